"""Titles matched, paired and supported by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import fuzzy, titles
from millrace.operators import fuzzy as alike
from millrace.plans.registry import query
from millrace.sources.tables import Tables


def _titles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(lang, raw, text) of the opening sentences of labelled documents and of all others."""
    raw = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), r"^[^.!?\n]*", 0))
    own = t.documents.select("doc_id", "lang", raw.alias("raw"), fuzzy.plain_words(raw).alias("text")).filter("text <> ''")
    labelled = t.labels.select("doc_id").distinct()
    return own.join(labelled, "doc_id", "left_semi"), own.join(labelled, "doc_id", "left_anti")


def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'))"


#: Opening sentences of labelled documents (a) and of the others (b).
TITLES_SQL = rf"""d AS (SELECT doc_id, lang, trim(regexp_extract(coalesce(text, ''), '^[^.!?\n]*')) AS raw FROM documents),
a AS (SELECT DISTINCT lang, {_plain("raw")} AS x FROM d WHERE doc_id IN (SELECT doc_id FROM labels) AND {_plain("raw")} <> ''),
b AS (SELECT DISTINCT lang, {_plain("raw")} AS x FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND {_plain("raw")} <> '')"""


def blocks_sql(pairs: str) -> str:
    """Common table expressions ``seg`` and ``blocks`` (id, m): the characters of the matching blocks of ``pairs`` (id, a, b), by all substrings."""
    best = "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda l: CASE WHEN contains(b, substr(a, i, l)) THEN {'l': l, 'i': -i} END))))"
    return f"""seg AS (
  SELECT id, a, b, {best} AS m FROM {pairs}
  UNION ALL
  SELECT id, a, b, {best} FROM (SELECT id, s.a, s.b FROM (SELECT id, unnest([{{'a': substr(a, 1, (-m.i - 1)::INT), 'b': substr(b, 1, (p - 1)::INT)}}, {{'a': substr(a, (-m.i + m.l)::INT), 'b': substr(b, (p + m.l)::INT)}}]) AS s
    FROM (SELECT *, strpos(b, substr(a, -m.i, m.l)) AS p FROM seg WHERE m IS NOT NULL)) WHERE s.a <> '' AND s.b <> '')
), blocks AS (SELECT id, coalesce(sum(m.l), 0) AS m FROM seg GROUP BY id)"""


def _near_sql(least: float, a: str = "a", b: str = "b") -> str:
    """Pairs of a and b of one language that may have that ratio: unmatched characters are at least as many as edits."""
    return f"SELECT row_number() OVER () AS id, {a}.lang, {a}.x AS a, {b}.x AS b FROM {a} JOIN {b} ON {a}.lang IS NOT DISTINCT FROM {b}.lang AND {a}.x <> {b}.x AND CASE WHEN abs(length({a}.x) - length({b}.x)) > (1 - {least}) * (length({a}.x) + length({b}.x)) THEN false ELSE levenshtein({a}.x, {b}.x) <= (1 - {least}) * (length({a}.x) + length({b}.x)) + 1e-9 END"


RATIO_SQL = "round(2.0 * m / (length(a) + length(b)), 6)"


@query(rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, split_part(text, chr(10), 1) AS line FROM conversations),
pairs AS (SELECT row_number() OVER () AS id, y.conv_id, y.turn, coalesce(x.line, '') AS a, coalesce(y.line, '') AS b FROM c y JOIN c x ON x.conv_id = y.conv_id AND x.turn = y.turn - 1 AND x.role = 'user' WHERE y.role = 'assistant'),
{blocks_sql("pairs")}
SELECT conv_id, turn, CASE WHEN a = b THEN 1.0 ELSE {RATIO_SQL} END AS ratio FROM pairs JOIN blocks USING (id)
""")
def fuzzy_title(t: Tables) -> DataFrame:
    """Matching-block likeness of each assistant turn's first line to that of the user turn before it."""
    c = t.conversations.select("conv_id", "turn", "role", F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")).alias("line"))
    asked = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("line").alias("asked"))
    both = c.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(fuzzy.ratio(F.col("asked"), F.col("line")), 6).alias("ratio"))


@query(f"""
WITH RECURSIVE {TITLES_SQL},
x AS (SELECT a.lang, a.x FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.x = b.x),
rest AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang IS NOT DISTINCT FROM a.lang AND x.x = a.x)),
pairs AS ({_near_sql(0.9, "rest")}), {blocks_sql("pairs")},
near AS (SELECT lang, a, b, {RATIO_SQL} AS ratio FROM pairs JOIN blocks USING (id) WHERE 2.0 * m / (length(a) + length(b)) >= 0.9 QUALIFY row_number() OVER (PARTITION BY lang, a ORDER BY 2.0 * m / (length(a) + length(b)) DESC, b) = 1)
SELECT lang, x AS title, x AS match, 'exact' AS how, 1.0 AS ratio FROM x UNION ALL SELECT lang, a, b, 'fuzzy', ratio FROM near
""")
def two_stage_match(t: Tables) -> DataFrame:
    """Titles of labelled documents matched to equal ones of other documents of their language, the rest to the most alike one."""
    left, right = _titles(t)
    m = alike.matched(left, right, ["lang"], 0.9)
    return m.select("lang", F.col("text").alias("title"), "match", "how", F.round("ratio", 6).alias("ratio"))


@query(f"""
WITH RECURSIVE {TITLES_SQL},
u AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.x = a.x)), v AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.lang IS NOT DISTINCT FROM a.lang AND b.x = a.x)),
pairs AS ({_near_sql(0.9, "u", "v")}), {blocks_sql("pairs")},
near AS (SELECT lang, a, b, {RATIO_SQL} AS ratio FROM pairs JOIN blocks USING (id) WHERE 2.0 * m / (length(a) + length(b)) >= 0.9)
SELECT * FROM near QUALIFY count(*) OVER (PARTITION BY lang, a) = 1 AND count(*) OVER (PARTITION BY lang, b) = 1
""")
def mutual_matches(t: Tables) -> DataFrame:
    """Titles that one side lacks, paired where each is the other's only likely partner."""
    left, right = _titles(t)
    m = alike.mutual(left, right, ["lang"], 0.9)
    return m.select("lang", "a", "b", F.round("ratio", 6).alias("ratio"))


def _scanned_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(replace(replace(replace(replace(lower({text}), '($)', ' '), '&', ' and '), '+', 'h'), '|', 'i'), '[^a-z0-9]+'), lambda w: w <> '')"


@query(rf"""
WITH RECURSIVE h AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_extract(html, '<p><b>([^<]*)<', 1), '^(\S+\s+){{2}}', '')) AS span FROM pages),
w AS (SELECT page_id AS id, title, span, {_scanned_sql("title")} AS tw, {_scanned_sql("span")} AS sw FROM h),
pairs AS (SELECT id, array_to_string(tw, '') AS a, array_to_string(sw, '') AS b FROM w), {blocks_sql("(SELECT * FROM pairs WHERE NOT contains(a, b) AND NOT contains(b, a) AND 2 * least(length(a), length(b)) >= 0.82 * (length(a) + length(b)))")},
r AS (SELECT w.*, a, b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE coalesce(2.0 * m / (length(a) + length(b)), 0.0) END AS near, list_filter(sw, lambda x: length(x) <= 2) AS short FROM w JOIN pairs USING (id) LEFT JOIN blocks USING (id))
SELECT id AS page_id, array_to_string(sw, ' ') AS read,
  len(tw) > 0 AND len(sw) > 0 AND (list_has_all(sw, tw) OR ((len(short) * 3 >= len(sw) OR (len(sw) >= 3 AND len(list_filter(sw, lambda x: length(x) = 1)) > 0) OR regexp_matches(span, '[|+]')) AND near >= 0.92)) AS title_supported,
  near >= 0.82 AS field_supported,
  CASE WHEN least(len(tw), len(sw)) < 2 THEN false ELSE CASE WHEN len(tw) <= len(sw) THEN sw[-len(tw):] = tw ELSE tw[-len(sw):] = sw END END AS ends FROM r
""")
def supported_titles(t: Tables) -> DataFrame:
    """Pages' titles against their first lines less two words: how these read when scanned, and whether they support or end the title."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    line = F.trim(F.regexp_replace(F.regexp_extract("html", "<p><b>([^<]*)<", 1), r"^(\S+\s+){2}", ""))
    h = t.pages.select("page_id", title.alias("title"), line.alias("span"))
    read = F.array_join(titles.scanned_words(F.col("span")), " ")
    ends = titles.ends_with_words(F.array_join(titles.scanned_words(F.col("title")), " "), read)
    return h.select("page_id", read.alias("read"), fuzzy.supports_title(F.col("title"), F.col("span")).alias("title_supported"), fuzzy.supports_field(F.col("title"), F.col("span")).alias("field_supported"), ends.alias("ends"))
