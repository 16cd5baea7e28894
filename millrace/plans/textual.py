"""Text, search, pages and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import arrays, scoring, temporal, text
from millrace.operators import aggregates, ranking, search
from millrace.plans.registry import query
from millrace.sources import readers
from millrace.sources.tables import Tables, fresh_folder

WEIGHTS = {"p_name": 150.0, "p_type": 60.0, "p_brand": 35.0}
SYNONYMS = {"bolt": ["screw", "threaded rod"], "gear": ["cog wheel"], "ring": ["band"]}


def _score_sql(f: str, q: str, w: float) -> str:
    """A field's score in SQL."""
    words = f"list_filter(regexp_split_to_array({f}, '[^a-z0-9]+'), lambda w: w <> '')"
    allowed = 0 if len(q) < 4 else 1 if len(q) <= 6 else 2
    d = f"list_min(list_filter(list_transform({words}, lambda w: CASE WHEN length(w) = {len(q)} AND w <> '{q}' AND damerau_levenshtein('{q}', w) = 1 AND levenshtein('{q}', w) = 2 THEN 1 ELSE levenshtein('{q}', w) END), lambda d: d <= {allowed}))"
    return f"(CASE WHEN {f} = '{q}' THEN 1.0 WHEN starts_with({f}, '{q}') THEN 0.92 WHEN contains({f}, '{q}') THEN 0.82 WHEN list_contains({words}, '{q}') THEN 0.42 WHEN {d} > 0 THEN 0.28::DOUBLE / {d} ELSE 0.0 END * {w})::DOUBLE"


def _search_sql(q: str) -> str:
    cols = ", ".join(f"{_score_sql(f'lower({f})', q, w)} AS s{k}" for k, (f, w) in enumerate(WEIGHTS.items()))
    hits = ", ".join(f"CASE WHEN s{k} > 0 THEN '{f}' END" for k, f in enumerate(WEIGHTS))
    return f"SELECT p_partkey, p_name, p_type, round(greatest(s0, s1, s2), 6) AS score, concat_ws(',', {hits}) AS hits FROM (SELECT *, {cols} FROM part) WHERE greatest(s0, s1, s2) > 0"


@query(f"SELECT p_partkey, score, hits, row_number() OVER (ORDER BY score DESC, p_name, p_partkey) AS rank FROM ({_search_sql('bolt')}) QUALIFY row_number() OVER (ORDER BY score DESC, p_name, p_partkey) <= 50")
def search_ranked(t: Tables) -> DataFrame:
    """The fifty best parts for a word (a top-k report)."""
    found = search.score(t.part, "Bolt ", WEIGHTS)
    top = found.orderBy(F.desc("score"), "p_name", "p_partkey").limit(50)
    return ranking.top_per(top.withColumn("all", F.lit(1)), ["all"], [F.desc("score"), F.asc("p_name"), F.asc("p_partkey")], 50).select("p_partkey", "score", "hits", "rank")


@query(f"WITH h AS ({_search_sql('promo')}) SELECT 'p_type' AS facet, p_type AS value, count(*) AS n FROM h GROUP BY p_type UNION ALL SELECT 'p_name', p_name, count(*) FROM h GROUP BY p_name")
def search_facets(t: Tables) -> DataFrame:
    """Facets over all hits of a search."""
    return aggregates.facet_counts(search.score(t.part, "promo", WEIGHTS), ["p_type", "p_name"])


@query(f"SELECT p_partkey, score, hits FROM ({_search_sql('wigdet')})")
def typo_match(t: Tables) -> DataFrame:
    """All parts for a misspelt word: a swap of neighbours."""
    return search.score(t.part, "wigdet", WEIGHTS).select("p_partkey", "score", "hits")


@query("SELECT p_name, count(*) AS n FROM part WHERE starts_with(lower(p_name), 'sm') GROUP BY p_name ORDER BY n DESC, p_name LIMIT 8")
def suggest(t: Tables) -> DataFrame:
    """The most frequent names that begin so (a top-k report)."""
    return search.suggest(t.part, "Sm", "p_name")


@query("""
WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS w FROM part),
x AS (SELECT p_partkey, list_concat(w, CASE WHEN list_contains(w, 'bolt') THEN ['screw', 'threaded rod', 'screw', 'threaded', 'rod'] WHEN list_contains(w, 'gear') THEN ['cog wheel', 'cog', 'wheel'] WHEN list_contains(w, 'ring') THEN ['band'] ELSE [] END) AS w FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(w)), '|') AS words FROM x
""")
def synonym_tokens(t: Tables) -> DataFrame:
    """Name tokens with synonyms."""
    words = text.expand_synonyms(text.tokens(F.col("p_name")), SYNONYMS)
    return t.part.select("p_partkey", F.array_join(F.array_sort(words), "|").alias("words"))


@query("""
WITH n AS (SELECT p_name, count(*) AS parts, '  ' || lower(p_name) || ' ' AS x FROM part GROUP BY p_name),
g AS (SELECT p_name, parts, list_distinct(list_transform(range(1, length(x) - 1), lambda k: substr(x, k, 3))) AS g FROM n),
p AS (SELECT a.p_name AS a, b.p_name AS b, a.parts * b.parts AS parts, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM g a JOIN g b ON a.p_name < b.p_name)
SELECT a, b, parts, round(shared / (total - shared), 6) AS similarity FROM p WHERE shared / (total - shared) >= 0.3
""")
def trigram_similarity(t: Tables) -> DataFrame:
    """Different part names that are alike by trigrams.

    Equal names are counted as one first. Names meet only on their rarest trigrams.
    """
    n = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("parts")).withColumn("g", scoring.trigrams(F.col("p_name")))
    met = search.similar_sets(n.select("p_name", "g"), "p_name", "g", 0.3)
    count = lambda s: n.select(F.col("p_name").alias(s), F.col("parts").alias(f"{s}n"))
    return met.join(count("a"), "a").join(count("b"), "b").select("a", "b", (F.col("an") * F.col("bn")).alias("parts"), F.round("similarity", 6).alias("similarity"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(regexp_replace(coalesce(text, ''), '\([0-9]{4}\)', '', 'g'), '^\s+|\s+$', '', 'g') AS r FROM documents),
m AS (SELECT doc_id, CASE WHEN x = '' THEN 1.0 WHEN r = '' THEN 0.0 ELSE length(regexp_replace(r, '[A-Za-z0-9\s''’":,&.!?-]', '', 'g')) / length(r) END AS g, len(regexp_extract_all(x, '[^ \n]+')) AS w FROM t)
SELECT doc_id, round(g, 6) AS garbage, CASE WHEN w < 10 OR g > 0.2 THEN 'low' WHEN g > 0.05 THEN 'medium' ELSE 'high' END AS tier FROM m
""")
def quality_tier(t: Tables) -> DataFrame:
    """Documents in tiers by their share of odd characters and their length."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \n]+"))
    g = text.garbage_ratio(F.col("text"))
    d = t.documents.select("doc_id", g.alias("g"), words.alias("w"))
    return d.select("doc_id", F.round("g", 6).alias("garbage"), F.when((F.col("w") < 10) | (F.col("g") > 0.2), "low").when(F.col("g") > 0.05, "medium").otherwise("high").alias("tier"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: regexp_full_match(w, '[A-Za-z]+')) AS w FROM documents)
SELECT doc_id, coalesce(len(w) >= 4 AND len(list_filter(w, lambda x: length(x) <= 2)) >= len(w) * 0.25, false) AS spaced FROM w
""")
def ocr_spaced(t: Tables) -> DataFrame:
    """Documents with many stray letters."""
    return t.documents.select("doc_id", text.letter_spaced(F.col("text"), share=0.25).alias("spaced"))


@query("""
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS compact,
  upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS title,
  left(sha256(lower(trim(p_name))), 24) AS short_id, regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uid FROM part
""".replace("\\\\", "\\"))
def identifiers(t: Tables) -> DataFrame:
    """Slugs, keys and stable identifiers of part names."""
    n = F.col("p_name")
    return t.part.select("p_partkey", text.slug(n).alias("slug"), text.compact_key(n).alias("compact"), text.title_case(n).alias("title"), text.short_id(n).alias("short_id"), text.md5_uuid(n).alias("uid"))


@query("""
WITH a AS (SELECT p_partkey, lower(p_name) AS x, regexp_replace(lower(p_name), '[aeiou]', '', 'g') AS y FROM part)
SELECT count(*) AS n, count(*) FILTER (x = y) AS agree, count(*) FILTER (levenshtein(x, y) <= 2) AS near FROM a
""")
def engine_agreement(t: Tables) -> DataFrame:
    """How often two normalisations of the names agree."""
    a = t.part.select(F.lower("p_name").alias("x"), F.regexp_replace(F.lower("p_name"), "[aeiou]", "").alias("y"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if(F.levenshtein("x", "y") <= 2).alias("near"))


@query("""
SELECT d.source, count(*) AS n, round(count(*) FILTER (l.doc_id IS NOT NULL) / count(*), 6) AS labelled, round(coalesce(avg(l.quality), 0), 6) AS good, round(coalesce(avg(l.toxic), 0), 6) AS toxic, count(DISTINCT d.lang) AS langs
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source
""")
def field_metrics(t: Tables) -> DataFrame:
    """Label rates of each source."""
    d = t.documents.select("doc_id", "source", "lang").join(t.labels.withColumn("has", F.lit(True)), "doc_id", "left")
    avg = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(aggregates.rate(F.col("has")), 6).alias("labelled"), avg("quality").alias("good"), avg("toxic").alias("toxic"), F.countDistinct("lang").alias("langs"))


@query("""
WITH e AS (SELECT event_type AS route, (props->>'k')::INT AS k, value FROM events)
SELECT route, count(*) AS hits, count(*) FILTER (k < 10) AS failed, count(*) FILTER (value > 90) AS slow, max(value) AS slowest, count(DISTINCT k) AS kinds FROM e GROUP BY route
""")
def crawler_log_audit(t: Tables) -> DataFrame:
    """Log entries per route: failures, slow ones, extremes."""
    e = t.events.select(F.col("event_type").alias("route"), arrays.json_int(F.col("props"), "k").alias("k"), "value")
    return e.groupBy("route").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("k") < 10).alias("failed"), F.count_if(F.col("value") > 90).alias("slow"), F.max("value").alias("slowest"), F.countDistinct("k").alias("kinds"))


LINES = ["{0}", "{{}}", '{{"b": "only other", "n": {1}}}', '{{"k": "text {1}"}}', "[{0}]", "no json {1}", '{{"k": {1}', ' {{"k": {1}, "nested": {{"k": 1}}}}']


@query("""
WITH l AS (SELECT CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '{}' WHEN 2 THEN '{"b": "only other", "n": ' || event_id || '}' WHEN 3 THEN '{"k": "text ' || event_id || '"}'
  WHEN 4 THEN '[' || props || ']' WHEN 5 THEN 'no json ' || event_id WHEN 6 THEN '{"k": ' || event_id ELSE ' {"k": ' || event_id || ', "nested": {"k": 1}}' END AS line FROM events)
SELECT TRY_CAST(line->>'k' AS INTEGER) AS k, TRY_CAST(line->>'n' AS BIGINT) AS n, count(*) AS lines FROM (SELECT * FROM l WHERE json_valid(line)) WHERE json_type(line) = 'OBJECT' GROUP BY ALL
""")
def log_lines(t: Tables) -> DataFrame:
    """Events written as log lines, sound and broken, and read again: what the objects among them say."""
    line = F.concat()
    for n, form in reversed(list(enumerate(LINES))):
        said = F.format_string(form.format("%1$s", "%2$d"), F.col("props"), F.col("event_id"))
        line = said if n == len(LINES) - 1 else F.when(F.col("event_id") % len(LINES) == n, said).otherwise(line)
    folder = fresh_folder(t.spark, "log-lines")
    t.events.select(line.alias("value")).write.text(folder)
    return readers.json_lines(t.spark, folder, T.StructType.fromDDL("k int, n bigint")).groupBy("k", "n").agg(F.count(F.lit(1)).alias("lines"))


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS p FROM pages)
SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM u
""")
def url_path(t: Tables) -> DataFrame:
    """The paths of pages."""
    return t.pages.select("page_id", text.url_path(F.col("url")).alias("path"))


@query(r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>.*?</h1>|<h2(?:\s[^>]*)?>.*?</h2>|<p(?:\s[^>]*)?>.*?</p>|<li(?:\s[^>]*)?>.*?</li>')) AS b FROM pages),
t AS (SELECT page_id, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM b)
SELECT page_id, tag, count(*) AS blocks, sum(length(x))::BIGINT AS characters FROM t WHERE x <> '' GROUP BY ALL
""")
def html_blocks(t: Tables) -> DataFrame:
    """The blocks of pages by tag."""
    b = readers.page_blocks(t.pages, tags=("h1", "h2", "p", "li"))
    return b.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("characters"))


@query(None)
def html_lines(t: Tables) -> DataFrame:
    """The text lines of pages."""
    return readers.page_lines(t.pages)


@query(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?[^"''\s>]+["'']?[^>]*>.*?</a>')) AS a FROM pages)
SELECT page_id, count(*) AS links, count(DISTINCT regexp_extract(a, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS targets FROM a GROUP BY page_id
""")
def html_links(t: Tables) -> DataFrame:
    """How many links pages have."""
    return readers.page_links(t.pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("targets"))


@query("""
SELECT page_id, sha256(concat_ws(chr(31), coalesce('=' || url, '~'), coalesce('=' || html, '~'))) AS hash FROM pages
""")
def content_hash(t: Tables) -> DataFrame:
    """Hashes of pages' contents."""
    return t.pages.select("page_id", text.content_hash(F.col("url"), F.col("html")).alias("hash"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Mon-Wed from 7:30 pm, $12' WHEN 1 THEN 'daily at 9 am for $1,250.50' WHEN 2 THEN 'Fri - Mon 20:15' WHEN 3 THEN 'weekends 8:00, $5 or $7.25' ELSE 'by request' END AS s, p_partkey % 5 AS m FROM part)
SELECT p_partkey, CASE m WHEN 0 THEN '1,2,3' WHEN 2 THEN '0,1,5,6' WHEN 3 THEN '0,6' END AS days, CASE m WHEN 0 THEN 1170 WHEN 1 THEN 540 WHEN 2 THEN 1215 WHEN 3 THEN 1200 END::INT AS minutes,
  CASE m WHEN 0 THEN '1200' WHEN 1 THEN '125050' WHEN 3 THEN '500,725' ELSE '' END AS cents FROM x
""")
def schedule_days(t: Tables) -> DataFrame:
    """Days, times and prices read from schedule texts."""
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "Mon-Wed from 7:30 pm, $12").when(k == 1, "daily at 9 am for $1,250.50").when(k == 2, "Fri - Mon 20:15").when(k == 3, "weekends 8:00, $5 or $7.25").otherwise("by request")
    x = t.part.select("p_partkey", s.alias("s"))
    cents = F.array_join(text.money_cents(F.col("s")).cast("array<string>"), ",")
    return x.select("p_partkey", F.array_join(temporal.parse_days(F.col("s")).cast("array<string>"), ",").alias("days"), temporal.parse_clock(F.col("s")).alias("minutes"), cents.alias("cents"))


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(p_name, 'bolt') THEN 'metal' END, CASE WHEN regexp_matches(p_name, 'hot|red') THEN 'warm' END, CASE WHEN regexp_matches(p_name, 'cold|blue') THEN 'cool' END], lambda x: x IS NOT NULL), ',') AS labels,
  CASE WHEN contains(p_name, 'bolt') THEN 'metal' WHEN regexp_matches(p_name, 'hot|red') THEN 'warm' WHEN regexp_matches(p_name, 'cold|blue') THEN 'cool' ELSE 'plain' END AS first FROM part
""")
def keyword_labels(t: Tables) -> DataFrame:
    """Labels of part names by patterns."""
    rules = [("metal", "bolt"), ("warm", "hot|red"), ("cool", "cold|blue")]
    return t.part.select("p_partkey", F.array_join(text.keyword_labels(F.col("p_name"), rules), ",").alias("labels"), text.first_label(F.col("p_name"), rules, "plain").alias("first"))


@query("""
WITH g AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(list_transform(range(1, len(f) + 1), lambda k: CASE WHEN k = 1 OR f[k] <> f[k - 1] THEN f[k] END), lambda x: x IS NOT NULL), '>') AS path FROM g
""")
def run_length_labels(t: Tables) -> DataFrame:
    """Orders' sequences of return flags without repeats in a row (an order has a few lines)."""
    g = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("s"))
    return g.select("l_orderkey", F.array_join(arrays.run_length_dedupe(F.transform("s", lambda x: x["l_returnflag"])), ">").alias("path"))


@query(r"""
WITH e AS (SELECT user_id || '/' || ts::DATE AS owner, ts, event_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || event_id || chr(13) || chr(10) || 'SUMMARY:' || event_type || chr(13) || chr(10) || 'DTSTART:' || strftime(ts, '%Y%m%dT%H%M%S') || chr(13) || chr(10)
  || 'DTEND:' || strftime(ts + INTERVAL 1 HOUR, '%Y%m%dT%H%M%S') || chr(13) || chr(10) || 'END:VEVENT' AS x FROM events WHERE ts IS NOT NULL)
SELECT owner, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(x, chr(13) || chr(10) ORDER BY ts, event_id) || chr(13) || chr(10) || 'END:VCALENDAR' AS ics FROM e GROUP BY owner
""")
def calendar_files(t: Tables) -> DataFrame:
    """A calendar file's text for each user and day."""
    e = t.events.withColumns({"owner": F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")), "end": F.timestamp_add("HOUR", F.lit(1), F.col("ts"))})
    return readers.calendar_text(e, "owner", "event_id", "event_type", "ts", "end")
