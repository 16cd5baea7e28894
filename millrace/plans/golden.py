"""Documents against golden versions of themselves: spans in their lines, roles, fields and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import golden
from millrace.plans.registry import query
from millrace.sources.tables import Tables

PAGE = 5
LINES_SQL = f"""l AS (SELECT id, k // {PAGE} + 1 AS page, k % {PAGE} + 1 AS line, text, k FROM (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL))"""


def drawn(salt: str, *more: Column) -> Column:
    """Two hexadecimal digits drawn from the id and more."""
    return F.substring(F.md5(F.concat(F.lit(salt), *[c.cast("string") for c in (F.col("id"), *more)])), 1, 2)


@query(f"""
WITH {LINES_SQL}, q AS (SELECT id, CASE WHEN k = 0 THEN 'title' ELSE 'body' END AS field, k AS place, substr(md5('s' || id || k), 1, 2) AS d, page, line, text FROM l WHERE k = 0 OR substr(md5('p' || id || k), 1, 2) < '60'),
r AS (SELECT id, field, place, CASE WHEN d < '28' THEN NULL WHEN d < '40' THEN page + 1 ELSE page END AS page, CASE WHEN d < '28' THEN NULL ELSE line END AS line, trim(CASE WHEN d BETWEEN '20' AND '30' THEN text || ' zz' WHEN d > 'f0' THEN ' ' ELSE text END) AS n FROM q),
o AS (SELECT r.*, l.id IS NOT NULL AND (n = '' OR contains(l.text, n)) AS fine FROM r LEFT JOIN l ON l.id = r.id AND l.page = r.page AND l.line = r.line),
w AS (SELECT id, n, min({{'page': page, 'line': line}}) AS spot FROM (SELECT DISTINCT id, n FROM o WHERE NOT fine AND n <> '') JOIN l USING (id) WHERE contains(l.text, n) GROUP BY id, n)
SELECT o.id, field, place, CASE WHEN o.n = '' THEN 'missing_line' WHEN spot IS NULL THEN 'missing_span' ELSE 'wrong_line:' || spot.page || ':' || spot.line END AS error FROM o LEFT JOIN w ON w.id = o.id AND w.n = o.n WHERE NOT fine AND NOT (o.page IS NULL AND (o.n = '' OR spot IS NOT NULL))
""")
def golden_spans(t: Tables) -> DataFrame:
    """Required spans that are missing from their documents, or stand on another line."""
    lines = golden.page_lines(t.documents, "doc_id", "text", PAGE)
    k = ((F.col("page") - 1) * PAGE + F.col("line") - 1).cast("long")
    d = drawn("s", F.col("place"))
    spans = lines.withColumn("place", k).filter((F.col("place") == 0) | (drawn("p", F.col("place")) < "60"))
    text = F.when(d.between("20", "30"), F.concat("text", F.lit(" zz"))).when(d > "f0", " ").otherwise(F.col("text"))
    page = F.when(d >= "28", F.when(d < "40", F.col("page") + 1).otherwise(F.col("page")))
    required = spans.select("id", F.when(F.col("place") == 0, "title").otherwise("body").alias("field"), "place", page.alias("page"), F.when(d >= "28", F.col("line")).alias("line"), text.alias("text"))
    return golden.span_errors(lines, required)


@query("""
WITH d AS (SELECT doc_id AS id, source, lang, substr(md5('role' || doc_id), 1, 1) AS r, substr(md5('found' || doc_id), 1, 1) AS f, substr(md5('warn' || doc_id), 1, 1) AS w FROM documents),
g AS (SELECT id, CASE WHEN r < '8' THEN 'public' WHEN r < 'a' THEN 'manual' WHEN r < 'd' THEN 'quarantine' ELSE 'unextractable' END AS role, CASE WHEN w <> '0' THEN source END AS source, lang, CASE WHEN w >= '2' THEN CASE WHEN w < '8' THEN ['a', 'b'] ELSE [] END END AS ew FROM d WHERE r < 'f'),
h AS (SELECT id, source, CASE WHEN f = '1' THEN 'xx' ELSE lang END AS lang, CASE WHEN w < '7' THEN ['a', 'b'] WHEN w = 'f' THEN ['c'] ELSE [] END AS fw FROM d WHERE f <> '0'),
j AS (SELECT coalesce(g.id, h.id) AS id, role, h.id IS NOT NULL AS there, g.source AS es, h.source AS fs, g.lang AS el, h.lang AS fl, ew, fw FROM g FULL JOIN h ON g.id = h.id),
c AS (SELECT id, unnest([CASE WHEN there AND role <> 'unextractable' AND es IS NOT NULL AND es IS DISTINCT FROM fs THEN 'fixture_drift:source' END, CASE WHEN there AND role <> 'unextractable' AND el IS NOT NULL AND el IS DISTINCT FROM fl THEN 'fixture_drift:lang' END,
  CASE WHEN there AND role IN ('quarantine', 'unextractable') AND ew IS NOT NULL AND ew <> fw THEN 'fixture_drift:warnings' END, CASE WHEN there AND role = 'unextractable' AND len(fw) = 0 THEN 'candidate_unextractable_became_extractable' END, CASE WHEN role IS NULL THEN 'candidate_unexpected' END,
  CASE WHEN NOT there THEN CASE role WHEN 'public' THEN 'candidate_missing' WHEN 'manual' THEN 'candidate_manual_missing' WHEN 'quarantine' THEN 'candidate_quarantine_missing' END END]) AS error FROM j)
SELECT * FROM c WHERE error IS NOT NULL
""")
def golden_sets(t: Tables) -> DataFrame:
    """Documents against golden roles: public, manual, quarantined, unextractable."""
    d = t.documents.select(F.col("doc_id").alias("id"), "source", "lang")
    role, found, warned = (F.substring(drawn(x), 1, 1) for x in ("role", "found", "warn"))
    pair, none = F.lit(["b", "a"]), F.lit([]).cast("array<string>")
    roles = F.when(role < "8", "public").when(role < "a", "manual").when(role < "d", "quarantine").otherwise("unextractable")
    expected = d.filter(role < "f").select("id", roles.alias("role"), F.when(warned != "0", F.col("source")).alias("source"), "lang", F.when(warned >= "2", F.when(warned < "8", pair).otherwise(none)).alias("warnings"))
    got = d.filter(found != "0").select("id", "source", F.when(found == "1", "xx").otherwise(F.col("lang")).alias("lang"), F.when(warned < "7", F.lit(["a", "b"])).when(warned == "f", F.lit(["c"])).otherwise(none).alias("warnings"))
    return golden.set_errors(got, expected, ["source", "lang"])
