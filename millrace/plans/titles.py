"""Titles made of table values and damaged as scanners damage them: detection, repair, canonical forms, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import titles
from millrace.plans.registry import query
from millrace.sources.tables import Tables

PHRASES = ("subject to change", "scan the code")
WORDS_SQL = r"list_filter(regexp_split_to_array(trim(title), '\s+'), lambda w: w <> '')"

#: Part names in eight states: sound, letters apart, boilerplate, junk, leaders, few letters, over-long, dashed.
DAMAGED_SQL = r"""d AS (SELECT p_partkey AS k, p_name, p_type, CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN trim(regexp_replace(upper(p_name), '([A-Z])', '\1 ', 'g')) WHEN 2 THEN p_name || ' subject to change'
  WHEN 3 THEN p_name || '!!!!!!' WHEN 4 THEN p_name || ' ..... 12' WHEN 5 THEN p_size || ' 12 34 $ ' || left(p_name, 3) WHEN 6 THEN repeat(p_name || ' ', 10) ELSE p_name || ' - ' || p_type END AS title FROM part)"""


def damaged(t: Tables) -> DataFrame:
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    forms = [
        name, F.trim(F.regexp_replace(F.upper(name), "([A-Z])", "$1 ")), F.concat(name, F.lit(" subject to change")), F.concat(name, F.lit("!!!!!!")), F.concat(name, F.lit(" ..... 12")),
        F.concat(F.col("p_size").cast("string"), F.lit(" 12 34 $ "), F.substring(name, 1, 3)), F.repeat(F.concat(name, F.lit(" ")), 10), F.concat(name, F.lit(" - "), kind),
    ]
    title = forms[7]
    for n in range(7):
        title = F.when(k % 8 == n, forms[n]).otherwise(title)
    return t.part.select(k.alias("k"), "p_name", "p_type", title.alias("title"))


@query(rf"""
WITH {DAMAGED_SQL}, w AS (SELECT *, {WORDS_SQL} AS ws, length(regexp_replace(title, '[^A-Za-z]', '', 'g')) AS letters, contains(lower(title), 'subject to change') OR contains(lower(title), 'scan the code') OR regexp_matches(title, '\.{{4,}}') AS boiler FROM d),
c AS (SELECT *, len(list_filter(ws, lambda x: length(x) = 1)) AS single, len(list_filter(ws, lambda x: length(x) <= 2)) AS short, replace(lower(title), ' ', '-') AS slug FROM w),
s AS (SELECT *, list_filter(string_split(slug, '-'), lambda x: x <> '') AS ps FROM c)
SELECT k, boiler, length(trim(title)) > 80 OR regexp_matches(title, '!{{5,}}|\.{{5,}}') OR boiler OR (len(ws) >= 4 AND (single >= 3 OR short >= len(ws) * 0.65)) OR (letters > 0 AND letters < length(trim(title)) * 0.35) AS corrupt,
  (len(ps) >= 5 AND len(list_filter(ps, lambda x: length(x) = 1)) >= len(ps) * 0.55) OR (len(ps) >= 3 AND len(list_filter(ps, lambda x: length(x) > 2)) = 0 AND length(slug) <= 14) AS corrupt_slug,
  round(length(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) / length(title), 6) AS letter_share FROM s
""")
def corrupt_titles(t: Tables) -> DataFrame:
    """Which titles and slugs are damaged, and the share of letters."""
    title = F.col("title")
    return damaged(t).select(
        "k", titles.boilerplate(title, PHRASES).alias("boiler"), titles.corrupt_title(title, PHRASES).alias("corrupt"), titles.corrupt_slug(F.replace(F.lower(title), F.lit(" "), F.lit("-"))).alias("corrupt_slug"), F.round(titles.letter_share(title), 6).alias("letter_share")
    )


REPAIRS = {"coldwidget": "Cold Widget", "smallbolt": "Small Bolt", "largebolt": "Large Bolt"}


@query(r"""
SELECT p_partkey AS k, CASE p_name WHEN 'cold widget' THEN 'Cold Widget' WHEN 'small bolt' THEN 'Small Bolt' WHEN 'large bolt' THEN 'Large Bolt' ELSE upper(left(p_name, 1)) || replace(substr(p_name, 2), ' ', '') || ' - ' || p_type END AS title,
  p_name AS cleaned, p_partkey % 3 = 1 AS rejected FROM part
""")
def repaired_titles(t: Tables) -> DataFrame:
    """Titles closed up or repaired by their key, cleaned at their ends, and titles that are none."""
    name, k = F.col("p_name"), F.col("p_partkey")
    spaced = F.concat(F.trim(F.regexp_replace(name, "(.)", "$1 ")), F.lit(" - "), F.col("p_type"))
    known = name.isin("cold widget", "small bolt", "large bolt")
    ragged = F.when(k % 4 == 0, F.concat(F.lit('Tonight: "'), name, F.lit(' PG" at 8'))).when(k % 4 == 1, F.concat(name, F.lit("  [PG-"))).when(k % 4 == 2, F.concat(name, F.lit(" "), name)).otherwise(F.concat(name, F.lit(" (pg-13) ")))
    offered = F.when(k % 3 == 0, F.concat(F.lit("Pool Party at 8 pm "), name)).when(k % 3 == 1, F.element_at(F.lit(["PG", "8:30 pm show", "by the main pool", " "]), (k % 4 + 1).cast("int"))).otherwise(name)
    return t.part.select(
        k.alias("k"), titles.close_up(F.when(known, name).otherwise(spaced), REPAIRS).alias("title"), titles.clean_tail(ragged).alias("cleaned"), titles.rejected_title(offered, ("Pool Party",), r"\bpool\b").alias("rejected")
    )


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 3 = 2 THEN 'from ' ELSE '' END || (1 + p_size % 9) || ':0' || (p_size % 7) || CASE WHEN p_size % 3 = 1 THEN ' p.m.' ELSE ' pm' END AS clock, p_name || ': ' || 'day' AS canonical, CASE WHEN p_size % 4 < 3 THEN 'exact' ELSE 'disagreement' END AS status,
  CASE p_size % 4 WHEN 2 THEN 'find a friend' WHEN 1 THEN 'find' ELSE p_name END AS value, p_name || ' and ' || lower(p_type) AS key, CASE WHEN p_name = 'cold widget' AND p_type = 'PROMO' THEN 'L1' ELSE 'unknown' END AS id,
  NOT (p_name = 'cold widget' AND p_type = 'PROMO') AS review, p_size % 3 = 0 AS fee, CASE WHEN p_size % 5 = 0 AND p_type <> 'PROMO' THEN left('Ask at the arcade for ' || p_name, 20) END AS bled FROM part
""")
def canonical_titles(t: Tables) -> DataFrame:
    """Clock texts repaired, titles in canonical form and compared, labels looked up, fees and marks of other categories found."""
    name, z, kind = F.col("p_name"), F.col("p_size"), F.col("p_type")
    h, m = (z % 9 + 1).cast("string"), (z % 7).cast("string")
    clock = F.when(z % 3 == 0, F.concat(h, F.lit(".0"), m, F.lit(" pm"))).when(z % 3 == 1, F.concat(h, F.lit(":O"), m, F.lit(" p.m."))).otherwise(F.concat(F.lit("fro* "), h, F.lit(":0"), m, F.lit(" pm")))
    a = F.when(z % 4 == 0, name).when(z % 4 == 1, "find").when(z % 4 == 2, "find a friend").otherwise(name)
    b = F.when(z % 4 == 0, name).when(z % 4 == 1, "find").when(z % 4 == 2, "find").otherwise(F.concat(name, F.lit(" x")))
    label = titles.vocabulary(F.concat(F.upper(name), F.lit("! & "), kind), {"cold widget and promo": "L1"})
    same = titles.agreement(a, b, [("find", "find a friend", "find a friend")])
    fee = F.when(z % 3 == 0, F.concat(name, F.lit(" ($)"))).otherwise(name)
    bled = titles.bleed(F.when(z % 5 == 0, F.concat(F.lit("Ask at the arcade for "), name)), kind, {"PROMO": r"\barcade\b"}, 20)
    return t.part.select(
        F.col("p_partkey").alias("k"), titles.repair_clock(clock).alias("clock"), titles.canonical_title(F.concat(F.upper(name), F.lit(":Day [PG]")), {}).alias("canonical"),
        same["status"].alias("status"), same["value"].alias("value"), label["key"].alias("key"), label["id"].alias("id"), label["review"].alias("review"), titles.mentions_fee(fee).alias("fee"), bled.alias("bled"),
    )


@query(r"""
WITH d AS (SELECT doc_id, lower(left(text, 60)) AS x, left(coalesce(text, ''), 500) AS lead FROM documents)
SELECT doc_id, length(lead) AS lead, trim(regexp_replace(strip_accents(regexp_replace(x, '([à-åç-ïñ-öù-ýÿ])', '\1-', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM d WHERE x IS NOT NULL
""")
def folded_slugs(t: Tables) -> DataFrame:
    """Slugs of the texts' beginnings without marks, and the lengths of their leads."""
    head = F.substring("text", 1, 60)
    return t.documents.filter("text is not null").select("doc_id", F.length(F.substring(F.coalesce("text", F.lit("")), 1, 500)).cast("long").alias("lead"), titles.folded_slug(head).alias("slug"))


FAMILIES = [("filename:frame", "name LIKE '%frame%'", "frame", "high"), ("filename:sign", "name LIKE '%sign%'", "sign", "high"), ("text:both", "seen LIKE '%activities%' AND seen LIKE '%movie%'", "frame", "medium"), ("shape:tall", "ratio >= 1.5", "sign", "low")]


@query("""
WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'a-frame.pdf' WHEN 1 THEN 'rec-sign.pdf' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 2 THEN 'activities and a movie' ELSE '' END AS seen, p_size / 20.0 AS ratio FROM part)
SELECT k, CASE WHEN name LIKE '%frame%' THEN 'frame' WHEN name LIKE '%sign%' THEN 'sign' WHEN seen <> '' THEN 'frame' WHEN ratio >= 1.5 THEN 'sign' ELSE 'unknown' END AS family,
  CASE WHEN k % 5 < 2 THEN 'high' WHEN seen <> '' THEN 'medium' WHEN ratio >= 1.5 THEN 'low' ELSE 'none' END AS confidence,
  concat_ws(',', CASE WHEN name LIKE '%frame%' THEN 'filename:frame' END, CASE WHEN name LIKE '%sign%' THEN 'filename:sign' END, CASE WHEN seen <> '' THEN 'text:both' END, CASE WHEN ratio >= 1.5 THEN 'shape:tall' END) AS signals FROM m
""")
def document_families(t: Tables) -> DataFrame:
    """Documents classified by the first rule over names, texts and shapes, with all signals."""
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, "a-frame.pdf").when(k % 5 == 1, "rec-sign.pdf").otherwise(F.col("p_name"))
    m = t.part.select(k.alias("k"), name.alias("name"), F.when(k % 5 == 2, "activities and a movie").otherwise("").alias("seen"), (F.col("p_size") / 20.0).alias("ratio"))
    first = lambda at, default: F.coalesce(*[F.when(F.expr(r[1]), F.lit(r[at])) for r in FAMILIES], F.lit(default))
    return m.select("k", first(2, "unknown").alias("family"), first(3, "none").alias("confidence"), F.concat_ws(",", *[F.when(F.expr(test), F.lit(s)) for s, test, _, _ in FAMILIES]).alias("signals"))
