"""Parts, suppliers and customers as search hits: scorers by kind, caps, hydration, word vectors, intent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import temporal as T
from millrace.operators import ranking, search
from millrace.plans.registry import query
from millrace.sources.tables import Tables

LEVEL = "CASE WHEN {t} = 'blue ring' THEN {e} WHEN starts_with({t}, 'blue ring') THEN {p} WHEN contains({t}, 'blue ring') THEN {c} ELSE (contains({t}, 'blue')::INT + contains({t}, 'ring')::INT) * {k} / 2.0 END"
HIT_SQL = f"""h AS (
  SELECT 'part' AS kind, p_partkey AS id, {LEVEL.format(t="p_name", e=110, p=90, c=70, k=50)} + {LEVEL.format(t="lower(p_name || ' ' || p_type)", e=0, p=0, c=30, k=24)} + least(p_size, 30) * 0.5 AS score FROM part
  UNION ALL SELECT 'supplier', s_suppkey, {LEVEL.format(t="lower(s_name)", e=105, p=88, c=68, k=46)} + {LEVEL.format(t="lower(s_name || ' blue nation ' || s_nationkey)", e=0, p=0, c=26, k=20)} + CASE WHEN s_suppkey % 4 = 0 THEN 15 ELSE 0 END FROM supplier
  UNION ALL SELECT 'segment', min(c_custkey), {LEVEL.format(t="lower(c_mktsegment)", e=80, p=70, c=55, k=42)} + {LEVEL.format(t="''", e=0, p=0, c=0, k=0)} + CASE WHEN c_mktsegment = 'FURNITURE' THEN 50 ELSE 0 END FROM customer GROUP BY c_mktsegment)"""
CAPS = {"part": 12, "supplier": 5, "segment": 1}


def hits(t: Tables) -> DataFrame:
    """(kind, id, score) of all rows of three kinds for one query."""
    q = "blue ring"
    part = search.Scorer(F.col("p_name"), F.concat_ws(" ", "p_name", "p_type"), (110, 90, 70, 50), (0, 0, 30, 24), (F.least("p_size", F.lit(30)) * 0.5,))
    near = F.when(F.col("s_suppkey") % 4 == 0, 15).otherwise(0)
    supplier = search.Scorer(F.col("s_name"), F.concat_ws(" blue nation ", "s_name", F.col("s_nationkey").cast("string")), (105, 88, 68, 46), (0, 0, 26, 20), (near,))
    wanted = search.intent(F.lit(q.split()), {"ring": "FURNITURE", "blue ring": "HOUSEHOLD"})
    segment = search.Scorer(F.col("c_mktsegment"), F.lit(""), (80, 70, 55, 42), (0, 0, 0, 0), (F.when(wanted == F.col("c_mktsegment"), 50).otherwise(0),))
    row = lambda df, kind, k, s: df.select(F.lit(kind).alias("kind"), F.col(k).alias("id"), s.score(q).alias("score"))
    segments = t.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    return row(t.part, "part", "p_partkey", part).unionByName(row(t.supplier, "supplier", "s_suppkey", supplier)).unionByName(row(segments, "segment", "c_custkey", segment))


@query(f"WITH {HIT_SQL} SELECT kind, id, round(score, 4)::DOUBLE AS score FROM h WHERE score > 0")
def kind_scores(t: Tables) -> DataFrame:
    """All scoring rows of three kinds, each by its own levels and boosts."""
    return hits(t).filter("score > 0").withColumn("score", F.round("score", 4))


@query(f"""
WITH {HIT_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, id) AS place FROM h WHERE score > 0 QUALIFY place <= 40)
SELECT kind, id, place FROM top QUALIFY row_number() OVER (PARTITION BY kind ORDER BY place) <= CASE kind WHEN 'part' THEN 12 WHEN 'supplier' THEN 5 ELSE 1 END
""")
def capped_hits(t: Tables) -> DataFrame:
    """The first forty hits, capped by kind."""
    return search.capped(hits(t).filter("score > 0"), CAPS, [F.desc("score"), F.asc("kind"), F.asc("id")], 40).select("kind", "id", "place")


@query(f"""
WITH {HIT_SQL}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind, id) AS place FROM h WHERE score > 0 QUALIFY place <= 30)
SELECT place, kind, id, p_name AS title FROM top JOIN part ON kind = 'part' AND p_partkey = id AND p_size % 5 > 0 UNION ALL SELECT place, kind, id, s_name FROM top JOIN supplier ON kind = 'supplier' AND s_suppkey = id
""")
def hydrated_hits(t: Tables) -> DataFrame:
    """The first thirty hits with their rows' titles; hits whose row is gone are dropped."""
    top = ranking.numbered_top(hits(t).filter("score > 0"), [F.desc("score"), F.asc("kind"), F.asc("id")], 30)
    sources = {"part": t.part.filter("p_size % 5 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))}
    return search.hydrate(top, sources, ["title"])


@query("""
WITH w AS (SELECT p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS a, [lower(p_type)] AS b, [lower(replace(p_brand, 'Brand#', ''))] AS c FROM part)
SELECT k, len(list_distinct(a || b || c || ['brand'])) AS words, CASE WHEN (list_contains(a, 'ring') OR list_contains(b, 'ring')) AND list_contains(a || b, 'promo') THEN 1.4 END::DOUBLE AS rank FROM w
""")
def word_vectors(t: Tables) -> DataFrame:
    """Weighted word vectors of names, types and brands, ranked for a query of two words."""
    vector = search.word_weights({"A": (F.col("p_name"), 1.0), "B": (F.col("p_type"), 0.4), "C": (F.col("p_brand"), 0.2)})
    v = t.part.select(F.col("p_partkey").alias("k"), vector.alias("v"))
    return v.select("k", F.size("v").cast("long").alias("words"), search.rank(F.col("v"), "ring PROMO").alias("rank"))


@query("""
WITH s AS (SELECT n_name, n_regionkey, count(s_suppkey) AS n, count(*) FILTER (s_acctbal > 5000) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, n, row_number() OVER (ORDER BY n_name) AS place FROM s WHERE n_regionkey <> 2 AND rich > 0
""")
def entities_by_stats(t: Tables) -> DataFrame:
    """Nations outside a region with a rich supplier, by name."""
    stats = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_acctbal") > 5000).alias("rich"))
    kept = t.nation.filter("n_regionkey <> 2").join(stats, "n_nationkey").filter("rich > 0")
    return kept.select("n_name", "n", F.row_number().over(Window.orderBy("n_name")).cast("long").alias("place"))  # one row a nation


@query("""
WITH e AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 45 MINUTE WHEN event_id % 10 = 0 THEN ts - INTERVAL 5 MINUTE END AS fin, ts FROM events)
SELECT event_id, CASE WHEN abs(m - 780) <= 75 THEN 'now' WHEN m < 780 THEN 'past' ELSE 'later' END AS status, greatest(14, least(86, floor(14 + (m - 600) * 72 / 720.0 + 0.5)))::BIGINT AS position,
  CASE WHEN fin IS NULL OR fin < ts THEN ts + INTERVAL 60 MINUTE ELSE fin END AS ends FROM e
""")
def timeline_marks(t: Tables) -> DataFrame:
    """Events against one o'clock within 75 minutes, on a scale from 14 to 86, with ends put right."""
    k, m = F.col("event_id"), T.minutes_of_day(F.col("ts"))
    shift = lambda n: F.timestamp_add("MINUTE", F.lit(n), F.col("ts"))
    end = F.when(k % 5 > 0, shift(45)).when(k % 10 == 0, shift(-5))
    return t.events.select("event_id", T.relative_status(m, F.lit(780), 75).alias("status"), T.on_scale(m, (600, 1320), (14, 86)).alias("position"), T.proper_end(F.col("ts"), end, 60).alias("ends"))


@query("""
WITH f AS (SELECT user_id, props AS href, arg_min(event_type, event_id) AS label, min(event_id) AS pos FROM events GROUP BY user_id, props)
SELECT user_id, href, label, CASE WHEN pos = min(pos) OVER (PARTITION BY user_id) THEN 'primary' ELSE 'secondary' END AS intent FROM f
""")
def recovery_actions(t: Tables) -> DataFrame:
    """What to offer each user again: their events by target, the first of each, the first of all primary."""
    first = ranking.dedupe_first(t.events.select("user_id", F.col("props").alias("href"), F.col("event_type").alias("label"), F.col("event_id").alias("pos")), ["user_id", "href"], F.col("pos"))
    begins = t.events.groupBy("user_id").agg(F.min("event_id").alias("begin"))
    return first.join(begins, "user_id").select("user_id", "href", "label", F.when(F.col("pos") == F.col("begin"), "primary").otherwise("secondary").alias("intent"))


@query("""
WITH s AS (SELECT s_suppkey AS id, sha256('h' || s_suppkey % 6) AS h FROM supplier), c AS (SELECT c_custkey, sha256('h' || c_custkey % 8) AS h FROM customer), p AS (SELECT h, count(*) AS candidates FROM c GROUP BY h),
f AS (SELECT 'supplier' AS family, 'supplier:' || id AS source, h, 'https://x.org/' || id AS url FROM s UNION ALL SELECT 'nation', 'nation:' || n_nationkey, NULL, '' FROM nation UNION ALL SELECT 'region', 'region:' || r_regionkey, sha256('h1'), 'http://r' FROM region)
SELECT family, source, coalesce(candidates, 0) AS candidates, f.h IS NOT NULL AND regexp_matches(url, '^https?://') AS backed FROM f LEFT JOIN p ON p.h = f.h
""")
def source_inventory(t: Tables) -> DataFrame:
    """Sources of several families under stable ids, with the candidates of their content and whether they are backed."""
    digest = lambda c: F.sha2(F.concat(F.lit("h"), c.cast("string")), 256)
    none = F.lit(None).cast("string")
    family = lambda df, name, k, h, url: df.select(F.lit(name).alias("family"), F.concat(F.lit(f"{name}:"), F.col(k).cast("string")).alias("source"), h.alias("h"), url.alias("url"))
    rows = family(t.supplier, "supplier", "s_suppkey", digest(F.col("s_suppkey") % 6), F.concat(F.lit("https://x.org/"), F.col("s_suppkey").cast("string")))
    rows = rows.unionByName(family(t.nation, "nation", "n_nationkey", none, F.lit(""))).unionByName(family(t.region, "region", "r_regionkey", digest(F.lit(1)), F.lit("http://r")))
    counts = t.customer.groupBy(digest(F.col("c_custkey") % 8).alias("h")).agg(F.count(F.lit(1)).alias("candidates"))
    backed = F.coalesce(F.col("h").rlike("^[0-9a-f]{64}$"), F.lit(False)) & F.col("url").rlike("^https?://")
    return rows.join(counts, "h", "left").select("family", "source", F.coalesce("candidates", F.lit(0)).alias("candidates"), backed.alias("backed"))


@query("""
WITH r AS (SELECT c_custkey AS k, c_mktsegment AS kind, c_custkey % 4 = 0 AS backed, CASE WHEN c_custkey % 3 = 0 THEN 'free' ELSE 'paid' END AS state FROM customer)
SELECT k, state, CASE WHEN backed AND state = 'free' THEN CASE WHEN k % 2 = 0 THEN 'base,kit,wood' ELSE 'kit,wood' END WHEN k % 2 = 0 THEN 'base' ELSE '' END AS options FROM r
""")
def option_rows(t: Tables) -> DataFrame:
    """Priced options added once to free records with evidence, whose state stays free."""
    k = F.col("c_custkey")
    own = F.when(k % 2 == 0, F.array(F.lit("base"))).otherwise(F.lit([]).cast("array<string>"))
    takes = (k % 4 == 0) & (k % 3 == 0)
    options = F.when(takes, F.array_distinct(F.concat(own, F.lit(["kit", "wood", "kit"])))).otherwise(own)
    return t.customer.select(k.alias("k"), F.when(k % 3 == 0, "free").otherwise("paid").alias("state"), F.array_join(options, ",").alias("options"))
