"""Presets, matching, promotion, limits and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import arrays, scoring, temporal, text
from millrace.operators import promotion, ranking
from millrace.plans.registry import query
from millrace.sources.tables import Tables


@query("""
SELECT preset, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN value < 10 THEN 'cheap' END, CASE WHEN hour(ts) >= 17 THEN 'tonight' END, CASE WHEN dayofweek(ts) IN (0, 6) THEN 'weekend' END,
  CASE WHEN event_type = 'view' AND value < 50 THEN 'easy' END], lambda x: x IS NOT NULL)) AS preset FROM events) GROUP BY preset
""")
def presets(t: Tables) -> DataFrame:
    """Named predicates, counted in one pass."""
    ts = F.col("ts")
    named = {"cheap": F.col("value") < 10, "tonight": F.hour(ts) >= 17, "weekend": temporal.day_number(ts).isin(0, 6), "easy": (F.col("event_type") == "view") & (F.col("value") < 50)}
    return t.events.select(F.explode(arrays.errors(*named.items())).alias("preset")).groupBy("preset").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 10 THEN p_retailprice END AS price, CASE WHEN p_size > 10 AND p_brand <> 'Brand#1' THEN 'verified' WHEN p_size > 10 THEN 'priced' ELSE 'unknown' END AS badge FROM part WHERE p_type <> 'PROMO'
""")
def redaction(t: Tables) -> DataFrame:
    """A public projection: prices only with evidence, the badge from what is left."""
    evidence = F.when(F.col("p_size") > 10, F.array(F.col("p_size"))).otherwise(F.array().cast("array<int>"))
    p = t.part.filter("p_type <> 'PROMO'").withColumn("claims", F.create_map(F.lit("price"), evidence))
    shown = arrays.has_evidence(F.col("claims"), ["price"])
    return p.select("p_partkey", F.when(shown, F.col("p_retailprice")).alias("price"), F.when(shown & (F.col("p_brand") != "Brand#1"), "verified").when(shown, "priced").otherwise("unknown").alias("badge"))


@query("""
WITH v AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '2024-01-01' + (s_suppkey % 60)::INT END AS a, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2024-02-01' + (s_suppkey % 45)::INT END AS b FROM supplier)
SELECT s_suppkey FROM v WHERE (a IS NULL OR a <= DATE '2024-02-10') AND (b IS NULL OR b >= DATE '2024-02-10')
""")
def validity_window(t: Tables) -> DataFrame:
    """Rows valid on a date; null bounds are open."""
    k, day = F.col("s_suppkey"), F.lit("2024-02-10").cast("date")
    since = F.when(k % 3 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int")))
    until = F.when(k % 4 != 0, F.date_add(F.lit("2024-02-01").cast("date"), (k % 45).cast("int")))
    return t.supplier.filter(F.coalesce(since <= day, F.lit(True)) & F.coalesce(until >= day, F.lit(True))).select("s_suppkey")


@query("""
SELECT 'price' AS sorted, o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 100 UNION ALL
SELECT 'status', o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 100
""")
def sort_orders(t: Tables) -> DataFrame:
    """The first hundred of two sort orders (a top-k report): by price, and by an ordinal status then date.

    Each is a limit over an order, which keeps a hundred rows a task, before the rows are numbered.
    """
    o = t.orders.withColumn("s", F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2))
    orders = {"price": [F.desc("o_totalprice"), F.asc("o_orderkey")], "status": [F.asc("s"), F.asc("o_orderdate"), F.asc("o_orderkey")]}
    top = [ranking.top_per(o.orderBy(*by).limit(100).withColumn("sorted", F.lit(name)), ["sorted"], by, 100, "place") for name, by in orders.items()]
    return top[0].union(top[1]).select("sorted", "o_orderkey", "place")


@query("""
WITH p AS (SELECT c_custkey, 100 - CASE WHEN c_acctbal < 0 THEN 35 ELSE 0 END - CASE WHEN c_acctbal BETWEEN 0 AND 500 THEN 20 ELSE 0 END - CASE WHEN c_mktsegment = 'BUILDING' THEN 10 ELSE 0 END - CASE WHEN c_nationkey > 20 THEN 25 ELSE 0 END AS s FROM customer)
SELECT c_custkey, greatest(0, least(100, s))::INT AS score, CASE WHEN s < 35 THEN 'hidden' WHEN s < 55 THEN 'low' WHEN s < 75 THEN 'medium' ELSE 'high' END AS tier FROM p
""")
def penalty_score(t: Tables) -> DataFrame:
    """A score from 100 less penalties, and its tier."""
    b = F.col("c_acctbal")
    rules = [(b < 0, 35), (b.between(0, 500), 20), (F.col("c_mktsegment") == "BUILDING", 10), (F.col("c_nationkey") > 20, 25)]
    s = F.lit(100)
    for cond, points in rules:
        s = s - F.when(cond, points).otherwise(0)
    p = t.customer.select("c_custkey", s.alias("s"))
    tier = F.when(F.col("s") < 35, "hidden").when(F.col("s") < 55, "low").when(F.col("s") < 75, "medium").otherwise("high")
    return p.select("c_custkey", F.greatest(F.lit(0), F.least(F.lit(100), "s")).alias("score"), tier.alias("tier"))


@query("""
WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS h, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, event_id, CASE WHEN h > 2 THEN 'hour' WHEN d > 6 THEN 'day' END AS failed, least(greatest(2 - h, 0), greatest(6 - d, 0))::INT AS remaining FROM w
""")
def layered_limits(t: Tables) -> DataFrame:
    """Two limits in order: the first that fails, and the tightest rest."""
    limits = {"hour": (F.date_trunc("hour", "ts"), 2), "day": (F.to_date("ts"), 6), "open": (F.lit(0), 0)}
    return promotion.layered_limits(t.events, ["user_id"], ["ts", "event_id"], limits).select("user_id", "event_id", "failed", "remaining")


@query("""
WITH u AS (SELECT user_id, max(ts) AS touched, bool_or(event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-25 00:00:00') AS live FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN (epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(touched)) // 86400000000 >= 30 THEN 'drop' WHEN (epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(touched)) // 86400000000 >= 7 AND NOT live THEN 'soft_delete' ELSE 'keep' END AS fate FROM u
""")
def retention(t: Tables) -> DataFrame:
    """What becomes of idle users."""
    live = (F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    u = t.events.groupBy("user_id").agg(F.max("ts").alias("touched"), F.bool_or(live).alias("live"))
    return promotion.retention(u, "touched", F.col("live"), F.lit("2024-02-05 00:00:00").cast("timestamp_ntz"), 7, 30).select("user_id", "fate")


@query("""
WITH d AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id)
SELECT CASE WHEN d.doc_id IS NOT NULL AND d.doc_id % 7 = 0 THEN 'stale' WHEN d.q = 1 AND d.x = 0 THEN 'approved' WHEN d.doc_id IS NOT NULL THEN 'rejected' WHEN length(c.text) < 300 THEN 'review' ELSE 'automatic' END AS outcome, count(*) AS n
FROM documents c LEFT JOIN d ON d.doc_id = c.doc_id GROUP BY 1
""")
def promotion_gate(t: Tables) -> DataFrame:
    """Documents by outcome of reviews, some of which saw other content."""
    docs = t.documents.select("doc_id", "text", text.content_hash(F.col("text")).alias("hash"))
    made = t.labels.join(docs, "doc_id").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("x"), F.first("hash").alias("hash"))
    made = made.select("doc_id", F.when((F.col("q") == 1) & (F.col("x") == 0), "approve").otherwise("reject").alias("decision"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.lit(1).alias("decided"))
    out = promotion.promote(docs, made, "doc_id", "hash", F.length("text") < 300)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS hash FROM lineitem GROUP BY l_orderkey
""")
def group_hash(t: Tables) -> DataFrame:
    """A hash of each order's lines that their order doesn't change."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat_ws(":", r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["l_suppkey"].cast("string"))), "|")
    return t.lineitem.groupBy("l_orderkey").agg(F.sha2(joined, 256).alias("hash"))


@query("""
WITH r AS (SELECT event_type, count(*) AS samples, quantile_disc(value, 0.75) AS p75 FROM events GROUP BY event_type)
SELECT event_type, samples, p75, CASE WHEN samples < 75 THEN 'few' WHEN p75 > 25 THEN 'over' ELSE 'ok' END AS verdict FROM r
""")
def percentile_budget(t: Tables) -> DataFrame:
    """The 75th percentile of each type against a budget."""
    r = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY value)").alias("p75"))
    return r.withColumn("verdict", F.when(F.col("samples") < 75, "few").when(F.col("p75") > 25, "over").otherwise("ok"))


@query("""
WITH g AS (SELECT o_custkey, o_orderpriority AS label, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(label, ' > ' ORDER BY first, label) AS labels FROM g GROUP BY o_custkey
""")
def labels_in_order(t: Tables) -> DataFrame:
    """Each customer's priorities in order of their first order."""
    g = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.min("o_orderkey").alias("first"))  # five labels a customer
    ordered = F.array_sort(F.collect_list(F.struct("first", "label")))
    return g.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda r: r["label"]), " > ").alias("labels"))


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) AS other FROM orders GROUP BY o_custkey
""")
def status_pivot(t: Tables) -> DataFrame:
    """Orders by status as columns."""
    s = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderstatus") == "P", "pending").otherwise("other")
    names = ["open", "filled", "pending", "other"]
    return t.orders.select("o_custkey", s.alias("s")).groupBy("o_custkey").pivot("s", names).count().fillna(0, names)


@query("""
WITH s AS (SELECT p_partkey, p_name, round(CASE WHEN contains(p_name, 'red') THEN 50 ELSE 0 END + CASE WHEN contains(p_name, 'bolt') THEN 50 ELSE 0 END, 6) AS phrase, CASE WHEN p_size <= 10 THEN 10 ELSE 0 END AS small FROM part)
SELECT p_partkey, (phrase + small)::DOUBLE AS score, concat_ws(',', CASE WHEN phrase > 0 THEN 'words' END, CASE WHEN small > 0 THEN 'small' END) AS reasons FROM s WHERE phrase + small >= 50
""")
def additive_score(t: Tables) -> DataFrame:
    """Parts by the words found and a boost, with reasons."""
    words = scoring.phrase_score(text.tokens(F.lit("red bolt")), F.col("p_name"), 100.0)
    p = t.part.select("p_partkey", F.round(words, 6).alias("phrase"), F.when(F.col("p_size") <= 10, 10).otherwise(0).alias("small"))
    reasons = F.array_join(arrays.errors(("words", F.col("phrase") > 0), ("small", F.col("small") > 0)), ",")
    return p.withColumn("score", F.col("phrase") + F.col("small")).filter("score >= 50").select("p_partkey", "score", reasons.alias("reasons"))


@query("""
SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL HAVING count(*) > (SELECT count(*) / 100 FROM customer)
""")
def duplicate_groups(t: Tables) -> DataFrame:
    """Groups above a share of the whole."""
    total = t.customer.agg((F.count(F.lit(1)) / 100).alias("most"))
    g = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(total), F.col("n") > F.col("most")).drop("most")  # one row


@query("""
SELECT text_hash, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, left(sha256(lower(trim(text))), 24) AS text_hash FROM documents) GROUP BY text_hash HAVING count(*) > 1
""")
def exact_text_groups(t: Tables) -> DataFrame:
    """Texts that occur more than once, by hash."""
    d = t.documents.select("doc_id", text.short_id(F.col("text")).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1")
