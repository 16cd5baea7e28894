"""Parts, orders and customers as a catalogue: facets, comparison, versions, checks and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays, temporal
from millrace.operators import aggregates, filters, graph, joins, quality, ranking, recurrence, sets, versioning
from millrace.plans.registry import query
from millrace.sources.tables import Tables


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, p_type, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 3
""")
def top_categories_per_entity(t: Tables) -> DataFrame:
    """Each brand's three most frequent types."""
    c = t.part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_per(c, ["p_brand"], [F.desc("n"), F.asc("p_type")], 3)


@query("""
WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers, count(*) FILTER (s_acctbal < 0) AS debtors, count(*) FILTER (s_acctbal > 5000) AS rich FROM supplier GROUP BY 1)
SELECT n.n_name, suppliers, debtors, rich, 10 * suppliers + 3 * rich - 2 * debtors AS score, row_number() OVER (ORDER BY 10 * suppliers + 3 * rich - 2 * debtors DESC, n.n_name) AS place
FROM s JOIN nation n ON n.n_nationkey = s.k
""")
def comparison_rank(t: Tables) -> DataFrame:
    """Nations by a composite score of their suppliers."""
    s = t.supplier.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"), F.count_if(F.col("s_acctbal") < 0).alias("debtors"), F.count_if(F.col("s_acctbal") > 5000).alias("rich"))
    s = s.withColumn("score", 10 * F.col("suppliers") + 3 * F.col("rich") - 2 * F.col("debtors"))
    named = s.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select("n_name", "suppliers", "debtors", "rich", "score", F.row_number().over(Window.orderBy(F.desc("score"), "n_name")).cast("long").alias("place"))


@query("""SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0.0) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def entity_counts_zero_fill(t: Tables) -> DataFrame:
    """Orders of every customer, 0 for those without."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return aggregates.zero_fill(t.customer.select("c_custkey"), o, ["c_custkey"], ["orders", "spent"])


FACETS = {"p_brand": ["Brand#12", "Brand#3"], "p_type": ["PROMO"], "p_size": []}


@query("""
WITH f AS (SELECT *, p_brand IN ('Brand#12', 'Brand#3') AS b, p_type = 'PROMO' AS y FROM part),
c AS (SELECT 'p_brand' AS facet, p_brand AS value, count(*) FILTER (y) AS n FROM f GROUP BY p_brand
 UNION ALL SELECT 'p_type', p_type, count(*) FILTER (b) FROM f GROUP BY p_type UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FILTER (b AND y) FROM f GROUP BY p_size)
SELECT facet, value, n, (facet = 'p_brand' AND value IN ('Brand#12', 'Brand#3')) OR (facet = 'p_type' AND value = 'PROMO') AS active FROM c
WHERE n > 0 OR (facet = 'p_brand' AND value IN ('Brand#12', 'Brand#3')) OR (facet = 'p_type' AND value = 'PROMO')
""")
def facet_leave_one_out(t: Tables) -> DataFrame:
    """Counts of each facet's values under the other facets' filters."""
    return aggregates.leave_one_out(t.part, FACETS)


@query("""
WITH r AS (SELECT * FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_name = p.p_name AND q.p_size > 45))
SELECT 'p_type' AS facet, p_type AS value, count(*) AS n FROM r GROUP BY p_type UNION ALL SELECT 'p_brand', p_brand, count(*) FROM r GROUP BY p_brand
""")
def facet_after_antijoin(t: Tables) -> DataFrame:
    """Facet counts of parts whose name no large part has."""
    rest = joins.exclude(t.part, t.part.filter("p_size > 45"), ["p_name"])
    return aggregates.facet_counts(rest, ["p_type", "p_brand"])


@query("""SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_size BETWEEN 5 AND 30 AND contains(lower(p_name || ' ' || p_type), 'blue') AND contains(lower(p_name || ' ' || p_type), 'pro')""")
def browse_filter(t: Tables) -> DataFrame:
    """Parts by a filter specification."""
    spec = filters.Spec(allowed={"p_brand": filters.split_list("Brand#1, Brand#2,,Brand#3,Brand#1")}, between={"p_size": (5, 30)}, words="blue pro", text=("p_name", "p_type"))
    return t.part.filter(filters.predicate(spec)).select("p_partkey", "p_name")


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1""")
def dedupe_first(t: Tables) -> DataFrame:
    """Each part's first line."""
    position = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return ranking.dedupe_first(t.lineitem, ["l_partkey"], position).select("l_partkey", "l_orderkey", "l_linenumber")


@query("""
SELECT l_partkey, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS l_orderkey, min(l_orderkey) AS first_position
FROM lineitem GROUP BY l_partkey
""")
def dedupe_last(t: Tables) -> DataFrame:
    """Each part's last line, with the place of its first."""
    out = ranking.dedupe_last(t.lineitem, ["l_partkey"], F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    return out.select("l_partkey", "l_orderkey", F.col("first_position.l_orderkey").alias("first_position"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_tax, l_extendedprice, l_linenumber, l_partkey, l_suppkey) = 1
""")
def best_option_per_key(t: Tables) -> DataFrame:
    """Each order's best line by discount, tax and price."""
    order = [F.desc("l_discount"), F.asc("l_tax"), F.asc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return ranking.first_per(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier s WHERE floor(s_acctbal / 1000) = (SELECT max(floor(s_acctbal / 1000)) FROM supplier q WHERE q.s_nationkey = s.s_nationkey)
""")
def keep_top_priority(t: Tables) -> DataFrame:
    """All suppliers of their nation's highest balance class."""
    s = t.supplier.withColumn("p", F.floor(F.col("s_acctbal") / 1000))
    return ranking.keep_top_priority(s, ["s_nationkey"], "p").select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount >= 0.08 THEN 2 WHEN l_discount >= 0.04 THEN 1 ELSE 0 END AS d,
  CASE WHEN l_quantity >= 40 THEN 2 WHEN l_quantity >= 20 THEN 1 ELSE 0 END AS q, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(d, q, r)::INT AS risk, CASE WHEN r = 2 THEN 'returned' WHEN q = 2 THEN 'bulk' WHEN d = 2 THEN 'discount' ELSE 'none' END AS reason FROM l
""")
def risk_levels(t: Tables) -> DataFrame:
    """The greatest of three ordinal risks per line, with the first reason in priority."""
    level = lambda c, hi, lo: F.when(c >= hi, 2).when(c >= lo, 1).otherwise(0)
    d, q, r = level(F.col("l_discount"), 0.08, 0.04), level(F.col("l_quantity"), 40, 20), F.when(F.col("l_returnflag") == "R", 2).otherwise(0)
    reason = F.when(r == 2, "returned").when(q == 2, "bulk").when(d == 2, "discount").otherwise("none")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(d, q, r).alias("risk"), reason.alias("reason"))


@query("""
WITH o AS (SELECT o_orderkey, date_diff('hour', TIMESTAMP '1998-06-01 00:00:00', o_orderdate) AS h FROM orders)
SELECT route, count(*) AS n FROM (SELECT CASE WHEN h < 0 THEN 'past' WHEN h <= 72 THEN 'hourly' WHEN h <= 168 THEN 'daily' WHEN h <= 360 THEN 'outlook' ELSE 'none' END AS route FROM o) GROUP BY route
""")
def horizon_router(t: Tables) -> DataFrame:
    """How many orders each forecast horizon serves from a fixed time."""
    hours = F.timestamp_diff("HOUR", F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.select(temporal.horizon(hours).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT unnest(range(DATE '2024-03-01', DATE '2024-03-08', INTERVAL 1 DAY))::DATE AS day)
SELECT s_suppkey, day FROM supplier, d WHERE (s_suppkey % 8 = 7 OR s_suppkey % 8 = dayofweek(day)) AND (s_suppkey % 5 <> 0 OR day >= DATE '2024-03-04')
""")
def recurrence_expand(t: Tables) -> DataFrame:
    """Suppliers as weekly or daily rules over a week, some valid from the middle of it."""
    key = F.col("s_suppkey") % 8
    rules = t.supplier.select("s_suppkey", F.when(key != 7, key).alias("weekday"), F.when(F.col("s_suppkey") % 5 == 0, F.lit("2024-03-04").cast("date")).alias("since"))
    return recurrence.expand(rules, F.lit("2024-03-01").cast("date"), 7, "weekday", valid_from="since").select("s_suppkey", "day")


def _perturbed(t: Tables) -> DataFrame:
    """Orders as a later version of themselves: some gone, some changed, some new."""
    k = F.col("o_orderkey")
    new = t.orders.filter(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return new.withColumn("o_totalprice", F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderkey", F.when(k % 17 == 0, k + 10_000_000).otherwise(k))


NEW_SQL = """n AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s,
  CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 11 <> 0), o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders)"""


@query(f"""
WITH {NEW_SQL}
SELECT coalesce(o.k, n.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.s <> n.s OR o.p <> n.p THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL AND (o.s <> n.s OR o.p <> n.p) THEN concat_ws(',', CASE WHEN o.s <> n.s THEN 'o_orderstatus' END, CASE WHEN o.p <> n.p THEN 'o_totalprice' END) END AS changed
FROM o FULL JOIN n ON o.k = n.k
""")
def publication_parity(t: Tables) -> DataFrame:
    """Orders against their later version, key by key."""
    return sets.keyed_diff(t.orders, _perturbed(t), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"""
WITH {NEW_SQL}
SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1
""")
def snapshot_drift(t: Tables) -> DataFrame:
    """How many orders drifted on the stable field."""
    return sets.keyed_diff(t.orders, _perturbed(t), "o_orderkey", ["o_orderstatus"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {NEW_SQL}, d AS (SELECT o.k, o.s AS os, n.s AS ns, o.p AS op, n.p AS np FROM o JOIN n ON o.k = n.k),
f AS (SELECT 'o_orderstatus' AS field, os = ns AS same FROM d UNION ALL SELECT 'o_totalprice', abs(op - np) < 0.5 FROM d)
SELECT field, count(*) AS compared, count(*) FILTER (NOT same) AS differ, round(count(*) FILTER (NOT same) / count(*), 6) AS share FROM f GROUP BY field
""")
def dual_run(t: Tables) -> DataFrame:
    """Two versions field by field, prices within half a unit being equal."""
    new = _perturbed(t).select("o_orderkey", F.col("o_orderstatus").alias("s2"), F.col("o_totalprice").alias("p2"))
    both = t.orders.join(new, "o_orderkey")
    same = F.array(F.struct(F.lit("o_orderstatus").alias("field"), (F.col("o_orderstatus") == F.col("s2")).alias("same")), F.struct(F.lit("o_totalprice").alias("field"), (F.abs(F.col("o_totalprice") - F.col("p2")) < 0.5).alias("same")))
    f = both.select(F.inline(same))
    return f.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("same")).alias("differ"), F.round(aggregates.rate(~F.col("same")), 6).alias("share"))


@query("""
WITH cur AS (SELECT c_custkey AS k, c_mktsegment AS seg, DATE '2024-01-01' AS since FROM customer WHERE c_custkey % 9 <> 0),
nxt AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT coalesce(c.k, x.k) AS k, c.k AS ck, x.k AS xk, c.seg AS cs, x.seg AS xs, since FROM cur c FULL JOIN nxt x ON c.k = x.k)
SELECT k AS c_custkey, cs AS c_mktsegment, since AS valid_from, CASE WHEN xk IS NULL OR cs <> xs THEN DATE '2024-02-01' END AS valid_until FROM j WHERE ck IS NOT NULL
UNION ALL SELECT k, xs, DATE '2024-02-01', NULL FROM j WHERE xk IS NOT NULL AND (ck IS NULL OR cs <> xs)
""")
def scd2_publish(t: Tables) -> DataFrame:
    """Customer versions after a new batch."""
    k = F.col("c_custkey")
    current = t.customer.filter(k % 9 != 0).select("c_custkey", "c_mktsegment", F.lit("2024-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_until"))
    batch = t.customer.filter(k % 5 != 0).select("c_custkey", F.when(k % 4 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return versioning.scd2_publish(current, batch, "c_custkey", ["c_mktsegment"], F.lit("2024-02-01").cast("date"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 2 <> 0 AS is_current FROM customer""")
def retire_missing(t: Tables) -> DataFrame:
    """Customers that a new batch lacks are no longer current."""
    current = t.customer.select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("is_current"))
    return versioning.retire_missing(current, t.customer.filter("c_custkey % 2 <> 0"), "c_custkey").select("c_custkey", "is_current")


@query("""
WITH b AS (SELECT s_suppkey % 40 AS k, max(s_suppkey) AS last FROM supplier GROUP BY 1)
SELECT s.s_suppkey, coalesce((SELECT q.s_acctbal FROM supplier q WHERE q.s_suppkey = b.last), s.s_acctbal) AS s_acctbal FROM supplier s LEFT JOIN b ON b.k = s.s_suppkey
""")
def upsert_last_wins(t: Tables) -> DataFrame:
    """Suppliers after an upsert whose batch has several rows a key."""
    s = t.supplier.select("s_suppkey", "s_acctbal")
    batch = s.select((F.col("s_suppkey") % 40).alias("s_suppkey"), "s_acctbal", F.col("s_suppkey").alias("position"))
    return versioning.upsert(s, batch, ["s_suppkey"], F.col("position"))


@query("""
WITH o AS (SELECT event_id % 7000 AS op, arg_min(user_id, event_id) AS user_id, arg_min(event_type, event_id) AS kind, min(event_id) AS pos FROM events GROUP BY 1)
SELECT user_id, count(*) AS version, arg_max(kind, pos) AS last_op, arg_max(kind, pos) = 'error' AS removed FROM o GROUP BY user_id
""")
def op_log_fold(t: Tables) -> DataFrame:
    """Users' state after replaying events as operations whose ids repeat."""
    ops = t.events.select((F.col("event_id") % 7000).alias("op"), "user_id", "event_type", "event_id")
    return versioning.fold_ops(ops, "op", "user_id", "event_type", "event_id", "error")


@query("""
WITH e AS (SELECT DISTINCT 's' || s_nationkey AS src, 'r' || n_regionkey AS dst, 'supply' AS l FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION SELECT DISTINCT 'r' || n_regionkey, 'c' || c_nationkey, 'demand' FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT a.src, a.dst AS via, b.dst, CASE WHEN a.l = b.l THEN a.l ELSE a.l || '>' || b.l END AS labels FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst
""")
def two_hop_paths(t: Tables) -> DataFrame:
    """Supplier nations to customer nations through a region."""
    n = t.nation.select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("region"))
    up = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_nationkey").alias("src"), F.col("region").alias("dst"), F.lit("supply").alias("label"))
    down = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("region").alias("src"), F.concat(F.lit("c"), "c_nationkey").alias("dst"), F.lit("demand").alias("label"))
    return graph.two_hop_paths(up.union(down).distinct(), "src", "dst", "label")


@query("""
WITH f AS (SELECT s_nationkey AS node, CASE WHEN s_acctbal > 0 THEN 'in' ELSE 'out' END AS mode, 'supplier' AS source FROM supplier UNION SELECT c_nationkey, lower(c_mktsegment), 'customer' FROM customer
 UNION SELECT n_nationkey, 'home', 'nation' FROM nation)
SELECT node, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM f GROUP BY node
""")
def mode_rollup(t: Tables) -> DataFrame:
    """Each nation's distinct modes and sources from three feeds."""
    feeds = [
        t.supplier.select(F.col("s_nationkey").alias("node"), F.when(F.col("s_acctbal") > 0, "in").otherwise("out").alias("mode"), F.lit("supplier").alias("source")),
        t.customer.select(F.col("c_nationkey").alias("node"), F.lower("c_mktsegment").alias("mode"), F.lit("customer").alias("source")),
        t.nation.select(F.col("n_nationkey").alias("node"), F.lit("home").alias("mode"), F.lit("nation").alias("source")),
    ]
    return graph.node_modes(feeds)


@query("""
SELECT a.p_partkey, b.p_partkey AS other, (100 - abs(a.p_size - b.p_size))::INT AS score, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) AS rank
FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 5
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) <= 3
""")
def backup_top3(t: Tables) -> DataFrame:
    """Three stand-ins of every part: same brand and type, nearest in size.

    Each cell (brand, type, size) offers its four least keys, one more than are needed; a part looks into eleven cells,
    so candidates stay bounded however large a cell is.
    """
    cells = ranking.first_per(t.part.select("p_brand", "p_type", "p_size", F.col("p_partkey").alias("other")), ["p_brand", "p_type", "p_size"], [F.asc("other")], 4)
    a = t.part.select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("own"), F.explode(F.sequence(F.col("p_size") - 5, F.col("p_size") + 5)).alias("p_size"))
    s = a.join(cells, ["p_brand", "p_type", "p_size"]).filter("p_partkey <> other").withColumn("score", 100 - F.abs(F.col("own") - F.col("p_size")))
    return ranking.top_per(s, ["p_partkey"], [F.desc("score"), F.asc("other")], 3).select("p_partkey", "other", "score", "rank")


@query("""
SELECT 'orders_customer' AS "check", count(*) AS failed, count(*) = 0 AS ok FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'line_order', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'discount_range', count(*), count(*) = 0 FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1 UNION ALL
SELECT 'negative_balance', count(*), count(*) = 0 FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT 'line_unique', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'label_document', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def health_checks(t: Tables) -> DataFrame:
    """Keys, ranges and uniqueness over the tables."""
    return quality.report([
        quality.orphans("orders_customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        quality.orphans("line_order", t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        quality.failures("discount_range", t.lineitem, ~F.col("l_discount").between(0, 0.1)),
        quality.failures("negative_balance", t.customer, F.col("c_acctbal") < 0),
        quality.duplicates("line_unique", t.lineitem, ["l_orderkey", "l_linenumber"]),
        quality.orphans("label_document", t.labels, "doc_id", t.documents, "doc_id"),
    ])


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY month) AS before FROM m)
SELECT month, n, before, CASE WHEN n < 10 THEN 'too_few' WHEN before IS NULL THEN 'first' WHEN abs(n - before) * 100 > 30 * before THEN 'drift' ELSE 'ok' END AS verdict FROM p
""")
def count_drift(t: Tables) -> DataFrame:
    """Months whose order count moved by over 30 percent."""
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    p = m.withColumn("before", F.lag("n").over(Window.orderBy("month")))  # one row a month
    return p.withColumn("verdict", F.when(F.col("n") < 10, "too_few").when(F.col("before").isNull(), "first").when(F.abs(F.col("n") - F.col("before")) * 100 > 30 * F.col("before"), "drift").otherwise("ok"))


@query("""
WITH r AS (SELECT n_nationkey, e.event_type FROM nation, (SELECT unnest(['signup', 'purchase', 'error', 'view', 'refund']) AS event_type) e), s AS (SELECT DISTINCT user_id % 20 AS n_nationkey, event_type FROM events WHERE value > 99)
SELECT r.n_nationkey, r.event_type FROM r LEFT JOIN s ON s.n_nationkey = r.n_nationkey AND s.event_type = r.event_type WHERE s.event_type IS NULL
""")
def required_completeness(t: Tables) -> DataFrame:
    """Which required (nation, type) pairs have no event of high value."""
    required = t.nation.select("n_nationkey", F.explode(F.lit(["signup", "purchase", "error", "view", "refund"])).alias("event_type"))
    seen = t.events.filter("value > 99").select((F.col("user_id") % 20).cast("int").alias("n_nationkey"), "event_type")
    return aggregates.missing_required(required, seen, ["n_nationkey", "event_type"])


@query("""
WITH u AS (SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'c_acctbal']) AS field, unnest([c_name, c_mktsegment, c_acctbal::VARCHAR]) AS value FROM customer)
SELECT field, count(*) AS n, count(DISTINCT value) AS kinds, CASE WHEN count(DISTINCT value) = count(*) THEN 'key' WHEN count(DISTINCT value) < 10 THEN 'facet' ELSE 'measure' END AS tier FROM u GROUP BY field
""")
def field_audit_unpivot(t: Tables) -> DataFrame:
    """Customer columns as rows, with their numbers of values."""
    long = t.customer.select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("string").alias("c_acctbal")).unpivot("c_custkey", ["c_name", "c_mktsegment", "c_acctbal"], "field", "value")
    f = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds"))
    return f.withColumn("tier", F.when(F.col("kinds") == F.col("n"), "key").when(F.col("kinds") < 10, "facet").otherwise("measure"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(list_filter([CASE WHEN l_quantity < 2 THEN 'small' END, CASE WHEN l_discount > 0.09 THEN 'discount' END, CASE WHEN l_tax = 0 AND l_returnflag = 'R' THEN 'untaxed_return' END], lambda x: x IS NOT NULL)) AS issue FROM lineitem)
SELECT issue, count(*) AS n FROM i GROUP BY issue
""")
def row_issues(t: Tables) -> DataFrame:
    """Rules that lines break."""
    rules = [("small", F.col("l_quantity") < 2), ("discount", F.col("l_discount") > 0.09), ("untaxed_return", (F.col("l_tax") == 0) & (F.col("l_returnflag") == "R"))]
    return quality.issues(t.lineitem, "l_orderkey", rules).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT c_nationkey, c_mktsegment, list_sort(list_distinct(list(c_custkey % 7))) AS days, min(c_custkey) AS first, count(*) AS merged FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, array_to_string(days, ',') AS days, first, merged FROM g
""")
def merge_identical(t: Tables) -> DataFrame:
    """Customers of one identity merged, with the union of their days."""
    c = t.customer.select("c_nationkey", "c_mktsegment", F.array(F.col("c_custkey") % 7).alias("days"), F.col("c_custkey").alias("first"))
    return sets.merge_identical(c, ["c_nationkey", "c_mktsegment"], "days", "first").withColumn("days", F.array_join(F.col("days").cast("array<string>"), ","))


@query("""
SELECT n.n_nationkey, s.s_suppkey FROM (SELECT s_suppkey, s_nationkey AS x, (s_suppkey % 25)::INT AS y FROM supplier) s JOIN nation n ON n.n_nationkey = s.x OR n.n_nationkey = s.y
""")
def either_key(t: Tables) -> DataFrame:
    """Nations of suppliers by either of two keys."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 25).cast("int").alias("y"))
    return joins.either_key(s, t.nation, "x", "y", "n_nationkey").select("n_nationkey", "s_suppkey")


@query("""SELECT c_custkey, coalesce(n_name, 'elsewhere') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def lookup_default(t: Tables) -> DataFrame:
    """Customers with their nation from a table that lacks some, with defaults."""
    table = t.nation.filter("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup(t.customer, table, "c_nationkey", {"n_name": "elsewhere", "n_regionkey": -1}).select("c_custkey", "n_name", "n_regionkey")


@query("""
SELECT kind, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY kind
""")
def tagged_union(t: Tables) -> DataFrame:
    """Two tables under one schema."""
    u = sets.tagged_union({"customer": t.customer.select(F.col("c_acctbal").alias("balance")), "supplier": t.supplier.select(F.col("s_acctbal").alias("balance"))}, "kind")
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("""
WITH r AS (SELECT r.r_name, n.n_name, c.c_mktsegment, o.o_orderpriority, l.l_extendedprice * (1 - l.l_discount) AS v FROM lineitem l JOIN orders o ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey JOIN region r ON r_regionkey = n_regionkey)
SELECT r_name, c_mktsegment, count(*) AS n, round(sum(v), 2) AS revenue, count(DISTINCT n_name) AS nations FROM r GROUP BY ALL
""")
def entity_chain(t: Tables) -> DataFrame:
    """Five tables joined from lines to regions, the small ones as the planner sees fit."""
    r = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    r = r.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return r.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("n_name").alias("nations"))


@query("""
SELECT event_id, (props->>'k')::BIGINT AS k, coalesce((props->>'k')::BIGINT > 50, false) AS large, CASE WHEN (props->>'k')::BIGINT IS NULL THEN 'missing' ELSE 'ok' END AS issues FROM events
""")
def json_members(t: Tables) -> DataFrame:
    """Members of a JSON column, with error codes."""
    k = arrays.json_int(F.col("props"), "k")
    codes = F.array_join(arrays.errors(("missing", k.isNull())), ",")
    return t.events.select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("large"), F.when(codes == "", "ok").otherwise(codes).alias("issues"))
