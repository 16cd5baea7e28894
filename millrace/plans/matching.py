"""Preference-ordered matches, array membership and diffs with equivalences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import joins, sets
from millrace.plans.registry import query
from millrace.sources.tables import Tables


@query("""
WITH e AS (SELECT o_orderkey AS k, o_custkey % 150 AS hash, o_orderstatus AS config, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 3)::INT END AS version FROM orders),
e2 AS (SELECT k, hash, CASE WHEN k % 5 = 0 THEN NULL ELSE config END AS config, CASE WHEN k % 5 = 0 THEN NULL ELSE version END AS version FROM e),
s AS (SELECT s_suppkey AS snap, s_suppkey % 120 AS hash, ['F', 'O', 'P'][(floor(s_acctbal)::BIGINT % 3 + 3) % 3 + 1] AS config, (s_nationkey % 3)::INT AS version FROM supplier UNION ALL SELECT c_custkey + 1000000, c_custkey % 120, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END, (c_nationkey % 3)::INT FROM customer),
j AS (SELECT e2.*, s.snap, (e2.config IS NOT NULL OR e2.version IS NOT NULL) AND e2.config IS NOT DISTINCT FROM s.config AND (e2.version IS NULL OR e2.version = s.version) AS fit FROM e2 LEFT JOIN s USING (hash))
SELECT k, hash, config, version, snap, CASE WHEN snap IS NOT NULL THEN fit END AS fits FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY fit DESC, snap) = 1
""")
def best_snapshots(t: Tables) -> DataFrame:
    """Orders as expected sources, matched to snapshots of their hash: equal configuration and version first, else the first snapshot."""
    k = F.col("o_orderkey")
    asks = k % 5 != 0
    expected = t.orders.select(k.alias("k"), (F.col("o_custkey") % 150).alias("hash"), F.when(asks, F.col("o_orderstatus")).alias("config"), F.when(asks & (k % 4 > 0), (k % 3).cast("int")).alias("version"))
    third = F.element_at(F.lit(["F", "O", "P"]), (F.pmod(F.floor("s_acctbal"), F.lit(3)) + 1).cast("int"))
    one = t.supplier.select(F.col("s_suppkey").alias("snap"), (F.col("s_suppkey") % 120).alias("hash"), third.alias("config"), (F.col("s_nationkey") % 3).alias("version"))
    two = t.customer.select((F.col("c_custkey") + 1_000_000).alias("snap"), (F.col("c_custkey") % 120).alias("hash"), F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("O").alias("config"), (F.col("c_nationkey") % 3).alias("version"))
    return joins.best_snapshot(expected, one.unionByName(two), "hash", ["config"], ["version"], "snap", ["snap"])


@query("""
WITH d AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '') AS words FROM conversations),
tags AS (SELECT w AS tag, count(*) AS uses FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4 GROUP BY w)
SELECT conv_id, turn, tag, uses FROM d JOIN tags ON list_contains(words, tag)
""")
def tagged_turns(t: Tables) -> DataFrame:
    """Turns with the words of benchmark items that they hold, by membership in their arrays of words."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: w != "")
    turns = t.conversations.select("conv_id", "turn", words("text").alias("words"))
    tags = t.benchmark.select(F.explode(words("text")).alias("tag")).filter(F.length("tag") >= 4).groupBy("tag").agg(F.count(F.lit(1)).alias("uses"))
    return joins.members(turns, "words", tags, "tag").select("conv_id", "turn", "tag", "uses")


PLACES = {"AUTOMOBILE": "cars", "MACHINERY": "shop", "Machinery hall": "shop", "machinery-hall": "shop"}


def _place(name: Column) -> Column:
    """The id of a place's name in the vocabulary; null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACES.items() for x in kv]), name)


@query("""
WITH o AS (SELECT c_custkey AS k, c_mktsegment AS place, CASE WHEN c_custkey % 3 = 0 THEN 'Mon 8:30 pm' ELSE 'Daily 8:30 pm' END AS schedule, CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN c_acctbal < 1000 THEN NULL ELSE 'fee' END AS price, CASE WHEN c_custkey % 7 = 0 THEN 'draft' ELSE 'live' END AS status FROM customer WHERE c_custkey % 11 > 0),
n AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Machinery hall' ELSE 'machinery-hall' END WHEN c_nationkey = 3 THEN 'elsewhere' ELSE c_mktsegment END AS place,
  CASE WHEN c_nationkey % 4 = 0 THEN '8:30 pm' WHEN c_nationkey % 4 = 1 THEN 'Tue 9:00 pm' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'Mon 8:30 pm' ELSE 'Daily 8:30 pm' END END AS schedule, CASE WHEN c_acctbal < 500 THEN 'free' WHEN c_acctbal < 1000 THEN NULL WHEN c_acctbal > 9000 THEN 'unknown' ELSE 'fee' END AS price, 'live' AS status FROM customer WHERE c_custkey % 13 > 0),
j AS (SELECT coalesce(o.k, n.k) AS k, o.k AS ok, n.k AS nk, o.place AS p1, n.place AS p2, o.schedule AS s1, n.schedule AS s2, o.price AS c1, n.price AS c2, o.status AS t1, n.status AS t2 FROM o FULL JOIN n ON o.k = n.k),
r AS (
  SELECT k, CASE WHEN nk IS NULL THEN 'missing' ELSE 'new' END AS kind, NULL AS field, NULL AS was, NULL AS now, NULL AS rule, nk IS NULL AS blocks FROM j WHERE ok IS NULL OR nk IS NULL
  UNION ALL SELECT k, NULL, 'place', p1, p2, CASE WHEN p1 = 'MACHINERY' AND p2 IN ('Machinery hall', 'machinery-hall') THEN 'same place' END, false FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND p1 IS DISTINCT FROM p2
  UNION ALL SELECT k, NULL, 'schedule', s1, s2, CASE WHEN regexp_matches(s2, '^[0-9]') AND ends_with(s1, s2) THEN 'time only' END, NULL FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND s1 IS DISTINCT FROM s2
  UNION ALL SELECT k, NULL, 'price', c1, c2, CASE WHEN coalesce(c1, 'unknown') = 'unknown' AND c2 IN ('free', 'fee') THEN 'now known' END, NULL FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND c1 IS DISTINCT FROM c2
  UNION ALL SELECT k, 'transition', 'status', t1, t2, NULL, false FROM j WHERE ok IS NOT NULL AND nk IS NOT NULL AND t1 <> t2)
SELECT k, coalesce(kind, CASE WHEN rule IS NULL THEN 'changed' ELSE 'equivalent' END) AS kind, field, was, now, rule, coalesce(blocks, rule IS NULL) AS blocks FROM r
""")
def equivalence_diffs(t: Tables) -> DataFrame:
    """Two versions of customers as listings: places by id, schedules that lost their day, prices that became known, transitions, and what blocks."""
    c = F.col("c_custkey")
    day = F.when(c % 3 == 0, "Mon 8:30 pm").otherwise("Daily 8:30 pm")
    bal, nation, seg = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    old = t.customer.filter(c % 11 > 0).select(c.alias("k"), seg.alias("place"), day.alias("schedule"), F.when(bal < 0, "unknown").when(bal >= 1000, "fee").alias("price"), F.when(c % 7 == 0, "draft").otherwise("live").alias("status"))
    place = F.when(seg == "MACHINERY", F.when(nation % 2 == 0, "Machinery hall").otherwise("machinery-hall")).when(nation == 3, "elsewhere").otherwise(seg)
    time = F.when(nation % 4 == 0, "8:30 pm").when(nation % 4 == 1, "Tue 9:00 pm").otherwise(day)
    price = F.when(bal < 500, "free").when(bal < 1000, None).when(bal > 9000, "unknown").otherwise("fee")
    new = t.customer.filter(c % 13 > 0).select(c.alias("k"), place.alias("place"), time.alias("schedule"), price.alias("price"), F.lit("live").alias("status"))
    relations = {
        "place": [("same place", lambda a, b: _place(a["place"]) == _place(b["place"]))],
        "schedule": [("time only", lambda a, b: b["schedule"].rlike("^[0-9]") & F.endswith(a["schedule"], b["schedule"]))],
        "price": [("now known", lambda a, b: (F.coalesce(a["price"], F.lit("unknown")) == "unknown") & b["price"].isin("free", "fee"))],
    }
    return sets.equivalence_diff(old, new, "k", relations, "status", ("schedule", "price"))
