"""Events as operations on plans, and tables as publications: replay, shares, merges, inserts, updates, rollbacks, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import replay, versioning
from millrace.plans.registry import query
from millrace.sources.tables import Tables


@query("""
WITH o AS (SELECT event_id % 900 AS op, arg_min(user_id, event_id) AS u, arg_min(event_type, event_id) AS kind, arg_min(value, event_id) AS v, min(event_id) AS pos FROM events GROUP BY 1),
p AS (SELECT *, u * 50 + pos % 50 AS plan FROM o), d AS (SELECT plan, min(pos) AS gone FROM p WHERE kind = 'error' GROUP BY plan),
l AS (SELECT p.* FROM p LEFT JOIN d USING (plan) WHERE (gone IS NULL OR pos <= gone) AND NOT (kind = 'purchase' AND v >= 150) AND NOT (kind = 'signup' AND v < 5))
SELECT plan, count(*) + 1 AS version, bool_or(kind = 'error') AS removed, arg_max('T' || floor(v)::BIGINT, pos) FILTER (kind = 'signup') AS title,
  CASE WHEN floor(arg_max(v, pos) FILTER (kind = 'view'))::BIGINT % 3 > 0 THEN repeat('n', 10) END AS note, arg_max(floor(v)::BIGINT, pos) FILTER (kind = 'purchase') AS home FROM l GROUP BY plan
""")
def plan_replay(t: Tables) -> DataFrame:
    """Plans after renames, notes (cut and blank as null), validated settings and removals whose op ids repeat."""
    ops = t.events.select((F.col("event_id") % 900).alias("op"), (F.col("user_id") * 50 + F.col("event_id") % 50).alias("plan"), "event_type", "value", "event_id")
    v = F.floor("value")
    note = F.substring(F.trim(F.when(v % 3 == 0, "   ").otherwise(F.repeat(F.lit("n"), 12))), 1, 10)
    sets = {
        "title": ("signup", F.col("value") >= 5, F.concat(F.lit("T"), v.cast("string"))),
        "note": ("view", F.lit(True), F.struct(F.nullif(note, F.lit("")).alias("text"))),  # a struct, so that the last note counts even if it is empty
        "home": ("purchase", F.col("value") < 150, v),
    }
    out = versioning.replay(ops, "op", "plan", "event_type", "value", "event_id", sets, "error")
    return out.withColumn("note", F.col("note.text"))


@query(None)
def pending_replay(t: Tables) -> DataFrame:
    """Users' events as operations on plans of three items, of which some fail, wait and repeat: what became of each, in order."""
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "add", "purchase": "add", "click": "add", "view": "note", "error": "remove"}.items() for x in kv])
    ops = t.events.select(
        F.col("user_id").alias("owner"), F.floor(F.col("event_id") * 0.9).alias("op_id"), F.try_element_at(kinds, F.col("event_type")).alias("kind"), (F.floor("value") % 5).alias("item"),
        F.col("props").alias("note"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    return replay.replay(ops, replay.Rules(most=3, give_up=2 * 86_400))


@query("""
WITH s AS (SELECT user_id, event_id, event_type AS kind, row_number() OVER (PARTITION BY user_id, ts::DATE, event_type ORDER BY event_id) > 2 AND event_type = 'click' AS refused FROM events WHERE event_type IN ('purchase', 'click', 'error')),
a AS (SELECT *, coalesce(last_value(CASE WHEN NOT refused THEN kind <> 'error' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS active FROM s)
SELECT user_id, event_id, CASE WHEN refused THEN 'refused' WHEN kind = 'error' THEN CASE WHEN active THEN 'revoked' ELSE 'nothing' END WHEN kind = 'click' THEN 'rotated' WHEN active THEN 'reused' ELSE 'created' END AS outcome FROM a
""")
def share_outcomes(t: Tables) -> DataFrame:
    """What share operations did, two rotations a day allowed."""
    out = versioning.shares(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", "event_type", "event_id", F.to_date("ts"), 2, "purchase", "click", "error")
    return out.select("user_id", "event_id", "outcome")


@query("""
WITH l AS (SELECT c_custkey AS k, (c_custkey % 5)::INTEGER AS version, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS pending, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS title, c_mktsegment AS items FROM customer WHERE c_custkey % 7 > 0),
s AS (SELECT c_custkey AS k, 2 AS version, 'S' || c_custkey AS title, 'server' AS items FROM customer WHERE c_custkey % 11 > 0)
SELECT coalesce(l.k, s.k) AS c_custkey, CASE WHEN r THEN s.version ELSE l.version END AS version, CASE WHEN r THEN s.title ELSE coalesce(l.title, s.title) END AS title, CASE WHEN r THEN s.items ELSE l.items END AS items, r AS replaced
FROM (SELECT *, s.version IS NOT NULL AND (l.version IS NULL OR (s.version >= l.version AND l.pending = 0)) AS r FROM l FULL JOIN s ON l.k = s.k)
""".replace("SELECT coalesce(l.k, s.k) AS c_custkey, CASE WHEN r THEN s.version ELSE l.version END AS version, CASE WHEN r THEN s.title ELSE coalesce(l.title, s.title) END AS title, CASE WHEN r THEN s.items ELSE l.items END AS items, r AS replaced\nFROM (SELECT *, s.version", "SELECT c_custkey, CASE WHEN r THEN sv ELSE lv END AS version, CASE WHEN r THEN st ELSE coalesce(lt, st) END AS title, CASE WHEN r THEN si ELSE li END AS items, r AS replaced\nFROM (SELECT coalesce(l.k, s.k) AS c_custkey, s.version AS sv, l.version AS lv, s.title AS st, l.title AS lt, s.items AS si, l.items AS li, s.version"))
def version_gated_merge(t: Tables) -> DataFrame:
    """Local plans merged with the server's."""
    k = F.col("c_custkey")
    local = t.customer.filter(k % 7 > 0).select("c_custkey", (k % 5).cast("int").alias("version"), F.when(k % 3 == 0, 1).otherwise(0).alias("pending"), F.when(k % 4 > 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("items"))
    server = t.customer.filter(k % 11 > 0).select("c_custkey", F.lit(2).alias("version"), F.concat(F.lit("S"), k.cast("string")).alias("title"), F.lit("server").alias("items"))
    return versioning.merge_by_version(local, server, "c_custkey", ["title"], ["items"])


@query("""
WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN 'debtor' WHEN s_acctbal < 5000 THEN 'plain' ELSE 'rich' END AS kind FROM supplier WHERE s_suppkey % 3 > 0),
i AS (SELECT * FROM c UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0)
SELECT i.k, CASE WHEN i.k % 10 = 4 THEN 'fixed' ELSE kind END AS kind FROM i
""")
def insert_and_update(t: Tables) -> DataFrame:
    """Rows classified and inserted where keys are missing, then updated from matching changes."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    current = t.supplier.filter(k % 3 > 0).select(k.alias("k"), F.when(b < 0, "debtor").when(b < 5000, "plain").otherwise("rich").alias("kind"))
    batch = t.supplier.select(k.alias("k"), F.lit("new").alias("kind"))
    changes = t.supplier.filter(k % 5 == 4).select(k.alias("k"), F.when(k % 10 == 4, "fixed").alias("kind"))
    return versioning.update_from(versioning.insert_missing(current, batch, ["k"]), changes, ["k"], ["kind"])


@query("""
SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN DATE '2024-01-10' WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 3 THEN DATE '2024-02-01' END AS valid_until FROM customer
""")
def roll_back(t: Tables) -> DataFrame:
    """Open versions of one segment and nation closed; closed ones stay as they are."""
    current = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("2024-01-10").cast("date")).alias("valid_until"))
    return versioning.roll_back(current, F.lit("2024-02-01").cast("date"), c_mktsegment="MACHINERY", c_nationkey=3, c_name=None).drop("c_nationkey")


@query("""
WITH b AS (SELECT user_id, (epoch(ts)::BIGINT // 3600) AS w, count(*) AS n FROM events GROUP BY ALL) SELECT count(*) FILTER (w < epoch(TIMESTAMP '2024-01-10 00:00:00')::BIGINT // 3600) AS deleted, count(*) FILTER (w >= epoch(TIMESTAMP '2024-01-10 00:00:00')::BIGINT // 3600) AS kept FROM b
""".replace("(epoch(ts)::BIGINT // 3600) AS w", "floor(epoch(ts) / 3600)::BIGINT AS w"))
def prune_buckets(t: Tables) -> DataFrame:
    """Old rate-limit buckets deleted, and how many."""
    hour = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 3600)
    buckets = t.events.groupBy("user_id", hour.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    stays, gone = versioning.prune(buckets, F.col("w") < 473568)
    return gone.join(F.broadcast(stays.agg(F.count(F.lit(1)).alias("kept"))), F.lit(True))


@query("""
WITH p AS (SELECT count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 > 0)) AS a, count(*) FILTER (o_totalprice < 0) AS b, count(*) - count(DISTINCT o_orderkey) AS c FROM orders)
SELECT a = 0 AND b = 0 AND c = 0 AS passed, concat_ws(',', CASE WHEN c > 0 THEN 'duplicate_key' END, CASE WHEN b > 0 THEN 'negative_price' END, CASE WHEN a > 0 THEN 'orphan_order' END) AS failures FROM p
""")
def publish_gate(t: Tables) -> DataFrame:
    """Customers, then orders published; the gate tells whether the whole is healthy."""
    customers = versioning.upsert(t.customer.filter("c_custkey < 0"), t.customer.filter("c_custkey % 50 > 0"), ["c_custkey"], F.col("c_custkey"))
    orders = versioning.upsert(t.orders.filter("o_orderkey < 0"), t.orders, ["o_orderkey"], F.col("o_orderkey"))
    orphan = orders.join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(F.lit("orphan_order").alias("check_name"), F.count(F.lit(1)).alias("failing"))
    negative = orders.agg(F.lit("negative_price").alias("check_name"), F.count_if(F.col("o_totalprice") < 0).alias("failing"))
    twice = orders.groupBy("o_orderkey").count().agg(F.lit("duplicate_key").alias("check_name"), F.count_if(F.col("count") > 1).alias("failing"))
    return versioning.gate(orphan.unionByName(negative).unionByName(twice))
