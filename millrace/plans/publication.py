"""Publications and reports over several tables, lookups by batch, and tokens in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import evidence, versioning
from millrace.plans.registry import query
from millrace.sources import readers
from millrace.sources.publication import Publication, lacking, orphans, repeated
from millrace.sources.tables import Tables, fresh_folder


@query("""
WITH e AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 > 0 GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(id, -c_custkey) AS id, id IS NULL AS created FROM customer LEFT JOIN e ON o_custkey = c_custkey
""")
def get_or_create(t: Tables) -> DataFrame:
    """Each customer's latest open order, else a new one."""
    orders = t.orders.select("o_custkey", F.col("o_orderkey").alias("id"), "o_orderdate", "o_orderstatus")
    wanted = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return versioning.get_or_create(wanted, orders, "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "O") & (F.col("id") % 5 > 0), -F.col("o_custkey"))


@query("""
WITH p AS (SELECT 'program' AS part, n_nationkey AS k, n_nationkey % 2 = 0 AS is_current FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0), o AS (SELECT 'offering', s_suppkey, s_suppkey % 2 = 0 FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0)
SELECT * FROM p UNION ALL SELECT * FROM o
""")
def publish_parts(t: Tables) -> DataFrame:
    """Programs and offerings published together, those that the batch lacks retired."""
    n, s = t.nation.select(F.col("n_nationkey").cast("long").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"))
    pair = lambda df: (df.filter("k % 3 = 0").withColumn("is_current", F.lit(True)), df.filter("k % 2 = 0"))
    out = versioning.publish_parts({"program": pair(n), "offering": pair(s)}, "k")
    one = lambda name: out[name].select(F.lit(name).alias("part"), "k", "is_current")
    return one("program").unionByName(one("offering"))


@query("""
SELECT 'negative' AS name, count(*) AS n, 'blocker' AS severity, count(*) = 0 AS passed FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'orphans', count(*), 'blocker', count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'open', count(*), 'note', true FROM orders WHERE o_orderstatus = 'O'
""")
def trust_report(t: Tables) -> DataFrame:
    """Several reports as one, with what blocks."""
    n = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    orphans = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return evidence.report({"negative": n(t.supplier.filter("s_acctbal < 0")), "orphans": n(orphans), "open": n(t.orders.filter("o_orderstatus = 'O'"))}, ["negative", "orphans"])


@query("""
WITH f AS (SELECT user_id, event_type, max(value) AS top FROM events WHERE value > 20 GROUP BY ALL) SELECT e.event_id, round(top, 2) AS top FROM events e LEFT JOIN f USING (user_id, event_type)
""")
def batched_lookup(t: Tables) -> DataFrame:
    """Events with what a lookup gives for their user and type, asked once for each."""
    feed = t.events.filter("value > 20")
    fetch = lambda keys: feed.join(keys, ["user_id", "event_type"], "left_semi").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return evidence.batched_lookup(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], fetch).select("event_id", F.round("top", 2).alias("top"))


@query("""SELECT DISTINCT trim(url) AS url FROM pages WHERE trim(url) <> '' UNION SELECT 'http://nation/' || n_nationkey FROM nation""")
def used_urls(t: Tables) -> DataFrame:
    """Urls of two feeds, each once."""
    return readers.distinct_urls((t.pages, "url"), (t.nation.select(F.concat(F.lit(" http://nation/"), F.col("n_nationkey").cast("string")).alias("u")), "u"))


@query("""
WITH k AS (SELECT l_orderkey AS region, l_linenumber * 10 + l_partkey % 3 AS y, l_partkey AS x, l_linenumber % 3 = 1 AS s FROM lineitem),
d AS (SELECT DISTINCT * FROM k), a AS (SELECT *, sum(CASE WHEN y - prev > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY y, x ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM (SELECT *, lag(y) OVER (PARTITION BY region ORDER BY y, x) AS prev FROM d)),
b AS (SELECT *, max(s::INT) OVER (PARTITION BY region, line) = 1 AND row_number() OVER (PARTITION BY region, line ORDER BY x) = 1 AS opens FROM a)
SELECT region, y, x, line, sum(opens::INT) OVER (PARTITION BY region ORDER BY line, x ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM b
""")
def reading_order(t: Tables) -> DataFrame:
    """Lines of orders as tokens on a page, numbered by line and group in reading order."""
    k = t.lineitem.select(F.col("l_orderkey").alias("region"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 3).alias("y"), F.col("l_partkey").alias("x"), (F.col("l_linenumber") % 3 == 1).alias("s")).distinct()
    out = evidence.reading_groups(k.withColumn("h", F.lit(8)), "region", "y", "x", "h", F.col("s"))
    return out.select("region", "y", "x", "line", F.col("group").alias("grp"))


@query("""
WITH p AS (SELECT c_custkey AS program, c_mktsegment AS kind FROM customer), o AS (SELECT o_orderkey AS offering, o_custkey AS program, o_totalprice AS price FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)),
bad AS (SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 7)),
good AS (SELECT p.kind, count(DISTINCT p.program) AS programs, count(o.offering) AS offerings, round(coalesce(sum(o.price), 0), 2) AS value FROM p LEFT JOIN o USING (program) GROUP BY p.kind)
SELECT 'first' AS version, kind, programs, offerings, value, (SELECT n FROM bad) AS refused FROM good
""")
def staged_publication(t: Tables) -> DataFrame:
    """Programs and offerings published; a second version, whose gate finds offerings without a program, stays staged: what readers see, and how many rows it was refused for."""
    site = Publication(t.spark, fresh_folder(t.spark, "site"))
    programs = t.customer.select(F.col("c_custkey").alias("program"), F.col("c_mktsegment").alias("kind"), "c_nationkey")
    offerings = t.orders.select(F.col("o_orderkey").alias("offering"), F.col("o_custkey").alias("program"), F.col("o_totalprice").alias("price"))
    checks = {"orphans": orphans("offerings", "program", "programs", "program"), "repeats": repeated("programs", "program"), "blanks": lacking("offerings", "offering", "program")}
    site.publish("first", {"programs": programs, "offerings": offerings.join(programs.select("program"), "program", "left_semi")}, checks)
    late = site.publish("second", {"programs": programs.filter("c_nationkey <> 7"), "offerings": offerings}, checks)
    now, name = site.tables(), site.manifest()["version"]
    both = now["programs"].join(now["offerings"].withColumnRenamed("program", "_p"), F.col("program") == F.col("_p"), "left")
    value = F.round(F.coalesce(F.sum("price"), F.lit(0.0)), 2).alias("value")
    return both.groupBy("kind").agg(F.countDistinct("program").alias("programs"), F.count("offering").alias("offerings"), value).select(F.lit(name).alias("version"), "kind", "programs", "offerings", "value", F.lit(late.findings["orphans"]).cast("long").alias("refused"))
