"""Suppliers as edges between nations: paths and what travellers are shown, modes, lineage, active versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import graph, graphdoc, versioning
from millrace.plans.registry import query
from millrace.sources.tables import Tables

EDGE_SQL = """e AS (SELECT DISTINCT s_nationkey AS src, ((s_nationkey + 1 + s_suppkey % 3) % 25)::INTEGER AS dst, ['Bus 5', 'Ferry', 'Foot path'][1 + s_suppkey % 3] AS label, ['bus', 'boat', 'walk'][1 + s_suppkey % 3] AS mode,
  CASE WHEN s_nationkey % 2 = 0 THEN 'even' END AS note, 5 + s_nationkey % 7 AS minutes FROM supplier)"""
PATH_SQL = """p AS (SELECT src, dst, 1 AS depth, '' AS via, label AS labels, mode AS modes, coalesce(note, '') AS notes, minutes::BIGINT AS minutes FROM e WHERE src <> dst
  UNION ALL SELECT a.src, b.dst, 2, a.dst::VARCHAR, CASE WHEN a.label = b.label THEN a.label ELSE a.label || ' > ' || b.label END, CASE WHEN a.mode = b.mode THEN a.mode ELSE a.mode || ',' || b.mode END,
    coalesce(a.note, b.note, ''), a.minutes + b.minutes FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst AND b.src <> b.dst AND a.src <> b.dst)"""


def edges(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    pick = lambda *v: F.element_at(F.lit(list(v)), (k % 3 + 1).cast("int"))
    return t.supplier.select(n.alias("src"), ((n + 1 + k % 3) % 25).cast("int").alias("dst"), pick("Bus 5", "Ferry", "Foot path").alias("label"), graph.canonical_mode(pick("Bus 5", "Ferry", "Foot path")).alias("mode"), F.when(n % 2 == 0, "even").alias("note"), (n % 7 + 5).alias("minutes"))


@query(f"WITH {EDGE_SQL}, {PATH_SQL} SELECT * FROM p")
def path_options(t: Tables) -> DataFrame:
    """All simple paths of one and two edges as travellers see them."""
    return graph.path_options(graph.paths(edges(t), "src", "dst", ["label", "mode", "note", "minutes"]), "label", "mode", "note", "minutes")


@query(f"WITH {EDGE_SQL}, {PATH_SQL} SELECT o.n_name AS origin, d.n_name AS destination, labels, minutes FROM p JOIN nation o ON o.n_nationkey = src JOIN nation d ON d.n_nationkey = dst WHERE depth = 1")
def direct_options(t: Tables) -> DataFrame:
    """Direct edges with the names of both ends, from one table joined twice."""
    shown = graph.path_options(graph.paths(edges(t), "src", "dst", ["label", "mode", "note", "minutes"]).filter("depth = 1"), "label", "mode", "note", "minutes")
    o, d = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(name)) for k, name in (("src", "origin"), ("dst", "destination")))
    return shown.join(o, "src").join(d, "dst").select("origin", "destination", "labels", "minutes")


@query(f"""
WITH {EDGE_SQL}, {PATH_SQL} SELECT o.n_name AS origin, d.n_name AS destination, coalesce(v.n_name, '') AS via, arg_min(labels, (minutes, labels)) AS labels, min(minutes) AS minutes
FROM p JOIN nation o ON o.n_nationkey = src JOIN nation d ON d.n_nationkey = dst LEFT JOIN nation v ON v.n_nationkey::VARCHAR = via WHERE r_ok(o.n_regionkey) GROUP BY ALL
""".replace(" WHERE r_ok(o.n_regionkey)", " WHERE o.n_regionkey = 1"))
def named_options(t: Tables) -> DataFrame:
    """The quickest option by origin, destination and node on the way, by name, from one region."""
    starts = t.nation.filter("n_regionkey = 1")
    found = graph.path_options(graph.paths(edges(t), "src", "dst", ["label", "mode", "note", "minutes"]), "label", "mode", "note", "minutes")
    name = lambda k, n: t.nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n))
    met = found.join(starts.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("origin")), "src").join(name("dst", "destination"), "dst")
    met = met.withColumn("v", F.nullif(F.col("via"), F.lit("")).cast("int")).drop("via").join(name("v", "via"), "v", "left")
    return met.groupBy("origin", "destination", F.coalesce("via", F.lit("")).alias("via")).agg(F.min_by("labels", F.struct("minutes", "labels")).alias("labels"), F.min("minutes").alias("minutes"))


@query("""
SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'bus' WHEN 1 THEN 'boat' WHEN 2 THEN 'walk' WHEN 3 THEN 'skyliner' END AS mode,
  CASE s_suppkey % 5 WHEN 0 THEN 'bus,boat' WHEN 1 THEN 'boat' WHEN 2 THEN 'walk,boat' WHEN 3 THEN 'skyliner,boat' ELSE 'monorail,boat' END AS legs FROM supplier
""")
def leg_modes(t: Tables) -> DataFrame:
    """Modes by what labels say, and of each leg of a journey."""
    label = F.element_at(F.lit(["Resort Bus", "Water Launch", "foot path", "Skyliner line", "taxi"]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    legs = graph.leg_modes(F.array(label, F.lit("Ferry"), F.lit("the boat")), F.lit("monorail"))
    return t.supplier.select(F.col("s_suppkey").alias("k"), graph.canonical_mode(label).alias("mode"), F.array_join(legs, ",").alias("legs"))


@query("""
SELECT DISTINCT * FROM (SELECT o_custkey::VARCHAR AS parent, o_orderkey::VARCHAR AS child, 'placed_by' AS type FROM orders UNION ALL SELECT (o_orderkey - 1)::VARCHAR, o_orderkey::VARCHAR, 'follows' FROM orders WHERE o_orderkey % 4 = 0)
""")
def lineage(t: Tables) -> DataFrame:
    """Orders' parents of two types as edges."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") - 1).alias("before"))
    return graph.lineage(rows, "o_orderkey", {"o_custkey": "placed_by", "before": "follows"})


@query("""
WITH v AS (SELECT n_nationkey AS place, n_regionkey AS version FROM nation)
SELECT n.n_name, v.version FROM v JOIN nation n ON n.n_nationkey = v.place WHERE v.version = 3 UNION ALL SELECT n_name, 9 FROM nation WHERE n_nationkey < 0
""")
def active_version(t: Tables) -> DataFrame:
    """Places of the one active version after a bulk load."""
    old = t.nation.filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("version"), F.lit(True).alias("is_active"))
    new = t.nation.filter("n_regionkey = 3").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("version"))
    live = versioning.activate(old, new, "version").filter("is_active")
    return live.join(t.nation.select(F.col("n_nationkey").alias("place"), "n_name"), "place").select("n_name", "version")


@query("""
WITH l AS (SELECT l_orderkey AS g, l_linenumber AS n, l_suppkey AS s, l_partkey % 100 AS p, l_returnflag AS f, l_quantity AS q FROM lineitem),
ids AS (SELECT g, 'places' AS r, s::VARCHAR AS id, 1 AS k FROM l UNION ALL SELECT g, 'stops', n::VARCHAR, 1 FROM l UNION ALL SELECT DISTINCT g, 'patterns', f, 1 FROM l UNION ALL SELECT g, 'edges', n || '-' || (n + 1), 1 FROM l UNION ALL SELECT g, 'services', 'v' || n, 1 FROM l),
refs AS (
  SELECT g, 'stops' AS relation, n::VARCHAR AS id, 'place' AS field, 'places' AS r, CASE WHEN n % 5 = 0 THEN s + 1 ELSE s END::VARCHAR AS ref FROM l
  UNION ALL SELECT g, 'patterns', f, 'stops', 'stops', n::VARCHAR FROM l
  UNION ALL SELECT g, 'edges', n || '-' || (n + 1), 'from', 'stops', n::VARCHAR FROM l UNION ALL SELECT g, 'edges', n || '-' || (n + 1), 'to', 'stops', (n + 1)::VARCHAR FROM l UNION ALL SELECT g, 'edges', n || '-' || (n + 1), 'pattern', 'patterns', CASE WHEN q > 45 THEN 'X' ELSE f END FROM l
  UNION ALL SELECT g, 'services', 'v' || n, 'origin', 'places', s::VARCHAR FROM l UNION ALL SELECT g, 'services', 'v' || n, 'destination', 'places', p::VARCHAR FROM l UNION ALL SELECT g, 'services', 'v' || n, 'edges', 'edges', (n - 1) || '-' || n FROM l),
faults AS (
  SELECT relation, field, 'orphan' AS fault FROM refs WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.g = refs.g AND ids.r = refs.r AND ids.id = refs.ref)
  UNION ALL SELECT r, 'id', 'repeated' FROM ids GROUP BY g, r, id HAVING count(*) > 1)
SELECT relation, field, fault, count(*) AS n FROM faults GROUP BY ALL
""")
def graph_integrity(t: Tables) -> DataFrame:
    """Orders written as graph documents, some with broken references, and read again: how many faults each relation has."""
    text = lambda c: c.cast("string")
    edge = lambda k: F.concat(text(k), F.lit("-"), text(k + 1))
    few = F.struct(F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), (F.col("l_partkey") % 100).alias("p"), (F.col("l_quantity") > 45).alias("much"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(few).alias("l"))  # an order has a few lines
    each = lambda item: F.transform("l", item)
    places = each(lambda x: F.struct(text(x["s"]).alias("id")))
    stops = each(lambda x: F.struct(text(x["n"]).alias("id"), text(F.when(x["n"] % 5 == 0, x["s"] + 1).otherwise(x["s"])).alias("place")))
    edges = each(lambda x: F.struct(edge(x["n"]).alias("id"), text(x["n"]).alias("from"), text(x["n"] + 1).alias("to"), F.when(x["much"], "X").otherwise(x["f"]).alias("pattern")))
    services = each(lambda x: F.struct(F.concat(F.lit("v"), text(x["n"])).alias("id"), text(x["s"]).alias("origin"), text(x["p"]).alias("destination"), F.array(edge(x["n"] - 1)).alias("edges")))
    patterns = F.transform(F.array_distinct(each(lambda x: x["f"])), lambda p: F.struct(p.alias("id"), F.transform(F.filter("l", lambda x: x["f"] == p), lambda x: text(x["n"])).alias("stops")))
    doc = F.to_json(F.struct(places.alias("places"), stops.alias("stops"), patterns.alias("patterns"), edges.alias("edges"), services.alias("services")))
    found = graphdoc.integrity(graphdoc.parsed(lines.select("l_orderkey", doc.alias("doc")), "l_orderkey", "doc"))
    return found.groupBy("relation", "field", "fault").agg(F.count(F.lit(1)).alias("n"))
