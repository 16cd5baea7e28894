"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of a 60-bit ring; a row belongs to the
first point at or after its hash. A shard takes rows up to its capacity, its
own rows first; the rows beyond it go on clockwise to the next points whose
shard has room. With ``slack`` = 0 the capacities are n/shards rounded up or down, so
counts are at most one apart (the law ``rows``).

Only DataFrame operations run on rows. Loads are counted by (arc, slice), a slice being a
power-of-two part of the ring with about ``slice_rows`` rows; the driver sees one row an
arc (shards * virtual_nodes), pours the counts along the ring, and sends back
segments "rows [from, to) of this arc go to that shard from this slot on", at most
arcs * shards of them. A row's place in its arc is its slice's offset plus its rank in the
slice, so no task ever orders more than about ``slice_rows`` distinct rows. Rows equal in all
columns used here are interchangeable: they are counted as one before the rank and spread again after it.

Edge cases: null text has size 1 and crc 0; a null doc_id is a value of its own;
repeated rows get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash60, materialize, small_table

RING_BITS = 60


def ring_points(spark: SparkSession, shards: int, virtual_nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in ring order."""
    nodes = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.col("id").alias("node"))
    rows = nodes.select(hash60(F.lit("node"), F.col("shard"), F.col("node"), seed=seed).alias("p"), "shard").collect()
    return sorted({r["p"]: r["shard"] for r in rows}.items())


def pour(points: list[tuple[int, int]], loads: dict[int, int], shards: int, slack: float = 0.0) -> list[dict]:
    """Segments (arc, from_, to_, shard, slot) that put each arc's rows on shards within capacity."""
    total = sum(loads.values())
    if slack:
        room = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    slots, segments, over = [0] * shards, [], []

    def put(arc: int, start: int, n: int, shard: int) -> None:
        segments.append({"arc": arc, "from_": start, "to_": start + n, "shard": shard, "slot0": slots[shard]})
        slots[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(points):
        n = loads.get(arc, 0)
        if own := min(n, room[shard]):
            put(arc, 0, own, shard)
        if n > own:
            over.append((arc, own, n - own))
    for arc, start, n in over:
        at = arc
        while n:
            at = (at + 1) % len(points)
            shard = points[at][1]
            if took := min(n, room[shard]):
                put(arc, start, took, shard)
                start, n = start + took, n - took
    return segments


#: Rows of one count that are spread at once.
SPREAD = 1 << 14


def _spread(ranked: DataFrame) -> DataFrame:
    """Each counted row ``n`` times, with ``rank`` from ``first`` on.

    A count beyond ``SPREAD`` is cut into so many pieces of that size; these are dealt over all tasks before they are spread, so no task holds or
    makes more of one row than others do. (The pieces of pieces keep every array short.)
    """
    few = ranked.filter(F.col("n") <= SPREAD)
    many = ranked.filter(F.col("n") > SPREAD)
    for size in (SPREAD**3, SPREAD**2, SPREAD):
        at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)))
        cut = many.withColumn("_k", at).withColumn("first", F.col("first") + F.col("_k") * size)
        many = cut.withColumn("n", F.least(F.lit(size).cast("long"), F.col("n") - F.col("_k") * size)).drop("_k")
    many = many.repartition(F.xxhash64("first", "arc", "slice"))
    return few.unionByName(many).withColumn("rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    virtual_nodes: int = 64,
    slack: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
    slice_rows: int = 1 << 16,
    seed: int = 0,
) -> DataFrame:
    """doc_id, size, text_crc32, home (the shard before overflow), shard and slot of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).cast("long").alias("text_crc32"))
    rows = materialize(rows.withColumn("h", hash60(F.col("doc_id"), F.col("text_crc32"), seed=seed)), "ring")
    total = rows.count()
    slice_bits = max(9, (max(total, 1) // slice_rows).bit_length())
    points = ring_points(spark, shards, virtual_nodes, seed)
    # The first point at or after a hash, by cells of the ring, about eight a point whatever the table's size: a cell's first point and the points in it.
    cell_bits = (8 * len(points)).bit_length()
    inner: dict[int, list[int]] = {}
    for p, _ in points:
        inner.setdefault(p >> (RING_BITS - cell_bits), []).append(p)
    table = [{"cell": k, "first": bisect_left(points, (k << (RING_BITS - cell_bits), -1)) % len(points), "cuts": inner.get(k, [])} for k in range(1 << cell_bits)]
    cells = F.broadcast(small_table(spark, table, "cell bigint, first int, cuts array<bigint>"))
    past = F.aggregate("cuts", F.lit(0), lambda n, cut: n + (cut < F.col("h")).cast("int"))
    placed = rows.withColumn("cell", F.shiftright("h", RING_BITS - cell_bits)).join(cells, "cell")
    placed = placed.withColumn("slice", F.shiftright("h", RING_BITS - slice_bits)).withColumn("arc", (F.col("first") + past) % len(points))
    same = placed.groupBy("arc", "slice", "h", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    counts = placed.groupBy("arc", "slice").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("arc").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    loads = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("rows").alias("n")).collect()}  # one row an arc
    segments = F.broadcast(small_table(spark, pour(points, loads, shards, slack), "arc int, from_ bigint, to_ bigint, shard int, slot0 bigint"))
    homes = F.broadcast(small_table(spark, [{"arc": a, "home": s} for a, (_, s) in enumerate(points)], "arc int, home int"))
    inside = Window.partitionBy("arc", "slice").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets.select("arc", "slice", "offset"), ["arc", "slice"])
    each = _spread(materialize(ranked.withColumn("first", F.col("offset") + F.col("before")).drop("offset", "before"), "ring-ranks"))
    return (
        each.join(segments, (each["arc"] == segments["arc"]) & (F.col("rank") >= F.col("from_")) & (F.col("rank") < F.col("to_")))
        .drop(segments["arc"])
        .join(homes, "arc")
        .select("doc_id", "size", "text_crc32", "home", "shard", (F.col("slot0") + F.col("rank") - F.col("from_")).alias("slot"))
    )
