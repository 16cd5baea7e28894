"""Embedding near-duplicates by an epsilon grid order join.

Vectors with a cosine of at least ``threshold`` are, scaled to length 1, at most
eps = sqrt(2 - 2 * threshold) apart, and so are their projections on any orthonormal directions. The
directions are the leading principal components of all vectors (second moments summed in Spark).
Cells of width eps on the first ``sort_dims`` of them give each vector its place in epsilon grid order (lexicographic by label and cells),
a range sort in Spark. The sorted sequence is cut into intervals of at most ``block`` vectors, each with the box of cells that it spans.
Two intervals of a label are joined only if their boxes touch, that is, are at most one cell apart in every direction; all others hold no pair. Interval pairs are
found by equality of occupied cells on the first ``key_dims`` directions, from a table of one row an interval and cell.

A pair of intervals is one group of a task: at most two blocks of vectors, whatever the density. There, both are joined by recursive halving: parts whose
cells are over one apart in some direction are skipped as a whole; small parts are compared by their exact double-precision cosines.

Equal vectors of a label are collapsed first and counted. A task returns each vector's number of partners and one
link to the least member of its component in the group: no pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing;
vectors of different lengths don't link; repeated rows of one vec_id count as separate vectors; a null vec_id is kept
with its links; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_materialized, materialize
from millrace.llm.components import connected_components, merge_labels


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal_directions(unique: DataFrame, dim: int) -> np.ndarray:
    """The principal directions of all unit vectors of one length, the leading first (as columns)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            u = _matrix(b.column(0), dim)
            total += u.T @ u
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

    summed = unique.select("unit").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    total = np.zeros(dim * dim)
    for row in summed.collect():  # dim * dim numbers
        total[row["at"]] = row["v"]
    _, vectors = np.linalg.eigh(total.reshape(dim, dim))
    return vectors[:, ::-1]


def join_intervals(cells: np.ndarray, units: np.ndarray, first: int, threshold: float, weights: np.ndarray, leaf: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Epsilon grid order join of the first ``first`` vectors with the others (with themselves if there are no others).

    Both parts are sorted by ``cells``. Returns each vector's summed weight of partners and the component labels.
    """
    n = len(units)
    links, labels = np.zeros(n, np.int64), np.arange(n)
    spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def span(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if (lo, hi) not in spans:
            spans[lo, hi] = cells[lo:hi].min(0), cells[lo:hi].max(0)
        return spans[lo, hi]

    def compare(a0: int, a1: int, b0: int, b1: int) -> None:
        close = units[a0:a1] @ units[b0:b1].T >= threshold
        if a0 == b0:
            close = np.triu(close, 1)
        if not close.any():
            return
        links[a0:a1] += close @ weights[b0:b1]
        links[b0:b1] += close.T @ weights[a0:a1]
        x, y = np.nonzero(close)
        merge_labels(labels, x + a0, y + b0)

    stack = [(0, n, 0, n) if first == n else (0, first, first, n)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a0 != b0:
            (alo, ahi), (blo, bhi) = span(a0, a1), span(b0, b1)
            if ((alo - bhi > 1) | (blo - ahi > 1)).any():
                continue
        if a1 - a0 <= leaf and b1 - b0 <= leaf:
            compare(a0, a1, b0, b1)
            continue
        am, bm = (a0 + a1) // 2, (b0 + b1) // 2
        if a0 == b0:
            stack += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
        else:
            stack += [(a0, am, b0, bm), (a0, am, bm, b1), (am, a1, b0, bm), (am, a1, bm, b1)]
    return links, labels


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    key_dims: int = 3,
    sort_dims: int = 12,
    block: int = 4096,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    spark = vectors.sparkSession
    eps = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    raw = F.col(embedding).cast("array<double>")
    fine = F.coalesce(F.size(raw) > 0, F.lit(False)) & F.col(label).isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(raw, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.when(fine, raw).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))
    rows = materialize(rows.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), "key"), "vectors")
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    unique = rows.filter("v is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    unique = unique.withColumn("s", scaled).withColumn("norm", norm).select(F.xxhash64("key").alias("id"), "key", "least", "n", "label", F.size("v").alias("dim"), F.transform("s", lambda x: x / F.col("norm")).alias("unit"))
    unique = materialize(unique, "unique")
    found = []
    for dim in sorted(r["dim"] for r in unique.select("dim").distinct().collect()):
        part = unique.filter(F.col("dim") == dim)
        found.append(_joined(part, dim, principal_directions(part, dim), eps, threshold, key_dims, sort_dims, block))
    links = found[0] if found else spark.createDataFrame([], "key string, root string, links long")
    for more in found[1:]:
        links = links.union(more)
    parts = connected_components(links.filter("root is not null"), "key", "root")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    placed = unique.select("key", "least", "n").join(counts, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "key"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", "key").join(of, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


def in_grid_order(part: DataFrame, dim: int, directions: np.ndarray, eps: float, block: int) -> DataFrame:
    """(interval, label, key, n, unit, cells): the vectors of one length in epsilon grid order, cut into intervals of one label and at most ``block`` rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = np.floor(_matrix(b.column("unit"), dim) @ directions / eps).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], ["label", "key", "n", "unit", "cells"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, last = (TaskContext.get().partitionId() << 40) - 1, block, None
        for b in batches:
            numbers = []
            for label in b.column("label").to_pylist():
                if held == block or label != last:
                    at, held, last = at + 1, 0, label
                held += 1
                numbers.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *b.columns], ["interval", "label", "key", "n", "unit", "cells"])

    columns = f"label {part.schema['label'].dataType.simpleString()}, key string, n long, unit array<double>, cells array<int>"
    placed = part.select("label", "key", "n", "unit").mapInArrow(place, columns)
    n = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The key divides what shares all its cells.
    return materialize(placed.repartitionByRange(n, "label", "cells", "key").sortWithinPartitions("label", "cells", "key").mapInArrow(cut, f"interval long, {columns}"), "grid-order")


def touching_intervals(rows: DataFrame, dims: int, key_dims: int) -> DataFrame:
    """(i, j), i <= j: intervals of one label whose boxes are at most one cell apart in every direction."""
    edges = [f(F.col("cells")[k]).alias(f"{name}{k}") for k in range(dims) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    prefixes = F.collect_set(F.slice("cells", 1, key_dims)).alias("prefixes")  # at most the rows of an interval
    boxes = materialize(rows.groupBy("interval", "label").agg(*edges, prefixes), "boxes")
    here = boxes.withColumn("p", F.explode("prefixes")).drop("prefixes")
    steps = F.array(*[F.array(*map(F.lit, o)) for o in product((-1, 0, 1), repeat=key_dims)])
    there = here.withColumn("o", F.explode(steps)).withColumn("p", F.zip_with("p", "o", lambda x, y: x + y)).drop("o").distinct()
    there = there.select("label", "p", *[F.col(c).alias(f"{c}_") for c in here.columns if c not in ("label", "p")])
    touch = F.lit(True)
    for k in range(dims):
        touch = touch & (F.col(f"lo{k}") <= F.col(f"hi{k}_") + 1) & (F.col(f"lo{k}_") <= F.col(f"hi{k}") + 1)
    met = here.join(there, ["label", "p"]).filter((F.col("interval") <= F.col("interval_")) & touch)
    return met.select(F.col("interval").alias("i"), F.col("interval_").alias("j")).distinct()


def _joined(part: DataFrame, dim: int, directions: np.ndarray, eps: float, threshold: float, key_dims: int, sort_dims: int, block: int) -> DataFrame:
    """(key, root, links): partners counted and local components of all vectors of one length."""
    dims = min(sort_dims, dim)
    rows = in_grid_order(part, dim, directions[:, :dims], eps, block)
    pairs = materialize(touching_intervals(rows, dims, min(key_dims, dims)), "pairs")
    one = pairs.select(F.col("i").alias("interval"), "i", "j").union(pairs.filter("i < j").select(F.col("j").alias("interval"), "i", "j"))
    n = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(one, "interval").select("i", "j", "interval", "cells", "key", "n", "unit").repartition(n, "i", "j").sortWithinPartitions("i", "j", "interval", "cells", "key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            cuts = [0, *(np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if (i[lo], j[lo]) != last:
                    yield from group(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = (i[lo], j[lo])
        yield from group(held)

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or table.num_rows < 2:
            return
        units = _matrix(table.column("unit").combine_chunks(), dim)
        cells = _matrix(table.column("cells").combine_chunks(), dims)
        interval = table.column("interval").to_numpy()
        links, labels = join_intervals(cells, units, int((interval == interval[0]).sum()), threshold, table.column("n").to_numpy())
        hit = np.flatnonzero(links)
        if len(hit):
            key, root = table.column("key"), labels[hit]
            roots = pc.if_else(pa.array(root == hit), pa.scalar(None, pa.string()), key.take(pa.array(root)).combine_chunks())
            yield pa.RecordBatch.from_arrays([key.take(pa.array(hit)).combine_chunks(), roots, pa.array(links[hit])], ["key", "root", "links"])

    links = materialize(dealt.mapInArrow(join, "key string, root string, links long"), "links")
    drop_materialized(rows, pairs)
    return links
