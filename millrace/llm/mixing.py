"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. A source whose target is ``c`` whole
passes plus a rest takes all its documents ``c`` times and, once more, those
whose hash lies below the source's threshold. The threshold comes from a
histogram of sizes by (source, leading hash bits): the bucket in which the
running size crosses the rest is the boundary, and only that bucket is counted
again by its next bits, until it holds one hash. Nothing is sorted, and a larger rest
always keeps the documents that a smaller one took (nested samples).

Scale: one narrow table (hash, source, size) is written once; each level is a
partial aggregation to at most ``2**bits`` rows a source, so a source with a
third of all rows shuffles no more than any other. The driver sees one row a
source and level; the number of sources is checked against ``max_sources``.

Edge cases: null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0; rows equal in doc_id and text share one hash and one
decision; an empty table gives an empty result; only the named columns are read,
so extra columns don't clash.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash60, materialize, named, small_table, word_count

HASH_BITS = 60


def fill_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], max_repeat: int) -> list[Fraction]:
    """Share the sum of sizes by repeating weights; no share exceeds ``max_repeat`` sizes.

    What a full source leaves over is shared again by weight among the others.
    """
    total = sum(size for _, size in sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [max_repeat * size for _, size in sizes]
    full: set[int] = set()
    while True:
        rest = total - sum(cap[i] for i in full)
        open_weight = sum(w[i] for i in range(len(sizes)) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and rest * w[i] > cap[i] * open_weight}
        if not over:
            break
        full |= over
    return [Fraction(cap[i]) if i in full else Fraction(rest * w[i], open_weight) for i in range(len(sizes))]


def _thresholds(base: DataFrame, rests: dict[str | None, Fraction], bits: int) -> dict[str | None, int]:
    """Each source's hash threshold: documents with a smaller hash make up its rest."""
    spark = base.sparkSession
    found = dict.fromkeys(rests, 0)
    state = {s: (0, 0) for s, rest in rests.items() if rest > 0}  # source: (prefix so far, size below it)
    used = 0
    while state:
        step = min(bits, HASH_BITS - used)
        left = {s: rests[s] - below for s, (_, below) in state.items()}
        rows = [{"s": s, "prefix": p, "rest": left[s].numerator, "den": left[s].denominator} for s, (p, _) in state.items()]
        open_ = F.broadcast(small_table(spark, rows, "s string, prefix bigint, rest decimal(38,0), den decimal(12,0)"))
        digit = F.shiftright("h", HASH_BITS - used - step)
        histogram = (
            base.join(open_, base["source"].eqNullSafe(open_["s"]) & (F.shiftright("h", HASH_BITS - used) == F.col("prefix")))
            .groupBy("s", "rest", "den", digit.alias("bucket"))
            .agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        )
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        crossed = (
            histogram.withColumn("upto", upto)
            .filter(F.col("upto").cast("decimal(26,0)") * F.col("den") >= F.col("rest"))
            .groupBy("s")
            .agg(F.min_by(F.struct("bucket", "n", "lo", "hi", "upto"), "bucket").alias("b"))
        )
        used += step
        following = {}
        for row in crossed.collect():  # one row a source
            s, b = row["s"], row["b"]
            below = state[s][1] + b["upto"] - b["n"]
            if b["lo"] == b["hi"] or used == HASH_BITS:
                nearer_with = rests[s] - below > below + b["n"] - rests[s]
                found[s] = b["lo"] + 1 if nearer_with else b["lo"]
            else:
                following[s] = (b["bucket"], below)
        state = following
    return found


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeat: int = 3,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    size: Column | None = None,
    bits: int = 12,
    seed: int = 0,
    max_sources: int = 100_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size, source_size, target, copies, taken and, as a struct
    ``carried``, the columns named in ``carry``, whatever their names. ``size`` defaults to the words of ``text``.
    """
    spark = docs.sparkSession
    own = F.md5(F.col(text).cast("binary"))
    size = word_count(F.col(text)) if size is None else size
    carried = [F.struct(*map(named, carry)).alias("carried")] if carry else []
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"), hash60(F.col(doc_id), own, seed=seed).alias("h"), *carried)
    base = materialize(base, "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(sizes) > max_sources:
        raise ValueError(f"more than max_sources={max_sources} sources")
    ordered = sorted(((r["source"], r["n"] or 0) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    targets = fill_targets(ordered, weights, max_repeat)
    rows, rests = [], {}
    for (s, n), t in zip(ordered, targets, strict=True):
        whole = int(t // n) if n else 0
        rests[s] = t - whole * n
        rows.append({"s": s, "source_size": n, "target": float(t), "whole": whole})
    threshold = _thresholds(base.select("source", "size", "h"), rests, bits)
    for row in rows:
        row["below"] = threshold[row["s"]]
    plan = small_table(spark, rows, "s string, source_size bigint, target double, whole int, below bigint")
    plan = F.broadcast(plan)  # at most max_sources rows
    copies = F.col("whole") + (F.col("h") < F.col("below")).cast("int")
    return (
        base.join(plan, base["source"].eqNullSafe(plan["s"]))
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["carried"] if carry else []))
    )


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, from doc_id, source and what was carried, as often as ``copies`` says."""
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    fields = [F.col(c) if c in ("doc_id", "source") else F.col("carried").getField(c).alias(c) for c in columns]
    return mixed.filter(F.col("copies") > 0).select(*fields, copies.alias("_copy")).drop("_copy")
