"""Bounded paths and per-node summaries of edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import run_length_dedupe


def two_hop_paths(edges: DataFrame, src: str, dst: str, label: str) -> DataFrame:
    """(src, via, dst, labels): simple paths of exactly two edges. One equality join on the middle node; nothing is revisited."""
    a = edges.select(F.col(src).alias("src"), F.col(dst).alias("via"), F.col(label).alias("l1"))
    b = edges.select(F.col(src).alias("via"), F.col(dst).alias("dst"), F.col(label).alias("l2"))
    met = a.join(b, "via").filter("src <> via and via <> dst and src <> dst")
    return met.select("src", "via", "dst", F.when(F.col("l1") == F.col("l2"), F.col("l1")).otherwise(F.concat_ws(">", "l1", "l2")).alias("labels"))


def node_modes(feeds: list[DataFrame]) -> DataFrame:
    """(node, modes, sources): sorted distinct modes and sources from several (node, mode, source) feeds."""
    union = feeds[0]
    for f in feeds[1:]:
        union = union.unionByName(f)
    return union.distinct().groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def paths(edges: DataFrame, src: str, dst: str, fields: list[str], starts: list | None = None) -> DataFrame:
    """(src, dst, depth, nodes, steps): simple paths of one and two edges, their nodes in order and a struct of ``fields`` for each edge.

    Equal edges are one. Two-edge paths come from one equality join on the middle node, which adaptive skew handling splits
    where a hub has many edges; with ``starts`` only paths from these nodes are built.
    """
    one = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.struct(*fields).alias("step")).filter("src <> dst").distinct()
    first = one if starts is None else one.filter(F.col("src").isin(*starts))
    direct = first.select("src", "dst", F.lit(1).alias("depth"), F.array("src", "dst").alias("nodes"), F.array("step").alias("steps"))
    a, b = first.toDF("src", "via", "s1"), one.toDF("via", "dst", "s2")
    two = a.join(b, "via").filter("src <> dst").select("src", "dst", F.lit(2).alias("depth"), F.array("src", "via", "dst").alias("nodes"), F.array("s1", "s2").alias("steps"))
    return direct.unionByName(two)


def path_options(found: DataFrame, label: str, mode: str, note: str, minutes: str) -> DataFrame:
    """What a traveller is shown of each path: nodes on the way, labels in order without repeats, modes, distinct notes and the sum of minutes."""
    texts = lambda name: F.transform("steps", lambda s: s[name].cast("string"))
    return found.select(
        "src", "dst", "depth",
        F.array_join(F.transform(F.slice("nodes", F.lit(2), F.size("nodes") - 2), lambda n: n.cast("string")), ",").alias("via"),
        F.array_join(run_length_dedupe(texts(label)), " > ").alias("labels"),
        F.array_join(F.array_distinct(texts(mode)), ",").alias("modes"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(texts(note), lambda n: n.isNotNull()))), ";").alias("notes"),
        F.aggregate("steps", F.lit(0).cast("long"), lambda total, s: total + s[minutes].cast("long")).alias("minutes"),
    )


#: Words by which modes are known, in order of precedence.
MODE_WORDS = {"skyliner": ("skyliner", "gondola"), "monorail": ("monorail", "rail"), "boat": ("boat", "ferry", "launch", "water"), "bus": ("bus", "coach", "shuttle"), "walk": ("walk", "path", "foot")}


def canonical_mode(text: Column) -> Column:
    """The mode that a text names; null if it names none."""
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.rlike(r"\b(" + "|".join(words) + ")"), F.lit(mode)) for mode, words in MODE_WORDS.items()])


def leg_modes(labels: Column, default: Column) -> Column:
    """The mode of each leg by its label, else the default, one of each run."""
    return run_length_dedupe(F.transform(labels, lambda x: F.coalesce(canonical_mode(x), default)))


def lineage(rows: DataFrame, child: str, parents: dict[str, str]) -> DataFrame:
    """(parent, child, type) edges from columns that name parents; rows without that parent have no edge."""
    edges = F.array(*[F.struct(F.col(c).cast("string").alias("parent"), F.col(child).cast("string").alias("child"), F.lit(kind).alias("type")) for c, kind in parents.items()])
    return rows.select(F.inline(edges)).filter("parent is not null").distinct()
