"""Typo-tolerant weighted search over document tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scoring import field_score
from millrace.operators.ranking import numbered_top


def score(df: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """``score``, the greatest of the weighted field scores, and ``hits``, all fields that score; only rows that do."""
    q = F.lit(query.strip().lower())
    per = {f: field_score(q, F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), w) for f, w in weights.items()}
    hits = F.array_join(F.array_compact(F.array(*[F.when(s > 0, F.lit(f)) for f, s in per.items()])), ",")
    columns = list(per.values())
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return df.withColumn("score", F.round(best, 6)).filter("score > 0").withColumn("hits", hits)


def suggest(df: DataFrame, prefix: str, column: str, limit: int = 8) -> DataFrame:
    """The most frequent values that start with the prefix (two characters or more)."""
    low = F.lower(column)
    return df.filter(F.lit(len(prefix) >= 2) & low.startswith(prefix.lower())).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(limit)


def levels(text: Column, query: str, words: list[str], exact: float, prefix: float, contains: float, token: float) -> Column:
    """The level of a phrase in a text: equal, beginning, inside, or the share of its words inside; 0 for none."""
    inside = [F.contains(text, F.lit(w)).cast("int") for w in words]
    hits = reduce(lambda a, b: a + b, inside, F.lit(0))
    part = hits * F.lit(float(token)) / max(len(words), 1)
    return F.when(text == query, float(exact)).when(F.startswith(text, F.lit(query)), float(prefix)).when(F.contains(text, F.lit(query)), float(contains)).otherwise(part)


@dataclass(frozen=True)
class Scorer:
    """How one kind of row scores: levels of its title, of all its words, and boosts added where they hold."""

    title: Column
    words: Column
    on_title: tuple[float, float, float, float]
    on_words: tuple[float, float, float, float]
    boosts: tuple[Column, ...] = ()

    def score(self, query: str) -> Column:
        q = query.strip().lower()
        parts = [w for w in re.split("[^a-z0-9]+", q) if w]
        total = levels(F.lower(self.title), q, parts, *self.on_title) + levels(F.lower(self.words), q, parts, *self.on_words)
        return reduce(lambda a, b: a + b, self.boosts, total)


def intent(words: Column, aliases: dict[str, str]) -> Column:
    """The category of the first word that has one, else that of all words together; null if none has."""
    table = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    each = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda c: c.isNotNull())
    return F.coalesce(F.get(each, F.lit(0)), F.try_element_at(table, F.array_join(words, " ")))


def word_weights(parts: dict[str, tuple[Column, float]]) -> Column:
    """A weighted word vector: each word of each part with the greatest weight of its parts, in order of words."""

    def weighted(c: Column, weight: float) -> Column:
        words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))

    every = F.concat(*[weighted(*p) for p in parts.values()])
    return F.transform(F.array_sort(F.array_distinct(F.transform(every, lambda e: e["word"]))), lambda w: F.struct(w.alias("word"), F.array_max(F.transform(F.filter(every, lambda e: e["word"] == w), lambda e: e["weight"])).alias("weight")))


def rank(vector: Column, query: str) -> Column:
    """The sum of the query words' weights in a vector if it has all of them, else null."""
    words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", query.lower()) if w))

    def entry(word: str) -> Column:
        return F.filter(vector, lambda e: e["word"] == word)

    held = [entry(w) for w in words]
    every = reduce(lambda a, b: a & b, [F.size(h) > 0 for h in held], F.lit(bool(words)))
    return F.when(every, reduce(lambda a, b: a + b, [F.coalesce(F.get(h, F.lit(0))["weight"], F.lit(0.0)) for h in held], F.lit(0.0)))


def hydrate(hits: DataFrame, sources: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Hits (place, kind, id) with their rows from the source of their kind, in the order of the hits; hits without a row are dropped."""
    out = None
    for kind, source in sources.items():
        one = hits.filter(F.col("kind") == kind).join(source.select("id", *columns), "id").select("place", "kind", "id", *columns)
        out = one if out is None else out.unionByName(one)
    return out


def capped(hits: DataFrame, caps: dict[str, int], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` hits of all kinds, and of these each kind's first as its cap says; kinds without a cap go."""
    top = numbered_top(hits, order, limit)
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(caps.items()) for x in kv]), F.col("kind"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("place"))
    return top.withColumn("_n", nth).filter(F.col("_n") <= F.coalesce(cap, F.lit(0))).drop("_n")


def similar_sets(rows: DataFrame, row_id: str, items: str, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of rows whose sets have a Jaccard similarity of ``threshold`` or more.

    Sets are ordered from their rarest item. Two sets that are alike share one of each other's first n - ceil(threshold * n) + 1 items,
    so only these are joined on, and only sets of like sizes; common items, which nearly all sets hold, come last and are seldom joined on.
    """
    each = rows.select(F.col(row_id).alias("id"), F.explode(F.array_distinct(items)).alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, "x").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda e: e["x"]).alias("s"))  # one row's items
    ordered = ordered.withColumn("size", F.size("s")).withColumn("x", F.explode(F.slice("s", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int"))))
    side = lambda k: ordered.select("x", F.col("id").alias(k), F.col("s").alias(f"s{k}"), F.col("size").alias(f"n{k}"))
    like = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    met = side("a").join(side("b"), "x").filter((F.col("a") < F.col("b")) & like).dropDuplicates(["a", "b"])
    shared = F.size(F.array_intersect("sa", "sb"))
    similarity = shared / (F.col("na") + F.col("nb") - shared)
    return met.select("a", "b", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
