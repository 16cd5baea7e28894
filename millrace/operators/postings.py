"""An inverted index as tables: weighted postings with places, kept current by merges, searched with a trigram fallback.

``Index.words`` has a row for each word of each row of the source (id, word, weight, places), ``Index.grams`` one for each trigram of each name
(id, name, gram, n). A merge touches the rows of the changed ids only: their old postings go by an anti join, new ones come by a union, so the index after
any number of merges equals one built at once. A search reads the postings of the query's words and never a text.

Nulls: a null part has no words; a row whose parts are all null has no vector, and only such a row is ranked by its name's likeness. Rows with a null id are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = "[^a-z0-9]+"


def words_of(text: Column) -> Column:
    """The words of a text in order, repeats included."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def grams_of(name: Column) -> Column:
    """The distinct trigrams of a name's words, each with two blanks before it and one behind."""
    each = F.transform(F.array_distinct(words_of(name)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(each, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


@dataclass(frozen=True)
class Layout:
    """Which columns an index is made of: the key, weighted parts in order of their places, and names for likeness."""

    row_id: str
    parts: dict[str, float]
    names: tuple[str, ...]

    def postings(self, rows: DataFrame) -> DataFrame:
        """(id, word, weight, places): a word has the greatest weight of its parts and its places in all parts one after the other."""
        tagged = [_tagged(F.col(c), float(weight)) for c, weight in self.parts.items()]
        each = rows.filter(F.col(self.row_id).isNotNull()).select(F.col(self.row_id).alias("id"), F.posexplode(F.concat(*tagged)).alias("place", "w"))
        return each.groupBy("id", "w.word").agg(F.max("w.weight").alias("weight"), F.array_sort(F.collect_list("place")).alias("places"))

    def trigrams(self, rows: DataFrame) -> DataFrame:
        """(id, name, vector, gram, n): each name's trigrams and their number; ``vector`` tells whether the row has a part at all."""
        vector = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in self.parts])
        named = rows.filter(F.col(self.row_id).isNotNull()).select(F.col(self.row_id).alias("id"), vector.alias("vector"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), grams_of(F.col(c)).alias("g")) for c in self.names])).alias("x"))
        return named.select("id", "x.name", "vector", F.explode_outer("x.g").alias("gram"), F.size("x.g").alias("n"))


@dataclass(frozen=True)
class Index:
    """Postings and trigrams of one source table; both can be written, read and published like any table."""

    layout: Layout
    words: DataFrame
    grams: DataFrame

    @staticmethod
    def build(rows: DataFrame, layout: Layout) -> Index:
        """The index of a table; keys are unique."""
        return Index(layout, layout.postings(rows), layout.trigrams(rows))

    def merge(self, changes: DataFrame, at: str, deleted: str) -> Index:
        """The index after changes: rows as they are now, the last by ``at`` of each key (ties: the greatest row), deleted ones flagged."""
        lay = self.layout
        held = list(dict.fromkeys([*lay.parts, *lay.names]))
        gone = F.coalesce(F.col(deleted), F.lit(False)).alias("_gone")
        last = changes.filter(F.col(lay.row_id).isNotNull()).groupBy(lay.row_id).agg(F.max(F.struct(F.col(at).alias("_at"), gone, *held)).alias("_r"))
        keys = last.select(F.col(lay.row_id).alias("id"))
        now = last.filter(~F.col("_r._gone")).select(lay.row_id, *[F.col("_r")[c].alias(c) for c in held])
        rest = lambda table: table.join(keys, "id", "left_anti")
        return Index(lay, rest(self.words).unionByName(lay.postings(now)), rest(self.grams).unionByName(lay.trigrams(now)))

    def search(self, query: str | None, threshold: float = 0.3) -> DataFrame:
        """(id, rank, via) of all rows that a web-style query finds, or of all rows of the index if it is empty.

        Words are all wanted, ``-word`` must not occur, ``"some words"`` stand side by side, and ``or`` parts alternatives. A row found so (``via`` words)
        ranks by the mean weight of its best alternative's words. A row is found by a name too (``via`` name) if it shares
        ``threshold`` of its trigrams with the query; it ranks by that share if it has no vector and last otherwise.
        """
        wanted = [a for a in map(_alternative, re.split(r"\s+or\s+(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", (query or "").strip().lower())) if a[0] or a[1]]
        if not wanted:
            return self.words.select("id").union(self.grams.select("id")).distinct().select("id", F.lit(0.0).alias("rank"), F.lit("all").alias("via"))
        named = sorted({w for phrases, none in wanted for w in (*(w for p in phrases for w in p), *none)})
        rows = self.words.filter(F.col("word").isin(*named)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", F.struct("weight", "places")))).alias("m"))
        ranks = [F.when(_holds(F.col("m"), phrases, none), _weight(F.col("m"), phrases)) for phrases, none in wanted if phrases]
        by_words = rows.select("id", (F.greatest(*ranks) if len(ranks) > 1 else ranks[0] if ranks else F.lit(None).cast("double")).alias("word_rank")).filter("word_rank is not null")
        mine = grams_of(F.lit(query))
        shared = self.grams.filter(F.array_contains(mine, F.col("gram"))).groupBy("id", "name").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("vector").alias("vector"))
        alike = F.round(F.col("c") / (F.size(mine) + F.col("n") - F.col("c")), 6)
        by_name = shared.withColumn("alike", alike).filter(F.col("alike") >= threshold).groupBy("id").agg(F.max("alike").alias("alike"), F.first("vector").alias("vector"))
        met = by_words.join(by_name, "id", "full")
        rank = F.coalesce("word_rank", F.when(F.col("vector"), 0.0).otherwise(F.col("alike")))
        return met.select("id", rank.alias("rank"), F.when(F.col("word_rank").isNotNull(), "words").otherwise("name").alias("via"))

    def summary(self) -> DataFrame:
        """(word, rows, weight, places, place_sum): what each word has in the index."""
        placed = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p)
        totals = F.count(F.lit(1)).alias("rows"), F.round(F.sum("weight"), 4).alias("weight"), F.sum(F.size("places").cast("long")).alias("places"), F.sum(placed).alias("place_sum")
        return self.words.groupBy("word").agg(*totals)


def _tagged(text: Column, weight: float) -> Column:
    return F.transform(words_of(text), lambda w: F.struct(w.alias("word"), F.lit(weight).alias("weight")))


def _begins(m: Column, word: str, nth: int) -> Column:
    """Where phrases begin whose ``nth`` word this is."""
    places = F.coalesce(F.try_element_at(m, F.lit(word))["places"], F.lit([]).cast("array<int>"))
    return F.transform(places, lambda p: p - nth)


def _alternative(text: str) -> tuple[list[list[str]], list[str]]:
    """(phrases, words that must not occur) of one alternative; a single word is a phrase of one."""
    phrases, none = [], []
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', text):
        words = [w for w in re.split(SEPARATORS, quoted or plain) if w]
        if words and minus:
            none += words
        elif words:
            phrases.append(words)
    return phrases, none


def _holds(m: Column, phrases: list[list[str]], none: list[str]) -> Column:
    """Whether a row's map of words has every phrase and no unwanted word."""
    begins = [reduce(F.array_intersect, [_begins(m, w, i) for i, w in enumerate(words)]) for words in phrases]
    return reduce(lambda a, b: a & b, [F.size(b) > 0 for b in begins] + [F.try_element_at(m, F.lit(w)).isNull() for w in none])


def _weight(m: Column, phrases: list[list[str]]) -> Column:
    words = list(dict.fromkeys(w for p in phrases for w in p))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(m, F.lit(w))["weight"], F.lit(0.0)) for w in words])
    return F.round(total / len(words), 6)
