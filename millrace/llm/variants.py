"""Spelling variants by anagram hashing.

A word's anagram key is the sum of its letters' fifth powers, so all orders of the same letters share it, and a word with one letter
added, removed or exchanged differs by that letter's value or by the difference of two. Every word gives its own key and, for each
different letter, its key less that letter's value. Keys on which two words meet bring together

- a word and one with a letter more (own key = key less a letter), and
- two words with one letter exchanged (equal keys less a letter each).

Only those words have the order of their letters verified: what is left of the letters in their order, by digest and, for an exchange,
the place of the letter taken out. Words that agree there are one edit apart, whatever their lengths.

Scale: no pairs are compared. The anagram keys are a narrow table of at most one row a different letter of a word; words that
meet nobody there go no further, so a long lone word is never taken apart. An exchange group has one word for each letter of the
alphabet at most and gives counts and the two best words; additions are an equality join, one row a link. A popular anagram key or a short word with
many neighbours is split by adaptive skew handling or combined in the map stage. Forms strictly grow in
frequency, so roots are found by doubling: a few joins, logarithmic in the longest chain.

Edge cases: null texts have no words; a null doc_id is empty text in the planted slips; words equal after the slips are one; an
empty table gives an empty result; only the named columns are read; words that differ only in order are not near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_materialized, materialize

#: A run of letters; of capitals, only A to Z are lowered.
LETTERS = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(run: Column, doc_id: Column, one_in: int = 97) -> Column:
    """The run without its code point ``h`` modulo its length where ``one_in`` divides ``h``, the crc32 of ``doc_id:run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 5, least_count: int = 3, slips: bool = False) -> DataFrame:
    """word and n: the texts' letter runs of at least that many letters and occurrences, with planted slips if asked for."""
    low = F.translate(F.col(text).cast("string"), CAPITALS, SMALL)
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))
    word = slipped(F.col("run"), F.col("doc_id")) if slips else F.col("run")
    words = runs.select(word.alias("word")).filter(F.char_length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letter_value(letter: Column) -> Column:
    """A letter's fifth power; of code points from 4096 on, that of the remainder, since order is verified anyway."""
    c = F.ascii(letter).cast("long") % 4096
    return c * c * c * c * c


def anagram_rows(words: DataFrame) -> DataFrame:
    """key, word, n and letter: each word's anagram key (letter null) and its key less each different letter's value."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    # Sums of long words wrap like hashes do: equal sums stay equal.
    total = F.aggregate("letters", F.lit(0).cast("long"), lambda a, c: _wrapped(a, letter_value(c)))
    keyed = words.select("word", "n", letters.alias("letters")).withColumn("key", total)
    less = F.transform(F.array_distinct("letters"), lambda c: F.struct(_wrapped(F.col("key"), -letter_value(c)).alias("key"), c.alias("letter")))
    own = F.array(F.struct(F.col("key"), F.lit(None).cast("string").alias("letter")))
    return keyed.select("word", "n", F.inline(F.concat(own, less)))


def _wrapped(a: Column, b: Column) -> Column:
    """The sum modulo 2**62, not negative."""
    return F.pmod(a + b, F.lit(1 << 62))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (n and word of the near word of largest n, then first in code-point order) of words that have near ones.

    ``words`` has word and n, each word once. Two words are near if one inserted, deleted or replaced code point makes one the other.
    """
    rows = materialize(anagram_rows(words), "anagram-keys")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("letter").isNull()).alias("owns"))
    met = rows.join(keys.filter("members > 1"), "key")
    digest = lambda w: F.md5(w.cast("binary"))
    own = met.filter("letter is null and members > owns").select("key", "n", "word", digest(F.col("word")).alias("rest"))
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substr(F.col("word"), i, F.lit(1)) == F.col("letter"))
    rest = F.concat(F.substr(F.col("word"), F.lit(1), F.col("place") - 1), F.substr(F.col("word"), F.col("place") + 1))
    taken = met.filter("letter is not null").select("key", "n", "word", "members", "owns", F.explode(places).alias("place"))
    taken = materialize(taken.select("key", "n", "word", "place", "members", "owns", digest(rest).alias("rest")), "letters-left")
    # One letter exchanged: the same letters left in the same order, taken out at the same place.
    by_order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))
    groups = taken.filter("members - owns > 1").groupBy("key", "rest", "place").agg(by_order.alias("of")).filter(F.size("of") > 1)
    exchanged = groups.select(F.explode("of").alias("own"), "of").select(F.col("own.word").alias("word"), (F.size("of") - 1).cast("long").alias("n_near"), F.when(F.col("of")[0] == F.col("own"), F.col("of")[1]).otherwise(F.col("of")[0]).alias("best"))
    # One letter more: what is left is a word of its own; a doubled letter gives the same rest at either place.
    longer = taken.filter("owns > 0").select("key", "rest", F.col("n").alias("long_n"), F.col("word").alias("long")).distinct()
    links = longer.join(own, ["key", "rest"])
    best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("word")).alias("best")
    one = F.lit(1).cast("long").alias("n_near")
    added = links.select("word", one, best("long_n", "long")).unionByName(links.select(F.col("long").alias("word"), one, best("n", "word")))
    both = exchanged.unionByName(added).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n_near", F.struct((-F.col("best.less")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: where following ``form`` from each word ends. Chains must not be circular; each round doubles the steps taken."""
    # A round's words: those whose chain goes on from where they have come to.
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.filter("moved").limit(1).count()
        drop_materialized(at)
        at = after.select("word", "root")
        if not moved:
            return at


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``words`` (word, n).

    A word's form is its near word of largest n, if that is at least ``ratio`` times the word's n.
    """
    words = materialize(words, "vocabulary")
    near = words.join(near_words(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    goes = F.col("best.n") >= ratio * F.col("n")
    near = materialize(near.select("word", "n", "n_near", F.when(goes, F.col("best.word")).alias("form"), F.when(goes, F.col("best.n")).alias("form_n")), "near-words")
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
