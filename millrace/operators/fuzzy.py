"""Joins of texts that are alike by matching blocks, through counts of the substrings that texts share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Texts and characters that a block holds at most (a text beyond that is a block of its own), texts compared at a time, and kinds of substrings told apart.
BLOCK, CHARACTERS, ROWS, KINDS = 4096, 1 << 23, 512, 1024


def _comparer(least: float) -> Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]]:
    """The comparison of two lists of texts for pairs that may have a ratio of ``least``; made here, so that it takes what it needs to executors."""

    def width_for(longest: int) -> int:
        """How long the counted substrings are: the longer the texts, the longer, as far as a tenth of all characters must be in shared ones."""
        wanted = 2 if longest <= 150 else 3 if longest <= 1200 else 4
        return max([w for w in range(1, wanted + 1) if 0.5 - (w - 0.5) * (1 - least) >= 0.1], default=1)

    def counts(texts: list[str], lengths: np.ndarray, width: int) -> np.ndarray:
        """How often each text has each kind of substring; kinds are told apart by a hash, which can only make texts more alike."""
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        places = max(len(letters) - width + 1, 0)
        kind = np.zeros(places, np.uint64)
        for k in range(width):
            kind = kind * np.uint64(1000003) + letters[k : places + k]
        kind = (kind * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KINDS.bit_length() + 1)
        ends = np.cumsum(lengths)
        of = np.repeat(np.arange(len(texts)), lengths)[:places]
        inside = np.arange(places) + width <= ends[of]
        return np.bincount(of[inside] * KINDS + kind[inside].astype(np.int64), minlength=len(texts) * KINDS).reshape(len(texts), KINDS).astype(np.int32)

    def near(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that share as many substrings as a ratio of ``least`` takes.

        If D of N characters of two texts stay unmatched, at most D + 1 blocks are matched and share (N - D) / 2 - (w - 1)(D + 1) substrings of w characters. Shared ones
        are counted for all pairs at once, as products of matrices that say whether a text has a substring once, twice and so on.
        """
        m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        by_m, by_n = np.argsort(m, kind="stable"), np.argsort(n, kind="stable")
        m, n = m[by_m], n[by_n]
        width = width_for(int(max(m[-1], n[-1])))
        x, y = counts([a[k] for k in by_m], m, width), counts([b[k] for k in by_n], n, width)
        share, shrink = 0.5 - (width - 0.5) * (1 - least), least / (2 - least)
        found_a, found_b = [], []
        for at in range(0, len(m), ROWS):
            own = slice(at, at + ROWS)
            most = int(np.searchsorted(n, m[own][-1] / shrink + 1e-6, "right"))
            for start in range(int(np.searchsorted(n, m[at] * shrink - 1e-6)), most, 8 * ROWS):
                other = slice(start, min(start + 8 * ROWS, most))
                both = np.minimum(x[own].max(0), y[other].max(0))
                shared = np.zeros((len(m[own]), len(n[other])), np.float32)
                for times in range(1, int(both.max()) + 1):
                    kinds = np.flatnonzero(both >= times)
                    shared += (x[own][:, kinds] >= times).astype(np.float32) @ (y[other][:, kinds] >= times).astype(np.float32).T
                shared -= (share * m[own]).astype(np.float32)[:, None]
                shared -= (share * n[other]).astype(np.float32)[None, :]
                i, j = np.nonzero(shared >= 1 - width - 0.01 - 1e-6 * m[own][-1])
                found_a.append(by_m[at + i])
                found_b.append(by_n[start + j])
        return np.concatenate(found_a or [by_m[:0]]), np.concatenate(found_b or [by_n[:0]])

    return near


def _matcher() -> Callable[[str, str], int]:
    """How many characters the matching blocks of two texts hold, as :func:`millrace.functions.fuzzy.matched_characters` counts them, for texts of any length."""
    small = 1 << 18  # characters of one text times those of the other that the library's matcher gets

    def plain(a: str, b: str) -> int:
        return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())

    def matched(a: str, b: str) -> int:
        if len(a) * len(b) <= small:
            return plain(a, b)
        # the first text, a character that neither has, and the second; ranks[k] numbers the substrings of 2^k characters, so that two numbers tell any longer one
        letters = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for x in (a, b)]
        ranks, base = [np.unique(np.concatenate([letters[0], [-1], letters[1]]), return_inverse=True)[1].astype(np.int64)], len(a) + 1
        while 2 ** len(ranks) <= min(len(a), len(b)):
            half = 2 ** (len(ranks) - 1)
            ranks.append(np.unique(ranks[-1][:-half] * (len(ranks[-1]) + 1) + ranks[-1][half:], return_inverse=True)[1].astype(np.int64))

        def numbers(n: int, start: int, end: int) -> np.ndarray:
            k = n.bit_length() - 1
            own, more = ranks[k], n - 2**k
            return own[start : end - n + 1] * (len(own) + 1) + own[start + more : end - n + 1 + more]

        total, open_ = 0, [(0, len(a), 0, len(b))]
        while open_:
            i, i_end, j, j_end = open_.pop()
            if (i_end - i) * (j_end - j) <= small:
                total += plain(a[i:i_end], b[j:j_end])
                continue
            least, most = 0, min(i_end - i, j_end - j)
            while least < most:  # if a substring of some length is common, so is one of each lesser length
                n = (least + most + 1) // 2
                if len(np.intersect1d(numbers(n, i, i_end), numbers(n, base + j, base + j_end))):
                    least = n
                else:
                    most = n - 1
            if least:
                x, y = numbers(least, i, i_end), numbers(least, base + j, base + j_end)
                at = int(np.argmax(np.isin(x, y)))
                other = int(np.argmax(y == x[at]))
                total += least
                open_ += [(i, i + at, j, j + other), (i + at + least, i_end, j + other + least, j_end)]
        return total

    return matched


def _on(keys: list[str], x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in keys]


def candidates(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, a, b): pairs of different texts of equal keys that include all with a ratio of ``least`` or more (over 2/3).

    ``left`` and ``right`` have the keys and ``text``, each row once. Texts go to bands by length, so wide that only texts of one band or of neighbours can reach the
    ratio, and bands to blocks of bounded size. Each pair of blocks that may hold pairs is compared in one task, in memory, by how many substrings
    texts share; only pairs that pass leave the task, and go on if so many edits make one text the other. The comparing is quadratic in the texts of like length, with
    a product of matrices for each pair of blocks; what is shuffled is a text for each block that it meets.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be over 2/3")
    step = 1.001 * max(math.log(2 / least - 1), 0.1)  # the longest partner's length over a text's own, as a logarithm
    sides = left.select(*keys, "text", F.lit(True).alias("_l")).unionByName(right.select(*keys, "text", F.lit(False).alias("_l")))
    both = sides.filter("text <> ''").groupBy(*keys, "text").agg(F.max("_l").alias("_l"), F.max(~F.col("_l")).alias("_r"))
    both = both.withColumn("_band", F.floor(F.log(F.char_length("text")) / step).cast("int"))
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), CHARACTERS / F.exp((F.col("_band") + 1) * step)))  # texts in a block
    blocks = lambda side: F.ceil(F.count_if(side) / room).cast("int")
    sizes = both.groupBy(*keys, "_band").agg(blocks(F.col("_l")).alias("_ls"), blocks(F.col("_r")).alias("_rs"))
    near = sizes.withColumn("_to", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)))
    # for each band, the number of its own blocks on one side and of the blocks of each near band on the other
    cells = lambda own, other: near.alias("s").join(sizes.alias("o"), [*_on(keys, "s", "o"), F.col("s._to") == F.col("o._band")]).select(*[f"s.{k}" for k in keys], "s._band", "s._to", F.col(f"s.{own}").alias("_own"), F.col(f"o.{other}").alias("_others")).filter("_own > 0 and _others > 0")

    def dealt(mark: str, own: str, other: str, is_left: bool) -> DataFrame:
        met = both.filter(mark).alias("t").join(cells(own, other).alias("c"), [*_on(keys, "t", "c"), F.col("t._band") == F.col("c._band")])
        block, others = F.pmod(F.xxhash64("t.text"), F.col("c._own")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("c._others") - 1))
        rows = met.select(*[f"t.{k}" for k in keys], F.col("t._band").alias("_i"), F.col("c._to").alias("_j"), block.alias("_x"), others.alias("_y"), F.lit(is_left).alias("_l"), "t.text")
        return rows if is_left else rows.select(*keys, F.col("_j").alias("_i"), F.col("_i").alias("_j"), F.col("_y").alias("_x"), F.col("_x").alias("_y"), "_l", "text")

    compare = _comparer(least)

    def compared(rows: pa.Table) -> pa.Table:
        own = rows.column("_l")
        a, b = rows.filter(own), rows.filter(pc.invert(own))
        texts = [x.column("text").to_pylist() for x in (a, b)]
        i, j = compare(*texts) if all(texts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.table([a.column(k).take(pa.array(i)) for k in keys] + [a.column("text").take(pa.array(i)), b.column("text").take(pa.array(j))], names=[*keys, "a", "b"])

    rows = dealt("_l", "_ls", "_rs", True).unionByName(dealt("_r", "_rs", "_ls", False))
    kinds = [left.schema[k] for k in keys] + [StructField("a", StringType()), StructField("b", StringType())]
    cell = [*keys, "_i", "_j", "_x", "_y"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes are much work
    met = rows.repartition(tasks, *cell).groupBy(*cell).applyInArrow(compared, StructType(kinds)).filter("a <> b")
    edits = f"levenshtein(a, b, cast(floor({1 - least} * (char_length(a) + char_length(b)) + 1e-9) as int))"
    return met.filter(F.expr(edits) >= 0)


def similar_texts(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, a, b, ratio): all pairs of different texts of equal keys, one of each side, with a ratio of ``least`` or more."""
    pairs, matched_characters = candidates(left, right, keys, least), _matcher()

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([2.0 * matched_characters(a, b) / (len(a) + len(b)) for a, b in both], pa.float64())], [*rows.schema.names, "ratio"])

    return pairs.mapInArrow(ratios, StructType([*pairs.schema.fields, StructField("ratio", DoubleType())])).filter(F.col("ratio") >= least)


def matched(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """(keys, text, match, how, ratio): each text of ``left`` with an equal one of ``right``, else with the most alike (then first in order) of ``least`` or more.

    Texts without a match are absent.
    """
    l, r = left.select(*keys, "text").distinct(), right.select(*keys, "text").distinct()
    same = [*_on(keys, "l", "r"), F.col("l.text") == F.col("r.text")]
    exact = l.alias("l").join(r.alias("r"), same, "left_semi").select(*keys, "text", F.col("text").alias("match"), F.lit("exact").alias("how"), F.lit(1.0).alias("ratio"))
    rest = l.alias("l").join(r.alias("r"), same, "left_anti").select(*keys, "text")
    best = similar_texts(rest, r, keys, least).groupBy(*keys, "a").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "b")).alias("m"))
    return exact.unionByName(best.select(*keys, F.col("a").alias("text"), F.col("m.b").alias("match"), F.lit("fuzzy").alias("how"), (-F.col("m.less")).alias("ratio")))


def mutual(left: DataFrame, right: DataFrame, keys: list[str], least: float) -> DataFrame:
    """(keys, a, b, ratio): texts that one side lacks, paired with such texts of the other if each is the other's only likely partner."""
    l, r = left.select(*keys, "text").distinct(), right.select(*keys, "text").distinct()
    lacks = lambda x, y: x.alias("x").join(y.alias("y"), [*_on(keys, "x", "y"), F.col("x.text") == F.col("y.text")], "left_anti").select(*keys, "text")
    pairs = similar_texts(lacks(l, r), lacks(r, l), keys, least)
    alone = lambda side: F.count(F.lit(1)).over(Window.partitionBy(*keys, side))
    return pairs.withColumns({"_a": alone("a"), "_b": alone("b")}).filter("_a = 1 and _b = 1").drop("_a", "_b")
