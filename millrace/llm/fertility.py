"""Quality rules from public tokenisers' fertility, with bands per language or script.

A text that a vocabulary was made for gives few tokens for its characters, no bytes and many different tokens.
Four measures of the whole text are compared with bands of the text's language (its script where the
language is null): characters per token of two vocabularies, and, of the first, the share of byte-fallback tokens and token entropy in bits (among texts of like length).
A band is the middle half of the language's texts, widened
by ``reach`` times its own width below (``reach_up`` above: long and varied tokens are less often a fault; above and not below for bytes) and by the
``sampling`` error of a text of that many tokens (for bytes that of a share, and ``stray`` characters of up to four bytes); quartiles are exact, of values rounded
to a fixed grid, over all texts that pass the base rules. Where a group has under ``least_texts`` such
texts, its texts are held against the next wider one that has them: neighbouring lengths, then the texts of their script, then all texts, whatever their
number; a smaller one's reach grows with its sampling error. A group of ``few_texts`` and more speaks for itself besides: what its own band, widened so, lets pass is kept.

Base rules: under ``least_words`` words, or over a fifth of the words in repeated five-word windows.

Scale: one scan in Arrow batches, one text at a time in memory; quartiles are partial aggregates per group (a language with
a third of all texts is no larger than any other after them; entropies are counted in steps of 1/256 bit first), joined back to narrow rows.

Edge cases: null and empty texts have no words and fail; a text without tokens has null measures; a null language is judged by
script; repeated rows are judged alike; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, hold, materialize

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
REMEMBERED = 300_000
#: First code points of ranges of letters and the script of each range.
RANGES = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]


class Pieces(dict):
    """Ids of words, as little-endian uint16."""

    def __init__(self, path: str, ranks: str | None = None) -> None:
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.second = Counts(ranks) if ranks else None

    def __missing__(self, word: bytes) -> bytes:
        ids = np.array(self.model.encode(word.decode()), "<u2").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Counts(dict):
    """Numbers of tokens of words, a space before each, by a vocabulary of ranked byte strings."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.model = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: bytes) -> int:
        n = len(self.model.encode_ordinary(" " + word.decode()))
        if len(word) <= 64:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def pieces(path: str, ranks: str | None = None) -> Pieces:
    """The vocabularies of a Python worker."""
    return Pieces(path, ranks)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    starts = np.fromiter((w in often for w in windows), bool, len(windows))
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.flatnonzero(starts), 1)
    np.add.at(change, np.flatnonzero(starts) + width, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), "<u4")
    if not len(points):
        return "none"
    at = np.searchsorted([lo for lo, _ in RANGES], points, "right") - 1
    totals = Counter()
    for k, n in Counter(at.tolist()).items():
        totals[RANGES[max(k, 0)][1]] += n
    return min(totals.items(), key=lambda x: (-x[1], x[0]))[0]


def measure(text: str, known: Pieces) -> tuple:
    """Counts and token measures of one text."""
    data = text.encode()
    words = data.split()
    ids = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2")
    chars = len(text) - sum(text.count(c) for c in SPACES)
    base = (len(words), chars, sum(data.count(c) for c in SYMBOLS), repeated_lines(text), repeated_words(words))
    if not len(ids):
        return (*base, 0, None, None, None, None)
    counts = np.bincount(ids)
    counts = counts[counts > 0]
    entropy = math.log2(len(ids)) - float((counts * np.log2(counts)).sum()) / len(ids)
    second = chars / sum(map(known.second.__getitem__, words)) if known.second is not None else None
    return (*base, len(ids), chars / len(ids), float(known.is_byte[ids].mean()), entropy, second)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, second_chars_per_token double"


def measures(docs: DataFrame, path: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, text_hash (of text and language), band (language or script), script and the measures of every row."""
    bound_batches(docs)
    own = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"))
    own = own.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")), "lang"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path, ranks)
        hold(known, *([known.second] if known.second is not None else []))
        for b in batches:
            rows, bands, scripts = [], [], []
            for value, language in zip(b.column(0), b.column(2).to_pylist(), strict=True):
                if len(known) > REMEMBERED:
                    known.clear()
                    if known.second is not None:
                        known.second.clear()
                content = value.as_py() or ""
                rows.append(measure(content, known))
                scripts.append(script(content))
                bands.append(f"lang:{language}" if language is not None else f"script:{scripts[-1]}")
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64()] * 6 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(3), pa.array(bands, pa.string()), pa.array(scripts, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "text_hash", "band", "script", *names])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text_hash long, band string, script string, {SCHEMA}")


def _small(table: DataFrame, most: int) -> DataFrame:
    """The table, broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def judge(docs: DataFrame, path: str, ranks: str | None = None, reach: float = 3.0, reach_up: float = 8.0, sampling: float = 6.0, stray: int = 3, least_texts: int = 100, few_texts: int = 8, least_words: int = 10, repeat_percent: int = 20, most_bands: int = 10_000, **columns: str) -> DataFrame:
    """The measures of every row, base_failed and kept."""
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    m = materialize(measures(docs, path, ranks, **columns).withColumn("base_failed", failed), "fertility")
    # Token entropy grows with a text's length: it is held against the middle of texts of like length (by powers of two).
    m = m.withColumn("length", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"))
    passed = m.filter(~F.col("base_failed") & (F.col("n_tokens") > 0))
    levels = [F.col("band"), F.concat(F.lit("written:"), "script"), F.lit("all")]
    quarters = [0.25, 0.5, 0.75]
    wider = F.greatest(F.lit(1.0), F.sqrt(least_texts / F.col("n")))

    def reached(q: str, least: float) -> tuple[Column, Column]:
        width = F.greatest(F.col(q)[2] - F.col(q)[0], F.lit(least)) * wider
        return F.col(q)[0] - width * reach, F.col(q)[2] + width * reach_up

    def limits(cells: DataFrame, groups: DataFrame, by: list[str], wanted: list[Column], **bounds: Column) -> DataFrame:
        """The cells with the bounds of the first wanted group that has enough texts (or the last), or the cell's own if those are looser."""
        met = cells.select("*", F.posexplode(F.array(*wanted)).alias("at", "g")).select(*cells.columns, "at", "g.*").join(groups, by)
        found = F.struct(*[c.alias(k) for k, c in bounds.items()])
        first = F.max_by(found, F.when(F.col("n") >= least_texts, 1000 - F.col("at")).otherwise(F.col("at"))).alias("first")
        own = F.max_by(found, F.when((F.col("level") == F.col("band")) & (F.col("n") >= few_texts), -F.col("at"))).alias("own")
        looser = [(F.least if k.startswith("lo") else F.greatest)(f"first.{k}", f"own.{k}").alias(k) for k in bounds]
        return _small(materialize(met.groupBy(*cells.columns).agg(first, own).select(*cells.columns, *looser), "bands"), most_bands)

    # Values on a grid: their counts, and so the quartiles, don't depend on how rows are dealt.
    grids = {"c": ("chars_per_token", 256), "d": ("second_chars_per_token", 256), "b": ("byte_share", 4096)}
    values = F.array(*[F.struct(F.lit(k).alias("k"), (F.round(F.col(c) * steps) / steps).alias("v")) for k, (c, steps) in grids.items()])
    counted = passed.select(*levels[:2], F.inline(values)).filter("v is not null").toDF("band", "written", "k", "v").groupBy("band", "written", "k", "v").agg(F.count(F.lit(1)).alias("w"))
    each = materialize(counted, "values").select(F.explode(F.array("band", "written", F.lit("all"))).alias("level"), "k", "v", "w")
    groups = each.groupBy("level", "k").agg(F.sum("w").alias("n"), F.percentile("v", quarters, F.col("w")).alias("q"))
    groups = groups.groupBy("level").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("q"))).alias(k) for k in grids])
    cells = materialize(m.filter("n_tokens > 0").select("band", "script", "length").distinct(), "cells")
    bounds = {f"{side}_{k}": bound for k in "cd" for side, bound in zip(("low", "high"), reached(k, 0.05), strict=True)}
    most = F.col("b")[2] + F.greatest(F.col("b")[2] - F.col("b")[0], F.lit(0.01)) * reach * wider
    bands = limits(cells.select("band", "script").distinct(), groups, ["level"], [F.struct(x.alias("level")) for x in levels], **bounds, high_b=most)

    # Groups of lengths: one power of two (0), with two on either side (2), all (64).
    spots = passed.groupBy("band", "script", "length", (F.round(F.col("entropy") * 256) / 256).alias("entropy")).agg(F.count(F.lit(1)).alias("w"))
    around = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: F.struct(F.lit(2).alias("span"), (F.col("length") + k).alias("center")))
    one, all_ = F.struct(F.lit(0).alias("span"), F.col("length").alias("center")), F.struct(F.lit(64).alias("span"), F.lit(0).alias("center"))
    spots = materialize(spots, "spots").withColumn("level", F.explode(F.array(*levels))).withColumn("s", F.explode(F.concat(F.array(one, all_), around)))
    alike = spots.groupBy("level", "s.span", "s.center").agg(F.sum("w").alias("n"), F.percentile("entropy", quarters, F.col("w")).alias("e"), (F.sum(F.col("w") * F.col("length")) / F.sum("w")).alias("mean"))
    near = [F.struct(x.alias("level"), F.lit(span).alias("span"), (F.col("length") if span < 64 else F.lit(0)).alias("center")) for spans in ((0, 2), (64,)) for x in levels for span in spans]
    low, high = reached("e", 0.1)
    # Twice the tokens have up to one bit more.
    low, high = low - F.greatest(F.col("mean") - F.col("length"), F.lit(0.0)), high + F.greatest(F.col("length") - F.col("mean"), F.lit(0.0))
    lengths = limits(cells, alike, ["level", "span", "center"], near, low_e=low, high_e=high)

    noise = F.lit(sampling) / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))

    def inside(column: str, k: str) -> Column:
        return (F.col(column) >= F.col(f"low_{k}") - noise) & (F.col(column) <= F.col(f"high_{k}") + noise)

    share = F.least(F.col("high_b"), F.lit(1.0))
    bytes_ = share + sampling * F.sqrt(share * (1 - share) / F.col("n_tokens")) + 4 * stray / F.col("n_tokens")
    second = F.col("second_chars_per_token").isNull() | inside("second_chars_per_token", "d")
    within = inside("chars_per_token", "c") & second & (F.col("byte_share") <= bytes_) & inside("entropy", "e")
    verdict = ~F.col("base_failed") & F.coalesce(within, F.lit(True))
    judged = m.join(bands, ["band", "script"], "left").join(lengths, ["band", "script", "length"], "left").withColumn("kept", verdict)
    return judged.select("band", *(c for c in m.columns if c not in ("band", "script", "length")), "kept")
