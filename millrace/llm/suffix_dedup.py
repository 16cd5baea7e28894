"""Removing long byte strings that occur more than once: a sparse suffix array with hash comparisons.

A string of ``least`` bytes contains, wherever it occurs, the same *anchor*: the first position of
the least hash of ``gram`` bytes among its first ``least - gram + 1`` positions. So only anchors need to be
sorted, about one in (least - gram) / 2 bytes, and two equal strings meet in the group of their anchor's gram hash. An anchor's
*context* is what the strings with this anchor cover together: ``least`` bytes and, on average, (least - gram) / 2 more. Strings that start before or after
them have other anchors and meet there. A repeated string covers l bytes left and r bytes right of its anchor with l + r >= least.

1. One scan hashes every text by prefix polynomials modulo 2**64 (any substring's hash in two
   reads), finds the anchors and digests their contexts' bytes (BLAKE2b: texts made to collide under polynomials don't). Only hashes and digests are shuffled. Equal
   contexts are one from here on, however often they occur; a context that occurs twice is removed whole.
2. For the anchors in groups of two or more different contexts, one context of each kind is cut from the texts.
3. In each group, contexts are sorted by what follows the anchor and by what precedes it: a merge sort in numpy, all groups of a
   batch at once, whose comparisons find the common extension of two contexts by binary search on prefix hashes
   (nine steps for 400 bytes) and then compare one byte. The common extensions of neighbours in the sorted
   order are verified against the bytes themselves. Runs of neighbours give, for every split (l, r), the contexts that agree on both sides; a
   split can only change where an extension ends, so only those are tried.
4. The ranges found are joined back to the anchors and united for each document.

Groups of more than ``block`` different contexts are divided, exactly, before step 3. With d = :func:`step_of` (``least``, ``gram``), two contexts with
l + r >= least agree, for some k, on the window from d * k bytes left of the anchor to least - d - d * k bytes right of it. So each context goes
to a group for each k by that window's 128-bit digest, with only the d bytes on each side of the window as its new context, and d as
the new least length; equal new contexts are one again. A divided group above ``block`` is divided in turn, by windows of 3 d / 4 bytes, and so on:
differences far from a window no longer tell its contexts apart, so that ever fewer are left. What is above ``block`` once ``TINY`` bytes or
less are left to agree on is decided by the digests of all windows of that length (:func:`split_windows`).

Edge cases: null texts are empty and lose nothing; texts under ``least`` bytes lose nothing; runs of one byte make every position
an anchor with equal contexts, which are one; repeated rows (also of one doc_id) are separate texts; doc_ids may be null; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, drop_materialized, hold, materialize

LEAST = 400
GRAM = 64
#: Bytes hashed at a time; positions in a segment take as many low bits of a window's key.
SEGMENT_BITS = 20
#: Groups are divided down to so many bytes; below, a context has few windows.
TINY = 8
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def step_of(least: int, gram: int) -> int:
    """How far apart the windows lie by which large groups are divided: a quarter of what an anchor can move in ``least`` bytes."""
    return max(1, (least - gram) // 4)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        both.append(np.cumprod(p, dtype=U))
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def digest(*parts: bytes, size: int = 8) -> bytes:
    """A digest of the parts and of where they border."""
    h = hashlib.blake2b(len(parts[0]).to_bytes(4, "little"), digest_size=size)
    for part in parts:
        h.update(part)
    return h.digest()


def as_longs(digests: list[bytes]) -> np.ndarray:
    """Digests of eight bytes or a multiple as rows of signed integers."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(len(digests), -1)


class Hashes:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, x: np.ndarray, base: int = BASE) -> None:
        power, self.inverse = _powers(base, (1 << SEGMENT_BITS) + 1)
        self.prefix = np.zeros(len(x) + 1, U)
        np.cumsum((x.astype(U) + U(1)) * power[: len(x)], out=self.prefix[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [lo, hi)."""
        return (self.prefix[hi] - self.prefix[lo]) * self.inverse[lo]

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all substrings of one width."""
        n = len(self.prefix) - width
        return (self.prefix[width:] - self.prefix[:-width]) * self.inverse[:n]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    n = len(v)
    pad = np.full(-(-n // w) * w, ~U(0))
    pad[:n] = v
    blocks = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def find_anchors(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of the texts [starts, ends) of a segment: (text, position, gram hash, context digest, context's bytes left, right)."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U, np.int32, np.int32))
    if len(x) < least:
        return none
    w = least - gram + 1
    hashes = Hashes(x)
    g = mix(hashes.grams(gram))
    key = (g >> U(SEGMENT_BITS) << U(SEGMENT_BITS)) | np.arange(len(g), dtype=U)
    lowest = sliding_min(key, w)
    inside = np.zeros(len(x) + 1, np.int64)
    full = ends - starts >= least
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - least + 1, -1)
    begin = np.flatnonzero(np.cumsum(inside)[: len(lowest)] > 0)
    if not len(begin):
        return none
    at = (lowest[begin] & U((1 << SEGMENT_BITS) - 1)).astype(np.int64)
    # The strings of one anchor begin at consecutive places.
    change = np.flatnonzero(at[1:] != at[:-1])
    first, last = begin[np.append(0, change + 1)], begin[np.append(change, len(at) - 1)]
    at = at[np.append(0, change + 1)]
    text = np.searchsorted(starts, at, "right") - 1
    left, right = at - first, last + least - at
    data = memoryview(np.ascontiguousarray(x))
    digests = [digest(data[p - a : p], data[p : p + b]) for p, a, b in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)]
    return text, at, g[at], as_longs(digests)[:, 0].view(U), left.astype(np.int32), right.astype(np.int32)


def text_anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position in it, gram hash, context digest, context's bytes left, right) for texts in one buffer, a segment at a time."""
    size, n, k = 1 << SEGMENT_BITS, len(offsets) - 1, 0
    while k < n:
        to = int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1
        if to > k:
            to = min(to, n)
            lo, hi = int(offsets[k]), int(offsets[to])
            keep = offsets[k + 1 : to + 1] > offsets[k:to]
            rows = np.flatnonzero(keep) + k
            text, at, *more = find_anchors(data[lo:hi], offsets[rows] - lo, offsets[rows + 1] - lo, least, gram)
            yield rows[text], at + lo - offsets[rows[text]], *more
            k = to
            continue
        # A text longer than a segment: pieces that overlap by what an anchor and its context need.
        lo, hi = int(offsets[k]), int(offsets[k + 1])
        margin, step = least, size - 3 * least
        for begin in range(0, hi - lo, step):
            a, b = max(0, begin - margin), min(hi - lo, begin + step + 2 * margin)
            _, at, *more = find_anchors(data[lo + a : lo + b], np.array([0]), np.array([b - a]), least, gram)
            own = (at + a >= begin) & (at + a < begin + step)
            yield np.full(int(own.sum()), k), at[own] + a, *(m[own] for m in more)
        k += 1


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


class Contexts:
    """Contexts of one batch of groups: bytes left (read backwards) and right of the anchors, with prefix hashes."""

    def __init__(self, sides: list[bytes], width: int) -> None:
        self.size = np.fromiter(map(len, sides), np.int64, len(sides))
        self.x = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in sides), np.uint8).reshape(len(sides), width)
        power, _ = _powers(BASE, (1 << SEGMENT_BITS) + 1)
        self.prefix = np.zeros((len(sides), width + 1), U)
        np.cumsum((self.x.astype(U) + U(1)) * power[:width], axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common extension of contexts a[i] and b[i], by binary search on prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether context a[i] comes before b[i]; ``ties`` says it of equal ones."""
        n = self.common(a, b)
        ended_a, ended_b = n == self.size[a], n == self.size[b]
        last = self.x.shape[1] - 1
        less = self.x[a, np.minimum(n, last)] < self.x[b, np.minimum(n, last)]
        return np.where(ended_a & ended_b, ties, np.where(ended_a, True, np.where(ended_b, False, less)))

    def merge_sort(self, group: np.ndarray) -> np.ndarray:
        """An order of all contexts by group, then content. All runs of a length are merged at once."""
        n = len(group)
        order = np.arange(n)
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(start, n))
        first, size = np.repeat(start, sizes), np.repeat(sizes, sizes)
        run = 1
        while run < sizes.max(initial=0):
            here = np.flatnonzero(size > run)
            within = here - first[here]
            mate = (within // run) ^ 1
            lo0 = first[here] + mate * run
            end = first[here] + size[here]
            some = lo0 < end
            here, within, mate, lo0, end = here[some], within[some], mate[some], lo0[some], end[some]
            lo, hi = lo0.copy(), np.minimum(lo0 + run, end)
            me, leads = order[here], mate % 2 == 1
            for _ in range(run.bit_length()):
                open_ = lo < hi
                mid = np.minimum((lo + hi) >> 1, n - 1)
                goes = self.before(order[mid], me, ~leads) & open_
                lo, hi = np.where(goes, mid + 1, lo), np.where(goes | ~open_, hi, mid)
            pair = first[here] + (within // (2 * run)) * (2 * run)
            merged = order.copy()
            merged[pair + within % run + (lo - lo0)] = me
            order = merged
            run *= 2
        return order

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order and the common extension of each context with the one before it (-1: another group)."""
        order = self.merge_sort(group)
        shared = np.full(len(order), -1)
        near = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
        a, b = order[near - 1], order[near]
        shared[near] = self.common(a, b)
        # Verification: the bytes must agree as far as the hashes do, and no further.
        for at in range(0, len(near), 8192):
            p, q, n = a[at : at + 8192], b[at : at + 8192], shared[near[at : at + 8192]]
            differ = self.x[p] != self.x[q]
            differ[np.arange(self.x.shape[1]) >= np.minimum(self.size[p], self.size[q])[:, None]] = True
            true = np.where(differ.any(1), differ.argmax(1), self.x.shape[1])
            if (true != n).any():
                return self._by_bytes(group)
        return order, shared

    def _by_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the bytes alone, after a hash collision."""
        content = [bytes(self.x[k, : self.size[k]]) for k in range(len(group))]
        order = np.array(sorted(range(len(group)), key=lambda k: (group[k], content[k])))
        shared = np.full(len(order), -1)
        for k in range(1, len(order)):
            p, q = order[k - 1], order[k]
            if group[p] == group[q]:
                n = int(min(self.size[p], self.size[q]))
                differ = self.x[p, :n] != self.x[q, :n]
                shared[k] = int(differ.argmax()) if differ.any() else n
        return order, shared


def _farthest(group: np.ndarray, order: np.ndarray, shared: np.ndarray, other_order: np.ndarray, other_shared: np.ndarray, least: int) -> np.ndarray:
    """For each context, the longest extension on this side of a repeated string of ``least`` bytes or more; -1 if none.

    Such an extension is one of the group's common extensions of neighbours. They are tried for all groups
    at once, each group's longest first: contexts in one run of neighbours on this side and in one on the other, with two members or more.
    """
    n = len(group)
    best = np.full(n, -1)
    # Each group's distinct extensions, from the longest.
    g, s = group[order], shared
    tried = np.unique(np.stack([g[s >= 0], -s[s >= 0]], 1), axis=0) if (s >= 0).any() else np.zeros((0, 2), np.int64)
    nth = np.arange(len(tried)) - np.searchsorted(tried[:, 0], tried[:, 0])
    bounds = np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[bounds], np.arange(int(nth.max(initial=-1)) + 2))
    value = np.full(int(group.max(initial=0)) + 1, -1)
    alive = np.ones(n, bool)  # groups come in order, so those with more extensions to try stay in place
    for k in range(len(cuts) - 1):
        row = tried[bounds[cuts[k] : cuts[k + 1]]]
        value[:] = -1
        value[row[:, 0]] = -row[:, 1]
        alive = value[group] >= 0
        mine, its = order[alive[order]], other_order[alive[other_order]]
        run, other = np.zeros(n, np.int64), np.zeros(n, np.int64)
        run[mine] = np.cumsum(shared[alive[order]] < value[group[mine]])
        other[its] = np.cumsum(other_shared[alive[other_order]] < least - value[group[its]])
        pair = run[mine] * (n + 1) + other[mine]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        twice = np.zeros(len(mine), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        hit = mine[twice]
        best[hit] = np.maximum(best[hit], value[group[hit]])
    return best


def repeated_extents(group: np.ndarray, left: list[bytes], right: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated strings through each context's anchor reach to the left and to the right (-1: there is none)."""
    backward, forward = (Contexts(side, max(1, *map(len, side))) for side in ([s[::-1] for s in left], right))
    lo, ls = backward.sorted(group)
    ro, rs = forward.sorted(group)
    return _farthest(group, lo, ls, ro, rs, least), _farthest(group, ro, rs, lo, ls, least)


def _keep_possible(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, count: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key may be among the keys, and rows whose key is not, by a bit map of bounded size.

    16 bits a key, 2**26 (8 MB) at most: beyond that the map only lets more rows pass.
    """
    bits = min(26, max(15, (16 * max(count, 1)).bit_length()))

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(1 << bits)) + 1

    maps = keys.select(place(keys_key).alias("_p")).select(F.bitmap_bucket_number("_p").alias("_bucket"), F.bitmap_bit_position("_p").alias("_bit"))
    maps = F.broadcast(maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map")))  # at most 8 MB
    byte = "cast(conv(hex(substring(_map, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)), 16, 10) as int)"
    seen = F.coalesce(F.expr(f"getbit({byte}, cast(bitmap_bit_position(_p) % 8 as int)) = 1"), F.lit(False))
    placed = df.withColumn("_p", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(maps, "_bucket", "left").withColumn("_seen", seen)
    drop = ("_p", "_bucket", "_map", "_seen")
    return placed.filter("_seen").drop(*drop), placed.filter("not _seen").drop(*drop)


#: Columns that name a group of contexts: the anchor's hash and, in divided groups, the shared window's.
GROUP = ["kh", "w1", "w2"]


def _groups_of(batches: Iterator[pa.RecordBatch], about: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by group."""
    rest: pa.Table | None = None
    for b in _ended(batches):
        table = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if table is None or not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in GROUP]
        new = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
        whole = table.num_rows if b is None else int(new[-1])
        rest = None if b is None else table.slice(whole)
        at = 0
        while at < whole:
            cut = int(np.searchsorted(new, at + about, "left"))
            to = min(int(new[cut]) if cut < len(new) else table.num_rows, whole)
            if to - at > about and cut > 0 and int(new[cut - 1]) > at:
                to = int(new[cut - 1])
            yield table.slice(at, to - at)
            at = to


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def compare_groups(contexts: DataFrame, least: int) -> DataFrame:
    """(kh, w1, w2, ck, l, r) of contexts with a partner in their group; step 3. ``contexts`` has one row a kind (group and ck)."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches):
            keys = [table.column(c).to_numpy() for c in (*GROUP, "ck")]
            differ = [k[1:] != k[:-1] for k in keys[:3]]
            group = np.cumsum(np.concatenate(([False], np.any(differ, axis=0))))
            l, r = repeated_extents(group, table.column("left").to_pylist(), table.column("right").to_pylist(), least)
            hit = np.flatnonzero(l >= 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*(k[hit] for k in keys), l[hit], r[hit])], [*GROUP, "ck", "l", "r"])

    dealt = contexts.select(*GROUP, "ck", "left", "right").repartition(n, *GROUP).sortWithinPartitions(*GROUP, "ck")
    return dealt.mapInArrow(run, "kh long, w1 long, w2 long, ck long, l long, r long")


def split_windows(contexts: DataFrame, least: int) -> DataFrame:
    """(kh, w1, w2, ck, l, r) of contexts with a partner, by the hashes of all their windows of ``least`` bytes; for very large groups.

    A window that two different contexts of a group hold at the same split is repeated. Windows are told apart by 128-bit digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kh, w1, w2, ck, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = left + right
                lo = np.arange(max(0, len(data) - least + 1))
                lo = lo[lo <= len(left)]
                if len(lo):
                    h, h2 = as_longs([digest(data[k : k + least], size=16) for k in lo.tolist()]).T
                    fixed = [pa.array(np.full(len(lo), v)) for v in (kh, w1, w2, ck)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(len(left) - lo), pa.array(h), pa.array(h2)], [*GROUP, "ck", "l", "h", "h2"])

    windows = contexts.select(*GROUP, "ck", "left", "right").mapInArrow(run, "kh long, w1 long, w2 long, ck long, l long, h long, h2 long")
    often = windows.groupBy(*GROUP, "l", "h", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = windows.join(often, [*GROUP, "l", "h", "h2"])
    return met.groupBy(*GROUP, "ck").agg(F.max("l").alias("l"), F.max(F.lit(least) - F.col("l")).alias("r"))


def divide_groups(contexts: DataFrame, least: int, step: int, block: int) -> DataFrame:
    """(kh, w1, w2, ck, l, r) as from :func:`compare_groups`, for large groups: by shared windows of ``least - step`` bytes.

    Contexts have at most ``least`` bytes on each side.
    """
    shared = least - step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for kh, u1, u2, ck, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, group = left + right, struct.pack("<qq", u1, u2)
                back = np.arange(0, len(left) + 1, step)
                lo = len(left) - back
                lo, back = lo[lo + shared <= len(data)], back[lo + shared <= len(data)]
                if not len(lo):
                    continue
                # The group and the split belong to the window's name: windows of different ones don't meet.
                for at, k in zip(lo.tolist(), back.tolist(), strict=True):
                    side = data[max(0, at - step) : at], data[at + shared : at + shared + step]
                    (w1, w2), (own,) = (as_longs([d])[0].tolist() for d in (digest(k.to_bytes(4, "little") + group, data[at : at + shared], size=16), digest(*side)))
                    out.append((kh, w1, w2, u1, u2, ck, own, k, *side))
            for at in range(0, len(out), 8192):
                types = [pa.int64()] * 8 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 8192], strict=True), types, strict=True)], [*GROUP, "u1", "u2", "of", "ck", "back", "left", "right"])

    parts = materialize(contexts.select(*GROUP, "ck", "left", "right").mapInArrow(run, "kh long, w1 long, w2 long, u1 long, u2 long, of long, ck long, back long, left binary, right binary"), "divided")
    kinds = parts.groupBy(*GROUP, "ck").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    kinds = materialize(kinds, "divided-kinds")
    sizes = kinds.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("kinds"))
    sized = kinds.join(sizes, GROUP)
    equal = kinds.filter((F.col("n") > 1) & (F.octet_length("left") + F.octet_length("right") >= step))
    found = equal.select(*GROUP, "ck", F.octet_length("left").cast("long").alias("l"), F.octet_length("right").cast("long").alias("r"))
    found = found.union(compare_groups(sized.filter(F.col("kinds").between(2, block)), step))
    large = sized.filter(F.col("kinds") > block)
    if step <= TINY:
        found = found.union(split_windows(large, step))
    elif large.limit(1).count():
        found = found.union(divide_groups(large, step, step_of(step, 0), block))
    best = found.groupBy(*GROUP, "ck").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    met = parts.select(*GROUP, "u1", "u2", "of", "ck", "back").join(best, [*GROUP, "ck"])
    return met.select("kh", F.col("u1").alias("w1"), F.col("u2").alias("w2"), F.col("of").alias("ck"), (F.col("back") + F.col("l")).alias("l"), (F.lit(shared) - F.col("back") + F.col("r")).alias("r"))


def repeated_ranges(docs: DataFrame, text: str = "text", least: int = LEAST, gram: int = GRAM, block: int = 1024) -> DataFrame:
    """(rid, size, ranges): for texts that hold repeated strings, the byte ranges that these cover.

    A text is known by ``rid``, its XXH64, and ``size``, its number of bytes. Ranges may overlap. ``gram`` is at most ``least``.
    """
    if not 0 < gram <= least:
        raise ValueError("gram must be between 1 and least")
    bound_batches(docs)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(body.alias("text")).select("text", F.xxhash64("text").alias("rid"), F.octet_length("text").cast("long").alias("size"))
    long_ = texts.filter(F.col("size") >= least)

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            data, offsets = _buffer(b.column(0))
            rid, size = b.column(1).to_numpy(), b.column(2).to_numpy()
            for row, at, g, c, left, right in text_anchors(data, offsets, least, gram):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (g.view(np.int64), c.view(np.int64), rid[row], size[row], at, left, right)], ["kh", "ck", "rid", "size", "pos", "left", "right"])

    anchors = materialize(long_.mapInArrow(anchors_of, "kh long, ck long, rid long, size long, pos long, left int, right int"), "anchors")
    kinds = anchors.groupBy("kh", "ck").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "size", "pos", "left", "right")).alias("one"))
    groups = kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"))
    # Equal contexts are a repeated string; different ones of a group have to be compared.
    kept = kinds.join(groups.filter("kinds > 1 or most > 1"), "kh").select("kh", "ck", "n", "kinds", "one.*")
    kept = materialize(kept, "kinds")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for value, cuts in zip(b.column(0), b.column(1), strict=True):
                data = value.as_buffer() if hasattr(value, "as_buffer") else value.as_py().encode()
                view = memoryview(data)
                for c in cuts.as_py():
                    p = c["pos"]
                    rows.append((c["kh"], c["ck"], bytes(view[p - c["left"] : p]), bytes(view[p : p + c["right"]])))
                if len(rows) > 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["kh", "ck", "left", "right"])

    def contexts_of(rows: DataFrame) -> DataFrame:
        """The contexts' bytes, cut from the texts that hold them."""
        wanted = rows.groupBy("rid", "size").agg(F.collect_list(F.struct("kh", "ck", "pos", "left", "right")).alias("cut"))  # bounded by the text
        wanted = materialize(wanted, "wanted")
        possible, _ = _keep_possible(long_, F.col("rid"), wanted, F.col("rid"), wanted.count())
        # One row a text, combined in the map stage: copies would bring the same contexts, all to one group.
        single = possible.groupBy("rid", "size").agg(F.first("text").alias("text"))
        cuts = single.join(wanted, ["rid", "size"]).select("text", "cut").mapInArrow(cut, "kh long, ck long, left binary, right binary")
        return cuts.withColumns({"w1": F.lit(0).cast("long"), "w2": F.lit(0).cast("long")})

    found = compare_groups(contexts_of(kept.filter(F.col("kinds").between(2, block))), least)
    if kept.filter(F.col("kinds") > block).limit(1).count():
        found = found.union(divide_groups(contexts_of(kept.filter(F.col("kinds") > block)), least, step_of(least, gram), block))
    found = found.select("kh", "ck", "l", "r")
    equal = kept.filter("n > 1").select("kh", "ck", F.col("left").cast("long").alias("l"), F.col("right").cast("long").alias("r"))
    extents = materialize(found.union(equal).groupBy("kh", "ck").agg(F.max("l").alias("l"), F.max("r").alias("r")), "extents")
    near, _ = _keep_possible(anchors, F.col("kh"), extents, F.col("kh"), extents.count())
    met = near.join(extents, ["kh", "ck"])
    lo, hi = (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi")
    ranges = met.groupBy("rid", "size").agg(F.collect_set(F.struct(lo, hi)).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    drop_materialized(anchors, kept, extents)
    return ranges


def united(ranges: list[dict]) -> list[tuple[int, int]]:
    """Ranges as maximal runs."""
    out: list[list[int]] = []
    for r in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return [(lo, hi) for lo, hi in out]


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = repeated_ranges(own, **options)
    own = own.withColumn("rid", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))
    possible, clean = _keep_possible(own, F.col("rid"), ranges, F.col("rid"), ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], []]
            for value, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, runs, sha, at = value.encode(), united(found or []), hashlib.sha256(), 0
                for lo, hi in runs:
                    sha.update(data[at:lo])
                    at = hi
                sha.update(data[at:])
                for c, v in zip(columns, (sum(hi - lo for lo, hi in runs), len(runs), sha.hexdigest()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = own.schema["doc_id"].dataType.simpleString()
    hit = possible.join(ranges, ["rid", "size"], "left").select("doc_id", "text", "ranges", "size")
    hit = hit.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    rest = clean.select("doc_id", F.col("size").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return hit.union(rest)


def strip_repeats(docs: DataFrame, text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """The rows with repeated strings taken out of their texts; a character that is only partly covered stays whole.

    Null texts stay null; repeated rows and rows of one doc_id are texts of their own; other columns pass through, whatever their names.
    """
    ranges = repeated_ranges(docs.select(text), text, **options)
    own = docs.select(F.struct("*").alias("doc")).withColumn("body", F.coalesce(F.col("doc")[text].cast("string"), F.lit("")))
    own = own.withColumn("rid", F.xxhash64("body")).withColumn("size", F.octet_length("body").cast("long"))
    possible, clean = _keep_possible(own, F.col("rid"), ranges, F.col("rid"), ranges.count())

    @F.pandas_udf("string")
    def kept(body, ranges):  # noqa: ANN001, ANN202
        out = []
        for value, found in zip(body, ranges, strict=True):
            data, at, parts = value.encode(), 0, []
            for lo, hi in united([{"lo": r["lo"], "hi": r["hi"]} for r in found] if found is not None else []):
                while lo < hi and data[lo] & 0xC0 == 0x80:  # inside a character: it stays
                    lo += 1
                while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
                    hi -= 1
                parts.append(data[at:lo])
                at = hi
            parts.append(data[at:])
            out.append(b"".join(parts).decode())
        return body.__class__(out, dtype=object)

    hit = possible.join(ranges, ["rid", "size"], "left").withColumn("new", F.when(F.col("ranges").isNotNull(), kept("body", "ranges")))
    named = [F.coalesce("new", F.col("doc")[c]).alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns]
    return hit.select(*named).union(clean.select("doc.*"))
