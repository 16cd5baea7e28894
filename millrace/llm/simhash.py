"""SimHash near-duplicates: 64-bit fingerprints compared in bit-sliced form.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of the
text's word shingles. Equal fingerprints are collapsed first. Fingerprints within the
radius agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so each is dealt to every
choice of that many blocks (15 tables of 20 to 22 bits by default) and compared only with those that agree there.
Within a task the groups' fingerprints are stored as 64 vertical bit planes: at
shift d, 64 pairs (i, i+d) are compared by each word operation, distances are kept in carry-save bit
counters, and a block of 512 pairs is abandoned once all of them exceed the radius.

A task emits no pairs but one link to the least member for each group's own components,
at most one row a member; the components over all tables come from contraction in Spark.
Groups above ``block`` rows are cut into pairs of chunks (hotsplit).

Edge cases: null and empty texts and texts without words have fingerprint 0 and link with each
other and with any other fingerprint within the radius; texts shorter than a shingle are one shingle;
repeated rows share a fingerprint; an empty table gives an empty result. Rows with a null doc_id are kept and
get their group's least non-null doc_id (null if none has one).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, hold, materialize, row_hash
from millrace.llm.components import connected_components, merge_labels
from millrace.llm.hotsplit import pair_blocks

BITS = 64
#: Pairs in a block that is abandoned together.
ABANDON = 512


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text's shingles of ``width`` words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, seed=42)], dtype=np.uint64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    cuts = map(slice, starts[:n].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return _majority(np.fromiter((digest(joined[c], 42) for c in cuts), np.uint64, n))


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    bound_batches(docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fp long")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of row b is bit b of ``fp[i]``."""
    pad = np.zeros(-(-(len(fp)) // 64) * 64 + 64, np.uint64)  # one word more than needed, for shifted reads
    pad[: len(fp)] = fp
    bits = np.unpackbits(pad.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """The planes with bit i+d at place i."""
    word, bit = divmod(d, 64)
    n = planes.shape[1] - 1
    low = np.zeros((planes.shape[0], n), np.uint64)
    part = planes[:, word : word + n]
    low[:, : part.shape[1]] = part
    if bit:
        high = planes[:, word + 1 : word + 1 + n]
        low >>= np.uint64(bit)
        low[:, : high.shape[1]] |= high << np.uint64(64 - bit)
    return low


def within(planes: np.ndarray, d: int, radius: int, wanted: np.ndarray) -> np.ndarray:
    """Packed bits: bit i is set if items i and i+d differ in at most ``radius`` bits.

    ``wanted`` has a bit for each pair to compare. Distances live in bit counters, one word a power of two;
    ``over`` collects the pairs past the counters' range.
    """
    n = planes.shape[1] - 1
    other = _shifted(planes, d)
    live = np.arange(n)
    live = live[wanted != 0]
    result = np.zeros(n, np.uint64)
    depth = (radius + 8).bit_length()
    counters = np.zeros((depth, len(live)), np.uint64)
    over = ~wanted[live]
    for start in range(0, BITS, 8):
        x = planes[start : start + 8, live] ^ other[start : start + 8, live]
        # Carry-save: three planes in, a sum and a carry out, until the eight are one digit of each power of two.
        s0, c0 = _full(x[0], x[1], x[2])
        s1, c1 = _full(x[3], x[4], x[5])
        s2, c2 = _full(s0, s1, x[6])
        ones, c3 = s2 ^ x[7], s2 & x[7]
        t0, f0 = _full(c0, c1, c2)
        twos, f1 = t0 ^ c3, t0 & c3
        fours, eights = f0 ^ f1, f0 & f1
        carry = np.zeros_like(ones)
        for k, digit in enumerate((ones, twos, fours, eights)):
            if k < depth:
                counters[k], carry = _full(counters[k], digit, carry)
            else:
                carry |= digit
        for k in range(4, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        # A counter above the radius: compare from the highest digit.
        above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        over |= above
        if start + 8 < BITS and len(live):
            size = ABANDON // 64
            pad = np.full(-(-len(live) // size) * size, ~np.uint64(0))
            pad[: len(live)] = over
            keep = np.repeat((pad.reshape(-1, size) != ~np.uint64(0)).any(1), size)[: len(live)]
            if not keep.all():
                live, over, counters = live[keep], over[keep], counters[:, keep]
    result[live] = ~over
    return result


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder on words: sum and carry."""
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def link_groups(fp: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the items' components by links within the radius and within their groups.

    Items are ordered by group. Two items are compared if one of them is on the left and the other on the right
    (items of a whole group are on both sides).
    """
    labels = np.arange(len(fp))
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(fp)))
    order = np.argsort(sizes, kind="stable")
    # Groups of like sizes go together, so that the shifts run as far as the groups do.
    at = 0
    while at < len(order):
        top, total, to = max(2 * sizes[order[at]], 8), 0, at
        while to < len(order) and sizes[order[to]] <= top and (total < 1 << 17):
            total += sizes[order[to]]
            to += 1
        picked = order[at:to]
        items = np.repeat(starts[picked] - np.concatenate(([0], np.cumsum(sizes[picked])[:-1])), sizes[picked]) + np.arange(total)
        _link_block(fp[items], group[items], left[items], right[items], radius, labels, items, int(sizes[picked].max()))
        at = to
    return labels


def _link_block(fp, group, left, right, radius, labels, items, longest) -> None:  # noqa: ANN001
    planes = bit_planes(fp)
    n, width = len(fp), planes.shape[1] - 1
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    held = 0
    for d in range(1, longest):
        same = np.zeros(width * 64, bool)
        same[: n - d] = (group[d:] == group[:-d]) & ((left[d:] & right[:-d]) | (left[:-d] & right[d:]))
        wanted = np.packbits(same, bitorder="little").view("<u8")
        close = within(planes, d, radius, wanted)
        hit = np.flatnonzero(close)
        if len(hit):
            where = np.unpackbits(close[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, bit = np.nonzero(where)
            a = hit[row] * 64 + bit
            found_a.append(items[a])
            found_b.append(items[a + d])
            held += len(a)
        if held > 1 << 20:
            merge_labels(labels, np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [], [], 0
    if held:
        merge_labels(labels, np.concatenate(found_a), np.concatenate(found_b))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def link_fingerprints(fps: DataFrame, radius: int = 4, blocks: int = 6, block: int = 4096) -> DataFrame:
    """(a, b) edges that connect the distinct fingerprints (column fp) exactly as all links within the radius do."""
    bounds = block_bounds(blocks)
    keys = []
    for table, chosen in enumerate(combinations(bounds, blocks - radius)):
        key = F.lit(table).cast("long")
        for lo, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND((1 << width) - 1))
        keys.append(key)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    dealt = pair_blocks(dealt, ["k"], F.col("fp"), block)
    n = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(n, "k", "i", "j").sortWithinPartitions("k", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in _with_end(batches):
            table = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if table is None or not table.num_rows:
                continue
            fp, k, chunk, i, j = (table.column(c).to_numpy() for c in ("fp", "k", "chunk", "i", "j"))
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            whole = len(fp) if b is None else int(np.flatnonzero(new)[-1])
            if b is not None and whole < 1 << 16:
                rest = table
                continue
            rest = None if b is None else table.slice(whole)
            if whole:
                group = np.cumsum(new)[:whole]
                labels = link_groups(fp[:whole].view(np.uint64), group, (chunk == i)[:whole], (chunk == j)[:whole], radius)
                linked = np.flatnonzero(labels != np.arange(whole))
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[labels[linked]])], ["a", "b"])

    return dealt.select("fp", "k", "chunk", "i", "j").mapInArrow(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, blocks: int = 6, block: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id reachable by links."""
    prints = materialize(with_fingerprints(docs, doc_id, text, width), "prints")
    unique = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    edges = link_fingerprints(unique.select("fp"), radius, blocks, block)
    parts = connected_components(edges)
    placed = unique.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "component").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, of: DataFrame) -> DataFrame:
    """One row of each component in ``of`` (as :func:`similar_documents` gives it for ``docs``): that of the least doc_id, nulls last, and the least row hash.

    Rows of a null or repeated doc_id with different texts are told apart by their hash; equal rows count once; columns may have any names.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = of.groupBy("component").agg(least.alias("m")).select(F.col("m.row").alias("h"))
    # The join has dealt and sorted the rows by their hash already.
    rows = docs.select(row_hash(docs).alias("h"), F.struct("*").alias("doc"))
    return rows.join(kept, "h").dropDuplicates(["h"]).select("doc.*")


# Similarity of 0.8 and more: wide fingerprints.


def wide_fingerprint(text: str | None, width: int, lanes: int) -> np.ndarray:
    """``lanes`` independent 64-bit SimHashes of a text's shingles: each lane mixes the shingles' XXH64 anew."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.zeros(lanes, np.uint64)
    if not words:
        return out
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    cuts = map(slice, starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[c], 42) for c in cuts), np.uint64, n)
    salt = np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, n, 255):  # sums of 255 rows fit a byte
        x = h[at : at + 255, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(x), 8 * lanes), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def linking_pairs(
    fp: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, wide: np.ndarray | None = None, limit: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of items of a group within the radius in ``fp`` and, if ``wide`` is given, within ``limit`` in it that connect the items as all such pairs do.

    A pair is passed on only if earlier pairs have not connected its items, so their number follows the items', not their square.
    """
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    longest = int(np.diff(np.append(starts, len(fp))).max(initial=0))
    planes, n = bit_planes(fp), len(fp)
    labels = np.arange(n)
    found: list[np.ndarray] = []
    for d in range(1, longest):
        same = np.zeros((planes.shape[1] - 1) * 64, bool)
        same[: n - d] = (group[d:] == group[:-d]) & ((left[d:] & right[:-d]) | (left[:-d] & right[d:])) & (labels[d:] != labels[:-d])
        if not same.any():
            continue
        close = within(planes, d, radius, np.packbits(same, bitorder="little").view("<u8"))
        a = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little"))
        if wide is not None:
            a = a[np.bitwise_count(wide[a] ^ wide[a + d]).sum(1, dtype=np.int64) <= limit]
        if len(a):
            found.append(np.stack([a, a + d]))
            merge_labels(labels, a, a + d)
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def _whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the rows' groups and sides."""
    rest: pa.Table | None = None
    for b in _with_end(batches):
        table = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if table is None or not table.num_rows:
            continue
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([(v := table.column(c).to_numpy())[1:] != v[:-1] for c in by], axis=0)
        whole = len(new) if b is None else int(np.flatnonzero(new)[-1])
        if b is not None and whole < 1 << 16:
            rest = table
            continue
        rest = None if b is None else table.slice(whole)
        if whole:
            chunk, i, j = (table.column(c).to_numpy()[:whole] for c in ("chunk", "i", "j"))
            yield table.slice(0, whole), np.cumsum(new)[:whole], chunk == i, chunk == j


def bands_of(bits: int, count: int, lanes: int) -> list[tuple[int, list[int]]]:
    """(lane, bit places) of ``count`` bands of so many bits, dealt over the lanes: blocks as long as a lane has them, then draws of its bits."""
    rng, out = np.random.default_rng(3), []
    for j in range(count):
        first = j // lanes * bits
        out.append((j % lanes, [*range(first, first + bits)] if first + bits <= BITS else rng.choice(BITS, bits, replace=False).tolist()))
    return out


def similar_documents(
    docs: DataFrame,
    similarity: float = 0.8,
    width: int = 5,
    lanes: int = 16,
    lane_radius: int = 14,
    block: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    missed: float = 0.01,
    band_bits: int | None = None,
) -> DataFrame:
    """(doc_id, row, component, component_id) of every row, linking texts whose shingle sets are about ``similarity`` alike or more.

    Two texts of Jaccard similarity s differ in a share p = acos(2s / (1 + s)) / pi of SimHash bits: 10 of 64 for 0.8, too many for pigeonhole tables,
    and too uncertain for one word. So a text has ``lanes`` words (1024 bits). Texts that agree on any band
    of any lane meet there and are compared bit-sliced in that lane. Bands have 16 bits, and one more for each doubling of the texts beyond some millions, so that
    a band's texts stay few; there are so many bands that two texts of this similarity meet in none with a chance of ``missed``. What is
    connected there, and nothing else, gets all its words and is compared again: pairs within one standard deviation above the expected distance
    on all bits connect texts, and no others do. Texts with equal fingerprints are one from the start.
    ``row`` is the hash of the row's columns, ``component`` a value that only one component has, ``component_id`` its least doc_id (null if none has one).
    """
    spark = docs.sparkSession
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * lanes
    limit = int(bits * p + (bits * p * (1 - p)) ** 0.5)
    bound_batches(docs)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), row_hash(docs).alias("row"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            wide = [wide_fingerprint(t.as_py(), width, lanes) for t in b.column(1)]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(wide).view(np.int64) if wide else [], pa.int64()), lanes).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists], ["doc_id", "row", "wide"])

    prints = materialize(own.mapInArrow(prints_of, f"doc_id {kind}, row long, wide array<long>").withColumn("node", F.xxhash64("wide")), "wide")
    unique = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("wide").alias("wide")), "unique")

    size = band_bits or max(16, unique.count().bit_length() - 8)
    count = int(np.ceil(np.log(missed) / np.log(1 - (1 - p) ** size)))
    chosen = bands_of(size, -(-count // lanes) * lanes, lanes)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        one = np.uint64(1)
        for b in batches:
            wide = b.column(1).flatten().to_numpy().reshape(-1, lanes).view(np.uint64)
            for j, (lane, places) in enumerate(chosen):
                word = np.ascontiguousarray(wide[:, lane])
                if places[-1] - places[0] == size - 1:
                    value = (word >> np.uint64(places[0])) & np.uint64((1 << size) - 1)
                else:
                    value = np.zeros(len(word), np.uint64)
                    for at, place in enumerate(places):
                        value |= ((word >> np.uint64(place)) & one) << np.uint64(at)
                key = value.astype(np.int64) + (j << size)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), pa.array(word.view(np.int64))], ["k", "node", "fp"])

    dealt = pair_blocks(unique.select("node", "wide").mapInArrow(bands, "k long, node long, fp long"), ["k"], F.col("node"), block)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "k", "i", "j").sortWithinPartitions("k", "i", "j", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group, left, right in _whole_groups(batches, ("k", "i", "j")):
            x, y = linking_pairs(table.column("fp").to_numpy().view(np.uint64), group, left, right, lane_radius)
            labels = np.arange(len(group))
            merge_labels(labels, x, y)
            met = np.unique(np.concatenate([x, y]))
            out = table.select(["k", "chunk", "i", "j", "node"]).take(pa.array(met)).combine_chunks()
            yield from out.append_column("c", pa.array(table.column("node").to_numpy()[labels[met]])).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group, left, right in _whole_groups(batches, ("k", "i", "j", "c")):
            wide = table.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
            fp = wide[np.arange(len(group)), (table.column("k").to_numpy() >> size) % lanes]  # the lane of the key's band
            x, y = linking_pairs(fp, group, left, right, lane_radius, wide, limit)
            node = table.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

    met = materialize(dealt.select("fp", "k", "chunk", "i", "j", "node").mapInArrow(meet, "k long, chunk int, i int, j int, node long, c long"), "met")
    met = met.join(unique.select("node", "wide"), "node").repartition(n, "k", "i", "j", "c").sortWithinPartitions("k", "i", "j", "c")
    parts = connected_components(met.select("k", "chunk", "i", "j", "c", "node", "wide").mapInArrow(link, "a long, b long"))
    placed = unique.select("node", "least").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "row", "node").join(placed.join(least, "component").select("node", "component", "component_id"), "node").drop("node")
