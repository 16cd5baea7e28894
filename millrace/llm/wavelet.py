"""Token shards as wavelet matrices: one compressed file a shard, read by rank and select.

A shard holds the token ids of consecutive documents (each ended by ``end_id``) as bit planes: plane 0 has
every id's highest bit in text order; each next plane has the next bit after a stable partition by the one
before (zeros first). Ids are first replaced by their places in the shard's own sorted alphabet. The file keeps a rank directory: the ones before every 512 bits
of each plane, searched by halving for select. From one file
come any token (``access``), any range of tokens (``read``), a token's count in any range (``count``) and the places where it
occurs (``occurrences``), each by one step a plane.

File format (little-endian): magic ``MWM2``, uint32 length of a JSON header, the header (n, zeros of each
plane, sizes of the alphabet and of the sections, number of documents), then zstd frames: the documents' ends (uint64), their ids
(int64, with a mask frame for nulls), the alphabet (uint32), the directory (uint32, plane by plane), each plane's bits (first bit lowest).

In Spark, documents are dealt by ranges of doc_id and sorted in the task; a task writes shards of about
``shard_tokens`` ids, so its memory is bounded, to a file named for the attempt: a lost or repeated
task leaves an unread file at most. Shard starts are two-level running sums over shard sizes. Rows with
equal doc_id are ordered by a hash of their text, and a salt deals fully equal rows over tasks.

Edge cases: null and empty texts hold the end id only; null doc_ids come first; very long texts fill a shard of
their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh_path, materialize

MAGIC = b"MWM2"
BLOCK = 512
#: Special tokens, and characters that Unicode versions split, class or lower-case in different ways: such texts go to the library whole.
UNUSUAL = "[\x1c-\x1f\u0130]|<\\||[^\x00-\u052f\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
MARKS = string.punctuation
#: Fixed by the vocabulary: how it cuts a lower-case word.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
REMEMBERED = 700_000
#: Bytes of text encoded at a time.
CHUNK = 8 << 20


class WaveletMatrix:
    """Bit planes of a sequence of unsigned integers below 2**width, with a directory of the ones before each block of each plane."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: np.ndarray) -> None:
        self.n, self.planes, self.zeros, self.ones, self.width = n, planes, zeros, ones, len(planes)

    @classmethod
    def build(cls, values: np.ndarray, width: int = 16) -> WaveletMatrix:
        planes, zeros, now = [], [], values.astype(np.uint16 if width <= 16 else np.uint32)
        for k in reversed(range(width)):
            bit = (now >> k & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = np.compress(~bit, now)
            zeros.append(len(low))
            now = np.concatenate((low, np.compress(bit, now)))
        return cls(len(values), planes, zeros, np.array([cls._before_blocks(p) for p in planes], "<u4"))

    @staticmethod
    def _before_blocks(plane: np.ndarray) -> np.ndarray:
        """Ones of a plane before each block, and in all."""
        pad = np.zeros(-(-len(plane) * 8 // BLOCK) * (BLOCK // 8), np.uint8)
        pad[: len(plane)] = plane
        per = np.bitwise_count(pad.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        return np.concatenate(([0], np.cumsum(per)))

    def read(self, lo: int, hi: int) -> np.ndarray:
        """The values in places lo to hi - 1.

        Going down, the range is a few runs of each plane, whose ends move by rank; going up, the partitions of their bits are undone.
        """
        kind = np.uint16 if self.width <= 16 else np.uint32
        runs, bits = np.array([[lo, hi]], np.int64)[: int(hi > lo)], []
        for k in range(self.width):
            bits.append(self._bits(k, runs))
            ones = self._ranks(k, runs.ravel()).reshape(-1, 2)
            runs = np.concatenate((runs - ones, self.zeros[k] + ones))
            runs = runs[runs[:, 0] < runs[:, 1]]
            if len(runs) > 1:  # neighbours are one run
                new = np.concatenate(([True], runs[1:, 0] != runs[:-1, 1]))
                runs = np.stack([runs[new, 0], runs[np.append(np.flatnonzero(new)[1:] - 1, len(runs) - 1), 1]], 1)
        out = np.zeros(hi - lo, kind)
        for k, bit in enumerate(reversed(bits)):
            up, zeros = np.empty_like(out), len(bit) - int(np.count_nonzero(bit))
            up[np.flatnonzero(~bit)] = out[:zeros]
            up[np.flatnonzero(bit)] = out[zeros:] | kind(1 << k)
            out = up
        return out

    def _bits(self, k: int, runs: np.ndarray) -> np.ndarray:
        """The bits of plane k in all runs, one after the other."""
        if len(runs) <= 8:
            parts = [np.unpackbits(self.planes[k][lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo] for lo, hi in runs.tolist()]
            return np.concatenate(parts).view(bool) if parts else np.zeros(0, bool)
        size = runs[:, 1] - runs[:, 0]
        at = np.repeat(runs[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return (self.planes[k][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def _ranks(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each of the places."""
        if len(at) <= 16:
            return np.array([self._rank(k, i) for i in at.tolist()], np.int64)
        block = at // BLOCK
        pad = np.zeros((len(self.ones[k]) + 1) * (BLOCK // 8), np.uint8)
        pad[: len(self.planes[k])] = self.planes[k]
        words = pad.view("<u8").reshape(-1, BLOCK // 64)
        inside = at - block * BLOCK
        out = self.ones[k][block].astype(np.int64)
        for w in range(BLOCK // 64):
            left = np.clip(inside - 64 * w, 0, 64).astype(np.uint64)
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
            out += np.bitwise_count(words[block, w] & mask)
        return out

    def _rank(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // BLOCK
        part = self.planes[k][block * BLOCK // 8 : -(-i // 8)]
        ones = int(self.ones[k][block]) + int(np.bitwise_count(part).sum(dtype=np.int64))
        if i % 8:
            ones -= int(part[-1] >> (i % 8)).bit_count()
        return ones

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        ones = self.ones[k]

        def before(block: int) -> int:
            return int(ones[block]) if bit else block * BLOCK - int(ones[block])

        lo, hi = 0, len(ones) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= j else (lo, mid)
        bits = np.unpackbits(self.planes[k][lo * BLOCK // 8 : (lo + 1) * BLOCK // 8], bitorder="little")
        return lo * BLOCK + int(np.flatnonzero(bits == bit)[j - before(lo)])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.width):
            bit = int(self.planes[k][i // 8] >> (i % 8) & 1)
            ones = self._rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for k in range(self.width):
            a, b = self._rank(k, lo), self._rank(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.width - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``value`` stands in places lo to hi - 1."""
        lo, hi = self._range(value, lo, self.n if hi is None else hi)
        return hi - lo

    def occurrences(self, value: int) -> Iterator[int]:
        """The places of ``value``, in order."""
        lo, hi = self._range(value, 0, self.n)
        for at in range(lo, hi):
            for k in reversed(range(self.width)):
                bit = value >> (self.width - 1 - k) & 1
                at = self._select(k, bit, at - self.zeros[k] if bit else at)
            yield at


def pack_shard(ids: np.ndarray, ends: np.ndarray, doc_ids: pa.Array, level: int = 1) -> bytes:
    """A shard file's bytes."""
    used = np.flatnonzero(np.bincount(ids, minlength=1))
    place = np.zeros(int(used[-1]) + 1 if len(used) else 1, np.uint16)
    place[used] = np.arange(len(used))
    m = WaveletMatrix.build(place[ids], max(1, (len(used) - 1).bit_length()))
    null = doc_ids.is_null().to_numpy(zero_copy_only=False)
    known = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    put = zstandard.ZstdCompressor(level=level).compress
    frames = [put(x.tobytes()) for x in (ends.astype("<u8"), known, np.packbits(null, bitorder="little"), used.astype("<u4"), m.ones, *m.planes)]
    header = json.dumps({"n": m.n, "zeros": m.zeros, "alphabet": len(used), "docs": len(ends), "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


class Shard:
    """A shard file, read from its bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 4)
        head = json.loads(data[8 : 8 + size])
        at, parts, get = 8 + size, [], zstandard.ZstdDecompressor()
        for length in head["frames"]:
            parts.append(get.decompress(data[at : at + length], max_output_size=max(8 * head["n"], 8 * head["docs"], 4 * head["alphabet"], 4096)))
            at += length
        self.ends = np.frombuffer(parts[0], "<u8").astype(np.int64)
        null = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=head["docs"], bitorder="little").astype(bool)
        self.doc_ids = pa.array(np.frombuffer(parts[1], "<i8"), mask=null)
        self.alphabet = np.frombuffer(parts[3], "<u4")
        ones = np.frombuffer(parts[4], "<u4").reshape(len(head["zeros"]), -1)
        self.places = WaveletMatrix(head["n"], [np.frombuffer(p, np.uint8) for p in parts[5:]], head["zeros"], ones)

    def read(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids in places lo to hi - 1, as little-endian uint32."""
        hi = self.places.n if hi is None else hi
        return self.alphabet[self.places.read(lo, hi)] if hi > lo else np.zeros(0, "<u4")

    def document(self, nth: int) -> np.ndarray:
        """The ids of one document."""
        return self.read(int(self.ends[nth - 1]) if nth else 0, int(self.ends[nth]))

    def access(self, i: int) -> int:
        return int(self.alphabet[self.places.access(i)])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in places lo to hi - 1."""
        k = int(np.searchsorted(self.alphabet, token))
        return self.places.count(k, lo, hi) if k < len(self.alphabet) and self.alphabet[k] == token else 0

    def occurrences(self, token: int) -> Iterator[int]:
        """The places of a token, in order."""
        k = int(np.searchsorted(self.alphabet, token))
        if k < len(self.alphabet) and self.alphabet[k] == token:
            yield from self.places.occurrences(k)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Encoder:
    """The tokenizers library behind two bounded tables: of what stands between white space, and of its pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        # The same vocabulary for pieces that are normalised and cut already.
        spec = json.loads(t.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "CharDelimiterSplit", "delimiter": " "}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        vocab = t.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("the vocabulary has ids above 65535")
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words in composed lower-case form. New pieces are encoded many at a time."""
        cut: dict[str, list[str]] = {}
        for w in words:
            stem = w.rstrip(MARKS)
            if stem.isalpha():
                cut[w] = [stem] if len(stem) == len(w) else [stem, w[len(stem) :]]
            else:
                cut[w] = PIECES.findall(w)
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        new = list({p for ps in cut.values() for p in ps} - self.pieces.keys())
        lines = [new[k : k + 64] for k in range(0, len(new), 64)]
        for line, e in zip(lines, self.plain.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u2")
            to = (2 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(to) == len(line):
                data = ids.tobytes()
                self.pieces.update((p, data[a:b]) for p, a, b in zip(line, [0, *to], to, strict=False))
            else:
                self.pieces.update((p, self.alone(p)) for p in line)
        get = self.pieces.__getitem__
        for w, ps in cut.items():
            self.words[w] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, each text's followed by ``end_id``, and where each text ends.

        Words are split and numbered by Arrow, so that only a batch's different words are looked up.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
        apart = {k: np.frombuffer(self.alone(texts[int(k)].as_py()), "<u2") for k in np.flatnonzero(odd)}
        plain = texts if not len(apart) else pc.if_else(pa.array(odd), "", texts)
        content = plain.to_pylist()
        if not all(unicodedata.is_normalized("NFC", t) for t in content):
            plain = pa.array([unicodedata.normalize("NFC", t) for t in content], texts.type)
        split = pc.utf8_split_whitespace(pc.utf8_lower(plain))
        of_text = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        parts = list(map(self.words.get, words))
        if holes := [k for k, part in enumerate(parts) if part is None]:
            self.learn([words[k] for k in holes])
            for k in holes:
                parts[k] = self.words[words[k]]
        table = np.frombuffer(b"".join(parts), "<u2")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        begins = np.cumsum(sizes) - sizes
        size = sizes[which]
        upto = np.concatenate(([0], np.cumsum(size)))
        counts = np.diff(upto[of_text])
        ids = table[np.repeat(begins[which] - upto[:-1], size) + np.arange(upto[-1])]
        for k, own in apart.items():
            counts[k] = len(own)
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, "<u2")
        place = np.repeat(~odd, counts + 1)
        place[ends - 1] = False
        out[place] = ids
        for k, own in apart.items():
            out[ends[k] - 1 - len(own) : ends[k] - 1] = own
        return out, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One vocabulary a Python worker."""
    return Encoder(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 21, chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in ascending doc_id order; (part, nth, path, docs, tokens) of every shard file."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "shards")
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text")).withColumn("salt", F.xxhash64("text", F.monotonically_increasing_id()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(n, "doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, held, ends, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = pack_shard(np.concatenate(held), np.concatenate(ends), pa.concat_arrays(ids))
            name = f"{folder}/shard-{part:06d}-{nth:05d}-{uuid.uuid4().hex}.mwm"
            at, file = _open(name)
            with at.open_output_stream(file) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, nth, name, sum(map(len, ids)), size)], ["part", "nth", "path", "docs", "tokens"])

        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
                coded, where = encoder(tokenizer).encode(b.column(1).slice(at, to - at), end_id)
                held.append(coded)
                ends.append(where + size)
                ids.append(b.column(0).slice(at, to - at))
                size, at = size + len(coded), to
                if size >= shard_tokens:
                    yield flush()
                    nth, held, ends, ids, size = nth + 1, [], [], [], 0
        if held:
            yield flush()

    return materialize(dealt.mapInArrow(run, "part long, nth long, path string, docs long, tokens long"), "shard-list")


def shard_starts(shards: DataFrame) -> DataFrame:
    """The list of shards with ``start``, the number of ids in all shards before."""
    per = shards.groupBy("part").agg(F.sum("tokens").alias("n"))  # one row a task
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(per, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).drop("base")


def read_documents(shards: DataFrame, tokens: int = 1 << 22) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, read in ranges of about ``tokens`` ids."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, file = _open(path)
                with at.open_input_stream(file) as f:
                    shard = Shard(f.read())
                begins = np.concatenate(([0], shard.ends[:-1]))
                sums, at = [], 0
                while at < len(begins):  # a bounded range of tokens at a time, one document at least
                    base = int(begins[at])
                    to = max(at + 1, int(np.searchsorted(shard.ends, base + tokens, "right")))
                    ids = memoryview(shard.read(base, int(shard.ends[to - 1])).view(np.uint8))
                    sums += [zlib.crc32(ids[4 * (lo - base) : 4 * (hi - base)]) for lo, hi in zip(begins[at:to].tolist(), shard.ends[at:to].tolist(), strict=True)]
                    at = to
                yield pa.RecordBatch.from_arrays([shard.doc_ids, pa.array(begins + start), pa.array(shard.ends - begins), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("path", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
