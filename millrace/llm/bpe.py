"""Byte-level BPE as a streaming transducer, and its incremental decoder.

BPE tokenisations of a string's prefixes form a tree: the tokenisation of n bytes is that of n - len(t) bytes
followed by its last token t, the one vocabulary suffix that does not merge with the token before it. A
later token starts less than ``lookahead`` bytes back, where ``lookahead`` is the longest string that
the merge list builds; so a token is stable once the paths of the last ``lookahead`` prefixes all run
through it, or once its piece ends. The transducer keeps those prefixes only, emits stable tokens and forgets them: memory
doesn't grow with the input. Every piece passes it. Short pieces share their prefixes, whose last tokens are kept in a table of bounded size, and what
it gave for them is remembered in another, from which entries go that were not asked for again.

The decoder turns token bytes into text by an incremental UTF-8 state machine: a character cut by
a token's end waits for the next one; ill-formed bytes become U+FFFD.

Texts are split as the byte-level pattern does. A space after a non-space always starts a new piece there, so
long texts pass in windows; where no such space comes, piece by piece, and long pieces in parts. Characters that versions of Unicode class
differently are split by the library's own splitter.

Edge cases: null and empty texts have no tokens; a special token's string
in the text is that token; ties don't arise (merges have ranks); extra columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, hold

#: Fixed by the vocabulary: how the byte-level pattern splits a text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A white-space character before a space: there, splitting at spaces would cut a piece.
RUN = regex.compile(r"\p{White_Space} ")
CUT = regex.compile(r"(?<=\P{White_Space}) ")
#: A cut whatever the version of Unicode.
SURE_CUT = re.compile(r"(?<=[0-9A-Za-z]) ")
WINDOW = 1 << 16
REMEMBERED = 250_000
#: Bytes of a piece whose prefixes are kept for others, and characters of what is remembered.
SHORT = 64
#: Bytes of a long piece that are pushed at a time.
PART = 4096
NONE, UNKNOWN = -1, -2


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, as letter: byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _class_now(c: str) -> str:
    return next((name for name, p in CLASSES.items() if p.match(c)), "other")


def _class_then(c: str) -> str:
    kind = unicodedata.ucd_3_2_0.category(c)
    return "space" if kind[0] == "Z" or c in "\t\n\v\f\r\x85" else {"L": "letter", "N": "number"}.get(kind[0], "other")


CLASSES = {"space": regex.compile(r"\p{White_Space}"), "letter": regex.compile(r"\p{L}"), "number": regex.compile(r"\p{N}")}


class Classes(dict):
    """Whether a character had the same class in every version of Unicode from 3.2 on."""

    def __missing__(self, c: str) -> bool:
        self[c] = same = _class_now(c) == _class_then(c)
        return same


class Transducer:
    """Tokens of one piece whose bytes come part by part."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe
        self.held = b""  # the bytes after the last stable token
        #: The last token of each of their prefixes (UNKNOWN: not asked for yet, NONE: none ends there); first, the stable token before them (None: the piece begins).
        self.last: list[int | None] = [None]
        self.checked = 0

    def push(self, data: bytes) -> list[int]:
        """Take more bytes; the tokens that have become stable."""
        self.bpe.pushed += len(data)
        self.held += data
        self.last += [UNKNOWN] * len(data)
        longest, out = self.bpe.lookahead, []
        while len(self.held) >= self.checked + 2 * longest:
            self.checked += longest
            stable = self._stable(self.checked + longest)
            if stable:
                out += [token for token, _ in stable]
                cut = sum(n for _, n in stable)
                self.held, self.last = self.held[cut:], [out[-1], *self.last[cut + 1 :]]
                self.checked -= cut
        return out

    def _last(self, n: int) -> int:
        """The last token of the first n held bytes: of the tokens that they end with, the one that can follow the last token before it."""
        bpe, held, last = self.bpe, self.held, self.last
        token_of, pairs = bpe.whole.get, bpe.pairs.get
        start = n - bpe.reach.get(held[n - 4 : n], 3) if n > 3 else 0
        for start in range(start if start > 0 else 0, n):
            token = token_of(held[start:n])
            if token is not None:
                before = last[start]
                if before == UNKNOWN:
                    before = self._last(start)
                if before is None:
                    break
                if before >= 0:
                    apart = pairs((before, token))
                    if bpe.apart(before, token) if apart is None else apart:
                        break
        else:
            token = NONE
        last[n] = token
        return token

    def _path(self, n: int) -> list[tuple[int, int]]:
        """(token, bytes) of the first n held bytes."""
        out = []
        while n:
            token = self.last[n]
            out.append((token, self.bpe.size[token]))
            n -= out[-1][1]
        return out[::-1]

    def _stable(self, at: int) -> list[tuple[int, int]]:
        """The tokens that the paths of all prefixes share on which later tokens can stand."""
        upto = range(at - self.bpe.lookahead + 1, at + 1)
        live = [n for n in upto if (self._last(n) if self.last[n] == UNKNOWN else self.last[n]) >= 0]
        shared = self._path(live[0])
        for n in live[1:]:
            path = self._path(n)
            k = 0
            while k < min(len(path), len(shared)) and path[k] == shared[k]:
                k += 1
            shared = shared[:k]
        return shared

    def end(self) -> list[int]:
        """The tokens of what is left when the piece ends."""
        n, out = len(self.held), []
        if n and self.last[n] == UNKNOWN:
            self._last(n)
        while n:
            token = self.last[n]
            out.append(token)
            n -= self.bpe.size[token]
        return out[::-1]


class ByteBPE:
    """A byte-level BPE vocabulary with its merge list, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        for t in spec["added_tokens"]:
            if not t["special"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} is of a kind that is not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.size = [len(b) for b in self.bytes]
        self.of_byte = [0] * 256
        for token, i in vocab.items():
            if len(token) == 1:
                self.of_byte[letters[token]] = i
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank_of: dict[tuple[int, int], int] = {}
        #: What each token was merged from, and the merge's rank; -1 for single bytes.
        self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n
        #: Whether token b can follow token a, as far as it was asked.
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Tokens that BPE gives for their own bytes.
        self.whole = {bytes((b,)): i for b, i in enumerate(self.of_byte)}
        for rank, (a, b) in enumerate(pairs):
            one, two, made = vocab[a], vocab[b], vocab[a + b]
            self.rank_of[one, two] = rank
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = one, two, rank
        for made in sorted(vocab.values(), key=self.rank.__getitem__):  # parts come before what is merged from them
            if self.rank[made] >= 0 and self._parts_stand(made):
                self.whole[self.bytes[made]] = made
        #: The longest token that ends with four given bytes.
        self.reach: dict[bytes, int] = {}
        for token in sorted(self.whole, key=len):
            self.reach[token[-4:]] = len(token)
        #: No token is longer than the longest string that the merge list builds.
        self.lookahead = max(map(len, self.whole))
        self.digits = [str(i) for i in range(n)]
        self.remembered = _Pieces(self)
        #: The last token of short prefixes (NONE: none ends there).
        self.ends: dict[bytes, int] = {}
        self.sure = Classes()
        #: Bytes that have passed the transducer.
        self.pushed = 0
        self._path, self._splitter = path, None

    def _parts_stand(self, token: int) -> bool:
        """Whether BPE gives a token for its own bytes: both parts do, and nothing merges across them before they do."""
        one, two = self.left[token], self.right[token]
        return self.bytes[one] in self.whole and self.bytes[two] in self.whole and self._stay_apart(one, two, self.rank[token])

    def _stay_apart(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` joins tokens a and b, or what they were before, across their border.

        What stood at the border is found by undoing the later of the two tokens' merges, again and again. Of two equal merges the left
        one comes first.
        """
        rank, rank_of = self.rank, self.rank_of.get
        while True:
            across = rank_of((a, b))
            if across is not None and across < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = min(limit, rank[a]), self.right[a]
            elif rank[b] >= 0:
                limit, b = min(limit, rank[b] + 1), self.left[b]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: their bytes together give just these two."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        known = self.pairs[a, b] = self._stay_apart(a, b, float("inf"))
        return known

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece of the pattern."""
        if data in self.whole:  # the transducer's longest candidate, and nothing stands before it
            self.pushed += len(data)
            return [self.whole[data]]
        if len(data) <= SHORT:
            return self._short(data)
        stream = Transducer(self)
        return stream.push(data) + stream.end()

    def _short(self, data: bytes) -> list[int]:
        """What the transducer gives for a short piece, with the prefixes of all short pieces in one table."""
        self.pushed += len(data)
        if len(self.ends) > REMEMBERED:
            self.ends.clear()
        ends, size, out = self.ends, self.size, []
        while data:
            token = ends.get(data)
            if token is None:
                token = self._end(data)
            out.append(token)
            data = data[: -size[token]]
        return out[::-1]

    def _end(self, data: bytes) -> int:
        """The last token of a short prefix, as :meth:`Transducer._last` finds it."""
        ends, token_of, pairs, n = self.ends, self.whole.get, self.pairs.get, len(data)
        start = n - self.reach.get(data[-4:], 3) if n > 3 else 0
        for start in range(start if start > 0 else 0, n):
            token = token_of(data[start:])
            if token is not None:
                if not start:
                    break
                before = ends.get(data[:start])
                if before is None:
                    before = ends[data[:start]] = self._end(data[:start])
                if before >= 0:
                    apart = pairs((before, token))
                    if self.apart(before, token) if apart is None else apart:
                        break
        else:
            token = NONE
        return token

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """The text's tokens, a window at a time."""
        if not text:
            return
        sure = text.isascii() or all(map(self.sure.__getitem__, set(text)))
        parts = [text]
        if any(s in text for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)
        for part in parts:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                cut = None
                if len(part) - at > WINDOW:
                    cut = CUT.search(part, at + WINDOW, at + 2 * WINDOW) if sure else SURE_CUT.search(part, at + WINDOW)
                if sure and cut is None and len(part) - at > 2 * WINDOW:
                    for ids, at in self._pieces(part, at):  # noqa: B007, PLW2901
                        yield ids
                    continue
                to = cut.start() if cut else len(part)
                yield self._window(part[at:to]) if sure else self._split(part[at:to])
                at = to

    def _pieces(self, text: str, at: int) -> Iterator[tuple[list[int], int]]:
        """Tokens from ``at`` on, piece by piece for about a window, and where they end."""
        upto = at + WINDOW
        self.remembered.bound(REMEMBERED)
        for m in PIECES.finditer(text, at):
            lo, hi = m.span()
            if hi - lo <= PART:
                yield list(self.remembered[m.group()]), hi
            else:
                stream = Transducer(self)
                for k in range(lo, hi, PART):
                    yield stream.push(text[k : min(k + PART, hi)].encode()), hi
                yield stream.end(), hi
            if hi >= upto:
                return

    def _split(self, text: str) -> list[int]:
        """The tokens of a window that holds characters of doubtful class: split by the library."""
        if self._splitter is None:
            from tokenizers import Tokenizer

            self._splitter = Tokenizer.from_file(self._path).pre_tokenizer
        spans = [span for _, span in self._splitter.pre_tokenize_str(text)]
        return list(chain.from_iterable(self.piece(text[lo:hi].encode()) for lo, hi in spans))

    def _window(self, text: str) -> list[int]:
        known = self.remembered
        known.bound(REMEMBERED)
        if RUN.search(text):
            return list(chain.from_iterable(map(known.__getitem__, PIECES.findall(text))))
        first, *others = text.split(" ")
        return [*(known[first] if first else ()), *chain.from_iterable(map(known.spaced.__getitem__, others))]

    def decoder(self) -> Decoder:
        return Decoder(self)


class _Recent(dict):
    """A table that is emptied when it is full; entries of the one before that are asked for come back."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= SHORT:
            self[chunk] = ids
        return ids

    def bound(self, size: int) -> None:
        """Turn to a new table once this one has half of ``size`` entries."""
        if 2 * len(self) > size:
            self.older = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.older = {}


class _Pieces(_Recent):
    """Tokens of pieces, and of what stands between two spaces: in ``spaced`` by what follows the space before."""

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__(self._tokens)
        self.bpe, self.spaced = bpe, _Recent(lambda chunk: self._tokens(" " + chunk))

    def _tokens(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return tuple(self.bpe.piece(chunk.encode()))
        pieces = PIECES.findall(chunk)
        if len(pieces) == 1:
            return tuple(self.bpe.piece(chunk.encode()))
        return tuple(chain.from_iterable(self.spaced[p[1:]] if p[0] == " " else self[p] for p in pieces))

    def bound(self, size: int) -> None:
        super().bound(size)
        self.spaced.bound(size)

    def clear(self) -> None:
        super().clear()
        self.spaced.clear()


class Decoder:
    """Tokens to text; what is not yet a whole character waits."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bytes = bpe.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One vocabulary a Python worker."""
    return ByteBPE(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, ids array<int> and round_trip of every row: whether decoding gives the text back (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        hold(bpe.remembered, bpe.pairs, bpe.ends)
        for b in batches:
            at, n = 0, b.num_rows
            while at < n:  # a batch of long texts goes on in parts
                ids, ends, same, start = array("i"), [0], [], at
                while at < n and len(ids) < 1 << 20:
                    value, back, place, good = b.column(0)[at].as_py() or "", bpe.decoder(), 0, True
                    for some in bpe.encode(value):
                        ids.extend(some)
                        piece = back.push(some)
                        good, place = good and value.startswith(piece, place), place + len(piece)
                    piece = back.end()
                    same.append(good and value[place:] == piece)
                    ends.append(len(ids))
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(same), *b.slice(start, at - start).columns[1:]], ["ids", "round_trip", *carry])

    bound_batches(docs)
    own = docs.select(F.col(text).cast("string").alias("_text"), *carry)
    types = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"ids array<int>, round_trip boolean{types}")


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of ``carry`` and, as column ``text``, the text of every row's ids (null ids: null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        hold(bpe.remembered, bpe.pairs, bpe.ends)
        for b in batches:
            texts = []
            for row in b.column(0):
                if not row.is_valid:
                    texts.append(None)
                    continue
                stream = bpe.decoder()
                texts.append(stream.push(row.as_py()) + stream.end())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *b.columns[1:]], [text, *carry])

    bound_batches(encoded)
    own = encoded.select(F.col(ids).alias("_ids"), *carry)
    types = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"`{text}` string{types}")


def digests(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row: encoded and decoded as a stream, nothing kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        hold(bpe.remembered, bpe.pairs, bpe.ends)
        digit = bpe.digits.__getitem__
        for b in batches:
            counts, ids_sums, text_sums = [], [], []
            for value in b.column(0):
                n, ids_sha, text_sha, back = 0, hashlib.sha256(), hashlib.sha256(), bpe.decoder()
                for ids in bpe.encode(value.as_py()):
                    if ids:
                        ids_sha.update(("," * (n > 0) + ",".join(map(digit, ids))).encode())
                        text_sha.update(back.push(ids).encode())
                        n += len(ids)
                text_sha.update(back.end().encode())
                counts.append(n)
                ids_sums.append(ids_sha.hexdigest())
                text_sums.append(text_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums), *b.columns[1:]], ["n_tokens", "ids_sha256", "decoded_sha256", *carry])

    bound_batches(docs)
    own = docs.select(F.col(text).cast("string").alias("_text"), *carry)
    types = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in carry)
    return own.mapInArrow(run, f"n_tokens long, ids_sha256 string, decoded_sha256 string{types}")
