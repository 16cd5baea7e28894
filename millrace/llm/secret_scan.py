"""Secret scans with one deterministic automaton for all rules.

A rule is a sequence of parts, each a set of bytes with a least and a greatest number of repeats (or none), or a choice of such
sequences. Thompson's construction gives each rule's automaton. Subset construction joins them: a state of the joint automaton
holds, for every rule, the sets of places that a match begun earlier may have reached, the earliest begun first. What a
leftmost match has committed to (its first accepted byte) drops the later ones, so the states themselves keep matches of a
rule leftmost and apart. Bytes that no state tells apart become one class, and equal states are merged by partition refinement; what
remains is one array ``next[state, class]`` and a bit a rule ``accepting[state]``.

A scan reads each byte of a text once, for all rules. Texts are cut where any state goes back to the start (line
ends, most punctuation, and the last letters of most words with the space behind them do that), and numpy advances all pieces side by side, a byte of each at a time. Runs of accepting states are
matches; where one began follows from the rule's length or, for heads of varying length, from the reversed rule over those few bytes.

Rules must keep accepting from their first accepted byte to the end of the match, which is what the automaton can decide in one pass; others
are refused when they are compiled. A rule's ``least`` is held against the length of its last part after the match is found, since a match that fails still uses up its bytes.

Edge cases: null texts are empty; offsets are in code points; nothing crosses texts; empty texts and tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches

DIGIT, LOWER, UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Part:
    """Bytes that may come, from ``low`` to ``high`` times (None: any number)."""

    of: bytes
    low: int = 1
    high: int | None = 1


def word(text: str, any_case: bool = False) -> tuple[Part, ...]:
    """A fixed text."""
    return tuple(Part((c.lower() + c.upper()).encode() if any_case else c.encode()) for c in text)


@dataclass(frozen=True)
class Rule:
    """One of the ``heads``, then ``tail``; the last part of ``tail`` must have ``least`` bytes, ``base`` rules count in digests."""

    kind: str
    heads: tuple[tuple[Part, ...], ...]
    tail: tuple[Part, ...]
    least: int = 1
    base: bool = False


_value = LOWER + UPPER + DIGIT
_quote = Part(b"\"'", 0)
#: The rules of the scan. The first three are its base.
RULES = (
    Rule("assign", tuple(word(w, True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")), (_quote, Part(b" ", 0, None), Part(b":="), Part(b" ", 0, None), _quote, Part(_value + b"+/_.=-", 1, None)), 12, True),
    Rule("access", (word("AKIA"),), (Part(UPPER + DIGIT, 1, None),), 14, True),
    Rule("hex", ((),), (Part(DIGIT + b"abcdef", 16, None),), 16, True),  # runs don't overlap: 16 can be counted by the automaton
    Rule("private_key", tuple(word(f"-----BEGIN {w}") for w in ("", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED ")), word("PRIVATE KEY-----")),
    Rule("code_host", tuple(word(f"gh{c}_") for c in "pousr"), (Part(_value, 1, None),), 36),
    Rule("chat", tuple(word(f"xox{c}-") for c in "abprs"), (Part(_value + b"-", 1, None),), 10),
    Rule("web_token", (word("eyJ") + (Part(_value + b"_-", 1, None), Part(b".")) + word("eyJ") + (Part(_value + b"_-", 1, None), Part(b".")),), (Part(_value + b"_-", 1, None),), 8),
    Rule("url_login", ((*word("://"), Part(_value + b"._~-", 1, None), Part(b":")),), (Part(_value + b"._~!$%&*+=-", 1, None), Part(b"@"))),
)


@dataclass
class _Net:
    """A rule's automaton: moves[place] = (byte flags, next place); skips[place] = places reached without a byte."""

    moves: dict[int, tuple[np.ndarray, int]] = field(default_factory=dict)
    skips: dict[int, set[int]] = field(default_factory=dict)
    n: int = 1
    last: int = 0

    def place(self) -> int:
        self.n += 1
        return self.n - 1

    def skip(self, start: int, end: int) -> int:
        self.skips.setdefault(start, set()).add(end)
        return end

    def chain(self, parts: tuple[Part, ...], start: int) -> int:
        for part in parts:
            flags = np.zeros(256, bool)
            flags[list(part.of)] = True
            optional = [start]
            for k in range(part.high or part.low):
                if k > part.low:
                    optional.append(start)
                self.moves[start] = (flags, end := self.place())
                start = end
            if part.high is None:
                loop = self.skip(start, self.place())
                self.moves[loop] = (flags, loop)
                start = loop
            end = self.skip(start, self.place())
            for p in optional[part.low > 0 :]:
                self.skip(p, end)
            start = end
        return start

    @classmethod
    def of(cls, choices: tuple[tuple[Part, ...], ...], tail: tuple[Part, ...] = (), front: tuple[Part, ...] = ()) -> _Net:
        """``front``, one of the choices, ``tail``."""
        net = cls()
        fork, join = net.chain(front, 0), net.place()
        for choice in choices:
            net.skip(net.chain(choice, net.skip(fork, net.place())), join)
        net.last = net.chain(tail, join)
        return net

    def closed(self, places: set[int]) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for q in self.skips.get(todo.pop(), ()):
                if q not in seen:
                    seen.add(q), todo.append(q)
        return frozenset(p for p in seen if p in self.moves or p == self.last)

    def step(self, places: frozenset[int], byte: int) -> frozenset[int]:
        return self.closed({to for p in places if p in self.moves for flags, to in [self.moves[p]] if flags[byte]})


@dataclass(frozen=True)
class Automaton:
    """``next[state, group[byte]]``, ``accepting[state]`` (bit k: rule k), and ``resets[g, h]``: after bytes of groups g and h, every state is the start."""

    rules: tuple[Rule, ...]
    group: np.ndarray
    next: np.ndarray
    accepting: np.ndarray
    resets: np.ndarray
    unmerged: int


def _byte_groups(nets: list[_Net]) -> tuple[np.ndarray, list[int]]:
    """A number for each byte, equal for bytes that no move tells apart, and a byte of each number."""
    columns = np.array([flags for net in nets for flags, _ in net.moves.values()], bool)
    _, first, group = np.unique(columns, axis=1, return_index=True, return_inverse=True)
    return group.reshape(-1), [int(x) for x in first]


@cache
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The joint minimal automaton of the rules."""
    if odd := [r.kind for r in rules if not r.tail or r.tail[-1].low < 1]:
        raise ValueError(f"the last part of {odd} may be missing")
    nets = [_Net.of(r.heads, r.tail) for r in rules]
    group, samples = _byte_groups(nets)
    fresh = [net.closed({0}) for net in nets]
    steps: list[dict] = [{} for _ in nets]

    def one(k: int, sets: tuple[frozenset[int], ...], byte: int) -> tuple[frozenset[int], ...]:
        """A rule's sets after a byte: earliest start first, a place only in the earliest set that has it."""
        net, out, seen = nets[k], [], set()
        held = bool(sets) and net.last in sets[0]
        for places in (*sets, fresh[k]):
            after = frozenset(net.step(places, byte) - seen)
            if not after:
                continue
            if net.last in after:
                if out:
                    raise ValueError(f"{rules[k].kind}: a later start matches before an earlier one is decided")
                if held and places is not sets[0]:
                    raise ValueError(f"{rules[k].kind}: a match can begin right after another")
                return (after,)
            if held and places is sets[0]:
                raise ValueError(f"{rules[k].kind}: a match can go on without accepting")
            out.append(after)
            seen |= after
        return tuple(out)

    start = tuple(() for _ in nets)
    index, todo, table = {start: 0}, [start], []
    while todo:
        state = todo.pop(0)
        row = []
        for byte in samples:
            parts = []
            for k, sets in enumerate(state):
                known = steps[k].get((sets, byte))
                if known is None:
                    known = steps[k][sets, byte] = one(k, sets, byte)
                parts.append(known)
            after = tuple(parts)
            if after not in index:
                index[after] = len(index)
                todo.append(after)
            row.append(index[after])
        table.append(row)
    following = np.array(table)
    accepting = np.array([sum(1 << k for k, sets in enumerate(s) if sets and nets[k].last in sets[0]) for s in index])
    label = np.unique(accepting, return_inverse=True)[1].reshape(-1)
    while True:  # partition refinement: states of one label part if a byte leads to different labels
        finer = np.unique(np.column_stack([label, label[following]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == label.max():
            break
        label = finer
    _, first = np.unique(label, return_index=True)
    order = np.argsort(first)  # the start stays state 0
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first = first[order]
    small = rank[label[following[first]]].astype(np.uint16)
    resets = np.array([(small[small[:, g]] == 0).all(axis=0) for g in range(small.shape[1])])
    return Automaton(rules, group.astype(np.uint8), small, accepting[first], resets, len(index))


#: Pieces below which a byte of each at a time is slower than one piece after the other.
FEW_PIECES = 24
#: Bytes of the texts that are scanned side by side, so that arrays stay small; a longer text is one such group.
SIDE_BY_SIDE = 1 << 22


def scan_states(auto: Automaton, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The state after each byte; every text begins in the start state."""
    out = np.zeros(len(data), np.int32)
    width = auto.next.shape[1]
    groups = auto.group[data].astype(np.int32)
    begins = np.zeros(len(data), bool)
    begins[starts[starts < len(data)]] = True
    begins[2:] |= auto.resets[groups[:-2], groups[1:-1]]
    first = np.flatnonzero(begins).astype(np.int32)
    size = np.diff(np.append(first, len(data)))
    order = np.argsort(-size, kind="stable")
    at, size = first[order], size[order]
    lives = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")  # pieces with more bytes than that
    flat = (auto.next.astype(np.int32) * width).reshape(-1)  # a state's row, so that a step is one sum and one look-up
    row, done = np.zeros(len(at), np.int32), 0
    for live in lives.tolist():
        if live <= FEW_PIECES:
            break
        at, row = at[:live], row[:live]
        row = flat.take(row + groups.take(at))
        out[at] = row
        at = at + 1
        done += 1
    steps = flat.tolist() if done < len(lives) else []
    for k in range(int(lives[done]) if steps else 0):
        lo, hi, r, found = int(at[k]), int(first[order[k]] + size[k]), int(row[k]), []
        for g in groups[lo:hi].tolist():
            r = steps[r + g]
            found.append(r)
        out[lo:hi] = found
    return out // width


@cache
def _backward(rules: tuple[Rule, ...]) -> list[tuple[_Net, int | None]]:
    """A rule read backwards from its first accepted byte, and the number of bytes up to there if it is always the same."""
    out = []
    for r in rules:
        tail = (*r.tail[:-1], Part(r.tail[-1].of, r.tail[-1].low, r.tail[-1].low))
        same = {sum(p.low for p in (*h, *tail)) if all(p.low == p.high for p in (*h, *tail)) else None for h in r.heads}
        net = _Net.of(tuple(h[::-1] for h in r.heads), (), tail[::-1])
        out.append((net, same.pop() if len(same) == 1 else None))
    return out


def _began(net: _Net, text: bytes, at: int, floor: int) -> int:
    """The earliest start, not before ``floor``, of a match whose first accepted byte is at ``at``."""
    places, found, memo = net.closed({0}), at, {}
    for k in range(at, floor - 1, -1):
        key = (places, text[k])
        if key not in memo:
            memo[key] = net.step(places, text[k])
        places = memo[key]
        if not places:
            break
        if net.last in places:
            found = k
    return found


def find(auto: Automaton, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule) in bytes of each text's matches, by start, then rule; ``end`` is exclusive."""
    out, group, held = [], [], 0
    for t in texts:
        if group and held + len(t) > SIDE_BY_SIDE:
            out += _find(auto, group)
            group, held = [], 0
        group.append(t)
        held += len(t)
    return out + _find(auto, group)


def _find(auto: Automaton, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    bits = auto.accepting[scan_states(auto, data, starts[:-1])]
    hits = np.flatnonzero(bits)
    cut = np.zeros(len(data) + 1, bool)  # a text's first byte never goes on with what the text before it had
    cut[starts] = True
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, rule in enumerate(auto.rules):
        on = hits[(bits[hits] >> k) & 1 == 1]
        apart = np.diff(on) > 1
        rises = on[np.concatenate([[True], apart | cut[on[1:]]])] if len(on) else on
        falls = on[np.concatenate([apart | cut[on[1:]], [True]])] + 1 if len(on) else on
        keep = rule.tail[-1].low + falls - rises - 1 >= rule.least
        net, length = _backward(auto.rules)[k]
        if length:  # a match that fails matters only for where the next one may begin
            rises, falls, keep = rises[keep], falls[keep], keep[keep]
        doc = np.searchsorted(starts, rises, side="right") - 1
        ended: dict[int, int] = {}
        for at, end, ok, d in zip(rises.tolist(), falls.tolist(), keep.tolist(), doc.tolist(), strict=True):
            base = int(starts[d])
            if ok:
                begin = at - base - length + 1 if length else _began(net, texts[d], at - base, ended.get(d, 0))
                out[d].append((begin, end - base, k))
            ended[d] = end - base
    return [sorted(x, key=lambda m: (m[0], m[2])) for x in out]


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``found``, an array of (kind, base, start, end) in order of start, for every document."""
    auto = compile_rules(rules)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("b"))
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = pa.list_(pa.struct([("kind", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("b").to_pylist()
            found = [[{"kind": rules[k].kind, "base": rules[k].base, "start": a, "end": e} for a, e, k in in_code_points(t, x)] for t, x in zip(texts, find(auto, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, schema)], ["doc_id", "found"])

    bound_batches(rows)
    return rows.mapInArrow(scan, f"doc_id {kind}, found array<struct<kind:string,base:boolean,start:bigint,end:bigint>>")
