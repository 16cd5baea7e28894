"""SimHash, suffix-array and embedding near-duplicates against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, epsgrid, simhash, suffix_dedup

DOCS = "doc_id long, text string, fp string, `rid` int"  # extra columns with the operators' own names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def reach(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = reach(300, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a in nodes for b in nodes)
    assert all(got[got[a]] == got[a] for a in nodes)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fp(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "a b c d e f g", "É x\x0by z é w q", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fp(text)


@pytest.mark.parametrize("block", [5, 4096])
def test_links_of_planted_fingerprints(spark, block):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    parts = components.connected_components(simhash.link_fingerprints(df, block=block))
    got = {r["node"] % (1 << 64): r["component"] for r in parts.collect()}
    a = np.array(fps, np.uint64)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(np.bitwise_count(a[i] ^ a[j])) <= 4]
    want = reach(len(fps), links)
    assert {fps[k] for pair in links for k in pair} == set(got)
    linked = [k for k in range(len(fps)) if fps[k] in got]
    assert all((got[fps[i]] == got[fps[j]]) == (want[i] == want[j]) for i in linked for j in linked)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 9])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    fp[1::2] = fp[::2] ^ np.array([sum(1 << int(b) for b in rng.choice(63, k % 12, replace=False)) for k in range(350)], np.uint64)
    planes = simhash.bit_planes(fp)
    for d in (1, 63, 64, 65, 130):
        wanted = np.zeros((planes.shape[1] - 1) * 64, bool)
        wanted[: len(fp) - d] = True
        close = simhash.within(planes, d, radius, np.packbits(wanted, bitorder="little").view("<u8"))
        bits = np.unpackbits(close.view(np.uint8), bitorder="little")[: len(fp) - d].astype(bool)
        assert (bits == (np.bitwise_count(fp[:-d] ^ fp[d:]) <= radius)).all()


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (9, " "), (7, "alpha beta gamma delta"), (2, "ALPHA beta gamma delta"), (2, "other words are in this one"), (None, "alpha beta gamma delta")]
    got = sorted(((r["doc_id"] or -1, r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()))
    assert got == [(-1, False, 2), (2, False, 2), (2, False, 2), (3, True, 3), (5, True, 3), (7, False, 2), (9, True, 3)]
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0


def brute_removal(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for k in range(len(b) - least + 1):
            seen[b[k : k + least]] = seen.get(b[k : k + least], 0) + 1
    out = []
    for b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if seen[b[k : k + least]] > 1:
                cover[k : k + least] = b"\1" * least
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("block", [2, 4096])
def test_suffix_removal(spark, block):
    rng = random.Random(3)
    passage, long_ = words(rng, 90), words(rng, 400)
    near = [long_[:k] + "#" + long_[k + 1 :] for k in (5, 500, 900, 901, 1400)]
    texts = [None, "", "short", "short", "a" * 1500, "ab" * 450, words(rng, 300), words(rng, 50) + passage + words(rng, 60), passage + words(rng, 40), passage[:399], passage[:405] + "z", long_, long_, *near, words(rng, 80) + long_[300:1000] + words(rng, 10) + long_[290:900]]
    got = sorted(suffix_dedup.removal(frame(spark, list(enumerate(texts))), block=block).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in got] == brute_removal(texts, 400)


def test_copies_of_a_text_bring_each_context_once(spark, monkeypatch):
    rng = random.Random(8)
    passage = words(rng, 90)
    one, other = words(rng, 60) + passage + words(rng, 60), words(rng, 50) + passage + words(rng, 50)
    seen, plain = [], suffix_dedup.compare_groups

    def counted(contexts, least):
        seen.extend(contexts.groupBy(*suffix_dedup.GROUP, "ck").count().collect())
        return plain(contexts, least)

    monkeypatch.setattr(suffix_dedup, "compare_groups", counted)
    texts = [one] * 3000 + [other]
    got = sorted(suffix_dedup.removal(frame(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    want = brute_removal([one, one, other], 400)
    assert {tuple(r)[1:] for r in got[:-1]} == {want[0]} and tuple(got[-1])[1:] == want[2]
    assert seen and {r["count"] for r in seen} == {1}


def test_large_groups_are_divided_until_few_windows_are_left(spark, monkeypatch):
    rng = random.Random(11)
    passage = words(rng, 120)
    texts = [words(rng, rng.randrange(9)) + passage + words(rng, 40) for _ in range(40)]
    for k in range(40):  # near copies with a change each
        at = rng.randrange(len(passage))
        texts.append(passage[:at] + "#%"[k % 2] + passage[at + 1 :] + words(rng, 3))
    lengths, windows, plain = [], [], suffix_dedup.split_windows

    def counted(contexts, least):
        lengths.append(least)
        windows.append(contexts.count() * (least + 1))
        return plain(contexts, least)

    monkeypatch.setattr(suffix_dedup, "split_windows", counted)
    got = sorted(suffix_dedup.removal(frame(spark, list(enumerate(texts))), block=8).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in got] == brute_removal(texts, 400)
    assert lengths and max(lengths) <= suffix_dedup.TINY and sum(windows) <= 5 * 80 * (suffix_dedup.TINY + 1)


def test_near_copies_bring_few_rows_to_the_division(spark, monkeypatch):
    rng = random.Random(13)
    passage = words(rng, 200)
    texts = [passage]
    for k in range(300):  # near copies with a change each, between different words
        at = rng.randrange(len(passage))
        texts.append(words(rng, 2) + passage[:at] + "#%"[k % 2] + passage[at + 1 :] + words(rng, 2))
    made, plain = [], suffix_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        if name == "divided":
            made.append(out.count())
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    got = sorted(suffix_dedup.removal(frame(spark, list(enumerate(texts))), block=64).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in got] == brute_removal(texts, 400)
    assert made and made[0] <= 11 * len(texts)  # windows with no string of their anchor would make it 13.8


def test_every_string_belongs_to_one_context():
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 97 + n, size, dtype=np.uint8) for n, size in ((26, 3000), (2, 2500), (1, 900), (26, 399), (26, 400), (3, 0))]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    data = np.concatenate(texts)
    begins = {k: [] for k in range(len(texts))}
    digests = {}
    for text, at, _, c, left, right in suffix_dedup.text_anchors(data, offsets):
        for k, p, d, a, b in zip(*(v.tolist() for v in (text, at, c, left, right)), strict=True):
            assert 0 <= a <= 336 and 0 <= p - a and p + b <= len(texts[k])
            begins[k] += range(p - a, p + b - 399)
            assert digests.setdefault((a, bytes(texts[k][p - a : p + b])), d) == d
    assert {k: sorted(v) for k, v in begins.items()} == {k: list(range(max(0, len(t) - 399))) for k, t in enumerate(texts)}
    long_ = rng.integers(97, 123, (2 << suffix_dedup.SEGMENT_BITS) + 77, dtype=np.uint8)
    _, at, _, _, left, right = map(np.concatenate, zip(*suffix_dedup.text_anchors(long_, np.array([0, len(long_)])), strict=True))
    begins = np.concatenate([np.arange(p - a, p + b - 399) for p, a, b in zip(at, left, right, strict=True)])
    assert (np.sort(begins) == np.arange(len(long_) - 399)).all()


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_suffix_removal_with_few_letters(spark, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab"[: 1 + k % 2] + "c") * rng.randrange(1, 4) for _ in range(rng.randrange(60))) for k in range(120)]
    texts += [t[: len(t) // 2] + "é" + t[len(t) // 2 :] for t in texts[::3]]
    got = sorted(suffix_dedup.removal(frame(spark, list(enumerate(texts))), least=24, gram=8, block=block).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in got] == brute_removal(texts, 24)


def test_suffix_text_longer_than_a_segment():
    rng = np.random.default_rng(4)
    one = rng.integers(97, 123, 3 << suffix_dedup.SEGMENT_BITS, dtype=np.uint8)
    one[-5000:-3000] = one[1_000_000:1_002_000]
    found = list(suffix_dedup.text_anchors(one, np.array([0, len(one)])))
    at = np.concatenate([f[1] for f in found])
    assert len(set(at.tolist())) == len(at) and (np.diff(np.sort(at)) <= 337).all()
    kinds = np.concatenate([f[3] for f in found])
    assert len(kinds) - len(set(kinds.tolist())) >= 5


def test_merge_sort_and_collisions():
    rng = np.random.default_rng(5)
    sides = [bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(300)]
    group = np.sort(rng.integers(0, 9, 300))
    c = suffix_dedup.Contexts(sides, 12)
    order, shared = c.sorted(group)
    assert [(group[k], sides[k]) for k in order] == sorted((group[k], sides[k]) for k in range(300))
    c.prefix[:] = 0  # every hash collides
    order2, shared2 = c.sorted(group)
    assert [sides[k] for k in order2] == [sides[k] for k in order] and (shared2 == shared).all()


def test_strip_repeats_keeps_characters_whole(spark):
    body = "é" * 300  # 600 bytes
    docs = frame(spark, [(1, "x" + body + "y"), (2, "z" + body), (3, None), (4, "plain")])
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.strip_repeats(docs).collect()}
    assert got[3] is None and got[4] == "plain" and got[1].replace("é", "") == "xy" and got[2].replace("é", "") == "z"
    assert suffix_dedup.strip_repeats(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("block", [6, 4096])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(120):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((len(rows), [float(x) for x in base + rng.normal(scale=0.08, size=8)], int(k % 3)))
    rows += [(len(rows) + k, v, 0) for k, v in enumerate([None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] * 8, [1.0, None] + [1.0] * 6, [1.0, 2.0], [2.0, 4.0]])]
    rows += [(len(rows), rows[0][1], rows[0][2]), (len(rows) + 1, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in epsgrid.near_duplicates(df, block=block).collect()}

    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = []
    for i, a, la in rows:
        for j, b, lb in rows[:i]:
            if la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((i, j))
    want = reach(len(rows), links)
    assert got == {i: (sum(i in p for p in links), want[i]) for i, _, _ in rows}
    assert epsgrid.near_duplicates(df.limit(0)).count() == 0
    assert df.select(F.lit(1)).count() == len(rows)


@pytest.mark.parametrize("band_bits", [None, 19])
def test_similar_documents(spark, band_bits):
    rng = random.Random(8)
    vocabulary = [words(rng, 1) + str(k) for k in range(3000)]

    def shingles(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 300))]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 30):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, list(enumerate(texts))), block=16, band_bits=band_bits).collect()}
    sets = [shingles(t) for t in texts]
    alike = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), i, j) for i in range(len(texts)) for j in range(i - i % 5, i)]
    sure = [(i, j) for s, i, j in alike if s >= 0.85]
    assert len(sure) > 100 and sum(got[i] == got[j] for i, j in sure) >= 0.98 * len(sure)
    assert all(got[i] // 5 == i // 5 for i in got)  # never across the originals
    apart = [(i, j) for s, i, j in alike if s < 0.6]
    assert sum(got[i] == got[j] for i, j in apart) <= 0.05 * len(apart)  # only by way of texts between them
    edge = frame(spark, [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "ONE two")])
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.similar_documents(edge).collect()) == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert simhash.similar_documents(edge.limit(0)).count() == 0


def test_only_verified_pairs_connect():
    # In the first lane C is close to A and B, but apart in the others; A and B are close in all.
    a = np.random.default_rng(9).integers(0, 1 << 63, 16, dtype=np.uint64)
    b = a.copy()
    b[0] ^= np.uint64(0b11)
    c = ~a
    c[0] = a[0] ^ np.uint64(0b1)
    for wide in (np.stack([a, c, b]), np.stack([c, a, b]), np.stack([a, b, c])):
        n, both = np.zeros(3, np.int64), np.ones(3, bool)
        x, y = simhash.linking_pairs(wide[:, 0].copy(), n, both, both, 14, wide, 180)
        assert [sorted((wide[i].tobytes(), wide[j].tobytes())) for i, j in zip(x, y, strict=True)] == [sorted((a.tobytes(), b.tobytes()))]


def test_true_copies_in_a_large_family(spark):
    rng = np.random.default_rng(10)
    # 2,000 texts that share 151 of 200 words (0.6 alike), and a near copy (0.82 alike) of every eighth.
    base = [f"s{k}" for k in range(200)]
    texts, copies = [], []
    for k in range(2000):
        text = base[:151] + [f"u{k}x{j}" for j in range(49)]
        texts.append(" ".join(text))
        if k % 8 == 0:
            copies.append((len(texts) - 1, len(texts)))
            texts.append(" ".join(f"v{k}x{j}" if j in (160, 170, 180, 190) else w for j, w in enumerate(text)))
    order = rng.permutation(len(texts))
    rows = [(int(order[k]), t) for k, t in enumerate(texts)]
    prints = np.stack([simhash.wide_fingerprint(t, 5, 16) for t in texts])
    p = float(np.arccos(1.6 / 1.8) / np.pi)
    limit = int(1024 * p + (1024 * p * (1 - p)) ** 0.5)
    close = [(i, j) for i in range(len(texts)) for j in i + 1 + np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]).sum(1, dtype=np.int64) <= limit)]
    want = reach(len(texts), close)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(frame(spark, rows), block=512).collect()}
    assert len(copies) == 250 and len(set(want)) > 1500
    true = [(i, j) for i, j in copies if want[i] == want[j]]
    assert len(true) > 200 and sum(got[int(order[i])] == got[int(order[j])] for i, j in true) >= 0.98 * len(true)
    by: dict[int, set[int]] = {}
    for k in range(len(texts)):
        by.setdefault(got[int(order[k])], set()).add(want[k])
    assert all(len(v) == 1 for v in by.values())  # nothing is linked beyond verified pairs


def test_one_row_of_each_component_is_kept(spark):
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(None, one), (None, two), (None, two), (4, "x y z"), (4, "other words here"), (4, "x y z"), (7, one + " end"), (8, None), (None, None), (9, two[:-1] + "!")]
    docs = frame(spark, rows)
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_representatives(docs, simhash.similar_documents(docs)).collect()]
    assert sorted(got, key=str) == sorted([(4, "x y z"), (4, "other words here"), (7, one + " end"), (8, None), (9, two[:-1] + "!")], key=str)
    alone = docs.filter("doc_id is null and text is not null")
    assert sorted(r["text"] for r in simhash.keep_representatives(alone, simhash.similar_documents(alone)).collect()) == [one, two]
    none = docs.limit(0)
    assert simhash.keep_representatives(none, simhash.similar_documents(none)).columns == docs.columns


def test_columns_of_any_name_and_type_pass_the_stages(spark):
    docs = frame(spark, [(None, "word " * 30 + str(k)) for k in range(3)])
    docs = docs.selectExpr("doc_id", "text", "rid", "fp AS h", "'y' AS row", "map('a', 1) AS doc", "2 AS body", "3 AS size", "4 AS ranges", "5 AS new", "6 AS component")
    kept = simhash.keep_representatives(docs, simhash.similar_documents(docs))
    assert kept.columns == docs.columns and kept.count() >= 1
    left = suffix_dedup.strip_repeats(docs, least=100)
    assert left.columns == docs.columns and {str(r[2:]) for r in left.collect()} == {str(r[2:]) for r in docs.collect()}
