"""Mixing, sharding, url filters and the pipeline."""

import bisect
import hashlib
import os
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.llm import linkgraph, mixing, ring

FOLDER = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, h int")


def test_targets():
    t = mixing.fill_targets([("a", 100), ("b", 10), (None, 50)], (5, 2, 1), 3)
    assert sum(t) == 160 and t[1] == 30 and t[0] == Fraction(130 * 5, 6)
    assert mixing.fill_targets([], (5, 2, 1), 3) == []
    assert mixing.fill_targets([("a", 0), ("b", 7)], (5, 2, 1), 3) == [0, 7]


@pytest.mark.parametrize("bits", [1, 12])
def test_mix(spark, bits):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randrange(0, 30), rng.choice(["a", "a", "a", "b", None])) for k in range(600)]
    rows += [(k, "w " * 40, "c") for k in range(700, 705)] + [(9, "w w", "a"), (9, "w w", "a"), (None, None, "b"), (800, None, "empty")]
    got = mixing.mix(docs(spark, rows), bits=bits).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs(spark, rows), bits=12).collect()), key=str)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 45 for taken, target, _ in by.values())
    assert abs(sum(t for _, t, _ in by.values()) - sum(r["size"] for r in got)) < 1e-6
    assert by["empty"] == [0, 0.0, 0]
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0
    named = docs(spark, rows).selectExpr("*", "1 AS size", "2 AS copies", "3 AS target", "4 AS carried")
    columns = ["doc_id", "text", "source", "h", "size", "copies", "target", "carried"]
    out = mixing.repeat_rows(mixing.mix(named, carry=tuple(c for c in columns if c not in ("doc_id", "source"))), columns)
    assert out.columns == columns and out.count() == sum(r["copies"] for r in got)
    assert {tuple(r)[3:] for r in out.collect()} == {(5, 1, 2, 3, 4)}


def test_a_larger_rest_keeps_the_smaller_ones_documents(spark):
    base = docs(spark, [(k, "w w w", "a") for k in range(500)] + [(1000 + k, "w", "b") for k in range(1500)])
    few = {r["doc_id"] for r in mixing.mix(base, weights=(1, 3)).collect() if r["source"] == "a" and r["copies"]}
    more = {r["doc_id"] for r in mixing.mix(base, weights=(1, 2)).collect() if r["source"] == "a" and r["copies"]}
    assert few < more


def test_pour_fills_evenly():
    points = [(k, k % 3) for k in range(12)]
    for loads in ({0: 100}, {k: 7 for k in range(12)}, {}, {11: 5, 2: 1}):
        segments = ring.pour(points, loads, 3)
        total = sum(loads.values())
        counts = [sum(s["to_"] - s["from_"] for s in segments if s["shard"] == k) for k in range(3)]
        assert sum(counts) == total and max(counts) - min(counts) <= 1
        for arc, n in loads.items():
            spans = sorted((s["from_"], s["to_"]) for s in segments if s["arc"] == arc)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring(spark, slack):
    rows = [(k, f"t{k}", "s") for k in range(1000)] + [(5, "t5", "s")] * 300 + [(None, None, None), (None, "x", "s")]
    got = ring.shard_rows(docs(spark, rows).repartition(4), slack=slack, slice_rows=64).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    if not slack:
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        assert max(map(len, by.values())) <= 1.25 * len(rows) / 8 + 2
    again = ring.shard_rows(docs(spark, rows).repartition(3), slack=slack, slice_rows=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert ring.shard_rows(docs(spark, rows).limit(0)).count() == 0
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(1, 0), (2, 2363233923)}


def brute_ring(rows, shards=8, nodes=64):
    """(shard, slot) counts of a ring walked row by row: each arc's rows in order, own rows first, the rest clockwise."""
    h60 = lambda *parts: int(hashlib.md5("|".join(map(str, ("0", *parts))).encode()).hexdigest()[:15], 16)
    points = sorted((h60("node", n % shards, n), n % shards) for n in range(shards * nodes))
    arcs = [[] for _ in points]
    for doc_id, text, _ in rows:
        crc = zlib.crc32((text or "").encode())
        h = h60("~" if doc_id is None else doc_id, crc)
        at = bisect.bisect_left(points, (h, -1)) % len(points)
        arcs[at].append((h, -1 if doc_id is None else doc_id, len((text or "").encode()) + 1, crc))
    room, taken, over, out = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)], [0] * shards, [], []

    def put(row, shard):
        out.append((*row[1:], shard, taken[shard]))
        room[shard] -= 1
        taken[shard] += 1

    for at, arc in enumerate(arcs):
        for row in sorted(arc):
            if room[points[at][1]]:
                put(row, points[at][1])
            else:
                over.append((at, row))
    for at, row in over:
        while not room[points[at][1]]:
            at = (at + 1) % len(points)
        put(row, points[at][1])
    return out


def test_ring_equals_a_walk_row_by_row(spark):
    rng = random.Random(11)
    rows = [(k, f"t{rng.randrange(400)}", "s") for k in range(1500)] + [(7, "t7", "s")] * 250 + [(None, None, None), (None, "é", "s")]
    got = ring.shard_rows(docs(spark, rows).repartition(5), slice_rows=100).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(brute_ring(rows))


def test_ring_spreads_counts_by_pieces(spark, monkeypatch):
    rows = [(k, f"t{k}", "s") for k in range(50)] + [(7, "t7", "s")] * 800 + [(None, None, None)] * 77
    monkeypatch.setattr(ring, "SPREAD", 5)  # pieces of 125, 25 and 5
    got = ring.shard_rows(docs(spark, rows).repartition(5), slice_rows=100).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == sorted(brute_ring(rows))


def test_ring_of_millions_of_equal_rows(spark):
    from pyspark.sql import functions as F

    n = 4_000_000
    same = spark.range(n, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = ring.shard_rows(same).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("top"), F.approx_count_distinct("slot").alias("about")).collect()
    assert {r["n"] for r in got} == {n // 8} and {r["top"] for r in got} == {n // 8 - 1} and min(r["about"] for r in got) > n // 9


def test_every_stage_passes_columns_of_any_name(spark):
    import corpus_pipeline

    text = " ".join(f"word{k} runs over the other{k} field." for k in range(40))
    rows = [(k, f"{text} {k}" if k % 2 else " ".join(f"t{k}x{j} and more." for j in range(60)), f"s{k % 3}", k, "c", k, "e`f") for k in range(12)]
    named = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` long, carried string, doc long, `e``f` string").selectExpr("*", "'en' AS lang", "cast(length(text) AS long) AS n_chars")
    frame = named
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == named.columns
        assert all(r["a.b"] == r["doc"] == r["doc_id"] and r["carried"] == "c" for r in frame.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()


RULES = [("com", "/", "allow"), ("bad.com", "/x/", "block"), ("net", "/", "block")]


def test_urls(spark):
    a = lambda *hosts: "".join(f'<p><A class=l href="http://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://Good.COM/x?q", a("mid.org")), (2, "https://bad.com/x/1#f", None), (3, "https://a.bad.com/y", ""), (4, "http://evil.net/z", None),
        (5, "http://mid.org", a("far.org")), (6, "http://far.org/", None), (7, "http://pal.org/a", a("evil.net", "evil.net")), (8, None, "x"), (9, "no scheme", None), (10, "http://com?x", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in linkgraph.judge_urls(df, RULES).collect()}
    assert got[1] == ("good.com", "/x", "com/", "allow") and got[2] == ("bad.com", "/x/1", "bad.com/x/", "block") and got[3][2:] == ("com/", "allow")
    assert got[4] == ("evil.net", "/z", "net/", "block") and got[5] == ("mid.org", "", None, "allow") and got[6][3] == "allow"
    assert got[7] == ("pal.org", "/a", None, "block")  # it links to a blocked host only
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10] == ("com", "", None, "allow")
    assert linkgraph.judge_urls(df.limit(0), RULES).count() == 0


def test_propagation_equals_a_dense_iteration(spark):
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0), ("d", 0.2, 0.3)], "host string, trust double, distrust double")
    links = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("d", "a", 5)], "src string, dst string, n long")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in linkgraph.propagate(seeds, links, rounds=12).collect()}
    s = {"a": (1.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 1.0), "d": (0.2, 0.3)}
    along = {("a", "b"): 0.75, ("a", "c"): 0.25, ("b", "c"): 1.0, ("d", "a"): 1.0}
    against = {("a", "b"): 1.0, ("a", "c"): 1 / 3, ("b", "c"): 2 / 3, ("d", "a"): 1.0}
    now = dict(s)
    for _ in range(12):
        t = {h: sum(now[x][0] * w for (x, y), w in along.items() if y == h) + (now[h][0] if h == "c" else 0) for h in s}
        d = {h: sum(now[y][1] * w for (x, y), w in against.items() if x == h) + (now[h][1] if h == "d" else 0) for h in s}
        now = {h: (0.15 * s[h][0] + 0.85 * t[h], 0.15 * s[h][1] + 0.85 * d[h]) for h in s}
    assert all(abs(got[h][k] - now[h][k]) < 1e-9 for h in s for k in (0, 1))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first = p.STAGES[0][1](spark, table, FOLDER)
    good = {r["doc_id"] for r in first.collect()}
    assert first.columns == table.columns and 0 < len(good) <= table.count()
    kept = p.near_duplicates(spark, first, FOLDER)
    assert {r["doc_id"] for r in kept.collect()} <= good
    out = p.run(spark, FOLDER)
    rows = out.select("doc_id", "n_tokens", "round_trip").collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] for r in rows)
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "some words " * 3, "en", "s", 3)], table.schema)
    for docs_ in (odd, table.limit(0)):
        now = docs_
        for _, stage in p.STAGES:
            now = stage(spark, now, FOLDER)
        assert now.count() == 0


def test_verdicts_do_not_depend_on_degree(spark):
    a = lambda *hosts: "".join(f'<a href="http://{h}/p">t</a>' for h in hosts)
    rows = [(k, f"http://bad.com/x/{k}", None) for k in range(9)] + [(9, "http://bad.com/y", None), (10, "http://evil.net/z", None)]
    rows += [(100 + k, f"http://fan{k}.org/", a("evil.net")) for k in range(40)]  # a blocked hub with many linkers
    rows += [(200, "http://one.org/", a("bad.com")), (201, "http://fair.org/", a("evil.net", "p.org", "q.org")), (202, "http://p.org/", a("q.org")), (203, "http://q.org/", a("p.org"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("bad.com", "/x/", "block"), ("net", "/", "block")]
    got = {r["page_id"]: r for r in linkgraph.judge_urls(df, rules).collect()}
    assert got[9]["rule"] is None and got[9]["verdict"] == "block" and got[9]["host_score"] >= 0.9  # although one.org links to it
    assert all(got[100 + k]["verdict"] == "block" and abs(got[100 + k]["host_score"] - 0.85) < 1e-3 for k in range(40))
    assert got[200]["verdict"] == "block" and all(got[k]["verdict"] == "allow" for k in (201, 202, 203))


def test_propagation_blocks_and_rescues_over_two_hops(spark):
    a = lambda *hosts: "".join(f'<a href="http://{h}/p">t</a>' for h in hosts)
    rows = [(1, "http://evil.net/", None), (2, "http://near.org/", a("evil.net")), (3, "http://far.org/", a("near.org")), (4, "http://also.org/", a("near.org", "evil.net"))]
    rows += [(5, "http://good.com/", a("kept.org")), (6, "http://kept.org/", a("evil.net")), (7, "http://lost.org/", a("evil.net"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["host_score"]) for r in linkgraph.judge_urls(df, [("net", "/", "block"), ("com", "/", "allow")]).collect()}
    assert [got[k][0] for k in (2, 3, 4, 7)] == ["block"] * 4 and abs(got[3][1] - 0.85**2) < 1e-3
    assert got[6][0] == "allow" and abs(got[6][1]) < 1e-3  # a trusted host vouches for it
    for most in (0, 500_000):
        pages = df.select("page_id", linkgraph.host_of(F.col("url")).alias("host"), F.lit("/").alias("path"))
        assert linkgraph.with_host_rows(pages, pages.select("host", F.length("host").alias("n")), most).filter("n = length(host)").count() == 7


def test_passages_of_fifty_five_words_go_and_clean_texts_stay(spark):
    import corpus_pipeline as p

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghinorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [prose(55) for _ in range(25)]
    rows = []
    for k in range(300):
        parts = [prose(rng.randrange(60, 200)), prose(rng.randrange(60, 200))]
        if k < 100:
            parts.insert(1, passages[k % 25])
        rows.append((k, " ".join(parts), "en", "s", 0))
    got = {r["doc_id"]: r["text"] for r in p.repeated_strings(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert sum(passages[k % 25] not in got[k] for k in range(100)) >= 90
    assert sum(got[k] == rows[k][1] for k in range(100, 300)) >= 0.97 * 200
