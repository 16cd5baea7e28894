"""Matching-block ratios against the standard library, and the join against all pairs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from millrace.functions import fuzzy
from millrace.operators import fuzzy as joins


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def varied(rng, n, letters="abcd e", top=24):
    out = {"", "a", "ab", "aaaa", "aaaaaa", "abababab", "babababa"}
    while len(out) < n:
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(1, top)))
        out.add(base)
        for _ in range(3):
            k = rng.randrange(len(base))
            out.add(rng.choice([base[:k] + rng.choice(letters) + base[k + 1 :], base[:k] + base[k + 1 :], base[:k] + "xy" + base[k:], base[k:] + base[:k]]))
    return sorted(out)


def test_ratio_equals_the_standard_library(spark):
    rng = random.Random(4)
    texts = varied(rng, 150, "abcé x")
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(400)] + [("", ""), (None, "a"), ("tide", "diet"), ("x" * 60, "x" * 59 + "y"), ("abc" * 100, "acb" * 100)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", fuzzy.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["r"] == (None if r["a"] is None else plain(r["a"], r["b"])), (r["a"], r["b"])


def test_join_finds_all_pairs(spark):
    rng = random.Random(9)
    for least in (0.7, 0.82, 0.9):
        left, right = [(rng.choice(["en", None]), t) for t in varied(rng, 60)], [(rng.choice(["en", None]), t) for t in varied(rng, 60, top=16)]
        frame = lambda rows: spark.createDataFrame(sorted(set(rows), key=str), "g string, text string")
        got = {(r["g"], r["a"], r["b"], r["ratio"]) for r in joins.similar_texts(frame(left), frame(right), ["g"], least).collect()}
        assert got == {(g, a, b, plain(a, b)) for g, a in left for h, b in right if g == h and a != b and plain(a, b) >= least}


def test_matches_and_mutual_pairs(spark):
    left = [("s1", "evening trivia by the pool"), ("s1", "campfire"), ("s1", "arts and crafts"), ("s2", "campfire"), ("s1", "yoga on the lawn")]
    right = [("s1", "evening trivia by the pol"), ("s1", "campfire"), ("s1", "arts und crafts"), ("s1", "arts an crafts"), ("s1", "yoga on the lawns")]
    l, r = (spark.createDataFrame(rows, "g string, text string") for rows in (left, right))
    got = {(x["g"], x["text"]): (x["match"], x["how"]) for x in joins.matched(l, r, ["g"]).collect()}
    assert got == {("s1", "campfire"): ("campfire", "exact"), ("s1", "evening trivia by the pool"): ("evening trivia by the pol", "fuzzy"), ("s1", "arts and crafts"): ("arts an crafts", "fuzzy"), ("s1", "yoga on the lawn"): ("yoga on the lawns", "fuzzy")}
    pairs = {(x["a"], x["b"]) for x in joins.mutual(l, r, ["g"], 0.9).collect()}
    assert pairs == {("evening trivia by the pool", "evening trivia by the pol"), ("yoga on the lawn", "yoga on the lawns")}
    assert joins.matched(l.limit(0), r, ["g"]).count() == 0


def test_support(spark):
    rows = [
        ("Movie Under the Stars", "movie under the stars 8 pm", True, True),
        ("Movie Under the Stars", "m0vie under the stars", False, True),
        ("Movie Under the Stars", "mov ie un der the st ars", True, True),
        ("Movie Under the Stars", "mo vie un der t he sta s", True, True),
        ("Bingo & Cards", "bingo and cards", True, True),
        ("Tie Dye", "t|e dye", True, True),
        ("Campfire", "pool party", False, False),
        ("", "x", False, False),
        (None, None, False, False),
    ]
    frame = spark.createDataFrame(rows, "t string, s string, title boolean, field boolean")
    got = frame.select("t", "s", fuzzy.supports_title(F.col("t"), F.col("s")).alias("a"), "title", fuzzy.supports_field(F.col("t"), F.col("s")).alias("b"), "field").collect()
    assert [(r["t"], r["s"], r["a"], r["b"]) for r in got] == [(r["t"], r["s"], r["title"], r["field"]) for r in got]


def test_join_shuffles_texts_and_no_pairs(spark):
    frame = spark.createDataFrame([("s", f"title number {n} of a long list") for n in range(300)], "g string, text string")
    found = joins.candidates(frame, frame, ["g"], 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Exchange" in plan
    assert found.count() == joins.similar_texts(frame, frame, ["g"], 0.9).count() == 300 * 299


def test_blocks_of_long_texts_equal_the_standard_library():
    rng, matched = random.Random(5), joins._matcher()
    for n, letters in ((700, "abcdefgh é"), (1500, "ab 😀"), (900, "a")):
        a = "".join(rng.choice(letters) for _ in range(n))
        for b in (a[: n // 3] + "xy" + a[n // 3 :], a[n // 2 :] + a[: n // 2], "".join(rng.choice(letters) for _ in range(n)), a.replace("b", "", 40)):
            assert 2.0 * matched(a, b) / (len(a) + len(b)) == plain(a, b)


def test_join_over_several_blocks_finds_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 7)
    monkeypatch.setattr(joins, "CHARACTERS", 60)
    texts = varied(random.Random(11), 120, "abcé x", 40)
    frame = spark.createDataFrame([(None, t) for t in texts], "g string, text string")
    got = {(r["a"], r["b"], r["ratio"]) for r in joins.similar_texts(frame, frame, ["g"], 0.82).collect()}
    assert got == {(a, b, plain(a, b)) for a in texts for b in texts if a != b and plain(a, b) >= 0.82}
