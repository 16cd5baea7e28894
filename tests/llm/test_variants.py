"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from millrace.llm import variants as vs
from millrace.llm.queries import OP11_SQL, op11_spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found(frame):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    counts = {}
    for stem in stems:
        for _ in range(8):
            k = rng.randrange(len(stem))
            w = rng.choice([stem, stem[:k] + rng.choice("abcdéÿ×") + stem[k + 1 :], stem[:k] + stem[k + 1 :], stem[:k] + rng.choice("abz") + stem[k:], stem[::-1]])
            counts[w] = rng.choice([3, 4, 6, 8, 12, 100])
    assert found(vs.spelling_variants(spark.createDataFrame([*counts.items()], "word string, n long"))) == brute(counts)


def test_anagrams_meet_and_are_told_apart(spark):
    """Thousands of orders of the same letters share a key; none of them are near, but each is near its own longer word."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(1500)}
    counts = dict.fromkeys(words, 5) | {w + "z": 20 for w in sorted(words)[:300]}
    near = {r["word"]: r["n_near"] for r in vs.near_words(spark.createDataFrame([*counts.items()], "word string, n long")).collect()}
    assert near == {w: len(x) for w in counts if (x := [v for v in ([w[:-1]] if w[-1] == "z" else [w + "z"]) if v in counts])}


def test_doubled_letters_and_chains(spark):
    counts = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaab": 24, "aaaaabb": 48, "aaaabbb": 96, "lettter": 3, "letter": 9, "leter": 4, "abcde": 7, "abced": 90}
    assert found(vs.spelling_variants(spark.createDataFrame([*counts.items()], "word string, n long"))) == brute(counts)


def test_long_chain_of_forms(spark):
    forms = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(62)]
    got = {r["word"]: r["root"] for r in vs.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w062" for w, _ in forms}


def test_whole_query_with_nulls_long_words_and_clashing_names(spark, tmp_path):
    import duckdb

    rng = random.Random(2)
    words = [w for _ in range(40) for w in [("".join(rng.choice("abcdeÉé×") for _ in range(rng.randrange(4, 8))))]]
    words += [w[:-1] + rng.choice("abé") for w in words] + ["Straße", "straße", "STRAßE", "ÀÉÎÕÜ", "Ÿabcd"]
    rows = [(None if k % 9 == 0 else k, None if k % 50 == 0 else "-".join(rng.choice(words) for _ in range(30)) + rng.choice(["", " — x1y2", "\n\n"])) for k in range(200)]
    rows += [(1000 + k, "x" * 3000 + rng.choice("yz")) for k in range(12)] + [(5, ""), (5, "")]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, word int, `n.key` string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = found(op11_spelling_variants(spark, str(tmp_path)))
    assert got == brute(counted(rows))
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(sql.sql(OP11_SQL).fetchall()) == got


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op11_spelling_variants(spark, str(tmp_path)).count() == 0
