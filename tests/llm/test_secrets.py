"""The secret scan against regular expressions applied one by one."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import secret_scan as ss
from millrace.llm.queries import OP13_SQL, op13_secret_scan

WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: kind, pattern whose last group is counted, least count
RULES = [
    ("assign", rf"(?:{WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"AKIA([A-Z0-9]+)", 14),
    ("hex", r"([0-9a-f]+)", 16),
    ("private_key", r"-----BEGIN (?:|RSA |EC |DSA |OPENSSH |ENCRYPTED )(PRIVATE KEY-----)", 1),
    ("code_host", r"gh[pousr]_([A-Za-z0-9]+)", 36),
    ("chat", r"xox[abprs]-([A-Za-z0-9-]+)", 10),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8),
    ("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$%&*+=-]+(@)", 1),
]


def brute(text):
    found = []
    for k, (_, pattern, least) in enumerate(RULES):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return [(a, e, k) for a, k, e in sorted(found)]


def scanned(texts):
    auto = ss.compile_rules()
    raw = [t.encode() for t in texts]
    return [ss.in_code_points(b, f) for b, f in zip(raw, ss.find(auto, raw), strict=True)]


PIECES = ["token", "Secret", "PASSWORD", "passwd", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "-", "ghp_", "a" * 36, "xoxb-", "12345-67890", "eyJ", "abc.", ".", "://", "user", "@", "é", "ſecret", "\n", ",", "日本", "x", "+/"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=6))
def test_scan_equals_rules_one_by_one(texts):
    assert scanned(texts) == [brute(t) for t in texts]


def test_failed_matches_use_up_their_bytes():
    text = "secret= password: abcdefghijklmnop"
    assert brute(text) == [] and scanned([text]) == [[]]
    text = "secret = \"abcdefghijkl\" token='x' token=abcdefghijklm"
    assert scanned([text]) == [brute(text)] and len(brute(text)) == 2


def test_long_texts_and_borders():
    rng = random.Random(3)
    long_ = "".join(rng.choice(PIECES) for _ in range(60_000))
    texts = ["", "token = deadbeefdeadbeef", "deadbeefdeadbeef" * 9, "0" * 300_000, "token" + " " * 200_000 + "=" + "a" * 12, long_, "AKIA" * 5000, ""]
    assert scanned(texts) == [brute(t) for t in texts]


def test_the_automaton_is_minimal_and_small():
    auto = ss.compile_rules()
    rows = np.column_stack([auto.accepting, auto.next])
    assert len(np.unique(rows, axis=0)) == len(rows) <= auto.unmerged  # no two states of equal moves are left
    assert auto.next.nbytes < 4 << 20
    assert auto.group[ord("a")] != auto.group[ord("z")] and auto.group[200] == auto.group[1]


@pytest.mark.parametrize(
    "rule",
    [
        ss.Rule("stops", ((ss.Part(b"a"),),), (ss.Part(b"b", 0), ss.Part(b"c", 0), ss.Part(b"e", 0, 2), ss.Part(b"d", 1, None))),
        ss.Rule("later", ((ss.Part(b"ab", 0, None), ss.Part(b"x")),), (ss.Part(b"y"),)),
    ],
)
def test_other_rules(rule):
    auto = ss.compile_rules((rule,))
    parts = [*rule.heads[0], *rule.tail]
    pattern = "".join(f"[{p.of.decode()}]" + ("*" if p.high is None and not p.low else "+" if p.high is None else f"{{{p.low},{p.high}}}") for p in parts)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefxy") for _ in range(40)) for _ in range(300)]
    assert [[(a, e) for a, e, _ in f] for f in ss.find(auto, [t.encode() for t in texts])] == [[m.span() for m in re.finditer(pattern, t)] for t in texts]


def test_rules_that_one_pass_cannot_decide_are_refused():
    inner = ss.Rule("inner", (ss.word("abcy"), ss.word("b")), (ss.Part(b"c"),))
    open_end = ss.Rule("open", (ss.word("a"),), (ss.Part(b"x", 0),))
    for rule in (inner, open_end):
        with pytest.raises(ValueError):
            ss.compile_rules((rule,))


def test_whole_query(spark, tmp_path):
    import duckdb

    rng = random.Random(7)
    texts = [None, "", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(300))]
    rows = [(k if k % 7 else None, t, 1, "x") for k, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, found int, b string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_secret_scan(spark, str(tmp_path)).collect()
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got) == sorted(map(str, sql.sql(f"SELECT {', '.join(cols)} FROM ({OP13_SQL})").fetchall()))
    by = {}
    for r in got:
        by.setdefault(r["spans"], r)
    for t in texts:
        spans = brute(t or "")
        r = by[",".join(f"{RULES[k][0]}:{a}:{e}" for a, e, k in spans)]
        base = ",".join(f"{RULES[k][0]}:{a}:{e}" for a, e, k in spans if k < 3)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, _, k in spans) for i in range(3))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op13_secret_scan(spark, str(tmp_path)).count() == 0
