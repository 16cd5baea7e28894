"""Conversation repair against a brute-force search, and its edge cases."""

import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import conversations as conv
from millrace.llm.queries import OP12_SQL, op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """(cost, audit, lines) of the cheapest repair of (role, fault, text), by trying all edits, with up to two turns inserted at a place."""
    best = None
    kinds = [["D"] if f in ("blank", "duplicate") else ["D", "Ru", "Ra"] + ["K"] * bool(role) for role, f, _ in turns]
    gaps = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    for plan in itertools.product(*kinds):
        for ins in itertools.product(gaps, repeat=len(turns) + 1):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(turns) + 1):
                for x in ins[k]:
                    cost, audit, roles = cost + 5, audit + "I", roles + x
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k < len(turns):
                    role, f, text = turns[k]
                    audit += plan[k][0]
                    cost += {"D": 2, "K": 0, "R": 1}[plan[k][0]] + (5 if f == "truncated" and plan[k] != "D" else 0)
                    if plan[k] != "D":
                        role = {"K": role, "Ru": "user", "Ra": "assistant"}[plan[k]]
                        roles += role[:1]
                        lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def marked(turns):
    """Faults of (role, text) in order."""
    seen, out = set(), []
    for role, text in turns:
        cut = text.rstrip(" \t\n\x0b\x0c\r")
        f = "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, f, text))
    return out


CASES = [
    [("user", "a."), ("assistant", "b.")],
    [("system", "x.")],
    [("system", "x."), ("assistant", "b."), ("user", "c")],
    [("user", "a."), ("user", "a."), ("assistant", " \n")],
    [("assistant", "a!"), ("user", "b?"), ("assistant", "c. ")],
    [("user", "a."), ("assistant", "b."), ("system", "c.")],
    [("tool", "a."), ("", "b.")],
    [("user", "a"), ("assistant", "b ")],
]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_repair_equals_brute_force(spark, block):
    rows = [(k, t, role, text) for k, turns in enumerate(CASES) for t, (role, text) in enumerate(turns)]
    summary, out = conv.repair(spark.createDataFrame(rows, SCHEMA), block=block)
    got = {r["conv_id"]: r for r in summary.collect()}
    sha = {r["conv_id"]: r["sha"] for r in conv.text_digests(out).collect()}
    for k, turns in enumerate(CASES):
        cost, audit, lines = brute(marked(turns))
        assert (got[k]["cost"], got[k]["audit"]) == (cost, audit), turns
        assert sha.get(k) == (hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.sampled_from(["a.", "b.", "c", " "])), min_size=1, max_size=3), min_size=10, max_size=10))
def test_many_repairs_equal_brute_force(spark, cases):
    rows = [(k, t, role, text) for k, turns in enumerate(cases) for t, (role, text) in enumerate(turns)]
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in conv.repair(spark.createDataFrame(rows, SCHEMA), block=2)[0].collect()}
    assert got == {k: brute(marked(turns))[:2] for k, turns in enumerate(cases)}


def test_damage(spark):
    rows = [(c, t, r, "Yes. No!") for c in (None, 1, 2) for t in (None, 1, 2, 3, 4, 5, 6, 7) for r in (None, "system")]
    got = conv.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if d == 4 else " " if r is None else r
        want += [(c, t, role, "" if d == 1 else "Yes No" if d == 2 else x)] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(map(str, got)) == sorted(str(spark_row) for spark_row in map(lambda w: _row(*w), want))


def _row(c, t, role, text):
    from pyspark.sql import Row

    return Row(conv_id=c, turn=t, role=role, text=text)


def _tables(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, SCHEMA + ", block long, `a.b` long")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def _sql(folder):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return sorted(map(str, c.sql(OP12_SQL).fetchall()))


def test_whole_query_with_nulls_ties_and_long_conversations(spark, tmp_path):
    rows = [(c, t, r, x, 1, 2) for c in (None, 1, 2) for t in (None, 1, 1, 5) for r in (None, "user", "system", "assistant") for x in (None, "", "hm", "Yes.", "No! ")]
    rows += [(7, k, ["user", "assistant", "system", "user"][k % 4], f"text {k % 90}" + "." * (k % 3), 1, 2) for k in range(700)]
    rows += [(9, 1, "user", "x" * 400_000 + " " * 400_000, 1, 2)]
    folder = _tables(spark, tmp_path, rows)
    got = op12_conversation_repair(spark, folder)
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == _sql(folder)


def test_dropped_and_empty_conversations(spark, tmp_path):
    gone = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    got = op12_conversation_repair(spark, _tables(spark, tmp_path / "a", [(gone[0], 0, "user", "x.", 1, 2)])).collect()
    assert [(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got] == [(gone[0], 0, "", hashlib.sha256(b"").hexdigest())]
    assert op12_conversation_repair(spark, _tables(spark, tmp_path / "b", [])).count() == 0


def test_a_block_bounds_what_meets_in_a_row(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(5000)]
    summary, out = conv.repair(spark.createDataFrame(rows, SCHEMA), block=64)
    assert summary.first()["audit"] == "K" * 5000
    assert max(r[0] for r in out.selectExpr("size(rows)").collect()) == 64
    want = hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows).encode()).hexdigest()
    assert [r["sha"] for r in conv.text_digests(out).collect()] == [want]
