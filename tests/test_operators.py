"""Relational operators against brute force and on edge cases."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import aggregates, filters, graph, joins, ranking, sets, versioning

T0 = dt.datetime(2024, 1, 1)
intervals = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400), st.integers(0, 300)), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(intervals)
def test_overlap_pairs(spark, items):
    rows = [(k, i, T0 + dt.timedelta(minutes=s), T0 + dt.timedelta(minutes=s + n)) for i, (k, s, n) in enumerate(items)]
    df = spark.createDataFrame(rows, "k int, id int, s timestamp_ntz, e timestamp_ntz")
    got = {(r["id_a"], r["id_b"]) for r in joins.overlap_pairs(df, ["k"], "id", "s", "e").collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}


def test_exclude_keeps_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert sorted(r["k"] or 0 for r in joins.exclude(a, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]).collect()) == [0, 2]
    assert joins.exclude(a, a.limit(0), ["k"]).count() == 3


def test_keyed_diff_nulls(spark):
    old = spark.createDataFrame([(1, None), (2, "a"), (3, "x")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, None), (4, "y")], "k int, v string")
    assert {r["k"]: r["status"] for r in sets.keyed_diff(old, new, "k", ["v"]).collect()} == {1: "same", 2: "changed", 3: "removed", 4: "added"}


def test_scd2_twice_is_idempotent(spark):
    day = F.lit("2024-02-01").cast("date")
    current = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), None), (2, "b", dt.date(2024, 1, 1), None)], "k int, v string, valid_from date, valid_until date")
    batch = spark.createDataFrame([(1, "c"), (3, "d")], "k int, v string")
    once = versioning.scd2_publish(current, batch, "k", ["v"], day)
    assert sorted(map(tuple, versioning.scd2_publish(once, batch, "k", ["v"], day).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert once.count() == 4


def test_dedupe_and_fold(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, None)], "k string, pos int, v string")
    assert {(r["k"], r["v"]) for r in ranking.dedupe_first(df, ["k"], F.col("pos")).collect()} == {("a", "x"), ("b", None)}
    last = ranking.dedupe_last(df, ["k"], F.col("pos")).collect()
    assert {(r["k"], r["v"], r["first_position"]) for r in last} == {("a", "y", 1), ("b", None, 3)}
    ops = spark.createDataFrame([(1, "e", "add", 1), (1, "e", "add", 2), (2, "e", "drop", 3)], "op int, ent string, kind string, pos int")
    assert tuple(versioning.fold_ops(ops, "op", "ent", "kind", "pos", "drop").first()) == ("e", 2, "drop", True)


def test_two_hop_paths_are_simple(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "c", "y"), ("c", "c", "z")], "s string, d string, l string")
    assert [tuple(r) for r in graph.two_hop_paths(e, "s", "d", "l").collect()] == [("a", "b", "c", "x>y")]


def test_facets_and_filters(spark):
    df = spark.createDataFrame([("r", "s"), ("r", ""), ("b", "unknown"), (None, "s")], "c string, z string")
    counts = {(r["facet"], r["value"]): r["n"] for r in aggregates.facet_counts(df, ["c", "z"]).collect()}
    assert counts == {("c", "r"): 2, ("c", "b"): 1, ("z", "s"): 2}
    loo = {(r["facet"], r["value"]): (r["n"], r["active"]) for r in aggregates.leave_one_out(df, {"c": ["b"], "z": ["s"]}).collect()}
    assert loo[("c", "b")] == (0, True) and loo[("c", "r")] == (1, False)
    assert df.filter(filters.predicate(filters.Spec())).count() == 4
    assert df.filter(filters.predicate(filters.Spec(allowed={"c": ["r"]}, words="s", text=("z",)))).count() == 1
    assert filters.split_list(" a,b,,a ") == ["a", "b"]


def test_mutual_and_either(spark):
    p = spark.createDataFrame([(1, 1), (2, 2), (2, 3)], "a int, b int")
    assert [tuple(r) for r in joins.mutually_unique(p, "a", "b").collect()] == [(1, 1)]
    n = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.either_key(p, n, "a", "b", "k").count() == 3
