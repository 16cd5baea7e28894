"""Operators on small tables: nulls, ties, repeated rows, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import forecast, schedules, titles, zoned
from millrace.operators import browse, evidence, graph, graphdoc, joins, lists, payloads, ranking, recurrence, search, sets, versioning
from millrace.sources import readers

ZONE = "America/New_York"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def test_zones_over_changes_of_offset(spark):
    assert one(spark, zoned.iso(ntz("2024-03-10 06:59:59"), ZONE)) == "2024-03-10T01:59:59-05:00"
    assert one(spark, zoned.iso(ntz("2024-03-10 07:00:00"), ZONE)) == "2024-03-10T03:00:00-04:00"
    assert one(spark, zoned.at_time(F.lit("2024-11-03").cast("date"), F.lit("8:5"), ZONE)) == dt.datetime(2024, 11, 3, 13, 5)
    assert one(spark, zoned.add_days(F.lit("2024-03-09").cast("date"), 1, ZONE)) == dt.date(2024, 3, 10)
    assert one(spark, zoned.day_end(F.lit("2024-11-03").cast("date"), ZONE)) == dt.datetime(2024, 11, 4, 4, 59, 59)
    assert one(spark, zoned.at_time(F.lit("2024-01-01").cast("date"), F.lit("noon"), ZONE)) is None
    assert one(spark, zoned.iso(F.lit(None).cast("timestamp_ntz"), ZONE)) is None
    assert one(spark, zoned.iso(ntz("2024-01-01 00:00:00"), "Asia/Kolkata")) == "2024-01-01T05:30:00+05:30"


@pytest.mark.parametrize(
    ("text", "evening", "want"),
    [("7:00 - 9:30 pm", False, (1140, 1290)), ("8:30PM", False, (1230, None)), ("9:15", True, (1275, None)), ("12:00 a.m.", False, (0, None)), ("25:00", False, None), (None, False, None), ("", True, None)],
)
def test_time_ranges(spark, text, evening, want):
    got = one(spark, schedules.time_range(F.lit(text).cast("string"), evening))
    assert (got and (got["start"], got["finish"])) == want


@pytest.mark.parametrize(
    ("text", "kind", "days", "start", "finish", "segments"),
    [
        ("daily 9 am to 5 pm", "recurring", [1, 2, 3, 4, 5, 6, 0], 540, 1020, 0),
        ("7pm", "time_point", None, 1140, None, 0),
        ("Nightly from 8:30 pm", "recurring", [1, 2, 3, 4, 5, 6, 0], 1230, None, 0),
        ("Dawn to Dusk", "phrase", None, None, None, 0),
        ("Open 24 hours, 7 days", "recurring", [1, 2, 3, 4, 5, 6, 0], 0, 1439, 0),
        ("Sunday", "unparsed", None, None, None, 0),
        ("10.15am - 11:3O am", "time_range", None, 615, 690, 0),
        ("Wed., Fri & mon at 7pm", "recurring", [3, 5, 1], 1140, None, 0),
        ("Mon from 9 am to 10 am; Tue and Thu at 8 pm; bring a towel", "recurring", [1], 540, 600, 2),
        ("Sat at 1 pm; sunny", "recurring", [6], 780, None, 0),
        ("13 pm 8:75 am", "unparsed", None, None, None, 0),
        (None, "unparsed", None, None, None, 0),
    ],
)
def test_grammar(spark, text, kind, days, start, finish, segments):
    g = one(spark, schedules.grammar(F.lit(text).cast("string")))
    assert (g["kind"], g["days"], g["start"], g["finish"], len(g["segments"])) == (kind, days, start, finish, segments)
    assert g["review"] == (kind == "unparsed") and g["phrase"] == ("dawn_to_dusk" if kind == "phrase" else None)
    if segments:
        assert [(s["days"], s["start"], s["finish"]) for s in g["segments"]] == [([1], 540, 600), ([2, 4], 1200, None)]


def test_occurrences_without_rules_and_without_a_match(spark):
    items = spark.createDataFrame([(1, False, "from 9:15 am"), (2, False, "at 8:00 - 9:00 am"), (3, True, None), (4, True, "8:30"), (5, None, "ask")], "id int, evening boolean, text string")
    rules = spark.createDataFrame([(2, 1, False, "7:05", "8:05", None), (3, None, False, "7:05", "7:05", None), (5, 3, True, None, None, "2:30 pm to 2:30 pm"), (9, 1, True, "1:00", None, None)], "id int, weekday int, daily boolean, start string, finish string, notes string")
    got = recurrence.occurrences(items, rules, "id", F.lit("2024-03-09").cast("date"), 2, ZONE).collect()  # a Saturday, and the Sunday on which clocks go forward
    assert sorted((r["id"], str(r["start"])[5:16], r["finish"] and str(r["finish"])[5:16], r["made"]) for r in got) == [
        (1, "03-09 14:15", "03-09 16:15", True), (1, "03-10 13:15", "03-10 15:15", True),
        (3, "03-10 00:05", None, False), (3, "03-10 23:05", None, False),
        (4, "03-10 01:30", "03-10 03:30", True), (4, "03-11 00:30", "03-11 02:30", True),
        (5, "03-09 19:30", None, False), (5, "03-10 18:30", None, False),
    ]


def test_update_takes_the_last_change_of_a_key(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    changes = spark.createDataFrame([(1, "c", None, 1), (1, "d", 5, 2), (3, "e", 6, 1), (2, None, 7, 1)], "k int, x string, y int, at int")
    got = versioning.update_from(current, changes, ["k"], ["x", "y"], "at")
    assert sorted(map(tuple, got.collect())) == [(1, "d", 5), (2, "b", 7)]
    assert versioning.update_from(current, changes, ["k"], ["x"]).count() == 2


def test_schedule_parts(spark):
    assert one(spark, schedules.range_label(schedules.time_range(F.lit("7:00 pm - 7:00 pm")))) == "7:00 PM"
    assert tuple(one(spark, schedules.age_range(F.lit("Ages 7 and up")))) == (7, None) and tuple(one(spark, schedules.age_range(F.lit("ages 3 – 9")))) == (3, 9)
    assert [tuple(p) for p in one(spark, schedules.price_options(F.lit("Adult: $12.50; free; Child $3")))] == [("Adult", 1250), ("Child", 300)]
    assert one(spark, schedules.price_options(F.lit(None).cast("string"))) == []
    assert one(spark, schedules.date_in_name(F.lit("x-2026-02-30.pdf"))) is None
    assert one(spark, schedules.rule_time(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True))) == "20:30:00"


def test_titles(spark):
    assert one(spark, titles.close_up(F.lit("R E E L F u n - Late Show"))) == "Reelfun - Late Show" or one(spark, titles.close_up(F.lit("R E E L F u n - Late Show"))).endswith(" - Late Show")
    assert all(one(spark, titles.corrupt_title(F.lit(t).cast("string"))) for t in (None, "", "x" * 81, "aaaaaa", "R E E L F U N", "a.....b", "12 34 56 a"))
    assert not one(spark, titles.corrupt_title(F.lit("Movie Under the Stars")))
    assert one(spark, titles.corrupt_slug(F.lit("r-e-e-l-fun"))) and not one(spark, titles.corrupt_slug(F.lit("reel-fun-arcade")))
    assert one(spark, titles.folded_slug(F.lit("Crème Brûlée"))) == "cre-me-bru-le-e"
    assert one(spark, titles.letter_share(F.lit(""))) is None
    for text, want in {"fro* 9 am a1d 10.15pm": "from 9 am and 10:15pm", "=ro7:OO p.m. – I1:00 pm": "from 7:00 p.m. - 1:00 pm", "12:450m": "12:45am", "8:O5  daily": "8:05 daily"}.items():
        assert one(spark, titles.repair_clock(F.lit(text))) == want
    assert one(spark, titles.ends_with_words(F.lit("the late show"), F.lit("Late Show"))) and not one(spark, titles.ends_with_words(F.lit("show"), F.lit("late show")))


def test_query_strings_and_areas(spark):
    q = F.lit("?daypart=dusk&q=a+b%21&free=yes&resort=A b,,a%20B&sort=none#x")
    got = spark.range(1).select(*browse.parse(q, {"daypart": ("late",)}, ("q",), ("free",), ("resort",), ("time", "price"))).first()
    assert tuple(got) == (None, "a b!", False, ["a-b"], "time")
    empty = spark.range(1).select(*browse.parse(F.lit(None).cast("string"), {"daypart": ("late",)}, ("q",), ("free",), ("resort",))).first()
    assert tuple(empty) == (None, None, False, [], "time")
    areas = browse.Areas({"north": ["north_end"]}, {"a": "north", "b": "island"}, {"island": "b"})
    assert one(spark, areas.same_as(F.lit("zz"), F.lit("zz"), F.lit(None).cast("string"))) and not one(spark, areas.matches(F.lit("c"), F.lit("North & End"), "north"))
    assert one(spark, areas.matches(F.lit("c"), F.lit("North End"), "north"))
    rows = spark.createDataFrame([("x", 1)], "kind string, n int")
    assert browse.browse(rows, browse.Kind({"kind": "x"}), {"kind": "y"}).count() == 0 and browse.browse(rows, browse.Kind({"kind": "x"}), {"kind": "x", "n": 1}).count() == 1


def test_lists(spark):
    rows = spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 5, "x"), (1, "c", 1, "y"), (2, "d", None, "x")], "k int, id string, v int, c string")
    got = {(r["k"], r["turn"]): r["id"] for r in lists.pick(rows, "k", "id", "c", -F.col("v"), ["x", "y", "x", "z"]).collect()}
    assert got == {(1, 1): "a", (1, 2): "c", (1, 3): "b", (2, 1): "d"}
    assert lists.pick(rows.limit(0), "k", "id", "c", F.col("v"), ["x"]).count() == 0
    top = lists.filled(rows, F.col("c") == "y", [F.col("id")], 2).collect()
    assert [(r["id"], r["filled"], r["place"]) for r in sorted(top, key=lambda r: r["place"])] == [("c", False, 1), ("a", True, 2)]
    assert {(r["id"], r["other"]) for r in lists.similar(rows, ["c"], "id", [F.col("id")], 1).collect()} == {("a", "b"), ("b", "a"), ("d", "a")}
    assert ranking.numbered_top(rows.limit(0), [F.col("id")], 3).count() == 0


def test_paths_visit_no_node_twice(spark):
    edges = spark.createDataFrame([("a", "b", "Bus", 1), ("a", "b", "Bus", 1), ("b", "a", "Bus", 2), ("b", "c", "Ferry", 3), ("c", "c", "x", 1)], "s string, d string, label string, minutes int")
    found = graph.paths(edges, "s", "d", ["label", "minutes"])
    assert sorted((r["nodes"], r["depth"]) for r in found.collect()) == [(["a", "b"], 1), (["a", "b", "c"], 2), (["b", "a"], 1), (["b", "c"], 1)]
    assert graph.paths(edges, "s", "d", ["label"], ["b"]).count() == 2 and graph.paths(edges.limit(0), "s", "d", ["label"]).count() == 0
    assert one(spark, graph.canonical_mode(F.lit("Water taxi"))) == "boat" and one(spark, graph.canonical_mode(F.lit(None).cast("string"))) is None


def test_replay_and_shares(spark):
    ops = spark.createDataFrame([(1, "p", "name", "A", 1), (1, "p", "name", "B", 2), (2, "p", "name", "C", 3), (3, "p", "drop", None, 4), (4, "p", "name", "D", 5), (5, "q", "name", "", 6)], "op int, plan string, kind string, value string, pos int")
    out = versioning.replay(ops, "op", "plan", "kind", "value", "pos", {"name": ("name", F.length("value") > 0, F.col("value"))}, "drop").collect()
    assert [tuple(r) for r in out] == [("p", 4, True, "C")]
    acts = spark.createDataFrame([("o", k, n) for n, k in enumerate(["rotate", "create", "create", "revoke", "revoke", "rotate", "rotate", "create", "other"])], "owner string, kind string, pos int")
    done = versioning.shares(acts, "owner", "kind", "pos", F.lit(1), 2, "create", "rotate", "revoke").orderBy("pos").collect()
    assert [r["outcome"] for r in done] == ["rotated", "reused", "reused", "revoked", "nothing", "rotated", "refused", "reused"]


def test_versions(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, versioning.insert_missing(table, spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int"), ["k"]).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted(map(tuple, versioning.update_from(table, spark.createDataFrame([("a", None), ("b", 5)], "k string, v int"), ["k"], ["v"]).collect())) == [("a", 1), ("b", 5)]
    with pytest.raises(ValueError, match="key"):
        versioning.roll_back(table, F.current_date(), k=None)
    with pytest.raises(ValueError, match="nothing"):
        versioning.publish_parts({"x": (table.withColumn("is_current", F.lit(True)), table.limit(0))}, "k")


def test_payloads(spark):
    rows = spark.createDataFrame([(1, '{"a":{"b":[{"x":1},{"y":2}]}}'), (2, "no json"), (3, None), (4, '{"a":{}}')], "k int, p string")
    assert sorted(map(tuple, payloads.nested_rows(rows, "p", "struct<a: struct<b: array<struct<x: int>>>>", "a.b", ["k"]).collect()), key=str) == [(1, 1), (1, None)]
    assert one(spark, payloads.texts_of(F.lit('{"a":1}'))) == [] and one(spark, payloads.texts_of(F.lit('["a",1]'))) == ["a", "1"]
    assert one(spark, payloads.box_of(F.lit([]).cast("array<array<double>>"))) is None
    assert one(spark, payloads.keep_members(F.lit('{"b":"2","a":"1","c":"3"}'), ["a", "z", "b"])) == '{"a":"1","b":"2"}'
    assert one(spark, payloads.merge_objects(F.lit(None).cast("string"), F.lit('{"a":"1"}'))) == {"a": "1"}


def test_joins_and_sets(spark):
    table = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(map(tuple, joins.equal_or_first(rows, table, "k", ["v"]).collect())) == [(1, "x")] * 3
    sets = spark.createDataFrame([("a", ["p", "q", "r"]), ("b", ["q", "r", "p"]), ("c", ["p", "z"]), ("d", [])], "id string, s array<string>")
    assert [tuple(r) for r in search.similar_sets(sets, "id", "s", 0.9).collect()] == [("a", "b", 1.0)]
    assert sorted((r["a"], r["b"]) for r in search.similar_sets(sets, "id", "s", 0.25).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert one(spark, forecast.rain_signal(F.lit(10), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(False), F.lit(False))) == "unknown"


def test_evidence(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 1), ("x", 2)], "e string, q int")
    assert sorted(map(tuple, evidence.missing_combinations(seen, {"e": ["a", "b"], "q": [1, 2]}).collect())) == [("a", 2), ("b", 1), ("b", 2)]
    assert one(spark, evidence.passing_state(F.lit("No errors"), F.lit(None).cast("string"))) and not one(spark, evidence.passing_state(F.lit("Passed"), F.lit("failed")))
    assert one(spark, evidence.decision_record(F.lit("t"), F.lit("r"), F.lit("maybe"), F.lit(["a"]), F.current_date())) is None


def test_readers_of_missing_and_broken_files(spark, tmp_path):
    schema = "a int, b string"
    assert readers.json_or_empty(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "rows.json").write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert sorted(map(tuple, readers.json_or_empty(spark, str(tmp_path / "rows.json"), schema).collect())) == [(1, "x"), (2, None)]
    (tmp_path / "odd.json").write_text('[{"other": 1}, {}, 5, "{}", {"a": 3}]')
    assert sorted(readers.json_or_empty(spark, str(tmp_path / "odd.json"), schema).collect(), key=str) == sorted([(3, None), (None, None), (None, None)], key=str)
    (tmp_path / "bad.json").write_text("not json")
    assert readers.json_or_empty(spark, str(tmp_path / "bad.json"), schema).count() == 0
    files = readers.document_rows(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {(r["name"], r["size"]) for r in files.collect()} == {("rows.json", 30), ("odd.json", 37), ("bad.json", 8)}
    blocks = spark.createDataFrame([(1, "<h1>A</h1><p class=x>b <i>c</i></p><p> </p>"), (2, None)], "page_id int, html string")
    assert [(r["tag"], r["text"]) for r in readers.page_blocks(blocks).collect()] == [("h1", "A"), ("p", "b c")]
    assert [tuple(r) for r in readers.missing_tables(spark, ["no_such_table"]).collect()] == [("no_such_table", False)]


def test_members_join_on_an_index(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, [None, "c"])], "id int, held array<string>")
    other = spark.createDataFrame([("a", 10), ("b", 11), (None, 12), ("d", 13)], "name string, n int")
    got = joins.members(rows, "held", other, "name")
    assert sorted((r["id"], r["n"]) for r in got.collect()) == [(1, 10), (1, 11)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_snapshot_prefers_what_was_asked(spark):
    expected = spark.createDataFrame([(1, "h", "c1", "v1"), (2, "h", "c1", None), (3, "h", None, "v2"), (4, "h", None, None), (5, "x", "c1", None), (6, "h", "c9", "v9")], "id int, hash string, config string, version string")
    snaps = spark.createDataFrame([("h", "c2", "v1", 1), ("h", "c1", "v2", 2), ("h", "c1", "v1", 3), ("h", None, "v2", 4), ("h", "c1", "v1", 5)], "hash string, config string, version string, snap int")
    got = joins.best_snapshot(expected, snaps, "hash", ["config"], ["version"], "snap", ["snap"])
    assert sorted((r["id"], r["snap"], r["fits"]) for r in got.collect()) == [(1, 3, True), (2, 2, True), (3, 4, True), (4, 1, False), (5, None, None), (6, 1, False)]


def test_equivalence_diff(spark):
    old = spark.createDataFrame([(1, "Pool", "draft"), (2, "hall", "live"), (3, "bar", "live"), (5, None, "live")], "k int, place string, status string")
    new = spark.createDataFrame([(1, "pool", "live"), (2, "yard", "live"), (4, "x", "live"), (5, None, "live")], "k int, place string, status string")
    same = {"place": [("case", lambda a, b: F.lower(a["place"]) == F.lower(b["place"]))]}
    got = sets.equivalence_diff(old, new, "k", same, "status", ("place",))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        (1, "equivalent", "place", "Pool", "pool", "case", False), (1, "transition", "status", "draft", "live", None, False), (2, "changed", "place", "hall", "yard", None, True),
        (3, "missing", None, None, None, None, True), (4, "new", None, None, None, None, False),
    ]))


def test_graph_documents(spark):
    good = '{"places":[{"id":"p"},{"id":"q"}],"stops":[{"id":"1","place":"p"},{"id":"2","place":"q"}],"patterns":[{"id":"a","stops":["1","2"]}],"edges":[{"id":"e","from":"1","to":"2","pattern":"a"}],"services":[{"id":"s","origin":"p","destination":"q","edges":["e"]}]}'
    bad = '{"places":[{"id":"p"},{"id":"p"},{}],"stops":[{"id":"1","place":"x"}],"patterns":[{"id":"a","stops":["1","9",null]}],"edges":[{"id":"e","from":"1","to":"8","pattern":"z"}],"services":[{"id":"s","origin":"p","destination":"y","edges":["e","f"]}]}'
    docs = graphdoc.parsed(spark.createDataFrame([(1, good), (2, bad), (3, "no json"), (4, "{}"), (5, None)], "k int, t string"), "k", "t")
    assert {n: df.filter("graph = 1").count() for n, df in graphdoc.relations(docs).items()} == {"places": 2, "stops": 2, "patterns": 1, "edges": 1, "services": 1}
    got = sorted(map(str, map(tuple, graphdoc.integrity(docs).collect())))
    assert got == sorted(map(str, [
        (2, "stops", "1", "place", "x", "orphan"), (2, "patterns", "a", "stops", "9", "orphan"), (2, "edges", "e", "to", "8", "orphan"), (2, "edges", "e", "pattern", "z", "orphan"),
        (2, "services", "s", "destination", "y", "orphan"), (2, "services", "s", "edges", "f", "orphan"), (2, "places", "p", "id", None, "repeated"), (2, "places", None, "id", None, "unnamed"),
        (3, None, None, None, None, "unread"), (5, None, None, None, None, "unread"),
    ]))
