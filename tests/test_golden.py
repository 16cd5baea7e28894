"""Golden records: spans on their lines, on others and nowhere; roles, fields, warnings; nulls and empty tables."""

from millrace.operators import golden

SPAN = "id int, field string, place int, page int, line int, text string"


def test_spans(spark):
    docs = spark.createDataFrame([(1, "Night swim\nPool at 7pm\nFree\nPool at 7pm"), (2, ""), (3, None)], "k int, body string")
    lines = golden.page_lines(docs, "k", "body", 2)
    assert [tuple(r) for r in lines.orderBy("id", "page", "line").collect()] == [(1, 1, 1, "Night swim"), (1, 1, 2, "Pool at 7pm"), (1, 2, 1, "Free"), (1, 2, 2, "Pool at 7pm"), (2, 1, 1, "")]
    required = spark.createDataFrame(
        [(1, "title", 0, 1, 1, "swim"), (1, "title", 1, 2, 1, "swim"), (1, "time", 0, 2, 2, "7pm"), (1, "time", 1, 9, 9, "7pm"), (1, "time", 2, None, None, "7pm"), (1, "time", 3, None, None, "8pm"),
         (1, "fee", 0, 2, 1, " "), (1, "fee", 1, 3, 1, None), (1, "fee", 2, None, None, None), (2, "title", 0, 1, 1, "swim"), (3, "title", 0, 1, 1, ""), (4, "title", 0, None, None, "x"), (None, "title", 0, 1, 1, "swim")], SPAN,
    )
    got = {(r["id"], r["field"], r["place"]): r["error"] for r in golden.span_errors(lines, required).collect()}
    assert got == {
        (1, "title", 1): "wrong_line:1:1", (1, "time", 1): "wrong_line:1:2", (1, "time", 3): "missing_span", (1, "fee", 1): "missing_line", (2, "title", 0): "missing_span", (3, "title", 0): "missing_line",
        (4, "title", 0): "missing_span", (None, "title", 0): "missing_span",
    }
    assert golden.span_errors(lines, required.limit(0)).count() == 0
    plan = golden.span_errors(lines, required)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sets(spark):
    found = spark.createDataFrame([(1, "a", ["w"]), (2, "b", None), (3, None, ["v", "w"]), (4, "d", []), (5, "e", ["z"]), (6, "f", None)], "id int, name string, warnings array<string>")
    expected = spark.createDataFrame(
        [(1, "public", None, None), (2, "public", "x", ["q"]), (3, "quarantine", "c", ["w", "v"]), (4, "unextractable", "x", None), (5, "unextractable", None, ["y"]), (7, "manual", "g", None), (8, "quarantine", None, None), (9, "public", None, None),
         (10, "unextractable", None, ["y"]), (None, "quarantine", "n", None)], "id int, role string, name string, warnings array<string>",
    )
    got = sorted(map(tuple, golden.set_errors(found, expected, ["name"]).collect()), key=str)
    assert got == sorted(
        [(2, "fixture_drift:name"), (3, "fixture_drift:name"), (4, "candidate_unextractable_became_extractable"), (5, "fixture_drift:warnings"), (6, "candidate_unexpected"), (7, "candidate_manual_missing"),
         (8, "candidate_quarantine_missing"), (9, "candidate_missing"), (None, "fixture_quarantine_missing:slug")], key=str,
    )
    assert golden.set_errors(found.limit(0), expected.limit(0), ["name"]).count() == 0
