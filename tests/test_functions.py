"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, scoring, temporal, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("given", "evening", "want"),
    [("at 7:30 pm", True, 1170), ("8", True, 1200), ("8", False, 480), ("12 am", True, 0), ("20:15", True, 1215), ("13 pm", True, None), ("7:75", True, None), ("no time", True, None), ("", True, None), (None, True, None)],
)
def test_parse_clock(spark, given, evening, want):
    assert one(spark, temporal.parse_clock(F.lit(given).cast("string"), evening)) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Mon-Wed", [1, 2, 3]), ("Fri - Mon", [0, 1, 5, 6]), ("weekdays", [1, 2, 3, 4, 5]), ("Saturday, Tuesday", [2, 6]), ("daily", None), ("from the sunset", None), (None, None), ("Mon Mon", [1])],
)
def test_parse_days(spark, given, want):
    assert one(spark, temporal.parse_days(F.lit(given).cast("string"))) == want


def test_clock_label_and_quarter(spark):
    assert one(spark, temporal.clock_label(F.lit(0))) == "12:00 AM"
    assert one(spark, temporal.clock_label(F.lit(785))) == "1:05 PM"
    assert one(spark, temporal.fiscal_quarter(F.lit("2023-10-01").cast("date"))) == "FY24-Q1"
    assert one(spark, temporal.span_daypart(F.lit(540), F.lit(60))) == "anytime"
    assert one(spark, temporal.span_daypart(F.lit(1200), F.lit(60))) == "evening"


@pytest.mark.parametrize(("a", "b", "most", "want"), [("widget", "wigdet", 1, 1), ("bolt", "bolt", 1, 0), ("bolt", "belt", 1, 1), ("bolt", "bottle", 1, None), ("ab", "ba", 2, 1), ("", "a", 1, 1)])
def test_typo_distance(spark, a, b, most, want):
    assert one(spark, scoring.typo_distance(F.lit(a), F.lit(b), F.lit(most))) == want


def test_field_score_steps(spark):
    score = lambda q, f: one(spark, F.round(scoring.field_score(F.lit(q), F.lit(f), 100.0), 3))
    assert [score("bolt", f) for f in ("bolt", "bolt red", "red bolts", "a bold one", "gear")] == [100, 92, 82, 28, 0]


def test_text_forms(spark):
    assert one(spark, text.slug(F.lit("  Big & Small! "))) == "big-small"
    assert one(spark, text.title_case(F.lit("the lord OF rings"))) == "The Lord of Rings"
    assert one(spark, text.collapse_repeat(F.lit("Late Show Late Show"))) == "Late Show"
    assert one(spark, text.money_cents(F.lit("$1,250.50 or $7"))) == [125050, 700]
    assert one(spark, text.garbage_ratio(F.lit(""))) == 1.0
    assert one(spark, text.fold_marks(F.lit("a – “b”"))) == 'a - "b"'
    assert one(spark, text.escape_calendar(F.lit("a;b,c\\d\n"))) == "a\\;b\\,c\\\\d\\n"
    assert one(spark, text.first_filled(F.lit(" "), F.lit(None), F.lit("x "))) == "x"
    assert one(spark, text.content_hash(F.lit(None).cast("string"))) != one(spark, text.content_hash(F.lit("")))


def test_arrays(spark):
    assert one(spark, arrays.tidy(F.array(F.lit(" a"), F.lit(""), F.lit("a")))) == ["a"]
    assert one(spark, arrays.run_length_dedupe(F.array(*map(F.lit, "aabba")))) == ["a", "b", "a"]
    assert one(spark, arrays.first_number(F.lit("x"), F.lit("NaN"), F.lit("3.5"))) == 3.5
    assert one(spark, arrays.errors(("a", F.lit(True)), ("b", F.lit(None).cast("boolean")))) == ["a"]
    assert one(spark, arrays.has_evidence(F.create_map(F.lit("k"), F.array(F.lit(1))), ["k", "m"])) is False
