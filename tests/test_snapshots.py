"""Snapshots, regions, provenance, authority, windows, display times and guarded tables: nulls, ties, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import temporal
from millrace.operators import evidence, snapshots
from millrace.sources import readers

SNAP = "k int, pages array<struct<number: int, hash: string, width: long, height: long>>, runs array<struct<engine: string, status: string, tokens: long>>, regions array<string>, tokens array<string>, errors array<string>"


def test_quality(spark):
    rows = spark.createDataFrame(
        [
            (1, [(1, "h", 800, 800), (2, None, None, 900)], [("a", "ok", 3), ("a", "ok", 0), (None, None, None), ("b", "bad", 2)], ["r"], None, ["ocr_config_error:x", "ocr_config_error:x", "other", None]),
            (2, None, None, None, None, None),
            (3, [], [], ["r"], ["t"], []),
        ],
        SNAP,
    )
    got = {r["id"]: (r["pages"], r["tokens"], r["statuses"], r["engine_tokens"], r["reviewable"], r["findings"]) for r in snapshots.quality(rows, "k").collect()}
    assert got == {
        1: (2, 0, "bad=1,ok=2,unknown=1", "a=0,b=2,unknown=0", 1, "ocr_config_error:x,missing_page_image_hash:page_2,low_quality_image:page_2"),
        2: (0, 0, "", "", 0, "missing_source_pages,missing_regions,missing_ocr_tokens"),
        3: (0, 1, "", "", 0, "missing_source_pages"),
    }
    assert snapshots.quality(rows.limit(0), "k").count() == 0


def test_regions_round_to_even_and_stay_inside(spark):
    rows = spark.createDataFrame([(1, "a", 5, 3), (2, "b", 5, None), (3, None, 5, 3)], "k int, f string, w int, h int")
    got = sorted(map(tuple, snapshots.regions(rows, "k", "f", "w", "h", {"a": [("top", 0, 0, 0.5, 0.5), ("out", 0.9, 0, 1.5, 2)]}).collect()))
    assert got == [(1, 1, "top", 0, 0, 2, 2), (1, 2, "out", 4, 0, 5, 3), (2, 1, "unknown", 0, 0, 5, 0), (3, 1, "unknown", 0, 0, 5, 3)]


def test_provenance_and_authority(spark):
    rows = spark.createDataFrame(
        [(1, "u", "aB" * 32, "free", {"resort_join": ["x"], "surface": ["y"], "price": ["z"]}), (2, "", "a" * 63, "odd", {"resort_join": [], "surface": None, "price": ["z"]}), (3, None, None, None, None), (4, "u", "0" * 64, "fee", {"resort_join": ["x"], "surface": ["y"]})],
        "k int, source_url string, source_sha256 string, price_state string, spans map<string,array<string>>",
    )
    got = {}
    for r in snapshots.provenance_errors(rows, "k", ["surface"], "t_").collect():
        got.setdefault(r["k"], []).append(r["error"])
    every = ["t_missing_source_url", "t_missing_source_hash", "t_missing_resort_join", "t_missing_surface_provenance"]
    assert got == {2: [*every, "t_price_without_source"], 3: every, 4: ["t_price_without_source"]}
    policy = [{"kind": "a", "authority": "high"}, {"kind": "a", "authority": "low"}, {"kind": "b", "forbidden": ["public_price_state"], "cannot_override": ["free_price_state"]}]
    kinds = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string").select(snapshots.authority(F.col("x"), policy).alias("p"))
    assert [tuple(r["p"]) for r in kinds.collect()] == [("high", True, True), ("", False, False), ("unknown", False, False), ("unknown", False, False)]
    maps = spark.createDataFrame([({"a": "exact", "b": None},), ({"a": ""},), ({"a": "off"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(snapshots.disagrees(F.col("m"), ("exact",))).collect()] == [False, False, True, False, False]


@pytest.mark.parametrize(
    ("start", "end", "text", "label", "ranged", "doubtful", "want"),
    [
        ("09:00", "07:00", None, None, None, None, ("Time needs confirmation", True)),
        ("09:00", "20:00", None, None, None, None, ("Time needs confirmation", True)),
        ("09:00", "20:00", "9 to 8", "9:00 AM – 8:00 PM", True, False, ("9:00 AM – 8:00 PM", False)),
        ("09:00", "20:00", "from 9", "9:00 AM", False, None, ("Time needs confirmation", True)),
        (None, None, "see board", None, None, False, (None, False)),
        ("09:00", "10:00", "see board", None, None, True, ("Time needs confirmation", True)),
        ("09:00", "10:00", "x" * 81, None, None, False, ("x" * 77 + "…", False)),
        ("09:00", None, "", None, None, None, ("9:00 AM", True)),
        ("09:05", "09:05", None, None, None, None, ("9:05 AM", False)),
        ("09:05", "13:00", None, None, None, None, ("9:05 AM – 1:00 PM", False)),
        (None, None, None, None, None, None, (None, False)),
    ],
)
def test_display_time(spark, start, end, text, label, ranged, doubtful, want):
    at = lambda x: F.lit(x and f"2024-01-01 {x}:00").cast("timestamp_ntz")
    shown = temporal.display_time(at(start), at(end), F.lit(text).cast("string"), F.lit(label).cast("string"), F.lit(ranged).cast("boolean"), F.lit(doubtful).cast("boolean"))
    assert tuple(spark.range(1).select(shown.alias("d")).first()["d"]) == want


def test_windows_count_from_nought(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 19), "low", None, "low"), ("a", dt.datetime(2024, 1, 1, 8), "high", "high", "high"), ("b", dt.datetime(2024, 1, 1, 8), "low", "low", "high")], "l string, s timestamp, storm string, rain string, heat string")
    got = {r["window"]: (r["action"], r["chapter"]) for r in snapshots.windows(rows, "l", "s", F.col("storm"), F.col("rain"), F.col("heat"), F.hour("s")).collect()}
    assert got == {"a-1-20240101190000": ("go_now", "Starlight Reset"), "a-0-20240101080000": ("stay_indoors", "Storm Mode"), "b-0-20240101080000": ("bring_backup", "Heat Buildup")}


def test_guarded_tables_and_missing_combinations(spark):
    assert readers.table_or_empty(spark, "no_such_offerings", "a int, b string").collect() == []
    spark.createDataFrame([(1, "x")], "a int, c string").createOrReplaceTempView("some_offerings")
    assert [tuple(r) for r in readers.table_or_empty(spark, "some_offerings", "a long, b string").collect()] == [(1, None)]
    seen = spark.createDataFrame([("a", 1), ("a", 9), ("z", 2), ("a", None)], "x string, y int")
    assert sorted(map(tuple, evidence.missing_combinations(seen, {"x": ["a", "b"], "y": [1, 2]}).collect())) == [("a", 2), ("b", 1), ("b", 2)]
