"""The maintained index: merges equal one build, web-style queries, fallback on names, nulls and ties."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.postings import Index, Layout

LAYOUT = Layout("k", {"name": 1.0, "note": 0.4}, ("name",))
SCHEMA = "k int, name string, note string"
ROWS = [(1, "Night Swim", "swim in the pool at night"), (2, "Pool games", "no swim, only games"), (3, None, None), (4, "", ""), (5, "Campfire night", None), (None, "Night", "x")]


def dump(index):
    return sorted(map(str, index.words.collect())), sorted(map(str, index.grams.collect()))


def test_increments_equal_one_build(spark):
    empty = spark.createDataFrame([], SCHEMA)
    step = lambda rows: spark.createDataFrame(rows, SCHEMA + ", at int, gone boolean")
    index = Index.build(empty, LAYOUT)
    index = index.merge(step([(1, "old", "older", 1, False), (1, "Night Swim", "x", 2, False), (2, "a", "b", 2, None), (9, "z", "z", 1, False)]), "at", "gone")
    index = index.merge(step([(1, *ROWS[0][1:], 3, False), (9, None, None, 3, True), (2, *ROWS[1][1:], 4, False), (2, "lost", "lost", 3, False)]), "at", "gone")
    index = index.merge(step([(*r, 5, False) for r in ROWS[2:]] + [(8, "both", "ways", 5, False), (8, "both", "ways", 5, True), (8, "both", "ways", 5, False)]), "at", "gone")
    assert dump(index) == dump(Index.build(spark.createDataFrame(ROWS, SCHEMA), LAYOUT))
    assert dump(index.merge(step([]), "at", "gone")) == dump(index)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("night swim", {1: (1.0, "words"), 5: (0.0, "name")}),
        ('"swim in"', {1: (0.7, "words")}),
        ('"in swim"', {1: (0.0, "name")}),
        ("swim -night", {2: (0.4, "words"), 1: (0.0, "name"), 5: (0.0, "name")}),
        ("games or campfire", {2: (1.0, "words"), 5: (1.0, "words")}),
        ('"no swim" or "pool at"', {1: (0.4, "words"), 2: (0.4, "words")}),
        ("campfir nigt", {5: (0.0, "name")}),
        ("-night", {5: (0.0, "name"), 1: (0.0, "name")}),
        ("!!", {1: (0.0, "all"), 2: (0.0, "all"), 3: (0.0, "all"), 4: (0.0, "all"), 5: (0.0, "all")}),
    ],
)
def test_search(spark, query, want):
    index = Index.build(spark.createDataFrame(ROWS, SCHEMA), LAYOUT)
    assert {r["id"]: (r["rank"], r["via"]) for r in index.search(query).collect()} == want


def test_rows_without_a_vector_rank_by_likeness(spark):
    lay = Layout("k", {"note": 0.4}, ("name",))
    got = Index.build(spark.createDataFrame(ROWS[:5] + [(6, "Night Swims", None)], SCHEMA), lay).search("night swim").collect()
    assert {r["id"]: (r["rank"], r["via"]) for r in got} == {1: (0.4, "words"), 5: (0.3, "name"), 6: (0.769231, "name")}


def test_a_search_reads_postings_of_its_words_only(spark, tmp_path):
    index = Index.build(spark.createDataFrame(ROWS, SCHEMA), LAYOUT)
    index.words.write.parquet(f"{tmp_path}/words")
    stored = Index(LAYOUT, spark.read.parquet(f"{tmp_path}/words"), index.grams)
    plan = stored.search("night swim")._jdf.queryExecution().executedPlan().toString()
    assert "In(word, [night,swim])" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert stored.search("night swim").filter(F.col("via") == "words").count() == 1
