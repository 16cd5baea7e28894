"""Readers, sinks and streams."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import readers
from millrace.streaming import windows


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nnot json\n[1]\n{"k": 2, "x": 3}\n\n"s"\n')
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    assert sorted(r["k"] for r in readers.json_lines(spark, str(tmp_path), schema).collect()) == [1, 2]

    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{}\n{"b": "only other"}\n{"a": "text"}\n{"a": 2, "a": 3}\n {"a": 4} \n{"a": 5\nnull\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted((r["a"] or 0 for r in readers.json_lines(spark, str(tmp_path / "b.jsonl"), schema).collect())) in ([0, 0, 0, 1, 2, 4], [0, 0, 0, 1, 3, 4])


def test_json_envelope(spark):
    texts = ['[{"a": 1}, {"a": 2}]', '{"rows": [{"a": 3}]}', '{"a": 4}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.explode(readers.json_envelope(F.col("t"), "struct<a: int>")).alias("r")).select("r.a").collect()
    assert [r["a"] for r in got] == [1, 2, 3, 4]


def test_page_lines_and_links(spark):
    html = "<title>T &amp; U</title><script>x</script><p>a <b>b</b><br>c</p><svg><p>no</p></svg><a href='/x'>go  <i>on</i></a>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert [(r["line"], r["text"]) for r in readers.page_lines(pages).collect()] == [(1, "T & U"), (2, "a b"), (3, "c"), (4, "go on")]
    assert [(r["href"], r["label"]) for r in readers.page_links(pages).collect()] == [("/x", "go on")]


def test_sniff_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "a"), (bytearray(b"\xff\xd8\xff\xe0"), "b"), (None, "c.PNG"), (bytearray(b""), "d")], "d binary, n string")
    assert [r[0] for r in df.select(readers.sniff(F.col("d"), F.col("n"))).collect()] == ["pdf", "jpeg", "png", "unknown"]
    assert readers.markdown_table(df.select("n").limit(1)) == "| n |\n| --- |\n| a |"
    readers.write_table(df.select("n"), str(tmp_path / "csv"), "csv", "overwrite")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_stream_counts_and_ledger(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = "op int, k string, ts timestamp"
    for part, minutes in enumerate([[0, 1, 2, 70], [1, 200]]):
        rows = [(m, "a", t0 + dt.timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = windows.window_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["k"], "1 hour", "10 minutes")
        windows.run_available(counts, str(tmp_path / "counts"), str(tmp_path / "c1"))
        once = windows.apply_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "op", "ts", "1 hour")
        windows.run_available(once, str(tmp_path / "once"), str(tmp_path / "c2"))
        assert part < 2
    found = {r["window_start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert found[t0] == 3  # the late row of the second part is past the watermark
    assert windows.over_limit(spark.read.parquet(str(tmp_path / "counts")), 2).count() == 1
    assert windows.over_limit(spark.read.parquet(str(tmp_path / "counts")), 0).count() == 0
    assert spark.read.parquet(str(tmp_path / "once")).groupBy("op").count().filter("count > 1").count() == 0


def test_latest_snapshot(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t0, 1), ("a", t0 + dt.timedelta(seconds=50), 2), ("b", t0, 3)], "k string, at timestamp_ntz, v int")
    now = F.lit("2024-01-01 00:01:40").cast("timestamp_ntz")
    assert [r["v"] for r in windows.latest_snapshot(df, ["k"], "at", now, 60).collect()] == [2]
