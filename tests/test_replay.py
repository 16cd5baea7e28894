"""Replay with failures: by hand, and the stream against its batch form."""

import datetime as dt
import random

from pyspark.sql import functions as F

from millrace.operators.replay import Rules, replay
from millrace.streaming.replay import replay_stream
from millrace.streaming.windows import run_available

SCHEMA = "owner int, op_id long, kind string, item long, note string, at timestamp, seq long"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_failures_wait_and_repeats_get_their_first_result(spark):
    ops = [
        (1, 10, "note", 7, "early", at(0), 0),  # nothing there yet
        (1, 11, "add", 7, None, at(1), 1),
        (1, 12, "add", 8, None, at(2), 2),
        (1, 13, "add", 9, None, at(3), 3),  # full
        (1, 11, "add", 7, "again", at(4), 4),
        (1, 13, "add", 9, None, at(5), 5),
        (1, 14, "remove", 8, None, at(6), 6),  # makes room for 9
        (1, 15, "remove", 1, None, at(7), 7),
        (1, 16, "note", 9, "x", at(7 + 61), 8),
        (None, 17, "add", 1, None, at(0), 0),
    ]
    got = replay(spark.createDataFrame(ops, SCHEMA), Rules(most=2, give_up=3600)).collect()
    assert [(r["op_id"], r["result"], r["repeated"], r["version"], r["waiting"]) for r in got] == [
        (10, "pending", False, 0, 1), (11, "applied", False, 1, 0), (10, "applied", False, 2, 0), (12, "applied", False, 3, 0), (13, "pending", False, 3, 1),
        (11, "applied", True, 3, 1), (13, "pending", True, 3, 1), (14, "applied", False, 4, 0), (13, "applied", False, 5, 0), (15, "pending", False, 5, 1),
        (15, "expired", False, 5, 0), (16, "applied", False, 6, 0),
    ]
    assert replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    ops = [(rng.randrange(4), rng.randrange(150), rng.choice(["add", "add", "remove", "note"]), rng.randrange(6), rng.choice([None, "n"]), at(rng.randrange(600)), k) for k in range(240)]
    ops.sort(key=lambda o: o[5] + dt.timedelta(minutes=rng.randrange(20)))  # out of order within twenty minutes
    for k in range(4):
        spark.createDataFrame(ops[k * 60 : k * 60 + 60], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    rules = Rules(most=3, give_up=5400, remember=7200)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = replay_stream(source, "30 minutes", rules)
    run_available(out, str(tmp_path / "out"), str(tmp_path / "check"))
    last = max(o[5] for o in ops) - dt.timedelta(minutes=30)
    want = replay(spark.createDataFrame(ops, SCHEMA), rules, F.lit(last).cast("timestamp_ntz"))
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(want.columns))
    assert got == rows(want) and len(got) > 150 and {r.split("result='")[1].split("'")[0] for r in got} == {"applied", "pending", "expired"}
