"""Queries against their SQL on small tables with rows that the test data have none or few of."""

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from millrace.plans.queries import oracle_sql, queries


def both(spark, folder, name, tables):
    """The rows that the query and its SQL give for tables (name to frame), as sorted tuples of texts."""
    c = duckdb.connect()
    for table, frame in tables.items():
        pq.write_table(pa.Table.from_pandas(frame, preserve_index=False), f"{folder}/{table}.parquet", coerce_timestamps="us")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = queries()[name](spark, str(folder)).toPandas(), c.sql(oracle_sql()[name]).df()
    plain = lambda frame: sorted(tuple("" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(want.columns)].itertuples(index=False))
    return plain(got), plain(want)


def test_events_that_last_half_minutes(spark, tmp_path):
    ends = [(value, minutes) for value in (0.5, 1.5, 2.5, 12.5, 179.5, 180.5) for minutes in range(4)]
    now = pd.Timestamp("2024-01-15 12:00:00")
    rows = [(5 * n + 1, now - pd.Timedelta(minutes=int(value) % 180 + minutes - 1), value) for n, (value, minutes) in enumerate(ends)]
    got, want = both(spark, tmp_path, "availability_state", {"events": pd.DataFrame(rows, columns=["event_id", "ts", "value"])})
    assert got == want


def test_events_a_part_of_a_second_off(spark, tmp_path):
    now, away = pd.Timestamp("2024-01-15 12:00:00"), [0, -1, 5400, 72 * 3600, 168 * 3600, -7200, -13 * 86400, -15 * 86400, 86400]
    shifts = [pd.Timedelta(seconds=s, microseconds=us) for s in away for us in (0, 1, -1, 500000, -500000)]
    shifts.append(pd.Timestamp("1969-12-31 23:59:58.5") - now)
    rows = [(11 * n + k, now + s, n * 7 + k, 35.0 * (k % 3)) for n, s in enumerate(shifts) for k in (1, 2, 4, 8)]
    got, want = both(spark, tmp_path, "timing_advice", {"events": pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"])})
    assert got == want
