"""Rules are read once, before they are expanded to days; odd times are none."""

from pyspark.sql import functions as F

from millrace.operators import recurrence

ZONE = "America/New_York"
ITEM, RULE = "id int, evening boolean, text string", "id int, weekday int, daily boolean, start string, finish string, notes string"


def test_rules_are_read_below_the_expansion(spark):
    items = spark.createDataFrame([(1, False, None)], ITEM)
    rules = spark.createDataFrame([(1, None, True, "7:05", "8:05", "9:15 - 10:45 am")], RULE)
    got = recurrence.occurrences(items, rules, "id", F.lit("2024-03-07").cast("date"), 7, ZONE)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "regexp" not in above and "regexp" in below
    assert got.count() == 7


def test_odd_times_around_changes_of_offset(spark):
    items = spark.createDataFrame([(n, n == 3, None) for n in range(1, 8)], ITEM)
    rules = [(1, None, True, "25:10", "2:30", None), (2, None, True, "2:30", "2:30", None), (3, None, True, "7", None, None), (4, None, True, "x", "y", "at 12:75 or 1:30 pm"), (5, None, True, "1:30", "3:00", ""), (6, None, True, "0:00", "23:59", "7:00 - 9:00 pm"), (7, None, True, None, "10:75", None)]
    got = recurrence.occurrences(items, spark.createDataFrame(rules, RULE), "id", F.lit("2024-03-10").cast("date"), 1, ZONE)  # clocks go from 2:00 to 3:00
    shown = lambda t: t and str(t)[5:16]
    assert sorted((r["id"], shown(r["start"]), shown(r["finish"])) for r in got.collect()) == [
        (1, None, "03-10 07:30"), (2, "03-10 07:30", None), (3, "03-10 23:00", None), (4, "03-10 13:00", None), (5, "03-10 06:30", "03-10 07:00"), (6, "03-10 11:00", "03-11 01:00"), (7, "03-10 13:00", "03-10 15:15"),
    ]
    back = recurrence.occurrences(items, spark.createDataFrame(rules, RULE), "id", F.lit("2024-11-03").cast("date"), 1, ZONE)  # 1:00 to 2:00 comes twice
    assert sorted((r["id"], shown(r["start"]), shown(r["finish"])) for r in back.collect() if r["id"] in (5, 6)) == [(5, "11-03 05:30", "11-03 08:00"), (6, "11-03 12:00", "11-04 02:00")]
