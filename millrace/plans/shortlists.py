"""Short lists over events, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import temporal as T
from millrace.operators import lists
from millrace.plans.registry import query
from millrace.sources.tables import Tables


@query("""SELECT p_partkey, p_name FROM (SELECT * FROM part WHERE p_type = 'PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 12) WHERE p_size % 2 = 0""")
def preview_limited_first(t: Tables) -> DataFrame:
    """The twelve dearest promotions, and only then those of even size."""
    return lists.limit_then_filter(t.part.filter("p_type = 'PROMO'"), [F.desc("p_retailprice"), F.asc("p_partkey")], 12, F.col("p_size") % 2 == 0).select("p_partkey", "p_name")


@query("""
WITH u AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-15 18:00:00'),
f AS (SELECT user_id, coalesce(min(place) FILTER (ts::DATE = DATE '2024-01-16'), min(place)) AS chosen FROM u WHERE place <= 14 GROUP BY 1)
SELECT u.user_id, event_id, place, place = chosen AS featured FROM u JOIN f USING (user_id) WHERE place <= 14
""")
def upcoming_featured(t: Tables) -> DataFrame:
    """Each user's next fourteen events, one featured."""
    later = t.events.filter("ts >= timestamp_ntz'2024-01-15 18:00:00'")
    out = lists.upcoming(later, "user_id", [F.col("ts"), F.col("event_id")], 14, F.to_date("ts") == F.lit("2024-01-16").cast("date"))
    return out.select("user_id", "event_id", F.col("place").cast("long").alias("place"), "featured")


@query("""
WITH n AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey) AS n FROM part)
SELECT a.p_partkey, b.p_partkey AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.n) AS place FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND b.n <= 5 AND b.p_partkey <> a.p_partkey
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.n) <= 4
""")
def similar_items(t: Tables) -> DataFrame:
    """For each part the four cheapest others of its brand and type."""
    return lists.similar(t.part, ["p_brand", "p_type"], "p_partkey", [F.col("p_retailprice"), F.col("p_partkey")], 4)


@query("""
SELECT p_partkey, filled, place FROM (SELECT p_partkey, NOT (p_type = 'PROMO' AND p_size > 45) AS filled, row_number() OVER (ORDER BY NOT (p_type = 'PROMO' AND p_size > 45), p_partkey) AS place FROM part) WHERE place <= 30
""")
def filled_from_pool(t: Tables) -> DataFrame:
    """Thirty large promotions, filled up with other parts."""
    return lists.filled(t.part, (F.col("p_type") == "PROMO") & (F.col("p_size") > 45), [F.col("p_partkey")], 30).select("p_partkey", "filled", "place")


PICK_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS o FROM events),
w AS (SELECT * FROM (VALUES (1, 'purchase'), (2, 'purchase'), (3, 'signup'), (4, 'nothing')) v(turn, kind)),
p(user_id, turn, ids) AS (SELECT DISTINCT user_id, 0, []::BIGINT[] FROM events UNION ALL
  SELECT p.user_id, p.turn + 1, list_append(p.ids, (SELECT arg_min(e.event_id, (e.event_type <> w.kind, e.o)) FROM e WHERE e.user_id = p.user_id AND NOT list_contains(p.ids, e.event_id))) FROM p JOIN w ON w.turn = p.turn + 1)
SELECT user_id, turn::BIGINT AS turn, ids[turn] AS event_id FROM p WHERE turn > 0 AND ids[turn] IS NOT NULL"""


@query(PICK_SQL)
def picks_without_repeats(t: Tables) -> DataFrame:
    """Four picks a user: the dearest of each wanted kind, any other where there is none."""
    return lists.pick(t.events, "user_id", "event_id", "event_type", -F.col("value"), ["purchase", "purchase", "signup", "nothing"])


@query("""
WITH s AS (SELECT CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts::DATE END AS d, hour(ts) AS h FROM events),
c AS (SELECT coalesce(d::VARCHAR, 'unscheduled') AS day, CASE WHEN d IS NULL THEN 'unscheduled' WHEN h < 11 THEN 'morning' WHEN h < 17 THEN 'afternoon' WHEN h < 21 THEN 'evening' ELSE 'late' END AS section, count(*) AS n FROM s GROUP BY ALL)
SELECT day, section, n, row_number() OVER (PARTITION BY day ORDER BY list_position(['morning', 'afternoon', 'evening', 'late', 'unscheduled'], section)) AS place FROM c
""")
def plan_sections(t: Tables) -> DataFrame:
    """Events by day and section, unscheduled ones last."""
    rows = t.events.select(F.when(F.col("event_id") % 6 != 0, F.to_date("ts")).alias("d"), "ts")
    return lists.sections(rows, "d", T.daypart(T.minutes_of_day(F.col("ts"))), ["morning", "afternoon", "evening", "late"])


@query("""
WITH n AS (SELECT p_partkey AS k, p_brand, unnest([{'day': ['Mon', 'Tue', 'Fri'][1 + p_size % 3], 'title': p_name}, {'day': 'Mon', 'title': CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END}, {'day': 'Mon', 'title': p_type}]) AS x FROM part),
v AS (SELECT DISTINCT p_brand, x.day AS day, x.title AS title FROM n WHERE trim(x.title) <> '')
SELECT p_brand, day, title, row_number() OVER (PARTITION BY p_brand ORDER BY day <> 'Tue', list_position(['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'], day), title) AS place FROM v
""")
def nested_nights(t: Tables) -> DataFrame:
    """Nested entries exploded, checked, deduplicated and put in order: today's first, then by weekday and title."""
    z = F.col("p_size")
    night = lambda d, title: F.struct(d.alias("day"), title.alias("title"))
    nights = F.array(night(F.element_at(F.lit(["Mon", "Tue", "Fri"]), (z % 3 + 1).cast("int")), F.col("p_name")), night(F.lit("Mon"), F.when(z % 4 == 0, " ").otherwise(F.col("p_type"))), night(F.lit("Mon"), F.col("p_type")))
    good = t.part.select("p_brand", F.inline(nights)).filter("trim(title) <> ''").dropDuplicates(["p_brand", "day", "title"])
    week = F.array_position(F.lit(["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]), F.col("day"))
    w = Window.partitionBy("p_brand").orderBy(F.col("day") != "Tue", week, "title")
    return good.withColumn("place", F.row_number().over(w).cast("long"))
