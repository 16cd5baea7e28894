"""Events as providers' nested payloads: normalised to rows, joined to what they concern, and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import forecast, temporal
from millrace.operators import joins, payloads
from millrace.plans.registry import query
from millrace.sources.tables import Tables

HOURS = "struct<properties: struct<periods: array<struct<startTime: string, temperature: double, windSpeed: string, shortForecast: string, name: string, probabilityOfPrecipitation: struct<value: int>, isDaytime: boolean>>>>"
DAYS = "struct<location: struct<name: string>, forecast: struct<forecastday: array<struct<date: string, day: struct<maxtemp_f: double, mintemp_f: double, daily_chance_of_rain: int>>>>>"
ALERTS = "struct<features: array<struct<properties: struct<id: string, event: string, severity: string, urgency: string, headline: string>>>>"


def hourly_payloads(t: Tables) -> DataFrame:
    """JSON payloads of up to fifty periods, one for each event."""
    e = t.events.select(F.to_date("ts").alias("day"), "ts", "event_id", "event_type", "value")
    period = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("startTime"), F.round("value").alias("temperature"), F.concat((F.col("event_id") % 30).cast("string"), F.lit(" to 40 mph")).alias("windSpeed"),
        F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("shortForecast"), F.lit("Later").alias("name"), F.struct(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 100).alias("value")).alias("probabilityOfPrecipitation"), (F.hour("ts") >= 6).alias("isDaytime"),
    )
    return e.groupBy("day", F.floor(F.col("event_id") / 50).alias("part")).agg(F.collect_list(period).alias("periods")).select("day", F.to_json(F.struct(F.struct("periods").alias("properties"))).alias("payload"))


HOUR_SQL = """h AS (SELECT ts::DATE AS day, date_trunc('second', ts) AS at, event_id, round(value) AS temp_f, round((round(value) - 32) * 5 / 9, 1) AS temp_c, (event_id % 30)::DOUBLE AS wind_mph,
  round(event_id % 30 * 1.609344, 1) AS wind_kph, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'Later' END AS condition, CASE WHEN event_id % 5 > 0 THEN (event_id % 100)::INTEGER END AS rain, hour(ts) >= 6 AS is_day FROM events)"""


def hours(t: Tables) -> DataFrame:
    rows = payloads.nested_rows(hourly_payloads(t), "payload", HOURS, "properties.periods", ["day"])
    wind = forecast.first_number(F.col("windSpeed"))
    return rows.select(
        "day", F.col("startTime").cast("timestamp_ntz").alias("at"), F.col("temperature").alias("temp_f"), forecast.celsius(F.col("temperature")).alias("temp_c"), wind.alias("wind_mph"), forecast.kilometres(wind).alias("wind_kph"),
        F.coalesce("shortForecast", "name", F.lit("Forecast")).alias("condition"), F.col("probabilityOfPrecipitation.value").alias("rain"), F.col("isDaytime").alias("is_day"),
    )


@query(f"WITH {HOUR_SQL} SELECT day, at AS moment, temp_f, temp_c, wind_mph, wind_kph, condition, rain, is_day FROM h".replace(" at,", " moment_,").replace("AS at,", "AS moment_,").replace("at AS moment", "moment_ AS moment"))
def hourly_forecast(t: Tables) -> DataFrame:
    """Nested hourly payloads as rows with both units; the first number of a wind text counts."""
    return hours(t).withColumnRenamed("at", "moment")


@query("""
WITH d AS (SELECT ts::DATE AS day, round(max(value), 1) AS hi, round(min(value), 1) AS lo, (max(event_id) % 100)::INTEGER AS rain FROM events GROUP BY 1)
SELECT day::DATE AS day, 'here' AS place, hi AS max_f, lo AS min_f, round((hi - 32) * 5 / 9, 1) AS max_c, rain, CASE WHEN rain >= 70 OR hi >= 105 THEN 'high' WHEN rain >= 40 OR hi >= 95 THEN 'moderate' ELSE 'low' END AS risk FROM d
""")
def daily_forecast(t: Tables) -> DataFrame:
    """Another provider's nested payload as days of the same schema, with a risk."""
    d = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.round(F.max("value"), 1).alias("maxtemp_f"), F.round(F.min("value"), 1).alias("mintemp_f"), (F.max("event_id") % 100).cast("int").alias("daily_chance_of_rain"))
    one = F.struct(F.col("date").cast("string").alias("date"), F.struct("maxtemp_f", "mintemp_f", "daily_chance_of_rain").alias("day"))
    month = d.groupBy(F.trunc("date", "month").alias("m")).agg(F.to_json(F.struct(F.struct(F.lit("here").alias("name")).alias("location"), F.struct(F.collect_list(one).alias("forecastday")).alias("forecast"))).alias("payload"))  # days of a month
    parsed = month.withColumn("place", F.from_json("payload", DAYS)["location"]["name"])
    rows = payloads.nested_rows(parsed, "payload", DAYS, "forecast.forecastday", ["place"])
    return rows.select(
        F.col("date").cast("date").alias("day"), "place", F.col("day.maxtemp_f").alias("max_f"), F.col("day.mintemp_f").alias("min_f"), forecast.celsius(F.col("day.maxtemp_f")).alias("max_c"), F.col("day.daily_chance_of_rain").alias("rain"),
        forecast.risk_level(F.col("day.daily_chance_of_rain"), F.lit(0), F.col("day.maxtemp_f")).alias("risk"),
    )


@query("""
WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN 'Severe' WHEN event_id % 2 = 0 THEN 'Minor' ELSE 'Unknown' END AS severity, CASE WHEN event_id % 50 = 1 THEN 'Immediate' ELSE 'Expected' END AS urgency FROM events WHERE event_type = 'error')
SELECT user_id, count(*) AS alerts, CASE WHEN bool_or(severity = 'Severe' OR urgency = 'Immediate') THEN 'danger' WHEN user_id % 2 = 0 THEN 'caution' ELSE 'none' END AS state FROM a GROUP BY user_id
""")
def alert_states(t: Tables) -> DataFrame:
    """Alerts from feature collections, with defaults, as a state for each user."""
    k = F.col("event_id")
    one = F.struct(F.struct(k.cast("string").alias("id"), F.lit("storm").alias("event"), F.when(k % 9 == 0, "Severe").when(k % 2 == 0, "Minor").alias("severity"), F.when(k % 50 == 1, "Immediate").alias("urgency"), F.lit("h").alias("headline")).alias("properties"))
    feeds = t.events.filter("event_type = 'error'").groupBy("user_id", F.floor(k / 1000)).agg(F.to_json(F.struct(F.collect_list(one).alias("features"))).alias("payload"))
    rows = payloads.nested_rows(feeds, "payload", ALERTS, "features", ["user_id"]).select("user_id", F.coalesce("properties.severity", F.lit("Unknown")).alias("severity"), F.coalesce("properties.urgency", F.lit("Expected")).alias("urgency"))
    each = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"), F.collect_set("severity").alias("s"), F.collect_set("urgency").alias("u"))
    return each.select("user_id", "alerts", forecast.storm_state(F.col("s"), F.col("u"), F.when(F.col("user_id") % 2 == 0, "high")).alias("state"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, value FROM events), s AS (SELECT event_id, user_id, ts, ts + INTERVAL 30 MINUTE AS fin, ts - INTERVAL 20 MINUTE AS now FROM e WHERE event_id % 10 = 0),
j AS (SELECT s.event_id, max(h.value) AS rain, max((h.event_id % 60)::INTEGER) AS thunder, count(h.event_id) AS n FROM s LEFT JOIN e h ON h.user_id = s.user_id AND h.ts >= s.now - INTERVAL 15 MINUTE AND h.ts <= greatest(s.fin, s.ts + INTERVAL 60 MINUTE) GROUP BY s.event_id)
SELECT event_id, n, CASE WHEN event_id % 90 = 0 THEN 'storm_alert' WHEN n = 0 THEN 'unknown' WHEN rain >= 60 OR thunder >= 40 THEN 'likely' WHEN rain >= 30 OR thunder >= 20 THEN 'possible' ELSE 'unlikely' END AS answer FROM j
""")
def near_term_rain(t: Tables) -> DataFrame:
    """For each tenth event, the greatest measures of its user within its window, classified."""
    e = t.events.select("event_id", "user_id", "ts", "value")
    shift = lambda m: F.timestamp_add("MINUTE", F.lit(m), F.col("ts"))
    spans = e.filter("event_id % 10 = 0").select("event_id", F.col("user_id").alias("u"), shift(-35).alias("lo"), F.greatest(shift(30), shift(60)).alias("hi"))
    measured = e.select("user_id", "ts", "value", (F.col("event_id") % 60).cast("int").alias("thunder"))
    met = joins.in_range(spans, measured, (F.col("u"), F.col("user_id")), ("lo", "hi"), "ts", 3600)
    worst = met.groupBy("event_id").agg(F.max("value").alias("rain"), F.max("thunder").alias("thunder"), F.count(F.lit(1)).alias("n"))
    out = spans.select("event_id").join(worst, "event_id", "left")
    answer = forecast.rain_signal(F.lit(20), F.col("rain"), F.col("thunder"), F.lit(None).cast("double"), F.lit(False), F.col("event_id") % 90 == 0)
    return out.select("event_id", F.coalesce("n", F.lit(0)).alias("n"), answer.alias("answer"))


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE hour(ts) < 12 AND day(ts) % 3 <> 0 GROUP BY 1), f AS (SELECT n AS first_n, day AS first_day FROM d ORDER BY day LIMIT 1)
SELECT e.event_id, coalesce(d.day, first_day) AS day, coalesce(d.n, first_n) AS n FROM events e LEFT JOIN d ON d.day = e.ts::DATE, f
""")
def day_or_first(t: Tables) -> DataFrame:
    """Each event's day among known days, else the first known day."""
    days = t.events.filter("hour(ts) < 12 and day(ts) % 3 <> 0").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return joins.equal_or_first(t.events.select("event_id", F.to_date("ts").alias("day")), days, "day", ["n"])


@query("""
WITH e AS (SELECT event_id, user_id, ts, value, date_diff('second', TIMESTAMP '2024-01-15 12:00:00', ts) / 3600.0 AS out FROM events)
SELECT event_id, CASE WHEN out < 0 OR event_id % 3 = 0 THEN false WHEN event_id % 7 = 0 OR out > 72 THEN false ELSE true END AS allowed,
  CASE WHEN out < 0 OR event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 OR out > 72 THEN 'soft_planning_only' WHEN (event_id % 100) - (user_id % 50) >= 20 THEN 'go_earlier' ELSE 'keep_time' END AS advice,
  CASE WHEN event_id % 11 = 0 THEN 'changed' WHEN ts <= TIMESTAMP '2024-01-15 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00' < ts + INTERVAL 2 HOUR THEN 'now' WHEN out > 0 AND out <= 1.5 THEN 'soon' WHEN event_id % 2 = 0 AND ts - INTERVAL 1 DAY <= TIMESTAMP '2024-01-15 12:00:00' AND date_diff('second', ts - INTERVAL 1 DAY, TIMESTAMP '2024-01-15 12:00:00') <= 1209600 THEN 'verified' END AS living,
  CASE WHEN out < 0 AND ts + INTERVAL 2 HOUR >= TIMESTAMP '2024-01-15 12:00:00' THEN 'hourly' WHEN out < 0 THEN 'past' WHEN out <= 72 THEN 'hourly' WHEN out <= 168 THEN 'daily' WHEN out <= 360 THEN 'outlook' ELSE 'none' END AS route,
  CASE WHEN value >= 70 THEN CASE WHEN user_id % 3 = 0 THEN 'stop' ELSE 'slow' END WHEN value >= 40 THEN CASE WHEN user_id % 3 < 2 THEN 'slow' ELSE 'none' END ELSE 'none' END AS impact FROM e
""")
def timing_advice(t: Tables) -> DataFrame:
    """Advice on timing, living states, forecast routes that count what is under way from now, and what risks do to ways of travel."""
    now, k = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), F.col("event_id")
    seconds = lambda c: temporal.seconds_apart(now, c)
    end = F.timestamp_add("HOUR", F.lit(2), F.col("ts"))
    advice = forecast.timing_advice(seconds(F.col("ts")) / 3600.0, k % 3 != 0, k % 7 == 0, k % 100, F.col("user_id") % 50)
    living = forecast.living_state(k % 11 == 0, F.col("ts"), end, F.when(k % 2 == 0, F.timestamp_add("DAY", F.lit(-1), F.col("ts"))), now)
    route = temporal.horizon(seconds(forecast.effective_start(F.col("ts"), end, now)) / 3600.0)
    mode = F.element_at(F.lit(["boat", "walk", "bus"]), (F.col("user_id") % 3 + 1).cast("int"))
    impact = forecast.route_impact(mode, forecast.risk_level(F.col("value"), F.lit(0), F.lit(0)))
    return t.events.select("event_id", advice["allowed"].alias("allowed"), advice["advice"].alias("advice"), living.alias("living"), route.alias("route"), impact.alias("impact"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS z, p_name, p_type FROM part)
SELECT k, CASE WHEN z % 3 = 0 THEN 'b' || z ELSE 'a' || z END AS last_claim, z::VARCHAR AS cents, CASE WHEN z % 2 = 0 THEN p_type ELSE p_name END AS label, 'x=1,y=' || z AS entries, z > 25 AS any_big, CASE WHEN z % 4 = 0 THEN '' ELSE p_name || ',' || p_type END AS items,
  '{"name":"' || p_name || '","size":"' || z || '"}' AS kept, p_type AS merged_type, CASE WHEN z % 5 = 0 THEN '9' ELSE z::VARCHAR END AS merged_size, (z / 2)::INTEGER AS x0, greatest(z + 10, 40)::INTEGER AS x1, z % 10 < 6 AS inside FROM (SELECT *, CASE WHEN (z % 4) = 1 THEN z // 2 WHEN z % 4 = 3 THEN z // 2 + 1 ELSE z // 2 END AS half FROM p)
""".replace("(z / 2)::INTEGER AS x0", "half::INTEGER AS x0"))
def json_shapes(t: Tables) -> DataFrame:
    """Arrays of claims as maps, spellings of keys, maps as entries, arrays by type, members kept and merged, boxes."""
    z, zs = F.col("p_size"), F.col("p_size").cast("string")
    claims = F.array(F.struct(F.lit("c").alias("field"), F.concat(F.lit("a"), zs).alias("v")), F.when(z % 3 == 0, F.struct(F.lit("c").alias("field"), F.concat(F.lit("b"), zs).alias("v"))).otherwise(F.struct(F.lit(None).cast("string").alias("field"), F.lit("n").alias("v"))))
    priced = F.when(z % 2 == 0, F.to_json(F.struct(zs.alias("price_cents"), F.col("p_type").alias("priceLabel")))).otherwise(F.to_json(F.struct(zs.alias("priceCents"), F.col("p_name").alias("price_label"))))
    spelt = payloads.coalesce_spellings(priced, ["price_cents", "price_label"])
    m = F.create_map(F.lit("y"), z, F.lit("x"), F.lit(1))
    shown = F.array_join(F.transform(payloads.map_to_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    listed = F.when(z % 4 == 0, F.to_json(F.struct("p_name"))).otherwise(F.to_json(F.array("p_name", "p_type")))
    row = F.to_json(F.struct(zs.alias("size"), F.col("p_type").alias("secret"), F.col("p_name").alias("name")))
    merged = payloads.merge_objects(F.to_json(F.struct(zs.alias("size"), F.lit("old").alias("type"))), F.to_json(F.struct(F.col("p_type").alias("type"), F.when(z % 5 == 0, "9").alias("size"))))
    box = payloads.box_of(F.array(F.array(z / 2.0, F.lit(1.0)), F.array(z + 10.0, F.lit(3.0))))
    both = payloads.box_union(F.array(box, F.struct(F.lit(40).alias("x0"), F.lit(0).alias("y0"), F.lit(40).alias("x1"), F.lit(9).alias("y1")), F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>")))
    spot = F.struct(both["x0"].alias("x0"), F.lit(1).alias("y0"), both["x1"].alias("x1"), (z % 10 + 4).alias("y1"))
    return t.part.select(
        F.col("p_partkey").alias("k"), payloads.entries_to_map(claims, "field", "v")["c"].alias("last_claim"), spelt["price_cents"].alias("cents"), spelt["price_label"].alias("label"), shown.alias("entries"), payloads.any_value(m, lambda v: v > 25).alias("any_big"),
        F.array_join(payloads.texts_of(listed), ",").alias("items"), payloads.keep_members(row, ["name", "size", "none"]).alias("kept"), merged["type"].alias("merged_type"), merged["size"].alias("merged_size"), both["x0"].alias("x0"), both["x1"].alias("x1"), payloads.box_contains(both, spot).alias("inside"),
    )


@query("""
WITH v AS (SELECT * FROM (VALUES (1, 'cold widget', 5), (2, 'blue ring', NULL), (NULL, 'none', 7)) x(part, name, bonus))
SELECT p_partkey AS k, p_name, v.bonus FROM part JOIN v ON v.name = p_name
""")
def inline_json_table(t: Tables) -> DataFrame:
    """Parts joined with a table written as inline JSON; missing members are null."""
    v = payloads.json_rows(t.spark, '[{"part":1,"name":"cold widget","bonus":5},{"part":2,"name":"blue ring"},{"name":"none","bonus":7}]', "part int, name string, bonus int")
    return t.part.join(v.select(F.col("name").alias("p_name"), "bonus"), "p_name").select(F.col("p_partkey").alias("k"), "p_name", "bonus")


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), b AS (SELECT *, CASE WHEN z % 9 = 0 THEN 'needs_check' WHEN z % 2 = 0 AND z % 20 <= 7 THEN 'verified' WHEN z % 2 = 0 THEN 'likely' ELSE 'unverified' END AS base, ['good', 'low', 'hidden', 'review'][1 + k % 4] AS tier FROM p)
SELECT k, CASE WHEN tier = 'hidden' AND base <> 'needs_check' THEN 'hidden' WHEN tier = 'low' AND base IN ('verified', 'likely') THEN 'unverified' WHEN tier = 'review' AND base = 'verified' THEN 'needs_check' ELSE base END AS state,
  CASE WHEN z % 4 <> 3 THEN CASE WHEN z % 3 = 0 AND z % 5 <> 0 THEN true WHEN z % 3 <> 0 AND z % 5 = 0 THEN false END END AS fee, (z % 3 = 0 AND z % 5 = 0) OR (z % 4 = 3 AND (z % 3 = 0) <> (z % 5 = 0)) AS review,
  CASE WHEN z % 6 = 0 THEN 'here' WHEN z % 6 < 3 THEN 'same_area' WHEN z % 2 = 1 THEN 'one_ride' ELSE 'far' END AS near FROM b
""")
def trust_states(t: Tables) -> DataFrame:
    """Trust by evidence and tier, fees by what title and body say, and nearness."""
    k, z = F.col("p_partkey"), F.col("p_size")
    base = forecast.base_trust(z % 20, z % 2 == 0, z % 9 == 0)
    tier = F.element_at(F.lit(["good", "low", "hidden", "review"]), (k % 4 + 1).cast("int"))
    fee = forecast.fee_verdict(z % 3 == 0, F.lit(False), z % 5 == 0, z % 4 != 3)
    near = forecast.proximity(z % 6, F.lit(0), F.when(z % 6 < 3, "a").otherwise("b"), F.lit("a"), z % 2 == 1)
    return t.part.select(k.alias("k"), forecast.trust_state(base, tier).alias("state"), fee["fee"].alias("fee"), fee["review"].alias("review"), near.alias("near"))
