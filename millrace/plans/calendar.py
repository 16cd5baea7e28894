"""Events as a calendar: density, states, sequences, intervals and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import temporal as T
from millrace.operators import aggregates, joins, ranking, sequences
from millrace.plans.registry import query
from millrace.sources.tables import Tables

NOW = "2024-01-15 12:00:00"
DAYPART_SQL = "CASE WHEN hour(ts) < 11 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' WHEN hour(ts) < 21 THEN 'evening' ELSE 'late' END"


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"""
WITH e AS (SELECT ts::DATE AS day, {DAYPART_SQL} AS part, event_type, value, user_id FROM events),
n AS (SELECT day, event_type, count(*) AS n FROM e GROUP BY ALL),
m AS (SELECT day, event_type FROM n QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) = 1)
SELECT e.day, count(*) AS total, count(*) FILTER (part = 'morning') AS morning, count(*) FILTER (part = 'afternoon') AS afternoon,
  count(*) FILTER (part = 'evening') AS evening, count(*) FILTER (part = 'late') AS late, any_value(m.event_type) AS top_type,
  count(*) FILTER (value < 10) AS cheap, count(*) FILTER (value >= 10 AND value < 50) AS middling, count(*) FILTER (value >= 50) AS dear, count(DISTINCT user_id) AS users
FROM e JOIN m USING (day) GROUP BY e.day
""")
def calendar_density(t: Tables) -> DataFrame:
    """Events per day by daypart and price tier, with the day's leading type."""
    e = t.events.select(F.to_date("ts").alias("day"), T.daypart(T.minutes_of_day(F.col("ts"))).alias("part"), "event_type", "value", "user_id")
    tiers = {"cheap": F.count_if(F.col("value") < 10), "middling": F.count_if((F.col("value") >= 10) & (F.col("value") < 50)), "dear": F.count_if(F.col("value") >= 50), "users": F.countDistinct("user_id")}
    return aggregates.density(e, "day", F.col("part"), ["morning", "afternoon", "evening", "late"], {"event_type": "top_type"}, tiers)


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (hour(ts) >= 17) AS evening, count(*) FILTER (value < 10) AS cheap,
  round(count(*) FILTER (value < 10) / count(*), 6) AS cheap_share, count(DISTINCT ts::DATE) AS days
FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts < TIMESTAMP '2024-01-22 12:00:00' GROUP BY event_type
""")
def future_insights(t: Tables) -> DataFrame:
    """The coming week by type: how many, in the evening, cheap."""
    e = t.events.filter((F.col("ts") >= now()) & (F.col("ts") < F.timestamp_add("DAY", F.lit(7), now())))
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.hour("ts") >= 17).alias("evening"), F.count_if(F.col("value") < 10).alias("cheap"),
        F.round(aggregates.rate(F.col("value") < 10), 6).alias("cheap_share"), F.countDistinct(F.to_date("ts")).alias("days"),
    )


@query(f"""
WITH c AS (SELECT {DAYPART_SQL} AS part, event_type, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY part) AS top FROM c)
SELECT part, event_type, n, floor(n * 100 / top + 0.5) / 100 AS intensity,
  CASE WHEN top = 1 THEN 'medium' WHEN n = top THEN 'large' WHEN n >= ceil(top / 2) THEN 'medium' ELSE 'small' END AS size FROM m
""")
def constellation(t: Tables) -> DataFrame:
    """Types within dayparts, sized by their share of the daypart's largest."""
    c = t.events.groupBy(T.daypart(T.minutes_of_day(F.col("ts"))).alias("part"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.share_of_top(c, "n", ["part"])


@query(f"""
WITH e AS (SELECT event_id, ts AS s, CASE WHEN event_id % 5 <> 0 THEN ts + to_minutes((value::INT % 180)::BIGINT) END AS e, TIMESTAMP '{NOW}' AS n FROM events)
SELECT event_id, CASE WHEN s <= n AND n <= coalesce(e, s + INTERVAL 120 MINUTE) THEN 'live'
  WHEN s > n AND epoch(s) - epoch(n) < 5401 THEN 'soon' WHEN s > n AND s::DATE = n::DATE THEN 'later_today' WHEN s > n THEN 'upcoming' ELSE 'ended' END AS state FROM e
""")
def availability_state(t: Tables) -> DataFrame:
    """Every event's state at a fixed time; a missing end is two hours after the start."""
    end = F.when(F.col("event_id") % 5 != 0, F.timestamp_add("MINUTE", F.rint("value").cast("int") % 180, F.col("ts")))  # halves go to the even minute, as casts do in SQL
    return t.events.select("event_id", T.live_state(F.col("ts"), end, now()).alias("state"))


@query(f"""
WITH e AS (SELECT event_id, ts, floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '{NOW}')::BIGINT AS away FROM events WHERE ts::DATE = DATE '2024-01-15')
SELECT event_id, CASE WHEN away > 0 THEN 0 WHEN away >= -3600 THEN 1 ELSE 2 END AS bucket,
  row_number() OVER (ORDER BY CASE WHEN away > 0 THEN 0 WHEN away >= -3600 THEN 1 ELSE 2 END, abs(away), event_id) AS place FROM e
""")
def happening_soon(t: Tables) -> DataFrame:
    """One day's events: coming ones by start, running ones, past ones by age."""
    e = t.events.filter(F.to_date("ts") == F.to_date(now())).withColumn("away", T.epoch_seconds(F.col("ts")) - T.epoch_seconds(now()))
    e = e.withColumn("bucket", F.when(F.col("away") > 0, 0).when(F.col("away") >= -3600, 1).otherwise(2))
    e = e.withColumn("gap", F.abs("away"))
    # one row for each bucket and second of a day goes through one task, however many events the day has
    before = e.groupBy("bucket", "gap").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("bucket", "gap")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("bucket", "gap").orderBy("event_id"))
    return e.join(before, ["bucket", "gap"]).select("event_id", "bucket", (F.col("before") + nth).cast("long").alias("place"))


@query("""
WITH e AS (SELECT user_id, event_id AS id, ts AS s, ts + to_minutes((30 + event_id % 90)::BIGINT) AS e FROM events)
SELECT a.user_id, a.id AS id_a, b.id AS id_b,
  floor((epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s))) // 1000000 / 60.0 + 0.5)::BIGINT AS minutes
FROM e a JOIN e b ON a.user_id = b.user_id AND a.id < b.id AND a.s < b.e AND b.s < a.e
""")
def overlap_pairs(t: Tables) -> DataFrame:
    """Events of one user that overlap, with the minutes shared."""
    e = t.events.withColumn("end", F.timestamp_add("MINUTE", (30 + F.col("event_id") % 90).cast("int"), F.col("ts")))
    return joins.overlap_pairs(e, ["user_id"], "event_id", "ts", "end")


@query("""
WITH p AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
g AS (SELECT *, (epoch_us(ts) - epoch_us(pt)) // 1000000 / 60.0 AS gap FROM p)
SELECT user_id, event_id, floor(gap + 0.5)::BIGINT AS gap_minutes, pe IS NOT NULL AND pe <> event_type AS changed,
  CASE WHEN gap IS NULL THEN 'first' WHEN floor(gap + 0.5) <= 30 THEN 'tight' WHEN floor(gap + 0.5) <= 90 THEN 'short' ELSE 'open' END AS connector FROM g
""")
def adjacent_pairs(t: Tables) -> DataFrame:
    """Each event with the class of the gap to the one before on the same day."""
    p = sequences.with_previous(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], ["ts", "event_type"])
    gap = T.minutes_between(F.col("prev_ts"), F.col("ts"))
    changed = F.coalesce(F.col("prev_event_type") != F.col("event_type"), F.lit(False))
    return p.select("user_id", "event_id", gap.alias("gap_minutes"), changed.alias("changed"), sequences.gap_class(gap).alias("connector"))


@query("""
WITH p AS (SELECT user_id, ts::DATE AS day, ts, event_type, lag(ts) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)),
a AS (SELECT user_id, day, count(*) AS items, count(*) FILTER ((epoch_us(ts) - epoch_us(pt)) // 1000000 < 1800) AS short_gaps, count(*) FILTER (pe <> event_type) AS moves FROM p GROUP BY ALL)
SELECT *, greatest(0, least(100, 92 - 13 * short_gaps - 7 * greatest(0, moves - 1))) AS score FROM a
""")
def pace_score(t: Tables) -> DataFrame:
    """How relaxed each user's day is."""
    return sequences.pace(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], "ts", "event_id", "event_type")


@query("""
WITH p AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS pt, lag(event_type) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id))
SELECT user_id, pe AS from_type, event_type AS to_type, min(event_id) AS first_event, count(*) AS hops FROM p
WHERE pe <> event_type AND (epoch_us(ts) - epoch_us(pt)) // 1000000 <= 2700 GROUP BY ALL
""")
def tight_hops(t: Tables) -> DataFrame:
    """Changes of type within 45 minutes, each pair once per user."""
    p = sequences.with_previous(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], ["ts", "event_type"])
    hop = (F.col("prev_event_type") != F.col("event_type")) & (F.timestamp_diff("SECOND", F.col("prev_ts"), F.col("ts")) <= 2700)
    return p.filter(hop).groupBy("user_id", F.col("prev_event_type").alias("from_type"), F.col("event_type").alias("to_type")).agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("hops"))


@query("""
SELECT ts::DATE AS day, hour(ts)::INT AS hour, event_id, event_type FROM events WHERE hour(ts) >= 17
QUALIFY row_number() OVER (PARTITION BY ts::DATE, hour(ts) ORDER BY ts, event_id) = 1
""")
def first_per_hour(t: Tables) -> DataFrame:
    """Each evening hour's first event."""
    e = t.events.filter(F.hour("ts") >= 17).withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})
    return ranking.first_per(e, ["day", "hour"], [F.col("ts"), F.col("event_id")]).select("day", "hour", "event_id", "event_type")


@query("""
WITH p AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt FROM events),
i AS (SELECT *, sum(CASE WHEN (epoch_us(ts) - epoch_us(pt)) // 1000000 >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM p)
SELECT user_id, island::BIGINT AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY ALL
""")
def gaps_islands(t: Tables) -> DataFrame:
    """Runs of a user's events without six hours of silence."""
    return sequences.islands(t.events, ["user_id"], "ts", "event_id", 6 * 3600)


def _hours(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("severity"))


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'error') AS severity FROM events GROUP BY 1),
s AS (SELECT event_id, ts AS s, ts + INTERVAL 3 HOUR AS e FROM events WHERE event_type = 'purchase'),
m AS (SELECT event_id, hour, severity, greatest((epoch_us(s) - epoch_us(hour)) // 1000000,
   (epoch_us(hour) - epoch_us(e)) // 1000000, 0) AS away FROM s JOIN h ON hour BETWEEN s - INTERVAL 3 HOUR AND e + INTERVAL 3 HOUR),
b AS (SELECT * FROM m WHERE away <= 7200 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY away, CASE WHEN away = 0 THEN -severity ELSE 0 END, hour) = 1)
SELECT s.event_id, b.hour, b.severity, b.away = 0 AS inside FROM s LEFT JOIN b USING (event_id)
""")
def worst_hour_in_span(t: Tables) -> DataFrame:
    """The worst hour within three hours of each purchase, else the nearest."""
    spans = t.events.filter("event_type = 'purchase'").select("event_id", "ts", F.timestamp_add("HOUR", F.lit(3), F.col("ts")).alias("end"))
    return joins.worst_in_span(spans, "event_id", "ts", "end", _hours(t), "hour", "severity")


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (event_type = 'error') AS severity FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0),
m AS (SELECT event_id, hour, severity, abs(epoch_us(hour) - epoch_us(ts)) // 1000000 AS away FROM events JOIN h ON hour BETWEEN ts - INTERVAL 3 HOUR AND ts + INTERVAL 3 HOUR WHERE event_type = 'signup')
SELECT e.event_id, b.hour, b.severity FROM (SELECT event_id FROM events WHERE event_type = 'signup') e
LEFT JOIN (SELECT * FROM m WHERE away <= 7200 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY away, hour) = 1) b USING (event_id)
""")
def nearest_hour(t: Tables) -> DataFrame:
    """The nearest hour with an error within two hours of each signup."""
    spans = t.events.filter("event_type = 'signup'").select("event_id", "ts", F.col("ts").alias("end"))
    return joins.worst_in_span(spans, "event_id", "ts", "end", _hours(t).filter("severity > 0"), "hour", "severity").drop("inside")


@query("""
WITH w AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 3600 AS window_start, floor(epoch(ts))::BIGINT AS sec, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS used FROM w)
SELECT user_id, event_id, window_start, used::INT AS used, used <= 2 AS allowed, greatest(2 - used, 0)::INT AS remaining, CASE WHEN used > 2 THEN window_start + 3600 - sec ELSE 0 END AS retry_after FROM n
""")
def rate_limit(t: Tables) -> DataFrame:
    """Two events an hour for each user in fixed windows."""
    e = t.events.withColumn("window_start", T.window_start(F.col("ts"), 3600))
    used = F.row_number().over(Window.partitionBy("user_id", "window_start").orderBy("ts", "event_id"))
    e = e.withColumn("used", used)
    wait = F.when(F.col("used") > 2, F.col("window_start") + 3600 - T.epoch_seconds(F.col("ts"))).otherwise(0)
    return e.select("user_id", "event_id", "window_start", "used", (F.col("used") <= 2).alias("allowed"), F.greatest(2 - F.col("used"), F.lit(0)).alias("remaining"), wait.alias("retry_after"))


@query("""
WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1),
p AS (SELECT *, lag(n) OVER w AS pn, lag(errors) OVER w AS pe, lag(mean) OVER w AS pm FROM d WINDOW w AS (ORDER BY day)),
c AS (SELECT day, unnest(list_filter([CASE WHEN abs(n - pn) * 100 > 10 * pn THEN 'volume' END, CASE WHEN errors - pe >= 5 THEN 'errors' END, CASE WHEN mean > 52 AND pm <= 52 THEN 'dearer' END], lambda x: x IS NOT NULL)) AS change FROM p)
SELECT day, change FROM c
""")
def material_changes(t: Tables) -> DataFrame:
    """What changed from one day to the next by more than a threshold."""
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean"))
    p = d.withColumns({f"p_{c}": F.lag(c).over(Window.orderBy("day")) for c in ("n", "errors", "mean")})  # one row a day
    rules = F.array_compact(F.array(
        F.when(F.abs(F.col("n") - F.col("p_n")) * 100 > 10 * F.col("p_n"), "volume"), F.when(F.col("errors") - F.col("p_errors") >= 5, "errors"), F.when((F.col("mean") > 52) & (F.col("p_mean") <= 52), "dearer")
    ))
    return p.select("day", F.explode(rules).alias("change"))


@query("""
WITH s AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day), u AS (SELECT unnest(['signup', 'purchase', 'error', 'view', 'click', 'refund']) AS event_type),
c AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT s.day, u.event_type, coalesce(c.n, 0) AS n FROM s CROSS JOIN u LEFT JOIN c USING (day, event_type)
""")
def daily_zero_fill(t: Tables) -> DataFrame:
    """Every day of five weeks by type, with 0 where nothing happened."""
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day"))
    spine = days.withColumn("event_type", F.explode(F.lit(["signup", "purchase", "error", "view", "click", "refund"])))
    facts = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.zero_fill(spine, facts, ["day", "event_type"], ["n"])


@query(f"""
WITH e AS (SELECT event_id, ts, hour(ts) AS h, floor(epoch(ts))::BIGINT - epoch(TIMESTAMP '{NOW}')::BIGINT AS away FROM events WHERE ts::DATE = DATE '2024-01-15'),
b AS (SELECT 'now' AS bucket, * FROM e WHERE away BETWEEN -1800 AND 0 UNION ALL SELECT 'afternoon', * FROM e WHERE away > 0 AND h BETWEEN 12 AND 16
  UNION ALL SELECT 'evening', * FROM e WHERE h BETWEEN 17 AND 21 UNION ALL SELECT 'tonight', * FROM e WHERE h >= 22)
SELECT bucket, event_id, row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) AS place FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY ts, event_id) <= 5
""")
def timeline_buckets(t: Tables) -> DataFrame:
    """One day's first five events of each labelled bucket; an event can be in several."""
    e = t.events.filter(F.to_date("ts") == F.to_date(now())).withColumn("away", T.epoch_seconds(F.col("ts")) - T.epoch_seconds(now()))
    h = F.hour("ts")
    labels = F.array_compact(F.array(F.when(F.col("away").between(-1800, 0), "now"), F.when((F.col("away") > 0) & h.between(12, 16), "afternoon"), F.when(h.between(17, 21), "evening"), F.when(h >= 22, "tonight")))
    return ranking.top_per(e.withColumn("bucket", F.explode(labels)), ["bucket"], [F.col("ts"), F.col("event_id")], 5, "place").select("bucket", "event_id", "place")


@query("""
SELECT event_id, ts::DATE AS day, dayofweek(ts)::INT AS day_number, (hour(ts) * 60 + minute(ts))::INT AS minutes,
  CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS label,
  (ts::DATE + ((3 - dayofweek(ts) + 7) % 7)::INT)::DATE AS next_wednesday, 'FY' || strftime(ts::DATE + INTERVAL 3 MONTH, '%y') || '-Q' || quarter(ts::DATE + INTERVAL 3 MONTH) AS quarter,
  floor(epoch(ts))::BIGINT - floor(epoch(ts))::BIGINT % 900 AS window_start FROM events
""")
def time_labels(t: Tables) -> DataFrame:
    """Calendar scalars of every event."""
    ts, day = F.col("ts"), F.to_date("ts")
    minutes = T.minutes_of_day(ts)
    return t.events.select("event_id", day.alias("day"), T.day_number(day).alias("day_number"), minutes.alias("minutes"), T.clock_label(minutes).alias("label"),
        T.next_day_on(day, F.lit(3)).alias("next_wednesday"), T.fiscal_quarter(day).alias("quarter"), T.window_start(ts, 900).alias("window_start"))


@query("""
WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_type FROM events)
SELECT user_id, event_id, prev_event_type, event_type FROM p WHERE prev_event_type <> event_type
""")
def state_transitions(t: Tables) -> DataFrame:
    """Events whose type differs from the user's one before."""
    return sequences.transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "prev_event_type", "event_type")


@query("""
WITH e AS (SELECT ts::DATE AS day, event_type, count(*) AS n, count(*) FILTER (value < 10) AS cheap, count(*) FILTER (hour(ts) >= 17) AS evening, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
SELECT *, 10 * n + 3 * cheap + 2 * evening + users AS score, row_number() OVER (PARTITION BY day ORDER BY 10 * n + 3 * cheap + 2 * evening + users DESC, event_type) AS place FROM e
""")
def group_scores(t: Tables) -> DataFrame:
    """A day's types by a composite score."""
    g = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 10).alias("cheap"), F.count_if(F.hour("ts") >= 17).alias("evening"), F.countDistinct("user_id").alias("users"))
    g = g.withColumn("score", 10 * F.col("n") + 3 * F.col("cheap") + 2 * F.col("evening") + F.col("users"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "event_type")).cast("long"))


LABEL_SQL = "((hour({0}) + 11) % 12 + 1)::VARCHAR || ':' || lpad(minute({0})::VARCHAR, 2, '0') || CASE WHEN hour({0}) < 12 THEN ' AM' ELSE ' PM' END"


@query(f"""
WITH e AS (SELECT event_id, event_type, props, CASE WHEN event_id % 7 > 0 THEN ts END AS s, CASE WHEN event_id % 3 > 0 THEN ts + to_minutes((event_id % 13 * 70 - 60)::BIGINT) END AS f FROM events),
t AS (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN repeat(props || ' ', 1 + event_id % 20) WHEN 2 THEN 'from 7:00 PM' WHEN 3 THEN event_type ELSE '' END AS x, event_id % 5 = 3 AND event_type <> 'click' AS doubtful, CASE WHEN event_id % 5 = 2 THEN '7:00 PM' END AS y, event_id % 2 = 0 AS r,
  hour(s) * 60 + minute(s) AS a, hour(f) * 60 + minute(f) AS b FROM e),
d AS (SELECT *, coalesce(a <= 540 AND CASE WHEN b < a THEN b + 1440 ELSE b END >= 1200 AND CASE WHEN b < a THEN b + 1440 ELSE b END - a >= 600, false) AS whole FROM t),
l AS (SELECT event_id, CASE WHEN f < s THEN ['?'] WHEN x <> '' AND NOT doubtful THEN CASE WHEN whole AND NOT r THEN ['?'] WHEN y IS NOT NULL THEN [y] WHEN s IS NULL THEN [NULL] ELSE [CASE WHEN length(x) > 80 THEN substr(x, 1, 77) || '…' ELSE x END] END
  WHEN x <> '' THEN CASE WHEN s IS NULL THEN [NULL] ELSE ['?'] END WHEN whole THEN ['?'] WHEN s IS NULL THEN [NULL] WHEN f IS NULL THEN [{LABEL_SQL.format("s")}, '!'] WHEN a = b THEN [{LABEL_SQL.format("s")}] ELSE [{LABEL_SQL.format("s")} || ' – ' || {LABEL_SQL.format("f")}] END AS v FROM d)
SELECT event_id, CASE WHEN v[1] = '?' THEN 'Time needs confirmation' ELSE v[1] END AS label, coalesce(v[1] = '?', false) OR len(v) = 2 AS uncertain FROM l
""")
def display_times(t: Tables) -> DataFrame:
    """What to say of events' times: their text, their times, or that they need confirmation."""
    k = F.col("event_id")
    start, end = F.when(k % 7 > 0, F.col("ts")), F.when(k % 3 > 0, F.timestamp_add("MINUTE", (k % 13 * 70 - 60).cast("int"), F.col("ts")))
    text = F.when(k % 5 == 1, F.repeat(F.concat("props", F.lit(" ")), (k % 20 + 1).cast("int"))).when(k % 5 == 2, "from 7:00 PM").when(k % 5 == 3, F.col("event_type")).when(k % 5 == 4, "")
    shown = T.display_time(start, end, text, F.when(k % 5 == 2, "7:00 PM"), k % 2 == 0, (k % 5 == 3) & (F.col("event_type") != "click"))
    return t.events.select("event_id", shown.alias("d")).select("event_id", "d.*")
