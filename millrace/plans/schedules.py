"""Schedule texts read by the grammar, and rules expanded into timed occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import schedules
from millrace.operators import recurrence
from millrace.plans.registry import query
from millrace.sources.tables import Tables

ZONE = "America/New_York"

#: Pieces of schedule texts as printed and as scanned; a key picks one of each list.
HEADS = ["", "Daily", "Nightly", "Mon, Wed & Fri", "Tuesday and  Thursday", "Sun", "Sat.", "Weekends", "Thurs", "Wed  fri. wednesday", "Open 24 hours, 7 days"]
LINKS = [" from ", " at ", " ", " fro* ", " =ro", ", "]
FIRSTS = ["9 am", "7:3O p.m.", "10.15am", "noon", "12:450m", "I1:00 pm", "8:00 PM", "12 am", "", "7:OOpm", "13 pm", "8:15"]
MIDDLES = [" - ", " to ", " a1d ", "; Sunday from ", " – ", "; Fri & Sat at ", ";; bring a towel; "]
LASTS = ["5 pm", "11:O0 pm", "", "10:00", "dawn to dusk", "24 hours, 7 days", "1:15 a.m.", "Tue 6pm"]
PIECES = [HEADS, LINKS, FIRSTS, MIDDLES, LASTS]


def _spoken(key: Column) -> Column:
    """A schedule text for a key: one piece of each list, as digits of the key in mixed bases."""
    parts, left = [], key
    for pieces in PIECES:
        parts.append(F.element_at(F.lit(pieces), (left % len(pieces) + 1).cast("int")))
        left = F.floor(left / len(pieces))
    return F.concat(*parts)


def _spoken_sql(key: str) -> str:
    parts, over = [], 1
    for pieces in PIECES:
        parts.append(f"([{', '.join(repr(p) for p in pieces)}])[({key} // {over}) % {len(pieces)} + 1]")
        over *= len(pieces)
    return " || ".join(parts)


def _days_sql(text: str) -> str:
    """Days named before from or at, in order, from the text alone."""
    names, numbers = [*schedules.DAY_WORDS], [*schedules.DAY_WORDS.values()]
    words = f"regexp_split_to_array(replace(replace(regexp_replace(lower({text}), '(?s)\\b(?:from|at)\\b.*', ''), '&', ','), ' and ', ','), '[\\s,]+')"
    days = f"list_filter(list_transform({words}, lambda w: {numbers}[list_position({names}, trim(w, '.'))]), lambda d: d IS NOT NULL)"
    return f"CASE WHEN regexp_matches(lower({text}), '\\b(?:daily|nightly)\\b') THEN [1, 2, 3, 4, 5, 6, 0] ELSE list_filter({days}, lambda d, i: list_position({days}, d) = i) END"


def _times_sql(text: str) -> str:
    """Minutes of day of times with am or pm, in order."""
    found = f"regexp_extract_all(lower({text}), '\\b[0-9]{{1,2}}(?::[0-9]{{2}})?\\s*[ap]\\.?m\\.?\\b')"
    hour, minute = "regexp_extract(x, '^([0-9]+)', 1)::INT", "coalesce(nullif(regexp_extract(x, ':([0-9]{2})', 1), '')::INT, 0)"
    return f"list_filter(list_transform({found}, lambda x: CASE WHEN {hour} BETWEEN 1 AND 12 AND {minute} < 60 THEN {hour} % 12 * 60 + {minute} + CASE WHEN contains(x, 'p') THEN 720 ELSE 0 END END), lambda m: m IS NOT NULL)"


def _mended_sql(text: str) -> str:
    """The scanner's slips mended, one by one."""
    steps = [
        (r"\bfro\*\s*([0-9])", r"from \1"), (r"\ba1d\b", "and"), (r"(?:=|\b)ro([0-9])", r"from \1"), (r"\bI([0-9]{1,2}:[0-9]{2}\s*[ap]\.?m)", r"\1"),
        (r"\b([0-9]{1,2})\.([0-9]{2}\s*[ap]\.?m)", r"\1:\2"), (r"\b([0-9]{1,2}:[0-9]{2})0m\b", r"\1am"), (r"([0-9]:)o([0-9o]\s*[ap]\.?m)", r"\g10\2"), (r"([0-9]:[0-9])o(\s*[ap]\.?m)", r"\g10\2"), (r"([0-9]:)o([0-9])", r"\g10\2"),
    ]
    out = f"trim(regexp_replace(translate({text}, '–—’', '--'''), '\\s+', ' ', 'g'))"
    for pattern, put in steps:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('g10', '10')}', 'gi')"
    return out


SPOKEN_SQL = rf"""x AS (SELECT o_orderkey AS k, {_mended_sql(_spoken_sql("o_orderkey"))} AS text FROM orders),
r AS (SELECT *, {_days_sql("text")} AS days, {_times_sql("text")} AS times, regexp_matches(lower(text), '\b(?:open\s*)?24\s*hours?\b') AND regexp_matches(lower(text), '\b7\s*days?\b') AS always FROM x),
p AS (SELECT k, trim(s) AS part, i FROM (SELECT k, unnest(string_split(text, ';')) AS s, generate_subscripts(string_split(text, ';'), 1) AS i FROM x) WHERE trim(s) <> ''),
q AS (SELECT k, string_agg(array_to_string(d, ',') || '@' || t[1] || coalesce('-' || t[2], '') || '=' || part, '|' ORDER BY i) AS segments, count(*) AS n FROM (SELECT k, part, i, {_days_sql("part")} AS d, {_times_sql("part")} AS t FROM p) WHERE len(d) > 0 AND len(t) > 0 GROUP BY k),
g AS (SELECT r.*, CASE WHEN always THEN 'recurring' WHEN contains(lower(text), 'dawn to dusk') THEN 'phrase' WHEN len(days) = 0 AND len(times) > 1 THEN 'time_range' WHEN len(days) = 0 AND len(times) = 1 THEN 'time_point' WHEN len(times) > 0 AND len(days) > 0 THEN 'recurring' ELSE 'unparsed' END AS kind FROM r)"""


@query(rf"""
WITH {SPOKEN_SQL}
SELECT k, text, kind, CASE WHEN kind = 'phrase' THEN 'dawn_to_dusk' END AS phrase, CASE WHEN always THEN '1,2,3,4,5,6,0' WHEN kind = 'recurring' THEN array_to_string(days, ',') END AS days,
  CASE WHEN always THEN 0 WHEN kind IN ('recurring', 'time_range', 'time_point') THEN times[1] END AS start, CASE WHEN always THEN 1439 WHEN kind IN ('recurring', 'time_range', 'time_point') THEN times[2] END AS finish,
  CASE WHEN kind = 'recurring' AND NOT always AND n > 1 THEN segments ELSE '' END AS segments, kind = 'unparsed' AS review,
FROM g LEFT JOIN q USING (k)
""")
def schedule_grammar(t: Tables) -> DataFrame:
    """Schedule texts, some misread by a scanner, by the grammar: kind, days, times, segments, and whether someone must look."""
    g = t.orders.select(F.col("o_orderkey").alias("k"), schedules.grammar(_spoken(F.col("o_orderkey"))).alias("g"))
    numbers = lambda c: F.array_join(c.cast("array<string>"), ",")
    shown = F.transform("g.segments", lambda s: F.concat(numbers(s["days"]), F.lit("@"), s["start"].cast("string"), F.coalesce(F.concat(F.lit("-"), s["finish"].cast("string")), F.lit("")), F.lit("="), s["text"]))
    return g.select("k", "g.text", "g.kind", "g.phrase", numbers(F.col("g.days")).alias("days"), "g.start", "g.finish", F.array_join(shown, "|").alias("segments"), "g.review")


#: A week with a change of offset.
WEEK = "2024-03-07"
NOTES = ["9:15 - 10:45 am", "starts 7:30", "12:05 a.m.", "6:00 pm to 6:00 pm", "from 2:30 to 3:30 in the lounge", "ask us", "10:00pm–11:30pm"]

CLOCK_SQL = r"'([0-9]{1,2})\s*:\s*([0-9]{2})\s*([aApP]\.?[mM]\.?)?'"


def _minutes_sql(found: str, evening: str, fallback: str = "''") -> str:
    """Minutes of day of one matched time."""
    h, m = f"regexp_extract({found}, '^([0-9]+)', 1)::INT", f"regexp_extract({found}, ':\\s*([0-9]+)', 1)::INT"
    half = f"coalesce(nullif(lower(regexp_extract({found}, '([aApP])\\.?[mM]', 1)), ''), {fallback})"
    on24 = f"(CASE WHEN {half} = 'p' AND {h} < 12 THEN {h} + 12 WHEN {half} = 'a' AND {h} = 12 THEN 0 WHEN {half} = '' AND {evening} AND {h} BETWEEN 1 AND 11 THEN {h} + 12 ELSE {h} END)"
    return f"CASE WHEN {found} IS NOT NULL AND {on24} <= 23 AND {m} <= 59 THEN {on24} * 60 + {m} END"


@query(f"""
WITH i AS (SELECT c_custkey AS item, c_mktsegment IN ('BUILDING', 'MACHINERY') AS evening, CASE WHEN c_custkey % 9 < 8 THEN ({NOTES})[c_custkey % {len(NOTES)} + 1] END AS text FROM customer),
r AS (SELECT o_custkey AS item, CASE WHEN o_orderstatus <> 'P' THEN dayofweek(o_orderdate) END AS weekday, o_orderpriority LIKE '1%' AS daily, (o_orderkey % 24) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS s, CASE WHEN o_orderkey % 3 = 0 THEN ((o_orderkey + 2) % 24) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS f,
  CASE WHEN o_orderkey % 4 = 0 THEN ({NOTES})[o_orderkey % {len(NOTES)} + 1] END AS notes FROM orders),
d AS (SELECT unnest(range(DATE '{WEEK}', DATE '{WEEK}' + 7, INTERVAL 1 DAY))::DATE AS day),
e AS (SELECT i.item, evening, day, s, f, coalesce(notes, text) AS notes, false AS made FROM i JOIN r USING (item), d WHERE daily OR weekday IS NULL OR weekday = dayofweek(day)
  UNION ALL SELECT item, evening, day, NULL, NULL, text, true FROM i, d WHERE text <> '' AND item NOT IN (SELECT item FROM r WHERE item IS NOT NULL)),
n AS (SELECT *, regexp_extract_all(coalesce(notes, ''), {CLOCK_SQL}) AS found FROM e),
m AS (SELECT *, {_minutes_sql("found[1]", "evening")} AS noted, {_minutes_sql("found[1]", "evening", "lower(regexp_extract(coalesce(found[2], ''), '([aApP])[.]?[mM]', 1))")} AS ranged, {_minutes_sql("found[2]", "evening")} AS second,
  CASE WHEN evening AND split_part(s, ':', 1)::INT BETWEEN 1 AND 11 THEN 720 ELSE 0 END + split_part(s, ':', 1)::INT * 60 + split_part(s, ':', 2)::INT AS ruled,
  CASE WHEN evening AND split_part(f, ':', 1)::INT BETWEEN 1 AND 11 THEN 720 ELSE 0 END + split_part(f, ':', 1)::INT * 60 + split_part(f, ':', 2)::INT AS ruled_end FROM n),
z AS (SELECT *, coalesce(noted, ruled, CASE WHEN evening THEN 1230 ELSE 540 END) AS a, CASE WHEN ranged IS NOT NULL THEN second END AS b1, CASE WHEN f IS NOT NULL THEN coalesce(noted, ruled_end) END AS b2 FROM m),
y AS (SELECT *, CASE WHEN b1 <> a THEN b1 WHEN b2 <> a THEN b2 END AS b FROM z)
SELECT item, day, ((day::TIMESTAMP + to_minutes(a::BIGINT)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' AS start,
  CASE WHEN made THEN ((day::TIMESTAMP + to_minutes(a::BIGINT)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' + INTERVAL 2 HOUR ELSE ((day::TIMESTAMP + to_minutes(b::BIGINT)) AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC' END AS finish, notes, made FROM y
""")
def timed_occurrences(t: Tables) -> DataFrame:
    """Customers as items and orders as their rules, over a week in which clocks change; customers without orders occur by their text."""
    pick = lambda k: F.element_at(F.lit(NOTES), (k % len(NOTES) + 1).cast("int"))
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    items = t.customer.select(c.alias("item"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("evening"), F.when(c % 9 < 8, pick(c)).alias("text"))
    clock = lambda h: F.concat(h.cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    rules = t.orders.select(
        F.col("o_custkey").alias("item"), F.when(F.col("o_orderstatus") != "P", F.dayofweek("o_orderdate") - 1).alias("weekday"), F.col("o_orderpriority").startswith("1").alias("daily"),
        clock(k % 24).alias("start"), F.when(k % 3 == 0, clock((k + 2) % 24)).alias("finish"), F.when(k % 4 == 0, pick(k)).alias("notes"),
    )
    return recurrence.occurrences(items, rules, "item", F.lit(WEEK).cast("date"), 7, ZONE)
