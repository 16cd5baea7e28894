"""Evidence as records: shape rules, completeness, findings, diffs against expectations, freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import errors


def metric_issues(impressions: Column, clicks: Column, ctr: Column, position: Column, days: Column) -> Column:
    """Codes of what is wrong with search metrics."""
    return errors(
        ("impressions", impressions.isNull() | (impressions < 0)), ("clicks", clicks.isNull() | (clicks < 0)), ("clicks_above_impressions", clicks > impressions), ("ctr", ctr.isNull() | (ctr < 0) | (ctr > 1)),
        ("position", position.isNull() | (position < 1)), ("days", days.isNull() | (days < 7) | (days > 93)),
    )


def passing_state(status: Column, validation: Column) -> Column:
    """Whether a status tells of success and, "no errors" and the like apart, of no failure."""
    both = F.lower(F.concat_ws(" ", status, validation))
    rest = F.regexp_replace(both, "no (errors?|issues?)", "")
    return both.rlike("no errors|no issues|passed|valid|resolved|fixed|complete") & ~rest.rlike("open|failed|error|not started|detected|active")


def missing_combinations(seen: DataFrame, wanted: dict[str, list]) -> DataFrame:
    """The combinations of fixed lists of values that no row has (rows that pass, if the caller filtered them)."""
    spark = seen.sparkSession
    every = spark.range(1).select(F.lit(0).alias("_"))
    for c, values in wanted.items():
        every = every.select("*", F.explode(F.lit(values)).alias(c))
    known = seen.select(*wanted).filter(reduce(lambda a, b: a & b, [F.col(c).isin(*values) for c, values in wanted.items()])).distinct()
    return every.drop("_").join(F.broadcast(known), list(wanted), "left_anti")  # no more rows than there are wanted combinations


def matrix(feeds: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, a count for each feed): all keys of all feeds, 0 where a feed has none."""
    union = None
    for name, feed in feeds.items():
        one = feed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(name).alias("feed"), "n")
        union = one if union is None else union.unionByName(one)
    return union.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("feed") == name, F.col("n"))), F.lit(0)).alias(name) for name in feeds])


def batches(rows: DataFrame, keys: list[str], row_id: str, show: int) -> DataFrame:
    """(keys, n, ids): counts by key with the first ``show`` ids, which is all that a task keeps of a key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(row_id))
    few = rows.withColumn("_n", nth).filter(F.col("_n") <= show).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(row_id)).cast("array<string>"), ",").alias("ids"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(few, keys)


def expectation_diff(found: DataFrame, expected: DataFrame, key: str, fields: list[str], kind: str) -> DataFrame:
    """(key, error): expected keys that are missing, and fields that differ, as ``missing:<kind>`` and ``<field>:<expected>:<found>``."""
    e = expected.select(key, *[F.col(f).cast("string").alias(f"e_{f}") for f in fields])
    f_ = found.select(key, *[F.col(f).cast("string").alias(f"f_{f}") for f in fields], F.lit(True).alias("_there"))
    met = e.join(f_, key, "left")
    text = lambda c: F.coalesce(c, F.lit("null"))
    differs = [F.when(F.col("_there") & ~F.col(f"e_{f}").eqNullSafe(F.col(f"f_{f}")), F.concat(F.lit(f"{f}:"), text(F.col(f"e_{f}")), F.lit(":"), text(F.col(f"f_{f}")))) for f in fields]
    return met.select(key, F.explode(F.array_compact(F.array(F.when(F.col("_there").isNull(), F.lit(f"missing:{kind}")), *differs))).alias("error"))


def stale_editions(manifest: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """(key, kind, verdict) of manifest rows (key, url, edition) against live ones (key, url, edition, official).

    Stale if the live url differs, its edition is not older and official evidence backs it; a document without a live url is an error; rows without a
    url of their own are pages, which don't go stale.
    """
    met = manifest.join(live.select(key, F.col("url").alias("_url"), F.col("edition").alias("_edition"), "official"), key, "left")
    document = F.col("url").isNotNull()
    stale = (F.col("_url") != F.col("url")) & (F.col("_edition") >= F.col("edition")) & F.col("official")
    verdict = F.when(~document, "page").when(F.col("_url").isNull(), "no_live_evidence").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("current")
    return met.select(key, F.when(document, "document").otherwise("page").alias("kind"), verdict.alias("verdict"))


def freshness_errors(inventory: DataFrame, used: DataFrame, url: str, state: str, exempt: str, blocking: list[str], stale_pattern: str) -> DataFrame:
    """(url, error) rows: used urls that the inventory lacks, used sources in a blocking state, of unknown state without exemption, or with a stale url."""
    wanted = used.select(url).filter(F.trim(url) != "").distinct()
    missing = wanted.join(inventory.select(url), url, "left_anti").select(url, F.lit("missing_from_inventory").alias("error"))
    s = F.coalesce(F.col(state), F.lit("unknown"))
    codes = errors(*[(b, s == b) for b in blocking], ("unknown", (s == "unknown") & (F.trim(F.coalesce(F.col(exempt), F.lit(""))) == "")), ("stale_url", F.col(url).rlike(stale_pattern)))
    return missing.unionByName(inventory.join(wanted, url, "left_semi").select(url, F.explode(codes).alias("error")))


def covered_by(rows: DataFrame, offered: DataFrame, group: str, slug: str, alias: Column) -> DataFrame:
    """``rows`` with ``covered``: direct if their (group, slug) is offered, alias if that of their alias is, else none."""
    keys = offered.select(F.col(group).alias("_g"), F.col(slug).alias("_s")).distinct()
    tried = rows.withColumn("_alias", alias)
    direct = keys.withColumn("_direct", F.lit(True))
    other = keys.toDF("_g2", "_s2").withColumn("_other", F.lit(True))
    met = tried.join(direct, (F.col(group) == F.col("_g")) & (F.col(slug) == F.col("_s")), "left").join(other, (F.col(group) == F.col("_g2")) & (F.col("_alias") == F.col("_s2")), "left")
    return met.select(*rows.columns, F.when(F.col("_other"), "alias").when(F.col("_direct"), "direct").otherwise("none").alias("covered"))


def append_facts(rows: DataFrame, facts: DataFrame, keys: list[str], position: str, fact: str, fact_position: str, target: str = "facts") -> DataFrame:
    """``rows`` with the facts of their keys in order on the LAST row of each key; facts without a row are dropped."""
    gathered = facts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(fact_position, fact))), lambda x: x[fact]).alias("_facts"))
    last = rows.groupBy(*keys).agg(F.max(position).alias(position))
    met = rows.join(last.join(gathered, keys), [*keys, position], "left")
    return met.select(*rows.columns, F.coalesce("_facts", F.lit([]).cast("array<string>")).alias(target))


def reuse_keys(rows: DataFrame, known: DataFrame, keys: list[str], surrogate: str, new: Column) -> DataFrame:
    """``rows`` with the surrogate key that their keys already have, else a new one."""
    old = known.select(*keys, F.col(surrogate).alias("_old"))
    return rows.join(old, keys, "left").withColumn(surrogate, F.coalesce("_old", new)).drop("_old")


def decision_record(task: Column, reviewer: Column, decision: Column, fields: Column, at: Column) -> Column:
    """A review decision as JSON, its id the digest of what was decided; unknown decisions are null."""
    key = F.substring(F.sha2(F.concat_ws("|", task, reviewer, decision, F.array_join(F.array_sort(fields), ",")), 256), 1, 16)
    body = F.to_json(F.struct(key.alias("id"), task.alias("task"), reviewer.alias("reviewer"), decision.alias("decision"), F.array_sort(fields).alias("fields"), at.cast("string").alias("at")))
    return F.when(decision.isin("approve", "reject", "defer"), body)


def report(summaries: dict[str, DataFrame], blocking: list[str]) -> DataFrame:
    """(name, n, severity, passed) of one-row count frames (column ``n``): blocking ones pass at 0, others always."""
    out = None
    for name, frame in summaries.items():
        severity = "blocker" if name in blocking else "note"
        one = frame.select(F.lit(name).alias("name"), F.col("n").cast("long").alias("n"), F.lit(severity).alias("severity"), ((F.col("n") == 0) | F.lit(severity != "blocker")).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def batched_lookup(rows: DataFrame, keys: list[str], fetch) -> DataFrame:  # noqa: ANN001
    """``rows`` with what ``fetch`` gives for their keys; it is asked once for each distinct key."""
    return rows.join(fetch(rows.select(*keys).distinct()), keys, "left")


def reading_groups(tokens: DataFrame, region: str, y: str, x: str, height: str, is_start: Column) -> DataFrame:
    """``tokens`` with line and group numbers in reading order of each region.

    A token begins a line if it stands over half its height below the one before by y; a line that has a starting token begins a group.
    """
    by_y = Window.partitionBy(region).orderBy(y, x)
    below = F.col(y) - F.lag(y).over(by_y) > F.col(height) / 2
    lined = tokens.withColumn("line", F.sum(F.coalesce(below, F.lit(False)).cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.withColumn("_first", F.max(is_start.cast("int")).over(Window.partitionBy(region, "line")))
    opens = (F.col("_first") == 1) & (F.row_number().over(Window.partitionBy(region, "line").orderBy(x)) == 1)
    order = Window.partitionBy(region).orderBy("line", x).rowsBetween(Window.unboundedPreceding, 0)
    return lined.withColumn("group", F.sum(opens.cast("int")).over(order)).drop("_first")
