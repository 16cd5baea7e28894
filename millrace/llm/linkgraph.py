"""URL filters: explicit rules, and verdicts for other hosts by link-graph propagation.

A rule (host, path, verdict) fits urls of its host and all subdomains whose path starts with its path; the longest wins.
Hosts are the nodes of a graph whose edges are the links between pages of different hosts. A host's trust seed is the share of its
pages that rules allow, its distrust seed the share that rules block. Scores are personalised PageRank in its contribution form: a host's distrust is the
seed that a surfer meets who starts there, follows links weighted by their counts, goes on with probability ``damping``, and stops at a host by the share of its pages that rules
fit (who links to bad hosts is suspect); its trust is the same for a surfer who goes backwards along links (whom trusted hosts link to is trusted). This
form, unlike mass divided over neighbours, doesn't depend on how many others link to a host, nor take a host's own seeds away. A host is blocked
if its distrust exceeds its trust by more than ``threshold``; pages without a rule get their host's verdict.

Scale: pages are reduced to distinct hosts and to link counts per host pair before any join; links of one hot host are added up
in the map stage. Each round of scores is a written table, so rounds don't repeat one another. Rounds go on until no score moves
by more than ``tolerance``; each shrinks the moves by ``damping``. Pages of a hot host meet its rules and scores by broadcast or, where there are too many hosts, salted.

Edge cases: null urls and urls without ``://`` have an empty host and path, which no rule with a host fits, are outside the graph and allowed; null html has
no links; repeated pages count as often as they occur; rules of one length that fit the same page: the first by text; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_materialized, materialize, small_table

Rule = tuple[str, str, str]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_host_rows(pages: DataFrame, per_host: DataFrame, most: int = 500_000, salts: int = 64) -> DataFrame:
    """``pages`` left joined with a written table of one row a host; a host with any share of the pages makes no large task."""
    if per_host.count() <= most:
        return pages.join(F.broadcast(per_host), "host", "left")
    spread = per_host.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["host", "_salt"], "left").drop("_salt")


def apply_rules(pages: DataFrame, rules: list[Rule], broadcast_rules: int = 10_000) -> DataFrame:
    """``pages`` (with host and path) plus rule and rule_verdict, null where none fits."""
    spark = pages.sparkSession
    table = small_table(spark, [{"suffix": h, "prefix": p, "v": v} for h, p, v in rules], "suffix string, prefix string, v string")
    table = table.groupBy("suffix").agg(F.collect_set(F.struct("prefix", "v")).alias("rs"))
    if len(rules) <= broadcast_rules:
        table = F.broadcast(table)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = pages.select("host").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix")
    fits = F.transform("rs", lambda r: F.struct(-(F.length("suffix") + F.length(r["prefix"])), F.concat("suffix", r["prefix"]).alias("rule"), r["prefix"].alias("prefix"), r["v"].alias("v")))
    known = hosts.withColumn("fits", fits).groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("fits"))).alias("fits"))
    best = F.filter("fits", lambda r: F.startswith("path", r["prefix"]))
    return with_host_rows(pages, materialize(known, "known")).withColumn("best", F.get(best, F.lit(0))).withColumn("rule", F.col("best.rule")).withColumn("rule_verdict", F.col("best.v")).drop("fits", "best")


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    href = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    leaving = F.filter(href, lambda u: u.contains("://") | u.startswith("//"))
    links = pages.select(F.col("host").alias("src"), F.explode(leaving).alias("u"))
    links = links.select("src", host_of(F.when(F.col("u").startswith("//"), F.concat(F.lit("http:"), "u")).otherwise(F.col("u"))).alias("dst"))
    return links.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, mean: bool = False, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) from seeds of the same columns.

    This is personalised PageRank: a host's score is divided over its neighbours, and a host without such neighbours keeps its own. With ``mean``,
    in contribution form, a host takes its neighbours' mean score instead, for the share of it that has no seed. Rounds go on until no score moves by
    more than ``tolerance``, or as many as given.
    """
    most = rounds if rounds is not None else 2 + math.ceil(math.log(tolerance) / math.log(damping))
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("into"))
    of_src, of_dst = F.col("n") / F.col("out"), F.col("n") / F.col("into")
    along, against = (of_dst, of_src) if mean else (of_src, of_dst)
    edges = materialize(links.join(out, "src").join(into, "dst").select("src", "dst", along.alias("along"), against.alias("against")), "edges")
    nodes = seeds.join(out.select(F.col("src").alias("host"), F.lit(True).alias("has_out")), "host", "left").join(into.select(F.col("dst").alias("host"), F.lit(True).alias("has_in")), "host", "left")
    nodes = materialize(nodes.fillna(False, ["has_out", "has_in"]), "hosts")
    now = nodes.select("host", "trust", "distrust")
    for k in range(most):
        given = edges.join(now, edges["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("along")).alias("t"), F.lit(0.0).alias("d"))
        blamed = edges.join(now, edges["dst"] == now["host"]).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("against")).alias("d"))
        got = given.union(blamed).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        old = now.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        t, d = F.coalesce("t", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
        if mean:
            own, open_ = 1.0, damping * (1 - F.col("trust") - F.col("distrust"))
        else:
            own, open_ = 1 - damping, F.lit(damping)
            t = t + F.when(F.col("has_out"), 0.0).otherwise(F.col("t0"))
            d = d + F.when(F.col("has_in"), 0.0).otherwise(F.col("d0"))
        new = nodes.join(old, "host").join(got, "host", "left").select(
            "host", (F.col("trust") * own + t * open_).alias("trust"), (F.col("distrust") * own + d * open_).alias("distrust"), "t0", "d0"
        )
        new = materialize(new, "scores")
        moved = new.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t0")), F.abs(F.col("distrust") - F.col("d0"))))).first()[0]
        if k:
            drop_materialized(now)
        now = new.select("host", "trust", "distrust")
        if rounds is None and (moved or 0.0) <= tolerance:
            break
    drop_materialized(edges)
    return now


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, page_id: str = "page_id", url: str = "url", html: str = "html", **options) -> DataFrame:  # noqa: ANN003
    """page_id, host, path, rule, verdict and host_score (distrust less trust) of every page."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = materialize(apply_rules(own.select("page_id", "host", "path"), rules), "ruled")
    links = materialize(host_links(own), "links")
    share = [F.avg((F.col("rule_verdict").eqNullSafe(v)).cast("double")).alias(c) for v, c in (("allow", "trust"), ("block", "distrust"))]
    linked = links.select(F.col("src").alias("host")).union(links.select(F.col("dst").alias("host"))).distinct()
    seeds = ruled.filter("host <> ''").groupBy("host").agg(*share).join(linked, "host", "full").fillna(0.0, ["trust", "distrust"])
    scores = propagate(seeds, links, **{"mean": True} | options).select("host", (F.col("distrust") - F.col("trust")).alias("host_score"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("host_score") > threshold, "block").otherwise("allow"))
    return with_host_rows(ruled, scores).select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("host_score", F.lit(0.0)).alias("host_score"))
