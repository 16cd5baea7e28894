"""Evidence over events, orders and pages: metrics, crawl errors, findings, diffs, freshness, coverage, lints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import errors
from millrace.operators import evidence
from millrace.plans.registry import query
from millrace.sources.tables import Tables

METRIC_SQL = """m AS (SELECT event_id, event_type AS engine, user_id % 4 AS q, event_id % 100 AS impressions, event_id % 110 AS clicks, CASE WHEN event_id % 9 = 0 THEN 1.5 ELSE (event_id % 11) / 10.0 END AS ctr, event_id % 13 AS pos, event_id % 99 AS days FROM events),
i AS (SELECT *, concat_ws(',', CASE WHEN clicks > impressions THEN 'clicks_above_impressions' END, CASE WHEN ctr > 1 THEN 'ctr' END, CASE WHEN pos < 1 THEN 'position' END, CASE WHEN days < 7 OR days > 93 THEN 'days' END) AS issues FROM m)"""


def metrics(t: Tables) -> DataFrame:
    k = F.col("event_id")
    m = t.events.select(k, F.col("event_type").alias("engine"), (F.col("user_id") % 4).alias("q"), (k % 100).alias("impressions"), (k % 110).alias("clicks"), F.when(k % 9 == 0, 1.5).otherwise(k % 11 / 10.0).alias("ctr"), (k % 13).alias("pos"), (k % 99).alias("days"))
    c = F.col
    return m.withColumn("issues", F.array_join(evidence.metric_issues(c("impressions"), c("clicks"), c("ctr"), c("pos"), c("days")), ","))


@query(f"""
WITH {METRIC_SQL}, p AS (SELECT * FROM i WHERE issues = '')
SELECT engine, count(*) AS records, count(*) FILTER (issues = '') AS good, coalesce(sum(impressions) FILTER (issues = ''), 0)::BIGINT AS impressions, coalesce(sum(clicks) FILTER (issues = ''), 0)::BIGINT AS clicks,
  count(*) FILTER (issues = '' AND impressions >= 50 AND ctr < 0.2) AS low_ctr, round(coalesce(sum(clicks) FILTER (issues = '') / nullif(sum(impressions) FILTER (issues = ''), 0), 0), 6) AS weighted_ctr FROM i GROUP BY engine
""")
def visibility_audit(t: Tables) -> DataFrame:
    """Search metrics by engine: records, good ones, totals, low click rates, and clicks by impressions."""
    good = F.col("issues") == ""
    of = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0))
    return metrics(t).groupBy("engine").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(good).alias("good"), of("impressions").alias("impressions"), of("clicks").alias("clicks"), F.count_if(good & (F.col("impressions") >= 50) & (F.col("ctr") < 0.2)).alias("low_ctr"),
        F.round(F.coalesce(F.try_divide(of("clicks"), of("impressions")), F.lit(0.0)), 6).alias("weighted_ctr"),
    )


@query(f"""
WITH {METRIC_SQL}, w AS (SELECT * FROM (SELECT unnest(['purchase', 'signup', 'video']) AS engine) a, (SELECT unnest([0, 1, 2, 3]) AS q) b)
SELECT engine, q::INTEGER AS q FROM w WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.engine = w.engine AND i.q = w.q AND issues = '')
""")
def visibility_gaps(t: Tables) -> DataFrame:
    """Engines and queries without a passing record."""
    seen = metrics(t).filter("issues = ''").withColumn("q", F.col("q").cast("int"))
    return evidence.missing_combinations(seen, {"engine": ["purchase", "signup", "video"], "q": [0, 1, 2, 3]})


@query("""
WITH r AS (SELECT event_type AS engine, user_id, event_id, CASE event_id % 4 WHEN 0 THEN 'No errors' WHEN 1 THEN 'Fixed' WHEN 2 THEN 'Open' ELSE 'Validation failed' END AS status, event_id % 3 AS open_n FROM events)
SELECT engine, count(*) AS rows_, count(*) FILTER (event_id % 4 < 2 AND open_n = 0) AS passing, bool_or(event_id % 4 < 2 AND open_n = 0) AS ok FROM r GROUP BY engine
""".replace("rows_", "records"))
def crawl_audit(t: Tables) -> DataFrame:
    """Crawl reports by engine: a row passes with a good status and nothing open; an engine needs one that passes."""
    k = F.col("event_id")
    status = F.element_at(F.lit(["No errors", "Fixed", "Open", "Validation failed"]), (k % 4 + 1).cast("int"))
    good = evidence.passing_state(status, F.lit("")) & (k % 3 == 0)
    return t.events.groupBy(F.col("event_type").alias("engine")).agg(F.count(F.lit(1)).alias("records"), F.count_if(good).alias("passing"), F.bool_or(good).alias("ok"))


@query("""
WITH p AS (SELECT page_id, length(html) AS n, len(regexp_extract_all(html, '<p[ >]')) AS paras, len(regexp_extract_all(html, '<a ')) AS links, contains(html, '<title>') AS titled, contains(html, 'lang="') AS lang, regexp_matches(html, 'display:\\s*none|hidden') AS hidden FROM pages)
SELECT page_id, paras, links, concat_ws(',', CASE WHEN NOT titled THEN 'no_title' END, CASE WHEN NOT lang THEN 'no_lang' END, CASE WHEN paras = 0 THEN 'no_text' END, CASE WHEN hidden THEN 'hidden' END, CASE WHEN n > 3000 THEN 'too_large' END) AS findings, titled AND lang AND paras > 0 AS passed FROM p
""")
def page_lint(t: Tables) -> DataFrame:
    """Features, hidden content and sizes of pages against rules."""
    h = F.col("html")
    paras, links = F.regexp_count(h, F.lit("<p[ >]")).cast("long"), F.regexp_count(h, F.lit("<a ")).cast("long")
    found = errors(("no_title", ~h.contains("<title>")), ("no_lang", ~h.contains('lang="')), ("no_text", paras == 0), ("hidden", h.rlike(r"display:\s*none|hidden")), ("too_large", F.length(h) > 3000))
    return t.pages.select("page_id", paras.alias("paras"), links.alias("links"), F.array_join(found, ",").alias("findings"), (h.contains("<title>") & h.contains('lang="') & (paras > 0)).alias("passed"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN regexp_matches(line, '[0-9]{3}-[0-9]{4}|\([0-9]{3}\)') THEN 'phone' WHEN regexp_matches(line, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'mail' WHEN regexp_matches(line, 'token = ') THEN 'secret' END AS rule FROM l)
SELECT doc_id, rule, count(*) AS lines FROM f WHERE rule IS NOT NULL GROUP BY ALL
""")
def line_lint(t: Tables) -> DataFrame:
    """Lines of documents that break a rule, by the first rule that they break."""
    line = F.col("line")
    rule = F.when(line.rlike(r"[0-9]{3}-[0-9]{4}|\([0-9]{3}\)"), "phone").when(line.rlike("[A-Za-z0-9.]+@[A-Za-z0-9.]+"), "mail").when(line.rlike("token = "), "secret")
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", rule.alias("rule")).filter("rule is not null").groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH o AS (SELECT o_custkey, count(*) AS gold FROM orders GROUP BY 1), p AS (SELECT o_custkey, count(*) AS fixture FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), q AS (SELECT c_custkey AS o_custkey, 1 AS legacy FROM customer WHERE c_acctbal < 0),
m AS (SELECT o_custkey, coalesce(gold, 0) AS gold, coalesce(fixture, 0) AS fixture, coalesce(legacy, 0)::BIGINT AS legacy FROM o FULL JOIN p USING (o_custkey) FULL JOIN q USING (o_custkey))
SELECT *, concat_ws(',', CASE WHEN gold < legacy THEN 'lost' END, CASE WHEN fixture = 0 AND gold > 0 THEN 'no_fixture' END) AS errors FROM m
""")
def coverage_matrix(t: Tables) -> DataFrame:
    """Counts of three feeds by customer, and which rules they break."""
    m = evidence.matrix({"gold": t.orders, "fixture": t.orders.filter("o_orderstatus = 'F'"), "legacy": t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))}, "o_custkey")
    return m.withColumn("errors", F.array_join(errors(("lost", F.col("gold") < F.col("legacy")), ("no_fixture", (F.col("fixture") == 0) & (F.col("gold") > 0))), ","))


@query("""
WITH n AS (SELECT o_orderpriority, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT o_orderpriority, o_orderstatus, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (k <= 5) AS ids FROM n GROUP BY ALL
""")
def review_batches(t: Tables) -> DataFrame:
    """Orders as review batches: how many, and the first five ids."""
    return evidence.batches(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 5)


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS a, o_orderkey % 3 = 0 AS b, o_totalprice > 300000 AS d FROM orders)
SELECT k, concat_ws(',', CASE WHEN a THEN 'missing_span:title' END, CASE WHEN b AND NOT a THEN 'engine_disagreement:title' END, CASE WHEN d THEN 'missing_span:price' END, CASE WHEN k % 7 = 0 THEN 'unknown_location' END) AS findings,
  CASE WHEN a OR d THEN 'quarantined' WHEN b OR k % 7 = 0 THEN 'review' ELSE 'passed' END AS status FROM c
""")
def candidate_findings(t: Tables) -> DataFrame:
    """Findings for each candidate's critical fields, and the status that follows."""
    k = F.col("o_orderkey")
    fields = {"title": (k % 5 != 0, k % 3 != 0), "price": (F.col("o_totalprice") <= 300000, F.lit(True))}  # has a span, engines agree
    codes = [(f"{code}:{f}", cond) for f, (span, agree) in fields.items() for code, cond in (("missing_span", ~span), ("engine_disagreement", span & ~agree))]
    found = errors(*codes, ("unknown_location", k % 7 == 0))
    status = F.when(F.exists(found, lambda x: x.startswith("missing_span")), "quarantined").when(F.size(found) > 0, "review").otherwise("passed")
    return t.orders.select(k.alias("k"), F.array_join(found, ",").alias("findings"), status.alias("status"))


@query("""
WITH e AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 6 = 0), f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg, c_nationkey + (c_custkey % 9 = 0)::INTEGER AS nat FROM customer WHERE c_custkey % 18 > 0),
j AS (SELECT e.k, f.k AS fk, e.seg AS es, f.seg AS fs, e.nat AS en, f.nat AS fn FROM e LEFT JOIN f ON e.k = f.k)
SELECT k AS c_custkey, 'missing:record' AS error FROM j WHERE fk IS NULL UNION ALL SELECT k, 'c_mktsegment:' || es || ':' || fs FROM j WHERE es <> fs UNION ALL SELECT k, 'c_nationkey:' || en || ':' || fn FROM j WHERE en <> fn
""")
def expectation_diff(t: Tables) -> DataFrame:
    """Expected records against what was found: missing ones and fields that differ."""
    k = F.col("c_custkey")
    found = t.customer.filter(k % 18 > 0).select(k, F.when(k % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + (k % 9 == 0).cast("int")).alias("c_nationkey"))
    return evidence.expectation_diff(found, t.customer.filter(k % 6 == 0), "c_custkey", ["c_mktsegment", "c_nationkey"], "record")


@query("""
WITH m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN 'u' || s_nationkey END AS url, s_nationkey AS edition FROM supplier), l AS (SELECT s_suppkey AS k, 'u' || (s_nationkey + s_suppkey % 3 - 1) AS url, s_nationkey + s_suppkey % 3 - 1 AS edition, s_suppkey % 2 = 0 AS official FROM supplier WHERE s_suppkey % 7 > 0)
SELECT m.k, CASE WHEN m.url IS NULL THEN 'page' ELSE 'document' END AS kind, CASE WHEN m.url IS NULL THEN 'page' WHEN l.url IS NULL THEN 'no_live_evidence' WHEN l.url <> m.url AND l.edition >= m.edition AND official THEN 'stale' ELSE 'current' END AS verdict FROM m LEFT JOIN l ON m.k = l.k
""")
def stale_editions(t: Tables) -> DataFrame:
    """Sources whose live edition has moved on."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    manifest = t.supplier.select(k.alias("k"), F.when(k % 5 > 0, F.concat(F.lit("u"), n.cast("string"))).alias("url"), n.alias("edition"))
    moved = n + k % 3 - 1
    live = t.supplier.filter(k % 7 > 0).select(k.alias("k"), F.concat(F.lit("u"), moved.cast("string")).alias("url"), moved.alias("edition"), (k % 2 == 0).alias("official"))
    return evidence.stale_editions(manifest, live, "k")


@query("""
WITH inv AS (SELECT DISTINCT 'n' || c_nationkey AS url FROM customer WHERE c_nationkey % 4 > 0), s AS (SELECT url, CASE substr(url, 2)::INT % 3 WHEN 0 THEN 'expired' WHEN 1 THEN NULL ELSE 'current' END AS state, CASE WHEN substr(url, 2)::INT % 2 = 0 THEN 'listed' END AS exempt FROM inv),
u AS (SELECT DISTINCT 'n' || s_nationkey AS url FROM supplier)
SELECT url, 'missing_from_inventory' AS error FROM u WHERE url NOT IN (SELECT url FROM inv) UNION ALL SELECT url, 'expired' FROM s JOIN u USING (url) WHERE state = 'expired'
UNION ALL SELECT url, 'unknown' FROM s JOIN u USING (url) WHERE state IS NULL AND exempt IS NULL UNION ALL SELECT url, 'stale_url' FROM s JOIN u USING (url) WHERE regexp_matches(url, '1$')
""")
def freshness_errors(t: Tables) -> DataFrame:
    """What keeps used sources from being published."""
    n = F.substring("url", 2, 9).cast("int")
    inventory = t.customer.filter("c_nationkey % 4 > 0").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("url")).distinct()
    inventory = inventory.withColumn("state", F.when(n % 3 == 0, "expired").when(n % 3 == 2, "current")).withColumn("exempt", F.when(n % 2 == 0, "listed"))
    used = t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("url"))
    return evidence.freshness_errors(inventory, used, "url", "state", "exempt", ["expired", "unreachable"], "1$")


@query("""
WITH o AS (SELECT DISTINCT s_nationkey AS g, 's' || s_suppkey % 4 AS slug FROM supplier), r AS (SELECT c_custkey, c_nationkey AS g, 's' || c_custkey % 9 AS slug, CASE WHEN c_custkey % 9 > 6 THEN 's' || (c_custkey % 9 - 6) END AS alias FROM customer)
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.g = r.g AND o.slug = r.alias) THEN 'alias' WHEN EXISTS (SELECT 1 FROM o WHERE o.g = r.g AND o.slug = r.slug) THEN 'direct' ELSE 'none' END AS covered FROM r
""")
def quarantine_cover(t: Tables) -> DataFrame:
    """Whether quarantined rows are covered by an offering, directly or by alias."""
    k = F.col("c_custkey")
    offered = t.supplier.select(F.col("s_nationkey").alias("g"), F.concat(F.lit("s"), (F.col("s_suppkey") % 4).cast("string")).alias("slug"))
    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("g"), F.concat(F.lit("s"), (k % 9).cast("string")).alias("slug"))
    alias = F.when(k % 9 > 6, F.concat(F.lit("s"), (k % 9 - 6).cast("string")))
    return evidence.covered_by(rows, offered, "g", "slug", alias).select("c_custkey", "covered")


@query("""
WITH l AS (SELECT s_nationkey AS g, max(s_suppkey) AS k FROM supplier GROUP BY 1), f AS (SELECT c_nationkey AS g, string_agg(c_name, '|' ORDER BY c_custkey) AS facts FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1)
SELECT s_suppkey, coalesce(CASE WHEN l.k = s_suppkey THEN f.facts END, '') AS facts, CASE WHEN s_suppkey % 2 = 0 THEN 'K' || s_suppkey ELSE 'new-' || s_suppkey END AS surrogate FROM supplier JOIN l ON l.g = s_nationkey LEFT JOIN f ON f.g = s_nationkey
""")
def merged_facts(t: Tables) -> DataFrame:
    """Facts appended in order to the last row of their key, and surrogate keys reused."""
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("g"))
    facts = t.customer.filter("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("g"), "c_custkey", "c_name")
    merged = evidence.append_facts(rows, facts, ["g"], "s_suppkey", "c_name", "c_custkey")
    known = t.supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", F.concat(F.lit("K"), F.col("s_suppkey").cast("string")).alias("surrogate"))
    out = evidence.reuse_keys(merged, known, ["s_suppkey"], "surrogate", F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")))
    return out.select("s_suppkey", F.array_join("facts", "|").alias("facts"), "surrogate")


@query("""
WITH d AS (SELECT o_orderkey AS k, ['approve', 'reject', 'maybe'][1 + o_orderkey % 3] AS d, 'r' || o_custkey % 5 AS r FROM orders), i AS (SELECT *, left(sha256('t' || k || '|' || r || '|' || d || '|price,title'), 16) AS id FROM d)
SELECT k, CASE WHEN d <> 'maybe' THEN '{"id":"' || id || '","task":"t' || k || '","reviewer":"' || r || '","decision":"' || d || '","fields":["price","title"],"at":"2024-01-15"}' END AS record,
  CASE WHEN k % 4 = 0 THEN 'free' ELSE 'open' END AS state FROM i
""")
def decision_records(t: Tables) -> DataFrame:
    """Review decisions as records with stable ids."""
    k = F.col("o_orderkey")
    decision = F.element_at(F.lit(["approve", "reject", "maybe"]), (k % 3 + 1).cast("int"))
    record = evidence.decision_record(F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("r"), (F.col("o_custkey") % 5).cast("string")), decision, F.lit(["title", "price"]), F.lit("2024-01-15").cast("date"))
    return t.orders.select(k.alias("k"), record.alias("record"), F.when(k % 4 == 0, "free").otherwise("open").alias("state"))
