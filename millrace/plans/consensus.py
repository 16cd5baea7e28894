"""Documents as candidates read by three engines: damage planted by digests of their ids in every column, votes, findings and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import consensus
from millrace.plans.registry import query
from millrace.sources.tables import Tables

FIELDS = ["title", "schedule", "location", "fee", "movie_title", "region"]
NORMALS = {
    "schedule": lambda x: F.nullif(F.regexp_extract(consensus.plain(x), "[0-9]+:[0-9]{2}", 0), F.lit("")),
    "location": lambda x: F.when(~consensus.plain(x).rlike(r"^$|^unknown$|\?$"), consensus.plain(x)),
    "fee": lambda x: F.when(x.contains("($)"), "true").otherwise("false"),
}


def hit(name: str | Column, upto: str = "05") -> Column:
    """Whether the digest of a name and the document's id begins below a bound."""
    return F.substring(F.md5(F.concat(F.lit(name) if isinstance(name, str) else name, F.col("id").cast("string"))), 1, 2) < upto


def unless(name: str, value: Column, other: Column | None = None) -> Column:
    return F.when(hit(name), F.lit(None).cast("string") if other is None else other).otherwise(value)


def candidates(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), "text", "source", "lang", "n_chars")
    return d.select(
        "id", "text", "source", "lang", "n_chars",
        F.when(hit("movie", "20"), "movie").when(hit("kind"), "generic").otherwise("activity").alias("kind"), unless("family", F.lit("frame"), F.lit("odd")).alias("family"),
        unless("title", F.substring_index("text", "\n", 1), F.lit("And more")).alias("title"), unless("version", F.lit("v1")).alias("pipeline_version"), unless("config", F.lit("cfg")).alias("config_hash"),
        F.when(~hit("lineage"), F.struct(unless("lc", unless("lx", F.lit("cfg"), F.lit("other"))).alias("config_hash"), unless("lh", F.lit("h")).alias("lineage_hash"), unless("sha", F.lit("s")).alias("git_sha"), *[(~hit(x)).alias(x) for x in ("config", "packages", "models", "engines")])).alias("lineage"),
        unless("url", F.lit("https://x.org")).alias("canonical_url"), F.lit(None).cast("string").alias("fetched_url"), unless("sk", unless("so", F.lit("official_page"), F.lit("blog"))).alias("source_kind"),
        F.when(hit("status"), 404).otherwise(200).alias("http_status"), unless("now", F.lit("Current"), F.lit("past")).alias("currentness"), unless("at", F.lit("2024")).alias("captured_at"),
        unless("sd", F.lit("d")).alias("source_document_id"), unless("sha256", F.lit("abc")).alias("content_sha256"), F.when(hit("pages"), F.array(F.lit(" "))).otherwise(F.array(F.lit("p1"))).alias("page_hashes"),
        unless("rid", F.lit("r")).alias("region_id"), unless("rt", F.lit("card")).alias("region_type"), (~hit("sched")).alias("schedule_ok"),
        F.when(hit("prior", "40"), F.array(F.lit("field_extraction_not_implemented"))).otherwise(F.lit([]).cast("array<string>")).alias("prior"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    f = F.explode(F.lit(FIELDS)).alias("field")
    hour = (F.coalesce("n_chars", F.lit(0)) % 12 + 1).cast("string")
    raws = F.create_map(*[x for k, v in {
        "title": F.col("title"), "schedule": F.concat(F.lit("Daily at "), hour, F.lit(":30 pm")), "location": F.col("source"),
        "fee": F.when(hit("paid", "40"), "($) adults").otherwise("none"), "movie_title": F.concat(F.lit("Movie  "), F.col("lang")), "region": F.lit("card"),
    }.items() for x in (F.lit(k), v)])
    x = rows.select("id", f, F.try_element_at(raws, F.col("field")).alias("own_raw"))
    at = lambda name, upto="05": hit(F.concat(F.lit(name), F.col("field")), upto)
    null = F.lit(None).cast("string")
    value = consensus.normalised(F.col("field"), F.col("own_raw"), NORMALS)
    nothing = hit("nothing")
    page = F.when(~at("pg") & ~nothing, F.when(at("px"), "p9").otherwise("p1"))
    cols = [
        "id", "field", "own_raw", F.when(at("ov"), "odd").otherwise(value).alias("own_value"), F.when(at("r0"), null).when(at("rx"), "else").otherwise(F.col("own_raw")).alias("raw"),
        F.when(at("v0"), null).otherwise(value).alias("value"), F.when(at("mr"), consensus.MANUAL).when(at("ag"), "disagreement").otherwise(consensus.EXACT).alias("agreement"), at("de", "40").alias("derived"),
        F.when(at("sh"), null).when(at("sx"), "zzz").otherwise("abc").alias("source_hash"), F.lit("1").alias("page"), page.alias("page_hash"), F.array(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)]).alias("box"),
        F.when(~at("cr"), "c").alias("crop_hash"), F.lit("crops/1").alias("crop_path"), F.when(at("sp"), F.array(F.struct(F.lit(" ").alias("text"), F.lit("1").alias("page")))).otherwise(F.array(F.struct(F.lit("x").alias("text"), F.lit("1").alias("page")))).alias("spans"),
    ]
    return x.filter(~at("no")).select(*cols)


def records(proof: DataFrame) -> DataFrame:
    """Three engines a field: alpha reads the text, beta in capitals or garbled, gamma often reads another box."""
    at = lambda name, upto="05": hit(F.concat(F.lit(name), F.col("field")), upto)
    garbled = F.concat(F.translate("own_raw", "o:", "0 "), F.lit("?"))
    null = F.lit(None).cast("string")
    box = lambda n: F.array(*[F.lit(v) for v in (n, 0.0, 10.0 + n, 10.0)])
    one = lambda e, place, text, conf, left: F.struct(e.alias("engine"), F.lit(place).alias("place"), text.alias("text"), conf.alias("confidence"), left.alias("box"))
    sure = F.when(at("c0"), F.lit(None).cast("double")).when(at("c9", "20"), 0.9).otherwise(0.99)
    alpha = one(F.lit("alpha"), 1, F.when(at("a0"), null).when(hit("mark") & (F.col("field") == "fee"), "($)").otherwise(F.col("own_raw")), sure, box(0.0))
    beta = one(F.when(at("alone"), " ").when(at("bd"), "delta").otherwise(F.lit("beta")), 2, F.when(at("bg", "28"), garbled).otherwise(F.translate("own_raw", "aeinrst", "AEINRST")), F.lit(0.8), box(1.0))
    gamma = one(F.when(at("alone"), null).otherwise(F.lit("gamma")), 3, F.when(at("gg", "80"), garbled).otherwise(F.col("own_raw")), F.lit(0.95), F.when(at("gb", "60"), box(6.0)).otherwise(box(2.0)))
    return proof.select("id", "field", F.inline(F.array(alpha, beta, gamma)))


def h(name: str, upto: str = "05") -> str:
    return f"(substr(md5({name} || id), 1, 2) < '{upto}')"


def g(name: str, upto: str = "05") -> str:
    return h(f"'{name}' || field", upto)


def p(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g'))"


def n(x: str) -> str:
    return rf"CASE field WHEN 'schedule' THEN nullif(regexp_extract({p(x)}, '[0-9]+:[0-9]{{2}}'), '') WHEN 'location' THEN CASE WHEN NOT regexp_matches({p(x)}, '^$|^unknown$|\?$') THEN {p(x)} END WHEN 'fee' THEN CASE WHEN contains({x}, '($)') THEN 'true' ELSE 'false' END ELSE {p(x)} END"


BASE_SQL = f"""
c AS (SELECT doc_id AS id, text, source, lang, n_chars, CASE WHEN {h("'movie'", "20").replace("|| id", "|| doc_id")} THEN 'movie' WHEN {h("'kind'").replace("|| id", "|| doc_id")} THEN 'generic' ELSE 'activity' END AS kind,
  CASE WHEN {h("'title'").replace("|| id", "|| doc_id")} THEN 'And more' ELSE split_part(text, chr(10), 1) END AS title FROM documents),
x AS (SELECT *, CASE field WHEN 'title' THEN title WHEN 'schedule' THEN 'Daily at ' || (coalesce(n_chars, 0) % 12 + 1) || ':30 pm' WHEN 'location' THEN source WHEN 'fee' THEN CASE WHEN {h("'paid'", "40")} THEN '($) adults' ELSE 'none' END
  WHEN 'movie_title' THEN 'Movie  ' || lang ELSE 'card' END AS own_raw FROM (SELECT *, unnest({FIELDS}) AS field FROM c)),
e AS (SELECT id, field, own_raw, CASE WHEN {g("ov")} THEN 'odd' ELSE {n("own_raw")} END AS own_value, CASE WHEN {g("r0")} THEN NULL WHEN {g("rx")} THEN 'else' ELSE own_raw END AS raw, CASE WHEN NOT {g("v0")} THEN {n("own_raw")} END AS value,
  CASE WHEN {g("mr")} THEN 'manual' WHEN {g("ag")} THEN 'off' ELSE 'exact' END AS agreement, {g("de", "40")} AS derived, CASE WHEN {g("sh")} THEN NULL WHEN {g("sx")} THEN 'zzz' ELSE 'abc' END AS source_hash,
  CASE WHEN NOT {g("pg")} AND NOT {h("'nothing'")} THEN CASE WHEN {g("px")} THEN 'p9' ELSE 'p1' END END AS page_hash, {g("cr")} AS no_crop, {g("sp")} AS no_span FROM x WHERE NOT {g("no")}),
o AS (SELECT id, field, 'alpha' AS engine, CASE WHEN {g("a0")} THEN NULL WHEN {h("'mark'")} AND field = 'fee' THEN '($)' ELSE own_raw END AS text, CASE WHEN {g("c0")} THEN NULL WHEN {g("c9", "20")} THEN 0.9 ELSE 0.99 END::DOUBLE AS confidence, 1.0 AS near FROM e
  UNION ALL SELECT id, field, CASE WHEN {g("alone")} THEN ' ' WHEN {g("bd")} THEN 'delta' ELSE 'beta' END, CASE WHEN {g("bg", "28")} THEN translate(own_raw, 'o:', '0 ') || '?' ELSE translate(own_raw, 'aeinrst', 'AEINRST') END, 0.8, 90.0 / 110 FROM e
  UNION ALL SELECT id, field, CASE WHEN NOT {g("alone")} THEN 'gamma' END, CASE WHEN {g("gg", "80")} THEN translate(own_raw, 'o:', '0 ') || '?' ELSE own_raw END, 0.95, CASE WHEN {g("gb", "60")} THEN 40.0 / 160 ELSE 80.0 / 120 END FROM e),
r AS (SELECT *, {n("text")} AS value FROM o WHERE trim(coalesce(text, '')) <> '' AND trim(coalesce(engine, '')) <> '')"""


@query(f"""
WITH {BASE_SQL}, t AS (SELECT id, field, value, count(*) AS n, round(sum(coalesce(confidence, 0)), 6) AS c FROM r WHERE near >= 0.5 GROUP BY ALL), b AS (SELECT *, sum(n) OVER (PARTITION BY id, field) AS engines FROM t QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY value IS NULL, n DESC, c DESC, value) = 1)
SELECT id, field, value, CASE WHEN value IS NULL THEN 0 ELSE n END AS backing, engines::BIGINT AS engines, CASE WHEN value IS NOT NULL THEN c END AS confidence, (CASE WHEN value IS NULL THEN 0 ELSE n END) = engines AS unanimous FROM b
""")
def field_votes(t: Tables) -> DataFrame:
    """What most engines read in each field's box."""
    proof = evidence(candidates(t))
    return consensus.vote(records(proof), proof, NORMALS)


def rules(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in pairs)


LINEAGE = h("'lineage'")
CONFIG, LC, LX = h("'config'"), h("'lc'"), h("'lx'")
SEEN = "(page_hash IS NOT NULL AND NOT no_crop)"
OWN_CODES = [
    ("missing_pipeline_version", h("'version'")), ("missing_config_hash", CONFIG), ("missing_runtime_lineage", LINEAGE), ("missing_runtime_lineage_config_hash", f"NOT {LINEAGE} AND {LC}"),
    ("runtime_lineage_config_hash_mismatch", f"NOT {LINEAGE} AND NOT {LC} AND {LX} AND NOT {CONFIG}"), ("missing_runtime_lineage_hash", f"NOT {LINEAGE} AND " + h("'lh'")), ("missing_git_sha", f"NOT {LINEAGE} AND " + h("'sha'")),
    ("missing_runtime_config", f"NOT {LINEAGE} AND {CONFIG}"), ("missing_package_versions", f"NOT {LINEAGE} AND " + h("'packages'")), ("missing_model_asset_hashes", f"NOT {LINEAGE} AND " + h("'models'")), ("missing_ocr_engine_configs", f"NOT {LINEAGE} AND " + h("'engines'")),
    ("missing_source_url", h("'url'")), ("missing_source_kind", h("'sk'")), ("non_official_source", "NOT " + h("'sk'") + " AND " + h("'so'")), ("source_fetch_not_successful", h("'status'")), ("source_not_current", h("'now'")), ("missing_source_captured_at", h("'at'")),
    ("unknown_document_family", h("'family'")), ("missing_source_document_id", h("'sd'")), ("missing_content_sha256", h("'sha256'")), ("missing_canonical_page_image", h("'pages'")), ("missing_activity_region_id", h("'rid'")), ("missing_activity_region_type", h("'rt'")),
    ("missing_activity_region_evidence", "region_hash IS NULL"), ("region_source_hash_mismatch", f"region_hash <> CASE WHEN {h(chr(39) + 'sha256' + chr(39))} THEN '' ELSE 'abc' END"), ("unparsed_schedule", h("'sched'")), ("unknown_location", "coalesce(place, '') IN ('', 'unknown')"),
    ("non_activity_title:title", f"{p('title')} = 'nothing here' OR starts_with({p('title')}, 'and ')"), ("fee_marker_conflict", "fee_off OR (marked AND fee_own = 'false')"), ("review_only_candidate_type:generic", "kind = 'generic'"),
    ("field_extraction_not_implemented", h("'prior'", "40")), ("missing_reviewable_field_evidence", h("'prior'", "40") + " AND NOT coalesce(seen_critical, false)"),
]
GO = "crop AND agreement <> 'manual'"
FIELD_CODES = [
    ("missing_source_span", "NOT there OR no_span"), ("missing_field_raw_value", "there AND trim(coalesce(raw, '')) = ''"), ("field_raw_value_mismatch", f"there AND field <> 'fee' AND trim(raw) <> '' AND trim(own_raw) <> '' AND {p('raw')} <> {p('own_raw')}"),
    ("missing_field_normalized_value", "there AND trim(coalesce(value, '')) = ''"), ("field_normalized_value_mismatch", "there AND trim(value) <> '' AND NOT own"), ("field_source_hash_mismatch", "source_hash <> 'abc' AND NOT " + h("'sha256'")),
    ("field_page_image_not_canonical", "page_hash <> 'p1' AND NOT " + h("'pages'")), ("missing_required_field", "NOT crop"), ("manual_review_required", "crop AND agreement = 'manual'"), ("missing_field_engine_evidence", f"{GO} AND n < 2"),
    ("missing_required_engine_evidence", f"{GO} AND n >= 2 AND NOT (a AND b)"), ("missing_field_engine_confidence", f"{GO} AND n >= 2 AND a AND b AND (ac IS NULL OR bc IS NULL)"), ("engine_disagreement", f"{GO} AND NOT (said AND agree)"), ("field_engine_value_mismatch", f"{GO} AND said AND agree AND NOT same"),
]
REJECT = "|".join([*consensus.REJECTING, *(f"{x}.*" for x in consensus.REJECTING_FIELDS)])


@query(f"""
WITH {BASE_SQL},
k AS (SELECT id, bool_or({SEEN}) AS seen, bool_or({SEEN} AND field <> 'region') AS seen_critical, max(source_hash) FILTER (field = 'region' AND {SEEN}) AS region_hash, bool_or(field = 'fee' AND value <> own_value) AS fee_off, max(own_value) FILTER (field = 'fee') AS fee_own, max({p("own_value")}) FILTER (field = 'location') AS place FROM e GROUP BY id),
m AS (SELECT DISTINCT id, true AS marked FROM r WHERE field = 'fee' AND trim(text) = '($)'),
q AS (SELECT id, field, count(*) AS n, bool_or(engine = 'alpha') AS a, bool_or(engine = 'beta') AS b, max(value) FILTER (engine = 'alpha') AS av, max(value) FILTER (engine = 'beta') AS bv, max(confidence) FILTER (engine = 'alpha') AS ac, max(confidence) FILTER (engine = 'beta') AS bc FROM r GROUP BY id, field),
y AS (SELECT w.id, w.field, e.id IS NOT NULL AS there, e.* EXCLUDE (id, field), coalesce(n, 0) AS n, coalesce(a, false) AS a, coalesce(b, false) AS b, av, bv, ac, bc, {p("e.value")} = {p("e.own_value")} AS own FROM (SELECT id, field FROM x WHERE field <> 'region' AND (field <> 'movie_title' OR kind = 'movie')) w LEFT JOIN e ON e.id = w.id AND e.field = w.field LEFT JOIN q ON q.id = w.id AND q.field = w.field),
z AS (SELECT *, there AND source_hash IS NOT NULL AND {SEEN} AS crop, coalesce(ac >= 0.98 AND av IS NOT NULL AND b AND bv IS NULL AND field IN ('schedule', 'location') AND own AND {p("av")} = {p("value")}, false) AS sure, coalesce(derived AND agreement = 'exact' AND own, false) AS der FROM y),
u AS (SELECT *, agreement = 'exact' OR sure AS said, coalesce(av = bv, false) OR sure OR der AS agree, coalesce({p("av")} = {p("own_value")}, false) OR sure OR der AS same FROM z),
codes AS (SELECT id, unnest([{rules(OWN_CODES)}]) AS code FROM c LEFT JOIN k USING (id) LEFT JOIN m USING (id) UNION ALL SELECT id, unnest([{rules(FIELD_CODES)}]) || ':' || field FROM u),
l AS (SELECT id, list(DISTINCT code) FILTER (code IS NOT NULL) AS f FROM codes GROUP BY id), v AS (SELECT id, coalesce(seen, false) AS seen, list_sort(CASE WHEN len(f) > 0 AND NOT coalesce(seen, false) THEN list_append(f, 'missing_reviewable_evidence') ELSE coalesce(f, []) END) AS f FROM l LEFT JOIN k USING (id))
SELECT id, array_to_string(f, ',') AS findings, CASE WHEN len(f) = 0 THEN 'auto_publishable' WHEN NOT seen OR len(list_filter(f, lambda x: regexp_full_match(x, '{REJECT}'))) > 0 THEN 'rejected' ELSE 'needs_review' END AS status FROM v
""")
def evidence_findings(t: Tables) -> DataFrame:
    """All findings of all candidates and their status."""
    rows = candidates(t)
    proof = evidence(rows)
    out = consensus.findings(rows, proof, records(proof), NORMALS, ("alpha", "beta"), ("frame",), ("generic",), ("nothing here",))
    return out.withColumn("findings", F.array_join("findings", ","))
