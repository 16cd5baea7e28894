"""Documents as snapshots: quality, regions, provenance, authority, windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import snapshots
from millrace.plans.registry import query
from millrace.sources.tables import Tables

LAYOUTS = {"src0": [("header", 0.0, 0.0, 1.0, 0.13), ("left", 0.0, 0.13, 0.5, 0.96), ("right", 0.48, 0.13, 1.0, 0.96), ("footer", 0.0, 0.96, 1.0, 1.0)], "src1": [("header", 0.0, 0.0, 1.0, 0.08), ("rows", 0.0, 0.08, 1.0, 0.985)]}
POLICY = [{"kind": "src0", "authority": "primary"}, {"kind": "src1", "authority": "listing", "forbidden": ["public_price_amount"]}, {"kind": "src2", "authority": "blog", "forbidden": ["public_price_state"], "cannot_override": ["free_price_state"]}, {"kind": "src0", "authority": "shadowed"}]


@query("""
WITH d AS (SELECT doc_id AS id, n_chars, source, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT id, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM d), x AS (SELECT id, k, CASE WHEN line = '' THEN 'unknown' ELSE lower(line[1]) END AS engine, CASE WHEN line = '' THEN 'empty' WHEN contains(line, '.') THEN 'ok' ELSE 'unknown' END AS status, len(string_split(line, ' ')) AS tokens FROM r),
s AS (SELECT id, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT id, status, count(*) AS n FROM x GROUP BY ALL) GROUP BY id), e AS (SELECT id, string_agg(engine || '=' || n, ',' ORDER BY engine) AS engine_tokens FROM (SELECT id, engine, arg_max(tokens, k) AS n FROM x GROUP BY ALL) GROUP BY id)
SELECT d.id, (CASE WHEN source IS NULL THEN 0 ELSE 2 END)::BIGINT AS pages, (CASE WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END)::BIGINT AS regions, 0::BIGINT AS tokens, coalesce(statuses, '') AS statuses, coalesce(engine_tokens, '') AS engine_tokens,
  (CASE WHEN source IS NULL THEN 0 ELSE (n_chars >= 800)::INT END)::BIGINT AS reviewable,
  concat_ws(',', CASE WHEN source IS NULL THEN 'missing_source_pages' END, CASE WHEN n_chars % 5 = 0 THEN 'missing_regions' END, CASE WHEN lines IS NULL THEN 'missing_ocr_tokens' END, CASE WHEN n_chars % 7 = 0 THEN 'ocr_engine_error:beta' END,
    CASE WHEN source IS NOT NULL AND n_chars < 800 THEN 'low_quality_image:page_1' END, CASE WHEN source IS NOT NULL THEN 'missing_page_image_hash:page_2,low_quality_image:page_2' END) AS findings
FROM d LEFT JOIN s ON s.id = d.id LEFT JOIN e ON e.id = d.id
""")
def snapshot_quality(t: Tables) -> DataFrame:
    """Documents whose lines are engine runs: counts, the last run of each engine, findings in order."""
    n = F.col("n_chars")
    page = lambda k, h, w, t_: F.struct(F.lit(k).alias("number"), F.lit(h).alias("hash"), w.cast("long").alias("width"), F.lit(t_).alias("height"))
    runs = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lower(F.substring(x, 1, 1)).alias("engine"), F.when(x == "", "empty").when(x.contains("."), "ok").alias("status"), F.size(F.split(x, " ")).cast("long").alias("tokens")))
    pages = F.when(F.col("source").isNotNull(), F.array(page(1, "h", n, 800), page(2, "", F.lit(799), 900)))
    told = F.when(n % 7 == 0, F.lit(["noise", "ocr_engine_error:beta", "ocr_engine_error:beta"])).otherwise(F.lit(["ocr_engine_errors"]))
    rows = t.documents.select("doc_id", pages.alias("pages"), runs.alias("runs"), F.when(n % 5 > 0, F.lit(["r"])).alias("regions"), F.lit(None).cast("array<string>").alias("tokens"), told.alias("errors"))
    return snapshots.quality(rows, "doc_id")


@query(f"""
WITH l AS (SELECT unnest({[[str(x) for x in (k, i, *v)] for k, vs in LAYOUTS.items() for i, v in enumerate(vs, 1)]!r}::VARCHAR[][]) AS v), d AS (SELECT doc_id AS id, source, n_chars AS w, n_chars * 2 + 1 AS h FROM documents),
j AS (SELECT id, v[2]::INT AS nth, v[3] AS region, v[4]::DOUBLE AS a, v[5]::DOUBLE AS b, v[6]::DOUBLE AS c, v[7]::DOUBLE AS e, w, h FROM d JOIN l ON v[1] = source UNION ALL SELECT id, 1, 'unknown', 0, 0, 1, 1, w, h FROM d WHERE source IS NULL OR source NOT IN ('src0', 'src1'))
SELECT id, nth, region, round_even(w * a, 0)::BIGINT AS "left", round_even(h * b, 0)::BIGINT AS top, round_even(w * c, 0)::BIGINT AS "right", round_even(h * e, 0)::BIGINT AS bottom FROM j
""")
def region_rows(t: Tables) -> DataFrame:
    """The regions of each document's layout in pixels."""
    d = t.documents.withColumn("h", F.col("n_chars") * 2 + 1)
    return snapshots.regions(d, "doc_id", "source", "n_chars", "h", LAYOUTS)


@query("""
WITH d AS (SELECT doc_id, text, lang, CASE WHEN doc_id % 9 > 0 THEN coalesce(source, '') END AS url, CASE WHEN doc_id % 11 = 0 THEN 'xyz' ELSE sha256(text) END AS sha, ['free', 'fee', 'unknown', 'odd', '', NULL][doc_id % 6 + 1] AS price FROM documents),
e AS (SELECT doc_id, unnest([CASE WHEN coalesce(url, '') = '' THEN 'missing_source_url' END, CASE WHEN sha IS NULL OR length(sha) <> 64 THEN 'missing_source_hash' END, CASE WHEN NOT coalesce(contains(text, chr(10)), false) THEN 'missing_resort_join' END, CASE WHEN lang IS NULL THEN 'missing_surface_provenance' END,
  CASE WHEN NOT coalesce(regexp_matches(text, '[0-9]'), false) THEN 'missing_distance_provenance' END, CASE WHEN price = 'odd' OR price IN ('free', 'fee') AND NOT coalesce(regexp_matches(text, '[$]'), false) THEN 'price_without_source' END]) AS error FROM d)
SELECT doc_id, 'trail_' || error AS error FROM e WHERE error IS NOT NULL
""")
def provenance_audit(t: Tables) -> DataFrame:
    """What documents lack as sourced offerings: url, digest, joins, spans of required fields, sources of prices."""
    k, text = F.col("doc_id"), F.col("text")
    spans = F.create_map(
        F.lit("resort_join"), F.when(text.contains("\n"), F.array(F.lit("line"))), F.lit("surface"), F.when(F.col("lang").isNotNull(), F.array("lang")), F.lit("distance"), F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0)), F.lit("price"), F.regexp_extract_all("text", F.lit("[$]"), F.lit(0)),
    )
    price = F.element_at(F.lit(["free", "fee", "unknown", "odd", ""]), F.when(k % 6 < 5, k % 6 + 1).cast("int"))
    rows = t.documents.select("doc_id", F.when(k % 9 > 0, F.col("source")).alias("source_url"), F.when(k % 11 == 0, "xyz").otherwise(F.sha2("text", 256)).alias("source_sha256"), price.alias("price_state"), spans.alias("spans"))
    return snapshots.provenance_errors(rows, "doc_id", ["surface", "distance"], "trail_")


@query("""
SELECT doc_id, CASE source WHEN 'src0' THEN 'primary' WHEN 'src1' THEN 'listing' WHEN 'src2' THEN 'blog' ELSE 'unknown' END AS authority, coalesce(source = 'src0', false) AS may_price, coalesce(source IN ('src0', 'src1'), false) AS may_override,
  coalesce(lang NOT IN ('', 'en', 'fr'), false) OR coalesce(source NOT IN ('', 'en', 'fr'), false) AS disagrees FROM documents
""")
def source_policies(t: Tables) -> DataFrame:
    """What documents' sources may decide, and whether any of their fields disagrees."""
    fields = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    return t.documents.select("doc_id", snapshots.authority(F.col("source"), POLICY).alias("p"), snapshots.disagrees(fields, ("en", "fr")).alias("disagrees")).select("doc_id", "p.*", "disagrees")


@query("""
WITH e AS (SELECT user_id, ts, value, event_type, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM events), r AS (SELECT *, value > 60 AS storm, event_type = 'click' AS rain, value < 5 AS heat FROM e)
SELECT user_id || '-' || k || '-' || strftime(ts, '%Y%m%d%H%M%S') AS "window", ts, CASE WHEN storm THEN 'stay_indoors' WHEN rain OR heat THEN 'bring_backup' ELSE 'go_now' END AS action,
  CASE WHEN storm THEN 'Storm Mode' WHEN rain THEN 'Rain Window' WHEN heat THEN 'Heat Buildup' WHEN h >= 18 THEN 'Starlight Reset' ELSE 'Sunshine Start' END AS chapter, CASE WHEN storm THEN 'pool,campfire,outdoor_movie' WHEN heat THEN 'walking_heavy,heat_sensitive' ELSE '' END AS avoid FROM r
""")
def window_classes(t: Tables) -> DataFrame:
    """Each user's events as weather windows, named by their place."""
    level = lambda c: F.when(c, "high").otherwise("low")
    return snapshots.windows(t.events, "user_id", "ts", level(F.col("value") > 60), level(F.col("event_type") == "click"), level(F.col("value") < 5), F.hour("ts"))
