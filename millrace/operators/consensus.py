"""Candidates read by several engines: votes on each field, agreement of required engines, findings, and the status that follows.

Three tables go in, any column of them may be null:

* candidates: ``id, kind, family, title, pipeline_version, config_hash, lineage`` (struct of ``config_hash, lineage_hash, git_sha`` and the flags ``config, packages, models,
  engines``), ``canonical_url, fetched_url, source_kind, http_status, currentness, captured_at, source_document_id, content_sha256, page_hashes`` (array),
  ``region_id, region_type, schedule_ok, prior`` (findings so far)
* evidence: ``id, field, own_raw, own_value`` (what the candidate has), ``raw, value, agreement, derived, source_hash, page, page_hash, box, crop_hash, crop_path, spans``
  (array of struct ``page, text``)
* records: ``id, field, engine, place, text, confidence, box`` (boxes are arrays of left, top, right, bottom)

A field's evidence and records meet by (id, field); nothing is gathered but a field's few engines and a candidate's findings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import errors

# Fixed values.
EXACT, MANUAL = "exact_after_normalization", "manual_reviewed"
CRITICAL = ("title", "schedule", "location", "fee")
EXTRA = {"movie": ("movie_title",)}
RAW_COMPARED = ("title", "schedule", "location", "movie_title")
TRUSTING = ("schedule", "location")
REJECTING = (
    "missing_pipeline_version", "missing_config_hash", "missing_runtime_lineage", "missing_runtime_lineage_config_hash", "missing_runtime_lineage_hash", "missing_git_sha",
    "missing_runtime_config", "missing_package_versions", "missing_model_asset_hashes", "missing_ocr_engine_configs", "runtime_lineage_config_hash_mismatch",
    "missing_canonical_page_image", "region_source_hash_mismatch", "missing_source_url", "missing_source_kind", "non_official_source", "source_fetch_not_successful",
    "source_not_current", "missing_source_captured_at", "missing_reviewable_field_evidence", "missing_source_document_id", "missing_content_sha256",
)
REJECTING_FIELDS = ("field_source_hash_mismatch:", "field_page_image_not_canonical:")

Normal = Callable[[Column], Column]


def plain(text: Column) -> Column:
    """A text lower-cased, trimmed, its blanks single; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+", " "))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def overlap(a: Column, b: Column) -> Column:
    """The shared part of two boxes' united area, null if one has no area or is null."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    shared = side(0) * side(1)
    both = area(a) + area(b) - shared
    return F.when((area(a) > 0) & (area(b) > 0), shared / both)


def normalised(field: Column, text: Column, normals: dict[str, Normal]) -> Column:
    """A text by its field's normaliser (null: it can't be read), by :func:`plain` where there is none."""
    out = F.lit(None).cast("string")
    for name, normal in normals.items():
        out = F.when(field == name, normal(text)).otherwise(out)
    return F.when(field.isin(*normals), out).otherwise(plain(text)) if normals else plain(text)


def engine_records(records: DataFrame, normals: dict[str, Normal]) -> DataFrame:
    """One record for each (id, field, engine) that has an engine and a text, the first by place (ties: the least text), with its normalised ``value``."""
    real = records.filter(~blank(F.col("engine")) & ~blank(F.col("text")))
    one = real.groupBy("id", "field", F.trim("engine").alias("engine")).agg(F.min(F.struct("place", "text", "confidence", "box")).alias("r")).select("id", "field", "engine", "r.*")
    return one.withColumn("value", normalised(F.col("field"), F.col("text"), normals))


def vote(records: DataFrame, evidence: DataFrame, normals: dict[str, Normal], least_overlap: float = 0.5) -> DataFrame:
    """(id, field, value, backing, engines, confidence, unanimous): what most engines read in a field's box.

    Engines whose box overlaps the field's by less than ``least_overlap`` read something else and have no vote; without a box on either side they have one. Ties go to
    the greater sum of confidences, then to the least value. ``engines`` counts the voters, those that could not read a value included.
    """
    boxes = evidence.select("id", "field", F.col("box").alias("_box"))
    near = engine_records(records, normals).join(boxes, ["id", "field"], "left")
    near = near.filter(F.coalesce(overlap(F.col("box"), F.col("_box")), F.lit(1.0)) >= least_overlap)
    tally = near.groupBy("id", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("confidence", F.lit(0.0))), 6).alias("c"))
    # the least struct wins: no value last, then fewer votes, then less confidence
    order = F.struct(F.col("value").isNull().alias("none"), (-F.col("n")).alias("n"), (-F.col("c")).alias("c"), "value")
    best = tally.groupBy("id", "field").agg(F.min(order).alias("b"), F.sum("n").alias("engines"))
    backing = F.when(F.col("b.none"), F.lit(0)).otherwise(-F.col("b.n"))
    return best.select("id", "field", "b.value", backing.alias("backing"), "engines", F.when(~F.col("b.none"), -F.col("b.c")).alias("confidence"), (backing == F.col("engines")).alias("unanimous"))


def lineage_codes() -> list[tuple[str, Column]]:
    x = F.col("lineage")
    there = x.isNotNull()
    off = lambda c: there & ~F.coalesce(x[c], F.lit(False))
    return [
        ("missing_pipeline_version", blank(F.col("pipeline_version"))),
        ("missing_config_hash", blank(F.col("config_hash"))),
        ("missing_runtime_lineage", ~there),
        ("missing_runtime_lineage_config_hash", there & blank(x["config_hash"])),
        ("runtime_lineage_config_hash_mismatch", there & ~blank(x["config_hash"]) & ~blank(F.col("config_hash")) & (F.trim(x["config_hash"]) != F.trim("config_hash"))),
        ("missing_runtime_lineage_hash", there & blank(x["lineage_hash"])),
        ("missing_git_sha", there & blank(x["git_sha"])),
        ("missing_runtime_config", off("config")),
        ("missing_package_versions", off("packages")),
        ("missing_model_asset_hashes", off("models")),
        ("missing_ocr_engine_configs", off("engines")),
    ]


def provenance_codes(official: str = "official_") -> list[tuple[str, Column]]:
    web = lambda c: F.coalesce(F.col(c).rlike("^https?://"), F.lit(False))
    kind, status = F.trim(F.coalesce("source_kind", F.lit(""))), F.coalesce("http_status", F.lit(0))
    return [
        ("missing_source_url", ~(web("canonical_url") | web("fetched_url"))),
        ("missing_source_kind", kind == ""),
        ("non_official_source", (kind != "") & ~kind.startswith(official)),
        ("source_fetch_not_successful", (status < 200) | (status >= 300)),
        ("source_not_current", plain(F.col("currentness")) != "current"),
        ("missing_source_captured_at", blank(F.col("captured_at"))),
    ]


def field_findings(candidates: DataFrame, evidence: DataFrame, records: DataFrame, normals: dict[str, Normal], engines: tuple[str, str], trust: float = 0.98) -> DataFrame:
    """(id, field_codes) of every candidate: the codes of its required fields, each with the field's name. Evidence has one row for each (id, field).

    Two required engines agree on a field if both read the same value. A primary engine that is ``trust`` sure is believed where the other can't read a schedule or a place,
    and evidence marked ``derived`` (composed, inferred or recovered) where it agrees and has the candidate's value.
    """
    extra = F.lit([]).cast("array<string>")
    for kind, fields in EXTRA.items():
        extra = F.when(F.col("kind") == kind, F.lit(list(fields))).otherwise(extra)
    wanted = candidates.select("id", "content_sha256", "page_hashes", F.explode(F.concat(F.lit(list(CRITICAL)), extra)).alias("field"))
    a, b = engines
    of = lambda e: F.max(F.when(F.col("engine") == e, F.struct("value", "confidence", "text")))  # noqa: E731  one record an engine
    read = engine_records(records, normals).groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"), of(a).alias("a"), of(b).alias("b"))
    met = wanted.join(evidence.withColumn("_there", F.lit(True)), ["id", "field"], "left").join(read, ["id", "field"], "left")

    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    there, field = yes(c("_there")), c("field")
    crop = ~reduce(lambda p, q: p | q, [blank(c(x)) for x in ("source_hash", "page", "page_hash", "crop_hash", "crop_path")]) & c("box").isNotNull()
    span = yes(F.exists("spans", lambda s: ~blank(s["text"]) & ~blank(s["page"])))
    own = plain(c("value")) == plain(c("own_value"))
    sure = yes((c("a.confidence") >= trust) & c("a.value").isNotNull() & c("b").isNotNull() & c("b.value").isNull()) & field.isin(*TRUSTING) & own & (plain(c("a.value")) == plain(c("value")))
    derived = yes(c("derived")) & yes(c("agreement") == EXACT) & own
    said = yes(c("agreement") == EXACT) | sure
    agree = yes(c("a.value") == c("b.value")) | sure | derived
    same = yes(plain(c("a.value")) == plain(c("own_value"))) | sure | derived
    both, certain = c("a").isNotNull() & c("b").isNotNull(), c("a.confidence").isNotNull() & c("b.confidence").isNotNull()
    go = there & crop & ~yes(c("agreement") == MANUAL)
    raw_differs = ~blank(c("raw")) & field.isin(*RAW_COMPARED) & ~blank(c("own_raw")) & (plain(c("raw")) != plain(c("own_raw")))
    own_hash, hashes = F.trim(F.coalesce("content_sha256", F.lit(""))), F.filter(c("page_hashes"), lambda h: ~blank(h))
    few = F.coalesce(c("n"), F.lit(0)) < 2
    codes = errors(
        ("missing_source_span", ~span),
        ("missing_field_raw_value", there & blank(c("raw"))),
        ("field_raw_value_mismatch", there & raw_differs),
        ("missing_field_normalized_value", there & blank(c("value"))),
        ("field_normalized_value_mismatch", there & ~blank(c("value")) & ~own),
        ("field_source_hash_mismatch", there & ~blank(c("source_hash")) & (own_hash != "") & (F.trim("source_hash") != own_hash)),
        ("field_page_image_not_canonical", there & ~blank(c("page_hash")) & yes(F.size(hashes) > 0) & ~yes(F.array_contains(hashes, c("page_hash")))),
        ("missing_required_field", ~(there & crop)),
        ("manual_review_required", there & crop & yes(c("agreement") == MANUAL)),
        ("missing_field_engine_evidence", go & few),
        ("missing_required_engine_evidence", go & ~few & ~both),
        ("missing_field_engine_confidence", go & ~few & both & ~certain),
        ("engine_disagreement", go & ~(said & agree)),
        ("field_engine_value_mismatch", go & said & agree & ~same),
    )
    coded = met.select("id", F.transform(codes, lambda x: F.concat_ws(":", x, c("field"))).alias("codes"))
    return coded.groupBy("id").agg(F.flatten(F.collect_list("codes")).alias("field_codes"))


def findings(candidates: DataFrame, evidence: DataFrame, records: DataFrame, normals: dict[str, Normal], engines: tuple[str, str], families: tuple[str, ...], review_kinds: tuple[str, ...] = (), not_titles: tuple[str, ...] = (), trust: float = 0.98) -> DataFrame:
    """(id, findings, status) of every candidate: all codes, sorted and once each; without any it is ``auto_publishable``, with a rejecting one ``rejected``, else ``needs_review``."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    seen = ~reduce(lambda p, q: p | q, [blank(c(x)) for x in ("page_hash", "crop_hash", "crop_path")])
    crop = seen & ~blank(c("source_hash")) & ~blank(c("page")) & c("box").isNotNull()
    critical = c("field").isin(*CRITICAL, *(f for fs in EXTRA.values() for f in fs))
    is_region, is_fee = c("field") == "region", c("field") == "fee"
    fee_off = is_fee & c("value").isNotNull() & ~(plain(c("value")) == plain(c("own_value")))
    each = evidence.groupBy("id").agg(
        F.bool_or(seen).alias("seen"), F.bool_or(seen & critical).alias("seen_critical"), F.bool_or(is_region & crop).alias("region"), F.max(F.when(is_region & crop, c("source_hash"))).alias("region_hash"),
        F.bool_or(fee_off).alias("fee_off"), F.max(F.when(is_fee, plain(c("own_value")))).alias("fee_own"), F.max(F.when(c("field") == "location", plain(c("own_value")))).alias("place"),
    )
    marked = records.filter((c("field") == "fee") & (F.trim("text") == "($)") & ~blank(c("engine"))).select("id").distinct().withColumn("marked", F.lit(True))
    met = candidates.join(field_findings(candidates, evidence, records, normals, engines, trust), "id", "left").join(each, "id", "left").join(marked, "id", "left")
    title = plain(c("title"))
    kind = F.trim(F.coalesce("kind", F.lit("")))
    place = F.coalesce("place", F.lit(""))
    own = errors(
        *lineage_codes(), *provenance_codes(),
        ("unknown_document_family", ~yes(c("family").isin(*families))), ("missing_source_document_id", blank(c("source_document_id"))), ("missing_content_sha256", blank(c("content_sha256"))),
        ("missing_canonical_page_image", ~yes(F.exists("page_hashes", lambda h: ~blank(h)))), ("missing_activity_region_id", blank(c("region_id"))), ("missing_activity_region_type", blank(c("region_type"))),
        ("missing_activity_region_evidence", ~yes(c("region"))), ("region_source_hash_mismatch", yes(c("region")) & (F.trim(F.coalesce("region_hash", F.lit(""))) != F.trim(F.coalesce("content_sha256", F.lit(""))))),
        ("unparsed_schedule", ~yes(c("schedule_ok"))), ("unknown_location", place.isin("", "unknown")), ("non_activity_title:title", title.isin(*not_titles) | title.startswith("and ")),
        ("fee_marker_conflict", yes(c("fee_off")) | (yes(c("marked")) & yes(c("fee_own") == "false"))),
        ("missing_reviewable_field_evidence", yes(F.array_contains("prior", "field_extraction_not_implemented")) & ~yes(c("seen_critical"))),
    )
    only = F.when(kind.isin(*review_kinds), F.array(F.concat(F.lit("review_only_candidate_type:"), kind))).otherwise(F.lit([]).cast("array<string>"))
    none = F.lit([]).cast("array<string>")
    every = F.concat(F.coalesce("prior", none), own, only, F.coalesce("field_codes", none))
    every = F.when((F.size(every) > 0) & ~yes(c("seen")), F.array_append(every, F.lit("missing_reviewable_evidence"))).otherwise(every)
    out = met.select("id", F.array_sort(F.array_distinct(F.filter(every, lambda x: ~blank(x)))).alias("findings"), yes(c("seen")).alias("_seen"))
    rejects = F.exists("findings", lambda x: x.isin(*REJECTING) | reduce(lambda p, q: p | q, [x.startswith(f) for f in REJECTING_FIELDS])) | ~c("_seen")
    return out.select("id", "findings", F.when(F.size("findings") == 0, "auto_publishable").when(rejects, "rejected").otherwise("needs_review").alias("status"))
