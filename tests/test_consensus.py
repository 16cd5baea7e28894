"""Votes, agreement and findings over engines' records: ties, overlap, nulls, and every code of the rules."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import consensus
from millrace.plans.queries import queries

BOX = [0.0, 0.0, 10.0, 10.0]
NORMALS = {"place": lambda x: F.when(~x.contains("?"), consensus.plain(x))}
RECORDS = "id int, field string, engine string, place int, text string, confidence double, box array<double>"
FOLDER = "/root/testdata/sf0.01"


def votes(spark, rows, box=BOX):
    proof = spark.createDataFrame([(1, "place", box)], "id int, field string, box array<double>")
    got = consensus.vote(spark.createDataFrame([(1, "place", *r) for r in rows], RECORDS), proof, NORMALS).collect()
    return [(r["value"], r["backing"], r["engines"], r["confidence"], r["unanimous"]) for r in got]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", 1, "Pool", 0.9, BOX), ("b", 2, "POOL ", 0.8, None), ("c", 3, "Beach", 1.0, BOX)], [("pool", 2, 3, 1.7, False)]),
        ([("a", 1, "Pool", 0.5, BOX), ("b", 2, "Beach", 0.6, BOX)], [("beach", 1, 2, 0.6, False)]),
        ([("a", 1, "Pool", None, BOX), ("b", 2, "Beach", 0.0, BOX)], [("beach", 1, 2, 0.0, False)]),
        ([("a", 1, "Pool", 0.5, BOX), ("a", 2, "Beach", 0.9, BOX), (" ", 0, "x", 1.0, BOX), ("b", 0, " ", 1.0, BOX)], [("pool", 1, 1, 0.5, True)]),
        ([("a", 1, "Pool", 0.5, [0.0, 0.0, 4.9, 10.0]), ("b", 2, "Beach", 0.1, [0.0, 0.0, 5.0, 10.0])], [("beach", 1, 1, 0.1, True)]),
        ([("a", 1, "P?", 0.5, BOX), ("b", 2, "Q?", 0.5, BOX)], [(None, 0, 2, None, False)]),
        ([], []),
    ],
)
def test_votes(spark, rows, want):
    assert votes(spark, rows) == want


def test_overlap_of_empty_boxes_is_null(spark):
    none = F.lit([1.0, 1.0, 1.0, 5.0])
    got = spark.range(1).select(consensus.overlap(none, F.lit(BOX)), consensus.overlap(F.lit(None).cast("array<double>"), F.lit(BOX)), consensus.overlap(F.lit(BOX), F.lit([20.0, 0.0, 30.0, 10.0]))).first()
    assert tuple(got) == (None, None, 0.0)


# Every code that the rules can give.
CODES = """
missing_pipeline_version missing_config_hash missing_runtime_lineage missing_runtime_lineage_config_hash runtime_lineage_config_hash_mismatch missing_runtime_lineage_hash missing_git_sha
missing_runtime_config missing_package_versions missing_model_asset_hashes missing_ocr_engine_configs missing_source_url missing_source_kind non_official_source source_fetch_not_successful
source_not_current missing_source_captured_at unknown_document_family review_only_candidate_type missing_source_document_id missing_content_sha256 missing_canonical_page_image
field_page_image_not_canonical missing_activity_region_id missing_activity_region_type missing_activity_region_evidence region_source_hash_mismatch missing_source_span missing_field_raw_value
field_raw_value_mismatch missing_field_normalized_value field_normalized_value_mismatch field_source_hash_mismatch missing_required_field manual_review_required missing_field_engine_evidence
missing_required_engine_evidence missing_field_engine_confidence engine_disagreement field_engine_value_mismatch unparsed_schedule unknown_location non_activity_title fee_marker_conflict
missing_reviewable_field_evidence missing_reviewable_evidence field_extraction_not_implemented
""".split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_every_code_has_a_row(spark):
    rows = queries()["evidence_findings"](spark, FOLDER).collect()
    assert {f.split(":")[0] for r in rows for f in r["findings"].split(",") if f} == set(CODES)
    assert {r["status"] for r in rows} == {"auto_publishable", "needs_review", "rejected"}
