"""Found records against golden ones: roles and quarantine sets, fields, warnings, and required spans in numbered page lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import errors

# The roles of golden records and what is said where such a record isn't found.
MISSING = {"public": "candidate_missing", "manual": "candidate_manual_missing", "quarantine": "candidate_quarantine_missing"}
UNEXTRACTABLE = "unextractable"


def page_lines(docs: DataFrame, row_id: str, text: str, per_page: int) -> DataFrame:
    """(id, page, line, text) of all lines of texts, pages of so many lines, both counted from 1; a null text has no line."""
    each = docs.select(F.col(row_id).alias("id"), F.posexplode(F.split(text, "\n")).alias("k", "text"))
    return each.select("id", (F.floor(F.col("k") / per_page) + 1).cast("int").alias("page"), (F.col("k") % per_page + 1).cast("int").alias("line"), "text")


def span_errors(lines: DataFrame, required: DataFrame) -> DataFrame:
    """(id, field, place, error) of required spans (id, field, place, page, line, text) that aren't where they should be.

    A span is in order if its line exists and contains its text; a null page and line mean any line, a null or blank text any text. A span whose text is on other
    lines only is ``wrong_line`` with the first of these, one whose text is nowhere ``missing_span``, one without text whose line isn't there ``missing_line``.
    Spans meet their own line by its number; only those that fail there are looked for in their record's other lines, never in another record's.
    Lines have one row for each (id, page, line).
    """
    at = lines.select("id", "page", "line", F.col("text").alias("_t"), F.lit(True).alias("_there"))
    needle = F.trim(F.coalesce("text", F.lit("")))
    asked = required.withColumn("_n", needle)
    own = asked.join(at, ["id", "page", "line"], "left")
    fine = F.coalesce(F.col("_there"), F.lit(False)) & ((F.col("_n") == "") | F.col("_t").contains(F.col("_n")))
    any_line = F.col("page").isNull() & F.col("line").isNull()
    lost = own.filter(~fine & ~(any_line & (F.col("_n") == ""))).select("id", "field", "place", "page", "line", "_n")
    elsewhere = lost.filter("_n <> ''").select("id", "_n").distinct().join(lines.select("id", F.struct("page", "line").alias("_at"), F.col("text").alias("_t")), "id")
    first = elsewhere.filter(F.col("_t").contains(F.col("_n"))).groupBy("id", "_n").agg(F.min("_at").alias("_at"))
    met = lost.join(first, ["id", "_n"], "left").filter(~(any_line & F.col("_at").isNotNull()))
    error = F.when(F.col("_n") == "", "missing_line").when(F.col("_at").isNull(), "missing_span").otherwise(F.concat_ws(":", F.lit("wrong_line"), F.col("_at.page").cast("string"), F.col("_at.line").cast("string")))
    return met.select("id", "field", "place", error.alias("error"))


def set_errors(found: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """(id, error) of found records (id, fields, warnings) against golden ones (id, role, fields, warnings); ids are unique on each side.

    Public, manual and quarantined records must be found with the golden fields (a null golden field isn't compared), quarantined and unextractable ones with the golden
    warnings, whatever their order, if these aren't null. A found unextractable record without warnings has become extractable; one that isn't found is in order, and a
    found record of no role is unexpected.
    """
    f = found.select("id", F.lit(True).alias("_f"), F.array_sort(F.coalesce("warnings", F.lit([]).cast("array<string>"))).alias("_fw"), *[F.col(c).cast("string").alias(f"_f_{c}") for c in fields])
    e = expected.select("id", "role", F.array_sort("warnings").alias("_ew"), *[F.col(c).cast("string").alias(f"_e_{c}") for c in fields])
    met = f.join(e, "id", "full")
    there, role = F.coalesce(F.col("_f"), F.lit(False)), F.col("role")
    absent: Column = F.lit(None).cast("string")
    for name, code in MISSING.items():
        absent = F.when((role == name) & ~there, code).otherwise(absent)
    drift = [(f"fixture_drift:{c}", there & role.isin(*MISSING) & F.col(f"_e_{c}").isNotNull() & ~F.col(f"_e_{c}").eqNullSafe(F.col(f"_f_{c}"))) for c in fields]
    nameless = (role == "quarantine") & F.col("id").isNull()
    codes = errors(
        ("fixture_quarantine_missing:slug", nameless), *drift,
        ("fixture_drift:warnings", there & role.isin("quarantine", UNEXTRACTABLE) & F.col("_ew").isNotNull() & (F.col("_ew") != F.col("_fw"))),
        ("candidate_unextractable_became_extractable", there & (role == UNEXTRACTABLE) & (F.size("_fw") == 0)), ("candidate_unexpected", there & role.isNull()),
    )
    every = F.when(absent.isNotNull() & ~F.coalesce(nameless, F.lit(False)), F.array_append(codes, absent)).otherwise(codes)
    return met.select("id", F.explode(every).alias("error"))
