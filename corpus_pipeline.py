"""The corpus pipeline: quality, near duplicates, repeated strings, source mix, tokens.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``. Every stage works on all rows that its predecessor kept, and may be given its predecessor's
rows as a table written and read again. :func:`run` writes each stage's rows to the shared folder, so that a
lost executor never sends a later stage back to the start.

Nulls: a null text is an empty one; it fails the quality rules. The near-duplicate stage keeps one row of each group of similar texts,
whatever their doc_ids. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, fertility, mixing, simhash, suffix_dedup
from millrace.llm.common import materialize
from millrace.llm.queries import tokenizer_path

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bytes of a repeated string: fifty words of a European language take more in 99 texts of 100.
REPEATED_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = fertility.judge(docs, tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    # Rows of one doc_id can have different texts: a verdict belongs to a row's doc_id and counts.
    good = judged.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("lang")).alias("h"))
    return own.join(good, F.col("doc.doc_id").eqNullSafe(good["_id"]) & (F.col("h") == F.col("_hash")), "left_semi").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are 0.8 alike or more, by SimHash."""
    return simhash.keep_representatives(docs, simhash.similar_documents(docs, SIMILARITY, SHINGLE_WORDS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of ``REPEATED_BYTES`` that occur elsewhere; documents that lose everything go."""
    left = suffix_dedup.strip_repeats(docs, least=REPEATED_BYTES)
    left = left.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "source"))
    return mixing.repeat_rows(mixing.mix(docs, carry=others), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the text back."""
    coded = bpe.encode_texts(docs, tokenizer_path("byte_bpe_50k.json"), carry=("doc_id", "source"))
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mix", source_mix),
    ("BPE tokens", tokens),
]

#: Fertility, fingerprints and BPE have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
