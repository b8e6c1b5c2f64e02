"""A corpus pipeline of five stages; each is written as Parquet and read again before the next.

Stages take and return the columns of documents, except the last, which returns the pieces of the packed sequences.
Each row is judged by itself: where decisions are joined back, rows are numbered and written first, and the numbers are
the key. Rows whose doc_id is null or repeated are rows like any other; of rows repeated whole near dedup keeps one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlark.llm import minhash, packing, quality, secret_scan, suffix_dedup
from flowlark.llm.common import cut, free
from flowlark.llm.queries import vocabulary

#: SQL expresses neither the sketches nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def _only(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; it gives (row, kept) of rows numbered as _row."""
    numbered = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    kept = judge(numbered).filter("kept").select(F.col("row").alias("_row"))
    return numbered.join(kept, "_row", "left_semi").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return _only(docs, lambda d: quality.judge(d, row_col="_row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return _only(docs, lambda d: minhash.near_duplicates(d, row_col="_row"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that also occur elsewhere go from the texts; n_chars follows."""
    stripped = suffix_dedup.strip_repeats(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    out = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return stripped.withColumns(out).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; n_chars follows."""
    masked = secret_scan.mask_secrets(docs, vocabulary=vocabulary())
    out = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return masked.withColumns(out).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("suffix dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
