"""A corpus from raw documents to token ids, stage by stage.

Each stage gets what its predecessor kept, written as Parquet and read again.
SQL can't express the stages; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackwright.llm.common import remove, stage_path, table
from stackwright.llm.decontam import decontaminate
from stackwright.llm.langid import in_known_language
from stackwright.llm.mixing import repeat_documents
from stackwright.llm.neardup import drop_near_duplicates
from stackwright.llm.token_io import token_digests, write_token_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the labelled languages go: those without letters
    (null and empty texts too) and long ones whose cosine is below the fitted
    least one.  Without labels all lettered documents stay; repeated rows all
    stay; other columns are kept under any names."""
    return in_known_language(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest
    id; a row that repeats id and text stays once, and null texts without an id
    all stay."""
    return drop_near_duplicates(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts
    hold none and stay, as do all where the benchmark is empty."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as passes of its source take from it: sources over
    their target lose documents, sources under it repeat theirs up to three times.
    Documents without words are taken by no pass."""
    return repeat_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id files of all copies, read back: doc_id, start, n_tokens,
    ids_crc32.  A null text has the end id only."""
    path = stage_path(spark, "token-ids")
    write_token_ids(docs, path, chunks=500_000, pieces=100_000)  # the stages before leave large heaps
    return token_digests(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", deduplicate),
    ("decontamination", remove_benchmarks),
    ("mixing", mix),
    ("token_ids", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  Each stage's table goes when its successor is
    written; an empty table of documents gives no rows."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
