"""Finding duplicate books: by content, by metadata, against the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHED_BYTES = 262_144


def by_content(df: DataFrame, path: str, content: Column, first_bytes: int | None = None) -> DataFrame:
    """dup_path, source: rows whose content is that of an earlier path; with
    ``first_bytes`` (``HASHED_BYTES`` for files) only so much of it counts.  Hashes are summed map-side; only groups of two or more are joined back."""
    data = content.cast("binary")
    h = df.select(F.col(path).alias("p"), F.sha2(data if first_bytes is None else F.substring(data, 1, first_bytes), 256).alias("h"))
    groups = h.groupBy("h").agg(F.min("p").alias("source"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return h.join(groups, "h").filter("p <> source").select(F.col("p").alias("dup_path"), "source")


def by_title_and_author(df: DataFrame, path: str, title: Column, authors: Column) -> DataFrame:
    """dup_path, source: rows that share a title and any author with an earlier
    path, which is the first of all such."""
    e = df.select(F.col(path).alias("p"), title.alias("t"), F.explode(authors).alias("a")).filter("t <> '' AND a <> ''").distinct()
    first = F.min("p").over(Window.partitionBy("t", "a"))
    return e.withColumn("source", first).filter("p <> source").groupBy(F.col("p").alias("dup_path")).agg(F.min("source").alias("source"))


def merged_reasons(*found: tuple[str, DataFrame]) -> DataFrame:
    """dup_path, source, reasons of several findings."""
    parts = [d.select("dup_path", "source", F.lit(name).alias("reason")) for name, d in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dup_path").agg(F.min("source").alias("source"), F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"))


def new_to_catalogue(batch: DataFrame, catalogue: DataFrame, key: list[str], first: str) -> DataFrame:
    """Rows whose key the catalogue lacks, the first of each key."""
    fresh = batch.join(catalogue.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(first))).filter("__rn = 1").drop("__rn")


def similar_texts(df: DataFrame, block: list[str], path: str, text: str, least: float = 0.85) -> DataFrame:
    """a, b, ratio within blocks: equal texts by hash first, the rest by the
    matching-blocks ratio."""
    from ..functions.text import sequence_ratio

    left = df.select(*block, F.col(path).alias("a"), F.col(text).alias("ta"))
    right = df.select(*block, F.col(path).alias("b"), F.col(text).alias("tb"))
    pairs = left.join(right, block).filter("a < b")
    same = pairs.filter("ta = tb").select("a", "b", F.lit(1.0).alias("ratio"))
    rest = pairs.filter("ta <> tb").withColumn("ratio", sequence_ratio("ta", "tb")).filter(F.col("ratio") >= least).select("a", "b", "ratio")
    return same.unionByName(rest)
