"""The catalogue of books and its adapter over the star-schema tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books: brand, type and name stand for author, series, title."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".fb2")).alias("file_path"),
        F.col("p_brand").alias("author"), F.col("p_type").alias("series"), F.col("p_name").alias("title"), F.col("p_size").cast("string").alias("series_number"),
        F.concat(F.lower("p_type"), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("genre"),
        F.when(F.col("p_partkey") % 3 == 0, "folder_dataset").when(F.col("p_partkey") % 3 == 1, "filename").otherwise("metadata").alias("author_source"),
    )


#: The same in SQL, as the first of a query's common table expressions.
BOOKS_SQL = """WITH books AS (
  SELECT p_partkey AS id, p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey || '.fb2' AS file_path, p_brand AS author, p_type AS series, p_name AS title,
         CAST(p_size AS VARCHAR) AS series_number, lower(p_type) || ', ' || split_part(p_name, ' ', 1) AS genre,
         CASE p_partkey % 3 WHEN 0 THEN 'folder_dataset' WHEN 1 THEN 'filename' ELSE 'metadata' END AS author_source
  FROM part)"""
