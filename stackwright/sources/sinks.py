"""Sinks, and decision rows for what would change files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_xml, file_name_safe, slug

CSV_COLUMNS = ["file_path", "metadata_authors", "proposed_author", "author_source", "metadata_series", "proposed_series", "series_source", "series_number", "file_title", "metadata_genre"]


def write_csv(df: DataFrame, path: str) -> None:
    """Sorted by path into one file, which a reader of the whole list expects."""
    df.select(*CSV_COLUMNS).orderBy("file_path").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_new(batch: DataFrame, path: str) -> None:
    """Appends the rows whose file_path the stored catalogue lacks."""
    old = batch.sparkSession.read.parquet(path).select("file_path")
    batch.join(old, "file_path", "left_anti").write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key."""
    both = old.unionByName(new)
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).filter("__rn = 1").drop("__rn")


def orphans(catalogue: DataFrame, scanned: DataFrame) -> DataFrame:
    """Catalogue rows whose file is gone."""
    return catalogue.join(scanned.select("file_path"), "file_path", "left_anti")


def without(catalogue: DataFrame, gone: DataFrame) -> DataFrame:
    """Deletes by path, then by (author, series, title): two anti-joins."""
    out = catalogue.join(gone.select("file_path").distinct(), "file_path", "left_anti")
    return out.join(gone.select("author", "series", "title").distinct(), ["author", "series", "title"], "left_anti")


def target_path(genre: Column, author: Column, series: Column, name: Column) -> Column:
    parts = F.filter(F.array(genre, author, series), lambda x: x != "")
    return F.array_join(F.concat(F.transform(parts, file_name_safe), F.array(file_name_safe(name))), "/")


def target_name(title: Column, series: Column, number: Column) -> Column:
    """With a series and number: ``series N. title``."""
    return F.concat(file_name_safe(F.when((series != "") & (number != ""), F.concat(series, F.lit(" "), number, F.lit(". "), title)).otherwise(title)), F.lit(".fb2"))


def move_decisions(df: DataFrame, target: Column, existing: DataFrame) -> DataFrame:
    """file_path, action, reason, target; nothing is touched here."""
    t = df.select("file_path", target.alias("target")).join(existing.select(F.col("file_path").alias("target"), F.lit(True).alias("taken")).distinct(), "target", "left")
    unsafe = F.exists(F.split("target", "/"), lambda x: x == "..")
    return t.select("file_path", F.when(unsafe | F.col("taken"), "skip").otherwise("move").alias("action"), F.when(unsafe, "outside the library").when(F.col("taken"), "target exists").otherwise("").alias("reason"), "target")


def rewrite_genre(text: Column, genre: Column) -> Column:
    """Without any genre tags but the given one, at the end of title-info."""
    bare = F.regexp_replace(text, r"(?is)\s*<(fb:)?genre\b[^>]*>.*?</(fb:)?genre>", "")
    return F.replace(bare, F.lit("</title-info>"), F.concat(F.lit("<genre>"), escape_xml(genre), F.lit("</genre></title-info>")))


def feed_entries(df: DataFrame, entity: str) -> DataFrame:
    """slug, name, n_books, feed: an Atom feed for each author or series."""
    number = F.when(F.col("series_number").rlike(r"^\d+$"), F.col("series_number").cast("int")).otherwise(999)
    entry = F.struct(number.alias("n"), F.col("title"), F.col("id"))
    xml = lambda e: F.concat(F.lit("<entry><title>"), escape_xml(e["title"]), F.lit("</title><id>"), e["id"].cast("string"), F.lit("</id></entry>"))
    g = df.filter(F.col(entity) != "").groupBy(F.col(entity).alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    feed = F.concat(F.lit("<feed><title>"), escape_xml(F.col("name")), F.lit("</title>"), F.array_join(F.transform("e", xml), ""), F.lit("</feed>"))
    return g.select(slug(F.col("name")).alias("slug"), "name", F.size("e").alias("n_books"), feed.alias("feed"))


def compiled_text(df: DataFrame, group: list[str], order: list[str], body: str) -> DataFrame:
    """group, n_bodies, compiled: the bodies of a group in order."""
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, body))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: F.concat(F.lit("<body>"), F.coalesce(x[body], F.lit("")), F.lit("</body>"))), "")
    return g.select(*group, F.size("b").alias("n_bodies"), text.alias("compiled"))
