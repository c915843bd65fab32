"""The metadata cache, protected folders, tags and remote answers already fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_xml

RATING = "array<struct<work_id long, name string, author string, rating struct<rating double, voters long>>>"


def fresh_metadata(files: DataFrame, cache: DataFrame, parser: str) -> DataFrame:
    """The files (file_path, mtime, hash) with the cached metadata of the same
    path, time, content and parser; null where it must be read again."""
    same = cache.filter(F.col("parser") == parser).select("file_path", "mtime", "hash", "metadata")
    return files.join(same, ["file_path", "mtime", "hash"], "left")


def purged(cache: DataFrame, parser: str | None = None, before: float | None = None) -> DataFrame:
    """The cache without rows of another parser, and without those cached
    ``before`` a time."""
    if parser is not None:
        cache = cache.filter(F.col("parser") == parser)
    return cache if before is None else cache.filter(F.col("cached_at") >= before)


def cache_statistics(cache: DataFrame, now: float) -> DataFrame:
    """total, last_day: entries, and those of the last 24 hours."""
    return cache.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cached_at") > now - 86_400).alias("last_day"))


def unprotected(decisions: DataFrame, protected: list[str]) -> DataFrame:
    """Decisions on protected paths are skipped, with the reason."""
    hit = F.regexp_replace(F.translate("file_path", "\\", "/"), "/+$", "").isin([p.replace("\\", "/").rstrip("/") for p in protected])
    return decisions.withColumns({"action": F.when(hit, "skip").otherwise(F.col("action")), "reason": F.when(hit, "protected").otherwise(F.col("reason"))})


def folder_decisions(folders: DataFrame) -> DataFrame:
    """Decision rows for folders to remove."""
    return folders.select(F.col("folder").alias("file_path"), F.lit("remove").alias("action"), F.lit("no books below").alias("reason"), F.lit("").alias("target"))


def patched(text: Column, title: Column | None = None, series: Column | None = None, number: Column | None = None) -> Column:
    """A book's text with another title and series within its title-info; null
    leaves what there is.  The rest isn't touched."""
    info = F.regexp_extract(text, r"(?is)<(?:fb:)?title-info\b.*?</(?:fb:)?title-info>", 0)
    new = info
    safe = lambda c: F.regexp_replace(escape_xml(c), r"([\\$])", r"\\$1")  # noqa: E731  it is a replacement
    if title is not None:
        new = F.when(title.isNull(), new).otherwise(F.regexp_replace(new, F.lit(r"(?is)(<(?:fb:)?book-title\b[^>]*>).*?(</(?:fb:)?book-title>)"), F.concat(F.lit("$1"), safe(title), F.lit("$2"))))
    if series is not None:
        bare = F.regexp_replace(new, r"(?is)\s*<(?:fb:)?sequence\b[^>]*/?>(?:\s*</(?:fb:)?sequence>)?", "")
        n = F.lit("") if number is None else F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit(' number="'), escape_xml(number), F.lit('"'))).otherwise("")
        tag = F.when(series != "", F.concat(F.lit('<sequence name="'), escape_xml(series), F.lit('"'), n, F.lit("/>"))).otherwise("")
        end = F.regexp_extract(bare, r"(?i)</(?:fb:)?title-info>$", 0)
        new = F.when(series.isNull(), new).otherwise(F.concat(F.substr(bare, F.lit(1), F.char_length(bare) - F.char_length(end)), tag, end))
    return F.when(info == "", text).otherwise(F.replace(text, info, new))


def work_ratings(answer: Column) -> Column:
    """The works of a JSON answer of a rating service."""
    return F.from_json(answer, f"struct<works {RATING}>")["works"]


def vote_pages(html: Column) -> Column:
    """struct(link, title, rating, votes) of the rows of a page of votes."""
    row = r'(?is)<a\s+href="?([^">\s]+)"?[^>]*>(?:<b>)?([^<]+)(?:</b>)?</a>(?:[^<\d]|<[^aA][^>]*>)*(\d+(?:\.\d+)?)\*(\d+)'
    part = lambda i: F.regexp_extract_all(html, F.lit(row), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("link"), part(2).alias("title"), part(3).alias("rating"), part(4).alias("votes"))
    return F.transform(zipped, lambda x: F.struct(x["link"].alias("link"), F.trim(x["title"]).alias("title"), x["rating"].cast("double").alias("rating"), x["votes"].cast("long").alias("votes")))


def load_lists(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The lists of a JSON settings file, by name; anything else in it is left out."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    return {k: v for k, v in json.loads(text).items() if isinstance(v, list) and all(isinstance(x, str) for x in v)}


def register_functions(spark: SparkSession) -> list[str]:
    """The library's scalar functions under names that SQL can call, as
    temporary SQL functions; returns the names."""
    made = {
        "series_base": r"trim(regexp_replace(regexp_replace(s, '\\s+\\d+(?!\\.\\d)[\\s.]*$', ''), '[-–—]\\d+(?!\\.\\d)\\s*$', ''))",
        "name_key": "translate(lower(s), 'ё', 'е')",
        "book_slug": "substring(md5(s), 1, 12)",
        "file_stem": r"regexp_replace(element_at(split(s, '[/\\\\]'), -1), '(?i)\\.fb2(\\.zip)?$', '')",
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    return list(made)
