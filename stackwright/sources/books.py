"""Book files as a table: scan, container, encoding, metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..vocabulary import NO_TITLE, UNKNOWN_AUTHOR

METADATA = "title string, authors string, series string, series_number string, genre string"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of every book below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{fb2,fb2.zip}").load(folder)


def count_books(spark: SparkSession, folder: str) -> int:
    """How many books lie below a folder; their contents aren't read."""
    return scan(spark, folder).select("path").count()


def has_books(spark: SparkSession, folder: str) -> bool:
    return not scan(spark, folder).select("path").limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written list of records; blanks are '', as in the list."""
    got = spark.read.option("header", True).csv(path)
    return got.fillna("")


def unzipped(raw: bytes) -> bytes:
    """The book in a zip container: its first book, else its first member.  What
    is none, or can't be read, stays as it is."""
    if raw[:2] != b"PK":
        return raw
    import io
    import zipfile
    import zlib

    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.namelist()
            return z.read(next((n for n in names if n.lower().endswith(".fb2")), names[0])) if names else raw
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError):
        return raw


def decoded(raw: bytes) -> str:
    """By mark, as UTF-8 if valid, by declaration, else the Cyrillic code page
    in which capitals most often precede small letters."""
    import re

    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    said = re.search(rb'encoding=["\']([\w-]+)', raw[:1024])
    names = ([said[1].decode()] if said and said[1].lower() not in (b"utf-8", b"utf8") else []) + ["cp1251", "koi8-r", "cp866"]

    def natural(text: str) -> int:
        pairs = list(zip(text[:4000], text[1:4001]))
        return sum((a.isupper() and b.islower()) - 2 * (a.islower() and b.isupper()) for a, b in pairs)

    texts = []
    for n in names:
        try:
            texts.append(raw.decode(n))
        except (LookupError, UnicodeDecodeError):
            continue
    return max(texts, key=natural) if texts else raw.decode("cp1251", "replace")


@F.pandas_udf(StringType())
def book_text(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else decoded(unzipped(raw)))


def _tag(text: Column, name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)<(?:fb:)?{name}\b[^>]*>(.*?)</(?:fb:)?{name}>", 1), r"\s+", " "))


def unescape_xml(c: Column) -> Column:
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def title_info(text: Column) -> Column:
    """title, authors, series, series_number, genre of a book's text."""
    info = F.regexp_extract(text, r"(?is)<(?:fb:)?title-info\b[^>]*>(.*?)</(?:fb:)?title-info>", 1)
    every = lambda name: F.regexp_extract_all(info, F.lit(rf"(?is)<(?:fb:)?{name}\b[^>]*>(.*?)</(?:fb:)?{name}>"), F.lit(1))
    name = lambda a: F.trim(F.regexp_replace(F.concat_ws(" ", _tag(a, "first-name"), _tag(a, "middle-name"), _tag(a, "last-name")), r"\s+", " "))
    authors = F.filter(F.transform(every("author"), name), lambda x: x != "")
    sequence = F.regexp_extract_all(info, F.lit(r"(?is)<(?:fb:)?sequence\b([^>]*)>"), F.lit(1))
    last = F.coalesce(F.try_element_at(sequence, F.lit(-1)), F.lit(""))
    attr = lambda c, n: F.trim(F.regexp_extract(c, rf"""(?is)\b{n}\s*=\s*["']([^"']*)["']""", 1))
    genres = F.array_distinct(F.filter(F.transform(every("genre"), lambda g: F.trim(g)), lambda g: g != ""))
    or_else = lambda c, d: F.when(c == "", d).otherwise(c)
    return F.struct(
        or_else(unescape_xml(_tag(info, "book-title")), NO_TITLE).alias("title"), or_else(unescape_xml(F.array_join(authors, "; ")), UNKNOWN_AUTHOR).alias("authors"),
        unescape_xml(attr(last, "name")).alias("series"), attr(last, "number").alias("series_number"), F.array_join(genres, ", ").alias("genre"),
    )


def integrity_issues(text: Column, size: Column) -> Column:
    """What is wrong with a book, as an array of names."""
    info = title_info(text)
    closed = F.regexp_count(text, F.lit(r"(?i)<(fb:)?title-info\b")) == F.regexp_count(text, F.lit(r"(?i)</(fb:)?title-info>"))
    return F.array_compact(F.array(
        F.when(size < 64, "too small"), F.when(text.isNull(), "undecodable"), F.when(~F.coalesce(text, F.lit("")).rlike(r"(?i)<(fb:)?title-info\b"), "no title-info"), F.when(~closed, "ill-formed"),
        F.when(info["title"] == NO_TITLE, "no title"), F.when(info["authors"] == UNKNOWN_AUTHOR, "no author"),
    ))


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """file_path (below the folder), metadata and hash of every book."""
    root = folder.rstrip("/").removeprefix("file://")
    rows = scan(spark, folder).withColumn("text", book_text("content"))
    return rows.select(F.regexp_replace("path", rf"^(file:)?/*{root.lstrip('/')}/", "").alias("file_path"), title_info(F.col("text")).alias("m"), F.sha2("content", 256).alias("file_hash"), "modificationTime").select("file_path", "m.*", "file_hash", "modificationTime")


def changed_since(scanned: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """The scanned files whose (path, time) the cache lacks for this parser."""
    return scanned.join(cache.filter(F.col("parser_version") == version).select("file_path", "modificationTime"), ["file_path", "modificationTime"], "left_anti")
