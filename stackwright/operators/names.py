"""Authors against lists of given names and tables of claims.

Lists are tables (word, gender); nothing assumes that they are small, so Spark
picks the join by their size.  Gender is ``m`` or ``f``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import ANTHOLOGY


def _words(author: Column) -> Column:
    return F.split(F.lower(F.trim(author)), r"\s+")


def author_rows(df: DataFrame, path: str, authors: str) -> DataFrame:
    """author, path: every author once, at its first path.  Anthologies have none."""
    rows = df.filter(F.col(authors) != ANTHOLOGY).select(F.col(path).alias("path"), F.explode(F.split(authors, "[,;]+")).alias("author"))
    return rows.select(F.trim("author").alias("author"), "path").filter("author <> ''").groupBy("author").agg(F.min("path").alias("path"))


def listed_words(authors: DataFrame, names: DataFrame) -> DataFrame:
    """author, pos, gender of the words of ``authors`` (author) that are listed."""
    words = authors.select("author", F.posexplode(_words(F.col("author"))).alias("pos", "word"))
    return words.join(names.select(F.lower("word").alias("word"), "gender").distinct(), "word").select("author", "pos", "gender")


def genders(authors: DataFrame, names: DataFrame) -> DataFrame:
    """author, gender of the first listed word, the male list before the
    female; null without one."""
    first = listed_words(authors, names).groupBy("author").agg(F.min_by("gender", F.struct("pos", (F.col("gender") != "m").alias("second"))).alias("gender"))
    return authors.select("author").join(first, "author", "left")


def unlisted_authors(df: DataFrame, path: str, authors: str, names: DataFrame) -> DataFrame:
    """author, path of those none of whose words is listed."""
    every = author_rows(df, path, authors)
    return every.join(listed_words(every, names), "author", "left_anti")


def only_female(df: DataFrame, key: str, authors: str, names: DataFrame) -> DataFrame:
    """The keys of rows all of whose authors have a female word and no male one."""
    rows = df.filter(F.col(authors) != "").select(key, F.explode(F.split(authors, "[,;]+")).alias("author")).select(key, F.trim("author").alias("author")).filter("author <> ''")
    kinds = listed_words(rows.select("author").distinct(), names).groupBy("author").agg(F.bool_or(F.col("gender") == "m").alias("m"), F.bool_or(F.col("gender") == "f").alias("f"))
    fits = F.coalesce(F.col("f") & ~F.col("m"), F.lit(False))
    return rows.join(kinds, "author", "left").groupBy(key).agg(F.bool_and(fits).alias("all_fit")).filter("all_fit").select(key)


def best_claims(authors: DataFrame, claims: DataFrame) -> DataFrame:
    """author, candidate, gender: the best of each author's ``claims`` (name,
    candidate, gender, is_writer, rank): writers first, then by rank."""
    order = F.struct((~F.col("is_writer")).alias("w"), F.col("rank"), F.col("candidate"))
    best = claims.groupBy("name").agg(F.min_by(F.struct("candidate", "gender"), order).alias("c"))
    return authors.select("author", F.lower(F.trim("author")).alias("name")).join(best, "name").select("author", "c.candidate", "c.gender")


def expand_surnames(df: DataFrame, author: str, full: DataFrame, first: str) -> DataFrame:
    """``X. Surname``, ``Surname X.`` and ``Surname`` become the first full
    name (``full``: author, first) of that surname with that initial."""
    a = F.trim(F.col(author))
    surname = F.lower(F.coalesce(F.nullif(F.regexp_extract(a, r"^(?:\p{L}\.\s*)?([\p{L}-]{2,})(?:\s+\p{L}\.?)?$", 1), F.lit("")), F.lit("")))
    initial = F.lower(F.coalesce(F.nullif(F.regexp_extract(a, r"(?:^|\s)(\p{L})\.?(?:\s|$)", 1), F.lit("")), F.nullif(F.regexp_extract(a, r"^(\p{L})\.", 1), F.lit("")), F.lit("")))
    words = F.split(F.trim(F.col("author")), r"\s+")
    known = full.filter(F.size(words) >= 2).select(F.lower(words[0]).alias("__s"), F.lower(F.substring(words[1], 1, 1)).alias("__i"), F.col("author").alias("__full"), F.col(first).alias("__at"))
    by_initial = known.groupBy("__s", "__i").agg(F.min_by("__full", F.struct("__at", "__full")).alias("__full"))
    by_name = known.groupBy("__s").agg(F.min_by("__full", F.struct("__at", "__full")).alias("__full")).select("__s", F.lit("").alias("__i"), "__full")
    rows = df.withColumns({"__s": surname, "__i": F.when(F.char_length(a) > 2, initial).otherwise("")})
    return rows.join(by_initial.unionByName(by_name), ["__s", "__i"], "left").withColumn(author, F.coalesce("__full", author)).drop("__s", "__i", "__full")
