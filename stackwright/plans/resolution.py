"""Queries that resolve names: patterns, name lists, genres, compilations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import BOOKS_SQL, books, table
from ..functions import predicates as P
from ..functions import text as T
from ..operators import compilations, genres, names, patterns
from ..registry import query


@query("pattern_match", BOOKS_SQL + """,
w AS (SELECT id, split_part(title, ' ', 1) AS a, split_part(title, ' ', 2) AS b, series || ' ' || series_number AS s FROM books)
SELECT id, CASE WHEN b IN ('ring', 'widget') THEN 1.0 ELSE 27 / 33.0 END::DOUBLE AS best_score, CASE WHEN b IN ('ring', 'widget') THEN 'Author - Title (Series)' ELSE 'Title - Title (Author)' END AS best_pattern,
       CASE WHEN b IN ('ring', 'widget') THEN b END AS author, CASE WHEN b IN ('ring', 'widget') THEN s END AS series FROM w""")
def pattern_match(spark, sf_dir) -> DataFrame:
    word = lambda n: F.split_part("title", F.lit(" "), F.lit(n))
    stems = books(spark, sf_dir).select("id", F.concat(word(2), F.lit(" - "), word(1), F.lit(" ("), "series", F.lit(" "), "series_number", F.lit(")")).alias("stem"))
    return patterns.match_patterns(stems, "stem", known_names=["ring", "widget"]).drop("stem")


@query("pattern_groups", BOOKS_SQL + " SELECT id, author, title, series FROM books")
def pattern_groups(spark, sf_dir) -> DataFrame:
    stem = F.concat("author", F.lit(" - "), "title", F.lit(" ("), "series", F.lit(")"))
    return books(spark, sf_dir).select("id", patterns.extract_groups(stem, "Author - Title (Series)").alias("g")).select("id", "g.*")


_NAMES = [("cold", "m"), ("red", "m"), ("ring", "f"), ("gear", "f")]


def _names(spark) -> DataFrame:
    return spark.createDataFrame(_NAMES, "word string, gender string")


@query("unlisted_authors", BOOKS_SQL + """
SELECT title AS author, min(file_path) AS path FROM books WHERE split_part(title, ' ', 1) NOT IN ('cold', 'red') AND split_part(title, ' ', 2) NOT IN ('ring', 'gear') GROUP BY title""")
def unlisted_authors(spark, sf_dir) -> DataFrame:
    return names.unlisted_authors(books(spark, sf_dir), "file_path", "title", _names(spark))


@query("only_female_authors", BOOKS_SQL + " SELECT id FROM books WHERE split_part(title, ' ', 1) NOT IN ('cold', 'red') AND split_part(title, ' ', 2) IN ('ring', 'gear')")
def only_female_authors(spark, sf_dir) -> DataFrame:
    return names.only_female(books(spark, sf_dir), "id", "title", _names(spark))


@query("author_genders", BOOKS_SQL + """
SELECT DISTINCT title AS author, CASE WHEN split_part(title, ' ', 1) IN ('cold', 'red') THEN 'm' WHEN split_part(title, ' ', 2) IN ('ring', 'gear') THEN 'f' END AS gender FROM books""")
def author_genders(spark, sf_dir) -> DataFrame:
    return names.genders(books(spark, sf_dir).select(F.col("title").alias("author")).distinct(), _names(spark))


@query("author_claims", """
WITH c AS (SELECT lower(c_mktsegment) AS name, c_name AS candidate, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END, c_nationkey, c_name) AS rn FROM customer)
SELECT upper(name) AS author, candidate, CASE WHEN c_custkey % 2 = 0 THEN 'm' ELSE 'f' END AS gender FROM c WHERE rn = 1""")
def author_claims(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    claims = c.select(
        F.lower("c_mktsegment").alias("name"), F.col("c_name").alias("candidate"), F.when(F.col("c_custkey") % 2 == 0, "m").otherwise("f").alias("gender"),
        (F.col("c_custkey") % 5 == 0).alias("is_writer"), F.col("c_nationkey").alias("rank"))
    return names.best_claims(c.select(F.upper("c_mktsegment").alias("author")).distinct(), claims)


@query("genre_tree", """
SELECT r_name AS name, 0 AS depth, r_name AS path, r_name AS top FROM region
UNION ALL SELECT n_name, 1, r_name || '/' || n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def genre_tree(spark, sf_dir) -> DataFrame:
    return genres.walk(_tree(spark, sf_dir))


def _tree(spark, sf_dir) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    none = F.array().cast("array<string>")
    top = r.select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), none.alias("assigned"))
    return top.unionByName(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"), F.array(F.col("n_nationkey").cast("string")).alias("assigned")))


@query("main_genres", """
SELECT s_suppkey, n_name AS name, r_name AS top FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def main_genres(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("genre"))
    return genres.main_genres(s, "s_suppkey", "genre", _tree(spark, sf_dir))


@query("replaced_by_compilations", BOOKS_SQL + """,
v AS (SELECT author, series, file_path, CAST(series_number AS INTEGER) AS lo, CAST(series_number AS INTEGER) + CASE WHEN id % 10 = 0 THEN 4 ELSE 0 END AS hi, id % 10 = 0 AS many FROM books)
SELECT a.file_path FROM v a WHERE NOT many AND EXISTS (SELECT 1 FROM v b WHERE b.many AND a.author = b.author AND a.series = b.series AND a.lo BETWEEN b.lo AND b.hi)""")
def replaced_by_compilations(spark, sf_dir) -> DataFrame:
    n = F.col("series_number")
    b = books(spark, sf_dir).withColumn("series_number", F.when(F.col("id") % 10 == 0, F.concat(n, F.lit("-"), (n.cast("int") + 4).cast("string"))).otherwise(n))
    return compilations.replaced_by_compilations(b)


@query("outvoted_positions", BOOKS_SQL + """,
v AS (SELECT id, author, series, CAST(series_number AS INTEGER) AS n, id % 3 = 0 AS file FROM books),
g AS (SELECT author, series, count(*) FILTER (WHERE NOT file) > count(*) FILTER (WHERE file) AS turn FROM v GROUP BY author, series)
SELECT id, CASE WHEN file AND NOT turn THEN n + 1 ELSE n END AS position FROM v JOIN g USING (author, series)""")
def outvoted_positions(spark, sf_dir) -> DataFrame:
    n = F.col("series_number").cast("int")
    b = books(spark, sf_dir).withColumns({"position": F.when(F.col("id") % 3 == 0, n + 1).otherwise(n), "from": F.when(F.col("id") % 3 == 0, "filename").otherwise("series_number")})
    return compilations.outvoted_positions(b, ["author", "series"], "position", "from", "series_number").select("id", "position")


@query("name_tests", BOOKS_SQL + """
SELECT id, split_part(title, ' ', 1) = 'cold' OR split_part(title, ' ', 2) = 'ring' AS listed, true AS valid, false AS incomplete, true AS own_word FROM books""")
def name_tests(spark, sf_dir) -> DataFrame:
    t = F.col("title")
    return books(spark, sf_dir).select(
        "id", P.contains_word(t, ["Cold", "ring"]).alias("listed"), P.is_valid_author(t).alias("valid"), P.is_incomplete_name(t).alias("incomplete"),
        P.is_surname_of(F.split_part(t, F.lit(" "), F.lit(2)), t).alias("own_word"))


@query("opening_texts", BOOKS_SQL + " SELECT id, title || ' ' || series AS opening FROM books")
def opening_texts(spark, sf_dir) -> DataFrame:
    xml = F.concat(
        F.lit("<FictionBook><description/><body>\n<section><title><p>Preface</p></title><p>Thanks.</p></section><section><p>"), "title",
        F.lit("</p>\n<p>https://example.org/x</p><p>"), "series", F.lit("</p></section></body></FictionBook>"))
    return books(spark, sf_dir).select("id", T.opening_text(xml).alias("opening"))
