"""Queries over raw texts and pages, and the streaming extensions in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import BOOKS_SQL, books, table
from ..functions import text as T
from ..functions import volumes as V
from ..registry import query
from ..sources import sinks
from ..streaming.ingest import sessions, tumbling_counts


@query("page_metadata", r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a\s')) AS links FROM pages""")
def page_metadata(spark, sf_dir) -> DataFrame:
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("long").alias("links"))


@query("page_integrity", r"""
SELECT page_id, array_to_string(list_filter([CASE WHEN strlen(html) < 64 THEN 'too small' END, CASE WHEN NOT regexp_matches(html, '(?i)<title') THEN 'no title' END,
  CASE WHEN len(regexp_extract_all(html, '(?i)<p\b')) <> len(regexp_extract_all(html, '(?i)</p>')) THEN 'ill-formed' END], lambda x: x IS NOT NULL), ',') AS issues FROM pages""")
def page_integrity(spark, sf_dir) -> DataFrame:
    count = lambda p: F.regexp_count("html", F.lit(p))
    issues = F.array_compact(F.array(F.when(F.octet_length("html") < 64, "too small"), F.when(count("(?i)<title") == 0, "no title"), F.when(count(r"(?i)<p\b") != count("(?i)</p>"), "ill-formed")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(issues, ",").alias("issues"))


@query("page_tag_rewrite", r"""
SELECT page_id, md5(replace(regexp_replace(html, '(?is)\s*<h1\b[^>]*>.*?</h1>', '', 'g'), '</article>', '<h1>Title</h1></article>')) AS rewritten_md5 FROM pages""")
def page_tag_rewrite(spark, sf_dir) -> DataFrame:
    bare = F.regexp_replace("html", r"(?is)\s*<h1\b[^>]*>.*?</h1>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.replace(bare, F.lit("</article>"), F.lit("<h1>Title</h1></article>"))).alias("rewritten_md5"))


@query("conversation_compile", """
SELECT conv_id, CAST(count(*) AS INTEGER) AS n_bodies, md5(string_agg('<body>' || coalesce(text, '') || '</body>', '' ORDER BY turn, text)) AS compiled_md5 FROM conversations GROUP BY conv_id""")
def conversation_compile(spark, sf_dir) -> DataFrame:
    c = sinks.compiled_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return c.select("conv_id", "n_bodies", F.md5("compiled").alias("compiled_md5"))


@query("norm_keys", BOOKS_SQL + """
SELECT id, lower(title) AS title_key, list_aggregate(list_sort(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 3))), 'string_agg', ',') AS words FROM books""")
def norm_keys(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).select("id", T.title_key(F.col("title")).alias("title_key"), F.array_join(T.author_words(F.col("title")), ",").alias("words"))


@query("author_format", BOOKS_SQL + " SELECT id, split_part(title, ' ', 2) || ' ' || split_part(title, ' ', 1) AS author FROM books")
def author_format(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).select("id", T.format_authors(T.person_order(F.col("title"))).alias("author"))


@query("series_clean", BOOKS_SQL + " SELECT id, title AS base, series AS first_level FROM books")
def series_clean(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    return b.select("id", T.series_base(F.concat("title", F.lit(" "), "series_number")).alias("base"), T.clean_series(F.concat("series", F.lit(" 3. "), "title")).alias("first_level"))


@query("roman_volumes", "SELECT * FROM (VALUES ('I', 1), ('IV', 4), ('IX', 9), ('XIV', 14), ('XL', 40), ('MCMXCIV', 1994)) t(roman, n)")
def roman_volumes(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("I", "IV", "IX", "XIV", "XL", "MCMXCIV")], "roman string").select("roman", V.roman_to_int(F.col("roman")).alias("n"))


@query("sort_keys", BOOKS_SQL + " SELECT id, 0 AS level, CAST(series_number AS INTEGER) AS primary_key, 'series_number' AS source FROM books")
def sort_keys(spark, sf_dir) -> DataFrame:
    k = V.sort_key(F.col("series_number"), T.logical_stem(F.col("file_path")), F.col("title"))
    return books(spark, sf_dir).select("id", k["level"].alias("level"), k["primary"].alias("primary_key"), k["source"].alias("source"))


@query("event_tumbling", """
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_tumbling(spark, sf_dir) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("hour"), "event_type", "n")


@query("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir) -> DataFrame:
    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("session_window.start").alias("started"), "n")
