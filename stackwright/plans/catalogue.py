"""Queries over the catalogue, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import BOOKS_SQL, books, table
from ..functions.text import like_ascii, slug
from ..functions.volumes import leading_int, runs_text, strict_int
from ..operators import duplicates, paths, sequences, votes
from ..registry import query
from ..sources import sinks


@query("series_gaps", BOOKS_SQL + """,
g AS (SELECT author, series, count(*) AS books, list_sort(list_distinct(list(CAST(series_number AS INTEGER)))) AS h FROM books GROUP BY author, series HAVING count(*) >= 2),
m AS (SELECT *, list_filter(generate_series(h[1], h[-1]), lambda x: NOT list_contains(h, x)) AS miss FROM g)
SELECT author, series, books, array_to_string(h, ', ') AS have, array_to_string(miss, ', ') AS missing FROM m WHERE len(miss) > 0""")
def series_gaps(spark, sf_dir) -> DataFrame:
    return sequences.series_gaps(books(spark, sf_dir))


@query("catalog_summary", BOOKS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE series <> '') AS in_series, count(*) FILTER (WHERE author NOT IN ('', '[unknown]')) AS known_author,
       count(DISTINCT author) FILTER (WHERE author NOT IN ('', '[unknown]')) AS authors, count(DISTINCT series) FILTER (WHERE series <> '') AS series_count,
       coalesce(count(*) FILTER (WHERE series <> '') * 100.0 / nullif(count(*), 0), 0) AS series_percent FROM books""")
def catalog_summary(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("series") != "").alias("in_series"), F.count_if(~F.col("author").isin("", "[unknown]")).alias("known_author"),
        F.count_distinct(F.when(~F.col("author").isin("", "[unknown]"), F.col("author"))).alias("authors"), F.count_distinct(F.nullif("series", F.lit(""))).alias("series_count"),
        F.coalesce(F.try_divide(F.count_if(F.col("series") != "") * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)).alias("series_percent"),
    )


def _top(column: str):
    def run(spark, sf_dir) -> DataFrame:
        return books(spark, sf_dir).filter(F.col(column) != "").groupBy(column).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), column).limit(30)

    query(f"top_{column}", BOOKS_SQL + f" SELECT {column}, count(*) AS cnt FROM books WHERE {column} <> '' GROUP BY {column} ORDER BY cnt DESC, {column} LIMIT 30")(run)


_top("author")
_top("series")


@query("genre_distribution", BOOKS_SQL + """
SELECT g AS genre, count(*) AS cnt FROM (SELECT trim(unnest(string_split(genre, ','))) AS g FROM books) WHERE g <> '' GROUP BY g ORDER BY cnt DESC, g LIMIT 50""")
def genre_distribution(spark, sf_dir) -> DataFrame:
    g = books(spark, sf_dir).select(F.explode(F.split("genre", ",")).alias("g")).select(F.trim("g").alias("genre")).filter("genre <> ''")
    return g.groupBy("genre").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "genre").limit(50)


@query("genre_combinations", BOOKS_SQL + """
SELECT CASE WHEN trim(genre) = '' THEN 'Не определено' ELSE genre END AS genre, count(*) AS cnt, md5(string_agg(file_path, '|' ORDER BY file_path)) AS paths_md5 FROM books GROUP BY 1""")
def genre_combinations(spark, sf_dir) -> DataFrame:
    g = F.when(F.trim("genre") == "", "Не определено").otherwise(F.col("genre"))
    return books(spark, sf_dir).groupBy(g.alias("genre")).agg(F.count(F.lit(1)).alias("cnt"), F.md5(F.array_join(F.array_sort(F.collect_list("file_path")), "|")).alias("paths_md5"))


@query("source_distribution", "SELECT source, count(*) AS cnt FROM documents GROUP BY source")
def source_distribution(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("cnt"))


@query("author_source_summary", BOOKS_SQL + """
SELECT author_source, count(*) AS cnt, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM books GROUP BY author_source""")
def author_source_summary(spark, sf_dir) -> DataFrame:
    g = books(spark, sf_dir).groupBy("author_source").agg(F.count(F.lit(1)).alias("cnt"))
    return g.withColumn("share", F.col("cnt") * F.lit(100.0) / F.sum("cnt").over(Window.partitionBy()))


@query("search_like", BOOKS_SQL + """
SELECT id, author, series, series_number, title FROM books WHERE author ILIKE '%bRAND#_%' AND title ILIKE '%r%ng%'
ORDER BY author, series, CAST(NULLIF(series_number, '') AS INTEGER) NULLS FIRST, title, id LIMIT 2000""")
def search_like(spark, sf_dir) -> DataFrame:
    return search(books(spark, sf_dir), author="bRAND#_", title="r%ng")


def search(df: DataFrame, most: int = 2000, **patterns: str) -> DataFrame:
    """The rows whose columns hold the given texts (wildcards and all), in the
    order of a shelf, ``most`` of them."""
    for column, text in patterns.items():
        if text:
            df = df.filter(like_ascii(F.col(column), f"%{text}%"))
    return df.orderBy("author", "series", F.asc_nulls_first(leading_int(F.nullif("series_number", F.lit("")))), "title", "id").select("id", "author", "series", "series_number", "title").limit(most)


@query("any_column_filter", BOOKS_SQL + """
SELECT id, file_path FROM books WHERE contains(lower(concat_ws(' ', file_path, author, series, title, genre, author_source)), 'ring ')""")
def any_column_filter(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).filter(F.lower(F.concat_ws(" ", "file_path", "author", "series", "title", "genre", "author_source")).contains("ring ")).select("id", "file_path")


@query("new_since_cutoff", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC")
def new_since_cutoff(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"))


@query("page_of_books", BOOKS_SQL + " SELECT id, title FROM (SELECT id, title, row_number() OVER (ORDER BY title, id) AS rn FROM books) WHERE rn > 1000 AND rn <= 2000")
def page_of_books(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).select("id", "title").orderBy("title", "id").offset(1000).limit(1000)


@query("dup_by_hash", """
WITH h AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS source FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS dup_path, source FROM h WHERE doc_id <> source""")
def dup_by_hash(spark, sf_dir) -> DataFrame:
    return duplicates.by_content(table(spark, sf_dir, "documents").filter("text is not null"), "doc_id", F.col("text"))


@query("dup_by_title_author", BOOKS_SQL + """,
s AS (SELECT file_path, min(file_path) OVER (PARTITION BY lower(title), author) AS source FROM books)
SELECT file_path AS dup_path, source FROM s WHERE file_path <> source""")
def dup_by_title_author(spark, sf_dir) -> DataFrame:
    return duplicates.by_title_and_author(books(spark, sf_dir), "file_path", F.lower("title"), F.array("author"))


@query("dup_reasons_merged", BOOKS_SQL + """,
a AS (SELECT file_path, min(file_path) OVER (PARTITION BY lower(title), author) AS source, 'metadata' AS reason FROM books),
b AS (SELECT file_path, min(file_path) OVER (PARTITION BY title, series_number) AS source, 'content' AS reason FROM books),
u AS (SELECT * FROM a WHERE file_path <> source UNION ALL SELECT * FROM b WHERE file_path <> source)
SELECT file_path AS dup_path, min(source) AS source, string_agg(DISTINCT reason, '+' ORDER BY reason) AS reasons FROM u GROUP BY file_path""")
def dup_reasons_merged(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    return duplicates.merged_reasons(
        ("metadata", duplicates.by_title_and_author(b, "file_path", F.lower("title"), F.array("author"))),
        ("content", duplicates.by_content(b, "file_path", F.concat_ws("|", "title", "series_number"))),
    )


@query("catalog_anti_join", BOOKS_SQL + """,
k AS (SELECT DISTINCT author, series, title FROM books WHERE id % 2 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY author, series, title ORDER BY file_path) AS rn FROM books b
      WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.author = b.author AND k.series = b.series AND k.title = b.title))
SELECT id, author, series, title FROM f WHERE rn = 1""")
def catalog_anti_join(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    return duplicates.new_to_catalogue(b.filter("id % 2 = 1"), b.filter("id % 2 = 0"), ["author", "series", "title"], "file_path").select("id", "author", "series", "title")


@query("orphan_rows", "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def orphan_rows(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), "source")
    return sinks.orphans(d, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_path"))).select(F.col("file_path").alias("doc_id"), "source")


@query("delete_by_key_or_path", BOOKS_SQL + """,
g AS (SELECT * FROM books WHERE id % 50 = 0)
SELECT id FROM books b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.file_path = b.file_path OR (g.author = b.author AND g.series = b.series AND g.title = b.title))""")
def delete_by_key_or_path(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    return sinks.without(b, b.filter("id % 50 = 0")).select("id")


@query("upsert_latest", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def upsert_latest(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("v"))
    return sinks.upserted(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "v").drop("v")


@query("keep_first_title", BOOKS_SQL + " SELECT author, title, id FROM (SELECT *, row_number() OVER (PARTITION BY author, title ORDER BY CAST(series_number AS INTEGER) DESC, file_path) AS rn FROM books) WHERE rn = 1")
def keep_first_title(spark, sf_dir) -> DataFrame:
    return sequences.keep_first(books(spark, sf_dir), ["author", "title"], F.desc(strict_int(F.col("series_number"))), F.col("file_path")).select("author", "title", "id")


@query("keep_best_position", BOOKS_SQL + """,
f AS (SELECT *, count(*) OVER (PARTITION BY author, series, split_part(title, ' ', 1)) AS fit FROM books)
SELECT author, series, series_number, id, fit FROM (SELECT *, row_number() OVER (PARTITION BY author, series, series_number ORDER BY fit DESC, file_path) AS rn FROM f) WHERE rn = 1""")
def keep_best_position(spark, sf_dir) -> DataFrame:
    fit = F.count(F.lit(1)).over(Window.partitionBy("author", "series", F.split_part("title", F.lit(" "), F.lit(1))))
    return sequences.keep_first(books(spark, sf_dir).withColumn("fit", fit), ["author", "series", "series_number"], F.desc("fit"), F.col("file_path")).select("author", "series", "series_number", "id", "fit")


@query("consecutive_runs", BOOKS_SQL + """,
v AS (SELECT DISTINCT author, series, CAST(series_number AS INTEGER) AS lo, CAST(series_number AS INTEGER) + CASE WHEN CAST(series_number AS INTEGER) % 5 = 0 THEN 3 ELSE 0 END AS hi FROM books),
t AS (SELECT *, max(hi) OVER (PARTITION BY author, series ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v),
n AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY author, series ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM t)
SELECT author, series, CAST(run AS BIGINT) AS run, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM n GROUP BY author, series, run""")
def consecutive_runs(spark, sf_dir) -> DataFrame:
    n = strict_int(F.col("series_number"))
    v = books(spark, sf_dir).select("author", "series", n.alias("lo"), (n + F.when(n % 5 == 0, 3).otherwise(0)).alias("hi")).distinct()
    return sequences.runs(v, ["author", "series"], "lo", "hi").withColumn("run", F.col("run").cast("long"))


@query("volume_range", BOOKS_SQL + """,
g AS (SELECT author, series, title, min(CAST(series_number AS INTEGER)) AS lo, max(CAST(series_number AS INTEGER)) AS hi, count(DISTINCT series_number) AS n FROM books GROUP BY author, series, title)
SELECT author, series, title, CASE WHEN n <> hi - lo + 1 THEN '' WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END AS volumes FROM g""")
def volume_range(spark, sf_dir) -> DataFrame:
    g = books(spark, sf_dir).groupBy("author", "series", "title").agg(F.collect_set(strict_int(F.col("series_number"))).alias("v"))
    return g.select("author", "series", "title", runs_text(F.col("v")).alias("volumes"))


@query("compilation_cover", BOOKS_SQL + """,
r AS (SELECT author, series, file_path, CAST(series_number AS INTEGER) AS lo, CAST(series_number AS INTEGER) + CAST(id % 4 AS INTEGER) AS hi FROM books),
c AS (SELECT a.author, a.series, a.file_path, b.file_path AS keeper, row_number() OVER (PARTITION BY a.author, a.series, a.file_path ORDER BY b.hi - b.lo DESC, b.file_path DESC) AS rn
      FROM r a JOIN r b ON a.author = b.author AND a.series = b.series AND b.lo <= a.lo AND b.hi >= a.hi AND (b.hi - b.lo > a.hi - a.lo OR (b.hi - b.lo = a.hi - a.lo AND b.file_path < a.file_path)))
SELECT author, series, file_path, keeper FROM c WHERE rn = 1""")
def compilation_cover(spark, sf_dir) -> DataFrame:
    n = strict_int(F.col("series_number"))
    r = books(spark, sf_dir).select("author", "series", "file_path", n.alias("lo"), (n + (F.col("id") % 4).cast("int")).alias("hi"))
    return sequences.covered(r, ["author", "series"], "lo", "hi", "file_path")


@query("run_statistics", BOOKS_SQL + """,
e AS (SELECT author, series, unnest(generate_series(CAST(series_number AS INTEGER), CAST(series_number AS INTEGER) + CAST(id % 4 AS INTEGER))) AS v FROM books)
SELECT author, series, CAST(min(v) AS INTEGER) AS lo, CAST(max(v) AS INTEGER) AS hi, count(DISTINCT v) AS n_volumes FROM e GROUP BY author, series""")
def run_statistics(spark, sf_dir) -> DataFrame:
    n = strict_int(F.col("series_number"))
    r = books(spark, sf_dir).select("author", "series", n.alias("lo"), (n + (F.col("id") % 4).cast("int")).alias("hi"))
    return sequences.run_statistics(r, ["author", "series"], "lo", "hi")


_VOTES = """
n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM documents WHERE lang <> '' GROUP BY source, lang),
v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen, lang) AS rn, sum(n) OVER (PARTITION BY source) AS voters, count(*) OVER (PARTITION BY source) AS n_values FROM n)
"""


@query("folder_majority", "WITH" + _VOTES + "SELECT source, lang AS winner, n AS votes, CAST(voters AS BIGINT) AS voters, n_values FROM v WHERE rn = 1 AND n >= 0.6 * voters")
def folder_majority(spark, sf_dir) -> DataFrame:
    return votes.majority(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", 0.6)


@query("author_consensus", "WITH" + _VOTES + """
SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 2 THEN v.lang ELSE d.lang END AS lang, CASE WHEN d.doc_id % 3 = 2 AND v.lang <> d.lang THEN 'consensus' ELSE 'own' END AS lang_source
FROM documents d LEFT JOIN v ON v.source = d.source AND v.rn = 1""")
def author_consensus(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit("own").alias("lang_source"))
    won = votes.vote(d, ["source"], "lang", "doc_id")
    return votes.apply_vote(d, won, ["source"], "lang", "lang_source", F.col("doc_id") % 3 == 2, "consensus").select("doc_id", "lang", "lang_source")


@query("donor_propagation", "SELECT source, arg_min(lang, doc_id) AS donor FROM documents WHERE doc_id % 4 = 1 AND lang <> '' GROUP BY source")
def donor_propagation(spark, sf_dir) -> DataFrame:
    return votes.first_donor(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", F.col("doc_id") % 4 == 1)


@query("singleton_cleanup", BOOKS_SQL + """
SELECT id, CASE WHEN count(*) OVER (PARTITION BY author, series, title) = 1 AND id % 2 = 0 THEN '' ELSE title END AS title FROM books""")
def singleton_cleanup(spark, sf_dir) -> DataFrame:
    return votes.clear_singletons(books(spark, sf_dir).withColumn("key", F.col("title")), ["author", "series", "key"], "title", F.col("id") % 2 == 1).select("id", "title")


@query("multi_author_cleanup", BOOKS_SQL + """,
f AS (SELECT id, title || ' ' || lower(series) AS folder, author, series FROM books),
m AS (SELECT folder, count(DISTINCT author) AS n FROM f GROUP BY folder)
SELECT id, CASE WHEN n > 1 AND series <> '' AND contains(lower(f.folder), lower(series)) THEN '' ELSE series END AS series FROM f JOIN m USING (folder)""")
def multi_author_cleanup(spark, sf_dir) -> DataFrame:
    f = books(spark, sf_dir).withColumn("folder", F.concat("title", F.lit(" "), F.lower("series")))
    return votes.clear_multi_author_folders(f, "folder", "author", "series", ["Сборник", "Соавторство"]).select("id", "series")


@query("subset_author_vote", BOOKS_SQL + """,
b AS (SELECT id, series, CASE WHEN id % 5 = 0 THEN split_part(title, ' ', 1) ELSE title END AS name FROM books),
n AS (SELECT series, name, count(*) AS n, min(id) AS seen FROM b GROUP BY series, name),
w AS (SELECT series, name AS winner FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, seen, name) AS rn FROM n) WHERE rn = 1)
SELECT id, CASE WHEN len(list_filter(string_split(lower(name), ' '), lambda x: NOT list_contains(string_split(lower(winner), ' '), x))) = 0
                 AND len(string_split(winner, ' ')) > len(string_split(name, ' ')) THEN winner ELSE name END AS name FROM b JOIN w USING (series)""")
def subset_author_vote(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir).select("id", "series", F.when(F.col("id") % 5 == 0, F.split_part("title", F.lit(" "), F.lit(1))).otherwise(F.col("title")).alias("name"))
    return votes.widen_by_subset(b, votes.vote(b, ["series"], "name", "id"), ["series"], "name").select("id", "name")


@query("suffix_correction", BOOKS_SQL + """,
v AS (SELECT DISTINCT author, title AS name FROM books UNION SELECT DISTINCT author, split_part(title, ' ', 2) FROM books),
o AS (SELECT a.author, a.name, b.name AS longest, row_number() OVER (PARTITION BY a.author, a.name ORDER BY length(b.name) DESC, b.name DESC) AS rn
      FROM v a JOIN v b ON a.author = b.author AND a.name <> '' AND ends_with(b.name, a.name))
SELECT author, name, longest FROM o WHERE rn = 1""")
def suffix_correction(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    both = b.select("author", F.col("title").alias("name")).union(b.select("author", F.split_part("title", F.lit(" "), F.lit(2))))
    return votes.longest_with_suffix(both, ["author"], "name")


@query("phrase_confirmation", BOOKS_SQL + """,
p AS (SELECT author, title AS phrase FROM books UNION ALL SELECT author, title || ' ' || lower(series) FROM books),
n AS (SELECT author, phrase, count(*) AS n FROM p GROUP BY author, phrase HAVING count(*) >= 2),
c AS (SELECT n.*, row_number() OVER (PARTITION BY n.author ORDER BY length(n.phrase) DESC, n.phrase DESC) AS rn FROM n JOIN (SELECT DISTINCT author, title FROM books) b ON b.author = n.author AND b.title = n.phrase)
SELECT author, phrase, n FROM c WHERE rn = 1""")
def phrase_confirmation(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir).withColumn("stem", F.concat("title", F.lit(" "), F.lower("series")))
    return votes.confirmed_phrases(b, ["author"], "stem", "title")


@query("hierarchy_unification", BOOKS_SQL + """,
s AS (SELECT id, author, CASE WHEN id % 2 = 0 THEN series ELSE series || '. ' || title END AS series FROM books)
SELECT id, CASE WHEN contains(series, '. ') AND EXISTS (SELECT 1 FROM s t WHERE t.author = s.author AND t.series = split_part(s.series, '. ', 1))
  THEN split_part(series, '. ', 1) || '\\' || split_part(series, '. ', 2) ELSE series END AS series FROM s""")
def hierarchy_unification(spark, sf_dir) -> DataFrame:
    s = books(spark, sf_dir).select("id", "author", F.when(F.col("id") % 2 == 0, F.col("series")).otherwise(F.concat("series", F.lit(". "), "title")).alias("series"))
    return votes.unify_hierarchy(s, "author", "series").select("id", "series")


@query("ancestor_lookup", BOOKS_SQL + """,
f AS (SELECT DISTINCT author || '/' || series AS folder, 'A of ' || series AS author FROM books WHERE id % 7 = 0),
g AS (SELECT folder, min(author) AS author FROM f GROUP BY folder)
SELECT b.file_path, g.author FROM books b JOIN g ON g.folder = b.author || '/' || b.series""")
def ancestor_lookup(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    folders = b.filter("id % 7 = 0").select(F.concat("author", F.lit("/"), "series").alias("folder"), F.concat(F.lit("A of "), "series").alias("author")).distinct()
    return paths.nearest_to_root(b.select("file_path"), folders, "file_path", 3)


@query("folder_tree", BOOKS_SQL + """
SELECT folder, depth, count(*) AS n_files FROM (SELECT author AS folder, 0 AS depth FROM books UNION ALL SELECT author || '/' || series, 1 FROM books) GROUP BY folder, depth""")
def folder_tree(spark, sf_dir) -> DataFrame:
    return paths.folder_tree(books(spark, sf_dir), "file_path")


@query("series_from_path", BOOKS_SQL + " SELECT id, series FROM books")
def series_from_path(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir).withColumn("folder", F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/"))
    return b.select("id", paths.series_below_author(F.col("folder"), F.col("author")).alias("series"))


@query("slugs", BOOKS_SQL + " SELECT DISTINCT author, substr(md5(author), 1, 12) AS slug FROM books")
def slugs(spark, sf_dir) -> DataFrame:
    return books(spark, sf_dir).select("author", slug(F.col("author")).alias("slug")).distinct()


@query("feed_entries", BOOKS_SQL + """
SELECT substr(md5(series), 1, 12) AS slug, series AS name, CAST(count(*) AS INTEGER) AS n_books,
  '<feed><title>' || series || '</title>' || string_agg('<entry><title>' || title || '</title><id>' || id || '</id></entry>', '' ORDER BY CAST(series_number AS INTEGER), title, id) || '</feed>' AS feed FROM books GROUP BY series""")
def feed_entries(spark, sf_dir) -> DataFrame:
    return sinks.feed_entries(books(spark, sf_dir), "series")


@query("move_decisions", BOOKS_SQL + """,
t AS (SELECT file_path, series || '/' || author || '/' || title || '.fb2' AS target FROM books)
SELECT file_path, 'move' AS action, '' AS reason, target FROM t""")
def move_decisions(spark, sf_dir) -> DataFrame:
    b = books(spark, sf_dir)
    target = sinks.target_path(F.col("series"), F.col("author"), F.lit(""), sinks.target_name(F.col("title"), F.lit(""), F.lit("")))
    return sinks.move_decisions(b, target, b.select("file_path"))


@query("scan_summary", BOOKS_SQL + """,
g AS (SELECT author, series, count(*) AS files, sum(length(file_path)) AS bytes, max(length(file_path)) AS kept FROM books GROUP BY author, series HAVING count(*) > 1)
SELECT count(*) AS n_groups, CAST(sum(files) AS BIGINT) AS files_before, count(*) AS files_after, CAST(sum(bytes - kept) AS BIGINT) AS bytes_freed FROM g""")
def scan_summary(spark, sf_dir) -> DataFrame:
    size = F.char_length("file_path")
    g = books(spark, sf_dir).groupBy("author", "series").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("kept")).filter("files > 1")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("files").alias("files_before"), F.count(F.lit(1)).alias("files_after"), F.sum(F.col("bytes") - F.col("kept")).alias("bytes_freed"))
