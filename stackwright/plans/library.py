"""Queries of whole passes: over a library made from the star-schema tables,
and on fixed cases with known results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import people as N
from ..functions import series as S
from ..operators import authors, consensus, groups, sequences, series
from ..operators import paths as P
from ..registry import query
from ..sources import maintenance

SURNAMES = ["Сомов", "Ершов", "Карпов", "Щукин", "Окунев"]
GIVEN = ["Антон", "Борис", "Виктор", "Глеб", "Денис"]
TITLES = ["Дорога", "Тишина", "Маяк", "Ветер", "Озеро"]
CYCLES = ["Заря", "Полдень", "Закат", "Ночь"]
LISTED = [g.lower() for g in GIVEN]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Parts as files: the brand's number chooses the author, the key the kind of name: with author, with a surname, without, a collection, in an author's folder.
LIBRARY_SQL = f"""WITH files AS (
  SELECT p_partkey AS k, p_partkey % 5 AS kind, {_list(SURNAMES)}[(CAST(substr(p_brand, 7) AS INT) - 1) % 5 + 1] AS s, {_list(GIVEN)}[(CAST(substr(p_brand, 7) AS INT) - 1) // 5 % 5 + 1] AS g,
         {_list(TITLES)}[p_partkey % 5 + 1] AS title, {_list(CYCLES)}[p_size % 4 + 1] || ' ' || p_size AS cycle FROM part),
library AS (
  SELECT *, CASE kind WHEN 0 THEN 'Разное/' || k || '/' || s || ' ' || g || ' - ' || title || ' (' || cycle || ').fb2'
                      WHEN 1 THEN 'Разное/' || k || '/' || s || ' - ' || title || ' (' || cycle || ').fb2'
                      WHEN 2 THEN 'Разное/' || k || '/' || title || '.fb2'
                      WHEN 3 THEN 'Разное/' || k || '/' || title || '. Сборник.fb2'
                      ELSE 'Авторы/' || s || ' ' || g || '/' || title || ' ' || k || '.fb2' END AS file_path FROM files)"""


def library(spark, sf_dir) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.substr("p_brand", F.lit(7)).cast("int") - 1
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))
    p = p.select(
        F.col("p_partkey").cast("string").alias("k"), (F.col("p_partkey") % 5).alias("kind"), pick(SURNAMES, n % 5).alias("s"), pick(GIVEN, F.floor(n / 5) % 5).alias("g"),
        pick(TITLES, F.col("p_partkey") % 5).alias("title"),
        F.concat_ws(" ", pick(CYCLES, F.col("p_size") % 4), F.col("p_size").cast("string")).alias("cycle"))
    kind, name = F.col("kind"), F.concat_ws(" ", "s", "g")
    path = (
        F.when(kind == 0, F.format_string("Разное/%s/%s - %s (%s).fb2", "k", name, "title", "cycle")).when(kind == 1, F.format_string("Разное/%s/%s - %s (%s).fb2", "k", "s", "title", "cycle"))
        .when(kind == 2, F.format_string("Разное/%s/%s.fb2", "k", "title")).when(kind == 3, F.format_string("Разное/%s/%s. Сборник.fb2", "k", "title"))
        .otherwise(F.format_string("Авторы/%s/%s %s.fb2", name, "title", "k"))
    )
    meta = F.when(kind.isin(1, 2), F.concat_ws(" ", "g", "s")).when(kind == 3, "Антон Сомов; Борис Ершов; Виктор Карпов").otherwise("")
    return p.select(
        path.alias("file_path"), F.col("title").alias("file_title"), meta.alias("metadata_authors"), F.when(kind == 4, name).otherwise("").alias("proposed_author"),
        F.when(kind == 4, "folder_dataset").otherwise("").alias("author_source"), F.col("cycle").alias("proposed_series"))


@query("author_resolution", LIBRARY_SQL + """
SELECT file_path, CASE kind WHEN 3 THEN 'Сборник' ELSE s || ' ' || g END AS proposed_author,
       CASE kind WHEN 2 THEN 'metadata' WHEN 3 THEN 'collection' WHEN 4 THEN 'folder_dataset' ELSE 'filename' END AS author_source,
       CASE kind WHEN 3 THEN '' ELSE cycle END AS proposed_series FROM library""")
def author_resolution(spark, sf_dir) -> DataFrame:
    return authors.author_pass(library(spark, sf_dir), LISTED).select("file_path", "proposed_author", "author_source", "proposed_series")


@query("folder_authors", LIBRARY_SQL + " SELECT DISTINCT 'Авторы/' || s || ' ' || g AS folder, s || ' ' || g AS author, 'high' AS confidence FROM library WHERE kind = 4")
def folder_authors(spark, sf_dir) -> DataFrame:
    return authors.folder_authors(library(spark, sf_dir).select("file_path"), LISTED)


def _values(rows: list[tuple], columns: str) -> str:
    said = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") AS t({columns})"


PEOPLE = [
    ("Иван Петров", "Петров Иван"), ("Живой А.Я.", "Живой А.Я."), ("Гоблин (MeXXanik)", "Гоблин (MeXXanik)"), ("Аликс де л'Эн", "де л'Эн Аликс"), ("Александр Сергеевич Пушкин", "Пушкин Александр Сергеевич"),
    ("Линдквист Йон Айвиде", "Линдквист Йон Айвиде"), ("К. Роберт Каргилл", "Каргилл К. Роберт"), ("Коллектив авторов", "Сборник"), ("123", ""), ("Демченко", "Демченко"),
]
FOLDERS = [
    ("Волков Тим", "Волков Тим"), ("Живовы Георгий и Геннадий", "Живов Георгий; Живов Геннадий"), ("МВП-2 (1) Одиссея (Чернов)", "Чернов"), ("Защита Периметра (Абенд Эдвард)", "Абенд Эдвард"),
    ("Максим Шаттам - Собрание сочинений", "Максим Шаттам"), ("Иван Петров, Сергей Иванов", "Иван Петров; Сергей Иванов"), ("(Боевой отряд) Петров И.", "Петров И."), ("Демонолог", ""),
]


@query("person_names", _values(PEOPLE, "name, normal"))
def person_names(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([(n,) for n, _ in PEOPLE], "name string")
    return df.select("name", N.normal_name(F.col("name"), ["иван", "александр"]).alias("normal"))


@query("folder_names", _values(FOLDERS, "folder, author"))
def folder_names(spark, sf_dir) -> DataFrame:
    df = spark.createDataFrame([(n,) for n, _ in FOLDERS], "folder string")
    return df.select("folder", N.folder_author(F.col("folder"), ["эдвард"]).alias("author"))


#: path, author, its source, series, its source, the metadata's series, the candidate.
SHELF = [
    ("а/Иванов - Ёж 1.fb2", "Иванов", "filename", "Ёж", "filename", "", "Ёж 1"), ("а/Иванов - Ёж 2.fb2", "Иванов", "filename", "Ёж", "filename", "", "Ёж 2"), ("а/Ёж.fb2", "[unknown]", "", "", "", "", ""),
    ("б/x.fb2", "", "", "", "", "Шерлок Холмс. Свободные продолжения", ""), ("в/Осень.fb2", "Лим", "filename", "Осень", "filename", "", "Осень"),
    ("г/1.fb2", "Мак", "metadata", "Сад", "folder_dataset", "", ""), ("г/2.fb2", "Мак", "metadata", "Сад. Дальний берег", "folder_dataset", "", ""), ("г/3.fb2", "", "", "", "", "", ""),
]
SETTLED = [
    ("а/Иванов - Ёж 1.fb2", "Иванов", "Еж", "filename"), ("а/Иванов - Ёж 2.fb2", "Иванов", "Еж", "filename"), ("а/Ёж.fb2", "Иванов", "Еж", "author-consensus"),
    ("б/x.fb2", "", "Шерлок Холмс. Свободные продолжения", "metadata"), ("в/Осень.fb2", "Лим", "", ""),
    ("г/1.fb2", "Мак", "Сад", "folder_dataset"), ("г/2.fb2", "Мак", "Сад\\Дальний берег", "folder_dataset"), ("г/3.fb2", "Мак", "Сад", "folder_dataset"),
]


@query("consensus", _values(SETTLED, "file_path, proposed_author, proposed_series, series_source"))
def consensus_pass(spark, sf_dir) -> DataFrame:
    columns = "file_path string, proposed_author string, author_source string, proposed_series string, series_source string, metadata_series string, extracted_series_candidate string"
    return consensus.consensus(spark.createDataFrame(SHELF, columns)).select("file_path", "proposed_author", "proposed_series", "series_source")


#: Parts as records: the brand is the folder, the name the author.
_RECORDS_SQL = """WITH r AS (
  SELECT p_brand || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS file_path, p_brand AS folder, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END AS author,
         CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'filename' ELSE 'metadata' END AS source, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE '' END AS series,
         CASE WHEN p_partkey % 4 = 0 THEN 'folder_dataset' ELSE '' END AS series_source FROM part)"""


def _records(spark, sf_dir) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return authors.records(p.select(
        F.concat("p_brand", F.lit("/"), F.lpad(k.cast("string"), 9, "0")).alias("file_path"), F.when(k % 7 == 0, "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("proposed_author"),
        F.when(k % 7 == 0, "").when(k % 3 == 0, "filename").otherwise("metadata").alias("author_source"), F.when(k % 4 == 0, F.col("p_type")).otherwise("").alias("proposed_series"),
        F.when(k % 4 == 0, "folder_dataset").otherwise("").alias("series_source")))


@query("folder_author_consensus", _RECORDS_SQL + """,
s AS (SELECT folder, bool_or(source = 'filename') AS strong FROM r GROUP BY folder),
v AS (SELECT folder, author, strong, count(*) AS n, min(file_path) AS seen FROM r JOIN s USING (folder) WHERE author <> '' AND (source = 'filename' OR NOT strong) GROUP BY ALL),
b AS (SELECT folder, strong, author AS best FROM v QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, seen) = 1)
SELECT file_path, CASE WHEN hit THEN best ELSE author END AS proposed_author, CASE WHEN hit THEN 'consensus' ELSE source END AS author_source
FROM (SELECT *, coalesce(best IS NOT NULL AND source <> 'filename' AND author <> best AND (strong OR author = ''), false) AS hit FROM r LEFT JOIN b USING (folder))""")
def folder_author_consensus(spark, sf_dir) -> DataFrame:
    return consensus.folder_author_consensus(_records(spark, sf_dir)).select("file_path", "proposed_author", "author_source")


@query("folder_series_donors", _RECORDS_SQL + """,
d AS (SELECT folder, arg_min(series, file_path) AS donor FROM r WHERE series <> '' GROUP BY folder)
SELECT file_path, CASE WHEN series = '' THEN coalesce(donor, '') ELSE series END AS proposed_series, CASE WHEN series = '' AND donor IS NULL THEN '' ELSE 'folder_dataset' END AS series_source
FROM r LEFT JOIN d USING (folder)""")
def folder_series_donors(spark, sf_dir) -> DataFrame:
    return consensus.folder_series_donors(_records(spark, sf_dir)).select("file_path", "proposed_series", "series_source")


@query("series_author_consensus", """WITH r AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS file_path, p_type AS series, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS author FROM part),
v AS (SELECT series, author, count(*) AS n, min(file_path) AS seen FROM r GROUP BY ALL),
b AS (SELECT series, author AS best FROM v QUALIFY row_number() OVER (PARTITION BY series ORDER BY n DESC, seen) = 1),
c AS (SELECT series FROM r GROUP BY series HAVING count(*) >= 2)
SELECT file_path, CASE WHEN hit THEN best ELSE author END AS proposed_author, CASE WHEN hit THEN 'metadata+series-consensus' ELSE 'metadata' END AS author_source
FROM (SELECT *, coalesce(contains(best, ' ') AND NOT contains(author, ' ') AND list_contains(string_split(best, ' '), author), false) AS hit FROM r LEFT JOIN (SELECT * FROM b JOIN c USING (series)) USING (series))""")
def series_author_consensus(spark, sf_dir) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    author = F.when(k % 5 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.col("p_name"))
    rows = authors.records(p.select(F.lpad(k.cast("string"), 9, "0").alias("file_path"), author.alias("proposed_author"), F.lit("metadata").alias("author_source"), F.col("p_type").alias("proposed_series")))
    return consensus.series_author_consensus(rows).select("file_path", "proposed_author", "author_source")


@query("series_resolution", LIBRARY_SQL + """
SELECT file_path, CASE WHEN kind <= 1 THEN split_part(cycle, ' ', 1) WHEN kind = 2 THEN split_part(cycle, ' ', 1) ELSE '' END AS proposed_series,
       CASE WHEN kind <= 1 THEN 'filename' WHEN kind = 2 THEN 'metadata' ELSE '' END AS series_source FROM library WHERE kind <= 2""")
def series_resolution(spark, sf_dir) -> DataFrame:
    """Files with their series in brackets, and files whose metadata name it."""
    rows = library(spark, sf_dir).filter("author_source = '' AND metadata_authors NOT LIKE '%;%'")
    bare = rows.withColumns({"metadata_series": F.when(F.col("file_path").contains("("), "").otherwise(F.col("proposed_series")), "proposed_series": F.lit("")})
    return series.normalise_series(series.series_from_file_names(authors.records(bare), LISTED)).select("file_path", "proposed_series", "series_source")


LEVELS = [
    ("Сид 1. Принцип талиона 1. Геката 1", "Сид\\Принцип талиона\\Геката"), ("Дракон 1-3", "Дракон"), ("Мир Вечного 2. Вечный. Тетралогия", "Мир Вечного\\Вечный"), ("О. Р. З.", ""),
]
CLEAN = [("Солдат удачи 3. Взор Тьмы", "Солдат удачи"), ("«СССР-2023» 2", "СССР-2023"), ("Странник (Серия 3)", "Странник"), ("Цивилизация 2.0", "Цивилизация 2.0"), ("Сага №5", "Сага")]
NORMAL = [
    ("Тёмный  век", "Темный век"), ("Байши Сюсянь: Песнь", "Песнь"), ("Пастух[Кросс]", "Пастух"), ("Дракон (Трофимов)", "Дракон"), ("Отряд «Сигма» 07+", "Отряд «Сигма»"), ("Война 1941", "Война 1941"),
    ("Цикл «Солдат удачи»", "Солдат удачи"), ("Пророчество (т", "Пророчество"), ("Война (1-3)", "Война"),
]
TOLD = [
    ("[Метро] Туннель", "Метро"), ("Курилкин. Охотник 1", "Охотник"), ("Яманов. Бесноватый Цесаревич I", "Бесноватый Цесаревич"), ("Атаманов Михаил - Задача выжить 1", "Задача выжить"),
    ("Тидхар Леви - Центральная станция 2. Неом", "Центральная станция"), ("Земляной Андрей - Отморозки. Другим путем", "Отморозки"), ("Белоус", ""),
]
VALID = [("Солдат удачи", "true"), ("Детектив Джейкоб Лев", "true"), ("Том Риддл", "true"), ("Литературная премия «Буква – 2019»", "false"), (".45", "false"), ("том 1", "false"), ("Сборник рассказов", "false"), ("фантастика", "false")]


def _golden(name: str, rows: list[tuple[str, str]], function) -> None:
    def run(spark, sf_dir) -> DataFrame:
        return spark.createDataFrame([(a,) for a, _ in rows], "said string").select("said", function(F.col("said")).cast("string").alias("result"))

    query(name, _values(rows, "said, result"))(run)


_golden("series_levels", LEVELS, S.levels)
_golden("series_cleaned", CLEAN, S.clean)
_golden("series_normal", NORMAL, S.normal)
_golden("series_told", TOLD, S.told_by_name)
_golden("series_valid", VALID, S.is_series)


@query("empty_folders", """
SELECT n_name AS folder FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")
def empty_folders(spark, sf_dir) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    files = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat("n_name", F.lit("/"), "c_name").alias("file_path"))
    return P.empty_folders(n.select(F.col("n_name").alias("folder")), files, "file_path")


@query("below_folders", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def below_folders(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("\\"), "p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("file_path"))
    return P.below_any(p, spark.createDataFrame([("Brand#1",), ("Brand#2",)], "folder string"), "file_path").select("p_partkey")


_CACHE_SQL = "WITH c AS (SELECT o_orderkey, o_orderstatus AS parser, epoch(CAST(o_orderdate AS DATE)) AS cached_at FROM orders) "


def _cache(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("parser"), (F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")) * 86_400.0).alias("cached_at"))


@query("purged_cache", _CACHE_SQL + "SELECT o_orderkey FROM c WHERE parser = 'F' AND cached_at >= 800000000")
def purged_cache(spark, sf_dir) -> DataFrame:
    return maintenance.purged(_cache(spark, sf_dir), "F", 800_000_000.0).select("o_orderkey")


@query("cache_statistics", _CACHE_SQL + "SELECT count(*) AS total, count(*) FILTER (WHERE cached_at > 800000000 - 86400) AS last_day FROM c")
def cache_statistics(spark, sf_dir) -> DataFrame:
    return maintenance.cache_statistics(_cache(spark, sf_dir), 800_000_000.0)


@query("lone_first_volumes", """WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS p FROM part)
SELECT p_partkey, CASE WHEN p IS NULL AND count(*) FILTER (WHERE p IS NULL) OVER w = 1 AND min(p) OVER w >= 2 THEN 1 ELSE p END AS position FROM r WINDOW w AS (PARTITION BY p_brand)""")
def lone_first_volumes(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("position"))
    return sequences.lone_first_volume(p, ["p_brand"], "position").select("p_partkey", "position")


@query("vote_pages", """
SELECT p_partkey, '/b/' || p_partkey || '.shtml' AS link, p_name AS title, p_size / 10.0::DOUBLE AS rating, CAST(p_size AS BIGINT) AS votes FROM part""")
def vote_pages(spark, sf_dir) -> DataFrame:
    html = F.concat(
        F.lit('<ul><li><a href="/b/'), F.col("p_partkey").cast("string"), F.lit('.shtml"><b>'), "p_name", F.lit("</b></a> &nbsp; <b>"), F.format_string("%.1f", F.col("p_size") / 10), F.lit("*"), F.col("p_size").cast("string"),
        F.lit("</b></li></ul>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(maintenance.vote_pages(html)).alias("v"))
    return rows.select("p_partkey", "v.*")


@query("work_ratings", "SELECT event_id, CAST(event_id % 100 AS BIGINT) AS work_id, event_type AS name, CAST(event_id % 10 AS DOUBLE) AS rating FROM events")
def work_ratings(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    answer = F.to_json(F.struct(F.array(F.struct((F.col("event_id") % 100).alias("work_id"), F.col("event_type").alias("name"), F.struct((F.col("event_id") % 10).cast("double").alias("rating")).alias("rating"))).alias("works")))
    return e.select("event_id", F.explode(maintenance.work_ratings(answer)).alias("w")).select("event_id", "w.work_id", "w.name", F.col("w.rating.rating").alias("rating"))


@query("patched_tags", """
SELECT p_partkey, '<title-info><book-title>' || p_type || '</book-title><sequence name="' || p_brand || '" number="' || p_size || '"/></title-info><p>' || p_name || '</p>' AS text FROM part""")
def patched_tags(spark, sf_dir) -> DataFrame:
    xml = F.concat(F.lit('<title-info><book-title>'), "p_name", F.lit('</book-title><sequence name="x"/></title-info><p>'), "p_name", F.lit("</p>"))
    return table(spark, sf_dir, "part").select("p_partkey", maintenance.patched(xml, F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string")).alias("text"))


@query("volume_groups", """WITH b AS (
  SELECT p_partkey, p_brand AS author, p_type AS series, p_name || ' ' || p_partkey AS title, CAST(p_size AS BIGINT) AS n, p_brand || '/' || p_type || '/' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '.fb2' AS path FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY author, series, n ORDER BY path) AS rn FROM b),
i AS (SELECT author, series, n, n - row_number() OVER (PARTITION BY author, series ORDER BY n) AS run FROM k WHERE rn = 1),
g AS (SELECT author, series, count(*) AS n_books, min(n) AS lo, max(n) AS hi FROM i GROUP BY author, series, run HAVING count(*) >= 2),
d AS (SELECT author, series, count(*) AS n_dropped FROM k WHERE rn > 1 GROUP BY author, series)
SELECT author, series, n_books, lo || '-' || hi AS volumes, coalesce(n_dropped, 0) AS n_dropped, lo = 1 AS complete FROM g LEFT JOIN d USING (author, series)""")
def volume_groups(spark, sf_dir) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    books = p.select(
        F.col("p_brand").alias("author"), F.col("p_type").alias("series"), F.concat_ws(" ", "p_name", key).alias("title"), F.col("p_size").cast("string").alias("series_number"),
        F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.lpad(key, 9, "0"), F.lit(".fb2")).alias("file_path"))
    return groups.volume_groups(books).select("author", "series", "n_books", "volumes", F.size("dropped").cast("long").alias("n_dropped"), "complete")


@query("book_sections", """
SELECT p_partkey, 'Том ' || p_size AS title, CAST(p_size AS INTEGER) AS volume, '<section><title>Том ' || p_size || '</title><section>' || p_name || '</section></section>' AS text FROM part
UNION ALL SELECT p_partkey, '', NULL, '<section>' || p_type || '</section>' FROM part""")
def book_sections(spark, sf_dir) -> DataFrame:
    size = F.col("p_size").cast("string")
    xml = F.concat(
        F.lit("<body>x<section><title>Том "), size, F.lit("</title><section>"), "p_name", F.lit("</section></section> y <section>"), "p_type", F.lit("</section></body><binary>z</binary>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(groups.sections(xml)).alias("s")).select("p_partkey", "s.title", "s.volume", "s.text")
