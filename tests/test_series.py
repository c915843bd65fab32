"""Series names, series by file name, maintenance and parsers on small cases."""

import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F
from test_resolution import values

from stackwright.functions import series as S
from stackwright.functions import text as T
from stackwright.functions.volumes import leading_int, strict_int
from stackwright.operators import authors, paths, sequences, series
from stackwright.sources import books, maintenance


def test_levels_and_clean(spark):
    assert values(spark, S.levels, "Сид 1. Принцип талиона 1. Геката 1", "Дракон 1-3", "Мир Вечного 2. Вечный. Тетралогия", "О. Р. З.", "") == ["Сид\\Принцип талиона\\Геката", "Дракон", "Мир Вечного\\Вечный", "", ""]
    assert values(spark, S.clean, "Солдат удачи 3. Взор Тьмы", "Вариант «Бис» 1", "«СССР-2023» 2", "Странник (Серия 3)", "Цивилизация 2.0", "Араб.", "Сага №5") == ["Солдат удачи", "Вариант «Бис", "СССР-2023", "Странник", "Цивилизация 2.0", "Араб", "Сага"]


def test_normal_series(spark):
    rows = {"Тёмный  век": "Темный век", "Байши Сюсянь: Песнь": "Песнь", "Война в мире: год первый": "Война в мире год первый", "Пастух[Кросс]": "Пастух", "Дракон (Трофимов)": "Дракон", "Отряд «Сигма» 07+": "Отряд «Сигма»", "Война 1941": "Война 1941", "Цикл «Солдат удачи»": "Солдат удачи", "Пророчество (т": "Пророчество", "Война (1-3)": "Война"}
    assert values(spark, S.normal, *rows) == list(rows.values())
    got = spark.createDataFrame([("Артефакт - детектив. Астра", "Артефакт & Детектив/x.fb2"), ("Иное. Астра", "Артефакт/x.fb2")], "s string, p string").select(S.without_folder_prefix(F.col("s"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["Астра", "Иное. Астра"]


def test_is_series(spark):
    good = ["Солдат удачи", "Последний солдат СИ", "Детектив Джейкоб Лев", "Том Риддл", "СССР-2023"]
    bad = ["Литературная премия «Буква – 2019»", "Р\\или Сказ", ".45", "9mm", "том 1", "книга", "Сборник рассказов", "фантастика", "x", ""]
    assert values(spark, S.is_series, *good) == [True] * len(good)
    assert values(spark, S.is_series, *bad) == [False] * len(bad)


def test_names_tell_series(spark):
    rows = {"[Метро] Туннель": "Метро", "Курилкин. Охотник 1": "Охотник", "Яманов. Бесноватый Цесаревич I": "Бесноватый Цесаревич", "Атаманов Михаил - Задача выжить 1": "Задача выжить", "Тидхар Леви - Центральная станция 2. Неом": "Центральная станция", "Земляной Андрей - Отморозки. Другим путем": "Отморозки", "Белоус": ""}
    assert values(spark, S.told_by_name, *rows) == list(rows.values())
    pairs = [("Аберкромби - Земной круг 1. Первый закон 2. Прежде чем их повесят", "Первый закон", "Земной круг 1\\Первый закон"), ("Вулф - Брия 1. Книга Длинного Солнца 1-2. Литания", "Книга Длинного Солнца", "Брия 1\\Книга Длинного Солнца"), ("А - Б 1. Вода 2. Г", "Иное", None)]
    got = spark.createDataFrame([p[:2] for p in pairs], "n string, m string").select(S.two_levels(F.col("n"), F.col("m"))).collect()
    assert [r[0] for r in got] == [p[2] for p in pairs]


def test_series_from_file_names(spark):
    rows = [("а/Авраменко Александр - Солдат удачи (Солдат удачи 1. Тетралогия).fb2", "", ""), ("а/Курилкин. Охотник 1.fb2", "", "Охотник"), ("а/Петров Иван - Меч.fb2", "Меч", ""), ("а/Петров Иван - Щит.fb2", "Щит", "Сага")]
    got = {r.file_path: (r.proposed_series, r.series_source) for r in series.series_from_file_names(authors.records(spark.createDataFrame(rows, "file_path string, file_title string, metadata_series string"))).collect()}
    assert [got[r[0]] for r in rows] == [("Солдат удачи", "filename"), ("Охотник", "filename+meta_confirmed"), ("", ""), ("Сага", "metadata")]
    df = authors.records(spark.createDataFrame([("а/Круг 2. Имя.fb2", "А", "Круг"), ("а/x.fb2", "А", "Круг 1\\Закон"), ("а/Круг 3. Y.fb2", "Б", "Круг")], "file_path string, proposed_author string, proposed_series string"))
    assert {r.file_path: r.proposed_series for r in series.numbered_children(df).collect()} == {"а/Круг 2. Имя.fb2": "Круг 2", "а/x.fb2": "Круг 1\\Закон", "а/Круг 3. Y.fb2": "Круг"}
    df = authors.records(spark.createDataFrame([(f"f/{i}", s) for i, s in enumerate("AABBC")], "file_path string, metadata_series string")).withColumn("proposed_series", F.lit("F"))
    assert [r.proposed_series for r in series.umbrella_folders(df, authors.folder_of(F.col("file_path")), F.col("metadata_series")).orderBy("file_path").collect()] == ["A", "A", "B", "B", "F"]


def test_gaps_of_blank_authors_and_wide_gaps(spark):
    rows = [("", "S", "1"), ("", "S", "3"), (None, "S", "x"), ("A", "T", "1"), ("A", "T", "999999999999")]
    got = {r.author: (r.books, r.have, r.missing) for r in sequences.series_gaps(spark.createDataFrame(rows, "author string, series string, series_number string")).collect()}
    assert got == {"": (3, "1, 3", "2"), "A": (2, "1, 999999999999", "2-999999999998")}
    runs = spark.createDataFrame([("k", 1, 10**9), ("k", 5, 6), ("k", 2 * 10**9, 2 * 10**9)], "k string, lo long, hi long")
    assert tuple(sequences.run_statistics(runs, ["k"], "lo", "hi").first()) == ("k", 1, 2 * 10**9, 10**9 + 1)
    lone = spark.createDataFrame([("a", 2), ("a", 3), ("a", None), ("b", None), ("b", 1)], "k string, p int")
    assert sorted((r.k, r.p or 0) for r in sequences.lone_first_volume(lone, ["k"], "p").collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert values(spark, strict_int, "7", "1234567890123", "1-3", "") == [7, 1234567890123, None, None]
    assert values(spark, leading_int, "12345678901 x", "1-3", "x", "99999999999999999999") == [12345678901, 1, 0, 2**63 - 1]


def test_like_and_paths(spark):
    assert values(spark, lambda c: T.like_ascii(c, "%R_NG%"), "a ring", "Rang", "rng", "РИНГ") == [True, True, False, False]
    assert values(spark, lambda c: T.like_ascii(c, "%Ы%"), "ы", "Ы") == [False, True]
    assert values(spark, paths.ancestors, "a\\b/c.fb2") == [["a", "a/b"]]
    files = spark.createDataFrame([("a/b/1",), ("c/2",)], "file_path string")
    assert [r[0] for r in paths.below_any(files, spark.createDataFrame([("a",)], "folder string"), "file_path").collect()] == ["a/b/1"]
    assert [r[0] for r in paths.empty_folders(spark.createDataFrame([("a",), ("d",)], "folder string"), files, "file_path").collect()] == ["d"]
    assert values(spark, T.title_of_file, "01. Иванов - Меч", "Меч") == ["Меч", "Меч"]


def test_containers():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("book.FB2", "book")
    broken = packed.getvalue()[:30]
    assert books.unzipped(packed.getvalue()) == b"book" and books.unzipped(broken) == broken and books.unzipped(b"plain") == b"plain"
    for code in ("koi8-r", "cp866", "cp1251"):
        assert books.decoded("Глава первая. Однажды Иван пошел в лес.".encode(code)).startswith("Глава")


def test_book_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.fb2").write_text("<FictionBook/>")
    (tmp_path / "2.txt").write_text("x")
    assert books.count_books(spark, str(tmp_path)) == 1 and books.has_books(spark, str(tmp_path))
    (tmp_path / "l.csv").write_text("file_path,author\na,\nb,X\n")
    assert [tuple(r) for r in books.read_csv(spark, str(tmp_path / "l.csv")).collect()] == [("a", ""), ("b", "X")]
    (tmp_path / "c.json").write_text('{"words": ["a", "b"], "n": 1, "rows": [{"x": 1}]}')
    assert maintenance.load_lists(spark, str(tmp_path / "c.json")) == {"words": ["a", "b"]}


def test_cache_and_decisions(spark):
    cache = spark.createDataFrame([("a", 1.0, "h", "m", "p2", 100.0), ("b", 1.0, "h", "m", "p1", 90_000.0)], "file_path string, mtime double, hash string, metadata string, parser string, cached_at double")
    files = spark.createDataFrame([("a", 1.0, "h"), ("a", 2.0, "h"), ("b", 1.0, "h")], "file_path string, mtime double, hash string")
    assert sorted((r.file_path, r.mtime, r.metadata) for r in maintenance.fresh_metadata(files, cache, "p2").collect()) == [("a", 1.0, "m"), ("a", 2.0, None), ("b", 1.0, None)]
    assert [r.file_path for r in maintenance.purged(cache, "p1").collect()] == ["b"] and [r.file_path for r in maintenance.purged(cache, before=500.0).collect()] == ["b"]
    assert tuple(maintenance.cache_statistics(cache, 90_001.0).first()) == (2, 1)
    rows = maintenance.folder_decisions(spark.createDataFrame([("x/y",), ("z",)], "folder string"))
    assert {r.file_path: r.action for r in maintenance.unprotected(rows, ["x\\y\\"]).collect()} == {"x/y": "skip", "z": "remove"}


def test_tags_answers_and_functions(spark):
    xml = '<d><title-info><book-title>A</book-title><sequence name="S" number="1"/></title-info><p>A</p></d>'
    got = values(spark, lambda c: maintenance.patched(c, F.lit("B $1 & C"), F.lit("T"), F.lit("2")), xml, "<x/>")
    assert got == ['<d><title-info><book-title>B $1 &amp; C</book-title><sequence name="T" number="2"/></title-info><p>A</p></d>', "<x/>"]
    assert values(spark, lambda c: maintenance.patched(c, None, F.lit("")), xml) == ["<d><title-info><book-title>A</book-title></title-info><p>A</p></d>"]
    answer = '{"works": [{"work_id": 5, "name": "N", "author": "A", "rating": {"rating": 8.5, "voters": 10}}]}'
    assert [tuple(w)[:3] + tuple(w["rating"]) for w in values(spark, maintenance.work_ratings, answer)[0]] == [(5, "N", "A", 8.5, 10)]
    assert [tuple(x) for x in values(spark, maintenance.vote_pages, '<li><a href="/a/b.shtml"><b>Title</b></a> <b>7.50*12</b></li>')[0]] == [("/a/b.shtml", "Title", 7.5, 12)]
    maintenance.register_functions(spark)
    assert tuple(spark.sql("SELECT series_base('Охотник 1'), series_base('Фэндом-3'), series_base('Метро 2.0'), name_key('Ёж'), file_stem('a/b.fb2.zip')").first()) == ("Охотник", "Фэндом", "Метро 2.0", "еж", "b")


def _covered(rows):
    """path: keeper by comparing all members, as the SQL does."""
    out = {}
    for a, s, lo, hi, path in rows:
        held = [
            (ohi - olo, keeper) for b, t, olo, ohi, keeper in rows
            if (a, s) == (b, t) and None not in (a, s) and olo <= lo and ohi >= hi and (ohi - olo > hi - lo or (ohi - olo == hi - lo and keeper < path))
        ]
        if held:
            out[a, s, path] = max([*held, *([out[a, s, path]] if (a, s, path) in out else [])])
    return {k: v[1] for k, v in out.items()}


@pytest.mark.parametrize("most,widest", [(12, 4), (60, 60), (400, 30)])
def test_covered_by_brute_force(spark, most, widest):
    r = random.Random(most)
    rows = [(r.choice(["A", "B", None]), r.choice("xy"), lo := r.randint(-3, most), lo + r.randint(0, widest), f"p{r.randint(0, 500):03}") for _ in range(600)]
    rows += [("C", "x", i, i + most, f"q{i:03}") for i in range(64)] + [("C", "x", 30, 40, "in"), ("C", "x", 0, 0, "first"), ("C", "x", 63, 63 + most, "same")]
    df = spark.createDataFrame(rows, "author string, series string, lo int, hi int, path string")
    got = sequences.covered(df, ["author", "series"], "lo", "hi", "path").collect()
    assert {(x.author, x.series, x.path): x.keeper for x in got} == _covered(rows)
    assert len(got) == len({(x.author, x.series, x.path) for x in got})


def test_covered_makes_no_pairs(spark):
    """20,000 equal and 20,000 nested ranges of one key have 400 million pairs."""
    same = spark.range(20_000).selectExpr("'A' AS a", "5 AS lo", "9 AS hi", "format_string('s%05d', id) AS path")
    nested = spark.range(20_000).selectExpr("'A' AS a", "CAST(100 + id AS INT) AS lo", "CAST(60000 - id AS INT) AS hi", "format_string('n%05d', id) AS path")
    began = time.time()
    got = {r.path: r.keeper for r in sequences.covered(same.union(nested), ["a"], "lo", "hi", "path").collect()}
    assert time.time() - began < 30
    assert got == {f"s{i:05}": f"s{i - 1:05}" for i in range(1, 20_000)} | {f"n{i:05}": "n00000" for i in range(1, 20_000)}
