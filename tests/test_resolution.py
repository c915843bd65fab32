"""Patterns, predicates and compilations on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from stackwright.functions import predicates as P
from stackwright.functions import text as T
from stackwright.operators import compilations, duplicates, genres, names, patterns


def values(spark, f, *texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("name, blocks", [
    ("Янковский Дмитрий - Охотник (Тетралогия)", ["Янковский Дмитрий", "Охотник", "Тетралогия"]),
    ("Мах. Квест империя", ["Мах", "Квест империя"]),
    ("Посняков Андрей - Вещий князь (Вещий князь 1-4) Др. издание", ["Посняков Андрей", "Вещий князь", "Вещий князь 1-4", "Др. издание"]),
    ("Авраменко Александр - Солдат удачи (Солдат удачи. Тетралогия)", ["Авраменко Александр", "Солдат удачи", "Солдат удачи. Тетралогия"]),
    ("Зан Т. - Траун", ["Зан Т.", "Траун"]),
    ("Имя. Версия 2.0 я сдаюсь... «А. Б - В» г", ["Имя", "Версия 2.0 я сдаюсь... «А. Б - В» г"]),
    ("", []),
])
def test_blocks(spark, name, blocks):
    assert [b["text"] for b in values(spark, patterns.blocks, name)[0]] == blocks


def test_block_details(spark):
    got = values(spark, patterns.blocks, "А - Б. В (г. д) - е", "(а) - б", None)
    assert [tuple(b) for b in got[0]] == [("А", False, None), ("Б", False, " - "), ("В", False, ". "), ("г. д", True, "("), ("- е", False, ")")]
    assert [tuple(b) for b in got[1]] == [("а", True, "("), ("- б", False, ")")] and got[2] is None
    kinds = ["весь том 3", "Солдат удачи. Тетралогия", "Меч 1-3", "Меч 4", "Война и мир", "Иванов Пётр", "Зан Ян", "Мах", "Moby Dick", "пыль дорог"]
    assert values(spark, patterns.block_kind, *kinds) == ["service_words", "Series", "Series", "Series", "Title", "Author", "Author", "Author", "Title", "Title"]


def test_best_pattern(spark):
    names_ = ["Авраменко Александр - Солдат удачи (Солдат удачи. Тетралогия)", "Садов Сергей - Горе победителям (Дилогия)", "", "Авраменко. Цикл «Солдат удачи»"]
    got = patterns.match_patterns(spark.createDataFrame([(i, n) for i, n in enumerate(names_)], "i int, name string"), "name").orderBy("i").collect()
    assert [(r["best_pattern"], r["author"], r["series"]) for r in got[:3]] == [
        ("Author - Title (Series)", "Авраменко Александр", "Солдат удачи. Тетралогия"), ("Author - Series (service_words)", "Садов Сергей", "Горе победителям"), (None, None, None)]
    assert patterns.match_patterns(spark.createDataFrame([(None,)], "name string"), "name").first()["best_pattern"] is None
    assert got[3]["best_pattern"] == "Author. service_words «Series»" and got[3]["author"] == "Авраменко"


def test_compiled_pattern(spark):
    assert patterns.compile_pattern("Author, Author - Title")[1] == ["author", "author_2", "title"]
    got = values(spark, lambda c: patterns.extract_groups(c, "Author, Author - Title"), "А Б, В Г - Д", "А")
    assert tuple(got[0]) == ("А Б", "В Г", "Д") and got[1] is None


def test_predicates(spark):
    assert values(spark, P.contains_word, "мой сборник", "сборники", "эксмо") == [True, False, True]
    assert values(spark, P.is_branding, "цусима", "СИ", "Попаданец на рыбалке", "фантастика") == [False, True, False, True]
    assert values(spark, P.is_valid_author, "Иван Петров", "123", "a/b", "", "сборник") == [True, False, False, False, False]
    assert values(spark, P.is_incomplete_name, "Живой", "Михеев М.", "Живой Алексей", "Форд Джон М.", None) == [True, True, False, False, True]
    assert values(spark, P.is_variant_folder, "Вариант 2", "россия", "alt") == [True, False, True]
    assert values(spark, P.is_no_series_folder, "Вне серий", "Серия") == [True, False]


def test_group_key(spark):
    assert values(spark, T.group_key, "Ревизор. Возвращение", "Серия 1\\Икс", "Отрок\\Сотник") == ["ревизор возвращение", "серия|икс", "отрок\\сотник"]


def test_opening_text(spark):
    xml = "<body><section><title>От автора</title>x</section><section>Жил  был <b>кот</b>. ISBN: 12345-6</section></body>"
    assert values(spark, T.opening_text, xml, "<body>без секций</body>", None) == ["Жил был кот .", "без секций", None]


def test_classify_and_replace(spark):
    rows = [("a/1.fb2", "A", "S", "t", "1-3"), ("a/2.fb2", "a", "s", "t", "2"), ("a/3.fb2", "A", "S", "t", "7"), ("b/x.fb2", "B", "S", "Сборник", ""), ("b/y.fb2", "B", "S", "t", "1"), ("c.fb2", "", "S", "t", "1")]
    df = spark.createDataFrame(rows, "file_path string, author string, series string, title string, series_number string")
    assert {r[0] for r in compilations.replaced_by_compilations(df).collect()} == {"a/2.fb2", "b/y.fb2"}
    assert compilations.replaced_by_compilations(df.limit(0)).collect() == []


def test_groups_of_volumes(spark):
    rows = [(1, "1_а.fb2", "Спартанец", 1), (1, "2_б.fb2", "Великий царь", 2), (1, "все.fb2", "Спартанец. Великий царь", None), (1, "трилогия.fb2", "Трилогия", None), (1, "3.fb2", "Удар", 3)]
    df = spark.createDataFrame(rows, "g int, path string, title string, pos int")
    assert [tuple(r) for r in compilations.titles_inside(df, ["g"], "path", "title", "pos").collect()] == [(1, "все.fb2", 1, 2)]
    assert {(r["path"], r["lo"], r["hi"]) for r in compilations.service_word_ranges(df, ["g"], "title", "pos").filter("lo is not null").collect()} == {("трилогия.fb2", 1, 3)}


def test_merged_buckets(spark):
    keys = [("иванов", "меч", []), ("иванов петр", "меч", []), ("иванов петр", "сага меч", ["меч"]), ("сидоров", "меч", []), ("иванов", "щит", [])]
    got = {(r[0], r[1]): (r[2], r[3]) for r in compilations.merged_buckets(spark.createDataFrame(keys, "author string, series string, said array<string>")).collect()}
    assert got == {("иванов", "меч"): ("иванов петр", "сага меч"), ("иванов петр", "меч"): ("иванов петр", "сага меч"), ("иванов петр", "сага меч"): ("иванов петр", "сага меч"),
                   ("сидоров", "меч"): ("сидоров", "меч"), ("иванов", "щит"): ("иванов", "щит")}


def test_surnames_expand(spark):
    full = spark.createDataFrame([("Иванов Петр", 1), ("Иванов Олег", 2)], "author string, at int")
    df = spark.createDataFrame([("Иванов О.",), ("П. Иванов",), ("Иванов",), ("Кто То",)], "who string")
    assert sorted(r[0] for r in names.expand_surnames(df, "who", full, "at").collect()) == ["Иванов Олег", "Иванов Петр", "Иванов Петр", "Кто То"]


def test_genre_tree(spark, tmp_path):
    xml = '<genres><genre name="A"><assigned><genre>sf</genre></assigned><genre name="B"/></genre></genres>'
    nodes = genres.read_tree(xml)
    assert nodes == [("A", None, ["sf"]), ("B", "A", [])]
    genres.write_tree(nodes, str(tmp_path / "g.xml"))
    assert genres.read_tree((tmp_path / "g.xml").read_text(encoding="utf-8")) == nodes
    tree = genres.associate(genres.tree_table(spark, nodes), "x", "B")
    assert {tuple(r) for r in genres.walk(tree).collect()} == {("A", 0, "A", "A"), ("B", 1, "A/B", "A")}


def test_duplicates_by_whole_content(spark, tmp_path):
    from stackwright.registry import QUERIES

    opening = "é" * 200_000  # more than 256 KiB
    rows = [(1, opening + "a"), (2, opening + "b"), (3, opening + "a"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["dup_by_hash"](spark, str(tmp_path)).collect()] == [(3, 1)]
    first = duplicates.by_content(df.filter("text is not null"), "doc_id", F.col("text"), duplicates.HASHED_BYTES)
    assert sorted(map(tuple, first.collect())) == [(2, 1), (3, 1)]
