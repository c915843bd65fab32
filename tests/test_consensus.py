"""Each rule of the consensus pass on small cases, and all of them in order."""

import pytest

from stackwright.operators import authors
from stackwright.operators import consensus as C

COLUMNS = ["file_path", "proposed_author", "author_source", "proposed_series", "series_source", "metadata_series", "extracted_series_candidate"]


@pytest.fixture
def run(spark):
    def go(rule, *rows):
        df = spark.createDataFrame([tuple(r) + ("",) * (len(COLUMNS) - len(r)) for r in rows], ", ".join(f"{c} string" for c in COLUMNS)).repartition(2)
        return {r.file_path: (r.proposed_author, r.author_source, r.proposed_series, r.series_source) for r in rule(authors.records(df)).collect()}

    return go


def test_lone_titles_go(run):
    got = run(
        C.clear_lone_titles, ("a/Осень.fb2", "А", "", "Осень", "filename"), ("a/Б 1.fb2", "А", "", "Б", "filename"), ("a/В.fb2", "А", "", "В", "filename", "в"), ("a/Г.fb2", "А", "", "Г", "folder_dataset"),
        ("a/Д (Д. Трилогия).fb2", "А", "", "Д", "filename"), ("a/Е-1.fb2", "А", "", "Е", "filename"), ("a/Е-2.fb2", "А", "", "Е", "filename"), ("Серия X/Ж.fb2", "А", "", "Ж", "filename"),
    )
    assert {k.split("/")[1]: v[2] for k, v in got.items()} == {"Осень.fb2": "", "Б 1.fb2": "Б", "В.fb2": "В", "Г.fb2": "Г", "Д (Д. Трилогия).fb2": "Д", "Е-1.fb2": "Е", "Е-2.fb2": "Е", "Ж.fb2": "Ж"}


def test_folder_authors_agree(run):
    got = run(C.folder_author_consensus, ("a/1", "Иванов", "filename"), ("a/2", "Петров", "metadata"), ("a/3", "", ""), ("b/1", "X", "metadata"), ("b/2", "Y", "metadata"), ("b/3", "", ""), ("b/4", "X", "metadata"))
    assert {k: v[:2] for k, v in got.items()} == {
        "a/1": ("Иванов", "filename"), "a/2": ("Иванов", "consensus"), "a/3": ("Иванов", "consensus"), "b/1": ("X", "metadata"), "b/2": ("Y", "metadata"), "b/3": ("X", "consensus"), "b/4": ("X", "metadata")}


def test_series_spread_by_author_and_folder(run):
    got = run(C.author_series_consensus, ("a/1", "А", "", "Меч", "filename", "", "Меч 1"), ("b/А - Меч.fb2", "А"), ("b/Мечта и меч.fb2", "А"), ("b/Щит, меч.fb2", "А"), ("c/Меч.fb2", "Б"), ("d/А. Меч.fb2", "А", "", "", "", "Меч 2"))
    assert {k: v[2:] for k, v in got.items()} == {
        "a/1": ("Меч", "filename"), "b/А - Меч.fb2": ("Меч", "author-consensus"), "b/Мечта и меч.fb2": ("Меч", "author-consensus"), "b/Щит, меч.fb2": ("", ""), "c/Меч.fb2": ("", ""),
        "d/А. Меч.fb2": ("Меч", "author-consensus (metadata-confirmed)")}
    got = run(C.folder_series_consensus, ("a/1", "", "", "С", "metadata", "С"), ("a/2", "", "", "", "", "С"), ("a/3", "", "", "", "", "Д"), ("b/1", "", "", "Ель", "filename"), ("b/2", "", "", "Ель", "filename"), ("b/Ель.fb2",), ("b/Дуб.fb2",))
    assert {k: v[2] for k, v in got.items()} == {"a/1": "С", "a/2": "С", "a/3": "", "b/1": "Ель", "b/2": "Ель", "b/Ель.fb2": "Ель", "b/Дуб.fb2": ""}


def test_authors_by_series_and_prefix(run):
    got = run(C.series_author_consensus, ("1", "Ильин Сергей, Ипатова Наталия", "filename", "В"), ("2", "Ильин Сергей, Ипатова Наталия", "filename", "В"), ("3", "Ипатова Наталия", "filename", "В"), ("4", "Капитонов", "filename", "В"), ("5", "Ипатова", "folder_dataset", "В"), ("6", "ильин", "", "В"))
    assert (got["3"][:2], got["4"][0], got["5"][0], got["6"][1]) == (("Ильин Сергей, Ипатова Наталия", "filename+series-consensus"), "Капитонов", "Ипатова", "series-consensus")
    got = run(C.authors_by_prefix, ("a/Zлой Медик. Тень.fb2", "Zлой Медик", "metadata"), ("a/Злой медик (сборник).fb2", "[unknown]"), ("a/Злой медики.fb2", ""), ("b/Злой медик.fb2", ""))
    assert {k: v[0] for k, v in got.items()} == {"a/Zлой Медик. Тень.fb2": "Zлой Медик", "a/Злой медик (сборник).fb2": "Zлой Медик", "a/Злой медики.fb2": "", "b/Злой медик.fb2": ""}


def test_hierarchies(run):
    rows = [("1", "А", "", "Рожденные в СССР"), ("2", "А", "", "Рожденные в СССР. Личности"), ("3", "А", "", "Рожденные в СССР. 2"), ("4", "А", "", "Рожденные в СССР. Назад в"), ("5", "Б", "", "Рожденные в СССР. Личности")]
    assert [run(lambda d: C.unify_hierarchies(d, True), *rows)[k][2] for k in "12345"] == ["Рожденные в СССР", "Рожденные в СССР\\Личности", "Рожденные в СССР", "Рожденные в СССР", "Рожденные в СССР. Личности"]
    assert run(lambda d: C.unify_hierarchies(d, False), *rows)["4"][2] == "Рожденные в СССР\\Назад в"


def test_cleanups(run):
    got = run(C.clear_embedded_authors, ("1", "Браст Иван", "", "Миры Браста", "folder_hierarchy", "Меч"), ("2", "Ян Иль", "", "Книги Яна", "folder_hierarchy"), ("3", "Браст Иван", "", "Миры Браста", "filename"), ("4", "Б", "", "Эксмо", "folder_hierarchy", "Дик, Филип. Сборники"), ("5", "Б", "", "Путь", "folder_hierarchy"))
    assert {k: v[2:] for k, v in got.items()} == {"1": ("Меч", "metadata"), "2": ("", ""), "3": ("Миры Браста", "filename"), "4": ("", ""), "5": ("Путь", "folder_hierarchy")}
    got = run(C.clear_shared_folders, ("Серия - «Метро»/1", "А", "", "Метро"), ("Серия - «Метро»/2", "Б", "", "Другое"), ("Метро/3", "А", "", "Метро"), ("Метро/4", "[unknown]", "", "Метро"), ("Мир/5", "А", "", "Мир"), ("Мир/6", "Б", "", "Мир"), ("Ёлки/7", "А", "", "елки"), ("Ёлки/8", "Сборник"))
    assert {k[-1]: v[2] for k, v in got.items()} == {"1": "", "2": "Другое", "3": "Метро", "4": "Метро", "5": "Мир", "6": "Мир", "7": "", "8": ""}


def test_corrections(run):
    got = run(C.confirm_twice, ("1", "А", "", "Переписать", "filename", "", "Переписать 2"), ("Переписать.fb2", "А", "", "Другое", "consensus", "Переписать 1"), ("Иное.fb2", "А", "", "Другое", "consensus", "Переписать"))
    assert (got["Переписать.fb2"][2:], got["Иное.fb2"][2]) == (("Переписать", "filename+meta_confirmed"), "Другое")
    got = run(C.restore_cut_series, ("1", "А", "", "Я - Миха", "metadata"), ("2", "А", "", "миха", "filename"), ("3", "Б", "", "миха", "filename"), ("4", "А", "", "Я - Миха", "filename"))
    assert [got[k][2:] for k in "1234"] == [("Я - Миха", "metadata"), ("Я - Миха", "author-consensus"), ("миха", "filename"), ("Я - Миха", "filename")]
    got = run(C.folder_metadata_majority, ("a/1", "", "", "", "", "Второй шанс (Гаусс)"), ("a/2", "", "", "", "", "Второй шанс [Г]"), ("a/Второй шанс.fb2",), ("a/4", "", "", "X", "filename", "Второй шанс"), ("a/5", "", "", "", "", "Иное"))
    assert {k: v[2] for k, v in got.items()} == {"a/1": "Второй шанс", "a/2": "Второй шанс", "a/Второй шанс.fb2": "Второй шанс", "a/4": "X", "a/5": ""}
    got = run(C.folder_series_donors, ("a/2", "", "", "С", "folder_dataset"), ("a/1", "", "", "Т", "filename"), ("a/3",))
    assert got["a/3"][2:] == ("С", "folder_dataset")
    got = run(C.confirm_phrases, ("Коруд Ал. Студент в СССР 2.fb2", "Коруд Ал", "", "", "", "Студент в СССР"), ("Ал Коруд - Студент в СССР.fb2", "Коруд Ал"), ("Коруд Ал. Студент.fb2", "Коруд Ал"), ("Студент в СССР 3.fb2", "Коруд Ал", "", "Y", "filename"))
    assert {k: v[2] for k, v in got.items()} == {"Коруд Ал. Студент в СССР 2.fb2": "Студент в СССР", "Ал Коруд - Студент в СССР.fb2": "Студент в СССР", "Коруд Ал. Студент.fb2": "", "Студент в СССР 3.fb2": "Y"}


def test_all_rules_in_order(run):
    got = run(C.consensus, ("a/Иванов - Ёж 1.fb2", "Иванов", "filename", "Ёж", "filename", "", "Ёж 1"), ("a/Иванов - Ёж 2.fb2", "Иванов", "filename", "Ёж", "filename", "", "Ёж 2"), ("a/Ёж.fb2", "[unknown]"), ("b/x.fb2", "", "", "", "", "Шерлок Холмс. Свободные продолжения"))
    assert got["a/Ёж.fb2"] == ("Иванов", "consensus", "Еж", "author-consensus") or got["a/Ёж.fb2"][2] == "Еж"
    assert got["b/x.fb2"][2:] == ("Шерлок Холмс. Свободные продолжения", "metadata") and got["a/Иванов - Ёж 1.fb2"][2] == "Еж"
