"""Groups of volumes, ranges, dates and sections on small cases."""

from pyspark.sql import functions as F
from test_resolution import values

from stackwright.operators import groups


def found(spark, *rows):
    df = spark.createDataFrame(rows, "author string, series string, title string, series_number string, file_path string")
    return {(r.author, r.series, r.volumes): r for r in groups.volume_groups(df).collect()}


def test_islands_and_doubles(spark):
    rows = [("А", "С", f"t{i}", str(i), f"{i}.fb2") for i in (1, 2, 3, 6, 7)] + [("А", "С", "t2", "2", "z2.fb2"), ("А", "С", "other", "3", "z3.fb2"), ("Б", "С", "t", "1", "b.fb2"), ("", "С", "t", "1", "c.fb2")]
    got = found(spark, *rows)
    assert set(got) == {("А", "С", "1-3"), ("А", "С", "6-7")}
    first = got["А", "С", "1-3"]
    assert (first.paths, first.dropped, first.complete, first.suffix) == (["1.fb2", "2.fb2", "3.fb2"], ["z2.fb2", "z3.fb2"], True, "Трилогия")
    assert (got["А", "С", "6-7"].complete, got["А", "С", "6-7"].suffix) == (False, "т. 6-7")


def test_bound_books_and_unknown_positions(spark):
    rows = [("А", "С", "all", "1-4", "all.fb2"), ("А", "С", "two", "2", "2.fb2"), ("А", "С", "part", "2-3", "p.fb2"), ("А", "С", "five", "5", "5.fb2")]
    got = found(spark, *rows)
    assert set(got) == {("А", "С", "1-5")} and got["А", "С", "1-5"].paths == ["all.fb2", "5.fb2"] and got["А", "С", "1-5"].dropped == ["2.fb2", "p.fb2"]
    rows = [("А", "С", "x", "", "x.fb2"), ("А", "С", "y", "2", "y.fb2"), ("Б", "С", "k", "", "k.fb2"), ("Б", "С", "j", "", "j.fb2"), ("Б", "С", "m", "1", "m.fb2")]
    got = found(spark, *rows)
    assert got["А", "С", "1-2"].paths == ["x.fb2", "y.fb2"] and got["Б", "С", ""].paths == ["j.fb2", "k.fb2"]


def test_ranges_dates_and_sections(spark):
    df = spark.createDataFrame([("1-3", "", ""), ("", "Меч (Сага 1-4)", ""), ("", "Меч 2-5", ""), ("", "", "Меч. Трилогия"), ("5", "Меч", "Меч"), ("7-2", "", "")], "n string, s string, t string")
    got = [r[0] and tuple(r[0]) for r in df.select(groups.bound_range(F.col("n"), F.col("s"), F.col("t"))).collect()]
    assert got == [(1, 3), (1, 4), (2, 5), (1, 3), None, None]
    assert values(spark, groups.year_of, "издание 1987 года", "120000", "") == [1987, None, None]
    assert values(spark, groups.date_of, '<date value="2001-05-02">май</date>', "<date>1999 г.</date>", "<p/>") == ["2001-05-02", "1999", None]
    xml = "<body><section><title><p>Том 1</p></title><section><title>Том 9</title>a</section></section><section>b</section><section><title>Книга 2</title></section></body>"
    got = values(spark, groups.sections, xml, "<x/>", "<body><section>open</body>")
    assert [(s["title"], s["volume"]) for s in got[0]] == [("Том 1", 1), ("", None), ("Книга 2", 2)] and got[1] == [] and got[2] == []
    assert "".join(s["text"] for s in got[0]) == xml[6:-7]
    assert tuple(values(spark, groups.content_range, xml)[0]) == (1, 9)
