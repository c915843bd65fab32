"""Groups of volumes that can be bound into one book.

Books of one author and series are put in order, doubles and what a wider
compilation holds are set aside, and each island of volumes without a gap is a
group.  Ranges are compared by their ends and never listed number by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_key, logical_stem, title_key
from ..functions.volumes import inline_volume, number_prefix, series_suffix, volume_range
from ..vocabulary import COMPILATION_WORDS


def year_of(c: Column) -> Column:
    """The first year from 1800 to 2099 that stands by itself, or null."""
    return F.nullif(F.regexp_extract(c, r"(?<!\d)((?:18|19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")


def date_of(xml: Column) -> Column:
    """A book's date: the value of its date tag, else the year in it."""
    tag = F.regexp_extract(xml, r"(?is)<(?:fb:)?date\b([^>]*)>", 1)
    said = F.nullif(F.regexp_extract(tag, r"value\s*=\s*[\"'](\d{4}(?:-\d{2}(?:-\d{2})?)?)", 1), F.lit(""))
    return F.coalesce(said, year_of(F.regexp_extract(xml, r"(?is)<(?:fb:)?date\b[^>]*>(.*?)</(?:fb:)?date>", 1)).cast("string"))


def bound_range(number: Column, stem: Column, title: Column) -> Column:
    """struct(lo, hi) of the volumes that a book binds, from the first that
    tells: its number, brackets in its file's name or title, ``lo-hi`` at the end
    of either, the count that a word such as ``трилогия`` stands for; else null."""
    count = F.coalesce(*[F.when(F.lower(F.concat_ws(" ", stem, title)).contains(w), F.lit(n)) for w, n in COMPILATION_WORDS.items() if n])
    inside, end = r"\((?:[^()]*\s)?(\d{1,3})\s*[-–—]\s*(\d{1,3})\)", r"(?<![\d.])(\d{1,3})\s*[-–—]\s*(\d{1,3})\s*$"
    by_number = _pair(F.trim(number), r"^(\d{1,4})\s*[-–—]\s*(\d{1,4})$")
    word = F.when(count.isNotNull(), F.struct(F.lit(1).cast("long").alias("lo"), count.cast("long").alias("hi")))
    return F.coalesce(by_number, _pair(stem, inside), _pair(title, inside), _pair(stem, end), _pair(title, end), word)


def _pair(c: Column, pattern: str) -> Column:
    lo, hi = (F.regexp_extract(c, pattern, i).try_cast("long") for i in (1, 2))
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def content_range(xml: Column) -> Column:
    """struct(lo, hi) of the volume numbers that the titles of a book's sections
    have, if they are two or more; else null."""
    titles = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:fb:)?title\b[^>]*>(.*?)</(?:fb:)?title>"), F.lit(1))
    numbers = F.filter(F.transform(titles, lambda t: inline_volume(F.regexp_replace(t, "<[^>]+>", " "))), lambda n: n.isNotNull())
    return F.when(F.size(F.array_distinct(numbers)) >= 2, F.struct(F.array_min(numbers).cast("long").alias("lo"), F.array_max(numbers).cast("long").alias("hi")))


def positions(df: DataFrame) -> DataFrame:
    """``df`` (author, series, title, series_number, file_path) with lo, hi (null
    where nothing tells), bound (more than one volume), and the group's keys."""
    stem = logical_stem(F.col("file_path"))
    wide = bound_range(F.col("series_number"), stem, F.col("title"))
    one = F.coalesce(volume_range(F.col("series_number"))["lo"], number_prefix(stem), inline_volume(F.col("title"))).cast("long")
    rows = df.filter("trim(author) <> '' AND trim(series) <> ''").withColumns({"_a": group_key(F.col("author")), "_s": group_key(F.col("series")), "_w": wide, "_one": one})
    return rows.withColumns({"lo": F.coalesce("_w.lo", "_one"), "hi": F.coalesce("_w.hi", "_one"), "bound": F.col("_w").isNotNull()}).drop("_w", "_one")


def kept_books(rows: DataFrame) -> DataFrame:
    """The rows with ``drop``: why a book is left out, '' for those that stay.
    A title counts once, at its latest year; a volume that a wider bound book
    holds goes, the widest stays; a position counts once."""
    group = ["_a", "_s"]
    title = title_key(F.col("title"))
    first = F.row_number().over(Window.partitionBy(*group, "_t").orderBy(F.desc(F.coalesce(year_of(F.col("title")), F.lit(0))), "file_path"))
    rows = rows.withColumn("_t", title).withColumn("_rn", first)
    rows = rows.withColumn("drop", F.when((F.col("_rn") > 1) & (F.col("_t") != ""), "title").otherwise("")).drop("_rn", "_t")
    # The furthest end of a bound book that begins no later and is wider or earlier by path.
    live = F.when((F.col("drop") == "") & F.col("bound"), F.col("hi"))
    ahead = Window.partitionBy(*group).orderBy(F.asc_nulls_last("lo"), F.desc_nulls_last("hi"), "file_path").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max(live).over(ahead))
    rows = rows.withColumn("drop", F.when((F.col("drop") == "") & F.col("hi").isNotNull() & (F.col("_reach") >= F.col("hi")), "bound").otherwise(F.col("drop"))).drop("_reach")
    same = F.row_number().over(Window.partitionBy(*group, "lo", "hi", "drop").orderBy("file_path"))
    return rows.withColumn("_rn", same).withColumn("drop", F.when((F.col("drop") == "") & F.col("lo").isNotNull() & (F.col("_rn") > 1), "position").otherwise(F.col("drop"))).drop("_rn")


def volume_groups(df: DataFrame, least: int = 2) -> DataFrame:
    """author, series, n_books, volumes (``lo-hi``, '' if books without a number
    are among them), paths (in order), dropped (paths), complete (from volume 1
    on), suffix (what the bound book is called) of each island of ``least`` books
    or more.  The only book without a number is volume 1 if the others begin
    later; more of them make one group by title, without numbers."""
    group = ["_a", "_s"]
    rows = kept_books(positions(df))
    everyone = Window.partitionBy(*group)
    unknown = F.isnull("lo") & (F.col("drop") == "")
    alone = unknown & (F.count_if(unknown).over(everyone) == 1) & (F.min("lo").over(everyone) >= 2)
    rows = rows.withColumn("_alone", alone)
    rows = rows.withColumns({"lo": F.when(F.col("_alone"), F.lit(1).cast("long")).otherwise(F.col("lo")), "hi": F.when(F.col("_alone"), F.lit(1).cast("long")).otherwise(F.col("hi"))}).drop("_alone")
    live = rows.filter("drop = ''")
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_last("lo"), "hi", "file_path")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("_new", F.when(F.isnull("lo"), 0).when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0)).withColumn("_run", F.when(F.isnull("lo"), -1).otherwise(F.sum("_new").over(order)))
    book = F.struct(F.coalesce("lo", F.lit(2**31)).alias("lo"), F.lower("title").alias("title"), "file_path")
    found = live.groupBy(*group, "_run").agg(
        F.min_by("author", "file_path").alias("author"), F.min_by("series", "file_path").alias("series"), F.count(F.lit(1)).alias("n_books"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.transform(F.array_sort(F.collect_list(book)), lambda b: b["file_path"]).alias("paths"))
    gone = rows.filter("drop <> ''").groupBy(*group).agg(F.array_sort(F.collect_list("file_path")).alias("dropped"))
    out = found.filter(F.col("n_books") >= least).join(gone, group, "left")
    told = F.col("lo").isNotNull()
    text = F.when(told, F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))).otherwise("")
    complete = F.coalesce(F.col("lo") == 1, F.lit(False))
    suffix = F.when(told, series_suffix(F.col("lo"), F.col("hi"), F.col("hi") - F.col("lo") + 1, complete)).otherwise("")
    return out.select("author", "series", "n_books", text.alias("volumes"), "paths", F.coalesce("dropped", F.array().cast("array<string>")).alias("dropped"), complete.alias("complete"), suffix.alias("suffix"))


def sections(xml: Column) -> Column:
    """The top sections of a book's first body: array of struct(title, volume,
    text).  Tags are read in turn and their depth counted, so nested sections
    stay inside."""
    body = F.regexp_extract(xml, r"(?is)<(?:fb:)?body\b[^>]*>(.*?)</(?:fb:)?body>", 1)
    parts = F.regexp_extract_all(body, F.lit(r"(?is)<(?:fb:)?section\b[^>]*>|</(?:fb:)?section>|(?:(?!</?(?:fb:)?section\b).)+"), F.lit(0))
    opens, closes = (lambda p: p.rlike(r"(?i)^<(?:fb:)?section\b")), (lambda p: p.rlike(r"(?i)^</(?:fb:)?section>"))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        depth = a["depth"] + F.when(opens(p), 1).when(closes(p), -1).otherwise(0)
        now = F.when((a["depth"] > 0) | opens(p), F.concat(a["now"], p)).otherwise("")
        ended = closes(p) & (a["depth"] == 1)
        return F.struct(F.greatest(depth, F.lit(0)).alias("depth"), F.when(ended, "").otherwise(now).alias("now"), F.when(ended, F.array_append(a["done"], now)).otherwise(a["done"]).alias("done"))

    tops = F.aggregate(parts, start, step, lambda a: a["done"])
    title = lambda s: F.trim(F.regexp_replace(F.regexp_extract(s, r"(?is)^<[^>]*>\s*<(?:fb:)?title\b[^>]*>(.*?)</(?:fb:)?title>", 1), r"<[^>]+>|\s+", " "))
    return F.transform(tops, lambda s: F.struct(title(s).alias("title"), inline_volume(title(s)).alias("volume"), s.alias("text")))
