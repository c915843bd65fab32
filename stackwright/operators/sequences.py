"""Gaps, islands, keep-one windows and coverage over volume numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.volumes import strict_int

#: Numbers of a gap that are listed one by one.
LISTED_GAP = 1000


def series_gaps(df: DataFrame, least_books: int = 2) -> DataFrame:
    """author, series, have, missing: the volumes between the first and the
    last that a series lacks.  A blank author is one like any other.  Gaps come
    from the next volume, not from all numbers in between; one of more than
    ``LISTED_GAP`` numbers is shown as ``first-last``."""
    n = df.filter("series <> ''").select(F.coalesce("author", F.lit("")).alias("author"), "series", strict_int(F.col("series_number")).alias("v"))
    enough = n.groupBy("author", "series").agg(F.count(F.lit(1)).alias("books")).filter(F.col("books") >= least_books)
    ahead = F.lead("v").over(Window.partitionBy("author", "series").orderBy("v")) - 1
    steps = n.filter("v is not null").distinct().withColumn("hi", ahead).withColumn("lo", F.when(F.col("hi") > F.col("v"), F.col("v") + 1))
    text = F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    each = F.array_join(F.transform(F.sequence("lo", F.when(F.col("hi") - F.col("lo") < LISTED_GAP, F.col("hi")).otherwise(F.col("lo"))), lambda x: x.cast("string")), ", ")
    gap = F.when(F.col("lo").isNotNull(), F.struct("lo", F.when(F.col("hi") - F.col("lo") < LISTED_GAP, each).otherwise(text).alias("text")))
    g = steps.withColumn("gap", gap).groupBy("author", "series").agg(F.array_sort(F.collect_list("v")).alias("have"), F.array_sort(F.collect_list("gap")).alias("gaps")).filter(F.size("gaps") > 0)
    joined = lambda c, f: F.array_join(F.transform(c, f), ", ")
    return g.join(enough, ["author", "series"]).select("author", "series", "books", joined("have", lambda x: x.cast("string")).alias("have"), joined("gaps", lambda x: x["text"]).alias("missing"))


def keep_first(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def runs(df: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """key, run, lo, hi, n: islands of ranges that touch or overlap, by the
    running maximum of their ends."""
    w = Window.partitionBy(*key).orderBy(lo, hi)
    top = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col(lo) > top + 1), 1).otherwise(0)
    out = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*key, "run").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n"))


def _segments(first: Column, last: Column) -> Column:
    """array of struct(level, at): the aligned blocks of 2 ** level places that
    make up the places ``first`` to ``last``, at most two of each level."""
    levels = F.sequence(F.lit(0), F.floor(F.log2((last - first + 1).cast("double"))).cast("int"))

    def at(level):
        # What the levels below leave: from the first block that begins in the run to the last that ends in it.
        size = F.pow(F.lit(2.0), level)
        lo, hi = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long") - 1
        one = F.struct(level.cast("int").alias("level"), lo.alias("at"))
        two = F.struct(level.cast("int").alias("level"), hi.alias("at"))
        left, right = (lo % 2 != 0) & (lo <= hi), (hi % 2 == 0) & (lo <= hi)
        return F.filter(F.array(F.when(left, one), F.when(right, two)), lambda x: x.isNotNull())

    return F.flatten(F.transform(levels, at))


def covered(df: DataFrame, key: list[str], lo: str, hi: str, path: str) -> DataFrame:
    """key, path, keeper: ranges that another one of their key holds (of the
    widest, the last by path keeps; an equal range keeps from an earlier path).

    Members are never paired.  Only ranges that no other holds can keep a
    narrower one; in the order of their starts they are in that of their ends
    too, so those that hold a range are neighbours, found by two running counts.
    The widest of them comes from aligned blocks of neighbours, so rows grow with
    the ranges times a logarithm."""
    k = [f"__k{i}" for i in range(len(key))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(key, k)], F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi"), F.col(path).alias("path"))
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*k, "lo", "hi"]))
    # The places of a key's ranges by their starts; the widest of a start holds its others.
    ranges = rows.groupBy(*k, "lo", "hi").agg(F.max("path").alias("last"))
    by_lo = Window.partitionBy(*k).orderBy("lo", F.desc("hi"))
    before = F.max("hi").over(by_lo.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("top", before.isNull() | (F.col("hi") > before))
    to = F.count_if("top").over(by_lo.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("to", to)
    # Tops that end before: their count is the place of the first that doesn't.
    by_hi = Window.partitionBy(*k).orderBy("hi").rangeBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("from", F.coalesce(F.count_if("top").over(by_hi), F.lit(0)))
    marked = marked.withColumn("n", F.count_if("top").over(Window.partitionBy(*k)))
    best = F.max(F.struct((F.col("hi") - F.col("lo")).alias("width"), F.col("last").alias("keeper"))).alias("best")
    place, top_level = F.col("to") - 1, F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    blocks = marked.filter("top").select(*k, "lo", "hi", "last", place.alias("place"), F.explode(F.sequence(F.lit(0), top_level)).alias("level"))
    blocks = blocks.withColumn("at", F.floor(F.col("place") / F.pow(F.lit(2.0), "level")).cast("long")).groupBy(*k, "level", "at").agg(best)
    inner = marked.filter("NOT top").select(*k, "lo", "hi", F.explode(_segments(F.col("from"), F.col("to") - 1)).alias("s"))
    wider = inner.select(*k, "lo", "hi", "s.level", "s.at").join(blocks, [*k, "level", "at"]).groupBy(*k, "lo", "hi").agg(F.max("best").alias("best"))
    # An earlier path of the same range, where no wider one holds it.
    own = rows.distinct().withColumn("earlier", F.lag("path").over(Window.partitionBy(*k, "lo", "hi").orderBy(F.asc_nulls_first("path"))))
    same = F.when(F.col("earlier").isNotNull(), F.struct((F.col("hi") - F.col("lo")).alias("width"), F.col("earlier").alias("keeper")))
    found = own.join(wider, [*k, "lo", "hi"], "left").withColumn("best", F.coalesce("best", same)).filter("best IS NOT NULL")
    out = found.groupBy(*k, "path").agg(F.max("best").alias("best"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(key, k)], F.col("path").alias(path), F.col("best.keeper").alias("keeper"))


def run_statistics(df: DataFrame, key: list[str], lo: str, hi: str) -> DataFrame:
    """key, lo, hi, n_volumes: the volumes of all ranges, by the lengths of their
    islands, so a wide range costs no more than a narrow one."""
    islands = runs(df, key, lo, hi)
    return islands.groupBy(*key).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.sum(F.col(hi) - F.col(lo) + 1).alias("n_volumes"))


def lone_first_volume(df: DataFrame, key: list[str], position: str) -> DataFrame:
    """The only book of a group without a position is volume 1 if the others
    begin at 2 or later."""
    group = Window.partitionBy(*key)
    unknown = F.count_if(F.isnull(position)).over(group)
    first = F.isnull(position) & (unknown == 1) & (F.min(position).over(group) >= 2)
    return df.withColumn(position, F.when(first, 1).otherwise(F.col(position)))
