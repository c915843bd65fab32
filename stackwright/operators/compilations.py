"""Compilations of volumes: what a book covers, what it replaces, and which
buckets of books belong together.

Coverage is compared as ranges, never as lists of volumes, so a wide range costs
no more than a narrow one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..staging import cut
from ..vocabulary import COMPILATION_WORDS, SERIES_SIZES

_RANGE = r"^(\d+)\s*[-–]\s*(\d+)$"
_BRACKETS = r"\(\s*(\d+)\s*[-–]\s*(\d+)\s*\)"


def _int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("bigint")


def _kind(kind: str, lo: Column, hi: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def classify(path: Column, title: Column, series_number: Column) -> Column:
    """struct(kind, lo, hi): compilation (of lo to hi, null if unknown),
    single, or unknown."""
    number, title = F.trim(F.coalesce(series_number, F.lit(""))), F.coalesce(title, F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")
    both, nothing = F.lower(F.concat_ws(" ", stem, title)), F.lit(None)
    out = F.when(number.rlike(_RANGE), _kind("compilation", _int(number, _RANGE), _int(number, _RANGE, 2)))
    out = out.when(both.rlike(_BRACKETS), _kind("compilation", _int(both, _BRACKETS), _int(both, _BRACKETS, 2)))
    for word, n in COMPILATION_WORDS.items():
        out = out.when(both.contains(word), _kind("compilation", F.lit(1), F.lit(n)) if n else _kind("compilation", nothing, nothing))
    out = out.when(F.regexp_count(title, F.lit(r"\.\s+[А-ЯЁA-Z]")) >= 2, _kind("compilation", nothing, nothing))
    out = out.when(number.rlike(r"^\d+$"), _kind("single", number.try_cast("bigint"), number.try_cast("bigint")))
    inner = _int(stem, r"[-–\s](\d{1,3})\.\s+[А-ЯЁA-Z]")
    return out.when(inner.isNotNull(), _kind("single", inner, inner)).otherwise(_kind("unknown", nothing, nothing))


def replaced_by_compilations(df: DataFrame, path: str = "file_path") -> DataFrame:
    """The paths of single volumes that a compilation of their author and series
    covers, or that stand beside compilations of unknown extent only."""
    rows = df.filter("trim(author) <> '' AND trim(series) <> ''").select(
        F.lower(F.trim("author")).alias("a"), F.lower(F.trim("series")).alias("s"), F.col(path), classify(F.col(path), F.col("title"), F.col("series_number")).alias("k"))
    spans = rows.filter("k.kind = 'compilation' AND k.lo <= k.hi").select("a", "s", "k.lo", "k.hi").distinct()
    open_only = rows.filter("k.kind = 'compilation'").groupBy("a", "s").agg(F.bool_and(F.coalesce(~F.expr("k.lo <= k.hi"), F.lit(True))).alias("open")).filter("open")
    single = rows.filter("k.kind = 'single'").select("a", "s", path, F.col("k.lo").alias("v"))
    covered = single.join(spans, ["a", "s"], "left_semi").select("a", "s", "v").distinct().join(spans, ["a", "s"]).filter("v BETWEEN lo AND hi").select("a", "s", "v").distinct()
    return single.join(covered, ["a", "s", "v"], "left_semi").select(path).unionByName(single.join(open_only, ["a", "s"], "left_semi").select(path))


def service_word_ranges(df: DataFrame, key: list[str], text: str, position: str) -> DataFrame:
    """``df`` with lo, hi: 1 to n for a book that a word for n volumes names,
    where its group has all positions from 1 to n; else null."""
    words = {w.lower(): n + 1 for n, w in enumerate(SERIES_SIZES) if w}
    low = F.lower(text)
    first = F.regexp_extract(low, "(" + "|".join(words) + ")", 1)
    size = F.create_map(*[x for w, n in words.items() for x in (F.lit(w), F.lit(n))])
    known = df.filter(F.col(position).between(1, len(SERIES_SIZES))).groupBy(*key).agg(F.collect_set(F.col(position).cast("int")).alias("__known"))
    n = F.try_element_at(size, first)
    whole = F.size(F.array_except(F.sequence(F.lit(1), n), F.col("__known"))) == 0
    return df.join(known, key, "left").withColumns({"lo": F.when(whole, F.lit(1)), "hi": F.when(whole, n)}).drop("__known")


def outvoted_positions(df: DataFrame, key: list[str], position: str, source: str, stated: str) -> DataFrame:
    """Positions from file names give way to the stated number where more books
    of the group have theirs from metadata."""
    number = F.when(F.trim(stated).rlike(r"^\d{1,4}$"), F.trim(stated)).try_cast("int")
    votes = df.groupBy(*key).agg(
        F.count_if((F.col(source) == "series_number") & (F.col(position) > 0)).alias("__m"), F.count_if((F.col(source) == "filename") & number.isNotNull()).alias("__f"))
    turn = F.coalesce((F.col("__m") > F.col("__f")) & (F.col(source) == "filename") & number.between(1, 1899) & (number != F.col(position)), F.lit(False))
    out = df.join(votes, key).withColumn("__t", turn)
    return out.withColumns({position: F.when(F.col("__t"), number).otherwise(F.col(position)), source: F.when(F.col("__t"), "series_number").otherwise(F.col(source))}).drop("__m", "__f", "__t")


def titles_inside(df: DataFrame, key: list[str], path: str, title: str, position: str) -> DataFrame:
    """key, path, lo, hi: books whose title holds those of two or more other
    positions of their group, without a gap.  Only titles of several sentences,
    of files that don't begin with a digit, are searched."""
    t = fold(F.trim(F.col(title)))
    stem = F.element_at(F.split(path, r"[/\\]"), -1)
    long = df.filter(t.rlike(r"\.\s+[а-яa-z]") & ~stem.rlike(r"^\d")).select(*key, path, t.alias("__long"), F.col(position).alias("__own"))
    parts = df.filter((F.col(position) > 0) & (t != "")).select(*key, F.col(position).alias("__p"), t.alias("__t")).distinct()
    hit = long.join(parts, key).filter(F.col("__long").contains(F.col("__t")) & ~F.col("__p").eqNullSafe(F.col("__own")))
    g = hit.groupBy(*key, path).agg(F.min("__p").alias("lo"), F.max("__p").alias("hi"), F.count_distinct("__p").alias("n"))
    return g.filter("n >= 2 AND hi - lo + 1 = n").select(*key, path, "lo", "hi")


def merged_buckets(keys: DataFrame) -> DataFrame:
    """author, series, to_author, to_series for distinct ``keys`` (author,
    series, said: the series that metadata of the bucket name, all normalised).

    Two buckets merge where one author's words are among the other's and one
    series ends the other, not both alike; a series is only lengthened where the
    longer bucket's metadata say the shorter.  Buckets meet only under the same
    last word of the series, and each goes to the longest it may; this repeats
    until nothing changes.  Names only grow, up to the longest there is, so it ends."""
    words = lambda c: F.filter(F.split(F.regexp_replace(c, "[,;]", " "), r"\s+"), lambda w: w != "")
    ends = lambda a, b: (a == b) | b.endswith(F.concat(F.lit(" "), a))
    out = keys.select("author", "series", F.col("author").alias("to_author"), F.col("series").alias("to_series"), "said")
    while True:
        at = out.groupBy("to_author", "to_series").agg(F.array_distinct(F.flatten(F.collect_set("said"))).alias("said"))
        a = at.select(F.col("to_author").alias("a"), F.col("to_series").alias("s"), F.substring_index("to_series", " ", -1).alias("last"), F.col("said").alias("sa"))
        b = at.select(F.col("to_author").alias("b"), F.col("to_series").alias("t"), F.substring_index("to_series", " ", -1).alias("last"), F.col("said").alias("sb"))
        inside = lambda x, y: F.size(F.array_except(words(F.col(x)), words(F.col(y)))) == 0
        said = lambda who, short: F.exists(F.col(who), lambda x: ends(F.col(short), x))
        grow = ends(F.col("s"), F.col("t")) & ((F.col("s") == F.col("t")) | said("sb", "s"))
        shrink = ends(F.col("t"), F.col("s")) & (F.col("s") != F.col("t")) & said("sa", "t")
        same = inside("a", "b") & inside("b", "a")
        pair = a.join(b, "last").filter(((F.col("a") != F.col("b")) | (F.col("s") != F.col("t"))) & (inside("a", "b") | inside("b", "a")) & (grow | shrink) & ~(same & (F.col("s") == F.col("t"))))
        goal = F.struct(
            F.when(same, F.col("a")).when(inside("a", "b"), F.col("b")).otherwise(F.col("a")).alias("author"), F.when(grow, F.col("t")).otherwise(F.col("s")).alias("series"))
        size = F.char_length("g.author") + F.char_length("g.series")
        best = pair.select("a", "s", goal.alias("g")).groupBy("a", "s").agg(F.max_by("g", F.struct(size, "g.series", "g.author")).alias("g"))
        best = best.filter("g.author <> a OR g.series <> s")
        moved = out.join(best, (F.col("to_author") == F.col("a")) & (F.col("to_series") == F.col("s")), "left")
        new = moved.select("author", "series", F.coalesce("g.author", "to_author").alias("to_author"), F.coalesce("g.series", "to_series").alias("to_series"), "said", F.col("g").isNotNull().alias("moved"))
        new = cut(new)
        out = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return out.select("author", "series", "to_author", "to_series")
