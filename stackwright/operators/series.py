"""Series by file name and metadata, and their one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.people import words_of
from ..functions.predicates import contains_any
from ..functions.text import fold
from ..staging import cut
from ..vocabulary import FILENAME_BLACKLIST
from .authors import RECORD, file_stem, records
from .patterns import match_patterns


def _by_blocks(block: Column, pattern: Column, score: Column, metadata: Column) -> Column:
    """What the best pattern's series blocks tell, given the metadata's series:
    all levels if it is the same, a deeper level, or the pattern names levels; the
    top one if it is that, or without metadata; if it is another, the pattern must
    fit closely.  Null if nothing is told."""
    told, meta = S.levels(block), F.when(~contains_any(metadata, FILENAME_BLACKLIST), S.levels(metadata))
    parts, deep, root = F.split(fold(told), r"\\"), F.lower(pattern).contains("subseries"), F.substring_index(told, "\\", 1)
    blank = F.coalesce(meta, F.lit("")) == ""
    same, among = fold(meta) == fold(told), F.array_contains(parts, fold(meta))
    answer = (
        F.when(blank, F.when(deep, told).otherwise(root)).when(same, told)
        .when(among, F.when((F.get(parts, 0) == fold(meta)) & ~deep, root).otherwise(told)).when(score >= 0.85, F.when(deep, told).otherwise(root))
    )
    return F.when(pattern.contains("Series") & S.is_series(block) & (told != ""), F.nullif(answer, F.lit("")))


def series_from_file_names(df: DataFrame, given: list[str] = ()) -> DataFrame:
    """Records without a series take the one their file's name tells: two
    numbered levels that the metadata confirm, then the best pattern's blocks,
    then simpler rules; else the metadata's.  A name that a pattern without
    series fits, and that counts no volumes, tells none.  What is only the title
    or the author, and nothing confirms, is no series."""
    df = records(df)
    rows = match_patterns(df.withColumn("name", S.parsed_name(file_stem(F.col("file_path")))), "name", known_names=list(given))
    rows = cut(rows.drop("author").withColumnRenamed("series", "block"))
    name, meta = F.col("name"), F.trim("metadata_series")
    plain = F.col("best_pattern").isNotNull() & ~F.col("best_pattern").contains("Series")
    numbered = name.rlike(r"\s+\d+(?:[-–—]\d+)?\s*$|\s+\d+\.\s+\S")
    levels = S.two_levels(name, meta)
    by_rules = F.when(~plain | numbered, F.nullif(S.told_by_name(name), F.lit("")))
    rows = cut(rows.withColumns({"levels": levels, "blocks": _by_blocks(F.col("block"), F.col("best_pattern"), F.col("best_score"), meta), "rules": by_rules}))
    raw = F.coalesce("levels", "blocks", "rules")
    rows = rows.withColumn("found", F.when(F.coalesce("levels", F.when(F.col("blocks").contains("\\"), F.col("blocks"))).isNotNull(), raw).otherwise(S.clean(raw)))
    found, title = F.col("found"), fold(F.trim("file_title"))
    confirmed = (meta != "") & (fold(S.clean(meta)) == fold(found))
    only_title = (title != "") & (fold(found) == title) & ~confirmed & ~numbered
    only_author = fold(found) == fold(F.trim("proposed_author"))
    good = found.isNotNull() & (found != "") & ~only_title & ~only_author
    use_meta = ~F.coalesce(good, F.lit(False)) & (meta != "") & S.is_series(meta)
    open_ = (F.col("proposed_series") == "") & (F.col("series_source") != "no_series_folder")
    return rows.withColumns({
        "proposed_series": F.when(open_ & good, found).when(open_ & use_meta, S.clean(meta)).otherwise(F.col("proposed_series")),
        "series_source": F.when(open_ & good, F.when(confirmed, "filename+meta_confirmed").otherwise("filename")).when(open_ & use_meta, "metadata").otherwise(F.col("series_source")),
        "extracted_series_candidate": F.coalesce("rules", "block", "extracted_series_candidate"),
    }).select(*RECORD)


def normalise_series(df: DataFrame) -> DataFrame:
    """Every series in its normal form, without a prefix that a folder has."""
    s = F.col("proposed_series")
    return df.withColumn("proposed_series", F.when(s == "", s).otherwise(S.without_folder_prefix(S.normal(s), F.col("file_path"))))


def numbered_children(df: DataFrame) -> DataFrame:
    r"""A flat series of an author who also has ``Series N\Sub`` gets the number
    that its file's name has behind it."""
    key = lambda c: F.trim(F.regexp_replace(c, r"\s+\d{1,4}$", ""))
    root = F.substring_index("proposed_series", "\\", 1)
    parents = df.filter(F.col("proposed_series").contains("\\") & root.rlike(r"\s\d{1,4}$")).select(F.col("proposed_author").alias("_a"), key(root).alias("_root")).distinct()
    rows = df.join(parents, (F.col("proposed_author") == F.col("_a")) & (F.col("proposed_series") == F.col("_root")), "left")
    stem = file_stem(F.col("file_path"))
    at = F.position(F.concat("_root", F.lit(" ")), stem)
    number = F.regexp_extract(F.substr(stem, at + F.char_length("_root")), r"^\s+(\d{1,4})\.", 1)
    hit = F.col("_root").isNotNull() & (at > 0) & (number != "")
    return rows.withColumn("proposed_series", F.when(hit, F.concat_ws(" ", "proposed_series", number)).otherwise(F.col("proposed_series"))).select(*df.columns)


def umbrella_folders(df: DataFrame, folder: Column, own: Column) -> DataFrame:
    """Where a folder's files tell two series or more of their own, each in two
    files, those replace the folder's series."""
    rows = df.withColumns({"_f": folder, "_own": own})
    each = rows.filter("_own <> ''").groupBy("_f", "_own").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    many = each.groupBy("_f").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("_f")
    split = each.join(many, "_f", "left_semi").select("_f", "_own", F.lit(True).alias("_split"))
    rows = rows.join(split, ["_f", "_own"], "left")
    return rows.withColumn("proposed_series", F.when(F.col("_split"), F.col("_own")).otherwise(F.col("proposed_series"))).select(*df.columns)


def word_overlap(a: Column, b: Column) -> Column:
    """The share of the first's words that the second has."""
    mine = F.array_distinct(words_of(fold(a)))
    return F.size(F.array_intersect(mine, words_of(fold(b)))) / F.greatest(F.size(mine), F.lit(1))
