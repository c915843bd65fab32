"""Votes within groups, and the corrections that follow from them.

Votes are counted per value before any window, so a group of any size is summed
map-side first; ties go to the value that was first seen by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import UNKNOWN_AUTHOR


def vote(df: DataFrame, group: list[str], value: str, first: str, pool: Column | None = None) -> DataFrame:
    """group, winner, votes, voters, n_values: the most frequent value."""
    votes = df.filter(F.col(value) != "")
    if pool is not None:
        votes = votes.filter(pool)
    counts = votes.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("seen"))
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "seen", value))
    everyone = Window.partitionBy(*group)
    ranked = counts.withColumns({"rn": best, "voters": F.sum("n").over(everyone), "n_values": F.count(F.lit(1)).over(everyone)})
    return ranked.filter("rn = 1").select(*group, F.col(value).alias("winner"), F.col("n").alias("votes"), "voters", "n_values")


def majority(df: DataFrame, group: list[str], value: str, first: str, share: float) -> DataFrame:
    """The winners that hold at least ``share`` of their group's votes."""
    return vote(df, group, value, first).filter(F.col("votes") >= share * F.col("voters"))


def apply_vote(df: DataFrame, winners: DataFrame, group: list[str], value: str, source: str, weak: Column, label: str) -> DataFrame:
    """Weak rows take their group's winner and name its source."""
    w = winners.select(*group, "winner")
    change = weak & F.col("winner").isNotNull() & (F.col("winner") != F.col(value))
    out = df.join(w, group, "left").withColumn("__c", F.coalesce(change, F.lit(False)))
    return out.withColumns({source: F.when(F.col("__c"), label).otherwise(F.col(source)), value: F.when(F.col("__c"), F.col("winner")).otherwise(F.col(value))}).drop("winner", "__c")


def first_donor(df: DataFrame, group: list[str], value: str, first: str, donors: Column) -> DataFrame:
    """group, donor: the value of the first donating row."""
    return df.filter(donors & (F.col(value) != "")).groupBy(*group).agg(F.min_by(value, first).alias("donor"))


def clear_singletons(df: DataFrame, key: list[str], value: str, confirmed: Column) -> DataFrame:
    """Clears a value that its key has once only and nothing confirms."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(n, key).withColumn(value, F.when((F.col("__n") == 1) & ~confirmed, "").otherwise(F.col(value))).drop("__n")


def clear_multi_author_folders(df: DataFrame, folder: str, author: str, series: str, collective: list[str], source: str | None = None) -> DataFrame:
    """Clears a series, and its ``source``, that is part of the name of a folder
    of several known authors; names under four letters are none."""
    real = F.count_distinct(F.when(~F.col(author).isin("", UNKNOWN_AUTHOR, *collective), F.col(author)))
    several = df.groupBy(folder).agg(real.alias("__real"), F.bool_or(F.col(author).isin(collective)).alias("__coll"))
    mixed = (F.col("__real") > 1) | (F.col("__coll") & (F.col("__real") > 0))
    name = F.element_at(F.split(F.translate(folder, "\\", "/"), "/"), -1)
    hit = mixed & (F.char_length(name) >= 4) & (F.col(series) != "") & F.lower(name).contains(F.lower(series))
    cleared = {c: F.when(hit, "").otherwise(F.col(c)) for c in (series, source) if c}
    return df.join(several, folder).withColumns(cleared).drop("__real", "__coll")


def widen_by_subset(df: DataFrame, winners: DataFrame, group: list[str], value: str) -> DataFrame:
    """Takes the winner where the present words are a proper part of its."""
    words = lambda c: F.split(F.lower(c), " ")
    inside = (F.size(F.array_except(words(F.col(value)), words(F.col("winner")))) == 0) & (F.size(words(F.col("winner"))) > F.size(words(F.col(value))))
    return df.join(winners.select(*group, "winner"), group, "left").withColumn(value, F.when(inside, F.col("winner")).otherwise(F.col(value))).drop("winner")


def longest_with_suffix(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, longest: the longest value of the group that ends with
    it.  Ends are exploded, so values meet by equality and not in pairs."""
    v = df.filter(F.col(value) != "").select(*group, value).distinct()
    ends = F.transform(F.sequence(F.lit(1), F.char_length(value)), lambda i: F.substr(F.col(value), i))
    best = v.select(*group, F.col(value).alias("__other"), F.explode(ends).alias("__end")).groupBy(*group, "__end").agg(F.max(F.struct(F.char_length("__other").alias("n"), F.col("__other").alias("other"))).alias("m"))
    return v.join(best.withColumnRenamed("__end", value), [*group, value]).select(*group, value, F.col("m.other").alias("longest"))


def confirmed_phrases(df: DataFrame, group: list[str], stem: str, evidence: str, least_words: int = 2, least_rows: int = 2) -> DataFrame:
    """group, phrase, n: leading word runs that several stems share and a row's
    evidence confirms; the longest of each group."""
    words = F.split(F.trim(F.col(stem)), r"\s+")
    runs = F.when(F.size(words) >= least_words, F.transform(F.sequence(F.lit(least_words), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " ")))
    every = df.select(*group, F.explode(runs).alias("phrase")).groupBy(*group, "phrase").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_rows)
    said = df.select(*group, F.col(evidence).alias("phrase")).distinct()
    best = every.join(said, [*group, "phrase"]).groupBy(*group).agg(F.max(F.struct(F.char_length("phrase").alias("l"), "phrase", "n")).alias("m"))
    return best.select(*group, "m.phrase", "m.n")


def unify_hierarchy(df: DataFrame, author: str, series: str) -> DataFrame:
    r"""``A. B`` becomes ``A\B`` where the author also has ``A``."""
    bases = df.select(F.col(author).alias("__a"), F.col(series).alias("__b")).filter("__b <> ''").distinct()
    root = F.substring_index(series, ". ", 1)
    out = df.join(bases, (F.col(author) == F.col("__a")) & (root == F.col("__b")) & F.col(series).contains(". "), "left")
    return out.withColumn(series, F.when(F.col("__b").isNotNull(), F.concat("__b", F.lit("\\"), F.substr(F.col(series), F.char_length("__b") + 3))).otherwise(F.col(series))).drop("__a", "__b")
