"""Ancestor lookups: prefixes are exploded, so joins stay equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import NO_SERIES_FOLDERS


def ancestors(path: Column) -> Column:
    """The folders above a path, from the root down."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def nearest_to_root(files: DataFrame, folders: DataFrame, path: str, most_depth: int) -> DataFrame:
    """path, author: of the highest folder within the depth that has one."""
    e = files.select(path, F.posexplode(ancestors(F.col(path))).alias("depth", "folder")).filter(F.col("depth") < most_depth)
    return e.join(folders.select("folder", "author"), "folder").groupBy(path).agg(F.min_by("author", "depth").alias("author"))


def below_any(files: DataFrame, folders: DataFrame, path: str) -> DataFrame:
    """The files that lie below one of ``folders`` (folder), at any depth."""
    under = files.select(path, F.explode(ancestors(F.col(path))).alias("folder")).join(folders.select("folder").distinct(), "folder", "left_semi").select(path).distinct()
    return files.join(under, path, "left_semi")


def empty_folders(folders: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The folders of ``folders`` (folder) that no file lies below."""
    held = files.select(F.explode(ancestors(F.col(path))).alias("folder")).distinct()
    return folders.join(held, "folder", "left_anti")


def folder_tree(files: DataFrame, path: str) -> DataFrame:
    """folder, depth, n_files of every folder above the files."""
    e = files.select(F.posexplode(ancestors(F.col(path))).alias("depth", "folder"))
    return e.groupBy("folder").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_files"))


def series_below_author(path: Column, author: Column) -> Column:
    r"""The folders below the author's, joined by a backslash; '' below a folder
    that says there is no series."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    at = F.array_position(F.transform(parts, lambda x: F.lower(x)), F.lower(author))
    below = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int"))
    none = F.exists(below, lambda x: F.lower(x).isin(NO_SERIES_FOLDERS))
    return F.when((at == 0) | none, "").otherwise(F.array_join(below, "\\"))
