"""Ending the lineage of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the folder that all executors share
    (``spark.checkpoint.dir``) and read back, so that plans stay small and a lost
    executor costs no recomputation of what is above.  Only a local session that
    names no folder, as in tests, gets a temporary one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="stackwright-")
        sc.setCheckpointDir(root)
    return df.checkpoint()
