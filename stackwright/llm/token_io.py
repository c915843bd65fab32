"""Token ids in ORC files.

Documents are dealt by ranges of their ids and sorted, so a file holds a range
and the files follow one another.  ``ids`` is an integer list, which ORC packs
with its integer run-length encoding; each stripe can be read by itself, and
its row indexes and the Bloom filter on ``doc_id`` let a reader of a few
documents skip stripes and row groups by metadata alone.  The place of a
document among all ids is its file's base plus ``at`` in the file.

Defined results: a null text is empty; every document ends with the end id;
rows with a null id come first; repeated ids follow in an order by text; an
empty table gives no document.  Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, map_arrow, plain, slices, stage_path, table, tidy, working_on
from .encoding import CHUNKS, PIECES, SLICE, Encoder, shipped

END_ID = 0
FILE_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, stripe_bytes: int = 64 << 20, index_stride: int = 1000, chunks: int = CHUNKS, pieces: int = PIECES) -> None:
    """Writes the ids of ``docs`` (doc_id, text) as ORC files under ``path``.
    Workers remember as many ``chunks`` and ``pieces``: fewer take less memory and
    more time, and give the same ids."""
    shared = shipped(docs.sparkSession, tokenizer_path)

    def encode(batches):
        working_on("encoding")
        encoder, part, at = Encoder.of(shared, chunks, pieces), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, data, offsets in slices(*buffers(batch.column("text")), most=SLICE):
                ids, n = encoder.encode_rows(data, offsets)
                n = n + 1
                flat = np.full(int(n.sum()), end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[np.cumsum(n) - 1] = False
                flat[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
                before = at + np.concatenate([[0], np.cumsum(n)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(before), pa.array(n), lists], names=["doc_id", "part", "at", "n_tokens", "ids"]
                )
                at += int(n.sum())
            tidy(batch.nbytes)

    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = [F.col("doc_id"), F.xxhash64("text")]  # rows of one id may be dealt to several files
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(index_stride)}
    map_arrow(rows, encode, FILE_SCHEMA).write.options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    return _with_start(files, spark, path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    # The sums of the files: a row each.
    sums = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("at"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("at"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE_SCHEMA).orc(path)
    rows = map_arrow(files, digest, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return _with_start(rows, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
