"""Shared pieces: staging through the cluster's shared folder, Arrow batches
as flat byte arrays, and vectorised word splitting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word class ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
#: Bytes in the Arrow batches that workers get (one longer row makes a batch).
BATCH_BYTES = str(4 << 20)
TIDY_BYTES = 32 << 20


def stage_root(spark: SparkSession) -> str:
    """The folder all executors share.  Only where a local session names none
    (as in tests on one machine) a temporary one is made and named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stackwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage
    ends there, and a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``staged`` has written, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "staged_at", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` on batches of bounded bytes: texts differ in length by
    orders of magnitude, so a bound on rows alone doesn't bound memory."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so extra ones can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _store() -> dict:
    return sys.modules.setdefault("_stackwright_worker", types.ModuleType("_stackwright_worker")).__dict__


def working_on(operator: str) -> None:
    """A Python worker serves one operator after another: what it keeps for
    the last one goes."""
    store = _store()
    if store.get("operator") != operator:
        store.clear()
        store["operator"] = operator
    tidy()


def tidy(after: int = 0) -> None:
    """Gives memory that is free back to the machine, which a worker's two
    allocators would hold.  With ``after``, bytes just worked on, only once so
    many as ``TIDY_BYTES`` have come together: what is given back must be got again."""
    if after:
        store = _store()
        store["worked"] = store.get("worked", 0) + after
        if store["worked"] < TIDY_BYTES:
            return
        store["worked"] = 0
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def kept_in_worker(key: str, make):
    """A value made once in each Python worker process."""
    store = _store()
    if key not in store:
        store[key] = make()
    return store[key]


# --- Arrow strings as byte arrays -------------------------------------------------------


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets (rows + 1).
    A null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes (a longer row is alone):
    first row, end row, their bytes, their offsets."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# --- words ------------------------------------------------------------------------------

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def lut(inside: bytes = b"", outside: bytes | None = None) -> np.ndarray:
    """Which of the 256 bytes belong to a word."""
    out = np.zeros(256, bool)
    if outside is not None:
        out[:] = True
        out[list(outside)] = False
    out[list(inside)] = True
    return out


WORD_BYTES = lut(outside=SPACES)
LINE_BYTES = lut(outside=b"\n")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM_BYTES = lut(inside=b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))


def fold_ascii() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def _letters(lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return values[fold_ascii()] if lower else values


_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i below n."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    with np.errstate(over="ignore"):
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done += more
            step = step * step % (1 << 64)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE_BYTES + 1 if n <= SLICE_BYTES + 1 else 1 << int(n).bit_length()
    return kept_in_worker(f"powers-{size}", lambda: (_powers(_P, size), _powers(_P_INV, size)))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and each row's first word
    (rows + 1).  A word ends with its row."""
    m = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1] | edge[1:-1]
    end[:-1] &= ~m[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal in every process and machine."""
    up, down = powers(len(data) + 1)
    letters = kept_in_worker(f"letters-{lower}", lambda: _letters(lower))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * up[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` consecutive values (len - width + 1)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        q = 1
        for i in range(width):
            out += h[i : i + n] * np.uint64(q)
            q = q * 0xD1B54A32D192ED03 % (1 << 64)
        return mix64(out)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """For n items with each row's first item: the row of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null ids count as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds

