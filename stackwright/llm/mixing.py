"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a seeded hash and laid end to end; the
stream is cut into blocks of equal token counts.  The mix is a sequence of
slots.  Slot ``i`` takes the van der Corput point of ``i``, which the cumulative
target weights map to a source; its rank among the slots of that source has a
closed form (a count of dyadic intervals), so no window over slots is needed.
Rank ``r`` takes block ``r mod blocks`` of pass ``r div blocks``.

Defined results: a null text has size 0; null is a source of its own, last in
order; a source without words gets no slot; repeated rows are separate
documents; an empty table gives an empty mix.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, plain, staged, table

#: Words in a block; slots of a source with fewer words take what there is.
BLOCK_TOKENS = 4096
#: Hash ranges in which a source's shuffled order is summed in parallel.
RANGES = 1024
MAX_REPEATS = 3
#: Up to here the table of sources (one row each) is broadcast.
BROADCAST_SOURCES = 50_000
_BITS = 44


@dataclass(frozen=True)
class Source:
    sid: int
    size: int
    weight: int
    target: float


def targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Shares ``sum(sizes)`` by weight.  A target stops at ``max_repeats``
    times its source's size; the excess is reshared by weight until none is
    above."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(max_repeats * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def radical_inverse(i: np.ndarray) -> np.ndarray:
    """Base-2 van der Corput points as integers of ``_BITS`` bits."""
    i = i.astype(np.int64)
    out = np.zeros_like(i)
    for k in range(_BITS):
        out |= ((i >> k) & 1) << (_BITS - 1 - k)
    return out


def points_below(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many of the first n points are below x: [0, n) falls into a dyadic
    run for each set bit of n, and the points of a run are evenly spaced."""
    n, x = np.broadcast_arrays(np.asarray(n, np.int64), np.asarray(x, np.int64))
    out = np.zeros(n.shape, np.int64)
    for k in range(_BITS):
        has = (n >> k) & 1 == 1
        shift = radical_inverse((n >> (k + 1)) << (k + 1))
        step = np.int64(1) << (_BITS - k)
        count = np.clip(-((shift - x) // step), 0, np.int64(1) << k)  # ceil((x - shift) / step)
        out += np.where(has, count, 0)
    return out


class Schedule:
    """Slots of all sources in the order of the mix."""

    def __init__(self, needed: list[int]):
        self.needed = np.asarray(needed, np.int64)
        self.slots = int(self.needed.sum())
        edges = [0]
        for c in np.cumsum(self.needed).tolist():
            edges.append((int(c) << _BITS) // max(1, self.slots))
        self.edges = np.asarray(edges, np.int64)
        reached = points_below(np.int64(self.slots), self.edges[1:]) - points_below(np.int64(self.slots), self.edges[:-1])
        self.reached = np.minimum(reached, self.needed)
        #: A source that the points have served short closes the mix with its last slots.
        self.closing = np.concatenate([[0], np.cumsum(self.needed - self.reached)])

    def __len__(self) -> int:
        return self.slots + int(self.closing[-1])

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and rank of each slot; rank -1 where the source has enough."""
        early = np.minimum(i, max(self.slots - 1, 0))
        x = radical_inverse(early)
        s = np.searchsorted(self.edges, x, "right") - 1
        rank = points_below(early, self.edges[s + 1]) - points_below(early, self.edges[s])
        rank = np.where(rank < self.needed[s], rank, -1)
        late = i - self.slots
        t = np.clip(np.searchsorted(self.closing, late, "right") - 1, 0, len(self.needed) - 1)
        return np.where(late >= 0, t, s), np.where(late >= 0, self.reached[t] + late - self.closing[t], rank)


def mix_sources(
    docs: DataFrame, weights=(1, 2, 3), block_tokens: int = BLOCK_TOKENS, max_repeats: int = MAX_REPEATS, seed: int = 17
) -> tuple[DataFrame, DataFrame]:
    """(places, pieces) of the mix of ``docs`` (doc_id, text, source).

    ``places`` has a row for each document: place (sid, part, rn), doc_id,
    size, source_size, target, start in its source's stream.  ``pieces`` are
    what the slots take: place, slot, pass_no, offset (first word, in the
    document), words.  ``weights`` repeat over the sources by code point, null
    last; the targets share the total of all sizes."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))  # rows that share an id are apart
    slim = staged(
        plain(docs, "doc_id", "source", "text").select(
            "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD_REGEX)), F.lit(0)).cast("long").alias("size"), h.alias("h")
        ),
        "mix-sizes",
    )
    # One row for each source comes to the driver.
    found = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r.n) for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], max_repeats)
    goal = [min(round(t), max_repeats * s) for t, s in zip(wanted, sizes)]
    blocks = [max(1, -(-s // block_tokens)) if s else 0 for s in sizes]
    needed = []
    for s, b, g in zip(sizes, blocks, goal):
        passes, rest = divmod(g, s) if s else (0, 0)
        needed.append(passes * b + -(-rest // block_tokens))
    schedule = Schedule(needed)
    info = spark.createDataFrame(
        [(i, r.source, s, t, b, g) for i, (r, s, t, b, g) in enumerate(zip(found, sizes, wanted, blocks, goal))],
        "sid int, of string, source_size long, target double, blocks long, goal long",
    )
    small = F.broadcast if len(found) <= BROADCAST_SOURCES else lambda x: x

    docs_ = slim.join(small(info), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    docs_ = docs_.withColumn("part", (F.shiftrightunsigned("h", 64 - (RANGES.bit_length() - 1))).cast("int"))
    order = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size")
    placed = docs_.withColumn("rn", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = docs_.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("sid", "part", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = placed.join(parts, ["sid", "part"]).withColumn("start", F.col("base") + F.coalesce("before", F.lit(0))).drop("before", "base")
    places = staged(places, "mix-places")

    def slots(batches):
        for frame in batches:
            i = frame["id"].to_numpy()
            s, rank = schedule.at(i)
            yield pd.DataFrame({"slot": i, "sid": s.astype(np.int32), "r": rank})[rank >= 0]

    n = len(schedule)
    slot = spark.range(0, n, 1, max(1, min(4096, n // 50_000))).mapInPandas(slots, "slot long, sid int, r long")
    slot = slot.join(small(info.select("sid", "source_size", "blocks", "goal")), "sid")
    slot = slot.withColumns({"pass_no": F.expr("r div blocks"), "block": F.expr("r % blocks")})
    a = F.col("block") * block_tokens
    slot = slot.withColumns({"a": a, "z": F.least(a + block_tokens, F.col("source_size"), F.col("goal") - F.col("pass_no") * F.col("source_size"))})
    slot = slot.filter("z > a").select("sid", "block", "slot", "pass_no", "a", "z")

    cut = places.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + size - 1) div {block_tokens})")))
    pieces = cut.select("sid", "part", "rn", "block", "start", "size").join(slot, ["sid", "block"])
    first, last = F.greatest("start", "a"), F.least(F.col("start") + F.col("size"), F.col("z"))
    pieces = pieces.select("sid", "part", "rn", "slot", "pass_no", (first - F.col("start")).alias("offset"), (last - first).alias("words")).filter("words > 0")
    return places, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, slots (how many slots take
    from the document) for every row of ``docs``."""
    places, pieces = mix_sources(docs, **options)
    taken = pieces.groupBy("sid", "part", "rn").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("slots"))
    out = places.join(taken, ["sid", "part", "rn"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "size", "source_size", "target", zero("taken"), zero("slots"))


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all columns), each whole document once for every pass of its
    source in which the mix takes from it.  Rows that repeat an id and source
    get the copies of the one that has most."""
    places, pieces = mix_sources(docs, **options)
    passes = pieces.groupBy("sid", "part", "rn").agg(F.count_distinct("pass_no").alias("n"))
    ids = places.select("sid", "part", "rn", F.col("doc_id").alias("of_id"), F.col("source").alias("of_source"))
    copies = ids.join(passes, ["sid", "part", "rn"]).groupBy("of_id", "of_source").agg(F.max("n").cast("int").alias("n_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("of"))
    out = rows.join(copies, F.col("id").eqNullSafe(F.col("of_id")) & F.col("of").eqNullSafe(F.col("of_source")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))
