"""Sharding through fixed virtual slots.

Records hash into thousands of virtual slots.  Bytes and rows are summed for
each slot (a bounded table, one row a slot), and a versioned map says which
shard holds which slot.  Rebalancing edits the map: version 0 deals slots out
in turn, and each later version moves single slots from the heaviest shard to
the lightest until no move helps.  Records never need another hash.

Law: ``bytes`` (the shards' sizes are near equal).

Defined results: a null text has no bytes and counts 1, as an empty one does,
and its crc32 is that of no bytes; null ids hash like any value; repeated rows
are separate records that spread over slots; an empty table gives an empty result
and a map of empty slots.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field
from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain, stage_path, staged, table

VIRTUAL_SLOTS = 16_384


@dataclass
class SlotMap:
    """Which shard holds each virtual slot, version by version."""

    shards: int
    versions: list[list[int]] = field(default_factory=list)

    @classmethod
    def first(cls, shards: int, slots: int = VIRTUAL_SLOTS) -> SlotMap:
        return cls(shards, [[i % shards for i in range(slots)]])

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    def rebalanced(self, load: list[int], shards: int | None = None) -> SlotMap:
        """A new version in which single slots have moved from heavy shards to
        light ones until no move from the heaviest to the lightest narrows their
        gap.  More ``shards`` begin empty; with fewer, the slots of those that go
        are first dealt to the lightest of the others, heaviest slots first."""
        shards = shards or self.shards
        new = list(self.current)
        total = [0] * shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(new):
            if shard < shards:
                total[shard] += load[slot]
                held[shard].append((load[slot], slot))
        heap = [(t, s) for s, t in enumerate(total)]
        heapify(heap)
        for size, slot in sorted(((load[slot], slot) for slot, shard in enumerate(new) if shard >= shards), reverse=True):
            _, light = heap[0]
            held[light].append((size, slot))
            new[slot] = light
            total[light] += size
            heapreplace(heap, (total[light], light))
        held = [sorted(x for x in h if x[0]) for h in held]
        while shards > 1:
            heavy, light = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
            gap, h = total[heavy] - total[light], held[heavy]
            # The slot nearest to half the gap; one of a whole gap or more would not narrow it.
            k = bisect_left(h, (gap / 2, -1))
            near = [h[i] for i in (k - 1, k) if 0 <= i < len(h) and h[i][0] < gap]
            if not near:
                break
            size, slot = best = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
            h.remove(best)
            insort(held[light], best)
            new[slot] = light
            total[heavy] -= size
            total[light] += size
        return SlotMap(shards, [*self.versions, new])

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, virtual_slot, shard, shards (how many there are, with or
        without slots): the map as it is stored."""
        rows = [(v, i, s, self.shards) for v, m in enumerate(self.versions) for i, s in enumerate(m)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, shards int")

    @classmethod
    def load(cls, stored: DataFrame) -> SlotMap:
        by: dict[int, list[tuple[int, int]]] = {}
        shards = 0
        for r in stored.collect():  # one row a slot and version
            by.setdefault(r.version, []).append((r.virtual_slot, r.shard))
            shards = r.shards
        return cls(shards, [[s for _, s in sorted(by[v])] for v in sorted(by)])


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int")


def _measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return plain(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def hashed_records(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot.  Rows that
    repeat are counted first and numbered (the number is hashed too), so a row
    that repeats often spreads over all slots."""
    rows = _measured(docs).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return rows.withColumn("virtual_slot", _slot(slots)).drop("copy")


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = VIRTUAL_SLOTS, slot_map: SlotMap | None = None, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """The records with their shard and their place in it (gapless from 0),
    and the edited map.  A given map is the version that the edit starts from.
    The map is stored under ``map_path`` (by default in the shared folder), and
    shards are those of its last version as read back from there."""
    spark = docs.sparkSession
    rows = staged(hashed_records(docs, slots), "shard-records")
    load = [0] * slots
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    for r in sums.collect():  # one row a slot
        load[r.virtual_slot] = r.bytes
    path = map_path or stage_path(spark, "shard-map")
    (slot_map or SlotMap.first(shards, slots)).rebalanced(load, shards).frame(spark).coalesce(1).write.parquet(path)
    stored = spark.read.parquet(path)
    slot_map = SlotMap.load(stored)
    # A slot begins where the slots before it in its shard end.
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = _current(stored, slot_map).join(sums, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.withColumn("inside", inside).join(F.broadcast(places), "virtual_slot")  # ``slots`` rows
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside") - 1).alias("slot"), "virtual_slot"), slot_map


def _current(stored: DataFrame, slot_map: SlotMap) -> DataFrame:
    return stored.filter(F.col("version") == len(slot_map.versions) - 1).select("virtual_slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Writes the whole records (struct ``record``, so that no name can clash)
    under ``path``/data, partitioned by shard, and the versioned map under
    ``path``/map; returns the map.  Rows that repeat are spread by the partition
    that reads them, so their slots may differ from those ``shard_documents`` counted."""
    spark = docs.sparkSession
    _, slot_map = shard_documents(docs, shards, slots, map_path=f"{path}/map")
    stored = spark.read.parquet(f"{path}/map")
    text = F.coalesce(docs["text"], F.lit(""))
    again = _measured(docs).groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), docs["doc_id"].alias("id"), F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("at"))
    rows = rows.join(again, rows["id"].eqNullSafe(again["doc_id"]) & (rows["crc"] == again["text_crc32"]), "left")
    rows = rows.select("record", F.col("id").alias("doc_id"), F.col("crc").alias("text_crc32"), F.when(F.col("n") > 1, F.pmod("at", "n") + 1).otherwise(F.lit(1)).cast("long").alias("copy"))
    out = rows.select("record", _slot(slots).alias("virtual_slot")).join(F.broadcast(_current(stored, slot_map)), "virtual_slot")
    out.write.partitionBy("shard").parquet(f"{path}/data")
    return stored


def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
