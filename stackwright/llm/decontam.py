"""Benchmark decontamination with training suffix arrays.

Each partition of the corpus is cut into shards.  A shard's suffix array holds
the places from which a test item could match at all (the next words are all
words of the test set), sorted by the words that follow.  Every suffix of every
test item is looked up in it by binary search; the places found are joined along
their diagonals into the longest verbatim matches and their locations.  Documents
go one by one, so nothing is shuffled.

The test set travels to the executors in blocks of at most ``BLOCK_WORDS``
words; a larger test set takes one pass over the corpus for each block.

Words are runs of ASCII letters (lower-cased), digits and anything beyond
ASCII.  Defined results: a null text has no words; an item without words
matches nothing; an item shorter than the window is one window; repeated
documents are searched each, and item rows that repeat an id count as one item
under it (a null id as ''); empty tables give no hits.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import ALNUM_BYTES, buffers, map_arrow, plain, row_of, slices, span_hash, staged, table, word_spans, working_on

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Suffixes in a shard's array (40 bytes each).
SHARD_SUFFIXES = 400_000
_SPANS = "array<struct<start:bigint,end:bigint>>"
_MATCHES = "array<struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>>"


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and each row's first word (rows + 1)."""
    starts, ends, first = word_spans(data, offsets, ALNUM_BYTES)
    return span_hash(data, starts, ends, lower=True), first


class TestSet:
    """The suffixes of a block of items, cut to the window, and where each is."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        h, first = hashed_words(*buffers(pa.array(texts, pa.string())))
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(h)
        word = np.searchsorted(self.vocabulary, h).astype(np.uint32) + 1
        item = row_of(first, len(h))
        n = np.diff(first)[item]
        width = np.minimum(n, window)
        at = np.arange(len(h)) - first[item]
        ok = at + width <= n
        item, at, width, pos = item[ok], at[ok], width[ok], np.flatnonzero(ok)
        rows = np.zeros((len(pos), window), np.uint32)
        for k in range(window):
            has = width > k
            rows[has, k] = word[pos[has] + k]
        key = _keys(rows, window)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        #: Distinct windows: their words, widths and the (item, word) places of each.
        self.rows, self.width = rows[order][new], width[order][new]
        self.places = np.concatenate([new, [len(key)]]).astype(np.int64)
        self.item, self.at = item[order].astype(np.int64), at[order].astype(np.int64)
        self.least = int(width.min()) if len(width) else window + 1
        self.low = _keys(self.rows, window)
        high = self.rows.copy()
        for k in range(window):
            high[self.width <= k, k] = 0xFFFFFFFF
        self.high = _keys(high, window)
        self.prefix = np.zeros(1 << 16, bool)
        self.prefix[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def shared(self, spark: SparkSession):
        """A broadcast of plain arrays, which need no code to be read back."""
        return spark.sparkContext.broadcast(dict(vars(self)))

    @classmethod
    def read(cls, shared) -> TestSet:
        out = cls.__new__(cls)
        out.__dict__.update(shared.value)
        return out

    def word_ids(self, h: np.ndarray) -> np.ndarray:
        """Places in the vocabulary from 1; 0 for other words."""
        out = np.zeros(len(h), np.uint32)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.prefix[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[k] == h[maybe], k + 1, 0)
        return out


def _keys(rows: np.ndarray, window: int) -> np.ndarray:
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * window}").ravel() if len(rows) else np.zeros(0, f"S{4 * window}")


def suffixes(word: np.ndarray, first: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places followed by ``least`` known words or more, and their next
    ``window`` words (0 from the first unknown one or the row's end)."""
    n = len(word)
    stop = word == 0
    # Where the run of known words at each place ends.
    edge = np.full(n + 1, n, np.int64)
    edge[:n][stop] = np.flatnonzero(stop)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    limit = np.minimum.accumulate(np.where(begins, np.arange(n + 1), n)[::-1])[::-1]  # row start at or after
    ends = np.minimum.accumulate(edge[::-1])[::-1][:n]
    ends = np.minimum(ends, limit[1:]) if n else ends
    run = ends - np.arange(n)
    at = np.flatnonzero(run >= least)
    rows = np.zeros((len(at), window), np.uint32)
    for k in range(window):
        has = run[at] > k
        rows[has, k] = word[at[has] + k]
    return at, rows


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): the range of each member, and the members."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def search(test: TestSet, doc: np.ndarray, at: np.ndarray, rows: np.ndarray, longest: bool = True):
    """Occurrences of the test windows at training suffixes (document, word
    place, next words): hit words (doc, word), the items (doc, item) that they
    are of, and, if wanted, the longest matches (doc, item, item word, doc word,
    words)."""
    key = _keys(rows, test.window)
    array = np.argsort(key, kind="stable")
    key = key[array]
    low, high = np.searchsorted(key, test.low, "left"), np.searchsorted(key, test.high, "right")
    found = np.flatnonzero(high > low)
    of, member = _expand(low[found], high[found])
    window, place = found[of], array[member]
    d, p, w = doc[place], at[place], test.width[window]
    occ, word = _expand(p, p + w)
    hit = np.stack([d[occ], word])
    order = np.lexsort(hit[::-1])
    hit = hit[:, order][:, _groups(*hit[:, order])]
    # Each window of a document once, then the items it is of.
    once = np.unique(d * np.int64(len(test.width) + 1) + window)
    of_doc, of_window = once // (len(test.width) + 1), once % (len(test.width) + 1)
    occ, k = _expand(test.places[of_window], test.places[of_window + 1])
    pair = np.unique(of_doc[occ] * np.int64(len(test.ids) + 1) + test.item[k])
    items = pair // (len(test.ids) + 1), pair % (len(test.ids) + 1)
    if not longest:
        return hit, items, (np.zeros(0, np.int64),) * 5
    # Along a diagonal of (document, item), windows at consecutive places are one match.
    occ, k = _expand(test.places[window], test.places[window + 1])
    item, j = test.item[k], test.at[k]
    d, p, w = d[occ], p[occ], w[occ]
    order = np.lexsort((p, p - j, item, d))
    d, p, w, item, j = d[order], p[order], w[order], item[order], j[order]
    start = _groups(d, item, p - j, p - np.arange(len(p)))
    last = np.concatenate([start[1:], [len(p)]])[: len(start)] - 1
    return hit, items, (d[start], item[start], j[start], p[start], p[last] - p[start] + w[last])


def _pass(docs: DataFrame, test, window: int, least: int, longest: bool) -> DataFrame:
    """One block's hits in ``docs`` (doc_id, text)."""

    def run(batches):
        working_on("decontam")
        suite = TestSet.read(test)
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for i, j, data, offsets in slices(*buffers(batch.column("text"))):
                h, first = hashed_words(data, offsets)
                at, rows = suffixes(suite.word_ids(h), first, least, window)
                row = np.searchsorted(first, at, "right") - 1
                held.append((batch.select(["doc_id"]).slice(i, j - i), np.diff(first), row, at - first[row], rows))
                size += len(at)
                if size >= SHARD_SUFFIXES or len(held) >= 64:
                    yield from shard(suite, held)
                    held, size = [], 0
        if held:
            yield from shard(suite, held)

    def shard(suite, held):
        base = np.cumsum([0, *[b.num_rows for b, *_ in held]])
        hit, items, match = search(suite, np.concatenate([r + k for (_, _, r, _, _), k in zip(held, base)]), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held]), longest)
        n = int(base[-1])
        # Hit words as spans of each document, with those of earlier blocks.
        start = _groups(hit[0], hit[1] - np.arange(hit.shape[1]))
        last = np.concatenate([start[1:], [hit.shape[1]]])[: len(start)] - 1
        spans = _lists(n, hit[0][start], {"start": hit[1][start], "end": hit[1][last] + 1})
        names = np.array(suite.ids, object)
        found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(items[0], minlength=n))]).astype(np.int32)), pa.array(names[items[1]], pa.string()))
        matches = _lists(n, match[0], {"item_id": pa.array(names[match[1]], pa.string()), "item_word": match[2], "doc_word": match[3], "n_words": match[4]})
        for k, (b, words, *_) in enumerate(held):
            of = slice(int(base[k]), int(base[k + 1]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words.astype(np.int64)), spans[of], found[of], matches[of]], names=["doc_id", "n_words", "new_spans", "new_items", "new_matches"])

    schema = docs.select("doc_id").schema.add("n_words", "long").add("new_spans", DataType.fromDDL(_SPANS)).add("new_items", DataType.fromDDL("array<string>")).add("new_matches", DataType.fromDDL(_MATCHES))
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def _lists(n: int, row: np.ndarray, fields: dict) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields)))


def test_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """The items in blocks of about ``block_words`` words, one at a time."""
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for r in plain(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t) // 2 + 1
        if size >= block_words:
            yield TestSet(ids, texts, window)
            ids, texts, size = [], [], 0
    yield TestSet(ids, texts, window)


_ADD_SPANS = """aggregate(
  array_sort(flatten(collect_list(new_spans))), cast(array() as array<struct<start:bigint,end:bigint>>),
  (a, s) -> CASE WHEN size(a) = 0 OR element_at(a, -1).end < s.start THEN array_append(a, s)
    ELSE array_append(slice(a, 1, size(a) - 1), named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end))) END)"""


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, longest: bool = True) -> DataFrame:
    """doc_id, n_words, spans (word ranges that test windows hit), items (ids
    whose windows do), matches (longest verbatim matches with their locations; as
    many as occurrences times their places in items, so empty unless ``longest``)
    for every row of ``docs``."""
    spark = docs.sparkSession
    rows = plain(docs, "doc_id", "text")
    blocks = test_blocks(benchmark, window, block_words)
    first, more = next(blocks), next(blocks, None)
    if more is None:
        out = _pass(rows, first.shared(spark), window, first.least, longest)
        return out.select("doc_id", "n_words", F.col("new_spans").alias("spans"), F.col("new_items").alias("items"), F.col("new_matches").alias("matches"))
    numbered = staged(rows.withColumn("doc_id", F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "decontam-rows")
    parts = []
    for block in (b for bs in ([first, more], blocks) for b in bs):
        shared = block.shared(spark)
        parts.append(staged(_pass(numbered, shared, window, block.least, longest).filter("size(new_spans) > 0").drop("n_words"), "decontam-block"))
        shared.unpersist()
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy(F.col("doc_id").alias("k")).agg(F.expr(_ADD_SPANS).alias("spans"), F.array_distinct(F.flatten(F.collect_list("new_items"))).alias("items"), F.flatten(F.collect_list("new_matches")).alias("matches"))
    none = TestSet([], [], window)
    counted = _pass(numbered, none.shared(spark), window, none.least, longest).drop("new_spans", "new_items", "new_matches")
    out = counted.join(hits, F.col("doc_id.row") == F.col("k.row"), "left")
    return out.select("doc_id.doc_id", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("matches", F.expr(f"cast(array() as {_MATCHES})")).alias("matches"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents of ``docs`` that no test window occurs in, all columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    out = contamination(rows, benchmark, window, longest=False)
    return out.filter("size(spans) = 0").select("doc_id.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=False)
    items = F.array_sort("items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = rf"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
wide AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM wide)),
kinds AS (SELECT DISTINCT k, s FROM wins),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM kinds)),
found AS (SELECT r, i, k, s FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) JOIN kinds USING (k, s)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found JOIN wins USING (k, s)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN held USING (r)
"""
