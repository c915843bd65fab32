"""Near-duplicate classes by improved consistent weighted sampling.

A text is the bag of its shingles of five words (ASCII lower-cased; a shorter
text is one shingle).  A shingle weighs its count in the text times a damped
inverse document frequency between ``1 - DAMPING`` and 1 (undamped, what a large
group of copies shares weighs next to nothing and its copies fall apart), estimated over all documents by a
count-mean sketch: ``IDF_ROWS`` hash rows of ``2 ** IDF_BITS`` counters, less
what a counter holds of other shingles on average, and the median of the rows.
27 consistent weighted samples make 9 bands of 3; two texts of weighted Jaccard
similarity 0.8 share a band with probability 0.998.

Candidates are all pairs of a band's bucket whose texts aren't in one class
already.  To have few such pairs, each bucket has a hub, the text whose buckets
hold most texts, and every member meets the hub first; their pairs are verified
by weighted Jaccard similarity of the whole texts.  A bucket of several classes
after that, of any size, is searched whole in blocks: the members outside its
largest class meet each other and that class, block by block.  A task compares
the 27 samples of two blocks, drops pairs that agree in under half (3.9 standard
deviations below 0.8), computes the exact similarity of the others as products
of sparse bags, and returns a spanning forest of the similar pairs, so that rows
grow with the members and never with their pairs.  Classes are the connected
components of the links; equal texts are in one class without any pair.  Time
grows with a bucket's members times those outside its largest class.

Defined results: a null text is alone in its class (class_id is its doc_id, null
for a null id; class_key null); texts without words are in one class only if
equal; repeated rows share a class; classes that share a class_id, because ids
repeat, differ in class_key; an empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, buffers, discard, map_arrow, mix64, plain, row_of, slices, span_hash, staged, table, tidy, windows, word_spans, working_on

SHINGLE = 5
THRESHOLD = 0.8
#: Sums of weights are rounded; similarities this little below the threshold are at it.
TIE = 1e-9
BANDS, ROWS = 9, 3
SAMPLES = BANDS * ROWS
IDF_BITS, IDF_ROWS = 16, 3
DAMPING = 0.25
#: Texts, and bytes of them, in a block of a bucket.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Shingles of more texts than this are multiplied as dense columns, so many at a time.
DENSE, COLUMNS = 32, 2048
_BLOCK = 1 << 15
_TABLE = 1 << 16


# --- shingles and weights ---------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, 48-bit shingle hash, count: the rows' bags, sorted."""
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    h = span_hash(data, starts, ends, lower=True)
    row = row_of(first, len(h))
    w = windows(h, SHINGLE)
    ok = row[: len(w)] == row[SHINGLE - 1 :] if len(w) else np.zeros(0, bool)
    w, row_w = w[ok], row[: len(w)][ok]
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        with np.errstate(over="ignore"):
            short = np.array([mix64(np.array([np.bitwise_xor.reduce(mix64(h[first[i] : first[i + 1]] + np.arange(n[i], dtype=np.uint64)))]))[0] for i in few], np.uint64)
        w, row_w = np.concatenate([w, short]), np.concatenate([row_w, few])
    kinds, count = np.unique((row_w.astype(np.uint64) << np.uint64(48)) | (w >> np.uint64(16)), return_counts=True)
    return (kinds >> np.uint64(48)).astype(np.int64), kinds & np.uint64((1 << 48) - 1), count


def _slices(column):
    # Rows fit the 16 bits above a shingle's hash.
    for i, j, data, offsets in slices(*buffers(column)):
        for k in range(i, j, 50_000):
            z = min(j, k + 50_000)
            yield k, z, data[offsets[k - i] : offsets[z - i]], offsets[k - i : z - i + 1] - offsets[k - i]


def counters(h: np.ndarray, k: int) -> np.ndarray:
    """Each shingle's counter in row k of the sketch."""
    with np.errstate(over="ignore"):
        return ((h * _ODD[k] & np.uint64((1 << 48) - 1)) >> np.uint64(48 - IDF_BITS)).astype(np.int64) + (k << IDF_BITS)


_ODD = (np.uint64(1), np.uint64(0x9E3779B97F4B), np.uint64(0xD1B54A32D193))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch of how many texts hold a shingle, less the average load, and
    how many texts hold any."""
    size = IDF_ROWS << IDF_BITS

    def run(batches):
        working_on("neardup")
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column("text")):
                row, h, _ = shingles(data, offsets)
                for k in range(IDF_ROWS):
                    seen[:-1] += np.bincount(counters(h, k), minlength=size)
                seen[-1] += len(np.unique(row))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["counter", "n"])

    got = map_arrow(plain(docs, "text"), run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a row a counter
    out = np.zeros(size + 1, np.int64)
    out[got["counter"].to_numpy()] = got["n"].to_numpy()
    load = out[: 1 << IDF_BITS].sum()
    return np.maximum(0, out[:-1] - (load - out[:-1]) / ((1 << IDF_BITS) - 1)), int(out[-1])


def damped_idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    """1 for what no document has, ``1 - DAMPING`` for what all have, linear in the log."""
    return (1 - DAMPING * np.log1p(np.minimum(frequency, documents)) / np.log1p(max(1, documents))).astype(np.float32)


def shingle_idf(h: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The median of the rows' estimates."""
    a, b, c = (idf[counters(h, k)] for k in range(IDF_ROWS))
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count.astype(np.float32) * shingle_idf(h, idf)


# --- samples ----------------------------------------------------------------------------


def _draws() -> tuple[np.ndarray, ...]:
    u = (mix64(np.arange(1, 5 * _TABLE + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64).reshape(5, _TABLE) / 2.0**53 + 2.0**-54
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])  # Gamma(2, 1)
    return r.astype(np.float32), (1 / r).astype(np.float32), u[4].astype(np.float32), np.log(c).astype(np.float32)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, draws) -> np.ndarray:
    """The consistent weighted samples (n rows x SAMPLES) of sorted bags, as
    64-bit values; rows without shingles have zeros.

    Each shingle draws r, c and beta from its hash; the sample is the shingle of
    smallest log a = log c - r (t - beta + 1), t = floor(log w / r + beta)."""
    r_of, inv_r, beta_of, log_c = draws
    out = np.zeros((n, SAMPLES), np.uint64)
    if not len(h):
        return out
    odd = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    log_w = np.log(weight)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    end = np.concatenate([begin[1:], [len(row)]])
    with np.errstate(over="ignore"):
        spread = mix64(h)
        i = 0
        while i < len(begin):  # blocks of whole bags that stay in the cache
            j = max(i + 1, int(np.searchsorted(end, begin[i] + _BLOCK, "right")))
            a, z = begin[i], end[j - 1]
            x, lw, cut = spread[a:z], log_w[a:z], begin[i:j] - a
            size = end[i:j] - begin[i:j]
            for k in range(SAMPLES):
                p = ((x * odd[2 * k]) >> np.uint64(48)).astype(np.int64)
                q = ((x * odd[2 * k + 1]) >> np.uint64(48)).astype(np.int64)
                r, beta = r_of[p], beta_of[p]
                t = np.floor(lw * inv_r[p] + beta)
                log_a = log_c[q] - r * (t - beta + 1)
                best = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, cut), size))
                at = best[np.searchsorted(best, cut)]
                out[row[begin[i:j]], k] = mix64(x[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            i = j
    return out


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, tid (hash of the text), bands (keys), sig (16 bits of each
    sample) for every row of ``docs``; without words, bands is null."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # 1 MB
    rows = plain(docs, "doc_id", "text").select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("tid"), "text")

    def run(batches):
        working_on("neardup")
        idf_, draws = shared.value, _draws()
        for batch in batches:
            for i, j, data, offsets in _slices(batch.column("text")):
                row, h, count = shingles(data, offsets)
                got = samples(row, h, weights(h, count, idf_), j - i, draws)
                key = np.zeros((j - i, BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for b in range(BANDS):
                        for k in range(ROWS):
                            key[:, b] = mix64(key[:, b] + got[:, b * ROWS + k] + np.uint64(b + 1))
                has = np.bincount(row, minlength=j - i) > 0
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(has, x.shape[1], 0))]).astype(np.int32)), pa.array(x[has].ravel()))
                sig = (got >> np.uint64(48)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("tid").slice(i, j - i), lists(key.view(np.int64)), lists(sig)], names=["doc_id", "tid", "bands", "sig"])
            tidy(batch.nbytes)

    schema = rows.select("doc_id", "tid").schema.add("bands", pa_list("long")).add("sig", pa_list("integer"))
    return staged(map_arrow(rows, run, schema), "neardup-sketches")


def pa_list(kind: str):
    from pyspark.sql.types import ArrayType, IntegerType, LongType

    return ArrayType(LongType() if kind == "long" else IntegerType())


# --- verification -----------------------------------------------------------------------


def weighted_jaccard(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """The similarity of each pair of texts."""
    n = len(left)
    both = [x for pair in zip(left, right) for x in pair]
    row, h, count = shingles(*buffers(pa.array(both, pa.string())))
    w = weights(h, count, idf).astype(np.float64)
    pair, side = row >> 1, row & 1
    order = np.lexsort((side, h, pair))
    pair, h, w = pair[order], h[order], w[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    low = np.bincount(pair[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    high = np.bincount(pair, weights=w, minlength=n) - low
    return np.where(high > 0, low / np.maximum(high, 1e-9), 0.0)


def similar_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts are similar, with similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    sig = nodes.select("tid", "sig")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = pairs.join(sig.select(F.col("tid").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("tid").alias("a"), F.col("sig").alias("sa")), "a")
    near = near.filter(2 * agree >= SAMPLES).select("a", "b")
    near = near.join(texts.select(F.col("tid").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("tid").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        working_on("neardup")
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                s = weighted_jaccard(part.column("ta").to_pylist(), part.column("tb").to_pylist(), shared.value)
                ok = pa.array(s >= threshold - TIE)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok), pa.array(s).filter(ok)], names=["a", "b", "similarity"])

    return map_arrow(near.select("a", "b", "ta", "tb"), run, "a long, b long, similarity double")


# --- components -------------------------------------------------------------------------


def connected_components(edges: DataFrame) -> DataFrame:
    """tid, comp (the smallest tid of its component) and was of the ends of
    ``edges`` (a, b), staged.  Labels spread over the edges and along themselves until they stay."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "neardup-edges")
    labels = staged(both.groupBy(F.col("a").alias("tid")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "neardup-labels")
    while True:
        at = labels.select(F.col("tid").alias("b"), F.col("comp").alias("lb"))
        best = both.join(at, "b").groupBy(F.col("a").alias("tid")).agg(F.min("lb").alias("near"))
        spread = labels.join(best, "tid").select("tid", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        top = labels.select(F.col("tid").alias("comp"), F.col("comp").alias("top"))
        new = staged(spread.join(top, "comp", "left").select("tid", "was", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "neardup-labels")
        discard(labels)
        labels = new
        if new.filter("comp <> was").isEmpty():
            discard(both)
            return labels


# --- classes ----------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_class (rows in
    it), class_key (of its first text) for every row of ``docs`` (doc_id, text)."""
    return _classed(docs, threshold).select("doc_id", "class_id", "n_class", F.col("keep_tid").alias("class_key"))


def _classed(docs: DataFrame, threshold: float) -> DataFrame:
    """The rows with class_id and n_class, tid, and keep_tid: of the texts that
    have class_id for doc_id, the class's first."""
    docs = plain(docs, "doc_id", "text")
    frequency, documents = document_frequencies(docs)
    idf = damped_idf(frequency, documents)
    rows = sketches(docs, idf)
    nodes = rows.filter("tid is not null").groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    nodes = staged(nodes, "neardup-nodes")
    edges = _similar_edges(docs, nodes, idf, threshold)
    comps = connected_components(edges)
    discard(edges)
    of = nodes.select("tid").join(comps.select("tid", "comp"), "tid", "left").select("tid", F.coalesce("comp", "tid").alias("comp"))
    per = rows.filter("tid is not null").groupBy("tid").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")).join(of, "tid")
    classes = per.groupBy("comp").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "tid")).alias("first"), F.sum("n").alias("n_class"))
    classes = classes.select("comp", F.col("first.id").alias("class_id"), "n_class", F.col("first.tid").alias("keep_tid"))
    of_text = staged(per.select("tid", "comp").join(classes, "comp").select("tid", "class_id", "n_class", "keep_tid"), "neardup-classes")
    discard(nodes, comps)
    known = rows.select("doc_id", "tid").filter("tid is not null").join(of_text, "tid").select("doc_id", "class_id", "n_class", "tid", "keep_tid")
    alone = rows.filter("tid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"), "tid", F.col("tid").alias("keep_tid"))
    return known.unionByName(alone)


def _similar_edges(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Verified pairs (a, b) between different texts that link all classes, staged."""
    spread = nodes.filter("bands is not null").select("tid", F.explode("bands").alias("key"))
    often = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = staged(spread.join(often, "key"), "neardup-members")
    met = members.groupBy("tid").agg(F.sum("n").alias("mass")).join(nodes.select("tid", "first_id", "sig"), "tid")
    # The whole texts of those that share a bucket.
    said = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    said = said.join(met.select("tid", "first_id"), (said["tid"] == met["tid"]) & said["doc_id"].eqNullSafe(met["first_id"]), "left_semi")
    texts = staged(said.select("tid", "text").dropDuplicates(["tid"]), "neardup-texts")
    met = staged(met.join(texts.select("tid", F.octet_length("text").alias("bytes")), "tid").select("tid", "mass", "sig", "bytes"), "neardup-met")

    weighed = members.select("key", "tid").join(met.select("tid", "mass", "bytes"), "tid")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("mass", "tid")).alias("h"))
    pairs = weighed.join(hubs, "key").filter("tid <> h.tid").select(F.least("tid", "h.tid").alias("a"), F.greatest("tid", "h.tid").alias("b")).distinct()
    star = staged(similar_pairs(pairs, met, texts, idf, threshold).select("a", "b"), "neardup-hub-links")
    comps = connected_components(star)
    state = staged(weighed.join(comps.select("tid", "comp"), "tid", "left").select("key", "tid", "bytes", F.coalesce("comp", "tid").alias("comp")), "neardup-state")
    rest = staged(_search_buckets(state, met, texts, idf, threshold), "neardup-block-links")
    links = staged(star.unionByName(rest).distinct(), "neardup-links")
    discard(members, met, texts, star, comps, state, rest)
    return links


def _search_buckets(state: DataFrame, met: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Links (a, b) between the classes of each bucket (key, tid, bytes, comp):
    all its pairs across classes meet, in blocks."""
    one = F.count(F.lit(1))
    per = state.groupBy("key", "comp").agg(one.alias("n"), F.sum("bytes").alias("size"))
    tops = per.groupBy("key").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("top.n < n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_BYTES)).cast("int")
    tops = tops.select("key", F.col("top.comp").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("q"), blocks(F.col("top.n"), F.col("top.size")).alias("p"))
    # Blocks 0 to q - 1 hold what lies outside the largest class, q to q + p - 1 that class.  Two small blocks are one.
    block = F.expr("CASE WHEN q + p <= 2 THEN 0 WHEN comp = main THEN q + pmod(xxhash64(tid), p) ELSE pmod(xxhash64(tid), q) END").cast("int")
    dealt = state.join(tops, "key").withColumn("mine", block).withColumn("last", F.expr("CASE WHEN q + p <= 2 THEN 0 WHEN comp = main THEN q - 1 ELSE q + p - 1 END"))
    dealt = dealt.select("key", "tid", "comp", "mine", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "tid", "comp")
    full = dealt.join(met.select("tid", "sig"), "tid").join(texts, "tid").select("key", "x", "y", "mine", "tid", "comp", "sig", "text")
    full = full.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "mine", "tid")
    shared = state.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        working_on("neardup")
        group, held = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "x", "y")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if held and group != tuple(key[:, i]):
                    yield _block_links(held, shared.value, threshold)
                    held = []
                group = tuple(key[:, i]) if j > i else group
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield _block_links(held, shared.value, threshold)
        tidy()

    return map_arrow(full, run, "a long, b long")


def _block_links(parts: list[pa.RecordBatch], idf: np.ndarray, threshold: float) -> pa.RecordBatch:
    """A spanning forest of the similar pairs across classes between two blocks
    (mine) of a bucket, or within one."""
    table_ = pa.Table.from_batches(parts).combine_chunks()
    tid, comp, mine = (table_.column(c).to_numpy() for c in ("tid", "comp", "mine"))
    x, y = table_.column("x")[0].as_py(), table_.column("y")[0].as_py()
    left, right = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
    sig = table_.column("sig").combine_chunks().flatten().to_numpy().reshape(len(tid), -1)
    agree = np.zeros((len(left), len(right)), np.int8)
    for k in range(SAMPLES):
        agree += sig[left, k][:, None] == sig[right, k]
    maybe = (2 * agree >= SAMPLES) & (comp[left][:, None] != comp[right])
    left, right, maybe = left[(i := maybe.any(axis=1))], right[(j := maybe.any(axis=0))], maybe[i][:, j]
    a = b = np.zeros(0, np.int64)
    if maybe.any():
        texts = table_.column("text").combine_chunks()
        both = np.unique(np.concatenate([left, right]))
        near = similarities(texts.take(pa.array(both)), np.searchsorted(both, left), np.searchsorted(both, right), idf)
        i, j = np.nonzero(maybe & (near >= threshold - TIE))
        i, j = _forest(left[i], right[j])
        a, b = np.minimum(tid[i], tid[j]), np.maximum(tid[i], tid[j])
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def similarities(texts: pa.Array, left: np.ndarray, right: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every left text with every right one.  A
    shingle that a text holds n times counts as n features, so the common weight
    of two texts is a product of bags; frequent features are multiplied as dense
    columns, the others pair by pair."""
    rows, hs, counts = [], [], []
    for i, _, data, offsets in _slices(texts):
        row, h, count = shingles(data, offsets)
        rows.append(row + i)
        hs.append(h)
        counts.append(count)
    row, h, count = np.concatenate(rows), np.concatenate(hs), np.concatenate(counts)
    w = shingle_idf(h, idf).astype(np.float64)
    total = np.bincount(row, weights=w * count, minlength=len(texts))
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, h, w = np.repeat(row, count), np.repeat(h, count), np.repeat(w, count)
    order = np.lexsort((row, level, h))
    row, h, w, level = row[order], h[order], w[order], level[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (level[1:] != level[:-1])
    feature = np.cumsum(new) - 1
    often = np.bincount(feature)
    common = np.zeros((len(texts), len(texts)))
    # Each feature of few texts adds its weight to their pairs.
    start = np.flatnonzero(new)
    for n in range(2, DENSE + 1):
        at = start[often == n]
        if len(at):
            of = row[at[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            common += np.bincount((of[:, i] * len(texts) + of[:, j]).ravel(), weights=np.repeat(w[at], len(i)), minlength=len(texts) ** 2).reshape(common.shape)
    common += common.T
    dense = np.flatnonzero(often > DENSE)
    place = np.full(len(often), -1)
    place[dense] = np.arange(len(dense))
    column = place[feature]
    for k in range(0, len(dense), COLUMNS):
        use = (column >= k) & (column < k + COLUMNS)
        bag = np.zeros((len(texts), min(COLUMNS, len(dense) - k)))
        bag[row[use], column[use] - k] = np.sqrt(w[use])
        common += bag @ bag.T
    common = common[left][:, right]
    union = total[left][:, None] + total[right] - common
    return np.where(union > 0, common / np.maximum(union, 1e-9), 0.0)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of (a, b) that link all that they link."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := root(x)) != (y := root(y)):
            top[y] = x
            keep.append(k)
    return a[keep], b[keep]


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) with one document of each class: that of the
    smallest doc_id, once if its row (doc_id and text) repeats; null texts
    without an id all stay."""
    classes = staged(_classed(docs, threshold), "neardup-result")
    key = lambda df, tid: [F.coalesce(df["doc_id"], F.lit(0)).alias("k1"), F.isnull(df["doc_id"]).alias("k2"), F.coalesce(tid, F.lit(0)).alias("k3"), F.isnull(tid).alias("k4")]
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("tid").eqNullSafe(F.col("keep_tid")))
    keys = ["k1", "k2", "k3", "k4"]
    # Rows that repeat meet before the shuffle, so a hot row is a row a partition.
    whole = docs.filter("doc_id is not null or text is not null").select(*key(docs, F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"]))), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.groupBy(*keys).agg(F.first("row").alias("row"))
    out = whole.join(kept.select(*key(kept, kept["tid"])), keys, "left_semi").select("row.*")
    return out.unionByName(docs.filter("doc_id is null and text is null"))
