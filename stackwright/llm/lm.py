"""Language-model scores from a probabilistic suffix tree.

A text is its lower-cased words, spelt out in UTF-8 bytes, each with a word end,
and one text end.  The tree's states are contexts of up to four symbols, of
which one is retained if it is frequent (``P_MIN`` of all symbols, which bounds the
tree) and its next-symbol distribution diverges from its parent's by more than
the state costs to describe.  Distributions are smoothed towards the parent's;
a symbol is scored in the longest suffix of its context that is a state.

Symbols are 62 classes of bytes (the letters, the most frequent other bytes, one
class for the rest, whose bytes share its probability by frequency), so the
probabilities of all texts sum to one, unknown words included.

Above the spelling stand contexts of ``CONTEXT_WORDS`` whole words, whose next
symbol is the next word.  Their number grows with the corpus: every context met
twice or more is a candidate, there is no cap on their number, and one is
retained by the same divergence test against the tree.  A word after a retained
context is scored there, smoothed towards the tree.  All places of all texts
count and are scored (``ANCHORS`` is 1; at more, only contexts whose hash is 0
modulo it would be candidates).  Contexts are counted and looked up in one shuffle
of compressed arrays, not of rows: words go as ranks, a context's next words
together, and what returns is a sum for each text.  All places of one context
meet in one task, which holds its different next words and the compressed rest.

Beside it stands a unigram word model.  Word counts are exact, by 63-bit hash.
Words of at least 1 in ``HEAD_SHARE`` tokens (so at most that many) are
broadcast; all other words are looked up in the shuffle of the contexts.

Defined results: a null text is empty and has the text end only; repeated rows
count and are scored each; with no training rows the base model gives log10 1
and the tree is uniform over symbols; null ids fall into a fold as '' does.  Other columns
are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WORD_BYTES, buffers, discard, fold_ascii, fold_of, kept_in_worker, map_arrow, mix64, plain, row_of, slices, span_hash, staged, table, tidy, word_spans, working_on

DEPTH = 4
SYMBOLS = 64
PAD, WORD_END, TEXT_END, RARE = 0, 1, 2, 63
P_MIN = 2.0**-17
SMOOTHING = 8.0
HEAD_SHARE = 1 << 21
ALPHA = 0.1
#: Words in a context, the share of contexts that are candidates (one in so
#: many), how often one must be met, and the weight of the tree's distribution.
CONTEXT_WORDS, ANCHORS, LEAST_MET, TREE_WEIGHT = 2, 1, 2, 1.0
#: Head words have ranks below ``RANKS``.  Bytes of text that go on together, and
#: places in a part of the contexts.
RANK_BITS = HEAD_SHARE.bit_length() - 1
RANKS = 1 << RANK_BITS
PACK_BYTES, PART_PLACES = 8 << 20, 1 << 21


# --- symbols ----------------------------------------------------------------------------


def symbol_classes(byte_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and log10 of its share of its class."""
    classes = np.full(256, RARE, np.uint8)
    classes[97:123] = np.arange(3, 29)
    classes[65:91] = classes[97:123]
    others = [b for b in np.argsort(-byte_counts, kind="stable") if classes[b] == RARE]
    classes[others[: RARE - 29]] = np.arange(29, RARE)
    share = np.zeros(256)
    rare = (classes == RARE) & WORD_BYTES
    weight = byte_counts[rare] + ALPHA
    share[rare] = np.log10(weight / weight.sum())
    return classes, share


def spelt(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """The rows as symbols, ``DEPTH`` pads before each: symbols, the place of
    each row's text end, word keys, each row's first word (rows + 1), and the
    words' starts and ends among the symbols and among the bytes."""
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    n, words = len(offsets) - 1, len(starts)
    row = row_of(first, words)
    at = np.flatnonzero(WORD_BYTES[data])
    length = ends - starts
    shift = np.arange(words) + (DEPTH + 1) * row + DEPTH
    place = np.arange(len(at)) + np.repeat(shift, length)
    done = np.cumsum(np.concatenate([[0], length]))
    sym = np.zeros(len(at) + words + (DEPTH + 1) * n, np.uint8)
    sym[place] = classes[data[at]]
    sym[done[1:] + shift] = WORD_END
    row_end = done[first[1:]] + first[1:] + (DEPTH + 1) * np.arange(n) + DEPTH
    sym[row_end] = TEXT_END
    return sym, row_end, word_keys(data, starts, ends), first, (done[:-1] + shift, done[1:] + shift + 1, starts, ends)


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of words: hashes with the top bit set."""
    return span_hash(data, starts, ends, lower=True) | np.uint64(1 << 63)


def contexts(sym: np.ndarray) -> np.ndarray:
    """The ``DEPTH`` symbols before each place, packed (oldest first)."""
    out = np.zeros(len(sym), np.int32)
    s = sym.astype(np.int32)
    for k in range(1, min(DEPTH + 1, len(sym))):
        out[k:] |= s[:-k] << (6 * (k - 1))
    return out


class _Counts:
    """Sums counts by key, merging now and then."""

    def __init__(self, most: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, most

    def add(self, kinds: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((kinds, n))
        self.size += len(kinds)

    def full(self) -> bool:
        if self.size > self.most:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
        return self.size > self.most // 2

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        kinds, place = np.unique(keys, return_inverse=True)
        return kinds, np.bincount(place, weights=np.concatenate([n for _, n in self.parts]), minlength=len(kinds)).astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _count(docs: DataFrame, values_of, name: str) -> DataFrame:
    """key, n: how often each value of ``values_of`` occurs in the texts."""

    def run(batches):
        working_on("lm")
        seen = _Counts()
        for batch in batches:
            for _, _, data, offsets in slices(*buffers(batch.column("text"))):
                for kinds, n in values_of(data, offsets):
                    seen.add(kinds.view(np.int64), n)
                if seen.full():
                    k, n = seen.take()
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])
        k, n = seen.take()
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

    return staged(map_arrow(docs, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), name)


def count_words(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """key, n of the words of ``docs`` (text), and the counts of their bytes."""
    lower = fold_ascii()

    def values(data, offsets):
        starts, ends, _ = word_spans(data, offsets, WORD_BYTES)
        yield np.unique(word_keys(data, starts, ends), return_counts=True)
        yield np.arange(256), np.bincount(lower[data], minlength=256)

    found = _count(docs, values, "lm-words")
    seen = np.zeros(256)
    for r in found.filter("key >= 0").collect():  # 256 at most
        seen[r.key] = r.n
    return found.filter("key < 0"), seen * WORD_BYTES


# --- the tree ---------------------------------------------------------------------------


@dataclass
class SuffixTree:
    """States by depth (sorted contexts, rows in ``logp``; row 0 is the root)
    and log10 of the next-symbol probabilities."""

    classes: np.ndarray
    share: np.ndarray
    states: list[tuple[np.ndarray, np.ndarray]]
    logp: np.ndarray

    def table(self) -> np.ndarray:
        """The longest suffix state of every context of ``DEPTH`` symbols."""
        out = np.zeros(1, np.int32)
        for keys, rows in self.states:
            out = np.tile(out, SYMBOLS)
            out[keys] = rows
        return out

    def shared(self, spark: SparkSession):
        return spark.sparkContext.broadcast((uuid.uuid4().hex, dict(vars(self))))


def _opened(shared) -> tuple[SuffixTree, np.ndarray]:
    """A worker holds the tree it used last, with its table of contexts."""
    tag, state = shared.value
    if kept_in_worker("tree", lambda: [None])[0] != tag:
        tree = SuffixTree(**state)
        kept_in_worker("tree", list)[:] = [tag, tree, tree.table()]
    _, tree, states = kept_in_worker("tree", list)
    return tree, states


def grow_tree(counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], classes: np.ndarray, share: np.ndarray) -> SuffixTree:
    """A tree from the counts by depth: context, next symbol, how often."""
    probs = np.zeros(SYMBOLS)
    _, nxt, n = counts.get(0, (np.zeros(0, np.int64),) * 3)
    np.add.at(probs, nxt, n)
    total = max(2.0, probs.sum())
    probs[1:] += 0.5
    probs[PAD] = 0
    blocks = [(probs / probs.sum())[None, :]]
    size, states = 1, []
    table = np.zeros(1, np.int32)
    for depth in range(1, DEPTH + 1):
        table = np.tile(table, SYMBOLS)
        ctx, nxt, n = counts.get(depth, (np.zeros(0, np.int64),) * 3)
        keys, place = np.unique(ctx, return_inverse=True)
        c = np.zeros((len(keys), SYMBOLS))
        np.add.at(c, (place, nxt), n)
        parent = np.concatenate(blocks)[table[keys]] if len(keys) else c
        all_ = c.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(c > 0, c * np.log(c / all_ / parent), 0).sum(axis=1)
        keep = gain > 0.5 * (c > 0).sum(axis=1) * np.log(total)
        keys, c, parent, all_ = keys[keep], c[keep], parent[keep], all_[keep]
        rows = np.arange(size, size + len(keys), dtype=np.int32)
        blocks.append((c + SMOOTHING * parent) / (all_ + SMOOTHING))
        table[keys] = rows
        states.append((keys.astype(np.int64), rows))
        size += len(keys)
    with np.errstate(divide="ignore"):
        return SuffixTree(classes, share, states, np.log10(np.concatenate(blocks)).astype(np.float32))


def fit_tree(docs: DataFrame, byte_counts: np.ndarray, p_min: float = P_MIN) -> SuffixTree:
    """The tree of the texts of ``docs`` (text).  Counts cover all of them; what
    comes to the driver are the next symbols of the contexts that hold at
    least ``p_min`` of all symbols, at most 1 / p_min contexts a depth."""
    classes, share = symbol_classes(byte_counts)

    def grams(data, offsets):
        sym, *_ = spelt(data, offsets, classes)
        code = (contexts(sym) << 6) | sym
        kinds, n = np.unique(code[sym != PAD], return_counts=True)
        yield kinds.astype(np.int64), n

    found = _count(docs, grams, "lm-grams")
    total = found.agg(F.sum("n")).first()[0] or 0
    counts = {}
    for depth in range(DEPTH + 1):
        ctx = F.shiftright("key", 6).bitwiseAND((1 << 6 * depth) - 1)
        by = found.select(ctx.alias("ctx"), F.col("key").bitwiseAND(SYMBOLS - 1).alias("nxt"), "n").groupBy("ctx", "nxt").agg(F.sum("n").alias("n"))
        often = by.groupBy("ctx").agg(F.sum("n").alias("all")).filter(F.col("all") >= max(2.0, p_min * total)).select("ctx")
        got = by.join(often, "ctx").toArrow()
        counts[depth] = tuple(got[c].to_numpy().astype(np.int64) for c in ("ctx", "nxt", "n"))
    discard(found)
    return grow_tree(counts, classes, share)


# --- scores -----------------------------------------------------------------------------


def score_rows(data: np.ndarray, offsets: np.ndarray, tree: SuffixTree, states: np.ndarray):
    """log10 probability of each row, word keys, each row's first word, and
    log10 probability of each word."""
    sym, end, keys, first, (a, z, starts, ends) = spelt(data, offsets, tree.classes)
    got = tree.logp.ravel()[states[contexts(sym)] * SYMBOLS + sym]
    got[sym == PAD] = 0
    total = np.concatenate([[0], np.cumsum(got, dtype=np.float64)])
    begin = np.concatenate([[0], end[:-1] + 1])
    rare = np.concatenate([[0], np.cumsum(tree.share[data])])
    return total[end + 1] - total[begin] + rare[offsets[1:]] - rare[offsets[:-1]], keys, first, total[z] - total[a] + rare[ends] - rare[starts]


def word_contexts(words: np.ndarray, first: np.ndarray, logp: np.ndarray):
    """Of the words after a candidate context: row, key of the context, the
    word, log10 probability in the tree.  ``words`` are ranks of head words or
    keys of others; two ranks make an exact key, which is below 2^42."""
    n = len(words) - CONTEXT_WORDS
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    row = row_of(first, len(words))
    at = np.flatnonzero(row[:n] == row[CONTEXT_WORDS:])
    key = _joined(words[at], words[at + 1], RANK_BITS)
    if ANCHORS > 1:
        some = mix64(key) % np.uint64(ANCHORS) == 0
        at, key = at[some], key[some]
    to = at + CONTEXT_WORDS
    return row[to], key, words[to], logp[to]


def _joined(left: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """Keys of pairs: both side by side where the left is below 2^bits and the
    word a rank, else a hash with the top bit set."""
    with np.errstate(over="ignore"):
        hashed = mix64(mix64(left) + word * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1 << 63)
    return np.where((left >> np.uint64(bits) == 0) & (word >> np.uint64(RANK_BITS) == 0), (left << np.uint64(RANK_BITS)) | word, hashed)


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((mix64(key) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes by place value, each place compressed for itself."""
    codec, sizes, out = kept_in_worker("zstd", lambda: pa.Codec("zstd", compression_level=1)), [], []
    for a in arrays:
        sizes.append(len(a))
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        for k in range(a.itemsize):
            plane = np.ascontiguousarray(planes[:, k])
            out.append(codec.compress(plane.data, asbytes=True) if plane.any() else b"")
            sizes.append(len(out[-1]))
    return np.array(sizes, np.uint32).tobytes() + b"".join(out)


def unpacked(body, *types) -> list[np.ndarray]:
    """The arrays that ``packed`` got, of these types."""
    codec, body = kept_in_worker("zstd", lambda: pa.Codec("zstd", compression_level=1)), memoryview(body)
    types = [np.dtype(t) for t in types]
    fields = sum(1 + t.itemsize for t in types)
    sizes, at, i, out = np.frombuffer(body, np.uint32, fields).tolist(), 4 * fields, 0, []
    for t in types:
        n = sizes[i]
        planes = np.zeros((n, t.itemsize), np.uint8)
        for k, size in enumerate(sizes[i + 1 : i + 1 + t.itemsize]):
            if size:
                planes[:, k] = np.frombuffer(codec.decompress(body[at : at + size], n), np.uint8)
                at += size
        i += 1 + t.itemsize
        out.append(planes.view(t).reshape(n))
    return out


#: What a part gets of a pack: contexts (first bits of their keys as
#: differences, last bits), how many next words each has; the next words, how
#: often they are learnt, their log10 probability; other words (differences),
#: their counts.  And where: how many rows each next or other word has, the rows, how often.
WHAT = (np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.float32, np.uint64, np.uint64)
WHERE = (np.uint32, np.uint32, np.uint32)
#: What a part gives back to a pack: rows, their score, base score, known words.
BACK = (np.uint32, np.float32, np.float64, np.uint32)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=np.uint64(0))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_part(words, first, logp, learnt, asked, deep: bool, parts: int):
    """part, what, where of the places of some rows (see ``WHAT``)."""
    other = np.flatnonzero(words >> np.uint64(63))
    o_row = row_of(first, len(words))[other]
    other, o_row = words[other][asked[o_row]], o_row[asked[o_row]]
    order = np.argsort(other, kind="stable")
    order = order[np.argsort(_part_of(other[order], parts), kind="stable")]
    other, o_row = other[order], o_row[order]
    row, key, word, lp = word_contexts(words, first, logp) if deep else word_contexts(words[:0], first, logp)
    both = _joined(key, word, 2 * RANK_BITS)
    exact = both >> np.uint64(63) == 0
    order, rest = np.flatnonzero(exact), np.flatnonzero(~exact)
    order = np.concatenate([order[np.argsort(both[order], kind="stable")], rest[np.lexsort((word[rest], key[rest]))]])
    part = _part_of(key[order], parts)
    at = np.argsort(part, kind="stable")
    order, part = order[at], part[at]
    row, key, word, lp = row[order], key[order], word[order], lp[order]
    # One entry for each next word of a context and row, one item for all its rows.
    item = _runs(key, word)
    learns = np.concatenate([[0], np.cumsum(learnt[row])])
    learns = np.diff(learns[np.append(item, len(row))]).astype(np.uint32)
    entry = _runs(key, word, row)
    times = np.diff(np.append(entry, len(row)))
    places = np.diff(np.searchsorted(entry, np.append(item, len(row))))
    wanted = asked[row[entry]]
    places = np.bincount(np.repeat(np.arange(len(item)), places)[wanted], minlength=len(item)) if not wanted.all() else places
    e_row, times, part = row[entry][wanted], times[wanted], part[item]
    key, word, lp = key[item], word[item], lp[item]
    e_end = np.concatenate([[0], np.cumsum(places)])
    o_entry = _runs(other, o_row)
    o_times, o_e_row = np.diff(np.append(o_entry, len(other))), o_row[o_entry]
    o_item = _runs(other)
    o_places = np.diff(np.searchsorted(o_entry, np.append(o_item, len(other))))
    other = other[o_item]
    o_end = np.concatenate([[0], np.cumsum(o_places)])
    o_part = _part_of(other, parts)
    for q in np.union1d(part, o_part).tolist():
        (i, j), (k, m) = np.searchsorted(part, [q, q + 1]), np.searchsorted(o_part, [q, q + 1])
        c = _runs(key[i:j])
        ctx, nexts = key[i:j][c], np.diff(np.append(c, j - i))
        what = packed(
            _steps(ctx >> np.uint64(RANK_BITS)), (ctx & np.uint64(RANKS - 1)).astype(np.uint32), nexts.astype(np.uint32),
            word[i:j], learns[i:j], lp[i:j], _steps(other[k:m]), np.zeros(0, np.uint64),
        )
        e, o = slice(e_end[i], e_end[j]), slice(o_end[k], o_end[m])
        where = packed(*(np.concatenate(x).astype(np.uint32) for x in ((places[i:j], o_places[k:m]), (e_row[e], o_e_row[o]), (times[e], o_times[o]))))
        yield int(q), what, where


def _gains(key, word, n, lp, places: int) -> np.ndarray:
    """What scoring each next word in its context adds to its log10
    probability in the tree; 0 where the context isn't retained."""
    _, at, item = np.unique(_joined(key, word, 2 * RANK_BITS), return_index=True, return_inverse=True)
    n, p = np.bincount(item, n, len(at)), lp[at].astype(np.float64)
    _, ctx = np.unique(key[at], return_inverse=True)
    all_ = np.bincount(ctx, n)
    some = n > 0
    sums = np.bincount(ctx[some], n[some] * (np.log(n[some]) - p[some] * np.log(10)), len(all_)) - all_ * np.log(np.maximum(all_, 1))
    kept = (all_ >= LEAST_MET) & (sums > np.bincount(ctx, some) * (0.5 * np.log(max(2.0, ANCHORS * places))))
    # (n + w p) / (N + w), over p.
    with np.errstate(divide="ignore", over="ignore"):
        seen = np.where(p < -300, np.log10(n / TREE_WEIGHT) - p, np.log10(1 + n / TREE_WEIGHT * 10.0 ** np.minimum(-p, 300)))
    return np.where(kept[ctx], np.where(some, seen, 0) + np.log10(TREE_WEIGHT / (all_ + TREE_WEIGHT))[ctx], 0)[item]


@dataclass
class Contexts:
    """The texts that contexts are learnt from (none: those of the scored rows
    whose column ``learnt`` holds), and how many words in them follow one."""

    docs: DataFrame | None
    places: int


def fit_contexts(docs: DataFrame, tree: SuffixTree, scored: bool = False) -> Contexts:
    """The contexts of the texts of ``docs`` (text).  They are counted in the
    shuffle that scores; ``scored``: these texts are among the scored ones."""

    def run(batches):
        working_on("lm")
        for batch in batches:
            n = 0
            for _, _, data, offsets in slices(*buffers(batch.column("text"))):
                *_, first = word_spans(data, offsets, WORD_BYTES)
                n += int(np.maximum(np.diff(first) - CONTEXT_WORDS, 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    docs = plain(docs, "text")
    return Contexts(None if scored else docs, map_arrow(docs, run, "n long").agg(F.sum("n")).first()[0] or 0)


def score_documents(docs: DataFrame, tree: SuffixTree, words: DataFrame, train_rows: int, contexts: Contexts | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row
    of ``docs`` (doc_id, text).  ``words`` are the training words' counts;
    without ``contexts`` the tree scores alone.

    Rows go in packs of about ``PACK_BYTES``.  A pack sends each part of the
    contexts and of the words outside the head what it has of them, compressed; a
    part counts, retains, and sends back to each pack what its rows gain."""
    spark = docs.sparkSession
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = (sums.n or 0) + train_rows, sums.v + (train_rows > 0)
    scale = float(np.log10(tokens + ALPHA * (kinds + 1)))
    least = max(1, -(-tokens // HEAD_SHARE))
    head = words.filter(F.col("n") >= least).select("key", "n").toArrow()  # HEAD_SHARE rows at most
    key = head["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    key, often = key[order], head["n"].to_numpy().astype(np.int64)[order]
    rank = np.zeros(len(key), np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(key), dtype=np.uint32)
    bits = 20
    edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(63 - bits)) | np.uint64(1 << 63)
    start = np.concatenate([np.searchsorted(key, edges), [len(key)]])
    shared_head, shared_tree = spark.sparkContext.broadcast((key, often, rank, start)), tree.shared(spark)
    deep, places = contexts is not None, contexts.places if contexts else 0
    parts = 1 + max(tokens, places) // PART_PLACES
    end_base, end_known = float(np.log10(train_rows + ALPHA)) - scale, int(train_rows > 0)

    def lookup(h):
        """Counts of head words, and words: the head's as ranks."""
        key, often, rank, start = shared_head.value
        out, named = np.zeros(len(h), np.int64), h.copy()
        b = ((h >> np.uint64(63 - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        at, stop, of = start[b], start[b + 1], np.arange(len(h))
        while len(of):
            more = at < stop
            at, stop, of = at[more], stop[more], of[more]
            hit = key[at] == h[of]
            out[of[hit]], named[of[hit]] = often[at[hit]], rank[at[hit]]
            at, stop, of = at[~hit] + 1, stop[~hit], of[~hit]
        return out, named

    def send(pack, held):
        doc_id, n_tokens, known, base, score, named, logp, learnt, asked = zip(*held)
        about = pa.RecordBatch.from_arrays([pa.concat_arrays(doc_id), *(pa.array(np.concatenate(x)) for x in (n_tokens, known, base, score, asked))], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "asked"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as to:
            to.write_batch(about)
        yield -1 - int(mix64(np.array([pack], np.uint64))[0] % np.uint64(parts)), sink.getvalue().to_pybytes(), None
        first = np.concatenate([[0], np.cumsum(np.concatenate(n_tokens) - 1)])
        yield from _by_part(np.concatenate(named), first, np.concatenate(logp), np.concatenate(learnt), np.concatenate(asked), deep, parts)

    def rows(pack, sent):
        for part, what, where in sent:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack], pa.int64()), pa.array([what], pa.binary()), pa.array([where], pa.binary())], names=["part", "pack", "what", "where"])

    def run(batches):
        working_on("lm")
        tree_, states = _opened(shared_tree)
        pack, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            learnt, asked = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("learnt", "asked"))
            for i, j, data, offsets in slices(*buffers(batch.column("text"))):
                score, h, first, logp = score_rows(data, offsets, tree_, states)
                c, named = lookup(h)
                known = c > 0
                sums_ = np.concatenate([[0], np.cumsum(np.where(known, np.log10(c + ALPHA) - scale, 0))])
                base = sums_[first[1:]] - sums_[first[:-1]] + end_base
                n_known = np.bincount(row_of(first, len(h))[known], minlength=j - i) + end_known
                held.append((batch.column("doc_id").slice(i, j - i), np.diff(first) + 1, n_known, base, score, named, logp.astype(np.float32), learnt[i:j], asked[i:j]))
                size += len(data)
                if size >= PACK_BYTES:
                    yield from rows(pack, send(pack, held))
                    pack, held, size = pack + 1, [], 0
            tidy(batch.nbytes)
        if held:
            yield from rows(pack, send(pack, held))

    def tail(batches):
        working_on("lm")
        for batch in batches:
            key, n = batch.column("key").to_numpy().astype(np.int64).view(np.uint64), batch.column("n").to_numpy().astype(np.uint64)
            part = _part_of(key, parts)
            order = np.lexsort((key, part))
            key, n, part = key[order], n[order], part[order]
            none = [np.zeros(0, t) for t in WHAT[:6]]
            for q in np.unique(part).tolist():
                i, j = np.searchsorted(part, [q, q + 1])
                yield from rows(-1, [(q, packed(*none, _steps(key[i:j]), n[i:j]), None)])

    def gather(group):
        working_on("lm")
        if group["part"][0].as_py() < 0:  # rows of packs pass
            return pa.table([group["pack"], group["what"], pa.array([True] * len(group))], names=["pack", "body", "about"])
        met, found, counted = [], [], []
        packs = group["pack"].to_pylist()
        for pack, body in zip(packs, group["what"]):
            hi, lo, nexts, word, n, lp, other, count = unpacked(body.as_buffer(), *WHAT)
            other = np.cumsum(other, dtype=np.uint64)
            if pack < 0:
                counted.append((other, count))
                continue
            met.append((np.repeat((np.cumsum(hi, dtype=np.uint64) << np.uint64(RANK_BITS)) | lo, nexts), word, n, lp))
            found.append(other)
        if not met:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.bool_())], names=["pack", "body", "about"])
        ends = np.cumsum([len(m[1]) for m in met])
        gains = _gains(*(np.concatenate(x) for x in zip(*met)), places)
        del met
        word, count = (np.concatenate(x) for x in zip(*counted)) if counted else (np.zeros(0, np.uint64),) * 2
        order = np.argsort(word)
        word, count = word[order], count[order].astype(np.int64)
        out, k = [], 0
        for pack, body in zip(packs, group["where"]):
            if pack < 0:
                continue
            gain, other = gains[ends[k - 1] if k else 0 : ends[k]], found[k]
            k += 1
            c = np.zeros(len(other), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, other), len(word) - 1)
                c = np.where(word[at] == other, count[at], 0)
            entries, row, times = unpacked(body.as_buffer(), *WHERE)
            n = int(row.max(initial=0)) + 1
            value = np.repeat(np.concatenate([gain, np.log10(c + ALPHA) - scale]), entries) * times
            cut = int(entries[: len(gain)].sum())
            score, base = np.bincount(row[:cut], value[:cut], n), np.bincount(row[cut:], value[cut:], n)
            known = np.bincount(row[cut:], (np.repeat(c, entries[len(gain) :]) > 0) * times[cut:], n)
            at = np.flatnonzero((score != 0) | (base != 0))
            out.append((pack, packed(at.astype(np.uint32), score[at].astype(np.float32), base[at], known[at].astype(np.uint32))))
        tidy()
        return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary()), pa.array([False] * len(out))], names=["pack", "body", "about"])

    def finish(group):
        about = group.filter(group["about"])["body"][0].as_buffer()
        about = pa.ipc.open_stream(about).read_all()
        n_known, base, score = (about[c].to_numpy().copy() for c in ("n_known", "base_score", "score"))
        for body in group.filter(pc.invert(group["about"]))["body"]:
            at, s, b, k = unpacked(body.as_buffer(), *BACK)
            score[at] += s
            base[at] += b
            n_known[at] += k
        out = pa.table([about["doc_id"], about["n_tokens"], pa.array(n_known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])
        return out.filter(about["asked"])

    learnt = F.col("learnt") if deep and contexts.docs is None else F.lit(False)
    texts = docs.select(F.col("`doc_id`"), F.col("`text`"), learnt.alias("learnt"), F.lit(True).alias("asked"))
    if deep and contexts.docs is not None:
        no_id = F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")
        texts = texts.unionByName(contexts.docs.select(no_id, "text", F.lit(True).alias("learnt"), F.lit(False).alias("asked")))
    sent = "part int, pack long, what binary, where binary"
    sent = map_arrow(texts, run, sent).unionByName(map_arrow(words.filter(F.col("n") < least).select("key", "n"), tail, sent))
    back = sent.groupBy("part").applyInArrow(gather, "pack long, body binary, about boolean")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)]).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    per = back.groupBy("pack").applyInArrow(finish, schema)
    return per.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    train = docs.filter(fold_of("doc_id", 10) != 0)
    words, byte_counts = count_words(train)
    tree = fit_tree(train, byte_counts)
    contexts = fit_contexts(train, tree, scored=True)
    out = score_documents(docs.withColumn("learnt", fold_of("doc_id", 10) != 0), tree, words, train.count(), contexts)
    return out.withColumn("held_out", fold_of("doc_id", 10) == 0)
