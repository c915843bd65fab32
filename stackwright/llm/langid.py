"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound from its
letters' vectors, each rotated by its place, and multiplied; a text bundles (adds)
the vectors of its trigrams, and a language bundles all of its training texts.
A text has the language whose prototype lies at the smallest angle.  Letters are
lower-cased; whatever lies between letters counts as one space.

Vectors are drawn from the letter itself, so every executor makes the same
ones, and sums are whole numbers: results don't depend on how rows are dealt.

Defined results: a null text, or one without letters, is ``und`` with score 0;
with no labelled text every prediction is ``und``; null labels aren't learnt;
repeated rows count again; other columns are ignored.  Letters beyond the
first 26 share ``CLASSES - 27`` vectors by a hash of their code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, discard, fold_of, kept_in_worker, map_arrow, mix64, plain, slices, staged, table, working_on

DIMENSIONS = 1024
CLASSES = 256
UNKNOWN = "und"
#: The trigrams from which the least cosine holds.
LONG = 200
_SLICE = 1 << 20


def _letter_classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 no letter, 1-26 a-z."""
    out = np.zeros(0x10000, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            low = ord(low) if len(low) == 1 else cp
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (CLASSES - 27)
    return out


def _vectors(dimensions: int) -> np.ndarray:
    bits = mix64(np.arange(1, CLASSES * dimensions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(bits >> np.uint64(63), 1, -1).astype(np.int8).reshape(CLASSES, dimensions)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every trigram with a letter; a row reads ' letters '."""
    classes = kept_in_worker("letter-classes", _letter_classes)
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = np.minimum(lead[offsets], len(cp))
    high = cp > 0xFFFF
    code = classes[np.where(high, 0, cp)]
    if high.any():
        code[high] = [27 + (int(c) * 2654435761 >> 7) % (CLASSES - 27) if chr(c).isalpha() else 0 for c in cp[high]]
    n = len(offsets) - 1
    # A space before and after each row.
    sym = np.zeros(len(code) + 2 * n, np.uint8)
    row = np.repeat(np.arange(n), np.diff(at) + 2)
    inner = np.arange(len(code)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1
    sym[inner] = code
    keep = sym > 0
    keep[1:] |= (sym[:-1] > 0) | (row[1:] != row[:-1])
    if len(keep):
        keep[0] = True
    sym, row = sym[keep].astype(np.int32), row[keep]
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    ok = (row[2:] == row[:-2]) & (sym[1:-1] > 0)
    return row[2:][ok], ((sym[:-2] << 16) | (sym[1:-1] << 8) | sym[2:])[ok]


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of the rows, and the rows' counts of them."""
    row, code = trigrams(data, offsets)
    seen = kept_in_worker("trigram-seen", lambda: np.zeros(1 << 24, bool))
    place = kept_in_worker("trigram-place", lambda: np.zeros(1 << 24, np.int32))
    seen[code] = True
    kinds = np.flatnonzero(seen)
    seen[kinds] = False
    place[kinds] = np.arange(len(kinds), dtype=np.int32)
    n = len(offsets) - 1
    flat = np.bincount(row * len(kinds) + place[code], minlength=n * len(kinds)) if len(kinds) else np.zeros(0)
    return kinds, flat.reshape(n, len(kinds)).astype(np.float32)


def bound(kinds: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigrams: letter vectors rotated by place, multiplied."""

    def made():
        v = _vectors(dimensions)
        return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v

    a, b, c = kept_in_worker(f"letter-vectors-{dimensions}", made)
    return (a[kinds >> 16] * b[(kinds >> 8) & 255] * c[kinds & 255]).astype(np.float32)


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Runs of rows, by bytes and at most 500 rows, so the counts stay small."""
    for i, j, part, at in slices(data, offsets, _SLICE):
        for k in range(i, j, 500):
            z = min(j, k + 500)
            yield k, z, part[at[k - i] : at[z - i]], at[k - i : z - i + 1] - at[k - i]


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages of ``docs`` (text, lang) and their bundled vectors."""

    def bundle(batches):
        working_on("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, data, offsets in _blocks(*buffers(batch.column("text"))):
                kinds, counts = counted(data, offsets)
                if not len(kinds):
                    continue
                names = sorted(set(langs[i:j]))
                pick = np.array([[x == name for x in langs[i:j]] for name in names], np.float32)
                for name, v in zip(names, (pick @ counts).astype(np.float64) @ bound(kinds, dimensions).astype(np.float64)):
                    sums[name] = sums.get(name, 0) + v
        for name, v in sums.items():
            if not v.any():  # labelled, but without letters
                continue
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "d": np.arange(dimensions, dtype=np.int32), "v": np.rint(v).astype(np.int64)})

    rows = plain(docs, "text", "lang").filter("text is not null and lang is not null")
    # A row for each language and dimension comes to the driver.
    sums = map_arrow(rows, bundle, "lang string, d int, v long").groupBy("lang", "d").agg(F.sum("v").alias("v")).collect()
    names = sorted({r.lang for r in sums})
    out = np.zeros((len(names), dimensions))
    for r in sums:
        out[names.index(r.lang), r.d] = r.v
    return names, out


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """record (a struct of the columns ``keep`` of ``docs``, all by default, so
    that no name can clash), lang_pred, score, the cosine of text and prototype,
    at 0 where it is below, and n_grams, the text's trigrams."""
    dimensions = prototypes.shape[1] if len(names) else DIMENSIONS
    unit = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    if keep is None:
        keep = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("record"), F.col("text").alias("text"))
    out_schema = rows.select("record").schema.add("lang_pred", "string").add("score", "double").add("n_grams", "long")

    def label(batches):
        working_on("langid")
        for batch in batches:
            said, score, grams = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, data, offsets in _blocks(*buffers(batch.column("text"))) if names else ():
                kinds, counts = counted(data, offsets)
                if not len(kinds):
                    continue
                v = counts @ bound(kinds, dimensions)
                near = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = near.argmax(axis=1)
                has = counts.any(axis=1)
                for k in np.flatnonzero(has):
                    said[i + k] = names[best[k]]
                score[i:j] = np.where(has, np.clip(near.max(axis=1), 0, 1), 0)
                grams[i:j] = counts.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(said, pa.string()), pa.array(score), pa.array(grams)], names=["record", "lang_pred", "score", "n_grams"])

    return map_arrow(rows, label, out_schema)


def exact_percentile(values: DataFrame, column: str, share: float, bins: int = 1 << 16) -> float | None:
    """What ``percentile`` gives, null for no rows, with at most ``bins`` counts
    in one place however many values there are: counts of equal bins of values
    are narrowed to the one that holds the rank sought.  Reads ``values`` a few times."""
    v = values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    all_ = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not all_.n:
        return None

    def at(rank):
        lo, hi, left = all_.lo, all_.hi, rank
        while lo < hi:
            cell = F.floor((F.col("v") - lo) / (hi - lo) * float(bins - 1))
            by = v.filter(F.col("v").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell")
            for r in by.collect():  # ``bins`` rows at most
                if left < r.n:
                    lo, hi = r.lo, r.hi
                    break
                left -= r.n
        return lo

    place = share * (all_.n - 1)
    low = int(place)
    return at(low) if place == low else (low + 1 - place) * at(low) + (place - low) * at(low + 1)


def least_cosine(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> float:
    """The cosine below which a text of ``LONG`` trigrams or more is in no known
    language: half of what all but one in a hundred labelled texts of that
    length reach.  All labelled rows count."""
    known = plain(docs, "text", "lang").filter("text is not null and lang is not null")
    scores = staged(predict(known, names, prototypes, ["lang"]).filter(F.col("n_grams") >= LONG).select("score"), "langid-scores")
    found = exact_percentile(scores, "score", 0.01)
    discard(scores)
    return (found or 0.0) / 2


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text is in a language of its
    labels: it has letters, and if it is long its cosine isn't below
    ``least_cosine``.  Short texts have few trigrams and low cosines in any
    language, so letters suffice.  Without any label all lettered texts stay."""
    names, prototypes = learn_prototypes(docs)
    if not names:
        return docs.filter(docs["text"].rlike(r"\p{L}"))
    least = least_cosine(docs, names, prototypes)
    found = predict(docs, names, prototypes)
    return found.filter((F.col("lang_pred") != UNKNOWN) & ((F.col("n_grams") < LONG) | (F.col("score") >= least))).select("record.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    names, prototypes = learn_prototypes(docs.filter(fold_of("doc_id", 5) != 0))
    out = predict(docs, names, prototypes, ["doc_id"]).select("record.doc_id", "lang_pred", "score")
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
