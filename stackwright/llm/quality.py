"""Quality rules: decision lists learnt by sequential covering.

Statistics of whole texts are joined with labelled quality.  A rule for poor
documents grows by adding the threshold test of largest information gain on one
part of the labelled rows, and is pruned from its end on the other; it is kept
if it is precise there, what it covers is set aside, and the next one grows.
The list becomes one ordered Spark CASE expression over the statistics.

Windows and lines are compared by 64-bit hashes.  Defined results: a null or
empty text has no words and fails the base rules; without labelled rows of both
kinds the list is empty and keeps all that passes the base rules; labels that
are null, or of unknown documents, aren't used; repeated rows are judged each.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LINE_BYTES, WORD_BYTES, buffers, discard, map_arrow, mix64, plain, row_of, slices, span_hash, staged, table, windows, word_spans, working_on

#: At most so many labelled rows, in hash order, fit the rules.
LABELLED_ROWS = 100_000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_digits", "n_upper", "n_marks", "longest"]
#: What the rules may test: name and expression over the counts.
FEATURES = {
    "n_words": "n_words", "mean_word": "word_chars / n_words", "symbols": "n_symbols / n_words", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / n_words",
    "distinct": "n_distinct / n_words", "line_words": "n_words / greatest(n_lines, 1)", "digits": "n_digits / word_chars", "upper": "n_upper / word_chars", "marks": "n_marks / word_chars", "longest": "longest",
}


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more, and which of them aren't the first."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    later[order[1:][same]] = True
    return often, later


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    a, z, n = offsets[:-1], offsets[1:], len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, WORD_BYTES)
    word_row, h = row_of(first, len(starts)), span_hash(data, starts, ends)
    count = lambda rows: np.bincount(rows, minlength=n)
    out = {"n_words": np.diff(first)}
    inside = WORD_BYTES[data]
    lead = (data & 0xC0) != 0x80
    out["word_chars"] = _sums(inside & lead, a, z)
    out["n_symbols"] = _sums(np.isin(data, list(SYMBOLS)), a, z)
    out["n_digits"] = _sums((data >= 48) & (data <= 57), a, z)
    out["n_upper"] = _sums((data >= 65) & (data <= 90), a, z)
    out["n_marks"] = _sums(np.isin(data, list(b".,;:!?")), a, z)
    length = _sums(lead, starts, ends)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, word_row, length)
    out["longest"] = longest
    w = windows(h, WINDOW)
    at = np.flatnonzero(word_row[: len(w)] == word_row[WINDOW - 1 :]) if len(w) else np.zeros(0, np.int64)
    at = at[_repeated(_in_row(w[at], word_row[at]))[0]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out["n_repeat_words"] = count(word_row[np.cumsum(cover)[:-1] > 0])
    out["n_distinct"] = out["n_words"] - count(word_row[_repeated(_in_row(h, word_row))[1]])
    ls, le, lf = word_spans(data, offsets, LINE_BYTES)
    line_row, line = row_of(lf, len(ls)), span_hash(data, ls, le)
    said = _sums(inside, ls, le) > 0
    line_row, line = line_row[said], line[said]
    out["n_lines"] = count(line_row)
    out["n_dup_lines"] = count(line_row[_repeated(_in_row(line, line_row))[1]])
    return out


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text of ``docs`` (doc_id, text)."""
    rows = plain(docs, "doc_id", "text")
    schema = rows.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def measure(batches):
        working_on("quality")
        for batch in batches:
            for i, j, data, offsets in slices(*buffers(batch.column("text"))):
                s = _stats(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *[pa.array(s[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", *COUNTS])

    return map_arrow(rows, measure, schema)


# --- the rules --------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, x: np.ndarray) -> np.ndarray:
        c = x[:, list(FEATURES).index(self.feature)]
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]

    def __str__(self) -> str:
        return " AND ".join(map(str, self.tests))

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> Rule:
    tests: list[Test] = []
    inside = np.ones(len(x), bool)
    while len(tests) < most and (~y[inside]).any():
        p, n = y[inside].sum(), inside.sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for k, name in enumerate(FEATURES):
            v = x[inside, k]
            order = np.argsort(v, kind="stable")
            v, hit = v[order], np.cumsum(y[inside][order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            for above in (False, True):
                tp = (p - hit[cut] if above else hit[cut]).astype(float)
                all_ = (n - cut - 1 if above else cut + 1).astype(float)
                gain = np.where(tp > 0, tp * (np.log2(np.maximum(tp, 1e-9) / all_) - np.log2(p / n)), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), Test(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(x)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = r.holds(x)
        return (2 * y[m].sum() - m.sum()) / max(1, m.sum())

    best = rule
    for n in range(len(rule.tests) - 1, 0, -1):
        if worth(shorter := Rule(rule.tests[:n])) >= worth(best):
            best = shorter
    return best


def learn_rules(x: np.ndarray, poor: np.ndarray, turn: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 16, most_tests: int = 4) -> list[Rule]:
    """Rules for the ``poor`` rows.  ``turn`` deals rows to growing (0, 1) and
    pruning (2).  A rule must be right for ``precision`` of the rows it covers
    in both parts together, and cover at least ``least`` poor ones.  The list ends
    after ``most_rules`` rules, and a rule after ``most_tests`` tests: they bound
    the size of the model, not the rows it learns from or judges."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and poor[left].any():
        grow, hold = left & (turn != 2), left & (turn == 2)
        if not poor[grow].any():
            break
        rule = _grow(x[grow], poor[grow], most_tests)
        if not rule.tests:
            break
        rule = _prune(rule, x[hold], poor[hold])
        m = rule.holds(x) & left
        if poor[m].sum() < max(least, precision * m.sum()):
            break
        rules.append(rule)
        left &= ~m
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, **options) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality), on at most ``rows`` labelled
    rows taken in hash order."""
    known = plain(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").distinct()
    joined = staged(
        stats.filter("n_words > 0").join(known, "doc_id").select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("h"), "quality", *[F.expr(e).cast("double").alias(f"f_{n}") for n, e in FEATURES.items()]), "quality-labelled"
    )
    # The first rows in hash order lie below a bound that the count gives, with five standard
    # deviations to spare; only what lies below it is sorted and sent.
    share = (rows + 5 * rows**0.5 + 100) / max(1, joined.count())
    below = joined if share >= 1 else joined.filter(F.col("h") < F.lit(int((share - 0.5) * 2**64)))
    got = below.orderBy("h", "doc_id", "quality").limit(rows).toPandas()
    discard(joined)
    x = got[[f"f_{n}" for n in FEATURES]].to_numpy(float)
    return learn_rules(x, got["quality"].to_numpy() == 0, np.arange(len(got)) % 3, **options)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the number of the first
    rule that holds, or null."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("CASE " + " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(rules)) + " END")


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, rule (number of the first rule that
    rejects) and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", F.when(F.col("n_words") > 0, verdict(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(text_statistics(table(spark, sf_dir, "documents")), "quality-stats")
    out = judged(stats, fit_rules(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
