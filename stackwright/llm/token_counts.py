"""Token counts as an exact length histogram.

Documents are summed by encoded length; suffix sums over the lengths answer
totals, quantiles and truncated totals for every context limit.  The table has
a row for each distinct length, so it is bounded by the longest document.

Defined results: a null text has length 0, as an empty one has; repeated rows
count again; an empty table gives an empty histogram.  Other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, map_arrow, plain, slices, staged, table, tidy, working_on
from .encoding import SLICE, Encoder, shipped

_RANGE = 1024


def length_histogram(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """n_tokens, docs for each distinct encoded length of ``docs`` (text), staged:
    its users read it more than once and texts are encoded once."""
    shared = shipped(docs.sparkSession, tokenizer_path)

    def count(batches):
        working_on("encoding")
        encoder, seen = Encoder.of(shared), Counter()
        for batch in batches:
            for _, _, data, offsets in slices(*buffers(batch.column("text")), most=SLICE):
                seen.update(encoder.encode_rows(data, offsets)[1].tolist())
            tidy(batch.nbytes)
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(seen.keys(), pa.int64()), "docs": pa.array(seen.values(), pa.int64())})

    return staged(map_arrow(plain(docs, "text"), count, "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "token-lengths")


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length, as a context limit: docs_at_least, tokens_at_least
    (of the documents of that length or more), total_tokens, quantile (share of
    the documents of at most that length) and truncated_tokens (the total when
    each document is cut to the limit).  Summed in ranges of lengths."""
    h = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "range": F.expr(f"n_tokens div {_RANGE}")})
    after = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("range", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    h = h.withColumns({"d_in": F.sum("docs").over(inside), "t_in": F.sum("tokens").over(inside)}).join(sums, "range")
    h = h.withColumns({"docs_at_least": F.col("d_after") + F.col("d_in"), "tokens_at_least": F.col("t_after") + F.col("t_in")})
    return h.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("total_docs")).alias("quantile"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut, tokens_kept for any limits, from the suffix sums: the
    next longer length has the same suffix."""
    want = F.broadcast(sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long"))  # as many rows as limits
    longer = sums.join(want, F.col("n_tokens") > F.col("limit")).groupBy("limit").agg(
        F.max("docs_at_least").alias("docs_cut"), (F.max("tokens_at_least")).alias("cut_tokens"))
    total = sums.agg(F.max("total_tokens")).first()[0]
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = want.join(longer, "limit", "left").withColumn("total", F.lit(total).cast("long"))
    return out.select("limit", zero("docs_cut").alias("docs_cut"), (zero("total") - zero("cut_tokens") + F.col("limit") * zero("docs_cut")).alias("tokens_kept"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the shortest length that holds at least the share of
    the documents."""
    want = F.broadcast(sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return sums.join(want, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
