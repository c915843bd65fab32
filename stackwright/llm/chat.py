r"""Chat formatting over reply trees, in DataFrame functions only.

Messages point at the message they answer.  Self-joins double the pointers
(ancestor at 1, 2, 4 ... steps) and so give each message its depth and the sum
of scores from its root; the leaves of a tree are ranked by that sum, and the
same pointers, walked back, enumerate the messages of each chosen root-to-leaf
path.  Each path becomes one conversation string.

A turn is ``<|im_start|>ROLE\nTEXT<|im_end|>\n``.  Inside texts and roles every
``<``, backslashes, ``|`` gets one more backslash, so no text holds a marker
and the change can be undone.  ``loss_spans`` are the character ranges of the
assistant texts in the string.

Defined results: null text, role or score count as '', '' and 0; a message
whose parent is missing is a root; the links of a cycle are ignored, those of messages below it
hold;
repeated messages are separate ones when the caller numbers them; an empty
table gives no conversation.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain, staged, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: A planted conversation whose texts look like another template's markers.
LOOKALIKE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    parts = F.split(unescape(c), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def root_to_leaf_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) for the messages of the ``best``
    highest-scored branches of each tree (None: all).  ``messages`` has tree,
    node, parent, score; (tree, node) is unique."""
    nodes = plain(messages, "tree", "node", "parent", "score").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    have = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    known = nodes.join(have, _same("tree", "t") & (F.col("parent") == F.col("n")), "left")
    step = staged(known.select("tree", "node", F.col("n").alias("up"), F.lit(0).cast("long").alias("depth"), F.col("score").alias("total"), F.col("score")), "chat-links")
    for _ in range(2):
        jumps, now = [], step.drop("score")
        left = limit = now.count()
        while left and 1 << len(jumps) <= 2 * max(1, limit):
            jumps.append(now.select("tree", "node", "up").filter("up is not null"))
            far = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
            step_size = 1 << (len(jumps) - 1)
            # Only what still points up is joined.
            climbed = now.filter("up is not null").join(far, _same("tree", "t") & (F.col("up") == F.col("n"))).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2") + step_size).alias("depth"), (F.col("total") + F.col("s2")).alias("total")
            )
            now = climbed.unionByName(now.filter("up is null"))
            now = staged(now, "chat-jump")
            left = now.filter("up is not null").count()
        if not left:
            break
        # Whatever still points up has walked as many steps as there are messages, so it
        # points into a cycle, and every message of a cycle is pointed at: their links go.
        loop = now.filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
        cut = step.join(loop, _same("tree", "t") & (F.col("node") == F.col("n")), "left")
        step = staged(cut.select("tree", "node", F.when(F.col("n").isNull(), F.col("up")).alias("up"), "depth", "total", "score"), "chat-cut")

    answered = step.filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = now.join(answered, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")))
    if best is not None:
        ranked = ranked.filter(F.col("rank") <= best)
    paths = staged(ranked.select("tree", F.col("node").alias("leaf"), "rank", "node"), "chat-leaves")
    for jump in reversed(jumps):  # each step reads its paths twice, so they are written
        up = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        paths = staged(paths.union(paths.join(up, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", F.col("up").alias("node"))), "chat-paths")
    at = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return paths.join(at, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", "node", "depth")


def format_conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, rank, n_turns, formatted, loss_spans) for each chosen branch of
    ``messages`` (tree, node, parent, role, text, score)."""
    text = plain(messages, "tree", "node", "role", "text").withColumnsRenamed({"tree": "t", "node": "n"})
    paths = root_to_leaf_paths(messages, best)
    turns = paths.join(text, _same("tree", "t") & (F.col("node") == F.col("n")))
    empty = F.lit("")
    turns = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")))).alias("turns"))
    body = F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("learn"), F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")
    ))
    out = turns.withColumn("parts", body)
    span = "aggregate(parts, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)), (a, t) -> named_struct('at', a.at + char_length(t.head) + char_length(t.body) + {close}L, 'spans', if(t.learn, array_append(a.spans, named_struct('start', a.at + char_length(t.head), 'end', a.at + char_length(t.head) + char_length(t.body))), a.spans)), a -> a.spans)"
    return out.select(
        "tree", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.expr(span.format(close=len(CLOSE))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    return F.transform(parts, lambda x: F.struct(
        unescape_role(F.substr(head(x), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.char_length(head(x)) + 2)).alias("text")
    ))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each row
    answers the one before it in its conversation."""
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(F.col("conv_id").alias("tree"), node.cast("long").alias("node"), F.nullif(node - 1, F.lit(0)).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    turns = read_turns(F.col("formatted"))
    all_turns = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = formatted.withColumns({"said": all_turns, "n": F.size(turns).cast("long"), "learnt": read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    return out.select(
        F.col("tree").alias("conv_id"), F.col("n").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, 0, "user", LOOKALIKE), (-1, 1, "assistant", LOOKALIKE)], "conv_id long, turn long, role string, text string")
    rows = plain(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(planted)
    return digests(format_conversations(staged(linear_messages(rows), "chat-rows")))


OP2_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn
  FROM m),
e AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS text_len,
         length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) AS role_len
  FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn) AS said,
         coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '') AS learnt,
         CAST(sum(12 + role_len + 1 + text_len + 11) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, formatted_chars
FROM g
"""
