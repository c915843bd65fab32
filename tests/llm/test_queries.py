"""The queries themselves: their columns against brute force on the smallest
tables, and all of them and the pipeline on odd and on empty tables."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, brute_counts, low

from stackwright.llm import encoding, mixing
from stackwright.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def texts(real):
    return {r.doc_id: r for r in real.collect()}


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_op1_takes_targets(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op1_mix_sources"](spark, sf).collect()}
    size = {i: len(WORD.findall(r.text or "")) for i, r in texts.items()}
    per = defaultdict(int)
    for i, r in texts.items():
        per[r.source] += size[i]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, mixing.targets([per[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))])))
    taken = defaultdict(int)
    for i, r in got.items():
        s = texts[i].source
        assert (r.size, r.source_size) == (size[i], per[s]) and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * size[i]
        taken[s] += r.taken
    assert set(got) == set(texts) and all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert got == {r.doc_id: r for r in QUERIES["op1_mix_sources"](spark, sf).collect()}


def test_op3_places(spark, sf, texts):
    got = QUERIES["op3_shard_documents"](spark, sf).toPandas()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and set(got.doc_id) == set(texts)
    for r in got.itertuples():
        data = (texts[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert set(got.shard) <= set(range(16)) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_op4_held_out(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, sf).collect()}
    assert all(r.held_out == (remainder(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [r.lang_pred == texts[i].lang for i, r in got.items() if r.held_out]
    assert set(got) == set(texts) and np.mean(held) > 0.95


def test_op5_and_op10_are_the_library(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.vocabulary_path())
    ids = {i: tokenizer.encode(r.text or "", add_special_tokens=False).ids for i, r in texts.items()}
    lengths = Counter(map(len, ids.values()))
    assert {r.n_tokens: r.docs for r in QUERIES["op5_token_counts"](spark, sf).collect()} == dict(lengths)
    start = 0
    for r in QUERIES["op10_token_ids"](spark, sf).orderBy("doc_id").collect():
        want = np.array([*ids[r.doc_id], 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_op6_classes_hold_copies(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op6_near_duplicates"](spark, sf).collect()}
    first = {}
    for i in sorted(texts):
        if texts[i].text is not None:
            j = first.setdefault(texts[i].text, i)
            assert got[i].class_id == got[j].class_id <= i and got[i].class_key == got[j].class_key
    assert set(got) == set(texts) and all(n == r.n_class for c, n in Counter(r.class_id for r in got.values()).items() for r in got.values() if r.class_id == c)


def test_op7_base_columns_and_labels(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, sf).collect()}
    for i, r in got.items():
        want = brute_counts(texts[i].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.kept or not r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    agree = [got[i].kept == (q == 1) for i, q in labels.items() if i in got]
    assert set(got) == set(texts) and np.mean(agree) > 0.8


def test_op8_base_scores(spark, sf, texts):
    tokens = {i: [*WORD.findall(low(r.text)), None] for i, r in texts.items()}
    c = Counter(w for i, t in tokens.items() if remainder(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op8_lm_scores"](spark, sf).collect()}
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 10) == 0, len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])) and r.score < 0
    assert set(got) == set(texts)


def test_op9_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLE_SQL["op9_decontaminate"])
    got = QUERIES["op9_decontaminate"](spark, sf).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


@pytest.fixture(scope="module")
def odd(spark, docs, tmp_path_factory):
    """Folders of odd and of empty tables, with columns that clash with the operators' own."""
    made = {}
    for name, empty in (("odd", False), ("empty", True)):
        at = tmp_path_factory.mktemp(name)
        long = spark.createDataFrame([(9, "слово word " * 60_000, "en", "a")], "doc_id long, text string, lang string, source string")
        rows = docs.select("doc_id", "text", "lang", "source").unionByName(long).withColumn("n_chars", F.char_length("text").cast("long"))
        for extra in ("score", "copy", "n_copies", "kept_id", "shard", "a.b", "record", "row"):
            rows = rows.withColumn(extra, F.lit("x"))
        bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (1, "the cat sat")], "item_id long, text string").withColumn("h", F.lit(1))
        labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, None, None), (99, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").withColumn("n_words", F.lit(1))
        talks = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n"), (1, 1, "assistant", "<|im_end|>\n"), (None, 0, None, ""), (2, None, "assistant", "x")], "conv_id long, turn long, role string, text string").withColumn("score", F.lit(5.0))
        for table, df in (("documents", rows), ("benchmark", bench), ("labels", labels), ("conversations", talks)):
            (df.limit(0) if empty else df).write.parquet(f"{at}/{table}.parquet")
        made[name] = str(at)
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_odd_and_empty_tables(spark, odd, name):
    rows = {k: QUERIES[name](spark, at).collect() for k, at in odd.items()}
    n = spark.read.parquet(f"{odd['odd']}/documents.parquet").count()
    if name == "op2_chat_format":
        assert {r.conv_id: r.n_turns for r in rows["odd"]} == {1: 3, None: 1, 2: 1, -1: 2} and [r.conv_id for r in rows["empty"]] == [-1]
    elif name == "op5_token_counts":
        assert sum(r.docs for r in rows["odd"]) == n and rows["empty"] == []
    else:
        assert len(rows["odd"]) == n and rows["empty"] == []


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, odd["empty"]).count() == 0
    docs = spark.read.parquet(f"{odd['odd']}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd["odd"])
        assert out.columns == docs.columns, name
        # Null and empty texts go by the first stage only; the others take all rows here.
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.write_tokens(spark, docs, odd["odd"]).count() == docs.count()
