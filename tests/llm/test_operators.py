"""The ten operators against brute force, round trips and held-out labels, and
on odd and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stackwright.llm import chat, common, decontam, encoding, langid, lm, mixing, neardup, quality, sharding, token_counts, token_io
from stackwright.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# 1


def test_points_and_schedule_by_brute_force():
    x = mixing.radical_inverse(np.arange(500))
    for n, e in itertools.product((0, 1, 7, 100, 499), (0, 1 << 40, (1 << 43) + 12345, 1 << 44)):
        assert mixing.points_below(n, e) == (x[:n] < e).sum()
    needed = [5, 0, 100, 33]
    s = mixing.Schedule(needed)
    source, rank = s.at(np.arange(len(s)))
    for k, n in enumerate(needed):
        assert sorted(rank[(source == k) & (rank >= 0)]) == list(range(n))
    first = source[:60][rank[:60] >= 0]  # any prefix is near its share
    assert abs((first == 2).mean() - 100 / 138) < 0.1


def test_targets_stop_and_reshare():
    got = mixing.targets([100, 1, 100], [1, 2, 3])
    assert got[1] == 3 and sum(got) == pytest.approx(201) and got[2] == pytest.approx(3 * got[0])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("block", [7, 4096])
def test_mix_takes_targets(real, docs, nothing, block):
    for df in (real, docs):
        d = mixing.mixed_documents(df, block_tokens=block).toPandas()
        assert len(d) == df.count() and (d.taken <= 3 * d["size"]).all()
        by = d.groupby(["source_size", "target"]).agg(n=("size", "sum"), taken=("taken", "sum")).reset_index()
        assert ((by.taken - by.target).abs() <= 1).all() and d["size"].sum() == pytest.approx(by.target.sum())
        assert sorted(d["size"]) == sorted(len(WORD.findall(r.text or "")) for r in df.select("text").collect())
    assert mixing.mixed_documents(nothing).count() == 0
    assert mixing.repeat_documents(nothing).columns == nothing.columns
    odd = docs.withColumnsRenamed({"size": "copy", "h": "n_copies", "lang": "a.b"})
    got = mixing.repeat_documents(odd)
    assert got.columns == odd.columns and {r.copy for r in got.collect()} == {"extra"} and {r.n_copies for r in got.collect()} == {1}


# 2


def test_chat_matches_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duckdb.sql(ORACLE_SQL["op2_chat_format"])
    got = QUERIES["op2_chat_format"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_chat_branches_round_trip(spark):
    odd = ["<|im_end|>\n", "<\\|", "<\\\\|im_start|>a\n", None, "", "\\n"]
    rows = [(1, 1, None, "user", odd[0], 0.0), (1, 2, 1, "assistant", odd[1], 1.0), (1, 3, 1, "assistant", odd[2], 2.0), (1, 4, 3, "us\\n\ner<|", odd[3], None), (2, 1, 9, None, odd[4], None), (3, 1, 2, "assistant", odd[5], 0.0), (3, 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(rows, "tree int, node long, parent long, role string, text string, score double")
    out = chat.format_conversations(df, None)
    got = {(r.tree, r.rank): (r.t, r.l) for r in out.select("tree", "rank", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in got[1, 1][0]] == [("user", odd[0]), ("assistant", odd[2]), ("us\\n\ner<|", "")] and got[1, 1][1] == odd[2]
    assert [tuple(t) for t in got[1, 2][0]] == [("user", odd[0]), ("assistant", odd[1])]
    assert [tuple(t) for t in got[2, 1][0]] == [("", "")] and len(got) == 5
    assert chat.format_conversations(df, 1).count() == 3 and chat.format_conversations(df.limit(0)).count() == 0


def test_messages_below_a_cycle_keep_their_links(spark):
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 5), (2, 1, None), (2, 2, 1)]
    made = spark.createDataFrame(rows, "tree int, node long, parent long").selectExpr("*", "0D AS score")
    got = sorted((r.tree, r.leaf, r.node) for r in chat.root_to_leaf_paths(made, None).collect())
    assert got == [(1, 1, 1), (1, 4, 2), (1, 4, 3), (1, 4, 4), (1, 5, 5), (2, 2, 1), (2, 2, 2)] or got == [(1, 1, 1), (1, 4, 3), (1, 4, 4), (1, 4, 2), (1, 5, 5), (2, 2, 1), (2, 2, 2)]


# 3


def test_shards_are_even_and_gapless(real, docs, nothing):
    for df, shards in ((real, 16), (docs, 3)):
        rows, slot_map = sharding.shard_documents(df, shards, 1024)
        d = rows.toPandas()
        assert len(d) == df.count() and all(sorted(g.slot) == list(range(len(g))) for _, g in d.groupby("shard"))
        total = d.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
        assert total.max() - total.min() <= d["size"].max()
        assert Counter(zip(d["size"], d.text_crc32)) == Counter((len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("text").collect())
        assert sharding.SlotMap.load(slot_map.frame(df.sparkSession)).versions == slot_map.versions
    assert sharding.shard_documents(nothing)[0].count() == 0


def test_more_shards_only_take():
    load = [(i * 7919) % 101 + 1 for i in range(1024)]
    before = sharding.SlotMap.first(4, 1024).rebalanced(load)
    after = before.rebalanced(load, 5)
    moved = [(a, b) for a, b in zip(before.current, after.current) if a != b]
    assert moved and sum(b == 4 for _, b in moved) >= 0.9 * len(moved)
    total = [sum(x for x, s in zip(load, after.current) if s == k) for k in range(5)]
    assert max(total) - min(total) <= 101


def test_fewer_shards_take_all_and_empty_shards_count(spark):
    load = [5, 0, 9, 1, 7, 3, 0, 2]
    few = sharding.SlotMap.first(4, 8).rebalanced(load).rebalanced(load, 3)
    total = [sum(x for x, s in zip(load, few.current) if s == k) for k in range(3)]
    assert set(few.current) <= {0, 1, 2} and sum(total) == 27 and max(total) - min(total) <= 9
    many = sharding.SlotMap.first(16, 8).rebalanced(load)
    again = sharding.SlotMap.load(many.frame(spark))
    assert again.shards == 16 and again.versions == many.versions


def test_rows_that_repeat_spread_over_shards(spark):
    same = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 200).alias("text"), F.lit(1).alias("shard"), F.lit("y").alias("virtual_slot"))
    d = sharding.shard_documents(same, 4, 4096)[0].toPandas()
    total = d.groupby("shard")["size"].sum()
    assert len(d) == 2000 and len(total) == 4 and total.max() - total.min() <= 201
    path = common.stage_path(spark, "test-shards")
    stored = sharding.write_shards(same, path, 4, 4096)
    got = spark.read.parquet(f"{path}/data")
    assert stored.select("version").distinct().count() == 2 and got.count() == 2000 and got.select("record.*").columns == same.columns
    assert got.join(stored.filter("version = 1").withColumnRenamed("shard", "want"), "virtual_slot").filter("shard <> want").count() == 0


# 4


def test_long_texts_in_no_language_go(spark, real):
    rng = np.random.default_rng(4)
    junk = [(10**6 + i, "".join(rng.choice(list("qxzjkwvXQZJ0123456789+/"), 4000)), None, "s", 4000) for i in range(3)]
    made = real.unionByName(spark.createDataFrame(junk, real.schema))
    kept = langid.in_known_language(made)
    assert kept.filter("doc_id >= 1000000").count() == 0 and kept.count() == real.count()


def test_least_cosine_counts_all_labelled_texts(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(1500)]
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").crossJoin(spark.range(20)).selectExpr("concat(text, repeat(' qx', id * 3)) AS text", "lang")
    model = langid.learn_prototypes(df)
    d = langid.predict(df, *model).toPandas()
    long = d[d.n_grams >= langid.LONG].score
    assert len(long) == 30_000
    assert langid.least_cosine(df, *model) == pytest.approx(np.percentile(long, 1) / 2, abs=1e-7)


@pytest.mark.parametrize("bins", [7, 1 << 16])
def test_exact_percentile(spark, bins):
    rng = np.random.default_rng(bins)
    for values in ([], [0.25], [0.5] * 300, [*rng.random(2), None], [*np.repeat(rng.random(9), 7), *(1e-300 * rng.random(40)), 0.0]):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
        for share in (0.01, 0.37):
            assert langid.exact_percentile(df, "v", share, bins) == df.agg(F.percentile("v", share)).first()[0]


def test_languages_held_out(spark, real):
    # Most rows learn, the rest are held out.
    train, held = real.filter(common.fold_of("doc_id", 5) != 0), real.filter(common.fold_of("doc_id", 5) == 0)
    d = langid.predict(held, *langid.learn_prototypes(train)).select("record.*", "lang_pred", "score").toPandas()
    assert (d.lang == d.lang_pred).mean() > 0.95 and d.score.between(0, 1).all()


def test_language_of_odd_rows(docs, nothing):
    model = langid.learn_prototypes(docs)
    odd = docs.withColumnsRenamed({"size": "score", "h": "a.b"})
    d = langid.predict(odd, *model).select("record.text", "lang_pred").toPandas()
    assert model[0] == ["de", "en"] and (d[d.text.fillna("").str.upper().str.lower() == d.text.fillna("").str.upper()].lang_pred == "und").all()
    kept = langid.in_known_language(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 5, 6, 7)").count() == 5 and kept.filter("trim(text) = '' or text is null").count() == 0
    assert set(langid.predict(docs, *langid.learn_prototypes(nothing)).toPandas().lang_pred) == {"und"}
    assert langid.predict(nothing, *model).count() == 0


def test_vectors_by_brute_force():
    v = langid._vectors(64)
    kinds, counts = langid.counted(*common.buffers(common.pa.array(["Ab c", "", "abé"])))
    code = langid._letter_classes()
    for text, row in zip(["Ab c", "", "abé"], counts):
        s = " " + text.lower() + " "
        want = Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ") if text else Counter()
        assert {int(k): int(n) for k, n in zip(kinds, row) if n} == {(int(code[ord(a)]) << 16) | (int(code[ord(b)]) << 8) | int(code[ord(c)]): n for (a, b, c), n in want.items()}
    k = int(kinds[0])
    assert (langid.bound(kinds[:1], 64)[0] == np.roll(v[k >> 16], 2) * np.roll(v[k >> 8 & 255], 1) * v[k & 255]).all()


# 5 and 10


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.vocabulary_path())
    return t


def test_encoder_is_the_library(tokenizer):
    import random

    random.seed(5)
    letters = list("ab 'sé1,\n\t  !  x\x1c")
    texts = ["".join(random.choices(letters, k=random.randrange(0, 40))) for _ in range(5000)] + ["", " ", "  a", "<|endoftext|> a", "a <|endoftext|>b <|endoftext|>", "<|endoftext|", "it's 　 x", "a\x85 b"]
    encoder = encoding.Encoder(open(encoding.vocabulary_path(), encoding="utf-8").read())
    assert encoder.chunked
    assert 50256 in list(encoder.encode(["a <|endoftext|> b"])[0])
    plain = encoding.Encoder(open(encoding.vocabulary_path(), encoding="utf-8").read(), plain_specials=True)
    assert 50256 not in list(plain.encode(["a <|endoftext|> b"])[0])
    for _ in range(2):
        assert [list(x) for x in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_histogram_by_brute_force(real, docs, nothing, tokenizer):
    for df in (real, docs):
        n = np.array([len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in df.select("text").collect()])
        sums = token_counts.with_suffix_sums(token_counts.length_histogram(df))
        for r in sums.collect():
            assert (r.docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
        for r in token_counts.truncated_totals(sums, [0, 3, 512, 10**6]).collect():
            assert (r.tokens_kept, r.docs_cut) == (np.minimum(n, r.limit).sum(), (n > r.limit).sum())
        for r in token_counts.length_quantiles(sums, [0.5, 1.0]).collect():
            assert (n <= r.n_tokens).mean() >= r.share > (n < r.n_tokens).mean()
    assert token_counts.with_suffix_sums(token_counts.length_histogram(nothing)).count() == 0


def test_token_files_round_trip(spark, real, docs, nothing, tokenizer):
    for df in (real, docs):
        path = common.stage_path(spark, "test-ids")
        token_io.write_token_ids(df, path)
        want = sorted(((r.doc_id if r.doc_id is not None else -1, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.select("doc_id", "text").collect()), key=lambda x: x[0])
        got = sorted(token_io.read_token_ids(spark, path).collect(), key=lambda r: r.start)
        assert [(-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got] == want
        assert [r.start for r in got] == [sum(len(x) for _, x in want[:i]) for i in range(len(want))]
        crc = {r.start: r.ids_crc32 for r in token_io.token_digests(spark, path).collect()}
        assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    path = common.stage_path(spark, "test-ids")
    token_io.write_token_ids(nothing, path)
    assert token_io.token_digests(spark, path).count() == 0


# 6


def brute_classes(df, idf, least=0.8):
    texts = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        texts[r.text if r.text is not None else ("null", r.doc_id)].append(r.doc_id)
    keys = list(texts)
    said = [k if isinstance(k, str) else "" for k in keys]
    pairs = list(itertools.combinations([i for i, t in enumerate(said) if t.split()], 2))
    s = neardup.weighted_jaccard([said[a] for a, _ in pairs], [said[b] for _, b in pairs], idf)
    group = list(range(len(keys)))
    for (a, b), x in zip(pairs, s):
        if x >= least:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    return sorted(tuple(sorted((x is None, x or 0) for i, k in enumerate(keys) if group[i] == g for x in texts[k])) for g in set(group))


def test_near_duplicates_by_brute_force(spark, docs, real, nothing):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh".split()
    near = [(100 + i, " ".join(base[:i] + ["new"] + base[i + 1 :])) for i in (0, 1, 33)] + [(200, " ".join(base))]
    made = spark.createDataFrame(near, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).unionByName(real.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").limit(120))
    d = neardup.near_duplicates(made)
    idf = neardup.damped_idf(*neardup.document_frequencies(made))
    got = defaultdict(list)
    for r in d.collect():
        got[r.class_id].append((r.doc_id is None, r.doc_id or 0))
    assert sorted(tuple(sorted(v)) for v in got.values()) == brute_classes(made, idf)
    assert len({r.class_id for r in d.filter("doc_id in (100, 101, 133, 200)").collect()}) == 1
    assert neardup.near_duplicates(nothing).count() == 0
    odd = docs.withColumnsRenamed({"h": "kept_id", "size": "a.b"})
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 5)").count() == 1


def band_classes(df, least=0.8):
    """Classes of distinct texts by all similar pairs that share a band."""
    idf = neardup.damped_idf(*neardup.document_frequencies(df))
    rows = sorted(neardup.sketches(df, idf).collect(), key=lambda r: r.doc_id)
    text = {r.doc_id: r.text for r in df.collect()}
    bands, sig = np.array([r.bands for r in rows]), np.array([r.sig for r in rows])
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (bands[i] == bands[j]).any() and 2 * (sig[i] == sig[j]).sum() >= neardup.SAMPLES]
    s = [x for k in range(0, len(pairs), 1000) for x in neardup.weighted_jaccard([text[rows[i].doc_id] for i, _ in pairs[k : k + 1000]], [text[rows[j].doc_id] for _, j in pairs[k : k + 1000]], idf)]
    group = list(range(len(rows)))
    for (i, j), x in zip(pairs, s):
        if x >= least and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group):
        first.setdefault(g, r.doc_id)
    return {r.doc_id: first[g] for r, g in zip(rows, group)}, max(Counter(bands.ravel().tolist()).values())


def drifted(n, changes, seed):
    """Texts of one origin, each with some words of its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.choice(len(base), rng.integers(*changes), replace=False):
            words[k] = f"new{i}x{k}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("texts, size", [(1024, 8 << 20), (64, 8 << 20), (1024, 20_000)])
def test_large_buckets_are_searched_whole(spark, monkeypatch, texts, size):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", texts)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
    made = spark.createDataFrame(drifted(500, (2, 5), 3), "doc_id long, text string").repartition(3)
    want, largest = band_classes(made)
    assert largest > 150 and len(set(want.values())) > 10
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(made).collect()} == want


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_block_similarities_are_those_of_pairs(monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    texts = [x for _, x in drifted(40, (0, 60), 5)] + ["a a a a a a a a a", "a a a a a a a", "x", "", "w0 w1 w2 w3 w4 w5 " * 9]
    idf = np.random.default_rng(1).uniform(0.5, 1, neardup.IDF_ROWS << neardup.IDF_BITS).astype(np.float32)
    n = np.arange(len(texts))
    got = neardup.similarities(common.pa.array(texts), n, n, idf)
    i, j = np.triu_indices(len(texts), 1)
    assert np.allclose(got[i, j], neardup.weighted_jaccard([texts[k] for k in i], [texts[k] for k in j], idf), atol=1e-9)


def test_block_links_are_a_forest():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 40, 300), rng.integers(40, 60, 300)
    x, y = neardup._forest(a, b)
    assert len(x) == len(set(a) | set(b)) - 1  # so many pairs link them all


def test_classes_of_shared_ids_differ_in_key(spark):
    rows = [(7, "one text of some words that stands alone here"), (7, "another text with other words altogether, you see"), (8, "one text of some words that stands alone here")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {7} and Counter(r.class_key for r in got).most_common(1)[0][1] == 2


def test_frequencies_leave_out_the_average_load(spark):
    rows = [(i, "the common opening words of all " + " ".join(f"u{i}x{k}" for k in range(300))) for i in range(800)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    frequency, n = neardup.document_frequencies(made)
    row, h, _ = neardup.shingles(*common.buffers(common.pa.array([rows[0][1]])))
    got = sorted(np.median([frequency[neardup.counters(h, k)] for k in range(3)], axis=0))
    assert n == 800 and got[-1] == pytest.approx(800, abs=5) and np.median(got) < 2.5


def test_kept_rows_go_by_id_and_text(spark):
    one, two, three = ("the first text has words of its own and no others", "a second one is about something else entirely, as you see", "and the third, without any id, is there twice or more")
    rows = [(5, one), (5, two), (5, two), (6, one), (None, three), (None, three), (7, None), (7, None), (None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, neardup.drop_near_duplicates(made).collect()))
    assert got == Counter([(5, one), (5, two), (None, three), (7, None), (None, None)])


def test_samples_estimate_similarity():
    idf = np.full(neardup.IDF_ROWS << neardup.IDF_BITS, 1.0, np.float32)
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[:360])
    row, h, n = neardup.shingles(*common.buffers(common.pa.array([a, b])))
    s = neardup.samples(row, h, neardup.weights(h, n, idf), 2, neardup._draws())
    assert abs((s[0] == s[1]).mean() - neardup.weighted_jaccard([a], [b], idf)[0]) < 0.3


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21)]
    got = {r.tid: r.comp for r in neardup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20}


# 7


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_statistics_and_rules(spark, sf, real, docs, nothing):
    for df in (real, docs):
        got = quality.text_statistics(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(map(tuple, got)) == Counter(brute_counts(r.text) for r in df.select("text").collect())
    stats, labels = quality.text_statistics(real), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit_rules(stats, labels)
    x = stats.select("doc_id", *[F.expr(e).cast("double").alias(f"f_{n}") for n, e in quality.FEATURES.items()]).toPandas().set_index("doc_id")
    d = quality.judged(stats, rules).toPandas().set_index("doc_id")
    for i, r in d.iterrows():
        first = next((k for k, rule in enumerate(rules) if r.n_words and rule.holds(x.loc[[i]].to_numpy(float))[0]), None)
        assert first == (None if np.isnan(r.rule) else r.rule) if r.rule is not None else first is None
    assert quality.fit_rules(stats, labels.limit(0)) == [] and quality.judged(quality.text_statistics(nothing), rules).count() == 0


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    poor = (x[:, 2] > 0.8) & (x[:, 5] <= 0.5) | (x[:, 7] > 0.95)
    rules = quality.learn_rules(x, poor, np.arange(3000) % 3)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= r.holds(x)
    assert (said == poor).mean() > 0.97


# 8


def test_lm_by_brute_force(real, docs, nothing):
    for df in (real, docs):
        train = df.filter(common.fold_of("doc_id", 10) != 0)
        words, seen = lm.count_words(train)
        out = lm.score_documents(df, lm.fit_tree(train, seen), words, train.count()).collect()
        tokens = lambda t: WORD.findall(low(t)) + [None]
        c = Counter(w for r in train.select("text").collect() for w in tokens(r.text))
        n, v = sum(c.values()), len(c)
        want = sorted((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in (tokens(r.text) for r in df.select("text").collect()))
        got = sorted((r.n_tokens, r.n_known, r.base_score) for r in out)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])
        assert all(r.train_tokens == n and r.score < 0 for r in out)
    words, seen = lm.count_words(nothing)
    assert lm.score_documents(docs, lm.fit_tree(nothing, seen), words, 0).count() == docs.count()


def test_tree_sums_to_one_and_scores_by_longest_state(spark, real):
    words, seen = lm.count_words(real)
    tree = lm.fit_tree(real, seen, p_min=1e-4)
    p = 10.0 ** tree.logp.astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and len(p) > 50
    state = {(): 0} | {tuple(int(k) >> 6 * (d - i) & 63 for i in range(d + 1)): int(r) for d, (keys, rows) in enumerate(tree.states) for k, r in zip(keys, rows)}
    text = "the cat, The end"
    sym = [lm.PAD] * lm.DEPTH
    for w in text.split():
        sym += [int(tree.classes[b]) for b in w.encode()] + [lm.WORD_END]
    sym.append(lm.TEXT_END)
    want = 0.0
    for i in range(lm.DEPTH, len(sym)):
        ctx = tuple(sym[i - lm.DEPTH : i])
        while ctx not in state:
            ctx = ctx[1:]
        want += float(tree.logp[state[ctx], sym[i]])
    want += sum(float(tree.share[b]) for b in text.encode() if b != 32)
    got, *_ = lm.score_rows(*common.buffers(common.pa.array([text])), tree, tree.table())
    assert got[0] == pytest.approx(want, rel=1e-5)


def test_every_word_after_two_has_a_context(spark):
    said = [" ".join(f"w{(i * k) % 41}" for i in range(k)) for k in range(60)]
    words, counts = lm.count_words(df := spark.createDataFrame([(t,) for t in said], "text string"))
    tree = lm.fit_tree(df, counts)
    _, h, first, logp = lm.score_rows(*common.buffers(common.pa.array(said)), tree, tree.table())
    row, *_ = lm.word_contexts(h, first, logp)
    assert np.bincount(row, minlength=60).tolist() == [max(0, k - 2) for k in range(60)]


def test_word_contexts_by_brute_force(spark, monkeypatch):
    # Every context is a candidate; scores are those of counts in plain Python.
    monkeypatch.setattr(lm, "ANCHORS", 1)
    said = ["the red fox ran over the red fox ran home"] * 2 + ["the red fox sat", "a b c d e f g", "the red dog", None, ""]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(2)
    words, counts = lm.count_words(docs)
    tree = lm.fit_tree(docs, counts)
    table = tree.table()

    def spelling(text):
        return lm.score_rows(*common.buffers(common.pa.array([text or ""])), tree, table)

    met, logp = defaultdict(Counter), {}
    for text in said:
        w = WORD.findall(low(text))
        for i, p in enumerate(spelling(text)[3]):
            if i > 1:
                met[w[i - 2], w[i - 1]][w[i]] += 1
                logp[w[i - 2], w[i - 1], w[i]] = p
    total = sum(sum(c.values()) for c in met.values())
    kept = {c for c, n in met.items() if sum(n.values()) >= 2 and sum(x * (math.log(x / sum(n.values())) - logp[*c, y] * math.log(10)) for y, x in n.items()) > 0.5 * len(n) * math.log(total)}
    assert kept and len(kept) < len(met)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, tree, words, len(said), lm.fit_contexts(docs, tree)).collect()}
    alone = {r.doc_id: r.score for r in lm.score_documents(docs, tree, words, len(said)).collect()}
    for k, text in enumerate(said):
        w, want = WORD.findall(low(text)), spelling(text)[0][0]
        assert alone[k] == pytest.approx(want)
        for i, p in enumerate(spelling(text)[3]):
            if i > 1 and (c := (w[i - 2], w[i - 1])) in kept:
                n = sum(met[c].values())
                want += math.log10((met[c][w[i]] + lm.TREE_WEIGHT * 10**p) / (n + lm.TREE_WEIGHT)) - p
        assert got[k] == pytest.approx(want)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, top, n, dtype=np.int64).astype(t) for top, n, t in ((1 << 62, 900, np.uint64), (1, 50, np.uint32), (300, 0, np.uint32), (1 << 20, 7, np.uint64))] + [rng.random(77).astype(np.float32)]
    back = lm.unpacked(lm.packed(*arrays), *[a.dtype for a in arrays])
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))


def test_lm_scores_hang_on_no_pack_part_or_head(spark, real, monkeypatch):
    rows = real.withColumn("learnt", common.fold_of("doc_id", 10) != 0)
    train = rows.filter("learnt")
    words, counts = lm.count_words(train)
    tree, n = lm.fit_tree(train, counts), train.count()

    def scores(**how):
        got = lm.score_documents(rows, tree, words, n, lm.fit_contexts(train, tree, **how)).collect()
        return np.array(sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got))

    want = scores(scored=True)
    monkeypatch.setattr(lm, "HEAD_SHARE", 1 << 10)
    monkeypatch.setattr(lm, "PACK_BYTES", 30_000)
    monkeypatch.setattr(lm, "PART_PLACES", 5_000)
    for got in (scores(), scores(scored=True)):
        assert np.array_equal(got[:, :3], want[:, :3]) and np.allclose(got[:, 3:], want[:, 3:], rtol=1e-5)


def test_lm_shuffles_few_bytes_a_word(spark, real):
    # Rows of hashes took 58 bytes a word, packed ranks take 18.
    def written():
        doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    words = sum(r.n_tokens for r in QUERIES["op8_lm_scores"](spark, "/root/testdata/sf0.01").collect())
    bytes_ = sum(n for k, n in written().items() if k not in before)
    assert 0 < bytes_ < 25 * words


# 9


def brute_hits(docs, items, width=10):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = split.findall(low(t))
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = split.findall(low(t)), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if x := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination_query_by_brute_force(spark, sf, real):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = Counter(map(tuple, QUERIES["op9_decontaminate"](spark, sf).collect()))
    assert got == brute_hits([tuple(r) for r in real.select("doc_id", "text").collect()], items)


@pytest.mark.parametrize("block_words", [10**6, 5])
def test_contamination_of_odd_rows(spark, docs, nothing, block_words):
    items = [(1, "cat sat on the MAT and looked at the dog then left"), (2, "x x"), (11, "wort"), (5, None), (6, "?!"), (None, "six seven eight"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, 10, block_words).collect()
    mine = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len({m.item_id for m in r.matches})) for r in got)
    want = Counter(x[:4] for x in brute_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], items).elements())
    assert mine == want
    longest = [m for r in got if r.doc_id == 1 for m in r.matches if m.item_id == "1"]
    assert [(m.item_word, m.doc_word, m.n_words) for m in longest] == [(0, 1, 12)]
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for x, n in want.items() if not x[2])
    assert decontam.contamination(nothing, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = common.stage_path(spark, "test-stage")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0 < docs.count() <= 3 * n
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()


def test_pipeline_keeps_unlabelled_texts(spark, docs):
    import corpus_pipeline

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    want = Counter((r.doc_id, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    got = corpus_pipeline.identify_language(spark, bare, "")
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == want


def test_pipeline_run_by_brute_force(spark, tmp_path, tokenizer):
    import corpus_pipeline

    said = lambda k, n: " ".join(f"{'abcdefgh'[k]}{'xyz'[i % 3]}word{'klmnop'[i % 6]}{i}" for i in range(n))
    item = "which of these ten words is in the benchmark of tests"
    rows = [(1, said(0, 40), "a"), (2, said(0, 40), "a"), (3, said(0, 40) + " more", "b"), (4, said(1, 30), "a"), (5, said(2, 25) + " " + item, "a"), (6, "12 34 ?!", "a"), (7, None, "b"), (8, said(3, 50), "b"), (9, said(4, 20), "b"), (10, said(5, 35), "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    made = spark.createDataFrame([r[:2] for r in letters], "doc_id long, text string")
    classes = brute_classes(made, neardup.damped_idf(*neardup.document_frequencies(made)))
    first = {min(x for _, x in c) for c in classes}
    hit = {d for (d, *_, bad) in brute_hits([r[:2] for r in letters if r[0] in first], [(1, item)]) if bad}
    want = [r for r in letters if r[0] in first - hit]
    assert sorted(r[0] for r in want) == [1, 4, 8, 9, 10]

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-2]:
        path = common.stage_path(spark, "test-run")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id for r in docs.collect()})
    assert kept == [{r[0] for r in letters}, first, first - hit]

    crc = {i: zlib.crc32(np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t, _ in want}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies, size = Counter(r.doc_id for r in out), {i: len(t.split()) for i, t, _ in want}
    assert set(copies) <= set(crc) and all(r.ids_crc32 == crc[r.doc_id] for r in out)
    per = {s: [i for i, _, x in want if x == s] for s in "ab"}
    target = dict(zip("ab", mixing.targets([sum(size[i] for i in per[s]) for s in "ab"], [1, 2])))
    for s, ids in per.items():
        passes = target[s] / sum(size[i] for i in ids)
        assert all(math.floor(passes) <= copies[i] <= math.ceil(passes) for i in ids)
        assert sum(copies[i] * size[i] for i in ids) >= target[s] - 1


def test_every_query_is_registered(spark):
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
