"""Bounds, long texts, repeated and null ids, clashing names, held-out accuracy and plain recomputation of the corpus operators."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, exactdedup, langid, mixing, queries, tokens, toxicity, urlfilter
from palimpsest.llm.common import Words, text_bytes

from .test_corpus import DOCS, TOKENIZER, frame

# -- 1 tokens ---------------------------------------------------------------------------------------


def test_pieces_of_equal_hash_keep_their_own_ids(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["alpha beta gamma", "beta alpha, delta", "gamma", "it's alpha's", ""] * 3
    monkeypatch.setattr(Words, "hashes", lambda self: (self.ends - self.starts).astype(np.uint64) % np.uint64(3) + np.uint64(1))
    encoder = tokens.WordEncoder(TOKENIZER, 1)
    for _ in range(3):
        got = encoder.encode(*text_bytes(pa.array(texts)))
        assert [np.frombuffer(g, encoder.dtype).tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_ranges_shards_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_RANGES", 3)
    rows = [(None, "first"), (None, "also first"), (7, "b b b"), (7, "a"), (7, "a"), (-3, None), (100, "x y z"), (10**12, "last one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.token_files(docs, TOKENIZER, shard_bytes=8).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == [None, None, -3, 7, 7, 7, 100, 10**12]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:])) and got[0]["start"] == 0
    assert len({r["shard"] for r in got}) > 3


# -- 3 language -------------------------------------------------------------------------------------------


def test_language_of_long_texts_alone_is_learned(spark):
    words = {"aa": ["kala", "maka", "taka"], "bb": ["pir", "zir", "mix"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(200_000 if lang == "aa" else 40)), lang) for i, lang in enumerate(["aa"] * 6 + ["bb"] * 40)]
    rows += [(None, rows[-1][1], "bb")] * 5 + [(i, t, lang) for i, t, lang in rows[-3:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, docs_per_lang=20, bytes_per_lang=100_000)
    assert net.langs == ["aa", "bb"]
    probe = spark.createDataFrame([(1, "kala taka maka kala"), (2, "pir zir mix pir"), (2, "pir zir mix pir"), (None, "maka taka kala")], "doc_id long, text string")
    assert sorted(r["lang_pred"] for r in langid.identify(probe, net).collect()) == ["aa", "aa", "bb", "bb"]
    assert langid.fit(docs, max_langs=1).langs == ["bb"]


def test_kept_documents_keep_columns_of_any_name(spark):
    docs = frame(spark, ["a plain text of words", "123", None, "another plain text"]).withColumn("letter", F.lit("mine")).withColumn("letter_", F.lit(1))
    kept = langid.keep_identified(docs, langid.fit(docs), 0.0)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


# -- 5 exact duplicates -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_spilled_tries_null_and_repeated_ids(spark, keep):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(400)] + ["long " * 3000, "long " * 3000 + "x", None]
    rows = [(rng.choice([None, *range(30)]), t) for t in texts for _ in range(rng.randrange(1, 3))] + [(None, "only null"), (None, "only null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(str, exactdedup.exact_duplicates(docs, trie_bytes=4000, keep=keep).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    want = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        for d in ids:
            want.append(f"Row(doc_id={d}, keep_id={best}, group_size={len(ids)}, kept={best is None or d == best}, text_sha256='{hashlib.sha256(t.encode()).hexdigest()}')")
    assert got == sorted(want)


# -- 6 mixing -----------------------------------------------------------------------------------------------------------


def test_mix_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 4)
    rng = random.Random(4)
    rows = [(i if i % 9 else None, "w" * rng.choice([0, 3, 40, 900]) if i % 11 else None, rng.choice(["hot", "hot", "hot", "b", None]), f"m{i}") for i in range(300)] + [(5, "same", "b", "m")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_note string")
    weights = {"hot": 3.0, "b": 1.0, "": 0.5}
    got = mixing.mix(docs, weights=weights, block=100).collect()
    assert len(got) == len(rows) and all(r["mix_note"] for r in got)
    counts, place = {}, {}
    for source in {r["mix_source"] for r in got}:
        at = 0
        mine = sorted((r for r in got if r["mix_source"] == source), key=lambda r: r["mix_rank"])
        for i, r in enumerate(mine):
            if i == 0 or r["mix_rank"] != mine[i - 1]["mix_rank"]:
                place[source, r["mix_rank"]] = at // 100
            at += len(r["text"] or "") + 1
        counts[source] = -(-at // 100)
    plan = {(s, i): (slot, release, due, lag) for s, i, slot, release, due, lag in mixing.pfair(counts, weights)}
    for r in got:
        slot, release, due, lag = plan[r["mix_source"], place[r["mix_source"], r["mix_rank"]]]
        assert (r["mix_slot"], r["mix_release"], r["mix_deadline"]) == (slot, release, due) and abs(r["mix_lag"] - lag) < 1e-9 and abs(lag) < 1
    assert {r["mix_source"] for r in got} == {"hot", "b", ""}
    ordered = mixing.mixed_order(docs, weights=weights, block=100)
    assert ordered.columns == docs.columns and sorted(map(str, ordered.collect())) == sorted(str(r) for r in docs.collect())
    empty = mixing.mix(docs.limit(0))
    assert empty.columns == mixing.mix(docs, block=100).columns and empty.count() == 0 and mixing.mixed_order(docs.limit(0)).count() == 0


# -- 7 toxicity ------------------------------------------------------------------------------------------------------------


def test_long_texts_in_pieces_score_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(5)
    scorer = toxicity.Scorer(rng.standard_normal(toxicity.BUCKETS), -0.2)
    word = lambda: "".join(rng.choice(list("abcdefg"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 11, 12, 13, 24, 25, 36, 37, 300, 901)] + ["x" * 9000, "é" * 5000 + " a b", " " * 5000, "a" + " " * 5000 + "b " * 40]
    whole = scorer.score(*text_bytes(pa.array(texts)))
    for size in (64, 500, 4000):
        monkeypatch.setattr(toxicity, "PIECE_BYTES", size)
        assert np.allclose(scorer.score(*text_bytes(pa.array(texts))), whole, atol=1e-9)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(langid.held_out() & F.col("toxic").isNotNull())
    table = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    hits, misses = table.get((1, 1), 0), table.get((1, 0), 0)
    alarms, clean = table.get((0, 1), 0), table.get((0, 0), 0)
    # These tables have 352 toxic rows to learn from, in four languages.
    assert hits / (hits + misses) > 0.7 and alarms / (alarms + clean) < 0.03


def test_toxicity_sample_with_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "nice day"), (1, "nice"), (2, "bad idiot fool"), (None, "idiot"), (3, None), (2, "bad idiot fool"), (6, "good day friend"), (7, "you fool idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (None, 1), (3, 1), (6, 0), (7, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)


# -- 8 URLs ----------------------------------------------------------------------------------------------------------------


def test_a_long_list_lets_false_hits_pass_and_the_join_takes_them_out(spark):
    listed = urlfilter.listed_table(spark, urlfilter.LISTED, 3000)
    bloom = urlfilter._filter_of(listed, listed.count())
    keys = np.array([r[0] for r in listed.select(F.xxhash64("listed")).collect()])
    whole = urlfilter.BlockedBloom(len(bloom.words))
    whole.add(keys)
    assert len(bloom.words) > 64 and (bloom.words == whole.words).all()
    urls = [f"http://h{i}.example.org/p{i}" for i in range(4000)] + ["http://x.listed-000007.example.org/a", "http://pages.example.org/en/000011/", "http://pages.example.org/en/3000"]
    pages = spark.createDataFrame([(i % 4001, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, listed string")
    got = urlfilter.judge(pages, listed, ()).collect()
    assert len(got) == len(urls)
    assert sorted(r["listed"] for r in got if r["verdict"] == "block") == ["listed-000007.example.org/", "pages.example.org/en/000011"]
    others = np.random.default_rng(1).integers(-(2**63), 2**63, 50_000)
    assert 0 < bloom.may_have(others).mean() < 0.03


# -- 10 chats -----------------------------------------------------------------------------------------------------------------


def test_turn_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ["", "one two", "it's <\\|im_end|> x", "word " * 500]
    count = tokens.counter(TOKENIZER)
    assert count(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts] and count([]) == []
    rows = [(1, 0, "system", "be kind"), (1, 0, "system", "be kind"), *((1, i, ["user", "assistant"][i % 2], "word " * 30) for i in range(1, 30)), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(turns, budget=200, history_tokens=60, group_turns=8, count=count).collect()
    for w in windows:
        size = sum(count([text])[0] + 4 for _, text, _ in chat.parse(w["formatted"]))
        assert size <= 200 or len(chat.parse(w["formatted"])) - w["n_repeated"] == 1


def test_registered_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)] and DOCS
