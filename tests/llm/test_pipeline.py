"""The pipeline's stages, written and read again as in production, against brute force."""

import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from palimpsest.llm import langid, mixing

from .test_corpus import TOKENIZER, brute_leaks, frame
from .test_neardup import brute_survivors

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output frame) of every stage, over documents with some bad rows added."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", None, 0), (900_002, "", "en", "s", 0), (900_003, "123 %%", None, "s", 6)], docs.schema)
    root = f"/tmp/palimpsest-pipeline-{uuid.uuid4().hex}"
    docs.unionByName(odd).write.parquet(f"{root}/in")
    now, out = spark.read.parquet(f"{root}/in"), []
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, DATA).write.parquet(f"{root}/{name}")
        now = spark.read.parquet(f"{root}/{name}")
        out.append((name, before, now))
    return {name: (before, after) for name, before, after in out}


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stage_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for name, (before, after) in stages.items():
        if name != "token_output":
            assert after.columns == list(before[0].asDict())


def test_language_stage_drops_only_what_has_no_language(spark, stages):
    before, after = stages["language_id"]
    gone = set(ids(before)) - set(ids(after.collect()))
    assert {900_001, 900_002, 900_003} <= gone and len(gone) <= 3 + len(before) // 50
    docs = spark.createDataFrame(before, after.schema)
    scores = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert gone == {d for d, r in scores.items() if r["lang_pred"] == "und" or r["score"] < corpus_pipeline.MIN_LANGUAGE_SHARE}


def test_near_duplicate_stage(stages):
    before, after = stages["simhash_near_dedup"]
    kept = brute_survivors([(r["doc_id"], r["text"]) for r in before])
    assert ids(after.collect()) == kept and len(kept) < len(before)


def test_decontamination_stage(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = [r["doc_id"] for r, (_, hit, _) in zip(before, brute_leaks([r["text"] for r in before], items)) if not hit]
    assert ids(after.collect()) == sorted(clean) and len(clean) < len(before)


def test_mixing_stage_keeps_rows_and_orders_them(spark, stages):
    before, after = stages["source_mixing"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, before))
    stored = after.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    plan = mixing.mix(spark.createDataFrame(before, after.schema), weights=corpus_pipeline.MIX_WEIGHTS).collect()
    assert [r["doc_id"] for r in stored] == [r["doc_id"] for r in sorted(plan, key=lambda r: (r["mix_slot"], r["mix_rank"], r["doc_id"]))]


def test_token_stage_follows_the_stored_order(spark, stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = stages["source_mixing"][1].select("doc_id", "text", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()
    got = sorted(stages["token_output"][1].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixed] and TOKENIZER
    start = 0
    for r, d in zip(got, mixed):
        want = plain.encode(d["text"], add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_stages_on_an_empty_table(spark):
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    root = f"/tmp/palimpsest-pipeline-{uuid.uuid4().hex}"
    docs.write.parquet(f"{root}/in")
    now = spark.read.schema(docs.schema).parquet(f"{root}/in")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        assert out.count() == 0
        out.write.parquet(f"{root}/{name}")
        now = spark.read.schema(out.schema).parquet(f"{root}/{name}")
