"""Decontamination over several blocks: the same rows as over one, for repeated and null ids too."""

import random

import pytest

from palimpsest.llm import decontam

from .test_corpus import brute_leaks

ITEMS = [("i1", "a b c d"), ("i2", "x y z w"), ("i2", "a b c d"), (None, "p q r s t u v a b c d e f"), ("i3", "same " * 30), ("i4", "one two three four five six seven eight nine ten eleven twelve")]
DOCS = [
    (1, "a b c d"), (1, "x y z w"), (1, "x y z w"), (None, "x y z a b c d"), (None, "nothing here"), (2, None), (2, ""), (3, "same " * 60), (3, "Same same"), (4, "zero one two three four five six seven eight nine ten eleven a b c d"), (5, "p q r s t u v a b c d e"),
]


def rows(frame):
    return sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [(x["from"], x["to"]) for x in r["runs"]]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 20, 60, 20])
def test_blocks_give_the_same_rows(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = rows(decontam.find_leaks(docs, bench, block_bytes=block))
    want = brute_leaks([t for _, t in DOCS], [(i or "", t) for i, t in ITEMS])
    assert sorted((r[1] is None, r[1] or 0, *r[2:5]) for r in got) == sorted((d is None, d or 0, n, hit, sorted(set(items))) for (d, _), (n, hit, items) in zip(DOCS, want))
    assert got == rows(decontam.find_leaks(docs, bench))
    clean = sorted(((t or "") for (_, t), (_, hit, _) in zip(DOCS, want) if not hit))
    assert sorted((r["text"] or "") for r in decontam.decontaminate(docs, bench, block_bytes=block).collect()) == clean


def test_long_spans(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(9)}" for _ in range(400)]
    swapped = words[:130]
    swapped[3], swapped[67] = swapped[67], swapped[3]
    docs = spark.createDataFrame([(1, " ".join(words[50:300])), (2, " ".join(words[50:149])), (3, " ".join(swapped))], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(words))], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.find_leaks(docs, bench, span=100, k=20).collect()}
    assert got[1] == 250 and got[2] == 0 and got[3] == (0 if words[3] != words[67] else 130)
