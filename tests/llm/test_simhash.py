"""SimHash: long texts, null and repeated ids, shards of shards, dense groups; against brute force."""

import random

import numpy as np

from palimpsest.llm import simhash

from .test_corpus import DOCS, brute_classes, brute_print


def test_pieces_of_long_texts_give_the_same_shingles(monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "a", "a b", "a b c", "a b c d", " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(500)), "x" * 900 + " y z " + "w" * 300, "\t a\x0bB  c\n" * 90]
    want = [brute_print(t) for t in texts]
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        assert [simhash._majority_of(simhash.shingles(t.encode(), 3)) for t in texts] == want
        assert list(simhash.shingles(None, 3)) == [[]]


def test_null_and_repeated_ids_link(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(400)) for _ in range(6)]
    near = [b + " tail" for b in base]
    pairs = [(None, base[0]), (7, near[0]), (None, base[1]), (None, near[1]), (5, base[2]), (5, base[2]), (5, base[3]), (3, near[3]), (9, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, "clash", -1, 0) for d, t in pairs], DOCS)
    prints = [brute_print(t) for _, t in pairs]
    classes = brute_classes(prints, 3)
    least = {c: min((d for (d, _), k in zip(pairs, classes) if k == c and d is not None), default=None) for c in set(classes)}
    want = sorted(((d, f"{p:016x}", least[c]) for (d, _), p, c in zip(pairs, prints, classes)), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str) == want


def test_shards_of_shards_and_dense_groups(spark):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one_off = points[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    dense = points[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 64, dtype=np.uint64))
    points = np.unique(np.concatenate([points, one_off, dense]))
    label = np.arange(len(points))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 3):
            x, y = sorted((label[i], label[j]))
            label[label == y] = x
    frame = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    for options in ({}, {"shard_points": 60, "top_leaves": 4}):
        got = np.arange(len(points))
        for r in simhash.near_links(frame, **options).collect():
            x, y = sorted((got[place[r["a"]]], got[place[r["b"]]]))
            got[got == y] = x
        assert (got == label).all()


def test_forest_of_a_chain_and_a_clique():
    far = 0xFF << 40
    a, b = simhash.links(np.array([0, 7, 63, 511, 4095, far, far + 1, far + 2, far + 3], np.uint64), 3)
    assert len(a) == 4 + 3 and {frozenset(x) for x in zip(a[b < 5].tolist(), b[b < 5].tolist())} == {frozenset((i, i + 1)) for i in range(4)}
