"""The mix's deviation in code points, with documents of many blocks."""

import random
from collections import defaultdict

import pytest

from palimpsest.llm import mixing

from .test_corpus import frame


@pytest.mark.parametrize("long", [20_000, 2_000])
def test_text_follows_the_weights_with_documents_of_many_blocks(spark, long):
    rng = random.Random(8)
    block = 500
    texts = ["x" * rng.choice([long, long // 2, 40]) for _ in range(60)] + ["y" * rng.randrange(300) for _ in range(4000)] + ["z" * rng.randrange(900) for _ in range(1500)]
    sources = ["books"] * 60 + ["web"] * 4000 + ["news"] * 1500
    weights = {"books": 0.5, "web": 0.3, "news": 0.2}
    rows = mixing.mix(frame(spark, texts, source=sources), block=block, weights=weights).collect()
    assert len(rows) == len(texts)
    left, largest, by_slot = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        n = len(r["text"]) + 1
        left[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
        by_slot[r["mix_slot"]].append((r["source"], n))
    # Until the first source's last block, wherever that is: its text is worth total / weight.
    end = min(int(left[s] / block / w) for s, w in weights.items()) - len(weights)
    assert end > 20
    given = dict.fromkeys(weights, 0)
    for slot in range(end):
        for s, n in by_slot[slot]:
            given[s] += n
        for s, w in weights.items():
            assert abs(given[s] - (slot + 1) * w * block) < block + largest[s]
