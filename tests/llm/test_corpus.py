"""The corpus operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from palimpsest.llm import chat, decontam, exactdedup, html, langid, mixing, simhash, tokens, toxicity, urlfilter
from palimpsest.llm.common import text_bytes
from palimpsest.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, owner long, h long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SOME = [
    None, "", " ", "a", "The quick brown fox. It's don't STOP'S", "Émile Zola, naïve café. 日本語。 x²!", "a\x0bb\tc\x1cd", "<|endoftext|> A<|ENDOFTEXT|>", "word " * 30_000, "x" * 60_000, "The quick brown fox. It's don't STOP'S",
]


def frame(spark, texts, **columns):
    """Documents with columns whose names clash with those that operators use."""
    rows = [(i, t, (columns.get("lang") or ["en"] * len(texts))[i], (columns.get("source") or ["s"] * len(texts))[i], len(t or ""), "clash", -1, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- 1 tokens -------------------------------------------------------------------------------------


def test_token_files_match_the_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r for r in tokens.token_files(frame(spark, SOME), TOKENIZER, end_id=1, length=64, batch_rows=3).collect()}
    start = 0
    assert len(got) == len(SOME)
    for i, t in enumerate(SOME):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i]["start"] == start and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_shard_random_access(tmp_path):
    w = tokens.ShardWriter(str(tmp_path), 0, np.uint16, 8, 2)
    parts = [np.arange(n, dtype=np.uint16) + 10 * n for n in (3, 20, 1, 17)]
    for i, p in enumerate(parts):
        w.add(i, p.tobytes())
    w.close()
    r = tokens.ShardReader(str(tmp_path), 0)
    flat = np.concatenate(parts)
    assert r.n_sequences == -(-len(flat) // 8)
    for i in range(r.n_sequences):
        want = flat[8 * i : 8 * i + 8]
        assert (r.sequence(i)[: len(want)] == want).all() and r.mask(i).tolist() == [True] * len(want) + [False] * (8 - len(want))
    assert not r.sequence(0).flags.owndata  # a view of the file
    at = 0
    for p in parts:
        assert (r.ids(at, len(p)) == p).all()
        at += len(p)


def test_token_files_empty_table(spark):
    assert tokens.token_files(frame(spark, []), TOKENIZER).count() == 0


# -- 2 decontamination ----------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_leaks(docs, items):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    out = []
    for t in docs:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for name, item in items:
            iw = WORD.findall(lower(item))
            n = min(10, len(iw))
            if not n:
                continue
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(name)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [64 << 20, 400])
def test_leaks_match_brute_force(spark, block):
    rng = random.Random(4)
    vocabulary = ["ab", "Bc", "cd", "é", "7", "zz", "q"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [("b1", say(25)), ("b10", say(12)), ("b2", say(3)), ("b3", "q"), ("b4", None), ("b5", ""), ("b6", "same " * 40), ("b7", say(9)), ("b8", say(10))]
    docs = [say(n) for n in (0, 1, 5, 9, 10, 60, 200, 400)] + [None, "", items[0][1] + " " + say(30), "x " + items[1][1].upper() + " y", "same " * 500, "!!"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.find_leaks(frame(spark, docs), bench, block_bytes=block).collect()
    want = brute_leaks(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in got} == dict(enumerate(want))
    assert all(sum(x["to"] - x["from"] for x in r["runs"]) == r["n_hit"] for r in got)


def test_leaks_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontam.find_leaks(frame(spark, ["a b"]), none).collect()] == [0]
    assert decontam.find_leaks(frame(spark, []), none).count() == 0


# -- 3 language ----------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.BiGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 1, 0])
    mask = np.ones((4, 6), bool)
    mask[0, 3:] = False
    old = langid.f32
    langid.f32 = np.float64
    try:
        _, g = net.step(x, y, mask)
        for name in ("U", "C", "V", "b", "E"):
            flat = net.p[name].reshape(-1)
            used = np.argsort(-np.abs(g[name].reshape(-1)))[:5]
            for i in used:
                keep, e = flat[i], 1e-3
                flat[i] = keep + e
                up, _ = net.step(x, y, mask)
                flat[i] = keep - e
                down, _ = net.step(x, y, mask)
                flat[i] = keep
                assert abs((up - down) / (2 * e) - g[name].reshape(-1)[i]) < 2e-3
    finally:
        langid.f32 = old


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).withColumn("held", langid.held_out()).join(docs.select("doc_id", "lang"), "doc_id").filter("held").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_edges(spark):
    docs = frame(spark, SOME + ["123 !!"])
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, len(SOME))] == ["und"] * 4 and got[3]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    none = frame(spark, [])
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0


def test_pooling_counts_every_byte_once():
    net = langid.BiGru(["a", "b"])
    texts = ["", "a" * 10, "b" * langid.STEPS, "hello world " * 40]
    together = net.pooled(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], net.pooled(*text_bytes(pa.array([t])))[0], atol=1e-5)
        assert abs(together[i].sum() - (1 if t else 0)) < 1e-4


# -- 4 near duplicates --------------------------------------------------------------------------------------------


def brute_print(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) > words else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, bits):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.choice([3, 40, 300]))) for _ in range(40)]
    texts = SOME + base + [b.replace("ak", "AK") for b in base[:10]] + [b + " tail" for b in base[:20]] + base[:5]
    prints = [brute_print(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_classes(prints, 3)


def test_tree_finds_all_pairs_of_many_points():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = points[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64))
    chain = points[:100] ^ np.uint64(0b111)
    points = np.unique(np.concatenate([points, near, chain]))
    nodes = simhash.top_tree(points[::3], 8, 3)
    assert nodes
    rows, shard = simhash.route(points, nodes, 3)
    label = np.arange(len(points))
    for s in np.unique(shard):
        mine = rows[shard == s]
        for a, b in zip(*simhash.links(points[mine], 3)):
            x, y = sorted((label[mine[a]], label[mine[b]]))
            label[label == y] = x
    want = np.arange(len(points))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[:i] ^ points[i]) <= 3):
            x, y = sorted((want[i], want[j]))
            want[want == y] = x
    assert (label == want).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 5 exact duplicates -----------------------------------------------------------------------------------------------


def test_exact_duplicates(spark, monkeypatch):
    texts = SOME + ["same"] * 50 + ["same ", "Same", None, ""]
    got = {r["doc_id"]: r for r in exactdedup.exact_duplicates(frame(spark, texts).repartition(5), trie_bytes=1000).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exactdedup.exact_duplicates(frame(spark, [])).count() == 0


def test_trie_against_dict():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    trie, plain = exactdedup.Trie(), {}
    for i, k in enumerate(rng.choices(keys, k=2000)):
        assert trie.insert(k, i + 1) == plain.setdefault(k, i + 1)
    assert all(trie.get(k) == plain.get(k) for k in keys)
    assert sorted(trie.spill_before(b"b")) == sorted(v for k, v in plain.items() if k and k < b"b")
    assert all(trie.get(k) == plain.get(k) for k in keys if k >= b"b")
    assert all(trie.get(k) is None for k in keys if k and k < b"b")
    left = {k: v for k, v in plain.items() if not k or k >= b"b"}
    gone = dict(trie.spill(trie.bytes // 2))
    assert gone and gone.items() <= left.items() and not any(trie.get(k) for k in gone)
    assert dict(trie.rest()) == {k: v for k, v in left.items() if k not in gone} and trie.bytes == 0


# -- 6 mixing -------------------------------------------------------------------------------------------------------------


def test_pfair_stays_within_one_block():
    blocks, weights = {"a": 400, "b": 300, "c": 30, "d": 5}, {"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}
    plan = mixing.pfair(blocks, weights)
    assert sorted((s, i) for s, i, *_ in plan) == sorted((s, i) for s, n in blocks.items() for i in range(n))
    assert [p[2] for p in plan] == list(range(len(plan)))
    active, given, start = dict(blocks), dict.fromkeys(blocks, 0), 0
    for s, _, slot, release, due, lag in plan:
        assert release <= slot < due
        given[s] += 1
        total = sum(weights[k] for k in active)
        assert abs(lag - (given[s] - (slot + 1 - start) * weights[s] / total)) < 1e-9
        for k in active:
            assert abs(given[k] - (slot + 1 - start) * weights[k] / total) < 1
        active[s] -= 1
        if not active[s]:
            active = {k: v for k, v in active.items() if v}
            given, start = dict.fromkeys(active, 0), slot + 1


def test_mix_keeps_all_rows(spark):
    texts = ["word " * (i % 50) for i in range(600)] + [None, "", "long " * 20_000, "a", "a"]
    sources = [None if i % 10 == 9 else "hot" if i % 3 else f"s{i % 5}" for i in range(len(texts))]
    docs = frame(spark, texts, source=sources)
    got = mixing.mix(docs, block=500, weights={"hot": 1, "s0": 2}).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    for s in set(sources):
        blocks = sorted((r["mix_block"], r["mix_slot"]) for r in got if r["source"] == s)
        assert len({b for b, _ in blocks}) == blocks[-1][0] + 1 and len(dict(blocks)) == len(set(blocks))
    ordered = mixing.mixed_order(docs, block=500).collect()
    assert [r["doc_id"] for r in sorted(mixing.mix(docs, block=500).collect(), key=lambda r: (r["mix_slot"], r["mix_rank"], r["doc_id"]))] == [r["doc_id"] for r in ordered]
    assert mixing.mix(frame(spark, [])).count() == 0


# -- 7 toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_catches_misspellings():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    clean = lambda n: [rng.choice(words) for _ in range(n)]
    bad = ["wretchedfool", "stinkbrain"]
    samples = [(" ".join(clean(80)), 0) for _ in range(150)] + [(" ".join(rng.sample(clean(80) + [rng.choice(bad)] * 4, 84)), 1) for _ in range(150)]
    model = toxicity.train(samples, rounds=6)
    score = lambda t: model.score(*text_bytes(pa.array([t])))[0]
    assert score(" ".join(clean(200))) < 0.5 < score(" ".join(clean(500) + ["wretchedfool", "stinkbrain", "wretchedfool"] + clean(500)))
    assert score("you wretchdfool stinkbrains") > 0.5
    assert (np.array([score(""), score("!!")]) < 0.5).all()


def test_toxicity_query_edges(spark):
    docs = frame(spark, SOME + ["nice day today", "you idiot fool"] * 10)
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(len(SOME), len(SOME) + 20)] + [(999, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(SOME) + 20 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    none = labels.limit(0)
    assert toxicity.score(docs, toxicity.fit(docs, none)).count() == len(SOME) + 20
    assert toxicity.score(frame(spark, []), toxicity.fit(frame(spark, []), none)).count() == 0


# -- 8 URLs ---------------------------------------------------------------------------------------------------------------------


def brute_judge(url, rules, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    bare = re.sub(r"^www\.", "", re.sub(r"\.+$", "", re.sub(r":\d*$", "", re.sub(r"^[^@]*@", "", host))))
    parts = bare.split(".")
    names = {bare + re.sub(r"/+$", "", path), *(".".join(parts[i:]) + "/" for i in range(len(parts)))} if host else set()
    return host, path, None, "block" if names & set(listed) else "allow"


def test_url_verdicts(spark):
    urls = [
        None, "", "no scheme", "http://a.net", "http://a.net/", "https://Blog.Example.NET/en/1?q#x", "http://xexample.net/en/", "http://example.com/de/1", "http://www.example.com/de", "http://u.example.org/fr/x", "http://org/fr/",
        "http://spam-farm.example.org/a", "http://www.spam-farm.example.org:80/a", "http://user@m.spam-farm.example.com", "http://notspam-farm.example.com/", "http://ok.com/bad/page/", "http://ok.com/bad/page?x=1", "http://ok.com/bad/pages", "a://b://c.net/x", "http:///x", "http://a.net?x/y",
    ] + ["http://spam-farm.example.org/a"] * 50
    listed = [*urlfilter.LISTED, "ok.com/bad/page"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, urlfilter.listed_table(spark, listed)).collect()}
    assert got == {i: brute_judge(u, urlfilter.RULES, listed) for i, u in enumerate(urls)}
    nothing = spark.createDataFrame([], "listed string")
    assert {r["verdict"] for r in urlfilter.judge(pages, nothing, ()).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), nothing).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(8)
    keys, others = rng.integers(-(2**63), 2**63, 20_000), rng.integers(-(2**63), 2**63, 20_000)
    bloom = urlfilter.BlockedBloom.for_keys(len(keys))
    bloom.add(keys)
    assert bloom.may_have(keys).all() and bloom.may_have(others).mean() < 0.03
    full = urlfilter.BlockedBloom.for_keys(len(keys), limit=64)
    full.add(keys)
    assert full.may_have(keys).all()


# -- 9 HTML ----------------------------------------------------------------------------------------------------------------------


def test_main_text_of_pages():
    long = "plain words of a story that goes on for a while " * 4
    cases = {
        f"<nav><a href=x>menu</a></nav><article><h1>Head</h1><p>{long}</p><p>b &amp; c&nbsp;d</p></article><footer>foot</footer>": f"Head\n{long.strip()}\nb & c d",
        f"<header>site</header><div class='sidebar'>{long}</div><main><p>One<br>two</p><script>var a='<p>x</p>'</script><style>p{{}}</style></main><form>mail <input></form>": "One two",
        f"<article><p>{long}</p><!-- <p>gone</p> --><aside>{long}</aside><div class='comments'><p>{long}</p></div></article><div class=ad>{long}</div>": long.strip(),
        f"<p>{long}<p>{long}": f"{long.strip()}\n{long.strip()}",
        f"<div id='siteHeader'>{long}</div><div class='postBody'><div class='entry-header'><h1>H</h1></div><p>{long}</p><section class='reader-comments'><p>{long}</p></section></div><div class='cookieBar'>{long}</div>": f"H\n{long.strip()}",
        "": "", "<article><p>cut off &am": "cut off &am", f'<article title="a > b"><p>{long}</p><p class="x': long.strip(),
    }
    for page, want in cases.items():
        assert html.main_text(page) == want, page[:60]
    assert html.main_text(None) == ""


def test_extraction_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, None, "<p>a</p>", "x"), (None, "u", "<" * 50_000, "x")], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


# -- 10 chats -----------------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_masks(spark):
    rng = random.Random(6)
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = []
    for c in [None, 1, 2, 3, -1]:
        turns = {None: 3, 1: 40, 2: 1, 3: 300, -1: 2}[c]
        for t in range(turns):
            role = "system" if t == 0 and c in (1, 3) else ["user", "assistant"][t % 2]
            text = rng.choice([None, "", probe, "<\\|x", "<\\\\|", "\n", "é" * 5, "word " * rng.randrange(400)])
            rows.append((c, t, role if (c, t) != (1, 5) else "odd\nrole<|im_end|>\\n", text))
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(data, budget=200, history_tokens=60, history_turns=3, group_turns=64)
    kept = windows.collect()
    assert max(len(w["loss"]) for w in kept) >= 1 and any(w["n_repeated"] > 1 for w in kept)
    for w in kept:
        if w["conv_id"] in (1, 3):
            assert chat.parse(w["formatted"])[0][0] == "system"
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    for c in {r[0] for r in rows}:
        mine = [(r or "", t or "") for k, _, r, t in rows if k == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(w["formatted"]) for w in kept if w["conv_id"] == c)
    assert chat.digests(chat.format_chats(data.limit(0))).count() == 0


def test_windows_fit_the_budget():
    rng = random.Random(7)
    for _ in range(200):
        turns = [("user", "", rng.randrange(1, 40)) for _ in range(rng.randrange(1, 30))]
        system = rng.random() < 0.5
        seen = []
        for picked, repeated in chat.windows(turns, system, 0, budget=60, history_tokens=25, history_turns=3):
            new = picked[repeated:]
            seen += new
            size = sum(turns[i][2] for i in picked)
            assert size <= 60 or len(new) == 1
        assert seen == list(range(len(turns)))


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|", "a<|im_end|>b", "<<|", "<|<\\|", "\\<|", "<\\", ""])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"
