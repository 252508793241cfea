"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of each text, in every window of consecutive
word k-grams the one with the least hash (the right one of equals) is kept as
a fingerprint. A span of ``span = k + w - 1`` words that two texts share has
the same k-gram hashes, so both keep the same fingerprint inside it: the join
of fingerprints misses no shared span. Each hit is then extended to the spans
of ``span`` words around it, which are compared word for word.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, gram_weights, grams, materialize, mixed, prepare, slices, text_bytes

#: Words in a window, and in the k-grams that are winnowed (fewer in items with fewer words).
SPAN, GRAM_WORDS = 10, 5
#: Bytes of benchmark text in one index, which takes about ten times as much memory; beyond it there are several passes.
BLOCK_BYTES = 16 << 20


def winnow(hashes: np.ndarray, doc: np.ndarray, k: int, span: int) -> np.ndarray:
    """Starts of the k-grams kept. ``hashes`` are of k-grams at each word, ``doc`` the text of each word."""
    w = span - k + 1
    n = len(doc) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, where = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, w):
        other = hashes[j : j + n]
        less = other <= best
        best[less] = other[less]
        where[less] = j
    whole = doc[:n] == doc[span - 1 :]
    keep = np.zeros(len(doc), dtype=bool)
    keep[(np.arange(n) + where)[whole]] = True
    return np.flatnonzero(keep)


class Index:
    """Fingerprints of a block of items and the word windows behind them, in flat arrays.

    Of each window length: the k-gram length, the winnowed fingerprints, and the
    distinct windows in order of their hash, each with its place in ``joined``
    (all words of the block with a space after each) and its items as a run of
    indexes into ``names``.
    """

    def __init__(self, items: list[tuple[str, str | None]], span: int, k: int):
        words = Words(*text_bytes(pa.array([t for _, t in items], pa.string())))
        h = words.hashes()
        self.names = sorted({i for i, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        name_of = np.array([number[i] for i, _ in items], np.int64)
        sizes = words.ends - words.starts
        begin = np.cumsum(sizes + 1) - sizes - 1
        flat = np.full(int(sizes.sum()) + len(words), 32, np.uint8)
        flat[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)), sizes)] = words.low[words.inside]
        self.joined, end = flat.tobytes(), begin + sizes
        self.spans: dict[int, tuple] = {}
        lengths = np.minimum(words.n_words, span)
        for length in sorted({int(x) for x in lengths if x}):
            gram = min(k, length)
            mine = np.flatnonzero(lengths[words.doc] == length)
            sub, doc = h[mine], words.doc[mine]
            small = grams(sub, gram)
            prints = np.unique(small[winnow(small, doc, gram, length)])
            whole = np.flatnonzero(doc[: len(doc) - length + 1] == doc[length - 1 :])
            self.spans[length] = (gram, prints, *self._windows(grams(sub, length)[whole], begin[mine[whole]], end[mine[whole + length - 1]], name_of[doc[whole]]))

    def _windows(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows (hash, begin, end) in order of hash, and their items as (starts, names)."""
        order = np.lexsort((name, hashes))
        hashes, begin, end, name = hashes[order], begin[order], end[order], name[order]
        edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]])).tolist()
        rows, starts, held = array("q"), array("q", [0]), array("q")
        names = name.tolist()
        for a, b in zip(edges, edges[1:]):
            left = range(a, b)
            while left:  # more than once only for windows of equal hash that differ
                text = self.joined[begin[left[0]] : end[left[0]]]
                same = [i for i in left if self.joined[begin[i] : end[i]] == text] if len(left) > 1 else left
                rows.append(left[0])
                held.extend(sorted({names[i] for i in same}) if len(same) > 1 else [names[left[0]]])
                starts.append(len(held))
                left = [i for i in left if i not in set(same)] if len(same) < len(left) else ()
        at = np.array(rows, np.int64)
        return hashes[at], begin[at], end[at], np.array(starts, np.int64), np.array(held, np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of a slice are hit, and the items hit by text, as indexes into ``names``."""
        hit = np.zeros(len(words), dtype=bool)
        found: dict[int, set[int]] = defaultdict(set)
        if not len(words):
            return hit, found
        h = words.hashes()
        for length, (gram, prints, wide, begin, end, starts, names) in self.spans.items():
            small = grams(h, gram)
            kept = winnow(small, words.doc, gram, length)
            seen = kept[_in(small[kept], prints)]
            if not len(seen):
                continue
            at = np.unique((seen[:, None] - np.arange(length - gram + 1)).ravel())
            at = at[(at >= 0) & (at <= len(words) - length)]
            at = at[words.doc[at] == words.doc[at + length - 1]]
            big = np.zeros(len(at), np.uint64)
            for j, weight in enumerate(gram_weights(length)):
                big = big + h[at + j] * weight
            big = mixed(big + np.uint64(length))
            place = np.searchsorted(wide, big)
            place[place == len(wide)] = 0
            same = wide[place] == big
            for s, w in zip(at[same].tolist(), place[same].tolist()):
                key = b" ".join(words.low[a:b].tobytes() for a, b in zip(words.starts[s : s + length].tolist(), words.ends[s : s + length].tolist()))
                mine = wide[w]
                while w < len(wide) and wide[w] == mine:
                    if self.joined[begin[w] : end[w]] == key:
                        hit[s : s + length] = True
                        found[int(words.doc[s])].update(names[starts[w] : starts[w + 1]].tolist())
                        break
                    w += 1
        return hit, found


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _indexes(docs: DataFrame, benchmark: DataFrame, span: int, k: int, block_bytes: int) -> Iterator[Broadcast]:
    """A broadcast index of each block of the benchmark, one after the other; a block has about ``block_bytes`` of text."""
    spark = prepare(docs.sparkSession)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for b in range(n):
        block = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in block.toLocalIterator()], span, k))


_RUNS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _scan(index: Broadcast, key: str, every: bool):
    """A pass over batches of (key, text): key, n_words, n_hit, items, runs; of all texts or of those that are hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = index.value.names
        for batch in slices(batches, "text"):
            words = Words(*text_bytes(batch.column("text")))
            hit, found = index.value.search(words)
            counts = np.concatenate([[0], np.cumsum(hit)])
            n_hit = counts[words.first[1:]] - counts[words.first[:-1]]
            items = [[names[x] for x in sorted(found[i])] if i in found else [] for i in range(batch.num_rows)]
            runs = [[{"from": a, "to": b} for a, b in _runs(hit[words.first[i] : words.first[i + 1]])] if n_hit[i] else [] for i in range(batch.num_rows)]
            out = pa.record_batch(
                [batch.column(key), pa.array(words.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUNS)], names=[key, "n_words", "n_hit", "items", "runs"]
            )
            yield out if every else out.filter(pa.array(n_hit > 0))

    return scan


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, items, runs) of all blocks, as lists, as one set of items and one of runs without overlap."""
    for batch in batches:
        n_hit, items, runs = [], [], []
        for lists, several in zip(batch.column("items").to_pylist(), batch.column("runs").to_pylist()):
            items.append(sorted({i for some in lists for i in some}))
            out: list[list[int]] = []
            for a, b in sorted((r["from"], r["to"]) for some in several for r in some):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            n_hit.append(sum(b - a for a, b in out))
            runs.append([{"from": a, "to": b} for a, b in out])
        yield pa.record_batch([batch.column("row"), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, _RUNS)], names=["row", "n_hit", "items", "runs"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted item ids with a window in it), runs of hit words.

    A window is ``span`` words of an item, or all of a shorter item; an item
    without words has none. Null and empty texts have no words; null item ids
    count as ''. Repeated documents and doc_ids give a row each; an empty
    benchmark hits nothing, an empty table gives no row; other columns are
    ignored. A benchmark of ``block_bytes`` of text at most goes to the executors
    as one index: one narrow pass, documents are never shuffled, whatever words
    are frequent. A larger one is taken in blocks: the documents are written
    once with a number for each row, a narrow pass for each block writes the rows
    it hits, and these hits (no texts) are united by row.
    """
    indexes = _indexes(docs, benchmark, span, k, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = "n_words long, n_hit long, items array<string>, runs array<struct<from:int,to:int>>"
    first, second = next(indexes), next(indexes, None)
    if second is None:
        return docs.select("doc_id", "text").mapInArrow(_scan(first, "doc_id", True), f"doc_id {kind}, {result}")
    rows = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "leaks")
    counted = materialize(rows.select("row", "text").mapInArrow(_scan(first, "row", True), f"row long, {result}"), "leaks-first")
    parts = [counted.filter("n_hit > 0")]
    for index in (second, *indexes):
        parts.append(materialize(rows.select("row", "text").mapInArrow(_scan(index, "row", False), f"row long, {result}"), "leaks-block"))
        index.destroy()
    hits = reduce(DataFrame.unionAll, parts).groupBy("row").agg(F.collect_list("items").alias("items"), F.collect_list("runs").alias("runs"))
    hits = hits.mapInArrow(_unite, "row long, n_hit long, items array<string>, runs array<struct<from:int,to:int>>")
    told = rows.select("row", "doc_id").join(counted.select("row", "n_words"), "row").join(hits, "row", "left")
    none = F.array().cast("array<string>"), F.array().cast("array<struct<from:int,to:int>>")
    return told.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("runs", none[1]).alias("runs"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = GRAM_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit word, with all their columns.

    Windows, nulls, empty tables and repeated rows are as in ``find_leaks``; each
    row is judged by its own text. One narrow filter, nothing is shuffled; where
    the benchmark has several blocks, what is left is written after each.
    """
    held = None
    for index in _indexes(docs, benchmark, span, k, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = Words(*text_bytes(batch.column("text")))
                hit, _ = index.value.search(words)
                leaks = np.zeros(batch.num_rows, bool)
                leaks[words.doc[hit]] = True
                yield batch.filter(pa.array(~leaks))

        docs = (docs if held is None else materialize(docs, "decontaminated")).mapInArrow(clean, docs.schema)
        held = index
    return docs
