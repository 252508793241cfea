"""Toxicity by subword-bag embeddings under a linear softmax.

A word's units are the word itself and its character 3- to 5-grams with word
edges marked, hashed into buckets of embeddings. A window of words is the
average of its units' embeddings; a linear softmax on that average gives the
probability of toxic. Embeddings and softmax are trained jointly in numpy, and
a document scores as its most toxic window, so length doesn't dilute it. A
misspelling that was never seen shares most n-grams with its word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mixed, prepare, slices, text_bytes
from .langid import held_out

BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4, 5)
#: Bytes of one word, and of a text that are read at once, at most.
WORD_LIMIT, PIECE_BYTES = 4096, 1 << 20
#: Words in a window, and between the starts of two.
WINDOW, STRIDE = 24, 12
#: The bounded training sample: rows of each label, and bytes of text of all.
ROWS_PER_LABEL, SAMPLE_BYTES = 3000, 16 << 20

_TABLES = np.random.default_rng(99).integers(0, 2**63, (max(NGRAMS), 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OPEN, _CLOSE = 1, 2  # bytes that no word has


def _words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts; a run of over ``WORD_LIMIT`` word bytes counts as several words."""
    words = Words(raw, offsets)
    sizes = words.ends - words.starts
    if sizes.max(initial=0) > WORD_LIMIT:
        parts = -(-sizes // WORD_LIMIT)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, doc = np.repeat(words.starts, parts) + nth * WORD_LIMIT, np.repeat(words.ends, parts), np.repeat(words.doc, parts)
        words.starts, words.ends, words.doc = starts, np.minimum(ends, starts + WORD_LIMIT), doc
        words.n_words = np.bincount(doc, minlength=len(offsets) - 1)
        words.first = np.concatenate([[0], np.cumsum(words.n_words)])
    return words


def units(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every unit, in no order that matters."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = words.ends - words.starts
    at = np.cumsum(lengths) - lengths + 2 * np.arange(n) + 1
    stream = np.empty(int(lengths.sum()) + 2 * n, np.uint8)
    word = np.repeat(np.arange(n), lengths + 2)
    inner = np.ones(len(stream), bool)
    inner[at - 1] = inner[at + lengths] = False
    stream[at - 1], stream[at + lengths] = _OPEN, _CLOSE
    stream[inner] = words.low[words.inside]
    left = np.repeat(at + lengths + 1, lengths + 2) - np.arange(len(stream))  # bytes up to the word's end, mark included
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    got, owner = [(words.hashes() >> shift).astype(np.int64)], [np.arange(n)]
    h = np.zeros(len(stream), np.uint64)
    for j in range(max(NGRAMS)):
        m = len(stream) - j
        if m <= 0:
            break
        h = h[:m] + _TABLES[j][stream[j:]]
        if j + 1 in NGRAMS:
            fits = np.flatnonzero(left[:m] > j)
            got.append((mixed(h[fits]) >> shift).astype(np.int64))
            owner.append(word[fits])
    return np.concatenate(got), np.concatenate(owner)


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.v = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32)
        self.b = np.zeros(2, np.float32)

    def projected(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the logit of toxic, and the constant: averages are linear, so one number a unit is enough."""
        d = self.v[:, 1] - self.v[:, 0]
        return self.e @ d, float(self.b[1] - self.b[0])


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of each window; a text without words has none."""
    n = words.n_words
    per = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    text = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = words.first[:-1][text] + nth * STRIDE
    return begin, np.minimum(begin + WINDOW, words.first[1:][text]), text


class Scorer:
    """What scoring needs of a model: one float for each bucket."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of toxic of each text; texts over ``PIECE_BYTES`` are read in pieces, so memory is bounded."""
        sizes = np.diff(offsets)
        if sizes.max(initial=0) <= PIECE_BYTES:
            best = self._logits(_words(raw, offsets))
        else:
            parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            best = np.array([self._long(p) if len(p) > PIECE_BYTES else self._logits(_words(p, np.array([0, len(p)])))[0] for p in parts])
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))

    def _logits(self, words: Words) -> np.ndarray:
        """The logit of each text's most toxic window."""
        bucket, owner = units(words)
        sums = np.concatenate([[0.0], np.cumsum(np.bincount(owner, self.weights[bucket], len(words)))])
        counts = np.concatenate([[0.0], np.cumsum(np.bincount(owner, minlength=len(words)))])
        begin, end, text = _windows(words)
        logits = (sums[end] - sums[begin]) / np.maximum(1, counts[end] - counts[begin]) + self.bias
        best = np.full(len(words.n_words), self.bias)
        if len(text):
            best[np.unique(text)] = np.maximum.reduceat(logits, np.flatnonzero(np.diff(text, prepend=-1)))
        return best

    def _long(self, raw: np.ndarray) -> float:
        """The same for one long text. A piece's whole windows are rated; the next piece begins where the next window does."""
        best, at, size = None, 0, PIECE_BYTES
        while True:
            end = min(len(raw), at + size)
            words = _words(raw[at:end], np.array([0, end - at]))
            last = end == len(raw)
            whole = (len(words) - 1 - WINDOW) // STRIDE + 1  # the last word may be cut
            if not last and whole < 1:
                size *= 2  # hardly a word in it
                continue
            if not last:
                stop, following = int(words.ends[(whole - 1) * STRIDE + WINDOW - 1]), int(words.starts[whole * STRIDE])
                words = _words(raw[at : at + stop], np.array([0, stop]))
            if len(words) > (WINDOW - STRIDE if at else 0):  # fewer are part of the window before
                got = float(self._logits(words)[0])
                best = got if best is None else max(best, got)
            if last:
                return self.bias if best is None else best
            at, size = at + following, PIECE_BYTES


def train(samples: list[tuple[str, int]], *, rounds: int = 8, batch: int = 64, rate: float = 0.5, seed: int = 13) -> Scorer:
    """Adagrad on (text, label) pairs. In each step a text stands for its window that scores most toxic just now
    (in the first round one drawn at random), so toxic texts teach by their toxic part and clean ones by their worst."""
    model = Model()
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, y in samples])
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        return Scorer(np.zeros(BUCKETS), float(np.log((share + 0.01) / (1.01 - share))))
    groups = [np.flatnonzero(labels == y) for y in (0, 1)]
    # Units of all texts once, by word, to be cut into windows.
    texts = []
    for t, _ in samples:
        words = _words(*text_bytes(pa.array([t])))
        bucket, owner = units(words)
        order = np.argsort(owner, kind="stable")
        texts.append((bucket[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1)), _windows(words)))
    se, sv, sb = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    steps = max(30, max(len(g) for g in groups) * 2 // batch)
    for t in range(rounds * steps):
        picks = np.concatenate([rng.choice(g, batch // 2) for g in groups])
        y = labels[picks]
        weight, bias = model.projected()
        got, counts = [], []
        for i in picks:
            bucket, first, (begin, end, _) = texts[i]
            if not len(begin):
                got.append(bucket[:0])
            else:
                if t < steps // 4:
                    w = rng.integers(len(begin))
                else:
                    run = np.concatenate([[0.0], np.cumsum(weight[bucket])])
                    a, b = first[begin], first[end]
                    w = int(np.argmax((run[b] - run[a]) / np.maximum(1, b - a)))
                got.append(bucket[first[begin[w]] : first[end[w]]])
            counts.append(max(1, len(got[-1])))
        flat, text, counts = np.concatenate(got), np.repeat(np.arange(len(picks)), [len(g) for g in got]), np.array(counts)
        mean = np.zeros((len(picks), DIM), np.float32)
        np.add.at(mean, text, model.e[flat])
        mean /= counts[:, None]
        logits = mean @ model.v + model.b
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(picks)), y] -= 1
        prob /= len(picks)
        gv, gb = mean.T @ prob, prob.sum(0)
        # A unit's step is not shrunk by its window's length: that only scales the rate.
        ge = (prob @ model.v.T)[text]
        sv += gv * gv
        sb += gb * gb
        np.add.at(se, flat, (ge * ge).mean(1))
        step = np.zeros((0, 0))
        rows, inverse = np.unique(flat, return_inverse=True)
        step = np.zeros((len(rows), DIM), np.float32)
        np.add.at(step, inverse, ge)
        model.e[rows] -= rate * step / np.sqrt(se[rows])[:, None]
        model.v -= 0.1 * gv / np.sqrt(sv)
        model.b -= 0.1 * gb / np.sqrt(sb)
    return Scorer(*model.projected())


def fit(docs: DataFrame, labels: DataFrame, *, rows_per_label: int = ROWS_PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> Scorer:
    """Train on labelled rows that aren't held out: of each label those least by hash, up to the two bounds.

    Sizes come first, one for each labelled doc_id, so the texts that reach the
    driver are within the bounds. Of a doc_id with several texts the shortest
    counts, ties by hash; one with several labels counts by its largest. Null
    labels, doc_ids and texts don't count. Without labels all texts score alike.
    """
    marked = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = []
    for y in (0, 1):
        drawn += marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit("tox")), "doc_id").limit(rows_per_label).collect()
    if not drawn:
        return train([])
    ids = docs.sparkSession.createDataFrame(drawn, marked.schema)
    told = docs.select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")).filter(F.col("text").isNotNull())
    texts = told.select("doc_id", "n", "h").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("n", "h")).alias("s"), F.max("toxic").alias("toxic"))
    sizes = texts.select("doc_id", "s.n", "s.h", "toxic").collect()
    share = sample_bytes // max(1, len(drawn))
    room, fits = sample_bytes, []
    for r in sorted(sizes, key=lambda r: (r["n"] > 8 * share, zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]))):
        if r["n"] <= room:
            room -= r["n"]
            fits.append(tuple(r))
    if not fits:
        return train([])
    kind = marked.schema["doc_id"].dataType.simpleString()
    small = docs.sparkSession.createDataFrame(fits, f"doc_id {kind}, n int, h long, toxic int")
    rows = told.join(F.broadcast(small), ["doc_id", "n", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: str(r["doc_id"]))])


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 from 0.5).

    Null and empty texts get the score of no evidence. Repeated rows and doc_ids
    give a row each, an empty table none; other columns are ignored. One narrow
    pass over whole texts of any length, in bounded memory.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            s = shared.value.score(*text_bytes(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
