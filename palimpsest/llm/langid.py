"""Language identification by a bidirectional gated recurrent network over bytes.

Trained here in numpy by backpropagation through time. A text's bytes are cut
into segments of ``STEPS``; two recurrent passes, one from each end, label
every position with language probabilities, and a document's probabilities
are the mean over all its positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE_BYTES, prepare, slices, text_bytes

#: Bytes that a recurrent pass runs over before it starts anew; hidden units of a direction.
STEPS, HIDDEN = 48, 8
#: The bounded training sample: documents and bytes of text of each language.
DOCS_PER_LANG, BYTES_PER_LANG = 400, 2 << 20
#: Code points of one text in the sample, and languages that are learned, at most.
SPAN_CHARS, MAX_LANGS = 1 << 16, 256
UNDETERMINED = "und"

f32 = np.float32


class BiGru:
    """Both directions are kept in arrays of leading dimension 2 and stepped together."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        h, k = hidden, len(langs)
        init = lambda *shape, s: (rng.standard_normal(shape) * s).astype(f32)
        self.p = {
            "E": init(2, 256, 3 * h, s=0.5),  # of each byte: what it adds to reset, update and candidate
            "U": init(2, h, 2 * h, s=h**-0.5),
            "C": init(2, h, h, s=h**-0.5),
            "V": init(2, h, k, s=h**-0.5),
            "b": np.zeros(k, f32),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: bytes (segments, steps). Returns position logits (2-direction sums) and the tape."""
        p, (n, steps) = self.p, x.shape
        h = p["U"].shape[1]
        state = np.zeros((2, n, h), f32)
        states = np.empty((steps + 1, 2, n, h), f32)
        states[0] = state
        gates, cands = ([], []) if keep else (None, None)
        # Gates are sigmoids, as half a tanh of half the sum; reset, update and candidate are apart so that all is contiguous.
        er, eu = (np.ascontiguousarray(p["E"][:, :, i * h : (i + 1) * h].reshape(512, h)) * f32(0.5) for i in (0, 1))
        ec = np.ascontiguousarray(p["E"][:, :, 2 * h :].reshape(512, h))
        ur, uu = (np.ascontiguousarray(p["U"][:, :, i * h : (i + 1) * h]) * f32(0.5) for i in (0, 1))
        index = np.empty((steps, 2, n), np.intp)
        index[:, 0] = x.T
        index[:, 1] = x.T[::-1]
        index[:, 1] += 256
        r, u, c, got = (np.empty((2, n, h), f32) for _ in range(4))
        for t in range(steps):
            for gate, w, e in ((r, ur, er), (u, uu, eu)):
                np.matmul(state, w, out=gate)
                np.take(e, index[t], axis=0, out=got, mode="clip")
                gate += got
                np.tanh(gate, out=gate)
                gate += f32(1)
                gate *= f32(0.5)
            np.multiply(r, state, out=got)
            np.matmul(got, p["C"], out=c)
            np.take(ec, index[t], axis=0, out=got, mode="clip")
            c += got
            np.tanh(c, out=c)
            if keep:
                gates.append(np.concatenate([r, u], 2))
                cands.append(c.copy())
            new = states[t + 1]
            np.subtract(c, state, out=new)
            new *= u
            new += state
            state = new
        fw, bw = states[1:, 0], states[1:, 1][::-1]
        logits = fw @ p["V"][0] + bw @ p["V"][1] + p["b"]  # (steps, n, k)
        return logits, (states, gates, cands)

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over all positions, and its gradients by backpropagation through time."""
        p, (n, steps) = self.p, x.shape
        h = p["U"].shape[1]
        logits, (states, gates, cands) = self.forward(x, keep=True)
        prob = np.exp(logits - logits.max(-1, keepdims=True))
        prob /= prob.sum(-1, keepdims=True)
        m = mask.T.astype(f32)
        total = max(1.0, float(m.sum()))
        loss = -float((np.log(prob[:, np.arange(n), y] + 1e-9) * m).sum()) / total
        d = prob
        d[:, np.arange(n), y] -= 1
        d *= (m / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        fw, bw = states[1:, 0], states[1:, 1][::-1]
        g["b"] = d.sum((0, 1))
        g["V"][0] = np.einsum("tnh,tnk->hk", fw, d)
        g["V"][1] = np.einsum("tnh,tnk->hk", bw, d)
        out = np.stack([d @ p["V"][0].T, (d @ p["V"][1].T)[::-1]], 1)  # by step of each direction
        back = np.zeros((2, n, h), f32)
        ut, ct = p["U"].transpose(0, 2, 1), p["C"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            before, z, c = states[t], gates[t], cands[t]
            r, u = z[:, :, :h], z[:, :, h:]
            dh = back + out[t]
            dc = dh * u * (1 - c * c)
            du = dh * (c - before) * u * (1 - u)
            drs = np.matmul(dc, ct)
            dr = drs * before * r * (1 - r)
            dz = np.concatenate([dr, du], 2)
            back = dh * (1 - u) + drs * r + np.matmul(dz, ut)
            g["U"] += np.matmul(before.transpose(0, 2, 1), dz)
            g["C"] += np.matmul((r * before).transpose(0, 2, 1), dc)
            both = np.concatenate([dz, dc], 2)
            np.add.at(g["E"][0], x[:, t], both[0])
            np.add.at(g["E"][1], x[:, steps - 1 - t], both[1])
        return loss, g

    def pooled(self, raw: np.ndarray, offsets: np.ndarray, group: int = 2048) -> np.ndarray:
        """Mean position probabilities of each text."""
        k = len(self.langs)
        sizes = np.diff(offsets)
        n_seg = -(-sizes // STEPS)
        doc = np.repeat(np.arange(len(sizes)), n_seg)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        # A text's last segment begins early enough to be whole; positions seen before don't count again.
        begin = offsets[:-1][doc] + np.maximum(0, np.minimum(nth * STEPS, sizes[doc] - STEPS))
        length = np.minimum(STEPS, sizes[doc])
        again = offsets[:-1][doc] + nth * STEPS - begin
        order = np.argsort(length, kind="stable")  # segments of one length share a pass, so nothing is padded
        ordered = length[order]
        sums = np.zeros((len(doc), k))
        at = 0
        while at < len(order):
            size = int(ordered[at])
            end = min(at + group, int(np.searchsorted(ordered, size, side="right")))
            rows = order[at:end]
            x = raw[begin[rows][:, None] + np.arange(size)]
            logits, _ = self.forward(x)
            logits -= logits.max(-1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(-1, keepdims=True)
            late = np.flatnonzero(again[rows])
            if len(late):
                logits[:, late] *= (np.arange(size)[:, None] >= again[rows[late]])[:, :, None]
            sums[rows] = logits.sum(0)
            at = end
        out = np.zeros((len(sizes), k))
        np.add.at(out, doc, sums)
        return out / np.maximum(1, sizes)[:, None]


def train(samples: list[tuple[str, str]], *, rounds: int = 500, batch: int = 192, rate: float = 0.02, seed: int = 3) -> BiGru | None:
    """Adam over segments drawn evenly from the languages of (text, lang) samples."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    pool: dict[str, list[np.ndarray]] = {lang: [] for lang in langs}
    for text, lang in samples:
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw):
            pool[lang].append(raw)
    pool = {lang: v for lang, v in pool.items() if v}
    net = BiGru(langs)
    if not pool:
        return net
    index = {lang: i for i, lang in enumerate(langs)}
    names = sorted(pool)
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, rounds + 1):
        x, y, mask = np.zeros((batch, STEPS), np.uint8), np.zeros(batch, np.int64), np.zeros((batch, STEPS), bool)
        for i in range(batch):
            lang = names[i % len(names)]
            raw = pool[lang][rng.integers(len(pool[lang]))]
            at = rng.integers(max(1, len(raw) - STEPS + 1))
            part = raw[at : at + STEPS]
            x[i, : len(part)], mask[i, : len(part)], y[i] = part, True, index[lang]
        _, grads = net.step(x, y, mask)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        lr = rate * min(1.0, 3 * (1 - t / (rounds + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.p[k] -= (lr * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-6)).astype(f32)
    return net


def held_out(column: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG, max_langs: int = MAX_LANGS) -> BiGru | None:
    """Train on rows that aren't held out and have a lang and a letter.

    Of each language, the documents least by hash are taken, up to the two
    bounds, and of a text over ``SPAN_CHARS`` code points one span at a place
    drawn by its hash, so a language of long texts alone is learned too. Equal
    rows of one doc_id count once. Languages are the ``max_langs`` most frequent.
    Twice the documents wanted of each is all that reaches the driver.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.least(F.octet_length("text"), F.lit(SPAN_CHARS))
    top = usable.groupBy("lang").agg(F.count("*").alias("n"), F.avg(size).alias("b")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if not top:
        return None
    kind = docs.schema["lang"].dataType.simpleString()
    want = [(r["lang"], min(docs_per_lang, max(1, int(bytes_per_lang // max(1, r["b"]))))) for r in top]
    shares = docs.sparkSession.createDataFrame([(lang, w, min(1.0, 2.0 * w / r["n"])) for (lang, w), r in zip(want, top)], f"lang {kind}, want int, share double")
    h = F.xxhash64("doc_id", "text", F.lit("lang"))
    drawn = usable.select("lang", "text", h.alias("h")).join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    place = F.pmod("h", F.greatest(F.lit(1), F.char_length("text") - SPAN_CHARS + 1)).cast("int") + 1
    spans = drawn.select("lang", "h", "want", F.substring(F.col("text"), place, F.lit(SPAN_CHARS)).alias("text")).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    got = spans.withColumn("rank", rank).filter("rank <= 2 * want").collect()
    got.sort(key=lambda r: (r["lang"], r["rank"]))
    taken: dict[str, list[int]] = {}
    samples = []
    for r in got:
        n = taken.setdefault(r["lang"], [0, 0])
        size = len(r["text"].encode())
        if n[0] < docs_per_lang and (n[1] + size <= bytes_per_lang or not n[0]):
            n[0] += 1
            n[1] += size
            samples.append((r["text"], r["lang"]))
    return train(samples)


def identify(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score.

    ``und`` with score 0 where the text is null, empty or without a letter, or
    where nothing could be learned; of languages with one probability the first
    by name. Repeated rows and doc_ids give a row each, an empty table none;
    other columns are ignored. One narrow pass; whole texts of any length.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text", SLICE_BYTES):
            valid = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            if net is None:
                names, scores = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                prob = net.pooled(*text_bytes(batch.column("text")))
                best = prob.argmax(1)
                names = [net.langs[b] if v else UNDETERMINED for b, v in zip(best, valid)]
                scores = np.where(valid, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.record_batch([batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(label, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: BiGru | None, min_score: float) -> DataFrame:
    """The documents, with all their columns, that have a letter and whose best language has at least ``min_score``.

    Null and empty texts go. Each row is judged by itself, so repeated ones stay
    or go together. One narrow filter; where nothing could be learned no document
    is kept.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, mark = docs.columns, "letter"
    while mark in names:
        mark += "_"
    marked = docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "text", SLICE_BYTES):
            letter = batch.column(mark).to_numpy(zero_copy_only=False)
            sure = net.pooled(*text_bytes(batch.column("text"))).max(1, initial=0) >= min_score if net is not None else np.zeros(batch.num_rows, bool)
            yield batch.select(names).filter(pa.array(letter & sure))

    return marked.mapInArrow(keep, docs.schema)
