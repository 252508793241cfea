"""SimHash near-duplicates found by vantage-point trees.

Fingerprints are grouped first (equal ones are linked by that). The distinct
ones are dealt to shards by the top of a vantage-point tree: at each node the
Hamming distance to the vantage point is compared with the node's radius, and
by the triangle inequality only points outside the ball, but within ``bits`` of
its edge, can have a neighbour on both sides; these go to both. By induction
every pair within ``bits`` shares a shard. Shards that are still large get a
tree of their own, grown from their own points. Each shard goes on with the
same split in memory and compares all in its leaves, so the pairs are exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare, slices
from .components import components

SEED = 42
#: Distinct fingerprints aimed at in one shard, and in one leaf of its tree.
SHARD_POINTS, LEAF_POINTS = 4_000, 1024
#: Leaves of one tree of vantage points, at most, and fingerprints that are drawn to place its points, for each leaf.
TOP_LEAVES, SAMPLE_PER_LEAF = 1024, 64
#: Identifiers of dropped documents that may be broadcast: a few MB.
BROADCAST_IDS = 500_000
#: Bytes of a text that are cut into shingles at once.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")
#: A node of a tree of vantage points, as stored.
NODE = np.dtype([("vantage", "u8"), ("radius", "i8"), ("inner", "i8"), ("outer", "i8")])
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingles(text: bytes | None, words: int) -> Iterator[list[int]]:
    """Hashes of a text's shingles, repeats included, in lists of bounded length: one for each piece of the text,
    at least one, which is empty for a text without words."""
    text, at, held, short = text or b"", 0, [], True
    while True:
        # A piece goes on to the end of its last word, and begins with the words that shingles share with it.
        space = _SPACE.search(text, at + PIECE_BYTES)
        end = space.start() if space else len(text)
        tokens = held + text[at:end].lower().split()
        at, n = end, len(tokens)
        if n >= words:
            line = b" ".join(tokens)
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
            yield [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip([0, *(s + 1 for s in spaces)], [*spaces[words - 1 :], len(line)])]
            short, tokens = False, tokens[n - words + 1 :]
        held = tokens
        if space is None:
            break
    if short:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)] if held else []


def fingerprints(docs: DataFrame, *, words: int = 3) -> DataFrame:
    """Per document: doc_id, fp (long, the 64 bits). Texts without words have 0, null ones too.

    A-Z are lower-cased, words are runs of bytes other than space and
    \\x09-\\x0D; shingles of ``words`` words (all of them if fewer), repeats
    included, are hashed by XXH64; a bit is 1 if set in over half of them.
    """
    prepare(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes: list[int] = []
            counts = []
            long = {}
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                pieces = shingles(text, words)
                if text is not None and len(text) > PIECE_BYTES:
                    long[i], got = _majority_of(pieces), []
                else:
                    got = next(pieces)
                hashes += got
                counts.append(len(got))
            prints = _majority(np.array(hashes, np.uint64), np.array(counts))
            for i, fp in long.items():
                prints[i] = fp
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(compute, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _majority_of(pieces: Iterator[list[int]]) -> int:
    """The fingerprint of one long text, whose hashes come in pieces."""
    seen, total = np.zeros((8, 256)), 0
    for hashes in pieces:
        parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        seen += [np.bincount(parts[:, byte], minlength=256) for byte in range(8)]
        total += len(hashes)
    bits = 2 * (seen @ _BITS) > total
    return sum(1 << (8 * byte + i) for byte, i in zip(*(x.tolist() for x in np.nonzero(bits))))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each group's hashes, by byte histograms."""
    out = np.zeros(len(counts), np.uint64)
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    parts = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        seen = np.bincount(doc * 256 + parts[:, byte], minlength=256 * len(counts)).reshape(-1, 256)
        bits = (2 * (seen @ _BITS) > counts[:, None]).astype(np.uint64)
        out |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * byte)
    return out


def _split(points: np.ndarray, bits: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that leave the two sides about equal; None if no split makes them smaller."""
    best = None
    for vantage in rng.choice(points, min(4, len(points)), replace=False):
        d = np.bitwise_count(points ^ vantage)
        below = np.cumsum(np.bincount(d, minlength=65))
        inner = below[np.minimum(np.arange(65) + bits, 64)]  # what the ball's side gets
        outer = len(points) - below
        cost = inner.astype(float) ** 2 + outer.astype(float) ** 2
        cost[(inner == len(points)) | (outer == len(points))] = np.inf
        r = int(np.argmin(cost))
        if np.isfinite(cost[r]) and (best is None or cost[r] < best[0]):
            best = (cost[r], vantage, r)
    return None if best is None or best[0] > 0.95 * float(len(points)) ** 2 else best[1:]


def top_tree(sample: np.ndarray, leaves: int, bits: int, seed: int = 5) -> list[tuple]:
    """Nodes (vantage, radius, inner, outer); children below 0 are leaves -1, -2 ... A list of at most ``leaves`` nodes."""
    rng = np.random.default_rng(seed)
    nodes: list = []
    count = [0]

    def grow(points: np.ndarray, want: int) -> int:
        cut = _split(points, bits, rng) if want > 1 and len(points) > 16 else None
        if cut is None:
            count[0] += 1
            return -count[0]
        at = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(points ^ cut[0])
        inner, outer = points[d <= cut[1] + bits], points[d > cut[1]]
        nodes[at] = (int(cut[0]), cut[1], grow(inner, want // 2), grow(outer, want - want // 2))
        return at

    grow(sample, leaves)
    return nodes


def route(points: np.ndarray, nodes: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard each point belongs to: own, and those whose ball's edge is within ``bits``."""
    rows, shards = [], []
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        at, idx = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            rows.append(idx)
            shards.append(np.full(len(idx), -at - 1))
            continue
        vantage, radius, inner, outer = nodes[at]
        d = np.bitwise_count(points[idx] ^ np.uint64(vantage))
        stack.append((inner, idx[d <= radius + bits]))
        stack.append((outer, idx[d > radius]))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(shards)


def links(points: np.ndarray, bits: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as index pairs) of the graph that joins points within ``bits``."""
    rng = np.random.default_rng(seed)
    forest = Forest(len(points))
    stack = [np.arange(len(points))]
    while stack:
        idx = stack.pop()
        cut = _split(points[idx], bits, rng) if len(idx) > LEAF_POINTS else None
        if cut is not None:
            d = np.bitwise_count(points[idx] ^ cut[0])
            stack += [idx[d <= cut[1] + bits], idx[d > cut[1]]]
            continue
        mine = points[idx]
        step = max(1, 4_000_000 // max(1, len(idx)))
        for at in range(0, len(idx), step):
            near = np.bitwise_count(mine[at : at + step, None] ^ mine[None, at:]) <= bits
            a, b = np.nonzero(near)
            forest.join(idx[at + a[a < b]], idx[at + b[a < b]])
    return forest.edges()


class Forest:
    """Components of points as their least index, and the edges that made them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every round hangs each root that meets a lesser one under the least of these, by one edge."""
        while True:
            apart = self.label[a] != self.label[b]
            a, b = a[apart], b[apart]
            if not len(a):
                return
            low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            order = np.lexsort((low, high))
            one = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            self.kept.append((a[one], b[one]))
            root = np.arange(len(self.label))
            root[high[one]] = low[one]
            while not (root[root] == root).all():
                root = root[root]
            self.label = root[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = zip(*self.kept)
        return np.concatenate(a), np.concatenate(b)


def _deal(points: DataFrame, trees: dict[int, list[tuple]], bits: int) -> DataFrame:
    """``points(shard, fp)`` dealt on by the tree of their shard; shards without one stay. Numbers of new shards differ from all old ones."""
    shared = points.sparkSession.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, fp = batch.column("shard").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            out_s, out_f = [], []
            for s in np.unique(shard):
                mine = fp[shard == s]
                rows, leaf = route(mine, shared.value.get(int(s), []), bits)
                out_s.append(int(s) * TOP_LEAVES + leaf)
                out_f.append(mine[rows].view(np.int64))
            if out_s:
                yield pa.record_batch([pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_f))], names=["shard", "fp"])

    return points.mapInArrow(deal, "shard long, fp long")


def near_links(distinct: DataFrame, *, bits: int = 3, shard_points: int = SHARD_POINTS, top_leaves: int = TOP_LEAVES) -> DataFrame:
    """Edges (a, b) between fingerprints of ``distinct(fp)`` that connect all pairs within ``bits``.

    Only a spanning forest of each shard is returned, so a group of many near
    copies gives as many edges as members, not their pairs; its components are
    those of the exact pairs. The driver draws a bounded sample and places
    ``top_leaves`` shards at most. Where that leaves shards far over
    ``shard_points``, each of these draws its own sample and is dealt on, by
    trees that the executors grow: ``top_leaves`` squared shards in all, which
    is enough for some billions of distinct fingerprints.
    """
    prepare(distinct.sparkSession)
    n = distinct.count()
    points = distinct.select(F.lit(0).cast("long").alias("shard"), "fp")
    wanted = max(1, 2 * n // shard_points)
    leaves = min(top_leaves, wanted)
    if leaves > 1:
        sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_PER_LEAF * leaves).collect()
        points = _deal(points, {0: top_tree(np.array([r[0] for r in sample], np.int64).view(np.uint64), leaves, bits)}, bits)
    if wanted > top_leaves:
        points = materialize(points, "simhash-shards")
        # A tree for each large shard, of which there are top_leaves at most, from as many points as its leaves need.
        large = points.groupBy("shard").count().filter(F.col("count") > 4 * shard_points)
        large = large.select("shard", F.least(F.lit(top_leaves), F.floor(2 * F.col("count") / shard_points)).cast("long").alias("leaves"))
        few = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < (1 << 20) * min(1.0, 4 * SAMPLE_PER_LEAF / shard_points)
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("fp")))
        drawn = points.filter(few).join(F.broadcast(large), "shard").withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_PER_LEAF * F.col("leaves"))

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            tree = top_tree(group["fp"].to_numpy(np.int64).view(np.uint64), int(group["leaves"].iloc[0]), bits)
            return pd.DataFrame({"shard": group["shard"].iloc[:1], "tree": [np.array(tree, NODE).tobytes()]})

        grown = drawn.groupBy("shard").applyInPandas(grow, "shard long, tree binary")
        points = _deal(points, {r["shard"]: np.frombuffer(bytes(r["tree"]), NODE).tolist() for r in grown.toLocalIterator()}, bits)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        a, b = links(fp.view(np.uint64), bits)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return points.groupBy("shard").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = 3, bits: int = 3, **sizes: int) -> DataFrame:
    """Per document: doc_id, fp, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Fingerprints link at ``bits`` or fewer differing bits, whatever doc_ids they
    have: a null doc_id has its component from the others, null where all are.
    Null and empty texts have fingerprint 0. An empty table gives no rows;
    repeated doc_ids and rows give a row each. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words=words), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    parts = materialize(components(near_links(distinct, bits=bits, **sizes)), "simhash-parts")
    # Few fingerprints have a component beyond their own copies; all others keep their least doc_id.
    linked = parts.withColumnRenamed("node", "fp").join(distinct, "fp")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    owner = distinct.join(linked.select("fp", "component").join(least, "component").select("fp", "component", "least"), "fp", "left")
    owner = owner.select("fp", F.when(F.col("component").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    return prints.join(owner, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
