"""Exact deduplication by Patricia tries that own each distinct byte string.

Every text is a key of bytes. Each input partition first inserts its texts into
a trie of its own, so copies meet before any shuffle: a terminal node stores the
smallest identifier of its copies. Tries are bounded: what they hold over the
bound leaves them as whole subtrees, written out with what their terminals know
(a text that comes again is a new owner, which meets the old one later). The
owners' texts are then dealt by length and content hash and inserted, in order
of their bytes, into the final tries of these partitions, whose terminals take
the smallest identifier of all. Texts come in order (the JVM's sort spills), so
subtrees left of the current path are complete and are written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parallelism, prepare, slices

#: Bytes of key, and nodes, that a trie holds before subtrees leave it; a node counts as this many bytes.
TRIE_BYTES, NODE_BYTES = 32 << 20, 500


class Node:
    __slots__ = ("edge", "children", "value")

    def __init__(self, edge: bytes, value: Any = None):
        self.edge, self.value = edge, value
        self.children: dict[int, Node] = {}


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        if a[low : mid + 1] == b[low : mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


class Trie:
    """A compressed radix trie over bytes; ``insert`` merges values of equal keys by a function."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, key: bytes, value: Any, merge=None) -> Any:
        """The value that the key's terminal node holds afterwards: the old one, merged with the new one by ``merge``."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value if node.value is None else merge(node.value, value) if merge else node.value
                return node.value
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], value)
                self.bytes += len(key) - at + NODE_BYTES
                return value
            if key.startswith(child.edge, at):
                n = len(child.edge)
            else:
                n = _common(child.edge, key[at:])
                middle = Node(child.edge[:n])
                middle.children[child.edge[n]] = child
                child.edge = child.edge[n:]
                node.children[key[at]] = middle
                child = middle
                self.bytes += NODE_BYTES
            node, at = child, at + n

    def get(self, key: bytes) -> Any:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None or not key.startswith(child.edge, at):
                return None
            node, at = child, at + len(child.edge)
        return node.value

    def spill_before(self, key: bytes) -> Iterator[Any]:
        """Take out the subtrees before ``key`` in key order, which no later key can reach, and what their terminals hold.
        Terminals on the path to ``key`` stay."""
        node, at = self.root, 0
        while at < len(key):
            for c in sorted(c for c in node.children if c < key[at]):
                yield from self._take(node, c, b"")
            child = node.children.get(key[at])
            if child is None or not key.startswith(child.edge, at):
                return
            node, at = child, at + len(child.edge)

    def spill(self, limit: int) -> Iterator[tuple[bytes, Any]]:
        """Take out subtrees, the first in key order first, until at most ``limit`` bytes are held: (key, value) of each terminal."""
        while self.bytes > limit and self.root.children:
            # The deepest node on the leftmost path that has several children loses its first: small subtrees go one by one.
            node, above, path = self.root, [], b""
            while node.children:
                c = min(node.children)
                above.append((node, c, path))
                path, node = path + node.children[c].edge, node.children[c]
            several = [x for x in above if len(x[0].children) > 1] or above[:1]
            node, c, path = several[len(several) // 2]
            yield from ((path + k, v) for k, v in self._take(node, c, None))

    def rest(self) -> Iterator[tuple[bytes, Any]]:
        """Take out everything, the empty key's value too."""
        if self.root.value is not None:
            yield b"", self.root.value
            self.root.value = None
        for c in sorted(self.root.children):
            yield from self._take(self.root, c, None)

    def _take(self, node: Node, c: int, path: bytes | None) -> Iterator[Any]:
        """Cut a child off: the values of its terminals, or (key below ``node``, value) where ``path`` is None."""
        child = node.children.pop(c)
        stack = [(child, child.edge if path is None else b"")]
        while stack:
            n, key = stack.pop()
            self.bytes -= len(n.edge) + NODE_BYTES
            if n.value is not None:
                yield n.value if path is not None else (key, n.value)
            for k in sorted(n.children, reverse=True):
                below = n.children[k]
                stack.append((below, key + below.edge if path is None else b""))


def exact_duplicates(docs: DataFrame, *, trie_bytes: int = TRIE_BYTES, keep: str = "largest") -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest (or ``keep="smallest"``) doc_id stays; if that doc_id
    repeats, each such row is kept. Null doc_ids lose against all others and stay
    if all are null. doc_ids are whole numbers. An empty table gives no rows;
    other columns are ignored. A text is written once and shuffled once, one copy
    for each input partition (and spill) at most, however many copies there are.
    """
    spark = prepare(docs.sparkSession)
    sign = -1 if keep == "largest" else 1

    def least(a: list, b: list) -> list:
        """[owner, smallest identifier, rows] of two runs of copies; the identifier is the doc_id with the sign."""
        a[1] = b[1] if a[1] is None else a[1] if b[1] is None else min(a[1], b[1])
        a[2] += b[2]
        return a

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, number, part = Trie(), 0, TaskContext.get().partitionId() << 40

        def owners(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for text, (owner, best, rows) in found:
                held.append((None, owner, best, rows, len(text), text, hashlib.sha256(text).hexdigest()))
                size += len(text) + 100
                if size > 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in slices(batches, "text", 4 << 20):
            seen = []
            ids = batch.column("doc_id").to_pylist()
            for d, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist()):
                number += 1
                seen.append(trie.insert(text or b"", [part + number, None if d is None else sign * d, 1], least)[0])
            n = len(ids)
            empty = [pa.nulls(n, t) for t in types[2:]]
            if n:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(seen, pa.int64()), *empty], names=names)
            if trie.bytes > trie_bytes:
                yield from owners(trie.spill(trie_bytes // 2))
        yield from owners(trie.rest())

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = ["doc_id", "owner", "best", "n", "size", "body", "sha"]
    # Two kinds of rows: (doc_id, owner) of each document, and what is known of each owner.
    schema = "doc_id long, owner long, best long, n long, size long, body binary, sha string"
    staged = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, schema), "exact")
    known = staged.filter("body is not null").select("owner", "best", "n", "size", F.xxhash64("body").alias("h"), "body", "sha")
    dealt = known.repartition(parallelism(spark), "size", "h").sortWithinPartitions("body", "owner").drop("size", "h")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()

        def classes(found: Iterator[list]) -> pa.RecordBatch:
            rows = list(found)
            columns = [pa.nulls(len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())]
            return pa.record_batch(columns, names=["owner", "class", "best", "n", "sha"])

        for batch in slices(batches, "body", 4 << 20):
            members, text = [], b""
            owners = batch.column("owner").to_pylist()
            for owner, best, n, text, sha in zip(owners, *(batch.column(c).to_pylist() for c in ("best", "n", "body", "sha"))):
                members.append(trie.insert(text, [owner, best, n, sha], least)[0])
            k = len(owners)
            yield pa.record_batch([pa.array(owners, pa.int64()), pa.array(members, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names=["owner", "class", "best", "n", "sha"])
            if trie.bytes > trie_bytes:
                yield classes(trie.spill_before(text))
        yield classes(v for _, v in trie.rest())

    # From here on rows are small: no text. A class is named by its first owner.
    found = materialize(dealt.mapInArrow(final, "owner long, class long, best long, n long, sha string"), "exact-classes")
    whole = found.filter("owner is null").select("class", (F.col("best") * sign).alias("keep_id"), F.col("n").alias("group_size"), "sha")
    resolved = found.filter("owner is not null").select("owner", "class").join(whole, "class").drop("class")
    told = staged.filter("body is null").select("doc_id", "owner").join(resolved, "owner")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return told.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
