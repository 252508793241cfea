"""Token ids in Arrow stream files of equal-length sequences with masks.

Layout of one shard ``N.arrows`` (Arrow IPC stream format): record
batches of ``batch_rows`` rows (the last may have fewer) with two columns,
``ids: fixed_size_list<uint16|uint32>[L]`` and ``mask: fixed_size_list<bool>[L]``
(true: a token, false: padding). The ids of a shard are the ids of its
documents one after the other, each ended by ``end_id``; only the last
sequence of a shard is padded. The sidecar ``N.docs.arrows`` has
``doc_id, at, n_tokens`` of the shard's documents in stored order. Both are
memory-mapped and sliced without copying.

Shards are ranges of the sort key or parts of these, so shard after shard in
order of their numbers is the whole corpus in order; a document's global ``start`` is the ids of earlier shards plus ``at``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, fresh_path, parallelism, prepare, slices, text_bytes

#: Slots of a worker's table of pieces, and ids and bytes of pieces that it keeps before it starts again.
SLOTS, KEPT_IDS, KEPT_BYTES = 1 << 21, 1 << 23, 1 << 25
#: Bytes of a piece that its hash tells apart by place; texts with longer pieces go through the library whole.
LONG_PIECE = 4096
#: Ranges of the sort key, at most, and numbers of shards that each has for itself.
MAX_RANGES, SHARDS_PER_RANGE = 4096, 1 << 32

#: ASCII letters (small) and digits, and ASCII punctuation but the apostrophe.
_ALNUM, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_PUNCT[39] = False


_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


class WordEncoder:
    """Encodes whole texts with the word-level tokenizers file, piece by piece.

    That tokenizer ignores case and white space, and no match of its splitting
    pattern goes on from a letter or digit to punctuation other than an
    apostrophe. So a text's ids are those of its pieces between these places,
    one after the other. A distinct piece goes through the library once and is
    then found by its hash in a table of fixed size (two places for each hash),
    whose own bytes must equal the piece's; all pieces of a slice are looked up
    together. Texts that hold ``<|``, where special tokens depend on case, or
    very long pieces go through the library whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = np.array([end_id], self.dtype).tobytes()
        self.hashes, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.ids, self.used = np.zeros(KEPT_IDS, self.dtype), 0
        #: The pieces themselves, and where in them each slot's begins and ends.
        self.bytes, self.filled = np.zeros(KEPT_BYTES, np.uint8), 0
        self.begin, self.end_of = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece's begin and how many they are."""
        texts = [p.decode() for p in pieces]
        at, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        flat: list[np.ndarray] = []
        used = 0
        plain = np.array([t.isalpha() for t in texts], bool)
        other = np.flatnonzero(~plain).tolist()
        # Pieces of letters alone are one match each: many go through the library as one text.
        rows = np.flatnonzero(plain)
        for begin in range(0, len(rows), 1024):
            some = rows[begin : begin + 1024]
            e = self.tokenizer.encode(" ".join([texts[i] for i in some.tolist()]), add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            if len(sizes) != len(some):  # a letter that lower-cases to something else
                other += some.tolist()
                continue
            at[some], size[some] = used + np.cumsum(sizes) - sizes, sizes
            flat.append(np.array(e.ids, self.dtype))
            used += len(flat[-1])
        for begin in range(0, len(other), 4096):
            some = other[begin : begin + 4096]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            sizes = np.array([len(f) for f in found], np.int64)
            at[some], size[some] = used + np.cumsum(sizes) - sizes, sizes
            flat.append(np.array([x for f in found for x in f], self.dtype))
            used += len(flat[-1])
        return np.concatenate(flat), at, size

    def _find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` the ids of each piece begin, and how many there are."""
        h = words.hashes()
        h[h == 0] = 1
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        unsure = np.flatnonzero(self.hashes[slot] != h)
        second = (h[unsure] >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        slot[unsure] = second
        known = self.hashes[slot] == h
        known[np.flatnonzero(known)[self._differ(words, np.flatnonzero(known), slot)]] = False
        missing = np.flatnonzero(~known)
        at, size = self.at[slot], self.size[slot]
        if len(missing):
            low = words.low.tobytes()
            texts = [low[a:b] for a, b in zip(words.starts[missing].tolist(), words.ends[missing].tolist())]
            fresh: dict[bytes, int] = {}
            which = np.array([fresh.setdefault(x, len(fresh)) for x in texts], np.int64)
            first = np.unique(which, return_index=True)[1]
            ids, places, sizes = self._library(list(fresh))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(ids), self.dtype)])
            places = places + self.used
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            at[missing], size[missing] = places[which], sizes[which]
            flat = np.frombuffer(b"".join(fresh), np.uint8)
            lengths = np.array([len(x) for x in fresh], np.int64)
            begin = np.cumsum(lengths) - lengths + self.filled
            if self.filled + len(flat) > len(self.bytes):
                self.bytes = np.concatenate([self.bytes, np.zeros(len(flat), np.uint8)])
            self.bytes[self.filled : self.filled + len(flat)] = flat
            self.filled += len(flat)
            hashes = h[missing[first]]
            one, two = (hashes & np.uint64(SLOTS - 1)).astype(np.int64), (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
            put = np.where(self.hashes[one] == 0, one, two)
            own = len(put) - 1 - np.unique(put[::-1], return_index=True)[1]  # one of several new pieces in a place
            for table, values in ((self.hashes, hashes), (self.at, places), (self.size, sizes), (self.begin, begin), (self.end_of, begin + lengths)):
                table[put[own]] = values[own]
        return at, size

    def _differ(self, words: Words, which: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Those of the words ``which`` whose bytes are not the ones that their slots hold, as places in ``which``."""
        if not len(which):
            return which
        length, begin = (words.ends - words.starts)[which], self.begin[slot[which]]
        differ = self.end_of[slot[which]] - begin != length
        step = np.where(differ, 0, length)
        ends = np.cumsum(step)
        nth = np.arange(int(ends[-1])) - np.repeat(ends - step, step)
        wrong = words.low[np.repeat(words.starts[which], step) + nth] != self.bytes[np.repeat(begin, step) + nth]
        if wrong.any():
            differ[np.searchsorted(ends, np.flatnonzero(wrong), side="right")] = True
        return np.flatnonzero(differ)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a slice, ended by the end id."""
        if self.used > KEPT_IDS // 4 * 3 or self.filled > KEPT_BYTES // 4 * 3:
            self.hashes[:], self.used, self.filled = 0, 0, 0
            self.ids, self.bytes = self.ids[:KEPT_IDS], self.bytes[:KEPT_BYTES]
        low = LOWER[raw]
        edges = np.flatnonzero(_ALNUM[low[:-1]] & _PUNCT[low[1:]]) + 1
        words = Words(np.insert(low, edges, 32), offsets + np.searchsorted(edges, offsets, side="left"), _NOT_SPACE)
        at, size = self._find(words)
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[words.first].tolist()
        out = [flat[a:b].tobytes() + self.end for a, b in zip(cuts, cuts[1:])]
        long = set(words.doc[words.ends - words.starts > LONG_PIECE].tolist())
        if long or (len(raw) > 1 and ((raw[:-1] == 60) & (raw[1:] == 124)).any()):  # <|
            whole = raw.tobytes()
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                if i in long or whole.find(b"<|", a, b) >= 0:
                    out[i] = np.array(self.tokenizer.encode(whole[a:b].decode(), add_special_tokens=False).ids, self.dtype).tobytes() + self.end
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> WordEncoder:
    """One encoder for each worker process, so that what it has learned outlives a task."""
    return WordEncoder(path, end_id)


def counter(path: str):
    """A function from texts to their numbers of tokens, for the workers."""

    def count(texts: list[str]) -> list[int]:
        encoder = encoder_of(path, 0)
        ids = encoder.encode(*text_bytes(pa.array(texts, pa.string())))
        return [len(x) // encoder.ids.itemsize - 1 for x in ids]

    return count


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes one shard; holds at most one record batch of ids."""

    def __init__(self, root: str, shard: int, dtype: Any, length: int, batch_rows: int):
        self.fs, base = _filesystem(root)
        self.fs.create_dir(base, recursive=True)
        # Attempts write apart and are renamed when whole, so a lost executor leaves no torn shard.
        self.final = f"{base}/{shard:08d}"
        self.part = f"{base}/_part-{shard:08d}-{os.getpid()}-{os.urandom(4).hex()}"
        self.length, self.batch_rows, self.dtype = length, batch_rows, np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.fs.open_output_stream(f"{self.part}.arrows")
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[bytes] = []
        self.held_ids = self.total = self.sequences = 0
        self.docs: tuple[list, list, list] = ([], [], [])

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        for column, value in zip(self.docs, (doc_id, self.total, n)):
            column.append(value)
        self.total += n
        self.held.append(ids)
        self.held_ids += n
        if self.held_ids >= self.length * self.batch_rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = self.length * self.batch_rows
        at = 0
        while len(ids) - at >= whole or (last and at < len(ids)):
            part = ids[at : at + whole]
            at += len(part)
            rows = -(-len(part) // self.length)
            mask = np.ones(rows * self.length, bool)
            if rows * self.length > len(part):
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(rows * self.length - len(part), self.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.out.write_batch(pa.record_batch(columns, schema=self.schema))
            self.sequences += rows
        rest = ids[at:].tobytes()
        self.held, self.held_ids = [rest], len(rest) // self.dtype.itemsize

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        table = pa.table(dict(zip(("doc_id", "at", "n_tokens"), (pa.array(c, pa.int64()) for c in self.docs))))
        with self.fs.open_output_stream(f"{self.part}.docs.arrows") as sink, pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        for end in (".docs.arrows", ".arrows"):
            self.fs.move(self.part + end, self.final + end)


class ShardReader:
    """Random access to one shard. Local files are memory-mapped: ``sequence``,
    ``mask`` and, where a range lies in one batch, ``ids`` are views."""

    def __init__(self, root: str, shard: int):
        fs, base = _filesystem(root)
        path = f"{base}/{shard:08d}"
        if isinstance(fs, pafs.LocalFileSystem):
            self.source = pa.memory_map(f"{path}.arrows")
            index = pa.memory_map(f"{path}.docs.arrows")
        else:
            self.source = pa.BufferReader(fs.open_input_file(f"{path}.arrows").read_buffer())
            index = pa.BufferReader(fs.open_input_file(f"{path}.docs.arrows").read_buffer())
        stream = pa.ipc.open_stream(self.source)
        self.length = stream.schema.field("ids").type.list_size
        self.batches = list(stream)
        self.docs = pa.ipc.open_stream(index).read_all()
        self.flat = [b.column("ids").flatten().to_numpy() for b in self.batches]  # views, no copies
        self.batch_rows = self.batches[0].num_rows if self.batches else 1
        self.n_sequences = sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        b, r = divmod(i, self.batch_rows)
        return self.flat[b][r * self.length : (r + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        b, r = divmod(i, self.batch_rows)
        return self.batches[b].column("mask").flatten().to_numpy(zero_copy_only=False)[r * self.length : (r + 1) * self.length]

    def ids(self, at: int, n: int) -> np.ndarray:
        size, parts = self.batch_rows * self.length, []
        while n > 0:
            b, o = divmod(at, size)
            part = self.flat[b][o : o + n]
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame,
    root: str,
    tokenizer_path: str,
    *,
    end_id: int = 1,
    length: int = 2048,
    batch_rows: int = 64,
    shard_bytes: int = 256 << 20,
    order: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` and write shards under ``root`` in ascending ``order``.

    Returns the manifest: shard, n_ids, n_sequences, n_docs; one row a shard.
    Null text is empty and gives the end id alone. Repeated doc_ids stay, beside
    each other, ties by their ids; rows with a null first order column come
    first. An empty table gives no shard. The first order column is a number.
    Tasks are ranges of it, at most ``MAX_RANGES``, from approximate quantiles
    that go to the workers as one array; a range is as many shards as its ids
    need, of about ``shard_bytes`` of text each. The row order inside comes from
    a sort in the JVM, which spills, and the writer holds one record batch, so no
    task's memory grows with the corpus. Only ids (not texts) are shuffled, once.
    """
    spark = prepare(docs.sparkSession)
    key = order[0]
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], "shard long, n_ids long, n_sequences long, n_docs long")
    ranges = int(max(1, min(size["n"], MAX_RANGES, max(-(-size["b"] // shard_bytes), 3 * parallelism(spark)))))
    probs = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.select(F.percentile_approx(key, probs, 10 * ranges).alias("q")).first()["q"] or [])) if probs else []
    limits = np.array(bounds)
    kept = [f"k{i}" for i in range(len(order))]
    ordered = docs.select(*[F.col(c).alias(k) for c, k in zip(order, kept)], "doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id)
        for batch in slices(batches, "text"):
            ids = pa.array(encoder.encode(*text_bytes(batch.column("text"))), pa.binary())
            given = batch.column("k0")
            # How many limits are below a key; null ones belong to the first range.
            rank = np.searchsorted(limits, pc.fill_null(given, 0).to_numpy(zero_copy_only=False), side="left") if len(limits) else np.zeros(len(given), np.int64)
            rank[given.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.record_batch([pa.array(rank, pa.int64()), *[batch.column(c) for c in (*kept, "doc_id")], ids], names=["range", *kept, "doc_id", "ids"])

    fields = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in (*zip(order, kept), ("doc_id", "doc_id")))
    coded = ordered.mapInArrow(encode, f"range long, {fields}, ids binary").repartition(ranges, "range").sortWithinPartitions("range", *kept, "ids")
    shard_ids = max(1, shard_bytes // 4)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder_of(tokenizer_path, end_id).dtype
        writer, current, shard = None, None, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.record_batch([pa.array([v], pa.int64()) for v in (shard, writer.total, writer.sequences, len(writer.docs[0]))], names=["shard", "n_ids", "n_sequences", "n_docs"])

        for batch in batches:
            for r, d, ids in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "ids"))):
                if r != current or writer.total >= shard_ids:
                    if writer:
                        yield closed()
                    shard = shard + 1 if r == current else r * SHARDS_PER_RANGE
                    writer, current = ShardWriter(root, shard, dtype, length, batch_rows), r
                writer.add(d, ids)
        if writer:
            yield closed()

    manifest = coded.mapInArrow(write, "shard long, n_ids long, n_sequences long, n_docs long")
    # One row a shard; the action writes the files.
    rows = manifest.collect()
    return spark.createDataFrame([tuple(r) for r in sorted(rows)], "shard long, n_ids long, n_sequences long, n_docs long")


def read_token_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32, shard, at, n_sequences read back from the shards."""
    rows = sorted(manifest.collect())
    starts, total = [], 0
    for r in rows:
        starts.append((r["shard"], total))
        total += r["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, at long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist()):
                reader = ShardReader(root, shard)
                for docs in reader.docs.to_batches(max_chunksize=4096):
                    at, n = (docs.column(c).to_numpy() for c in ("at", "n_tokens"))
                    crc = [zlib.crc32(reader.ids(int(a), int(k)).astype("<u4")) for a, k in zip(at, n)]
                    yield pa.record_batch(
                        [docs.column("doc_id"), pa.array(at + before), docs.column("n_tokens"), pa.array(crc, pa.int64()), pa.array(np.full(len(at), shard)), docs.column("at")],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "at"],
                    )

    return spark.createDataFrame(starts, "shard long, before long").repartition(min(len(starts), 4 * parallelism(spark)), "shard").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str, **options: Any) -> DataFrame:
    """Write the files to a fresh folder of the shared directory and read them back.

    Nulls, ties, repeated rows, empty tables and long texts are as in
    ``write_token_files``; columns other than doc_id, text and the order's are ignored.
    """
    spark = prepare(docs.sparkSession)
    root = fresh_path(spark, "tokens")
    return read_token_files(spark, root, write_token_files(docs, root, tokenizer_path, **options))
