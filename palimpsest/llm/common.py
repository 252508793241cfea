"""Helpers shared by the corpus operators: session settings, bounded slices
of Arrow batches, and vectorised word views over UTF-8 bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch between the JVM and Python; texts may be very long.
ROWS_PER_BATCH = 512
#: Bytes of text that one vectorised pass looks at, but for longer single texts.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: small Arrow batches and a checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset and
    the master is local, as in tests, is a folder under /tmp used.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    # Workers find this package where the driver did, if it wasn't shipped to them.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, as a URI or path. Without a setting there is one only where all is on one machine."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts lineage
    and lets several consumers read it without computing it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named text column has about ``limit`` bytes in each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and where each begins (one entry more). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of a-z, digits and all that is not ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

_MIX = U64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240501)
#: Random odd weights: of the bytes of a word by place, of bytes.
PLACE = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * U64(2) + U64(1)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(maxsize=64)
def gram_weights(n: int) -> np.ndarray:
    """A random odd weight for each word of a gram of n words."""
    return np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(29))) * _MIX
    return h ^ (h >> U64(32))


class Words:
    """The words of a slice of texts, as arrays over all texts together.

    ``starts``/``ends`` are byte places in ``low`` (lower-cased bytes), ``doc``
    the text of each word, ``first`` the index of each text's first word (one
    entry more than texts).
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = WORD_BYTES):
        self.low = LOWER[raw]
        inside = word_bytes[self.low]
        n = len(raw)
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < n]
        before[cuts] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.n_words)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        chars = self.low[self.inside]
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(chars)) - np.repeat(at, lengths)
        sums = np.add.reduceat(BYTE[chars] * PLACE[place & 4095], at)
        return mixed(sums + lengths.astype(np.uint64) * _MIX)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, for starts 0 .. len - n."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j, weight in enumerate(gram_weights(n)):
        h += words[j : j + m] * weight
    return mixed(h + U64(n))
