"""URL verdicts by rules, then a blocked Bloom filter and an exact hash join.

A listed URL is canonical: lower-cased host without port, user or "www.", then
the path without a final slash; an entry ``host/`` lists a whole host with its
subdomains. A page's candidates are its own canonical URL and ``suffix/`` of
each suffix of its host. Candidates that the filter lets pass are joined with
the list itself, which takes out what passed by chance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Rules as (host, path, verdict); fixed values of the query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Listed hosts of the query: each family in each domain. Fixed values, a stand-in for a published list.
FAMILIES, DOMAINS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("example.com", "example.net", "example.org")
LISTED = tuple(f"{family}.{domain}/" for family in FAMILIES for domain in DOMAINS)
#: Further entries of the query's list by rule, as many hosts as single URLs, so that the filter is as full as a real list's.
NUMBERED = 50_000

BLOCK_WORDS = 8  # 64-bit words of a block, one cache line
PROBES = 8  # bits set by a key, one in each word
MAX_FILTER_BYTES = 64 << 20

U64 = np.uint64
_SALT = np.random.default_rng(17).integers(0, 2**63, PROBES, dtype=np.uint64) * U64(2) + U64(1)


class BlockedBloom:
    """Every key sets one bit in each word of one block. ``h`` are 64-bit hashes."""

    def __init__(self, blocks: int, of: int | None = None):
        self.words, self.of = np.zeros((max(1, blocks), BLOCK_WORDS), np.uint64), of or max(1, blocks)

    @staticmethod
    def for_keys(n: int, bits_per_key: int = 12, limit: int = MAX_FILTER_BYTES) -> BlockedBloom:
        """Sized for n keys, but never beyond ``limit`` bytes: a fuller filter passes more, the join stays exact."""
        return BlockedBloom(min(-(-n * bits_per_key // 512), limit // 64) or 1)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.int64).view(np.uint64)
        block = ((h >> U64(32)) * U64(self.of) >> U64(32)).astype(np.int64)
        bits = U64(1) << ((h[:, None] * _SALT) >> U64(58))
        return block, bits

    def add(self, h: np.ndarray, first: int = 0) -> None:
        """Add keys. ``first`` is the number of this filter's first block where it is a part of a larger one."""
        block, bits = self._places(h)
        for j in range(BLOCK_WORDS):
            np.bitwise_or.at(self.words[:, j], block - first, bits[:, j])

    def may_have(self, h: np.ndarray) -> np.ndarray:
        block, bits = self._places(h)
        return ((self.words[block] & bits) == bits).all(1)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.+$", ""), r"^www\.", "")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def listed_table(spark: SparkSession, entries: Sequence[str], numbered: int = 0) -> DataFrame:
    """A list as a table: the entries, and as many numbered hosts and numbered URLs as said."""
    made = spark.createDataFrame([(e,) for e in dict.fromkeys(entries)], "listed string")
    name = F.format_string("listed-%06d.example.org/", "id")
    rows = spark.range(numbered).select(F.explode(F.array(name, F.format_string("pages.example.org/en/%06d", "id"))).alias("listed"))
    return made.unionByName(rows) if numbered else made


def _filter_of(keys: DataFrame, n: int) -> BlockedBloom:
    """The filter of ``keys(listed)``, made on the executors: each part of the blocks by one task, which keeps no others."""
    bloom = BlockedBloom.for_keys(n)
    blocks, parts = bloom.of, min(64, bloom.of)
    h = keys.select(F.xxhash64("listed").alias("h"))
    # The block of a key, as in BlockedBloom, says which part it is in.
    part = F.floor(F.shiftright(F.shiftrightunsigned("h", 32) * blocks, 32) * parts / blocks).cast("int")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, BlockedBloom] = {}
        for batch in batches:
            which, keys_ = batch.column("part").to_numpy(), batch.column("h").to_numpy()
            for p in np.unique(which).tolist():
                first, end = -(-p * blocks // parts), -(-(p + 1) * blocks // parts)
                made.setdefault(p, BlockedBloom(end - first, blocks)).add(keys_[which == p], first)
        if made:
            yield pa.record_batch([pa.array(list(made), pa.int32()), pa.array([b.words.tobytes() for b in made.values()], pa.binary())], names=["part", "words"])

    for r in h.withColumn("part", part).repartition(parts, "part").mapInArrow(build, "part int, words binary").toLocalIterator():
        first = -(-r["part"] * blocks // parts)
        words = np.frombuffer(bytes(r["words"]), np.uint64).reshape(-1, BLOCK_WORDS)
        bloom.words[first : first + len(words)] = words
    return bloom


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, listed (the longest entry that blocks it, if the method did).

    A page whose url is null or has no :// has an empty host and path, no rule
    and verdict allow. Repeated page_ids and rows give a row each, an empty table
    none; other columns are ignored, whatever their names. An empty list blocks
    nothing beyond the rules; null entries don't count. The filter is made on
    the executors and bounded in size whatever the list's. What it lets pass is
    written once; the distinct strings of that meet the list.
    """
    spark = prepare(pages.sparkSession)
    keys = listed.filter("listed is not null").select("listed").distinct()
    shared = spark.sparkContext.broadcast(_filter_of(keys, keys.count()))

    url = F.col("url")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", rule).withColumn("ruled", ruled)
    bare = canonical_host(F.col("host"))
    labels = F.split(bare, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    own = F.concat(bare, F.regexp_replace(F.col("path"), r"/+$", ""))
    candidates = F.when((F.col("host") != "") & F.col("ruled").isNull(), F.array_distinct(F.concat(F.array(own), suffixes))).otherwise(F.array().cast("array<string>"))
    base = base.withColumn("candidates", candidates).withColumn("hashes", F.transform("candidates", lambda c: F.xxhash64(c)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            sizes = np.array([len(x) for x in hashes.to_pylist()], np.int64)
            passed = shared.value.may_have(hashes.flatten().to_numpy()) if sizes.sum() else np.zeros(0, bool)
            at = np.concatenate([[0], np.cumsum(sizes)])
            hits = [[c for c, ok in zip(row, passed[a:b]) if ok] for row, a, b in zip(batch.column("candidates").to_pylist(), at[:-1], at[1:])]
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule", "ruled")]
            yield pa.record_batch([*cols, pa.array(hits, pa.list_(pa.string()))], names=["page_id", "host", "path", "rule", "ruled", "hits"])

    page_type = pages.schema["page_id"].dataType.simpleString()
    probed = base.mapInArrow(probe, f"page_id {page_type}, host string, path string, rule string, ruled string, hits array<string>")
    probed = materialize(probed.withColumn("row", F.monotonically_increasing_id()), "urls")
    # The distinct strings that passed, not their pages, meet the list; the pages then meet what is really on it.
    some = probed.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit"))
    real = keys.withColumnRenamed("listed", "hit").join(some.select("hit").distinct(), "hit", "left_semi")
    blocked = some.join(real, "hit").groupBy("row").agg(F.max_by("hit", F.length("hit")).alias("listed"))
    judged = probed.join(blocked, "row", "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed").isNotNull(), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
