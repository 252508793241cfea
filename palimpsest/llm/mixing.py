"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks of
about ``block`` units of text. The i-th block of a source of weight w (a share
of 1) is released at slot floor((i - 1) / w) and due by ceil(i / w); at every
slot the released block due first goes next (ties by heavier weight, then name).
With shares that sum to 1 every block meets its deadline, so at any slot t each
source has been given w * t blocks within less than one. When a source has no
more blocks, the shares of the others are scaled up to sum to 1 again and their
releases start from that slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, prepare

#: Blocks in a whole schedule, at most: blocks grow with the corpus so that the schedule stays a small table.
MAX_BLOCKS = 200_000
#: Code points in one block, at least.
MIN_BLOCK = 1 << 16
#: Rows of a source that one running sum covers, and chunks of these that one sum over them covers.
CHUNK_ROWS = 1024
#: Columns that a mix adds, in order.
COLUMNS = ("mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_lag", "mix_rank")


def pfair(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int, int, int, int, float]]:
    """(source, i from 0, slot, release, deadline, lag) of every block, in slot order.

    ``lag`` is what its source has been given since the last change of shares,
    this block included, less its share of the slots since then: within one block.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: list[tuple[str, int, int, int, int, float]] = []
    slot = 0
    while left:
        # Exact shares of the sources that still have blocks; this epoch ends when one runs out.
        total = sum(Fraction(weights[s]).limit_denominator(10**6) for s in left)
        share = {s: Fraction(weights[s]).limit_denominator(10**6) / total for s in left}
        start, issued = slot, dict.fromkeys(left, 0)
        ready: list[tuple] = []
        future: list[tuple] = []

        def plan(s: str) -> None:
            i, w = issued[s], share[s]
            release, due = start + (i * w.denominator) // w.numerator, start - (-(i + 1) * w.denominator // w.numerator)
            heapq.heappush(future, (release, due, -w, s))

        for s in left:
            plan(s)
        over = False
        while not over:
            while future and future[0][0] <= slot:
                release, due, w, s = heapq.heappop(future)
                heapq.heappush(ready, (due, w, s, release))
            due, _, s, release = heapq.heappop(ready)
            issued[s] += 1
            out.append((s, done[s], slot, release, due, float(issued[s] - share[s] * (slot + 1 - start))))
            done[s] += 1
            left[s] -= 1
            slot += 1
            if left[s]:
                plan(s)
            else:
                del left[s]
                over = True
    return out


def mix(docs: DataFrame, *, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, block: int | None = None, max_blocks: int = MAX_BLOCKS, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` and mix_source, mix_block, mix_slot, mix_release, mix_deadline, mix_lag, mix_rank (columns
    of ``docs`` with one of these names are replaced).

    Every row stays: the schedule decides the order (by mix_slot, then
    mix_rank). ``weights`` are relative; sources that it doesn't name have
    ``default_weight``. A null source is a source of its own, named ''. Text
    lengths count in code points plus 1, so null and empty texts count as 1. A
    document longer than a block starts in one and takes the slots of all that
    it covers, in which no other of its source starts. Documents are not cut:
    while no source has ended, a source's text after slot t is its share of t
    blocks within less than one block and its longest document (or run of rows
    of equal doc_id and text, which are ordered beside each other). mix_lag is
    the deviation from the share after the slot, in blocks. An empty table gives
    no rows and the same columns.

    The running sums are taken in chunks of a source's hash order, then over
    groups of chunks, then over these, so a source with a third of all rows is
    many tasks' work. The driver schedules from counts: a row for each source,
    at most ``max_blocks`` plus a block for each source, or, where ``block`` is
    given, as many as the text has.
    """
    spark = prepare(docs.sparkSession)
    source, size = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.char_length("text"), F.lit(0)) + 1
    rank = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    # Sizes and ranks alone first: sums of a few numbers a row, not of texts.
    slim = materialize(docs.select(source.alias("mix_source"), rank.alias("mix_rank"), size.alias("size")), "mix")
    rows = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
    unit = block or max(MIN_BLOCK, -(-int(rows["s"]) // max_blocks))
    n_chunks = max(1, -(-int(rows["n"]) // CHUNK_ROWS))
    chunk = F.floor((F.col("mix_rank").cast("double") / float(1 << 64) + 0.5) * n_chunks)
    slim = slim.withColumn("chunk", F.least(chunk, F.lit(n_chunks - 1)).cast("long"))
    sums = slim.groupBy("mix_source", "chunk").agg(F.sum("size").alias("s")).withColumn("group", F.floor(F.col("chunk") / CHUNK_ROWS))
    before = lambda *keys: Window.partitionBy("mix_source", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda *keys, of="s": F.coalesce(F.sum(of).over(before(*keys)), F.lit(0))
    groups = sums.groupBy("mix_source", "group").agg(F.sum("s").alias("s")).select("mix_source", "group", running("group").alias("far"))
    bases = sums.select("mix_source", "group", "chunk", running("group", "chunk").alias("near")).join(groups, ["mix_source", "group"])
    bases = bases.select("mix_source", "chunk", (F.col("far") + F.col("near")).alias("base"))
    placed = slim.withColumn("within", running("chunk", "mix_rank", of="size")).join(bases, ["mix_source", "chunk"])
    # Equal ranks (equal rows) count once: one place for all of them.
    placed = placed.groupBy("mix_source", "mix_rank").agg(F.min(F.col("base") + F.col("within")).alias("at"))
    placed = materialize(placed.select("mix_source", "mix_rank", F.floor(F.col("at") / unit).cast("long").alias("raw")), "mix-placed")
    used = placed.select("mix_source", "raw").distinct()
    # Long documents leave raw numbers in which nothing starts. These take slots like others; mix_block numbers the used ones.
    dense = used.withColumn("mix_block", (F.row_number().over(Window.partitionBy("mix_source").orderBy("raw")) - 1).cast("long"))
    counts = {r["mix_source"]: -(-int(r["s"]) // unit) for r in sums.groupBy("mix_source").agg(F.sum("s").alias("s")).collect()}
    given = {s: float((weights or {}).get(s, default_weight)) for s in counts}
    if min(given.values(), default=1) <= 0:
        raise ValueError("weights must be above 0")
    slots = spark.createDataFrame(pfair(counts, given), "mix_source string, raw long, mix_slot long, mix_release long, mix_deadline long, mix_lag double")
    # At most max_blocks rows and one for each source, unless ``block`` says otherwise.
    plan = dense.join(F.broadcast(slots) if sum(counts.values()) <= max_blocks + len(counts) else slots, ["mix_source", "raw"])
    where = placed.join(plan, ["mix_source", "raw"]).select("mix_rank", "mix_source", *COLUMNS[1:-1])
    own = [c for c in docs.columns if c.lower() not in COLUMNS]
    keyed = docs.select(*[F.col(f"`{c}`") for c in own], source.alias("mix_source"), rank.alias("mix_rank"))
    return keyed.join(where, ["mix_source", "mix_rank"]).select(*[F.col(f"`{c}`") for c in own], *COLUMNS)


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs``, whatever their names, written in the order of the mix: sorted by slot over partitions."""
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mixed"), "doc_id", "text", "source")
    found = mix(given, **options)
    return found.orderBy("mix_slot", "mix_rank", "doc_id").select("mixed.*")
