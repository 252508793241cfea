"""The query log and its metrics."""

from __future__ import annotations

import time
from collections import deque
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .plans.classify import Classification

#: Entries that are held in the driver; more are written to the log's folder as JSON lines.
ENTRIES = 10_000
SCHEMA = "ts timestamp, connection long, sql string, op string, sub string, tables array<string>, strategy string, duration_ms double, error string"


class QueryLog:
    """All statements, in order: the newest here, older ones in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.entries: deque[tuple] = deque()
        self.written = False

    def add(self, session: Any, sql: str, c: Classification | None, strategy: Any, ms: float, error: str) -> None:
        import datetime

        self.entries.append((
            datetime.datetime.fromtimestamp(time.time()), id(session), sql, c.op.value if c else None, c.sub.value if c else None, list(c.tables) if c else [], strategy.value if strategy else None, ms, error or None,
        ))
        if len(self.entries) >= ENTRIES and self.folder:
            self.flush()

    def flush(self) -> None:
        """Write what is held as JSON lines."""
        if self.entries and self.folder:
            held = list(self.entries)
            self.spark.createDataFrame(held, SCHEMA).coalesce(1).write.mode("append").json(self.folder)
            self.written = True
            for _ in held:
                self.entries.popleft()

    def frame(self) -> DataFrame:
        held = self.spark.createDataFrame(list(self.entries), SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.folder).unionByName(held) if self.written else held

    def metrics(self, seconds: int = 120) -> DataFrame:
        """Latency percentiles and queries a second, for each second of the last ones."""
        return percentiles(self.frame().filter(F.col("ts") >= F.current_timestamp() - F.expr(f"INTERVAL {int(seconds)} SECONDS")), "ts", "duration_ms", "1 second")


def percentiles(df: DataFrame, ts: str, value: str, width: str) -> DataFrame:
    """p50, p95 and p99 by linear interpolation and the number of rows, by window of time."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = df.groupBy(F.window(ts, width).alias("w")).agg(p.alias("p"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("bucket"), *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "n")
