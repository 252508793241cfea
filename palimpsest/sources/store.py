"""Where overlays put what they write: parquet in a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import OverlayError


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all is on one machine, as in tests, a folder under /tmp."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise OverlayError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file by Spark's own file systems; it replaces what is there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


class Store:
    """Writes frames once, counts their rows on the way and reads them back without lineage."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/overlay-{uuid.uuid4().hex}").rstrip("/")
        # A folder that can't be written fails now, not at the first write.
        try:
            write_text(spark, f"{self.root}/.writable", "")
        except Exception as e:
            raise OverlayError(f"the overlay folder {self.root} can't be written: {e}") from e

    def write(self, df: DataFrame, name: str, **counts) -> tuple[DataFrame, str, dict[str, int]]:
        """(frame read back, path, counts). ``counts`` are aggregate columns observed during the write."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
        got = {k: int(v or 0) for k, v in seen.get.items()}
        return self.spark.read.schema(df.schema).parquet(path), path, got
