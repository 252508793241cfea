"""Base tables: read-only sources by name, with the schema found once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotSupported, UnknownTable, WriteGuard
from ..state import ForeignKey, TableDiff, TableMeta, TableState

@dataclass(frozen=True)
class Base:
    """One read-only table: files of a format, a JDBC relation, or a frame."""

    name: str
    meta: TableMeta
    path: str | None = None
    format: str = "parquet"
    options: tuple[tuple[str, str], ...] = ()
    frame: DataFrame | None = None
    schema: T.StructType = field(default_factory=T.StructType)

    def read(self, spark: SparkSession, keys: bool = False) -> DataFrame:
        """The base rows; with ``keys``, also their overlay key columns."""
        if self.frame is not None:
            df = self.frame
        else:
            reader = spark.read.format(self.format).options(**dict(self.options))
            # Files are read by the schema found once; a database relation has its own.
            df = (reader if self.format == "jdbc" else reader.schema(self.schema)).load(self.path)
        if not keys:
            return df
        if self.meta.pk:
            return df.select("*", *[F.col(c).alias(f"__k{i}") for i, c in enumerate(self.meta.pk)])
        if self.path is None or self.format not in ("parquet",):
            raise NotSupported(f"{self.name} has no key and no stable row places; register it with pk or as parquet")
        return df.select("*", F.col("_metadata.file_path").alias("__k0"), F.col("_metadata.row_index").alias("__k1"))


def _moved(frame: DataFrame, spark: SparkSession) -> DataFrame:
    """The frame in the session where this catalog's views are."""
    if frame.sparkSession is spark:
        return frame
    plan = frame._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


class Catalog:
    """The base tables of an overlay. It hands out readers only; paths under a base root are never written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.bases: dict[str, Base] = {}
        self._single: dict[str, bool] = {}

    def one_file(self, name: str) -> bool:
        """Whether a base table is one file; found once."""
        base = self.base(name)
        if base.name not in self._single:
            self._single[base.name] = base.path is not None and base.frame is None and base.format == "parquet" and len(base.read(self.spark).inputFiles()) == 1
        return self._single[base.name]

    def register(
        self, name: str, path: str | None = None, *, frame: DataFrame | None = None, format: str = "parquet", pk: Sequence[str] = (), fks: Sequence[ForeignKey] = (),
        defaults: Mapping[str, str] | None = None, generated: Sequence[str] = (), auto_id: bool = False, schema: T.StructType | None = None, **options: str,
    ) -> TableState:
        """Add a table: ``path`` with any reader ``format`` and its ``options`` (parquet, orc, csv, json, jdbc, ...), or a ``frame``.

        ``pk`` names the key columns. A table without one is told apart by the
        place of its rows in parquet files. The schema is found once.
        """
        if frame is None and path is None and format != "jdbc":
            raise UnknownTable(f"{name}: neither a path nor a frame")
        if frame is not None:
            frame = _moved(frame, self.spark)
            schema = frame.schema
        elif schema is None:
            schema = self.spark.read.format(format).options(**options).load(path).schema
        missing = [c for c in pk if c not in schema.fieldNames()]
        if missing:
            raise UnknownTable(f"{name}: key columns {missing} are not in its schema")
        meta = TableMeta(tuple(pk), tuple((defaults or {}).items()), tuple(generated), auto_id, tuple(fks))
        base = Base(name, meta, path, format, tuple(options.items()), frame, schema)
        self.bases[name.lower()] = base
        columns = tuple((f.name, f.dataType.simpleString(), f.name, None) for f in schema.fields)
        return TableState(name, name.lower(), meta, TableDiff(columns))

    def base(self, name: str) -> Base:
        try:
            return self.bases[name.lower()]
        except KeyError:
            raise UnknownTable(f"table {name} does not exist") from None

    def guard_path(self, path: str) -> None:
        """Refuse to write at, above or below a base table's files."""
        def plain(p: str) -> str:
            return p.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"

        for b in self.bases.values():
            if b.path and (plain(path).startswith(plain(b.path)) or plain(b.path).startswith(plain(path))):
                raise WriteGuard(f"{path} holds the read-only table {b.name}")
