"""Streams over overlaid tables, and message-like fan-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotSupported
from ..operators.merge import adapt, overlay_keys, without_keys
from ..session import OverlaySession
from ..state import DEAD


def read_stream(session: OverlaySession, table: str, *, images: bool = True, **options: str) -> DataFrame:
    """The base files of a table as a stream, merged with the overlay as it is now.

    Base rows whose keys are changed or deleted are left out by a stream-static
    anti join, in append mode and without state. The changed rows themselves
    follow as a second stream (of the segments' files), if ``images``.
    """
    version = session.version
    state = version.get(table)
    base = session.db.catalog.base(state.base)
    if base.path is None:
        raise NotSupported(f"{table} is not made of files")
    stream = session.spark.readStream.format(base.format).options(**dict(base.options), **options).schema(base.schema).load(_folder(base.path))
    if base.meta.pk:
        stream = stream.select("*", *[F.col(c).alias(k) for c, k in zip(base.meta.pk, state.key_columns)])
    else:
        stream = stream.select("*", F.col("_metadata.file_path").alias("__k0"), F.col("_metadata.row_index").alias("__k1"))
    if state.segments:
        stream = without_keys(stream, overlay_keys(state), state.key_columns, state.rows, state.null_keys)
    out = adapt(stream, state, False)
    if not state.segments or not images:
        return out
    whole = session.writer.compact(state)
    changed = session.spark.readStream.schema(whole.segments[0].schema).parquet(whole.paths[0]).filter(~F.col(DEAD)).select(*[f"`{c}`" for c in state.diff.names])
    return changed.unionByName(out)


def _folder(path: str) -> str:
    """Streams read folders; a single file is matched by its own name."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return f"{head}/{tail[:-1]}[{tail[-1]}]" if "." in tail and not path.endswith("/") else path


def fan_in(streams: Sequence[DataFrame], channel: Column | None = None, patterns: Sequence[str] = ()) -> DataFrame:
    """Messages of several streams as one, kept to the channels that match a pattern (*, ?, [set])."""
    from functools import reduce

    from ..operators.kv import glob

    out = reduce(DataFrame.unionByName, streams)
    if channel is None or not patterns:
        return out
    return out.filter(reduce(lambda a, b: a | b, [channel.rlike(glob(p)) for p in patterns]))


def windowed(stream: DataFrame, ts: str, keys: Sequence[str], *, delay: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window of event time, late rows up to ``delay`` included."""
    marked = stream.withWatermark(ts, delay)
    return marked.groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"))
