"""Documents in collections over an overlaid table.

A document is a row (path, collection, doc_id, fields, create_time,
update_time) with the path as primary key and its fields as JSON text, read as
VARIANT. Values keep their JSON type; other types are objects with one
``$`` field: ``{"$timestamp": ...}``, ``{"$bytes": ...}``, ``{"$ref": ...}``,
``{"$geo": [lat, lng]}``, ``{"$double": "NaN"}``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Conflict, NotFound, NotSupported, PreconditionFailed, TransactionState, WriteGuard
from ..session import OverlaySession
from ..state import DEAD

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in ("path", "collection", "doc_id", "fields")], *[T.StructField(c, T.TimestampType()) for c in ("create_time", "update_time")]])

#: Order of the types; fixed values.
RANKS = {"null": 1, "bool": 2, "number": 3, "timestamp": 4, "string": 5, "bytes": 6, "ref": 7, "geo": 8, "array": 9, "map": 10}


def _path(field: str) -> str:
    return "$" + "".join(f"['{p}']" if not p.isidentifier() else f".{p}" for p in field.split("."))


def raw(field: str) -> Column:
    """A field as VARIANT; null if it is missing."""
    return F.try_variant_get(F.parse_json(F.coalesce(F.col("fields"), F.lit("{}"))), _path(field), "variant")


class Value:
    """Type tests and typed readings of one field, or of any VARIANT column; its rank may be given as a column of its own."""

    def __init__(self, field: str | Column, rank: Column | None = None):
        self._rank = rank
        self.v = raw(field) if isinstance(field, str) else field
        self.kind = F.coalesce(F.schema_of_variant(self.v), F.lit(""))
        get = lambda p, t: F.try_variant_get(self.v, p, t)
        self.text = get("$", "string")
        self.special = {k: get(f"$['${k}']", "string") for k in ("timestamp", "bytes", "ref", "geo", "double")}
        self.number = F.coalesce(F.when(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), get("$", "double")), self.special["double"].try_cast("double"))
        self.geo = [get(f"$['$geo'][{i}]", "double") for i in (0, 1)]

    @property
    def rank(self) -> Column:
        """The type's place in the order; 0 if the field is missing."""
        if self._rank is not None:
            return self._rank
        r = F.when(self.v.isNull(), 0).when(F.is_variant_null(self.v), RANKS["null"]).when(self.kind == "BOOLEAN", RANKS["bool"])
        r = r.when(self.number.isNotNull(), RANKS["number"]).when(self.kind == "STRING", RANKS["string"]).when(self.kind.startswith("ARRAY"), RANKS["array"])
        for k in ("timestamp", "bytes", "ref", "geo"):
            r = r.when(self.special[k].isNotNull(), RANKS[k])
        return r.otherwise(RANKS["map"])

    @property
    def plain(self) -> list[Column]:
        """rank, two numbers and a text that sort scalars as values do: numbers and times by value (NaN last), places by both numbers."""
        moment = F.unix_micros(self.special["timestamp"].try_cast("timestamp")).cast("double")
        num = F.when(self.rank == RANKS["number"], self.number).when(self.rank == RANKS["timestamp"], moment).when(self.rank == RANKS["geo"], self.geo[0])
        other = F.coalesce(self.special["bytes"], self.special["ref"], self.text, F.to_json(self.v))
        text = F.when(~self.rank.isin(RANKS["number"], RANKS["timestamp"], RANKS["geo"], RANKS["array"], RANKS["map"]), other)
        return [self.rank.alias("rank"), num.alias("num"), F.when(self.rank == RANKS["geo"], self.geo[1]).alias("num2"), text.alias("text")]

    @property
    def order(self) -> Column:
        """A struct that sorts as values do: missing, then by type; arrays by their elements in turn, maps by their keys and
        values in order of the keys. Arrays and maps inside these go by their JSON."""
        inner = lambda x: F.struct(*Value(x).plain, F.when(Value(x).rank >= RANKS["array"], F.to_json(x)).alias("json"))
        items = F.transform(F.try_variant_get(self.v, "$", "array<variant>"), inner)
        entries = F.array_sort(F.transform(F.map_entries(F.try_variant_get(self.v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), inner(e["value"]).alias("value"))))
        return F.struct(*self.plain, F.when(self.rank == RANKS["array"], items).alias("items"), F.when(self.rank == RANKS["map"], entries).alias("entries"))


def constant(value: Any) -> Value:
    """A Python value as a field's value."""
    return Value(F.parse_json(F.lit(encode(value))))


def _literal(value: Any) -> tuple[int, Column]:
    """(rank, comparable column) of a Python value that is compared directly."""
    if value is None:
        return RANKS["null"], F.lit(None)
    if isinstance(value, bool):
        return RANKS["bool"], F.lit("true" if value else "false")
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return RANKS["number"], F.lit(float(value))
    return RANKS["string"] if isinstance(value, str) else 0, F.lit(value if isinstance(value, str) else None)


def encode(value: Any) -> str:
    """A Python value as the JSON that is stored."""

    def plain(v: Any) -> Any:
        if isinstance(v, datetime.datetime):
            return {"$timestamp": v.isoformat()}
        if isinstance(v, bytes):
            return {"$bytes": v.hex()}
        if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            return {"$double": "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"}
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in sorted(v.items())}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


def decode(text: str) -> Any:
    def back(v: Any) -> Any:
        if isinstance(v, dict):
            if len(v) == 1:
                (k, x), = v.items()
                if k == "$timestamp":
                    return datetime.datetime.fromisoformat(x)
                if k == "$bytes":
                    return bytes.fromhex(x)
                if k == "$double":
                    return float(x)
            return {k: back(x) for k, x in v.items()}
        return [back(x) for x in v] if isinstance(v, list) else v

    return back(json.loads(text))


def condition(field: str, op: str, value: Any = None) -> Column:
    """A field filter. Comparisons hold only between values of one type; a missing field fits IS_NULL and nothing else."""
    op = op.upper()
    if field == "__name__":
        c = F.col("path")
        return {"=": c == value, "==": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value, "IN": c.isin(value) if op == "IN" else F.lit(False)}[op]
    f = Value(field)
    if op in ("IS_NULL", "IS_NOT_NULL"):
        null = f.rank <= RANKS["null"]
        return null if op == "IS_NULL" else ~null
    if op in ("IS_NAN", "IS_NOT_NAN"):
        nan = F.coalesce(F.isnan(f.number), F.lit(False))
        return nan if op == "IS_NAN" else (f.rank > 0) & ~nan
    if op in ("IN", "NOT_IN"):
        any_of = reduce(lambda a, b: a | b, [condition(field, "=", v) for v in value], F.lit(False))
        return any_of if op == "IN" else (f.rank > RANKS["null"]) & ~any_of
    if op in ("ARRAY_CONTAINS", "ARRAY_CONTAINS_ANY"):
        wanted = value if op == "ARRAY_CONTAINS_ANY" else [value]
        items = F.transform(F.coalesce(F.try_variant_get(f.v, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: Value(x).order)
        held = lambda order: F.exists(items, lambda x: x == order)
        found = [held(constant(w).order) for w in wanted]
        return F.coalesce(reduce(lambda a, b: a | b, found, F.lit(False)), F.lit(False)) & (f.rank == RANKS["array"])
    rank, literal = _literal(value)
    if value is None:
        same = f.rank == RANKS["null"]
        return same if op in ("=", "==") else (f.rank > RANKS["null"])
    if rank == RANKS["number"]:
        column = f.number
    elif rank:
        column = f.text
    else:  # times, bytes, places, arrays and maps by the order of values
        column, literal, rank = f.order, constant(value).order, constant(value).rank
    test = {"=": column == literal, "==": column == literal, "<": column < literal, "<=": column <= literal, ">": column > literal, ">=": column >= literal, "!=": column != literal}[op]
    if op == "!=":
        return F.coalesce((f.rank > RANKS["null"]) & ((f.rank != rank) | test), F.lit(False))
    return F.coalesce((f.rank == rank) & test, F.lit(False))


def where(spec: Any) -> Column:
    """(field, op, value), {"and": [...]} or {"or": [...]}; an empty list holds for all."""
    if isinstance(spec, dict):
        (kind, parts), = spec.items()
        found = [where(p) for p in parts]
        if not found:
            return F.lit(True)
        return reduce(lambda a, b: a & b, found) if kind == "and" else reduce(lambda a, b: a | b, found)
    return condition(*spec)


class Documents:
    """Document requests on one table in a session."""

    def __init__(self, session: OverlaySession, table: str = "docs", now: Callable[[], datetime.datetime] | None = None):
        self.session, self.table = session, table
        self.now = now or (lambda: datetime.datetime.now(datetime.UTC))

    def rows(self) -> DataFrame:
        return self.session.table(self.table)

    # -- reads --------------------------------------------------------------------------------------

    def get(self, path: str) -> dict[str, Any]:
        row = self.rows().filter(F.col("path") == path).select("fields").first()
        if row is None:
            raise NotFound(path)
        return decode(row[0])

    def batch_get(self, paths: Sequence[str]) -> list[tuple[str, dict[str, Any] | None]]:
        """Found or missing for each path, in the order asked."""
        got = {r["path"]: decode(r["fields"]) for r in self.rows().filter(F.col("path").isin(list(paths))).select("path", "fields").collect()}
        return [(p, got.get(p)) for p in paths]

    def list(self, collection: str, page_size: int = 100, token: str | None = None) -> tuple[list[tuple[str, dict]], str | None]:
        """A page in order of path, and the token of the next one: the path that it begins with."""
        rows = self.rows().filter(F.col("collection") == collection)
        if token:
            rows = rows.filter(F.col("path") >= token)
        got = rows.orderBy("path").limit(page_size + 1).select("path", "fields").collect()
        more = got[page_size]["path"] if len(got) > page_size else None
        return [(r["path"], decode(r["fields"])) for r in got[:page_size]], more

    def collection_ids(self, parent: str = "") -> list[str]:
        """Collections right below a document (or the root), sorted."""
        c = F.col("collection")
        inside = c if not parent else F.when(c.startswith(parent + "/"), F.substring(c, len(parent) + 2, 1 << 30))
        top = F.split(inside, "/")[0]
        return [r[0] for r in self.rows().select(top.alias("c")).filter("c is not null").distinct().orderBy("c").collect()]

    def query(self, collection: str, filter: Any = None, order: Sequence[tuple[str, str]] = (), limit: int | None = None, offset: int = 0, group: bool = False, start: Any = None) -> DataFrame:
        """Documents of a collection (or, with ``group``, of all collections of that name) as a frame."""
        c = F.col("collection")
        rows = self.rows().filter((c == collection) | c.endswith("/" + collection) if group else c == collection)
        if filter is not None:
            rows = rows.filter(where(filter))
        if order or limit is not None or offset:
            shown = rows.columns
            # Values, their ranks and keys are columns, each made once for a row; in the sort they would be made again for each comparison.
            fields = {i: f for i, (f, _) in enumerate(order) if f != "__name__"}
            rows = rows.select("*", *[raw(f).alias(f"__value{i}") for i, f in fields.items()])
            for i in fields:
                rows = rows.filter(F.col(f"__value{i}").isNotNull())
            rows = rows.select("*", *[Value(F.col(f"__value{i}")).rank.alias(f"__rank{i}") for i in fields])
            rows = rows.select(*shown, *[Value(F.col(f"__value{i}"), F.col(f"__rank{i}")).order.alias(f"__key{i}") for i in fields])
            keys = [F.col(f"__key{i}") if i in fields else F.col("path") for i in range(len(order))]
            sort = [k.desc() if d.lower().startswith("desc") else k.asc() for k, (_, d) in zip(keys, order)]
            down = bool(order) and order[-1][1].lower().startswith("desc")
            rows = rows.orderBy(*sort, F.col("path").desc() if down else F.col("path").asc())
            if offset:
                rows = rows.offset(offset)
            if limit is not None:
                rows = rows.limit(limit)
            rows = rows.select(*shown)
        return rows

    def aggregate(self, collection: str, aggregations: Sequence[tuple[str, str | None, str | None]], filter: Any = None) -> DataFrame:
        """(COUNT | SUM | AVG, field, alias): sums skip what isn't a number and are 0 without any; averages are null."""
        out = []
        for i, (kind, field, alias) in enumerate(aggregations):
            name = alias or f"field_{i + 1}"
            if kind.upper() == "COUNT":
                out.append(F.count(F.lit(1)).alias(name))
            elif kind.upper() == "SUM":
                out.append(F.coalesce(F.sum(Value(field).number), F.lit(0.0)).alias(name))
            elif kind.upper() == "AVG":
                out.append(F.avg(Value(field).number).alias(name))
            else:
                raise NotSupported(kind)
        return self.query(collection, filter).agg(*out)

    def partition(self, collection: str, n: int) -> DataFrame:
        """The collection's documents in n ranges of path."""
        return self.query(collection).repartitionByRange(n, "path")

    # -- transactions and calls by name -----------------------------------------------------------------

    def begin(self) -> DocumentTransaction:
        """A transaction: its reads are those of now, its writes come together at its commit."""
        return DocumentTransaction(self)

    def call(self, method: str, **request: Any) -> Any:
        """A request by the name of its method. Reads and writes go to the merged table; writes never reach the base."""
        kind = classify_method(method)
        if kind == "write" and self.session.version.get(self.table) is None:
            raise WriteGuard(f"{method}: {self.table} has no overlay")
        name = METHODS[method][1]
        if name is None:
            raise NotSupported(method)
        return getattr(self, name)(**request)

    # -- writes ----------------------------------------------------------------------------------------

    def create(self, collection: str, doc_id: str, fields: dict[str, Any]) -> str:
        path = f"{collection}/{doc_id}"
        self.commit([{"update": path, "fields": fields, "exists": False}])
        return path

    def update(self, path: str, fields: dict[str, Any], mask: Sequence[str] | None = None, exists: bool | None = None) -> None:
        self.commit([{"update": path, "fields": fields, "mask": mask, "exists": exists}])

    def delete(self, path: str, exists: bool | None = None) -> None:
        self.commit([{"delete": path, "exists": exists}])

    def commit(self, writes: Sequence[dict[str, Any]]) -> int:
        """Apply writes together: update (with mask and transforms) or delete, each with its preconditions.

        The documents named are read once and written as one segment; if a
        precondition fails nothing is written.
        """
        paths = [w.get("update") or w.get("delete") or w["transform"] for w in writes]
        now = self.now()
        old = {r["path"]: r for r in self.rows().filter(F.col("path").isin(paths)).collect()}
        docs: dict[str, dict | None] = {p: (decode(old[p]["fields"]) if p in old else None) for p in paths}
        for path, w in zip(paths, writes):
            now_doc = docs[path]
            if w.get("exists") is not None and (now_doc is not None) != w["exists"]:
                raise PreconditionFailed(f"{path} {'exists' if now_doc is not None else 'does not exist'}")
            if w.get("update_time") is not None and (path not in old or old[path]["update_time"] != w["update_time"]):
                raise PreconditionFailed(f"{path} was changed")
            if "delete" in w:
                docs[path] = None
                continue
            new = w.get("fields") or {}
            if w.get("mask") is not None or "transform" in w:
                merged = _copy(now_doc or {})
                for f in w.get("mask") or []:
                    _put(merged, f, _take(new, f))
                new = merged
            else:
                new = _copy(new)
            for field, (kind, value) in (w.get("transforms") or {}).items():
                _put(new, field, _transform(kind, _take(new, field), value, now))
            docs[path] = new
        rows, dead = [], []
        for path, doc in docs.items():
            collection, _, doc_id = path.rpartition("/")
            if doc is None:
                if path in old:
                    dead.append(path)
                continue
            created = old[path]["create_time"] if path in old else now
            rows.append((path, collection, doc_id, encode(doc), created, now))
        s = self.session
        s._start = version = s.version
        state = version.get(self.table)
        frame = s.spark.createDataFrame(rows, SCHEMA).withColumn(DEAD, F.lit(False))
        if dead:
            frame = frame.unionByName(self.rows().filter(F.col("path").isin(dead)).withColumn(DEAD, F.lit(True)))
        after, _, n = s.writer.apply(state, frame.withColumn("__k0", F.col("path")))
        if n:
            s._save(version.put(after))
        return n

    def apply_stream(self, stream: DataFrame, checkpoint: str) -> Any:
        """A stream of (op, path, fields JSON) rows written batch by batch; the overlay takes each batch as one segment.
        Of several rows of a path in a batch the last by ``seq`` counts, where there is such a column, or by place."""

        def write(batch: DataFrame, _: int) -> None:
            s = self.session
            s._start = version = s.version
            now = F.lit(self.now()).cast("timestamp")
            p = F.col("path")
            order = F.col("seq") if "seq" in batch.columns else F.monotonically_increasing_id()
            last = batch.withColumn("__order", order).groupBy("path").agg(F.max_by(F.struct("op", "fields"), "__order").alias("last")).select("path", "last.op", "last.fields")
            there = self.rows().select("path", F.col("create_time").alias("made"))
            rows = last.join(there, "path", "left").select(
                p, F.regexp_replace(p, "/[^/]*$", "").alias("collection"), F.element_at(F.split(p, "/"), -1).alias("doc_id"), "fields", F.coalesce("made", now).alias("create_time"), now.alias("update_time"), (F.col("op") == "delete").alias(DEAD), p.alias("__k0")
            )
            after, _, n = s.writer.apply(version.get(self.table), rows)
            if n:
                s._save(version.put(after))

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Methods by name: what they do, and the request here that does it; fixed values.
METHODS: dict[str, tuple[str, str | None]] = {
    "GetDocument": ("read", "get"), "BatchGetDocuments": ("read", "batch_get"), "ListDocuments": ("read", "list"), "ListCollectionIds": ("read", "collection_ids"), "RunQuery": ("read", "query"),
    "RunAggregationQuery": ("read", "aggregate"), "PartitionQuery": ("read", "partition"), "CreateDocument": ("write", "create"), "UpdateDocument": ("write", "update"), "DeleteDocument": ("write", "delete"),
    "Commit": ("write", "commit"), "BatchWrite": ("write", "commit"), "Write": ("write", "apply_stream"), "BeginTransaction": ("transaction", "begin"), "Rollback": ("transaction", None), "Listen": ("base only", None),
}


def classify_method(method: str) -> str:
    """read, write, transaction or base only; anything else is refused."""
    if method not in METHODS:
        raise NotSupported(f"method {method}")
    return METHODS[method][0]


class DocumentTransaction:
    """Reads of one version; a commit fails if a document that was read has changed since."""

    def __init__(self, documents: Documents):
        self.documents, self.read_time, self.open = documents, documents.now(), True
        snapshot = OverlaySession(documents.session.db)
        snapshot.current = documents.session.version
        self.snapshot = Documents(snapshot, documents.table, documents.now)
        self.seen: set[str] = set()

    def _check(self) -> None:
        if not self.open:
            raise TransactionState("the transaction has ended")

    def get(self, path: str) -> dict[str, Any]:
        self._check()
        self.seen.add(path)
        return self.snapshot.get(path)

    def batch_get(self, paths: Sequence[str]) -> list[tuple[str, dict[str, Any] | None]]:
        self._check()
        self.seen |= set(paths)
        return self.snapshot.batch_get(paths)

    def query(self, *args: Any, **options: Any) -> DataFrame:
        self._check()
        return self.snapshot.query(*args, **options)

    def commit(self, writes: Sequence[dict[str, Any]] = ()) -> int:
        self._check()
        self.open = False
        if self.seen:
            mark = lambda d: {r["path"]: r["update_time"] for r in d.rows().filter(F.col("path").isin(list(self.seen))).select("path", "update_time").collect()}
            if mark(self.snapshot) != mark(self.documents):
                raise Conflict("a document that was read has changed")
        return self.documents.commit(writes) if writes else 0

    def rollback(self) -> None:
        self._check()
        self.open = False


def _copy(value: Any) -> Any:
    return {k: _copy(v) for k, v in value.items()} if isinstance(value, dict) else list(value) if isinstance(value, list) else value


_MISSING = object()


def _take(doc: dict, field: str) -> Any:
    for part in field.split("."):
        if not isinstance(doc, dict) or part not in doc:
            return _MISSING
        doc = doc[part]
    return doc


def _put(doc: dict, field: str, value: Any) -> None:
    *parents, last = field.split(".")
    for part in parents:
        doc = doc.setdefault(part, {})
    if value is _MISSING:
        doc.pop(last, None)
    else:
        doc[last] = value


def _transform(kind: str, old: Any, value: Any, now: datetime.datetime) -> Any:
    number = isinstance(old, int | float) and not isinstance(old, bool)
    if kind == "server_timestamp":
        return now
    if kind == "increment":
        return (old if number else 0) + value
    if kind == "maximum":
        return max(old, value) if number else value
    if kind == "minimum":
        return min(old, value) if number else value
    items = old if isinstance(old, list) else []
    if kind == "array_union":
        return items + [v for v in value if v not in items]
    if kind == "array_remove":
        return [v for v in items if v not in value]
    raise NotSupported(kind)
