"""Named databases under one folder: create, open, list, reset and drop."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import OverlayError, UnknownTable
from .session import Database
from .sources.store import read_text, shared_folder, write_text
from .state import ForeignKey


class Registry:
    """What is known of each database is a small JSON text beside its segments, written and read by Spark."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/databases").rstrip("/")
        self.opened: dict[str, Database] = {}
        self.known: dict[str, dict[str, Any]] = {n: self._read(k) for n, k in json.loads(read_text(spark, f"{self.root}/registry.json") or "{}").items()}

    @staticmethod
    def _read(known: dict[str, Any]) -> dict[str, Any]:
        for options in known["tables"].values():
            if "fks" in options:
                options["fks"] = [ForeignKey(**{k: tuple(v) if isinstance(v, list) else v for k, v in fk.items()}) for fk in options["fks"]]
        return known

    def _keep(self) -> None:
        """Databases over files are known after a restart; those over frames of this process are not."""
        kept = {}
        for name, known in self.known.items():
            if not any("frame" in o for o in known["tables"].values()):
                kept[name] = known | {"tables": {t: o | ({"fks": [asdict(fk) for fk in o["fks"]]} if "fks" in o else {}) for t, o in known["tables"].items()}}
        write_text(self.spark, f"{self.root}/registry.json", json.dumps(kept))

    def create(self, name: str, tables: dict[str, dict[str, Any]]) -> Database:
        """A database over base tables: name -> options of ``Database.register``."""
        if name in self.known:
            raise OverlayError(f"database {name} exists already")
        db = Database(self.spark, f"{self.root}/{name}")
        for table, options in tables.items():
            db.register(table, **options)
        self.opened[name] = db
        self.known[name] = {"tables": tables, "manifest": None}
        self._keep()
        return db

    def open(self, name: str) -> Database:
        if name not in self.known:
            raise UnknownTable(f"database {name} does not exist")
        return self.opened[name] if name in self.opened else self.reopen(name)

    def save(self, name: str) -> str:
        """Keep the committed state; returns the manifest's path."""
        self.known[name]["manifest"] = path = self.open(name).save()
        self._keep()
        return path

    def reopen(self, name: str) -> Database:
        """A new database object from what was saved last, as after a restart."""
        known = self.known[name]
        db = Database(self.spark, f"{self.root}/{name}")
        for table, options in known["tables"].items():
            db.register(table, **options)
        if known["manifest"]:
            db.load(known["manifest"])
        self.opened[name] = db
        return db

    def reset(self, name: str) -> None:
        self.open(name).reset()
        self.known[name]["manifest"] = None
        self._keep()

    def drop(self, name: str) -> None:
        """Forget a database. Its base tables are not touched."""
        if name not in self.known:
            raise UnknownTable(f"database {name} does not exist")
        self.opened.pop(name, None)
        del self.known[name]
        self._keep()

    def list(self) -> DataFrame:
        rows = [(n, len(k["tables"]), k["manifest"], json.dumps(sorted(k["tables"]))) for n, k in sorted(self.known.items())]
        return self.spark.createDataFrame(rows, "name string, tables int, manifest string, table_names string")
