"""The catalog: tables, their keys and committed revisions.

Each state is a JSON file with the next number, which is only written if no other
driver has written that number before; so of two drivers that change the same state
one is told, and nothing is overwritten unseen.
"""

from __future__ import annotations

import json
import threading
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from quern.errors import AnalysisError
from quern.functions.dialect import SPARK_TYPES
from quern.sources.files import Files


#: States that are kept.
KEPT = 20


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]]
    key: list[str]
    not_null: list[str] = field(default_factory=list)
    engine: str = "TABLE"
    retention: float | None = None
    indexes: dict[str, str] = field(default_factory=dict)
    base: int = 0  # revision up to which the base files go; 0: none
    base_rows: int = 0
    manifest: str = ""  # name of the list of base files
    #: Committed (revision, rows, whether it may hold new keys, least and greatest first key, name of its folder).
    deltas: list[tuple] = field(default_factory=list)
    splits: list = field(default_factory=list)  # first keys that begin a shard, as the manifest has them; no base file holds keys of two shards

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK_TYPES[k], True) for n, k in self.columns])

    def kind(self, column: str) -> str:
        kinds = dict(self.columns)
        if column not in kinds:
            raise AnalysisError(f"table {self.name} has no column {column}")
        return kinds[column]


class CatalogChanged(AnalysisError):
    """Another driver has changed the catalog; this one has read it again, and the statement can be repeated."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.files, self.folder = root, Files(spark), f"{root}/catalog"
        self.lock = threading.RLock()
        self.refresh()

    def refresh(self) -> None:
        """Read the latest state."""
        numbers = [int(n.removesuffix(".json")) for n in self.files.names(self.folder) if n.removesuffix(".json").isdigit()]
        self.number = max(numbers, default=0)
        self.tables: dict[str, Table] = {}
        self.revision = 0
        self.leases: dict[str, dict] = {}
        if self.number:
            state = json.loads(self.files.read(f"{self.folder}/{self.number}.json"))
            self.revision, self.leases = state["revision"], state["leases"]
            for t in state["tables"]:
                t |= {"columns": [tuple(c) for c in t["columns"]], "deltas": [tuple(d) for d in t["deltas"]]}
                self.tables[t["name"]] = Table(**t)

    def save(self) -> None:
        state = {"revision": self.revision, "leases": self.leases, "tables": [asdict(t) for t in self.tables.values()]}
        if not self.files.create(f"{self.folder}/{self.number + 1}.json", json.dumps(state)):
            self.refresh()
            raise CatalogChanged("another driver has changed the catalog; the statement had no effect")
        self.number += 1
        if self.number > KEPT:
            self.files.delete(f"{self.folder}/{self.number - KEPT}.json")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise AnalysisError(f"unknown table {name}")
        return self.tables[name]

    def next_revision(self) -> int:
        self.revision += 1
        return self.revision
