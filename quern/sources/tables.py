"""Keyed tables that change: sorted base files and a log of changes, merged on read.

A change row holds the table's columns, its revision and place within the statement,
whether it writes or deletes, and which columns it sets (null: all). Only changes are
grouped by key; the base is joined to them, by broadcast while they are few, so a few
changes never shuffle a large base, and a table without changes is read as it is.

A manifest lists the base files with the range of first keys that each holds, so that
reads bounded by that key open few files and compaction rewrites only files that
changes touch.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import AnalysisError
from quern.sources.catalog import Catalog, Table

META = [T.StructField("_rev", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_set", T.ArrayType(T.StringType()))]
#: Change rows up to which they are broadcast to the base.
BROADCAST_ROWS = 200_000
#: Change files after which a table is compacted.
COMPACT_AFTER = 10
ROWS_A_FILE = 2_000_000
NOT_NULL = "must not be null"


@dataclass(frozen=True)
class BaseFile:
    path: str
    rows: int
    low: int | float | str | None
    high: int | float | str | None


@dataclass(frozen=True)
class Bounds:
    """What first keys may be, ends included; times are microseconds, None is no bound."""

    low: int | float | str | None = None
    high: int | float | str | None = None

    def meet(self, low: int | float | str | None, high: int | float | str | None) -> bool:
        return (self.low is None or high is None or high >= self.low) and (self.high is None or low is None or low <= self.high)

    def condition(self, c: Column) -> Column:
        """The same on a column of plain keys (see :func:`plain_key`)."""
        out = F.lit(True)
        if self.low is not None:
            out = out & (c >= F.lit(self.low))
        return out & (c <= F.lit(self.high)) if self.high is not None else out


@dataclass(frozen=True)
class Shard:
    """First keys from ``low`` on and below ``high`` (None: no bound), and base files."""

    low: int | float | str | None
    high: int | float | str | None
    files: list[BaseFile]

    def condition(self, c: Column) -> Column:
        """Whether plain keys (see :func:`plain_key`) are the shard's."""
        out = F.lit(True) if self.low is None else c >= F.lit(self.low)
        return out if self.high is None else out & (c < F.lit(self.high))

    def outside(self, low: int | float | str | None, high: int | float | str | None) -> bool:
        """Whether no key of a range is the shard's, as far as is known."""
        return (self.low is not None and high is not None and high < self.low) or (self.high is not None and low is not None and low >= self.high)


def named(revision: int) -> str:
    """A folder of one's own for a revision: another driver may be writing the same, and one of both will commit."""
    return f"rev={revision}.{uuid.uuid4().hex[:12]}"


def plain_key(t: Table, c: Column) -> Column:
    """A first key as the manifest has it."""
    return F.unix_micros(c) if t.kind(t.key[0]) == "timestamp" else c


class Storage:
    def __init__(self, spark: SparkSession, catalog: Catalog) -> None:
        self.spark, self.catalog = spark, catalog
        self.bases: dict[str, tuple[str, DataFrame]] = {}  # base files never change, so their listing is kept
        self.manifests: dict[str, tuple[str, list[BaseFile]]] = {}

    def folder(self, t: Table) -> str:
        return f"{self.catalog.root}/{t.name}"

    def delta_schema(self, t: Table) -> T.StructType:
        return T.StructType(t.schema.fields + META)

    # --- reading

    def files(self, t: Table) -> list[BaseFile]:
        """The base files, by their least key."""
        if not t.base:
            return []
        number, held = self.manifests.get(t.name, (None, []))
        if number != t.manifest:
            held = [BaseFile(**f) for f in json.loads(self.catalog.files.read(f"{self.folder(t)}/manifest/{t.manifest}.json"))]
            self.manifests[t.name] = (t.manifest, held)
        return held

    def shards(self, t: Table) -> list[Shard]:
        """All first keys, divided where the table was split, with the base files that hold them; a shard may have no file or many."""
        out = [Shard(low, high, []) for low, high in zip([None, *t.splits], [*t.splits, None], strict=True)]
        for f in self.files(t):
            out[-1 if f.low is None else bisect_right(t.splits, f.low)].files.append(f)  # no least key: NaN, above all numbers
        return out

    def base(self, t: Table, bounds: Bounds | None = None, files: list[BaseFile] | None = None) -> DataFrame:
        """The base's rows, at least those within bounds of the first key, or those of some files."""
        every = self.files(t)
        wanted = [f for f in every if bounds.meet(f.low, f.high)] if bounds else every if files is None else files
        if not wanted:
            return self.spark.createDataFrame([], t.schema)
        if len(wanted) < len(every):
            return self.spark.read.schema(t.schema).parquet(*(f.path for f in wanted))
        number, df = self.bases.get(t.name, (None, None))
        if number != t.manifest:
            df = self.spark.read.schema(t.schema).parquet(*(f.path for f in every))
            self.bases[t.name] = (t.manifest, df)
        return df

    def ends(self, t: Table, rows: int, last: bool) -> list[BaseFile]:
        """Files that hold the first, or last, so many rows by the first key, and all rows that tie with these."""
        out, held, every = [], 0, sorted(self.files(t), key=lambda f: (f.high if last else f.low), reverse=last)
        for f in every:
            edge = (min(x.low for x in out) if last else max(x.high for x in out)) if out else None
            if held >= rows and (f.high < edge if last else f.low > edge):
                break
            out.append(f)
            held += f.rows
        return out

    def deltas(self, t: Table, upto: int | None = None) -> DataFrame | None:
        paths = [f"{self.folder(t)}/delta/{d[5]}" for d in t.deltas if d[0] > t.base and (upto is None or d[0] <= upto)]
        return self.spark.read.schema(self.delta_schema(t)).parquet(*paths) if paths else None

    def changes(self, t: Table, deltas: DataFrame) -> DataFrame:
        """One row a key: per column its newest setting since the key was last deleted, and what became of the key."""
        at = F.struct("_rev", "_seq")
        writes = F.col("_op") == "U"
        aggs = [F.max(F.when(F.col("_op") == "D", at)).alias("_deleted"), F.max(F.when(writes, at)).alias("_written"), F.max(F.when(writes & F.col("_set").isNull(), at)).alias("_full")]
        for c in self.others(t):
            sets = writes & (F.col("_set").isNull() | F.array_contains("_set", c))
            aggs.append(F.max(F.when(sets, F.struct("_rev", "_seq", F.col(c).alias("v")))).alias(f"_c_{c}"))
        return deltas.groupBy(*t.key).agg(*aggs)

    def others(self, t: Table) -> list[str]:
        return [c for c, _ in t.columns if c not in t.key]

    def view(self, t: Table, upto: int | None = None, bounds: Bounds | None = None, files: list[BaseFile] | None = None) -> DataFrame:
        """The table as of a revision (None: now); with bounds, at least the rows whose first key is within them; with files, those and the changes."""
        deltas = self.deltas(t, upto)
        base = lambda: self.base(t, bounds, files)
        if deltas is None:
            return base()
        changes = self.changes(t, deltas)
        after = lambda c: c.isNotNull() & (F.col("_deleted").isNull() | (F.struct(c["_rev"], c["_seq"]) > F.col("_deleted")))
        alive = after(F.col("_written"))
        value = lambda c, old: F.when(after(F.col(f"_c_{c}")), F.col(f"_c_{c}")["v"]).otherwise(old)
        columns = [c for c, _ in t.columns]
        if not t.base:
            made = changes.where(alive)
            return made.select(*((value(c, F.lit(None)) if c not in t.key else F.col(c)).alias(c) for c in columns))
        past = [d for d in t.deltas if d[0] > t.base and (upto is None or d[0] <= upto)]
        rows = sum(d[1] for d in past)
        if rows <= BROADCAST_ROWS:
            changes = F.broadcast(changes)
        b, d = base().alias("b"), changes.alias("d")
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in t.key]
        touched = F.col("_written").isNotNull() | F.col("_deleted").isNotNull()
        # A base row keeps what no change since its deletion, if any, has set.
        old = lambda c: F.when(F.col("_deleted").isNull(), F.col(f"b.{c}"))
        merged = b.join(d, same, "left").where(~touched | alive)
        merged = merged.select(*((F.col(f"b.{c}") if c in t.key else F.when(touched, value(c, old(c))).otherwise(F.col(f"b.{c}"))).alias(c) for c in columns))
        whole = [x for x in past if x[2]]
        if not whole:
            return merged  # only deletions and changes to rows that the base has
        # Keys that the base lacks can only be among those written whole; the base is asked for these alone.
        written = Bounds(min(x[3] for x in whole), max(x[4] for x in whole)) if all(x[3] is not None for x in whole) else Bounds()
        first = plain_key(t, F.col(t.key[0]))
        near = self.base(t, written) if files is None else base()
        held = near.where(written.condition(first)).select(*t.key).alias("b").join(d, same, "left_semi").alias("b")
        if rows <= BROADCAST_ROWS:
            held = F.broadcast(held)
        new = self.changes(t, deltas.where(written.condition(first))).alias("d").join(held, same, "left_anti").where(alive)
        return merged.union(new.select(*((value(c, F.lit(None)) if c not in t.key else F.col(f"d.{c}")).alias(c) for c in columns)))

    # --- writing

    def append(self, t: Table, rows: DataFrame, op: str | Column = "U", sets: list[str] | None = None, seq: Column | None = None) -> int:
        """Write change rows as one revision and commit it; the number of rows."""
        with self.catalog.lock:
            revision = self.catalog.next_revision()
            present = set(rows.columns)
            kinds = {f.name: f.dataType for f in t.schema.fields}
            out = rows.select(
                *((F.col(f"`{c}`") if c in present else F.lit(None)).cast(kinds[c]).alias(c) for c, _ in t.columns),
                F.lit(revision).cast("long").alias("_rev"), (seq if seq is not None else F.lit(0)).cast("long").alias("_seq"), (F.lit(op) if isinstance(op, str) else op).alias("_op"),
                (F.array(*map(F.lit, sets)) if sets is not None else F.lit(None)).cast("array<string>").alias("_set"),
            )
            name = named(revision)
            path = f"{self.folder(t)}/delta/{name}"
            try:
                out.write.mode("overwrite").parquet(path)
            except Exception as e:
                if NOT_NULL in str(e):
                    raise AnalysisError(next(x for x in str(e).splitlines() if NOT_NULL in x)) from None
                raise
            first = plain_key(t, F.col(t.key[0]))
            count, low, high = self.spark.read.schema(self.delta_schema(t)).parquet(path).agg(F.count(F.lit(1)), F.min(first), F.max(first)).first()
            if count:
                t.deltas.append((revision, count, sets is None and not (isinstance(op, str) and op == "D"), low, high, name))
            self.catalog.save()
            return count

    def append_mixed(self, t: Table, rows: DataFrame) -> int:
        """Write rows that say themselves, in _op and _seq, what they do."""
        return self.append(t, rows, op=F.col("_op"), seq=F.col("_seq"))

    def compact(self, t: Table, keep: int | None = None, whole: bool = False) -> int:
        """Fold changes up to a revision into new base files, sorted by key; the base's rows.

        Files whose keys no change touches stay, unless the whole table is asked for.
        """
        with self.catalog.lock:
            past = [d for d in t.deltas if d[0] > t.base and (keep is None or d[0] <= keep)]
            if not past:
                return t.base_rows
            known = all(d[3] is not None for d in past)
            every = self.files(t)
            touched = [f for f in every if any(Bounds(d[3], d[4]).meet(f.low, f.high) for d in past)] if known and not whole else every
            rows = sum(d[1] for d in past)
            revision = max(d[0] for d in past)
            first, parts = plain_key(t, F.col(t.key[0])), []
            for s in self.shards(t):
                held = [f for f in s.files if f in touched]
                if held or not all(s.outside(d[3], d[4]) for d in past):
                    view = self.view(t, revision, files=held)
                    parts.append((view.where(s.condition(first)) if t.splits else view, rows + sum(f.rows for f in held)))
            self._replace(t, touched, parts, revision)
            t.base = revision
            t.deltas = [d for d in t.deltas if d[0] > revision]
            self.catalog.save()
            return t.base_rows

    def split(self, t: Table, at: int | float | str) -> int:
        """Let a shard begin at a first key, now and in later compactions; files that hold keys on both sides are rewritten. The base's rows."""
        with self.catalog.lock:
            self.compact(t)
            first = plain_key(t, F.col(t.key[0]))
            for f in [f for f in self.files(t) if f.low is not None and f.low < at and (f.high is None or at <= f.high)]:
                held = self.base(t, files=[f])
                self._replace(t, [f], [(held.where(first < F.lit(at)), f.rows), (held.where(first >= F.lit(at)), f.rows)], self.catalog.next_revision())
            t.splits = sorted({*t.splits, at})
            self.catalog.save()
            return t.base_rows

    def rewrite(self, t: Table) -> None:
        """Write all base files again, with what indexes now ask for."""
        with self.catalog.lock:
            if self.files(t):
                parts = [(self.base(t, files=s.files), sum(f.rows for f in s.files)) for s in self.shards(t) if s.files]
                self._replace(t, self.files(t), parts, self.catalog.next_revision())

    def _replace(self, t: Table, old: list[BaseFile], parts: list[tuple[DataFrame, int]], number: int) -> None:
        """Write frames of so many rows at most, which share no file, as new base files in place of some others."""
        name = named(number)
        path = f"{self.folder(t)}/base/{name}"
        for k, (part, rows) in enumerate(parts):
            files = max(1, -(-rows // ROWS_A_FILE))
            writer = part.repartitionByRange(files, *t.key).sortWithinPartitions(*t.key).write.mode("append" if k else "overwrite")
            for column in {*t.indexes.values(), *t.key}:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer.parquet(path)
        # Old files stay until vacuum(): readers may still use them.
        first = plain_key(t, F.col(t.key[0]))
        made = self.spark.read.schema(t.schema).parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), F.min(first).alias("low"), F.max(first).alias("high"))
        kept = [f for f in self.files(t) if f not in old]
        known = lambda x: None if isinstance(x, float) and x != x else x  # noqa: E731  NaN is above all numbers, so no bound
        every = kept + [BaseFile(r["path"], r["rows"], known(r["low"]), known(r["high"])) for r in made.collect()]  # a row a file
        every.sort(key=lambda f: (f.low is not None, f.low if f.low is not None else 0))
        self.catalog.files.write(f"{self.folder(t)}/manifest/{name}.json", json.dumps([asdict(f) for f in every]))
        t.manifest, t.base_rows = name, sum(f.rows for f in every)
        t.base = t.base or number

    def vacuum(self, t: Table) -> None:
        """Delete files that no committed state refers to."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(t))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        wanted = {"base": {f.path.rsplit("/", 2)[1] for f in self.files(t)}, "delta": {d[5] for d in t.deltas}, "manifest": {f"{t.manifest}.json"}}
        for part, keep in wanted.items():
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder(t)}/{part}")
            if fs.exists(where):
                for status in fs.listStatus(where):
                    if status.getPath().getName() not in keep:
                        fs.delete(status.getPath(), True)
