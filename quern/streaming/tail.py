"""Change feeds and live tails over the log of changes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.catalog import Table
from quern.sources.tables import Storage

LONGEST_INTERVAL = 30.0


def change_stream(storage: Storage, t: Table) -> DataFrame:
    """A stream of a table's change rows as they are written, with their revision and whether they delete.

    A revision that a crash left uncommitted is in the folder and in the stream; :func:`committed` tells.
    """
    path = f"{storage.folder(t)}/delta/*"
    return storage.spark.readStream.schema(storage.delta_schema(t)).parquet(path)


def committed(storage: Storage, t: Table, revisions: DataFrame) -> DataFrame:
    """Of a batch of change rows, those whose revision the catalog knows; for use in ``foreachBatch``.

    Rows of a crashed statement whose revision number was used again, or was compacted, are not told apart.
    """
    known = {d[0] for d in t.deltas}
    return revisions.where((F.col("_rev") <= t.base) | F.col("_rev").isin(*known) if known else F.col("_rev") <= t.base)


def watch(storage: Storage, kv: Table, prefix: str = "") -> DataFrame:
    """A stream (rev, key, value, is_delete) of the changes to keys with a prefix."""
    rows = change_stream(storage, kv).where(F.col("key").startswith(prefix))
    return rows.select(F.col("_rev").alias("rev"), "key", "value", (F.col("_op") == "D").alias("is_delete"))


def tail(run: Callable[[], DataFrame], interval: float = 2.0, frames: int | None = None) -> Iterator[list]:
    """Run a query again and again and yield its rows; every ``interval`` seconds, 30 at most."""
    k = 0
    while frames is None or k < frames:
        if k:
            time.sleep(min(interval, LONGEST_INTERVAL))
        yield run().collect()
        k += 1


def bucket_counts(events: DataFrame, time_column: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Extension: counts in tumbling windows of event time, for a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark(time_column, late)
    keys = [F.window(time_column, width).alias("w"), *([F.col(by)] if by else [])]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), *([by] if by else []), "n")
