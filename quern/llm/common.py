"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only in a local session, where that
    may be unset, a folder of our own takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, the tables that :func:`materialize` writes meanwhile, but for those that stay."""
    _scratch.append([])
    try:
        yield
    finally:
        for table in _scratch.pop():
            discard(table)


def materialize(df: DataFrame, name: str = "t", codec: str = "zstd", stays: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back, which cuts its lineage.

    A table that ``stays`` outlives the innermost :func:`scratch`, not one around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if _scratch[stays:]:
        _scratch[-1 - stays].append(out)
    return out


def settled(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For functions that write tables on their way: their result is written too, and those tables go."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(*args: Any, **kwargs: Any) -> DataFrame:
            with scratch():
                return materialize(f(*args, **kwargs), name, stays=True)

        return run

    return wrap


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """Hint a broadcast if the frame has at most ``rows`` rows, else leave the join to shuffle.

    ``weight`` is what a row counts, where rows hold arrays.
    """
    n = df.limit(rows + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= rows else df


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Split Arrow batches so that ``column`` holds about ``limit`` bytes a slice (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = min(len(batch), int(np.searchsorted(ends, before + limit)) + 1)
            part = batch.slice(start, stop - start)
            yield part, part.column(column).to_pylist()
            start = stop


_kept: list[tuple[Hashable, Any]] = []


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    """Something that a Python worker keeps from task to task: one thing at a time, so stages don't add up."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


#: Maps the bytes A-Z to a-z and leaves all others.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
