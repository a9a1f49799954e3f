"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.shared import discard, shared_folder, table_bytes, written

__all__ = ["ascii_lower", "bounded_batches", "broadcast_if_small", "discard", "each_value", "local_tmp", "release_memory", "rows_kept", "shared_folder", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a written table whose files are at most ``limit`` bytes; else leave it to a shuffle join."""
    return F.broadcast(df) if table_bytes(df) <= limit else df


def rows_kept(docs: DataFrame, kept: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """One row of ``docs``, with all its columns, for each (id, mark) of ``kept``; ``mark`` is that of a row.

    Ids may be null or repeat. Rows are met by a semi-join; only those that agree in both with another
    row, which are counted on their keys alone, are folded, in the map task first.
    """
    keys = ["__id", "__null", "__mark"]
    place = lambda i: (F.coalesce(i.cast("long"), F.lit(0).cast("long")), i.isNull())
    keyed = docs.withColumns(dict(zip(keys, (*place(F.col(id_col)), mark), strict=True)))
    wanted = kept.select(*(c.alias(k) for c, k in zip((*place(F.col("id")), F.col("mark")), keys, strict=True)))
    met = keyed.join(wanted, keys, "left_semi")
    repeated = written(keyed.select(*keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "repeated-rows")
    if not repeated.isEmpty():
        folded = keyed.join(repeated, keys, "left_semi").dropDuplicates(keys).join(wanted, keys, "left_semi")
        met = met.join(repeated, keys, "left_anti").unionByName(folded)
    return met.select(docs.columns)


def bounded_batches(spark: SparkSession, limit: int = 16 << 20) -> None:
    """Have Spark cut the Arrow batches of this session's Python functions at ``limit`` bytes as well as by rows.
    A smaller setting of the session's own stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES)) > limit:
        spark.conf.set(_BATCH_BYTES, str(limit))


def each_value(column: pa.Array, step: int = 512) -> Iterator[Any]:
    """A column's values one by one; only ``step`` of them are Python objects at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def release_memory() -> None:
    """Give back what a finished task has freed: its Python worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def local_tmp() -> str:
    """A folder for the spill files of the task that calls this, among Spark's own local folders where
    the executor names them; the caller removes it."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.mkdtemp(prefix="spill-", dir=local if local and os.access(local, os.W_OK) else None)
