"""What driver and executors share: a folder, tables in it, and this package."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Where that is unset a local one is made in local
    mode; on a cluster, whose executors share no local folder, it's an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends in here are removed with it: its rows are in a table then."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs a reread of the files, not a rerun of the
    steps before.
    """
    path = shared_folder(df.sparkSession, tag)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables from ``written`` that nothing reads any more. What the rows that an operator
    returns are read from stays, for whoever cleans spark.checkpoint.dir."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_path"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def range_count(df: DataFrame, parts: int | None) -> int:
    """``parts``, or as many ranges as the session has shuffle partitions, which grow with the cluster."""
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table from ``written``, by the scan's own statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="rankloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package shipped to its session's executors first."""

    @wraps(query)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        ship(spark)
        return query(spark, *args, **options)

    return run
