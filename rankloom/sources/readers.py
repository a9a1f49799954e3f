"""Reading inputs: splits, windows, manifests, schema checks, failure budgets."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from rankloom.operators.batching import slices
from rankloom.sources.shared import range_count, written


def read_split(spark: SparkSession, inputs: list[str], columns: list[str], optional: list[str] | None = None) -> DataFrame:
    """Parquet files, folders, globs or addresses; optional columns only where they are there."""
    df = spark.read.parquet(*inputs)
    return df.select(*columns, *(c for c in optional or [] if c in df.columns))


def hour_window(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Partitions pt=YYYY-MM-DD, hr=HH from ``start`` inclusive to ``end`` exclusive, by pruning."""
    if end <= start:
        raise ValueError("the window is empty")
    days: dict[str, list[int]] = {}
    at = start
    while at < end:
        days.setdefault(at.strftime("%Y-%m-%d"), []).append(at.hour)
        at += timedelta(hours=1)
    pt, hr = F.col("pt").cast("string"), F.col("hr").cast("int")
    whole = [d for d, h in days.items() if len(h) == 24]
    condition = pt.isin(whole) if whole else F.lit(False)
    for d, h in days.items():
        if len(h) < 24:
            condition = condition | (pt == d) & hr.isin(h)
    return df.where(condition)


def default_test_window(train_end: datetime) -> tuple[datetime, datetime]:
    """The calendar day after the day on which training ends."""
    last: date = (train_end - timedelta(microseconds=1)).date()
    start = datetime(last.year, last.month, last.day) + timedelta(days=1)
    return start, start + timedelta(days=1)


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (partitions, files or ids) that both inputs have; disjoint inputs have none."""
    return train.select(*keys).intersect(test.select(*keys))


def check_disjoint(train: DataFrame, test: DataFrame, keys: list[str]) -> None:
    if overlap(train, test, keys).limit(1).count():
        raise ValueError("train and test inputs overlap")


def evenly_spaced(df: DataFrame, key: str, limit: int) -> DataFrame:
    """``limit`` distinct keys at even distances in sorted order, both ends included; the middle one
    for limit 1. Keys are numbered in ranges, from the counts of the ranges before, and the wanted
    places are found by equality."""
    keys = slices(df.select(key).distinct(), [], [key], 1).withColumnRenamed("slice", "at")
    keys = written(keys.select(key, "at"), "numbered")
    last = keys.agg((F.count("*") - 1).alias("last"))
    if limit == 1:
        wanted = last.select(F.floor(F.col("last") / 2).alias("at"))
    else:
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("last"), F.lit(limit - 1).cast("long")))).alias("i")
        place = F.when(F.col("last") >= limit, F.floor(F.col("i") * F.col("last") / (limit - 1))).otherwise(F.col("i"))
        wanted = last.where("last >= 0").select("last", i).select(place.alias("at")).distinct()
    return keys.join(wanted, "at").select(key)


def freeze_manifest(df: DataFrame, key: str, limit: int, path: str) -> None:
    """Write the chosen keys; an empty choice is an error."""
    chosen = evenly_spaced(df, key, limit)
    if not chosen.limit(1).count():
        raise ValueError("the held-out set is empty")
    chosen.write.mode("errorifexists").parquet(path)


def held_out(df: DataFrame, key: str, manifest: DataFrame) -> DataFrame:
    """Rows of the frozen keys. Spark broadcasts the manifest if its size allows."""
    return df.join(manifest, key, "left_semi")


def with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("input_file", F.col("_metadata.file_path"))


def first_files(df: DataFrame, n: int, key: str = "input_file") -> DataFrame:
    """Rows of the first n files in path order."""
    files = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(files, key, "left_semi")


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order; a top-k in each task, so the whole isn't sorted."""
    return df.orderBy(*order).limit(n)


def split_statistics(df: DataFrame, candidates: str, file: str = "input_file") -> DataFrame:
    """Files, raw rows, flat rows of nested rows."""
    return df.agg(F.countDistinct(file).alias("files"), F.count("*").alias("rows"), F.sum(F.coalesce(F.size(candidates), F.lit(0))).cast("long").alias("flat_rows"))


def renamed(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names; two candidates for one name are an error."""
    found = {}
    for name, options in aliases.items():
        have = [c for c in dict.fromkeys([name, *options]) if c in df.columns]
        if len(have) > 1:
            raise ValueError(f"ambiguous alias for {name}: {have}")
        if have and have[0] != name:
            found[have[0]] = name
    return df.withColumnsRenamed(found)


def _store(address: str):
    """The file system and path of an address as Spark writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address)


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Footers of the files with these addresses, read where they lie: of each its last bytes only."""
    import pyarrow.parquet as pq

    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["file", "rows", "group_rows", "column", "type", "bytes", "error"]
    for batch in batches:
        rows: list[tuple] = []
        for address in batch.column(0).to_pylist():
            try:
                store, path = _store(address)
                with store.open_input_file(path) as source:
                    meta = pq.read_metadata(source)
            except (OSError, pa.ArrowException) as e:
                rows.append((address, None, None, None, None, None, type(e).__name__))
                continue
            schema = meta.schema.to_arrow_schema()
            sizes: dict[str, int] = {}
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    column = meta.row_group(g).column(c)
                    name = column.path_in_schema.split(".")[0]
                    sizes[name] = sizes.get(name, 0) + column.total_compressed_size
            groups = [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]
            rows += [(address, meta.num_rows, groups, f.name, str(f.type), sizes.get(f.name, 0), None) for f in schema]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def footers(spark: SparkSession, path: str, suffix: str = "*.parquet", sample: int | None = None) -> DataFrame:
    """One row per file and column: rows, group_rows, column, type, compressed bytes; a file whose
    footer can't be read has one row with the error. Spark lists the files; contents aren't loaded.
    With ``sample`` only that many files, the ones with the smallest hash of their path, are looked at."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path).select("path")
    if sample is not None:
        files = files.orderBy(F.xxhash64("path"), "path").limit(sample).repartition(max(1, min(sample, 64)))
    return files.mapInArrow(_footers, "file string, rows long, group_rows array<long>, column string, type string, bytes long, error string")


def schema_report(found: DataFrame) -> DataFrame:
    """(fingerprint, files) of the schemas of readable files; more than one row means they differ."""
    by_file = found.where("error IS NULL").groupBy("file").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("column", "type")))), 256).alias("fingerprint"))
    return by_file.groupBy("fingerprint").agg(F.count("*").alias("files"))


def projected_bytes(found: DataFrame, columns: list[str]) -> DataFrame:
    """Compressed bytes of the projected columns by file."""
    return found.where(F.col("column").isin(columns)).groupBy("file").agg(F.sum("bytes").alias("bytes"))


BEYOND = "can't be read; the budget is"
_FAULT = "struct<file:string,group:int,rows:bigint,error:string>"


def _read_groups(schema: pa.Schema, on_failure: str, most_groups: int | None, most_rows: int | None, retries: int, pause: float):
    """Rows (file, group, rows, error) give the group's rows with a null fault, or one row with its fault."""
    import pyarrow.parquet as pq

    data, fault = list(schema)[:-1], schema.field(len(schema) - 1)

    def opened(address: str, group: int) -> Iterator[pa.RecordBatch]:
        for tried in range(retries + 1):
            try:
                store, path = _store(address)
                source = store.open_input_file(path)
                break
            except OSError:
                if tried == retries:
                    raise
                time.sleep(pause * 2**tried)
        with source:
            file = pq.ParquetFile(source, page_checksum_verification=True)
            have = set(file.schema_arrow.names)
            for batch in file.iter_batches(8192, row_groups=[group], columns=[f.name for f in data if f.name in have]):
                columns = [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in data]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(batch.num_rows, fault.type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost_groups = lost_rows = 0
        for batch in batches:
            for address, group, rows, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                given = 0
                if error is None:
                    try:
                        for found in opened(address, group):
                            yield found
                            given += found.num_rows
                        continue
                    except (OSError, pa.ArrowException) as e:
                        error = type(e).__name__
                if on_failure == "fail":
                    raise OSError(f"row group {group} of {address} can't be read: {error}")
                lost_groups, lost_rows = lost_groups + 1, lost_rows + (rows or 0) - given
                if most_groups is not None and lost_groups > most_groups or most_rows is not None and lost_rows > most_rows:
                    raise ValueError(f"{lost_rows} rows {BEYOND} {most_rows}" if most_rows is not None and lost_rows > most_rows else f"{lost_groups} groups {BEYOND} {most_groups}")
                one = {"file": address, "group": group, "rows": None if rows is None else rows - given, "error": error}
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in data), pa.array([one], fault.type)], schema=schema)

    return run


class Losses:
    """What a read by row groups has lost, known once an action has read all of its rows."""

    def __init__(self, most_files: int | None, most_rows: int | None, most_groups: int | None) -> None:
        self.budgets = {"files": most_files, "rows": most_rows, "groups": most_groups}
        self.seen = Observation()

    def found(self) -> dict[str, int]:
        """Lost files (those with a fault), rows and groups."""
        got = self.seen.get
        return {"files": len(got["files"] or []), "rows": got["rows"] or 0, "groups": got["groups"] or 0}

    def check(self) -> None:
        """An error if more is lost than a budget allows."""
        for name, lost in self.found().items():
            if self.budgets[name] is not None and lost > self.budgets[name]:
                raise ValueError(f"{lost} {name} {BEYOND} {self.budgets[name]}")


def _struct(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _groups_of(spark: SparkSession, path: str, schema: StructType, on_failure: str, most_rows: int | None, most_groups: int | None, retries: int, pause: float) -> DataFrame:
    """The rows of all row groups, and a row for each fault, by a column ``__fault``."""
    told = footers(spark, path).groupBy("file").agg(F.first("group_rows").alias("groups"), F.max("error").alias("error"))
    known = told.select("file", F.posexplode_outer("groups").alias("group", "rows"), "error").where(F.col("group").isNotNull() | F.col("error").isNotNull())
    whole = StructType([*schema.fields, StructField("__fault", StructType.fromDDL(f"f {_FAULT}")[0].dataType)])
    dealt = known.repartition(range_count(known, None), "file", "group")
    return dealt.mapInArrow(_read_groups(to_arrow_schema(whole), on_failure, most_groups, most_rows, retries, pause), whole)


def read_groups(spark: SparkSession, path: str, schema: str | StructType, on_failure: str = "skip", most_files: int | None = None, most_rows: int | None = None, most_groups: int | None = None, retries: int = 2, pause: float = 0.5) -> tuple[DataFrame, Losses]:
    """The rows of Parquet files read a row group at a time, and what is lost of them.

    Footers are read by tasks, and (file, row group) is what is dealt out to tasks, so a large file is
    spread and the driver plans no groups. Only the schema's columns are read; one that a file lacks is
    null. A group that can't be read loses what it hasn't given, no other group and no other file,
    and is reported by the same pass: ``Losses.found`` and ``check`` tell once an action has read all.
    ``on_failure="fail"`` stops at the first fault; a task stops once it alone exceeds a budget. Opening
    is tried again ``retries`` times, with pauses that double."""
    losses = Losses(most_files, most_rows, most_groups)
    rows = _groups_of(spark, path, _struct(schema), on_failure, most_rows, most_groups, retries, pause)
    fault = F.col("__fault")
    seen = rows.observe(losses.seen, F.count(fault).alias("groups"), F.sum(fault["rows"]).alias("rows"), F.collect_set(fault["file"]).alias("files"))
    return seen.where(fault.isNull()).drop("__fault"), losses


def read_losses(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """(file, rows, lost_rows, lost_groups, error) by file: what the footer promises, and how much of it
    can't be read. A file without a readable footer has its error and unknown losses."""
    told = footers(spark, path).groupBy("file").agg(F.max("rows").alias("rows"), F.max("error").alias("error"))
    faults = _groups_of(spark, path, _struct(schema), "skip", None, None, 0, 0.0).where("__fault IS NOT NULL")
    lost = faults.groupBy(F.col("__fault.file").alias("file")).agg(F.sum("__fault.rows").alias("lost"), F.count("__fault.group").alias("groups"), F.max("__fault.error").alias("first"))
    joined = told.join(lost, "file", "left")
    known = F.col("rows").isNotNull()
    return joined.select("file", "rows", F.when(known, F.coalesce("lost", F.lit(0))).alias("lost_rows"), F.when(known, F.coalesce("groups", F.lit(0))).cast("int").alias("lost_groups"), F.coalesce("error", "first").alias("error"))


def read_with_budget(spark: SparkSession, path: str, schema: str | StructType, most_files: int, most_rows: int | None = None, most_groups: int | None = None) -> DataFrame:
    """Rows that can be read, as a table that they are written to as they are read, once; more files
    with a fault than ``most_files``, or more lost rows or row groups than their budgets, are an error."""
    rows, losses = read_groups(spark, path, schema, most_files=most_files, most_rows=most_rows, most_groups=most_groups)
    try:
        found = written(rows, "read")
    except PythonException as e:
        if BEYOND in str(e):  # a task alone was beyond a budget
            raise ValueError(next(x for x in str(e).splitlines() if BEYOND in x).strip()) from e
        raise
    losses.check()
    return found


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Sample rows from files that hold a JSON array of objects."""
    return spark.read.option("multiLine", "true").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines, one object per row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def nested_report(tables: dict[str, DataFrame], by: str = "field") -> DataFrame:
    """One row with a JSON object: of each named profile table the rows by field, or a list of its rows
    where it has no such column. Profile tables have a few rows a field, so they fit a row."""
    parts = None
    for name, df in tables.items():
        row = F.struct(*(c for c in df.columns if c != by))
        if by in df.columns:
            own = df.groupBy(F.col(by).cast("string").alias("k")).agg(F.collect_list(row).alias("v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("v"))
        else:
            own = df.agg(F.collect_list(row).alias("v"))
        one = own.select(F.to_json("v").alias("v"), F.lit(name).alias("name"))
        parts = one if parts is None else parts.unionByName(one)
    text = F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(":"), F.col("v"))
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(text)), ","), F.lit("}")).alias("report"))
