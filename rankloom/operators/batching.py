"""Request grouping, packing to batches and padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from rankloom.functions.encode import mix64, unsigned_order
from rankloom.functions.sequence import length_bucket, padded
from rankloom.sources.shared import range_count, written

#: The largest batch.
LONGEST_BATCH = 8192


def first_per_request(df: DataFrame, request: list[str], order: list[str]) -> DataFrame:
    """The first row of each request in physical order, even if payloads differ."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*request).orderBy(*order))).where("__r = 1").drop("__r")


def grouped_order(df: DataFrame, request: list[str], position: str) -> DataFrame:
    """Adds first_position of the request; sorted by it and position, requests lie together in the
    order in which they first appear."""
    return df.withColumn("first_position", F.min(position).over(Window.partitionBy(*request)))


def representative(df: DataFrame, request: list[str], position: str) -> DataFrame:
    """Adds the position of the request's first row."""
    return df.withColumn("representative", F.min(position).over(Window.partitionBy(*request)))


def _request_mix(df: DataFrame, request: list[str], seed: int) -> Column:
    """A mix of the seed and the request's columns; whole numbers go in as they are, other types by their hash."""
    out = F.lit(seed).cast("long")
    for c in request:
        whole = df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")
        out = mix64(out.bitwiseXOR(F.coalesce(F.col(c).cast("long") if whole else F.xxhash64(c), F.lit(-1).cast("long"))))
    return out


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of two inputs, null being equal to null; an equi-join for Spark."""
    same = F.lit(True)
    for c in keys:
        same = same & left[c].eqNullSafe(right[c])
    return same


def shuffled(df: DataFrame, request: list[str], position: str, seed: int, buffer: int | None = None) -> DataFrame:
    """Deterministic order by a mix of seed and request; rows of a request stay together. A buffer of
    at most ``buffer`` rows is shuffled at a time, filled by whole requests in the order in which they
    first appear: one that doesn't fit opens the next, and one of more rows is a buffer of its own.
    0 keeps the order, and without it the whole is shuffled. Adds shuffle_block and shuffle_key,
    which give the order."""
    key = _request_mix(df, request, seed)
    if buffer is None:
        return df.withColumn("shuffle_block", F.lit(0).cast("long")).withColumn("shuffle_key", key).orderBy("shuffle_key", *request, position)
    groups = df.groupBy(*request).agg(F.min(position).alias("__first"), F.count("*").alias("__rows"), F.lit(0).alias("__all"))
    if buffer:
        blocks = packed(groups, ["__all"], ["__first", *request], "__rows", buffer, max(buffer, LONGEST_BATCH), whole=True).select(*request, F.col("batch").alias("shuffle_block"))
    else:
        blocks = slices(groups, [], ["__first", *request], 1).select(*request, F.col("slice").alias("shuffle_block"))
    rows = df.join(blocks, null_safe(df, blocks, request)).select(df["*"], "shuffle_block")
    return rows.withColumn("shuffle_key", key if buffer else F.lit(0).cast("long")).orderBy("shuffle_block", "shuffle_key", *request, position)


def shuffled_rows(df: DataFrame, row: str, seed: int) -> DataFrame:
    """Adds the place from 0 of each row in an order by the unsigned mix of its number and a seed, as
    ranges are numbered; rows that repeat a number follow each other."""
    keyed = df.withColumn("__h", unsigned_order(mix64(F.col(row).bitwiseXOR(F.lit(seed).cast("long")))))
    return slices(keyed, [], ["__h", row], 1).withColumnRenamed("slice", "place").drop("__h")


def _ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None) -> DataFrame:
    """The rows in ``parts`` ranges of keys and order, as many as the session has shuffle partitions by
    default, each with its number, as a table: what follows reads the same ranges however often it
    reads them."""
    return written(df.repartitionByRange(range_count(df, parts), *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def slices(df: DataFrame, keys: list[str], order: list[str], n: int, parts: int | None = None) -> DataFrame:
    """Adds the number of the row's slice of n rows within its shard or bucket. Rows are numbered in
    ranges, from the counts of the ranges before, so no task has all rows of a bucket."""
    ranged = _ranged(df, keys, order, parts)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    numbered = ranged.withColumn("__row", own).join(before, [*keys, "__part"])
    return numbered.withColumn("slice", F.floor((F.col("__before") + F.col("__row") - 1) / n).cast("long")).drop("__part", "__row", "__before")


class NextFit:
    """Next-fit from several fills at once: batches closed so far and rows in the open one."""

    def __init__(self, used: np.ndarray, whole: bool = False) -> None:
        self.used, self.closed, self.whole = used.astype(np.int64), np.zeros(len(used), np.int64), whole

    def put(self, n: int, limit: int) -> np.ndarray:
        """The batch in which a group of n rows starts; what is left of an oversize one stays open, or
        is a batch of its own with the whole group."""
        full = (self.used > 0) & (self.used + n > limit)
        self.closed += full
        self.used = np.where(full, 0, self.used)
        at = self.closed.copy()
        if self.whole and n > limit:
            self.closed = self.closed + 1
            return at
        more, rest = divmod(self.used + n, limit)
        self.closed, self.used = self.closed + more, rest
        return at


class FillMap:
    """What a range of groups makes of each fill on entry. Fills that have come to the same state go on
    as one, so a range soon costs a few numbers for each group."""

    def __init__(self, limit: int, whole: bool) -> None:
        self.fit, self.own, self.steps = NextFit(np.arange(limit), whole), np.arange(limit), 0

    def put(self, n: int, limit: int) -> None:
        self.fit.put(n, limit)
        self.steps += 1
        if self.steps % 16 == 0 and len(self.fit.used) > 1:
            _, first, own = np.unique(self.fit.closed * limit + self.fit.used, return_index=True, return_inverse=True)
            self.fit.used, self.fit.closed, self.own = self.fit.used[first], self.fit.closed[first], own[self.own]

    def steps_of(self) -> list[np.ndarray]:
        """(first fill, fill on exit, batches closed) of each run of fills that end alike."""
        used, closed = self.fit.used[self.own], self.fit.closed[self.own]
        starts = np.append(0, np.nonzero((used[1:] != used[:-1]) | (closed[1:] != closed[:-1]))[0] + 1)
        return [starts, used[starts], closed[starts]]


_MAP = ["__from", "__used", "__closed"]


def _transfer(keys: int, longest: int, whole: bool):
    """Rows (part, *keys, n, limit) sorted by range give the range's map for each key in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fills, first = None, None, None

        def row() -> pa.RecordBatch:
            found = [pa.array([x], pa.list_(pa.int64())) for x in fills.steps_of()]
            return pa.RecordBatch.from_arrays([*first.columns[: keys + 1], *found], [*first.schema.names[: keys + 1], *_MAP])

        for batch in batches:
            for i, (*own, n, limit) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if own != key:
                    if key is not None:
                        yield row()
                    key, fills, first = own, FillMap(min(limit, longest), whole), batch.slice(i, 1)
                fills.put(n, limit)
        if key is not None:
            yield row()

    return run


def _starts(keys: int):
    """Maps (*keys, part, from, used, closed) sorted by key and range give the fill and the batch with
    which each range begins: a stream that holds one map at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used, first = None, 0, 0
        for batch in batches:
            fills, firsts = [], []
            for *own, _, begins, after, closed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    key, used, first = own, 0, 0
                fills.append(used)
                firsts.append(first)
                k = int(np.searchsorted(begins, used, "right")) - 1
                used, first = after[k], first + closed[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], pa.array(fills, pa.int64()), pa.array(firsts, pa.int64())], [*batch.schema.names[: keys + 1], "__fill", "__opened"])

    return run


def _placed(columns: int, whole: bool):
    """Rows (*columns, part, *keys, n, limit, fill, first) sorted by range give the parts: batch, offset, rows, slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fit = None, None
        for batch in batches:
            index, parts = [], []
            for i, (*own, n, limit, fill, first) in enumerate(zip(*(c.to_pylist() for c in batch.columns[columns:]), strict=True)):
                if own != key:
                    key, fit = own, NextFit(np.array([fill]), whole)
                    fit.closed += first
                before = int(fit.used[0])
                begin = int(fit.put(n, limit)[0])
                slot = before if before + n <= limit else 0
                for k in range(-(-n // limit) if n > limit and not whole else int(n > 0)):
                    index.append(i)
                    parts.append((begin + k, k * limit, n if whole else min(n - k * limit, limit), 0 if k else slot))
            own = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(own) for c in batch.columns[:columns]), *(pa.array([x[j] for x in parts], pa.int64()) for j in range(4))], [*batch.schema.names[:columns], "batch", "offset", "rows", "slot"])

    return run


def packed(groups: DataFrame, keys: list[str], order: list[str], size: str, batch: int | Column, longest: int = LONGEST_BATCH, parts: int | None = None, whole: bool = False) -> DataFrame:
    """Next-fit packing of ordered request groups, within each of ``keys`` (shard, bucket).

    A group that doesn't fit closes the batch; an oversize one is split in full batches and a rest
    that starts the next, or with ``whole`` is a batch by itself; a full batch closes. One row per part:
    batch, offset (in its group), rows, slot (its first row's place in the batch).

    A range of the order is a map from its fill on entry to its fill on exit and the batches that it
    closes. A key's maps are read in order as a stream, which gives the fill with which each range
    begins; then each is packed as a stream. So a shard's packing is spread over tasks, and none
    holds its groups or its maps. ``batch`` is one number for each key and at most ``longest``; null sizes
    count as 0, and a null or not positive batch is an error."""
    limit = (F.lit(batch) if isinstance(batch, int) else batch).cast("long")
    sound = (limit > 0) & (limit <= longest)
    checked = F.when(F.coalesce(sound, F.lit(False)), limit).otherwise(F.raise_error(F.lit(f"a batch has 1 to {longest} rows")).cast("long"))
    rows = groups.withColumn("__n", F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long")).withColumn("__limit", checked)
    ranged = _ranged(rows, keys, order, parts)
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    own = ["__part", *keys]
    head = ", ".join(f"`{c}` {kinds[c]}" for c in own)
    stream = lambda df: df.repartition("__part").sortWithinPartitions(*own, *order)
    maps = stream(ranged.select(*own, *(c for c in order if c not in own), "__n", "__limit")).select(*own, "__n", "__limit").mapInArrow(_transfer(len(keys), longest, whole), f"{head}, {', '.join(f'{c} array<bigint>' for c in _MAP)}")
    tail = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "__part"))
    in_order = maps.select(*keys, "__part", *_MAP).repartition(*keys).sortWithinPartitions(*keys, "__part")
    starts = written(in_order.mapInArrow(_starts(len(keys)), f"{tail}, __fill bigint, __opened bigint"), "starts")
    names = groups.columns
    met = ranged.join(starts, null_safe(ranged, starts, own)).select(ranged["*"], "__fill", "__opened")
    placed = stream(met).select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)), *own, "__n", "__limit", "__fill", "__opened")
    kept = ", ".join(f"`__c{i}` {kinds[c]}" for i, c in enumerate(names))
    found = placed.mapInArrow(_placed(len(names), whole), f"{kept}, batch bigint, offset bigint, rows bigint, slot bigint")
    return found.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)), "batch", "offset", "rows", "slot")


def batch_rows(parts: DataFrame, rows: DataFrame, request: list[str], position: str) -> DataFrame:
    """The candidates of packed request groups with the columns of their batch (all of ``parts`` that
    rows lack) and their slot in it, each in exactly one batch.

    A part lists the positions that it has, so rows meet it by an equality of request and position:
    no part is compared with rows of others, and a request of very many rows is spread over tasks."""
    more = [c for c in parts.columns if c not in (*request, "offset", "rows", "slot") and c not in rows.columns]
    places = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)
    spread = parts.where("rows > 0").select(*request, *more, "offset", "slot", F.explode(places).alias("__i"))
    spread = spread.select(*request, *more, (F.col("slot") + F.col("__i")).alias("slot"), (F.col("offset") + F.col("__i")).alias(position))
    return rows.join(spread, null_safe(rows, spread, [*request, position])).select(rows["*"], *(spread[c] for c in (*more, "slot")))


def write_batches(rows: DataFrame, path: str, keys: list[str], slot: str = "slot") -> None:
    """Writes batches as Parquet so that each lies in one file, whole and in order of its slots; ``keys``
    name a batch (shard, bucket, batch), and all but the last are folders."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, slot)
    ordered.write.partitionBy(*keys[:-1]).parquet(path)


def bucketed(groups: DataFrame, work: str, bounds: list[int]) -> DataFrame:
    """Adds the length bucket of each group's work."""
    return groups.withColumn("bucket", length_bucket(F.col(work), bounds))


def packed_by_length(groups: DataFrame, keys: list[str], order: list[str], size: str, work: str, bounds: list[int], batches: list[int], ratio: float = 1.0) -> DataFrame:
    """Length-bucketed packing: each bucket has its own batch size, scaled by ``ratio``."""
    sizes = F.array(*(F.lit(max(1, int(b * ratio))) for b in batches))
    return packed(bucketed(groups, work, bounds), [*keys, "bucket"], order, size, F.get(sizes, F.col("bucket")))


def padded_batches(df: DataFrame, batch: list[str], column: str, fill: int | float = 0) -> DataFrame:
    """Sequences padded to the longest of their batch, with length and has_sequence."""
    n = F.size(column)
    wide = df.withColumn("width", F.max(n).over(Window.partitionBy(*batch)))
    fill = F.lit(fill).cast(df.schema[column].dataType.elementType)
    return wide.withColumn("length", n).withColumn("has_sequence", n > 0).withColumn(column, padded(F.col(column), F.col("width"), fill))


def padding_ratio(df: DataFrame, batch: list[str], length: str) -> DataFrame:
    """Rows, tokens and share of padding of each batch."""
    out = df.groupBy(*batch).agg(F.count("*").alias("rows"), F.sum(length).cast("long").alias("tokens"), (F.max(length) * F.count("*")).cast("long").alias("cells"))
    return out.withColumn("padding", F.round(F.when(F.col("cells") > 0, 1 - F.col("tokens") / F.col("cells")).otherwise(0.0), 9))


def _apart(a: Column, b: Column, kind: DataType) -> Column:
    """Where below them two values first differ, as a path; empty at the value itself, null if they are equal."""
    out = F.when(a.eqNullSafe(b), F.lit(None).cast("string")).when(a.isNull() | b.isNull(), "")
    if isinstance(kind, StructType):
        inner = [F.concat(F.lit(f".{f.name}"), _apart(a[f.name], b[f.name], f.dataType)) for f in kind.fields]
        return out.otherwise(F.coalesce(*inner, F.lit("")))
    if isinstance(kind, ArrayType):
        at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int") - 1
        inner = F.concat(F.lit("["), at.cast("string"), F.lit("]"), F.coalesce(_apart(F.get(a, at), F.get(b, at), kind.elementType), F.lit("")))
        return out.when(F.size(a) != F.size(b), ".length").otherwise(inner)
    return out.otherwise("")


def _digests(df: DataFrame, keys: list[str], columns: list[str], parts: int) -> DataFrame:
    """Rows, sum and parity of the rows' hashes for each part of the keys' hashes. Rows are hashed as text,
    as a hash of nested values skips nulls and empty lists."""
    whole = F.xxhash64(F.to_json(F.struct(*keys, *columns), {"ignoreNullFields": "false"}))
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.sum(whole.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), whole)).alias("parity"))


def differing_parts(left: DataFrame, right: DataFrame, keys: list[str], parts: int = 4096) -> DataFrame:
    """Parts of the keys in which two inputs differ, by digests alone: no row of theirs is shuffled."""
    columns = sorted(c for c in left.columns if c not in keys)
    a, b = (_digests(df, keys, columns, parts) for df in (left, right))
    same = a["n"].eqNullSafe(b["n"]) & a["sum"].eqNullSafe(b["sum"]) & a["parity"].eqNullSafe(b["parity"])
    return a.join(b, a["part"] == b["part"], "full_outer").where(~same).select(F.coalesce(a["part"], b["part"]).alias("part"))


def differences(left: DataFrame, right: DataFrame, keys: list[str], parts: int = 4096) -> DataFrame:
    """Rows that two pipelines don't share, by key: only_left, only_right, or the path of the first value
    that differs, such as ``click[3].id``.

    Digests of parts of the keys are compared first, and only rows of parts that differ are joined, of
    equal inputs none. Keys name a row; the inputs have the same columns."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("the inputs' columns differ")
    columns = [c for c in left.columns if c not in keys]
    differ = written(differing_parts(left, right, keys, parts), "differing-parts")
    own = lambda df: df.where(F.pmod(F.xxhash64(*keys), F.lit(parts)).isin(sorted(r["part"] for r in differ.collect())))
    a = own(left).select(*keys, F.struct(*columns).alias("a"), F.lit(True).alias("in_a"))
    b = own(right).select(*(F.col(c).alias(f"__{c}") for c in keys), F.struct(*columns).alias("b"), F.lit(True).alias("in_b"))
    same = F.lit(True)
    for c in keys:
        same = same & a[c].eqNullSafe(b[f"__{c}"])
    joined = a.join(b, same, "full_outer")
    path = F.substring(_apart(F.col("a"), F.col("b"), a.schema["a"].dataType), 2, 1 << 20)
    first = F.when(F.col("in_a").isNull(), "only_right").when(F.col("in_b").isNull(), "only_left").otherwise(path)
    either = [F.when(F.col("in_a").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in keys]
    return joined.select(*either, first.alias("difference")).where("difference IS NOT NULL")


def union_of(inputs: dict[str, DataFrame]) -> DataFrame:
    """The rows of several inputs, by column name; inputs whose columns or types differ are an error that
    names the first of them."""
    (first, out), *rest = inputs.items()
    kinds = {f.name: f.dataType for f in out.schema.fields}
    for name, df in rest:
        other = {f.name: f.dataType for f in df.schema.fields}
        apart = sorted(c for c in kinds.keys() | other.keys() if kinds.get(c) != other.get(c))
        if apart:
            raise ValueError(f"{name} and {first} differ in {', '.join(apart)}")
        out = out.unionByName(df)
    return out


def keys_apart(left: DataFrame, right: DataFrame, keys: list[str], shared: bool = False) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks, or with ``shared`` has too; null equals null."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, null_safe(a, b, keys), "left_semi" if shared else "left_anti")
