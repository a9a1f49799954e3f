"""Synthetic nested rows, from ranges and a 64-bit mix, so they are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.encode import mix64


def hashed(*parts: Column) -> Column:
    """A non-zero hashed value from a few small numbers."""
    out = F.lit(1).cast("long")
    for p in parts:
        out = mix64(out.bitwiseXOR(mix64(p.cast("long").bitwiseXOR(F.lit(0x5DEECE66D).cast("long")))))
    return F.when(out == 0, F.lit(1).cast("long")).otherwise(out)


def agg_rows(spark: SparkSession, rows: int, requests: int, candidates: int, events: int, shared: float = 0.5, bag: int = 3, scenes: int = 4) -> DataFrame:
    """Rows of ``requests`` requests with ``candidates`` candidates each and one history: the first
    ``shared`` part of the events is seen by all requests, the rest by one each in turn."""
    r, c, e = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (requests, requests * candidates, events))
    row = F.col("row")
    base = F.lit(1_700_000_000_000).cast("long") + row * 1000
    common = int(events * shared)
    members = lambda i: F.when(i < common, F.transform(r, lambda x: x.cast("long"))).otherwise(F.array((i % requests).cast("long")))
    return spark.range(rows).withColumnRenamed("id", "row").select(
        "row",
        F.transform(r, lambda x: x.cast("long")).alias("context_indices"),
        F.transform(r, lambda x: base + x).alias("impr_time"),
        F.transform(r, lambda x: ((row + x) % scenes).cast("long")).alias("scene_id"),
        F.transform(c, lambda x: F.floor(x / candidates).cast("long")).alias("target_indices"),
        F.transform(c, lambda x: F.array(hashed(row, F.lit(1), x))).alias("item_id"),
        F.transform(c, lambda x: F.transform(F.sequence(F.lit(0), x % bag), lambda k: hashed(row, F.lit(2), x * 8 + k))).alias("item_parts"),
        F.transform(c, lambda x: F.array(((row + x) % 2).cast("long"))).alias("label"),
        F.transform(e, lambda x: hashed(F.lit(3), row % 16, x)).alias("click_id"),
        F.transform(e, lambda x: base - (x + 1) * 500).alias("click_time"),
        F.transform(e, members).alias("click_members"),
    )


def multiplied(df: DataFrame, n: int, index: str, times: list[str], step_ms: int = 1000, ids: tuple[str, ...] = (), values: tuple[str, ...] = (), labels: tuple[str, ...] = (), members: tuple[str, ...] = (), requests: str = "context_indices") -> DataFrame:
    """Each row n times with a copy number. Copy 0 is the row itself; in others times are moved by the
    copy, ids get it as a suffix, hashed values are mixed with it, labels turn over in odd copies, and
    memberships turn round the row's requests. Columns are scalars or lists of any depth; the index
    columns stay, as they are local to a row."""
    copies = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(index))
    copy = F.col(index)
    count = F.greatest(F.size(requests), F.lit(1)) if members else None

    def deep(column: Column, kind: str, change, name: str) -> Column:
        if kind.startswith("array<"):
            return F.transform(column, lambda x: deep(x, kind[len("array<") : -1], change, name))
        return F.when(copy == 0, column.cast("string") if name in ids else column).otherwise(change(column))

    changes = {c: lambda t: t + copy * step_ms for c in times}
    changes |= {c: lambda v: F.concat(v.cast("string"), F.lit("-"), copy.cast("string")) for c in ids}
    changes |= {c: lambda v: F.when(v.isNotNull(), hashed(v, copy)) for c in values}
    changes |= {c: lambda y: F.when(y.isin(0, 1) & (copy % 2 == 1), 1 - y).otherwise(y) for c in labels}
    changes |= {c: lambda r: F.get(F.col(requests), ((F.array_position(F.col(requests), r) - 1 + copy) % count).cast("int")) for c in members}
    return copies.withColumns({c: deep(F.col(c), df.schema[c].dataType.simpleString(), change, c) for c, change in changes.items()})
