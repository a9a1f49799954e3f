"""Field profiles, sketches and vocabularies. Every statistic is a two-phase aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.encode import encode, low_bits, mix64, unsigned_order
from rankloom.sources.shared import range_count, written


def depth_of(df: DataFrame, column: str) -> int:
    return df.schema[column].dataType.simpleString().count("array<")


def leaves(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per leaf of a scalar, list or nested list, nulls inside lists included."""
    out = df.select(*keep, F.col(column).alias("leaf"))
    for _ in range(depth_of(df, column)):
        out = out.select(*keep, F.explode("leaf").alias("leaf"))
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of values as text, nulls left out."""
    return leaves(df, column).where("leaf IS NOT NULL").groupBy(F.col("leaf").cast("string").alias("value")).agg(F.count("*").alias("count"))


def vocabulary(df: DataFrame, column: str, min_count: int = 1, max_size: int | None = None, parts: int | None = None) -> DataFrame:
    """(value, id, count): ids from 1 by count, then value. With ``max_size`` a top-k; without, ids
    come from range partitions and their offsets, so no task ranks all values. The ranges are written
    once, as they are read twice and must be the same."""
    counts = value_counts(df, column).where(F.col("count") >= min_count)
    if max_size is not None:
        top = counts.orderBy(F.desc("count"), "value").limit(max_size)
        return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "value")).cast("long")).select("value", "id", "count")
    ranged = written(counts.repartitionByRange(range_count(df, parts), F.desc("count"), F.col("value")).withColumn("part", F.spark_partition_id()), "vocabulary")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("count"), "value"))
    return ranged.withColumn("own", own).join(offsets, "part").select("value", (F.col("before") + F.col("own")).alias("id"), "count")


def vocabulary_ids(df: DataFrame, column: str, vocab: DataFrame, unknown: str = "padding") -> DataFrame:
    """Adds ``<column>_id``; an unknown value gets 0, or is an error. The join is left to Spark's
    size check, as a vocabulary may be large."""
    pairs = vocab.select(F.col("value").alias("__v"), F.col("id").alias("__i"))
    joined = df.join(pairs, F.col(column).cast("string") == F.col("__v"), "left")
    other = F.lit(0).cast("long") if unknown == "padding" else F.when(F.col(column).isNull(), F.lit(0).cast("long")).otherwise(F.raise_error(F.lit("unknown value")).cast("long"))
    return joined.withColumn(f"{column}_id", F.coalesce("__i", other)).drop("__v", "__i")


def vocabulary_list_ids(df: DataFrame, key: str, column: str, vocab: DataFrame) -> DataFrame:
    """(key, ids) of list columns, in the list's order."""
    flat = vocabulary_ids(df.select(key, F.posexplode(column).alias("p", "v")), "v", vocab)
    own = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "v_id"))).alias("x"))
    return df.select(key).join(own, key, "left").select(key, F.coalesce(F.col("x.v_id"), F.array().cast("array<bigint>")).alias("ids"))


def encoded(df: DataFrame, column: str, strategy: str, size: int = 0, depth: int = 0, vocab: DataFrame | None = None, **options) -> DataFrame:
    """Adds ``<column>_id`` by the configured strategy: ``vocabulary`` looks scalars up in ``vocab``, the
    others (prehashed, sha, identity) are expressions and take lists of any depth."""
    if strategy == "vocabulary":
        return vocabulary_ids(df, column, vocab, **options)
    return df.withColumn(f"{column}_id", encode(F.col(column), strategy, size, depth, **options))


def resolved_aliases(aliases: DataFrame) -> DataFrame:
    """(name, root, cyclic) of a table (name, alias): the name that a chain of aliases ends at, by pointer
    jumping, so a chain takes as many rounds as its length has binary digits. A name that is its own
    alias, has none or isn't a name is a root; one whose chain never ends is cyclic and has no root."""
    links = aliases.groupBy("name").agg(F.min(F.coalesce("alias", "name")).alias("at"))
    held = written(links, "aliases")
    for _ in range(held.count().bit_length() + 1):
        nexts = held.select(F.col("name").alias("at"), F.col("at").alias("next"))
        before, held = held, written(held.join(nexts, "at", "left").select("name", F.coalesce("next", "at").alias("at")), "aliases")
        if held.join(before, ["name", "at"], "left_anti").isEmpty():
            break
    ends = links.where("at = name").select(F.col("name").alias("at"), F.lit(False).alias("inside"))
    found = held.join(ends, "at", "left").join(links.select(F.col("name").alias("at"), F.lit(True).alias("named")), "at", "left")
    cyclic = F.col("named").isNotNull() & F.col("inside").isNull()
    return found.select("name", F.when(~cyclic, F.col("at")).alias("root"), cyclic.alias("cyclic"))


def union_registers(found: DataFrame, roots: DataFrame, field: str = "field", name: str = "name") -> DataFrame:
    """Registers (root, index, rank) of the unions of fields that share a table: those of the members by
    maximum. Their estimate takes the place of the root field's own."""
    own = found.join(roots.select(F.col(name).alias(field), "root"), field)
    return own.groupBy("root", "index").agg(F.max("rank").alias("rank"))


def scenarios(df: DataFrame, column: str, most: int = 256) -> DataFrame:
    """Sorted distinct integers of a scalar or list column with their index from 0; null rows, empty
    lists and more than ``most`` values are errors."""
    c = F.col(column)
    bad = c.isNull() | (F.size(c) == 0) if depth_of(df, column) else c.isNull()
    rows = df.select(F.when(bad, F.raise_error(F.lit("row without scenario")).cast(df.schema[column].dataType)).otherwise(c).alias(column))
    found = leaves(rows, column).distinct().orderBy("leaf").limit(most + 1)
    index = (F.row_number().over(Window.orderBy("leaf")) - 1).cast("long")
    found = found.withColumn("index", index)
    return found.select(F.col("leaf").alias("scenario"), F.when(F.col("index") < most, F.col("index")).otherwise(F.raise_error(F.lit("too many scenarios")).cast("long")).alias("index"))


def _at_depth(column: Column, depth: int) -> list[Column]:
    """All values at each depth of nesting, as one list each."""
    out = [F.array(column)]
    for _ in range(depth):
        out.append(F.flatten(F.filter(out[-1], lambda x: x.isNotNull())))
    return out


def field_profile(df: DataFrame, column: str) -> DataFrame:
    """Long table (depth, cells, nulls, empties, null_rows, empty_rows): values at each depth, how many
    are null or empty, and how many rows have some."""
    depth = depth_of(df, column)
    cells, stats = _at_depth(F.col(column), depth), []
    for k, values in enumerate(cells):
        empty = F.size(F.filter(values, lambda x: F.size(x) == 0)) if k < depth else F.lit(0)
        stats.append(F.struct(F.lit(k).alias("depth"), F.size(values).alias("cells"), F.size(F.filter(values, lambda x: x.isNull())).alias("nulls"), empty.alias("empties")))
    sums = [F.sum(c).cast("long").alias(c) for c in ("cells", "nulls", "empties")]
    return df.select(F.inline(F.array(*stats))).groupBy("depth").agg(*sums, F.count_if(F.col("nulls") > 0).alias("null_rows"), F.count_if(F.col("empties") > 0).alias("empty_rows"))


def leaf_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: count, negative, positive, zero, minimum, maximum, their span, and the unsigned ends as text."""
    v = leaves(df, column).where("leaf IS NOT NULL").select(F.col("leaf").cast("long").alias("v"))
    text = lambda x: F.conv(F.hex(unsigned_order(x)), 16, 10)
    u = unsigned_order(F.col("v"))
    return v.agg(
        F.count("*").alias("count"), F.count_if(F.col("v") < 0).alias("negative"), F.count_if(F.col("v") > 0).alias("positive"), F.count_if(F.col("v") == 0).alias("zero"),
        F.min("v").alias("minimum"), F.max("v").alias("maximum"), (F.max("v").cast("decimal(38,0)") - F.min("v").cast("decimal(38,0)")).cast("string").alias("span"), text(F.min(u)).alias("unsigned_min"), text(F.max(u)).alias("unsigned_max"),
    )


def strategy_profile(df: DataFrame, key: str, column: str) -> DataFrame:
    """What the choice of an encoding asks for, by key: leaf_count, zero_count, cells, distinct, minimum,
    maximum, span (share of the unsigned 64-bit range), high16 (distinct upper 16 bits), inputs."""
    v = F.col(column).cast("long")
    number = lambda x: (F.shiftrightunsigned(x, 1).cast("double") * 2 + x.bitwiseAND(F.lit(1).cast("long")))
    u = number(v)
    return df.groupBy(key).agg(
        F.count("*").alias("cells"), F.count(v).alias("leaf_count"), F.count_if(v == 0).alias("zero_count"), F.countDistinct(v).alias("distinct"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        ((F.max(u) - F.min(u)) / F.lit(2.0**64)).alias("span"), F.countDistinct(F.shiftrightunsigned(v, 48)).alias("high16"), F.lit(1).alias("inputs"),
    )


def list_lengths(df: DataFrame, column: str) -> DataFrame:
    """Lengths of the lists at each depth: depth, count, min, p50, p95, p99, max; a quantile is the
    smallest length whose cumulative count reaches it."""
    depth = depth_of(df, column)
    cells = _at_depth(F.col(column), depth)

    def lengths(k: int) -> Column:
        return F.transform(F.filter(cells[k], lambda x: x.isNotNull()), lambda x: F.struct(F.lit(k).alias("depth"), F.size(x).alias("n")))

    sizes = [lengths(k) for k in range(depth)]
    flat = df.select(F.inline(F.concat(*sizes)))
    quantiles = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("int").alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return flat.groupBy("depth").agg(F.count("*").alias("count"), F.min("n").alias("min"), *quantiles, F.max("n").alias("max"))


class HeavyHitters:
    """Counts of at most ``room`` values, each too low by at most ``missed``; a value that isn't among
    them occurs at most ``missed`` times."""

    def __init__(self, room: int) -> None:
        self.counts, self.room, self.missed = pd.Series(dtype="int64"), room, 0

    def add(self, values: pd.Series) -> None:
        self.counts = self.counts.add(values.value_counts(), fill_value=0).astype("int64")
        if len(self.counts) > self.room:
            low = int(self.counts.nlargest(self.room + 1).iloc[-1])
            self.missed += low
            self.counts = (self.counts - low)[self.counts > low]


def _summaries(room: int):
    """Leaves give a task's summary: (leaf, count) and a row without leaf that has what it missed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = HeavyHitters(room)
        for batch in batches:
            held.add(batch["leaf"].astype("int64"))
        yield pd.DataFrame({"leaf": held.counts.index.astype("int64"), "count": held.counts.to_numpy()})
        yield pd.DataFrame({"leaf": pd.array([None], dtype="Int64"), "count": [held.missed]})

    return run


def top_values(df: DataFrame, column: str, n: int = 16, room: int = 1 << 16) -> DataFrame:
    """Exact most frequent leaves, ties by value.

    Whole numbers are counted by task in summaries of at most ``room`` values, which is all that is
    shuffled; the best candidates are then counted exactly. If no other value can have as many as the
    last of them, which what the summaries missed says, they are the answer; else all are counted."""
    found = leaves(df, column).where("leaf IS NOT NULL")
    exact = lambda rows: rows.groupBy("leaf").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "leaf").limit(n)
    if found.schema["leaf"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return exact(found)
    long = found.select(F.col("leaf").cast("long").alias("leaf"))
    summary = written(long.mapInPandas(_summaries(room), "leaf long, count long").groupBy("leaf").agg(F.sum("count").alias("count")), "heavy-hitters")
    missed = summary.where("leaf IS NULL").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    best = summary.where("leaf IS NOT NULL").orderBy(F.desc("count"), "leaf").limit(4 * n + 1).collect()
    candidates, beyond = [r["leaf"] for r in best[: 4 * n]], (best[4 * n]["count"] if len(best) > 4 * n else 0) + missed
    counted = exact(long.where(F.col("leaf").isin(candidates))).collect()
    sure = not missed and len(best) <= 4 * n or len(counted) == n and counted[-1]["count"] > beyond
    kind = found.schema["leaf"].dataType
    if not sure:
        return exact(found)
    return df.sparkSession.createDataFrame([tuple(r) for r in counted], "leaf long, count long").select(F.col("leaf").cast(kind).alias("leaf"), "count").orderBy(F.desc("count"), "leaf")


def top_prefixes(df: DataFrame, column: str, n: int = 8, shift: int = 48) -> DataFrame:
    """Most frequent high bits of the leaves, and how many there are."""
    prefix = F.shiftrightunsigned(F.col("leaf").cast("long"), shift)
    counts = leaves(df, column).where("leaf IS NOT NULL").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("count"))
    return counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("diversity")))).orderBy(F.desc("count"), "prefix").limit(n)


def registers(df: DataFrame, column: str, precision: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """HyperLogLog registers of the mixed leaves: index and highest rank. Registers of several
    columns merge by the maximum over their union."""
    h = mix64(F.col("leaf").cast("long"))
    rest = F.shiftrightunsigned(F.col("h"), precision)
    width = 64 - precision
    rank = F.when(rest == 0, width + 1).otherwise(width - F.length(F.bin(rest)) + 1)
    mixed = leaves(df, column, keep).where("leaf IS NOT NULL").select(*keep, h.alias("h"))
    return mixed.groupBy(*keep, F.col("h").bitwiseAND(F.lit((1 << precision) - 1).cast("long")).alias("index")).agg(F.max(rank).alias("rank"))


def distinct_estimate(found: DataFrame, precision: int = 12, keys: tuple[str, ...] = ()) -> DataFrame:
    """Estimate from registers, with linear counting below 2.5 times their number."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = found.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank").cast("double"))).alias("s"), F.count("*").alias("used"))
    raw = F.lit(alpha * m * m) / (F.col("s") + (m - F.col("used")))
    empty = m - F.col("used")
    estimate = F.when((empty > 0) & (raw <= 2.5 * m), m * F.ln(F.lit(float(m)) / F.when(empty > 0, empty))).otherwise(raw)
    return sums.select(*keys, F.round(estimate, 4).alias("estimate"))


def _smallest(n: int, keys: tuple[str, ...]):
    """Rows (keys, leaf, priority) give the n distinct ones of each key with the smallest priority in this task."""

    def kept(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates([*keys, "priority"]).sort_values("priority", kind="stable")
        return rows.groupby([*keys], dropna=False, sort=False).head(n) if keys else rows.head(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = kept(batch if held is None else pd.concat([held, batch]))
        if held is not None:
            yield held

    return run


def bottom_sample(df: DataFrame, column: str, n: int = 4096, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n distinct leaves with the smallest unsigned mixed hash, of each key if there are any:
    (keys, leaf, priority). A task keeps n of each key, so that is all that is shuffled; samples
    merge, as the smallest of a union are among the smallest of its parts."""
    rows = leaves(df, column, keys).where("leaf IS NOT NULL").withColumn("priority", unsigned_order(mix64(F.col("leaf").cast("long"))))
    found = rows.mapInPandas(_smallest(n, keys), rows.schema).distinct()
    if not keys:
        return found.orderBy("priority").limit(n)
    return found.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("priority"))).where(F.col("__r") <= n).drop("__r")


def sample_overlap(samples: DataFrame) -> DataFrame:
    """Shared values and Jaccard of each two fields' samples (field, leaf), 0 where they share none.
    Samples are bounded, and a pair of fields is a row, as a report asks for it."""
    sizes = samples.groupBy("field").agg(F.count("*").alias("n"))
    a, b = samples.alias("a"), samples.alias("b")
    both = a.join(b, (F.col("a.leaf") == F.col("b.leaf")) & (F.col("a.field") < F.col("b.field"))).groupBy(F.col("a.field").alias("left"), F.col("b.field").alias("right")).agg(F.count("*").alias("shared"))
    pairs = sizes.toDF("left", "n_left").join(sizes.toDF("right", "n_right"), F.col("left") < F.col("right"))
    joined = pairs.join(both, ["left", "right"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return joined.select("left", "right", "shared", F.round(F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")), 9).alias("jaccard"))


def cardinality_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Empty (or null), single and several counts of the innermost lists of each scalar column."""
    parts = []
    for c in columns:
        cells = _at_depth(F.col(c), depth_of(df, c))[-2]
        n = lambda x: F.coalesce(F.size(x), F.lit(0))
        parts.append(F.struct(F.lit(c).alias("field"), F.size(F.filter(cells, lambda x: n(x) == 0)).alias("empty"), F.size(F.filter(cells, lambda x: n(x) == 1)).alias("single"), F.size(F.filter(cells, lambda x: n(x) > 1)).alias("several")))
    return df.select(F.inline(F.array(*parts))).groupBy("field").agg(*(F.sum(c).cast("long").alias(c) for c in ("empty", "single", "several")))


def collision_rates(sample: DataFrame, buckets: list[int], seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sample collision rate by bucket count, raw and remixed, for a bounded sample (keys, leaf)."""
    parts = [F.struct(F.lit(n).cast("long").alias("buckets"), low_bits(F.col("leaf"), n).alias("raw"), low_bits(F.col("leaf"), n, True, seed).alias("mixed")) for n in buckets]
    flat = sample.select(*keys, F.inline(F.array(*parts)))
    rate = lambda c: F.round((F.count("*") - F.countDistinct(c)) / F.count("*"), 9)
    return flat.groupBy(*keys, "buckets").agg(F.count("*").alias("n"), rate("raw").alias("raw_rate"), rate("mixed").alias("mixed_rate"))


def collision_exposure(top: DataFrame, buckets: int, remix: bool = False, seed: int = 0) -> DataFrame:
    """Share of events of the most frequent values (leaf, count) that fall in a shared bucket."""
    by = top.groupBy(low_bits(F.col("leaf"), buckets, remix, seed).alias("bucket")).agg(F.count("*").alias("values"), F.sum("count").alias("events"))
    shared = F.col("values") > 1
    return by.agg(F.sum("values").alias("values"), F.count("*").alias("occupied"), F.count_if(shared).alias("shared_buckets"), F.round(F.sum(F.when(shared, F.col("events")).otherwise(0)) / F.sum("events"), 9).alias("exposure"))


def bag_collisions(df: DataFrame, column: str, buckets: int, seed: int = 0) -> DataFrame:
    """Collision rates within bags of two or more distinct values, raw and remixed."""
    bag = F.array_distinct(F.filter(F.col(column), lambda x: x.isNotNull()))
    bags = df.select(bag.alias("b")).where(F.size("b") > 1)
    mapped = lambda remix: F.sum(F.size(F.array_distinct(F.transform("b", lambda x: low_bits(x, buckets, remix, seed)))))
    rate = lambda remix: F.round(1 - mapped(remix) / F.sum(F.size("b")), 9)
    return bags.agg(F.count("*").alias("groups"), rate(False).alias("raw_rate"), rate(True).alias("mixed_rate"))


def overfull_scalars(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, longest) of scalar columns whose deepest lists hold more than one value somewhere."""
    parts = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.array_max(F.transform(_at_depth(F.col(c), depth_of(df, c))[-2], lambda x: F.size(x))), F.lit(0)).alias("n")) for c in columns))
    return df.select(F.inline(parts)).groupBy("field").agg(F.max("n").alias("longest")).where("longest > 1")
