"""Data contracts of nested rows: counters, not errors, so a whole input can be judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.expand import candidates_with_requests
from rankloom.operators.spec import Layout, Sequence


def _size(c: str | Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def layout_counts(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows with both index columns filled, with neither, with one."""
    a, b = F.col(layout.request_index).isNotNull(), F.col(layout.candidate_index).isNotNull()
    return df.agg(F.count_if(a & b).alias("agg"), F.count_if(~a & ~b).alias("req"), F.count_if(a != b).alias("partial"))


def index_faults(df: DataFrame, layout: Layout) -> DataFrame:
    """Invalid (null or negative) values, rows with duplicate requests, candidates without request."""
    r, t = F.col(layout.request_index), F.col(layout.candidate_index)
    bad = lambda c: _size(F.filter(c, lambda x: x.isNull() | (x < 0)))
    return df.agg(F.sum(bad(r) + bad(t)).cast("long").alias("invalid"), F.count_if(_size(F.array_distinct(r)) < _size(r)).alias("duplicate_rows"), F.sum(_size(F.filter(t, lambda x: ~F.array_contains(r, x)))).cast("long").alias("dangling"))


def length_mismatches(df: DataFrame, layout: Layout) -> DataFrame:
    """(column, rows) where the outer length isn't that of the column's axis."""
    axes = {c: layout.request_index for c in (*layout.request_scalars, *layout.request_bags, *layout.request_meta)}
    axes |= {c: layout.candidate_index for c in (*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *layout.labels)}
    found = F.array(*(F.struct(F.lit(c).alias("column"), (_size(c) != _size(i)).cast("long").alias("n")) for c, i in axes.items()))
    return df.select(F.inline(found)).groupBy("column").agg(F.sum("n").alias("rows"))


def sequence_faults(df: DataFrame, sequence: Sequence) -> DataFrame:
    """Field lengths that differ from the membership's (one more if fields differ among themselves),
    missing membership, events without members, and members that are null or negative."""
    sizes = [_size(c) for c in sequence.fields.values()]
    m = F.col(sequence.members)
    wrong = sum(((s != _size(m)).cast("long") for s in sizes[1:]), (sizes[0] != _size(m)).cast("long"))
    differ = (F.size(F.array_distinct(F.array(*sizes))) > 1).cast("long")
    events = F.coalesce(m, F.array().cast(df.schema[sequence.members].dataType))
    invalid = F.aggregate(events, F.lit(0).cast("long"), lambda acc, e: acc + F.coalesce(F.size(F.filter(e, lambda x: x.isNull() | (x < 0))), F.lit(0)))
    return df.agg(F.sum(wrong + differ).alias("misaligned"), F.count_if(m.isNull() & (sizes[0] > 0)).alias("missing"), F.sum(F.size(F.filter(events, lambda e: _size(e) == 0))).cast("long").alias("orphans"), F.sum(invalid).alias("invalid"))


def order_faults(df: DataFrame, layout: Layout, sequence: Sequence) -> DataFrame:
    """Rows with a request view that isn't newest first, and events after the time of a request
    that sees them, counted once for each such request, over all views."""
    pairs = F.arrays_zip(F.col(layout.request_index).alias("r"), F.col(layout.request_time).alias("t"))
    events = F.arrays_zip(F.col(sequence.fields[sequence.time]).alias("time"), F.col(sequence.members).alias("m"))
    views = F.transform(pairs, lambda p: F.struct(p["t"].alias("t"), F.transform(F.filter(events, lambda e: F.array_contains(e["m"], p["r"])), lambda e: e["time"]).alias("times")))
    rows = df.select(views.alias("v"))
    unordered = F.exists("v", lambda v: F.exists(F.sequence(F.lit(0), F.greatest(F.size(v["times"]) - 2, F.lit(0))), lambda i: F.coalesce(F.get(v["times"], i) < F.get(v["times"], i + 1), F.lit(False))))
    future = F.aggregate("v", F.lit(0), lambda acc, v: acc + F.size(F.filter(v["times"], lambda t: t > v["t"])))
    return rows.agg(F.count_if(unordered).alias("unordered_rows"), F.sum(future).cast("long").alias("future_events"))


def time_faults(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows whose request times have the wrong length, and values that are null or not positive."""
    t = F.col(layout.request_time)
    return df.agg(F.count_if(_size(t) != _size(layout.request_index)).alias("layout"), F.sum(_size(F.filter(t, lambda x: x.isNull() | (x <= 0)))).cast("long").alias("invalid"))


def bag_group_mismatches(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, rows, positions) where bags that should be aligned differ in inner length."""

    def unequal(columns: list[str]) -> Column:
        zipped = F.arrays_zip(*(F.transform(F.col(c), lambda x: _size(x)).alias(c) for c in columns))
        return F.size(F.filter(zipped, lambda z: F.size(F.array_distinct(F.array(*(z[c] for c in columns)))) > 1))

    parts = [F.struct(F.lit(name).alias("group"), unequal(columns).alias("n")) for name, columns in groups.items()]
    return df.select(F.inline(F.array(*parts))).groupBy("group").agg(F.sum((F.col("n") > 0).cast("long")).alias("rows"), F.sum("n").cast("long").alias("positions"))


def label_distribution(df: DataFrame, labels: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Label counts by task from flat rows: total, nulls, minus_one, zeros, ones, other."""
    flat = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("task"), F.col(c).cast("long").alias("y")) for c in labels))))
    y = F.col("y")
    return flat.groupBy("task", *keys).agg(F.count("*").alias("total"), F.count_if(y.isNull()).alias("nulls"), F.count_if(y == -1).alias("minus_one"), F.count_if(y == 0).alias("zeros"), F.count_if(y == 1).alias("ones"), F.count_if(~y.isin(-1, 0, 1)).alias("other"))


def scene_counts(df: DataFrame, layout: Layout, scene: str, keys: tuple[str, ...]) -> DataFrame:
    """Requests and candidates of each scene; a scene list of length 1 isn't spread over requests."""
    by_request = df.select(F.explode(scene).alias("scene")).groupBy("scene").agg(F.count("*").alias("requests"))
    by_candidate = candidates_with_requests(df, layout, keys).groupBy(F.col(scene).alias("scene")).agg(F.count("*").alias("candidates"))
    return by_request.join(by_candidate, "scene", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def _inputs(inputs: dict[str, DataFrame], columns: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(input, rows, column, type) for the given columns of each input; its rows are counted."""
    out = None
    for name, df in inputs.items():
        listed = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in columns[name])).cast("array<struct<column:string,type:string>>")
        own = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("input"), "rows", F.inline(listed))
        out = own if out is None else out.unionByName(own)
    return out


def missing_columns(inputs: dict[str, DataFrame], wanted: list[str]) -> DataFrame:
    """(input, column, rows): wanted columns that an input lacks, with how many of its rows do without."""
    lacking = {name: [(c, "") for c in wanted if c not in df.columns] for name, df in inputs.items()}
    return _inputs(inputs, lacking).select("input", "column", "rows")


def observed_schema(inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, column, type, rows) of all columns that the inputs have."""
    return _inputs(inputs, {name: [(f.name, f.dataType.simpleString()) for f in df.schema.fields] for name, df in inputs.items()}).select("input", "column", "type", "rows")


def duplicates_across_sources(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Request ids that occur in more than one source."""
    union = None
    for name, df in sources.items():
        own = df.select(key, F.lit(name).alias("source"))
        union = own if union is None else union.unionByName(own)
    return union.groupBy(key).agg(F.countDistinct("source").alias("sources")).where("sources > 1")


#: Rules for profiled fields: what must not be, and the number that says how much of it there is.
FIELD_RULES: dict[str, tuple[str, str]] = {
    "no values": ("leaf_count = 0", "cells"),
    "zero is reserved for padding": ("zero_count > 0", "zero_count"),
    "no bucket count fits": ("leaf_count > 0 AND buckets IS NULL", "distinct"),
}
#: Rules for a contract's label distribution.
LABEL_RULES: dict[str, tuple[str, str]] = {
    "no labels": ("total = 0", "total"),
    "null labels": ("nulls > 0", "nulls"),
    "missing labels": ("minus_one > 0", "minus_one"),
    "labels that aren't 0 or 1": ("other > 0", "other"),
}
#: Rules for a field's profile by depth: outer lists may not be empty, and histories hold no inner nulls.
DEPTH_RULES: dict[str, tuple[str, str]] = {"empty outer lists": ("depth = 0 AND empties > 0", "empties"), "nulls inside a history": ("depth > 0 AND nulls > 0", "nulls")}


def gate(profile: DataFrame, rules: dict[str, tuple[str, str]], key: str = "field") -> DataFrame:
    """(key, rule, found) for each row of a profile and rule that it breaks; no row if all is well."""
    parts = [F.struct(F.lit(name).alias("rule"), F.expr(broken).alias("broken"), F.expr(found).cast("long").alias("found")) for name, (broken, found) in rules.items()]
    return profile.select(key, F.inline(F.array(*parts))).where("broken").drop("broken")


def nonzero(counters: DataFrame, name: str) -> DataFrame:
    """(field, rule, found) for each counter of a contract that isn't zero."""
    parts = F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("found")) for c in counters.columns))
    return counters.select(F.lit(name).alias("field"), F.inline(parts)).where("found <> 0")


def production_gate(
    rows: DataFrame | None = None, fields: DataFrame | None = None, depths: DataFrame | None = None, labels: DataFrame | None = None, counters: dict[str, DataFrame] | None = None, by_name: dict[str, tuple[DataFrame, str, str]] | None = None,
    scenes: DataFrame | None = None, least_requests: int = 1, missing: DataFrame | None = None,
) -> DataFrame:
    """One table (field, rule, found) of all that speaks against using a profile; no row if all is well.

    rows: one row with the number of rows scanned. fields, depths, labels: profiles that FIELD_RULES,
    DEPTH_RULES (by field and depth) and LABEL_RULES (by task) hold for. counters: one-row tables of
    counts that must be zero, by name. by_name: tables of counts by name that must be zero, as (table,
    name column, count column). scenes: requests and candidates of each scene, which must have some, and at
    least so many requests. missing: columns that an input lacks.
    """
    parts: list[DataFrame] = []
    if rows is not None:
        parts.append(rows.select(F.lit("rows").alias("field"), F.lit("nothing was scanned").alias("rule"), F.col(rows.columns[0]).cast("long").alias("found")).where("found = 0"))
    for table, rules, key in ((fields, FIELD_RULES, "field"), (depths, DEPTH_RULES, "field"), (labels, LABEL_RULES, "task")):
        if table is not None:
            parts.append(gate(table, rules, key).withColumnRenamed(key, "field"))
    parts += [nonzero(table, f"contract.{name}") for name, table in (counters or {}).items()]
    for name, (table, of, count) in (by_name or {}).items():
        parts.append(table.select(F.col(of).cast("string").alias("field"), F.lit(name).alias("rule"), F.col(count).cast("long").alias("found")).where("found > 0"))
    if scenes is not None:
        rules = {"a scene without candidates": ("requests > 0 AND candidates = 0", "requests"), "too few requests of a scene": (f"requests < {least_requests}", "requests")}
        parts.append(gate(scenes.withColumn("field", F.concat(F.lit("scene "), F.col("scene").cast("string"))), rules))
    if missing is not None:
        parts.append(missing.select(F.concat_ws(".", "input", "column").alias("field"), F.lit("missing column").alias("rule"), F.col("rows").cast("long").alias("found")))
    if not parts:
        raise ValueError("there is nothing to judge")
    out = parts[0].select("field", "rule", "found")
    for part in parts[1:]:
        out = out.unionByName(part.select("field", "rule", "found"))
    return out


def require(violations: DataFrame, most: int = 20) -> None:
    """Raise if a gate found something, with the first of it."""
    found = violations.limit(most).collect()
    if found:
        raise ValueError("the profile isn't fit for use:\n" + "\n".join(f"- {r['field']}: {r['rule']} ({r['found']})" for r in found))


def shared_group_faults(tables: DataFrame) -> DataFrame:
    """Members of a shared table (name, root, kind, buckets, width) that differ from their root, or
    whose root is itself shared: name, reason."""
    root = tables.select(F.col("name").alias("root"), *(F.col(c).alias(f"r_{c}") for c in ("root", "kind", "buckets", "width")))
    joined = tables.join(root, "root", "left")
    reason = F.when(F.col("r_root").isNull(), "unknown root").when(F.col("r_root") != F.col("root"), "alias chain")
    for c in ("kind", "buckets", "width"):
        reason = reason.when(F.col(f"r_{c}") != F.col(c), c)
    return joined.select("name", reason.alias("reason")).where("reason IS NOT NULL")
