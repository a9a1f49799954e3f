"""Expansion of nested rows to one row per candidate. Row-local, so without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rankloom.functions.sequence import aligned, flatten_bag, flatten_singletons, singleton
from rankloom.operators.spec import Layout, Sequence
from rankloom.sources.shared import written


def _empty_as_missing(column: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))


def _is_nested(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString().startswith("array<array")


def _depth(df: DataFrame, column: str) -> int:
    """How many lists a column's values are nested in."""
    kind, n = df.schema[column].dataType, 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def _tokens(column: str, df: DataFrame) -> Column:
    """A history's field with one value for each event; nested ones must hold one value each."""
    kind = df.schema[column].dataType
    if isinstance(kind.elementType, ArrayType):
        return F.coalesce(flatten_singletons(F.col(column)), F.array().cast(kind.elementType))
    return _empty_as_missing(column, df)


def history(df: DataFrame, sequence: Sequence, anchor: str | None = None, limit: int | None = None) -> Column:
    """A history as an array of structs with ``members``; truncated first, then events with a null
    anchor are dropped from all fields."""
    events = F.arrays_zip(*(_tokens(c, df).alias(name) for name, c in sequence.fields.items()), _empty_as_missing(sequence.members, df).alias("members"))
    if limit is not None:
        events = F.slice(events, 1, limit)
    return F.filter(events, lambda e: e[anchor].isNotNull()) if anchor else events


def _fields(events: Column, sequence: Sequence) -> Column:
    """Events with the sequence's own fields only."""
    return F.transform(events, lambda e: F.struct(*(e[n].alias(n) for n in sequence.fields)))


def violations(df: DataFrame, layout: Layout) -> Column:
    """First structural fault of an agg row as text, null if there is none."""
    requests, targets = F.col(layout.request_index), F.col(layout.candidate_index)
    out = F.when(requests.isNull() | targets.isNull(), "missing index")
    out = out.when((F.size(F.array_compact(requests)) < F.size(requests)) | (F.size(F.array_compact(targets)) < F.size(targets)), "null index")
    out = out.when(F.size(F.array_distinct(requests)) < F.size(requests), "duplicate request")
    out = out.when(F.size(F.array_except(targets, requests)) > 0, "dangling candidate")
    for c in (*layout.request_scalars, *layout.request_bags):
        out = out.when((F.size(F.col(c)) != F.size(requests)) & (F.size(F.col(c)) > 0), f"length of {c}")
    for c in layout.request_meta:
        out = out.when(F.coalesce(F.size(F.col(c)), F.lit(-1)) != F.size(requests), f"length of {c}")
    for c in (*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *(x for x in layout.labels if x in df.columns)):
        out = out.when(F.coalesce(F.size(F.col(c)), F.lit(-1)) != F.size(targets), f"length of {c}")
    for s in layout.sequences:
        members = _empty_as_missing(s.members, df)
        for c in s.fields.values():
            out = out.when(F.size(_empty_as_missing(c, df)) != F.size(members), f"length of {c}")
        out = out.when(F.exists(members, lambda m: m.isNull() | (F.size(m) == 0)), f"orphan event in {s.name}")
    return out


def _label(value: Column, layout: Layout) -> Column:
    return F.when(value.isin(*layout.missing_labels), F.lit(None)).otherwise(value) if layout.missing_labels else value


def complete_label(value: Column) -> Column:
    """The label, or an error if it isn't 0 or 1."""
    return F.when(F.coalesce(value.isin(0, 1), F.lit(False)), value).otherwise(F.raise_error(F.lit("label is not 0 or 1")).cast("long"))


def label_masks(df: DataFrame, labels: list[str], missing: list[int]) -> DataFrame:
    """Missing labels as null, and for each label the column ``<label>_mask`` that says it's valid."""
    for c in labels:
        df = df.withColumn(c, F.when(F.col(c).isin(*missing), F.lit(None)).otherwise(F.col(c)))
        df = df.withColumn(f"{c}_mask", F.col(c).isNotNull())
    return df


def expand_agg(df: DataFrame, layout: Layout, keys: tuple[str, ...] = (), validate: str = "strict", limit: int | None = None, anchors: dict[str, str] | None = None, complete: bool = False) -> DataFrame:
    """One row per candidate of agg rows: keys, request_id, candidate_position (from 0 within its
    request, in physical order), request and candidate columns, visible events of each history.

    ``validate="strict"`` fails on the first faulty row, ``"off"`` checks none: a candidate of an
    unknown request then has nulls for its columns. Labels that the input lacks are left out; with
    ``complete`` one that isn't 0 or 1 is an error. Nested event tokens and request bags are flattened.
    """
    requests = F.col(layout.request_index)
    labels = [c for c in layout.labels if c in df.columns]
    if validate == "strict":
        fault = violations(df, layout)
        df = df.where(F.when(fault.isNotNull(), F.raise_error(F.coalesce(fault, F.lit(""))).cast("boolean")).otherwise(F.lit(True)))
    fields = (*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *labels)
    targets = F.col(layout.candidate_index)
    # Candidates in order of request and place fall into runs, one for each request that has any: each
    # candidate is looked at once, and a run carries its own candidates and what its request sees.
    pairs = F.sort_array(F.arrays_zip(targets.alias("r"), F.sequence(F.lit(0), F.size(targets) - 1).alias("i")))
    of_request = lambda c: F.get(F.col(c), F.col("__r"))
    opens = F.filter(F.sequence(F.lit(0), F.size("__pairs") - 1), lambda k: (k == 0) | ~F.get("__pairs", k)["r"].eqNullSafe(F.get("__pairs", k - 1)["r"]))
    cells = lambda e: F.struct(*(F.get(F.col(c), e["i"]).alias(c) for c in fields), e["i"].alias("__i"))
    run = lambda start, k: F.struct(F.get("__pairs", start)["r"].alias("r"), F.transform(F.slice("__pairs", start + 1, F.coalesce(F.get("__opens", k + 1), F.size("__pairs")) - start), cells).alias("own"))
    kept = dict.fromkeys([*keys, layout.request_index, *layout.request_scalars, *layout.request_bags, *layout.request_meta])
    sights = {f"__{s.name}": history(df, s, (anchors or {}).get(s.name), limit) for s in layout.sequences}
    rows = df.where(F.size(targets) > 0).withColumn("__pairs", pairs).withColumn("__opens", opens)
    rows = rows.select(*kept, *(v.alias(k) for k, v in sights.items()), F.explode(F.transform("__opens", run)).alias("__run"))
    rows = rows.withColumn("request_id", F.col("__run.r")).withColumn("__r", (F.array_position(requests, F.col("__run.r")) - 1).cast("int"))
    request = {c: (singleton(of_request(c)) if _is_nested(df, c) else of_request(c)) for c in layout.request_scalars}
    bag = lambda c: flatten_bag(of_request(c)) if _depth(df, c) > 2 else of_request(c)
    flat_kind = lambda c: df.schema[c].dataType.elementType.elementType if _depth(df, c) > 2 else df.schema[c].dataType.elementType
    request |= {c: F.coalesce(bag(c), F.array().cast(flat_kind(c))) for c in layout.request_bags}
    request |= {c: of_request(c) for c in layout.request_meta}
    label = (lambda c, v: complete_label(v)) if complete else (lambda c, v: v)
    seen = {s.name: _fields(F.filter(F.col(f"__{s.name}"), lambda e: F.array_contains(e["members"], F.col("request_id"))), s) for s in layout.sequences}
    rows = rows.select(*keys, "request_id", *(v.alias(f"__q_{c}") for c, v in (request | seen).items()), F.posexplode("__run.own").alias("candidate_position", "__c"))
    cell = lambda c: F.col("__c")[c]
    out = [*keys, "request_id", "candidate_position", *(F.col(f"__q_{c}").alias(c) for c in request)]
    out += [(singleton(cell(c)) if _is_nested(df, c) else cell(c)).alias(c) for c in layout.candidate_scalars]
    out += [F.coalesce(cell(c), F.array().cast(df.schema[c].dataType.elementType)).alias(c) for c in layout.candidate_bags]
    out += [cell(c).alias(c) for c in layout.candidate_meta]
    out += [label(c, _label(singleton(cell(c)) if _is_nested(df, c) else cell(c), layout)).alias(c) for c in labels]
    out += [F.col(f"__q_{s.name}").alias(s.name) for s in layout.sequences]
    return rows.select(*out)


def req_violations(df: DataFrame, layout: Layout) -> Column:
    """First structural fault of a req row as text, null if there is none: candidate fields of other
    lengths than the first one, a null among them, histories whose fields differ in length."""
    fields = [*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *(c for c in layout.labels if c in df.columns)]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in fields:
        out = out.when(F.col(c).isNull(), f"missing {c}")
        out = out.when(F.size(fields[0]) != F.size(c), f"length of {c}")
    for s in layout.sequences:
        first, *others = (_empty_as_missing(c, df) for c in s.fields.values())
        for name, other in zip([*s.fields.values()][1:], others, strict=True):
            out = out.when(F.size(first) != F.size(other), f"length of {name}")
    return out


def expand_req(df: DataFrame, layout: Layout, keys: tuple[str, ...] = (), validate: str = "strict", complete: bool = False) -> DataFrame:
    """One row per candidate of req rows, whose request columns are plain values or lists.

    ``validate="strict"`` fails on the first row whose fields differ in length, ``"off"`` checks only the
    histories. A request scalar may be wrapped in lists of one value, a bag in one list or be lists of
    one value; with ``complete`` a label that isn't 0 or 1 is an error."""
    labels = [c for c in layout.labels if c in df.columns]
    fields = (*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *labels)
    if validate == "strict":
        fault = req_violations(df, layout)
        df = df.where(F.when(fault.isNotNull(), F.raise_error(F.coalesce(fault, F.lit(""))).cast("boolean")).otherwise(F.lit(True)))
    value = lambda c: df.schema[c].dataType.elementType.elementType if _depth(df, c) > 1 else df.schema[c].dataType.elementType
    shape = lambda s: ArrayType(StructType([StructField(n, value(c)) for n, c in s.fields.items()]))
    events = {s.name: aligned(*(_tokens(c, df) for c in s.fields.values())).cast(shape(s)) for s in layout.sequences}

    def unwrapped(c: str) -> Column:
        out = F.col(c)
        for _ in range(_depth(df, c)):
            out = singleton(out)
        return out

    scalars = {c: unwrapped(c) for c in layout.request_scalars}
    bags = {c: flatten_bag(F.col(c)) if _depth(df, c) > 1 else F.col(c) for c in layout.request_bags}
    plain = [c for c in dict.fromkeys([*keys, *layout.request_meta]) if c not in scalars and c not in bags]
    wide = {f"__{k}": v for k, v in (events | scalars | bags).items()}
    flat = df.select(*plain, *(v.alias(k) for k, v in wide.items()), F.posexplode(F.arrays_zip(*(F.col(c).alias(c) for c in fields))).alias("candidate_position", "__c"))
    cell = lambda c: singleton(F.col(f"__c.{c}")) if c in (*layout.candidate_scalars, *labels) and _is_nested(df, c) else F.col(f"__c.{c}")
    label = (lambda v: complete_label(_label(v, layout))) if complete else (lambda v: _label(v, layout))
    order = [*dict.fromkeys([*keys, *layout.request_scalars, *layout.request_bags, *layout.request_meta]), *events]
    cells = [(label(cell(c)) if c in labels else cell(c)).alias(c) for c in fields]
    return flat.select(*((F.col(c) if c in plain else F.col(f"__{c}").alias(c)) for c in order), "candidate_position", *cells)


def requests(df: DataFrame, layout: Layout, keys: tuple[str, ...]) -> DataFrame:
    """Request axis: one row per request with its scalars, bags and metadata."""
    fields = (*layout.request_scalars, *layout.request_bags, *layout.request_meta)
    return df.select(*keys, F.inline(F.arrays_zip(F.col(layout.request_index).alias("request_id"), *(F.col(c).alias(c) for c in fields))))


def candidates(df: DataFrame, layout: Layout, keys: tuple[str, ...]) -> DataFrame:
    """Candidate axis: one row per candidate with its place and request."""
    fields = (*layout.candidate_scalars, *layout.candidate_bags, *layout.candidate_meta, *(c for c in layout.labels if c in df.columns))
    zipped = F.arrays_zip(F.col(layout.candidate_index).alias("request_id"), *(F.col(c).alias(c) for c in fields))
    return df.select(*keys, F.posexplode(zipped).alias("place", "__c")).select(*keys, "place", "__c.*")


def events(df: DataFrame, sequence: Sequence, keys: tuple[str, ...]) -> DataFrame:
    """Event axis joined to requests through the membership lists: one row per event and request."""
    flat = df.select(*keys, F.posexplode(history(df, sequence)).alias("place", "__e"))
    return flat.select(*keys, "place", *(F.col(f"__e.{n}").alias(n) for n in sequence.fields), F.explode("__e.members").alias("request_id"))


def candidates_with_requests(df: DataFrame, layout: Layout, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """The relational form of the request gather; ``left_anti`` gives candidates without a request."""
    return candidates(df, layout, keys).join(requests(df, layout, keys), [*keys, "request_id"], how)


def sequence_lengths(df: DataFrame, sequence: Sequence, layout: Layout, keys: tuple[str, ...]) -> DataFrame:
    """Length of a history for each request, 0 included."""
    counts = events(df, sequence, keys).groupBy(*keys, "request_id").agg(F.count("*").alias("n"))
    every = df.select(*keys, F.explode(layout.request_index).alias("request_id"))
    return every.join(counts, [*keys, "request_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def adapted(df: DataFrame, adapt: Callable[[DataFrame, dict], DataFrame | dict[str, DataFrame]], context: dict | None = None) -> dict[str, DataFrame]:
    """A user's own function from a table and a context to one or several flat tables, by name."""
    found = adapt(df, context or {})
    return {"flat": found} if isinstance(found, DataFrame) else found


def adapted_arrow(df: DataFrame, adapt: Callable[..., pa.Table | dict[str, pa.Table]], context: dict | None = None) -> dict[str, DataFrame]:
    """A user's own function ``adapt(table, *, context)`` from an Arrow table to one or several, by name.

    It is called on batches of rows in tasks, so it must treat rows alike wherever they are cut; the
    outputs' schemas come from a call on an empty table here. One pass over the input feeds all
    outputs: with several of them its rows go to one table, each kind in a column of its own, and an
    output reads its column."""
    given = dict(context or {})
    named = lambda found: found if isinstance(found, dict) else {"flat": found}
    kinds = {name: t.schema for name, t in named(adapt(to_arrow_schema(df.schema).empty_table(), context=given)).items()}
    shape = StructType([StructField("__output", StringType()), *(StructField(n, from_arrow_schema(k)) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = to_arrow_schema(shape)
        for batch in batches:
            found = named(adapt(pa.Table.from_batches([batch]), context=given))
            if found.keys() != kinds.keys():
                raise ValueError(f"outputs {sorted(found)} aren't {sorted(kinds)}")
            for name, table in found.items():
                for part in table.select(kinds[name].names).cast(kinds[name]).combine_chunks().to_batches():
                    n, field = part.num_rows, whole.field(name)
                    own = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(part.columns, field.type, strict=True)], fields=[*field.type])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *(own if f.name == name else pa.nulls(n, f.type) for f in list(whole)[1:])], schema=whole)

    tagged = df.mapInArrow(run, shape)
    if len(kinds) > 1:
        tagged = written(tagged, "adapted")
    return {name: tagged.where(F.col("__output") == name).select(F.col(name)["*"] if False else f"{name}.*") for name in kinds}


class ExpandAgg:
    """The table function of ``register_expand``: agg rows to candidates, its schema from its arguments.

    ``shape`` is JSON: keys, request_meta, candidate_scalars, labels (lists of columns), sequences (name
    to {fields, members}). A row whose indices or lengths don't fit is an error."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, shape: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or shape.value is None:
            raise ValueError("expand_agg takes a table and its shape as JSON")
        s, have = json.loads(shape.value), {f.name: f.dataType for f in rows.dataType.fields}
        inner = lambda kind: kind.elementType if isinstance(kind, ArrayType) else kind
        out = StructType([StructField(k, have[k]) for k in s.get("keys", [])]).add("request_id", LongType()).add("candidate_position", LongType())
        for c in s.get("request_meta", []):
            out = out.add(c, inner(have[c]))
        for c in (*s.get("candidate_scalars", []), *s.get("labels", [])):
            out = out.add(c, inner(inner(have[c])))
        for name, q in s.get("sequences", {}).items():
            out = out.add(name, ArrayType(StructType([StructField(n, inner(have[c])) for n, c in q["fields"].items()])))
        return AnalyzeResult(out)

    def eval(self, rows: Row, shape: str) -> Iterator[tuple]:
        s, row = json.loads(shape), rows.asDict()
        requests, targets = row["context_indices"], row["target_indices"]
        for c in s.get("request_meta", []):
            if len(row[c]) != len(requests):
                raise ValueError(f"length of {c}")
        for c in (*s.get("candidate_scalars", []), *s.get("labels", [])):
            if len(row[c]) != len(targets):
                raise ValueError(f"length of {c}")
        one = lambda v: (v[0] if v else None) if isinstance(v, list) and len(v) < 2 else v
        place = {r: i for i, r in enumerate(requests)}
        seen: dict = {r: [[] for _ in s.get("sequences", {})] for r in requests}
        for k, q in enumerate(s.get("sequences", {}).values()):
            for *event, members in zip(*((row[c] or []) for c in q["fields"].values()), row[q["members"]] or [], strict=True):
                for r in members:
                    if r in seen:
                        seen[r][k].append(tuple(event))
        count = dict.fromkeys(requests, 0)
        for i, r in enumerate(targets):
            if r not in place:
                raise ValueError("dangling candidate")
            fields = [row[c][place[r]] for c in s.get("request_meta", [])] + [one(row[c][i]) for c in (*s.get("candidate_scalars", []), *s.get("labels", []))]
            yield (*(row[k] for k in s.get("keys", [])), r, count[r], *fields, *seen[r])
            count[r] += 1


def register_expand(spark: SparkSession, name: str = "expand_agg") -> None:
    """Lets SQL call ``SELECT * FROM expand_agg(TABLE(t), '<shape as JSON>')``. Rows go through Python; from
    DataFrames ``expand_agg`` does the same in the JVM."""
    spark.udtf.register(name, udtf(ExpandAgg))


def scenario_index(df: DataFrame, column: str, scenarios: DataFrame) -> DataFrame:
    """Rows with the index of their scenario; ``scenarios`` has scenario and index. Lists give a row
    for each member; an unknown scenario is an error."""
    if df.schema[column].dataType.simpleString().startswith("array"):
        df = df.withColumn(column, F.explode(column))
    known = scenarios.select(F.col("scenario").alias("__s"), "index")
    joined = df.join(known, F.col(column) == F.col("__s"), "left").drop("__s")
    return joined.withColumn("index", F.coalesce("index", F.raise_error(F.concat(F.lit("unknown scenario "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("long")))


def scenario_values(df: DataFrame, column: str, names: list[str], mode: str = "auto") -> DataFrame:
    """(scenario, index, name) for named scenarios. ``raw``: names are the values, in sorted order, and
    must be those of the data; ``index``: values are 0 to len(names) - 1 already; ``auto``: raw if the
    data's values are the names, else index. ``global`` is a reserved name."""
    if "global" in names or len(set(names)) < len(names):
        raise ValueError("scenario names must differ, and global is reserved")
    found = [str(r[0]) for r in df.select(F.explode(column) if df.schema[column].dataType.simpleString().startswith("array") else column).distinct().orderBy(1).limit(len(names) + 1).collect()]
    raw = set(found) == set(names)
    if mode == "raw" and not raw:
        raise ValueError(f"scenario values {found} aren't the names")
    if mode == "raw" or mode == "auto" and raw:
        pairs = [(x, i, x) for i, x in enumerate(found)]
    elif set(found) <= {str(i) for i in range(len(names))}:
        pairs = [(str(i), i, x) for i, x in enumerate(names)]
    else:
        raise ValueError(f"scenario values {found} aren't indices of the names")
    return df.sparkSession.createDataFrame(pairs, "scenario string, index long, name string")


def binary_mask_members(df: DataFrame, column: str, width: int) -> DataFrame:
    """Rows by the scenarios whose place in a binary membership mask is 1; a faulty mask is an error."""
    mask = F.col(column)
    sound = (F.size(mask) == width) & F.forall(mask, lambda x: F.coalesce(x.isin(0, 1), F.lit(False)))
    checked = F.when(sound, mask).otherwise(F.raise_error(F.lit("faulty membership mask")).cast("array<int>"))
    return df.select("*", F.posexplode(checked).alias("scenario", "__m")).where("__m = 1").drop("__m")


def drop_columns(df: DataFrame, names: list[str], constants: DataFrame | None = None, crosses: dict[str, list[str]] | None = None) -> DataFrame:
    """Without the named columns and those that a profile (field, distinct) says are constant. A cross
    (name, and the columns that it's made of) stays even if one of these goes."""
    more = [r["field"] for r in constants.where("distinct <= 1").select("field").collect()] if constants is not None else []
    return df.drop(*(c for c in (*names, *more) if c not in (crosses or {})))
