"""Row-local operators on event sequences, kept as arrays of structs so fields stay aligned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_empty(values: Column, kind: str | None = None) -> Column:
    """Null as an empty list."""
    return F.coalesce(values, F.array().cast(kind) if kind else F.array())


def head(values: Column, n: int) -> Column:
    return F.slice(values, 1, n)


def tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - (n - 1), F.lit(1)), F.lit(n))


def compact(events: Column, anchor: str) -> Column:
    """Events whose anchor field isn't null; a dropped event goes from all fields at once."""
    return F.filter(events, lambda e: e[anchor].isNotNull())


def truncate_then_compact(events: Column, n: int, anchor: str, keep: str = "head") -> Column:
    """struct(events, bucket_length): the length is the one before compaction."""
    cut = head(events, n) if keep == "head" else tail(events, n)
    return F.struct(compact(cut, anchor).alias("events"), F.size(cut).alias("bucket_length"))


def visible(events: Column, request: Column, membership: str = "members") -> Column:
    """Events whose membership list holds the request."""
    return F.filter(events, lambda e: F.array_contains(e[membership], request))


def time_deltas(request_time: Column, times: Column, unit: str = "ms") -> Column:
    """Ages of events, newest first, as floats: ms, seconds or log1p of seconds.

    An event after its request, or out of order, is an error."""

    def age(t: Column) -> Column:
        delta = (request_time - t).cast("double")
        delta = delta if unit == "ms" else delta / 1000 if unit == "seconds" else F.log1p(delta / 1000)
        return F.when(t > request_time, F.raise_error(F.lit("event after request")).cast("float")).otherwise(delta.cast("float"))

    unordered = F.exists(F.transform(times, lambda t, i: F.coalesce(F.get(times, i + 1) > t, F.lit(False))), lambda x: x)
    return F.when(unordered, F.raise_error(F.lit("events are not newest first")).cast("array<float>")).otherwise(F.transform(times, age))


def aligned(first: Column, *others: Column) -> Column:
    """Zipped fields of one sequence; a length that differs is an error."""
    same = F.lit(True)
    for other in others:
        same = same & (F.size(first) == F.size(other))
    return F.when(same, F.arrays_zip(first, *others)).otherwise(F.raise_error(F.lit("sequence fields differ in length")))


def singleton(values: Column) -> Column:
    """Null or empty gives null, one element gives it, more is an error."""
    return F.when(values.isNull() | (F.size(values) == 0), F.lit(None)).when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.raise_error(F.lit("more than one value for a scalar")))


def flatten_singletons(values: Column) -> Column:
    """Nested singleton tokens as a flat list; an empty or null inner list gives null, longer is an error."""
    return F.transform(values, singleton)


def flatten_bag(values: Column) -> Column:
    """A nested bag as one list: that of its only inner list, or of inner lists of one value each; several
    inner lists of other lengths are an error."""
    sound = (F.size(values) <= 1) | F.forall(values, lambda x: F.coalesce(F.size(x) == 1, F.lit(False)))
    return F.when(F.coalesce(sound, F.lit(True)), F.flatten(values)).otherwise(F.raise_error(F.lit("a bag is nested in several lists")))


def merged_by_time(streams: dict[str, Column], time: str = "time", clocks: dict[str, str] | None = None) -> Column:
    """All events of several streams, oldest first, as struct(time, stream, place, event).

    Ties: the earlier stream first, then the later place last, so the merge is stable. ``clocks``
    says for each stream whether its times are of day (``timestamp``) or ages (``age``), which count
    backwards; streams of both kinds can't be merged.
    """
    kinds = {(clocks or {}).get(name, "timestamp") for name in streams}
    if len(kinds) > 1:
        raise ValueError(f"streams of different clocks can't be merged: {clocks}")
    if kinds - {"timestamp", "age"}:
        raise ValueError(f"unknown clock: {clocks}")
    sign = -1 if kinds == {"age"} else 1

    def tagged(events: Column, k: int) -> Column:
        return F.transform(events, lambda e, i: F.struct((e[time] * sign if sign < 0 else e[time]).alias("time"), F.lit(k).alias("stream"), i.alias("place"), e.alias("event")))

    parts = [tagged(events, k) for k, events in enumerate(streams.values())]
    return F.array_sort(F.concat(*parts))


def recent(streams: dict[str, Column], n: int, time: str = "time") -> Column:
    """The newest n events over all streams, oldest first; events without time are left out.

    Streams borrow capacity from each other; on equal times the later stream stays.
    """
    timed = {name: F.filter(F.reverse(events), lambda e: e[time].isNotNull()) for name, events in streams.items()}
    return tail(merged_by_time(timed, time), n)


def by_intent(parts: list[Column], separator: Column) -> Column:
    """Streams in the given order with a separator between them."""
    out = [parts[0]]
    for part in parts[1:]:
        out += [F.array(separator), part]
    return F.concat(*out)


def chronological(events: Column) -> Column:
    return F.reverse(events)


def padded(values: Column, width: Column, fill: Column) -> Column:
    """Values with ``fill`` up to ``width``."""
    return F.concat(values, F.array_repeat(fill, F.greatest(width - F.size(values), F.lit(0)).cast("int")))


def length_bucket(length: Column, bounds: list[int]) -> Column:
    """Index of the first bound not below the length; the last bucket takes the rest."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < length))


def sequence_work(lengths: list[Column], limits: list[int], mode: str = "sum") -> Column:
    """Sum or maximum of lengths clamped to their limits."""
    clamped = [F.least(length, F.lit(limit)) for length, limit in zip(lengths, limits, strict=True)]
    if mode == "max":
        return F.greatest(*clamped) if len(clamped) > 1 else clamped[0]
    out = clamped[0]
    for c in clamped[1:]:
        out = out + c
    return out

