"""Roles of the columns of nested ranking rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Sequence:
    """A history: aligned list columns by field name; one holds times, one the requests that see each event."""

    name: str
    fields: dict[str, str]
    time: str
    members: str


@dataclass(frozen=True)
class Layout:
    """Which columns belong to requests, candidates, labels and histories. Roles come from these
    lists, never from nesting depth."""

    request_index: str = "context_indices"
    candidate_index: str = "target_indices"
    request_scalars: tuple[str, ...] = ()
    request_bags: tuple[str, ...] = ()
    request_meta: tuple[str, ...] = ()
    candidate_scalars: tuple[str, ...] = ()
    candidate_bags: tuple[str, ...] = ()
    candidate_meta: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    sequences: tuple[Sequence, ...] = ()
    request_time: str | None = None
    missing_labels: tuple[int, ...] = ()

    def kind(self, schema: StructType) -> str:
        """``agg`` with both index columns, ``req`` with neither; one alone is an error."""
        found = [c in schema.names for c in (self.request_index, self.candidate_index)]
        if found[0] != found[1]:
            raise ValueError("only one of the index columns is there")
        return "agg" if all(found) else "req"

    def check(self, schema: StructType) -> list[str]:
        """Columns that the layout names and the schema lacks, except labels."""
        wanted = [*self.request_scalars, *self.request_bags, *self.request_meta, *self.candidate_scalars, *self.candidate_bags, *self.candidate_meta]
        wanted += [c for s in self.sequences for c in (*s.fields.values(), s.members)]
        return sorted(set(wanted) - set(schema.names))
