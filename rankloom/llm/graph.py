"""Connected components by alternating large-star and small-star rounds.

Only edges and per-node minima move; no task gathers a node's neighbours. Each round is written
to the shared folder, and the joins read written tables on both sides, so Spark can split the
partition of a node with very many edges. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import discard, written

#: Edges that a map task folds to spanning stars at a time.
FOLD_EDGES = 400_000


def spanning(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for every node that isn't its own smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []

    def stars() -> pa.RecordBatch:
        out = spanning(iter(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    for batch in batches:
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) >= FOLD_EDGES:
            yield stars()
    yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge to another node; root is the smallest node reachable.

    Self-loops and repeated edges are allowed; nodes are longs; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    stars = written(pairs.mapInArrow(_folded, "a long, b long").distinct(), "stars")
    state = None
    for _ in range(rounds):
        found = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == (found["n"], found["h"]):
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (found["n"], found["h"])
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        smallest = written(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        discard(stars, least)
        moved = large.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(moved.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(large, smallest)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
