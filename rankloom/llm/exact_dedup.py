"""Exact deduplication by Grace hashing.

Each map task first folds the copies it meets, so a text that a third of all rows share leaves
a task once for each table that it fills. The distinct texts are shuffled by hash and folded as they
arrive in an open-addressing table, which compares complete content. Only if the distinct ones are
beyond a task's budget it partitions them by further hash bits to spill files, and those again, until
a bucket fits. Every document then joins its
group's summary on the digest; the join's sides are both shuffled, so Spark can split a hot key.

Defined results: texts are equal when identical after lower-casing A-Z; null counts as empty.
The largest id of a group stays; a null id is smaller than any other. Rows that repeat both id
and text each get a row, and all with the group's largest id are marked kept.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import ASCII_LOWER, ascii_lower, bounded_batches, each_value, local_tmp, release_memory, rows_kept

#: Bytes of text that a table or an unpartitioned run of rows holds; ways each spill level splits.
BUDGET_BYTES, WAYS = 16 << 20, 16
_MAX_LEVEL = 14


class ContentTable:
    """Open addressing over 64-bit hashes; a slot matches only if the complete contents do."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.digests: list[bytes] = []
        self.counts: list[int] = []
        self.largest: list[int | None] = []
        self.held = 0

    def _grow(self) -> None:
        slots = np.full(len(self.slots) * 4, -1, np.int64)
        mask = len(slots) - 1
        for i, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = i
        self.slots = slots

    def add(self, h: int, digest: bytes, text: bytes, count: int, largest: int | None) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.texts[i] == text:
                self.counts[i] += count
                if largest is not None and (self.largest[i] is None or largest > self.largest[i]):
                    self.largest[i] = largest
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.digests.append(digest)
        self.texts.append(text)
        self.counts.append(count)
        self.largest.append(largest)
        self.held += len(text) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def _hash(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


_ROWS = pa.schema([("digest", pa.binary()), ("text", pa.binary()), ("n", pa.int64()), ("largest", pa.int64())])


def _rows_of(table: ContentTable, step: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i, text in enumerate(table.texts):
        held += len(text)
        if held >= step or i + 1 == len(table.texts):
            part = slice(start, i + 1)
            yield pa.RecordBatch.from_arrays([pa.array(table.digests[part], pa.binary()), pa.array(table.texts[part], pa.binary()), pa.array(table.counts[part], pa.int64()), pa.array(table.largest[part], pa.int64())], schema=_ROWS)
            start, held = i + 1, 0


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct texts of a map task, as far as a table's budget goes at a time."""
    table = ContentTable()
    for batch in batches:
        for i, t in zip(each_value(batch.column(0)), each_value(batch.column(1)), strict=True):
            text = normalised(t)
            digest = hashlib.sha256(text).digest()
            table.add(_hash(digest), digest, text, 1, i)
            if table.held > BUDGET_BYTES:
                yield from _rows_of(table)
                table = ContentTable()
    yield from _rows_of(table)
    del table
    release_memory()


def _grace(batches: Iterator[pa.RecordBatch], level: int, budget: int, folder: list[str]) -> Iterator[ContentTable]:
    """Tables that together hold each distinct text once.

    Rows are folded before anything is spilled, so copies of few texts make no spill whatever
    their number. A table beyond the budget goes to the files of its rows' hash bits.
    """
    table = ContentTable()
    files: dict[int, tuple] = {}
    top = ""

    def spill() -> None:
        nonlocal table, top
        if not top:
            if not folder:
                folder.append(local_tmp())
            top = os.path.join(folder[0], f"{level}-{os.urandom(6).hex()}")
            os.makedirs(top)
        for batch in _rows_of(table):
            ways = (np.array([_hash(d) for d in batch.column(0).to_pylist()], np.uint64) >> np.uint64(4 * level)) % np.uint64(WAYS)
            for way in np.unique(ways).tolist():
                if way not in files:
                    sink = pa.OSFile(os.path.join(top, str(way)), "wb")
                    files[way] = (sink, pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                files[way][1].write_batch(batch.filter(pa.array(ways == way)))
        table = ContentTable()

    for batch in batches:
        for digest, text, n, largest in zip(*map(each_value, batch.columns), strict=True):
            table.add(_hash(digest), digest, text, n, largest)
            if table.held > budget and len(table.texts) > 1 and level < _MAX_LEVEL:
                spill()
    if not files:
        yield table
        return
    spill()
    for sink, writer in files.values():
        writer.close()
        sink.close()
    for way in sorted(files):
        path = os.path.join(top, str(way))
        with pa.OSFile(path, "rb") as source:
            yield from _grace(iter(pa.ipc.open_stream(source)), level + 1, budget, folder)
        os.remove(path)


def _grouped(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder: list[str] = []
        try:
            for t in _grace(batches, 0, budget, folder):
                yield pa.RecordBatch.from_arrays([pa.array([d.hex() for d in t.digests], pa.string()), pa.array([len(x) for x in t.texts], pa.int64()), pa.array(t.counts, pa.int64()), pa.array(t.largest, pa.int64())], ["sha", "n_bytes", "group_size", "keep_id"])
        finally:
            for path in folder:
                shutil.rmtree(path, ignore_errors=True)
            release_memory()

    return run


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET_BYTES) -> DataFrame:
    """One row per distinct text: sha, n_bytes, group_size, keep_id. One shuffle of the distinct texts of each map task."""
    bounded_batches(docs.sparkSession, 8 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    parts = rows.mapInArrow(_fold, "digest binary, text binary, n long, largest long")
    return parts.repartition("digest").mapInArrow(_grouped(budget), "sha string, n_bytes long, group_size long, keep_id long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(hashlib.sha256(t).hexdigest(), len(t)) for t in map(normalised, each_value(batch.column(1)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["i", "sha", "n_bytes"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET_BYTES) -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256."""
    members = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(_digests, "i long, sha string, n_bytes long")
    joined = members.join(text_groups(docs, id_col, text_col, budget), ["sha", "n_bytes"])
    return joined.select(F.col("i").alias(id_col), "keep_id", "group_size", F.col("i").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET_BYTES) -> DataFrame:
    """One row of ``docs``, with all its columns, for each text: that with the largest id.

    Null ids come last; of rows that repeat the id and the text one stays, whichever it is. The kept
    ids and digests are a skinny semi-join side.
    """
    kept = text_groups(docs, id_col, text_col, budget).select(F.col("keep_id").alias("id"), F.col("sha").alias("mark"))
    return rows_kept(docs, kept, id_col, F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256))
