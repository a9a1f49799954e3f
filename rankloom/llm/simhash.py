"""Near-duplicate documents by SimHash and Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded to the 23 bits of the perfect
Golay code. A segment's keys are the codewords nearest to it: one, or six where the nearest is
three bits away. Then two words a bit apart share a key, and the decoded codeword of either is
among the keys of the other. If two fingerprints differ in at most three bits, the two segments
with the fewest differences have at most one each. So it is enough to index a fingerprint by
the pair of decoded codewords for each two segments and to probe with all pairs of keys. Only
distinct fingerprints are keyed. A bucket gives a spanning set of edges, not all its pairs. One of
more than BUCKET rows is cut into blocks of its two sides, and each pair of blocks is a group of
its own, so no task holds more than two blocks. Components over the edges give the groups.

Defined results: null and empty texts have no shingles and fingerprint zero, which links like
any other. Copies share a fingerprint and so a component. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import ASCII_LOWER, bounded_batches, broadcast_if_small, each_value, release_memory, rows_kept, written
from rankloom.llm.graph import components

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Shingles whose bits are counted at a time, and comparisons made at a time in a bucket.
BLOCK, COMPARED = 200_000, 1 << 22
#: Rows of a bucket, or of either side of a block pair, that one group may have.
BUCKET, BROADCAST_BYTES = 8192, 8 << 20
#: (shift, bits) of the segments, and the generator polynomial of the Golay code.
SEGMENTS, GENERATOR = ((0, 22), (22, 21), (43, 21)), 0b110001110101


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """(id, fp) of every document, and ``mark`` of its row if given; fp is the fingerprint's bits as a long."""
    more = [] if mark is None else [mark.cast("string").alias("mark")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in each_value(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])
        release_memory()

    bounded_batches(docs.sparkSession, 8 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, "id long, fp long" + ", mark string" * len(more))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the 12 high bits; for each syndrome its error patterns: the leader, then
    those of weight 4 where the leader has weight 3, else the leader again."""

    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - 11)
        return v

    high = np.array([remainder(d << 11) for d in range(1 << 12)], np.int64)
    syndrome = lambda e: int(high[e >> 11]) ^ (e & 0x7FF)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            own = patterns[syndrome(e)]
            if not own or weight == 4 and own[0].bit_count() == 3:
                own.append(e)
    return high, np.array([own + own[:1] * (6 - len(own)) for own in patterns], np.int64)


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words: column 0 the decoded one; repeats fill up."""
    high, patterns = _tables()
    errors = patterns[high[words >> 11] ^ (words & 0x7FF)]
    return (words[:, None] ^ errors) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, indexed) for fingerprints as uint64: the keys each is probed with; ``indexed``
    marks the one for each two segments under which it is found."""
    keys = [golay_keys(((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for shift, bits in SEGMENTS]
    fresh = [np.concatenate((np.ones((len(k), 1), bool), k[:, 1:] != k[:, :1]), axis=1) for k in keys]
    rows, out, indexed = [], [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        own = (keys[i][:, :, None] << 12 | keys[j][:, None, :]) + (pair << 24)
        row, x, y = np.nonzero(fresh[i][:, :, None] & fresh[j][:, None, :])
        rows.append(row)
        out.append(own[row, x, y])
        indexed.append((x == 0) & (y == 0))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(indexed)


def linked(found: np.ndarray, probes: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that span what ``bits`` or fewer differing bits link between a bucket's two sides."""
    edges: list[tuple[int, int]] = []
    if len(found) * len(probes) <= 4 and len(found) == 1 == len(probes):
        return edges
    root = np.arange(len(probes))
    step = max(1, COMPARED // len(probes))
    for at in range(0, len(found), step):
        part = found[at : at + step]
        near = np.bitwise_count(part[:, None] ^ probes[None, :]) <= bits
        for x in np.nonzero(near.sum(axis=1) > 1)[0]:
            hit = np.nonzero(near[x])[0]
            trees, first = np.unique(root[hit], return_index=True)
            if len(trees) > 1:
                own = int(part[x])
                edges += [(own, int(p)) for p in probes[hit[first]] if int(p) != own]
                root[np.isin(root, trees)] = trees[0]
    return edges


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
        for at in range(0, len(whole), 4096):
            fps = whole[at : at + 4096]
            row, key, indexed = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(indexed)], ["key", "fp", "indexed"])


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group is linked as soon as its last row is there."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def edges_of(keys, fps, indexed) -> pa.RecordBatch:
        cuts = np.concatenate(([0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]))
        out: list[tuple[int, int]] = []
        sizes, found = np.diff(cuts), np.add.reduceat(indexed.astype(np.int64), cuts[:-1])
        for k in np.nonzero((sizes > 1) & (found > 0))[0]:
            s, e = cuts[k], cuts[k + 1]
            out += linked(fps[s:e][indexed[s:e]], fps[s:e])
        return pa.RecordBatch.from_arrays([_signed([x[0] for x in out]), _signed([x[1] for x in out])], ["a", "b"])

    def joined() -> list[np.ndarray]:
        return [np.concatenate([p[i] for p in held]) for i in range(3)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        keys, fps, indexed = np.stack(columns[:3], axis=1), columns[3].astype(np.int64).view(np.uint64), columns[4]
        same = (keys == keys[-1]).all(axis=1)
        last = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
        if last or held and (held[0][0][0] != keys[0]).any():
            held.append((keys[:last], fps[:last], indexed[:last]))
            yield edges_of(*joined())
            held = []
        held.append((keys[last:], fps[last:], indexed[last:]))
    if held:
        yield edges_of(*joined())
    del held
    release_memory()


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span what MAX_BITS links."""
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long, indexed boolean")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("indexed").alias("own")).where(F.col("n") > bucket)
    blocks = lambda c: F.ceil(F.col(c) / bucket).cast("int")
    hot = written(sizes.select("key", F.greatest(F.lit(1), blocks("own")).alias("s"), blocks("n").alias("t")), "hot-keys")
    zero = F.lit(0)
    if hot.isEmpty():
        rows = keyed.select("key", zero.alias("i"), zero.alias("p"), "fp", "indexed")
    else:
        place = lambda i, p, own: F.struct(i.alias("i"), p.alias("p"), F.lit(own).alias("indexed"))
        block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "fp"), F.col(n)).cast("int")
        probes = F.transform(F.sequence(zero, F.col("s") - 1), lambda i: place(i, block(1, "t"), False))
        found = F.transform(F.sequence(zero, F.col("t") - 1), lambda p: place(block(2, "s"), p, True))
        none = F.slice(probes, 1, 0)
        places = F.when(F.col("s").isNull(), F.array(F.struct(zero.alias("i"), zero.alias("p"), F.col("indexed").alias("indexed")))).otherwise(F.concat(probes, F.when(F.col("indexed"), found).otherwise(none)))
        rows = keyed.join(broadcast_if_small(hot, BROADCAST_BYTES), "key", "left").select("key", "fp", F.inline(places)).select("key", "i", "p", "fp", "indexed")
    group = ["key", "i", "p"]
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_bucket_edges, "a long, b long")


def _linked_fps(fps: DataFrame) -> DataFrame:
    """A written table (fp, root, least) of the fingerprints (fp, least) that any other links to."""
    roots = components(links(fps))
    return written(roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()).join(fps, "fp"), "linked")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    own = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fp")
    linked_fps = _linked_fps(fps)
    smallest = written(linked_fps.groupBy("root").agg(F.min("least").alias("component")), "smallest-id")
    groups = fps.join(linked_fps.join(smallest, "root").select("fp", "component"), "fp", "left")
    groups = written(groups.select("fp", F.coalesce("component", "least").alias("component_id")), "groups")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(groups, "fp").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each group: that with the smallest id.

    Null ids come last; of rows that share the id the one with the first digest of its text stays, and
    of rows that repeat both one, whichever it is.
    """
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark"))
    fps = written(fingerprints(docs, id_col, text_col, mark).groupBy("fp").agg(first.alias("least")), "distinct-fp")
    linked_fps = _linked_fps(fps)
    alone = fps.join(linked_fps.select("fp"), "fp", "left_anti").select("least.id", "least.mark")
    kept = linked_fps.groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.mark").unionByName(alone)
    return rows_kept(docs, written(kept, "kept"), id_col, mark)
