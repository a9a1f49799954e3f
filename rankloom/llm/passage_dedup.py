"""Repeated passages across documents by paragraph MinHash banding.

Units of one pass over the texts, all banded, verified and clustered alike:

- Paragraphs: every line, and every run of lines of at most WRAPPED words, which are wrapped text.
  They get BANDS keys of ROWS MinHash values over their 5-word shingles: a pair at a similarity of
  0.8 misses all of them in 1 of 150 cases, at 0.85 in 1 of 800; one at 0.3 meets in 1 of 6. Up to 7 words a
  similarity of 0.8 means equality, so shorter lines meet on their content alone.
- Blocks: a sliding block of LOOK shingles goes over each text of LOOK + UNIT - 1 = 51 words or
  more, and the MinHash of one function picks its start of a unit of UNIT words; that value is its
  band key, and half of its digest. Any two copies of a passage of 51 words or more share a block, whatever stands around
  them and wherever lines end.

Equal units are one content, by 128 bits of digest. Distinct contents that share a band are
verified by exact Jaccard in their bucket, which gives spanning edges, and form clusters by
components. A bucket of more than BUCKET contents is split by their rarest shingles there: two
sets of a similarity of 0.8 must share one of the first size - ceil(0.8 size) + 1 by frequency, so
nothing is lost. What is still as large is cut into blocks, and each two of these are a group of
their own, so no task holds more than two.

Of each cluster the copy in the document with the smallest id, then the first place, stays. The
ends of a document's run of units that go are grown word by word as far as they equal the kept
copy; as LOOK - 1 words at most lie between a passage's end and its outermost unit, REACH suffice.
Neighbouring units make a passage, which is reported from ``min_words`` words on, by default
MIN_PASSAGE: less is a phrase or a boilerplate line. With 1 every repeated run is reported.

Defined results: null and empty texts have no units. Repeats within one document alone are left.
A document is an id with a text (64 bits of its hash): rows that repeat both are one document, and
rows with a null id are told apart by their text. Documents without a repeated passage get no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import ASCII_LOWER, discard, each_value, release_memory, written
from rankloom.llm.graph import components

SHINGLE, SIMILARITY, MIN_PASSAGE = 5, 0.8, 26
BANDS, ROWS, UNIT, LOOK = 7, 3, 13, 39
WRAPPED, REACH = 40, LOOK - 1
#: Lines of fewer words are equal if similar.
BANDED_WORDS = 8
BUCKET, SHINGLES_AT_ONCE, FILTER_BUCKETS, _NO_ID = 4096, 1 << 20, 1 << 18, -(1 << 63)
#: Characters of text that are cut at a time; words whose hashes a task remembers.
BATCH_CHARS, KNOWN_WORDS = 1 << 20, 400_000
_LAST = np.uint64(2**64 - 1)
_RANDOM = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, (3, 80), dtype=np.uint64) | np.uint64(1)
_KEY = ["k", "h"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of consecutive ranges in one array, and where each range begins in it."""
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(int(sizes.sum())), at


class _Known(dict):
    """Hashes of words, computed on first sight."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that begin at each word; LAST at the end, where none does."""
    whole = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole += hashes[j : j + len(whole)] * _RANDOM[2, j]
    return np.append(_mixed(whole), np.full(SHINGLE, _LAST))


class Words:
    """The words of some texts side by side, A-Z lower-cased, as hashes."""

    def __init__(self, texts: Iterable[str | None], known: _Known | None = None) -> None:
        known = _Known() if known is None else known
        words: list[bytes] = []
        lines: list[int] = []
        cuts, line_cuts = [0], [0]
        for text in texts:
            for line in _lowered(text).split(b"\n"):
                own = line.split()
                words += own
                lines.append(len(own))
            cuts.append(len(words))
            line_cuts.append(len(lines))
        self.n = len(words)
        self.hashes = known.hashes(words)
        self.cuts, self.lines, self.line_cuts = np.array(cuts), np.array(lines, np.int64), np.array(line_cuts)
        self.shingles = _shingles(self.hashes)

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and word counts of lines and of runs of wrapped ones."""
        starts = np.cumsum(self.lines) - self.lines
        wrapped = (self.lines > 0) & (self.lines <= WRAPPED)
        first = np.zeros(len(self.lines) + 1, bool)
        first[self.line_cuts] = True
        opens = wrapped & (first[:-1] | ~np.append(False, wrapped[:-1]))
        run = np.cumsum(opens)[wrapped] - 1
        sizes = np.bincount(run, self.lines[wrapped]).astype(np.int64)
        several = np.bincount(run) > 1
        full = self.lines > 0
        return np.concatenate((starts[full], starts[opens][several])), np.concatenate((self.lines[full], sizes[several]))

    def blocks(self) -> np.ndarray:
        """Starts of the units that the sliding block picks."""
        if self.n < LOOK + UNIT - 1:
            return np.zeros(0, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.shingles[: self.n], LOOK)
        at = np.arange(len(views))
        end = np.repeat(self.cuts[1:], np.diff(self.cuts))[: len(views)]
        at = at[at + LOOK - 1 <= end - UNIT]
        return np.unique(np.concatenate([at[i : i + 50_000] + views[at[i : i + 50_000]].argmin(axis=1) for i in range(0, len(at), 50_000)])) if len(at) else at

    def digests(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Two 64-bit digests of each range of words."""
        if not len(starts):
            return np.zeros((2, 0), np.uint64)
        at, cuts = _ranges(starts, sizes)
        words, place = self.hashes[at], (at - np.repeat(starts, sizes)).astype(np.uint64)
        return np.array([_mixed(np.add.reduceat(words * (_mixed((place + np.uint64(1)) * _RANDOM[2, k]) | np.uint64(1)), cuts) + sizes.astype(np.uint64)) for k in (11, 12)])

    def bands(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Band keys, a row for each range of words."""
        keys = np.zeros((BANDS, len(starts)), np.uint64)
        if not len(starts):
            return keys.T
        at, cuts = _ranges(starts, sizes - SHINGLE + 1)
        own = self.shingles[at]
        for b in range(BANDS):
            for r in range(ROWS):
                k = b * ROWS + r
                least = np.minimum.reduceat((own ^ (own >> np.uint64(29))) * _RANDOM[0, k] + _RANDOM[1, k], cuts)
                keys[b] = _mixed((keys[b] ^ least) + _RANDOM[2, 32 + k])
        return keys.T


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of a column's texts of about BATCH_CHARS together, with the row of the first."""
    at, run, held = 0, [], 0
    for i, text in enumerate(each_value(column)):
        run.append(text)
        held += len(text or "")
        if held >= BATCH_CHARS:
            yield at, run
            at, run, held = i + 1, [], 0
    if run:
        yield at, run


_UNITS = "k long, h long, start int, n int, d1 long, d2 long, bands array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        for at, texts in _texts(batch.column(2)):
            w = Words(texts, known)
            starts, sizes = w.paragraphs()
            blocks = w.blocks()
            banded = sizes >= BANDED_WORDS
            keys = w.bands(starts[banded], sizes[banded])
            widths = np.concatenate((np.where(banded, BANDS, 0), np.zeros(len(blocks), np.int64)))
            starts, sizes = np.concatenate((starts, blocks)), np.concatenate((sizes, np.full(len(blocks), UNIT)))
            text = np.searchsorted(w.cuts, starts, "right") - 1
            digests = w.digests(starts, sizes)
            digests[0, len(starts) - len(blocks) :] = _mixed(w.shingles[blocks] + _RANDOM[2, 30])
            is_block = np.arange(len(starts)) >= len(starts) - len(blocks)
            digests = digests.view(np.int64)
            own = pa.array(text + at)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(widths)), pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=pa.array(is_block))
            columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(starts - w.cuts[text], pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests[0]), pa.array(digests[1]), bands]
            yield pa.RecordBatch.from_arrays(columns, ["k", "h", "start", "n", "d1", "d2", "bands"])
    del known
    release_memory()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, shingles) of the wanted places (start, n, cid) of each text; only their words are hashed."""
    known = _Known()
    for batch in batches:
        for at, texts in _texts(batch.column(0)):
            words: list[bytes] = []
            cids, cuts = [], [0]
            for text, wanted in zip(texts, each_value(batch.column(1).slice(at, len(texts))), strict=True):
                own = _lowered(text).split()
                for x in wanted:
                    cids.append(x["cid"])
                    words += own[x["start"] : x["start"] + x["n"]]
                    cuts.append(len(words))
            found = _shingles(known.hashes(words))
            sets = [np.unique(found[s : e - SHINGLE + 1]).view(np.int64) for s, e in zip(cuts, cuts[1:])]  # noqa: B905
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(values))], ["cid", "shingles"])
    del known
    release_memory()


def similar(cids: list[int], sets: list[np.ndarray], most: int = SHINGLES_AT_ONCE) -> list[tuple[int, int]]:
    """Spanning edges between the members of a bucket whose shingle sets have SIMILARITY or more. If
    they have more than ``most`` shingles together, each two parts of half of that are compared in turn."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(set(sets[0].tolist()).intersection(sets[1].tolist())) if sizes.min() >= SIMILARITY * sizes.max() - 1e-9 else 0
        return [(cids[0], cids[1])] if common >= SIMILARITY * (sizes.sum() - common) - 1e-9 else []
    part = np.cumsum(sizes) // (most // 2 + 1)
    if len(numbers := np.unique(part)) > 2:
        parts = [np.nonzero(part == p)[0] for p in numbers]
        pairs = [np.concatenate((x, y)) for i, x in enumerate(parts) for y in parts[i + 1 :]]
        return [e for own in pairs for e in similar([cids[i] for i in own], [sets[i] for i in own], int(sizes[own].sum()) * 2)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    cuts = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    root, edges = np.arange(len(sets)), []
    for x in range(len(sets)):
        if not root.any():
            break
        own = ids[offsets[x] : offsets[x + 1]]
        common = np.bincount(np.concatenate([owner[order[cuts[i] : cuts[i + 1]]] for i in own]), minlength=len(sets))
        hit = np.nonzero(common >= SIMILARITY * (sizes + sizes[x] - common) - 1e-9)[0]
        trees, first = np.unique(root[hit], return_index=True)
        if len(trees) > 1:
            edges += [(cids[x], cids[y]) for y in hit[first] if y != x]
            root[np.isin(root, trees)] = trees[0]
    return edges


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, cid, shingles) come sorted by group; each group gives its edges."""

    def edges(cids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        one = dict(zip(cids, sets, strict=True))
        return similar(list(one), list(one.values())) if len(one) > 1 else []

    key, cids, sets = None, [], []
    for batch in batches:
        out: list[tuple[int, int]] = []
        values, offsets = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
        for i, (*k, c) in enumerate(zip(*(batch.column(x).to_pylist() for x in range(4)), strict=True)):
            if k != key:
                out += edges(cids, sets)
                key, cids, sets = k, [], []
            cids.append(c)
            sets.append(values[offsets[i] : offsets[i + 1]])
        sets = [s.copy() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
    out = edges(cids, sets)
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
    release_memory()


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents (k, h, text) with the wanted list of each. A filter of at most FILTER_BUCKETS
    numbers spares most of the others the shuffle."""
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(FILTER_BUCKETS))
    some = docs.join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")
    return some.join(wanted, _KEY)


def _blocks(members: DataFrame, counts: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, i, j, cid): members (key, cid) of keys that several have, by group of two blocks."""
    shared = counts.where("n > 1").select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return members.join(shared, "key").select("key", F.inline(pairs), "cid")


def _rarest(members: DataFrame, shingles: DataFrame) -> DataFrame:
    """(key, cid): contents of large buckets by the shingles of which two similar ones must share one.
    Shingles are ordered by how many of these contents have them, whatever their buckets, so each
    content's are listed once."""
    tokens = written(members.select("cid").distinct().join(shingles, "cid").select("cid", F.size("shingles").alias("size"), F.explode("shingles").alias("s")), "tokens")
    counts = written(tokens.groupBy("s").agg(F.count("*").alias("f")), "token-counts")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("f", "s"))
    first = tokens.join(counts, "s").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-9) + 1)
    out = written(first.where("f > 1").select(F.col("s").alias("key"), "cid"), "rarest")
    discard(tokens, counts)
    return out


def similar_contents(docs: DataFrame, contents: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct contents (cid, place, d1, bands) that Jaccard verifies; docs: k, h,
    text. Contents without a list of bands are blocks, and d1 is their key."""
    keyed = contents.select("cid", F.explode(F.coalesce("bands", F.array("d1"))).alias("key"))
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    met = written(keyed.join(counts, "key"), "colliding")
    discard(counts)
    wanted = contents.join(met.select("cid").distinct(), "cid").groupBy(F.col("place.k").alias("k"), F.col("place.h").alias("h"))
    wanted = written(wanted.agg(F.collect_list(F.struct(F.col("place.start").alias("start"), F.col("place.n").alias("n"), "cid")).alias("wanted")), "wanted")
    found = _texts_of(docs, wanted).select("text", "wanted").mapInArrow(_shingled, "cid long, shingles array<long>")
    shingles = written(found.dropDuplicates(["cid"]), "shingles")
    discard(wanted)
    groups = met.where(F.col("n") <= bucket_rows).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "cid")
    large = met.where(F.col("n") > bucket_rows)
    if not large.isEmpty():
        first = _rarest(large, shingles)
        groups = groups.unionByName(_blocks(first, first.groupBy("key").agg(F.count("*").alias("n")), bucket_rows))
    group = ["key", "i", "j"]
    rows = groups.join(shingles, "cid").select(*group, "cid", "shingles")
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(_linked, "a long, b long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))


def repeated_units(docs: DataFrame) -> DataFrame:
    """Units of documents (k, h, text) in clusters over more than one document: k, h, start, n and their kept copy."""
    units = written(docs.mapInArrow(_cut, _UNITS), "units")
    folded = units.groupBy("d1", "d2").agg(F.min(F.struct("k", "h", "start", "n")).alias("place"), F.max("k").alias("last_k"), F.max("h").alias("last_h"), F.any_value("bands").alias("bands"))
    several = (F.col("last_k") > F.col("place.k")) | (F.col("last_h") > F.col("place.h"))  # with one k the place has the least h
    contents = written(folded.select("d1", "d2", "place", several.alias("several"), "bands", F.monotonically_increasing_id().alias("cid")), "contents")
    roots = components(similar_contents(docs, contents))
    roots = written(roots.select(F.col("node").alias("cid"), "root").unionByName(roots.select(F.col("root").alias("cid"), "root").distinct()), "roots")
    own = contents.drop("bands").join(roots, "cid", "left").where(F.col("root").isNotNull() | F.col("several")).withColumn("root", F.coalesce("root", "cid"))
    own = written(own, "rooted")
    doc = F.struct("place.k", "place.h")
    clusters = own.groupBy("root").agg(F.min("place").alias("keep"), F.max("several").alias("several"), F.max(doc).alias("last"))
    clusters = clusters.where(F.col("several") | (F.struct("keep.k", "keep.h") < F.col("last"))).select("root", "keep")
    clusters = written(clusters, "clusters")
    kept = written(own.join(clusters, "root").select("d1", "d2", "keep"), "kept")
    discard(contents, roots, own, clusters)
    met = units.drop("bands").join(kept, ["d1", "d2"])
    return met.select("k", "h", "start", "n", *(F.col(f"keep.{x}").alias(f"keep_{x}") for x in ("k", "h", "start", "n")))


class _Units:
    """The units of a batch of documents (k, h, units), side by side."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        lists = batch.column(2)
        self.doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        rows = lists.flatten()
        self.start, self.n, self.keep_k, self.keep_h, self.keep_start, self.keep_n = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(6))
        self.k, self.h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        self.end = self.start.astype(np.int64) + self.n
        self.same = (self.keep_k == self.k[self.doc]) & (self.keep_h == self.h[self.doc])
        self.stays = self.same & (self.keep_start == self.start)

    def runs(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen units: their numbers by document and place, which of them open a run of units
        that touch, and how far the run reaches by then."""
        order = np.nonzero(some)[0]
        order = order[np.lexsort((self.end[order], self.start[order], self.doc[order]))]
        far = self.doc[order].astype(np.int64) << 40  # no unit reaches into the next document
        reached = np.maximum.accumulate(far + self.end[order]) if len(order) else far
        opens = np.append(True, far[1:] + self.start[order][1:] > reached[:-1])[: len(order)]
        return order, opens, reached - far


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, h, units): both ends of each run of units that don't stay, with the place in the kept copy."""
    for batch in batches:
        u = _Units(batch)
        order, opens, reached = u.runs(~u.stays)
        closes = np.append(opens[1:], True)[: len(order)] & (u.end[order] == reached)
        left, right = order[opens & ~u.same[order]], order[closes & ~u.same[order]]
        both = np.concatenate((left, right))
        is_right = np.arange(len(both)) >= len(left)
        at, keep_at = np.where(is_right, u.end[both], u.start[both]), u.keep_start[both] + np.where(is_right, u.keep_n[both], 0)
        columns = [(u.k[u.doc[both]], pa.int64()), (u.h[u.doc[both]], pa.int64()), (at, pa.int32()), (is_right, pa.bool_()), (u.keep_k[both], pa.int64()), (u.keep_h[both], pa.int64()), (keep_at, pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["k", "h", "at", "right", "keep_k", "keep_h", "keep_at"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, h, at, right, near) of the wanted places (at, right) of each text: hashes of the REACH words
    after or before a place, the nearest first; 0 past the text's end."""
    known = _Known()
    for batch in batches:
        for at, texts in _texts(batch.column(2)):
            words: list[bytes] = []
            rows, sizes = [], []
            for i, (text, wanted) in enumerate(zip(texts, each_value(batch.column(3).slice(at, len(texts))), strict=True)):
                own = _lowered(text).split()
                for x in wanted:
                    near = own[x["at"] : x["at"] + REACH] if x["right"] else own[max(0, x["at"] - REACH) : x["at"]][::-1]
                    words += near
                    rows.append((i + at, x["at"], x["right"]))
                    sizes.append(len(near))
            found = np.zeros((len(rows), REACH), np.uint64)
            found[np.arange(REACH) < np.array(sizes, np.int64)[:, None]] = np.maximum(known.hashes(words), np.uint64(1))
            own = pa.array([x[0] for x in rows], pa.int64())
            near = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.bool_()), near], ["k", "h", "at", "right", "near"])
    del known
    release_memory()


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, h, at, right, keep_k, keep_h, keep_at, near, keep_near) give the words that both have there, as units of either."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, REACH) for i in (7, 8))
        same = ((a == b) & (a != 0)).cumprod(axis=1).sum(axis=1)
        back = np.where(batch.column(3).to_numpy(zero_copy_only=False), 0, same)
        at, keep_at, n = (pa.array(x, pa.int32()) for x in (batch.column(2).to_numpy() - back, batch.column(6).to_numpy() - back, same))
        kept = [batch.column(4), batch.column(5), keep_at, n]
        for own in ([batch.column(0), batch.column(1), at, n], kept):
            yield pa.RecordBatch.from_arrays([*own, *kept], ["k", "h", "start", "n", "keep_k", "keep_h", "keep_start", "keep_n"])


def _by_document(units: DataFrame) -> DataFrame:
    return units.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n", "keep_k", "keep_h", "keep_start", "keep_n")).alias("units"))


def grown(docs: DataFrame, units: DataFrame) -> DataFrame:
    """What the ends of the runs of ``units`` share further with their kept copies, as rows like units."""
    ends = written(_by_document(units).mapInArrow(_ends, "k long, h long, at int, right boolean, keep_k long, keep_h long, keep_at int"), "ends")
    kept = ends.select(F.col("keep_k").alias("k"), F.col("keep_h").alias("h"), F.col("keep_at").alias("at"), "right")
    wanted = ends.select("k", "h", "at", "right").unionByName(kept).groupBy(*_KEY).agg(F.collect_set(F.struct("at", "right")).alias("wanted"))
    near = _texts_of(docs, written(wanted, "wanted-ends")).select("k", "h", "text", "wanted").mapInArrow(_near, "k long, h long, at int, right boolean, near binary")
    near = written(near.dropDuplicates(["k", "h", "at", "right"]), "near")
    other = near.select(F.col("k").alias("keep_k"), F.col("h").alias("keep_h"), F.col("at").alias("keep_at"), "right", F.col("near").alias("keep_near"))
    rows = ends.join(near, [*_KEY, "at", "right"]).join(other, ["keep_k", "keep_h", "keep_at", "right"])
    rows = rows.select("k", "h", "at", "right", "keep_k", "keep_h", "keep_at", "near", "keep_near")
    return rows.mapInArrow(_grow, "k long, h long, start int, n int, keep_k long, keep_h long, keep_start int, keep_n int").where("n > 0")


def _spans(u: _Units, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the chosen units: document, start, end; and the chosen units' numbers with their run."""
    order, opens, reached = u.runs(some)
    first = np.nonzero(opens)[0]
    last = np.append(first[1:], len(order))[: len(first)] - 1
    run = np.full(len(some), -1)
    run[order] = np.cumsum(opens) - 1
    return u.doc[order[first]], u.start[order[first]].astype(np.int64), reached[last], run


def _reported(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u = _Units(batch)
        _, start, end, run = _spans(u, np.ones(len(u.doc), bool))
        inside = (end - start >= min_words)[run] if len(run) else np.zeros(0, bool)
        doc, first, last, _ = _spans(u, inside & ~u.stays)
        docs = np.unique(u.doc[inside])
        cuts = np.searchsorted(doc, np.append(docs, len(batch)))
        spans = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last - 1, pa.int32())], ["first", "last"])
        sums = np.append(0, np.cumsum(last - first))
        pairs = np.unique(np.stack((u.doc[inside], u.keep_k[inside]), axis=1), axis=0)
        at = np.searchsorted(pairs[:, 0], np.append(docs, len(batch)))
        keep = pa.array(pairs[:, 1], pa.int64(), mask=pairs[:, 1] == _NO_ID)
        columns = [pa.array(u.k[docs], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans), pa.array(sums[cuts[1:]] - sums[cuts[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), keep), keep.take(pa.array(at[:-1]))]
        yield pa.RecordBatch.from_arrays(columns, ["k", "removed", "removed_words", "keep_ids", "cluster_id"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_PASSAGE) -> DataFrame:
    """One row per document with a repeated passage of ``min_words`` words or more: id, removed (word ranges first to last whose
    kept copy is elsewhere), removed_words, keep_ids (documents that hold the kept copies, itself
    included where its own stay), cluster_id (the smallest of keep_ids)."""
    docs = _keyed(docs, id_col, text_col)
    units = written(repeated_units(docs), "repeated")
    found = _by_document(units.unionByName(grown(docs, units))).mapInArrow(partial(_reported, min_words=min_words), "k long, removed array<struct<first:int,last:int>>, removed_words long, keep_ids array<long>, cluster_id long")
    return found.select(F.nullif("k", F.lit(_NO_ID)).alias(id_col), "removed", "removed_words", "keep_ids", "cluster_id")
