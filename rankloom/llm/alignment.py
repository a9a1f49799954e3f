"""Alignment of two tokenizers' ids by the bytes that they stand for.

A text's tokens of A (a byte-level tokenizers file) and of B (a sentencepiece model) each cut the
same bytes. Positions where both end come from an intersection of their cumulative ends, kept as
dictionaries from end to index; the sorted common ends slice both id lists into groups, and the
links of a group are all its pairs.

Texts are split where both tokenizers must end a token (before a space behind a sign that isn't
white space), so a part is aligned by itself, and equal parts once. Documents are worked on in
chunks of about CHUNK_BYTES: a chunk is one row with its distinct pairs, its distinct parts as
lists of pairs, and its documents as lists of parts. A chunk's distinct parts are encoded in runs,
joined by spaces, whose ends all parts must share. How many documents hold a pair is summed over
chunks; each chunk asks for its own pairs once and gets their counts back, so neither texts nor
links are shuffled, a pair that all documents hold is one row for each chunk, and nothing is broadcast.

Defined results: a null or empty text has no tokens, nor has one whose tokens' bytes by A or B
aren't the space and text (such as one with U+2581): zeros and an empty digest. Every row is a
document, so repeated rows count each; ids may be null or repeat. Special strings in texts are
plain text. Long texts are aligned part by part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, each_value, release_memory, written

META = "▁"
#: UTF-8 bytes of text in a chunk, and rows; parts that are encoded as one text.
CHUNK_BYTES, CHUNK_ROWS, RUN = 2 << 20, 1 << 15, 1024
#: Parts that a task remembers.
KNOWN_PARTS = 400_000
_CUT = re.compile(rf"(?<=[^\s{META}]) (?=.)", re.S)
#: What stands before a space at which a text isn't cut.
_UNEVEN = [c + " " for c in map(chr, range(0x3001)) if c.isspace() or c == META]
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_of_sign() -> dict[str, int]:
    """The byte for each sign of a byte-level vocabulary: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The ends that both have, in order, and how many tokens of A and of B end up to each."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    ends = sorted(a_at.keys() & b_at.keys())
    return ends, [a_at[e] for e in ends], [b_at[e] for e in ends]


class Aligned:
    """Parts side by side: ``sound`` if their tokens' bytes are theirs, ``counts`` (parts, 4) of tokens,
    groups and links, ``shown`` groups as text, and all links as ``pair`` (a << 32 | b) with the
    part of each, in order."""

    def __init__(self, parts: int) -> None:
        self.sound, self.counts, self.shown = np.zeros(parts, bool), np.zeros((parts, 4), np.int64), [""] * parts
        self.pair, self.part = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, more: Aligned) -> None:
        """Adds parts behind these."""
        self.pair, self.part = np.append(self.pair, more.pair), np.append(self.part, more.part + len(self.shown))
        self.sound, self.counts = np.append(self.sound, more.sound), np.concatenate((self.counts, more.counts))
        self.shown += more.shown


class Aligner:
    """Parts of texts by both tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        signs = byte_of_sign()
        tokens = {i: bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(META, " ").encode() for p in pieces]
        self.a_sizes, self.b_sizes = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        # Parts stand for themselves if A cuts before such a space and no piece of B has a space behind a letter.
        tried = all(not any(s < 3 < e for _, (s, e) in self.a.pre_tokenizer.pre_tokenize_str(x)) for x in ("abc def", "ab. (de", "it' s a", "12, 34")) if self.a.pre_tokenizer else False
        self.shown_ids = [*map(str, range(max(len(self.a_bytes), len(self.b_bytes))))]
        self.numbers: dict[str, int] = {}
        self.table = Aligned(0)
        self.splits = tried and self.a.normalizer is None and not any(META in p.lstrip(META) for p in pieces)

    def parts(self, text: str) -> list[str]:
        if not self.splits:
            return [text]
        uneven = text[:1] == " " or text[-1:] == " " or any(x in text for x in _UNEVEN)
        return _CUT.split(text) if uneven else text.split(" ")

    def numbered(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The parts of texts as numbers of those in ``table``, where new ones are aligned first."""
        if len(self.numbers) > KNOWN_PARTS:
            self.numbers, self.table = {}, Aligned(0)
        numbers, known = self.numbers, len(self.numbers)
        new = [*set().union(*texts).difference(numbers)]
        numbers.update(zip(new, range(known, known + len(new)), strict=True))
        if new:
            self.table.extend(self(new))
        return [np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts)) for parts in texts]

    def forget(self) -> None:
        """Drop the parts: a Python worker lives on after its task and serves other stages."""
        self.numbers, self.table = {}, Aligned(0)
        release_memory()

    def _run(self, parts: list[str], out: Aligned, at: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Aligns parts ``at`` and on by encoding them as one text, and returns their links; None if that
        text's bytes or the parts' ends aren't met."""
        text = " ".join(parts)
        data, a, b = (" " + text).encode("utf-8", "replace"), self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        ends, a_cuts, b_cuts = common_cuts(np.cumsum(self.a_sizes[a_ids]).tolist(), np.cumsum(self.b_sizes[b_ids]).tolist())
        closes = np.cumsum(np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)) + 1)
        last = np.searchsorted(ends, closes)  # the group that ends each part
        if last[-1] >= len(ends) or not (np.array(ends)[last] == closes).all():
            return None
        a_to, b_to = np.array(a_cuts), np.array(b_cuts)
        a_from, b_from = np.append(0, a_to[:-1]), np.append(0, b_to[:-1])
        wide, high = a_to - a_from, b_to - b_from
        a_text, b_text = [*map(self.shown_ids.__getitem__, a)], [*map(self.shown_ids.__getitem__, b)]
        shown = [f"{a_text[i]}|{b_text[k]}" if j - i == 1 == m - k else f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}" for i, j, k, m in zip(a_from.tolist(), a_cuts, b_from.tolist(), b_cuts, strict=True)]
        first = np.append(0, last[:-1] + 1)
        out.shown[at : at + len(parts)] = [shown[i] if i == j else ";".join(shown[i : j + 1]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        links = np.append(0, np.cumsum(wide * high))
        for c, (until, since) in enumerate(((a_to[last], a_from[first]), (b_to[last], b_from[first]), (last + 1, first), (links[last + 1], links[first]))):
            out.counts[at : at + len(parts), c] = until - since
        out.sound[at : at + len(parts)] = True
        own = np.repeat(np.arange(len(ends)), wide * high)
        place = np.arange(links[-1]) - links[own]
        pair = a_ids[a_from[own] + place // high[own]] << 32 | b_ids[b_from[own] + place % high[own]]
        return pair, at + np.searchsorted(last, own)

    def __call__(self, parts: list[str]) -> Aligned:
        """The parts' alignment, encoded in runs; those that no run meets are encoded by themselves."""
        out, links = Aligned(len(parts)), []
        # A space mark in a part is a space in B's bytes.
        todo = [[i] for i, p in enumerate(parts) if not self.splits and META not in p]
        plain = [i for i, p in enumerate(parts) if self.splits and META not in p]
        todo += [plain[k : k + RUN] for k in range(0, len(plain), RUN)]
        for own in todo:
            some = Aligned(len(own))
            found = self._run([parts[i] for i in own], some, 0)
            if found is None and len(own) > 1:
                todo += [own[: len(own) // 2], own[len(own) // 2 :]]
            elif found is not None:
                where = np.array(own)
                out.sound[where], out.counts[where] = some.sound, some.counts
                for i, text in zip(own, some.shown, strict=True):
                    out.shown[i] = text
                links.append((found[0], where[found[1]]))
        if links:
            pair, part = (np.concatenate(x) for x in zip(*links, strict=True))
            order = np.argsort(part, kind="stable")
            out.pair, out.part = pair[order], part[order]
        return out


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, each with its length."""
    return zstandard.compress(b"".join(np.append(len(c), c).astype("<i4").tobytes() for c in columns), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    whole, out, at = np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64), [], 0
    while at < len(whole):
        out.append(whole[at + 1 : at + 1 + whole[at]])
        at += 1 + int(whole[at])
    return out


def _packed_pairs(pairs: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(pairs, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked_pairs(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<i8"))


_CHUNK = "chunk long, pairs binary, holders binary, links binary, entries binary, docs array<struct<id:{id},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,entries:int>>"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def chunk_row(docs: list[tuple], align: Aligner) -> tuple[bytes, bytes, bytes, bytes, list[dict]]:
    """(pairs, holders, links, entries, docs) of documents (id, text).

    pairs: distinct pairs in order; holders: the documents with each. links: how many each part has, and
    their pairs; entries: parts and times by document, of which a document's own number stands in docs.
    """
    texts = align.numbered([align.parts(text) if text else [] for _, text in docs])
    table = align.table
    own = [x for x in texts if len(x) and table.sound[x].all()]
    used = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
    first = np.searchsorted(table.part, np.arange(len(table.shown) + 1))
    sizes = (first[1:] - first[:-1])[used]
    pairs, pair = np.unique(table.pair[_ranges(first[:-1][used], sizes)], return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    out, parts_of, times_of, holders = [], [], [], np.zeros(len(pairs), np.int64)
    for (i, _), x in zip(docs, texts, strict=True):
        if not len(x) or not table.sound[x].all():
            out.append({"id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "entries": 0})
            continue
        n_a, n_b, n_groups, n_links = table.counts[x].sum(axis=0).tolist()
        digest = hashlib.sha256()
        for at in range(0, len(x), 1 << 14):
            digest.update((";" * bool(at) + ";".join(map(table.shown.__getitem__, x[at : at + (1 << 14)].tolist()))).encode())
        distinct, times = np.unique(x, return_counts=True)
        place = np.searchsorted(used, distinct)
        parts_of.append(place)
        times_of.append(times)
        held = np.zeros(len(pairs), bool)
        held[pair[_ranges(starts[place], sizes[place])]] = True
        holders += held
        out.append({"id": i, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digest.hexdigest(), "entries": len(distinct)})
    none = [np.zeros(0, np.int64)]
    return _packed_pairs(pairs), _packed(holders), _packed(sizes, pair), _packed(np.concatenate(parts_of or none), np.concatenate(times_of or none)), out


def _chunks(a_path: str, b_path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        held: list[tuple] = []
        size = 0

        def row() -> pa.RecordBatch:
            # Chunks of other tasks, and of another run of this one, must not share a number.
            number = int.from_bytes(hashlib.blake2b(np.random.default_rng().bytes(32), digest_size=8).digest(), "little", signed=True)
            values = (number, *chunk_row(held, align))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, n, text in zip(*map(each_value, batch.columns), strict=True):
                held.append((i, text))
                size += n
                if size >= CHUNK_BYTES or len(held) >= CHUNK_ROWS:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()
        align.forget()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, pairs, holders) give (chunk, pair, holders)."""
    for batch in batches:
        for chunk, pairs, holders in zip(*map(lambda c: each_value(c, 1), batch.columns), strict=True):
            own = _unpacked_pairs(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), chunk)), pa.array(own), pa.array(_unpacked(holders)[0])], ["chunk", "pair", "holders"])


def _told(schema: pa.Schema):
    """Rows of a chunk with its pairs' counts, best or not, give its documents' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pairs, (sizes, pair), (part, times) = _unpacked_pairs(batch.column(0)[k].as_py()), _unpacked(batch.column(1)[k].as_py()), _unpacked(batch.column(2)[k].as_py())
                docs, told = batch.column(3).slice(k, 1).flatten(), batch.column(4).slice(k, 1).flatten()
                count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
                if len(told):
                    order = np.searchsorted(pairs, told.field(0).to_numpy(zero_copy_only=False))
                    count[order], best[order] = told.field(1).to_numpy(zero_copy_only=False), told.field(2).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.append(0, np.cumsum(sizes))
                sums = [np.diff(np.append(0, np.cumsum(v[pair]))[ends]) for v in (best, count)]  # by part
                cuts = np.append(0, np.cumsum(docs.field(6).to_numpy(zero_copy_only=False)))
                found = []
                for row in sums:
                    run_sums = np.append(0, np.cumsum(row[part] * times))
                    found.append(pa.array(run_sums[cuts[1:]] - run_sums[cuts[:-1]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(docs.field(i) for i in range(5)), *found, docs.field(5)], schema=schema)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many
    documents as any pair of its A id), count_sum (over the links, the documents that hold the pair), groups_sha256."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"), F.col(text_col).alias("text"))
    shape = StructType.fromDDL(_CHUNK.format(id=kind))
    chunks = written(rows.mapInArrow(_chunks(a_path, b_path, to_arrow_schema(shape)), shape), "chunks")
    asked = written(chunks.select("chunk", "pairs", "holders").mapInArrow(_asked, "chunk long, pair long, holders long"), "pairs")
    counts = asked.groupBy("pair").agg(F.sum("holders").alias("count"))
    counts = written(counts, "pair-counts")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("best"))
    marked = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best"))
    told = asked.join(written(marked, "marked"), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "is_best")).alias("told"))
    out = StructType.fromDDL(f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    joined = chunks.join(told, "chunk", "left").select("pairs", "links", "entries", "docs", F.coalesce("told", F.array().cast("array<struct<pair:long,count:long,is_best:boolean>>")).alias("told"))
    return joined.mapInArrow(_told(to_arrow_schema(out)), out).withColumnRenamed("id", id_col)
