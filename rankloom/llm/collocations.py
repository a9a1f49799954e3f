"""Phrase collocations by vertical partitioning of the words' suffixes.

A phrase is 2 to 4 words in a row within a piece of text. Its counts are those of the suffix tree
over all pieces, truncated at the depth of 4 words, which is built in parts:

1. Words are counted by language. A phrase that occurs often enough has frequent words only, so a
   bounded filter of the frequent ones (false positives do no harm) ends suffixes at rare words.
2. Suffixes are dealt out by their prefix. A word that starts no more suffixes than the memory
   budget is a prefix by itself; a heavier one is extended by the next word, and so on up to the
   depth: a prefix with one word within the budget has no more suffixes than that word. Prefixes
   are grouped by hash to as many groups as the corpus holds budgets.
3. A map task folds equal suffixes before it sends them, as one compressed block for each group, so
   a hot phrase is one entry for a task whatever its count. Each group sorts its suffixes and
   reads every node's count from the totals of its leaves. Nodes above an extended prefix lie in
   several groups; their parts are summed.

Words stand as 64-bit hashes of language and word. That no two words share one is checked on the
counted words, where their sum is frequent; if two do, another seed is taken.

What is broadcast: the filter (FILTER_BITS bits) and the heavy words, of which there are at most
HEAVY_WORDS as they are heavier than that share of all words.

Defined results: null and empty texts have no words; a null language is ``und``. Repeated rows count
each. Ids aren't read, other columns neither. Without candidates there are no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.common import bounded_batches, discard, release_memory, written

DEPTH, LEAST, TOP, UNDETERMINED = 4, 30, 2000, "und"
#: Suffixes of a group; bits of the filter of frequent words; the most words that are extended.
BUDGET, FILTER_BITS, HEAVY_WORDS = 1 << 20, 1 << 23, 1 << 16
#: Words that a task counts or remembers, ids that it holds, bytes of text that are split at a time.
HELD_WORDS, HELD_IDS, SEGMENT = 300_000, 1 << 20, 1 << 20
#: Lower-cases A-Z, makes every end of a piece a full stop and a tab a space. None of these is in a word.
_TABLE = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile(rb"[ .]")
_BITMAP = 32768  # of Spark's bitmap functions
_W = [f"w{i + 1}" for i in range(DEPTH)]


def segments(texts: list[bytes | None]) -> Iterator[bytes]:
    """Spans of about SEGMENT bytes that hold the texts in turn, cut between words; a full stop ends each text."""
    held, size = [], 0
    for text in texts:
        data, at = (text or b"").translate(_TABLE), 0
        while len(data) - at > SEGMENT:
            cut = _GAP.search(data, at + SEGMENT)
            if cut is None:
                break
            yield b".".join([*held, data[at : cut.start()]])
            held, size, at = [], 0, cut.start()
        held.append(data[at:])
        size += len(data) - at
        if size >= SEGMENT:
            yield b".".join([*held, b""])
            held, size = [], 0
    if held:
        yield b".".join([*held, b""])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    langs = batch.column(0).to_pylist()
    order: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        order.setdefault(lang, []).append(i)
    for lang, own in order.items():
        yield lang, batch.column(1).take(pa.array(own)).to_pylist()


def _hash(lang: str, word: bytes, seed: int) -> int:
    h = xxhash.xxh64_intdigest(lang.encode() + b"\0" + word, seed) or 1
    return h - (1 << 64) if h >> 63 else h


def _counted(seed: int):
    """Rows (lang, text) give (id, lang, word, n), folded as far as a task can hold its words."""

    def rows(lang: str, counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([_hash(lang, w, seed) for w in words], pa.int64()), pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["id", "lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                for data in segments(texts):
                    held.setdefault(lang, Counter()).update(data.replace(b".", b" ").split())
                    if sum(map(len, held.values())) > HELD_WORDS:
                        yield from (rows(*x) for x in held.items())
                        held = {}
        yield from (rows(*x) for x in held.items())
        del held
        release_memory()

    return run


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Ids(dict):
    """Ids of a language's words; 0 ends a suffix: rare words and full stops."""

    def __init__(self, lang: str, seed: int, frequent: np.ndarray) -> None:
        self.lang, self.seed, self.frequent = lang, seed, frequent
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        h = _hash(self.lang, word, self.seed)
        bit = h & (FILTER_BITS - 1)
        own = self[word] = h if self.frequent[bit >> 3] >> (bit & 7) & 1 else 0
        return own


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Suffixes by word columns: their distinct words, then numbers of these."""
    words = np.unique(np.concatenate(columns))
    codes = [np.searchsorted(words, c).astype(np.uint32 if len(words) > 65535 else np.uint16) for c in columns]
    head = np.array([len(words), len(n)], np.int64)
    return zstandard.compress(b"".join(x.tobytes() for x in [head, words, n.astype(np.uint32), *codes]), 1)


def _unpacked(block: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    data = zstandard.decompress(block)
    a, n = np.frombuffer(data, np.int64, 2).tolist()
    words, at = np.frombuffer(data, np.int64, a, 16), 16 + 8 * a
    counts, at = np.frombuffer(data, np.uint32, n, at).astype(np.int64), at + 4 * n
    kind = np.dtype(np.uint32 if a > 65535 else np.uint16)
    return [words[np.frombuffer(data, kind, n, at + i * kind.itemsize * n)] for i in range(DEPTH)], counts


def _dealt(seed: int, frequent: np.ndarray, heavy: np.ndarray, groups: int):
    """Rows (lang, text) give (g, block): the folded suffixes of two words or more, by group."""

    def blocks(ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Of the suffixes that start before the last DEPTH - 1 ids."""
        n = len(ids) - DEPTH + 1
        own = np.nonzero((ids[:n] != 0) & (ids[1 : n + 1] != 0))[0]
        columns = [ids[own], ids[own + 1]]
        for i in range(2, DEPTH):
            columns.append(np.where(columns[-1] != 0, ids[own + i], 0))
        if not len(own):
            return
        goes_on, prefix = np.ones(len(own), bool), [columns[0]]
        for before, c in zip(columns, columns[1:], strict=False):
            goes_on &= _is_in(before, heavy)
            prefix.append(np.where(goes_on, c, 0))
        g = (_mixed(prefix) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((_mixed(columns), g))  # equal suffixes lie together, but for rare clashes, which stay apart
        columns, g = [c[order] for c in columns], g[order]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
        starts = np.nonzero(new)[0]
        counts, columns, g = np.diff(np.append(starts, len(new))), [c[starts] for c in columns], g[starts]
        cuts = np.append(np.nonzero(np.append(True, g[1:] != g[:-1]))[0], len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(g[a]), _packed([c[a:b] for c in columns], counts[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Ids] = {}
        held: dict[str, list[np.ndarray]] = {}
        end, size = np.zeros(DEPTH - 1, np.int64), 0

        def rows(done: bool) -> Iterator[pa.RecordBatch]:
            """Sends all that is held; of each language the last ids stay, as suffixes may start there."""
            out: list[tuple[int, bytes]] = []
            for lang, parts in held.items():
                ids = np.concatenate([*parts, end] if done else parts)
                if len(ids) >= DEPTH:
                    out += blocks(ids)
                held[lang] = [ids[-(DEPTH - 1) :]]
            for a in range(0, len(out), 64):
                part = out[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.binary())], ["g", "block"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                if sum(map(len, known.values())) > HELD_WORDS:
                    known = {}
                ids = known.setdefault(lang, _Ids(lang, seed, frequent))
                for data in segments(texts):
                    tokens = data.replace(b".", b" . ").split()
                    held.setdefault(lang, []).append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
                    size += len(tokens)
                    if size >= HELD_IDS:
                        yield from rows(False)
                        size = 0
        if held:
            yield from rows(True)
        del known, held
        release_memory()

    return run


def _nodes(heavy: np.ndarray, least: int):
    """Blocks (g, block) sorted by group give the nodes (w1 to w4, n) of each group's subtrees: all that
    occur ``least`` times, and every part of a node above an extended prefix."""

    def tree(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(b) for b in blocks]
        words = np.unique(np.concatenate([np.unique(c) for cs, _ in parts for c in cs] + [np.zeros(1, np.int64)]))
        codes = [np.concatenate([np.searchsorted(words, cs[i]).astype(np.uint64) for cs, _ in parts]) for i in range(DEPTH)]
        counts = np.concatenate([n for _, n in parts])
        del parts
        first, second = (codes[0] << np.uint64(32)) | codes[1], (codes[2] << np.uint64(32)) | codes[3]
        order = np.lexsort((second, first))
        codes, counts = [c[order].astype(np.int64) for c in codes], counts[order]
        is_heavy = _is_in(words, heavy)
        new, above = np.zeros(len(counts), bool), np.ones(len(counts), bool)
        new[0] = True
        for depth in range(DEPTH):
            c = codes[depth]
            new[1:] |= c[1:] != c[:-1]
            above &= is_heavy[c]
            if not depth:
                continue
            starts = np.nonzero(new)[0]
            total = np.add.reduceat(counts, starts)
            own = (words[c[starts]] != 0) & ((total >= least) | above[starts])
            starts, total = starts[own], total[own]
            ids = [words[codes[i][starts]] if i <= depth else np.zeros(len(starts), np.int64) for i in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(total, pa.int64())], [*_W, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for g, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g != group and held:
                    yield from tree(held)
                    held = []
                group = g
                held.append(block)
        if held:
            yield from tree(held)
        del held
        release_memory()

    return run


def _frequent_filter(words: DataFrame, least: int) -> np.ndarray:
    """Bits of the frequent words' ids, built from bitmaps of the tasks."""
    bit = F.col("id").bitwiseAND(FILTER_BITS - 1)
    maps = words.where(F.col("n") >= least).select(F.shiftright(bit, 15).alias("k"), bit.bitwiseAND(_BITMAP - 1).alias("p"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["k"] * _BITMAP // 8 :][: len(own)] = own
    return out


def counted_words(rows: DataFrame, least: int = LEAST) -> tuple[DataFrame, int]:
    """A written table (id, lang, word, n) of all words of (lang, text), and the seed of their ids."""
    for seed in range(1, 17):
        counts = rows.mapInArrow(_counted(seed), "id long, lang string, word string, n long")
        words = written(counts.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        clash = words.groupBy("id").agg(F.count("*").alias("own"), F.sum("n").alias("n")).where((F.col("own") > 1) & (F.col("n") >= least))
        if clash.isEmpty():
            return words, seed
        discard(words)
    raise ValueError("frequent words share an id with each seed")


def phrase_counts(rows: DataFrame, words: DataFrame, seed: int, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """A written table (w1 to w4, n) of the phrases that occur ``least`` times; 0 stands behind a phrase's end."""
    spark = rows.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    least_heavy = max(budget, -(-total // HEAVY_WORDS))
    heavy = np.sort(np.array([r["id"] for r in words.where(F.col("n") > least_heavy).select("id").collect()], np.int64))
    groups = max(math.ceil(total / budget), int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounded_batches(spark)
    dealt = rows.mapInArrow(_dealt(seed, _frequent_filter(words, least), heavy, groups), "g long, block binary")
    found = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_nodes(heavy, least), f"{', '.join(f'{w} long' for w in _W)}, n long")
    return written(found.groupBy(*_W).agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")


def _decimal(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase, its first part and the rest at the cut with the lowest score
    floor(2000000 a / (l + r)), ties to the shortest first part; n counts the language's words. Phrases
    inside a longer one that occurs at least 0.8 times as often are left out.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words, seed = counted_words(rows, least)
    phrases = phrase_counts(rows, words, seed, least, budget)
    frequent = words.where(F.col("n") >= least)
    nodes = phrases.select(F.array_remove(F.array(*_W), F.lit(0).cast("long")).alias("p"), F.col("n").alias("a"))
    parts = nodes.select(F.col("p").alias("part"), F.col("a").alias("n"), F.lit(None).cast("string").alias("lang")).unionByName(frequent.select(F.array("id").alias("part"), "n", "lang"))
    cuts = nodes.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", 1, F.col("k")).alias("first"), F.slice("p", F.col("k") + 1, F.lit(DEPTH)).alias("rest"))
    cuts = cuts.join(parts.select(F.col("part").alias("first"), F.col("n").alias("l"), "lang"), "first").join(parts.select(F.col("part").alias("rest"), F.col("n").alias("r")), "rest")
    exact = cuts.withColumns({"x": F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), "y": _decimal(F.col("l")) + _decimal(F.col("r"))})
    scored = exact.groupBy("p").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r")).alias("best"), F.any_value("a").alias("a"), F.max("lang").alias("lang"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("p") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("p") - n + 1), lambda at: F.slice("p", at, n)))))
    longer = nodes.where(F.size("p") > 2).select(inner.alias("p"), F.col("a").alias("outer")).groupBy("p").agg(F.max("outer").alias("outer"))
    kept = scored.join(longer, "p", "left").where(F.col("outer").isNull() | (F.lit(100).cast("decimal(3,0)") * _decimal(F.col("outer")) < F.lit(80).cast("decimal(2,0)") * _decimal(F.col("a"))))
    kept = kept.select("lang", "p", "a", "best.l", "best.r", "best.score")
    near = kept.withColumn("k", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("k") <= top).drop("k")
    near = written(near, "ranked")
    named = near.select("p", F.posexplode("p").alias("at", "id")).join(frequent.select("id", "word"), "id")
    named = named.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = near.join(named, "p").withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
