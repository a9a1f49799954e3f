"""Token counts of whole texts, from batches of about equal bytes.

An Arrow function returns lengths only. Spark's batches for it are bounded by bytes, as are the runs
of texts that are encoded together. Texts are split at safe boundaries, where no piece of
the vocabulary can reach across, so the counts of the parts add up to the count of the text;
equal parts of a batch are encoded once. A run holds about BATCH_BYTES of text however
long single texts are.

Defined results: a null text counts as empty, with no bytes and no tokens. Repeated rows are
counted alike, each on its own; rows keep their partition and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, each_value

BATCH_BYTES, CACHED_PARTS, CACHED_CHARS = 4 << 20, 300_000, 40
META = "▁"
_SAFE_SPACE = re.compile(f"(?<=[^ {META}]) ")
#: Texts longer than this are split before a space between letters for tokenizers of the .json kind.
LONG_CHARS = 50_000
_LETTER_SPACE = re.compile(r"(?<=[a-z]) (?=[a-z])")


def word_parts(text: str) -> list[str]:
    """Parts for a vocabulary whose pieces hold the space mark at their start only.

    Each part but the first stands for a space and what follows up to the next word. The space
    itself is left out: the library puts one in front of whatever it encodes.
    """
    if "  " in text or META in text or text[:1] == " ":
        return _SAFE_SPACE.split(text)
    return text.split(" ")


class PieceCounter:
    """Counts for a sentencepiece model with a dummy prefix, identity normalisation and no piece
    that holds a space mark after another character."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.plain = any(META in name.lstrip(META) for name in names)
        self.known: dict[str, int] = {}
        self.space = len(self.library.encode("a ")) - len(self.library.encode("a"))

    def __call__(self, texts: list[str]) -> list[int]:
        if self.plain:
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        known = self.known
        if len(known) > CACHED_PARTS:
            known.clear()
        known[""] = self.space
        parts = [word_parts(t) for t in texts]
        new = list(set().union(*parts).difference(known))
        if new:
            known.update(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
        out = [sum(map(known.__getitem__, p)) if t else 0 for t, p in zip(texts, parts, strict=True)]
        for part in new:
            if len(part) > CACHED_CHARS:
                del known[part]
        return out


class FastCounter:
    """Counts for a tokenizers file; special strings are handled as the file has them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.splits = self._splits_before_spaces()

    def _splits_before_spaces(self) -> bool:
        """Whether no token of this file reaches from a small letter to a space after it."""
        norm, before = self.library.normalizer, self.library.pre_tokenizer
        if before is None or any(_LETTER_SPACE.search(t.content) for t in self.library.get_added_tokens_decoder().values()):
            return False
        shown = norm.normalize_str if norm else str
        tried = ("ab", " cd"), ("it", " a"), ("zz", " is it")
        whole = all(shown(x + y) == shown(x) + shown(y) for x, y in tried)
        return whole and all(not any(start < len(x) < end for _, (start, end) in before.pre_tokenize_str(shown(x + y))) for x, y in tried)

    def __call__(self, texts: list[str]) -> list[int]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            for p in long_parts(t) if self.splits else [t]:
                parts.append(p)
                owner.append(i)
        out = [0] * len(texts)
        for i, x in zip(owner, self.library.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            out[i] += len(x.ids)
        return out


def long_parts(text: str, limit: int = LONG_CHARS) -> list[str]:
    """Parts of about ``limit`` characters, cut before a space between two lower-case letters."""
    out, start = [], 0
    while len(text) - start > limit:
        cut = _LETTER_SPACE.search(text, start + limit)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def by_bytes(texts: Iterable[str], sizes: Iterable[int] | None = None, limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``limit`` bytes each; ``sizes`` are known byte counts."""
    run, held = [], 0
    for t, n in zip(texts, sizes, strict=True) if sizes is not None else ((t, len(t.encode("utf-8", "replace"))) for t in texts):
        run.append(t)
        held += n
        if held >= limit:
            yield run
            run, held = [], 0
    if run:
        yield run


@lru_cache(4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    return PieceCounter(path) if path.endswith(".model") else FastCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            counts = [n for texts in by_bytes(each_value(batch.column(2)), each_value(batch.column(1))) for n in count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
