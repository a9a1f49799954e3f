"""Language identification by compression.

For each language a bounded sample of labelled texts becomes a raw-content zstandard
dictionary. A text gets the language whose dictionary makes it smallest. Where the two
smallest sizes are too close the text is rejected: their difference, in units of the square root of
the text's bytes, is at most a bound that fit() takes from further labelled texts, so that at most
REJECT_SHARE of the rightly judged ones fall under it. Chance differences grow as that root and
real ones as the length, so one bound serves every length.

Defined results: a null text or one without letters gets ``und``, score 0 and is rejected. Letters
are what Unicode calls letters; digits, marks and signs such as one half are none. Sizes that tie go
to the language with more training rows, then to the first by name, and are rejected. Without any
labelled row every text is ``und``. Repeated rows are judged alike, each on its own. More than
MAX_LANGUAGES different labels are an error, as every text is coded once for each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, each_value, release_memory

#: Bounds of the training sample: rows a language for its dictionary, characters of a sampled text
#: (a span of a longer one), bytes a dictionary, rows for the bound on rejection over all languages.
SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES, CALIBRATION_ROWS, MAX_LANGUAGES = 96, 4096, 65536, 2400, 200
LEVEL, BLOCK = 6, 8192
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Share of the rightly judged labelled texts that the fitted bound may reject.
REJECT_SHARE = 0.001
UNDETERMINED = "und"


_NOT_LETTERS = re.compile(r"[\W\d_]+")


@lru_cache(1)
def _signs() -> frozenset[str]:
    """Signs with a numeric value, which the pattern above takes for letters."""
    return frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def normalised(text: str | None) -> bytes:
    """Lower-cased letters with single spaces between them; empty if the text has no letter."""
    found = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not found.isascii() and not _signs().isdisjoint(found):
        found = " ".join("".join(" " if c in _signs() else c for c in found).split())
    return found.strip().encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """Dictionaries by language, in order of preference for ties."""

    dictionaries: dict[str, bytes]
    reject_at: float = 0.0
    level: int = LEVEL
    _made: list = field(default_factory=list, repr=False)

    def compressors(self) -> list:
        if not self._made:
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made.append((lang, zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return self._made

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": []}

    def sizes(self, data: bytes) -> tuple[int, int, int]:
        """(smallest size, second smallest, number of the best dictionary). Long texts are coded in blocks, all of them."""
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        found = sorted((sum(len(c.compress(b)) for b in blocks), k) for k, (_, c) in enumerate(self.compressors()))
        return found[0][0], found[1][0] if len(found) > 1 else 2 * found[0][0], found[0][1]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        data = normalised(text)
        if not data or not self.dictionaries:
            return UNDETERMINED, 0.0, True
        best, second, k = self.sizes(data)
        return self.compressors()[k][0], 1 - (best / second) ** 8, (second - best) / len(data) ** 0.5 <= self.reject_at


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Dictionaries and the bound on rejection from the labelled rows that aren't held out.

    The sample is bounded: for each language the rows with the smallest hash of the id, a text of
    each id, and of long texts a span at a place that the hash gives. Only the ids of hashes under
    a bound that follows from the language's count are ranked, so a frequent language does no harm.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return LanguageModel({})
    wanted = sample_rows + CALIBRATION_ROWS // len(counts)
    hashed = rows.withColumn("hash", F.xxhash64("i"))
    # About twice the sample, by a bound on the hash: no frequent language is ranked whole.
    below = {r["l"]: int(2**63 * min(1.0, (2 * wanted + 100) / r["n"]) * 2 - 2**63) for r in counts}
    drawn = F.coalesce(*(F.when(F.col("l") == lang, F.col("hash") <= min(bound, 2**63 - 1)) for lang, bound in below.items()))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("hash", "i"))
    ids = hashed.where(drawn).select("l", "i", "hash").distinct().withColumn("rank", rank).where(F.col("rank") <= wanted).select("l", "i", "rank")
    room = F.greatest(F.lit(1), F.char_length("t") - (SAMPLE_CHARS - 1))
    span = F.substr("t", F.pmod("hash", room).cast("int") + 1, F.lit(SAMPLE_CHARS))
    found = hashed.where(drawn).join(F.broadcast(ids), ["l", "i"]).groupBy("l", "rank").agg(F.min(span).alias("t")).orderBy("rank").collect()
    out: dict[str, bytes] = {}
    for lang in [r["l"] for r in counts]:
        whole = b" ".join(dict.fromkeys(normalised(r["t"]) for r in found if r["l"] == lang and r["rank"] <= sample_rows))
        if whole:
            out[lang] = whole[:DICT_BYTES]
    model = LanguageModel(out)
    right = []
    for r in found if len(out) > 1 else []:
        if r["rank"] > sample_rows and (data := normalised(r["t"])):
            best, second, k = model.sizes(data)
            if model.compressors()[k][0] == r["l"]:
                right.append((second - best) / len(data) ** 0.5)
    right.sort()
    # The value below the share's first text, so that this one stays.
    model.reject_at = max(0.0, math.nextafter(right[int(REJECT_SHARE * len(right))], -math.inf)) if right else 0.0
    return model


def _judged(model: LanguageModel, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.judge(t) for t in each_value(batch.column(text_col))]
            yield batch, got
        release_memory()

    return run


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, rejected. Narrow, no shuffle."""
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    judged = _judged(model, "text")

    def run(batches):
        for batch, got in judged(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                ["id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language isn't rejected."""
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    judged = _judged(model, text_col)

    def run(batches):
        for batch, got in judged(batches):
            yield batch.filter(pa.array([not g[2] for g in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
