"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes FEATURES numbers: shares of kinds of bytes, shapes of its words and lines,
repetition and length. Trees are grown on a bounded sample of labelled texts: each statistic is cut
into BINS bins at its quantiles, a level of a tree is one histogram of gradients by (node, statistic,
bin), and the best cut of a node is read from running sums over its bins. A fitted model is four flat
arrays; a batch of texts goes down all trees at once, a level at a time, in numpy.

Defined results: null and empty texts are texts with all statistics zero and get a score like any
other. Labels that are null are left out, several labels of one id are averaged, and of rows that
repeat a labelled id one stands for it in the sample. Without labels every score is 0.5. Repeated
rows are scored alike, each on its own; scoring shuffles nothing. Long texts are read in
spans; only the distinct words and lines of one text are held together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, each_value, release_memory
from rankloom.llm.language_id import held_out

#: The sample's bound in labelled rows, and the form of the model.
SAMPLE_ROWS, TREES, LEVELS, BINS, RATE, PENALTY, LEAST_ROWS = 20_000, 80, 4, 64, 0.15, 1.0, 8
#: Bytes of a text whose kinds are counted at a time.
SPAN = 1 << 20

#: Kinds of bytes: other letters are bytes of letters beyond ASCII.
KINDS = ["control", "space", "newline", "digit", "lower", "upper", "other", "end", "pause", "quote", "bar", "sign"]
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in {"space": b" \t", "newline": b"\n\r\x0b\x0c", "digit": b"0123456789", "end": b".!?", "pause": b",;:-", "quote": b"'\"()[]{}", "bar": b"|", "sign": b"#$%&*+/<=>@\\^_`~"}.items():
    _KIND[list(_bytes)] = KINDS.index(_kind)
_KIND[97:123], _KIND[65:91], _KIND[128:] = KINDS.index("lower"), KINDS.index("upper"), KINDS.index("other")
_SPACE, _NEWLINE, _END = KINDS.index("space"), KINDS.index("newline"), KINDS.index("end")
_GAP = re.compile(r"\s")

FEATURES = [f"share_{k}" for k in KINDS] + [f"words_starting_{k}" for k in KINDS[3:]] + [f"words_ending_{k}" for k in KINDS[3:]] + [
    "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "commonest_word", "repeats_last", "repeats_last_but_one", "log_lines", "line_length", "distinct_lines", "commonest_line", "lines_ended", "sentence_words", "exclamations", "entropy",
]


def _spans(text: str) -> Iterator[str]:
    """The text in spans of about SPAN characters that end between words."""
    at = 0
    while len(text) - at > SPAN:
        cut = _GAP.search(text, at + SPAN)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def statistics(text: str | None) -> np.ndarray:
    """The FEATURES of a whole text."""
    n = len(KINDS)
    kinds, starting, ending = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    words: Counter = Counter()
    lines: Counter = Counter()
    length = squares = last = last_but_one = exclamations = 0
    before, open_line = ["", ""], []
    for span in _spans(text or ""):
        data = span.encode("utf-8", "replace")
        kind = _KIND[np.frombuffer(data, np.uint8)]
        kinds += np.bincount(kind, minlength=n)
        gap = (kind == _SPACE) | (kind == _NEWLINE)
        starts, ends = np.nonzero(~gap & np.append(True, gap[:-1])[: len(gap)])[0], np.nonzero(~gap & np.append(gap[1:], True)[: len(gap)])[0]
        starting += np.bincount(kind[starts], minlength=n)
        ending += np.bincount(kind[ends], minlength=n)
        sizes = ends - starts + 1
        length, squares, exclamations = length + int(sizes.sum()), squares + float((sizes.astype(float) ** 2).sum()), exclamations + data.count(b"!")
        own = span.split()
        words.update(own)
        run = before + own
        last += sum(map(eq, run[2:], run[1:]))
        last_but_one += sum(map(eq, run[2:], run))
        before = run[-2:]
        head, *more = span.split("\n")
        open_line.append(head)
        for x in more:
            lines["".join(open_line).strip()] += 1
            open_line = [x]
    lines["".join(open_line).strip()] += 1
    del lines[""]
    n_bytes, n_words, n_lines = int(kinds.sum()), words.total(), lines.total()
    ended = sum(k for x, k in lines.items() if x[-1] in ".!?…。！？")
    b, w, m = max(1, n_bytes), max(1, n_words), max(1, n_lines)
    share = kinds / b
    mean = length / w
    entropy = float(-(share[share > 0] * np.log(share[share > 0])).sum())
    rest = [np.log1p(n_bytes), np.log1p(n_words), mean, max(0.0, squares / w - mean * mean) ** 0.5, len(words) / w, max(words.values(), default=0) / w, last / w, last_but_one / w]
    rest += [np.log1p(n_lines), n_words / m, len(lines) / m, max(lines.values(), default=0) / m, ended / m, n_words / (1 + int(kinds[_END])) if n_words else 0.0, exclamations / b, entropy]
    return np.concatenate([share, starting[3:] / w, ending[3:] / w, rest])


@dataclass
class Trees:
    """Complete trees as flat arrays: node k has its children at 2k + 1 and 2k + 2, and a row goes right
    if its statistic is above the node's limit. A node that isn't cut has an infinite limit."""

    features: np.ndarray  # (trees, nodes)
    limits: np.ndarray  # (trees, nodes)
    leaves: np.ndarray  # (trees, leaves)
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of statistics."""
        total = np.full(len(x), self.base)
        if len(self.features) and len(x):
            trees, rows = np.arange(len(self.features)), np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(trees)), np.int64)
            while (at < self.features.shape[1]).all():  # all trees have the same depth
                at = 2 * at + 1 + (x[rows, self.features[trees, at]] > self.limits[trees, at])
            total = total + self.leaves[trees, at - self.features.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def best_cuts(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, penalty: float = PENALTY, least: int = LEAST_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the statistic and bin of the best cut (up to and with that bin goes left) and its gain, from
    histograms (nodes, statistics, bins)."""
    g, h, n = grad.cumsum(2), hess.cumsum(2), rows.cumsum(2)
    total_g, total_h, total_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
    gain = g**2 / (h + penalty) + (total_g - g) ** 2 / (total_h - h + penalty) - total_g**2 / (total_h + penalty)
    gain = np.where((n >= least) & (total_n - n >= least), gain, 0.0).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    return best // grad.shape[2], best % grad.shape[2], gain[np.arange(len(gain)), best]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for logistic loss; y from 0 to 1."""
    nodes, n = 2**levels - 1, len(x)
    if not n:
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), 0.0)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = np.quantile(x, np.arange(1, bins) / bins, axis=0, method="inverted_cdf")
    code = np.stack([np.searchsorted(edges[:, f], x[:, f]) for f in range(x.shape[1])], axis=1)
    cell = code + bins * np.arange(x.shape[1])
    width = bins * x.shape[1]
    features, limits, leaves = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(levels):
            first, count = 2**level - 1, 2**level
            place = ((at - first)[:, None] * width + cell).ravel()
            histogram = [np.bincount(place, np.repeat(v, x.shape[1]) if v is not None else None, count * width).reshape(count, x.shape[1], bins) for v in (grad, hess, None)]
            feature, bin_, gain = best_cuts(*histogram)
            cut = gain > 1e-9
            features[t, first : first + count] = np.where(cut, feature, 0)
            limits[t, first : first + count] = np.where(cut, edges[np.minimum(bin_, bins - 2), feature], np.inf)
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > limits[t, at])
        leaf = at - nodes
        leaves[t] = -rate * np.bincount(leaf, grad, nodes + 1) / (np.bincount(leaf, hess, nodes + 1) + PENALTY)
        margin += leaves[t, leaf]
    return Trees(features, limits, leaves, base)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t).tolist() for t in each_value(batch.column(2), 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "label", "x"])
    release_memory()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled ids that aren't held out: those with the smallest hashes."""
    bounded_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    sample = own.groupBy("id").agg(F.avg("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.mapInArrow(_described, f"id {kind}, label double, x array<double>").groupBy("id").agg(F.min(F.struct("x", "label")).alias("s"))
    rows = found.select("id", "s.x", "s.label").orderBy("id").collect()
    return grow(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score (0 to 1, higher is better), predicted (1 from ``threshold`` on)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in each_value(batch.column(2), 1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.scores(x))], ["id", "held_out", "score"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
