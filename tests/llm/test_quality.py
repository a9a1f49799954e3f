"""The quality classifier: plain versions of its parts, and accuracy on rows held out."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.score(docs, quality.fit(docs, labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    rows = found.join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.96
    bad, good = [[r["score"] for r in held if r["quality"] == q] for q in (0, 1)]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) >= 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert len(a.features) and all((getattr(a, x) == getattr(b, x)).all() for x in ("features", "limits", "leaves"))


def slow_score(model, row):
    total = model.base
    for t in range(len(model.features)):
        k = 0
        while k < model.features.shape[1]:
            k = 2 * k + (2 if row[model.features[t, k]] > model.limits[t, k] else 1)
        total += model.leaves[t, k - model.features.shape[1]]
    return 1 / (1 + math.exp(-total))


def test_trees_equal_slow_traversal_and_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.grow(x[:400], y[:400], trees=30, levels=3)
    got = model.scores(x)
    assert np.allclose(got, [slow_score(model, r) for r in x], rtol=1e-12)
    assert ((got[400:] >= 0.5) == y[400:]).mean() > 0.95
    assert model.scores(x[:0]).shape == (0,)


def test_best_cut_equals_every_cut_tried():
    rng = np.random.default_rng(4)
    x, node, bins = rng.integers(0, 6, (200, 3)), rng.integers(0, 2, 200), 6
    grad, hess = rng.normal(size=200), rng.uniform(0.1, 0.3, 200)
    cell = (node[:, None] * 18 + np.arange(3) * bins + x).ravel()
    made = [np.bincount(cell, np.repeat(v, 3), 36).reshape(2, 3, bins) for v in (grad, hess, np.ones(200))]
    feature, cut, gain = quality.best_cuts(*made)
    value = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + quality.PENALTY)
    for k in range(2):
        own = node == k
        tried = {(f, b): value(own & (x[:, f] <= b)) + value(own & (x[:, f] > b)) - value(own) for f in range(3) for b in range(bins) if min((own & (x[:, f] <= b)).sum(), (own & (x[:, f] > b)).sum()) >= quality.LEAST_ROWS}
        assert math.isclose(gain[k], max(tried.values()), rel_tol=1e-9) and math.isclose(tried[feature[k], cut[k]], gain[k], rel_tol=1e-9)


def plain_statistics(text):
    """Some of the statistics, by their definition."""
    text = text or ""
    words, lines, size = text.split(), [x.strip() for x in text.split("\n") if x.strip()], len(text.encode())
    w, m = max(1, len(words)), max(1, len(lines))
    return {
        "share_upper": sum("A" <= c <= "Z" for c in text) / max(1, size), "share_bar": text.count("|") / max(1, size), "log_bytes": math.log1p(size), "log_words": math.log1p(len(words)), "word_length": sum(len(x.encode()) for x in words) / w,
        "distinct_words": len(set(words)) / w, "commonest_word": max(map(words.count, set(words)), default=0) / w, "repeats_last": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, "distinct_lines": len(set(lines)) / m,
        "words_ending_end": sum(x[-1] in ".!?" for x in words) / w, "words_starting_upper": sum("A" <= x[0] <= "Z" for x in words) / w, "log_lines": math.log1p(len(lines)), "lines_ended": sum(x[-1] in ".!?" for x in lines) / m,
    }


@pytest.mark.parametrize("span", [1 << 20, 7, 1])
def test_statistics(monkeypatch, span):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "A b. A b!\nA A | |\n", "é é É ###", "x" * 50, "One two.\n\n One two.\nthree  four\tfive"]
    texts += [" ".join(rng.choice(["A", "b", "c.", "###", "|", "ü!"]) for _ in range(40)) for _ in range(20)]
    monkeypatch.setattr(quality, "SPAN", span)
    for t in texts:
        got = dict(zip(quality.FEATURES, quality.statistics(t), strict=True))
        for k, v in plain_statistics(t).items():
            assert math.isclose(got[k], v, rel_tol=1e-12, abs_tol=1e-12), (t, k)
        assert all(math.isfinite(v) for v in got.values())


def test_edges(spark, frame):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    rows = [(i, " ".join(word() for _ in range(40)) + ".") for i in range(40)] + [(100 + i, " | ".join(word() for _ in range(40))) for i in range(40)]
    rows += [(None, "null id"), (200, None), (201, ""), (7, "again " * 30), (7, "again " * 30), (202, "word " * 400_000)]
    docs = frame(rows).withColumn("x", F.lit(1)).withColumn("label", F.lit("a")).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)] + [(None, 1, 1), (3, None, 0), (100, 0, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert sum(by_id[i]["predicted"] for i in range(40)) >= 38 and sum(by_id[100 + i]["predicted"] for i in range(40)) <= 2
    assert by_id[None]["held_out"] is False and by_id[200]["score"] == by_id[201]["score"]
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, none).collect()} == {(0.5, 1)}
    alike = quality.fit(docs, labels.where("quality = 1"))
    assert all(r["predicted"] == 1 for r in quality.score(docs, alike).collect())
    a, b = quality.fit(docs, labels, sample_rows=30), quality.fit(docs.repartition(5), labels.repartition(2), sample_rows=30)
    assert (a.leaves == b.leaves).all() and (a.limits == b.limits).all()
