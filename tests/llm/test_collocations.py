"""Phrase collocations against a plain count of all phrases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from brute import lower

from rankloom.llm import collocations as c


def plain(rows, least=30, top=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    own = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    outer = Counter()
    for p, a in own.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                outer[(p[0], *p[i : i + k])] = max(outer[(p[0], *p[i : i + k])], a)
    out = {}
    for p, a in own.items():
        cuts = [(Fraction(2_000_000 * a, f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]).__floor__(), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, left, right = min(cuts)
        if 100 * outer[p] < 80 * a:
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def texts(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "A", "a", "x y", "日本"]
    weights = [1 / (i + 1) for i in range(len(words))]
    passage = "One two THREE four five six"
    rows = []
    for _ in range(n):
        parts = [rng.choice(words[:8]) + rng.choice([". ", "\t", ";", "\n"]) if rng.random() < 0.1 else passage if rng.random() < 0.05 else rng.choices(words, weights)[0] for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([" ", "  ", "\t"]).join(parts)))
    return [*rows, ("en", None), ("en", ""), (None, " . ,"), ("zz", "the " * 3000), ("q", "alone")]


@pytest.mark.parametrize("budget", [3, 1 << 20])
def test_rows_equal_plain_counts(spark, budget):
    rows = texts(1)
    docs = spark.createDataFrame([(t, lang, 1, "x", 2) for lang, t in rows], "text string, lang string, w1 int, word string, n int").repartition(3)
    got = sorted(tuple(r) for r in c.collocations(docs, budget=budget).collect())
    assert got == plain(rows) and {r[0] for r in got} == {"en", "fr", "und", "zz"}
    got = sorted(tuple(r) for r in c.collocations(docs, budget=budget, least=12, top=3).collect())
    assert got == plain(rows, 12, 3)


def test_without_phrases(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert c.collocations(docs).collect() == []
    assert c.collocations(spark.createDataFrame([("a b", "en")], docs.schema)).collect() == []


def counted(rows, monkeypatch, held_ids, segment, heavy_share, held_words=300_000):
    """Phrases of one task's passes, run here."""
    monkeypatch.setattr(c, "HELD_IDS", held_ids)
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "HELD_WORDS", held_words)
    batches = [pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in part]), pa.array([t and t.encode() for _, t in part], pa.binary())], ["lang", "text"]) for part in (rows[:7], rows[7:])]
    words = Counter()
    for b in c._counted(1)(iter(batches)):
        for i, lang, w, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            words[(i, lang, w)] += n
    assert len({i for i, _, _ in words}) == len(words)
    heavy = np.sort(np.array([i for (i, _, _), n in words.items() if n > heavy_share * sum(words.values())], np.int64))
    every = np.full(c.FILTER_BITS // 8, 255, np.uint8)
    blocks = sorted((g, x) for b in c._dealt(1, every, heavy, 5)(iter(batches)) for g, x in zip(*(x.to_pylist() for x in b.columns), strict=True))
    out, by_id = Counter(), {i: (lang, w) for i, lang, w in words}
    cuts = [0, len(blocks) // 2, len(blocks)]
    sent = [pa.RecordBatch.from_arrays([pa.array([g for g, _ in blocks[a:b]], pa.int64()), pa.array([x for _, x in blocks[a:b]], pa.binary())], ["g", "block"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    for b in c._nodes(heavy, 1)(iter(sent)):
        for *w, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            own = [by_id[i] for i in w if i]
            assert len({lang for lang, _ in own}) == 1
            out[(own[0][0], *(x for _, x in own))] += n
    return out, words


@pytest.mark.parametrize("held_ids,segment,heavy_share,held_words", [(1 << 20, 1 << 20, 1.0, 300_000), (1, 1, 0.01, 1), (50, 17, 0.0, 9), (9, 1000, 0.05, 300_000)])
def test_passes_of_a_task(monkeypatch, held_ids, segment, heavy_share, held_words):
    rows = texts(2, 60)
    got, words = counted(rows, monkeypatch, held_ids, segment, heavy_share, held_words)
    want, single = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            single.update((lang or "und", x) for x in w)
            want.update((lang or "und", *w[i : i + k]) for k in range(2, 5) for i in range(len(w) - k + 1))
    assert got == want and {(lang, w): n for (_, lang, w), n in words.items()} == single


def test_score_beyond_64_bits(spark):
    """Counts of which the products don't fit 64 bits are exact."""
    row = spark.sql("SELECT cast(2000000 AS decimal(7,0)) * cast(4000000000000000001L AS decimal(19,0)) AS x, cast(4000000000000000003L AS decimal(20,0)) + cast(4000000000000000005L AS decimal(20,0)) AS y").selectExpr("x div y AS s").first()
    assert row["s"] == 2_000_000 * 4000000000000000001 // 8000000000000000008
