"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a ", "  a", " a  b ", "▁a ▁ b", "a ▁", "a\nb \n c", "a \nb", "x" * 300, "\u0000 a", "日本語 テスト 😀😀 ab", "<s> [INST] </s> a", "<|endoftext|> a <|endoftext|>", "naïve—“quote”… it's we'll 'tis ' s", "     " * 7, "a\x1c b\x85 c　 d e", "12 345, .. !? a_b", "word " * 3000]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    a_lib, b_lib = libraries
    vocab = {i: t for t, i in a_lib.get_vocab().items()}
    signs = alignment.byte_of_sign()
    assert len(signs) == 256 == len(set(signs.values()))
    found = []
    for i, text in rows:
        if not text:
            found.append((i, None))
            continue
        a, b, want = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text), (" " + text).encode()
        a_bytes = [bytes(signs[c] for c in vocab[x]) for x in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p := b_lib.id_to_piece(x)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for x in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            found.append((i, None))
            continue
        groups, x, y, left, right = [], 0, 0, 0, 0
        open_a, open_b = [], []
        while x < len(a) or y < len(b):
            if left <= right and x < len(a):
                open_a.append(a[x])
                left += len(a_bytes[x])
                x += 1
            else:
                open_b.append(b[y])
                right += len(b_bytes[y])
                y += 1
            if left == right and open_a and open_b:
                groups.append((open_a, open_b))
                open_a, open_b = [], []
        assert not open_a and not open_b
        found.append((i, (len(a), len(b), groups)))
    held = Counter()
    for _, f in found:
        held.update({(p, q) for g in (f[2] if f else []) for p in g[0] for q in g[1]})
    best = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for g in f[2] for p in g[0] for q in g[1]]
        shown = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in f[2])
        out.append((i, f[0], f[1], len(f[2]), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


def test_rows_equal_whole_texts(frame, libraries, documents):
    rows = documents + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "a b c"), (None, "a b c"), (7, "the end"), (7, "the end"), (2000, " ".join(t or "" for _, t in documents) * 3)]
    docs = frame(rows).withColumn("pair", F.lit(1)).withColumn("chunk", F.lit("x"))
    found = alignment.align(docs, A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, libraries)


def test_no_rows(frame):
    assert alignment.align(frame([(1, "a")]).limit(0), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(frame([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_parts_equal_whole_texts(libraries):
    rng = random.Random(6)
    align = alignment.Aligner(A, B)
    assert align.splits
    signs = ["a", "the", "É", "日", " ", "  ", "\n", "\t", "'s", "'", "...", "12", "▁", "😀", "　", "-", "word", "\x1f"]
    for _ in range(400):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))
        known = align(parts := align.parts(text))
        assert _plain_split(text) == parts
        a = libraries[0].encode(" " + text, add_special_tokens=False).ids
        if known.sound.all():
            got = ";".join(known.shown)
            assert [int(x) for g in got.split(";") for x in g.split("|")[0].split(",")] == a
            assert [int(x) for g in got.split(";") for x in g.split("|")[1].split(",")] == libraries[1].encode(text)
        else:
            assert "".join(libraries[1].id_to_piece(x) for x in libraries[1].encode(text)).replace("▁", " ") != " " + text


def _plain_split(text):
    return alignment._CUT.split(text)


def test_runs_equal_parts_by_themselves(monkeypatch):
    rng = random.Random(9)
    align = alignment.Aligner(A, B)
    parts = list({"".join(rng.choice("abé ▁.1'日") for _ in range(rng.randint(1, 8))) for _ in range(300)})
    runs = align(parts)
    monkeypatch.setattr(alignment, "RUN", 1)
    single = align(parts)
    assert runs.shown == single.shown and (runs.counts == single.counts).all() and (runs.sound == single.sound).all() and not runs.sound.all()
    assert sorted(zip(runs.part, runs.pair, strict=True)) == sorted(zip(single.part, single.pair, strict=True))


def test_forgotten_parts_come_again(monkeypatch):
    """A task that remembers few parts gives the same rows."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["ab", "cd.", "▁", "é", "12"]) + rng.choice("xyz") for _ in range(30))) for i in range(40)]
    align = alignment.Aligner(A, B)
    want = alignment.chunk_row(docs, align)
    for k in range(0, 40, 10):
        assert alignment.chunk_row(docs[k : k + 10], align)[4] == want[4][k : k + 10]
    monkeypatch.setattr(alignment, "KNOWN_PARTS", 2)
    for k in range(0, 40, 10):
        assert alignment.chunk_row(docs[k : k + 10], align)[4] == want[4][k : k + 10] and len(align.numbers) < 20


@pytest.mark.parametrize("size,rows", [(1, 1 << 15), (300, 1 << 15), (1 << 21, 3)])
def test_any_chunks(monkeypatch, size, rows):
    """A task's chunks sum up to the same, however they are cut."""
    texts = [(i, t) for i, t in enumerate(["a b c", "b c", None, "c d e " * 50, "a ▁", "the a b c"] * 5)]
    align = alignment.Aligner(A, B)
    whole = alignment.chunk_row(texts, align)
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "CHUNK_ROWS", rows)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(alignment._CHUNK.format(id="bigint")))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([len(t or "") for _, t in texts], pa.int64()), pa.array([t for _, t in texts])], ["id", "n", "text"])
    made = [b.to_pylist()[0] for b in alignment._chunks(A, B, schema)(iter([batch]))]
    assert len({m["chunk"] for m in made}) == len(made) > (size < 1 << 21 or rows == 3)
    held = Counter()
    for m in made:
        held.update(dict(zip(alignment._unpacked_pairs(m["pairs"]).tolist(), alignment._unpacked(m["holders"])[0].tolist(), strict=True)))
    assert held == dict(zip(alignment._unpacked_pairs(whole[0]).tolist(), alignment._unpacked(whole[1])[0].tolist(), strict=True))
    assert [d for m in made for d in m["docs"]] == whole[4]
