"""The pipeline against a plain version, and the registered queries against their SQL."""

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oracle import connection, rows_of, rows_of_sql

import corpus_pipeline
from rankloom.llm import language_id, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r in rows if not model.judge(r[1])[2]]
    last = {brute.lower(t): max(i for i, x in rows if brute.lower(x) == brute.lower(t)) for _, t in rows}
    rows = [(i, t) for i, t in rows if last[brute.lower(t)] == i]
    rows = [r for r, (i, _, c) in zip(sorted(rows), brute.near_groups(rows), strict=True) if i == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute.contamination(rows, items) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<i4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: library.encode(t) for i, t in rows} and 0 < len(got) < docs.count()


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    found = rows_of(queries.QUERIES[name](spark, SF))
    assert found[1]
    if name in queries.ORACLE_SQL:
        assert found == rows_of_sql(connection(SF), queries.ORACLE_SQL[name])


ROWS = [(None, "one two three four"), (None, "one two three four"), (7, "One two three four"), (5, "some text of its own"), (9, "some text of its own"), (5, "another text that stands by itself"), (5, "another text that stands by itself"), (None, None), (3, ""), (None, "alone without an id"), (None, "ALONE without an id")]


def test_no_exact_copy_stays(spark, frame):
    kept = corpus_pipeline.drop_exact_copies(spark, frame(ROWS), SF)
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["text"].lower() if r["text"] else r["text"]) if r["doc_id"] else (False, 0, r["text"].lower()) for r in kept.collect()) == [
        (False, 0, "alone without an id"), (True, 3, ""), (True, 5, "another text that stands by itself"), (True, 7, "one two three four"), (True, 9, "some text of its own"),
    ]
    assert kept.columns == frame(ROWS).columns


def test_one_of_each_near_group_stays(spark, frame):
    rows = [*ROWS, (20, "alone without  an id"), (21, "Some text of its own")]
    kept = [(r["doc_id"], brute.fingerprint(r["text"])) for r in corpus_pipeline.drop_near_copies(spark, frame(rows), SF).collect()]
    every = [brute.fingerprint(t) for _, t in rows]
    root = brute.groups([(a, b) for a in every for b in every if (a ^ b).bit_count() <= 3], every)
    assert len(kept) == len(set(root.values())) == len({root[f] for _, f in kept})
    for i, f in kept:
        ids = [j for (j, _), g in zip(rows, every, strict=True) if root[g] == root[f] and j is not None]
        assert i == min(ids, default=None)


def test_stages_keep_null_texts_defined(spark, frame):
    docs = frame([(1, None), (2, None), (None, None), (3, "a plain text of several words here")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [1, 3]
