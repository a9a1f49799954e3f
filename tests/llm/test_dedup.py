import hashlib
import random
import tempfile

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rankloom.llm import exact_dedup, graph, passage_dedup, simhash

ODD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É x"), (6, "é x"), (7, "A b"), (7, "A b"), (None, "a b"), (9, "z" * 50_000), (10, "Z" * 50_000), (11, "퟿\x00 q")]


def exact(rows):
    texts = [(i, brute.lower(t)) for i, t in rows]
    out = []
    for i, t in texts:
        same = [j for j, x in texts if x == t]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [1, 3000, 1 << 26])
def test_exact_groups(frame, budget):
    rng = random.Random(5)
    rows = ODD + [(100 + i, rng.choice(["x", "Hot text", f"text {i % 40}", f"t{i}"]) * rng.randint(1, 2)) for i in range(400)]
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(frame(rows), budget=budget).collect()), key=str)
    assert got == exact(rows)
    kept = exact_dedup.drop_copies(frame(rows), budget=budget)
    assert kept.columns == ["doc_id", "text", "id", "lang", "h", "sha"]
    stay = {(r[0], r[4]) for r in exact(rows) if r[3]}
    assert sorted(((r["doc_id"], hashlib.sha256(brute.lower(r["text"]).encode()).hexdigest()) for r in kept.collect()), key=str) == sorted(stay, key=str)


def rows_of(texts):
    digests = [hashlib.sha256(t).digest() for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(texts, pa.binary()), pa.array([1] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64())], schema=exact_dedup._ROWS)


def test_copies_make_no_spill(monkeypatch):
    """40 MB of one text fit a budget of 1 MB; distinct ones are spilled, and each stays once."""
    spilled = []
    monkeypatch.setattr(exact_dedup, "local_tmp", lambda: spilled.append(1) or tempfile.mkdtemp())
    text = b"x" * 100_000
    tables = list(exact_dedup._grace((rows_of([text] * 10) for _ in range(40)), 0, 1 << 20, []))
    assert not spilled and len(tables) == 1 and tables[0].counts == [400]
    texts = [b"%d" % (i % 700) * 3000 for i in range(1400)]
    tables = list(exact_dedup._grace((rows_of(texts[i : i + 100]) for i in range(0, 1400, 100)), 0, 1 << 20, []))
    assert spilled == [1] and sorted(t for x in tables for t in x.texts) == sorted(set(texts)) and {c for x in tables for c in x.counts} == {2}
    assert max(x.held for x in tables) <= (1 << 20) + 20_000


def test_hash_collisions_compare_content():
    table = exact_dedup.ContentTable()
    for k in range(3000):
        table.add(17, b"d", b"%d" % (k % 1500), 1, k)
    assert len(table.texts) == 1500 and set(table.counts) == {2} and table.largest[0] == 1500


def test_empty_tables(frame):
    none = frame([])
    assert exact_dedup.exact_groups(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_groups(none).count() == simhash.drop_near_copies(none).count() == 0
    assert passage_dedup.repeated_passages(none).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    row, key, indexed = simhash.fuzzy_keys(a)
    other, probe, _ = simhash.fuzzy_keys(b)
    met = {r for r, _ in set(zip(row[indexed].tolist(), key[indexed].tolist(), strict=True)) & set(zip(other.tolist(), probe.tolist(), strict=True))}
    assert len(met) == len(a)


def test_near_groups(frame, documents):
    rows = documents + [(-5, None), (-4, "one"), (-3, "One  two"), (-2, "")] + [(1000 + i, documents[3][1] + f" tail{i}") for i in range(30)]
    got = sorted(tuple(r) for r in simhash.near_groups(frame(rows)).collect())
    assert got == brute.near_groups(rows)
    kept = {r[0] for r in simhash.drop_near_copies(frame(rows)).select("doc_id").collect()}
    assert kept == {i for i, _, c in got if i == c}


def test_bucket_links_all(frame):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 3).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))) for _ in range(60)]))
    want = brute.groups([(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3], [int(f) for f in fps])
    got = brute.groups(simhash.linked(fps, fps), [int(f) for f in fps])
    assert got == want


def test_blocks_of_hot_buckets(spark):
    rng = np.random.default_rng(7)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for _ in range(400)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    want = brute.groups([(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3], [int(f) for f in fps])
    for bucket in (20, 8192):
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, bucket).collect()]
        assert brute.groups(edges, [int(f) for f in fps]) == want


def test_blocks_of_hot_bands(frame, monkeypatch):
    rng = random.Random(12)
    base = passage(rng, 60).split()
    rows = []
    for i in range(50):
        t = list(base)
        t[59] = f"w{i}"
        rows.append((i, " ".join(t)))
    sizes = []
    for bucket in (4, 512):
        monkeypatch.setattr(passage_dedup.similar_contents, "__defaults__", (bucket,))
        sizes.append(sorted((r["doc_id"], r["cluster_id"]) for r in passage_dedup.repeated_passages(frame(rows)).collect()))
    assert sizes[0] == sizes[1] and {c for _, c in sizes[0]} == {0} and len(sizes[0]) == 50


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5)]
    want = brute.groups(edges, {x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def passage(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_passages(frame):
    rng = random.Random(9)
    shared, para = passage(rng, 51), passage(rng, 60)
    changed = para.split()
    changed[30] = "other"
    rows = [(i, passage(rng, 40) + "\n" + passage(rng, 90)) for i in range(40)]
    rows += [(100 + i, passage(rng, 30 + i) + " " + shared + " " + passage(rng, 25)) for i in range(6)]
    rows += [(200, para + "\n" + passage(rng, 30)), (201, passage(rng, 10) + "\n" + " ".join(changed)), (202, None), (203, ""), (204, "a b " * 200)]
    got = {r["doc_id"]: r for r in passage_dedup.repeated_passages(frame(rows)).collect()}
    assert set(got) == {*range(100, 106), 200, 201}
    assert got[100]["removed"] == [] and got[100]["keep_ids"] == [100] and got[200]["removed_words"] == 0
    for i in range(1, 6):
        spans, start = got[100 + i]["removed"], 30 + i
        assert got[100 + i]["cluster_id"] == 100 and set(got[100 + i]["keep_ids"]) <= set(range(100, 101 + i)) and all(start <= s["first"] and s["last"] < start + 51 for s in spans) and got[100 + i]["removed_words"] >= 26
    assert [tuple(s) for s in got[201]["removed"]][0] == (10, 69) and got[201]["cluster_id"] == 200


def test_band_recall_and_candidates():
    """Pairs at a similarity of about 0.8 and over meet; few of those at about 0.3 do."""
    rng = random.Random(3)
    met = {2: 0, 12: 0}
    for edits in met:
        for _ in range(300):
            words = passage(rng, 100).split()
            other = list(words)
            for k in range(edits):
                other[5 + 90 * k // edits] = "zzz"
            w = passage_dedup.Words([" ".join(words), " ".join(other)])
            a, b = w.bands(np.array([0, 100]), np.array([100, 100]))
            met[edits] += bool((a == b).any())
    assert met[2] >= 297 and met[12] <= 90


def test_paragraph_clusters_equal_brute_force():
    rng = random.Random(8)
    base = passage(rng, 60).split()
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(60)] = "".join(rng.choices("xyz", k=5))
        texts.append(" ".join(t))
    sets = [np.unique(passage_dedup.Words([t]).shingles[:56]) for t in texts]
    close = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = brute.groups([(i, j) for i in range(40) for j in range(i + 1, 40) if close(sets[i], sets[j])], range(40))
    for most in (120, 500, 1 << 20):
        assert brute.groups(passage_dedup.similar(list(range(40)), sets, most), range(40)) == want


def test_repeated_passages_are_reported_to_their_ends(frame):
    rng = random.Random(19)
    shared = passage(rng, 51)
    rows = [(i, passage(rng, 30 + i) + " " + shared + " " + passage(rng, 25)) for i in range(12)]
    got = {r["doc_id"]: r for r in passage_dedup.repeated_passages(frame(rows)).collect()}
    assert got[0]["removed"] == []
    for i in range(1, 12):
        assert [tuple(s) for s in got[i]["removed"]] == [(30 + i, 80 + i)] and got[i]["removed_words"] == 51


def test_edited_copies_of_wrapped_text(frame):
    rng = random.Random(20)
    words = passage(rng, 120).split()
    edited = [w if i not in (40, 80) else "zzz" for i, w in enumerate(words)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    rows = [(0, wrap(words, 12)), (1, passage(rng, 5) + "\n\n" + wrap(edited, 11)), (2, wrap(passage(rng, 90).split(), 12))]
    got = {r["doc_id"]: r for r in passage_dedup.repeated_passages(frame(rows)).collect()}
    assert set(got) == {0, 1} and [tuple(s) for s in got[1]["removed"]] == [(5, 124)]
    starts, sizes = passage_dedup.Words([wrap(words, 12), " ".join(words[:60]) + "\nshort line"]).paragraphs()
    assert {(120, 60), (180, 2), (0, 120)} <= set(zip(starts.tolist(), sizes.tolist(), strict=True)) and len(starts) == 13


def test_passages_equal_brute_force(frame):
    """The query's rows against all pairs of units, with null ids, repeated ids, short and very long texts."""
    rng = random.Random(31)
    parts = [passage(rng, n) for n in (6, 9, 14, 20, 30, 51, 60, 80, 120)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice(parts).split() if rng.random() < 0.6 else passage(rng, rng.randint(1, 70)).split()
            for _ in range(rng.choice((0, 0, 0, 1, 2))):
                t[rng.randrange(len(t))] = rng.choice("xyz") * 3
            lines.append(" ".join(t))
        rows.append((i if i % 9 else None, rng.choice(("\n", "\n\n", " ")).join(lines)))
    rows += [(5, parts[8] + " again"), (6, parts[7]), (6, parts[7]), (300, passage(rng, 30_000) + " " + parts[5] + " " + passage(rng, 100)), (301, None), (302, "")]
    got = [(r["doc_id"], [tuple(x) for x in r["removed"]], r["removed_words"], r["keep_ids"], r["cluster_id"]) for r in passage_dedup.repeated_passages(frame(rows)).collect()]
    want = brute.passages(rows)
    assert len(want) > 40 and sorted(got, key=repr) == sorted(want, key=repr)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A bucket split by rarest shingles gives the components of all pairs."""
    rng = random.Random(5)
    base = passage(rng, 60).split()
    texts = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4))):
            t[rng.randrange(1, 60)] = f"w{rng.randrange(40)}"
        texts.append(" ".join(t))
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "k long, h int, text string")
    contents = spark.createDataFrame([(i, (i, i, 0, 60), 0, [7]) for i in range(len(texts))], "cid long, place struct<k:long,h:int,start:int,n:int>, d1 long, bands array<long>")
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    want = brute.groups([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])], range(len(texts)))
    for bucket in (8, 50, 512):
        edges = [tuple(r) for r in passage_dedup.similar_contents(docs, contents, bucket).collect()]
        assert brute.groups(edges, range(len(texts))) == want


def test_documents_without_id_whose_hashes_agree_in_half(frame):
    shared = passage(random.Random(21), 60)
    halves, pair = {}, None
    for i in range(1_000_000):
        half = xxhash.xxh64_intdigest(text := f"{shared} {i}", seed=42) >> 32
        if half in halves:
            pair = halves[half], text
            break
        halves[half] = text
    got = passage_dedup.repeated_passages(frame([(None, pair[0]), (None, pair[1])])).collect()
    assert [r["doc_id"] for r in got] == [None, None] and sorted(r["removed_words"] for r in got) == [0, 61]  # the line is one paragraph


def test_shorter_passages_by_parameter(frame):
    rng = random.Random(22)
    line = passage(rng, 10)
    docs = frame([(i, f"{passage(rng, 60)}\n{line}\n{passage(rng, 60)}") for i in range(3)])
    assert passage_dedup.repeated_passages(docs).count() == 0
    got = passage_dedup.repeated_passages(docs, min_words=1).collect()
    assert sorted((r["doc_id"], r["removed_words"]) for r in got) == [(0, 0), (1, 10), (2, 10)]
