import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rankloom.llm import common, decontamination, html_text, language_id, piece_codec, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a ", "  a", " a  b ", "▁a ▁ b", "a\nb \n c", "x" * 900, "\u0000 a", "日本語 テスト 😀😀", "a▁", "<s> [INST] </s>", "\n\n a\n", "naïve—“quote”…", "     " * 7, "<|endoftext|> a", "word " * 30_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    kept = [r for r in held if not r["rejected"]]
    assert sum(r["rejected"] and r["lang_pred"] == r["lang"] for r in found) / len(found) < 0.01
    assert sum(r["lang_pred"] == r["lang"] for r in kept) / len(kept) >= sum(r["lang_pred"] == r["lang"] for r in held) / len(held)


#: Words of the first English documents.
ENGLISH = "is and retitioning ouen the of nterti thorreou ndernt is ndble whst the by for and threea ores the oredat the anntly re"


def test_language_edges(spark, frame):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs)
    rows = frame([(1, None), (2, ""), (3, "123 !!"), (4, ENGLISH), (None, ENGLISH), (4, ENGLISH), (5, "the")])
    got = sorted((tuple(r) for r in language_id.identify(rows, model).collect()), key=str)
    assert [g[2:] for g in got if g[0] in (1, 2, 3)] == [("und", 0.0, True)] * 3
    assert len(got) == 7 and {g[2:3] + g[4:] for g in got if g[0] == 4} == {("en", False)}
    assert [g[2:] for g in got if g[0] == 5] == [("en", 0.0, True)]  # a text this short has one size for all
    kept = language_id.keep_identified(rows, model)
    assert kept.columns == rows.columns and kept.count() == 3
    unlabelled = language_id.fit(docs.withColumn("lang", docs["lang"].substr(0, 0)).where("lang <> ''"))
    assert {r["lang_pred"] for r in language_id.identify(rows, unlabelled).collect()} == {"und"}
    assert language_id.identify(frame([]), model).count() == 0


def test_signs_are_no_letters():
    for text in ("\u00bd \u00b2 \u2460 \u2167", "12 \u0663", "_ \u00bd_", "\u0301"):
        assert language_id.normalised(text) == b""
    assert language_id.normalised("A1b \u00e9\u00bdX \u65e5\u672c") == "a b é x 日本".encode()


def test_no_labelled_language_is_lost(spark, frame):
    """Languages with very long or very short texts only are learned; an id that repeats gives one text; ties are rejected."""
    rng = random.Random(12)
    words = {letters: ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(40)] for letters in ("abcd", "wxyz", "mnop")}
    text = lambda letters, n: " ".join(rng.choice(words[letters]) for _ in range(n))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, text("abcd", 3000), "long") for i in ids[:20]] + [(i, text("wxyz", 3), "short") for i in ids[20:200]] + [(ids[200], text("mnop", 300), "one")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert set(model.dictionaries) == {"long", "short", "one"}
    new = [(1, text("abcd", 40)), (2, text("wxyz", 40)), (3, text("mnop", 40)), (4, text("abcd", 60_000))]
    assert [r["lang_pred"] for r in sorted(language_id.identify(frame(new), model).collect())] == ["long", "short", "one", "long"]
    tied = language_id.LanguageModel({"b": b"same words", "a": b"same words"})
    got = language_id.identify(frame([(1, "same words"), (2, "same words")]), tied).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in got} == {("b", True)}


def test_narrow_margin_is_rejected():
    same = b"the quick brown fox jumps over the lazy dog " * 20
    model = language_id.LanguageModel({"a": same, "b": same})
    assert model.judge("the quick brown fox jumps over the lazy dog " * 4)[2]


def test_token_counts(frame, documents, library):
    rows = documents + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(frame(rows), MODEL).collect()}
    for i, t in rows:
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(frame([]), MODEL).count() == 0


def test_token_batches(spark, frame):
    """Runs are balanced by bytes, and Spark's batches are bounded by them."""
    texts = ["é" * n for n in (10, 700, 5, 900, 20, 3000, 1, 1)]
    runs = list(token_counts.by_bytes(texts, [len(t.encode()) for t in texts], 1000))
    assert [t for r in runs for t in r] == texts and all(sum(len(t.encode()) for t in r[:-1]) < 1000 for r in runs)
    assert runs == list(token_counts.by_bytes(texts, limit=1000))
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")  # other tests leave a smaller limit, which would stay
    assert sorted((tuple(r) for r in token_counts.count_tokens(frame(rows), MODEL).collect()), key=str) == [(1, 3, 2, False), (1, 3, 2, False), (None, 3, 2, False)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(16 << 20)
    sizes = []

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    big = spark.range(60).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    sizes = [r["n"] for r in big.mapInArrow(seen, "n long").collect()]
    assert len(sizes) > 2 and max(sizes) < 20 << 20


def test_long_texts_are_split_where_the_file_allows():
    counter = token_counts.FastCounter(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.splits and token_counts.FastCounter(public_tokenizers.path("word_bpe_49k.json")).splits
    counter.library.pre_tokenizer = None
    assert not counter._splits_before_spaces()


def test_other_tokenizers(frame):
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        rows = [(i, t) for i, t in enumerate(ODD)]
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame(rows), path).collect()}
        assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_piece_encoding(frame, documents, library):
    rng = random.Random(2)
    letters = "ab the ing▁\n éüñ日😀.,<0x>  "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["".join(rng.choice(["the", "ing", "tion", "a"]) for _ in range(900))]
    rows = documents[:60] + [(1000 + i, t) for i, t in enumerate(texts)] + [(5000, None)]
    for chunk in (37, 200, piece_codec.CHUNK_CHARS):
        found = piece_codec.encode(frame(rows), MODEL, chunk=chunk)
        got = {r["doc_id"]: r for r in found.collect()}
        for i, t in rows:
            ids = library.encode(t or "")
            assert np.frombuffer(got[i]["ids"], "<i4").tolist() == ids and got[i]["n_tokens"] == len(ids) and got[i]["exact"] == ("▁" not in (t or ""))
    back = {r["doc_id"]: r["text"] for r in piece_codec.decode(found, MODEL).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert piece_codec.encode(frame([]), MODEL).count() == 0


def test_distinct_words_are_solved_on_arrays(library):
    """Pairs of pieces are judged by how the pieces grow, as the merges judge them, and not by merging each pair."""
    rng, model = random.Random(3), piece_codec.PieceModel(MODEL)
    pieces = sorted(model.whole_pieces)
    pairs = [(rng.choice(pieces), rng.choice(pieces)) for _ in range(3000)] + [(p[:k], p[k:]) for p in rng.sample(pieces, 500) for k in range(1, len(p)) if {p[:k], p[k:]} <= model.whole_pieces]
    assert all(model.agree(a, b) == (model.merged(a + b) == [a, b]) for a, b in pairs)
    words = ["".join(rng.choices("etaoinshrdluéñ,.", k=rng.randint(1, 14))) for _ in range(20_000)]
    texts = [*(" ".join(words[i : i + 40]) for i in range(0, len(words), 40)), *ODD, "".join(words[:600]), *("".join(rng.choices("ethaino", k=90)) for _ in range(100)), "\U0010ff41é\ufffd"]
    merges = []
    model.merged = lambda text: merges.append(text)
    found = model.whole(texts)
    assert not merges
    assert [np.frombuffer(x, "<i4").tolist() for x in found.to_pylist()] == library.encode(texts)
    assert model.same(found, [f" {t}" if t else t for t in texts]) == ["▁" not in t for t in texts]
    assert not any(model.same(found, [f" {t}x" for t in texts]))


def test_tables_of_numbers():
    table, held = piece_codec.Numbers(64, "<i4"), {}
    for start in (0, 10, 20, 30, 40):  # the fourth doesn't fit
        keys = np.arange(start, start + 10) * 7919
        held = (held if start != 30 else {}) | dict(zip(keys.tolist(), range(start, start + 10), strict=True))
        table.add(keys, np.arange(start, start + 10))
        every = np.arange(60) * 7919
        assert table.find(every).tolist() == [held.get(k, -1) for k in every.tolist()]


def test_products_in_any_order(spark):
    """Pairwise products and their way back give the best path, as plain dynamic programming does."""
    rng = random.Random(8)
    rows, want = [], {}
    for uid, n in ((1, 1), (2, 2), (3, 5), (4, 8), (5, 13)):
        edges = [{(a, b): float(rng.randint(0, 1 << 40)) for a in range(1 if k == 0 else 3) for b in range(3) if rng.random() < 0.8 or a == b} for k in range(n)]
        best = {0: (0.0, (0,))}
        for own in edges:
            after = {}
            for (a, b), x in own.items():
                if a in best and (b not in after or best[a][0] + x > after[b][0]):
                    after[b] = best[a][0] + x, (*best[a][1], b)
            best = after
        want[uid] = max(best.values())
        rows += [(uid, k, a, 0, b, 0, x) for k, own in enumerate(edges) for (a, b), x in own.items()]
    rng.shuffle(rows)
    found = piece_codec.boundary_pieces(spark.createDataFrame(rows, "uid long, k long, s0 long, s1 long, e0 long, e1 long, score double").repartition(3)).collect()
    score = {(u, k, a, b): x for u, k, a, _, b, _, x in rows}
    for uid, (total, _) in want.items():
        own = sorted((r["k"], r["s0"], r["e0"]) for r in found if r["uid"] == uid)
        assert [k for k, *_ in own] == list(range(len(own))) and all(x[2] == y[1] for x, y in zip(own, own[1:], strict=False))
        assert sum(score[uid, k, a, b] for k, a, b in own) == total


def test_other_model_types_are_refused(monkeypatch):
    real = sentencepiece.SentencePieceProcessor

    class Unigram:
        def __init__(self, **more):
            self.inner = real(**more)

        def __getattr__(self, name):
            return (lambda i: -1.5) if name == "get_score" else getattr(self.inner, name)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError, match="BPE"):
        piece_codec.PieceModel(MODEL)


def test_giant_texts_with_clashing_columns(frame, library):
    text = "the thing and ▁ tion " * 300
    rows = [(1, text), (1, text), (None, text[:-1]), (2, "x")]
    got = piece_codec.encode(frame(rows).withColumnRenamed("h", "uid"), MODEL, chunk=500).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<i4").tolist()) for r in got) == sorted((str(i), library.encode(t)) for i, t in rows)


def bench_items():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(12)]
    return [*items, (3, items[3][1]), (3, "Another TEXT of item three"), (50, None), (51, "?! ,"), (52, "the the the the the the the the the the the the the the the"), (53, "of the")], word, rng


def test_contamination(spark, frame):
    items, word, rng = bench_items()
    items += [(60, "\u212a"), (61, "\u017ftone of \u0130 and \u212aelvin"), (62, "K of k")]
    docs = [(1, None), (2, ""), (3, "..."), (4, "the " * 40), (70, "k only here"), (71, "K x"), (72, "a \u212a"), (73, "stone of i and kelvin"), (74, "\u017ftone of \u0130 AND \u212aelvin"), (75, "k of K"), (76, "\u212a of k"), (5, items[2][1]), (5, items[2][1]), (5, "other text"), (None, items[4][1].upper()), (6, "OF. the, Of")]
    for i in range(60):
        own = [word() for _ in range(rng.randint(0, 60))]
        _, t = rng.choice(items[:14])
        w = (t or "").split()
        cut = w[rng.randint(0, 2) : len(w) - rng.randint(0, 2)]
        at = rng.randint(0, len(own))
        docs.append((10 + i, rng.choice([" ", ", ", "\n"]).join(own[:at] + cut + own[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(frame(docs), bench)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert got == brute.contamination(docs, items)
    clean = decontamination.drop_contaminated(frame(docs), bench)
    assert clean.columns == ["doc_id", "text", "id", "lang", "h", "sha"] and clean.count() == sum(not g[5] for g in got)
    assert decontamination.contamination(frame([]), bench).count() == 0
    assert decontamination.contamination(frame(docs), bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_proximity(spark, frame):
    words = [f"w{i}" for i in range(13)]
    moved = [*words[:6], "gap", *words[6:]]
    docs = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(reversed(words))), (4, " ".join(words[:12]))]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    near = lambda slop: sorted(r["doc_id"] for r in decontamination.proximity_matches(frame(docs), bench, slop).collect())
    assert near(0) == [1] and near(1) == [1, 2]


def test_proximity_equals_brute_force(spark, frame):
    rng = random.Random(41)
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([2, 4, 13, 15])))) for i in range(8)]
    docs = [(None, items[0][1]), (1, ""), (2, None)]
    for i in range(40):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abcxyz"))
        docs.append((10 + i, " ".join([*rng.choices("abcxyz", k=rng.randint(0, 6)), *w])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        got = sorted((tuple(r) for r in decontamination.proximity_matches(frame(docs), bench, slop).collect()), key=str)
        assert got == brute.proximity(docs, items, slop)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=x>Site</a></header><nav><ul><li><a>Menu, one.</a></ul></nav>
<div class="cookie-notice">We use cookies, please agree. Really, do.</div><div id=content><article><h1>Head  line</h1><p>First, a <b>bold</b> text &amp; more.<br>Next line, here.<p>Second &lt;one&gt;, with words and words.
<form>Name, please. <input></form><aside>Related, things.</aside><ul><li>Point one, of some.</li><li>Point two.</li></ul></article><div class="comments"><p>I disagree, wholly, with all of this, friends.</p></div></div><footer>&copy; someone, 2020.</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE).split("\n\n") == ["Head line", "First, a bold text & more. Next line, here.", "Second <one>, with words and words.", "Point one, of some.", "Point two."]
    for page in (None, "", "<html></html>", "<nav>a, b</nav>", "<!-- x", "<p"):
        assert html_text.main_text(page) == ""
    assert html_text.main_text("<body><p>cut &am") == "cut &am"
    body = "".join(f"<div class=row><p>Some text, number {i}, that goes on. And on.</p></div>" for i in range(5))
    assert html_text.main_text(f"<body><div id=menu>A, b.</div><div>{body}</div></body>").count("number") == 5


TEXT = [f"Sentence number {i}, which goes on for a while, and then on. It ends here." for i in range(4)]
PARAS = "".join(f"<p>{t}</p>" for t in TEXT)


@pytest.mark.parametrize("wrapper", ['class="page with-sidebar"', 'class="comments-open"', 'class="overflow-hidden"', 'class="widget"', "hidden", 'data-id="search"', 'title="see class=ad"'])
def test_html_wrappers_of_the_article_stay(wrapper):
    for inner in (f"<article><h1>Head</h1>{PARAS}</article>", f"<main><h1>Head</h1>{PARAS}</main>", f"<div><h1>Head</h1>{PARAS}</div>"):
        got = html_text.main_text(f"<body><div class=menu>A, b.</div><div {wrapper}>{inner}</div><footer>Us, 2020.</footer></body>")
        assert got.split("\n\n") == ["Head", *TEXT]
    assert html_text.main_text(f"<body><form id=aspnet><div>{PARAS}</div></form></body>").split("\n\n") == TEXT


def test_html_header_classes_in_the_article_stay():
    for name in ("entry-header", "header", "site-header"):
        assert html_text.main_text(f'<body><article><div class="{name}"><h1>Head</h1></div>{PARAS}</article></body>').split("\n\n") == ["Head", *TEXT]


def test_html_outside_words_still_cut():
    for name in ("ad", "related-posts", "cookie-notice", "share top", "comments"):
        assert html_text.main_text(f'<body><article>{PARAS}<div class="{name}"><p>Not this, no.</p></div></article></body>').split("\n\n") == TEXT
    talk = "".join(f"<article>{t} No.</article>" for t in TEXT * 9)
    assert html_text.main_text(f'<body><article>{PARAS}</article><div class="comments">{talk}</div></body>').split("\n\n") == TEXT
    assert html_text.main_text("<body><article><p>Before it, <button>Go, now.</button> after it.</p></article></body>") == "Before it, after it."
    assert html_text.main_text("<body><article><p hidden>Not, shown.</p><p>Some, shown.</p></article></body>") == "Some, shown."


def test_html_keeps_headline_and_siblings_with_content():
    more = [f"Further text {i}, that says something else, with some words. It is here." for i in range(2)]
    second = "".join(f"<p>{t}</p>" for t in more)
    text = lambda body: html_text.main_text(f"<body><div class=menu>A, b.</div>{body}<div><a>One</a></div><footer>Us, 2020.</footer></body>").split("\n\n")
    assert text(f"<div id=content><h1>Head</h1><div class=text>{PARAS}</div></div>") == ["Head", *TEXT]
    assert text(f"<div id=content><div class=top><h1>Head</h1></div><div class=text>{PARAS}</div></div>") == ["Head", *TEXT]
    assert text(f"<div><h1>Head</h1><section>{PARAS}</section><h2>More</h2><section>{second}<ul><li>Point</ul></section></div>") == ["Head", *TEXT, "More", *more, "Point"]
    assert text(f"<main><h1>Head</h1><article>{PARAS}</article><article><h2>More</h2>{second}</article></main>") == ["Head", *TEXT, "More", *more]
    assert text(f"<main><article>{PARAS}</article><div>{second}</div></main>") == [*TEXT, *more]
    assert text(f"<article>{PARAS}</article><div>{second}</div>") == TEXT


def test_html_frame(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 4), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("own,then", [("64m", str(16 << 20)), ("256MB", str(16 << 20)), ("64kb", "64kb")])
def test_batch_limit_reads_any_size(spark, own, then):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, own)
    common.bounded_batches(spark)
    assert spark.conf.get(key) == then
    spark.conf.set(key, before)
