"""Main text against pages whose article is known, and against a slow reading with the standard parser."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from rankloom.llm import html_text

HOSTILE = ["page with-sidebar", "overflow-hidden", "social-history", "comments-open", "navigable", "header-less", "ad-free", "content-footer-margin", "widgetized", "x", "shared-memory-article", "promoted"]


def sentence(rng, n):
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 9))) for _ in range(n)]
    return ", ".join(" ".join(words[i : i + 6]) for i in range(0, n, 6)) + "."


def made_page(rng, semantic):
    """(page, text): a page and what its article says."""
    hostile = lambda: f'class="{rng.choice(HOSTILE)}"'
    truth, body = [], []
    head = sentence(rng, 5)
    truth.append(head)
    for _ in range(rng.randint(4, 9)):
        kind = rng.random()
        if kind < 0.6:
            t = sentence(rng, rng.randint(15, 70))
            truth.append(t)
            body.append(f"<p {hostile()}>{t}</p>" if rng.random() < 0.7 else f"<p title=it's>{t}")
        elif kind < 0.75:
            t = rng.choice(["Of.", "Is 2 < 3?", "A & B"])
            truth.append(t)
            body.append("<p>" + t.replace("&", "&amp;").replace("<", "&lt;") + "</p>")
        elif kind < 0.85:
            items = [sentence(rng, 2) for _ in range(3)]
            truth += items
            body.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
        else:
            body.append(rng.choice(["<aside><p>See also, this.</p></aside>", '<div class="ad">Buy it, now.</div>', "<form><label>Mail</label><input></form>", '<div class="share">Tell, friends.</div>', "<script>if(a<b){x=1}</script>", "<!-- note --!>"]))
    t = sentence(rng, 40)
    truth.append(t)
    body.append(f"<p>{t}</p>")
    tag = rng.choice(["article", "main"]) if semantic else "div"
    article = f"<{tag} {hostile()}><h1>{head}</h1>{''.join(body)}</{tag}>"
    for _ in range(rng.randint(0, 3)):
        article = f"<div {hostile()}>{article}</div>"
    before = "<nav><ul>" + "".join(f"<li><a href=/{i}>{sentence(rng, 1)}</a>" for i in range(6)) + "</ul></nav>"
    notice = '<div class="cookie-notice"><p>We use them, and more. Agree.</p></div>' if rng.random() < 0.5 else ""
    rest = '<div class="sidebar"><p>Other things, here.</p></div>' if rng.random() < 0.5 else "<aside>More, of it.</aside>"
    talk = '<div id="comments">' + "".join(f"<p>{sentence(rng, 20)}</p>" for _ in range(rng.randint(0, 4))) + "</div>"
    foot = "<footer>&copy; us, 2020. All of it.</footer>"
    inner = f"<header><a>Site, name.</a></header>{before}{notice}{article}{rest}{talk}{foot}"
    if rng.random() < 0.3:
        inner = f"<form id=aspnetForm {hostile()}>{inner}</form>"
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p>a{{}}</style><script>if(a<b){{x='</p>'}}</script></head><body {hostile()}>{inner}</body></html>"
    return page, "\n\n".join(truth)


@pytest.mark.parametrize("semantic", [False, True])
def test_known_articles(semantic):
    rng = random.Random(17 + semantic)
    for _ in range(150):
        page, text = made_page(rng, semantic)
        assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<script>if(a<b){x=1}</script><p>Some text, here. And more.</p>",
        '<div class="overflow-hidden"><p>Some text, here. And more.</p></div>',
        '<form id="aspnetForm"><p>Some text, here. And more.</p></form>',
        '<div class="social-history"><p>Some text, here. And more.</p></div>',
        "<p title=it's>Some text, here. And more.</p>",
        "<p title='a>b' data-x=\"c>d\">Some text, here. And more.</p>",
        "<SCRIPT>x</scripty></SCRIPT ><p>Some text, here. And more.</p>",
        "<p>Some text, here. And more.</p><script>never ends <p>x",
    ],
)
def test_ordinary_pages_have_a_text(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "Some text, here. And more."


def test_advert_beside_an_empty_article():
    page = '<body><nav><li>a</nav><div class="ad">Buy this, now. Or else.</div><article><h1></h1><p></p></article><footer>Us, 2020.</footer></body>'
    assert html_text.main_text(page) == ""


def pages_text(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]


def unmarked_page(rng):
    """(page, text) without an article, a main or a class: what is content shows by its paths alone."""
    truth = [sentence(rng, 5)]
    body = [f"<h1>{truth[0]}</h1>"]
    for _ in range(rng.randint(5, 9)):
        kind = rng.random()
        truth.append(sentence(rng, rng.randint(20, 70)) if kind < 0.8 else sentence(rng, 3))
        body.append(f"<p>{truth[-1]}</p>" if kind < 0.9 else f"<h2>{truth[-1]}</h2>")
    truth.append(sentence(rng, 30))
    body.append(f"<p>{truth[-1]}</p>")
    article = "".join(body)
    if rng.random() < 0.5:
        article = f"<div>{article}</div>"
    links = "<div>" + "".join(f"<a href=/{i}>{sentence(rng, 1)}</a> " for i in range(15)) + "</div>"
    stories = "".join(f"<div><a href=/s{i}>Read this other story</a></div>" for i in range(10))
    if rng.random() < 0.5:
        stories = f"<div>{stories}</div>"
    page = f"<html><body>{links}{article}{stories}<div>Copyright 2020 by us</div></body></html>"
    return (page if rng.random() < 0.5 else f"<html><body><div>{page[12:-14]}</div></body></html>"), "\n\n".join(truth)


def test_ratios_decide(monkeypatch):
    """Unmarked pages come out as made, and would have another text if every block passed the threshold."""
    rng = random.Random(23)
    made = [unmarked_page(rng) for _ in range(150)]
    for page, text in made:
        assert html_text.main_text(page) == text
    plain = html_text._seeds
    monkeypatch.setattr(html_text, "_seeds", lambda found, doubted: (plain(found, doubted)[0], ~doubted))
    assert sum(html_text.main_text(page) != text for page, text in made) > 0.9 * len(made)


@pytest.mark.parametrize(
    "inner,text",
    [
        ('<p class="notice">Some own text, here. And more.</p>', "Some own text, here. And more."),
        ('<p class="banner">Some own text, here. And more.</p>', "Some own text, here. And more."),
        ('<pre>x = 1 <span class="token comment"># why, so.</span></pre>', "x = 1 # why, so."),
        ("<p>The value <math><mi>x</mi><mo>=</mo><mn>1</mn></math> is known.</p>", "The value x=1 is known."),
        ('<p>One, two. <span class="share">Three.</span> Four.</p>', "One, two. Three. Four."),
        ('<p>One, two.</p><div><span class="share">Tell friends.</span></div>', "One, two."),
        ('<p>One, two. <span hidden>Three.</span> Four.</p>', "One, two. Four."),
    ],
)
@pytest.mark.parametrize("around", ["article", "div"])
def test_class_words_in_an_article(inner, text, around):
    head, tail = "A first paragraph, with some text. And more of it, again.", "A last paragraph, with some text. And more of it, again."
    page = f'<html><body><nav><li><a href=/>Home</a></li></nav><{around}><p>{head}</p>{inner}<p>{tail}</p></{around}><div class="ad">Buy.</div></body></html>'
    assert html_text.main_text(page) == f"{head}\n\n{text}\n\n{tail}"


@pytest.mark.parametrize("part", ["<div>a b c.", "<div>x ", "<b>x ", "<li><div>x", "<p><b>a", '<div class="ad">x. ', "<form>x, y. ", "<article>x, y. ", '<span class="ad">x ', "</b><div><b>x", "<ul><li>a, b."])
def test_time_grows_with_length(part):
    def cost(n):
        began = time.process_time()
        html_text.main_text(part * n)
        return time.process_time() - began

    cost(200)
    assert cost(8000) < 40 * max(0.01, min(cost(1000) for _ in range(2)))


class Slow(HTMLParser):
    """Texts by path with the standard parser, for pages without broken nesting."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.skip, self.rows, self.new = [], 0, [], True
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.skip += 1
        elif tag == "br":
            self.handle_data("\n")
        elif tag not in html_text.VOID:
            if tag == "p" and "p" in self.path:
                del self.path[self.path.index("p") :]
            if tag in html_text.BLOCK:
                self.new = True
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.skip -= 1
        elif tag in self.path:
            at = len(self.path) - 1 - self.path[::-1].index(tag)
            if tag in html_text.BLOCK or not any(x in html_text.BLOCK for x in self.path[at:]):
                del self.path[at:]
                self.new = self.new or tag in html_text.BLOCK

    def handle_data(self, data):
        if self.skip:
            return
        if self.new or not self.rows:
            blocks = [i for i, x in enumerate(self.path) if x in html_text.BLOCK]
            self.rows.append([tuple(self.path[: blocks[-1] + 1] if blocks else ()), "", 0])
            self.new = False
        self.rows[-1][1] += data
        self.rows[-1][2] += len(data.strip()) * (1 if "a" in self.path else -1)


def test_paths_and_threshold_equal_a_slow_reading(spark):
    for page in pages_text(spark)[::5]:
        slow = [(path, " ".join(t.split()), links >= 0) for path, t, links in Slow(page).rows if t.strip()]
        parsed = html_text.blocks(page)
        rows = html_text.texts(parsed)
        assert [(parsed.path_of(b.node), t, linked) for b, t, linked in rows] == [(path, t, int(linked)) for path, t, linked in slow]
        doubted = [any(x in ("nav", "footer") for x in path) or path == ("html", "body", "div") for path, *_ in slow]
        n = len(slow)
        points = [sum(c in ".,;:!?…。，！？、；：" for c in t) for _, t, _ in slow]
        ratio = []
        for i in range(n):
            own = [j for j in range(n) if slow[j][0] == slow[i][0] and slow[j][2] == slow[i][2] and doubted[j] == doubted[i]]
            ratio.append(sum(len(slow[j][1]) for j in own) / len(own) * (0.1 + sum(points[j] for j in own) / len(own)))
        smooth = [(ratio[max(0, i - 1)] + 2 * ratio[i] + ratio[min(n - 1, i + 1)]) / 4 for i in range(n)]
        value = [((min(smooth[i], ratio[i]) if slow[i][2] else smooth[i]) * len(slow[i][1])) ** 0.5 * (1e-4 if doubted[i] else 1) for i in range(n)]
        mean = sum(value) / n
        bound = 0.5 * mean + 0.1 * (sum((v - mean) ** 2 for v in value) / n) ** 0.5
        got = html_text._seeds(html_text._Found(parsed, rows), np.array(doubted))
        assert np.allclose(got[0], value) and got[1].tolist() == [v >= min(bound, max(value)) for v in value]


def test_edges():
    assert html_text.main_text("<p>" + "word, " * 200_000 + "</p>") == ("word, " * 200_000).strip()
    assert html_text.main_text("<div>" * 3000 + "<p>Deep, text. Here.</p>") == "Deep, text. Here."
    tied = "<p>Same, here.</p>" * 4
    assert html_text.main_text(f"<body>{tied}</body>").split("\n\n") == ["Same, here."] * 4
    assert html_text.main_text("<div><p>One, two.</div></p></b><p>Three, four.</span>") == "One, two.\n\nThree, four."
