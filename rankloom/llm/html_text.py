"""Main text of web pages by tag-path ratios.

Text nodes are grouped by their root-to-leaf tag path; those of a block whose text is mostly links have
a path of their own. For each path the mean text length and the mean number of punctuation marks of its nodes
are multiplied to a ratio; a node's value is the ratio of its path, smoothed along the page and fused
with its own length. Nodes above a threshold relative to the page's spread are content.

Where pages say what stands outside the article their marks count too: a node in a menu, advert,
form, discussion and the like by tag, role or class, or beside the page's main or articles, has its
value times DOUBT. A class or id says so as a whole: by one of OUTSIDE_WORDS, or joined from them and
COMPANIONS. MILD_WORDS say nothing of a paragraph, heading or preformatted text. An inline element
with such a class goes only if its block has no other text. What holds the longest main or article
isn't doubted, nor what holds BESIDE times the text of all nodes that nothing speaks against, where
no main or article stands outside it.

The element that holds most of the content, an article or main before others, is the article's core;
content beside it, up to the lowest element that holds all of it, is taken with its region where
content is most of that, else with the blocks on its paths or between. So are the headline before
the core and headings between its parts. Nodes of the core and of these regions that are below
the threshold, single words or list items, are taken if they aren't doubted; where no article or main
says what belongs together, only if their path is one of content, or content stands before and behind.

A page is read once, and its elements are a tree of numbers, so time grows with the page's length
however deep it nests.

Defined results: a null page is empty and gives an empty text; a page without content gives an
empty text. Broken pages are read as far as they go: unclosed elements end with their parent, a
cut tag or comment at the end is dropped. Repeated pages each get a row; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import each_value

#: Comments, declarations, tags (quotes count only as those of a value), a cut tag at the end, text.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!(?!--)[^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|"
    r"</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+>|<(?=[/a-zA-Z]).*\Z|[^<]+|<",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、；：]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg object annotation annotation-xml".split())
#: Of these, the ones that a slash ends.
FOREIGN = frozenset(("svg",))
#: Elements that speak against being part of the article, and words of class, id or role that say the same.
OUTSIDE = RAW | frozenset("head nav footer aside form button select option input label menu dialog audio video canvas map figure".split()) - {"figure"}
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs footer header masthead sidebar rail aside widget "
    "related recommended share sharing social comment comments discussion respond reply replies disqus cookie cookies consent gdpr notice alert popup modal overlay subscribe subscription newsletter "
    "signup login search toolbar pager pagination skip copyright disclaimer contentinfo complementary".split()
)
#: Words that may stand beside those in one class: related-posts, site-footer.
COMPANIONS = frozenset("area bar block bottom box container inner link links list outer posts section site slot top unit wrap wrapper".split())
#: Words that a paragraph's or heading's own class may have within an article.
MILD_WORDS = frozenset("notice banner alert widget overlay rail promo promotion toolbar".split())
MILD_IN = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
HEADER_WORDS = frozenset(("header", "masthead"))
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Open elements that the start of another ends, up to the nearest of the third set.
_LIST, _TABLE = frozenset(("ul", "ol", "menu")), frozenset(("table",))
ENDS = {"li": (frozenset(("li",)), _LIST), "dd": (frozenset(("dd", "dt")), frozenset(("dl",))), "dt": (frozenset(("dd", "dt")), frozenset(("dl",))), "tr": (frozenset(("tr",)), _TABLE), "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE), "option": (frozenset(("option",)), frozenset(("select",)))}
_P_ENDERS = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "html", "body"} | {"li", "dd", "dt"}
_P_SCOPE = frozenset("article section main td th div body html button".split())
#: Blocks of text themselves, never the element that holds an article.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption blockquote summary hgroup ul ol dl tr address".split())
HEADINGS = tuple("h1 h2 h3 h4 h5 h6 hgroup".split())
THRESHOLD, SPREAD, SHARE, DOUBT, BESIDE, LINKED = 0.5, 1.0, 0.6, 1e-4, 10, 0.5


def _raw_end(name: str, page: str, at: int) -> int:
    """Where the end tag of an element that holds no markup begins; the page's end if there is none."""
    found = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def _says_outside(tag: str, name: str, in_article: bool) -> set[str]:
    """The words by which a tag says that its element isn't part of the article; "hidden" if it isn't shown."""
    if "=" not in tag and "hidden" not in tag.lower():
        return set()
    said: set[str] = set()
    for m in _ATTRIBUTE.finditer(tag, 1 + len(name)):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and value in ("", "hidden") or key == "aria-hidden" and value == "true" or key == "style" and _NO_DISPLAY.search(value):
            said.add("hidden")
        for token in value.split() if key in ("class", "id", "role") else [value] if key == "aria-label" else ():
            words = {x for x in re.split(r"[^a-z]+", token) if x}
            own = words & OUTSIDE_WORDS
            if own and words - own <= COMPANIONS and not (in_article and own <= HEADER_WORDS):
                said |= own
    return said


class _Block:
    """A block's element, the innermost element around it that says that it's outside the article, and its
    texts as (text, inline element that says so, in a link)."""

    __slots__ = ("cut", "node", "parts")

    def __init__(self, node: int, cut: int) -> None:
        self.node, self.cut, self.parts = node, cut, []


class _Page:
    """Blocks in page order, and elements by number, 0 being the page: name, parent, number of the path,
    and the innermost element from it outwards that says it's outside. Numbers grow inwards and
    along the page. soft: elements outside by their words or as a form; marks: articles and mains."""

    def __init__(self) -> None:
        self.blocks: list[_Block] = []
        self.names, self.parents, self.paths, self.cuts, self.depths = [""], [0], [0], [0], [0]
        self.soft: set[int] = set()
        self.marks: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}

    def open(self, name: str, parent: int, cut: int, says: bool) -> int:
        e = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        self.paths.append(self._paths.setdefault((self.paths[parent], name), len(self._paths) + 1))
        self.cuts.append(e if says else cut)
        self.depths.append(self.depths[parent] + 1)
        return e

    def outer_cut(self, e: int) -> int:
        """The next element outwards from ``e`` that says it's outside; 0 if there is none."""
        return self.cuts[self.parents[e]]

    def path_of(self, e: int) -> tuple[str, ...]:
        out = []
        while e:
            out.append(self.names[e])
            e = self.parents[e]
        return tuple(out[::-1])


def blocks(page: str) -> _Page:
    """A page's blocks and elements."""
    out = _Page()
    stack = [0]  # open elements
    tops = [0]  # of each the innermost block element, itself included
    inline = [0]  # of each the innermost inline element that says it's outside
    names = out.names
    opened: dict[str, int] = {}
    current, at = None, 0

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[names[e]] -= 1
        del stack[k:], tops[k:], inline[k:]

    while at < len(page):
        token = _TOKEN.match(page, at).group()
        at += len(token)
        if token[0] != "<" or token == "<":
            cut = out.cuts[stack[-1]]
            if cut and not token.strip():
                continue
            into = current
            if current is None or cut != current.cut:
                into = _Block(tops[-1], cut)
                out.blocks.append(into)
                if current is None or out.depths[cut] < out.depths[current.cut]:  # else the block goes on after what is cut
                    current = into
            into.parts.append((token, inline[-1], opened.get("a", 0) > 0))
            continue
        found = _NAME.match(token)
        if not found:
            continue
        name = found[1].lower()
        if token[1] == "/":
            if opened.get(name):
                k = len(stack) - 1
                while names[stack[k]] != name and (name in BLOCK or names[stack[k]] not in BLOCK):
                    k -= 1
                if names[stack[k]] == name:
                    close(k)
                    if name in BLOCK:
                        current = None
            continue
        if name in BLOCK:
            current = None
            ends, scope = ENDS.get(name, (frozenset(), frozenset()))
            if name in _P_ENDERS and opened.get("p"):
                k = len(stack) - 1
                while names[stack[k]] != "p" and names[stack[k]] not in _P_SCOPE:
                    k -= 1
                if names[stack[k]] == "p":
                    close(k)
            if any(map(opened.get, ends)):
                for k in range(len(stack) - 1, 0, -1):
                    if names[stack[k]] in scope:
                        break
                    if names[stack[k]] in ends:
                        close(k)
                        break
        if name in RAW:
            if not token.endswith("/>") or name not in FOREIGN:
                at = _raw_end(name, page, at)
            continue
        if name == "br" and current is not None:
            current.parts.append(("\n", inline[-1], False))
        if name in VOID:
            continue
        in_article = bool(opened.get("article") or opened.get("main"))
        said = _says_outside(token, name, in_article) if name not in ("html", "body", "article", "main") else set()
        if name in MILD_IN:
            said -= MILD_WORDS
        by_tag = name in OUTSIDE or name == "header" and not in_article
        by_words = bool(said) and (name in BLOCK or "hidden" in said or by_tag)
        e = out.open(name, stack[-1], out.cuts[stack[-1]], by_tag or by_words)
        if name in ("article", "main"):
            out.marks.append(e)
        if said and not by_words or (by_tag or by_words) and (name == "form" or not by_tag):
            out.soft.add(e)
        stack.append(e)
        tops.append(e if name in BLOCK else tops[-1])
        inline.append(e if said and not by_words else inline[-1])
        opened[name] = opened.get(name, 0) + 1
    return out


def texts(page: _Page) -> list[tuple[_Block, str, int]]:
    """Blocks that have a text, with it and, if most of it is links, the number of its text nodes, else 0. Where all of a block's text is
    in inline elements that say they are outside, the block is cut by them."""
    out = []
    for b in page.blocks:
        text = _SPACE.sub(" ", html.unescape("".join([t for t, _, _ in b.parts]))).strip()
        if text:
            shown = [(len(t.strip()), mark, link) for t, mark, link in b.parts if t.strip()]
            if all(mark for _, mark, _ in shown):
                b.cut = page.cuts[shown[0][1]] = shown[0][1]
            linked = sum(n for n, _, link in shown if link) >= LINKED * sum(n for n, _, _ in shown)
        out.append((b, text, len(shown) if linked else 0))
    return out


class _Found:
    """Blocks with text as arrays: element, path, innermost cut, length, punctuation, text nodes."""

    def __init__(self, page: _Page, rows: list[tuple[_Block, str, int]]) -> None:
        self.page, self.rows = page, rows
        self.node = np.array([b.node for b, _, _ in rows], np.int64)
        self.cut = np.array([b.cut for b, _, _ in rows], np.int64)
        self.length = np.array([len(t) for _, t, _ in rows], float)
        self.marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, _ in rows], float)
        nodes = np.array([n for _, _, n in rows], np.int64)
        self.path, self.nodes = 2 * np.array(page.paths, np.int64)[self.node] + (nodes > 0), np.maximum(nodes, 1)

    def name(self, i: int) -> str:
        return self.page.names[self.node[i]]

    def some(self, which: np.ndarray) -> _Found:
        return _Found(self.page, [r for r, own in zip(self.rows, which, strict=True) if own])

    def held(self, amount: np.ndarray) -> np.ndarray:
        """For each element the amounts of all blocks in it."""
        out = np.bincount(self.node, amount, len(self.page.names))
        parents = self.page.parents
        values = out.tolist()
        for e in range(len(values) - 1, 0, -1):
            values[parents[e]] += values[e]
        return np.array(values)

    def inside(self, element_is: np.ndarray) -> np.ndarray:
        """Which blocks have one of these elements around them."""
        flags, parents = element_is.tolist(), self.page.parents
        for e in range(1, len(flags)):
            flags[e] = flags[e] or flags[parents[e]]
        return np.array(flags, bool)[self.node]


def _seeds(found: _Found, doubted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the blocks, and which of them are content seeds."""
    _, own = np.unique(2 * found.path + doubted, return_inverse=True)
    n = np.bincount(own, found.nodes)
    ratio = (np.bincount(own, found.length) / n * (0.1 + np.bincount(own, found.marks) / n))[own]
    padded = np.pad(ratio, 1, mode="edge")
    smooth = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    smooth = np.where(found.path % 2 == 1, np.minimum(smooth, ratio), smooth)  # links gain nothing from what is beside them
    fused = np.sqrt(smooth * found.length / found.nodes) * np.where(doubted, DOUBT, 1.0)
    return fused, fused >= min(THRESHOLD * fused.mean() + 0.1 * SPREAD * fused.std(), fused.max())


def _bad(page: _Page, kept: set[int]) -> np.ndarray:
    """Which elements are, or stand in, one that says it's outside and isn't kept."""
    out = [False] * len(page.names)
    for e in range(1, len(out)):
        out[e] = page.cuts[e] == e and e not in kept or out[page.parents[e]]
    return np.array(out, bool)


def _kept(page: _Page, found: _Found) -> set[int]:
    """Elements that aren't cut though they say so, as they hold what the page is about."""
    shown = found.some(~_bad(page, page.soft)[found.cut])
    if not shown.cut.any():
        return set()
    kept: set[int] = set()
    size = shown.held(shown.length)
    for kind in ("main", "article"):
        longest = max((e for e in page.marks if page.names[e] == kind), key=size.__getitem__, default=0)
        if longest and size[longest]:
            e = page.cuts[longest]
            while e:
                kept.add(e)
                e = page.outer_cut(e)
    if any(not page.cuts[e] for e in page.marks):
        return kept
    _, seeds = _seeds(shown, np.zeros(len(shown.rows), bool))
    held, own = {}, {}
    for c, n, seed in zip(shown.cut.tolist(), shown.length.tolist(), seeds.tolist(), strict=True):
        own[c] = own.get(c, 0.0) + n
        if seed and c:
            held[c] = held.get(c, 0.0) + n
    inner: dict[int, list[int]] = {}
    waiting = sorted({c for c in own if c}, reverse=True)
    known = set(waiting)
    while waiting:  # from the innermost outwards
        e = waiting.pop(0)
        up = page.outer_cut(e)
        held[up], _ = held.get(up, 0.0) + held.get(e, 0.0), inner.setdefault(up, []).append(e)
        if up and up not in known:
            known.add(up)
            bisect.insort(waiting, up, key=lambda x: -x)
    free, clear = 0.0, set()

    def cleared(e: int) -> None:
        """Text under kept elements alone, from ``e`` inwards, counts against what is still cut."""
        nonlocal free
        todo = [e]
        while todo:
            x = todo.pop()
            clear.add(x)
            free += own.get(x, 0.0)
            todo += [y for y in inner.get(x, ()) if y in kept]

    cleared(0)
    for e in sorted(known):  # outer elements first
        if e not in kept and held.get(e, 0.0) > BESIDE * free:
            kept.add(e)
            if page.outer_cut(e) in clear:
                cleared(e)
    return kept


def _widened(found: _Found, own: int, seeds: np.ndarray) -> np.ndarray:
    """Which blocks are the article: those of its core ``own``, and what belongs to it beside the core."""
    page = found.page
    parents, names, depths, n = page.parents, page.names, page.depths, len(page.names)
    core, e = [], own
    while e:
        core.append(e)
        e = parents[e]
    core.reverse()
    in_core = {0, *core}
    # Of each element: where its chain leaves the core's, and the outermost article beside the core.
    leaves, articles, last = [0] * n, [0] * n, list(range(n))
    for x in range(1, n):
        if x not in in_core:
            leaves[x] = leaves[parents[x]] or x
            articles[x] = articles[parents[x]] or (x if names[x] == "article" else 0)
    for x in range(n - 1, 0, -1):
        last[parents[x]] = max(last[parents[x]], last[x])
    picked = (found.node >= own) & (found.node <= last[own])
    order = np.argsort(found.node, kind="stable")
    ordered = found.node[order]
    regions: dict[int, list[int]] = {}
    common = len(core)
    for i in np.nonzero(seeds & ~picked)[0].tolist():
        x = int(found.node[i])
        regions.setdefault(articles[x] or leaves[x], []).append(i)
        common = min(common, depths[parents[leaves[x]]] if leaves[x] else depths[x])
    for e, own_seeds in regions.items():
        part = np.sort(order[np.searchsorted(ordered, e) : np.searchsorted(ordered, last[e], "right")]) if e else np.array(own_seeds)
        if e and (names[e] == "article" or found.length[part][seeds[part]].sum() >= SHARE * found.length[part].sum()):
            picked[part] = True
            continue
        picked[part] |= np.isin(found.path[part] // 2, found.path[own_seeds] // 2)
        for i in part[(part > own_seeds[0]) & (part < own_seeds[-1])].tolist():
            picked[i] |= found.name(i) in LEAVES
    first, final = np.nonzero(picked)[0][[0, -1]].tolist()
    holder = core[common - 1] if common else 0
    for i in range(first, final):
        picked[i] |= found.name(i) in LEAVES and parents[found.node[i]] == holder and found.node[i] > 0
    for heads in (("h1",), HEADINGS):
        if any(found.name(i) in heads for i in np.nonzero(picked)[0].tolist()):
            break
        near = [i for i in range(first) if found.name(i) in heads and {parents[found.node[i]], parents[parents[found.node[i]]]} & in_core - {0}]
        if near:
            picked[near[-1]] = True
            break
    return picked


def _on_content_paths(found: _Found, picked: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Of the picked blocks: seeds, those on a seed's path, and from the first heading or seed to the last
    seed those that aren't links."""
    at = np.nonzero(picked & seeds)[0]
    if not len(at):
        return picked
    first = next((i for i in np.nonzero(picked[: at[0]])[0].tolist() if found.name(i) in HEADINGS), at[0])
    i = np.arange(len(picked))
    between = (i >= first) & (i < at[-1]) & (found.path % 2 == 0)
    return picked & (seeds | np.isin(found.path, found.path[at]) | between)


def main_text(page: str | None) -> str:
    parsed = blocks(page or "")
    found = _Found(parsed, texts(parsed))
    kept = _kept(parsed, found)
    doubted = _bad(parsed, kept)[found.cut]
    if doubted.all():
        return ""
    for kind in ("main", "article"):
        marked = np.array([name == kind and (not parsed.cuts[e] or not _chain_bad(parsed, e, kept)) for e, name in enumerate(parsed.names)], bool)
        inside = found.inside(marked)
        if (inside & ~doubted).any():
            doubted |= ~inside
            break
    _, seeds = _seeds(found, doubted)
    held, several = found.held(np.where(seeds, found.length, 0.0)), found.held(np.ones(len(found.rows)))
    need = SHARE * found.length[seeds].sum()
    whole = [e for e in range(1, len(parsed.names)) if held[e] >= need and held[e] > 0 and parsed.names[e] not in LEAVES and parsed.names[e] in BLOCK]
    own = max((e for e in whole if parsed.names[e] in ("article", "main")), default=0)
    semantic = bool(own)
    own = own or max((e for e in whole if several[e] > 1), default=0)
    picked = _widened(found, own, seeds) if own else np.ones(len(found.rows), bool)
    picked &= seeds | ~doubted
    if not semantic:
        picked = _on_content_paths(found, picked, seeds)
    return "\n\n".join(t for (_, t, _), is_in in zip(found.rows, picked.tolist(), strict=True) if is_in)


def _chain_bad(page: _Page, e: int, kept: set[int]) -> bool:
    """Whether an element around ``e`` says it's outside and isn't kept."""
    e = page.cuts[e]
    while e:
        if e not in kept:
            return True
        e = page.outer_cut(e)
    return False


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in each_value(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
