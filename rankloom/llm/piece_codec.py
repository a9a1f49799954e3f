"""SentencePiece encoding and decoding by a max-plus parallel scan.

For BPE models: a segmentation is scored by a max-plus sum over neighbouring pairs. The pair score is
0 if the two pieces, encoded together, come out as these two, else minus infinity: the segmentation
of which all neighbours agree is what the merges give, and it's the only one. Pieces have no scores
of their own, so a model of another type is refused.

Giant documents are cut into chunks anywhere. A chunk's transfer matrix has the best score from
each piece that may hold the character before its start to each that may hold the one before its
end. Matrices of neighbours are multiplied in the max-plus sense, pair by pair in rounds, as the
product is associative: after log2(chunks) rounds of joins a document has one matrix. The rounds
are then gone back, which gives every boundary its piece, and each chunk is traced back by itself.
Where a safe boundary stands, with no piece that reaches across, the matrix has rank one, and what
lies between safe boundaries is solved once in a run of texts: all of a run's distinct parts go forward
in step, on arrays, and are traced back in step.

Defined results: a null text counts as empty and has no tokens. Special strings in a text are
ordinary text; unknown characters become their bytes. A text that holds the space mark itself
decodes with a space there, so it isn't exact. Repeated rows each get a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches, discard, each_value, release_memory, written
from rankloom.llm.token_counts import META, by_bytes

#: Of distinct texts between safe boundaries, so many signs are solved in step, as long as it's not FEW texts.
CHUNK_CHARS, CACHED_PAIRS, SOLVED, FEW, BATCH_BYTES = 1 << 14, 1 << 20, 1 << 18, 64, 2 << 20
NONE = float("-inf")
#: First of 256 private characters that no piece of a vocabulary holds.
_PRIVATE = 0x10FF00
_BYTES = re.compile(f"[{chr(_PRIVATE)}-{chr(_PRIVATE + 255)}]+")
State = tuple[int, int]


class Numbers:
    """A table from non-negative 64-bit keys to small numbers, looked up by arrays of keys."""

    def __init__(self, slots: int, kind: str) -> None:
        self.bits, self.mask, self.held = 64 - (slots - 1).bit_length(), (1 << (slots - 1).bit_length()) - 1, 0
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, kind)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that differ from each other and from those held; a table half full is emptied first."""
        if self.held + len(keys) > len(self.keys) // 2:
            self.keys.fill(-1)
            self.held = 0
        self.held += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 where a key isn't held."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            there = self.keys[slots[left]]
            met = there == keys[left]
            out[left[met]] = self.values[slots[left[met]]]
            left = left[~met & (there >= 0)]
        return out


class PieceModel:
    """A vocabulary with identity normalisation and a space mark in front of every text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.names = [library.id_to_piece(i) for i in range(n)]
        ordinary = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.ids = {self.names[i]: i for i in ordinary}
        self.scores = {self.names[i]: library.get_score(i) for i in ordinary}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = library.unk_id()
        if any(x != int(x) for x in self.scores.values()):  # merges are numbered; other types have probabilities
            raise ValueError(f"{path} isn't a BPE model")
        self.longest = max(map(len, self.ids))
        #: What a piece shows; a byte is a private character until its neighbours are known.
        self.shown = [chr(_PRIVATE + self.byte_of[i]) if i in self.byte_of else name.replace(META, " ") for i, name in enumerate(self.names)]
        self._raw = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else name.replace(META, " ").encode() for i, name in enumerate(self.names)], pa.binary())
        #: Signs that any piece has side by side: between two others no merge is possible, which is a safe
        #: boundary. Whether a space mark after another sign always has one before it.
        self.neighbours = frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))
        self.safe_space = not any(META in p.lstrip(META) for p in self.ids)
        #: How a piece's last and first part grow while it is merged: each part with the score of the merge that
        #: ends it. Pieces that aren't merged best score first throughout have None.
        self.grown: dict[str, tuple[list, list] | None] = {c: ([(c, NONE)], [(c, NONE)]) for c in set().union(*self.ids)}
        #: Pieces that come out whole when encoded by themselves.
        self.whole_pieces = frozenset(p for p in self.ids if self._grow(p))
        self._number()

    def _number(self) -> None:
        """Number signs and forms, which are nothing, whole pieces, single signs and bytes, for work on arrays."""
        linked = sorted(set().union(*self.neighbours))
        signs = linked + sorted(set().union(*self.ids).difference(linked))
        #: Codes of characters: 0 for those that no piece holds, whose bytes have the codes from _foreign on.
        self._code = np.zeros(0x110000, np.min_scalar_type(len(signs) + 257))
        for k, c in enumerate(signs, 1):
            self._code[ord(c)] = k
        self._linked, self._foreign, self._width = len(linked), len(signs) + 1, len(signs) + 257
        self._near = np.zeros((len(linked) + 2, len(linked) + 2), bool)
        for x, y in self.neighbours:
            self._near[self._code[ord(x)], self._code[ord(y)]] = True
        own = sorted(self.whole_pieces.union(signs))
        self.forms = ["", *own, *(chr(_PRIVATE + b) for b in range(256))]
        ids = [b"", *map(self.token_ids, ([p] for p in own)), *(np.array([self.bytes.get(b, self.unknown)], "<i4").tobytes() for b in range(256))]
        self._form_ids, self._form_size = pa.array(ids, pa.binary()), np.array([len(p) for p in self.forms], np.int64)
        nodes = {"": 0}  # of a tree of the forms' beginnings
        for p in own:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        form = dict(zip(own, range(1, len(own) + 1), strict=True))
        self._form_of = np.array([form.get(p, 0) for p in nodes] + list(range(len(own) + 1, len(self.forms))), np.int32)
        keys = [nodes[p[:-1]] * self._width + int(self._code[ord(p[-1])]) for p in nodes if p] + [self._foreign + b for b in range(256)]
        self._child = Numbers(8 * len(keys), "<i4")
        self._child.add(np.array(keys, np.int64), np.arange(1, len(keys) + 1))
        #: Which pairs of forms agree, by their numbers: for arrays and for single texts.
        self._agreed, self._pairs = Numbers(2 * CACHED_PAIRS, "i1"), dict[int, bool]()

    def merged(self, text: str, steps: list | None = None) -> list[str]:
        """The merges themselves on a short text: best score first, leftmost on ties."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1], NONE)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            if steps is not None:
                steps.append((best, parts[0] if at == 0 else None, parts[-1] if at == len(parts) - 2 else None))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _grow(self, piece: str) -> bool:
        """Note how a piece grows; whether it comes out whole."""
        if len(piece) == 1:
            return True
        steps: list[tuple] = []
        if self.merged(piece, steps) != [piece]:
            return False
        falling = all(x[0] >= y[0] for x, y in zip(steps, steps[1:], strict=False))
        first, last = ([(x[k], x[0]) for x in steps if x[k]] + [(piece, NONE)] for k in (1, 2))
        self.grown[piece] = (last, first) if falling else None
        return True

    def agree(self, a: str, b: str) -> bool:
        """Whether a and b side by side are encoded as a and b; with a empty, whether b is whole.

        They aren't if, at some time, a's last part and b's first merge before either of them grows."""
        if not a:
            return b in self.whole_pieces or len(b) == 1
        left, right = self.grown.get(a), self.grown.get(b)
        if left is None or right is None:
            return self.merged(a + b) == [a, b]
        left, right, scores, i, j = left[0], right[1], self.scores, 0, 0
        while True:
            (x, ends), (y, other) = left[i], right[j]
            s = scores.get(x + y)
            if ends >= other:
                if s is not None and s > ends:
                    return False
                if ends == NONE:
                    return True
                i += 1
            else:
                if s is not None and s >= other:
                    return False
                j += 1

    def _agree(self, before: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Whether each form agrees with the one before it; 0 before a text's first."""
        n = len(self.forms)
        keys = before.astype(np.int64) * n + forms
        found = self._agreed.find(keys)
        if (missing := np.unique(keys[found < 0])).size:
            names = self.forms
            known = np.array([self.agree(names[k // n], names[k % n]) for k in missing.tolist()], np.int8)
            self._agreed.add(missing, known)
            new = found < 0
            found[new] = known[np.searchsorted(missing, keys[new])]
        return found > 0

    def token_ids(self, pieces: list[str]) -> bytes:
        """The pieces' ids as little-endian 32-bit integers."""
        out: list[int] = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8", "replace")] if self.bytes else [self.unknown]
        return np.array(out, "<i4").tobytes()

    def _candidates(self, codes: np.ndarray) -> list[np.ndarray]:
        """By the place where they end, the forms that may end there, longest first; a code 0 stands after each text."""
        at = np.flatnonzero(codes)
        node, size, found = np.zeros(len(at), np.int64), 0, []
        while len(at):
            node = self._child.find(node * self._width + codes[at + size])
            at, node, size = at[node >= 0], node[node >= 0].astype(np.int64), size + 1
            forms = self._form_of[node]
            found.append((at[forms > 0] + size, forms[forms > 0]))
        out, count = [], np.zeros(len(codes), np.int64)
        for ends, forms in reversed(found):
            rank = count[ends]
            for k in range(rank.max(initial=-1) + 1):
                if k == len(out):
                    out.append(np.zeros(len(codes), np.int32))
                out[k][ends[rank == k]] = forms[rank == k]
            count[ends] += 1
        return out

    def _solved(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forms of texts, longest text first, and where each text's begin: for each prefix of a text the one
        last piece that agrees with the last piece before it, all texts in step."""
        candidates, last = self._candidates(codes), np.zeros(len(codes), np.int32)
        for end in range(1, int(sizes[0]) + 1):
            places = starts[: np.searchsorted(-sizes, -end, "right")] + end
            if len(places) < FEW:
                for start, size in zip(starts[: len(places)].tolist(), sizes.tolist(), strict=False):
                    self._finish(candidates, last[start : start + size + 1], start, end)
                break
            for own in candidates:
                forms = own[places]
                ok = self._agree(last[places - self._form_size[forms]], forms)
                last[places[ok]] = forms[ok]
                places = places[~ok]
                if not len(places):
                    break
            else:
                raise ValueError("a prefix has no last piece")
        rounds, texts, places = [], np.arange(len(starts)), starts + sizes
        counts = np.zeros(len(starts), np.int64)
        while len(texts):
            forms = last[places]
            rounds.append((texts, forms))
            counts[texts] += 1
            places = places - self._form_size[forms]
            more = places > starts[texts]
            texts, places = texts[more], places[more]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (texts, forms) in enumerate(rounds, 1):
            out[ends[texts] - k] = forms
        return out, ends - counts

    def _finish(self, candidates: list[np.ndarray], last: np.ndarray, start: int, end: int) -> None:
        """The last pieces of one text's prefixes from length ``end`` on: of a few long texts, this is faster than in step."""
        if len(self._pairs) > CACHED_PAIRS // 4:
            self._pairs.clear()
        pairs, names, known, n = self._pairs, self.forms, last[:end].tolist(), len(self.forms)
        for at, forms in enumerate(zip(*(own[start + end : start + len(last)].tolist() for own in candidates), strict=True), end):
            for f in forms:
                before = known[at - len(names[f])]
                found = pairs.get(before * n + f)
                if found is None:
                    found = pairs[before * n + f] = self.agree(names[before], names[f])
                if found:
                    known.append(f)
                    break
            else:
                raise ValueError("a prefix has no last piece")
        last[:] = known

    def _distinct(self, data: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Ids of distinct texts that lie side by side in ``data`` from ``starts`` to the last of them."""
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        total, at, found = np.cumsum(sizes[order] + 1), 0, []
        while at < len(order):
            stop = int(np.searchsorted(total, (total[at - 1] if at else 0) + SOLVED, "right"))
            own = order[at : max(stop, at + 1)]
            ends = np.cumsum(sizes[own] + 1)
            begin = ends - sizes[own] - 1
            codes = np.zeros(int(ends[-1]), data.dtype)
            codes[np.arange(len(codes)) != np.repeat(ends - 1, sizes[own] + 1)] = data[_ranges(starts[own], sizes[own])]
            forms, firsts = self._solved(codes, begin, sizes[own])
            ids = self._form_ids.take(pa.array(forms))
            bounds = np.frombuffer(ids.buffers()[1], "<i4")[: len(ids) + 1]
            found.append(_cut(ids, np.append(bounds[firsts], bounds[-1])))
            at += len(own)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays(found).take(pa.array(back)) if found else pa.array([], pa.binary())

    def encoded(self, shown: list[str]) -> pa.Array:
        """Ids of texts with their space marks, as little-endian 32-bit integers. Texts are cut at
        safe boundaries; what lies between them is solved once."""
        points = np.frombuffer("".join(shown).encode("utf-32-le", "replace"), "<u4")
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in shown], dtype=np.int64)])
        if not len(points):
            return pa.array([b""] * len(shown), pa.binary())
        codes = self._code[points]
        if not codes.all():
            strange = codes == 0
            if self.bytes:
                own = points[strange]
                wide = np.ones(len(points), np.int64)
                wide[strange] += (own > 0x7F).astype(np.int64) + (own > 0x7FF) + (own > 0xFFFF)
                bounds = np.concatenate([[0], np.cumsum(wide)])[bounds]
                codes, strange = np.repeat(codes, wide), np.repeat(strange, wide)
                codes[strange] = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8) + np.uint32(self._foreign)
            else:
                codes[strange] = self._foreign
        near = np.minimum(codes, self._linked + 1)
        safe = np.append(True, ~self._near[near[:-1], near[1:]])
        safe[bounds[bounds < len(codes)]] = True
        cuts = np.append(np.flatnonzero(safe), len(codes))
        width = codes.dtype.itemsize
        units = _cut_bytes(codes, cuts * width).dictionary_encode()
        data, starts = units.dictionary.buffers()[2], np.frombuffer(units.dictionary.buffers()[1], "<i4")[: len(units.dictionary) + 1] // width
        ids = self._distinct(np.frombuffer(data, codes.dtype)[: starts[-1]], starts.astype(np.int64)).take(units.indices)
        return _cut(ids, np.frombuffer(ids.buffers()[1], "<i4")[np.searchsorted(cuts, bounds)])

    def whole(self, texts: list[str]) -> pa.Array:
        """Ids of texts of ordinary length, each the single chunk of its document."""
        return self.encoded([META + t.replace(" ", META) if t else "" for t in texts])

    def same(self, ids: pa.Array, texts: list[str]) -> list[bool]:
        """Whether ids, read back piece by piece, give exactly these texts."""
        bounds = np.frombuffer(ids.buffers()[1], "<i4")[ids.offset : ids.offset + len(ids) + 1] // 4
        if bounds[0] == bounds[-1]:
            return [not t for t in texts]
        read = self._raw.take(pa.array(np.frombuffer(ids.buffers()[2], "<i4")[bounds[0] : bounds[-1]]))
        ends = np.frombuffer(read.buffers()[1], "<i4")[bounds - bounds[0]].tolist()
        shown = memoryview(read.buffers()[2]).cast("B")
        return [shown[a:b] == t.encode("utf-8", "replace") for a, b, t in zip(ends, ends[1:], texts, strict=False)]

    def decode(self, data: bytes, start: bool = True) -> str:
        """The text of ids; ``start`` says that the first space mark was put in front."""
        text = "".join(map(self.shown.__getitem__, np.frombuffer(data, "<i4").tolist()))
        text = _BYTES.sub(lambda run: bytes(ord(c) - _PRIVATE for c in run.group()).decode("utf-8", "replace"), text)
        return text[1:] if start and text[:1] == " " else text


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1])) + np.repeat(starts - ends + sizes, sizes)


def _cut_bytes(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of an array, cut at ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4")), pa.py_buffer(data)])


def _cut(ids: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The bytes of all values together, cut at ``bounds``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype("<i4")), ids.buffers()[2]])


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def boundary_states(m: PieceModel, text: str, at: int) -> list[State]:
    """Pieces (start, end) that may hold the character before ``at``."""
    return [(s, e) for s in range(max(0, at - m.longest), at) for e in range(at, min(len(text), s + m.longest) + 1) if (text[s:e] in m.ids or e == s + 1) and m.agree("", text[s:e])]


def safe_places(m: PieceModel, text: str, start: int, end: int) -> tuple[int, int]:
    """The first and last safe boundary strictly inside, or (-1, -1)."""
    one = text.find(META, start + 1, end) if m.safe_space else -1
    while one > 0 and text[one - 1] == META:
        one = text.find(META, one + 1, end)
    two = text.rfind(META, one, end) if one > 0 else -1
    while two > one and text[two - 1] == META:
        two = text.rfind(META, one, two)
    return one, two


def forward(m: PieceModel, text: str, begin: list[State], end: int) -> tuple[dict[State, np.ndarray], dict[tuple[int, State], State]]:
    """Best scores from each state of ``begin`` to each piece that holds the character before
    ``end``, and for each start the piece before a piece."""
    ends: dict[int, dict[State, np.ndarray]] = {}
    back: dict[tuple[int, State], State] = {}
    for k, state in enumerate(begin):
        row = np.full(len(begin), NONE)
        row[k] = 0.0
        ends.setdefault(state[1], {})[state] = row
    out: dict[State, np.ndarray] = {}
    for at in range(min(s[1] for s in begin), end + m.longest + 1):
        for state, row in ends.pop(at, {}).items():
            if state[0] < end <= at:
                out[state] = row
            if at >= end:
                continue
            before = text[state[0] : at]
            for stop in range(at + 1, min(len(text), at + m.longest) + 1):
                piece = text[at:stop]
                if not (piece in m.ids or stop == at + 1) or not m.agree("", piece) or before and not m.agree(before, piece):
                    continue
                into = ends.setdefault(stop, {})
                old = into.get((at, stop))
                better = row > (NONE if old is None else old)
                for k in np.nonzero(better)[0]:
                    back[int(k), (at, stop)] = state
                into[at, stop] = row.copy() if old is None else np.maximum(old, row)
    return out, back


def _edges(m: PieceModel, text: str, start: int, end: int, first: bool, last: bool) -> tuple[list[State], dict[State, np.ndarray]]:
    """A chunk's transfer matrix: its start states, and by end state the scores from each."""
    begin = [(start, start)] if first else boundary_states(m, text, start)
    one, two = safe_places(m, text, start, end)
    if one < 0:
        out, _ = forward(m, text, begin, end)
    else:
        left, _ = forward(m, text[:one], begin, one)
        enter = np.max(list(left.values()), axis=0) if left else np.full(len(begin), NONE)
        right, _ = forward(m, text, [(two, two)], end)
        out = {state: enter + row[0] for state, row in right.items()}
    return begin, {s: row for s, row in out.items() if not last or s[1] == end}


def _path(m: PieceModel, text: str, entry: State, leave: State, end: int) -> list[str]:
    _, back = forward(m, text, [entry], end)
    pieces, at = [], leave
    while at != entry:
        pieces.append(text[at[0] : at[1]])
        at = back[0, at]
    return pieces[::-1]


def _chunk_parts(m: PieceModel, text: str, start: int, end: int, entry: State, leave: State) -> tuple[bytes, str, bytes]:
    """Ids of a chunk's pieces after ``entry`` up to ``leave``: those before and after safe boundaries, and the text between."""
    one, two = safe_places(m, text, start, end)
    if one < 0 or entry[1] > one:
        return m.token_ids(_path(m, text, entry, leave, end)), "", b""
    left, _ = forward(m, text[:one], [entry], one)
    head = _path(m, text[:one], entry, next(iter(left)), one) if entry[1] < one else []
    return m.token_ids(head), text[one:two], m.token_ids(_path(m, text, (two, two), leave, end))


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for batch in batches:
                at = 0
                for texts in by_bytes(each_value(batch.column(1)), limit=BATCH_BYTES):
                    found = m.whole(texts)
                    exact = m.same(found, [f" {t}" if t else t for t in texts])
                    sizes = pa.array(np.diff(np.frombuffer(found.buffers()[1], "<i4")[: len(texts) + 1]) // 4, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), sizes, found, pa.array(exact, pa.bool_())], ["id", "n_tokens", "ids", "exact"])
                    at += len(texts)
        finally:
            release_memory()

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            out: list[tuple] = []
            for uid, k, text, start, end, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin, scores = _edges(m, text, start, end, first, last)
                out += [(uid, k, start - s[0], s[1] - start, end - e[0], e[1] - end, float(row[i])) for e, row in scores.items() for i, s in enumerate(begin) if row[i] > NONE]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.float64() if i == 6 else pa.int64()) for i in range(7)], ["uid", "k", "s0", "s1", "e0", "e1", "score"])

    return run


_ENTRY, _EXIT, _LINK = ["s0", "s1"], ["e0", "e1"], ["m0", "m1"]


def _halves(matrices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The left and right of each two neighbouring matrices, by their parent's number."""
    parent = F.shiftright("k", 1).alias("parent")
    left = matrices.where("k % 2 = 0").select("uid", parent, *_ENTRY, F.col("e0").alias("m0"), F.col("e1").alias("m1"), F.col("score").alias("before"))
    right = matrices.where("k % 2 = 1").select("uid", parent, F.col("s0").alias("m0"), F.col("s1").alias("m1"), *_EXIT, F.col("score").alias("after"))
    return left, right


def multiplied(matrices: DataFrame) -> DataFrame:
    """Max-plus products (uid, k, s0, s1, e0, e1, score) of matrices 2k and 2k + 1; the last one may have no partner."""
    left, right = _halves(matrices)
    products = left.join(right, ["uid", "parent", *_LINK]).groupBy("uid", "parent", *_ENTRY, *_EXIT).agg(F.max(F.col("before") + F.col("after")).alias("score"))
    alone = left.join(right.select("uid", "parent").distinct(), ["uid", "parent"], "left_anti")
    alone = alone.select("uid", "parent", *_ENTRY, F.col("m0").alias("e0"), F.col("m1").alias("e1"), F.col("before").alias("score"))
    return products.unionByName(alone).withColumnRenamed("parent", "k")


def _opened(chosen: DataFrame, matrices: DataFrame) -> DataFrame:
    """The chosen entry and exit of each matrix of a round, from those of the round after it."""
    left, right = _halves(matrices)
    own = chosen.withColumnRenamed("k", "parent")
    pairs = own.join(left, ["uid", "parent", *_ENTRY]).join(right, ["uid", "parent", *_LINK, *_EXIT])
    link = F.max_by(F.struct(*_LINK), F.struct(F.col("before") + F.col("after"), *_LINK)).alias("m")
    pairs = pairs.groupBy("uid", "parent", *_ENTRY, *_EXIT).agg(link)
    k = F.shiftleft("parent", 1)
    both = F.array(F.struct(k.alias("k"), *_ENTRY, F.col("m.m0").alias("e0"), F.col("m.m1").alias("e1")), F.struct((k + 1).alias("k"), F.col("m.m0").alias("s0"), F.col("m.m1").alias("s1"), *_EXIT))
    alone = own.join(right.select("uid", "parent").distinct(), ["uid", "parent"], "left_anti")
    return pairs.select("uid", F.inline(both)).unionByName(alone.select("uid", k.alias("k"), *_ENTRY, *_EXIT))


def boundary_pieces(matrices: DataFrame) -> DataFrame:
    """(uid, k, s0, s1, e0, e1): the pieces at both ends of each chunk on the best path of its document."""
    rounds = [written(matrices, "matrices")]
    last = rounds[0].agg(F.max("k")).first()[0] or 0
    for _ in range(last.bit_length()):
        rounds.append(written(multiplied(rounds[-1]), "matrices"))
    best = F.max_by(F.struct(*_ENTRY, *_EXIT), F.struct("score", *_ENTRY, *_EXIT)).alias("m")
    chosen = written(rounds.pop().groupBy("uid", "k").agg(best).select("uid", "k", "m.*"), "boundary-pieces")
    while rounds:
        before, chosen = chosen, written(_opened(chosen, rounds.pop()), "boundary-pieces")
        discard(before)
    return chosen


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            uids, ks, parts, texts = [], [], [], []
            for uid, k, text, start, end, _, _, s0, s1, e0, e1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry, leave = (start - s0, start + s1), (end - e0, end + e1)
                uids.append(uid)
                ks.append(k)
                parts.append(_chunk_parts(m, text, start, end, entry, leave))
                texts.append(text[entry[1] : leave[1]].replace(META, " "))
            middles = (x for run in by_bytes((p[1] for p in parts), limit=BATCH_BYTES) for x in m.encoded(run).to_pylist())
            ids = pa.array([p[0] + x + p[2] for p, x in zip(parts, middles, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ks, pa.int64()), ids, pa.array(m.same(ids, texts), pa.bool_())], ["uid", "k", "ids", "exact"])

    return run


def _chunks(m_longest: int, chunk: int):
    """Rows (uid, id, text) give the text's chunks with what surrounds them, each text cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = 2 * m_longest
        for batch in batches:
            for i, text in enumerate(each_value(batch.column(2), 1)):
                shown = META + text.replace(" ", META)
                n = len(shown)
                for first in range(0, n, 64 * chunk):
                    starts = range(first, min(n, first + 64 * chunk), chunk)
                    lows, highs = [max(0, s - around) for s in starts], [min(n, s + chunk) for s in starts]
                    columns = [
                        pa.array([s // chunk for s in starts], pa.int64()), pa.array([shown[a : min(n, b + around)] for a, b in zip(lows, highs, strict=True)]), pa.array([s - a for s, a in zip(starts, lows, strict=True)], pa.int64()),
                        pa.array([b - a for a, b in zip(lows, highs, strict=True)], pa.int64()), pa.array([s == 0 for s in starts]), pa.array([b == n for b in highs]), pa.array([META in text] * len(starts)),
                    ]
                    own = pa.array([i] * len(starts), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *columns], ["uid", "id", "k", "text", "start", "end", "first", "last", "lossy"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, parts, exact), parts being (k, ids) in order, give each document's ids."""
    for batch in batches:
        whole = [b"".join(x["ids"] for x in parts) for parts in each_value(batch.column(1), 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array(whole, pa.binary()), batch.column(2)], ["uid", "n_tokens", "ids", "exact"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian 32-bit integers), exact (whether
    decoding gives the text back). Texts of up to ``chunk`` characters stay in their partition;
    chunks of longer ones are dealt out anew."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = rows.where(F.char_length("text") <= chunk).mapInArrow(_small(path), f"id {kind}, n_tokens long, ids binary, exact boolean")
    giant = rows.where(F.char_length("text") > chunk).select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    cut = giant.mapInArrow(_chunks(model(path).longest, chunk), f"uid long, id {kind}, k long, text string, start long, end long, first boolean, last boolean, lossy boolean")
    chunks = written(cut.repartition("uid", "k"), "chunks")
    if chunks.isEmpty():
        return small.withColumnRenamed("id", id_col)
    own = chunks.select("uid", "k", "text", "start", "end", "first", "last")
    matrices = own.mapInArrow(_matrices(path), "uid long, k long, s0 long, s1 long, e0 long, e1 long, score double")
    traced = own.join(boundary_pieces(matrices), ["uid", "k"]).mapInArrow(_traced(path), "uid long, k long, ids binary, exact boolean")
    whole = traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("exact").alias("exact"))
    whole = whole.mapInArrow(_joined, "uid long, n_tokens long, ids binary, exact boolean").join(chunks.where("first").select("uid", "id", "lossy"), "uid")
    return small.unionByName(whole.select("id", "n_tokens", "ids", (F.col("exact") & ~F.col("lossy")).alias("exact"))).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded documents; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
