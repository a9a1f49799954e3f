"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def groups(pairs, nodes):
    """Smallest node of each node's component."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(docs):
    fps = [(i, fingerprint(t)) for i, t in docs]
    pairs = [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[k + 1 :] if (x ^ y).bit_count() <= 3]
    root = groups(pairs, [i for i, _ in fps])
    return sorted((i, f"{f:016x}", root[i]) for i, f in fps)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[s : s + 13]), set()).add(item)
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if own := wins.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def passages(rows):
    """Rows of repeated passages from all pairs of units, without bands; picks of blocks by their definition."""
    import re

    import numpy as np

    from rankloom.llm import passage_dedup as p

    low = -(1 << 63)
    lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    docs, units = {}, {}
    for i, text in {(i, t or "") for i, t in rows}:
        key = (low if i is None else i, text)
        words = [w for w in re.split(r"[ \t-\r]+", lower(text)) if w]
        docs[key] = words
        at, run, found = 0, [], set()
        for line in [*lower(text).split("\n"), ""]:
            n = len(line.split())
            if n:
                found.add((at, n))
            if 0 < n <= p.WRAPPED:
                run.append((at, n))
            else:
                if len(run) > 1:
                    found.add((run[0][0], sum(x[1] for x in run)))
                run = []
            at += n
        hashes = p.Words([text]).shingles.tolist()
        for s in range(len(words) - p.UNIT - p.LOOK + 2):
            own = hashes[s : s + p.LOOK]
            found.add((s + own.index(min(own)), p.UNIT, True))
        for s, n, *block in found:
            units.setdefault((tuple(words[s : s + n]), bool(block)), []).append((*key, s, n))
    shingles = {c: {c[0][i : i + 5] for i in range(len(c[0]) - 4)} for c in units}
    near = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    contents = list(units)
    edges = []
    for x, a in enumerate(contents):
        for b in contents[x + 1 :]:
            if a[0] == b[0] or a[1] == b[1] and min(len(a[0]), len(b[0])) >= 8 and (not a[1] or a[0][:5] == b[0][:5]) and near(a, b):
                edges.append((x, contents.index(b)))
    clusters = {}
    for x, r in groups(edges, range(len(contents))).items():
        clusters.setdefault(r, set()).update(units[contents[x]])
    # documents with one id are in the order of the hash of their text
    order = {k: (k[0], np.uint64(hash_(k[1])).astype(np.int64)) for k in docs}
    by_doc = {}
    for places in clusters.values():
        keep = min(places, key=lambda u: (*order[u[0], u[1]], u[2], u[3]))
        if len({u[:2] for u in places}) > 1:
            for u in places:
                by_doc.setdefault(u[:2], set()).add((u[2], u[3], keep))
    grown = {}
    for key, found in by_doc.items():
        gone = sorted((s, s + n, keep) for s, n, keep in found if keep[:3] != (*key, s))
        more = set()
        for i, (s, e, keep) in enumerate(gone):
            other, own = docs[keep[:2]], docs[key]
            if keep[:2] == key:
                continue
            if not any(x[1] >= s for x in gone[:i]):
                g = 0
                while g < p.REACH and s - g > 0 and keep[2] - g > 0 and own[s - g - 1] == other[keep[2] - g - 1]:
                    g += 1
                more.add((s - g, g, (*keep[:2], keep[2] - g, g)))
            if not any(x[1] > e for x in gone[:i]) and not any(x[0] <= e for x in gone[i + 1 :]):
                g, end = 0, keep[2] + keep[3]
                while g < p.REACH and e + g < len(own) and end + g < len(other) and own[e + g] == other[end + g]:
                    g += 1
                more.add((e, g, (*keep[:2], end, g)))
        for x in more:
            if x[1]:
                grown.setdefault(key, set()).add(x)
                grown.setdefault(x[2][:2], set()).add((*x[2][2:], x[2]))
    out = []
    for key, found in by_doc.items():
        all_units = found | grown.get(key, set())
        covered = sorted({w for s, n, _ in all_units for w in range(s, s + n)})
        # units that only touch make one passage as well, so runs of covered words are the passages
        runs = _runs(covered)
        inside = {(s, n, keep) for s, n, keep in all_units if any(a <= s <= b for a, b in runs if b - a + 1 >= p.MIN_PASSAGE)}
        if inside:
            removed = _runs(sorted({w for s, n, keep in inside if keep[:3] != (*key, s) for w in range(s, s + n)}))
            ids = [None if x == low else x for x in sorted({keep[0] for _, _, keep in inside})]
            out.append((None if key[0] == low else key[0], removed, sum(b - a + 1 for a, b in removed), ids, ids[0]))
    return out


def _runs(words):
    out = []
    for w in words:
        if out and w == out[-1][1] + 1:
            out[-1][1] = w
        else:
            out.append([w, w])
    return [tuple(x) for x in out]


def hash_(text):
    """xxHash64 with Spark's seed, as an unsigned number."""
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def proximity(docs, items, slop):
    """(doc_id, item_id, start) of windows all of whose terms stand within ``slop`` words of their places."""
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    texts = sorted({(i, t or "") for i, t in docs}, key=str)
    count = {}
    for _, t in texts:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    out = set()
    for i, t in texts:
        own = words(t)
        for item, text in items:
            terms = words(text)
            for start in range(max(1, len(terms) - 12) if terms else 0):
                places = range(start, min(len(terms), start + 13))
                rare = {min(range(s, min(len(terms), s + 13)), key=lambda p: (count.get(terms[p], 0), p)) for s in range(max(1, len(terms) - 12))}
                for anchor in rare:
                    for shift in [p - anchor for p, w in enumerate(own) if w == terms[anchor]]:
                        if all(any(0 <= p < len(own) and own[p] == terms[q] for p in range(shift + q - slop, shift + q + slop + 1)) for q in places):
                            out.add((i, item, start))
    return sorted(out, key=str)
