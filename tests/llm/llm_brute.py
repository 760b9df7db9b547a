"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows, distance=2):
    """Fingerprint and component of each id; ``rows`` are (id, text)."""
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= distance]
    return prints, union(ids, pairs)


def cut_repeats(rows, least=31, spread=20):
    """Kept text, removed spans of each (id, text), ids in order."""
    blanks = " \t\n\v\f\r"
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        places = []
        for run in re.finditer(f"[^{blanks}]+", text or ""):
            start = run.start()
            for n in range(run.start(), run.end()):
                alone = any(a <= text[n] <= b for a, b in ("\u0e00\u0eff", "\u1000\u109f", "\u1780\u17ff", "\u3040\u30ff", "\u3400\u4dbf", "\u4e00\u9fff", "\uf900\ufaff", "\U00020000\U0003ffff"))
                if (alone or n - start == 32) and start < n:
                    places.append((start, n))
                    start = n
                if alone:
                    places.append((n, n + 1))
                    start = n + 1
            if start < run.end():
                places.append((start, run.end()))
        words = [text[a:b].lower() for a, b in places]
        ranks = [(hashlib.md5(w.encode()).hexdigest()[:8], n) for n, w in enumerate(words)]
        opens = {min(ranks[n : n + spread])[1] for n in range(len(words) - spread + 1)} | {0, len(words) - least}
        gone = set()
        for n in sorted(o for o in opens if 0 <= o <= len(words) - least):
            first = seen.setdefault(tuple(words[n : n + least]), (i, n))
            if first != (i, n):
                gone.update(range(max(n, first[1] + least) if first[0] == i else n, n + least))
        spans = []
        for n in sorted(gone):
            a, b = places[n - 1][1] if n else 0, places[n][1]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        kept = "" if text is None else "".join(text[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(text)]))
        out[i] = (None if text is None else kept, spans)
    return out


def tiling(pattern, text, least):
    """Greedy string tiling by the definition: longest unmarked common runs, round by round."""
    marked_p, marked_t, tiles = [False] * len(pattern), [False] * len(text), []
    while True:
        longest, matches = least - 1, []
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not marked_p[p + n] and not marked_t[t + n]:
                    n += 1
                if n > longest:
                    longest, matches = n, [(p, t)]
                elif n == longest and n >= least:
                    matches.append((p, t))
        if longest < least:
            return sorted(tiles)
        for p, t in matches:
            if not any(marked_p[p : p + longest]) and not any(marked_t[t : t + longest]):
                marked_p[p : p + longest] = marked_t[t : t + longest] = [True] * longest
                tiles.append((p, t, longest))


def coverages(text, items, least=5):
    """Coverage of each item (id, text) by ``text``."""
    words = re.findall(r"\w+", (text or "").lower())
    out = {}
    for i, item in items:
        own = re.findall(r"\w+", (item or "").lower())
        if own:
            out[i] = sum(n for _, _, n in tiling(own, words, min(least, len(own)))) / len(own)
    return out


def edf(counts):
    """Source of each slot of a cycle with ``counts`` blocks per source."""
    length, had, out = sum(counts), [0] * len(counts), []
    for t in range(length):
        ready = [i for i, n in enumerate(counts) if had[i] < n and had[i] * length // n <= t]
        pick = min(ready, key=lambda i: (-(-(had[i] + 1) * length // counts[i]), i))
        had[pick] += 1
        out.append(pick)
    return out


def mix(rows, block_rows=64, parts=200, temperature=0.5, weights=None):
    """mix_block and mix_row of each (id, source)."""
    sources = sorted({s for _, s in rows}, key=lambda s: (s is not None, s))
    queues = {s: sorted((i for i, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for s in sources}
    blocks = {s: [q[i : i + block_rows] for i in range(0, len(q), block_rows)] for s, q in queues.items()}
    total = sum(len(q) ** temperature for q in queues.values())
    share = {s: max(1, math.floor(parts * len(q) ** temperature / total + 0.5)) if weights is None else weights.get(s, 1) for s, q in queues.items()}
    out, place = {}, 0
    while any(blocks.values()):
        counts = [min(share[s], len(blocks[s])) for s in sources]
        for pick in edf(counts):
            for n, i in enumerate(blocks[sources[pick]].pop(0)):
                out[i] = (place, n)
            place += 1
    return out


def vector_groups(rows, threshold=0.98):
    """Links and component of each row (id, vector, label); ids unique."""
    links, pairs = defaultdict(int), []
    good = {}
    for i, v, label in rows:
        ok = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, float)
            good[i] = (label, x / np.linalg.norm(x))
    ids = sorted(good)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    return {i: links[i] for i, _, _ in rows}, union([i for i, _, _ in rows], pairs)


def near_words(words):
    """The words one edit away from each of ``words``."""

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    # Near words share their first or their second half, give or take a point.
    beside = defaultdict(set)
    for w in words:
        for n in (len(w), len(w) - 1):
            beside["first", n, w[: n // 2]].add(w)
            beside["second", n, w[len(w) - (n - n // 2 - 1) :]].add(w)
    close = defaultdict(set)
    for group in beside.values():
        for a in group:
            close[a].update(b for b in group if b not in close[a] and abs(len(a) - len(b)) < 2 and near(a, b))
    return close


def variants(rows, least=6, count=5, ratio=5, every=199):
    """word -> (form, root, n, n_near, form_n) of the words of (id, text) rows."""
    totals = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if code % every == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                totals[run] += 1
    words = {w: n for w, n in totals.items() if n >= count}
    close = near_words(words)
    forms = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(close[w]), words.get(forms[w]))
    return out


def ranked(docs, items, k=50):
    """item -> [(doc_id, score)] of the best documents; rows are (id, text), ids may be null."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item].update(terms(t))
    out = {}
    for item, own in wanted.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((i, score))
        out[item] = sorted(scores, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))[:k]
    return out
