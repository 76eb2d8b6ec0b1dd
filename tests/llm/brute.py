"""Slow, plain versions that the tests compare with."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from math import log10

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").encode().lower())


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(rows, n, percent):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def contamination(rows, items, window):
    """doc_id to (n_words, n_hit, n_items, sha256)."""
    wanted = {}
    for name, text in items:
        w = words(text, ALNUM)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    sizes = sorted({len(k) for k in wanted})
    out = {}
    for d, text in rows:
        w, hit, found = words(text, ALNUM), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                names = wanted.get(tuple(w[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


class Katz:
    """Bigram model by dictionaries; every word that is no class shares one, told apart by p1."""

    def __init__(self, texts, share, cutoff, discounts):
        token_lists = [[*words(t), b"\x00end"] for t in texts]
        self.uni = Counter(t for ts in token_lists for t in ts)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.classes = {w for w, c in self.uni.items() if c > share * self.n}
        pairs = Counter()
        for ts in token_lists:
            own = ["<begin>", *(self.of(t) for t in ts)]
            pairs.update(zip(own, own[1:]))
        self.pairs = pairs
        self.times = Counter()
        for (h, _), c in pairs.items():
            self.times[h] += c
        self.d = discounts([sum(c == r for c in pairs.values()) for r in range(1, cutoff + 2)])
        self.cutoff = cutoff

    def of(self, w):
        return w if w in self.classes else "<other>"

    def p1(self, w):
        return (self.uni[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p1_class(self, c):
        return 1 - sum(self.p1(w) for w in self.classes) if c == "<other>" else self.p1(c)

    def kept(self, c):
        return c * (self.d[c - 1] if c <= self.cutoff else 1.0)

    def p_class(self, h, c):
        if (h, c) in self.pairs:
            return self.kept(self.pairs[h, c]) / (self.times[h] + 1)
        if not self.times[h]:
            return self.p1_class(c)
        seen = [x for (g, x) in self.pairs if g == h]
        left = 1 - sum(self.kept(self.pairs[h, x]) for x in seen) / (self.times[h] + 1)
        return left / (1 - sum(self.p1_class(x) for x in seen)) * self.p1_class(c)

    def score(self, text):
        total, h = 0.0, "<begin>"
        for t in [*words(text), b"\x00end"]:
            c = self.of(t)
            total += log10(self.p_class(h, c))
            if c == "<other>":
                total += log10(self.p1(t)) - log10(self.p1_class(c))
            h = c
        return total


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _enc(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(_enc(v) for v in (doc_id, source, lang, n_chars, text)))


def merkle_paths(hashes, arity):
    """Top and, per node, the (left, right) siblings of each level."""
    current, place, paths = list(hashes), list(range(len(hashes))), [[] for _ in hashes]
    while len(current) > 1:
        for i, p in enumerate(place):
            start = p - p % arity
            run = current[start : start + arity]
            paths[i].append(("".join(run[: p - start]), "".join(run[p - start + 1 :])))
        current = [sha("".join(current[s : s + arity])) for s in range(0, len(current), arity)]
        place = [p // arity for p in place]
    return current[0], paths


def manifest(rows, arity=16, tampered=lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0):
    """rows: (doc_id, source, lang, n_chars, text). Result: {doc_id: [(leaf, subroot, root, proof, folded, verified)]}."""
    leaves = [(r, manifest_leaf(*r)) for r in rows]
    by_source = {}
    for r, leaf in leaves:
        by_source.setdefault(r[1], []).append((r, leaf))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subroots, inner = [], {}
    for s in sources:
        members = sorted(by_source[s], key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1]))
        top, paths = merkle_paths([leaf for _, leaf in members], arity)
        subroots.append(top)
        inner[s] = (members, paths, top)
    root, top_paths = merkle_paths(subroots, arity)
    out = {}
    for k, s in enumerate(sources):
        members, paths, top = inner[s]
        for (r, leaf), path in zip(members, paths):
            full = path + top_paths[k]
            text = r[4]
            if tampered(r[0]) and text is not None:
                text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            folded = manifest_leaf(r[0], r[1], r[2], r[3], text)
            for left, right in full:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in full))
            out.setdefault(r[0], []).append((leaf, top, root, proof, folded, folded == root))
    return out


def hard_negatives(rows, every=100, low=80, top=5):
    """rows: (vec_id, label, vector). Result rows as the operator gives them."""
    kept = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or x != x or abs(x) == float("inf") for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, label, [int(256 * float(x) // 1) for x in vector]))
    out = []
    for a_id, a_label, a in kept:
        if a_id % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, q)), v, lab) for v, lab, q in kept]
        order = sorted(scored, key=lambda t: (-t[0], t[1]))
        positives = [t for t in order if t[2] == a_label and t[1] != a_id][:top]
        for ps, p_id, _ in positives:
            fits = [t for t in order if t[2] != a_label and low * ps <= 100 * t[0] <= 100 * ps][:top]
            out += [(a_id, p_id, k + 1, n_id, ps, ns) for k, (ns, n_id, _) in enumerate(fits)]
    return sorted(out)
