"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def shingles(text, n):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(docs, n, num, den):
    """{id: (set size, component)} of (id, text) rows."""
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingles(t, n))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(p and q and den * len(p & q) >= num * len(p | q) for p in sets[x] for q in sets[y]):
                a, b = sorted((root(x), root(y)))
                up[b] = a
    return {i: root(i) for i in ids}


def contaminated(docs, items, n=5, threshold=0.8):
    out = []
    for d, t in docs:
        s = shingles(t, n)
        for i, u in items:
            q = shingles(u, n)
            if q and len(q & s) >= threshold * len(q):
                out.append((d, i, len(q), len(q & s), len(q & s) / len(q)))
    return sorted(out)


def mix(rows, weights=(5, 2, 1), most=3, seed="mix"):
    """rows (id, source, text) -> rows (id, size, source_size, target, taken)."""
    sized = []
    for i, s, t in rows:
        kept = sum(c.isalpha() or c in " \t\n\x0b\x0c\r" for c in t or "")
        w = max(kept / len(t) if t else 1.0, 0.05)
        u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        sized.append((i, s, len(words(t)), -math.log(u) / w))
    sizes = Counter()
    for _, s, n, _ in sized:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level >= most * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            free.remove(s)
    out = []
    for s in order:
        own = sorted((k, (i is not None, i or 0), n, i) for i, q, n, k in sized if q == s)
        epochs = min(most, int(target[s] // sizes[s])) if sizes[s] else 0
        rest, before = target[s] - epochs * sizes[s], 0
        for _, _, n, i in own:
            out.append((i, n, sizes[s], round(target[s], 6), n * (epochs + (before + n / 2 < rest))))
            before += n
    return sorted(out, key=repr)


def grams(text):
    c = [GAP if not ch.isalpha() else ch for ch in f" {(text or '').lower()} "]
    c = [x for i, x in enumerate(c) if not (i and x == GAP and c[i - 1] == GAP)]
    n = Counter()
    for i, x in enumerate(c):
        if x != GAP:
            n[(x,)] += 1
        if i + 1 < len(c):
            n[(x, c[i + 1])] += 1
        if i + 2 < len(c) and c[i + 1] != GAP:
            n[(x, c[i + 1], c[i + 2])] += 1
    return n


GAP = "\x01"


def order_of(counts, n):
    """Most frequent first; of equal ones the smaller number, which is the shorter or the first by code point."""
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:n]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def languages(rows, size=300):
    """rows (id, text, lang) -> {position: (lang, score)}."""
    by = defaultdict(Counter)
    for i, t, lang in rows:
        if lang is not None and t is not None and not held_out(i):
            by[lang] += grams(t)
    profiles = {lang: {g: r for r, g in enumerate(order_of(c, size))} for lang, c in by.items()}
    out = []
    for _, t, _ in rows:
        own = order_of(grams(t), size) if t and any(ch.isalpha() for ch in t.lower()) else []
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        away = {lang: sum(min(size, abs(p.get(g, 2 * size) - r)) for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=lambda k: away[k])
        out.append((best, 1 - away[best] / (size * len(own))))
    return out


def arcs(rows, n_shards, vnodes):
    """Home point and place in its arc of each row (id, text), and the owner of each point."""
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16)
    points = sorted((number(f"{s}:{v}"), s) for s in range(n_shards) for v in range(vnodes))
    at = []
    for i, t in rows:
        key = "" if i is None else str(i)
        p = number(key)
        at.append((next((k for k, (q, _) in enumerate(points) if q >= p), 0), number(f"{key}:{t or ''}")))
    return at, [s for _, s in points]


def bigram_scores(docs, targets, frequent, prior=1.0):
    """(words, target loss, background loss) of each of the rows (id, text), in order."""
    seqs = [words(t) for _, t in docs]
    total = sum(map(len, seqs))
    uni = {side: Counter() for side in (True, False)}
    begun = Counter()
    for (i, _), w in zip(docs, seqs):
        if w:
            uni[i in targets].update(w)
            begun[i in targets] += 1
    every = uni[True] + uni[False]
    known = {w for w, n in every.items() if n >= max(1, frequent * total)}
    size = {side: sum(uni[side].values()) + begun[side] for side in uni}
    least = min(size.values()) or max(size.values())
    weight = {side: least / size[side] if size[side] else 1.0 for side in uni}
    label = lambda w: w if w in known else "other words"
    pairs, hist = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    own = []
    for (i, _), w in zip(docs, seqs):
        c = Counter(zip(["the start", *map(label, w)], [*w, "the end"])) if w else Counter()
        own.append(c)
        pairs[i in targets].update(c)
        for (h, _), n in c.items():
            hist[i in targets][h] += n

    def lower(side, w):
        mass = size[side] * weight[side] + len(every) + 1
        if w == "the end" or w in known:
            return ((begun[side] if w == "the end" else uni[side][w]) * weight[side] + 1) / mass
        others = [x for x in every if x not in known]
        return (sum(uni[side][x] for x in others) * weight[side] + len(others)) / mass / len(others)

    out = []
    for (i, _), w, c in zip(docs, seqs, own):
        loss = []
        for side in (True, False):
            out_of = lambda n, side=side: n if (i in targets) == side else 0
            x = [n * -math.log((weight[side] * (pairs[side][p] - out_of(n)) + prior * lower(side, p[1])) / (weight[side] * (hist[side][p[0]] - out_of(n)) + prior)) for p, n in c.items()]
            loss.append(sum(x) / (len(w) + 1) if w else None)
        out.append((len(w), *loss))
    return out


def scramble(x):
    """The splitmix64 finaliser."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def word_hash(word):
    """A polynomial in odd numbers drawn for each byte."""
    number = lambda b: scramble(((b + 1) * 0x9E3779B97F4A7C15 + 1) % 2**64) | 1
    return scramble(sum(number(b) * pow(0xD1342543DE82EF95, k, 2**64) for k, b in enumerate(word.encode())) % 2**64)


def buckets(text, n):
    """Bucket of each word and of each pair of neighbours."""
    memo = {w: word_hash(w) for w in set(words(text))}
    h = [memo[w] for w in words(text)]
    return [x % n for x in h] + [scramble((3 * a + b) % 2**64) % n for a, b in zip(h, h[1:])]


def uniform(i, seed):
    return (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
