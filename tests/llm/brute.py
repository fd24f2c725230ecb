"""Plain-Python versions of the corpus contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def joined(spans):
    return ",".join("%s:%d:%d" % s for s in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 if d > 4 else d * 2
    return total % 10 == 0


def pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        ("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(t) if ok(m[0])]


def secrets(t):
    place = {"assign": 0, "access": 1, "hex": 2}
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(k, m.start(), m.end()) for k, p, n in (("access", ACCESS, 18), ("hex", HEX, 16)) for m in p.finditer(t) if len(m[0]) >= n]
    return sorted(found, key=lambda x: (x[1], place[x[0]]))


def shingles(t, lower=True):
    words = (t or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    of = components(ids, links)
    return {i: (len(sets[i]), of[i], of[i] == i) for i in ids}


def suffixes(rows, length=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = sum(1 for k, m in enumerate(mark) if m and (not k or not mark[k - 1]))
        out.append((i, len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped, total = dict(sizes), {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        aim = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if aim[s] > most * left[s]]
        if not over:
            return capped | aim
        capped |= {s: most * left[s] for s in over}


def windows(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, window + 1):
                p = tuple(w[k : k + n])
                if len(p) == n and p in patterns:
                    hit |= set(range(k, k + n))
                    found |= patterns[p]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def scored_values(edges, rounds=3, support=5, sure=0.8):
    """Of (pattern, value, kind or None): {(value, kind): score} after rounds over the whole graph."""
    values, seeds, unknown = defaultdict(set), defaultdict(set), defaultdict(set)
    for p, v, k in edges:
        values[p].add(v)
        (seeds[p, k] if k else unknown[p]).add(v)
    scores = {}
    for _ in range(rounds):
        conf = {}
        for p in values:
            for k in {k for q, k in seeds if q == p} | {k for v, k in scores if v in unknown[p]}:
                weight = len(seeds.get((p, k), ())) + sum(scores.get((v, k), 0) for v in unknown[p])
                if len(values[p]) >= support and weight / (len(values[p]) + 1) >= sure:
                    conf[p, k] = weight / (len(values[p]) + 1)
        miss = defaultdict(lambda: 1.0)
        for (p, k), c in conf.items():
            for v in unknown[p]:
                miss[v, k] *= 1 - c
        scores = {x: 1 - m for x, m in miss.items()}
    return scores
