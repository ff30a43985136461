"""Brute-force versions of the operators."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


class Classes(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def components(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    u = Classes()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        u.find(a)
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                u.join(a, b)
    return {d: (len(sets[d]), u.find(d)) for d in ids}


def leaks(rows, items, k, least):
    out = set()
    for item, t in items:
        n = min(k, len(WORD.findall(lower(t))))
        want = shingles(t, n) if n else set()
        out |= {(d, item) for d, x in rows if want and len(want & shingles(x, n)) >= least * len(want)}
    return out


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def line_classes(rows, tau, least):
    at = defaultdict(list)
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                at[x].append((d, i))
    u, texts = Classes(), sorted(at)
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= tau and sum((Counter(a) - Counter(b)).values()) <= tau and distance(a, b) <= tau:
                u.join(a, b)
    out = defaultdict(list)
    for a in texts:
        out[u.find(a)] += at[a]
    return {frozenset(v) for v in out.values() if len(v) > 1}


class Tree:
    """Probabilities after the longest retained suffix, by dictionaries."""

    def __init__(self, texts, depth, least, divergence, class_of):
        seqs = [[*WORD.findall(lower(t)), None] for t in texts]
        self.depth, self.single = depth, Counter(w for s in seqs for w in s)
        self.n = sum(self.single.values())
        ones, twos = (sum(c == k for c in self.single.values()) for k in (1, 2))
        self.discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        self.unseen = self.discount * len(self.single) / self.n if self.n else 1.0
        self.follow = defaultdict(Counter)
        for s in seqs:
            for i, a in enumerate(s):
                for k in range(1, min(depth, i) + 1):
                    self.follow[tuple(s[i - k : i])][a] += 1
        mass = Counter()
        for a, c in self.single.items():
            mass[class_of(a)] += c / self.n
        self.kept = set()
        for s in sorted(self.follow, key=len):
            d, n = self.follow[s], sum(self.follow[s].values())
            up = self.state(s[1:])
            if up:
                e = self.follow[up]
                bits = sum(c / n * math.log2(c / n / (e[a] / sum(e.values()))) for a, c in d.items())
            else:
                by = Counter()
                for a, c in d.items():
                    by[class_of(a)] += c
                bits = sum(c / n * math.log2(c / n / mass[k]) for k, c in by.items())
            if n >= least and bits >= divergence:
                self.kept.add(s)

    def state(self, s):
        while s and s not in self.kept:
            s = s[1:]
        return s

    def prob(self, s, a):
        s = self.state(s)
        if not s:
            return (self.single[a] - self.discount) / self.n if a in self.single else self.unseen
        d = self.follow[s]
        n, m = sum(d.values()), len(d)
        return (d[a] + m * self.prob(s[1:], a)) / (n + m)

    def score(self, text):
        s = [*WORD.findall(lower(text)), None]
        return sum(math.log10(self.prob(tuple(s[max(0, i - self.depth) : i]), a)) for i, a in enumerate(s))
