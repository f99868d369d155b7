"""Plain forms of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def repeated_strings(docs: list[tuple[object, str | None]], length: int) -> list[tuple]:
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen: Counter = Counter()
    for _, b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_words(docs: list[tuple[object, str | None]], window: int) -> list[tuple]:
    split = [(i, SPACE.findall((t or "").encode())) for i, t in docs]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def components(docs: list[tuple[object, str | None]], words: int, percent: int) -> list[tuple]:
    sets = []
    for _, t in docs:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, list] = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)].append(d)
    best = [min(least[find(i)], default=None) for i in range(len(docs))]
    return [(d, len(sets[i]), best[i], None if d is None else d == best[i]) for i, (d, _) in enumerate(docs)]


def held_out(i: object) -> bool:
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def base_scores(docs: list[tuple[object, str | None]]) -> list[tuple]:
    tokens = [(i, [*SPACE.findall(lower(t)), None]) for i, t in docs]
    c = Counter(w for i, ws in tokens if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def log_kt(a: int, b: int) -> float:
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def tree_scores(train: list[bytes], texts: list[bytes]) -> list[float]:
    """log2 probabilities under context trees of depth 2, straight from the recursion."""
    counts: dict = defaultdict(lambda: [0, 0])

    def steps(b: bytes):
        for k, x in enumerate(b):
            context = (bytes(2) + b[:k])[-2:]
            for bit in range(8):
                yield context, (bit, x >> (8 - bit)), x >> (7 - bit) & 1

    for b in train:
        for context, node, value in steps(b):
            for d in range(3):
                counts[node, context[2 - d :]][value] += 1
    children: dict = defaultdict(set)
    for node, context in list(counts):
        if context:
            children[node, context[1:]].add(context)
    memo: dict = {}

    def weighted(node, context) -> float:
        if (node, context) not in memo:
            own = log_kt(*counts[node, context])
            if len(context) < 2:
                below = sum(weighted(node, c) for c in children[node, context])
                m = max(own, below)
                own = m + math.log(math.exp(own - m) + math.exp(below - m)) - math.log(2)
            memo[node, context] = own
        return memo[node, context]

    def chance(node, context, value, depth=0) -> float:
        here = context[2 - depth :]
        n = counts[node, here] if (node, here) in counts else [0, 0]
        own = (n[value] + 0.5) / (sum(n) + 1)
        if depth == 2:
            return own
        w = weighted(node, here) if (node, here) in counts else 0.0
        share = math.exp(log_kt(*n) - math.log(2) - w) if (node, here) in counts else 0.5
        return share * own + (1 - share) * chance(node, context, value, depth + 1)

    return [sum(math.log2(chance(node, context, value)) for context, node, value in steps(b)) for b in texts]
