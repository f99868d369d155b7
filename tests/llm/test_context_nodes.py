"""Context trees deeper than two bytes against the plain recursion."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import defaultdict

import brute
import numpy as np
import pytest
from tidegauge.llm import context_nodes, lm_score, queries_lm


def tree_scores(train: list[bytes], texts: list[bytes], depth: int) -> list[float]:
    counts: dict = defaultdict(lambda: [0, 0])

    def steps(b: bytes):
        for k, x in enumerate(b):
            context = (bytes(depth) + b[:k])[-depth:]
            for bit in range(8):
                yield context, (bit, x >> (8 - bit)), x >> (7 - bit) & 1

    for b in train:
        for context, node, value in steps(b):
            for d in range(depth + 1):
                counts[node, context[depth - d :]][value] += 1
    children: dict = defaultdict(set)
    for node, context in list(counts):
        if context:
            children[node, context[1:]].add(context)
    memo: dict = {}

    def weighted(node, context) -> float:
        if (node, context) not in memo:
            own = brute.log_kt(*counts[node, context])
            if len(context) < depth:
                below = sum(weighted(node, c) for c in children[node, context])
                m = max(own, below)
                own = m + math.log(math.exp(own - m) + math.exp(below - m)) - math.log(2)
            memo[node, context] = own
        return memo[node, context]

    def chance(node, context, value, d=0) -> float:
        here = context[depth - d :]
        if (node, here) not in counts:
            return 0.5
        n = counts[node, here]
        own = (n[value] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        share = math.exp(brute.log_kt(*n) - math.log(2) - weighted(node, here))
        return share * own + (1 - share) * chance(node, context, value, d + 1)

    return [sum(math.log2(chance(node, context, value)) for context, node, value in steps(b)) for b in texts]


@pytest.mark.parametrize("depth", [3, queries_lm.DEPTH, 7])
def test_deep_trees(spark, depth):
    rng = random.Random(3)
    words = ["the cat sat", "the cat ran", "a dog sat", "the dog ran, the cat sat", "", "zzz\x01", "é", "the cart sat on the mat", "\x00\x00a"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(90, None), (91, "ÿ¿ unseen QQQ"), (91, "the cat sat")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.score) for r in lm_score.lm_scores(df, depth=depth).collect())
    bits = tree_scores([(t or "").encode() for i, t in texts if not brute.held_out(i)], [(t or "").encode() for _, t in texts], depth)
    want = sorted((i, b * math.log10(2)) for (i, _), b in zip(texts, bits, strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-4)


def test_deep_trees_of_edge_rows(edge, none):
    df, rows = edge
    assert lm_score.lm_scores(none, depth=5).count() == 0
    got = lm_score.lm_scores(df, depth=5).collect()
    bits = tree_scores([(t or "").encode() for i, t in rows if not brute.held_out(i)], [(t or "").encode() for _, t in rows], 5)
    assert sorted(r.score for r in got) == pytest.approx(sorted(b * math.log10(2) for b in bits), rel=1e-5, abs=1e-4)


def test_query_learns_from_more_than_two_bytes(spark, tmp_path):
    """The byte after 'b' or 'd' is told by the one three before it only."""
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(["axyb", "cxyd"]) for _ in range(50))) for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [r.bits_per_byte for r in queries_lm.op7_lm_score(spark, str(tmp_path)).collect()]
    assert max(found) < 0.4


def test_codes_take_few_passes():
    """Code by code against the definition; beside the codes no array of their size is made more than twice."""
    rng = random.Random(11)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 3, 1, 0, 7, 40, 2, 0)]
    at = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for depth in range(2, 8):
        want = [int.from_bytes((bytes(depth) + x[:k])[-depth:][::-1] + x[k : k + 1]) for x in texts for k in range(len(x))]
        assert context_nodes.codes(buf, at, depth).tolist() == want
        assert context_nodes.codes(buf[:0], at[:1], depth).tolist() == []
    buf = np.zeros(1 << 20, np.uint8)
    tracemalloc.start()
    context_nodes.codes(buf, np.array([0, len(buf)]), 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * len(buf)


def test_small_counts_come_from_a_table(monkeypatch):
    asked = []
    plain = lm_score._lgamma
    monkeypatch.setattr(lm_score, "_lgamma", lambda x: asked.append(x.size) or plain(x))
    a, b = np.array([[0, 1, 5, 16383], [40, 0, 2, 0]]), np.array([[0, 0, 7, 0], [16000, 3, 2, 9]])
    got = lm_score._log_kt(a.astype(float), b.astype(float))
    assert sum(asked) == 0
    assert got.ravel().tolist() == pytest.approx([brute.log_kt(x, y) for x, y in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True)], abs=1e-8)
    a, b = np.array([16384.0, 3.0, 9e6]), np.array([1.0, 16384.0, 5e5])
    assert lm_score._log_kt(a, b).tolist() == pytest.approx([brute.log_kt(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert sum(asked) == 7


@pytest.mark.parametrize("spread", [None, 0])
def test_alike(monkeypatch, spread):
    """Any order of all places; scores are the same where all hashes begin alike."""
    if spread is not None:
        monkeypatch.setattr(context_nodes, "_SPREAD", np.uint64(spread))
    values = np.array([7, 3, 7, 1 << 55, 3, 3, 0], np.uint64)
    order = context_nodes._alike(values)
    assert sorted(order.tolist()) == list(range(7))
    assert len(context_nodes._edges(values[order])) == (4 if spread is None else 6)
    assert context_nodes._alike(values[:0]).tolist() == []
    buf = np.frombuffer(b"abcabcabxabc", np.uint8)
    at = np.array([0, 5, 5, 12])
    found = context_nodes.Answers([], [], [], 3)
    code = context_nodes.codes(buf, at, 3)
    found.keys, found.values = np.unique(code), np.arange(len(np.unique(code)), dtype=float)
    each = found.values[np.searchsorted(found.keys, code)]
    assert found.scores(buf, at).tolist() == [each[:5].sum(), 0.0, each[5:].sum()]
