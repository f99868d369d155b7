"""Near-duplicates, repeated strings and repeated words against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from tidegauge.llm import components, near_dedup, substring_dedup, suffix_dedup


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(("words", "percent", "limit"), [(3, 85, 2_000_000), (5, 80, 300)])
def test_near_duplicates(edge, words, percent, limit):
    df, rows = edge
    got = near_dedup.near_duplicates(df, words=words, percent=percent, task_shingles=limit).collect()
    assert ordered(got) == ordered(brute.components(rows, words, percent))


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.without_near_duplicates(none).count() == 0


def chained(n=60):
    """Texts of which each shares most with the next, in three chains, one of them without ids, and texts alike to none."""
    rng = random.Random(11)
    word = [f"v{i}" for i in range(5000)]
    rows = []
    for chain in range(3):
        w = [rng.choice(word) for _ in range(150)]
        for k in range(n):
            if k % 3:
                w = list(w)
                w[rng.randrange(150)] = rng.choice(word)
            rows.append((None if chain == 2 else 1000 * chain + k, " ".join(w)))
    return rows + [(9000 + k, " ".join(rng.choice(word) for _ in range(100))) for k in range(40)]


@pytest.mark.parametrize("limit", [2_000_000, 700])
def test_near_duplicates_of_chains(spark, limit):
    rows = chained()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df, words=3, percent=85, task_shingles=limit).collect()
    assert ordered(got) == ordered(brute.components(rows, 3, 85))


def test_one_row_of_each_group_stays(edge, spark):
    df, rows = edge
    kept = [(r.doc_id, r.text) for r in near_dedup.without_near_duplicates(df).collect()]
    unique = list(dict.fromkeys(rows))
    named = [(k, t) for k, (_, t) in enumerate(unique)]
    groups = {c for _, _, c, _ in brute.components(named, 5, 80)}
    assert len(kept) == len(groups) and set(kept) <= set(unique)
    of = {unique[i]: c for i, _, c, _ in brute.components(named, 5, 80)}
    assert {of[r] for r in kept} == groups
    # rows that share an id are judged by their own texts
    two = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g")]
    left = near_dedup.without_near_duplicates(spark.createDataFrame(two, "doc_id long, text string")).collect()
    assert ordered(left) == ordered(two[:2])


def test_recall_on_planted_pairs(spark):
    """Pairs of a similarity of exactly 0.85 (68 of 80 shingles), each of its own words; one in 14,000 may be missed."""
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        w = [f"k{k}x{i}" for i in range(76)]
        v = list(w)
        for j in rng.sample(range(6, 66, 6), 2):
            v[j + rng.randrange(3)] = f"z{k}y{j}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert brute.components(rows[:2], 3, 85)[1][2] == 0
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert got.where("component_id <> doc_id").count() >= 1499


def test_set_join_connects_what_all_pairs_connect():
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.sample(range(500), rng.randint(1, 50)) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 30)):
            b = list(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                b[rng.randrange(len(b))] = rng.randrange(500)
            sets.append(np.unique(np.array(b, np.uint64)))
        percent = rng.choice([50, 80, 100])
        plain = [set(x.tolist()) for x in sets]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j])]
        assert partition(len(sets), near_dedup.join_sets(sets, percent)) == partition(len(sets), want)


def partition(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    names = {}
    return [names.setdefault(find(i), len(names)) for i in range(n)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(components.connected_components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


@pytest.mark.parametrize(("length", "limit"), [(400, 1 << 15), (120, 1 << 15), (40, 2)])
def test_repeated_strings(edge, length, limit):
    df, rows = edge
    got = suffix_dedup.repeated_strings_report(df, length=length, group_limit=limit).collect()
    assert ordered(got) == ordered(brute.repeated_strings(rows, length))


def test_repeated_strings_of_nothing(none):
    assert suffix_dedup.repeated_strings_report(none).count() == 0
    assert suffix_dedup.without_repeated_strings(none).count() == 0


def test_maximal_repeats_list_all_occurrences():
    left, right = [b"cba", b"cbz", b"cya", b"q"], [b"xyz1", b"xyz2", b"xyz1", b"xyw"]
    found = {(v, r, tuple(sorted(m))) for v, r, m in suffix_dedup.maximal_repeats(left, right, 4)}
    assert found == {(1, 4, (0, 2)), (1, 3, (0, 1, 2)), (2, 3, (0, 1))}


def test_reach_is_that_of_all_pairs():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(2, 12)
        part = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6)))
        both = list({(part(), part()) for _ in range(n)})
        left, right = [x for x, _ in both], [y for _, y in both]
        want: dict = {}
        for i in range(len(both)):
            for j in range(len(both)):
                v, r = suffix_dedup.common_prefix(left[i], left[j]), suffix_dedup.common_prefix(right[i], right[j])
                if i != j and v + r >= 3:
                    x, y = want.get(i, (0, 0))
                    want[i] = max(x, v), max(y, r)
        assert suffix_dedup.reach(left, right, 3) == want


def test_groups_list_all_occurrences_of_repeats(spark):
    a, b = "".join(chr(97 + k % 23) for k in range(0, 300, 7)), "0123456789" * 3
    rows = [(1, f"x{a}y"), (2, f"z{a}w{b}"), (3, a[:40]), (4, b + "q"), (5, None), (6, "")]
    found = suffix_dedup.maximal_repeat_groups(spark.createDataFrame(rows, "doc_id long, text string"), length=30, gram=16)
    groups: dict = {}
    for r in found.collect():
        groups.setdefault((r.repeat, r.n_bytes), set()).add((r.doc_id, r.start))
    raw = {i: (t or "").encode() for i, t in rows}
    text = {raw[i][s : s + n]: who for (_, n), who in groups.items() for i, s in who}
    every = lambda x: {(i, k) for i, t in raw.items() for k in range(len(t) - len(x) + 1) if t[k : k + len(x)] == x}
    assert text and all(who == every(x) for x, who in text.items())
    assert b.encode() in text and any(a[:40].encode() in x for x in text)
    covered = {(i, p) for (_, n), who in groups.items() for i, s in who for p in range(s, s + n)}
    for k, (i, n, gone, _, _) in enumerate(brute.repeated_strings(rows, 30)):
        assert sum(1 for j, _ in covered if j == i) == gone


@pytest.mark.parametrize("window", [35, 50, 4])
def test_repeated_words(edge, window):
    df, rows = edge
    got = substring_dedup.repeats_report(df, window=window).collect()
    assert ordered(got) == ordered(brute.repeated_words(rows, window))


def test_repeated_words_carry_columns(edge, none):
    df, _ = edge
    got = substring_dedup.remove_repeats(df, window=50, carry=("row", "at")).select("row.*").distinct().collect()
    assert [tuple(r) for r in got] == [("r", 3)]
    assert substring_dedup.repeats_report(none, window=35).count() == 0


@pytest.mark.parametrize("batches", [1, 2, 9])
def test_batches_give_the_rows_of_one(edge, batches):
    df, rows = edge
    got = substring_dedup.repeats_report(df, window=20, batches=batches, fanout=2)
    assert ordered(got.collect()) == ordered(brute.repeated_words(rows, 20))


def test_index_finds_what_earlier_batches_hold_and_compacts(spark):
    from tidegauge.llm._places import keyed

    rng = random.Random(1)
    texts = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    index = substring_dedup.FingerprintIndex(spark, window=50)
    rows = [[(0, texts[0]), (1, texts[1])], [(2, texts[1]), (3, texts[2])], [(4, texts[3])], [(5, texts[0] + " x"), (6, texts[4])], [(7, texts[2]), (8, texts[1])]]
    held, found = [], []
    for batch in rows:
        held += batch
        new = index.add(keyed(spark.createDataFrame(batch, "doc_id long, text string"), "doc_id", "text"))
        texts_so_far = keyed(spark.createDataFrame(held, "doc_id long, text string"), "doc_id", "text")
        found.append({(r.doc_id, r.at, r.stop) for r in index.verified(new, texts_so_far).collect()})
    # what a batch repeats comes with the earlier text it is of, once
    assert [{i for i, _, _ in x} for x in found[:4]] == [set(), {1, 2}, set(), {0, 5}]
    assert {i for i, _, _ in found[4]} >= {3, 7, 8}
    assert [r.level for r in index.runs] == [1, 0]
    cover = {i: (min(a for j, a, _ in f if j == i), max(b for j, _, b in f if j == i)) for f in found[:4] for i, _, _ in f}
    assert cover == {1: (0, 60), 2: (0, 60), 0: (0, 60), 5: (0, 60)}
