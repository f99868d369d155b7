"""Each stage of the corpus pipeline on its own input, against brute force."""

from __future__ import annotations

import hashlib
import os
import re

import brute
import pytest

import corpus_pipeline as C
from tidegauge.llm import sentencepiece_lattice as sp
from tidegauge.llm.quality import apply_policy, quality_ledger

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out[name] = docs.collect(), got.collect(), got.columns
        docs = got
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(columns == want for name, (_, _, columns) in stages.items() if name != "sentencepiece")


def test_rules(spark, stages):
    before, after, _ = stages["quality_rules"]
    kept = {r.doc_id for r in apply_policy(quality_ledger(spark.createDataFrame(before))).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and len(kept) < len(before)
    assert set(after) <= set(before)


def test_near_duplicates(stages):
    before, after, _ = stages["near_dedup"]
    want = {i for i, _, _, kept in brute.components([(r.doc_id, r.text) for r in before], 5, 80) if kept}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)


def test_substrings(stages):
    before, after, _ = stages["substring_dedup"]
    want = {i: (n, gone, digest) for i, n, gone, digest in brute.repeated_words([(r.doc_id, r.text) for r in before], 50)}
    old = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        _, gone, digest = want[r.doc_id]
        assert hashlib.sha256(r.text.encode()).hexdigest() == digest if gone else r.text == old[r.doc_id]
        assert r.n_chars == len(r.text)


def test_decontamination(spark, stages):
    before, after, _ = stages["decontaminate"]
    windows: dict[tuple, set] = {}
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(brute.lower(item.text))
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(item.item_id)
    kept = {}
    for r in before:
        w = WORD.findall(brute.lower(r.text))
        items, hit = set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    items |= found
                    hit |= set(range(k, k + m))
        if len(items) < 2:
            kept[r.doc_id] = [x for k, x in enumerate(w) if k not in hit], bool(hit), r.text
    assert {r.doc_id for r in after} == set(kept)
    for r in after:
        words, changed, text = kept[r.doc_id]
        assert WORD.findall(brute.lower(r.text)) == words if changed else r.text == text


@pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model file")
def test_pieces(stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    before, after, _ = stages["sentencepiece"]
    text = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    assert all(list(r.ids) == lib.encode(text[r.doc_id]) and r.n_pieces == len(r.ids) for r in after)


def test_stages_of_empty_and_odd_tables(spark, edge, none):
    """Nulls, empties, very long texts, repeated ids and rows, stage by stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in edge[1]]
    docs = spark.createDataFrame(rows, schema)
    out = {}
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out[name] = stage(spark, docs, SF).collect()
    pairs = lambda found: sorted(((r.doc_id, r.text) for r in found), key=repr)
    kept = [r.kept for r in sorted(apply_policy(quality_ledger(docs.where("doc_id IS NULL OR doc_id <> 131"))).collect(), key=lambda r: repr((r.doc_id, r.n_words)))]
    assert sum(kept) == sum(1 for r in out["quality_rules"] if r.doc_id != 131)
    unique = list(dict.fromkeys(edge[1]))
    groups = {c for _, _, c, _ in brute.components([(k, t) for k, (_, t) in enumerate(unique)], 5, 80)}
    assert len(out["near_dedup"]) == len(groups)
    gone = brute.repeated_words(edge[1], 50)
    assert len(out["substring_dedup"]) == len(rows)
    texts = sorted(((i, hashlib.sha256(b" ".join(brute.SPACE.findall((t or "").encode()))).hexdigest()) for i, t in pairs(out["substring_dedup"])), key=repr)
    assert texts == sorted(((i, digest) for i, _, _, digest in gone), key=repr)
    assert pairs(out["decontaminate"]) == sorted(edge[1], key=repr)
    assert len(out["sentencepiece"]) == len(rows) and all(r.n_pieces == len(r.ids) for r in out["sentencepiece"])
    assert all((r.n_pieces == 0) == (not t) for r, (_, t) in zip(sorted(out["sentencepiece"], key=lambda r: repr((r.doc_id, r.n_pieces))), sorted(edge[1], key=lambda x: repr((x[0], 0 if not x[1] else 1))), strict=True) if r.doc_id not in (131, None))
