"""Quality rules, decontamination, URLs, language model, pieces, quotations, classifier."""

from __future__ import annotations

import math
import os

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import connect, same
from tidegauge.llm import bayes_quality, decontaminate, lm_score, quality, quotations, registry, urls
from tidegauge.llm import sentencepiece_lattice as sp

SF = "/root/testdata/sf0.001"
MODEL = os.path.exists(sp.MODEL)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


# -- rules


def test_rules_of_edge_rows(edge, none):
    df, rows = edge
    got = quality.apply_policy(quality.quality_ledger(df, carry=("row",))).collect()
    assert len(got) == len(rows)
    assert all(r.base_failed for r in got if r.n_words < 10)
    assert quality.quality_ledger(none).count() == 0


def test_policies_are_bits(spark):
    text = "word " * 5 + "$$$$$$$$$ " * 6
    ledger = quality.quality_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = ledger.first()
    assert row.failed_bits & quality.BIT["symbol_heavy"]
    only = quality.Policy("t", ("long_words",))
    assert quality.apply_policy(ledger, only, only).first().kept
    a = {r.rule: (r.n_failed, r.n_failed_alone) for r in quality.ablation(ledger).collect()}
    assert a["symbol_heavy"][0] == 1 and a["long_words"] == (0, 0)


# -- decontamination


def test_leaks_of_edge_cases(spark, edge, none):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "a b c d e f g h i j"), (3, None), (4, "..."), (5, "alpha beta gamma"), (None, "z9 z8")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA-beta, gamma! a b c d e f g h x z9 z8"), (1, "alpha beta"), (None, None), (2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination_report(docs, items).collect()}
    assert got == {(1, 15): (13, 4, True), (1, 2): (0, 0, False), (None, 0): (0, 0, False), (2, 0): (0, 0, False)}
    assert decontaminate.contamination_report(none, items).count() == 0
    assert decontaminate.contamination_report(docs, items.limit(0)).agg(F.sum("n_items")).first()[0] == 0
    text = {r.text for r in decontaminate.without_leaks(docs, items, most=9, carry=("doc_id",)).where("doc_id = 1").collect()}
    assert text == {"x  x ", "alpha beta"}


def test_more_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontaminate.contamination_report(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert sorted(whole) == sorted(decontaminate.contamination_report(docs, items).collect())


# -- URLs


def test_urls(spark):
    cases = {
        "http://a.example.com/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://WWW.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "ftp://spam-farm.example.com": ("spam-farm.example.com", "", None, "block"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://xnet/es/": ("xnet", "/es/", None, "allow"),
        "": ("", "", None, "allow"),
        "http://example.com/en": ("example.com", "/en", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(cases)], "page_id long, url string, keys string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1 << 18, 60])
def test_cascade_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(urls, "SHARD_KEYS", shard)
    monkeypatch.setattr(urls, "SLOTS", 3)  # a filter that errs often, so that there are many levels
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("CAST(substring(key, 2) AS INT) % 27 = 0")
    found = urls.build_cascades(listed, keys)
    assert max(len(c.levels) for c in found) > 1
    rows = urls.listed_keys(keys.withColumn("a", F.array("key")), "a", "hit", found)
    assert {r.key for r in rows.where("size(hit) > 0").collect()} == {r.key for r in listed.collect()}


# -- language model


def test_scores(spark, edge, none):
    df, rows = edge
    got = lm_score.lm_scores(df).collect()
    want = brute.base_scores(rows)
    assert sorted(tuple(r)[1:5] for r in got) == sorted(w[1:5] for w in want)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(w[5] for w in want), rel=1e-9)
    assert lm_score.lm_scores(none).count() == 0


def test_context_trees(spark):
    texts = [(i, t) for i, t in enumerate(["the cat sat", "the cat ran", "a dog sat", "the dog ran, the cat sat", "", "zzz\x01", "é"] * 3)]
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    bits = brute.tree_scores([t.encode() for i, t in texts if not brute.held_out(i)], [t.encode() for _, t in texts])
    assert [got[i] for i, _ in texts] == pytest.approx([b * math.log10(2) for b in bits], abs=1e-4)


# -- pieces


@pytest.mark.skipif(not MODEL, reason="no model file")
def test_pieces_are_the_library_s(spark, edge):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = [t for _, t in edge[1]] + ["   ", " a  b ", "\n\n\tx", "▁", "日本語", "😀 hi", "ab" * 300, "the" * 90, "\x00"]
    ids, at = sp.encode_texts(pa.array(texts))
    for k, t in enumerate(texts):
        mine = ids[at[k] : at[k + 1]].tolist()
        assert mine == lib.encode(t or "")
        assert sp.decode_ids(mine) == (t or "").replace("▁", " ")


@pytest.mark.skipif(not MODEL, reason="no model file")
def test_lattice_on_dataframes_is_the_library_s(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    words = ["▁the", "▁there", "▁ontion", "▁Haanth.", "é", "▁日本", "▁▁▁x", "\x07"]
    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string"), sp.load_pieces()).collect()}
    for w in words:
        want = lib.encode(w.replace("▁", " ").removeprefix(" "))
        assert got[w] == want or not w.startswith("▁"), w


def test_viterbi_takes_the_best_path(spark):
    p = sp.Pieces(("<unk>", "a", "b", "ab", "abc", "c", "bc"), (0.0, -1.0, -1.0, -1.5, -9.0, -1.0, -1.2), (2, 1, 1, 1, 1, 1, 1), False, True, False)
    got = {r.word: r.ids for r in sp.encode_words(spark.createDataFrame([("abc",), ("axb",), ("ab",)], "word string"), p).collect()}
    assert got == {"abc": [1, 6], "axb": [1, 0, 2], "ab": [3]}


@pytest.mark.skipif(not MODEL, reason="no model file")
def test_encoding_of_rows(spark, edge, none):
    df, rows = edge
    enc = sp.encode(df)
    assert enc.count() == len(rows) and sp.encode(none).count() == 0
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in sp.decode(enc).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t in rows)


# -- quotations


def test_parse_levels():
    body, quoted = quotations.parse("Hi\n\nOn Monday, A wrote:\n> one\n> two\n>> deep\n> three\n\nmine\n\n\nend")
    assert body == "Hi\n\nmine\n\nend"
    assert quoted == [(1, "one\ntwo"), (2, "deep"), (1, "three")]


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "How  are you?"),
        (1, 1, "assistant", "Fine.\n\nAnd the weather is good."),
        (1, 2, "user", "Other topic"),
        (1, 3, "assistant", "> and the WEATHER is good.\nIndeed"),
        (1, 4, "user", "> > and the weather is good.\n> Indeed\nyes"),
        (2, 0, None, "> How are you?\nquoting another"),
        (2, 1, "user", None),
        (2, 1, "user", "> nobody said this\nx"),
        (None, 0, "user", "> Fine.\nlost"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "conv_id long, turn long, role string, text string, h string")
    got = quotations.link_quotations(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn, r.body): r for r in got}
    assert (by[1, 3, "Indeed"].reply_conv, by[1, 3, "Indeed"].reply_turn, by[1, 3, "Indeed"].root_turn, by[1, 3, "Indeed"].depth) == (1, 1, 1, 1)
    assert (by[1, 4, "yes"].reply_turn, by[1, 4, "yes"].root_turn, by[1, 4, "yes"].depth, by[1, 4, "yes"].n_linked) == (3, 1, 2, 2)
    assert (by[2, 0, "quoting another"].reply_conv, by[2, 0, "quoting another"].reply_turn, by[2, 0, "quoting another"].depth) == (1, 0, 0)
    assert by[2, 1, "x"].n_linked == 0 and by[None, 0, "lost"].n_linked == 0
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 3, 4, 2]
    assert quotations.link_quotations(df.limit(0)).count() == 0


# -- classifier


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = bayes_quality.hierarchical_quality(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    r = {x.good: x.kept for x in got.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy((F.expr("quality = 1 AND toxic = 0")).alias("good")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[True] > 0.95 and r[False] < 0.25


def test_classifier_of_edge_rows(spark, edge, none):
    df, rows = edge
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = bayes_quality.hierarchical_quality(df, known, F.col("row"), F.lit(None).cast("string")).collect()
        assert len(got) == len(rows) and all(0 < r.posterior < 1 for r in got)
    assert bayes_quality.hierarchical_quality(none, labels, F.col("row"), F.col("row")).count() == 0


def test_sparse_sites_are_near_their_parents(spark):
    import pyspark.sql.types as T

    rows = [(f"h{i % 6}", f"p{i}", 10.0, 9.0 if i % 6 < 3 else 2.0) for i in range(60)]
    g = spark.createDataFrame(rows, T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("s", T.DoubleType())]))
    mean, n = F.col("s") / F.col("n"), F.col("n")
    assert bayes_quality.strength(g, mean, n, F.lit(0.55)) < 10
    assert bayes_quality.strength(g.withColumn("s", F.lit(5.5)), mean, n, F.lit(0.55)) == bayes_quality.STRONGEST


def test_posteriors_are_those_of_a_plain_computation_and_sites_decide(spark):
    import random

    rng = random.Random(4)
    good, bad, any_ = ([f"{k}{i}" for i in range(40)] for k in "gbn")
    rows, labels = [], []
    for i in range(1500):
        site = i % 3
        fine = rng.random() < (0.95, 0.5, 0.05)[site]
        words = [rng.choice((good if fine else bad) if rng.random() < 0.3 else any_) for _ in range(30)]
        rows.append((i, " ".join(words), f"h{site}", "p" if i % 2 else None))
        if i < 900:
            labels.append((i, int(fine), 0))
    rows += [(5000 + k, "nothing known", f"h{k}", "p") for k in (0, 2)] + [(6000, None, None, None), (0, rows[0][1], "h0", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    got = bayes_quality.hierarchical_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("host"), F.col("path")).collect()
    assert len(got) == len(rows)
    # the same from p_doc alone: means left out of themselves, shrunk to their parents
    where = {}
    for i, _, h, p in rows:
        where.setdefault(i, []).append((h or "", p or ""))
    each = []
    for r in sorted(got, key=lambda r: r.doc_id):
        for key in where[r.doc_id]:
            each.append((*key, r.p_doc))
        where[r.doc_id] = []
    prior = (sum(x for *_, x in each) + 0.5) / (len(each) + 1)
    group = lambda f: {k: [x for h, p, x in each if f(h, p) == k] for k in {f(h, p) for h, p, _ in each}}
    hosts, paths = group(lambda h, p: h), group(lambda h, p: (h, p))

    def weight(groups, parent):
        free = sum(len(v) - 1 for v in groups.values())
        within = sum(sum(x * x for x in v) - sum(v) ** 2 / len(v) for v in groups.values()) / free
        found = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in groups.items())
        own = (found - within * len(groups)) / len(each)
        return min(bayes_quality.STRONGEST, within / own) if own > 0 else bayes_quality.STRONGEST

    kh = weight(hosts, lambda k: prior)
    kp = weight(paths, lambda k: (kh * prior + sum(hosts[k[0]])) / (kh + len(hosts[k[0]])))
    home = {i: (h or "", p or "") for i, _, h, p in rows if i not in (0,)}
    for r in got:
        if r.doc_id in home:
            h, p = home[r.doc_id]
            rest = (kh * prior + sum(hosts[h]) - r.p_doc) / (kh + len(hosts[h]) - 1)
            site = min(max((kp * rest + sum(paths[h, p]) - r.p_doc) / (kp + len(paths[h, p]) - 1), 1e-6), 1 - 1e-6)
            odds = math.log(r.p_doc / (1 - r.p_doc)) + math.log(site / (1 - site)) - math.log(prior / (1 - prior))
            assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
    by = {r.doc_id: r for r in got}
    assert by[5000].p_doc == pytest.approx(by[5002].p_doc) and by[5000].kept and not by[5002].kept


def plain_links(rows):
    """quotations.link_quotations, by looking at every message for every passage."""
    said, out = {}, {}
    for c, t, _, text in rows:
        if c is not None and t is not None:
            for x in quotations.pieces(quotations.parse(text)[0]):
                said.setdefault(x, set()).add((c, t))
    for c, t in {(c, t) for c, t, *_ in rows if c is not None and t is not None}:
        best, n = None, 0
        for text in [x for a, b, _, x in rows if (a, b) == (c, t)][:1]:
            for level, passage in quotations.parse(text)[1]:
                source = None
                for x in quotations.pieces(passage):
                    here = [(a, b) for a, b in said.get(x, ()) if a == c]
                    first = min(here) if here else None
                    other = min(((a, min(q for p, q in said[x] if p == a)) for a in {a for a, _ in said.get(x, ())} if a != c), default=None)
                    source = first if first and first[1] < t else other
                    if source:
                        break
                if source:
                    n += 1
                    if level == 1:
                        mark = (source[0] == c, source[1], source[0])
                        best = mark if best is None or mark > best else best
        out[c, t] = (n, best and best[2], best and best[1])
    roots = {}
    for c, t in out:
        at, depth = t, 0
        while out[c, at][1] == c:
            at, depth = out[c, at][2], depth + 1
        roots[c, t] = at, depth
    return {k: (*v, *roots[k]) for k, v in out.items()}


def test_quotations_of_the_tables_own_messages(spark):
    """Messages of the table, of which half quote earlier ones of their own or of other conversations, some at two levels, some twice the same."""
    import random

    rng = random.Random(9)
    raw = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").limit(150).collect()]
    mark = lambda text, by="> ": "\n".join(by + x for x in (text or "").split("\n"))
    rows, seen = [], set()
    for c, t, role, text in raw:
        if (c, t) in seen:
            continue
        seen.add((c, t))
        if rows and rng.random() < 0.6:
            quoted = rng.choice([r for r in rows if r[0] == c] or rows) if rng.random() < 0.7 else rng.choice(rows)
            body = quotations.parse(quoted[3])[0]
            text = f"{mark(body)}\n{mark(body.upper(), '>> ') if rng.random() < 0.2 else ''}\n{text}"
        rows.append((c, t, role, text))
    long = "word " * 60_000
    rows += [(10**6, 0, "user", long), (10**6, 1, "assistant", mark(long) + "\nyes"), (10**6, 2, "user", "yes"), (10**6, 3, "user", "> yes\nno"), (10**6 + 1, 0, None, ""), (10**6 + 1, 1, "user", ">\n> \n"), (None, 1, "user", "> yes")]
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = plain_links(rows)
    assert len(got) == len(rows)
    linked = 0
    for r in got:
        if r.conv_id is not None:
            assert (r.n_linked, r.reply_conv, r.reply_turn, r.root_turn, r.depth) == want[r.conv_id, r.turn], (r, want[r.conv_id, r.turn])
            assert ">" not in r.body or not r.n_quotes
            linked += r.n_linked
    assert linked > 20
