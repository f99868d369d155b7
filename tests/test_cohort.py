from __future__ import annotations

from tidegauge.plans import registry

SF = "/root/testdata/sf0.001"


def test_effective_dimensions_of_all_components(spark):
    """Eight components can't have more than eight dimensions."""
    found = registry.queries()["effective_dimensions"](spark, SF).collect()
    assert found and max(r.dimensions for r in found) > 8


def test_near_copies_are_all_pairs_within_the_limit(spark):
    import math

    from tidegauge.operators import cohort

    v = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("label < 3").collect()]
    v += [(10_000 + i, g, [x + 0.01 for x in e]) for i, g, e in v[:20]]
    df = spark.createDataFrame(v, "vec_id long, label int, x array<double>")
    for limit in (0.1, 1.3):
        got = {(r.a, r.b) for r in cohort.near_copies(df, limit=limit).collect()}
        want = set()
        for g in range(3):
            rows = [(i, e) for i, k, e in v if k == g]
            mean = [sum(c) / len(rows) for c in zip(*[e for _, e in rows])]
            scale = math.sqrt(sum((x - m) ** 2 for _, e in rows for x, m in zip(e, mean)) / len(rows) / len(mean))
            want |= {(min(i, j), max(i, j)) for i, e in rows for j, f in rows if i < j and math.sqrt(sum((x - y) ** 2 for x, y in zip(e, f)) / len(e)) / scale <= limit}
        assert got == want and want


def test_pairs_beyond_the_cap_keep_the_nearest(spark):
    from tidegauge.operators import cohort

    pairs = spark.createDataFrame([(a, b, abs(a - b) / 10) for a in range(6) for b in range(a + 1, 6)], "a long, b long, nrmse double")
    assert cohort.listed_pairs(pairs).count() == 15
    assert {(r.a, r.b) for r in cohort.listed_pairs(pairs, most=3, partners=1).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}


def test_near_copies_over_many_blocks_and_their_nearest_partners(spark, monkeypatch):
    """Blocks of a few rows: nothing is lost between them, ties of equal vectors go by id, and no join multiplies rows by cells."""
    from tidegauge.operators import blocks, cohort

    v = [(r.vec_id, r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("label < 2").collect()]
    v += [(20_000 + i, 0, v[0][2]) for i in range(30)]
    df = spark.createDataFrame(v, "vec_id long, label int, x array<double>")
    for limit in (0.1, 1.3):
        whole = {(r.a, r.b): r.nrmse for r in cohort.near_copies(df, limit=limit).collect()}
        first = {(r.id, r.place): (r.partner, r.nrmse) for r in cohort.nearest_partners(cohort.near_copies(df, limit=limit)).collect()}
        with monkeypatch.context() as m:
            m.setattr(blocks, "ROWS", 16)
            m.setattr(blocks.dealt, "__defaults__", (16,))
            parts = cohort.near_copies(df, limit=limit)
            assert "zip_with" not in parts._jdf.queryExecution().toString()
            assert {(r.a, r.b): r.nrmse for r in parts.collect()} == whole and len(whole) >= 435
            few = cohort.near_copies(df, limit=limit, most=5)
            assert few.count() < len(whole)
            assert {(r.id, r.place): (r.partner, r.nrmse) for r in cohort.nearest_partners(few).collect()} == first


def test_pairs_of_like_length_are_compared_in_blocks(spark, monkeypatch):
    from tidegauge.operators import blocks, cohort

    n = [(i % 2, i, f"k{k}", (i * 7 + k * 13) % 11 + 1) for i in range(60) for k in range(4) if (i + k) % 3]
    rows = spark.createDataFrame(n, "g long, id long, kind string, n long")
    u = rows.select("g", "id").distinct()
    pairs = u.withColumnRenamed("id", "a").join(u.withColumnRenamed("id", "b"), "g").where("a < b").select("a", "b")
    want = {(r.a, r.b, r.mismatch) for r in cohort.of_like_length(pairs, rows, "id", "kind", "n", 0.34).collect()}
    monkeypatch.setattr(blocks.dealt, "__defaults__", (8,))
    found = blocks.like_pairs(rows, "g", "id", "kind", "n", 0.34).collect()
    assert {(r.a, r.b, r.mismatch) for r in found} == want and len(found) == len(want) > 0
