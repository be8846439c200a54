import numpy as np
import pytest

from tidelog.llm import mixture

DOC = "doc_id long, text string, source string, tokens long, p double, dup string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 0.5, "x") for i, t, s in rows], DOC)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 1000])
def test_flight_keeps_both_totals(n):
    rng = np.random.default_rng(n)
    p, size = rng.random(n), rng.integers(1, 400, n)
    out = mixture.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.min(initial=0) >= 0 and out.max(initial=1) <= 1
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    assert set(mixture.land(out, size)) <= {0.0, 1.0}


def test_flight_keeps_the_probabilities():
    p, size = np.array([0.2, 0.7, 0.5, 0.4, 0.2]), np.array([10, 3, 7, 7, 1])
    mean = np.mean([mixture.flight(p, size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_equal_sizes():
    out = mixture.flight(np.full(10, 0.5), np.full(10, 8), np.random.default_rng(1))
    assert abs(out.sum() - 5) < 1e-9


def test_shares_and_caps(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "word " * int(rng.integers(1, 60)), s) for i, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["few"] * 40 + ["other"] * 50)]
    rows += [(9001, None, "mid"), (9002, "", "mid"), (9003, "text", None)]
    t = targets(spark, [("big", 0.5, 1), ("mid", 0.3, 4), ("few", 0.1, 2), ("absent", 0.1, 5), (None, 0.5, 1)])
    copies, report = mixture.mixture(docs(spark, rows), t, block=256)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "mid", "few", "absent"}
    assert r["few"].short and r["absent"].short and not r["big"].short and not r["mid"].short
    assert r["few"].used_tokens == 2 * r["few"].tokens and r["absent"].used_tokens == 0
    for s in ("big", "mid"):
        assert abs(r[s].used_tokens - r[s].wanted) <= 120  # two documents at most
        assert abs(r[s].used_documents - r[s].factor * r[s].documents) <= 2
        assert r[s].most_copies <= r[s].max_repeats
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-9
    c = copies.collect()
    assert len(c) == 3442 and len({x.doc_id for x in c}) == 3442  # 9001 and 9002 too
    assert sum(x.copies * x.tokens for x in c) == sum(x.used_tokens for x in r.values())
    assert mixture.faults(copies, report).count() == 0
    worse = copies.withColumn("copies", mixture.F.col("copies") + (mixture.F.col("source") == "mid").cast("int") * 9)
    assert {(x.source, x.fault) for x in mixture.faults(worse, report).collect()} == {("mid", "cap"), ("mid", "total")}
    again, _ = mixture.mixture(docs(spark, rows[::-1]).repartition(7), t, block=256)
    key = lambda x: (x.doc_id, x.source, x.tokens, x.copies)
    assert sorted(map(key, again.collect())) == sorted(map(key, c))  # whatever the partitioning
    whole = mixture.materialize(docs(spark, rows).select("doc_id", "text"), copies)
    assert whole.count() == sum(x.copies for x in c)


def test_found_against_brute_force(spark, sf):
    from tidelog.llm import queries, tokenize

    e = tokenize.Encoder(tokenize.rank_file())
    t = {r.source: r for r in spark.read.parquet(f"{sf}/mix_target.parquet").collect()}
    have = dict.fromkeys(t, 0)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.source in have and r.text:
            have[r.source] += len(e.bpe.encode_ordinary(r.text))
    total = sum(have.values())
    want = sorted(s for s in t if t[s].max_repeats * have[s] < t[s].weight * total)
    assert sorted(r.source for r in queries.p8_found(spark, sf).collect()) == want


def test_odd_target_rows(spark):
    rows = [(i, "some text", "a") for i in range(10)] + [(99, "some text", "b")]
    copies, report = mixture.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 1), ("a", 0.5, 1), ("a", 0.2, 9), ("b", None, None)]))
    assert sorted((r.source, r.weight, r.max_repeats, r.short) for r in report.collect()) == [("a", 0.5, 1, False), ("b", 0.0, 0, False)]
    assert copies.count() == 11 and {r.copies for r in copies.where("source = 'b'").collect()} == {0}


def test_empty(spark):
    t = targets(spark, [("a", 1.0, 1)])
    copies, report = mixture.mixture(docs(spark, []), t)
    assert copies.count() == 0 and [(r.source, r.tokens, r.share) for r in report.collect()] == [("a", 0, 0.0)]
    copies, report = mixture.mixture(docs(spark, [(1, "x", "a")]), targets(spark, []))
    assert copies.count() == 0 and report.count() == 0


def test_a_size_that_all_sources_can_reach(spark):
    rows = [(i, "word " * (i % 7 + 1), s) for i, s in enumerate(["a"] * 900 + ["b"] * 60)]
    t = targets(spark, [("a", 0.6, 1), ("b", 0.4, 2)])
    _, report = mixture.mixture(docs(spark, rows), t)
    assert {r.source for r in report.where("short").collect()} == {"b"}
    most = mixture.largest_exact(report).first()[0]
    _, report = mixture.mixture(docs(spark, rows), t, size=most)
    r = {x.source: x for x in report.collect()}
    assert not r["a"].short and not r["b"].short
    assert abs(r["a"].share - 0.6) < 0.02 and abs(r["b"].share - 0.4) < 0.02


def test_equal_rows_are_units_of_their_own(spark):
    rows = [(7, "some text", "a")] * 500 + [(None, "some text", "a")] * 20
    copies, report = mixture.mixture(docs(spark, rows), targets(spark, [("a", 0.5, 1)]), size=520 * 2)
    assert copies.count() == 520 and abs(report.first().used_documents - 260) <= 2
