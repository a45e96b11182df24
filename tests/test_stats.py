"""Statistics against brute force."""

import math
import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import sampling as SA
from scriptorium.operators import stats as S


def long(spark, a, b):
    rows = [("m", "2015", float(x)) for x in a] + [("m", "2025", float(x)) for x in b]
    return spark.createDataFrame(rows, "metric string, year_group string, value double")


def test_mann_whitney_pairwise(spark):
    rnd = random.Random(3)
    a, b = [rnd.choice([-5.5, -2, -1e-9, 0, 0.25, 1, 3, 1e6]) for _ in range(60)], [rnd.choice([-5.5, -3, 0, 0.5, 1, 2, 1e6]) for _ in range(45)]
    r = S.mann_whitney(long(spark, a, b)).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == u and (r.n1, r.n2) == (60, 45) and r.rank_biserial == pytest.approx(1 - 2 * u / (60 * 45))
    t = S.mann_whitney(long(spark, [1, 2, 2], [2, 5, 0])).first()
    assert (t.u, t.ties) == (4.0, 24.0)


def test_exact_rank_test():
    a, b = [1.0, 4.0, 6.0], [2.0, 7.0, 8.0, 9.0]
    u = sum(x > y for x in a for y in b)
    every = a + b
    us = [sum(x > y for x in (every[i] for i in c) for y in (every[j] for j in range(7) if j not in c)) for c in combinations(range(7), 3)]
    want = min(1.0, 2 * sum(x <= min(u, 12 - u) for x in us) / len(us))
    assert S.mann_whitney_exact(u, 3, 4) == pytest.approx(want)


def test_tails():
    assert S.student_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert S.chi2_one(3.841458820694124) == pytest.approx(0.05)
    assert S.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert S.fisher_two_sided(0, 5, 0, 5) == 1.0
    assert S.normal_two_sided(30) > 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 12))
def test_fisher_is_a_probability(a, b, c, d):
    assert 0 <= S.fisher_two_sided(a, b, c, d) <= 1


def test_marker_ratios(spark):
    from scriptorium.plans import analytics as A

    rows = [(f"p{i}", g, m, "t", 0.0, int(h)) for m, bits in (("both", "1010"), ("gone", "1000"), ("new", "0011"), ("none", "0000")) for i, (g, h) in enumerate(zip(("2015", "2015", "2025", "2025"), bits))]
    d = spark.createDataFrame(rows, "arxiv_id string, year_group string, marker string, tier string, per1k double, has int")
    # a share of 0 counts as 0.01 in the first cohort alone
    assert {r.marker: r.ratio for r in A.prevalence(d).collect()} == {"both": 1.0, "gone": 0.0, "new": 10000.0, "none": 0.0}
    t = {r.marker: r for r in S.marker_tests(d).collect()}
    assert t["new"].odds_ratio == 0.0 and t["none"].odds_ratio is None and t["gone"].odds_ratio == math.inf and t["both"].odds_ratio == 1.0


def test_corrections(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (None,)], "p double")
    r = {x.p: x for x in S.benjamini_hochberg(S.bonferroni(p)).collect()}
    assert [round(r[x].bh, 6) for x in (0.01, 0.04, 0.03, 0.5)] == [0.04, 0.053333, 0.053333, 0.5]
    assert r[0.5].bonferroni == 1.0 and r[0.01].significant and r[None].bh is None


def test_compare_and_edges(spark):
    r = S.compare(long(spark, [1, 2, 3, 4], [2, 4, 6, 8])).first()
    d = (2.5 - 5.0) / math.sqrt((3 * 5 / 3 + 3 * 20 / 3) / 6)
    assert r.cohens_d == pytest.approx(d) and 0 < r.welch_p < 1 and 0 < r.mw_p <= 1
    same = S.compare(long(spark, [1, 1], [1, 1])).first()
    assert same.cohens_d is None and same.t is None and same.mw_p == 1.0
    assert S.compare(long(spark, [], [])).count() == 0
    one_sided = S.compare(long(spark, [1, 2], [])).first()
    assert one_sided.n2 == 0 and one_sided.mw_p is None


def test_strata_ties_and_balance(spark):
    rows = [(i, "2015" if i % 2 else "2025", v) for i, v in enumerate([5] * 40 + list(range(60)))]
    m = spark.createDataFrame(rows, "corpus_id long, year_group string, n_words long")
    s = SA.strata(m, 10)
    assert s.groupBy("n_words").agg(F.count_distinct("word_stratum").alias("k")).filter("k > 1").count() == 0
    b = SA.balanced_sample(s, 20)
    c = {(r.word_stratum, r.year_group): r["count"] for r in b.groupBy("word_stratum", "year_group").count().collect()}
    assert all(c[k, "2015"] == c[k, "2025"] for k, _ in c) and sum(c.values()) == 40
    assert b.select("corpus_id").distinct().count() == 40
    assert SA.allocate({0: 5, 1: 3, 2: 2}, 4) == {0: 2, 1: 1, 2: 1}
    with pytest.raises(ValueError):
        SA.allocate({0: 0}, 3)


def test_random_ranks_are_a_permutation(spark):
    m = spark.range(500).select(F.col("id").alias("corpus_id"), F.when(F.col("id") < 400, "a").alias("year_group"))
    r = SA.random_ranks(m, ["year_group"], "corpus_id", 1).groupBy("year_group").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert sorted(len(x.r) for x in r) == [100, 400] and all(list(x.r) == list(range(1, len(x.r) + 1)) for x in r)


def test_boxes_density_fit(spark):
    d = spark.createDataFrame([("2015", float(x)) for x in [1, 2, 3, 4, 100]], "year_group string, v double")
    b = S.boxes(d, "v", ["year_group"]).first()
    assert (b.q1, b.q2, b.q3, b.low, b.high) == (2, 3, 4, 1, 4)
    k = S.density(d, "v", high=120.0).agg(F.sum("density")).first()[0]
    assert 0.5 < k < 1.05
    xy = spark.createDataFrame([("2015", float(x), 2.0 * x + 1) for x in range(10)], "year_group string, x double, y double")
    f = S.linear_fit(xy, "x", "y", quantile=1.0).first()
    assert f.slope == pytest.approx(2) and f.intercept == pytest.approx(1)
