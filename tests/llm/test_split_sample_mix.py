"""Problems 2, 7 and 9."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import p2_split, p7_sample, p9_mix

LIMITS = "limit_id int, unit string, max_size int, overlap_size int"


def check(text, unit, most, overlap):
    p = p2_split.plan(text, unit, most, overlap)
    size = {"chars": len, "bytes": lambda s: len(s.encode()), "words": lambda s: len(s.split())}[unit]
    if size(text) <= most:
        assert p == []
        return p
    assert p[0][0] == 0 and p[-1][1] == len(text)
    rebuilt, at = "", 0
    for s, e, _ in p:
        assert s <= at < e and size(text[s:e]) <= most
        if at and unit == "chars":
            assert at - s == min(overlap, at)
        if at and unit == "words" and text[at - 1].isspace():
            assert size(text[s:at]) == min(overlap, size(text[:at]))
        if at and unit == "bytes":
            assert size(text[s:at]) <= overlap and (s == 0 or size(text[s - 1 : at]) > overlap)
        rebuilt += text[at:e]
        at = e
    assert rebuilt == text
    return p


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é😀.,;\n \t", max_size=300), st.sampled_from(["chars", "words", "bytes"]), st.integers(8, 60), st.integers(0, 3))
def test_pieces_keep_the_text(text, unit, most, overlap):
    check(text, unit, most, overlap)


def test_natural_boundaries():
    para = "One sentence here. Another one follows it. " * 5
    p = check(("\n\n".join([para.strip()] * 6)), "chars", 260, 0)
    assert all(k == "paragraph" for _, _, k in p)
    p = check(para * 8, "chars", 300, 40)
    assert all(k == "sentence" for _, _, k in p[:-1])
    assert check("x" * 1000, "bytes", 100, 20)
    check("wörd " * 40_000, "words", 450, 40)


def test_split_operator(spark):
    rows = [(1, "a" * 10, 7), (2, "a" * 11, 7), (2, "a" * 11, 7), (3, None, 7), (4, "", 7)]
    df = spark.createDataFrame(rows, "record_id long, related_work string, limit_id int")
    lim = spark.createDataFrame([(1, "chars", 10, 2), (2, "words", 1, 0), (3, "lines", 1, 0), (4, "chars", None, 0), (5, "chars", 5, 9)], LIMITS)
    out = p2_split.split_oversized(df, lim, "record_id", "related_work")
    assert {(r.limit_id, r.record_id) for r in out.collect()} == {(1, 2), (5, 1), (5, 2)}
    assert out.filter("limit_id = 1 and piece_no = 0").count() == 2
    assert p2_split.split_oversized(df.limit(0), lim, "record_id", "related_work").count() == 0
    assert p2_split.split_oversized(df, lim.limit(0), "record_id", "related_work").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_seats_are_the_smallest_priorities(cats, size):
    share, floor, have = [c[0] for c in cats], [c[1] for c in cats], [c[2] for c in cats]
    got = p7_sample.seats(size, share, floor, have)
    least = [min(h, f) for h, f in zip(have, floor)]
    rest = sorted(((r - 0.5) / s, i) for i, (s, h) in enumerate(zip(share, have)) if s > 0 for r in range(least[i] + 1, h + 1))
    want = sum(least) + min(len(rest), max(0, size - sum(least)))
    assert sum(got) == want and all(l <= g <= h for l, g, h in zip(least, got, have))
    taken = [(r - 0.5) / share[i] for i in range(len(cats)) if share[i] > 0 for r in range(least[i] + 1, got[i] + 1)]
    left = [(r - 0.5) / share[i] for i in range(len(cats)) if share[i] > 0 for r in range(got[i] + 1, have[i] + 1)]
    assert not taken or not left or max(taken) <= min(left) * (1 + 1e-9)


def test_sample_operator(spark):
    rows = [(i, f"15{i:02d}.1", "2015.0" if i % 2 else " 2015") for i in range(40)] + [(100 + i, f"cs_{i:07d}", "2025") for i in range(3)] + [(200, "cs/0000000", "2025"), (201, "x", None), (202, None, "2025"), (203, "y", "n/a")]
    df = spark.createDataFrame(rows, "corpus_id long, arxiv_id string, year_group string").withColumn("category", F.lit("clash"))
    t = spark.createDataFrame([(1, 20, "2015", 0.5, 1), (1, 20, "2025", 0.5, 1), (1, 20, "1990", 0.0, 2), (2, None, "2015", None, None)], "plan_id int, sample_size int, year_group string, target_share double, min_papers int")
    p = p7_sample.papers(df)
    plan = p7_sample.allot(p7_sample.category_counts(p), t)
    r = {(x.plan_id, x.year_group): x for x in plan.collect()}
    assert r[1, "2025"].n_papers == 3 and r[1, "2025"].falls_short and r[1, "1990"].falls_short and not r[1, "2015"].falls_short
    s = p7_sample.draw(p, plan)
    assert {x.year_group: x["count"] for x in s.groupBy("year_group").count().collect()} == {"2015": 17, "2025": 3}
    assert s.select("plan_id", "paper").distinct().count() == s.count()
    assert p7_sample.report(s, plan).count() == 4
    assert p7_sample.allot(p7_sample.category_counts(p7_sample.papers(df.limit(0))), t).filter("falls_short").count() >= 2


def test_mixture(spark):
    docs = [(i, "some words here " * 10, " Alpha ") for i in range(200)] + [(1000 + i, "beta text", "beta") for i in range(5)] + [(2000, None, "alpha"), (2001, "", "ALPHA"), (2002, "x", None), (2003, "x", "  ")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    c = p9_mix.token_counts(df)
    assert c.count() == 207 and c.filter("tokens = 0").count() == 2
    have = {r.source: r.t for r in c.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    w = spark.createDataFrame([(1, 2 * have["alpha"], "alpha", 0.75, 2), (1, 2 * have["alpha"], "Beta", 0.25, 3), (1, 2 * have["alpha"], "gamma", 0.0001, 4)], "plan_id int, total_tokens long, source string, target_share double, max_repeats int")
    rate = p9_mix.rates(c, w)
    r = {x.source: x for x in rate.collect()}
    assert r["Beta"].falls_short and r["gamma"].falls_short and not r["alpha"].falls_short
    e = p9_mix.emit(c, rate)
    per = e.filter("source = 'alpha'").groupBy("doc_id").count()
    assert per.agg(F.min("count"), F.max("count")).first()[:] == (1, 2)
    got = e.filter("source = 'alpha'").agg(F.sum("tokens")).first()[0]
    assert got == pytest.approx(1.5 * have["alpha"], rel=0.1)
    assert e.filter("source = 'beta'").count() == 15
    rep = {x.source: x for x in p9_mix.report(c, rate).collect()}
    assert rep["gamma"].actual_tokens == 0 and sum(x.actual_share for x in rep.values()) == pytest.approx(1)
    assert p9_mix.rates(p9_mix.token_counts(df.limit(0)), w).filter("falls_short").count() == 3
    assert re.compile("x")
