"""Problem 7: a sample with given category proportions.

Method: divisor-method priorities. The papers of a category get random ranks 1, 2, ... (order of a
seeded hash); paper of rank r has priority (r - 0.5) / target, ranks within the minimum come first,
and the sample is the sample_size papers with the smallest priorities, so that the seats of an
exhausted category go to the others by themselves.

Ranks are dealt without putting a category into one task: the hash range is cut into slices, ranks
are taken inside a slice and the counts of the slices before it are added. Since priorities depend
on counts alone, the seats of a plan follow from the table of plans x categories, and the papers
chosen are those whose rank is within the seats; no global sort.

Defined results: both id writings (old_style/0101 and old_style_0101) are one paper; stray
formatting around a year is ignored; null, blank or yearless groups belong to no category; a paper
under two years counts in both; null or non-positive shares get seats only through min_papers; a
plan whose minimums exceed sample_size keeps the minimums and is larger; ties of priority go to the
category whose name comes first.
"""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.session import is_small, ship

SLICES = 256
MAX_PLAN_ROWS = 100_000


def year_key(c):
    """The year inside stray formatting: '2015.0', ' 2015 ' and '2015' are one."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"^\D{0,8}?(\d{4})(?:\.0+)?\D{0,8}$", 1), F.lit(""))


def paper_key(c):
    """Old-style ids are written with / or _; one paper either way."""
    return F.nullif(F.regexp_replace(F.trim(c), r"^([A-Za-z][A-Za-z.\-]*)_(\d)", "$1/$2"), F.lit(""))


def papers(corpus: DataFrame, group: str = "year_group", paper: str = "arxiv_id", key: str = "corpus_id") -> DataFrame:
    """One row per category and paper, with the smallest row key."""
    return (
        corpus.select(year_key(F.col(group)).alias("category"), paper_key(F.col(paper)).alias("paper"), F.col(key).cast("bigint").alias("row_key"))
        .filter("category is not null and paper is not null")
        .groupBy("category", "paper")
        .agg(F.min("row_key").alias("row_key"))
    )


def ranked(p: DataFrame, seed: int = 7, slices: int = SLICES) -> DataFrame:
    """p with a random rank inside its category; the largest task holds 1/slices of a category."""
    h = p.withColumn("_h", F.xxhash64("category", "paper", F.lit(seed))).withColumn("_slice", F.shiftrightunsigned("_h", 64 - int(math.log2(slices))).cast("int"))
    sizes = h.groupBy("category", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("category").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("category", "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("category", "_slice").orderBy(F.expr("shiftrightunsigned(_h, 1)"), "_h", "paper")
    return h.withColumn("_r", F.row_number().over(inner)).join(before, ["category", "_slice"]).select("category", "paper", "row_key", (F.col("_r") + F.col("_before")).alias("rank"))


def seats(size: int, shares: list[float], floors: list[int], have: list[int]) -> list[int]:
    """Seats of each category: the size smallest priorities, minimums first."""
    n = len(shares)
    got = [min(have[i], max(0, floors[i])) for i in range(n)]
    left = size - sum(got)
    open_ = [i for i in range(n) if shares[i] > 0]
    if left <= 0 or not open_:
        return got
    # seats(t): ranks r beyond the minimum with (r - 1/2) / share <= t
    at = lambda t: [max(got[i], min(have[i], math.floor(t * shares[i] + 0.5))) if shares[i] > 0 else got[i] for i in range(n)]
    lo, hi = 0.0, 1.0
    top = sum(max(got[i], have[i]) if shares[i] > 0 else got[i] for i in range(n))
    if top <= size:
        return [max(got[i], have[i]) if shares[i] > 0 else got[i] for i in range(n)]
    while sum(at(hi)) < size:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < size else (lo, mid)
    out = at(lo)
    nxt = sorted((Fraction(2 * out[i] + 1, 2) / Fraction(shares[i]), i) for i in open_ if out[i] < have[i])
    for _, i in nxt:
        if sum(out) < size:
            out[i] += 1
    return out


def allot(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per plan row: need, papers at hand, seats, shortfall. Small tables: plans x categories."""
    ship(targets.sparkSession)
    have = counts.select(F.col("category"), F.col("n_papers"))
    t = targets.select("plan_id", "sample_size", "year_group", "target_share", "min_papers", year_key(F.col("year_group")).alias("category"))
    t = t.join(have, "category", "left").na.fill(0, ["n_papers"])
    cols = "plan_id int, year_group string, category string, sample_size int, target_share double, min_papers int, n_papers bigint"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("category", kind="stable", na_position="last").reset_index(drop=True)
        share = pdf["target_share"].fillna(0.0).clip(lower=0).tolist()
        floor = pdf["min_papers"].fillna(0).astype("int64").tolist()
        size = pdf["sample_size"].max()
        size = 0 if pd.isna(size) else int(size)
        pdf["seats"] = seats(size, share, floor, pdf["n_papers"].astype("int64").tolist())
        pdf["need"] = [max(s * size, f) for s, f in zip(share, floor)]
        pdf["falls_short"] = pdf["need"] > pdf["n_papers"]
        return pdf[["plan_id", "year_group", "category", "sample_size", "target_share", "min_papers", "n_papers", "need", "seats", "falls_short"]]

    return t.selectExpr("cast(plan_id as int) plan_id", "year_group", "category", "cast(sample_size as int) sample_size", "target_share", "cast(min_papers as int) min_papers", "n_papers").groupBy("plan_id").applyInPandas(
        one, cols + ", need double, seats bigint, falls_short boolean"
    )


def category_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("category").agg(F.count(F.lit(1)).alias("n_papers"))


def draw(p: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """(plan_id, year_group, paper, row_key, rank): the sample of every plan."""
    s = plan.filter("seats > 0").select("plan_id", "year_group", "category", "seats")
    # plans are a stated table; the join is a broadcast only if they are as few as that
    s = F.broadcast(s) if is_small(s, MAX_PLAN_ROWS) else s
    return ranked(p, seed).join(s, "category").filter("rank <= seats").select("plan_id", "year_group", "paper", "row_key", "rank")


def report(sample: DataFrame, plan: DataFrame) -> DataFrame:
    got = sample.groupBy("plan_id", "year_group").agg(F.count(F.lit(1)).alias("drawn"))
    w = Window.partitionBy("plan_id")
    r = plan.join(got, ["plan_id", "year_group"], "left").na.fill(0, ["drawn"])
    return r.select("plan_id", "year_group", "target_share", F.try_divide(F.col("drawn"), F.sum("drawn").over(w)).alias("actual_share"), "min_papers", "n_papers", "need", "seats", "drawn", "falls_short")
