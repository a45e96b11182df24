"""Strata, balanced and stratified samples, and the manifest they are drawn from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import text as T
from scriptorium.operators.corpus import null_safe, quantiles
from scriptorium.session import durable

SLICES = 256


def manifest(corpus: DataFrame) -> DataFrame:
    """X17 and X18 for corpus records: one row per record with its counts."""
    c = corpus.withColumn("_t", T.normalize_newlines("raw_text")).withColumn("_c", T.clean_text("_t"))
    c = c.select(
        "corpus_id", "arxiv_id", "year_group", F.size("file_paths").cast("bigint").alias("n_files"), F.length("_t").cast("bigint").alias("n_chars"), F.size(T.manifest_words("_c")).cast("bigint").alias("n_words"), T.citation_count("_t").alias("n_citations"),
        T.alpha_ratio("_c").alias("alpha_ratio"), F.array_join("file_paths", "|").alias("file_paths"),
    )
    return c.withColumn("cit_per_100_words", F.try_divide(F.col("n_citations") * 100.0, "n_words"))


def quality_filter(m: DataFrame, min_words: int = 150, min_alpha: float = 0.55) -> DataFrame:
    """F8."""
    return m.filter((F.col("n_words") >= min_words) & (F.col("alpha_ratio") >= min_alpha))


def below_quantile(m: DataFrame, value: str = "n_words", group: str = "year_group", q: float = 0.99) -> DataFrame:
    """rows up to the upper quantile (linear interpolation) of their own group; null groups count as one."""
    m = durable(m)  # counts of a text each, read twice below
    lim = quantiles(m, value, [group], [q]).select(group, F.col("q0").alias("_lim"))
    return null_safe(m, lim, [group]).filter(F.col(value) <= F.col("_lim")).drop("_lim")


def strata(m: DataFrame, n: int = 10, value: str = "n_words") -> DataFrame:
    """L1: pooled quantile bins; equal values share a bin, equal edges are one edge. The edges are a
    handful of numbers from one histogram and go into the plan as constants."""
    h = durable(m.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c")))
    few = [r._x for r in h.select("_x").limit(n).collect()]
    q = min(max(1, n), max(1, len(few)))
    edges: list[float] = []
    if q > 1:
        row = quantiles(m.select(F.lit(0).alias("_g"), value), value, ["_g"], [i / q for i in range(1, q)]).first()
        lo = h.agg(F.min("_x")).first()[0]
        edges = sorted({float(row[f"q{i}"]) for i in range(q - 1)} - {float(lo)})
    s = sum([F.when(F.col(value) > e, 1).otherwise(0) for e in edges], F.lit(0))
    return m.withColumn("word_stratum", F.when(F.col(value).isNotNull(), s).cast("int"))


def random_ranks(m: DataFrame, keys: list[str], id_col: str, seed: int, slices: int = SLICES) -> DataFrame:
    """m with a random rank from 1 inside each group, dealt in slices of the hash range so that a group
    of any size is spread over many tasks."""
    h = m.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_s", F.shiftrightunsigned("_h", 64 - int(math.log2(slices))).cast("int"))
    sizes = h.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_s").alias("_s2"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_s").orderBy(F.shiftrightunsigned("_h", 1), "_h", id_col)
    cond = (F.col("_s") == F.col("_s2")) & F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return h.withColumn("_r", F.row_number().over(inner)).join(before, cond).withColumn("rank", F.col("_r") + F.col("_before")).drop("_h", "_s", "_s2", "_n", "_r", "_before", *[f"_k_{k}" for k in keys])


def allocate(capacity: dict[int, int], total: int | None) -> dict[int, int]:
    """Draws per stratum and group: all of the capacity, or a proportional share by floors and then one
    by one to the largest fractions that still have room."""
    whole = sum(capacity.values())
    if whole == 0:
        raise ValueError("no balanced sample: some group is missing in every stratum")
    if total is None or total >= whole:
        return dict(capacity)
    exact = {s: total * c / whole for s, c in capacity.items()}
    out = {s: min(capacity[s], math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), s))
    i = 0
    while sum(out.values()) < total:
        s = order[i % len(order)]
        if out[s] < capacity[s]:
            out[s] += 1
        i += 1
    return out


def balanced_sample(m: DataFrame, per_group: int | None = None, seed: int = 42, groups: tuple[str, ...] = ("2015", "2025"), id_col: str = "corpus_id") -> DataFrame:
    """L2: the same number of records of every group in each stratum, as many as there can be or
    per_group in all. Capacities are one aggregation over strata x groups."""
    d = m.filter(F.col("year_group").isin(*groups))
    have: dict[int, dict[str, int]] = {}
    for r in d.groupBy("word_stratum", "year_group").count().collect():
        have.setdefault(r.word_stratum, {})[r.year_group] = r["count"]
    draws = allocate({s: min(c.get(g, 0) for g in groups) for s, c in have.items()}, per_group)
    cap = F.create_map(*[F.lit(x) for s, n in draws.items() for x in (s, n)])
    return random_ranks(d, ["word_stratum", "year_group"], id_col, seed).filter(F.col("rank") <= cap[F.col("word_stratum")])


def stratified_sample(m: DataFrame, n: int, seed: int = 42, group: str = "year_group", id_col: str = "corpus_id") -> DataFrame:
    """L3: min(n, size) random rows of every group."""
    return random_ranks(m, [group], id_col, seed).filter(F.col("rank") <= n)
