"""Two-cohort statistics. Everything that grows with the data is a grouped aggregation; tail
probabilities are computed on the few aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.operators.corpus import leading, null_safe, quantiles
from scriptorium.session import durable, ship

FIRST, SECOND = "2015", "2025"


# ------------------------------------------------------------------------------ tail probabilities


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def chi2_one(x: float) -> float:
    """Upper tail for one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2.0))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the tables that are no more probable than the one seen; 1 for an empty margin."""
    r1, r2, c1 = a + b, c + d, a + c
    if 0 in (r1, r2, c1, b + d):
        return 1.0
    lc = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    base = lc(r1 + r2, c1)
    logp = lambda k: lc(r1, k) + lc(r2, c1 - k) - base
    seen = logp(a)
    total = sum(math.exp(p) for k in range(max(0, c1 - r2), min(r1, c1) + 1) if (p := logp(k)) <= seen + 1e-7)
    return min(1.0, total)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Asymptotic, with tie and continuity correction."""
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))) if n > 1 else 0.0
    if var <= 0:
        return 1.0
    return min(1.0, normal_two_sided(max(0.0, abs(u - n1 * n2 / 2.0) - 0.5) / math.sqrt(var)))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """For small samples without ties: counts of rank sums by recursion."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for k in range(1, n1 + n2 + 1):
        for i in range(min(n1, k), 0, -1):
            for s in range(n1 * n2, -1, -1):
                shift = k - i
                if s >= shift and ways[i - 1][s - shift]:
                    ways[i][s] += ways[i - 1][s - shift]
    w = ways[n1]
    total = sum(w)
    low = min(u, n1 * n2 - u)
    return min(1.0, 2.0 * sum(w[: int(low) + 1]) / total)


# ------------------------------------------------------------------------------------- relations


def histogram(long: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(metric, value, n1, n2): what every rank statistic needs; combined before the shuffle."""
    g = F.col("year_group")
    return long.filter(g.isin(first, second)).groupBy("metric", "value").agg(F.count_if(g == first).alias("n1"), F.count_if(g == second).alias("n2"))


def mann_whitney(long: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """ST1 and ST2: U of the first group and the rank-biserial correlation (positive: second is higher).

    The values below come from running sums over distinct values. They are summed in two levels, over
    ranges of values and inside a range, so that no task has to hold all distinct values of a metric.
    """
    h = histogram(long, first, second)
    h = h.withColumn("_r", leading("value"))
    per = h.groupBy("metric", "_r").agg(F.sum("n2").alias("_s"))
    outer = Window.partitionBy("metric").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("metric", "_r", F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("metric", "_r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    x = h.withColumn("_in", F.coalesce(F.sum("n2").over(inner), F.lit(0))).join(base, ["metric", "_r"])
    t = F.col("n1") + F.col("n2")
    g = x.groupBy("metric").agg(
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"),
        F.sum(F.col("n1") * (F.col("_in") + F.col("_before") + F.col("n2") / 2.0)).alias("u"),
        F.sum((t * t * t - t).cast("double")).alias("ties"),
    )
    return g.select("*", (F.lit(1.0) - F.try_divide(F.lit(2.0) * F.col("u"), (F.col("n1") * F.col("n2")).cast("double"))).alias("rank_biserial"))


def moments(long: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Counts, means and variances of both groups per metric, in one aggregation of partial sums."""
    g, v = F.col("year_group"), F.col("value")
    a, b = F.when(g == first, v), F.when(g == second, v)
    return long.filter(g.isin(first, second)).groupBy("metric").agg(
        F.count(a).alias("m1"), F.count(b).alias("m2"), F.avg(a).alias("mean1"), F.avg(b).alias("mean2"),
        F.var_samp(a).alias("var1"), F.var_samp(b).alias("var2"),
    )


def medians(long: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """(metric, median1, median2), from histograms."""
    q = quantiles(long.filter(F.col("year_group").isin(first, second)), "value", ["metric", "year_group"], [0.5])
    pick = lambda g: F.max(F.when(F.col("year_group") == g, F.col("q0")))
    return q.groupBy("metric").agg(pick(first).alias("median1"), pick(second).alias("median2"))


def cohens_d(n1: Column, n2: Column, m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """ST4: positive means the first group is higher; null where the pooled deviation is 0."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, (n1 + n2 - 2).cast("double")))
    return F.try_divide(m1 - m2, F.nullif(pooled, F.lit(0.0)))


def _p_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = lambda *xs: all(x is not None and not (isinstance(x, float) and math.isnan(x)) for x in xs)
        pu, t_, pt = [], [], []
        for r in b.itertuples(index=False):
            if r.n1 and r.n2:
                exact = min(r.n1, r.n2) <= 8 and r.ties == 0
                pu.append(mann_whitney_exact(r.u, int(r.n1), int(r.n2)) if exact and r.n1 * r.n2 <= 4000 else mann_whitney_p(r.u, int(r.n1), int(r.n2), r.ties))
            else:
                pu.append(None)
            se1, se2 = (r.var1 / r.n1 if ok(r.var1) and r.n1 else None), (r.var2 / r.n2 if ok(r.var2) and r.n2 else None)
            if se1 is None or se2 is None or se1 + se2 <= 0:
                t_.append(None)
                pt.append(None)
            else:
                t = (r.mean1 - r.mean2) / math.sqrt(se1 + se2)
                df = (se1 + se2) ** 2 / ((se1**2 / (r.n1 - 1) if r.n1 > 1 else 0) + (se2**2 / (r.n2 - 1) if r.n2 > 1 else 0))
                t_.append(t)
                pt.append(student_two_sided(t, df))
        yield b.assign(mw_p=pd.Series(pu, dtype="float64", index=b.index), t=pd.Series(t_, dtype="float64", index=b.index), welch_p=pd.Series(pt, dtype="float64", index=b.index))


def compare(long: DataFrame, first: str = FIRST, second: str = SECOND, with_medians: bool = True) -> DataFrame:
    """ST5: rank test, Welch test and effect sizes of all metrics from aggregations over the values, which are
    written once."""
    ship(long.sparkSession)
    long = durable(long.select("year_group", "metric", "value"))
    m = mann_whitney(long, first, second).join(moments(long, first, second), "metric")
    if with_medians:
        m = m.join(medians(long, first, second), "metric")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    m = m.withColumn("cohens_d", cohens_d(n1, n2, F.col("mean1"), F.col("mean2"), F.col("var1"), F.col("var2"))).drop("m1", "m2")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields) + ", mw_p double, t double, welch_p double"
    return m.mapInPandas(_p_values, schema)


def bonferroni(df: DataFrame, p: str = "p") -> DataFrame:
    """ST8 over all rows of a small result table."""
    return df.withColumn("bonferroni", F.least(F.col(p) * F.count(F.col(p)).over(Window.partitionBy()), F.lit(1.0)))


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """ST9 and ST10 over all rows of a small result table: step-up, monotone, at most 1."""
    every = Window.partitionBy(F.col(p).isNull())
    rk = F.row_number().over(every.orderBy(p))
    n = F.count(p).over(every)
    d = df.withColumn("_rk", rk).withColumn("_q", F.col(p) * n / F.col("_rk"))
    down = every.orderBy("_rk").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.withColumn("bh", F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(down), F.lit(1.0)))).drop("_rk", "_q")
    return d.withColumn("significant", F.col("bh") < alpha)


def contingency(markers: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Per marker how many papers of each cohort hold it or not."""
    g, h = F.col("year_group"), F.col("has")
    return markers.filter(g.isin(first, second)).groupBy("marker", "tier").agg(
        F.count_if((g == first) & (h == 1)).alias("a"), F.count_if((g == first) & (h == 0)).alias("b"), F.count_if((g == second) & (h == 1)).alias("c"), F.count_if((g == second) & (h == 0)).alias("d")
    )


def chi_square(a: Column, b: Column, c: Column, d: Column, yates: bool = True) -> Column:
    """ST6 statistic of a 2x2 table."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    diff = F.abs(a * d - b * c)
    if yates:
        diff = F.greatest(diff - n / 2.0, F.lit(0.0))
    return F.try_divide(n * diff * diff, (a + b) * (c + d) * (a + c) * (b + d))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ST6: infinite where b or c is 0, null where a or d is 0 as well."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    return F.when(b * c > 0, F.try_divide(a * d, b * c)).when(a * d > 0, F.lit(float("inf")))


def least_expected(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    return F.least(*[F.try_divide(r * k, n) for r in (a + b, c + d) for k in (a + c, b + d)])


def _table_tests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        test, p = [], []
        for r in b.itertuples(index=False):
            if r.expected is not None and r.expected >= 5:
                test.append("chi2")
                p.append(chi2_one(r.chi2))
            else:
                test.append("fisher")
                p.append(fisher_two_sided(int(r.a), int(r.b), int(r.c), int(r.d)))
        yield b.assign(test=test, p=p)


def marker_tests(markers: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """ST11 and L6: prevalence, odds ratio, test of independence, rank test of the rates, both corrections; by
    falling odds ratio."""
    ship(markers.sparkSession)
    markers = durable(markers.select("year_group", "marker", "tier", "per1k", "has"))
    t = contingency(markers, first, second)
    cols = [F.col(x) for x in "abcd"]
    a, b, c, d = (x.cast("double") for x in cols)
    t = t.select("*", F.try_divide(a * 100.0, a + b).alias("pct1"), F.try_divide(c * 100.0, c + d).alias("pct2"), odds_ratio(*cols).alias("odds_ratio"), chi_square(*cols).alias("chi2"), least_expected(*cols).alias("expected"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema.fields) + ", test string, p double"
    t = t.mapInPandas(_table_tests, schema)
    rates = compare(markers.select("year_group", F.col("marker").alias("metric"), F.col("per1k").alias("value")).filter("value is not null"), first, second, with_medians=False)
    t = t.join(rates.select(F.col("metric").alias("marker"), "mw_p"), "marker", "left")
    return benjamini_hochberg(bonferroni(t)).orderBy(F.desc("odds_ratio"), "marker")


def master_summary(long: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """ST12 and L6: by falling size of the rank-biserial correlation."""
    c = compare(long, first, second).withColumn("p", F.col("mw_p"))
    c = c.withColumn("pct_change", F.try_divide((F.col("mean2") - F.col("mean1")) * 100.0, F.col("mean1")))
    return benjamini_hochberg(c).select("metric", "mean1", "mean2", "median1", "median2", "pct_change", "u", "p", "rank_biserial", "cohens_d", "bh", "significant").orderBy(F.desc(F.abs("rank_biserial")), "metric")


def r_interval(r: Column, n1: Column, n2: Column) -> Column:
    """ST13: half width of the 95 % interval of a rank-biserial correlation."""
    return F.lit(1.96) * F.sqrt(F.try_divide((F.lit(1.0) - r * r) * (n1 + n2 + 1), F.lit(3.0) * n1 * n2))


def linear_fit(df: DataFrame, x: str, y: str, group: str = "year_group", quantile: float = 0.99) -> DataFrame:
    """ST14: least squares line per group over the rows up to the group's upper quantile of x."""
    df = durable(df.select(group, F.col(x).alias("_x"), F.col(y).alias("_y")))
    q = quantiles(df, "_x", [group], [quantile]).select(group, "q0")
    return null_safe(df.filter(F.col(group).isNotNull()), q, [group]).filter("_x <= q0").groupBy(group).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, value: str, group: str = "year_group", low: float = 0.0, high: float = 120.0, points: int = 121) -> DataFrame:
    """ST15: Gaussian kernel density on a grid. Values are counted first, so each distinct value meets
    the grid once."""
    c = df.filter(F.col(value).between(low, high)).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    n, s1, s2 = F.sum("c"), F.sum(F.col("c") * F.col("v")), F.sum(F.col("c") * F.col("v") * F.col("v"))
    st = c.groupBy(group).agg(n.alias("n"), F.sqrt(F.try_divide(s2 - s1 * s1 / n, (n - 1).cast("double"))).alias("sd"))
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    step = (high - low) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))
    k = c.join(st, group).filter("bw > 0").select(group, "n", "bw", "v", "c", F.explode(grid).alias("x"))
    z = (F.col("x") - F.col("v")) / F.col("bw")
    return k.groupBy(group, "x").agg((F.sum(F.col("c") * F.exp(-0.5 * z * z)) / (F.max("n") * F.max("bw") * math.sqrt(2 * math.pi))).alias("density"))


def boxes(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """ST16: quartiles and whiskers within 1.5 interquartile ranges."""
    df = durable(df.select(*keys, value))
    q = quantiles(df, value, keys, [0.25, 0.5, 0.75]).select(*keys, *[F.col(f"q{i}").alias(f"q{i + 1}") for i in (2, 1, 0)])
    iqr = F.col("q3") - F.col("q1")
    x = null_safe(df, q, keys).filter(F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr))
    return x.groupBy(*keys, "q1", "q2", "q3").agg(F.min(value).alias("low"), F.max(value).alias("high"))
