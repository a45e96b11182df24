"""The analyses of the corpus as compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import citations as C
from scriptorium.functions import markers as MK
from scriptorium.operators import corpus as K
from scriptorium.operators import stats as S
from scriptorium.session import durable

LINGUISTIC = ["mean_sentence_length", "median_sentence_length", "flesch", "fog", "passive_ratio", "mattr", "hapax_ratio"]
STRUCTURAL = ["n_words", "n_paragraphs", "n_citations", "cit_per_sentence", "cit_per_100_words"]


def features(p: DataFrame) -> DataFrame:
    """All features of a paper in one row. All but the lexical ones are computed inside the row from its
    arrays; the lexical ones come from one pass over the words. The papers are cut from their lineage
    first, as both branches read them."""
    p = durable(p.select(*K.KEYS, "text", "text_clean", "n_files"))
    return K.null_safe(K.row_features(p), K.word_features(p).drop("n"), K.PAPER, "left")


def marker_table(p: DataFrame) -> DataFrame:
    """D13 in long form."""
    return MK.marker_rows(p.withColumn("n_words", F.size(K.T.words("text_clean"))), K.PAPER)


def marker_score(p: DataFrame) -> DataFrame:
    """Sum of the high-confidence rates of a paper."""
    high = [i for i, (_, tier, _) in enumerate(MK.MARKERS) if tier == MK.HIGH]
    one = p.select(*K.PAPER, F.size(K.T.words("text_clean")).alias("_n"), MK.phrases().alias("_h"))
    one = one.select(*K.PAPER, "_n", *[MK.marker_columns("_h")[i] for i in high])
    total = sum((F.col(f"_m{i}") for i in high), F.lit(0))
    g = one.select(*K.PAPER, "_n", total.alias("_c")).groupBy(*K.PAPER).agg(F.sum("_n").alias("_n"), F.sum("_c").alias("_c"))
    return g.select(*K.PAPER, F.try_divide(F.col("_c") * 1000.0, "_n").alias("llm_marker_score"))


def prevalence(markers: DataFrame) -> DataFrame:
    """Share of papers per cohort with a marker, and its ratio, where a share of 0 in the first cohort
    counts as 0.01; by rising ratio."""
    m = markers.groupBy("marker", "tier").pivot("year_group", [S.FIRST, S.SECOND]).agg(F.avg("has") * 100.0)
    a, b = F.coalesce(F.col(f"`{S.FIRST}`"), F.lit(0.0)), F.coalesce(F.col(f"`{S.SECOND}`"), F.lit(0.0))
    out = m.select("marker", "tier", a.alias("pct_2015"), b.alias("pct_2025"), (b / F.when(a == 0, 0.01).otherwise(a)).alias("ratio"))
    return out.orderBy("ratio", "marker")


def top_markers(markers: DataFrame, group: str = S.SECOND, n: int = 10) -> DataFrame:
    """A5: a top-n report."""
    return markers.filter(F.col("year_group") == group).groupBy("marker").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "marker").limit(n)


def citation_patterns(p: DataFrame) -> DataFrame:
    """Count of each pattern per paper."""
    x = p.select(*K.PAPER, C.pieces("text").alias("_p")).select(*K.PAPER, F.explode(C.contexts(F.col("_p"))).alias("_c"))
    x = x.select(*K.PAPER, C.pattern(F.col("_c")).alias("pattern"))
    return x.groupBy(*K.PAPER, "pattern").agg(F.count(F.lit(1)).alias("n"))


def pattern_shares(patterns: DataFrame) -> DataFrame:
    """Share of each pattern among a cohort's citations, in percent."""
    g = patterns.groupBy("year_group", "pattern").agg(F.sum("n").alias("n"))
    # a window over cohorts x patterns, after the counts: a handful of rows
    return g.select("year_group", "pattern", "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("year_group"))).alias("share"))


def zero_citations(structure: DataFrame) -> DataFrame:
    """A7."""
    return structure.groupBy("year_group").agg(F.count_if(F.col("n_citations") == 0).alias("zero"), F.count(F.lit(1)).alias("papers"), F.avg((F.col("n_citations") == 0).cast("int")).alias("zero_rate"))
