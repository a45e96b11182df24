"""From corpus files to papers, and the features of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import text as T
from scriptorium.session import durable

MIN_WORDS = 50
PART_CHARS = 64_000_000
SLICE = 4096


def canonical_id(c: Column | str) -> Column:
    """Old-style ids are written with / or with _; one form."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(c), r"^([A-Za-z][A-Za-z.\-]*)_(\d)", "$1/$2")


def corpus_files(documents: DataFrame) -> DataFrame:
    """(doc_id, arxiv_id, year_group, filename, raw_text) of the documents that name a paper."""
    return documents.filter("arxiv_id is not null").select("doc_id", canonical_id("arxiv_id").alias("arxiv_id"), "year_group", "filename", F.col("text").alias("raw_text"))


def concat_papers(files: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """A2: the files of a paper in order of filename (then doc_id), joined by blank lines.

    No cell and no task may hold a paper of any size, so a paper beyond part_chars comes in parts
    (part_no 0, 1, ...); up to that size it is one row. Parts are cut from running sums over slices of
    SLICE ids, so no window sees single files. Null texts count as empty, null filenames come first.
    """
    f = files.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))).withColumn("_slice", F.floor(F.col("doc_id") / SLICE))
    sums = f.groupBy("arxiv_id", "year_group", "filename", "_slice").agg(F.sum(F.length("raw_text") + 2).alias("_len"))
    w = Window.partitionBy("arxiv_id", "year_group").orderBy("filename", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = ("arxiv_id", "year_group", "filename", "_slice")
    parts = sums.select(*[F.col(c).alias(f"_p_{c}") for c in keys], F.floor(F.coalesce(F.sum("_len").over(w), F.lit(0)) / part_chars).cast("bigint").alias("part_no"))
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    one = f.join(parts, cond)
    g = one.groupBy("arxiv_id", "year_group", "part_no").agg(F.sort_array(F.collect_list(F.struct("filename", "doc_id", "raw_text"))).alias("_f"))
    return g.select("arxiv_id", "year_group", "part_no", F.array_join(F.transform("_f", lambda x: x["raw_text"]), "\n\n").alias("text"), F.size("_f").cast("bigint").alias("n_files"))


def papers(files: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Papers with clean text and at least min_words words. Only a paper of one part can be
    that short; the further parts of a long paper stay whatever their length."""
    p = concat_papers(files).withColumn("text_clean", T.clean_text("text")).withColumn("n_ws_words", T.whitespace_words("text_clean"))
    return p.filter((F.col("n_ws_words") >= min_words) | (F.col("part_no") > 0))


KEYS = ["arxiv_id", "year_group", "part_no"]
#: What names a paper. Features are counted per part and added up by these before any ratio is taken, so that
#: a paper in parts counts once in every cohort statistic.
PAPER = ["arxiv_id", "year_group"]


def quantiles(df: DataFrame, value: str, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys, n, q0, q1, ...): exact quantiles with linear interpolation, from the histogram of the values.

    Equal values are counted first. The values' ranks come from running sums in two levels, over ranges of
    values (leading bits) and inside a range, so that no task holds all distinct values of a group."""
    v = F.col(value).cast("double")
    h = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    h = h.withColumn("_r", leading("_v"))
    per = h.groupBy(*keys, "_r").agg(F.sum("_c").alias("_s"))
    outer = Window.partitionBy(*keys).orderBy("_r")
    base = per.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_r").alias("_b_r"), (F.sum("_s").over(outer.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(*keys)).alias("_n"))
    same = F.col("_r") == F.col("_b_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    inner = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = h.withColumn("_in", F.sum("_c").over(inner)).join(base, same).select(*keys, "_v", "_n", (F.col("_before") + F.col("_in") - F.col("_c")).alias("_lo"), (F.col("_before") + F.col("_in") - 1).alias("_hi"))
    aggs = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("_n") - 1)
        for name, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("_lo") <= k) & (F.col("_hi") >= k), F.col("_v"))).alias(f"_{name}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_t{i}"))
    g = x.groupBy(*keys).agg(F.max("_n").alias("n"), *aggs)
    return g.select(*keys, "n", *[(F.col(f"_a{i}") + F.col(f"_t{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"q{i}") for i in range(len(probs))])


def leading(value: str) -> Column:
    """An order-preserving range of a number: sign, exponent and the first bits of the mantissa."""
    v = F.col(value)
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.floor(F.log2(F.abs(v)) * 16) + 20000))


def null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys come from df."""
    o = other.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return df.join(o, cond, how).drop(*[f"_j_{k}" for k in keys])


def corpus_statistics(files: DataFrame) -> DataFrame:
    """A1: papers, files and words per cohort."""
    f = files.select("year_group", "arxiv_id", T.whitespace_words(F.coalesce("raw_text", F.lit(""))).alias("n"))
    g = f.groupBy("year_group").agg(F.count_distinct("arxiv_id").alias("papers"), F.count(F.lit(1)).alias("files"), F.sum("n").alias("total_words"), F.round(F.avg("n"), 1).alias("mean_words"))
    mid = quantiles(f, "n", ["year_group"], [0.5]).select("year_group", F.round("q0", 1).alias("median_words"))
    return null_safe(g, mid, ["year_group"])


def sentence_rows(p: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per sentence with its word and syllable counts and whether it is passive."""
    s = p.select(*keys, F.posexplode(T.sentences("text_clean")).alias("pos", "sentence"))
    s = s.withColumn("_w", T.words("sentence"))
    return s.select(*keys, F.col("pos").cast("bigint").alias("pos"), "sentence", F.size("_w").cast("bigint").alias("n_words"), T.is_passive("sentence").alias("passive"))


def word_rows(p: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per word in lower case, with its position from 1 in its part."""
    w = p.select(*keys, F.posexplode(T.words("text_clean")).alias("j", "w"))
    return w.select(*keys, (F.col("j") + 1).cast("bigint").alias("j"), F.lower("w").alias("w"), T.syllables("w").alias("syl"))


def readability(p: DataFrame) -> DataFrame:
    """X6 and X7 with their counts, per paper: counts come from arrays of the row, parts are added."""
    a = p.withColumn("_w", T.words("text_clean")).withColumn("n_sentences", F.size(T.sentences("text_clean")).cast("bigint"))
    a = a.withColumn("_y", F.transform("_w", lambda w: T.syllables(w)))
    a = a.select(
        *PAPER, "n_sentences", F.size("_w").cast("bigint").alias("n_words"),
        F.aggregate("_y", F.lit(0).cast("bigint"), lambda s, y: s + y).alias("n_syllables"),
        F.size(F.filter("_y", lambda y: y >= 3)).cast("bigint").alias("n_complex"),
    )
    a = a.groupBy(*PAPER).agg(*[F.sum(c).alias(c) for c in ("n_sentences", "n_words", "n_syllables", "n_complex")])
    n, s = F.col("n_words").cast("double"), F.col("n_sentences").cast("double")
    return a.select("*", T.flesch(n, s, F.col("n_syllables").cast("double")).alias("flesch"), T.gunning_fog(n, s, F.col("n_complex").cast("double")).alias("fog"))


def lexical(p: DataFrame) -> DataFrame:
    """X10 and X12 per paper from word counts; words are combined before they are shuffled."""
    c = word_rows(p, PAPER).groupBy(*PAPER, "w").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*PAPER).agg(
        F.sum("c").alias("n_words"), F.count(F.lit(1)).alias("n_types"),
        (F.count(F.lit(1)) / F.sum("c")).alias("ttr"), (F.count_if(F.col("c") == 1) / F.sum("c")).alias("hapax_ratio"),
    )


def sentence_features(p: DataFrame) -> DataFrame:
    """X9 and X13. Sentence lengths are few different numbers: the median keeps their counts only."""
    return sentence_rows(p, PAPER).groupBy(*PAPER).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg("n_words").alias("mean_sentence_length"), F.median("n_words").alias("median_sentence_length"), F.avg(F.col("passive").cast("int")).alias("passive_ratio")
    )


def row_features(p: DataFrame) -> DataFrame:
    """Every feature that one row's arrays give: counts, readability, sentence lengths, passive voice,
    citations and paragraphs; counts of parts are added, lengths go through their histogram."""
    a = p.withColumn("_w", T.words("text_clean")).withColumn("_s", T.sentences("text_clean"))
    a = a.withColumn("_y", F.transform("_w", lambda w: T.syllables(w)))
    a = a.select(
        *PAPER, "n_files", F.transform("_s", lambda s: F.size(T.words(s))).alias("_l"), F.size("_w").cast("bigint").alias("n_words"), F.size("_s").cast("bigint").alias("n_sentences"),
        F.aggregate("_y", F.lit(0).cast("bigint"), lambda s, y: s + y).alias("n_syllables"), F.size(F.filter("_y", lambda y: y >= 3)).cast("bigint").alias("_cx"),
        F.size(F.filter("_s", T.is_passive)).cast("bigint").alias("_pv"), T.citation_count("text").alias("n_citations"), T.paragraph_count("text").alias("n_paragraphs"),
    )
    a = durable(a)
    sums = a.groupBy(*PAPER).agg(*[F.sum(c).alias(c) for c in ("n_files", "n_words", "n_sentences", "n_syllables", "_cx", "_pv", "n_citations", "n_paragraphs")])
    mid = a.select(*PAPER, F.explode("_l").alias("l")).groupBy(*PAPER).agg(F.avg("l").alias("mean_sentence_length"), F.median("l").alias("median_sentence_length"))
    n, s, c = (F.col(x).cast("double") for x in ("n_words", "n_sentences", "n_citations"))
    return null_safe(sums, mid, PAPER, "left").select(
        *PAPER, "n_files", "n_words", "n_sentences", "n_syllables", T.flesch(n, s, F.col("n_syllables").cast("double")).alias("flesch"), T.gunning_fog(n, s, F.col("_cx").cast("double")).alias("fog"),
        "mean_sentence_length", "median_sentence_length", F.try_divide(F.col("_pv").cast("double"), s).alias("passive_ratio"), "n_citations", "n_paragraphs", F.try_divide(c, s).alias("cit_per_sentence"), F.try_divide(c * 100.0, n).alias("cit_per_100_words"),
    )


def word_features(p: DataFrame, window: int = 50) -> DataFrame:
    """X10, X11 and X12 from one pass: a word without an earlier one is a new type, without a later one too
    it stands once. A word at position j opens as many MATTR windows as begin after its previous position:
    linear. One shuffle on (paper, word), so that no long paper sits in one task, one on paper. MATTR windows
    don't go over the border of a part."""
    w = Window.partitionBy(*PAPER, "w").orderBy("part_no", "j")
    # the count is taken below the generator, else it would be taken again for every word
    a = p.select(*KEYS, T.words("text_clean").alias("_w")).withColumn("n", F.size("_w").cast("bigint"))
    r = a.select(*KEYS, "n", F.posexplode("_w").alias("j", "w"))
    r = r.select(*KEYS, "n", (F.col("j") + 1).cast("bigint").alias("j"), F.lower("w").alias("w"))
    r = r.withColumn("_p", F.lag(F.struct("part_no", "j")).over(w)).withColumn("next", F.lead("j").over(w))
    prev = F.when(F.col("_p.part_no") == F.col("part_no"), F.col("_p.j")).otherwise(F.lit(0))
    opened = F.greatest(F.lit(0), F.least("j", F.col("n") - window + 1) - F.greatest(F.lit(0), F.col("j") - window, prev))
    g = r.groupBy(*PAPER).agg(
        F.count(F.lit(1)).alias("n"), F.sum(opened).alias("_o"), F.count_if(F.col("_p").isNull()).alias("_t"), F.count_if(F.col("_p").isNull() & F.col("next").isNull()).alias("_h"),
        F.sum(F.when(F.col("j") == 1, F.greatest(F.lit(0), F.col("n") - window + 1))).alias("_windows"),
    )
    return g.select(*PAPER, "n", (F.col("_t") / F.col("n")).alias("ttr"), (F.col("_h") / F.col("n")).alias("hapax_ratio"), F.when(F.col("_windows") == 0, F.col("_t") / F.col("n")).otherwise(F.col("_o") / (F.lit(float(window)) * F.col("_windows"))).alias("mattr"))


def mattr(p: DataFrame, window: int = 50) -> DataFrame:
    """X11."""
    return word_features(p, window).select(*PAPER, "mattr")


def structure(p: DataFrame) -> DataFrame:
    """X1, X2, X4 and X14 per paper; what is shuffled are counts."""
    s = p.select(
        *PAPER, T.citation_count("text").alias("n_citations"), T.paragraph_count("text").alias("n_paragraphs"),
        F.size(T.words("text_clean")).cast("bigint").alias("n_words"), F.size(T.sentences("text_clean")).cast("bigint").alias("n_sentences"),
    )
    s = s.groupBy(*PAPER).agg(*[F.sum(c).alias(c) for c in ("n_citations", "n_paragraphs", "n_words", "n_sentences")])
    c = F.col("n_citations").cast("double")
    return s.select("*", F.try_divide(c, F.col("n_sentences")).alias("cit_per_sentence"), F.try_divide(c * 100.0, F.col("n_words")).alias("cit_per_100_words"))


def unpivot(p: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Long form (keys, metric, value), nulls dropped."""
    return p.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").filter("value is not null")


def summary(long: DataFrame) -> DataFrame:
    """A3: per cohort and metric; the deviation is the sample's."""
    long = durable(long.select("year_group", "metric", "value"))
    keys = ["year_group", "metric"]
    g = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return null_safe(g, quantiles(long, "value", keys, [0.5]).select(*keys, F.col("q0").alias("median")), keys).select(*keys, "n", "mean", "median", "std", "min", "max")
