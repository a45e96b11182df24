"""Queries and SQL of the training-data problems, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import p1_markup, p1_shared, p2_split, p3_names, p10_pii, p4_quality, p5_garbled, p6_level, p7_sample, p8_leak, p9_mix
from scriptorium.session import durable, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# 1 -----------------------------------------------------------------------------------------------


def _markup_parts(spark: SparkSession, d: str):
    return [
        (table(spark, d, "paper_records"), "paper_records.related_work", "record_id", "related_work"),
        (table(spark, d, "raw_sections"), "raw_sections.content", "section_id", "content"),
    ]


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_markup.pieces(_markup_parts(spark, d)).select("field", "row_id")


@query("p1_shared_runs")
def p1_shared_runs(spark: SparkSession, d: str) -> DataFrame:
    # pages are the cleaned texts of both fields, hosts the papers and volumes they belong to
    parts = _markup_parts(spark, d)
    host = None
    for t, field, key, _ in parts:
        x = t.select(F.lit(field).alias("field"), F.col(key).alias("row_id"), "arxiv_id")
        host = x if host is None else host.unionByName(x)
    return p1_shared.shared_runs(p1_markup.cleaned(parts).join(host, ["field", "row_id"]), "arxiv_id", ["field", "row_id"], "clean")


@query("p1_clean")
def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return p1_markup.cleaned(_markup_parts(spark, d))


# 2 -----------------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    return p2_split.split_oversized(table(spark, d, "paper_records"), table(spark, d, "size_limits"), "record_id", "related_work", with_text)


@query(
    "p2_found",
    r"""SELECT l.limit_id, p.record_id FROM paper_records p JOIN size_limits l
        ON CASE l.unit WHEN 'chars' THEN length(p.related_work) WHEN 'bytes' THEN strlen(p.related_work)
           ELSE len(regexp_extract_all(p.related_work, '[^\s]+')) END > l.max_size""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).filter("piece_no = 0").select("limit_id", "record_id")


@query("p2_pieces")
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True)


# 3 -----------------------------------------------------------------------------------------------


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_names.pairs(p3_names.classes(table(spark, d, "paper_metadata")))


@query("p3_classes")
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return p3_names.classes(table(spark, d, "paper_metadata"))


# 4 -----------------------------------------------------------------------------------------------


def _quality(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        (table(spark, d, "corpus_records"), "corpus_records.raw_text", "corpus_id", "raw_text"),
        (table(spark, d, "paper_records"), "paper_records.related_work", "record_id", "related_work"),
    ]
    return p4_quality.quality(parts, table(spark, d, "common_words"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).filter("not is_prose").select("field", "row_id")


@query("p4_statistics")
def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d)


# 5 -----------------------------------------------------------------------------------------------

# papers of one month (or old archive) come through one channel: that is the source that pools evidence
SOURCE = "regexp_extract(arxiv_id, '^([0-9]{4}|[a-z-]+)', 1)"


def _garbled_parts(spark: SparkSession, d: str):
    return [
        (table(spark, d, "raw_sections"), "raw_sections.content", "section_id", "content", SOURCE),
        (table(spark, d, "paper_records"), "paper_records.abstract", "record_id", "abstract", SOURCE),
    ]


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tok = p5_garbled.words(_garbled_parts(spark, d))
    return p5_garbled.affected(tok, p5_garbled.estimate(tok))


@query("p5_words")
def p5_words(spark: SparkSession, d: str) -> DataFrame:
    return p5_garbled.estimate(p5_garbled.words(_garbled_parts(spark, d)))


@query("p5_repaired")
def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    parts = _garbled_parts(spark, d)
    tok = p5_garbled.words(parts)
    return p5_garbled.repaired(parts, tok, p5_garbled.estimate(tok))


# 6 -----------------------------------------------------------------------------------------------


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return p6_level.levels(table(spark, d, "paper_records"), table(spark, d, "common_words"), "record_id", "related_work")


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_level.young(_levels(spark, d)).select("record_id")


@query("p6_levels")
def p6_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


# 7 -----------------------------------------------------------------------------------------------

YEAR_SQL = r"nullif(regexp_extract({c}, '^\D{{0,8}}?(\d{{4}})(?:\.0+)?\D{{0,8}}$', 1), '')"
PAPERS_SQL = rf"""SELECT DISTINCT {YEAR_SQL.format(c="year_group")} AS category,
    nullif(regexp_replace(trim(arxiv_id), '^([A-Za-z][A-Za-z.\-]*)_([0-9])', '\1/\2'), '') AS paper FROM corpus_records"""


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = p7_sample.papers(table(spark, d, "corpus_records"))
    return p, p7_sample.allot(p7_sample.category_counts(p), table(spark, d, "sample_targets"))


@query(
    "p7_found",
    rf"""WITH have AS (SELECT category, count(*) AS n FROM ({PAPERS_SQL}) WHERE category IS NOT NULL AND paper IS NOT NULL GROUP BY category)
        SELECT t.plan_id, t.year_group FROM sample_targets t LEFT JOIN have h ON h.category = {YEAR_SQL.format(c="t.year_group")}
        WHERE greatest(t.target_share * t.sample_size, t.min_papers) > coalesce(h.n, 0)""",
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)[1].filter("falls_short").select("plan_id", "year_group")


@query("p7_sample")
def p7_draw(spark: SparkSession, d: str) -> DataFrame:
    p, plan = _plan(spark, d)
    return p7_sample.draw(p, plan)


@query(
    "p7_report",
    # the same seats by their definition: minimums first, then the smallest priorities of all open ranks
    rf"""WITH have AS (SELECT category, count(*) AS n FROM ({PAPERS_SQL}) WHERE category IS NOT NULL AND paper IS NOT NULL GROUP BY category),
        t AS (SELECT CAST(t.plan_id AS INTEGER) AS plan_id, t.year_group, {YEAR_SQL.format(c="t.year_group")} AS category, t.target_share, CAST(t.min_papers AS INTEGER) AS min_papers, max(t.sample_size) OVER (PARTITION BY t.plan_id) AS size, coalesce(h.n, 0) AS n FROM sample_targets t LEFT JOIN have h ON h.category = {YEAR_SQL.format(c="t.year_group")}),
        f AS (SELECT *, least(n, greatest(0, coalesce(min_papers, 0))) AS least_ FROM t),
        r AS (SELECT plan_id, year_group, category, unnest(range(least_ + 1, n + 1)) AS rank_, target_share FROM f WHERE target_share > 0),
        p AS (SELECT plan_id, year_group, row_number() OVER (PARTITION BY plan_id ORDER BY (rank_ - 0.5) / target_share, category NULLS LAST) AS k FROM r),
        g AS (SELECT p.plan_id, p.year_group, count(*) AS more FROM p JOIN (SELECT plan_id, max(size) - sum(least_) AS left_ FROM f GROUP BY plan_id) l ON p.plan_id = l.plan_id AND p.k <= l.left_ GROUP BY p.plan_id, p.year_group),
        s AS (SELECT f.*, least_ + coalesce(more, 0) AS seats, greatest(coalesce(target_share, 0) * size, coalesce(min_papers, 0)) AS need FROM f LEFT JOIN g USING (plan_id, year_group))
        SELECT plan_id, year_group, target_share, seats / nullif(sum(seats) OVER (PARTITION BY plan_id), 0) AS actual_share, min_papers, n AS n_papers, need, CAST(seats AS BIGINT) AS seats, CAST(seats AS BIGINT) AS drawn, need > n AS falls_short FROM s""",
)
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    p, plan = _plan(spark, d)
    return p7_sample.report(p7_sample.draw(p, plan), plan)


# 8 -----------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return p8_leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leak.leaked(_leaks(spark, d)).select("doc_id", "item_id")


@query("p8_leaks")
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


# 9 -----------------------------------------------------------------------------------------------


def _mix(spark: SparkSession, d: str, written: bool = True) -> tuple[DataFrame, DataFrame]:
    counts = p9_mix.token_counts(table(spark, d, "documents"))
    if written:  # tokens are counted once, for the rates and for what is drawn
        counts = durable(counts)
    return counts, p9_mix.rates(counts, table(spark, d, "mix_weights"))


@query(
    "p9_found",
    # any tokenizer gives the same answer; SQL counts the pieces before the merges
    r"""WITH have AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, sum(len(regexp_extract_all(text, ' ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+'))) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
        SELECT w.plan_id, w.source FROM mix_weights w LEFT JOIN have h ON h.source = lower(regexp_replace(w.source, '^\s+|\s+$', '', 'g'))
        WHERE w.target_share * w.total_tokens > w.max_repeats * coalesce(h.n, 0)""",
)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, written=False)[1].filter("falls_short").select("plan_id", "source")


@query("p9_mixture")
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    counts, rate = _mix(spark, d)
    return p9_mix.emit(counts, rate)


@query("p9_report")
def p9_report(spark: SparkSession, d: str) -> DataFrame:
    counts, rate = _mix(spark, d)
    return p9_mix.report(counts, rate)


# 10 ----------------------------------------------------------------------------------------------


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pii.found(table(spark, d, "documents"), table(spark, d, "paper_metadata")).select("doc_id", "pii_kind")


@query("p10_redacted")
def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return p10_pii.redacted(table(spark, d, "documents"), table(spark, d, "paper_metadata"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
