"""Writers."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.functions import headings as H


def write_records(records: DataFrame, path: str, compression: str = "snappy") -> None:
    """SK1."""
    records.write.mode("overwrite").option("compression", compression).parquet(path)


def append_batch(records: DataFrame, path: str, batch_id: int) -> None:
    """SK2: each batch in its own partition; a repeated batch replaces itself, nothing else is rewritten."""
    records.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def section_table(sections: DataFrame, related_only: bool = False) -> DataFrame:
    """SK3 and F11: (arxiv_id, section_order, filename, content)."""
    s = sections.filter(F.col("section_type") == H.RELATED) if related_only else sections
    return s.select("arxiv_id", "section_order", H.section_filename(F.col("section_order"), F.coalesce("heading", F.lit(""))).alias("filename"), "content")


def export_text(table: DataFrame, base: str) -> None:
    """SK3 as one file per row, written where the tasks run; base must be a shared folder."""

    def write(rows: Iterator[Row]) -> None:
        for r in rows:
            folder = os.path.join(base, *str(r.arxiv_id).split("/"))
            os.makedirs(folder, exist_ok=True)
            tmp = os.path.join(folder, f".{r.filename}.{os.getpid()}")
            with open(tmp, "w", encoding="utf-8") as f:
                f.write(r.content or "")
            os.replace(tmp, os.path.join(folder, r.filename))

    table.foreachPartition(write)


def not_exported(papers: DataFrame, done: DataFrame) -> DataFrame:
    """SK5: papers that have no text yet."""
    return papers.join(done.select("arxiv_id").distinct(), "arxiv_id", "left_anti")


def write_cache(meta: DataFrame, path: str) -> None:
    """SK6."""
    meta.write.mode("overwrite").json(path)


def write_progress(progress: DataFrame, path: str) -> None:
    """SK7: appended; readers take the latest row of a paper."""
    progress.write.mode("append").parquet(path)


METRIC_COLUMNS = (
    "arxiv_id year_group n_files n_words n_sentences n_syllables mean_sentence_length median_sentence_length ttr mattr hapax_ratio flesch fog passive_ratio n_citations n_paragraphs cit_per_sentence cit_per_100_words".split()
)
OPTIONAL_COLUMNS = "log_perplexity perplexity burstiness_std burstiness_cv base_log_ppl instruct_log_ppl binoculars_score".split()


def metric_export(df: DataFrame) -> DataFrame:
    """SK8: the fixed columns, and the optional ones that are there."""
    return df.select(*[c for c in METRIC_COLUMNS if c in df.columns], *[c for c in OPTIONAL_COLUMNS if c in df.columns])


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """SK8 and SK9: with a header; sorted by range where an order is asked for, so no single task gets all."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def append_scores(scores: DataFrame, path: str) -> None:
    """SK10: partial results are appended; J5 leaves out on resumption what is there."""
    scores.write.mode("append").option("header", True).csv(path)
