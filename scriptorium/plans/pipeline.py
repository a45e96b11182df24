"""Extraction as one lazy plan: metadata -> filters -> sections -> records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import markup as M
from scriptorium.operators import parse as P
from scriptorium.operators import records as R
from scriptorium.schemas import PAPER_RECORD
from scriptorium.session import durable
from scriptorium.sources import files as FS
from scriptorium.sources import metadata as MD
from scriptorium.sources import sinks


@dataclass
class Config:
    """The settings that are read."""

    category: str = "cs"
    date_start: str | None = None
    date_end: str | None = None
    cap: int | None = None
    output: str = "output/records.parquet"
    progress: str = "output/progress.parquet"
    text_export: str | None = None
    related_only: bool = False
    compression: str = "snappy"
    max_model_calls: int = 10_000
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Config:
        known = {f.name for f in fields(cls)} - {"extra"}
        return cls(**{k: v for k, v in d.items() if k in known}, extra={k: v for k, v in d.items() if k not in known})

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.from_dict(yaml.safe_load(f) or {})


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config, client: Callable[[], Callable[[str], str]] | None = None):
        """client: builds, in each worker, what answers a prompt."""
        self.spark, self.c, self.client = spark, config, client

    def select(self, meta: DataFrame, availability: DataFrame | None = None) -> DataFrame:
        """Resume, category, date, availability and cap: cheap filters first, all of them joins or predicates."""
        m = R.to_process(meta, FS.progress(self.spark, self.c.progress))
        m = R.by_date(m.filter(R.in_category(F.col("categories"), self.c.category)), self.c.date_start, self.c.date_end)
        if availability is not None:
            m = R.with_source(m, availability)
        return R.run_cap(m, self.c.cap) if self.c.cap else m

    def extract(self, sources: DataFrame) -> DataFrame:
        """Files (arxiv_id, path, text) to cleaned sections."""
        s = P.sections(P.assemble(sources))
        return s.select("arxiv_id", F.col("order").alias("section_order"), F.col("order").cast("bigint").alias("section_id"), "heading", M.clean_latex("content").alias("content")).filter("content <> ''")

    def records(self, meta: DataFrame, sections: DataFrame) -> DataFrame:
        """Classify, merge and flatten to the output schema; with a model client, it decides what the rules leave."""
        named = R.model_sections(sections, self.client, self.c.max_model_calls) if self.client else sections
        merged = R.merge_sections(R.classify_sections(named))
        counts = sections.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("raw_section_count"))
        return R.build_records(meta, merged, counts).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PAPER_RECORD.fields])

    def run(self, meta: DataFrame, sources: DataFrame, availability: DataFrame | None = None) -> DataFrame:
        """I6 and SK1: process what is due, merge into the output, note progress; returns the new records."""
        todo = self.select(meta, availability)
        sections = self.extract(sources.join(todo.select("arxiv_id"), "arxiv_id", "left_semi"))
        new = self.records(todo, sections)
        # the merged output is a new version beside the old one; readers take the newest complete version, so a
        # crash at any point leaves the last one as it was
        version = MD.next_version(self.spark, self.c.output)
        new = durable(new)
        sinks.write_records(R.merge_records(FS.existing_records(self.spark, self.c.output), new), version, self.c.compression)
        sinks.write_progress(new.filter("part_no = 0").select("arxiv_id", F.when(F.col("raw_section_count") > 0, "completed").otherwise("failed_parse").alias("status")), self.c.progress)
        if self.c.text_export:
            sinks.export_text(sinks.section_table(R.merge_sections(R.classify_sections(sections)).withColumnRenamed("first_order", "section_order"), self.c.related_only), self.c.text_export)
        return new


def convert(spark: SparkSession, sources: DataFrame, out: str, done: DataFrame | None = None) -> DataFrame:
    """SK4 and SK5: unmerged sections of papers without text, exported; returns counts per status."""
    todo = sinks.not_exported(sources, done) if done is not None else sources
    s = Pipeline(spark, Config()).extract(todo).withColumn("section_type", F.lit("other"))
    sinks.export_text(sinks.section_table(s), out)
    got = s.select("arxiv_id").distinct().withColumn("ok", F.lit(True))
    all_ = sources.select("arxiv_id").distinct()
    skipped = done.select("arxiv_id").distinct().withColumn("skip", F.lit(True)) if done is not None else all_.limit(0).withColumn("skip", F.lit(True))
    st = all_.join(got, "arxiv_id", "left").join(skipped, "arxiv_id", "left")
    return st.groupBy(F.when(F.col("skip"), "skipped").when(F.col("ok"), "succeeded").otherwise("failed").alias("status")).count()
