"""Command line: run, related-works, single, convert, metadata, manifest, score."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from scriptorium.operators import corpus as K
from scriptorium.operators import records as R
from scriptorium.operators import sampling as SA
from scriptorium.operators import scoring as SC
from scriptorium.plans import score
from scriptorium.plans.pipeline import Config, Pipeline, convert
from scriptorium.session import get_spark
from scriptorium.sources import files as FS
from scriptorium.sources import metadata as MD
from scriptorium.sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "related-works"):
        s = sub.add_parser(name)
        s.add_argument("--config")
        s.add_argument("--snapshot", help="raw JSON-lines snapshot of the metadata")
        s.add_argument("--cache", help="metadata cache: read if it is there, else written")
        s.add_argument("--oai-url", help="address to harvest where there is neither cache nor snapshot")
        s.add_argument("--start", default="2022-01-01")
        s.add_argument("--end", default="2025-12-31")
        s.add_argument("--sources", help="folder of source trees or archives")
        s.add_argument("--archives", action="store_true")
        s.add_argument("--download-url", help="address of a paper's source, with {id}; what is staged in --sources is not fetched again")
        s.add_argument("--use-llm", help="module:function that builds a client: prompt -> reply")
        s.add_argument("--batch", type=int)
        s.add_argument("--filter-date-start")
        s.add_argument("--filter-date-end")
        s.add_argument("--text-dir")
    s = sub.add_parser("single")
    s.add_argument("id")
    s.add_argument("--sources", required=True)
    s.add_argument("--use-llm")
    s = sub.add_parser("convert")
    s.add_argument("--sources-dir", required=True)
    s.add_argument("--output-dir", required=True)
    s = sub.add_parser("metadata")
    s.add_argument("--source", choices=("snapshot", "xml", "oai"), default="snapshot")
    s.add_argument("--path", help="snapshot file, folder of XML pages, or address to harvest", required=True)
    s.add_argument("--start", default="1991-01-01")
    s.add_argument("--end", default="2100-01-01")
    s.add_argument("--out", required=True)
    s = sub.add_parser("manifest")
    s.add_argument("--corpus", required=True, help="parquet of corpus records")
    s.add_argument("--out", required=True)
    s.add_argument("--min-words", type=int, default=150)
    s.add_argument("--max-quantile", type=float, default=0.99)
    s.add_argument("--min-alpha-ratio", type=float, default=0.55)
    s.add_argument("--strata", type=int, default=10)
    s.add_argument("--samples-per-group", type=int)
    s.add_argument("--seed", type=int, default=42)
    s = sub.add_parser("score")
    s.add_argument("--corpus", required=True, help="parquet of documents (arxiv_id, year_group, filename, text)")
    s.add_argument("--output", required=True)
    s.add_argument("--model", default="ngram", help="ngram, or a model of the transformers library")
    s.add_argument("--max-length", type=int, default=SC.WINDOW)
    s.add_argument("--stride", type=int, default=SC.STRIDE)
    s.add_argument("--batch-size", type=int, default=16)
    s.add_argument("--checkpoint-every", type=int, default=100_000)
    s.add_argument("--doc-only", action="store_true")
    s.add_argument("--limit", type=int, default=0)
    return p


def client(name: str | None):
    """What builds the client named module:function."""
    if not name:
        return None
    module, _, function = name.partition(":")

    def make():
        import importlib

        return getattr(importlib.import_module(module), function)()

    return make


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark()
    if a.command in ("run", "related-works"):
        c = Config.from_yaml(a.config) if a.config else Config()
        c.date_start, c.date_end, c.cap = a.filter_date_start or c.date_start, a.filter_date_end or c.date_end, a.batch or c.cap
        c.text_export, c.related_only = a.text_dir or c.text_export, c.related_only or a.command == "related-works"
        meta = MD.load_metadata(spark, a.cache, a.snapshot, a.start, a.end, c.category, a.oai_url)
        p, available = Pipeline(spark, c, client(a.use_llm)), None
        if a.download_url:
            available = FS.download(spark, p.select(meta), a.download_url, a.sources)
            src = FS.unpack(spark.read.parquet(a.sources).filter("content is not null"))
        else:
            src = FS.load_archives(spark, a.sources) if a.archives else FS.load_sources(spark, a.sources)
        print(p.run(meta, src, available).count(), "records")
    elif a.command == "single":
        p = Pipeline(spark, Config())
        s = p.extract(FS.load_sources(spark, a.sources).filter(F.col("arxiv_id") == a.id))
        s.select("section_order", "heading", F.length("content").alias("chars")).show(100, truncate=False)
        named = R.model_sections(s, client(a.use_llm)) if a.use_llm else s
        R.merge_sections(R.classify_sections(named)).select("section_type", "heading", "confidence", "method", F.length("content").alias("chars")).show(truncate=False)
    elif a.command == "convert":
        convert(spark, FS.load_sources(spark, a.sources_dir), a.output_dir).show()
    elif a.command == "metadata":
        m = MD.load_snapshot(spark, a.path, a.start, a.end) if a.source == "snapshot" else MD.load_xml_pages(spark, a.path) if a.source == "xml" else MD.harvest(spark, a.path, a.start, a.end)
        sinks.write_cache(m, a.out)
    elif a.command == "score":
        t = K.papers(K.corpus_files(spark.read.parquet(a.corpus))).groupBy(*K.PAPER).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "text_clean"))), lambda x: x["text_clean"]), " ").alias("text_clean"))
        print(score.run(spark, t, a.output, SC.make_scorer(a.model, t, a.batch_size), a.max_length, a.stride, a.doc_only, a.limit, a.checkpoint_every), "scored")
    else:
        m = SA.below_quantile(SA.quality_filter(SA.manifest(spark.read.parquet(a.corpus)), a.min_words, a.min_alpha_ratio), q=a.max_quantile)
        sinks.write_csv(SA.balanced_sample(SA.strata(m, a.strata), a.samples_per_group, a.seed).drop("rank"), a.out, "word_stratum", "year_group", "arxiv_id")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
