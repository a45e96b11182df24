"""Schemas of the data model. Ids are always strings: inference would read 1408.2103 as a number."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_LIST = T.ArrayType(T.StringType())

PAPER_METADATA = T.StructType([*_s("arxiv_id", "title"), T.StructField("authors", _LIST), T.StructField("categories", _LIST), *_s("primary_category", "published", "updated", "abstract", "doi")])
RAW_SECTION = T.StructType([*_s("heading", "content"), T.StructField("order", T.IntegerType())])
PAPER_RECORD = T.StructType(
    [
        *_s("arxiv_id", "title", "authors", "categories", "primary_category", "published", "updated", "abstract", "related_work", "extraction_method"),
        T.StructField("extraction_success", T.BooleanType()),
        *_s("sections_found"),
        T.StructField("raw_section_count", T.IntegerType()),
        T.StructField("part_no", T.LongType()),
    ]
)
PROGRESS = T.StructType(_s("arxiv_id", "status"))
SNAPSHOT = T.StructType(
    [
        *_s("id", "title", "abstract", "categories", "doi", "update_date"),
        T.StructField("authors_parsed", T.ArrayType(_LIST)),
        T.StructField("versions", T.ArrayType(T.StructType(_s("version", "created")))),
    ]
)
PERPLEXITY = T.StructType([*_s("arxiv_id", "year_group"), *[T.StructField(n, T.DoubleType()) for n in ("perplexity", "log_perplexity", "burstiness_std", "burstiness_cv")]])
RATIO = T.StructType([*_s("arxiv_id", "year_group"), *[T.StructField(n, T.DoubleType()) for n in ("base_log_ppl", "instruct_log_ppl", "binoculars_score")]])

SECTION_TYPES = ("related_work", "other")
EXTRACTION_METHODS = ("latex_parsed", "pdf_extracted", "llm_classified")
STATUSES = ("pending", "downloaded", "parsed", "failed_download", "failed_parse", "completed")
NO_SOURCE = "no_latex_source"
RETRY_STATUSES = ("downloaded", "pending")
