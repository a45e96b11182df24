"""Filters, projections, joins and merges on metadata, progress and records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions import headings as H
from scriptorium.schemas import NO_SOURCE, RETRY_STATUSES, STATUSES
from scriptorium.session import durable, ship


def in_category(categories: Column, prefix: str = "cs") -> Column:
    """any category starts with the prefix and a dot."""
    return F.exists(categories, lambda c: c.startswith(f"{prefix}."))


def by_date(papers: DataFrame, start: str | None = None, end: str | None = None, column: str = "published") -> DataFrame:
    """inclusive, on the first ten characters as text; either bound may be missing. A null date is kept
    only without bounds."""
    d = F.substring(column, 1, 10)
    if start:
        papers = papers.filter(d >= start)
    return papers.filter(d <= end) if end else papers


def published_window(snapshot: DataFrame, start: str, end: str) -> DataFrame:
    """the first version's time between both midnights, so that most of the last day is outside;
    papers without a version or with an unreadable date are dropped."""
    raw = F.try_element_at(F.transform("versions", lambda v: v["created"]), F.lit(1))
    ts = F.try_to_timestamp(F.regexp_replace(raw, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return snapshot.withColumn("published_ts", ts).filter(F.col("published_ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def latest_status(log: DataFrame, id_col: str = "arxiv_id") -> DataFrame:
    """Last status of each paper; both id writings are one, ties of time go to the larger log id.
    The pick is a partial aggregation, not a window, so a hot paper is combined before the shuffle."""
    from scriptorium.operators.corpus import canonical_id

    return log.filter(F.col(id_col).isNotNull() & F.col("status").isNotNull()).groupBy(canonical_id(id_col).alias("arxiv_id")).agg(F.max_by("status", F.struct("logged_at", "log_id")).alias("status"), F.count(F.lit(1)).alias("n_events"))


def unknown_statuses(log: DataFrame) -> DataFrame:
    """D7 check: statuses outside the list, counted."""
    return log.filter(~F.col("status").isin(*STATUSES, NO_SOURCE)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def to_process(papers: DataFrame, progress: DataFrame) -> DataFrame:
    """Papers that were never tried, or stopped while pending or downloaded."""
    done = progress.filter(~F.col("status").isin(*RETRY_STATUSES)).select("arxiv_id")
    return papers.join(done, "arxiv_id", "left_anti")


def with_source(papers: DataFrame, availability: DataFrame) -> DataFrame:
    """Papers whose source is at hand; availability is (arxiv_id, has_source)."""
    return papers.join(availability.filter("has_source").select("arxiv_id"), "arxiv_id", "left_semi")


def source_misses(availability: DataFrame) -> DataFrame:
    """Progress rows of the papers without a source."""
    return availability.filter(~F.col("has_source")).select("arxiv_id", F.lit(NO_SOURCE).alias("status"))


def run_cap(papers: DataFrame, n: int) -> DataFrame:
    """L4: the first n in order of id; the cap is the feature."""
    return papers.orderBy("arxiv_id").limit(n)


def merge_records(existing: DataFrame, new: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """New records replace old ones of the same key; repeated rows within new stay."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest_records(records: DataFrame, key: Column, order: Column) -> DataFrame:
    """One record per key, the one that comes last in order. Whole rows are compared inside a partial
    aggregation; a hot key is combined before the shuffle."""
    g = records.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*records.columns), order).alias("_r"))
    return g.select("_r.*")


def left_metrics(papers: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics beside papers. A key that stands in the metrics more than once is an error when the
    rows are read, as it would multiply papers; rows that are the same in all columns are one."""
    cols = [c for c in metrics.columns if c not in keys]
    one = metrics.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("_lo"), F.max(F.struct(*cols)).alias("_hi"))
    checked = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col("_lo")).otherwise(F.raise_error(F.concat(F.lit("metrics with several rows for "), F.concat_ws(", ", *keys))).cast(one.schema["_lo"].dataType))
    right = one.select(*keys, checked.alias("_m")).select(*keys, *[F.col("_m")[c].alias(c) for c in cols])
    return papers.join(right, keys, "left")


def manifest_texts(manifest: DataFrame, papers: DataFrame) -> DataFrame:
    """J9 and SC13: the texts of manifest rows, by paper and cohort."""
    return manifest.join(papers, ["arxiv_id", "year_group"])


def missing_scores(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """J5 and F12 on a composite key."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


# ----------------------------------------------------------------------------- author projections


def parse_author_lines(s: Column) -> Column:
    """PJ2: one author per line, cut at the first bracket, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(F.split(F.trim(x), r"\(")[0])), lambda x: x != "")


def parse_author_parts(a: Column) -> Column:
    """PJ3: [last, first, ...] becomes 'first last'; fewer than two parts give nothing."""
    names = F.transform(F.filter(a, lambda p: F.size(p) >= 2), lambda p: F.trim(F.concat_ws(" ", F.trim(p[1]), F.trim(p[0]))))
    return F.filter(names, lambda n: n != "")


def non_blank(x: Column) -> Column:
    """PJ4."""
    return F.nullif(F.trim(x), F.lit(""))


# ------------------------------------------------------------------------------ sections to record


def classify_sections(sections: DataFrame, heading: str = "heading") -> DataFrame:
    """X22 for section rows; a column model_reply, where there is one, is the third tier."""
    tier3 = H.parse_reply("model_reply") if "model_reply" in sections.columns else None
    return sections.withColumn("_c", H.classify(F.coalesce(F.col(heading), F.lit("")), tier3)).select("*", "_c.section_type", "_c.confidence", "_c.method").drop("_c", "model_reply")


def prompt(heading: str | None, content: str | None, sample: int = 500) -> str:
    """What a model is asked about a section."""
    return (
        "Tell whether this section of a scholarly paper discusses related work.\n"
        f"Heading: {heading or ''}\nBegin of the text: {(content or '')[:sample]}\n"
        'Answer with JSON alone: {"section_type": "related_work" or "other", "confidence": a number from 0 to 1}'
    )


def model_sections(sections: DataFrame, make: Callable[[], Callable[[str], str]], max_calls: int = 10_000, key: str = "section_id") -> DataFrame:
    """The sections with a model's reply (model_reply) where the rules leave them open, for at most
    max_calls of them in order of (paper, key); the cap on cost is the feature. make builds the client once per
    Python worker; a call that fails leaves no reply, so the section stays other."""
    h = F.coalesce(F.col("heading"), F.lit(""))
    ship(sections.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for b in batches:
            out = []
            for x, y in zip(b["heading"].to_pylist(), b["content"].to_pylist()):
                try:
                    out.append(call(prompt(x, y)))
                except Exception:  # noqa: BLE001  a client may fail in any way
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b["arxiv_id"], b[key], pa.array(out, pa.string())], names=["arxiv_id", key, "model_reply"])

    open_ = sections.filter((H.from_heading(h) != H.RELATED) & H.fuzzy(h).isNull()).orderBy("arxiv_id", key).limit(max_calls)
    kind = sections.schema[key].dataType.simpleString()
    replies = durable(open_.select("arxiv_id", key, "heading", "content").mapInArrow(ask, f"arxiv_id string, {key} {kind}, model_reply string"))
    return sections.join(replies, ["arxiv_id", key], "left")


def merge_sections(classified: DataFrame, key: str = "arxiv_id", order: str = "section_order", part_chars: int = 64_000_000) -> DataFrame:
    """Sections of one type become one: contents joined in order, lowest confidence, heading and
    method of the first. Like papers, a type beyond part_chars comes in parts."""
    d = classified.withColumn("content", F.coalesce("content", F.lit("")))
    sums = d.groupBy(key, "section_type", order).agg(F.sum(F.length("content") + 2).alias("_len"))
    w = Window.partitionBy(key, "section_type").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(F.col(key).alias("_k"), F.col("section_type").alias("_t"), F.col(order).alias("_o"), F.floor(F.coalesce(F.sum("_len").over(w), F.lit(0)) / part_chars).cast("bigint").alias("part_no"))
    d = d.join(parts, d[key].eqNullSafe(parts["_k"]) & (d["section_type"] == parts["_t"]) & d[order].eqNullSafe(parts["_o"]))
    pos = F.struct(order, "section_id")
    g = d.groupBy(key, "section_type", "part_no").agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("section_id").alias("i"), F.col("content").alias("c")))).alias("_c"),
        F.min("confidence").alias("confidence"), F.min_by("heading", pos).alias("heading"), F.min_by("method", pos).alias("method"), F.min(order).alias("first_order"), F.count(F.lit(1)).alias("n_sections"),
    )
    return g.select(key, "section_type", "part_no", "heading", F.array_join(F.transform("_c", lambda x: x["c"]), "\n\n").alias("content"), "confidence", "method", "first_order", "n_sections")


def build_records(meta: DataFrame, merged: DataFrame, raw_counts: DataFrame) -> DataFrame:
    """PJ1: metadata with the merged sections as records of the output schema. A paper whose related work
    comes in parts has a record of each part (part_no); what else a record says is of the whole paper."""
    related = F.col("section_type") == H.RELATED
    found = merged.groupBy("arxiv_id").agg(
        F.max(related & (F.col("content") != "")).alias("_ok"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part_no") == 0, F.struct("first_order", "section_type")))), lambda x: x["section_type"]), ", ").alias("_found"),
    )
    rw = merged.filter(related).select("arxiv_id", "part_no", F.col("content").alias("_rw"))
    j = meta.join(found, "arxiv_id", "left").join(rw, "arxiv_id", "left").join(raw_counts, "arxiv_id", "left")
    text = F.coalesce("_rw", F.lit(""))
    return j.select(
        "arxiv_id", "title", F.array_join("authors", "; ").alias("authors"), F.array_join("categories", ", ").alias("categories"), "primary_category", "published", "updated", "abstract",
        text.alias("related_work"), F.lit("latex_parsed").alias("extraction_method"), F.coalesce("_ok", F.lit(False)).alias("extraction_success"), F.coalesce("_found", F.lit("")).alias("sections_found"), F.coalesce("raw_section_count", F.lit(0)).cast("int").alias("raw_section_count"),
        F.coalesce("part_no", F.lit(0)).cast("bigint").alias("part_no"),
    )
