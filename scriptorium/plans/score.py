"""M9: scoring a corpus in blocks, resumable: finished blocks stand in <out>.partial and are not scored again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import records as R
from scriptorium.operators import scoring as SC
from scriptorium.sources import sinks
from scriptorium.sources.metadata import exists, filesystem

KEYS = ["arxiv_id", "year_group"]


def run(spark: SparkSession, texts: DataFrame, out: str, make: Callable[[], SC.Scorer], size: int = SC.WINDOW, stride: int = SC.STRIDE, doc_only: bool = False, limit: int = 0, block_rows: int = 100_000) -> int:
    """Score texts (arxiv_id, year_group, text_clean) into the CSV folder out; returns the rows written. limit takes
    the first rows in order of the keys (L5, 0 for all). An output that is there is left as it is."""
    if exists(spark, out):
        return 0
    partial = out.rstrip("/") + ".partial"
    work = texts.select(*KEYS, "text_clean")
    if limit:
        work = work.orderBy(*KEYS).limit(limit)
    kinds = work.schema
    read = lambda: spark.read.option("header", True).csv(partial, schema=", ".join(f"{k} {kinds[k].dataType.simpleString()}" for k in KEYS) + f", {SC.SCORE}")
    todo = R.missing_scores(work, read(), KEYS) if exists(spark, partial) else work
    n = todo.count()
    blocks = max(1, -(-n // block_rows))
    for k in range(blocks if n else 0):
        part = todo.filter(F.pmod(F.xxhash64(*KEYS), F.lit(blocks)) == k) if blocks > 1 else todo
        sinks.append_scores(SC.score(part, make, KEYS, size, stride, doc_only), partial)
    if not exists(spark, partial):
        SC.score(work, make, KEYS, size, stride, doc_only).write.option("header", True).csv(out)
        return 0
    # the finished scores get their name in one step
    (src, fs), (dst, _) = filesystem(spark, partial), filesystem(spark, out)
    if not fs.rename(src, dst):
        raise OSError(f"cannot rename {partial} to {out}")
    return n
