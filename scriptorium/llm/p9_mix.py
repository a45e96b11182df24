"""Problem 9: a mixture of sources with target shares of the tokens.

Method: tokens are summed per source; a source's repetition rate is its token target over its
tokens, at most max_repeats; every document is emitted floor(rate) times and once more with the
probability of the fraction, decided by a seeded hash of its key.

Defined results: case and outer blanks of a source are ignored; a null or blank source is no source;
null and empty texts have 0 tokens and are emitted like others of their source; a plan row whose
source has no documents emits nothing and is reported as short; target_share or total_tokens null
counts as 0, max_repeats null as 1; repeated texts under different keys are different documents;
a source named twice in one plan is added up (shares summed, the larger max_repeats).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the public pre-tokenization pattern that belongs to the byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENC: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file; loaded once per Python worker."""
    if path not in _ENC:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _ENC[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENC[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], b["_source"], pa.array(n, pa.int64())], names=["_key", "_source", "tokens"])

    return run


def source_key(c):
    """Sources differ neither by case nor by outer white space."""
    return F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, source, tokens) of every document that has a source."""
    ship(docs.sparkSession)
    d = docs.select(F.col(key).cast("bigint").alias("_key"), source_key(F.col(source)).alias("_source"), F.col(text).alias("_text")).filter("_source is not null")
    return spread(d).mapInArrow(_count(tokenizer), "_key bigint, _source string, tokens bigint").select(F.col("_key").alias(key), F.col("_source").alias("source"), "tokens")


def plan_rows(weights: DataFrame) -> DataFrame:
    return (
        weights.filter(source_key(F.col("source")).isNotNull())
        .groupBy("plan_id", source_key(F.col("source")).alias("_source"))
        .agg(
            F.min("source").alias("source"),
            F.max(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"),
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        )
    )


def rates(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Per plan row: target, tokens at hand, repetition rate and whether the source falls short.
    Token sums are combined before the shuffle; what is joined has one row per source."""
    have = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("tokens").alias("have_tokens"), F.count(F.lit(1)).alias("n_docs"))
    p = plan_rows(weights).join(have, "_source", "left").na.fill(0, ["have_tokens", "n_docs"])
    want = F.col("target_share") * F.col("total_tokens")
    most = F.col("max_repeats") * F.col("have_tokens")
    return p.select(
        "plan_id", "source", "_source", "target_share", "total_tokens", "max_repeats", "have_tokens", "n_docs",
        want.alias("target_tokens"),
        F.when(F.col("have_tokens") > 0, F.least(want / F.col("have_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0).alias("rate"),
        (want > most).alias("falls_short"),
    )


def emit(counts: DataFrame, rate: DataFrame, key: str = "doc_id", seed: int = 20) -> DataFrame:
    """(plan_id, key, source, copy_no, tokens), one row per copy. The plan rows are a stated table of
    plans x sources, so they are broadcast; no document is shuffled."""
    r = rate.select("plan_id", F.col("_source").alias("source"), "rate").filter("rate > 0")
    d = counts.join(F.broadcast(r), "source")
    u = F.pmod(F.xxhash64(F.col(key), F.col("plan_id"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    copies = F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("bigint")
    d = d.withColumn("_n", copies).filter("_n > 0").select("plan_id", key, "source", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), "tokens")
    return d.withColumn("copy_no", F.col("copy_no").cast("int"))


def report(counts: DataFrame, rate: DataFrame, key: str = "doc_id", seed: int = 20) -> DataFrame:
    """Actual tokens and shares of every plan row beside its target."""
    got = emit(counts, rate, key, seed).groupBy("plan_id", F.col("source").alias("_source")).agg(F.sum("tokens").alias("actual_tokens"), F.count(F.lit(1)).alias("copies"))
    r = rate.join(got, ["plan_id", "_source"], "left").na.fill(0, ["actual_tokens", "copies"])
    total = r.groupBy("plan_id").agg(F.sum("actual_tokens").alias("plan_tokens"))
    return r.join(total, "plan_id").select(
        "plan_id", "source", "target_share", F.try_divide(F.col("actual_tokens"), F.col("plan_tokens")).alias("actual_share"),
        "target_tokens", "actual_tokens", "have_tokens", "max_repeats", "rate", "copies", "falls_short",
    )
