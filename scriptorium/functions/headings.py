"""Classification of section headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATED, OTHER = "related_work", "other"
DIRECT_METHOD, LLM_METHOD = "latex_parsed", "llm_classified"
# fixed values: headings that decide at once, and rules with their confidence
DIRECT = ("related work", "related works", "literature review", "prior work", "previous work", "related research", "state of the art", "related literature", "survey of related")
RULES: tuple[tuple[str, float], ...] = (
    ("related work", 1.0), ("related works", 1.0), ("literature review", 1.0),
    ("prior work", 0.95), ("previous work", 0.95), ("related research", 0.95),
    ("state of the art", 0.9), ("related literature", 0.9), ("survey of related", 0.9),
    ("background and related", 0.85), ("related studies", 0.85),
    ("existing work", 0.8), ("existing approaches", 0.8), ("prior art", 0.8),
)
PREFIX_RX = r"^(?:\d[\d.]*|[ivx]+\.)\s*"


def _low(h: Column | str) -> Column:
    c = F.col(h) if isinstance(h, str) else h
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def from_heading(h: Column | str) -> Column:
    """related_work if a direct phrase stands in the heading, else other."""
    low = _low(h)
    hit = F.lit(False)
    for k in DIRECT:
        hit = hit | low.contains(k)
    return F.when(hit, RELATED).otherwise(OTHER)


def fuzzy(h: Column | str) -> Column:
    """Confidence of the best rule after a numeric or roman prefix is taken off, null for none."""
    low = F.regexp_replace(_low(h), PREFIX_RX, "")
    return F.greatest(*[F.when(low.contains(k), F.lit(c)) for k, c in RULES])


def classify(h: Column | str, tier3: Column | None = None) -> Column:
    """Direct, then rules, then an optional struct(section_type, confidence) of a model, else other."""
    t1 = F.when(from_heading(h) == RELATED, F.struct(F.lit(RELATED).alias("section_type"), F.lit(1.0).alias("confidence"), F.lit(DIRECT_METHOD).alias("method")))
    f = fuzzy(h)
    t2 = F.when(f.isNotNull(), F.struct(F.lit(RELATED).alias("section_type"), f.alias("confidence"), F.lit(DIRECT_METHOD).alias("method")))
    last = F.struct(F.lit(OTHER).alias("section_type"), F.lit(0.0).alias("confidence"), F.lit(DIRECT_METHOD).alias("method"))
    t3 = [F.when(tier3.isNotNull(), F.struct(tier3["section_type"].alias("section_type"), tier3["confidence"].alias("confidence"), F.lit(LLM_METHOD).alias("method")))] if tier3 is not None else []
    return F.coalesce(t1, t2, *t3, last)


def parse_reply(reply: Column | str) -> Column:
    """A model's JSON reply; bad JSON is other at 0.1, an unknown type other, no reply null."""
    c = F.col(reply) if isinstance(reply, str) else reply
    j = F.from_json(c, "section_type string, confidence double")
    kind = F.when(j["section_type"] == RELATED, RELATED).otherwise(OTHER)
    good = j["section_type"].isNotNull()
    return F.when(c.isNull(), F.lit(None)).when(good, F.struct(kind.alias("section_type"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))).otherwise(F.struct(F.lit(OTHER).alias("section_type"), F.lit(0.1).alias("confidence")))


def safe_filename(h: Column | str) -> Column:
    """PJ5: letters, digits, _ and - kept, white space to _, nothing left is untitled."""
    c = F.col(h) if isinstance(h, str) else h
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s-]", ""), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "_")
    return F.when(F.coalesce(c, F.lit("")) == "", "untitled").otherwise(c)


def section_filename(order: Column, h: Column | str) -> Column:
    return F.concat(F.lpad(order.cast("string"), 2, "0"), F.lit("_"), safe_filename(h), F.lit(".txt"))
