"""The marker phrases of the corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, ELEVATED = "high-confidence", "elevated-frequency"
# fixed values: marker, tier, pattern
MARKERS: tuple[tuple[str, str, str], ...] = (
    ("delve(s) into", HIGH, r"\bdelves?\s+into\b"),
    ("it is worth noting", HIGH, r"\bit\s+is\s+worth\s+noting\b"),
    ("comprehensive overview", HIGH, r"\bcomprehensive\s+overview\b"),
    ("in the realm of", HIGH, r"\bin\s+the\s+realm\s+of\b"),
    ("plays a crucial/pivotal role", HIGH, r"\bplays\s+a\s+(?:crucial|pivotal)\s+role\b"),
    ("noteworthy", HIGH, r"\bnoteworthy\b"),
    ("multifaceted", HIGH, r"\bmultifaceted\b"),
    ("tapestry", HIGH, r"\btapestry\b"),
    ("groundbreaking", HIGH, r"\bgroundbreaking\b"),
    ("paving the way", HIGH, r"\bpaving\s+the\s+way\b"),
    ("has garnered significant/considerable attention", HIGH, r"\bhas\s+garnered\s+(?:significant|considerable)\s+attention\b"),
    ("demonstrated remarkable", HIGH, r"\bdemonstrated\s+remarkable\b"),
    ("leveraging the power", HIGH, r"\bleveraging\s+the\s+power\b"),
    ("intricate", HIGH, r"\bintricate\b"),
    ("underscores", HIGH, r"\bunderscores\b"),
    ("furthermore", ELEVATED, r"\bfurthermore\b"),
    ("moreover", ELEVATED, r"\bmoreover\b"),
    ("additionally", ELEVATED, r"\badditionally\b"),
    ("landscape", ELEVATED, r"\blandscape\b"),
    ("notably", ELEVATED, r"\bnotably\b"),
    ("cutting-edge", ELEVATED, r"\bcutting[\s-]edge\b"),
    ("in recent years", ELEVATED, r"\bin\s+recent\s+years\b"),
    ("a growing body of", ELEVATED, r"\ba\s+growing\s+body\s+of\b"),
    ("shed(s) light on", ELEVATED, r"\bsheds?\s+light\s+on\b"),
)


def marker_columns(clean: str = "text_clean") -> list[Column]:
    """One count per marker, in the order of the list. A marker's pattern runs only over the phrases that
    one pass over the text has picked out: every marker stands alone there, as phrases don't overlap."""
    hits = F.col(clean)
    only = lambda rx: F.filter(hits, lambda h: h.rlike(f"(?i)^{rx}$"))
    return [F.size(only(rx)).cast("bigint").alias(f"_m{i}") for i, (_, _, rx) in enumerate(MARKERS)]


def phrases(clean: str = "text_clean") -> Column:
    """All marker phrases of a text, from one pass."""
    return F.regexp_extract_all(F.col(clean), F.lit("(?i)(?:" + "|".join(rx for _, _, rx in MARKERS) + ")"), 0)


def marker_rows(papers: DataFrame, keys: list[str], clean: str = "text_clean", n_words: str = "n_words") -> DataFrame:
    """Long form: one row per paper and marker, with the rate per 1,000 words. Counts of a paper's parts are
    added before anything is spread into rows."""
    one = papers.select(*keys, F.col(n_words).alias("_n"), phrases(clean).alias("_h"))
    one = one.select(*keys, "_n", *marker_columns("_h")).groupBy(*keys).agg(F.sum("_n").alias("_n"), *[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(MARKERS))])
    every = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(t).alias("tier"), F.col(f"_m{i}").alias("cnt")) for i, (m, t, _) in enumerate(MARKERS)])
    m = one.select(*keys, "_n", F.explode(every).alias("m"))
    return m.select(*keys, "m.marker", "m.tier", "m.cnt", F.try_divide(F.col("m.cnt") * 1000.0, F.col("_n")).alias("per1k"), (F.col("m.cnt") > 0).cast("int").alias("has"))
