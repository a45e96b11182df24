"""Citation contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: verbs of the verb-led pattern, and the patterns in order of precedence
VERBS = "proposed introduced shown described presented discussed studied demonstrated developed designed explored investigated".split()
LIST_RX = r"CITATION\s*[,;]\s*$"
AUTHOR_RX = r"(?:et\s+al\.|[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?)\s*$"
VERB_RX = r"(?i)\b(?:" + "|".join(VERBS) + r")\s+(?:by|in)\s*$"
PATTERNS = ("list_style", "author_named", "verb_led", "parenthetical")
BEFORE = 80


def pieces(text: Column | str) -> Column:
    """The text between citation markers."""
    return F.split(F.col(text) if isinstance(text, str) else text, r"<cit\.>")


def contexts(parts: Column) -> Column:
    """The BEFORE characters before each citation marker, earlier markers as words. parts must be a column
    that holds pieces(text): inside the lambda an expression would be evaluated for every citation."""
    n = F.size(parts)
    one = lambda i: F.regexp_replace(F.right(F.array_join(F.slice(parts, F.greatest(F.lit(1), i - 20), F.least(i, F.lit(21))), "<cit.>"), F.lit(BEFORE)), r"<cit\.>", "CITATION")
    # a context of 80 characters holds at most 13 earlier markers of 6 characters each
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), one)).otherwise(F.array().cast("array<string>"))


def pattern(context: Column) -> Column:
    """The first pattern that fits."""
    c = F.regexp_replace(context, r"(?U)^\s+|\s+$", "")
    return F.when(c.rlike(LIST_RX), "list_style").when(c.rlike(AUTHOR_RX), "author_named").when(c.rlike(VERB_RX), "verb_led").otherwise("parenthetical")
