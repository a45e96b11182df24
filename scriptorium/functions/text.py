"""Text features as Column expressions; all of them stay inside whole-stage codegen or the JVM.

Undefined values are NULL, never NaN: Spark aggregates skip NULL, and NaN would spread through avg.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = "CITATION"
# fixed values: placeholders of cleaned text
GRAPHICS_RX, REF_RX, CIT_RX = r"<\s*g\s*r\s*a\s*p\s*h\s*i\s*c\s*s\s*>", r"<ref>", r"<cit\.>"
GRAPHICS_LITERAL_RX = r"<graphics>"
# a token is a run of letters and digits, joined by inner hyphens or apostrophes
TOKEN_RX = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
MANIFEST_RX = r"[A-Za-z][A-Za-z0-9'-]*"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x: Column | str) -> Column:
    """Outer white space of any kind, not blanks alone."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normalize_newlines(x: Column | str) -> Column:
    """Byte-order mark dropped, NUL to blank, CRLF and CR to LF."""
    c = F.regexp_replace(_c(x), "^\\ufeff", "")
    return F.regexp_replace(F.translate(c, "\x00", " "), r"\r\n?", "\n")


def clean_text(x: Column | str, literal_graphics: bool = False) -> Column:
    """Placeholders out, citations as one word, white space collapsed. literal_graphics gives
    C23, which knows only the unspaced graphics marker."""
    c = F.regexp_replace(_c(x), GRAPHICS_LITERAL_RX if literal_graphics else GRAPHICS_RX, " ")
    c = F.regexp_replace(c, REF_RX, " ")
    c = F.regexp_replace(c, CIT_RX, f" {CITATION} ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def whitespace_words(x: Column | str) -> Column:
    """X4."""
    return F.regexp_count(_c(x), F.lit(r"\S+")).cast("bigint")


def sentences(clean: Column | str) -> Column:
    """P8, by the end marks and white space after them; blank pieces dropped."""
    return F.filter(F.split(_c(clean), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def words(clean: Column | str) -> Column:
    """Tokens of letters only, without the citation word."""
    return F.filter(F.regexp_extract_all(_c(clean), F.lit(TOKEN_RX), 0), lambda w: w.rlike(r"^\p{L}+$") & (w != CITATION))


def manifest_words(clean: Column | str) -> Column:
    """P10: counts the citation word, unlike P9."""
    return F.regexp_extract_all(_c(clean), F.lit(MANIFEST_RX), 0)


def citation_count(text: Column | str) -> Column:
    """X1, on the original text."""
    return F.regexp_count(_c(text), F.lit(CIT_RX)).cast("bigint")


def paragraph_count(text: Column | str) -> Column:
    """Pieces between blank lines, one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(strip_ws(text), r"\n\s*\n"), lambda p: F.trim(p) != ""))).cast("bigint")


def syllables(word: Column | str) -> Column:
    """Runs of vowels, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(_c(word)), F.lit("[aeiouy]+"))).cast("bigint")


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """X6."""
    return F.lit(206.835) - F.lit(1.015) * F.try_divide(n_words, n_sentences) - F.lit(84.6) * F.try_divide(n_syllables, n_words)


def gunning_fog(n_words: Column, n_sentences: Column, n_complex: Column) -> Column:
    """X7; complex words have three syllables or more."""
    return F.lit(0.4) * (F.try_divide(n_words, n_sentences) + F.lit(100.0) * F.try_divide(n_complex, n_words))


def alpha_ratio(clean: Column | str) -> Column:
    """Letters over non-blank characters; 0 for an empty text."""
    solid = F.length(F.regexp_replace(_c(clean), r"\s+", ""))
    return F.when(solid == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(_c(clean), r"[^\p{L}]+", "")) / solid)


# ------------------------------------------------------------------------------------ passive voice
# fixed values: forms of be, and participles that do not end in -ed
BE = ("am", "is", "are", "was", "were", "be", "been", "being")
PARTICIPLES = (
    "been become begun bent bound bought broken brought built burnt caught chosen come cut dealt done drawn driven eaten fallen fed felt fought found forgotten given gone grown heard held hidden hit hung kept known laid led left lent let lit lost "
    "made meant met paid put read ridden run said sat seen sent set shaken shown shut sold spent split spoken spread stolen stood stuck sung sunk swept sworn taken taught thought thrown told torn understood undertaken won worn woven written"
).split()
PASSIVE_RX = r"(?i)(?<![\p{L}])(?:" + "|".join(BE) + r")(?:\s+[^\s]+){0,2}?\s+(?:\p{L}{2,}ed|" + "|".join(PARTICIPLES) + r")(?![\p{L}])"


def is_passive(sentence: Column | str) -> Column:
    """A form of be with a participle among the three tokens after it. Participles are told by
    ending and list, as no tagger is at hand."""
    return _c(sentence).rlike(PASSIVE_RX)
