"""LaTeX to prose: the cleaning chain as a fold of native replacements, after a library-like pass that
renders accents, citations, references, graphics and simple macros.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values of the cleaning chain: environments and commands, and the patterns of the steps in order
FLOATS = ("figure", "table")
TABULARS = ("tabular", "tabularx", "longtable")
MATH_ENVS = ("equation", "align", "gather", "multline", "eqnarray", "math", "displaymath")
REF_COMMANDS = ("ref", "label", "eqref", "autoref", "pageref", "nameref")
FONT_COMMANDS = ("textbf", "textit", "emph", "textsc", "textrm", "texttt", "textsf", "textsl", "underline", "mbox")
COMMENT_RX = r"(?md)(?<!\\)%.*$"


def _env(names: tuple[str, ...], star: str) -> str:
    one = "(?:" + "|".join(names) + ")" + star
    return rf"(?s)\\begin\{{{one}\}}.*?\\end\{{{one}\}}"


def _steps() -> list[tuple[str, str]]:
    """C2 to C20 in order: (pattern, replacement). White space, digits and word borders are Unicode's."""
    refs, fonts = "|".join(REF_COMMANDS), "|".join(FONT_COMMANDS)
    return [
        (_env(FLOATS, r"\*?"), ""), (_env(TABULARS, ""), ""), (_env(MATH_ENVS, r"\*?"), ""),
        (r"(?s)\\\[.*?\\\]", ""), (r"(?s)\$\$.*?\$\$", ""), (r"(?s)\\\(.*?\\\)", ""), (r"\$[^$]+\$", ""),
        (r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", ""), (rf"\\(?:{refs})\{{[^}}]*\}}", ""), (r"\\caption\*?(?:\[[^\]]*\])?\{[^}]*\}", ""),
        (r"\\footnote\{([^}]*)\}", "$1"), (r"\\href\{[^}]*\}\{([^}]*)\}", "$1"), (r"\\url\{[^}]*\}", ""), (rf"\\(?:{fonts})\{{([^}}]*)\}}", "$1"),
        (r"\\begin\{[^}]*\}", ""), (r"\\end\{[^}]*\}", ""), (r"(?U)\\item\s*(?:\[[^\]]*\])?", ""),
        (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])*(?:\{[^}]*\})*", ""),
        (r"\\([%&#_$])", "$1"), ("~", " "), ("---", "\u2014"), ("--", "\u2013"), (r"[{}]", ""), (r"\\", ""),
        (r"(?U)\bet\s+al\b\.?", ""), (r"(?U)\[\s*[\d,;\s]+\s*\]", ""), (r"(?U)\(\s*\d{4}\s*\)", ""),
        (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (r"(?U)\s+([.,;:!?])", "$1"), (r"(?U)([.,;])\s*\1+", "$1"),
    ]


def strip_comments(text: Column | str) -> Column:
    """From an unescaped % to the end of its line."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, COMMENT_RX, "")


def clean_chain(text: Column | str) -> Column:
    """C2 to C21."""
    c = F.col(text) if isinstance(text, str) else text
    for rx, to in _steps():
        c = F.regexp_replace(c, rx, to)
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


_MARKS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
_ACCENT = re.compile(r"\\([\"'`^~=.])\s*\{?\\?([A-Za-z])\}?|\\([cvuHkr])\s*\{([A-Za-z])\}")
_SYMBOLS = {r"\ss": "ß", r"\ae": "æ", r"\AE": "Æ", r"\oe": "œ", r"\OE": "Œ", r"\o": "ø", r"\O": "Ø", r"\l": "ł", r"\L": "Ł", r"\aa": "å", r"\AA": "Å", r"\ldots": "...", r"\dots": "...", r"\LaTeX": "LaTeX", r"\TeX": "TeX"}
_SYMBOL = re.compile("|".join(re.escape(k) + r"(?![A-Za-z])\s?" for k in sorted(_SYMBOLS, key=len, reverse=True)))


def render_one(text: str | None) -> str | None:
    """C1 for one text."""
    if not text:
        return text
    accent = lambda m: unicodedata.normalize("NFC", (m[2] or m[4]) + _MARKS[m[1] or m[3]])
    t = _ACCENT.sub(accent, text)
    t = re.sub(r"~?\\cite\w*\*?(?:\[[^\]]*\])*\{[^}]*\}", "<cit.>", t)
    t = re.sub(r"\\(?:ref|eqref|autoref|pageref|nameref)\{[^}]*\}", "<ref>", t)
    t = re.sub(r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}", "< g r a p h i c s >", t)
    return _SYMBOL.sub(lambda m: _SYMBOLS[m[0].strip()], t)


@F.pandas_udf(StringType())
def render(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """LaTeX accents, citations, references and graphics as text; a text that can't be read stays."""
    for s in parts:
        yield s.map(render_one)


def clean_latex(text: Column | str) -> Column:
    """C1 and the chain."""
    return clean_chain(render(F.col(text) if isinstance(text, str) else text))
