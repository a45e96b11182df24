"""Problem 1: markup residue becomes clean text that keeps headings, lists, code and formulas.

Method: markup is found and converted by a lexer of the four grammars (HTML, LaTeX, wiki, Markdown).
The suffix array named for this problem finds long runs that pages of a host share; markup in these
data is mostly one short piece that stands once, so no repeated substring shows it, and removing
repeated runs would take content away (README). The suffix array is therefore the second stage,
p1_shared.shared_runs, on the cleaned texts: boilerplate that pages of one host repeat.

The lexer is one alternation of piece patterns, read from left to right; a piece is a tag, entity,
command, environment, formula, link, emphasis, heading, list star, table row, fence and so on.
Structure is kept in plain form: headings as '# text' lines, list items as '- text', code between
four-blank indents, formulas between $ signs, table cells separated by tabs.

Not markup: the corpus placeholders <cit.>, <ref> and < g r a p h i c s >, comparison signs, single
symbols, prices, bracketed numbers, identifiers, and lists that start with a dash, number or letter.

Defined results: null text has no pieces and a null clean text; empty text stays empty; a text
without pieces is returned unchanged; unclosed pieces are dropped and their text kept; equal texts
give equal results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship, spread

HOLD = ("<cit.>", "<ref>", "< g r a p h i c s >", "<graphics>")
PLACEHOLDER = r"<cit\.>|<ref>|<\s?g r a p h i c s\s?>"

# fixed values: names of HTML and wiki elements
TAGS = "a|abbr|b|big|blockquote|body|br|caption|center|cite|code|col|colgroup|dd|del|dfn|div|dl|dt|em|figcaption|figure|font|footer|form|gallery|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|math|meta|mfrac|mi|mn|mo|mrow|msub|msup|nav|noscript|nowiki|ol|option|p|pre|q|references|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|syntaxhighlight|table|tbody|td|textarea|tfoot|th|thead|title|tr|tt|u|ul|var|video|wbr"

PIECES: tuple[tuple[str, str], ...] = (
    ("hold", PLACEHOLDER),
    # blocks whose inside is code or formula
    ("comment", r"<!--(?:(?!<!--).)*?-->"),
    ("htmlcode", r"<(?:pre|syntaxhighlight|script|style)\b[^<>]*>.*?</(?:pre|syntaxhighlight|script|style)\s*>"),
    ("htmlmath", r"<math\b[^<>]*>.*?</math\s*>"),
    ("fence", r"^[ \t]*```[^\n]*\n.*?^[ \t]*```[ \t]*$|```[^`]*```"),
    ("envb", r"\\begin\{(?P<env>equation|align|gather|multline|eqnarray|math|displaymath|lstlisting|verbatim|tabular|figure|table|algorithm)(?P<envs>\*?)\}.*?\\end\{(?P=env)(?P=envs)\}"),
    ("display", r"\$\$[^$]+?\$\$|\\\[(?:(?!\\\[).)+?\\\]"),
    ("inline", r"\\\((?:(?!\\\().)+?\\\)|\$(?=[^\s$])(?=[^$\n]*[\\_^={}(+])[^$\n]+?(?<=[^\s\\])\$(?!\d)"),
    # LaTeX
    ("begin", r"\\(?:begin|end)\s*\{[^{}\n]*\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?"),
    ("cite", r"~?\\(?:no)?cite[A-Za-z]*\*?(?:\[[^\]\n]*\])*\{[^{}]*\}"),
    ("xref", r"~?\(?\\(?:ref|eqref|autoref|pageref|nameref|cref|Cref|label)\{[^{}\n]*\}\)?"),
    ("texlink", r"\\href\s*\{[^{}\n]*\}\s*\{(?P<href>[^{}\n]*)\}|\\url\s*\{[^{}\n]*\}"),
    ("texhead", r"\\(?P<sec>part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?\{(?P<sect>[^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"),
    ("item", r"\\item(?:\[[^\]\n]*\])?[ \t]*"),
    ("accent", r"\{?\\(?P<acc>[\"'`^~=.])\s*\{?(?P<accl>\\?[A-Za-z])\s?\}?\}?|\{?\\(?P<accw>[cHvukr])\s*\{(?P<acclw>[A-Za-z])\}\}?"),
    ("wrap", r"\\(?:text|emph|textbf|textit|texttt|textsc|textrm|textsf|underline|footnote|caption|title|mbox|url|math\w+)[A-Za-z]*\*?\s*\{"),
    ("command", r"\\[A-Za-z@]+\*?(?:\[[^\]\n]*\])?"),
    ("escape", r"\\[%&_#${}~^\\,;:!/ \-|]|\\\\(?:\[[^\]\n]*\])?"),
    ("texquote", r"``(?=\S)[^`'\n]+?''"),
    ("texcomment", r"^[ \t]*%[^\n]*$"),
    ("tie", r"(?<=\w)~(?=[\w\\(])"),
    # wiki
    ("template", r"\{\{[^{}]*\}\}"),
    ("wikitable", r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*|\|\+[^\n]*|!(?!\[)[^\n]*|\|[^\n|][^\n]*\|\|[^\n]*)$"),
    ("wikiimage", r"\[\[(?:Category|File|Image|Kategorie|Datei|Fichier|Archivo)\s*:[^\[\]]*\]\]"),
    ("wikilink", r"\[\[(?:[^\[\]|\n]*\|)?(?P<wl>[^\[\]\n]*)\]\]"),
    ("extlink", r"\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+(?P<xl>[^\]\n]*))?\]"),
    ("magic", r"__[A-Z]{3,}__"),
    ("quotes", r"'{5}|'{3}|''"),
    ("wikihead", r"^[ \t]*(?P<wh>={2,6})[ \t]*(?P<wht>[^=\n][^\n]*?)[ \t]*(?P=wh)[ \t]*$"),
    # Markdown
    ("mdhead", r"^[ \t]{0,3}(?P<mh>#{1,6})[ \t]+(?=\S)"),
    ("setext", r"(?<=\S)\n[ \t]*(?:={3,}|-{3,})[ \t]*$"),
    ("rule", r"^[ \t]*(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|-{3,})$"),
    ("image", r"!\[[^\[\]\n]*\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)"),
    ("mdlink", r"\[(?P<ml>[^\[\]\n]+)\]\((?:[^()\s]*)(?:\s+\"[^\"\n]*\")?\)"),
    ("mdref", r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]*(?:https?://|ftp://|mailto:|<|[/#]|\w+\.\w)\S*(?:[ \t]+\"[^\"\n]*\")?[ \t]*$|^[ \t]{0,3}\[\^[^\]\n]+\]:[ \t]*"),
    ("mdreflink", r"(?<!\w)\[(?!\d+\])(?P<mr>[^\[\]\n]+)\]\[[^\[\]\n]*\](?!\w)"),
    ("mdnote", r"\[\^[^\]\s]+\]"),
    ("mdtable", r"^[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?$|^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("quote", r"^[ \t]{0,3}>[ \t]?"),
    ("star", r"^[ \t]*\*+[ \t]+(?=\S)|^[ \t]*\*+(?=[\[{'])"),
    ("strong", r"\*{2,3}(?=[^\s*])|(?<=[^\s*])\*{2,3}"),
    ("under", r"(?<!\w)_{1,3}(?=[^\W_])(?P<un>[^\n_]+?)(?<=\S)_{1,3}(?!\w)"),
    ("em", r"(?<![\w*])\*(?=[\w\"“(\[])(?P<emi>[^*\n]+?)(?<=[^\s*(])\*(?![\w*])"),
    ("strike", r"~~(?=\S)(?P<st>[^~\n]+?)~~"),
    ("code", r"`(?P<cd>[^`\n]+)`"),
    # HTML and entities last, as the other grammars may stand inside
    ("tag", rf"</?(?i:{TAGS})(?:\s[^<>]*)?/?>|<[A-Za-z][A-Za-z0-9]*\s+[A-Za-z-]+\s*=[^<>]*>|</[A-Za-z][A-Za-z0-9]*\s*>|<(?i:{TAGS})\s(?=[^<>]*<)|</?ref\s[^<>]*>|</ref>"),
    ("entity", r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{1,6}|#[xX][0-9A-Fa-f]{1,6});"),
    ("group", r"\{(?=\\)|(?<=\\)\}"),
)

BEGIN = r"(?=[<\\$~`{}\[!|_'=*#%>&\n(-]|^[ \t])"
_RX: dict[str, re.Pattern] = {}


def lexer() -> re.Pattern:
    if "x" not in _RX:
        # no piece begins with a letter, digit or common punctuation: such positions fail at once
        _RX["x"] = re.compile(BEGIN + "(?:" + "|".join(f"(?P<{n}>{p})" for n, p in PIECES) + ")", re.M | re.S)
    return _RX["x"]


#: A text can hold a piece only if one of these marks stands in it: every piece of the lexer begins with or
#: holds one (tested). Read by the Arrow engine in one pass, without looking behind; the lexer decides.
MARKS = r"(?m)[\\\x60~_*$]|<[A-Za-z!/]|&#?[A-Za-z0-9]+;|\{\{|\[\[|\{\||\|\}|''|\]\(|\]\[|\]:|\[\^|\[\w+://|^[ \t]*[#>%|!]|^[ \t]*==|^[ \t]*:?-"


def marked(text: pa.Array) -> list[bool]:
    """Which texts have a mark besides the placeholders of the corpus. Nulls have none."""
    for x in HOLD:
        text = pc.replace_substring(text, x, "")
    return pc.fill_null(pc.match_substring_regex(text, MARKS), False).to_pylist()


_ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "H": "\u030b", "v": "\u030c", "u": "\u0306", "k": "\u0328", "r": "\u030a"}


def _indent(code: str) -> str:
    return "\n" + "\n".join("    " + x for x in code.strip("\n").split("\n")) + "\n"


def _strip_tags(s: str) -> str:
    return html.unescape(re.sub(r"<[^<>]*>", "", s))


def _cells(s: str) -> str:
    return re.sub(r"\s*(?:\|\||!!|\||!)\s*", "\t", s.strip().strip("|!").strip())


def _convert(m: re.Match) -> str:
    k, s = m.lastgroup, m[0]
    if k == "hold":
        return s
    if k in ("comment", "texcomment", "magic", "wikiimage", "template", "xref", "rule", "mdnote"):
        return ""
    if k == "cite":
        return " <cit.>" if s.startswith("~") else "<cit.>"
    if k == "htmlcode":
        return "" if re.match(r"<(script|style)", s) else _indent(_strip_tags(s))
    if k == "htmlmath":
        return "$" + _strip_tags(s) + "$"
    if k == "fence":
        return _indent(re.sub(r"^[ \t]*```[^\n]*\n?|\n?[ \t]*```[ \t]*$", "", s))
    if k == "envb":
        body = re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?|\\end\{[^}]*\}$", "", s)
        e = m["env"]
        if e in ("lstlisting", "verbatim", "algorithm"):
            return _indent(body)
        if e == "tabular":
            return re.sub(r"\s*&\s*", "\t", re.sub(r"\s*\\\\\s*(?:\\hline)?\s*", "\n", body)).strip()
        if e in ("figure", "table"):
            cap = re.search(r"\\caption\{([^{}]*)\}", body)
            return cap[1] if cap else ""
        return f"${body.strip()}$"
    if k == "display":
        return f"${s[2:-2].strip()}$"
    if k == "inline":
        return f"${s[2:-2].strip()}$" if s.startswith("\\") else s
    if k == "texlink":
        return m["href"] or ""
    if k == "texhead":
        return f"# {m['sect'].strip()}\n" if "section" in m["sec"] or m["sec"] in ("part", "chapter") else m["sect"]
    if k == "item":
        return "- "
    if k == "accent":
        a, letter = (m["acc"], m["accl"]) if m["acc"] else (m["accw"], m["acclw"])
        import unicodedata

        return unicodedata.normalize("NFC", letter.lstrip("\\") + _ACCENTS.get(a, ""))
    if k == "escape":
        return {"\\\\": "\n", "\\,": "", "\\ ": " ", "\\;": " ", "\\:": " ", "\\!": "", "\\/": "", "\\-": ""}.get(s, s[1:] if len(s) == 2 else "\n")
    if k == "texquote":
        return "“" + s[2:-2] + "”"
    if k == "tie":
        return " "
    if k == "wikitable":
        return "" if re.match(r"\s*(?:\{\||\|\}|\|-)", s) else _cells(s)
    if k == "wikilink":
        return m["wl"]
    if k == "extlink":
        return m["xl"] or ""
    if k == "wikihead":
        return f"# {m['wht']}"
    if k == "mdhead":
        return "# "
    if k in ("setext", "image"):
        return ""
    if k == "mdlink":
        return m["ml"]
    if k == "mdref":
        return ""
    if k == "mdreflink":
        return m["mr"]
    if k == "mdtable":
        return "" if re.fullmatch(r"[\s|:\-]+", s) else _cells(s)
    if k == "star":
        return "- "
    for n, inner in (("under", "un"), ("em", "emi"), ("strike", "st"), ("code", "cd")):
        if k == n:
            return m[inner]
    if k == "tag":
        t = re.match(r"</?\s*([A-Za-z0-9]+)", s)
        name, closing = t[1].lower(), s.startswith("</")
        if re.fullmatch(r"h[1-6]", name):
            return "\n" if closing else "\n# "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("p", "div", "br", "hr", "tr", "table", "ul", "ol", "blockquote", "section"):
            return "\n"
        if name in ("td", "th"):
            return "" if closing else "\t"
        return ""
    if k == "entity":
        return html.unescape(s)
    return ""  # commands, wrappers, quotes, strong marks, groups


def clean(text: str) -> tuple[str, int]:
    """(clean text, pieces). Pieces may stand in pieces (an escaped tag, emphasis in a link): the text
    is read again until nothing changes; formulas and code are not read again."""
    rx = lexer()
    pieces, before = 0, 0
    while True:
        n = 0

        def one(m: re.Match) -> str:
            nonlocal n
            out = _convert(m)
            if out != m[0]:
                n += 1
            return out

        kept = sum(1 for m in rx.finditer(text) if m.lastgroup == "inline") if not pieces else 0
        text2 = rx.sub(one, text)
        pieces += n + kept
        # a round takes a level of nesting off: neither the text nor its pieces may grow without end
        if text2 == text or (before and n >= before and len(text2) >= len(text)):
            break
        text, before = text2, n
    if pieces:
        text = re.sub(r"(?<=\S)\}(?!\S)|\{(?=\w+\s)", "", text) if "{" in text or "}" in text else text
        text = re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\S)[ ]{2,}", " ", text))
        text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text, pieces


def has_piece(text: str) -> bool:
    return any(m.lastgroup != "hold" for m in lexer().finditer(text))


def _run(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = marked(b["_text"])
            if with_text:
                got = [clean(t.as_py()) if h else (None, 0) for t, h in zip(b["_text"], hit)]
                out = [c if h else t.as_py() for t, h, (c, _) in zip(b["_text"], hit, got)]
                yield pa.RecordBatch.from_arrays([b["field"], b["row_id"], pa.array([k for _, k in got], pa.int32()), pa.array(out, pa.string())], names=["field", "row_id", "pieces", "clean"])
                continue
            some = b.filter(pa.array(hit, pa.bool_()))
            n = [sum(1 for m in lexer().finditer(t) if m.lastgroup != "hold") for t in some["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([some["field"], some["row_id"], pa.array(n, pa.int32())], names=["field", "row_id", "pieces"])

    return run


def stacked(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    out = None
    for df, field, key, text in parts:
        d = spread(df.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("_text")))
        out = d if out is None else out.unionByName(d)
    return out


def pieces(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(field, row_id, pieces) of the rows that hold markup. One scan, no shuffle."""
    d = stacked(parts).filter(F.length("_text") > 0)
    ship(d.sparkSession)
    return d.mapInArrow(_run(False), "field string, row_id bigint, pieces int").filter("pieces > 0")


def cleaned(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(field, row_id, pieces, clean) of every row: converted where it holds markup, as stored otherwise."""
    d = stacked(parts)
    ship(d.sparkSession)
    return d.mapInArrow(_run(True), "field string, row_id bigint, pieces int, clean string")
