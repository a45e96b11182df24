"""Problem 4: text quality statistics and a verdict whether a text is natural prose.

Method: of every text four distributions are taken (character classes; function words of each
language, other words, numbers and symbols; kinds of lines; word lengths) and compared with structural profiles
through Jensen-Shannon divergence. The text gets the nearest profile; a profile belongs to prose or
to something else (table, listing, log, contents, references, keywords, encoded bytes, symbols,
navigation, filler, scrambled letters). Basic counts stand beside it. The profiles are computed at
import from short specimens, written or generated below, by the same code that measures the texts.

Defined results: null and empty texts, and texts of white space alone, give no row in the verdicts
and null statistics with n_words 0 in the statistics; equal texts get equal rows; extra columns are
ignored; a text without any letter has null mean word length. A text of which markup, code and tables
are all or nearly all (less than LEFT stands beside them) is measured and compared as it is stored.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbytes as tb
from scriptorium.session import ship, spread

LANGS = ("de", "en", "es", "fr")
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "pause", "bracket", "symbol", "other")
N_CLASS = len(CLASSES)
# kinds of tokens: function word of each language, other word, mixed letters and digits, number, symbols
TOKEN_KINDS = (*LANGS, "word", "mixed", "number", "symbol")
N_KIND = len(TOKEN_KINDS)
# kinds of lines: share of non-blank characters in lines by length and end, and in repeated lines
LINE_KINDS = ("short_stop", "short_open", "long_stop", "long_open", "repeated")
N_LINE = len(LINE_KINDS)
SHORT_LINE = 90
# letters of a word: 1, 2, 3, 4, 5-6, 7-9, 10-14, 15 and more
LENGTH_BIN = np.array([0, 0, 1, 2, 3, 4, 4, 5, 5, 5, *[6] * 5, 7])
N_LENGTH = 8
PARTS = (("chars", 1.0), ("tokens", 1.0), ("lines", 0.7), ("lengths", 0.7))

_CLASS = np.full(256, 8, dtype=np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b" \t":
    _CLASS[_c] = 3
for _c in b"\n\r":
    _CLASS[_c] = 4
for _c in b".!?":
    _CLASS[_c] = 5
for _c in b",;:":
    _CLASS[_c] = 6
for _c in b"()[]{}\"'`":
    _CLASS[_c] = 7
_CLASS[0xC3:0xE0] = 0  # lead bytes of two-byte letters
_CLASS[0xC2] = 9
_CLASS[0xE0:0xF8] = 9
_CONT = np.zeros(256, dtype=bool)
_CONT[0x80:0xC0] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 13]] = True
# the corpus placeholders are regular content and say nothing about the structure
PLACEHOLDERS = ("<cit.>", "<ref>", "< g r a p h i c s >")

# ---------------------------------------------------------------------------------------- specimens
# Short texts of each structure. Prose is written out; what isn't prose comes from the generators below,
# so that nothing in it depends on the texts of any corpus (a test looks for its lines in the test tables).


def _word(rnd: random.Random, least: int = 3, most: int = 12) -> str:
    """An invented word: the structure counts, not what it says."""
    n, out = rnd.randint(least, most), ""
    while len(out) < n:
        out += rnd.choice("bcdfghklmnprstvwz") + rnd.choice("aeiou")
    return out[:n]


def _title(rnd: random.Random) -> str:
    return _word(rnd).capitalize()


def _tables(rnd: random.Random) -> Iterator[str]:
    """Rows of a name and numbers, with each usual separator."""
    for sep in ("   ", " ; ", ",", "\t", " | ", " & "):
        names = [_title(rnd) + rnd.choice(("Net", "", "-" + str(rnd.randint(1, 9)))) for _ in range(7)]
        yield sep.join(["Name", "P", "R", "F1", "Acc"]) + "\n" + "".join(sep.join([x, *[f"{rnd.uniform(40, 95):.1f}" for _ in range(4)]]) + "\n" for x in names)
    yield "year,count,share\n" + "".join(f"{1990 + k},{rnd.randint(5, 60)},{rnd.random():.2f}\n" for k in range(9))


def _logs(rnd: random.Random) -> Iterator[str]:
    clock = lambda: f"{rnd.randrange(24):02d}:{rnd.randrange(60):02d}:{rnd.randrange(60):02d}"
    yield "".join(f"[{clock()}] {rnd.choice(('INFO', 'DEBUG', 'WARN'))} iter={rnd.randrange(99999)} err={rnd.random():.3f} rate=1e-{rnd.randint(2, 6)}\n" for _ in range(9))
    yield "".join(f"2031-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}T{clock()} worker-{rnd.randint(1, 64)} {_word(rnd)}: took {rnd.randint(2, 900)} ms, queue={rnd.randint(0, 50)}\n" for _ in range(8))


def _contents(rnd: random.Random) -> Iterator[str]:
    yield "".join(f"{k // 3 + 1}.{k % 3 + 1} {_title(rnd)} {rnd.choice(('', _title(rnd) + ' '))}{'.' * rnd.randint(9, 22)} {3 * k + rnd.randint(1, 3)}\n" for k in range(9))


def _references(rnd: random.Random) -> Iterator[str]:
    for n in (3, 9):
        yield "".join(
            f"[{k}] {_title(rnd)}, {rnd.choice('ABCDEFGH')}. {_title(rnd)} {_word(rnd)} of {_word(rnd)} with {_word(rnd)} {_word(rnd)}. Proc. {_word(rnd, 3, 4).upper()}, pp. {rnd.randint(100, 4999)}-{rnd.randint(5000, 9999)}, {rnd.randint(1990, 2030)}\n"
            for k in range(1, n + 1)
        )


def _keywords(rnd: random.Random) -> Iterator[str]:
    term = lambda: rnd.choice((_word(rnd, 6, 14), f"{_word(rnd, 6, 12)} {_word(rnd, 6, 12)}"))
    for sep in ("; ", " / ", ", "):
        for n in (12, 30):
            yield sep.join(term() for _ in range(n))


def _keyword_lines(rnd: random.Random) -> Iterator[str]:
    for n in (10, 25):
        yield "".join(rnd.choice((_word(rnd, 6, 14), f"{_word(rnd, 6, 12)} {_word(rnd, 6, 12)}")) + "\n" for _ in range(n))


def _listings(rnd: random.Random) -> Iterator[str]:
    v = [_word(rnd, 1, 6) for _ in range(12)]
    yield "".join(f"def {a}({b}):\n    return {b} * ({c} - 1)\nprint({a}({k})[{k + 2}])  # []\nif {c}:\n    {b} += {a}({c})\nSELECT {a}, {b} FROM {c} WHERE {b} < {k}\n" for k, (a, b, c) in enumerate(zip(v, v[1:], v[2:])))
    yield "".join(f"int {a} = {k};\nfor (int i = 0; i < {a}; ++i) {{\n  {b}[i] = {c}(i) + {k};\n}}\nif (!{b}) return -1;\n" for k, (a, b, c) in enumerate(zip(v, v[3:], v[5:])))
    yield "".join(f"$ cd /opt/{a} && ./{b} --{c}={k}\nexport {a.upper()}={b}:{c}\nfor f in *.{c}; do {b} $f; done\n" for k, (a, b, c) in enumerate(zip(v, v[2:], v[4:])))


def _hex(rnd: random.Random) -> Iterator[str]:
    yield "".join(" ".join(f"{rnd.randrange(256):02x}" for _ in range(16)) + "\n" for _ in range(8))


def _encoded(rnd: random.Random) -> Iterator[str]:
    abc = string.ascii_letters + string.digits + "+/"
    yield "".join("".join(rnd.choice(abc) for _ in range(76)) + "\n" for _ in range(6))
    yield "".join(rnd.choice(abc) for _ in range(400))


def _symbols(rnd: random.Random) -> Iterator[str]:
    marks = [*"=+*/<>:,;()[]|~^%#", *(chr(c) for c in (0x2212, 0x2264, 0x2265, 0x2248, 0x2192, 0x2208, 0x2211, 0x220F, 0x2207, 0x2205, 0x2295, 0x00B1, 0x00D7, 0x00F7)), "..", "//"]
    for share in (0.15, 0.5):
        yield "".join(" ".join(f"{rnd.uniform(1, 99):.1f}" if rnd.random() < share else rnd.choice(marks) for _ in range(rnd.randint(6, 12))) + "\n" for _ in range(6))


def _navigation(rnd: random.Random) -> Iterator[str]:
    """Links of a page's frame."""
    links = "Log out|My account|Site map|Search|Advanced search|Print this page|All issues|Subscribe|Recent posts|Privacy|Accessibility|Go to start|Older →|← Newer|Report a problem|Languages|Start › Journals › Volume|Mobile view|Follow us|Text size|PDF (1 MB)|Cited by 14".split("|")
    for n in (14, 30):
        yield "".join(rnd.choice(links) + "\n" for _ in range(n))


def _filler(rnd: random.Random) -> Iterator[str]:
    """The same short line again and again."""
    for line in ("TODO", "-", "none given", "text to be added here", "not available yet", "Please see the online appendix", "dolor table caption"):
        yield (line + "\n") * rnd.randint(5, 9)


def _scrambled(rnd: random.Random) -> Iterator[str]:
    """Letters and marks as a failed character recognition leaves them."""
    for letters in ("eclfvrntuiom01Il", "aegqdbphn5S8Bzsk"):
        abc = letters * 2 + "',.'"
        words = lambda n: " ".join("".join(rnd.choice(abc) for _ in range(rnd.randint(1, 5))) for _ in range(n))
        for n in (60, 150):
            yield words(n)
            yield words(n) + "."
            yield "\n".join(words(8) for _ in range(n // 8))


PROSE: dict[str, tuple[str, ...]] = {
    "prose_en": (
        "The old bridge over the river was built by hand, and it is still in use. It has been said that such a bridge can be kept for a long time when it is painted every year, although the cost is not small. In contrast, the newer ones are made of steel; their parts were put together in a yard and then brought to the place.",
        "Whereas earlier surveys of the valley relied on maps that were drawn from memory, the present account concentrates on measured heights and their uncertainty. Our description differs from previous reports in that the two banks are treated together rather than one after the other, which is important for larger floods.",
    ),
    "prose_simple": (
        "We went to the lake in the morning and sat on the wet grass. The water was cold, but the sun was warm. My sister had a red boat, so we put it in. Then came the best part: it went all the way to the 3 big rocks! \"Look at that,\" I said, and she ran to get it.",
    ),
    "prose_terse": (
        "Volcanic sedimentation influences groundwater chemistry. Persistent erosion destabilizes coastal embankments. Agricultural drainage necessitates continuously maintained reservoirs. Contemporary inventories underestimate subterranean circulation.",
        "Transferring alpine measurements to tropical estuaries requires regularly calibrated instruments; Halvorsen therefore substituted simplified gradients. Several expeditions documented whether seasonal currents displace nutrients, yet interpretations diverge across neighbouring basins.",
    ),
    "prose_de": ("Frühere Brücken wurden aus Holz gebaut, das für schwere Wagen nicht ausreichte. Außerdem wurden weitere Flüsse vermessen; die Höhe lag bei 21 Metern. Ob sich diese Bauweise auf längere Strecken übertragen lässt, ist unklar, weil die Pläne häufig unvollständig sind.",),
    "prose_es": ("Los primeros puentes se hacían con madera que no bastaba para los carros más pesados. Además se midieron otros ríos y la altura alcanzó los 57 metros. Todavía no está claro si esta forma de construir sirve para distancias más largas, porque los planos están incompletos.",),
    "prose_fr": ("Les premiers ponts étaient faits de bois et ils ne suffisaient pas pour les voitures lourdes. Cette étude montre que la hauteur dépend de mesures souvent imprécises. De plus, des rivières ont été relevées pour améliorer les cartes, et il reste à savoir si ces plans conviennent.",),
    "prose_it": ("I primi ponti erano fatti di legno e non bastavano per i carri più pesanti. Inoltre sono stati misurati altri fiumi, e l'altezza è arrivata a 57 metri. Non è ancora chiaro se questo modo di costruire valga per distanze più lunghe, perché le carte sono spesso incomplete.",),
    "prose_nl": ("De eerste bruggen waren van hout en konden zware wagens niet dragen. Daarnaast zijn andere rivieren opgemeten, en de hoogte was 21 meter. Het is nog niet duidelijk of deze manier van bouwen ook voor langere afstanden geschikt is, omdat de kaarten vaak onvolledig zijn.",),
    "prose_ru": ("Первые мосты строили из дерева, которого не хватало для тяжёлых повозок. Кроме того, были измерены другие реки, и карты стали точнее. Остаётся неясным, годится ли этот способ для более длинных путей.",),
    "prose_zh": ("早期的桥用木头建成，不能承受沉重的车辆。此外还测量了其他河流，高度达到二十米。这种建法是否适合更长的距离还不清楚。",),
    "prose_with_list": (
        "The old bridge over the river was built by hand, and it is still in use. It has been said that such a bridge can be kept for a long time, although the cost is not small.\n\n- wooden arches\n- hanging footbridges over rivers\n- steel trusses\n\nIn contrast, the newer ones are made of steel; their parts were put together in a yard, and the cost was lower than before.",
    ),
    "prose_with_markup": (
        "<p>The old bridge was <b>built</b> by hand, and it is still in use.</p>\n\n\\begin{equation}\nh = a t + c\n\\end{equation}\n\nIt has been said that such a [bridge](https://example.org/b/1) can be kept for a long time, although the cost is <em>not small</em> for most towns (see $h_{ij}$ and $\\beta$).\n\n| Bridge | Year |\n|---|---|\n| North | 1871 |\n",
        "<p>The old bridge was <i>built</i> by hand.</p>\n<ul>\n  <li>wooden arches</li>\n  <li>steel trusses</li>\n</ul>\n<table border=0><tr><th>Bridge</th><th>Year</th></tr><tr><td>North</td><td>1871</td></tr></table>\n\nIt has been said that such a <a href=\"https://example.org/b?id=1&amp;v=2\">bridge</a> can be kept for a long time.<br/>\n<pre><code class=\"language-c\">int arches = span / width;</code></pre>",
        "\\section{Old Bridges}\\label{sec:old}\n\nThe old bridge \\cite{mason1871} was \\emph{built} by hand, and it is still in use~\\citep[see][]{carter1902}.\n\n\\begin{itemize}\n\\item wooden arches\n\\item steel trusses\n\\end{itemize}\n\n\\begin{tabular}{lc}\nBridge & Year \\\\ \\hline\nNorth & 1871 \\\\\n\\end{tabular}\n\nIt has been said that $h = a t + c$ can be kept for a long time.",
        "== Old bridges ==\n\nThe old [[bridge]]s were '''built''' by hand {{when|date=May 1990}} and are still in use.\n\n* [[wooden arches]]\n* [[steel trusses]]\n\n{| class=\"wikitable\"\n|-\n! Bridge !! Year\n|-\n| North || 1871\n|}\n\n[[Category:bridges]]\nIt has been said that such a bridge can be kept for a long time.",
        "## Old bridges\n\nThe old bridge was **built** by hand and is `still` in use.\n\n* **wooden arches**\n* **steel trusses**\n\n> **Note** hanging footbridges\n\n```c\nwhile (load)\n    load -= take(1);\n```\n\n![Plan](plans/3.png)\n\n[^1]: see [arches](https://example.org/a/3)\n\nIt has been said that such a bridge can be kept for a long time when it is painted.",
    ),
}

GENERATED = {
    "table": _tables, "log": _logs, "contents": _contents, "references": _references, "keyword_lines": _keyword_lines, "keywords": _keywords, "listing": _listings,
    "hex": _hex, "encoded": _encoded, "symbols": _symbols, "navigation": _navigation, "filler": _filler, "scrambled": _scrambled,
}

#: name -> (is prose, specimens)
SPECIMENS: dict[str, tuple[bool, tuple[str, ...]]] = {n: (True, xs) for n, xs in PROSE.items()} | {n: (False, tuple(f(random.Random(f"specimen {n}")))) for n, f in GENERATED.items()}


class FunctionWords:
    """Hashes of function words and the language each tells; a word of several languages tells the
    one in which it ranks highest."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        best: dict[int, tuple[int, int]] = {}
        for lang, word, rank in rows:
            if lang in LANGS and word:
                k, v = tb.hash_word(word.lower()), (rank if rank is not None else 999, LANGS.index(lang))
                best[k] = min(best.get(k, v), v)
        self.keys = np.array(sorted(best), dtype=np.uint64)
        self.lang = np.array([best[int(k)][1] for k in self.keys], dtype=np.int64)


#: Markup, and the code, tables and formulas set in it, say nothing about the prose around them.
MARKUP = (
    r"(?s)<pre\b.*?</pre>|<table\b.*?</table>|<syntaxhighlight\b.*?</syntaxhighlight>|<!--.*?-->|\x60{3}.*?\x60{3}|\{\|.*?\|\}|\\begin\{(?:lstlisting|tabular|equation|figure)\}.*?\\end\{(?:lstlisting|tabular|equation|figure)\}|\$\$.{1,300}?\$\$|\\\[.{1,300}?\\\]",
    r"(?i)</?[A-Za-z][^<>]{0,300}>|&lt;/?[a-z].{0,200}?&gt;|&#?[A-Za-z0-9]{2,8};|\\[A-Za-z]+\*?(?:\[[^\]\n]{0,80}\])*(?:\{[^{}\n]{0,80}\})?|\]\([^)\n]{0,200}\)|https?://[^\s\])]+|(?m:^\|.*\|[ \t]*$)|\{\{[^{}\n]{0,200}\}\}",
)


def plain(text: pa.Array) -> pa.Array:
    """Texts without placeholders and markup, for the comparison with the profiles."""
    import pyarrow.compute as pc

    for p in PLACEHOLDERS:
        text = pc.replace_substring(text, p, "")
    for rx in MARKUP:
        text = pc.replace_substring_regex(text, rx, " ")
    return text


#: Share of a text's non-blank bytes that plain() has to leave for the rest to speak for the text.
LEFT = 0.2


def ink(text: pa.Array) -> np.ndarray:
    """Non-blank bytes of each text."""
    out = [np.zeros(0, np.int64)]
    for _, _, data, off in tb.chunks(text):
        out.append(np.diff(np.concatenate(([0], np.cumsum(~_BLANK[data])))[off]))
    return np.concatenate(out)


def judged(text: pa.Array) -> pa.Array:
    """What is measured: the text without markup, or the stored text where nothing or little is left of it."""
    import pyarrow.compute as pc

    p = plain(text)
    whole = ink(text)
    return pc.if_else(pa.array((whole > 0) & (ink(p) < LEFT * whole)), text, p)


def measure(data: np.ndarray, off: np.ndarray, fw: FunctionWords) -> dict[str, np.ndarray]:
    """Counts and distributions of each row of a chunk."""
    n = len(off) - 1
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    keep = ~_CONT[data]
    cls = _CLASS[data]
    chars = np.bincount((row * N_CLASS + cls)[keep], minlength=n * N_CLASS).reshape(n, N_CLASS).astype(float)

    low = tb.lower(data)
    # tokens are runs of non-blank bytes; a token's kind follows from the bytes in it
    ts, te, tr = tb.spans(~_BLANK[data], off)
    alpha = np.concatenate(([0], np.cumsum(tb.word_mask(data))))
    digit = np.concatenate(([0], np.cumsum(cls == 2)))
    has_a, has_d = alpha[te] > alpha[ts], digit[te] > digit[ts]
    kind = np.where(has_a & has_d, N_KIND - 3, np.where(has_a, N_KIND - 4, np.where(has_d, N_KIND - 2, N_KIND - 1)))
    tokens = np.bincount(tr * N_KIND + kind, minlength=n * N_KIND).reshape(n, N_KIND).astype(float)

    ws, we, wr = tb.spans(tb.word_mask(data), off)
    h = tb.hashes(low, ws, we)
    is_fw, i = tb.member(h, fw.keys)
    lang = np.bincount(wr[is_fw] * len(LANGS) + fw.lang[i[is_fw]], minlength=n * len(LANGS)).reshape(n, len(LANGS)).astype(float) if len(fw.keys) else np.zeros((n, len(LANGS)))
    # letters per word without continuation bytes
    cont = np.concatenate(([0], np.cumsum(_CONT[data])))
    wlen = (we - ws) - (cont[we] - cont[ws])
    n_words = np.bincount(wr, minlength=n).astype(float)
    lengths = np.bincount(wr * N_LENGTH + LENGTH_BIN[np.minimum(wlen, 15)], minlength=n * N_LENGTH).reshape(n, N_LENGTH).astype(float)
    letters = np.bincount(wr, weights=wlen, minlength=n)
    tokens[:, : len(LANGS)] = lang
    tokens[:, len(LANGS)] = np.maximum(0.0, tokens[:, len(LANGS)] - lang.sum(1))

    # lines
    nl = (data == 10) | (data == 13)
    ls, le, lr = tb.spans(~nl, off)
    ink = np.concatenate(([0], np.cumsum(~_BLANK[data])))
    solid = ink[le] > ink[ls]
    ls, le, lr = ls[solid], le[solid], lr[solid]
    # the last non-blank byte of a line
    last = np.maximum.accumulate(np.where(~_BLANK[data], np.arange(len(data)), -1)) if len(data) else np.zeros(0, int)
    end = data[last[le - 1]] if len(le) else np.zeros(0, np.uint8)
    close = np.isin(end, np.frombuffer(b")\"'", np.uint8))
    if close.any():
        end = end.copy()
        end[close] = data[np.maximum(ls[close], last[le[close] - 1] - 1)]
    stop = np.isin(end, np.frombuffer(b".!?:;", np.uint8)) & ~_dots(data, last, le)
    size = (ink[le] - ink[ls]).astype(float)
    long_ = (le - ls) > SHORT_LINE
    lh = tb.hashes(low, ls, le)
    order = np.lexsort((lh, lr))
    same = np.zeros(len(lh), bool)
    if len(order) > 1:
        eq = (lh[order][1:] == lh[order][:-1]) & (lr[order][1:] == lr[order][:-1])
        same[order[1:]] |= eq
        same[order[:-1]] |= eq
    lk = np.where(same & ~long_, 4, np.where(long_, 2, 0) + np.where(stop, 0, 1))
    lines = np.bincount(lr * N_LINE + lk, weights=size, minlength=n * N_LINE).reshape(n, N_LINE)
    n_lines = np.bincount(lr, minlength=n).astype(float)
    n_stop = np.bincount(lr, weights=stop, minlength=n)
    sent = np.bincount(row[_sentence_ends(data)], minlength=n).astype(float)
    return {"chars": chars, "tokens": tokens, "lines": lines, "lengths": lengths, "n_words": n_words, "letters": letters, "n_lines": n_lines, "n_stop": n_stop, "lang": lang, "sentences": sent, "n_chars": np.bincount(row[keep], minlength=n).astype(float)}


def _dots(data: np.ndarray, last: np.ndarray, le: np.ndarray) -> np.ndarray:
    """Lines that end in a row of dots are no sentences."""
    if not len(le):
        return np.zeros(0, bool)
    e = last[le - 1]
    return (e > 1) & (data[e] == 46) & (data[np.maximum(e - 1, 0)] == 46) & (data[np.maximum(e - 2, 0)] == 46)


def _sentence_ends(data: np.ndarray) -> np.ndarray:
    stop = _CLASS[data] == 5
    nxt = np.ones(len(data), bool)
    nxt[:-1] = _BLANK[data[1:]] | np.isin(data[1:], np.frombuffer(b")\"'", np.uint8)) | (data[1:] == 0xE2)
    return np.flatnonzero(stop & nxt)


def _norm(x: np.ndarray) -> np.ndarray:
    return (x + 1e-9) / (x + 1e-9).sum(-1, keepdims=True)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits between each row of p and each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    return 0.5 * ((p * np.log2(p / m)).sum(-1) + (q * np.log2(q / m)).sum(-1))


class Profiles:
    def __init__(self, words: list[tuple[str, str, int]]):
        self.fw = FunctionWords(words)
        names, texts = [], []
        for name, (_, xs) in SPECIMENS.items():
            names += [name] * len(xs)
            texts += xs
        self.names = np.array(names)
        self.prose = np.array([SPECIMENS[x][0] for x in names])
        data, off = tb.as_utf8(plain(pa.array(texts)))
        m = measure(data, off, self.fw)
        self.dist = [_norm(m[k]) for k, _ in PARTS]

    def nearest(self, m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest profile, its divergence, divergence of the nearest of the other side)."""
        d = sum(w * divergence(_norm(m[k]), q) for (k, w), q in zip(PARTS, self.dist))
        best = d.argmin(1)
        own = self.prose[best][:, None] == self.prose[None, :]
        return best, d.min(1), np.where(own, np.inf, d).min(1)


STATS = "n_chars bigint, n_words bigint, n_lines bigint, n_sentences bigint, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, stop_line_share double, common_word_share double, repeated_line_share double, profile string, divergence double, margin double, is_prose boolean"


def _run(words: list[tuple[str, str, int]], id_type: pa.DataType):
    state: dict[str, Profiles] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["p"] = Profiles(words)
        P = state["p"]
        for b in batches:
            text = judged(b["_text"])
            for i, j, data, off in tb.chunks(text):
                m = measure(data, off, P.fw)
                best, d, other = P.nearest(m)
                chars = np.maximum(1.0, m["n_chars"])
                ink = np.maximum(1.0, m["lines"].sum(1))
                tok = np.maximum(1.0, m["n_words"])
                empty = m["lines"].sum(1) == 0
                f = lambda x: pa.array(x, pa.float64(), mask=empty)
                c = m["chars"]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["field"].slice(i, j - i), b["row_id"].slice(i, j - i),
                        pa.array(m["n_chars"].astype(np.int64)), pa.array(m["n_words"].astype(np.int64)), pa.array(m["n_lines"].astype(np.int64)), pa.array(m["sentences"].astype(np.int64)),
                        pa.array(m["letters"] / tok, pa.float64(), mask=m["n_words"] == 0), f((c[:, 7] + c[:, 8] + c[:, 9]) / chars), f(c[:, 2] / chars), f(c[:, 1] / chars),
                        f(m["n_stop"] / np.maximum(1.0, m["n_lines"])), f(m["lang"].max(1) / tok), f(m["lines"][:, 4] / ink),
                        pa.array(P.names[best], pa.string(), mask=empty), f(d), f(other - d), pa.array(P.prose[best], pa.bool_(), mask=empty),
                    ],
                    names=["field", "row_id", *[x.split()[0] for x in STATS.split(", ")]],
                )

    return run


def stacked(parts: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """(field, row_id, _text) of several text columns: (table, field name, key, text column)."""
    out = None
    for df, field, key, text in parts:
        d = spread(df.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("_text")))
        out = d if out is None else out.unionByName(d)
    return out


def common_rows(common_words: DataFrame) -> list[tuple[str, str, int]]:
    """The stated list of function words, a fixed table."""
    return [tuple(r) for r in common_words.select("lang", "word", "rank_no").collect() if r.lang and r.word]


def quality(parts: list[tuple[DataFrame, str, str, str]], common_words: DataFrame) -> DataFrame:
    """Statistics, nearest profile and verdict of every text. One scan, no shuffle; the result is the
    same however the rows are partitioned."""
    ship(common_words.sparkSession)
    return stacked(parts).mapInArrow(_run(common_rows(common_words), pa.int64()), f"field string, row_id bigint, {STATS}")
