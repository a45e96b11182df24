"""Problem 10: personal information in free text becomes typed placeholders.

Method: a skip-chain conditional random field. Tokens near a trigger (at-signs, runs of digits, id
words, street words, titles, given names, and further mentions of what follows a title or given name)
form chains; all other tokens are fixed to the outside label and separate the chains. Equal and
similar (one edit) capitalised tokens of one document are joined by skip edges, and loopy message
passing, repeated until it settles, makes their labels agree. The label of a token follows from the
field alone: its features are words, shapes, lengths of digit groups, distances to at-signs and street
words, and membership in the name lists, none of them a pattern of a kind. A label run counts if it
passes a short check of its kind's content (enough digits, two name parts, ...).

The weights, those of the skip edges included, are trained by pseudo-likelihood on a bounded sample
(TRAIN_DOCS documents) labelled by strict full patterns (distant supervision); every HIDDEN-th window
is shown a second time without its list memberships, so that context counts too. The driver keeps the
sample's windows and features in a temporary file and reads them in blocks; its memory holds the
labels (a few bytes a token), the skip edges, the counts of words and a hash of each window. Given and family
names come from the author lists of all papers. What is sent to the tasks is the model and two bit
filters of fixed size (2**tb.FILTER_BITS bits each), whatever the number of names.

Kinds: email, phone, id_number, address, person. Family names alone, names inside an email address and
numbers of works, grants or reports stay.

Defined results: null and empty texts have nothing to find and stay as they are; texts are processed
whole; equal texts give equal results; without author lists persons are still found by titles,
initials and context; without any training window nothing is found.
"""

from __future__ import annotations

import os
import pickle
import re
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbytes as tb
from scriptorium.session import ship, spread

KINDS = ("email", "phone", "id_number", "address", "person")
N_LABEL = len(KINDS) + 1
TRAIN_DOCS = 12_000
ROUNDS = 25
CONTEXT = 100
BP_ROUNDS = 60
BP_TOLERANCE = 1e-4
BUCKETS = 1 << 16
FIT_TOKENS = 1 << 14  # tokens of the sample in memory at once
MIN_FAMILIES = 2
HIDDEN = 3

# fixed values: words that announce a kind of personal data or a part of it
ID_WORDS = "ssn orcid dni nie nif passport licence license matriculation social insurance national nino ni badge staff id".split()
STREET_WORDS = "street st road rd lane ln avenue ave drive court ct close boulevard blvd terrace crescent calle rue avenida plaza paseo carrer chemin allée quai".split()
STREET_ENDS = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee")
TITLES = "dr prof mr mrs ms miss sir professor doctor herr frau señor señora mme".split()
AT_WORDS = ("at",)
PARTICLES = "van von der den de la le del du di da dos el ter zu".split()
# fixed values: common given names, so that small author lists don't leave the model without any
GIVEN = (
    "alexander alice amara amelia andrea andrew anna anne anthony antonio arthur barbara beatrice benjamin bruno carla carlos caroline charles charlotte christian christopher clara claire daniel david diana diego dorothea edward "
    "elena eleanor elizabeth emil emily emma eric erik ernst eva felix florian francis frank frederick gabriel gabriela george gregory greta hana hannah hans harold helen helena henry hugo ida ignacio ingrid isabel jack jakob james "
    "jan jane jasmine jean jennifer john jonathan jose joseph josephine juan judith julia karl katherine kenji klara laura lawrence leo leonie linda louis lucia luis magdalena maria marie mark marcus margaret martin mary matthew "
    "michael miguel nadia nicholas noor olga oliver oscar otto patricia paul pavel peter philippa quentin rachel rebecca richard robert rosalind samuel sandra sarah sebastian sofia stephen susan tamara theodore thomas timothy ursula "
    "valentina victor vincent walter wilhelmina william xenia yusuf yvette zachary zelda zoltan"
).split()
PHONE_WORDS = "tel phone call mobile fax тел telefon teléfono telephone".split()

_W = r"[^\W\d_]"
_NAME = rf"{_W}(?:[\w’'-]*\w)?"
_CAP = rf"(?-i:[A-ZÀ-ÞŠŽČŘĐŁŚŹŻÅØÑÇ][\w’'-]*\w)"
EMAIL = re.compile(r"(?:mailto:)?(?:\{\s*[\w.+-]+(?:\s*,\s*[\w.+-]+)*\s*\}|[\w.+-]*\w)\s?(?:@|\(at\)|\[at\]|\s\[at\]\s|\s\(at\)\s)\s?[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)*(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z]{2,}\b", re.I)
PHONE = re.compile(
    r"(?<![\w.#/-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ .-]\d{2,6}){1,5}|\(\d{2,4}\)[ .-]?\d{3,5}(?:[ .-]\d{2,5}){1,3}|0\d{1,4}(?:[ .-]\d{2,6}){1,4}|1-\d{3}-\d{3}-\d{4}|\d{3}[.]\d{3}[.]\d{4}|\d{3}-\d{3}-\d{4})(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w/-])"
)
CODE = re.compile(r"(?<![\w.])#?(?=[A-Z0-9 -]*\d)[A-Z]{0,2}\d[\dA-Z]*(?:[- ]\d[\dA-Z]*)*(?:[- ][A-Z](?![\w]))?(?![\w])")
ID_FULL = re.compile(
    r"(?:(?i:\bssn|social security (?:number|no\.?)|\borcid(?: id)?|\bdni|\bnie\b|passport(?: (?:no|number|nr)\.?)?|driv(?:ing|er'?s?) licen[cs]e(?: (?:no|number)\.?)?|\bni number|national insurance(?: (?:no|number)\.?)?|national id(?:entity)?(?: (?:no|number|card)\.?)?|identity (?:card|number)|matriculation (?:no\.?|number)|staff id(?: card)?|student (?:id|number)|employee (?:id|number)|tax (?:id|number)))\s?[:#]?\s?#?(?P<code>[A-Z]{0,2}\s?\d[\dA-Z]*(?:[- ]?\d[\dA-Z]*)*(?:[- ]?[A-Z](?!\w))?)"
)
_CITY = rf"(?:,? (?:\d{{4,5}} )?{_CAP}(?: {_CAP})?(?:,? (?:[A-Z]{{2}} )?\d{{5}})?)?"
ADDRESS = re.compile(
    rf"(?:\b(?:Flat|Apt|Unit|Suite)\.? \w{{1,4}}, )?(?<![\w.,-])\d{{1,5}}[A-Za-z]?(?: bis| ter)?,? (?:[NSEW]\. )?(?:{_CAP} ){{1,3}}(?i:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|close|boulevard|blvd|square|sq|way|place|row|terrace|crescent)\b\.?(?:, (?:Apt|Flat|Unit) \w{{1,4}})?{_CITY}"
    rf"|(?<![\w.,-])\d{{1,5}}(?: bis| ter)?,? (?i:rue|avenue|boulevard|chemin|quai|place|allée|via)(?: (?i:de la|des|du|de|d’|l’))? {_CAP}(?: {_CAP})?(?:, \d{{5}} {_CAP}(?: {_CAP})?)?"
    rf"|\b(?i:calle|avenida|plaza|paseo|carrer|via|rua)(?: (?i:del|de la|de los|de|da|do))? {_CAP}(?: {_CAP})? \d{{1,4}}(?:, \d{{1,2}}º ?[A-Z])?(?:, \d{{5}} {_CAP}(?: {_CAP})?)?"
    rf"|\b[A-ZÄÖÜ]\w*?(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ring) \d{{1,4}}[a-z]?(?:, \d{{5}} {_CAP}(?: {_CAP})?)?"
)
TOKEN = re.compile(r"\d+|[^\W\d_]+(?:[’'-][^\W\d_]+)*|[^\w\s]|_+")


class Names:
    """Given names, family names, words that stand in lower case in several windows (common), and words of
    several windows in any case that are no names (vocab)."""

    def __init__(self, given: tb.Bits, family: tb.Bits, common: frozenset[str] = frozenset(), vocab: frozenset[str] = frozenset()):
        h = lambda ws: np.unique(np.array([tb.hash_word(w) for w in ws], dtype=np.uint64))
        self.given, self.family, self.common, self.vocab = given, family, common, vocab
        self.titles = h(TITLES)
        self.words = h(ID_WORDS + STREET_WORDS)
        self.ends = {n: h([x for x in STREET_ENDS if len(x.encode()) == n]) for n in {len(x.encode()) for x in STREET_ENDS}}
        self.cache: dict[str, tuple[bool, bool]] = {}

    def of(self, low: str) -> tuple[bool, bool]:
        """(is a given name, is a family name)."""
        if (x := self.cache.get(low)) is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            x = self.cache[low] = (low in self.given, low in self.family)
        return x

    def is_given(self, low: str) -> bool:
        return self.of(low)[0]

    def is_family(self, low: str) -> bool:
        return self.of(low)[1]


def _name_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(given, block, bits): the filter words that the names of a batch set."""
    for b in batches:
        data, off = tb.as_utf8(b["t"])
        h, given = tb.hashes(data, off[:-1], off[1:]), np.array(b["given"].to_pylist(), dtype=bool)
        for kind in (True, False):
            block, bits = tb.bit_rows(h[given == kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), kind)), pa.array(block), pa.array(bits)], names=["given", "block", "bits"])


def name_lists(authors: DataFrame, column: str = "authors") -> tuple[tb.Bits, tb.Bits]:
    """Given names (tokens that stand first with several families) and family names of all author lists, as
    filters. Distinct tokens are counted, told apart, hashed and combined on the executors; what comes to
    the driver is at most the filters' fixed size."""
    ship(authors.sparkSession)
    a = authors.select(F.explode(column).alias("a")).filter(F.col("a").isNotNull())
    a = a.select(F.regexp_replace(F.lower("a"), r"\([^)]*\)|\"[^\"]*\"|(?U)[^\p{L}\s'’-]", " ").alias("a"), F.col("a").contains(",").alias("comma")).filter("not comma").distinct()
    w = a.select(F.regexp_extract_all("a", F.lit(r"(?U)\p{L}[\p{L}'’-]+"), 0).alias("w")).filter("size(w) between 2 and 5")
    pairs = w.select(F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last")).distinct()
    first = pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    last = pairs.groupBy("last").agg(F.count(F.lit(1)).alias("m"))
    both = first.join(last, F.col("first") == F.col("last"), "full").select(F.coalesce("first", "last").alias("t"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    is_given = (F.col("n") >= MIN_FAMILIES) & (F.col("n") > 2 * F.col("m")) & ~F.col("t").isin(*PARTICLES, *_NOT_FAMILY)
    told = both.select("t", (is_given | F.col("t").isin(*GIVEN)).alias("given")).filter(F.col("given") | (F.length("t") > 3))
    bits = told.mapInArrow(_name_bits, "given boolean, block bigint, bits bigint").groupBy("given", "block").agg(F.bit_or("bits").alias("bits"))
    got = bits.toArrow()
    g, block, word = np.array(got["given"].to_pylist(), dtype=bool), got["block"].to_numpy(), got["bits"].to_numpy().view(np.uint64)
    given, family = tb.Bits(block[g], word[g]), tb.Bits(block[~g], word[~g])
    return given.add(np.array([tb.hash_word(w) for w in GIVEN], np.uint64)), family


# ------------------------------------------------------------------------------------------ windows


def windows(data: np.ndarray, off: np.ndarray, names: Names) -> list[tuple[int, int, int]]:
    """(row, start, end) of the stretches around triggers, in bytes, cut at blanks."""
    n = len(data)
    if not n:
        return []
    low = tb.lower(data)
    letter = tb.word_mask(data)
    s, e, r = tb.spans(letter, off)
    h = tb.hashes(low, s, e)
    cap = (data >= 65) & (data <= 90)
    title = tb.member(h, names.titles)[0]
    given = names.given.has(h)
    at = [s[title | given | tb.member(h, names.words)[0]]]
    for size, keys in names.ends.items():
        k = e - s > size
        at.append(s[k][tb.member(tb.hashes(low, e[k] - size, e[k]), keys)[0]])
    at.append(np.flatnonzero(data == 64))
    b = np.flatnonzero((low[:-2] == 97) & (low[1:-1] == 116) & np.isin(data[2:], np.frombuffer(b")]", np.uint8))) if n > 2 else np.zeros(0, int)
    at.append(b[b > 0][np.isin(data[b[b > 0] - 1], np.frombuffer(b"([", np.uint8))])
    # runs of digits, blanks and separators with seven digits or more
    digit = (data >= 48) & (data < 58)
    body = digit | np.isin(data, np.frombuffer(b" ().-/#", np.uint8))
    ds, de, _ = tb.spans(body, off)
    c = np.concatenate(([0], np.cumsum(digit)))
    at.append(ds[c[de] - c[ds] >= 7])
    # an initial before a capitalised word
    initial = np.zeros(0, int)
    if n > 3:
        i = np.flatnonzero(cap[:-3] & (data[1:-2] == 46) & (data[2:-1] == 32) & (cap[3:] | (data[3:] >= 0xC3)))
        initial = i[(i == 0) | ~letter[np.maximum(i - 1, 0)]]
        at.append(initial)
    # further mentions in the document of a capitalised word that follows a title, given name or initial
    big = (e - s > 3) & (cap[s] | (data[s] == 0xC3)) if len(s) else np.zeros(0, bool)
    lead = np.flatnonzero(title | given)
    lead = np.unique(np.concatenate((lead, np.searchsorted(s, initial)))) if len(initial) else lead
    after = np.unique(np.concatenate([lead + k for k in (1, 2, 3)])) if len(lead) else lead
    after = after[after < len(s)]
    after = after[big[after]]
    if len(after):
        key = h * np.uint64(tb.MULT) + r.astype(np.uint64)
        at.append(s[big & np.isin(key, key[after])])
    pos = np.unique(np.concatenate(at))
    if not len(pos):
        return []
    row = np.searchsorted(off, pos, "right") - 1
    lo, hi = np.maximum(off[row], pos - CONTEXT), np.minimum(off[row + 1], pos + CONTEXT)
    new = np.ones(len(pos), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    out = []
    for a, z, rr in zip(lo[first].tolist(), hi[last].tolist(), row[first].tolist()):
        start, end = int(off[rr]), int(off[rr + 1])
        while a > start and data[a - 1] not in (32, 10):
            a -= 1
        while z < end and data[z] not in (32, 10):
            z += 1
        out.append((rr, a, z))
    return out


# ------------------------------------------------------------------------------------- training labels


def tokenize(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


_NOT_FAMILY = frozenset("the a an in on for and or of to we it this these that by as at from with is was are street road lane avenue drive court close".split())
_PART = r"(?:(?:van|von|de|der|den|la|le|del|du|di|da|ter|zu) ){0,3}"
_PERSON_RX = re.compile(
    rf"(?P<t>\b(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau)\.? )?(?<![\w@.])(?P<g>{_W}{{2,}}(?:-{_W}+)?)(?: {_W}\.)? (?P<f>{_PART}{_NAME})(?![\w@])"
    rf"|(?<![\w@.])(?P<lf>{_NAME}), (?P<lg>{_W}{{2,}}(?:-{_W}+)?)(?: {_W}\.)?(?![\w@])"
    rf"|(?P<it>\b(?:Dr|Prof|Mr|Mrs|Ms|Miss)\.? )?(?<![\w@.])(?P<i>(?-i:[A-Z])\.(?:[ -]?(?-i:[A-Z])\.)?) (?P<if_>{_PART}{_NAME})(?![\w@])"
)


def _person_iter(text: str, names: Names) -> list[tuple[int, int]]:
    """Stretches with the full form of a person's name: title, given name or initials with a family name.
    Where a match is refused the search goes on one word later, so that no name hides behind another."""
    out, at = [], 0
    while at < len(text):
        m = _PERSON_RX.search(text, at)
        if not m:
            break
        if _accept(m, text, names):
            out.append(m.span())
            at = m.end()
        else:
            nxt = re.compile(r"\W+").search(text, m.start() + 1)
            at = max(m.start() + 1, nxt.end() if nxt else len(text))
    return out


def _accept(m: re.Match, text: str, names: Names) -> bool:
    if (g := m["g"]) is not None:
        fam = m["f"].rsplit(" ", 1)[-1]
        low = fam.lower()
        if not names.is_given(g.lower()) and not m["t"]:
            return False
        if low in _NOT_FAMILY or (names.is_given(low) and not names.is_family(low)):
            return False
        if fam[0].isupper():
            return True
        return not g[0].isupper() and (names.is_family(low) or (len(low) > 3 and bool(names.common) and low not in names.common))
    if (g := m["lg"]) is not None:
        lf = m["lf"].lower()
        return names.is_given(g.lower()) and m["lf"][0].isupper() and not names.is_given(lf) and (names.is_family(lf) or len(lf) > 3)
    fam = m["if_"].rsplit(" ", 1)[-1]
    if re.search(r"\d,? $", text[max(0, m.start() - 6) : m.start()]) or not fam[0].isupper() or fam.lower() in _NOT_FAMILY:
        return False
    return bool(m["it"]) or names.is_family(fam.lower())


def strict(text: str, names: Names) -> list[tuple[int, int, int]]:
    """(start, end, label) by full patterns: the labels of the training sample, used nowhere else."""
    out: list[tuple[int, int, int]] = []
    taken = np.zeros(len(text) + 1, bool)

    def add(a: int, b: int, label: int) -> None:
        if not taken[a:b].any():
            taken[a:b] = True
            out.append((a, b, label))

    for m in EMAIL.finditer(text):
        add(*m.span(), 1)
    for m in ID_FULL.finditer(text):
        if sum(c.isdigit() for c in m["code"]) >= 5:
            add(*m.span("code"), 3)
    for m in ADDRESS.finditer(text):
        add(*m.span(), 4)
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 16:
            add(*m.span(), 2)
    for a, b in _person_iter(text, names):
        add(a, b, 5)
    return out


# ----------------------------------------------------------------------------------------- features

_CACHE: dict[tuple, int] = {}
_ID_SET, _PHONE_SET, _STREET_SET, _TITLE_SET, _PARTICLE_SET = (frozenset(x) for x in (ID_WORDS, PHONE_WORDS, STREET_WORDS, TITLES, PARTICLES))
_WORK_SET = frozenset("grant project report issn isbn doi batch version arxiv agreement pages".split())
_SEPARATORS = frozenset("-.()+/#")
FAR = 9


def _feature(*parts: object) -> int:
    """Bucket of a feature; bucket 0 is for what says nothing and has no weight."""
    if (x := _CACHE.get(parts)) is None:
        if len(_CACHE) > 400_000:
            _CACHE.clear()
        x = _CACHE[parts] = 1 + zlib.crc32("\x1f".join(map(str, parts)).encode()) % (BUCKETS - 1)
    return x


def _shape(t: str) -> str:
    if t[0].isdigit():
        return f"d{min(len(t), 9)}"
    if not (t[0].isalpha()):
        return t[0]
    if len(t) == 1:
        return "X" if t.isupper() else "x"
    return "XX" if t.isupper() else "Xx" if t[0].isupper() else "xx"


def _code(w: str, low: str, names: Names, hidden: bool) -> str:
    """What the lists say of a token: title, initial, given or family name, particle, other word, number, mark."""
    if w[0].isdigit():
        return "0"
    if not w[0].isalpha():
        return w[0]
    if len(w) == 1:
        return "I" if w.isupper() else "i"
    if low in _TITLE_SET:
        return "T"
    if low in _PARTICLE_SET:
        return "P"
    given, family = (False, False) if hidden else names.of(low)
    kind = "g" if given and not family else "b" if given else "f" if family else "l" if low in names.common or len(low) < 4 else "r"
    return kind.upper() if w[0].isupper() else kind


def _distance(marks: list[bool], walls: list[bool], far: int = FAR) -> tuple[list[int], list[int]]:
    """Tokens since the last mark and until the next one, at most far; nothing is seen across a wall (the
    begin of a line)."""
    n = len(marks)
    back, ahead = [far] * n, [far] * n
    for i in range(n):
        back[i] = 0 if marks[i] else far if i == 0 or walls[i] else min(far, back[i - 1] + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = 0 if marks[i] else far if i == n - 1 or walls[i + 1] else min(far, ahead[i + 1] + 1)
    return back, ahead


def _numbers(words: list[str], gaps: list[str]) -> list[tuple[int, int, str, int]]:
    """(first, end, form, digits) of the runs of digit groups with short capitals and separators between:
    the form is the lengths of the groups and the marks between them."""
    n, out, i = len(words), [], 0
    part = [w[0].isdigit() or w in _SEPARATORS or (w.isupper() and len(w) <= 2) or w in ("ext", "x") for w in words]
    while i < n:
        if not part[i]:
            i += 1
            continue
        j = i + 1
        while j < n and part[j] and gaps[j] in ("", " "):
            j += 1
        a, z = i, j
        while a < z and not (words[a][0].isdigit() or words[a] in "+(#" or (words[a].isupper() and a + 1 < z and words[a + 1][0].isdigit())):
            a += 1
        while z > a and not (words[z - 1][0].isdigit() or (words[z - 1].isupper() and z - 1 > a and words[z - 2][0].isdigit())):
            z -= 1
        digits = sum(len(w) for w in words[a:z] if w[0].isdigit())
        if digits:
            form = "".join((gaps[k] if k > a else "") + (f"d{len(words[k])}" if words[k][0].isdigit() else f"L{len(words[k])}" if words[k].isalpha() else words[k]) for k in range(a, min(z, a + 14)))
            out.append((a, z, form, digits))
        i = j
    return out


def _announced(low: list[str], i: int) -> str:
    """The nearest announcing word among the six tokens before a number."""
    for k in range(i - 1, max(-1, i - 7), -1):
        if low[k] in _ID_SET:
            return "id"
        if low[k] in _PHONE_SET:
            return "phone"
        if low[k] in _WORK_SET:
            return "work"
    return "none"


def features(text: str, toks: list[tuple[int, int]], names: Names, hidden: bool = False) -> np.ndarray:
    """Feature buckets of each token, one row a token. hidden: the lists of names say nothing."""
    n = len(toks)
    words = [text[a:b] for a, b in toks]
    low = [w.lower() for w in words]
    shp = [_shape(w) for w in words]
    gaps = [text[(toks[i - 1][1] if i else 0) : toks[i][0]] for i in range(n)]
    wall = ["\n" in g for g in gaps]
    gap = ["n" if x else "" if not g else " " if g == " " else "_" for g, x in zip(gaps, wall)]
    code = [_code(w, l, names, hidden) for w, l in zip(words, low)]
    at = [w == "@" or (l == "at" and 0 < i < n - 1 and words[i - 1] in "([" and words[i + 1] in ")]") for i, (w, l) in enumerate(zip(words, low))]
    at_back, at_ahead = _distance(at, wall, 14)
    street = [l in _STREET_SET or l.endswith(STREET_ENDS) and len(l) > 4 for l in low]
    st_back, st_ahead = _distance(street, wall)
    no_back, no_ahead = _distance([w[0].isdigit() for w in words], wall)
    # tokens without a blank between them are one piece; where the piece has an at-sign, before or after it
    blob = np.cumsum([g != "" for g in gaps]).tolist()
    with_at = {blob[i] for i in range(n) if at[i]}
    form, digits, place, told = [""] * n, [0] * n, [""] * n, [""] * n
    for a, z, f, d in _numbers(words, gaps):
        t = _announced(low, a)
        for k in range(a, z):
            form[k], digits[k], place[k], told[k] = f, min(d, 18), "b" if k == a else "e" if k == z - 1 else "m", t
    # a name or rare word is known by what the lists say of it, not by itself
    word = [s if s[0] == "d" else l if not l[0].isalpha() or len(l) < 3 or l in names.vocab else "\x00" + c for s, l, c in zip(shp, low, code)]
    pad = lambda xs, i, none: xs[i] if 0 <= i < n else none
    fe = _feature
    out = np.empty((n, N_FEATURE), dtype=np.int32)
    for i in range(n):
        c = [pad(code, i + k, "^") for k in range(-3, 4)]
        w = [pad(word, i + k, "^") for k in range(-3, 4)]
        ab, aa, sb, sa = at_back[i], at_ahead[i], st_back[i], st_ahead[i]
        nb, na = no_back[i], no_ahead[i]
        out[i] = (
            fe("b"), fe("w", w[3]), fe("s", shp[i], gap[i]), fe("w-1", w[2]), fe("w-2", w[1]), fe("w-3", w[0]), fe("w+1", w[4]), fe("w+2", w[5]), fe("ww", w[2], w[3]), fe("wx", w[3], w[4]), fe("w--", w[1], w[2], shp[i]),
            fe("c3", c[2], c[3], c[4]), fe("c-", c[1], c[2], c[3]), fe("c+", c[3], c[4], c[5]), fe("c5", c[1], c[2], c[3], c[4], c[5]), fe("c4-", c[0], c[1], c[2], c[3]), fe("c4+", c[3], c[4], c[5], c[6]), fe("cg", c[2], gap[i], c[3]), fe("c2", c[2], c[3]), fe("cn", c[3], c[4]),
            *((fe("ab", ab, shp[i]), fe("aa", aa, shp[i]), fe("a", ab, aa), fe("bl", blob[i] in with_at, ab < 14, aa < 14, gap[i]), fe("abw", ab < 14, w[3]), fe("abp", ab < 14, w[2], w[3])) if ab < 14 or aa < 14 else (0,) * 6),
            *((fe("sb", sb, shp[i]), fe("sa", sa, shp[i]), fe("sn", sb, nb, shp[i]), fe("sm", sa, na, shp[i]), fe("sbn", sb, na, w[3]), fe("sc", min(sb, sa), c[2], c[3], c[4])) if sb < FAR or sa < FAR else (0,) * 6),
            *((fe("f", form[i]), fe("fd", digits[i], told[i], place[i]), fe("ft", form[i][:3], told[i], digits[i]), fe("fw", form[i], w[2]), fe("fx", told[i], shp[i])) if form[i] else (0,) * 5),
        )
    return out


N_FEATURE = 37


# ---------------------------------------------------------------------------------------------- CRF


class Model:
    """weights: buckets x labels; trans: labels x labels, label before to label; skip: labels x labels of
    tokens joined by a skip edge, for lone repeats and for repeats with an equal neighbour."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, skip: np.ndarray):
        self.weights, self.trans, self.skip = (x.astype(np.float32) for x in (weights, trans, skip))


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, skips: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Pseudo-likelihood: each label given its features, its neighbours' labels in the chain and the labels at
    the other ends of its skip edges; Adam, small L2. skips: rows (token, token that speaks to it, kind).
    Labels are given, so a token's gradient needs no other token's: x may be a file, FIT_TOKENS rows are
    read at once."""
    w, t, sk = np.zeros((BUCKETS, N_LABEL)), np.zeros((N_LABEL + 1, N_LABEL)), np.zeros((2, N_LABEL, N_LABEL))
    n = len(x)
    if not n:
        w[:, 0] = 0.1
        return Model(w, np.zeros((N_LABEL, N_LABEL)), sk)
    state = [np.zeros_like(a) for a in (w, w, t, t, sk, sk)]
    skips = skips[np.argsort(skips[:, 0], kind="stable")]
    # rare labels weigh more
    rare = np.sqrt(n / (N_LABEL * np.maximum(1, np.bincount(y, minlength=N_LABEL))))
    for k in range(1, rounds + 1):
        tt, w32 = t[:N_LABEL], w.astype(np.float32)
        gw, gt, g2, gs = np.zeros_like(w), np.zeros_like(t), np.zeros((N_LABEL, N_LABEL)), np.zeros_like(sk)
        for i in range(0, n, FIT_TOKENS):
            j = min(n, i + FIT_TOKENS)
            xb, yb = np.asarray(x[i:j]), y[i:j].astype(np.int64)
            prev = np.where(start[i:j], N_LABEL, np.concatenate((y[i - 1 : i] if i else [N_LABEL], yb[:-1])))
            last = np.concatenate((start[i + 1 : j + 1], [True] * (j == n)))
            nxt = np.where(last, N_LABEL, np.concatenate((yb[1:], y[j : j + 1] if j < n else [N_LABEL])))
            e = skips[np.searchsorted(skips[:, 0], i) : np.searchsorted(skips[:, 0], j)]
            hears, says, kind = e[:, 0] - i, y[e[:, 1]], e[:, 2]
            s = t[prev] + np.concatenate((tt.T, np.zeros((1, N_LABEL))))[nxt]
            for c in range(xb.shape[1]):
                s += w32[xb[:, c]]
            np.add.at(s, hears, sk[kind, says])
            s -= s.max(1, keepdims=True)
            p = np.exp(s)
            p /= p.sum(1, keepdims=True)
            d = (p - np.eye(N_LABEL)[yb]) * rare[yb][:, None] / n
            flat = xb.ravel().astype(np.int64)
            for c in range(N_LABEL):
                gw[:, c] += np.bincount(flat, weights=np.repeat(d[:, c], xb.shape[1]), minlength=BUCKETS)
            np.add.at(gt, prev, d)
            m = nxt < N_LABEL
            np.add.at(g2, nxt[m], d[m])
            np.add.at(gs, (kind, says), d[hears])
        gw[0] = 0.0
        gt[:N_LABEL] += g2.T
        gs = gs + gs.transpose(0, 2, 1)
        for a, g, m1, m2 in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3]), (sk, gs, state[4], state[5])):
            g = g + 2e-6 * a
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            a -= 0.25 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
    return Model(w, t[:N_LABEL], sk)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)


def _beliefs(u: np.ndarray, size: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Normalised log marginals of every token by exact messages along its chain; chains by falling size."""
    f, g = np.zeros_like(u), np.zeros_like(u)
    top = int(size[0]) if len(size) else 0
    for p in range(1, top):
        i = first[: int(np.count_nonzero(size > p))] + p
        f[i] = _lse((f[i - 1] + u[i - 1])[:, :, None] + trans[None], 1)
    for p in range(top - 2, -1, -1):
        i = first[: int(np.count_nonzero(size > p + 1))] + p
        g[i] = _lse((g[i + 1] + u[i + 1])[:, None, :] + trans[None], 2)
    b = u + f + g
    return b - _lse(b, 1)[:, None]


def infer(model: Model, x: np.ndarray, chain: np.ndarray, skips: np.ndarray) -> np.ndarray:
    """Labels by loopy belief propagation: exact messages along the chains, damped messages over the skip
    edges until none changes by more than BP_TOLERANCE (at most BP_ROUNDS rounds). chain: chain number of
    each token (ascending, dense); skips: rows (token, token, kind)."""
    unary = np.zeros((len(x), N_LABEL))
    for c in range(x.shape[1]):
        unary += model.weights[x[:, c]]
    trans = model.trans.astype(float)
    size = np.bincount(chain)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    order = np.argsort(-size, kind="stable")
    belief = _beliefs(unary, size[order], first[order], trans)
    if not len(skips):
        return belief.argmax(1)
    # only chains with a skip edge are read again
    mine = np.zeros(len(size), bool)
    mine[chain[skips[:, :2].ravel()]] = True
    order = order[mine[order]]
    size, first = size[order], first[order]
    rows = np.flatnonzero(mine[chain])
    src, dst = np.concatenate((skips[:, 0], skips[:, 1])), np.concatenate((skips[:, 1], skips[:, 0]))
    back = np.concatenate((np.arange(len(skips)) + len(skips), np.arange(len(skips))))
    at = np.zeros(len(x), dtype=np.int64)
    at[rows] = np.arange(len(rows))
    src, dst, first = at[src], at[dst], at[first]
    u0, b = unary[rows], belief[rows]
    psi = model.skip.astype(float)[np.concatenate((skips[:, 2], skips[:, 2]))]
    msg = np.zeros((len(src), N_LABEL))
    for _ in range(BP_ROUNDS):
        out = _lse((b[src] - msg[back])[:, :, None] + psi, 1)
        new = 0.5 * msg + 0.5 * (out - _lse(out, 1)[:, None])
        moved = np.abs(new - msg).max()
        msg = new
        u = u0.copy()
        np.add.at(u, dst, msg)
        b = _beliefs(u, size, first, trans)
        if moved < BP_TOLERANCE:
            break
    belief[rows] = b
    return belief.argmax(1)


def skip_edges(words: list[str], doc: list[int]) -> np.ndarray:
    """Rows (token, later token, kind) of tokens of one document that are equal, or one edit apart (six letters
    and more), in lower case: equal ones with the last one before, similar ones with the first. Capitalised
    words of more than three letters count, whatever stands around them; kind 1 is a repeat whose word before or after repeats too. The edges
    of a document are linear in its tokens."""
    last: dict[tuple[int, str], int] = {}
    out = []
    n = len(words)

    def beside(i: int, step: int) -> str:
        """The next word with letters on one side, over one mark at most."""
        for j in (i + step, i + 2 * step):
            if 0 <= j < n and doc[j] == doc[i] and words[j][0].isalpha():
                return words[j].lower()
        return ""

    def edge(p: int, i: int) -> tuple[int, int, int]:
        same = lambda x, y: x != "" and (x == y or (len(x) > 5 and one_edit(x, y)))
        return p, i, int(same(beside(p, -1), beside(i, -1)) or same(beside(p, 1), beside(i, 1)))

    for i, (w, d) in enumerate(zip(words, doc)):
        if len(w) > 3 and w[0].isupper():
            k = w.lower()
            if (d, k) in last:
                out.append(edge(last[d, k], i))
            elif len(k) > 5:
                # one letter less on either side, or the same letters but one
                cut = [k[:j] + k[j + 1 :] for j in range(len(k))]
                near = {last[d, "\x00" + v] for v in (k, *cut) if (d, "\x00" + v) in last} | {last[d, v] for v in cut if (d, v) in last}
                out += [edge(p, i) for p in sorted(near)]
                for v in cut:
                    last.setdefault((d, "\x00" + v), i)
            last[d, k] = i
    return np.array(out, dtype=int).reshape(-1, 3)


def one_edit(a: str, b: str) -> bool:
    """At most one letter added, lost or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


_DIGITS = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]{2,}(?:[’'-][^\W\d_]+)*")


def valid(kind: int, s: str, before: str, names: Names) -> bool:
    """Short check of a labelled stretch: has it what makes an item of its kind. A person needs a family name
    beside a listed given name, an initial or a title (which may stand right before the stretch)."""
    digits = len(_DIGITS.findall(s))
    if kind == 1:
        return re.search(r"\w\W{0,3}(?:@|[(\[]at[)\]])\W{0,2}\w.*[.t]", s, re.I) is not None
    if kind == 2:
        return 9 <= digits <= 20
    if kind == 3:
        return digits >= 5
    if kind == 4:
        return digits >= 1 and len(_LETTERS.findall(s)) >= 1
    parts = [x for x in _LETTERS.findall(s) if x.lower() not in _PARTICLE_SET]
    full = [x for x in parts if x.lower() not in _TITLE_SET]
    initial = re.search(r"(?<!\w)[^\W\d_]\.", s) is not None
    titled = len(full) < len(parts) or (_LETTERS.findall(before) or [""])[-1].lower() in _TITLE_SET
    if len(full) > 1 and (titled or any(names.is_given(x.lower()) for x in full)):
        return True
    return bool(full) and initial and (titled or names.is_family(full[-1].lower()))


def find(texts: list[str], doc: list[int], model: Model, names: Names) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, label) of each window."""
    toks = [tokenize(t) for t in texts]
    words, docs = [], []
    for t, tk, d in zip(texts, toks, doc):
        words += [t[a:b] for a, b in tk]
        docs += [d] * len(tk)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not words:
        return out
    x = np.concatenate([features(t, tk, names) for t, tk in zip(texts, toks) if tk])
    chain = np.repeat(np.arange(sum(1 for tk in toks if tk)), [len(tk) for tk in toks if tk])
    y = infer(model, x, chain, skip_edges(words, docs))
    known: set[tuple[int, str]] = set()
    open_: list[tuple[int, int, int]] = []
    k = 0
    for c, (t, tk) in enumerate(zip(texts, toks)):
        lab = y[k : k + len(tk)]
        k += len(tk)
        i = 0
        while i < len(tk):
            if not lab[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(tk) and lab[j + 1] == lab[i]:
                j += 1
            a, b = tk[i][0], tk[j][1]
            if valid(int(lab[i]), t[a:b], t[max(0, a - 12) : a], names):
                out[c].append((a, b, int(lab[i])))
                if lab[i] == 5:
                    known.update((doc[c], w) for w in _name_words(t[a:b]))
            elif lab[i] == 5:
                open_.append((c, a, b))
            i = j + 1
    # a further mention of an accepted person, with two names of it
    for c, a, b in open_:
        ws = _name_words(texts[c][a:b])
        if len(ws) > 1 and all((doc[c], w) in known for w in ws):
            out[c].append((a, b, 5))
    return out


def _name_words(s: str) -> set[str]:
    return {w for x in _LETTERS.findall(s) if (w := x.lower()) not in _TITLE_SET and w not in _PARTICLE_SET}


# -------------------------------------------------------------------------------------------- Spark


def _train_rows(given: tb.Bits, family: tb.Bits):
    """Windows of the sample as text; they are labelled and used on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names(given, family)
        for b in batches:
            keys, out = [], []
            for i, _, data, off in tb.chunks(b["_text"]):
                for r, s, e in windows(data, off, names):
                    keys.append(b["_key"][i + r].as_py())
                    out.append(bytes(data[s:e]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["k", "w"])

    return run


def learn(wins: Iterable[tuple[int, str]], given: tb.Bits, family: tb.Bits, in_order: bool = False) -> tuple[Model, Names]:
    """The model and the names with the known words from windows (document, text) labelled by the strict patterns.
    in_order: the windows come by document, the one without a key last, and text."""
    if not in_order:
        wins = sorted(set(wins), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    bare = Names(given, family)
    with tempfile.TemporaryDirectory(prefix="scriptorium-pii-") as at:
        text, rows = os.path.join(at, "windows"), os.path.join(at, "features")
        with open(text, "wb") as f:
            common, vocab = known_words(_fresh(wins, f), bare)
        names = Names(given, family, common, vocab)
        ys, starts, skips = [], [], [np.zeros((0, 3), np.int32)]
        n = k = 0
        with open(rows, "wb") as f:
            for doc in _stored(text):
                begin, words, twice = n, [], []
                for t in doc:
                    k += 1
                    tk = tokenize(t)
                    if not tk:
                        continue
                    lab = np.zeros(len(tk), dtype=np.int8)
                    for a, b, label in strict(t, names):
                        for i, (s, e) in enumerate(tk):
                            if s < b and e > a:
                                lab[i] = label
                    f.write(features(t, tk, names).astype(np.uint16).tobytes())
                    ys.append(lab)
                    starts.append(n)
                    if (k - 1) % HIDDEN == 0:
                        twice.append((n, t, tk, lab))
                    words += [t[a:b] for a, b in tk]
                    n += len(tk)
                pairs = skip_edges(words, [0] * len(words)) + [begin, begin, 0]
                both = np.concatenate((pairs, pairs[:, [1, 0, 2]]))
                skips.append(both.astype(np.int32))
                for a, t, tk, lab in twice:  # a hidden copy is a further mention: it hears the shown one, and what that hears
                    big = np.array([i for i in range(a, a + len(tk)) if len(words[i - begin]) > 3 and words[i - begin][0].isupper()], dtype=int)
                    own = both[(both[:, 0] >= a) & (both[:, 0] < a + len(tk))]
                    skips += [np.column_stack((big - a + n, big, np.ones(len(big), int))).astype(np.int32), np.column_stack((own[:, 0] - a + n, own[:, 1:])).astype(np.int32)]
                    f.write(features(t, tk, names, hidden=True).astype(np.uint16).tobytes())
                    ys.append(lab)
                    starts.append(n)
                    n += len(tk)
        _CACHE.clear()
        start = np.zeros(n, bool)
        start[starts] = True
        x = np.memmap(rows, np.uint16, "r", shape=(n, N_FEATURE)) if n else np.zeros((0, N_FEATURE), np.uint16)
        return fit(x, np.concatenate(ys) if ys else np.zeros(0, np.int8), start, np.concatenate(skips)), names


def _fresh(wins: Iterable[tuple[int, str]], out) -> Iterator[str]:
    """The windows that are learnt from; out gets them by document. Equal windows of other documents say nothing
    new, but a document keeps all of its own."""
    seen: set[bytes] = set()
    for _, doc in groupby(wins, key=lambda r: r[0]):
        ws = [w for _, w in doc]
        new = {blake2b(w.encode(), digest_size=8).digest() for w in ws} - seen
        if new:
            seen |= new
            pickle.dump(ws, out)
            yield from ws


def _stored(path: str) -> Iterator[list[str]]:
    with open(path, "rb") as f:
        size = os.path.getsize(path)
        while f.tell() < size:
            yield pickle.load(f)


def train(docs: DataFrame, given: tb.Bits, family: tb.Bits, max_docs: int = TRAIN_DOCS) -> tuple[Model, Names]:
    """The model and the names with the known words, from the windows of at most about max_docs documents. The
    windows are made distinct and sorted on the executors; a partition at a time comes to the driver."""
    total = docs.count()
    rate = min(1.0, max_docs / max(1, total))
    picked = docs if rate >= 1 else docs.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    wins = picked.mapInArrow(_train_rows(given, family), "k bigint, w string").distinct().orderBy(F.col("k").asc_nulls_last(), "w")
    return learn((tuple(r) for r in wins.toLocalIterator()), given, family, in_order=True)


def known_words(wins: Iterable[str], names: Names, least: int = 3) -> tuple[frozenset[str], frozenset[str]]:
    """(words that stand in lower case in several windows, not after a given name; words of several windows
    in any case that are no names)."""
    lower: Counter[str] = Counter()
    every: Counter[str] = Counter()
    for t in wins:
        ws = re.findall(r"[^\W\d_]+", t)
        lower.update({w for v, w in zip(["", *ws], ws) if w.islower() and not (v and names.is_given(v.lower()))})
        every.update({w.lower() for w in ws})
    common = frozenset(w for w, n in lower.items() if n >= least)
    fixed = _ID_SET | _PHONE_SET | _STREET_SET | _TITLE_SET | _PARTICLE_SET | _WORK_SET
    return common, fixed | frozenset(w for w, n in every.items() if n >= least and not any(names.of(w)))


WINDOW_BYTES = 1 << 18  # windows labelled at once; a document's windows are never parted


def _find_run(names: Names, model: Model, with_text: bool):
    def spans(b: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
        """(row, its bytes, spans in bytes) of the rows with windows, in order."""
        for i, _, data, off in tb.chunks(b["_text"]):
            win = windows(data, off, names)
            k = 0
            while k < len(win):
                j, size = k, 0
                while j < len(win) and (size < WINDOW_BYTES or win[j][0] == win[j - 1][0]):
                    size += win[j][2] - win[j][1]
                    j += 1
                texts = [bytes(data[s:e]).decode("utf-8", "replace") for _, s, e in win[k:j]]
                per: dict[int, list[tuple[int, int, int]]] = {}
                for (r, s, _), t, got in zip(win[k:j], texts, find(texts, [r for r, _, _ in win[k:j]], model, names)):
                    lo = s - int(off[r])
                    per.setdefault(r, []).extend((lo + len(t[:a].encode()), lo + len(t[:z].encode()), x) for a, z, x in got)
                for r, got in per.items():
                    yield i + r, bytes(data[off[r] : off[r + 1]]) if with_text else b"", got
                k = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if with_text:
                count, texts = [0] * b.num_rows, b["_text"].to_pylist()
                for row, raw, got in spans(b):
                    out, at = [], 0
                    for a, z, x in sorted(got):
                        out += [raw[at:a], b"<" + KINDS[x - 1].encode() + b">"]
                        at = z
                    count[row], texts[row] = len(got), b"".join([*out, raw[at:]]).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([b["_key"], pa.array(count, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "n_items", "redacted"])
            else:
                rows = [(row, x, n) for row, _, got in spans(b) for x, n in sorted(Counter(x for _, _, x in got).items())]
                keys = b["_key"].take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([KINDS[r[1] - 1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "pii_kind", "n"])

    return run


def _prepared(docs: DataFrame, authors: DataFrame, key: str, text: str):
    ship(docs.sparkSession)
    d = docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text"))
    given, family = name_lists(authors)
    model, names = train(d, given, family)
    return spread(d), lambda with_text: _find_run(names, model, with_text)


def found(docs: DataFrame, authors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_kind, n). One scan of the documents besides the training sample; nothing is shuffled."""
    d, run = _prepared(docs, authors, key, text)
    return d.filter(F.length("_text") > 0).mapInArrow(run(False), "doc_id bigint, pii_kind string, n int").withColumnRenamed("doc_id", key)


def redacted(docs: DataFrame, authors: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_items, redacted): every document with typed placeholders in place of personal data."""
    d, run = _prepared(docs, authors, key, text)
    return d.mapInArrow(run(True), "doc_id bigint, n_items int, redacted string").withColumnRenamed("doc_id", key)
