"""Problem 3: variant spellings of names are linked to one person or group.

Method: metric-space partitioning. Every distinct name is parsed into given names, initials and a
family key (for groups: head word, topic, kind). The family keys are points under the unrestricted
Damerau-Levenshtein distance, a true metric. Pivots drawn from the points cut the space into cells; a
point belongs to the cell of its nearest pivot and is copied to every other cell that can hold a
neighbour within the radius (triangle inequality: d(x, p) <= d(x, home) + 2r and <= radius of the
cell + r). Inside a cell an exact radius join is run, band by band of the distance to the pivot. Within
equal or neighbouring family keys, given names are then compared, by joins on family and given name:
equal, nickname, initial, or one edit where one of the two is no name of its own. Spellings that agree
become one class.

Work is on distinct strings; a string that fills a third of all rows counts once. Results are classes
(name, class id); pairs are made only for p3_found, which asks for them, between different strings of
one class.

Defined results: null, empty and filler entries (Anonymous, et al.) name nobody and get no class;
a name without partner is a class of its own; an initial that fits several people of a family is
given to none of them; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm import textbytes as tb
from scriptorium.session import durable, ship

MIN_FAMILIES = 2
ESTABLISHED = 3
MISSPELT = 0.15
RADIUS = 1
POINTS_PER_CELL = 64
MAX_PIVOTS = 1024  # distances per point; bands keep the cells' parts small beyond it
MIN_EDIT_LENGTH = 5  # of shorter keys one edit apart, one has to be a rarity beside the other

# fixed values: common nicknames and the names they stand for
NICKNAMES = (
    "alex:alexander alexandra,al:albert alan,andy:andrew,tony:anthony antonio,bea:beatrice,ben:benjamin benedikt,bert:albert robert,bob:robert,rob:robert,bobby:robert,charlie:charles charlotte,lottie:charlotte,chris:christopher christian christina,"
    "dan:daniel,danny:daniel,dave:david,dora:dorothea theodora,dot:dorothea,ed:edward edmund,eddie:edward,ted:edward theodore,nell:eleanor helen,ellie:eleanor,liz:elizabeth,beth:elizabeth,betty:elizabeth,eliza:elizabeth,fred:frederick alfred,freddie:frederick,"
    "gabi:gabriela,greg:gregory,harry:harold henry,hal:harold henry,nacho:ignacio,izzy:isabel,bel:isabel,jim:james,jimmy:james,jack:john,johnny:john,jon:jonathan,jo:josephine joanna,josie:josephine,joe:joseph,judy:judith,kate:katherine,kathy:katherine,katie:katherine,kit:christopher,"
    "larry:lawrence,laurie:lawrence,len:leonard,leo:leonard,lena:magdalena helena,maggie:margaret,peggy:margaret,meg:margaret,greta:margaret,matt:matthew,max:maximilian,mike:michael,mick:michael,nick:nicholas,nicky:nicholas,pat:patricia patrick,patty:patricia,trish:patricia,paddy:patrick,pete:peter,phil:philip,pippa:philippa,"
    "becky:rebecca,becca:rebecca,dick:richard,rick:richard,rich:richard,ron:ronald,roz:rosalind,sam:samuel samantha,sandy:sandra alexander,seb:sebastian,steve:stephen steven,sue:susan susannah,susie:susan susannah,theo:theodore,tom:thomas,tommy:thomas,tim:timothy,tina:valentina christina,val:valentina valerie,vic:victor,vicky:victoria,vince:vincent,"
    "wally:walter,walt:walter,mina:wilhelmina,minnie:wilhelmina,bill:william,will:william,billy:william,zach:zachary,zack:zachary"
)
NICK = {n: frozenset(full.split()) for n, full in (x.split(":") for x in NICKNAMES.split(","))}
# fixed values: particles, name suffixes, fillers and words for kinds of groups
PARTICLES = frozenset("van von vonder dela der den de la le del della du di da dos das el ter ten zu zur zum af av bin ibn".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md msc bsc dr prof mr mrs ms".split())
FILLERS = frozenset(("", "anonymous", "anon", "et al", "etal", "others", "and others", "na", "n a", "none", "null", "unknown", "author", "authors", "unknown author", "tba", "tbd", "various"))
GROUP_KINDS = {
    "consortium": "consortium", "institute": "institute", "inst": "institute", "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "collaboration": "collaboration", "collab": "collaboration",
    "working group": "working group", "wg": "working group", "research network": "research network", "rn": "research network", "network": "network", "group": "group", "team": "team", "society": "society", "center": "center", "centre": "center",
    "committee": "committee", "association": "association", "initiative": "initiative", "project": "project", "consort": "consortium", "foundation": "foundation",
}


def plain(s: str) -> str:
    """Lower case without diacritics."""
    s = s.lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def fold(s: str) -> str:
    """plain, with ue, oe, ae and u, o, a as one: umlauts are written either way."""
    return re.sub(r"([aou])e+", r"\1", plain(s))


_INITIALS = re.compile(r"(?:[^\W\d_]\.[ -]?)+(?:[^\W\d_])?|[^\W\d_]")
_GLUED = re.compile(r"^(DeLa|Dela|VonDer|Vonder|Van|Von|De|Del|Du|Di)(?=[A-ZÀ-ÞŠŽ][a-zà-ÿ])")


def _initials(tok: str, shouting: bool) -> str | None:
    """Letters of a token made of initials (A., A.B., M.-L., KH), else None."""
    if _INITIALS.fullmatch(tok):
        return "".join(c for c in fold(tok) if c.isalpha())
    if not shouting and tok.isupper() and tok.isalpha() and len(tok) <= 3:
        return fold(tok)
    return None


def parse(name: str, given: Container[str]) -> dict | None:
    """Parts of a name: kind p or g; family key; given name; initials; nickname. None for fillers."""
    s = re.sub(r"\([^)]*\)", " ", name)
    nick = re.search(r"[\"“„'‘]([^\W\d_]{2,})[\"”’']", s)
    s = re.sub(r"[\"“„][^\"”]*[\"”]", " ", s)
    s = re.sub(r"\s+", " ", s).strip(" ,;")
    flat = re.sub(r"[^\w ]+", " ", fold(s))
    flat = re.sub(r"\s+", " ", flat).strip()
    if flat in FILLERS or sum(c.isalpha() for c in flat) < 3:
        return None
    if g := _group(s, flat):
        return g
    shouting = s.upper() == s
    parts = [p.strip() for p in s.split(",") if p.strip()]
    parts = [p for p in parts if fold(p).replace(".", "") not in SUFFIXES]
    if not parts:
        return None
    inverted = len(parts) > 1

    def clean(tok: str) -> list[str]:
        m = _GLUED.match(tok)
        return [m[1], tok[m.end() :]] if m and plain(tok) not in given else [tok]

    toks = [t for p in (parts if not inverted else parts[:2]) for t in ["|", *[c for x in p.split(" ") for c in clean(x)]]][1:]
    toks = [t for t in toks if fold(t).replace(".", "") not in SUFFIXES or len(t) <= 2]
    if "|" in toks:
        cut = toks.index("|")
        fam, giv = toks[:cut], toks[cut + 1 :]
    else:
        fam, giv = _order(toks, given, shouting)
    fam = [t for t in fam if fold(t) not in PARTICLES] or fam
    raw = re.sub(r"[^a-z0-9Ͱ-￿]", "", plain("".join(fam)))
    key = fold(raw)
    if not key:
        return None
    full, ini = "", ""
    for t in giv:
        i = _initials(t, shouting)
        if shouting and i is None and len(t) == 1:
            i = fold(t)
        if i is not None:
            ini += i
        elif fold(t) not in PARTICLES:
            w = re.sub(r"[^a-zͰ-￿-]", "", plain(t))
            if not full:
                full = w
                ini += "".join(p[0] for p in w.split("-") if p)
            else:
                ini += w[:1]
    if not full and not ini:
        full = ""
    return {"kind": "p", "family": key, "given": full, "initials": ini, "nick": plain(nick[1]) if nick else "", "topic": "", "raw": raw}


def _order(toks: list[str], given: Container[str], shouting: bool) -> tuple[list[str], list[str]]:
    """(family tokens, given tokens) of a name without comma."""
    if len(toks) == 1:
        return toks, []
    low = [plain(t) for t in toks]
    at = next((i for i, t in enumerate(low) if t in PARTICLES), None)
    if at is not None:
        end = at
        while end < len(low) - 1 and low[end] in PARTICLES:
            end += 1
        if at == 0:  # van Berg Anna
            return toks[: end + 1], toks[end + 1 :]
        return toks[at:], toks[:at]
    known = [t in given or t in NICK for t in low]
    ini = [_initials(t, shouting) is not None for t in toks]
    if not known[0] and not ini[0] and (known[-1] or ini[-1]):
        return toks[:1], toks[1:]
    return toks[-1:], toks[:-1]


def _group(s: str, flat: str) -> dict | None:
    words = [w for w in re.sub(r"[^\w]+", " ", flat).split() if w != "the"]
    joined = " ".join(words)
    for k in sorted(GROUP_KINDS, key=len, reverse=True):
        m = re.search(rf"(?<!\w){k}(?!\w)", joined)
        if m and len(words) > len(k.split()):
            rest = (joined[: m.start()] + " | " + joined[m.end() :]).split()
            if "for" in rest or "of" in rest:  # Institute for Topic, Head
                rest = [w for w in rest if w not in ("|", "for", "of", "and")]
                head, topic = rest[-1], rest[:-1]
            else:
                rest = [w for w in rest if w not in ("|", "and")]
                head, topic = rest[0], rest[1:]
            if not topic and k in ("group", "team", "project", "lab"):
                return None
            return {"kind": "g", "family": head, "given": GROUP_KINDS[k], "initials": "".join(w[0] for w in topic) if not (len(topic) == 1 and len(topic[0]) <= 3) else topic[0], "nick": "", "topic": " ".join(topic), "raw": head}
    return None


# ---------------------------------------------------------------------------------------- the metric


def codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(words), width), dtype=np.int32)
    size = np.array([len(w) for w in words], dtype=np.int64)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out, size


def distances(words: list[str], pivot: str) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of every word to the pivot, all words at once."""
    n, m = len(words), len(pivot)
    top = max((len(w) for w in words), default=0)
    x, size = codes(words, max(1, top))
    big = top + m
    h = np.full((n, top + 2, m + 2), big, dtype=np.int16)
    h[:, 1:, 1] = np.arange(top + 1)
    h[:, 1, 1:] = np.arange(m + 1)
    letters = {c: k for k, c in enumerate(sorted(set(pivot)))}
    last = np.zeros((n, len(letters)), dtype=np.int64)  # last row in which the letter stood
    rows = np.arange(n)
    for i in range(1, top + 1):
        col = np.zeros(n, dtype=np.int64)
        for j in range(1, m + 1):
            k = letters[pivot[j - 1]]
            i1, j1 = last[:, k], col
            same = x[:, i - 1] == ord(pivot[j - 1])
            sub = h[:, i, j] + ~same
            best = np.minimum(np.minimum(sub, h[:, i + 1, j] + 1), h[:, i, j + 1] + 1)
            swap = h[rows, i1, j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
            h[:, i + 1, j + 1] = np.minimum(best, swap)
            col = np.where(same, j, col)
        for c, k in letters.items():
            last[:, k] = np.where(x[:, i - 1] == ord(c), i, last[:, k])
    return h[rows, size + 1, m + 1].astype(np.int64)


def within_one(a: str, b: str) -> bool:
    """Distance of at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _homes(pivots: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b["point"].to_pylist()
            d = np.stack([distances(words, p) for p in pivots], 1) if words else np.zeros((0, len(pivots)), int)
            near = d.argmin(1) if words else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b["point"], pa.array(near, pa.int32()), pa.array(d[np.arange(len(words)), near], pa.int32())], names=["point", "cell", "d"])

    return run


def _copies(pivots: list[str], reach: list[int], r: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.array(reach)
        for b in batches:
            words = b["point"].to_pylist()
            if not words:
                continue
            d = np.stack([distances(words, p) for p in pivots], 1)
            home = d.argmin(1)
            least = d[np.arange(len(words)), home]
            ok = (d <= least[:, None] + 2 * r) & (d <= limit[None, :] + r) & (limit[None, :] >= 0)
            ok[np.arange(len(words)), home] = True
            i, c = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in i.tolist()], pa.string()), pa.array(c, pa.int32()), pa.array(d[i, c], pa.int32()), pa.array(home[i] == c)], names=["point", "cell", "d", "home"])

    return run


def _cell_join(pdf):
    """Exact radius join of a band of a cell: its own points against the points of the bands around it."""
    import pandas as pd

    by_len: dict[int, list[str]] = {}
    for p in pdf["point"].drop_duplicates():
        by_len.setdefault(len(p), []).append(p)
    out = []
    for p in pdf.loc[pdf["mine"], "point"].drop_duplicates():
        for n in range(len(p) - RADIUS, len(p) + RADIUS + 1):
            out += [(p, q) for q in by_len.get(n, ()) if q != p and within_one(p, q)]
    return pd.DataFrame(out, columns=["a", "b"])


def neighbours(points: DataFrame) -> DataFrame:
    """All ordered pairs (a, b) of different points within the radius; points has one column, point.

    A cell is cut into bands by the distance to its pivot and by length: by the triangle inequality, again,
    neighbours differ by at most the radius in both. A home point stands in its own band and is copied to the
    eight around it, so a hot cell is spread over its bands and none of them sees the whole cell."""
    ship(points.sparkSession)
    n = points.count()
    k = min(MAX_PIVOTS, max(1, n // POINTS_PER_CELL))
    pivots = [r.point for r in points.orderBy(F.xxhash64("point"), "point").limit(k).collect()]
    if not pivots:
        return points.select(F.col("point").alias("a"), F.col("point").alias("b"))
    parts = points.repartition(max(1, n // 2000 + 1))
    home = parts.mapInArrow(_homes(pivots), "point string, cell int, d int")
    stat = {r.cell: r.d for r in home.groupBy("cell").agg(F.max("d").alias("d")).collect()}
    reach = [stat.get(c, -1) for c in range(len(pivots))]
    cop = parts.mapInArrow(_copies(pivots, reach, RADIUS), "point string, cell int, d int, home boolean").withColumn("size", F.length("point"))
    step = lambda: F.explode(F.sequence(F.lit(-RADIUS), F.lit(RADIUS)))
    near = cop.withColumn("_d", step()).withColumn("_s", step())
    near = near.select("cell", (F.col("d") + F.col("_d")).alias("band"), (F.col("size") + F.col("_s")).alias("of"), "point", (F.col("home") & (F.col("_d") == 0) & (F.col("_s") == 0)).alias("mine"))
    return near.groupBy("cell", "band", "of").applyInPandas(_cell_join, "a string, b string")


# ------------------------------------------------------------------------------------------ linking


def distinct_names(meta: DataFrame, column: str = "authors") -> DataFrame:
    """(name, n) of the different strings; combined before the shuffle."""
    return meta.select(F.explode(column).alias("name")).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _given_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = {plain(w) for w in b["first"].to_pylist()} - PARTICLES - {"the"}
        block, bits = tb.bit_rows(np.array([tb.hash_word(w) for w in sorted(words)], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits)], names=["block", "bits"])


def given_names(names: DataFrame) -> tb.Bits:
    """Tokens that stand before several families: given names, as a bit filter of fixed size."""
    w = names.filter(~F.col("name").contains(",")).select(F.regexp_extract_all(F.regexp_replace("name", r"\([^)]*\)|\"[^\"]*\"", " "), F.lit(r"(?U)\p{L}[\p{L}’'-]+"), 0).alias("w")).filter("size(w) between 2 and 5")
    p = w.select(F.lower(F.element_at("w", 1)).alias("first"), F.lower(F.element_at("w", -1)).alias("last")).distinct()
    f = p.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    l = p.groupBy("last").agg(F.count(F.lit(1)).alias("m"))
    told = f.filter(F.col("n") >= MIN_FAMILIES).join(l, F.col("first") == F.col("last"), "left").filter(F.col("n") > 2 * F.coalesce("m", F.lit(0))).select("first")
    got = told.mapInArrow(_given_bits, "block bigint, bits bigint").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    return tb.Bits(got["block"].to_numpy(), got["bits"].to_numpy().view(np.uint64))


def _parse_batches(given: tb.Bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(nm, n, p) for nm, n in zip(b["name"].to_pylist(), b["n"].to_pylist()) if (p := parse(nm, given))]
            cols = [[r[0] for r in rows], [r[1] for r in rows], *[[r[2][k] for r in rows] for k in ("kind", "family", "given", "initials", "nick", "topic", "raw")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], names=["name", "n", "kind", "family", "given", "initials", "nick", "topic", "raw"])

    return run


def parsed(names: DataFrame) -> DataFrame:
    ship(names.sparkSession)
    return names.mapInArrow(_parse_batches(given_names(names)), "name string, n bigint, kind string, family string, given string, initials string, nick string, topic string, raw string")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of given names that are one edit apart."""
    for b in batches:
        ok = [within_one(x, y) for x, y in zip(b["ga"].to_pylist(), b["gb"].to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _cuts(word: str) -> Column:
    """The word and what is left of it without one of its letters."""
    w = F.col(word)
    one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(F.array(w), one))


def full_edges(full: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b) of people with full given names. Every rule is a join on family and given name (or a nickname or
    a given name without a letter), so that no family, however hot, has to stand in one task.
    full: (node, family, given, n); near: ordered pairs (fa, fb) of neighbouring families."""
    spark = full.sparkSession
    a = full.select(F.col("node").alias("a"), F.col("family").alias("fa"), F.col("given").alias("ga"), F.col("n").alias("na"))
    b = full.select(F.col("node").alias("b"), F.col("family").alias("fb"), F.col("given").alias("gb"), F.col("n").alias("nb"))
    around = a.join(near, "fa")  # each person in the neighbouring families
    equal = around.withColumn("gb", F.col("ga")).join(b, ["fb", "gb"]).select("a", "b")
    # nicknames, in the same family and in neighbouring ones; the list is fixed
    nick = F.broadcast(spark.createDataFrame([(n, g) for n, gs in NICK.items() for g in sorted(gs)], "ga string, gb string"))
    named = around.select("a", "fb", "ga").unionByName(a.select("a", F.col("fa").alias("fb"), "ga")).join(nick, "ga").join(b, ["fb", "gb"]).select("a", "b")
    # one edit in the given name: same family, and one of the two is no name of its own (known in fewer than
    # ESTABLISHED families, or in far fewer than the other)
    fam = full.groupBy("given").agg(F.count_distinct("family").alias("k"))
    own = F.when(F.col("k") >= ESTABLISHED, F.col("k"))
    ea, eb = fam.select(F.col("given").alias("ga"), own.alias("ka")), fam.select(F.col("given").alias("gb"), own.alias("kb"))
    va = a.filter(F.length("ga") >= 3).select("a", "fa", "ga", "na", F.explode(_cuts("ga")).alias("v"))
    vb = b.filter(F.length("gb") >= 2).select("b", F.col("fb").alias("fa"), "gb", "nb", F.explode(_cuts("gb")).alias("v"))
    cand = va.join(vb, ["fa", "v"]).filter("ga <> gb").drop("v").distinct()
    folded = lambda c: F.regexp_replace(c, r"([aou])e+", "$1")
    alike = a.filter(F.length("ga") >= 3).withColumn("v", folded("ga")).join(b.withColumn("v", folded("gb")).withColumnRenamed("fb", "fa"), ["fa", "v"]).filter("ga <> gb")
    weak = F.col("ka").isNull() | (F.col("ka") < MISSPELT * F.coalesce("kb", F.lit(0)))
    told = lambda d: d.join(ea, "ga").join(eb, "gb").filter(weak & (F.col("kb").isNotNull() | (F.col("nb") >= F.col("na"))))
    edited = told(cand).select("a", "b", "ga", "gb").mapInArrow(_verify, "a string, b string")
    return equal.unionByName(named).unionByName(edited).unionByName(told(alike).select("a", "b"))


def initial_edges(full: DataFrame, short: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short form, its only person) and (short form, short form) of names with initials or a family alone.

    The people of a family are summed up by their initials first: the least and greatest component and the
    commonest form of each. An initial is given to a person only if all people it fits are one component: those
    of its own family if there are any, else those of neighbouring ones; a second initial that fits decides.
    full: (node, family, initials, n, root); short: (node, family, initials)."""
    first = F.substring("initials", 1, 1).alias("c1")
    sums = full.groupBy("family", first, F.substring("initials", 1, 2).alias("c2")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("n", "node")).alias("top"))
    s = short.select(F.col("node").alias("s"), F.col("family").alias("fa"), first, F.substring("initials", 1, 2).alias("i2"))
    x = sums.withColumnRenamed("family", "fb")
    got = s.withColumn("fb", F.col("fa")).unionByName(s.join(near, "fa")).join(x, ["fb", "c1"]).withColumn("own", F.col("fa") == F.col("fb"))
    mine = Window.partitionBy("s")
    got = got.withColumn("_o", F.max("own").over(mine)).filter("own or not _o")
    two = (F.length("i2") > 1) & (F.col("c2") == F.col("i2"))
    one = (F.length("i2") > 1) & (F.length("c2") == 1)
    got = got.withColumn("_r", F.when(F.max(two).over(mine), two).when(F.max(one).over(mine), one).otherwise(True)).filter("_r")
    g = got.groupBy("s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("top").alias("top"))
    to_person = g.filter("lo = hi").select(F.col("s").alias("a"), F.col("top.node").alias("b"))
    # initials that fit nobody: with their like of the family, and with their like of neighbouring ones
    alone = s.join(g.select("s"), "s", "left_anti")
    rep = alone.groupBy("fa", "c1").agg(F.min("s").alias("b"))
    likes = alone.join(rep, ["fa", "c1"]).select(F.col("s").alias("a"), "b")
    beyond = rep.join(near, "fa").join(s.select(F.col("fa").alias("fb"), "c1", F.col("s").alias("a")), ["fb", "c1"]).select("a", "b")
    return to_person, likes.unionByName(beyond).filter("a <> b")


def _group_edges(pdf):
    """Groups of one kind under a head and its neighbours. The rows are distinct spellings; they meet by keys:
    topic, acronym, words of the topic, topic without a word."""
    import pandas as pd

    home = pdf["center"].iloc[0]
    forms = [(r.node, r.family, tuple(r.topic.split()), r.initials) for r in pdf[["node", "family", "initials", "topic"]].drop_duplicates("node").itertuples(index=False)]
    out: set[tuple[str, str]] = set()
    topic, acronym, word, gap = {}, {}, {}, {}
    for f in forms:
        t = f[2]
        topic.setdefault(t, []).append(f)
        if len(t) == 1 and len(t[0]) <= 4:
            acronym.setdefault(t[0], []).append(f)
        for w in set(t):
            word.setdefault(w, []).append(f)
        for i in range(len(t)):
            gap.setdefault((len(t), i, t[:i], t[i + 1 :]), []).append(f)
    for a in forms:
        t = a[2]
        like = [*topic[t], *acronym.get(a[3], ())]
        if t:
            some = set(t)
            rare = min(some, key=lambda w: (len(word[w]), w))
            like += [b for b in word[rare] if some <= set(b[2])]
        for i in range(len(t)):
            like += [b for b in gap[len(t), i, t[:i], t[i + 1 :]] if b[1] == a[1] and within_one(t[i], b[2][i])]
        out.update((a[0], b[0]) for b in like if b[0] != a[0] and home in (a[1], b[1]))
    return pd.DataFrame(sorted(out), columns=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each component; each round also jumps to the root's root. The rounds go
    on until no label changes."""
    e = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    lab = durable(nodes.select("node", F.col("node").alias("root")))
    while True:
        least = e.join(lab, e.b == lab.node).groupBy("a").agg(F.min("root").alias("r2"))
        nxt = lab.join(least, lab.node == least.a, "left").select("node", "root", F.least("root", F.coalesce("r2", "root")).alias("new"))
        jump = nxt.select(F.col("node").alias("_n"), F.col("new").alias("_r"))
        nxt = durable(nxt.join(jump, nxt.new == jump["_n"], "left").select("node", "root", F.least("new", F.coalesce("_r", "new")).alias("new")))
        changed = nxt.filter("root <> new").limit(1).count()
        lab = nxt.select("node", F.col("new").alias("root"))
        if not changed:
            return lab


def classes(meta: DataFrame, column: str = "authors") -> DataFrame:
    """(name, n, class_id, n_links) of every string that names somebody; n_links is the number of other
    spellings in its class."""
    p = durable(parsed(distinct_names(meta, column)).withColumn("node", F.concat_ws("\x1f", "kind", "family", "given", "initials", "topic")))
    p = p.withColumn("node", F.when(F.col("kind") == "p", F.concat_ws("\x1f", F.lit("p"), "family", F.when(F.col("given") != "", F.col("given")).otherwise(F.concat(F.lit("."), F.col("initials"))))).otherwise(F.col("node")))
    nodes = durable(p.groupBy("node", "kind", "family", "given", "topic").agg(F.max_by("initials", F.struct(F.length("initials"), "initials")).alias("initials"), F.sum("n").alias("n")))
    # a key is a point as it is written and with its umlauts folded; either may be near another key
    key = F.concat("kind", "family")
    points = durable(p.select(F.concat("kind", "raw").alias("point"), key.alias("key")).union(p.select(key.alias("point"), key.alias("key"))).distinct())
    near = neighbours(points.select("point").distinct()).filter(F.substring("a", 1, 1) == F.substring("b", 1, 1))
    ka, kb = points.select(F.col("point").alias("a"), F.col("key").alias("ka")), points.select(F.col("point").alias("b"), F.col("key").alias("kb"))
    near = near.join(ka, "a").join(kb, "b").filter("ka <> kb").select("ka", "kb").distinct()
    # short keys one edit apart are mostly different names: there one has to be a rarity beside the other
    many = nodes.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("k"))
    near = near.join(many.select(F.col("key").alias("ka"), F.col("k").alias("na")), "ka").join(many.select(F.col("key").alias("kb"), F.col("k").alias("nb")), "kb")
    long_ = (F.length("ka") > MIN_EDIT_LENGTH) & (F.length("kb") > MIN_EDIT_LENGTH)
    near = durable(near.filter(long_ | (F.least("na", "nb") < MISSPELT * F.greatest("na", "nb"))).select(F.substring("ka", 1, 1).alias("kind"), F.expr("substring(ka, 2)").alias("fa"), F.expr("substring(kb, 2)").alias("fb")))
    people = near.filter("kind = 'p'").select("fa", "fb")
    full, short = nodes.filter("kind = 'p' and given <> ''"), nodes.filter("kind = 'p' and given = ''")
    # each head of groups with itself and its neighbours
    heads = nodes.filter("kind = 'g'")
    star = near.filter("kind = 'g'").select(F.col("fa").alias("center"), F.col("fb").alias("family")).unionByName(heads.select(F.col("family").alias("center"), "family").distinct())
    groups = star.join(heads, "family").groupBy("center", "given").applyInPandas(_group_edges, "a string, b string")
    # a nickname in quotation marks stands beside the full name in one string: no edge needed
    lab = components(nodes.filter("kind <> 'p' or given <> ''").select("node"), full_edges(full.select("node", "family", "given", "n"), people).unionByName(groups))
    to_person, likes = initial_edges(full.join(lab, "node").select("node", "family", "initials", "n", "root"), short.select("node", "family", "initials"), people)
    named = to_person.join(lab.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
    rest = short.select("node").join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    lab = durable(lab.unionByName(rest))
    # short forms without a person join what they resemble
    r = lambda c: lab.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    tied = durable(likes.join(r("a"), "a").join(r("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    if tied.limit(1).count():
        up = components(tied.select(F.col("a").alias("node")).union(tied.select("b")).distinct(), tied).select(F.col("node").alias("root"), F.col("root").alias("up"))
        lab = lab.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = durable(p.join(lab, "node").select("name", "n", F.sha1("root").alias("class_id")))
    size = out.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    return out.join(size, "class_id").select("name", "n", "class_id", "n_links")


def pairs(cls: DataFrame) -> DataFrame:
    """Pairs of different strings of one class. Classes hold the spellings of one person or group."""
    a, b = cls.select("class_id", F.col("name").alias("name_a")), cls.select("class_id", F.col("name").alias("name_b"))
    return a.join(b, "class_id").filter(F.encode("name_a", "UTF-8") < F.encode("name_b", "UTF-8")).select("name_a", "name_b")
