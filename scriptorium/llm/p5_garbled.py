"""Problem 5: text decoded in a wrong encoding.

Method: expectation-maximization with a latent encoding chain. A chain says through which wrong
decoding a word went (UTF-8 read as a single-byte encoding, once or twice, or one single-byte encoding
read as another). For every distinct word with non-ASCII characters the chains that can be undone
give candidate originals. The E-step weighs 'clean' against the chains, in each source and field of its
own, by the chains' prior there and by how well the candidate reads: a character model and the support
of the same word elsewhere. The M-step re-estimates the character model, the word support, the overall
priors and the priors of every source and field (shrunk to the overall ones) from the weighted words, so
that weak evidence in many records of a source adds up. The rounds go on until the garbled mass settles;
each record is repaired by the posterior of its own source and field.

All work is on distinct words: records are reduced to (field, source, word) counts before anything is
shuffled. What is collected is the character model, bounded by the alphabet, and the chain priors.

A word with U+FFFD lost its bytes: it is garbled and repaired only where a single clean word of the
corpus fits its shape.

Defined results: null and empty texts, and texts in ASCII, have no garbled words; a null source
is a source of its own; equal texts are treated alike if their source is; words of correct accents
and other scripts stay untouched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.session import durable, is_small, ship

ROUNDS = 20  # at most; the loop ends when the garbled mass moves by no more than TOLERANCE of it
TOLERANCE = 0.02
SHRINK = 50.0
SLIGHT = -14.0
CLEAN_PRIOR = 0.97
BROADCAST_ROWS = 100_000
WORD = r"(?<![A-Za-z0-9\-\u0080-￿])[A-Za-z0-9\-]*+[\u0080-￿][A-Za-z0-9\-\u0080-￿]*"
ODD = r"[\u0080-\u009f\ufffd\u2500-\u25ff]|\p{IsLatin}\p{IsCyrillic}|\p{IsCyrillic}\p{IsLatin}"
CLEAN, UNKNOWN, LOST = "clean", "unknown", "lost bytes"

# fixed values: pairs of (original encoding, encoding it was read in)
UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp437", "cp850", "mac_roman", "cp866", "iso8859_15", "cp1253", "cp1254")
LEGACY_PAIRS = (
    ("cp1251", "cp1252"), ("cp1251", "latin_1"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("iso8859_2", "cp1252"), ("cp1252", "iso8859_2"),
)
TWICE = ("cp1252", "latin_1")
QUOTES = "«»“”„‘’"


def _table(codec: str) -> list[str]:
    """Byte to character; bytes the encoding leaves open become control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Chains:
    def __init__(self) -> None:
        self.table = {c: _table(c) for c in {*UTF8_READ_AS, *(x for p in LEGACY_PAIRS for x in p)}}
        self.back = {c: {ch: b for b, ch in reversed(list(enumerate(t)))} for c, t in self.table.items()}
        self.names = [f"utf_8>{c}" for c in UTF8_READ_AS] + [f"utf_8>{c} twice" for c in TWICE] + [f"{a}>{b}" for a, b in LEGACY_PAIRS]

    def _bytes(self, s: str, codec: str) -> bytes | None:
        m = self.back[codec]
        try:
            return bytes([m[c] for c in s])
        except KeyError:
            return None

    def undo(self, s: str) -> list[tuple[str, str]]:
        """(chain, original) for every chain that can be undone. A no-break space lost at the end of
        the word is put back; quotation marks around the word may be right although it isn't."""
        out = dict(reversed(self._undo(s)))
        for n, t in self._undo(s + "\xa0"):
            if n.startswith("utf_8"):
                out.setdefault(n, t)
        core = s.strip(QUOTES)
        if core and core != s:
            i = s.index(core)
            for n, t in self._undo(core):
                out.setdefault(n, s[:i] + t + s[i + len(core) :])
        return [(n, t) for n, t in out.items() if t != s and not any("\x7f" <= c <= "\x9f" or c == "\ufffd" for c in t)]

    def _undo(self, s: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for c in UTF8_READ_AS:
            b = self._bytes(s, c)
            if b is None:
                continue
            try:
                t = b.decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append((f"utf_8>{c}", t))
            if c in TWICE and t != s and (b2 := self._bytes(t, c)) is not None:
                try:
                    if (t2 := b2.decode("utf-8")) != t:
                        out.append((f"utf_8>{c} twice", t2))
                except UnicodeDecodeError:
                    pass
        for a, b in LEGACY_PAIRS:
            m, t = self.back[b], self.table[a]
            # letters that the encoding lacks were never bytes of it
            out.append((f"{a}>{b}", "".join(t[m[c]] if c in m else c for c in s)))
        return out


def shape(word: str) -> str:
    """The word with every run of non-ASCII characters as one mark."""
    return re.sub(r"[^\x00-\x7f]+", "�", word)


def _kind(c: str) -> str:
    """Character class for the character model."""
    o = ord(c)
    if o < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"
    if o < 0xA0:
        return "control"
    if c == "�":
        return "lost"
    if c.isalpha():
        script = "cyr" if 0x400 <= o < 0x530 else "grk" if 0x370 <= o < 0x400 else "lat" if o < 0x250 else "oth"
        return script + ("U" if c.isupper() else "l")
    if 0x2500 <= o < 0x2600:
        return "box"
    if c in "“”„«»":
        return "quote"
    if c in "’‘":
        return "apos"
    return unicodedata.category(c)


def _pairs(word: str) -> list[tuple[str, str, str, str]]:
    """(class before, class, letter before, letter) of each position, the end included."""
    out, pk, pf = [], "^", "^"
    for c in word:
        k = _kind(c)
        f = k if ord(c) < 128 else c.lower()
        out.append((pk, k, pf if ord(c) >= 128 else "", f))
        pk, pf = k, f
    out.append((pk, "$", "", "$"))
    return out


class Reader:
    """Character model: class given the class before, letter given its class and the letter before."""

    def __init__(self, rows: list[tuple[str, str, str, str, float]]):
        self.kk, self.k, self.lf, self.f = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
        self.kf, self.bf = defaultdict(float), defaultdict(float)
        for pk, k, pf, f, w in rows:
            self.kk[pk, k] += w
            self.k[pk] += w
            if pf:
                self.lf[pf, k, f] += w
                self.bf[pf, k] += w
            self.f[k, f] += w
            self.kf[k] += w
        self.cache: dict[str, float] = {}

    def logp(self, word: str) -> float:
        if (x := self.cache.get(word)) is not None:
            return x
        s = 0.0
        for pk, k, pf, f in _pairs(word):
            s += math.log((self.kk[pk, k] + 1e-4) / (self.k[pk] + 0.01))
            if pf:
                uni = (self.f[k, f] + 0.02) / (self.kf[k] + 2.0)
                b = self.bf[pf, k]
                s += math.log(0.8 * (self.lf[pf, k, f] / b if b else uni) + 0.2 * uni)
        if len(self.cache) < 200_000:
            self.cache[word] = s
        return s


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chains = Chains()
    for b in batches:
        tok, n, chain, orig = [], [], [], []
        for t, k in zip(b["token"].to_pylist(), b["n"].to_pylist()):
            found = [(LOST, shape(t))] if "�" in t else chains.undo(t)
            for c, o in [(CLEAN, t), *found]:
                tok.append(t)
                n.append(k)
                chain.append(c)
                orig.append(o)
        yield pa.RecordBatch.from_arrays([pa.array(tok, pa.string()), pa.array(n, pa.int64()), pa.array(chain, pa.string()), pa.array(orig, pa.string())], names=["token", "n", "chain", "original"])


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, float] = defaultdict(float)
    for b in batches:
        for t, w in zip(b["word"].to_pylist(), b["w"].to_pylist()):
            for x in _pairs(t):
                total[x] += w
    cols = list(zip(*total)) if total else [[]] * 4
    yield pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.string()) for c in cols], pa.array(list(total.values()), pa.float64())], names=["pk", "k", "pf", "f", "w"])


def _weigh(model_rows: list[tuple]):
    """Log-likelihood of each way a word may have come about, given the character model and the support of
    the candidate elsewhere. What is less than SLIGHT as likely as the best is left out; open says that more
    than the clean reading is left."""
    state: dict[str, Reader] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["r"] = Reader(model_rows)
        read = state["r"]
        for b in batches:
            rows = []
            for t, k, cands in zip(b["token"].to_pylist(), b["n"].to_pylist(), b["cands"].to_pylist()):
                if "�" in t:  # a lost byte is proof
                    rows.append((t, k, LOST, None, 0.0, True))
                    continue
                odd = sum(ord(x) > 127 for x in t)
                opts = [(c["chain"], c["original"], read.logp(c["original"]) + 0.5 * math.log1p(c["support"] or 0.0)) for c in cands]
                opts.append((UNKNOWN, None, -9.5 * odd - 2.0 * (len(t) - odd)))
                top = max(s for *_, s in opts)
                opts = [o for o in opts if o[2] > top + SLIGHT or o[0] == CLEAN]
                rows += [(t, k, name, o, max(s - top, 10 * SLIGHT), len(opts) > 1) for name, o, s in opts]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, types)], names=["token", "n", "chain", "original", "ll", "open"])

    return run


def words(parts: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(field, row_id, source, token): the distinct words with non-ASCII characters of each record.
    parts: (table, field name, key, text column, source expression)."""
    out = None
    for df, field, key, text, source in parts:
        d = df.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.expr(source).alias("source"), F.col(text).alias("_text"))
        d = d.filter(F.col("_text").rlike("[^\\x00-\\x7f]"))
        d = d.select("field", "row_id", F.coalesce("source", F.lit("")).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(WORD), 0))).alias("token"))
        out = d if out is None else out.unionByName(d)
    return out


def estimate(tok: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(field, source, token, chain, original, p_garbled, everywhere): the words that are garbled more probably than
    not in records of this field and source, with the likeliest chain and original."""
    spark = tok.sparkSession
    ship(spark)
    by_source = durable(tok.groupBy("field", "source", "token").agg(F.count(F.lit(1)).alias("n")))
    totals = by_source.groupBy("field", "source").agg(F.sum("n").alias("total"))
    vocab = by_source.groupBy("token").agg(F.sum("n").alias("n"))
    cands = durable(vocab.mapInArrow(_expand, "token string, n bigint, chain string, original string"))
    # before the first round a word with a control, lost or box character, or with letters of two scripts side
    # by side, is taken for garbled, all others for clean
    post = vocab.select("token", "n", F.lit(CLEAN).alias("chain"), F.col("token").alias("original"), F.when(F.col("token").rlike(ODD), 0.0).otherwise(1.0).alias("post"))
    others = [*Chains().names, UNKNOWN, LOST]
    base = {c: (1 - CLEAN_PRIOR) / len(others) for c in others} | {CLEAN: CLEAN_PRIOR}
    own = totals.select("field", "source", "total", F.lit(None).cast("map<string,double>").alias("w"), F.lit(0.0).alias("g"))
    mass: dict[str, float] = {}
    local = None
    for k in range(rounds):
        # M-step, words: the character model (bounded by the alphabet) goes to the driver, word support is a table
        weighted = post.filter("original is not null and post > 0.001").groupBy(F.col("original").alias("word")).agg(F.sum(F.col("n") * F.col("post")).alias("w"))
        chars = weighted.mapInArrow(_char_counts, "pk string, k string, pf string, f string, w double").groupBy("pk", "k", "pf", "f").agg(F.sum("w").alias("w"))
        rows = [tuple(r) for r in chars.collect()]
        support = post.filter(F.col("chain") == CLEAN).select(F.col("token").alias("original"), (F.col("n") * F.col("post")).alias("support"))
        seen = cands.filter(F.col("chain") != LOST).join(support, "original", "left").select("token", "n", "chain", "original", "support")
        seen = seen.unionByName(cands.filter(F.col("chain") == LOST).withColumn("support", F.lit(None).cast("double")))
        seen = seen.groupBy("token", "n").agg(F.collect_list(F.struct("chain", "original", "support")).alias("cands"))
        like = durable(seen.mapInArrow(_weigh(rows), "token string, n bigint, chain string, original string, ll double, open boolean"))
        # E-step: the posterior of each word in each field and source, by the chains' prior there: half of it the
        # overall one, half the source's own, shrunk to the overall one. A word that can only be clean needs no source.
        b = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("chain")]
        there = F.when(F.col("chain") == CLEAN, 1.0 - (F.col("g") + SHRINK * (1.0 - b)) / (F.col("total") + SHRINK)).otherwise((F.greatest(F.lit(0.0), F.coalesce(F.try_element_at("w", F.col("chain")), F.lit(0.0)) - F.coalesce("self", F.lit(0.0))) + SHRINK * b) / (F.col("total") + SHRINK))
        loc = by_source.select("field", "source", "token", F.col("n").alias("m")).join(like.filter("open"), "token").join(own, ["field", "source"])
        # a word is no evidence for itself: its own mass is taken out of its source's, else a frequent short word
        # that could be garbled would talk itself into it
        if local is None:
            loc = loc.withColumn("self", F.lit(0.0))
        else:
            loc = loc.join(local.select("field", "source", "token", "chain", (F.col("m") * F.col("p")).alias("self")), ["field", "source", "token", "chain"], "left")
        loc = loc.withColumn("s", F.exp("ll") * (0.5 * b + 0.5 * F.greatest(there, F.lit(1e-12))))
        local = durable(loc.select("field", "source", "token", "m", "n", "chain", "original", (F.col("s") / F.sum("s").over(Window.partitionBy("field", "source", "token"))).alias("p")))
        pooled = local.groupBy("token", "n", "chain", "original").agg((F.sum(F.col("m") * F.col("p")) / F.first("n")).alias("post"))
        post = like.filter("not open").select("token", "n", "chain", "original", F.lit(1.0).alias("post")).unionByName(pooled)
        # M-step, chains: their mass overall, and in each field and source
        now = {r.chain: r.w for r in post.groupBy("chain").agg(F.sum(F.col("n") * F.col("post")).alias("w")).collect()}
        total = sum(now.values()) or 1.0
        garbled = sum(w for c, w in now.items() if c != CLEAN)
        # chains with the same original share their mass in any way: what has to settle is what is garbled
        moved = abs(garbled - sum(w for c, w in mass.items() if c != CLEAN))
        mass = now
        if k and moved <= tolerance * max(1.0, garbled):
            break
        base = {c: (mass.get(c, 0.0) + 0.5) / (total + len(others)) for c in others}
        base[CLEAN] = max(0.5, mass.get(CLEAN, 0.0) / total)
        per = local.filter(F.col("chain") != CLEAN).groupBy("field", "source", "chain").agg(F.sum(F.col("m") * F.col("p")).alias("x"))
        per = per.groupBy("field", "source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "x"))).alias("w"), F.sum("x").alias("g"))
        own = totals.join(per, ["field", "source"], "left").select("field", "source", "total", "w", F.coalesce("g", F.lit(0.0)).alias("g"))
    best = local.groupBy("field", "source", "token").agg(
        F.sum(F.when(F.col("chain") != CLEAN, F.col("p")).otherwise(0.0)).alias("p_garbled"),
        F.max_by(F.struct("chain", "original"), F.when(F.col("chain") != CLEAN, F.col("p"))).alias("b"),
    )
    best = durable(best.select("field", "source", "token", F.col("b.chain").alias("chain"), F.col("b.original").alias("original"), "p_garbled"))
    # nearly all garbled words are garbled wherever they stand: those need no source beside them later
    always = best.groupBy("token").agg(F.min("p_garbled").alias("_least"))
    out = best.filter("p_garbled > 0.5").join(always, "token").withColumn("everywhere", F.col("_least") > 0.5).drop("_least")
    # lost bytes: the only clean word of that shape, if there is one
    fits = post.filter((F.col("chain") == CLEAN) & (F.col("post") > 0.9)).select(F.regexp_replace("token", "[^\\x00-\\x7f]+", "�").alias("_shape"), "token").groupBy("_shape").agg(F.min("token").alias("_fit"), F.count(F.lit(1)).alias("_k")).filter("_k = 1")
    out = out.withColumn("_shape", F.when(F.col("chain") == LOST, F.regexp_replace("token", "[^\\x00-\\x7f]+", "�")))
    out = out.join(fits, "_shape", "left").withColumn("original", F.coalesce("original", "_fit"))
    return durable(out.select("field", "source", "token", "chain", "original", "p_garbled", "everywhere"))


def garbled_words(tok: DataFrame, found: DataFrame) -> DataFrame:
    """The garbled words of each record. Garbled forms are few beside the words of the records; they are
    broadcast where their number is checked to be small, joined by shuffle otherwise."""
    f = F.broadcast(found) if is_small(found, BROADCAST_ROWS) else found
    return tok.join(f, ["field", "source", "token"])


def affected(tok: DataFrame, found: DataFrame) -> DataFrame:
    """Records with a garbled word. Words that are garbled everywhere are joined by themselves, the few
    others with their field and source; either side is broadcast only if it is checked to be small."""
    small = lambda d: F.broadcast(d) if is_small(d, BROADCAST_ROWS) else d
    plain = found.filter("everywhere").select("token").distinct().withColumn("_a", F.lit(True))
    local = found.filter("not everywhere").select("field", "source", "token").withColumn("_b", F.lit(True))
    j = tok.join(small(plain), "token", "left").join(small(local), ["field", "source", "token"], "left")
    return j.filter("_a or _b").select("field", "row_id").distinct()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rx = re.compile(r"(?<![A-Za-z0-9\-\u0080-￿])[A-Za-z0-9\-]*[\u0080-￿][A-Za-z0-9\-\u0080-￿]*")
    for b in batches:
        out, whole = [], []
        for text, ws in zip(b["_text"].to_pylist(), b["ws"].to_pylist()):
            fix = {w["token"]: w["original"] for w in ws}
            out.append(rx.sub(lambda m: fix.get(m[0]) or m[0], text))
            whole.append(all(fix.values()))
        yield pa.RecordBatch.from_arrays([b["field"], b["row_id"], b["chain"], b["n_words"], pa.array(whole), pa.array(out, pa.string())], names=["field", "row_id", "chain", "n_words", "restored", "repaired"])


def repaired(parts: list[tuple[DataFrame, str, str, str, str]], tok: DataFrame, found: DataFrame) -> DataFrame:
    """Affected records with the text restored as far as it can be."""
    ws = garbled_words(tok, found).groupBy("field", "row_id").agg(F.collect_list(F.struct("token", "original")).alias("ws"), F.mode("chain").alias("chain"), F.count(F.lit(1)).alias("n_words"))
    texts = None
    for df, field, key, text, _ in parts:
        d = df.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("_text"))
        texts = d if texts is None else texts.unionByName(d)
    j = texts.join(ws, ["field", "row_id"])
    return j.select("field", "row_id", "chain", "n_words", "_text", "ws").mapInArrow(_repair, "field string, row_id bigint, chain string, n_words bigint, restored boolean, repaired string")
