"""Problem 8: held-out evaluation passages inside training documents.

Method: template canonicalisation. Numbers, names and units become typed placeholders (a run of one
type is one placeholder), template windows of WIDTH tokens are hashed and joined with the windows of
the items; where windows meet, the stretch is aligned with the item's template token by token, and the
values in its slots decide: a copy has the passage's own values in most slots, the same template with
other values (a re-parameterised question) is reported as such and is no leak of the passage.

The windows of a block of items (MAX_BLOCK_CHARS characters; the usual table is one block) are the
build side of the join and go to all tasks, more items are joined block by block; documents are scanned
and never shuffled. Sentences that several items share are taken out of the items first.

Defined results: null or empty documents and items meet nothing; equal items both leak where either
does, unless every sentence is shared (then neither); repeated documents are all found; case,
punctuation, line breaks, hyphenation at line ends and placeholders don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbytes as tb
from scriptorium.llm.p4_quality import PLACEHOLDERS
from scriptorium.session import durable, ship, spread

WIDTH = 5
MIN_MATCH = 20  # words of the passage that stand in the document's stretch
DENSITY = 0.85  # their share of the stretch; the same template with other values has less
MAX_GAP = 4  # changed or missing words between matching runs
SLOT_SHARE = 0.5  # slots with the passage's own values in a copy
MAX_BLOCK_CHARS = 20_000_000
COPY, CHANGED, TEMPLATE = "copy", "changed copy", "other values"

# fixed values: English number words and common units
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNIT_WORDS = "percent km kilometres kilometers miles metres meters cm mm kg kilograms grams pounds litres liters hours minutes seconds days weeks months years dollars euros degrees".split()
NUM, NAME, UNIT = (np.uint64(tb.hash_word(f"\x00{x}")) for x in ("number", "name", "unit"))


class Canon:
    """Maps token hashes to template token hashes."""

    def __init__(self, names: list[str]):
        k = lambda ws: np.unique(np.array([tb.hash_word(w) for w in ws], dtype=np.uint64))
        self.numbers, self.units, self.names, self.and_ = k(NUMBER_WORDS), k(UNIT_WORDS), k(names), np.uint64(tb.hash_word("and"))

    def __call__(self, h: np.ndarray, digits: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template hashes, index of the token each begins with)."""
        t = h.copy()
        num = digits | tb.member(h, self.numbers)[0]
        if len(num) > 2:  # two hundred and twelve
            num[1:-1] |= (h[1:-1] == self.and_) & num[:-2] & num[2:]
        t[tb.member(h, self.names)[0]] = NAME
        t[tb.member(h, self.units)[0]] = UNIT
        t[num] = NUM
        slot = (t == NUM) | (t == NAME) | (t == UNIT)
        keep = np.ones(len(t), bool)
        keep[1:] = ~(slot[1:] & (t[1:] == t[:-1]) & (row[1:] == row[:-1]))
        at = np.flatnonzero(keep)
        return t[at], at


def tokens(data: np.ndarray, off: np.ndarray):
    """(lower bytes, start, end, row, all digits) of the tokens; words cut at a line end are joined."""
    data, off = _dehyphen(data, off)
    low = tb.lower(data)
    s, e, r = tb.spans(tb.word_mask(data, digits=True), off)
    d = np.concatenate(([0], np.cumsum((data >= 48) & (data < 58))))
    return low, s, e, r, (d[e] - d[s]) == (e - s)


def _dehyphen(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Take out hyphens with the white space after them where a line ends in a cut word."""
    hy = np.flatnonzero((data[:-1] == 45) & ((data[1:] == 10) | (data[1:] == 13))) if len(data) > 1 else np.zeros(0, int)
    soft = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] == 0xAD)) if len(data) > 1 else np.zeros(0, int)
    if not len(hy) and not len(soft):
        return data, off
    drop = np.zeros(len(data), bool)
    drop[soft] = drop[soft + 1] = True
    for i in hy.tolist():
        end = int(off[np.searchsorted(off, i, "right")])
        j = i + 1
        while j < end and data[j] in (10, 13, 32, 9):
            j += 1
        if i and j < end and tb._ALPHA[data[i - 1]] and 97 <= data[j] <= 122:
            drop[i:j] = True
    gone = np.concatenate(([0], np.cumsum(drop)))
    return data[~drop], off - gone[off]


def _sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if x.strip()]


def _norm(sentence: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", sentence.lower()))


def own_passages(items: list[tuple[int, str]], shared: frozenset[str] | None = None) -> tuple[list[tuple[int, list[str]]], list[str]]:
    """Each item without the sentences it shares with others, as tokens; and the names in the items. shared:
    the shared sentences in normal form, where they come from more items than these."""
    if shared is None:
        count = Counter(x for _, t in items for x in {_norm(s) for s in _sentences(t)})
        shared = frozenset(x for x, n in count.items() if n > 1)
    low = Counter(w for _, t in items for w in re.findall(r"(?<![^\W\d_])[a-z]+(?![^\W\d_])", t))
    # a name is a capitalised word inside a sentence that never stands in lower case
    names = {w.lower() for _, t in items for w in re.findall(r"(?<=[a-z,;] )[A-Z][a-z]+", t)}
    out = []
    for i, t in items:
        ws = [w for s in _sentences(t) if _norm(s) not in shared for w in re.findall(r"[^\W_]+", s.lower())]
        if ws:
            out.append((i, ws))
    return out, sorted(n for n in names if not low[n])


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, x) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist()) for x in {_norm(s) for s in _sentences(t)}]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item_id", "sentence"])


def item_blocks(items: DataFrame, max_chars: int) -> Iterator[tuple[list[tuple[int, str]], frozenset[str] | None]]:
    """(items, shared sentences) in blocks of about max_chars characters, by hash of the id. One block holds the
    usual table of items; beyond that shared sentences are counted on the executors, over all items, and a block
    gets those of its own items."""
    t = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and length(text) > 0")
    size = t.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // max_chars)
    if n <= 1:
        yield [(r.item_id, r.text) for r in t.collect()], None
        return
    part = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int")
    s = t.mapInArrow(_split_items, "item_id bigint, sentence string")
    twice = s.groupBy("sentence").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter("a <> b").select("sentence")
    t, s = t.withColumn("_p", part), durable(s.withColumn("_p", part).join(twice, "sentence").select("_p", "sentence").distinct())
    for k in range(n):
        yield [(r.item_id, r.text) for r in t.filter(F.col("_p") == k).select("item_id", "text").collect()], frozenset(r.sentence for r in s.filter(F.col("_p") == k).select("sentence").collect())


def _scan(passages: list[tuple[int, list[str]]], names: list[str], width: int, min_match: int, density: float, max_gap: int):
    state: dict = {}

    def build() -> None:
        canon = Canon(names)
        win, who, pos = [], [], []
        for k, (_, ws) in enumerate(passages):
            h = np.array([tb.hash_word(w) for w in ws], dtype=np.uint64)
            t, at = canon(h, np.array([w.isdigit() for w in ws]), np.zeros(len(ws), int))
            x = tb.roll(t, width)
            win.append(x)
            who.append(np.full(len(x), k))
            pos.append(at[: len(x)])
        w = np.concatenate(win) if win else np.zeros(0, np.uint64)
        order = np.argsort(w, kind="stable")
        keys, first = np.unique(w[order], return_index=True)
        state.update(slot=Slots(names), canon=canon, keys=keys, first=np.append(first, len(w)), who=np.concatenate(who)[order] if win else w, pos=np.concatenate(pos)[order] if win else w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            build()
        for b in batches:
            text = b["_text"]
            for p in PLACEHOLDERS:
                text = pc.replace_substring(text, p, " ")
            rows: list[tuple] = []
            for i, _, data, off in tb.chunks(text):
                low, s, e, r, digits = tokens(data, off)
                h = tb.hashes(low, s, e)
                t, at = state["canon"](h, digits, r)
                x = tb.roll(t, width)
                same = r[at[: len(x)]] == r[at[width - 1 : width - 1 + len(x)]]
                hit, k = tb.member(x, state["keys"])
                hit = np.flatnonzero(hit & same)
                if not len(hit):
                    continue
                pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for q in hit.tolist():
                    d = int(at[q])
                    for z in range(state["first"][k[q]], state["first"][k[q] + 1]):
                        pairs.setdefault((int(r[d]), int(state["who"][z])), []).append((d, int(state["pos"][z])))
                for (row, item), seeds in pairs.items():
                    if len(seeds) < 3:
                        continue
                    lo, hi = int(np.searchsorted(r, row)), int(np.searchsorted(r, row, "right"))
                    got = _align(low, s, e, lo, hi, seeds, passages[item][1], state["slot"], width, min_match, density, max_gap)
                    if got:
                        rows.append((b["_key"][i + row].as_py(), passages[item][0], *got))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, types)], names=["doc_id", "item_id", "matched_words", "stretch_words", "slots_equal", "slots", "kind"])

    return run


class Slots:
    """The type of a word's slot in a template, or the word itself."""

    def __init__(self, names: list[str]):
        self.kind = dict.fromkeys(names, "<name>") | dict.fromkeys(UNIT_WORDS, "<unit>") | dict.fromkeys(NUMBER_WORDS, "<number>")

    def __call__(self, word: str) -> str:
        return "<number>" if word.isdigit() else self.kind.get(word, word)


def _align(low, s, e, lo, hi, seeds, passage, slot, width, min_match, density, max_gap):
    """Longest stretch of the document's tokens that follows the passage's template, or None: (words of the
    passage in it, words of the stretch, slots with equal values, slots, kind).

    The decision is by the slots: where at least SLOT_SHARE of the slots hold the passage's own values, the
    stretch is a copy if the passage's own words are min_match and density of it; where fewer do, it is the
    same template with other values."""
    seeds = sorted(seeds)
    best = None
    group = [seeds[0]]
    groups = [group]
    for x in seeds[1:]:
        if x[0] - group[-1][0] > 40:
            groups.append(group := [])
        group.append(x)
    template = [slot(w) for w in passage]
    for g in groups:
        a, b = max(lo, g[0][0] - 40), min(hi, g[-1][0] + 40 + width)
        words = [bytes(low[s[z] : e[z]]).decode("utf-8", "replace") for z in range(a, b)]
        runs: list[list[tuple[int, int, int]]] = []
        for m in SequenceMatcher(None, [slot(w) for w in words], template, autojunk=False).get_matching_blocks():
            if not m.size:
                continue
            if runs and m.a - (runs[-1][-1][0] + runs[-1][-1][2]) <= max_gap and m.b - (runs[-1][-1][1] + runs[-1][-1][2]) <= max_gap:
                runs[-1].append(tuple(m))
            else:
                runs.append([tuple(m)])
        for run in runs:
            in_template = sum(z[2] for z in run)
            stretch = run[-1][0] + run[-1][2] - run[0][0]
            if in_template < min_match or in_template < density * stretch:
                continue
            pairs = [(words[i + k], passage[j + k], template[j + k]) for i, j, n in run for k in range(n)]
            own = sum(x == y for x, y, _ in pairs)
            slots = sum(t[0] == "<" for *_, t in pairs)
            equal = sum(t[0] == "<" and x == y for x, y, t in pairs)
            copy = equal >= SLOT_SHARE * slots and own >= min_match and own >= density * stretch
            if best is None or (copy, own) > (best[-1] != TEMPLATE, best[0]):
                best = (own, stretch, equal, slots, TEMPLATE if not copy else COPY if own == stretch else CHANGED)
    return best


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, min_match: int = MIN_MATCH, density: float = DENSITY, max_gap: int = MAX_GAP, max_chars: int = MAX_BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, matched_words, stretch_words, slots_equal, slots, kind); kind is copy, changed copy or
    other values. Items beyond max_chars are searched in blocks, a scan of the documents each."""
    ship(docs.sparkSession)
    d = spread(docs.select(F.col(key).cast("bigint").alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull()))
    out = None
    for block, shared in item_blocks(items, max_chars):
        passages, names = own_passages(block, shared)
        one = d.mapInArrow(_scan(passages, names, width, min_match, density, max_gap), "doc_id bigint, item_id bigint, matched_words int, stretch_words int, slots_equal int, slots int, kind string")
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("doc_id", key)


def leaked(found: DataFrame) -> DataFrame:
    """The copies; the same template with other values is no passage of the item."""
    return found.filter(F.col("kind") != TEMPLATE)
