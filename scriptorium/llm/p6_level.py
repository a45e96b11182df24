"""Problem 6: reading level of each document.

Method: one smoothed unigram language model per grade level. The training texts are seeded by the
Flesch-Kincaid formula: English prose whose formula grade lies in a level trains that level; the levels
cover all grades. A level with fewer than MIN_LEVEL_TOKENS seed words has no model and is given to no
text. A text gets the level of highest posterior; the formula itself never decides.

The models are fitted on every seed text of the table and every text is scored. Words are counted and
summed on the executors; what comes to the driver and goes to the tasks is a row for each distinct word of
the seeds (44 bytes in the model, with all levels). A seed's own words are left out of its level's model
while it is scored, so that a level of few texts doesn't draw them by what they alone say.

Defined results: null, empty and blank texts get no row; a text without a word known to the models
gets the level of highest prior; texts that are not prose or not English get a level too, with
is_prose or is_english false, and are never found as young readers' texts; equal texts get equal
levels; without any seed all levels are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbytes as tb
from scriptorium.llm.p4_quality import Profiles, common_rows, measure, plain
from scriptorium.session import ship, spread

FLUSH_WORDS = 500_000  # counted words that a task holds before it adds them up, and then sends on if they are still half as many
MIN_SEED_WORDS = 25
MIN_LEVEL_TOKENS = 400
MIX = 0.8
# (level, lowest formula grade, highest formula grade, grade reported)
LEVELS = (
    ("grade 1-2", -100.0, 2.5, 2),
    ("grade 3-5", 2.5, 5.5, 4),
    ("grade 6-8", 5.5, 8.5, 7),
    ("grade 9-10", 8.5, 11.0, 10),
    ("grade 11-12", 11.0, 12.9, 12),
    ("college", 12.9, 16.9, 14),
    ("graduate", 16.9, 1000.0, 18),
)
YOUNG = 8

_VOWEL = np.zeros(256, dtype=bool)
_VOWEL[[*b"aeiouy"]] = True


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, syllables) of each word."""
    low = tb.lower(data)
    s, e, r = tb.spans(tb.word_mask(data), off)
    v = _VOWEL[low]
    run = v.copy()
    run[1:] &= ~v[:-1]
    run[s[v[s]]] = True
    c = np.concatenate(([0], np.cumsum(run)))
    return tb.hashes(low, s, e), r, np.maximum(1, c[e] - c[s])


def formula(n_words: np.ndarray, n_sent: np.ndarray, syll: np.ndarray) -> np.ndarray:
    """Flesch-Kincaid grade."""
    w = np.maximum(1.0, n_words)
    return 0.39 * w / np.maximum(1.0, n_sent) + 11.8 * syll / w - 15.59


def english(data: np.ndarray, off: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """English leads the other languages' function words and nearly all letters are ASCII."""
    n = len(off) - 1
    letter = tb.word_mask(data)
    row = np.repeat(np.arange(n), np.diff(off))
    ascii_ = np.bincount(row[letter & (data < 128)], minlength=n)
    every = np.maximum(1, np.bincount(row[letter], minlength=n))
    lang = m["lang"]
    others = np.delete(lang, 1, axis=1).max(1)
    return (ascii_ / every > 0.9) & (lang[:, 1] >= others)


def seed_levels(P: Profiles, best: np.ndarray, m: dict[str, np.ndarray], g: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The level that each text is a seed of, -1 for none."""
    out = np.full(len(g), -1)
    ok = P.prose[best] & english(data, off, m) & (m["n_words"] >= MIN_SEED_WORDS)
    for k, (_, lo, hi, _) in enumerate(LEVELS):
        out[ok & (g >= lo) & (g < hi)] = k
    return out


def _seed_counts(words):
    state: dict[str, Profiles] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["p"] = Profiles(words)
        P = state["p"]
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in LEVELS]
        docs = [0] * len(LEVELS)
        held = 0

        def add_up() -> int:
            for k, t in enumerate(counts):
                if len(t) > 1:
                    u, at = np.unique(np.concatenate([x for x, _ in t]), return_inverse=True)
                    counts[k] = [(u, np.bincount(at, weights=np.concatenate([c for _, c in t])).astype(np.int64))]
            return sum(len(t[0][0]) for t in counts if t)

        def flush() -> Iterator[pa.RecordBatch]:
            for k, t in enumerate(counts):
                for u, c in t:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(c), pa.array(np.append(docs[k], np.zeros(len(u) - 1)).astype(np.int64))], names=["level", "word", "n", "docs"])
                counts[k], docs[k] = [], 0

        for b in batches:
            for _, _, data, off in tb.chunks(plain(b["_text"])):
                m = measure(data, off, P.fw)
                best, _, _ = P.nearest(m)
                h, r, syl = words_of(data, off)
                n = len(off) - 1
                g = formula(m["n_words"], m["sentences"], np.bincount(r, weights=syl, minlength=n))
                seed = seed_levels(P, best, m, g, data, off)
                for k in range(len(LEVELS)):
                    rows = seed == k
                    docs[k] += int(rows.sum())
                    u, c = np.unique(h[rows[r]], return_counts=True)
                    if len(u):
                        counts[k].append((u, c))
                        held += len(u)
                if held > FLUSH_WORDS:
                    held = add_up()
                    if held > FLUSH_WORDS // 2:
                        yield from flush()
                        held = 0
        add_up()
        yield from flush()

    return run


class Models:
    """Smoothed unigram models: log p(word | level), the pooled model as background. rows: columns level, word,
    n and docs."""

    def __init__(self, rows: pa.Table):
        lv, w, n, docs = (rows[c].to_numpy() for c in ("level", "word", "n", "docs"))
        n_docs = np.bincount(lv, weights=docs, minlength=len(LEVELS))
        size = np.bincount(lv, weights=n, minlength=len(LEVELS))
        self.levels = [k for k in range(len(LEVELS)) if size[k] >= MIN_LEVEL_TOKENS]
        self.keys, at = np.unique(w.view(np.uint64), return_inverse=True)
        self.size = size[self.levels]
        self.counts = np.empty((len(self.levels), len(self.keys)), np.float32)
        for i, k in enumerate(self.levels):
            self.counts[i] = np.bincount(at[lv == k], weights=n[lv == k], minlength=len(self.keys))
        pooled = self.counts.sum(0, dtype=float) + 0.5
        self.pooled = pooled / (pooled.sum() + 0.5)
        self.docs = n_docs[self.levels] + 1.0
        self.prior = np.log(self.docs / self.docs.sum()) if len(self.levels) else np.zeros(0)
        self.logp: np.ndarray | None = None

    def _log(self, share: np.ndarray, pooled: np.ndarray) -> np.ndarray:
        return np.log(MIX * share + (1 - MIX) * pooled)

    def score(self, h: np.ndarray, r: np.ndarray, n: int, seed: np.ndarray) -> np.ndarray:
        """Log posterior up to a constant, rows x levels. Words unknown to all levels say nothing; seed: the level
        that a row is a seed of, whose counts hold the row's own words, or -1."""
        if self.logp is None:  # made in the task, it isn't sent
            self.logp = np.stack([self._log(c / z, self.pooled).astype(np.float32) for c, z in zip(self.counts, self.size)])
        known, i = tb.member(h, self.keys)
        r, i = r[known], i[known]
        out = np.tile(self.prior, (n, 1))
        for k, level in enumerate(self.levels):
            out[:, k] += np.bincount(r, weights=self.logp[k, i], minlength=n)
            own = seed[r] == level
            pair, c = np.unique(r[own] * len(self.keys) + i[own], return_counts=True)
            row, w = np.divmod(pair, max(1, len(self.keys)))
            left = np.maximum(1.0, self.size[k] - np.bincount(row, weights=c, minlength=n))[row]
            out[:, k] += np.bincount(row, weights=c * (self._log(np.maximum(0.0, self.counts[k, w] - c) / left, self.pooled[w]) - self.logp[k, w]), minlength=n)
            out[seed == level, k] += np.log(max(1.0, self.docs[k] - 1) / self.docs[k])
        return out


def train(texts: DataFrame, common_words: DataFrame) -> Models:
    """The models of the levels from all seed texts."""
    c = texts.mapInArrow(_seed_counts(common_rows(common_words)), "level int, word bigint, n bigint, docs bigint")
    return Models(c.groupBy("level", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow())


OUT = "row_id bigint, level string, grade int, posterior double, formula_grade double, n_words bigint, is_english boolean, is_prose boolean"


def _score(words, M: Models):
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state["p"] = Profiles(words)
        P = state["p"]
        names = np.array([LEVELS[k][0] for k in M.levels] or [None])
        grades = np.array([LEVELS[k][3] for k in M.levels] or [0])
        for b in batches:
            for i, j, data, off in tb.chunks(plain(b["_text"])):
                n = j - i
                m = measure(data, off, P.fw)
                best, _, _ = P.nearest(m)
                h, r, syl = words_of(data, off)
                g = formula(m["n_words"], m["sentences"], np.bincount(r, weights=syl, minlength=n))
                if M.levels:
                    s = M.score(h, r, n, seed_levels(P, best, m, g, data, off))
                    top = s.argmax(1)
                    post = 1.0 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                    none = np.zeros(n, bool)
                else:
                    top, post, none = np.zeros(n, int), np.zeros(n), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        b["row_id"].slice(i, n),
                        pa.array(names[top], pa.string(), mask=none),
                        pa.array(grades[top].astype(np.int32), pa.int32(), mask=none),
                        pa.array(post, pa.float64(), mask=none),
                        pa.array(g, pa.float64(), mask=m["n_words"] == 0),
                        pa.array(m["n_words"].astype(np.int64)),
                        pa.array(english(data, off, m)),
                        pa.array(P.prose[best]),
                    ],
                    names=[x.split()[0] for x in OUT.split(", ")],
                )

    return run


def levels(df: DataFrame, common_words: DataFrame, key: str, text: str) -> DataFrame:
    """The reading level of every text that isn't blank. Two scans of one text column, no shuffle of texts."""
    ship(df.sparkSession)
    texts = spread(df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("_text")).filter(F.col("_text").rlike(r"\S")))
    models = train(texts, common_words)
    return texts.mapInArrow(_score(common_rows(common_words), models), OUT).withColumnRenamed("row_id", key)


def young(lv: DataFrame, grade: int = YOUNG) -> DataFrame:
    return lv.filter((F.col("grade") <= grade) & F.col("is_english") & F.col("is_prose"))
