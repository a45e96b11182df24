"""Model scoring: windows, log-perplexity, burstiness, ratio. A scorer is any object with
score(ids) -> (nll of each id after the first); the n-gram scorer here is trained on counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.session import ship, spread

WINDOW, STRIDE, MIN_SENTENCE_TOKENS = 1024, 512, 5


class Scorer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def nll(self, ids: list[int]) -> list[float]:
        """Negative log-likelihood of ids[1:], each given those before it in the window."""
        ...


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int, int]]:
    """M2: (begin, end, first scored) of overlapping windows over n tokens; each token is scored once."""
    out, done = [], 0
    for begin in range(0, max(1, n), stride):
        end = min(begin + size, n)
        out.append((begin, end, max(done, begin)))
        done = end
        if end == n:
            break
    return out


class _Next:
    """Scores of a document's windows that are at hand already, in order."""

    def __init__(self, scores: list[list[float]]):
        self.it = iter(scores)

    def __call__(self) -> list[float]:
        return next(self.it)


def nll_many(s: Scorer, windows: list[list[int]]) -> list[list[float]]:
    """A scorer that takes batches gets them."""
    return s.nll_many(windows) if hasattr(s, "nll_many") else [s.nll(w) for w in windows]


def doc_log_ppl(ids: list[int], nll: Callable[[list[int]], list[float]], size: int = WINDOW, stride: int = STRIDE, per_sequence: bool = False) -> tuple[float | None, int]:
    """M4: mean over the tokens scored; per_sequence is M5, which weighs window means by the window's new
    length and divides by the sequence length."""
    if len(ids) < 2:
        return None, 0
    total, count, weighted = 0.0, 0, 0.0
    for b, e, first in windows(len(ids), size, stride):
        x = nll() if isinstance(nll, _Next) else nll(ids[b:e])
        own = x[max(0, first - b - 1) :]
        total += math.fsum(own)
        count += len(own)
        weighted += (math.fsum(own) / len(own) if own else 0.0) * (e - first)
    if per_sequence:
        return weighted / len(ids), len(ids)
    return (total / count, count) if count else (None, 0)


def burstiness(scores: list[float]) -> tuple[float | None, float | None]:
    """Sample deviation of the sentence scores and its ratio to their mean; two scores at least."""
    if len(scores) < 2:
        return None, None
    mean = math.fsum(scores) / len(scores)
    std = math.sqrt(math.fsum((s - mean) ** 2 for s in scores) / (len(scores) - 1))
    return std, (std / mean if mean else None)


MIX = 0.7


class NgramScorer:
    """Interpolated word bigrams; ids are the words themselves, by position in the vocabulary. A window is
    scored with a few array lookups."""

    def __init__(self, uni: dict[str, int], bi: dict[tuple[str, str], int], mix: float = MIX):
        self.vocab = {w: i for i, w in enumerate(sorted(uni), 1)}
        self.size = len(self.vocab) + 1
        self.uni = np.zeros(self.size, dtype=np.int64)
        for w, n in uni.items():
            self.uni[self.vocab[w]] = n
        pairs = sorted((self.vocab[a] * self.size + self.vocab[b], n) for (a, b), n in bi.items() if a in self.vocab and b in self.vocab)
        self.keys, self.counts = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.total, self.mix = int(self.uni.sum()), mix

    def encode(self, text: str) -> list[int]:
        return [self.vocab.get(w, 0) for w in text.lower().split()]

    def nll(self, ids: list[int]) -> list[float]:
        x = np.asarray(ids, dtype=np.int64)
        if len(x) < 2:
            return []
        a, b = x[:-1], x[1:]
        p1 = (self.uni[b] + 1) / (self.total + self.size)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == key, self.counts[at], 0) if len(self.keys) else np.zeros(len(key))
        p2 = np.divide(n, self.uni[a], out=np.zeros(len(key)), where=self.uni[a] > 0)
        return (-np.log(self.mix * p2 + (1 - self.mix) * p1)).tolist()


def train_ngrams(texts: DataFrame, text: str = "text_clean", keep: int = 50_000, mix: float = MIX) -> NgramScorer:
    """Counts over all texts; the model has the keep commonest words and pairs, a stated bound of its size."""
    w = texts.select(F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " ").alias("w"))
    uni = w.select(F.explode("w").alias("a")).groupBy("a").count().orderBy(F.desc("count"), "a").limit(keep).collect()
    two = w.filter("size(w) > 1").select(F.explode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))).alias("p"))
    bi = two.groupBy("p.a", "p.b").count().orderBy(F.desc("count"), "a", "b").limit(keep).collect()
    return NgramScorer({r.a: r["count"] for r in uni}, {(r.a, r.b): r["count"] for r in bi}, mix)


class TransformersScorer:
    """M1: a causal language model of the transformers library, where that and torch are installed. Windows are
    scored in padded batches on the best device there is."""

    def __init__(self, model: str, batch: int = 16):
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        self.torch = torch
        self.device = choose_device(torch.cuda.is_available(), torch.backends.mps.is_available())
        self.tok = AutoTokenizer.from_pretrained(model)
        self.model = AutoModelForCausalLM.from_pretrained(model).to(self.device).eval()
        self.batch = batch

    def encode(self, text: str) -> list[int]:
        return self.tok(text, add_special_tokens=False)["input_ids"]

    def nll(self, ids: list[int]) -> list[float]:
        return self.nll_many([ids])[0]

    def nll_many(self, windows: list[list[int]]) -> list[list[float]]:
        out: list[list[float]] = [[] for _ in windows]
        torch = self.torch
        for rows, ids, mask in padded(windows, self.batch):
            x, m = torch.tensor(ids, device=self.device), torch.tensor(mask, device=self.device)
            with torch.no_grad():
                logp = torch.log_softmax(self.model(input_ids=x, attention_mask=m).logits[:, :-1].float(), -1)
            nll = -logp.gather(-1, x[:, 1:, None]).squeeze(-1)
            for k, r in enumerate(rows):
                out[r] = nll[k, : len(windows[r]) - 1].tolist()
        return out


def choose_device(cuda: bool, mps: bool) -> str:
    """M1: a GPU where there is one, then Apple's, then the processor."""
    return "cuda" if cuda else "mps" if mps else "cpu"


def padded(windows: list[list[int]], batch: int, pad: int = 0) -> Iterator[tuple[list[int], list[list[int]], list[list[int]]]]:
    """M3: (window numbers, ids, mask) of batches of windows of like length, filled up at the end; windows of
    fewer than two tokens have nothing to score."""
    order = sorted((i for i, w in enumerate(windows) if len(w) > 1), key=lambda i: len(windows[i]))
    for k in range(0, len(order), batch):
        rows = order[k : k + batch]
        top = len(windows[rows[-1]])
        yield rows, [windows[r] + [pad] * (top - len(windows[r])) for r in rows], [[1] * len(windows[r]) + [0] * (top - len(windows[r])) for r in rows]


def make_scorer(model: str, texts: DataFrame | None = None, batch: int = 16) -> Callable[[], Scorer]:
    """M1: what builds the scorer of a name: ngram, counted from the texts, or a model of the transformers library."""
    if model == "ngram":
        if texts is None:
            raise ValueError("the n-gram scorer is counted from texts")
        counted = train_ngrams(texts)
        return lambda: counted
    return lambda: TransformersScorer(model, batch)


SCORE = "log_perplexity double, perplexity double, burstiness_std double, burstiness_cv double, n_sentences_scored int, n_tokens_scored int"


def score(papers: DataFrame, make: Callable[[], Scorer], keys: list[str], size: int = WINDOW, stride: int = STRIDE, doc_only: bool = False, per_sequence: bool = False) -> DataFrame:
    """M3 to M7: one row of metrics per text. make builds the scorer, once per Python worker; a batch of
    Arrow rows is a batch of texts."""
    ship(papers.sparkSession)
    state: dict[str, Scorer] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not state:
            state["s"] = make()
        s = state["s"]
        for b in batches:
            rows = []
            docs = [s.encode(t or "") for t in b["text_clean"]]
            sent = [[] if doc_only or x is None else [i[:size] for i in map(s.encode, x) if len(i) >= MIN_SENTENCE_TOKENS] for x in b["_sents"]]
            # all windows and sentences of the batch at once
            spans = [windows(len(ids), size, stride) if len(ids) > 1 else [] for ids in docs]
            every = nll_many(s, [ids[x:y] for ids, ws in zip(docs, spans) for x, y, _ in ws] + [i for x in sent for i in x])
            at, tail = 0, sum(map(len, spans))
            for ids, ws, x in zip(docs, spans, sent):
                lp, n = doc_log_ppl(ids, _Next(every[at : at + len(ws)]), size, stride, per_sequence)
                at += len(ws)
                scores = [math.fsum(v) / len(v) for v in every[tail : tail + len(x)]]
                tail += len(x)
                std, cv = burstiness(scores)
                rows.append((lp, math.exp(lp) if lp is not None else None, std, cv, len(scores), n))
            out = b[keys].copy()
            for i, c in enumerate(x.split()[0] for x in SCORE.split(", ")):
                out[c] = pd.Series([r[i] for r in rows], index=b.index, dtype="Int32" if c.startswith("n_") else "float64")
            yield out

    d = spread(papers.select(*keys, "text_clean", T.sentences("text_clean").alias("_sents")))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in papers.select(*keys).schema.fields)
    return d.mapInPandas(run, f"{kind}, {SCORE}")


def ratio(base: DataFrame, instruct: DataFrame, keys: list[str]) -> DataFrame:
    """M8: base over instruct log-perplexity; null where the latter is 0 or missing."""
    a = base.select(*keys, F.col("log_perplexity").alias("base_log_ppl"))
    b = instruct.select(*keys, F.col("log_perplexity").alias("instruct_log_ppl"))
    return a.join(b, keys).select("*", F.try_divide("base_log_ppl", "instruct_log_ppl").alias("binoculars_score"))
