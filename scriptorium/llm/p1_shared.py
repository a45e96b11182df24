"""Problem 1, second stage: runs of text that pages of one host share.

Method: a host's pages (sections and related-work texts of one paper or volume) are concatenated as token streams; suffixes are sorted, and neighbours that
agree in at least WIDTH tokens and come from distinct pages are runs the pages share. The tokens such
runs cover are taken out of every page but the first that has them; unique runs stay.

The sort is a suffix array built by prefix doubling, cut at depth WIDTH: deeper order changes no
coverage, as a run of at least WIDTH tokens is covered by its windows of WIDTH tokens. A host of up to
HOST_TOKENS tokens is sorted in one task. A larger one is never put into one task: its windows are
combined by hash on the executors, which gives the same coverage (tested). Both ways have the same
tokens: what stands between blanks of Unicode (TOKEN).

Defined results: null and empty texts have no tokens; texts under WIDTH tokens share nothing; a null
host is a host of its own; pages with equal texts are shared runs, of which the smallest page keeps
its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import textbytes as tb
from scriptorium.session import durable, ship

WIDTH = 20
HOST_TOKENS = 2_000_000
TOKEN = re.compile(r"\S+")


def ranks(ids: np.ndarray, width: int) -> np.ndarray:
    """Rank of each suffix by its first width tokens; equal ranks agree in all of them. Prefix doubling;
    ids below 0 are ends of pages, all of them different, so that no run goes over a page's end."""
    n = len(ids)
    _, r = np.unique(ids, return_inverse=True)
    r = r.astype(np.int64)
    known = 1
    while known < width and n:
        step = min(known, width - known)
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[: n - step] = r[step:]
        _, r = np.unique(r * (n + 2) + nxt + 1, return_inverse=True)
        known += step
    return r


def shared_mask(ids: np.ndarray, page: np.ndarray, width: int) -> np.ndarray:
    """Tokens covered by a run of width tokens that an earlier page has too. page: ascending number of each
    token's page."""
    n = len(ids)
    out = np.zeros(n + 1, dtype=np.int64)
    if n < width:
        return out[:n].astype(bool)
    r = ranks(ids, width)
    order = np.lexsort((np.arange(n), r))
    first = np.ones(n, bool)
    first[1:] = r[order][1:] != r[order][:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    repeated = np.zeros(n, bool)
    repeated[order] = page[order] != page[order[start]]  # the group's first suffix is on its first page
    inside = np.zeros(n, bool)  # windows that end on their page
    inside[: n - width + 1] = page[: n - width + 1] == page[width - 1 :]
    at = np.flatnonzero(repeated & inside & (ids >= 0))
    np.add.at(out, at, 1)
    np.add.at(out, np.minimum(at + width, n), -1)
    return np.cumsum(out)[:n] > 0


def _tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text) if text else []


def _spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end of each token) of a text."""
    ws = [w.encode() for w in _tokens(text)]
    end = np.cumsum([len(w) for w in ws], dtype=np.int64)
    return np.frombuffer(b"".join(ws), np.uint8), end - np.diff(end, prepend=0), end


def _keep(text: str, mask: np.ndarray) -> str:
    """The text without the masked tokens; what stands between kept tokens is kept."""
    out, at, gap = [], 0, False
    for m, cut in zip(TOKEN.finditer(text), mask):
        if cut:
            gap = True
        else:
            out.append(("\n" if gap and out else text[at : m.start()] if out else "") + m[0])
            gap = False
        at = m.end()
    return "".join(out)


def _hashes(text: str | None) -> np.ndarray:
    return tb.hashes(*_spans(text))


def _host(width: int, keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable")
        texts = pdf["_text"].tolist()
        hs = [_hashes(t) for t in texts]
        sizes = np.array([len(h) for h in hs], dtype=np.int64)
        # tokens by number; behind each page stands an end of its own
        _, number = np.unique(np.concatenate(hs), return_inverse=True)
        page = np.repeat(np.arange(len(hs)), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(page), bool)
        inner[ends] = False
        ids = np.empty(len(page), dtype=np.int64)
        ids[inner], ids[ends] = number, -1 - np.arange(len(hs))
        mask = shared_mask(ids, page, width)
        n_shared, out = np.zeros(len(hs), dtype=np.int64), list(texts)
        for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist())):
            m = mask[end - n : end]
            n_shared[k] = m.sum()
            if n_shared[k]:
                out[k] = _keep(texts[k], m)
        return pdf[keys].assign(n_tokens=sizes, shared_tokens=n_shared, unique_text=out)

    return run


def _windows(width: int, keys: list[str]):
    """(host, keys, i, h): the hash of each window of a page's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            win = [tb.roll(_hashes(t.as_py()), width).view(np.int64) for t in b["_text"]]
            at = pa.array(np.repeat(np.arange(len(win)), [len(x) for x in win]))
            cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
            pos = [np.arange(len(x)) for x in win]
            yield pa.RecordBatch.from_arrays([b["host"].take(at), *[b[k].take(at) for k in keys], pa.array(cat(pos), pa.int32()), pa.array(cat(win), pa.int64())], names=["host", *keys, "i", "h"])

    return run


def _apply(width: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_, s_, out = [], [], []
            for t, at in zip(b["_text"].to_pylist(), b["at"].to_pylist()):
                n = len(_tokens(t))
                m = np.zeros(n + width + 1, dtype=np.int64)
                a = np.array(at or [], dtype=np.int64)
                np.add.at(m, a, 1)
                np.add.at(m, a + width, -1)
                mask = np.cumsum(m)[:n] > 0
                n_.append(n)
                s_.append(int(mask.sum()))
                out.append(_keep(t, mask) if t is not None and mask.any() else t)
            yield pa.RecordBatch.from_arrays([*[b[k] for k in keys], pa.array(n_, pa.int64()), pa.array(s_, pa.int64()), pa.array(out, pa.string())], names=[*keys, "n_tokens", "shared_tokens", "unique_text"])

    return run


def shared_runs(pages: DataFrame, host: str, keys: list[str], text: str, width: int = WIDTH, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """(keys, n_tokens, shared_tokens, unique_text) of every page; keys together name a page and order the
    pages of a host."""
    ship(pages.sparkSession)
    p = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), *keys, F.col(text).alias("_text"))
    p = durable(p)  # read by every branch below; the texts may come from a costly plan
    # a token and the blank after it have two bytes at least; sums are combined before the shuffle
    size = p.groupBy("host").agg(F.sum(F.coalesce(F.length("_text"), F.lit(0)) / 2 + 1).alias("_n"))
    hot = durable(size.filter(F.col("_n") > host_tokens).select("host"))
    typed = ", ".join(f"{k} {p.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{typed}, n_tokens bigint, shared_tokens bigint, unique_text string"
    # as many parts as the work asks for: adaptive coalescing goes by bytes and would make one task of it
    total = size.agg(F.sum("_n")).first()[0] or 0
    parts = int(max(3 * pages.sparkSession.sparkContext.defaultParallelism, total // 500_000))
    small = p.join(hot, "host", "left_anti").repartition(parts, "host").groupBy("host").applyInPandas(_host(width, keys), schema)
    big = p.join(hot, "host", "left_semi")
    win = big.mapInArrow(_windows(width, keys), f"host string, {typed}, i int, h bigint")
    # min and max are combined per task: a window that fills a third of the rows costs one row per task
    me = F.struct(*keys)
    first = win.groupBy("host", "h").agg(F.min(me).alias("first"), F.max(me).alias("last")).filter("first <> last").select("host", "h", "first")
    hits = win.join(first, ["host", "h"]).filter(me != F.col("first")).groupBy(*keys).agg(F.collect_list("i").alias("at"))
    large = big.join(hits, keys, "left").select(*keys, "_text", "at").mapInArrow(_apply(width, keys), schema)
    return small.unionByName(large)
