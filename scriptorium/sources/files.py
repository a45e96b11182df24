"""Readers of corpus trees, source files, staged archives, previous output and optional metrics."""

from __future__ import annotations

import gzip
import io
import tarfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scriptorium.operators import parse as P
from scriptorium.schemas import PAPER_RECORD, PROGRESS
from scriptorium.session import ship
from scriptorium.sources.metadata import exists, fetch, latest_version


def load_corpus(spark: SparkSession, base: str, year_group: str) -> DataFrame:
    """SC11: <base>/<id>/NN_Heading.txt, ids of one or two levels, to (arxiv_id, year_group, filename, raw_text)."""
    t = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.url_decode(F.col("_metadata.file_path")).alias("p"))
    parts = F.split(F.regexp_replace(F.substring_index("p", base.rstrip("/") + "/", -1), "^/+", ""), "/")
    n = F.size(parts)
    return t.filter(n >= 2).select(F.array_join(F.slice(parts, 1, n - 1), "/").alias("arxiv_id"), F.lit(year_group).alias("year_group"), F.element_at(parts, -1).alias("filename"), F.col("value").alias("raw_text"))


def load_papers(spark: SparkSession, base: str, year_group: str) -> DataFrame:
    """SC12: (arxiv_id, year_group, file_paths, n_files): the files of each paper of a corpus tree, in order."""
    f = load_corpus(spark, base, year_group)
    path = F.concat_ws("/", "arxiv_id", "filename")
    return f.groupBy("arxiv_id", "year_group").agg(F.sort_array(F.collect_list(path)).alias("file_paths"), F.count(F.lit(1)).alias("n_files"))


def load_sources(spark: SparkSession, base: str, max_bytes: int = P.MAX_FILE_BYTES) -> DataFrame:
    """SC10 and F10: LaTeX files of <base>/<id>/... as (arxiv_id, path, text); the length filter reaches
    the scan, so that large files are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").load(base).filter(F.col("length") <= max_bytes)
    rel = F.regexp_replace(F.substring_index("path", base.rstrip("/") + "/", -1), "^/+", "")
    return f.select(F.split(rel, "/")[0].alias("arxiv_id"), F.regexp_replace(rel, "^[^/]+/", "").alias("path"), P.decode(F.col("content")).alias("text"))


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """SC8: the files of a packed archive; names that leave the folder are dropped. A body that is no
    archive but one gzipped or plain file becomes main.tex."""
    packed = content
    if content[:2] == b"\x1f\x8b":
        try:
            packed = gzip.decompress(content)
        except (OSError, EOFError):
            packed = b""  # cut off: nothing of it can be trusted
    try:
        with tarfile.open(fileobj=io.BytesIO(packed), mode="r:") as t:
            inside = [m for m in t if m.isfile() and m.size <= P.MAX_FILE_BYTES and not m.name.startswith("/") and ".." not in m.name.split("/")]
            for m in inside:
                if (f := t.extractfile(m)) is not None:
                    yield m.name.removeprefix("./"), f.read()
        return
    except (tarfile.TarError, EOFError):
        pass
    if b"\\" in packed[:100_000] and len(packed) <= P.MAX_FILE_BYTES:
        yield "main.tex", packed


class Sources(DataSource):
    """SC6, SC7 and U9: format("sources") fetches the packed source of each id: option ids (one a line) or the
    file idfile, url with {id}, staged with a folder of what is there already, which is not fetched again.
    Rows: (arxiv_id, status_code, content_type, content). Ids are dealt over partitions (option parts), each of
    which asks politely, one after the other (option delay); a HEAD request tells first whether there is a
    source at all."""

    @classmethod
    def name(cls) -> str:
        return "sources"

    def schema(self) -> str:
        return "arxiv_id string, status_code int, content_type string, content binary"

    def reader(self, schema):
        return _SourcesReader(dict(self.options))


class _SourcesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self):
        ids = [x.strip() for x in self.o.get("ids", "").split("\n") if x.strip()]
        have = set(filter(None, self.o.get("have", "").split("\n")))
        ids = [x for x in ids if x not in have]
        n = max(1, min(len(ids), int(self.o.get("parts", 8))))
        return [InputPartition(ids[k::n]) for k in range(n)]

    def read(self, partition):
        for i in partition.value:
            url = self.o["url"].format(id=i)
            code, kind = head(url)
            found = code < 400 and kind != "application/pdf"
            yield i, code, kind, fetch(url) if found else None
            time.sleep(float(self.o.get("delay", 3)))


def head(url: str, timeout: float = 30) -> tuple[int, str]:
    """SC7: status and content type of a HEAD request; 599 where there is no answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as r:  # noqa: S310
            return r.status, r.headers.get_content_type()
    except urllib.error.HTTPError as e:
        return e.code, ""
    except OSError:
        return 599, ""


def download(spark: SparkSession, ids: DataFrame, url: str, staged: str, parts: int = 8, delay: float = 3) -> DataFrame:
    """SC6: fetch the sources of ids (a bounded batch of a run) that are not staged yet, write them there as parquet
    rows, and return the availability (arxiv_id, has_source) of all ids asked for."""
    have = spark.read.parquet(staged).select("arxiv_id") if exists(spark, staged) else spark.createDataFrame([], "arxiv_id string")
    todo = [r.arxiv_id for r in ids.select("arxiv_id").distinct().join(have, "arxiv_id", "left_anti").toLocalIterator()]
    if todo:
        spark.dataSource.register(Sources)
        spark.read.format("sources").option("ids", "\n".join(todo)).option("url", url).option("parts", parts).option("delay", delay).load().write.mode("append").parquet(staged)
    got = spark.read.parquet(staged) if exists(spark, staged) else spark.createDataFrame([], "arxiv_id string, status_code int, content_type string, content binary")
    return probe(got.join(ids.select("arxiv_id").distinct(), "arxiv_id", "left_semi"))


def unpack(archives: DataFrame) -> DataFrame:
    """(arxiv_id, path, text) of the LaTeX files in rows of (arxiv_id, content)."""
    ship(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, c) for i, x in zip(b["arxiv_id"], b["content"]) if x is not None for n, c in members(i, x) if n.endswith(".tex")]
            yield pd.DataFrame(rows, columns=["arxiv_id", "path", "content"])

    d = archives.select("arxiv_id", "content").mapInPandas(run, "arxiv_id string, path string, content binary")
    return d.select(F.regexp_replace("arxiv_id", r"^([A-Za-z][A-Za-z.\-]*)_(\d)", "$1/$2").alias("arxiv_id"), "path", P.decode(F.col("content")).alias("text"))


def load_archives(spark: SparkSession, base: str) -> DataFrame:
    """SC6 for staged archives: (arxiv_id, path, text) of the LaTeX files in <base>/<id>[.tar.gz]."""
    f = spark.read.format("binaryFile").load(base)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(?:tar\.gz|tgz|gz|tar)$", "")
    return unpack(f.select(name.alias("arxiv_id"), "content"))


def probe(heads: DataFrame) -> DataFrame:
    """SC7: (arxiv_id, has_source) from (arxiv_id, status_code, content_type): there is a source unless
    the answer failed or is a PDF."""
    return heads.select("arxiv_id", (F.coalesce(F.col("status_code") < 400, F.lit(False)) & (F.coalesce(F.lower("content_type"), F.lit("")) != "application/pdf")).alias("has_source"))


def optional_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """SC14: metrics, if there are any."""
    return spark.read.schema(schema).option("header", True).csv(path) if exists(spark, path) else None


def existing_records(spark: SparkSession, path: str) -> DataFrame:
    """SC15: the previous output, its newest complete version, or nothing; output older than part_no has whole papers."""
    at = latest_version(spark, path)
    return spark.read.schema(PAPER_RECORD).parquet(at).fillna(0, ["part_no"]) if at else spark.createDataFrame([], PAPER_RECORD)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """SC16."""
    return spark.read.schema(PROGRESS).parquet(path) if exists(spark, path) else spark.createDataFrame([], PROGRESS)
