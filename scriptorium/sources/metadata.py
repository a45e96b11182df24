"""Readers of bibliographic metadata: JSON-lines snapshot, cache, harvested XML pages, and the paged
harvest itself as a Python data source."""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scriptorium.operators import records as R
from scriptorium.schemas import PAPER_METADATA, SNAPSHOT

# fixed value: layout of one harvested record
RECORD_XML = (
    "header struct<identifier:string,datestamp:string>,"
    "metadata struct<arXivRaw:struct<id:string,version:array<struct<_version:string,date:string>>,title:string,authors:string,categories:string,doi:string,abstract:string>>"
)


def load_snapshot(spark: SparkSession, path: str, start: str, end: str, prefix: str = "cs") -> DataFrame:
    """SC4: JSON lines; malformed lines are skipped, category and window filters applied."""
    raw = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)
    cats = F.split(F.trim("categories"), r"\s+")
    d = R.published_window(raw.filter(R.in_category(cats, prefix)), start, end)
    return d.select(
        F.col("id").alias("arxiv_id"), F.trim(F.regexp_replace("title", r"\n\s*", " ")).alias("title"), R.parse_author_parts(F.col("authors_parsed")).alias("authors"), cats.alias("categories"), cats[0].alias("primary_category"),
        F.date_format("published_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.col("update_date").alias("updated"), F.trim("abstract").alias("abstract"), R.non_blank(F.col("doi")).alias("doi"),
    )


def load_metadata(spark: SparkSession, cache: str | None = None, snapshot: str | None = None, start: str = "1991-01-01", end: str = "2100-01-01", prefix: str = "cs", url: str | None = None) -> DataFrame:
    """Metadata from the cache if there is one, else from the raw snapshot, else from the harvest; what was
    not cached is written to the cache, if one is named, and read from there."""
    if cache and exists(spark, cache):
        return load_cache(spark, cache)
    if snapshot:
        m = load_snapshot(spark, snapshot, start, end, prefix)
    elif url:
        m = harvest(spark, url, start, end, prefix)
    else:
        raise ValueError("no cache, no snapshot and no address to harvest")
    if not cache:
        return m
    m.write.mode("error").json(cache)
    return load_cache(spark, cache)


def harvest(spark: SparkSession, url: str, start: str, end: str, prefix: str = "cs", delay: float = 3) -> DataFrame:
    """SC1 to SC3: the paged harvest, parsed; records of other categories are left out."""
    spark.dataSource.register(Harvest)
    pages = spark.read.format("harvest").option("url", url).option("from", start).option("until", end).option("set", prefix).option("delay", delay).load()
    m = parse_records(pages)
    return m.filter(R.in_category(F.col("categories"), prefix))


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """SC5: cached metadata; a missing file is empty, bad lines and lines without an id are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], PAPER_METADATA)
    return spark.read.schema(PAPER_METADATA).option("mode", "DROPMALFORMED").json(path).filter("arxiv_id is not null")


def parse_records(xml: DataFrame, column: str = "value") -> DataFrame:
    """SC3: one harvested record per row, as XML text, to metadata; records without id are dropped."""
    x = xml.select(F.from_xml(F.col(column), RECORD_XML).alias("r")).select("r.header", "r.metadata.arXivRaw.*")
    cats = F.split(F.trim("categories"), r"\s+")
    v1 = F.try_element_at(F.filter("version", lambda v: v["_version"] == "v1"), F.lit(1))["date"]
    ts = F.try_to_timestamp(F.regexp_replace(v1, r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return x.filter(R.non_blank(F.col("id")).isNotNull()).select(
        F.trim("id").alias("arxiv_id"), F.trim("title").alias("title"), R.parse_author_lines(F.coalesce("authors", F.lit(""))).alias("authors"), cats.alias("categories"), cats[0].alias("primary_category"),
        F.coalesce(F.date_format(ts, "yyyy-MM-dd"), v1, F.lit("")).alias("published"), F.col("header.datestamp").alias("updated"), F.trim("abstract").alias("abstract"), R.non_blank(F.col("doi")).alias("doi"),
    )


def load_xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """SC1 for pages already on disk: whole files, cut at record borders."""
    pages = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_records(pages.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<record>.*?</record>"), 0)).alias("value")))


class Harvest(DataSource):
    """SC1 and SC2: format("harvest") reads ListRecords pages one after the other, following the resumption
    token, politely delayed. Paging is sequential by protocol, so there is one partition."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _HarvestReader(dict(self.options))


class _HarvestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        base, delay = self.o["url"], float(self.o.get("delay", 3))
        params = {"verb": "ListRecords", "metadataPrefix": self.o.get("prefix", "arXivRaw"), "set": self.o.get("set", "cs")}
        params |= {k: self.o[k] for k in ("from", "until") if k in self.o}
        while True:
            page = fetch(f"{base}?{urllib.parse.urlencode(params)}").decode("utf-8", "replace")
            for m in re.finditer(r"<record>.*?</record>", page, re.S):
                yield (m[0],)
            t = re.search(r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", page)
            if not t:
                return
            params = {"verb": "ListRecords", "resumptionToken": t[1].strip()}
            time.sleep(delay)


def fetch(url: str, tries: int = 3, timeout: float = 60, wait: float = 5) -> bytes:
    """SC2 and SC6a: GET with growing waits; a 503's Retry-After is honoured, a 404 raised at once."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404 or k == tries - 1:
                raise
            time.sleep(float(e.headers.get("Retry-After", wait * 2**k)) if e.code == 503 else wait * 2**k)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    raise RuntimeError("unreachable")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop path, its file system): the one Spark itself reads and writes for this path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path has something, on the file system Spark reads it from (with or without a scheme)."""
    p, fs = filesystem(spark, path)
    return fs.exists(p)


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The newest complete version folder under path; one without its mark of success is not looked at."""
    p, fs = filesystem(spark, path)
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    done = [n for n in names if re.fullmatch(r"v=\d{8}", n) and exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")]
    return f"{path.rstrip('/')}/{max(done)}" if done else None


def next_version(spark: SparkSession, path: str) -> str:
    """A folder for the version after the newest complete one."""
    last = latest_version(spark, path)
    return f"{path.rstrip('/')}/v={(int(last[-8:]) + 1 if last else 0):08d}"
