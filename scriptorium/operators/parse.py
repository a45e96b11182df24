"""LaTeX sources to sections. Root choice, includes and section splitting are all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import markup as M
from scriptorium.session import durable

MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_DEPTH = 10
# fixed values: names of root files, and the patterns of sections
ROOT_NAMES = ("main.tex", "paper.tex", "manuscript.tex", "article.tex")
SECTION_RX = r"\\(section|subsection|subsubsection)\*?(?:\[[^\]]*\])?\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
TOP_RX = r"\\section\*?(?:\[[^\]]*\])?\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
SUB_RX = r"\\sub(?:sub)?section\*?(?:\[[^\]]*\])?\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
ABSTRACT_RX = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"
INCLUDE_RX = r"\\(?:input|include)\{([^}]+)\}"
ALT_RX = r"(?m)^(?:\d+|[IVX]+)\.?\s+([A-Z][A-Za-z\s]+?)$"


def decode(content: Column) -> Column:
    """SC10: UTF-8 if valid, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def root_file(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The root of each paper from (arxiv_id, path, text): a file with a document class, then the usual
    names at top level, then the largest; ties by path. Files beyond max_bytes are not looked at (F10)."""
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.when(F.instr("path", "/") > 0, len(ROOT_NAMES)).otherwise(F.coalesce(*[F.when(name == n, i) for i, n in enumerate(ROOT_NAMES)], F.lit(len(ROOT_NAMES))))
    f = files.filter(F.col("path").endswith(".tex") & (F.octet_length("text") <= max_bytes))
    # the least key wins; picked by a partial aggregation, so that a paper of any number of files is combined early
    key = F.struct(~F.col("text").contains(r"\documentclass"), rank, -F.length("text"), "path")
    return f.groupBy("arxiv_id").agg(F.min_by("path", key).alias("root"))


def pieces(text: Column) -> Column:
    """The text between includes and the names included, alternating: (literal, name or null)."""
    lit = F.split(text, INCLUDE_RX)
    names = F.regexp_extract_all(text, F.lit(INCLUDE_RX), 1)
    return F.transform(lit, lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("literal"), F.trim(F.get(names, i)).alias("name")))


def assemble(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(arxiv_id, text): included files put in place, at most max_depth deep, a missing file empty;
    comments are taken off after that.

    Includes are resolved for all papers at once, one level at a time: a piece that names a file is joined with
    the paper's files and gives way to that file's pieces. A level costs one join of the named pieces, not of
    the texts, and no paper's files have to stand in one row before the last step. A name is looked for beside
    the including file, then as the end of any path, with and without .tex; ties go to the least path."""
    f = files.select("arxiv_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    root = root_file(f)
    top = root.select("arxiv_id", F.col("root").alias("path"))
    now = f.join(top, ["arxiv_id", "path"]).select("arxiv_id", F.array().cast("array<int>").alias("at"), "path", "text")
    done = None
    for depth in range(max_depth + 1):
        if depth == max_depth:  # deeper includes stay as they are written
            done = done.unionByName(now.select("arxiv_id", "at", F.col("text").alias("literal")))
            break
        p = now.select("arxiv_id", "at", "path", F.posexplode(pieces(F.col("text"))).alias("k", "p")).select("arxiv_id", F.concat("at", F.array("k")).alias("at"), "path", "p.literal", "p.name")
        text = p.select("arxiv_id", F.concat("at", F.array(F.lit(0))).alias("at"), "literal")
        done = text if done is None else done.unionByName(text)
        named = p.filter("name is not null").select("arxiv_id", F.concat("at", F.array(F.lit(1))).alias("at"), "path", "name")
        now = durable(included(named, f))
        if not now.limit(1).count():
            break
    g = done.filter("literal <> ''").groupBy("arxiv_id").agg(F.sort_array(F.collect_list(F.struct("at", "literal"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["literal"]), "")
    return root.select("arxiv_id").join(g, "arxiv_id", "left").select("arxiv_id", M.strip_comments(F.coalesce(text, F.lit(""))).alias("text"))


def included(named: DataFrame, files: DataFrame) -> DataFrame:
    """(arxiv_id, at, path, text) of the file each name stands for; a file doesn't include itself."""
    base = F.regexp_extract("path", "^(.*/)?", 0)
    want = named.select("arxiv_id", "at", F.col("path").alias("_from"), base.alias("_base"), F.posexplode(F.array("name", F.concat("name", F.lit(".tex")))).alias("_c", "_want"))
    want = want.withColumn("_full", F.regexp_replace(F.concat("_base", "_want"), r"(^|/)\./", "$1"))
    # every ending of a path that begins after a slash, and the path itself
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_end = files.select("arxiv_id", F.col("path").alias("_path"), F.explode(ends).alias("_end"))
    exact = want.join(files.select("arxiv_id", F.col("path").alias("_full")).withColumn("_path", F.col("_full")), ["arxiv_id", "_full"]).withColumn("_k", F.lit(0))
    loose = want.join(by_end, (want.arxiv_id == by_end.arxiv_id) & (want["_want"] == by_end["_end"])).drop(by_end.arxiv_id).drop("_end").withColumn("_k", F.lit(1))
    hit = exact.select("arxiv_id", "at", "_from", "_c", "_k", "_path").unionByName(loose.select("arxiv_id", "at", "_from", "_c", "_k", "_path")).filter(F.col("_path") != F.col("_from"))
    best = hit.groupBy("arxiv_id", "at").agg(F.min(F.struct("_c", "_k", "_path")).alias("_b")).select("arxiv_id", "at", F.col("_b._path").alias("path"))
    return best.join(files, ["arxiv_id", "path"]).select("arxiv_id", "at", "path", "text")


def sections(docs: DataFrame, key: str = "arxiv_id", text: str = "text") -> DataFrame:
    """(key, order, heading, content): the abstract first, then the top-level sections with the
    headings below them as line breaks, or numbered lines where there are no sections; empty ones dropped
    and the rest numbered from 0. Arrays of one row, no shuffle."""
    t = F.col(text)
    heads = F.regexp_extract_all(t, F.lit(TOP_RX), 1)
    bodies = F.slice(F.split(t, TOP_RX), 2, 1_000_000)
    alt_heads = F.regexp_extract_all(t, F.lit(ALT_RX), 1)
    alt_bodies = F.slice(F.split(t, ALT_RX), 2, 1_000_000)
    pair = lambda h, b: F.transform(F.arrays_zip(h.alias("h"), b.alias("b")), lambda x: F.struct(x["h"].alias("heading"), F.regexp_replace(x["b"], SUB_RX, "\n").alias("content")))
    main = F.when(F.size(heads) > 0, pair(heads, bodies)).otherwise(pair(alt_heads, alt_bodies))
    ab = F.regexp_extract(t, ABSTRACT_RX, 1)
    first = F.array(F.struct(F.lit("Abstract").alias("heading"), ab.alias("content")))
    both = F.filter(F.concat(first, main), lambda s: F.length(F.regexp_replace(s["content"], r"(?U)^\s+|\s+$", "")) > 0)
    x = docs.filter(t.isNotNull()).select(key, F.posexplode(both).alias("order", "s"))
    return x.select(key, F.col("order").cast("int").alias("order"), F.trim("s.heading").alias("heading"), F.regexp_replace("s.content", r"(?U)^\s+|\s+$", "").alias("content"))
