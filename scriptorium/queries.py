"""Registry of the core queries and their SQL. Keys begin with the operator ids of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import citations as C
from scriptorium.functions import headings as H
from scriptorium.functions import markers as MK
from scriptorium.functions import markup as M
from scriptorium.functions import text as T
from scriptorium.operators import corpus as K
from scriptorium.operators import parse as P
from scriptorium.operators import records as R
from scriptorium.operators import sampling as SA
from scriptorium.operators import scoring as SC
from scriptorium.operators import stats as S
from scriptorium.plans import analytics as A
from scriptorium.session import durable, spread, table
from scriptorium.sources import sinks

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


# ------------------------------------------------------------------------------ shared pieces of SQL

ID = r"regexp_replace(trim({}), '^([A-Za-z][A-Za-z.\-]*)_([0-9])', '\1/\2')"
FILES = f"files AS (SELECT doc_id, {ID.format('arxiv_id')} AS arxiv_id, year_group, filename, coalesce(text, '') AS raw_text FROM documents WHERE arxiv_id IS NOT NULL)"
CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<\s*g\s*r\s*a\s*p\s*h\s*i\s*c\s*s\s*>', ' ', 'g'), '<ref>', ' ', 'g'), '<cit\.>', ' CITATION ', 'g'), '\s+', ' ', 'g'))"
CONCAT = FILES + ", cat AS (SELECT arxiv_id, year_group, CAST(0 AS BIGINT) AS part_no, string_agg(raw_text, chr(10) || chr(10) ORDER BY filename NULLS FIRST, doc_id) AS text, count(*) AS n_files FROM files GROUP BY arxiv_id, year_group)"
PAPERS = CONCAT + f", cl AS (SELECT *, {CLEAN.format('text')} AS text_clean FROM cat), papers AS (SELECT *, len(regexp_extract_all(text_clean, '[^\\s]+')) AS n_ws_words FROM cl WHERE len(regexp_extract_all(text_clean, '[^\\s]+')) >= 50)"
TOKEN = r"[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*"
WORDS = "list_filter(regexp_extract_all({}, '" + TOKEN + r"'), lambda w: regexp_full_match(w, '\p{{L}}+') AND w <> 'CITATION')"
WORDS = WORDS.replace("{L}\\p{N}", "{{L}}\\p{{N}}").replace("[\\p{L}", "[\\p{{L}}").replace("\\p{N}]", "\\p{{N}}]")
SENTS = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
SYL = "greatest(1, len(regexp_extract_all(lower({}), '[aeiouy]+')))"
STRUCT = PAPERS + (
    f", st AS (SELECT arxiv_id, year_group, part_no, len(regexp_extract_all(text, '<cit\\.>')) AS n_citations, len({WORDS.format('text_clean')}) AS n_words, len({SENTS.format('text_clean')}) AS n_sentences,"
    r" greatest(1, len(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n', chr(1), 'g'), chr(1)), lambda p: trim(p) <> ''))) AS n_paragraphs FROM papers)"
)
WORDROWS = PAPERS + f", wl AS (SELECT arxiv_id, year_group, part_no, {WORDS.format('text_clean')} AS ws FROM papers), wr AS (SELECT arxiv_id, year_group, part_no, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS j FROM wl)"
SENTROWS = PAPERS + f", sl AS (SELECT arxiv_id, year_group, part_no, {SENTS.format('text_clean')} AS ss FROM papers), sr AS (SELECT arxiv_id, year_group, part_no, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM sl)"
KEYS = "arxiv_id, year_group"
METRICS = ["n_words", "n_citations", "n_paragraphs", "n_sentences"]
LONG = STRUCT + ", long AS (" + " UNION ALL ".join(f"SELECT {KEYS}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM st" for m in METRICS) + ")"


# tail probabilities in SQL by Simpson's rule over 4,000 steps: of the normal and of Student's t distribution
_SIMPSON = "list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})) * ({w}) / 4000.0 / 3.0"


def _normal_tail(z: str) -> str:
    """Two-sided tail beyond z >= 0."""
    f = f"exp(-0.5 * power({z} + i * 12.0 / 4000.0, 2))"
    return "least(1.0, 2 * 0.3989422804014327 * " + _SIMPSON.format(f=f, w="12.0") + ")"


def _student_tail(t: str, df: str) -> str:
    """Two-sided tail beyond |t|, with x = |t| + u / (1 - u) for u from 0 to 1."""
    x = f"(abs({t}) + (i / 4000.0) / (1.0 - i / 4000.0))"
    f = f"(CASE WHEN i = 4000 THEN 0.0 ELSE exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()) - ({df} + 1) / 2 * ln(1 + {x} * {x} / {df})) / power(1.0 - i / 4000.0, 2) END)"
    return "least(1.0, 2 * " + _SIMPSON.format(f=f, w="1.0") + ")"


def files(s: SparkSession, d: str) -> DataFrame:
    return K.corpus_files(table(s, d, "documents"))


def papers(s: SparkSession, d: str) -> DataFrame:
    return K.papers(files(s, d))


def long(s: SparkSession, d: str) -> DataFrame:
    return K.unpivot(K.structure(papers(s, d)), METRICS, K.PAPER)


def q(name: str, body: str, prefix: str = "") -> Callable:
    return query(name, f"WITH {prefix} {body}" if prefix else body)


# ------------------------------------------------------------------------- sources, filters, metadata


@q("SC11_corpus_files", "SELECT * FROM files", FILES)
def _(s, d):
    return files(s, d).withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


@q("F2_category", "SELECT meta_id, arxiv_id FROM paper_metadata WHERE len(list_filter(categories, lambda c: starts_with(c, 'cs.'))) > 0")
def _(s, d):
    return table(s, d, "paper_metadata").filter(R.in_category(F.col("categories"))).select("meta_id", "arxiv_id")


@q("F4_dates", "SELECT meta_id, published FROM paper_metadata WHERE substring(published, 1, 10) >= '2015-01-01' AND substring(published, 1, 10) <= '2020-06-30'")
def _(s, d):
    return R.by_date(table(s, d, "paper_metadata"), "2015-01-01", "2020-06-30").select("meta_id", "published")


@q(
    "PJ1_flat_metadata",
    "SELECT meta_id, arxiv_id, array_to_string(authors, '; ') AS authors, array_to_string(categories, ', ') AS categories, trim(replace(title, chr(10), ' ')) AS title, nullif(trim(doi), '') AS doi FROM paper_metadata",
)
def _(s, d):
    m = table(s, d, "paper_metadata")
    return m.select("meta_id", "arxiv_id", F.array_join("authors", "; ").alias("authors"), F.array_join("categories", ", ").alias("categories"), F.trim(F.replace(F.col("title"), F.lit("\n"), F.lit(" "))).alias("title"), R.non_blank(F.col("doi")).alias("doi"))


@q(
    "PJ2_author_lines",
    r"SELECT meta_id, list_filter(list_transform(string_split(array_to_string(authors, chr(10)), chr(10)), lambda x: trim(string_split(trim(x), '(')[1])), lambda x: x <> '') AS names FROM paper_metadata",
)
def _(s, d):
    return table(s, d, "paper_metadata").select("meta_id", R.parse_author_lines(F.array_join("authors", "\n")).alias("names"))


LATEST = f"latest AS (SELECT {ID.format('arxiv_id')} AS arxiv_id, arg_max(status, (logged_at, log_id)) AS status, count(*) AS n_events FROM progress_log WHERE arxiv_id IS NOT NULL AND status IS NOT NULL GROUP BY 1)"


@q("D8_latest_status", "SELECT * FROM latest", LATEST)
def _(s, d):
    return R.latest_status(table(s, d, "progress_log"))


@q("D7_unknown_statuses", "SELECT status, count(*) AS n FROM progress_log WHERE status NOT IN ('pending', 'downloaded', 'parsed', 'failed_download', 'failed_parse', 'completed', 'no_latex_source') GROUP BY status")
def _(s, d):
    return R.unknown_statuses(table(s, d, "progress_log"))


META = f"m AS (SELECT meta_id, {ID.format('arxiv_id')} AS arxiv_id FROM paper_metadata)"


def _meta(s, d):
    return table(s, d, "paper_metadata").select("meta_id", K.canonical_id("arxiv_id").alias("arxiv_id"))


@q("F5_J5_to_process", "SELECT arxiv_id, meta_id FROM m WHERE arxiv_id NOT IN (SELECT arxiv_id FROM latest WHERE status NOT IN ('downloaded', 'pending'))", f"{LATEST}, {META}")
def _(s, d):
    return R.to_process(_meta(s, d), R.latest_status(table(s, d, "progress_log")))


AVAIL = "av AS (SELECT arxiv_id, status <> 'no_latex_source' AND status <> 'failed_download' AS has_source FROM latest)"


def _available(s, d):
    return R.latest_status(table(s, d, "progress_log")).select("arxiv_id", ((F.col("status") != "no_latex_source") & (F.col("status") != "failed_download")).alias("has_source"))


@q("F6_J3_with_source", "SELECT arxiv_id, meta_id FROM m WHERE arxiv_id IN (SELECT arxiv_id FROM av WHERE has_source)", f"{LATEST}, {META}, {AVAIL}")
def _(s, d):
    return R.with_source(_meta(s, d), _available(s, d))


@q("F6_source_misses", "SELECT arxiv_id, 'no_latex_source' AS status FROM av WHERE NOT has_source", f"{LATEST}, {AVAIL}")
def _(s, d):
    return R.source_misses(_available(s, d))


@q("L4_run_cap", "SELECT arxiv_id FROM (SELECT DISTINCT arxiv_id FROM m) ORDER BY arxiv_id LIMIT 200", META)
def _(s, d):
    return R.run_cap(_meta(s, d).select("arxiv_id").distinct(), 200)


@q(
    "J4_merge_records",
    "SELECT record_id, arxiv_id FROM r WHERE record_id % 3 <> 0 AND arxiv_id NOT IN (SELECT arxiv_id FROM r WHERE record_id % 3 = 0) UNION ALL SELECT record_id, arxiv_id FROM r WHERE record_id % 3 = 0",
    f"r AS (SELECT record_id, {ID.format('arxiv_id')} AS arxiv_id FROM paper_records)",
)
def _(s, d):
    # old and new runs: both parts together are the whole table
    r = table(s, d, "paper_records").select("record_id", K.canonical_id("arxiv_id").alias("arxiv_id"))
    new = F.col("record_id") % 3 == 0
    return R.merge_records(r.filter(~new), r.filter(new)).select("record_id", "arxiv_id")


@q("I3_latest_records", "SELECT arg_max(record_id, (updated, record_id)) AS record_id, arxiv_id FROM r GROUP BY arxiv_id", f"r AS (SELECT record_id, {ID.format('arxiv_id')} AS arxiv_id, coalesce(updated, '') AS updated FROM paper_records)")
def _(s, d):
    r = table(s, d, "paper_records").select("record_id", K.canonical_id("arxiv_id").alias("arxiv_id"), F.coalesce("updated", F.lit("")).alias("updated"))
    return R.latest_records(r, F.col("arxiv_id"), F.struct("updated", "record_id")).select("record_id", "arxiv_id")


@q(
    "J6_sources_of_papers",
    "SELECT m.meta_id, m.arxiv_id, x.n_files FROM m JOIN (SELECT arxiv_id, count(*) AS n_files FROM files GROUP BY arxiv_id) x ON m.arxiv_id = x.arxiv_id",
    f"{META}, {FILES}",
)
def _(s, d):
    n = files(s, d).groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("n_files"))
    return _meta(s, d).join(n, "arxiv_id").select("meta_id", "arxiv_id", "n_files")


# ------------------------------------------------------------------------------------ corpus, features


@q("A1_corpus_statistics", "SELECT year_group, count(DISTINCT arxiv_id) AS papers, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_words, round(avg(n), 1) AS mean_words, round(median(n), 1) AS median_words FROM x GROUP BY year_group", FILES + ", x AS (SELECT *, len(regexp_extract_all(raw_text, '[^\\s]+')) AS n FROM files)")
def _(s, d):
    return K.corpus_statistics(files(s, d))


@q("A2_concat_papers", "SELECT * FROM cat", CONCAT)
def _(s, d):
    return K.concat_papers(files(s, d))


@q("C22_F7_papers", "SELECT arxiv_id, year_group, part_no, n_files, text_clean, n_ws_words FROM papers", PAPERS)
def _(s, d):
    return papers(s, d).select(*K.KEYS, "n_files", "text_clean", "n_ws_words")


@q("C23_literal_graphics", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<graphics>', ' ', 'g'), '<ref>', ' ', 'g'), '<cit\.>', ' CITATION ', 'g'), '\s+', ' ', 'g')) AS t FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.clean_text("text", literal_graphics=True).alias("t"))


@q("C24_newlines", r"SELECT section_id, replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ' ') AS t FROM raw_sections")
def _(s, d):
    return table(s, d, "raw_sections").select("section_id", T.normalize_newlines("content").alias("t"))


@q("X1_X2_X14_structure", f"SELECT {KEYS}, n_citations, n_paragraphs, n_words, n_sentences, round(n_citations / nullif(n_sentences, 0), 6) AS cit_per_sentence, round(n_citations * 100.0 / nullif(n_words, 0), 6) AS cit_per_100_words FROM st", STRUCT)
def _(s, d):
    return rounded(K.structure(papers(s, d)))


@q("X4_whitespace_words", "SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.whitespace_words("text").alias("n"))


@q("P8_sentences", f"SELECT {KEYS}, part_no, pos, sentence, len({WORDS.format('sentence')}) AS n_words FROM sr", SENTROWS)
def _(s, d):
    return K.sentence_rows(papers(s, d)).drop("passive")


@q("P9_words", f"SELECT {KEYS}, w, count(*) AS c FROM wr GROUP BY {KEYS}, w", WORDROWS)
def _(s, d):
    return K.word_rows(papers(s, d), K.PAPER).groupBy(*K.PAPER, "w").agg(F.count(F.lit(1)).alias("c"))


@q("P10_manifest_words", f"SELECT doc_id, len(regexp_extract_all({CLEAN.format('text')}, '[A-Za-z][A-Za-z0-9''-]*')) AS n FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(T.manifest_words(T.clean_text("text"))).cast("bigint").alias("n"))


READ = WORDROWS + (
    f", ns AS (SELECT {KEYS}, len({SENTS.format('text_clean')}) AS n_sentences FROM papers), c AS (SELECT {KEYS}, count(*) AS n_words, CAST(sum({SYL.format('w')}) AS BIGINT) AS n_syllables, count(*) FILTER ({SYL.format('w')} >= 3) AS n_complex FROM wr GROUP BY {KEYS})"
)


@q(
    "X3_X6_X7_readability",
    f"SELECT arxiv_id, year_group, n_sentences, coalesce(n_words, 0) AS n_words, coalesce(n_syllables, 0) AS n_syllables, coalesce(n_complex, 0) AS n_complex, round(206.835 - 1.015 * n_words / nullif(n_sentences, 0) - 84.6 * n_syllables / nullif(n_words, 0), 6) AS flesch, round(0.4 * (n_words / nullif(n_sentences, 0) + 100.0 * n_complex / nullif(n_words, 0)), 6) AS fog FROM ns LEFT JOIN c USING ({KEYS})",
    READ,
)
def _(s, d):
    return rounded(K.readability(papers(s, d)))


LEX = WORDROWS + f", k AS (SELECT {KEYS}, w, count(*) AS c FROM wr GROUP BY {KEYS}, w)"


@q("X10_X12_lexical", f"SELECT {KEYS}, CAST(sum(c) AS BIGINT) AS n_words, count(*) AS n_types, round(count(*) / sum(c), 6) AS ttr, round(count(*) FILTER (c = 1) / sum(c), 6) AS hapax_ratio FROM k GROUP BY {KEYS}", LEX)
def _(s, d):
    return rounded(K.lexical(papers(s, d)))


@q(
    "X11_mattr",
    f"SELECT {KEYS}, round(CASE WHEN max(n) < 50 THEN count(*) FILTER (prev = 0) / max(n) ELSE sum(greatest(0, least(j, n - 49) - greatest(0, j - 50, prev))) / (50.0 * (max(n) - 49)) END, 6) AS mattr FROM pr GROUP BY {KEYS}",
    WORDROWS + f", nn AS (SELECT {KEYS}, count(*) AS n FROM wr GROUP BY {KEYS}), pr AS (SELECT {KEYS}, w, j, n, coalesce(lag(j) OVER (PARTITION BY {KEYS}, w ORDER BY j), 0) AS prev FROM wr JOIN nn USING ({KEYS}))",
)
def _(s, d):
    return rounded(K.mattr(papers(s, d)))


@q("X13_sentence_length", f"SELECT {KEYS}, count(*) AS n_sentences, round(avg(n), 6) AS mean_sentence_length, median(n) AS median_sentence_length FROM (SELECT {KEYS}, len({WORDS.format('sentence')}) AS n FROM sr) GROUP BY {KEYS}", SENTROWS)
def _(s, d):
    return rounded(K.sentence_features(papers(s, d)).drop("passive_ratio"))


PASSIVE = "(?i)(?:^|[^\\p{L}])(?:" + "|".join(T.BE) + ")(?:\\s+[^\\s]+){0,2}?\\s+(?:\\p{L}{2,}ed|" + "|".join(T.PARTICIPLES) + ")(?:$|[^\\p{L}])"


@q("X8_X9_passive", f"SELECT {KEYS}, round(avg(CASE WHEN regexp_matches(sentence, '{PASSIVE}') THEN 1.0 ELSE 0.0 END), 6) AS passive_ratio FROM sr GROUP BY {KEYS}", SENTROWS)
def _(s, d):
    return rounded(K.sentence_features(papers(s, d)).select(*K.PAPER, "passive_ratio"))


@q("X17_alpha_ratio", r"SELECT corpus_id, round(CASE WHEN length(regexp_replace(t, '\s+', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(t, '[^\p{L}]', '', 'g')) / length(regexp_replace(t, '\s+', '', 'g')) END, 6) AS alpha_ratio FROM (SELECT corpus_id, " + CLEAN.format("raw_text") + " AS t FROM corpus_records)")
def _(s, d):
    return rounded(spread(table(s, d, "corpus_records")).select("corpus_id", T.alpha_ratio(T.clean_text("raw_text")).alias("alpha_ratio")))


@q(
    "D12_features",
    f"""SELECT ns.arxiv_id, ns.year_group, n_citations, n_paragraphs, st.n_words, st.n_sentences, round(ttr, 6) AS ttr, round(hapax_ratio, 6) AS hapax_ratio, round(mean_sentence_length, 6) AS mean_sentence_length, median_sentence_length
        FROM st JOIN (SELECT {KEYS}, count(*) / sum(c) AS ttr, count(*) FILTER (c = 1) / sum(c) AS hapax_ratio FROM k GROUP BY {KEYS}) lx USING ({KEYS})
        JOIN (SELECT {KEYS}, avg(n) AS mean_sentence_length, median(n) AS median_sentence_length FROM (SELECT {KEYS}, len({WORDS.format('sentence')}) AS n FROM sr) GROUP BY {KEYS}) ns USING ({KEYS})""",
    LEX + STRUCT[len(PAPERS) :] + SENTROWS[len(PAPERS) :],
)
def _(s, d):
    f = rounded(A.features(papers(s, d)))
    return f.select(*K.PAPER, "n_citations", "n_paragraphs", "n_words", "n_sentences", "ttr", "hapax_ratio", "mean_sentence_length", "median_sentence_length")


@q(
    "SK8_metric_export",
    f"""SELECT st.arxiv_id, st.year_group, p.n_files, st.n_words, st.n_sentences, rd.n_syllables, round(sl2.mean_sentence_length, 6) AS mean_sentence_length, sl2.median_sentence_length, round(lx.ttr, 6) AS ttr, round(mt.mattr, 6) AS mattr, round(lx.hapax_ratio, 6) AS hapax_ratio,
        round(206.835 - 1.015 * st.n_words / nullif(st.n_sentences, 0) - 84.6 * rd.n_syllables / nullif(st.n_words, 0), 6) AS flesch, round(0.4 * (st.n_words / nullif(st.n_sentences, 0) + 100.0 * rd.n_complex / nullif(st.n_words, 0)), 6) AS fog, round(sl2.passive_ratio, 6) AS passive_ratio,
        st.n_citations, st.n_paragraphs, round(st.n_citations / nullif(st.n_sentences, 0), 6) AS cit_per_sentence, round(st.n_citations * 100.0 / nullif(st.n_words, 0), 6) AS cit_per_100_words
        FROM st JOIN papers p USING ({KEYS}) JOIN c rd USING ({KEYS}) JOIN (SELECT {KEYS}, count(*) / sum(c) AS ttr, count(*) FILTER (c = 1) / sum(c) AS hapax_ratio FROM k GROUP BY {KEYS}) lx USING ({KEYS})
        JOIN (SELECT {KEYS}, avg(n) AS mean_sentence_length, median(n) AS median_sentence_length, avg(pv) AS passive_ratio FROM (SELECT {KEYS}, len({WORDS.format('sentence')}) AS n, CASE WHEN regexp_matches(sentence, '{PASSIVE}') THEN 1.0 ELSE 0.0 END AS pv FROM sr) GROUP BY {KEYS}) sl2 USING ({KEYS})
        JOIN (SELECT {KEYS}, CASE WHEN max(n) < 50 THEN count(*) FILTER (prev = 0) / max(n) ELSE sum(greatest(0, least(j, n - 49) - greatest(0, j - 50, prev))) / (50.0 * (max(n) - 49)) END AS mattr FROM pr GROUP BY {KEYS}) mt USING ({KEYS})""",
    LEX + READ[len(WORDROWS) :] + STRUCT[len(PAPERS) :] + SENTROWS[len(PAPERS) :] + f", nn AS (SELECT {KEYS}, count(*) AS n FROM wr GROUP BY {KEYS}), pr AS (SELECT {KEYS}, w, j, n, coalesce(lag(j) OVER (PARTITION BY {KEYS}, w ORDER BY j), 0) AS prev FROM wr JOIN nn USING ({KEYS}))",
)
def _(s, d):
    return rounded(sinks.metric_export(A.features(papers(s, d))))


# ------------------------------------------------------------------------------------ markers, citations

_MARK = " UNION ALL ".join("SELECT {k}, '{m}' AS marker, '{t}' AS tier, len(regexp_extract_all(text_clean, '(?i){rx}')) AS cnt, n_words FROM pw".format(k=KEYS, m=m, t=t, rx=rx) for m, t, rx in MK.MARKERS)
MARKS = PAPERS + f", pw AS (SELECT *, len({WORDS.format('text_clean')}) AS n_words FROM papers), mk AS ({_MARK}), mr AS (SELECT {KEYS}, marker, tier, cnt, cnt * 1000.0 / nullif(n_words, 0) AS per1k, CASE WHEN cnt > 0 THEN 1 ELSE 0 END AS has FROM mk)"


@q("X15_markers", f"SELECT {KEYS}, marker, tier, cnt, round(per1k, 6) AS per1k, has FROM mr", MARKS)
def _(s, d):
    return rounded(A.marker_table(papers(s, d)))


@q("X16_marker_score", f"SELECT {KEYS}, round(sum(per1k), 6) AS llm_marker_score FROM mr WHERE tier = 'high-confidence' GROUP BY {KEYS}", MARKS)
def _(s, d):
    return rounded(A.marker_score(papers(s, d)))


@q(
    "A4_prevalence",
    "SELECT marker, tier, round(a, 6) AS pct_2015, round(b, 6) AS pct_2025, round(b / (CASE WHEN a = 0 THEN 0.01 ELSE a END), 6) AS ratio FROM (SELECT marker, tier, coalesce(avg(has) FILTER (year_group = '2015'), 0) * 100.0 AS a, coalesce(avg(has) FILTER (year_group = '2025'), 0) * 100.0 AS b FROM mr GROUP BY marker, tier)",
    MARKS,
)
def _(s, d):
    return rounded(A.prevalence(A.marker_table(papers(s, d))))


@q("A5_top_markers", "SELECT marker, CAST(sum(cnt) AS BIGINT) AS cnt FROM mr WHERE year_group = '2025' GROUP BY marker ORDER BY cnt DESC, marker LIMIT 10", MARKS)
def _(s, d):
    return A.top_markers(A.marker_table(papers(s, d)))


CONT = MARKS + ", ct AS (SELECT marker, tier, count(*) FILTER (year_group = '2015' AND has = 1) AS a, count(*) FILTER (year_group = '2015' AND has = 0) AS b, count(*) FILTER (year_group = '2025' AND has = 1) AS c, count(*) FILTER (year_group = '2025' AND has = 0) AS d FROM mr WHERE year_group IN ('2015', '2025') GROUP BY marker, tier)"


@q("A9_contingency", "SELECT * FROM ct", CONT)
def _(s, d):
    return S.contingency(A.marker_table(papers(s, d)))


@q(
    "ST6_chi_square",
    "SELECT marker, round(CASE WHEN (a+b)*(c+d)*(a+c)*(b+d) = 0 THEN NULL ELSE n * power(greatest(abs(a*d - b*c) - n / 2.0, 0), 2) / ((a+b)*(c+d)*(a+c)*(b+d)) END, 6) AS chi2, CASE WHEN b * c > 0 THEN round(a * d / (b * c), 6) WHEN a * d > 0 THEN CAST('inf' AS DOUBLE) END AS odds_ratio FROM (SELECT marker, CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d, CAST(a+b+c+d AS DOUBLE) n FROM ct)",
    CONT,
)
def _(s, d):
    t = S.contingency(A.marker_table(papers(s, d)))
    cols = [F.col(x) for x in "abcd"]
    return rounded(t.select("marker", S.chi_square(*cols).alias("chi2"), S.odds_ratio(*cols).alias("odds_ratio")))


def _mw_p(u: str, n1: str, n2: str, ties: str) -> str:
    """Asymptotic p of the rank test, with tie and continuity correction."""
    n = f"({n1} + {n2})"
    var = f"({n1} * {n2} / 12.0 * (({n} + 1) - {ties} / ({n} * ({n} - 1.0))))"
    return f"CASE WHEN {var} <= 0 THEN 1.0 ELSE {_normal_tail(f'(greatest(0.0, abs({u} - {n1} * {n2} / 2.0) - 0.5) / sqrt({var}))')} END"


_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_LOGP = _LC.format("r1", "k") + " + " + _LC.format("r2", "(c1 - k)") + " - " + _LC.format("(r1 + r2)", "c1")
_FISHER = f"CASE WHEN r1 = 0 OR r2 = 0 OR c1 = 0 OR b + d = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(list_filter(range(CAST(greatest(0, c1 - r2) AS BIGINT), CAST(least(r1, c1) AS BIGINT) + 1), lambda k: {_LOGP} <= {_LOGP.replace('k', 'a')} + 1e-7), lambda k: exp({_LOGP})))) END".replace("lambda a", "lambda k")
_TESTS = CONT + (
    ", tt AS (SELECT marker, tier, a, b, c, d, CAST(a + b AS DOUBLE) AS r1, CAST(c + d AS DOUBLE) AS r2, CAST(a + c AS DOUBLE) AS c1, CAST(a + b + c + d AS DOUBLE) AS n FROM ct)"
    ", te AS (SELECT *, CASE WHEN r1 * r2 * c1 * (b + d) = 0 THEN NULL ELSE n * power(greatest(abs(CAST(a AS DOUBLE) * d - CAST(b AS DOUBLE) * c) - n / 2.0, 0), 2) / (r1 * r2 * c1 * (b + d)) END AS chi2, least(least(r1 * c1, r1 * (b + d)), least(r2 * c1, r2 * (b + d))) / n AS expected FROM tt)"
    f", tp AS (SELECT *, CASE WHEN expected >= 5 THEN 'chi2' ELSE 'fisher' END AS test, CASE WHEN expected >= 5 THEN {_normal_tail('sqrt(chi2)')} ELSE {_FISHER} END AS p FROM te)"
    ", rh AS (SELECT marker, per1k AS value, count(*) FILTER (year_group = '2015') AS n1, count(*) FILTER (year_group = '2025') AS n2 FROM mr WHERE year_group IN ('2015', '2025') AND per1k IS NOT NULL GROUP BY marker, per1k), rc AS (SELECT *, coalesce(sum(n2) OVER (PARTITION BY marker ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c2 FROM rh)"
    ", ru AS (SELECT marker, CAST(sum(n1) AS DOUBLE) AS m1, CAST(sum(n2) AS DOUBLE) AS m2, CAST(sum(n1 * (c2 + n2 / 2.0)) AS DOUBLE) AS u, CAST(sum(CAST(n1 + n2 AS DOUBLE) * (n1 + n2) * (n1 + n2) - (n1 + n2)) AS DOUBLE) AS ties FROM rc GROUP BY marker)"
    f", rp AS (SELECT marker, {_mw_p('u', 'm1', 'm2', 'ties')} AS mw_p FROM ru)"
    ", tq AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, marker) AS q, row_number() OVER (ORDER BY p, marker) AS rk, count(*) OVER () AS k FROM tp), tb AS (SELECT *, least(1.0, min(q) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM tq)"
)


@q(
    "ST7_ST11_marker_tests",
    "SELECT marker, tier, a, b, c, d, round(a * 100.0 / r1, 6) AS pct1, round(c * 100.0 / r2, 6) AS pct2, CASE WHEN CAST(b AS DOUBLE) * c > 0 THEN round(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c), 6) WHEN CAST(a AS DOUBLE) * d > 0 THEN CAST('inf' AS DOUBLE) END AS odds_ratio, round(chi2, 6) AS chi2, round(expected, 6) AS expected, test, round(p, 6) AS p, round(mw_p, 6) AS mw_p, round(least(1.0, p * k), 6) AS bonferroni, round(bh, 6) AS bh, bh < 0.05 AS significant FROM tb LEFT JOIN rp USING (marker)",
    _TESTS,
)
def _(s, d):
    return rounded(S.marker_tests(A.marker_table(papers(s, d))))


_VERBS = "|".join(C.VERBS)
CTX = PAPERS + (
    r", pp AS (SELECT arxiv_id, year_group, part_no, string_split(text, '<cit.>') AS parts FROM papers), ci AS (SELECT arxiv_id, year_group, part_no, parts, unnest(range(1, len(parts))) AS i FROM pp)"
    r", cx AS (SELECT arxiv_id, year_group, part_no, regexp_replace(replace(right(array_to_string(list_slice(parts, greatest(1, i - 20), i), '<cit.>'), 80), '<cit.>', 'CITATION'), '^\s+|\s+$', '', 'g') AS c FROM ci)"
    rf", pt AS (SELECT arxiv_id, year_group, part_no, CASE WHEN regexp_matches(c, 'CITATION\s*[,;]\s*$') THEN 'list_style' WHEN regexp_matches(c, '(?:et\s+al\.|[A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?)\s*$') THEN 'author_named' WHEN regexp_matches(c, '(?i)\b(?:{_VERBS})\s+(?:by|in)\s*$') THEN 'verb_led' ELSE 'parenthetical' END AS pattern FROM cx)"
)


@q("X5_citation_contexts", f"SELECT {KEYS}, pattern, count(*) AS n FROM pt GROUP BY {KEYS}, pattern", CTX)
def _(s, d):
    return A.citation_patterns(papers(s, d))


@q("A6_pattern_shares", "SELECT year_group, pattern, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY year_group), 6) AS share FROM pt GROUP BY year_group, pattern", CTX)
def _(s, d):
    return rounded(A.pattern_shares(A.citation_patterns(papers(s, d))))


@q("A7_zero_citations", "SELECT year_group, count(*) FILTER (n_citations = 0) AS zero, count(*) AS papers, round(avg(CASE WHEN n_citations = 0 THEN 1 ELSE 0 END), 6) AS zero_rate FROM st GROUP BY year_group", STRUCT)
def _(s, d):
    return rounded(A.zero_citations(K.structure(papers(s, d))))


# --------------------------------------------------------------------------------- cohort statistics


@q(
    "A1_A3_cohort_summary",
    "SELECT year_group, metric, count(value) AS n, round(avg(value), 6) AS mean, median(value) AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max FROM long GROUP BY year_group, metric",
    LONG,
)
def _(s, d):
    return rounded(K.summary(long(s, d)))


@q("A13_describe", "SELECT year_group, metric, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY year_group, metric", LONG)
def _(s, d):
    g = K.quantiles(long(s, d), "value", ["year_group", "metric"], [0.25, 0.5, 0.75])
    return rounded(g.select("year_group", "metric", "n", *[F.col(f"q{i}").alias(f"q{i + 1}") for i in range(3)]))


@q("A17_sentence_lengths", f"SELECT year_group, len({WORDS.format('sentence')}) AS n_words, count(*) AS n FROM sr GROUP BY 1, 2", SENTROWS)
def _(s, d):
    return K.sentence_rows(papers(s, d)).groupBy("year_group", "n_words").agg(F.count(F.lit(1)).alias("n"))


HIST = LONG + ", h AS (SELECT metric, value, count(*) FILTER (year_group = '2015') AS n1, count(*) FILTER (year_group = '2025') AS n2 FROM long WHERE year_group IN ('2015', '2025') GROUP BY metric, value), hc AS (SELECT *, coalesce(sum(n2) OVER (PARTITION BY metric ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c2 FROM h), mw AS (SELECT metric, CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, CAST(sum(n1 * (c2 + n2 / 2.0)) AS DOUBLE) AS u, CAST(sum(CAST(n1 + n2 AS DOUBLE) * (n1 + n2) * (n1 + n2) - (n1 + n2)) AS DOUBLE) AS ties FROM hc GROUP BY metric)"


@q("ST1_ST2_mann_whitney", "SELECT metric, n1, n2, u, ties, round(1 - 2 * u / (CAST(n1 AS DOUBLE) * n2), 6) AS rank_biserial FROM mw", HIST)
def _(s, d):
    return rounded(S.mann_whitney(long(s, d)))


MOM = LONG + ", mo AS (SELECT metric, count(*) FILTER (year_group = '2015') AS n1, count(*) FILTER (year_group = '2025') AS n2, avg(value) FILTER (year_group = '2015') AS mean1, avg(value) FILTER (year_group = '2025') AS mean2, var_samp(value) FILTER (year_group = '2015') AS var1, var_samp(value) FILTER (year_group = '2025') AS var2 FROM long WHERE year_group IN ('2015', '2025') GROUP BY metric)"


@q("ST3_ST4_effects", "SELECT metric, round((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2), 6) AS t, round((mean1 - mean2) / nullif(sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)), 0), 6) AS cohens_d FROM mo", MOM)
def _(s, d):
    return rounded(S.compare(long(s, d)).select("metric", "t", "cohens_d"))


_T = "((mean1 - mean2) / sqrt(var1 / n1 + var2 / n2))"
_DF = "(power(var1 / n1 + var2 / n2, 2) / (power(var1 / n1, 2) / (n1 - 1) + power(var2 / n2, 2) / (n2 - 1)))"
_D = "((mean1 - mean2) / nullif(sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)), 0))"
BOTH = HIST + MOM[len(LONG) :] + ", me AS (SELECT metric, median(value) FILTER (year_group = '2015') AS median1, median(value) FILTER (year_group = '2025') AS median2 FROM long GROUP BY metric)"
BOTH += f", al AS (SELECT mw.metric, mw.n1, mw.n2, u, ties, 1 - 2 * u / (CAST(mw.n1 AS DOUBLE) * mw.n2) AS rank_biserial, mean1, mean2, var1, var2, median1, median2, {_mw_p('u', 'CAST(mw.n1 AS DOUBLE)', 'CAST(mw.n2 AS DOUBLE)', 'ties')} AS mw_p FROM mw JOIN mo USING (metric) JOIN me USING (metric))"


@q("ST5_tests", f"SELECT metric, n1, n2, u, ties, round(rank_biserial, 6) AS rank_biserial, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, round(var1, 6) AS var1, round(var2, 6) AS var2, median1, median2, round({_D}, 6) AS cohens_d, round(mw_p, 6) AS mw_p, round({_T}, 6) AS t, round({_student_tail(_T, _DF)}, 6) AS welch_p FROM al", BOTH)
def _(s, d):
    return rounded(S.compare(long(s, d)))


@q(
    "ST12_master_summary",
    f"SELECT metric, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2, median1, median2, round((mean2 - mean1) * 100.0 / nullif(mean1, 0), 6) AS pct_change, u, round(mw_p, 6) AS p, round(rank_biserial, 6) AS rank_biserial, round({_D}, 6) AS cohens_d, round(least(1.0, min(q) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh, least(1.0, min(q) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) < 0.05 AS significant FROM (SELECT *, mw_p * count(*) OVER () / row_number() OVER (ORDER BY mw_p, metric) AS q, row_number() OVER (ORDER BY mw_p, metric) AS rk FROM al)",
    BOTH,
)
def _(s, d):
    return rounded(S.master_summary(long(s, d)))


@q(
    "ST8_ST9_ST10_corrections",
    "SELECT year_group, p, least(p * count(*) OVER (), 1) AS bonferroni, least(min(q) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh, least(min(q) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) < 0.05 AS significant FROM (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, year_group) AS q, row_number() OVER (ORDER BY p, year_group) AS rk FROM (SELECT year_group, round(1.0 / count(*), 9) AS p FROM documents WHERE year_group IS NOT NULL GROUP BY year_group))",
)
def _(s, d):
    p = table(s, d, "documents").filter("year_group is not null").groupBy("year_group").agg(F.round(F.lit(1.0) / F.count(F.lit(1)), 9).alias("p"))
    return S.benjamini_hochberg(S.bonferroni(p))


@q("ST13_r_interval", "SELECT metric, round(1.96 * sqrt((1 - power(1 - 2 * u / (CAST(n1 AS DOUBLE) * n2), 2)) * (n1 + n2 + 1) / (3.0 * n1 * n2)), 6) AS half FROM mw", HIST)
def _(s, d):
    return rounded(S.mann_whitney(long(s, d)).select("metric", S.r_interval(F.col("rank_biserial"), F.col("n1").cast("double"), F.col("n2").cast("double")).alias("half")))


@q(
    "ST14_A10_linear_fit",
    "SELECT st.year_group, round(regr_slope(n_citations, n_words), 6) AS slope, round(regr_intercept(n_citations, n_words), 6) AS intercept, count(*) AS n FROM st JOIN (SELECT year_group, quantile_cont(n_words, 0.99) AS lim FROM st GROUP BY year_group) l ON st.year_group = l.year_group WHERE n_words <= lim GROUP BY st.year_group",
    STRUCT,
)
def _(s, d):
    return rounded(S.linear_fit(K.structure(papers(s, d)), "n_words", "n_citations"))


@q(
    "ST15_density",
    "SELECT year_group, x, round(sum(c * exp(-0.5 * power((x - v) / bw, 2))) / (max(n) * max(bw) * sqrt(2 * pi())), 6) AS density FROM (SELECT c.year_group, v, c, n, sd * power(n, -0.2) AS bw FROM c JOIN (SELECT year_group, CAST(sum(c) AS DOUBLE) AS n, sqrt((sum(c * v * v) - sum(c * v) * sum(c * v) / sum(c)) / (sum(c) - 1)) AS sd FROM c GROUP BY year_group) st ON c.year_group IS NOT DISTINCT FROM st.year_group) k, (SELECT CAST(unnest(range(0, 121)) AS DOUBLE) AS x) g WHERE bw > 0 GROUP BY year_group, x",
    SENTROWS + f", c AS (SELECT year_group, v, CAST(count(*) AS DOUBLE) AS c FROM (SELECT year_group, CAST(len({WORDS.format('sentence')}) AS DOUBLE) AS v FROM sr) WHERE v BETWEEN 0 AND 120 GROUP BY year_group, v)",
)
def _(s, d):
    return rounded(S.density(K.sentence_rows(papers(s, d)), "n_words"))


@q(
    "ST16_boxes",
    "SELECT year_group, metric, q1, q2, q3, min(value) AS low, max(value) AS high FROM long JOIN (SELECT year_group, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY year_group, metric) USING (year_group, metric) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY year_group, metric, q1, q2, q3",
    LONG,
)
def _(s, d):
    return rounded(S.boxes(long(s, d), "value", ["year_group", "metric"]))


# ------------------------------------------------------------------------------- manifest and samples

MAN = (
    r"mt AS (SELECT corpus_id, arxiv_id, year_group, file_paths, replace(replace(replace(raw_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), ' ') AS t FROM corpus_records), mc AS (SELECT *, " + CLEAN.format("t") + " AS c FROM mt), mn AS (SELECT corpus_id, arxiv_id, year_group, len(file_paths) AS n_files, length(t) AS n_chars, len(regexp_extract_all(c, '[A-Za-z][A-Za-z0-9''-]*')) AS n_words, len(regexp_extract_all(t, '<cit\\.>')) AS n_citations, CASE WHEN length(regexp_replace(c, '\\s+', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(c, '[^\\p{L}]', '', 'g')) / length(regexp_replace(c, '\\s+', '', 'g')) END AS alpha_ratio, array_to_string(file_paths, '|') AS file_paths FROM mc)"
)


def manifest(s, d):
    return SA.manifest(spread(table(s, d, "corpus_records")))


@q("X18_manifest", "SELECT corpus_id, arxiv_id, year_group, n_files, n_chars, n_words, n_citations, round(n_citations * 100.0 / nullif(n_words, 0), 6) AS cit_per_100_words, round(alpha_ratio, 6) AS alpha_ratio, file_paths FROM mn", MAN)
def _(s, d):
    return rounded(manifest(s, d))


QUAL = MAN + ", f8 AS (SELECT * FROM mn WHERE n_words >= 150 AND alpha_ratio >= 0.55), lim AS (SELECT year_group, quantile_cont(n_words, 0.99) AS lim FROM f8 GROUP BY year_group), f9 AS (SELECT f8.* FROM f8 JOIN lim ON f8.year_group IS NOT DISTINCT FROM lim.year_group WHERE n_words <= lim)"


def _kept(s, d):
    return SA.below_quantile(SA.quality_filter(manifest(s, d)))


@q("F8_F9_J7_quality", "SELECT corpus_id, year_group, n_words FROM f9", QUAL)
def _(s, d):
    return _kept(s, d).select("corpus_id", "year_group", "n_words")


@q(
    "L1_strata",
    "SELECT corpus_id, CAST(len(list_filter(edges, lambda e: e < n_words AND e > lo)) AS INTEGER) AS word_stratum FROM f9, ed",
    QUAL + ", ed AS (SELECT list_distinct(quantile_cont(n_words, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges, min(n_words) AS lo FROM f9)",
)
def _(s, d):
    return SA.strata(_kept(s, d)).select("corpus_id", "word_stratum")


STRATA = QUAL + ", ed AS (SELECT list_distinct(quantile_cont(n_words, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges, min(n_words) AS lo FROM f9), sx AS (SELECT f9.*, CAST(len(list_filter(edges, lambda e: e < n_words AND e > lo)) AS INTEGER) AS word_stratum FROM f9, ed)"


@q("L2_sample_sizes", "SELECT s.word_stratum, g.year_group, least(n15, n25) AS n FROM (SELECT word_stratum, count(*) FILTER (year_group = '2015') AS n15, count(*) FILTER (year_group = '2025') AS n25 FROM sx GROUP BY word_stratum) s, (SELECT unnest(['2015', '2025']) AS year_group) g WHERE least(n15, n25) > 0", STRATA)
def _(s, d):
    return SA.balanced_sample(SA.strata(_kept(s, d))).groupBy("word_stratum", "year_group").agg(F.count(F.lit(1)).alias("n"))


@q("A12_strata_counts", 'SELECT word_stratum, count(*) FILTER (year_group = \'2015\') AS "2015", count(*) FILTER (year_group = \'2025\') AS "2025" FROM sx GROUP BY word_stratum', STRATA)
def _(s, d):
    return SA.strata(_kept(s, d)).groupBy("word_stratum").pivot("year_group", ["2015", "2025"]).count().na.fill(0)


@query("L2_balanced_sample")
def _(s, d):
    return SA.balanced_sample(SA.strata(_kept(s, d)))


@query("L3_stratified_sample")
def _(s, d):
    return SA.stratified_sample(manifest(s, d), 50).select("corpus_id", "year_group", "rank")


@q("L3_sample_sizes", "SELECT year_group, least(count(*), 50) AS n FROM corpus_records GROUP BY year_group")
def _(s, d):
    return SA.stratified_sample(manifest(s, d), 50).groupBy("year_group").agg(F.count(F.lit(1)).alias("n"))


@q("A14_counts", "SELECT year_group, count(*) AS n FROM corpus_records GROUP BY year_group")
def _(s, d):
    return table(s, d, "corpus_records").groupBy("year_group").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- sections and extraction

_DIRECT = " OR ".join(f"contains(h, '{k}')" for k in H.DIRECT)
_FUZZY = ", ".join(f"CASE WHEN contains(regexp_replace(h, '^(?:[0-9][0-9.]*|[ivx]+\\.)\\s*', ''), '{k}') THEN {c} END" for k, c in H.RULES)
HEADS = rf"hd AS (SELECT section_id, arxiv_id, heading, content, section_order, lower(regexp_replace(coalesce(heading, ''), '^\s+|\s+$', '', 'g')) AS h FROM raw_sections), cs AS (SELECT *, ({_DIRECT}) AS direct, greatest({_FUZZY}) AS fz FROM hd), cl AS (SELECT section_id, arxiv_id, heading, content, section_order, CASE WHEN direct OR fz IS NOT NULL THEN 'related_work' ELSE 'other' END AS section_type, CASE WHEN direct THEN 1.0 ELSE coalesce(fz, 0.0) END AS confidence FROM cs)"


@q("X19_direct", "SELECT section_id, CASE WHEN direct THEN 'related_work' ELSE 'other' END AS section_type FROM cs", HEADS)
def _(s, d):
    return table(s, d, "raw_sections").select("section_id", H.from_heading(F.coalesce("heading", F.lit(""))).alias("section_type"))


@q("X20_fuzzy", "SELECT section_id, CAST(fz AS DOUBLE) AS confidence FROM cs", HEADS)
def _(s, d):
    return table(s, d, "raw_sections").select("section_id", H.fuzzy(F.coalesce("heading", F.lit(""))).cast("double").alias("confidence"))


@q("X22_classified", "SELECT section_id, section_type, CAST(confidence AS DOUBLE) AS confidence FROM cl", HEADS)
def _(s, d):
    return R.classify_sections(table(s, d, "raw_sections")).select("section_id", "section_type", "confidence")


@q(
    "A8_merge_sections",
    "SELECT arxiv_id, section_type, CAST(0 AS BIGINT) AS part_no, arg_min(coalesce(heading, chr(0)), (section_order, section_id)) AS heading, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY section_order, section_id) AS content, CAST(min(confidence) AS DOUBLE) AS confidence, 'latex_parsed' AS method, min(section_order) AS first_order, count(*) AS n_sections FROM cl GROUP BY arxiv_id, section_type",
    HEADS,
)
def _(s, d):
    m = R.merge_sections(R.classify_sections(table(s, d, "raw_sections").withColumn("heading", F.coalesce("heading", F.lit("\x00")))))
    return m


RECORDS = HEADS + (
    ", md AS (SELECT DISTINCT ON (arxiv_id) * FROM paper_metadata ORDER BY arxiv_id, ingested_at DESC, meta_id DESC), mg AS (SELECT arxiv_id, section_type, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY section_order, section_id) AS content, min(section_order) AS first_order FROM cl GROUP BY arxiv_id, section_type)"
    ", fo AS (SELECT arxiv_id, bool_or(section_type = 'related_work' AND content <> '') AS ok, string_agg(section_type, ', ' ORDER BY first_order, section_type) AS found, max(content) FILTER (section_type = 'related_work') AS rw FROM mg GROUP BY arxiv_id), rc AS (SELECT arxiv_id, count(*) AS k FROM raw_sections GROUP BY arxiv_id)"
)


@q(
    "PJ1_records",
    "SELECT md.arxiv_id, title, coalesce(array_to_string(authors, '; '), CASE WHEN authors IS NULL THEN NULL ELSE '' END) AS authors, coalesce(array_to_string(categories, ', '), CASE WHEN categories IS NULL THEN NULL ELSE '' END) AS categories, primary_category, published, updated, abstract, coalesce(rw, '') AS related_work, 'latex_parsed' AS extraction_method, coalesce(ok, false) AS extraction_success, coalesce(found, '') AS sections_found, CAST(coalesce(k, 0) AS INTEGER) AS raw_section_count, CAST(0 AS BIGINT) AS part_no FROM md LEFT JOIN fo ON md.arxiv_id = fo.arxiv_id LEFT JOIN rc ON md.arxiv_id = rc.arxiv_id",
    RECORDS,
)
def _(s, d):
    sec = table(s, d, "raw_sections")
    merged = R.merge_sections(R.classify_sections(sec))
    meta = R.latest_records(table(s, d, "paper_metadata"), F.col("arxiv_id"), F.struct("ingested_at", "meta_id"))
    return R.build_records(meta, merged, sec.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("raw_section_count")))


@q("F11_SK3_section_table", r"SELECT arxiv_id, section_order, lpad(CAST(section_order AS VARCHAR), 2, '0') || '_' || CASE WHEN f = '' THEN 'untitled' ELSE f END || '.txt' AS filename, content FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(heading, ''), '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g') AS f FROM cl WHERE section_type = 'related_work')", HEADS)
def _(s, d):
    return sinks.section_table(R.classify_sections(table(s, d, "raw_sections")), related_only=True)


# LaTeX documents made of the texts: an abstract, an introduction and a section whose heading varies
_BS = "chr(92)"
_HEADING = "CASE doc_id % 5 WHEN 0 THEN 'Related Work' WHEN 1 THEN '3. Prior Art' WHEN 2 THEN 'iv. Existing Approaches' WHEN 3 THEN 'Overview of Methods' ELSE 'Background and Related Studies' END"
LATEX = f"SELECT doc_id, concat({_BS}, 'begin{{abstract}}', substring(text, 1, 80), {_BS}, 'end{{abstract}}', chr(10), {_BS}, 'section{{Introduction}}', chr(10), substring(text, 81, 400), chr(10), {_BS}, 'section{{', {_HEADING}, '}}', chr(10), substring(text, 481)) AS text FROM documents WHERE text IS NOT NULL"


def latex(s, d):
    table(s, d, "documents").createOrReplaceTempView("_documents")
    return s.sql(LATEX.replace("FROM documents", "FROM _documents"))


@q(
    "P5_sections",
    r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS section_order, heading, content FROM (SELECT doc_id, 0 AS k, 'Abstract' AS heading, regexp_replace(substring(text, 1, 80), '^\s+|\s+$', '', 'g') AS content FROM documents UNION ALL SELECT doc_id, 1, 'Introduction', regexp_replace(substring(text, 81, 400), '^\s+|\s+$', '', 'g') FROM documents UNION ALL SELECT doc_id, 2, " + _HEADING + r", regexp_replace(substring(text, 481), '^\s+|\s+$', '', 'g') FROM documents) WHERE content <> ''",
)
def _(s, d):
    return P.sections(latex(s, d), "doc_id").withColumnRenamed("order", "section_order")


@query("P7_clean_latex")
def _(s, d):
    return spread(table(s, d, "raw_sections")).select("section_id", M.clean_latex("content").alias("content"))


def _chain_sql(text: str) -> str:
    """The steps of the chain for an engine without Unicode classes in \\s and without back references."""
    ws = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
    env = lambda names, star: rf"(?s)\\begin\{{(?:{names}){star}\}}.*?\\end\{{(?:{names}){star}\}}"
    steps = [
        (env("figure|table", r"\*?"), ""), (env("tabular|tabularx|longtable", ""), ""), (env("equation|align|gather|multline|eqnarray|math|displaymath", r"\*?"), ""),
        (r"(?s)\\\[.*?\\\]", ""), (r"(?s)\$\$.*?\$\$", ""), (r"(?s)\\\(.*?\\\)", ""), (r"\$[^$]+\$", ""),
        (r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\}", ""), (r"\\(?:ref|label|eqref|autoref|pageref|nameref)\{[^}]*\}", ""), (r"\\caption\*?(?:\[[^\]]*\])?\{[^}]*\}", ""),
        (r"\\footnote\{([^}]*)\}", r"\1"), (r"\\href\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\\url\{[^}]*\}", ""), (r"\\(?:textbf|textit|emph|textsc|textrm|texttt|textsf|textsl|underline|mbox)\{([^}]*)\}", r"\1"),
        (r"\\begin\{[^}]*\}", ""), (r"\\end\{[^}]*\}", ""), (rf"\\item{ws}*(?:\[[^\]]*\])?", ""), (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])*(?:\{[^}]*\})*", ""),
        (r"\\([%&#_$])", r"\1"), ("~", " "), ("---", "\u2014"), ("--", "\u2013"), (r"[{}]", ""), (r"\\", ""),
        (rf"(^|[^\p{{L}}\p{{N}}_])et{ws}+al($|[^\p{{L}}\p{{N}}_])", "\\1\x01\\2"), ("\x01\\.?", ""),
        (r"\[WS*[\d,;WS_]+WS*\]".replace("WS_", ws[1:-1]).replace("WS", ws), ""), (rf"\({ws}*\d{{4}}{ws}*\)", ""),
        (r"\n{3,}", "\n\n"), (r"[ \t]+", " "), (rf"{ws}+([.,;:!?])", r"\1"), (rf"\.(?:{ws}*\.)+", "."), (rf",(?:{ws}*,)+", ","), (rf";(?:{ws}*;)+", ";"), (rf"^{ws}+|{ws}+$", ""),
    ]
    for rx, to in steps:
        text = f"regexp_replace({text}, '{rx}', '{to}', 'g')"
    return text


@q("C2_C21_clean_chain", f"SELECT section_id, {_chain_sql('content')} AS content FROM raw_sections")
def _(s, d):
    return spread(table(s, d, "raw_sections")).select("section_id", M.clean_chain("content").alias("content"))


@q("P4_comments", r"SELECT section_id, regexp_replace(regexp_replace(replace(content, '\%', chr(1)), '(?m)%[^\n]*$', '', 'g'), chr(1), '\\%', 'g') AS t FROM raw_sections")
def _(s, d):
    return table(s, d, "raw_sections").select("section_id", M.strip_comments("content").alias("t"))


@q("PJ5_filenames", r"SELECT section_id, CASE WHEN f = '' THEN 'untitled' ELSE f END AS f FROM (SELECT section_id, regexp_replace(regexp_replace(regexp_replace(coalesce(heading, ''), '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '_', 'g') AS f FROM raw_sections)")
def _(s, d):
    return table(s, d, "raw_sections").select("section_id", H.safe_filename(F.coalesce("heading", F.lit(""))).alias("f"))


_HALF = "CAST(floor(length(text) / 2) AS BIGINT)"
_BODY = "'\\documentclass{article}' || chr(10) || '\\section{One}' || chr(10) || substring(text, 1, h) || chr(10) || '\\section{Two}' || chr(10) || substring(text, h + 1) || chr(10)"


@q("P1_P3_assemble", rf"SELECT CAST(doc_id AS VARCHAR) AS arxiv_id, regexp_replace(regexp_replace(replace({_BODY}, '\%', chr(1)), '(?m)%[^\n]*$', '', 'g'), chr(1), '\\%', 'g') AS text FROM (SELECT doc_id, text, {_HALF} AS h FROM documents WHERE text IS NOT NULL)")
def _(s, d):
    # three files a paper: a root that includes the two halves of the text
    t = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("arxiv_id"), "text")
    half = (F.length("text") / 2).cast("int")
    f = F.array(
        F.struct(F.lit("main.tex").alias("path"), F.lit("\\documentclass{article}\n\\section{One}\n\\input{parts/a}\n\\section{Two}\n\\include{parts/b.tex}\n").alias("text")),
        F.struct(F.lit("parts/a.tex").alias("path"), F.substring(F.col("text"), F.lit(1), half).alias("text")),
        F.struct(F.lit("parts/b.tex").alias("path"), F.substring(F.col("text"), half + 1, F.length("text")).alias("text")),
    )
    files_ = t.select("arxiv_id", F.explode(f).alias("f")).select("arxiv_id", "f.path", "f.text")
    return P.assemble(files_)


# ---------------------------------------------------------------------------------- scoring, optional


def _scores(s, d, mix=SC.MIX, **kw):
    p = durable(papers(s, d).select(*K.KEYS, "text_clean"))  # counted and scored
    return SC.score(p, lambda m=SC.train_ngrams(p, mix=mix): m, K.KEYS, **kw)


# the same bigram model in SQL: the 50,000 commonest words and pairs of all papers
NGRAM = SENTROWS + (
    ", tk AS (SELECT arxiv_id, year_group, part_no, string_split(lower(text_clean), ' ') AS w FROM papers), ti AS (SELECT arxiv_id, year_group, part_no, unnest(w) AS b, generate_subscripts(w, 1) AS i FROM tk), tg AS (SELECT *, lag(b) OVER (PARTITION BY arxiv_id, year_group, part_no ORDER BY i) AS a FROM ti)"
    ", un AS (SELECT b AS a, count(*) AS n FROM ti GROUP BY b ORDER BY n DESC, a LIMIT 50000), b0 AS (SELECT a, b, count(*) AS n FROM tg WHERE a IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 50000), bg AS (SELECT b0.* FROM b0 JOIN un x ON b0.a = x.a JOIN un y ON b0.b = y.a), vo AS (SELECT CAST(sum(n) AS DOUBLE) AS total, count(*) + 1 AS v FROM un)"
)


def _nll(rows: str, mix: float) -> str:
    return f"SELECT r.*, -ln({mix} * coalesce(bg.n / CAST(ua.n AS DOUBLE), 0.0) + {1 - mix} * (coalesce(ub.n, 0) + 1) / (vo.total + vo.v)) AS nll FROM {rows} r CROSS JOIN vo LEFT JOIN un ua ON r.a = ua.a LEFT JOIN un ub ON r.b = ub.a LEFT JOIN bg ON r.a = bg.a AND r.b = bg.b WHERE r.a IS NOT NULL"


DOC = NGRAM + f", dn AS ({_nll('tg', 0.7)}), ds AS (SELECT arxiv_id, year_group, part_no, sum(nll) / count(*) AS lp, count(*) AS n, sum(nll) FILTER (i <= 1024) AS head, sum(nll) FILTER (i > 1024) AS tail FROM dn GROUP BY ALL)"
SENT_SCORES = DOC + (
    ", sw AS (SELECT arxiv_id, year_group, part_no, pos, list_filter(string_split(regexp_replace(lower(sentence), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM sr), st2 AS (SELECT arxiv_id, year_group, part_no, pos, unnest(w) AS b, generate_subscripts(w, 1) AS i FROM sw WHERE len(w) >= 5), sg AS (SELECT *, lag(b) OVER (PARTITION BY arxiv_id, year_group, part_no, pos ORDER BY i) AS a FROM st2 WHERE i <= 1024)"
    f", sn AS ({_nll('sg', 0.7)}), ss2 AS (SELECT arxiv_id, year_group, part_no, pos, avg(nll) AS m FROM sn GROUP BY ALL), sb AS (SELECT arxiv_id, year_group, part_no, stddev_samp(m) AS std, stddev_samp(m) / nullif(avg(m), 0) AS cv, count(*) AS k FROM ss2 GROUP BY ALL)"
)
_ROWS = "arxiv_id, year_group, part_no"


@q(
    "M4_M6_A15_scores",
    f"SELECT {_ROWS}, round(lp, 6) AS log_perplexity, round(exp(round(lp, 6)), 3) AS perplexity, round(std, 6) AS burstiness_std, round(cv, 6) AS burstiness_cv, CAST(coalesce(k, 0) AS INTEGER) AS n_sentences_scored, CAST(n AS INTEGER) AS n_tokens_scored FROM ds LEFT JOIN sb USING ({_ROWS})",
    SENT_SCORES,
)
def _(s, d):
    return rounded(_scores(s, d)).withColumn("perplexity", F.round(F.exp("log_perplexity"), 3))


@q(
    "M5_per_sequence",
    f"SELECT {_ROWS}, round(lp5, 6) AS log_perplexity, round(exp(round(lp5, 6)), 3) AS perplexity, CAST(NULL AS DOUBLE) AS burstiness_std, CAST(NULL AS DOUBLE) AS burstiness_cv, CAST(0 AS INTEGER) AS n_sentences_scored, CAST(n + 1 AS INTEGER) AS n_tokens_scored FROM (SELECT *, CASE WHEN n + 1 <= 1024 THEN head / n ELSE (head / 1023.0 * 1024 + tail) / (n + 1) END AS lp5 FROM ds)",
    DOC,
)
def _(s, d):
    return rounded(_scores(s, d, doc_only=True, per_sequence=True)).withColumn("perplexity", F.round(F.exp("log_perplexity"), 3))


@q(
    "M8_ratio",
    f"SELECT {_ROWS}, round(x.lp, 6) AS base_log_ppl, round(y.lp, 6) AS instruct_log_ppl, round(x.lp / nullif(y.lp, 0), 6) AS binoculars_score FROM ds x JOIN (SELECT {_ROWS}, sum(nll) / count(*) AS lp FROM ({_nll('tg', 0.3)}) GROUP BY ALL) y USING ({_ROWS})",
    DOC,
)
def _(s, d):
    # two models of the same counts that lean on pairs and on single words
    p = durable(papers(s, d).select(*K.KEYS, "text_clean"))
    a, b = SC.train_ngrams(p), SC.train_ngrams(p, mix=0.3)
    return rounded(SC.ratio(SC.score(p, lambda: a, K.KEYS, doc_only=True), SC.score(p, lambda: b, K.KEYS, doc_only=True), K.KEYS))


@q("A11_group_means", "SELECT year_group, round(avg(lp), 4) AS log_perplexity, round(avg(std), 4) AS burstiness_std, round(avg(cv), 4) AS burstiness_cv FROM (SELECT ds.*, std, cv FROM ds LEFT JOIN sb USING (arxiv_id, year_group, part_no)) GROUP BY year_group", SENT_SCORES)
def _(s, d):
    return rounded(_scores(s, d).groupBy("year_group").agg(*[F.avg(c).alias(c) for c in ("log_perplexity", "burstiness_std", "burstiness_cv")]), 4)


@q("M2_windows", "SELECT doc_id, len(list_filter(range(0, greatest(n, 1), 512), lambda b: b = 0 OR b + 512 < n)) AS n_windows FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents)")
def _(s, d):
    # a window starts every 512 tokens until one of 1024 reaches the end
    n = T.whitespace_words("text")
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1, F.lit(512))
    return table(s, d, "documents").select("doc_id", F.size(F.filter(starts, lambda b: (b == 0) | (b + 512 < n))).cast("bigint").alias("n_windows"))


@q("J1_J2_left_metrics", "SELECT meta_id, m.arxiv_id, latest.status, latest.n_events FROM m LEFT JOIN latest ON m.arxiv_id = latest.arxiv_id", f"{LATEST}, {META}")
def _(s, d):
    return R.left_metrics(_meta(s, d), R.latest_status(table(s, d, "progress_log")), ["arxiv_id"])


@q("A16_coverage", "SELECT count(*) AS n, count(n_events) AS covered FROM (SELECT meta_id, n_events FROM m LEFT JOIN latest USING (arxiv_id))", f"{LATEST}, {META}")
def _(s, d):
    j = R.left_metrics(_meta(s, d), R.latest_status(table(s, d, "progress_log")), ["arxiv_id"])
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("n_events").alias("covered"))


@q(
    "F3_published_window",
    "SELECT meta_id FROM (SELECT meta_id, CASE WHEN regexp_full_match(substring(published, 1, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(substring(published, 1, 10) AS DATE) + INTERVAL '630 minutes' END AS ts FROM paper_metadata) WHERE ts BETWEEN TIMESTAMP '2015-01-01' AND TIMESTAMP '2015-12-31'",
)
def _(s, d):
    # the first version's time in the form of the snapshot, at half past ten of the day
    day = F.to_date(F.when(F.substring("published", 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring("published", 1, 10)))
    created = F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.lit(" 10:30:00 GMT"))
    m = table(s, d, "paper_metadata").select("meta_id", F.array(F.struct(F.lit("v1").alias("version"), created.alias("created"))).alias("versions"))
    return R.published_window(m, "2015-01-01", "2015-12-31").select("meta_id")


@q(
    "PJ3_author_parts",
    "SELECT meta_id, list_filter(list_transform(list_filter(authors, lambda a: a IS NOT NULL AND contains(a, ' ')), lambda a: trim(trim(substring(a, strpos(a, ' ') + 1)) || ' ' || trim(substring(a, 1, strpos(a, ' ') - 1)))), lambda x: x <> '') AS names FROM paper_metadata",
)
def _(s, d):
    # every author as the parts before and after the first blank, taken for family and given name
    parts = F.transform("authors", lambda a: F.when(a.isNull(), F.array().cast("array<string>")).otherwise(F.split(a, " ", 2)))
    return table(s, d, "paper_metadata").select("meta_id", R.parse_author_parts(parts).alias("names"))


@q(
    "P6_numbered_sections",
    r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS section_order, heading, content FROM (SELECT doc_id, 1 AS k, 'Introduction' AS heading, regexp_replace(substring(t, 1, 300), '^\s+|\s+$', '', 'g') AS content FROM x UNION ALL SELECT doc_id, 2, 'Prior Art', regexp_replace(substring(t, 301), '^\s+|\s+$', '', 'g') FROM x) WHERE content <> ''",
    "x AS (SELECT doc_id, translate(text, '0123456789IVX\\', '##############') AS t FROM documents WHERE text IS NOT NULL)",
)
def _(s, d):
    # no section commands, but numbered lines; digits of the texts themselves are masked
    t = F.translate("text", "0123456789IVX\\", "##############")
    doc = F.concat(F.lit("1. Introduction\n"), F.substring(t, 1, 300), F.lit("\nII Prior Art\n"), F.substring(t, F.lit(301), F.length(t)))
    return P.sections(table(s, d, "documents").filter("text is not null").select("doc_id", doc.alias("text")), "doc_id").withColumnRenamed("order", "section_order")


@q("F1_L5_first_papers", "SELECT meta_id, arxiv_id FROM (SELECT meta_id, arxiv_id FROM paper_metadata WHERE len(list_filter(categories, lambda c: starts_with(c, 'cs.'))) > 0 ORDER BY arxiv_id, meta_id LIMIT 100)")
def _(s, d):
    return table(s, d, "paper_metadata").filter(R.in_category(F.col("categories"))).select("meta_id", "arxiv_id").orderBy("arxiv_id", "meta_id").limit(100)


@q("J9_SC13_manifest_texts", "SELECT c.corpus_id, p.arxiv_id, p.year_group, p.part_no, p.n_ws_words FROM (SELECT corpus_id, " + ID.format("arxiv_id") + " AS arxiv_id, year_group FROM corpus_records) c JOIN papers p ON c.arxiv_id = p.arxiv_id AND c.year_group = p.year_group", PAPERS)
def _(s, d):
    m = table(s, d, "corpus_records").select("corpus_id", K.canonical_id("arxiv_id").alias("arxiv_id"), "year_group")
    return R.manifest_texts(m, papers(s, d)).select("corpus_id", *K.KEYS, "n_ws_words")


@q("F12_missing_scores", "SELECT arxiv_id, year_group FROM (SELECT DISTINCT arxiv_id, year_group FROM corpus_records) c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.arxiv_id = c.arxiv_id AND d.year_group = c.year_group)")
def _(s, d):
    return R.missing_scores(table(s, d, "corpus_records").select("arxiv_id", "year_group").distinct(), table(s, d, "documents"), ["arxiv_id", "year_group"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_ = Column
