"""Hand-computed cases of the text features."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import citations as C
from scriptorium.functions import headings as H
from scriptorium.functions import markup as M
from scriptorium.functions import text as T
from scriptorium.operators import corpus as K
from scriptorium.plans import analytics as A

TEXT = "The method was recently proposed by Smith <cit.>. It is simple <cit.>, <cit.>."


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("r")).first().r


def test_micro_case(spark):
    d = spark.createDataFrame([(1, "a", "2015", "00.txt", TEXT)], "doc_id long, arxiv_id string, year_group string, filename string, text string")
    p = K.papers(K.corpus_files(d), min_words=5)
    assert p.first().text_clean == "The method was recently proposed by Smith CITATION . It is simple CITATION , CITATION ."
    r = K.readability(p).first()
    assert (r.n_sentences, r.n_words, r.n_syllables, r.n_complex) == (2, 10, 16, 2)
    assert r.flesch == pytest.approx(66.4) and r.fog == pytest.approx(10.0)
    s = K.structure(p).first()
    assert (s.n_citations, s.n_paragraphs, s.cit_per_sentence, s.cit_per_100_words) == (3, 1, 1.5, 30.0)
    f = A.features(p).first()
    assert f.passive_ratio == 0.5 and f.ttr == f.mattr == f.hapax_ratio == 1.0
    assert f.mean_sentence_length == 5.0 and f.median_sentence_length == 5.0
    assert {x.pattern: x.n for x in A.citation_patterns(p).collect()} == {"author_named": 1, "parenthetical": 1, "list_style": 1}


@pytest.mark.parametrize("context,kind", [("ByteNet ", "author_named"), ("GPU ", "parenthetical"), ("first proposed by ", "verb_led"), ("CITATION, ", "list_style"), ("Smith et al. ", "author_named"), ("", "parenthetical")])
def test_citation_patterns(spark, context, kind):
    assert one(spark, context, C.pattern(F.col("x"))) == kind


def test_mattr_is_the_mean_over_windows(spark):
    words = "aa bb aa cc dd aa aa bb cc".split()
    for w in (3, 5, 9, 20):
        spans = [words[i : i + w] for i in range(max(1, len(words) - w + 1))]
        want = sum(len(set(x)) / len(x) for x in spans) / len(spans)
        p = spark.createDataFrame([("p", "2015", 0, " ".join(words))], "arxiv_id string, year_group string, part_no long, text_clean string")
        assert K.mattr(p, w).first().mattr == pytest.approx(want)


def test_long_paper_comes_in_parts(spark):
    d = spark.createDataFrame([(i * 5000, "v", "2015", f"{i:02d}.txt", "x" * 100) for i in range(20)], "doc_id long, arxiv_id string, year_group string, filename string, raw_text string")
    parts = K.concat_papers(d, part_chars=500).orderBy("part_no").collect()
    assert len(parts) > 1 and sum(r.n_files for r in parts) == 20
    assert "\n\n".join(r.text for r in parts) == "\n\n".join(["x" * 100] * 20)


def test_parts_count_as_one_paper(spark):
    """Cohort features of a paper in parts are those of the paper in one piece."""
    texts = ["The old method was shown <cit.>. It failed and failed again.", "Moreover the new one is notably good <cit.>, <cit.>.", "Moreover it works. The old method is not good."]
    d = spark.createDataFrame([(k * 5000, "v", "2015", f"{k}.txt", t) for k, t in enumerate(texts)] + [(99, "w", None, "0.txt", texts[0])], "doc_id long, arxiv_id string, year_group string, filename string, raw_text string")

    def papers(size):
        p = K.concat_papers(d, part_chars=size)
        return p.withColumn("text_clean", T.clean_text("text")).withColumn("n_ws_words", T.whitespace_words("text_clean"))

    one, many = papers(10**6), papers(40)
    assert one.count() == 2 and many.count() > 3
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    for f in (K.structure, K.readability, K.lexical, K.sentence_features, A.marker_table, A.marker_score, A.citation_patterns):
        assert rows(f(one)) == rows(f(many)), f.__name__
    assert rows(A.features(one).drop("mattr")) == rows(A.features(many).drop("mattr"))


def test_quantiles_from_histograms(spark):
    import random

    rnd = random.Random(4)
    rows = [(g, rnd.choice([-3.5, 0.0, 1e-9, rnd.random(), rnd.randint(0, 5) * 1.0, 1e12])) for g in ("a", None, "b") for _ in range(rnd.randint(1, 80))] + [("n", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: [r[f"q{i}"] for i in range(len(qs))] for r in K.quantiles(d, "v", ["g"], qs).collect()}
    for g in ("a", None, "b"):
        x = sorted(v for h, v in rows if h == g)
        want = [x[int(q * (len(x) - 1))] + (q * (len(x) - 1) % 1) * (x[min(len(x) - 1, int(q * (len(x) - 1)) + 1)] - x[int(q * (len(x) - 1))]) for q in qs]
        assert got[g] == pytest.approx(want)
    assert set(got) == {"a", None, "b"} and K.quantiles(d.limit(0), "v", ["g"], [0.5]).count() == 0


def test_markers_are_counted_in_one_pass(spark):
    from scriptorium.functions import markers as MK

    text = "We Delve  into it; delves into. It is worth noting, notably, that cutting-edge and cutting edge work sheds light on a growing body of work. Noteworthy. unnotably"
    d = spark.createDataFrame([("a", "2015", text, 20)], "arxiv_id string, year_group string, text_clean string, n_words int")
    import re

    got = {r.marker: r.cnt for r in MK.marker_rows(d, ["arxiv_id"]).collect()}
    assert got == {m: len(re.findall(rx, text, re.I)) for m, _, rx in MK.MARKERS} and got["delve(s) into"] == 2 and got["cutting-edge"] == 2
    assert {t for _, t, _ in MK.MARKERS} == {"high-confidence", "elevated-frequency"} and len(MK.MARKERS) == 24


@pytest.mark.parametrize(
    "heading,kind",
    [("Related Work", "related_work"), ("RELATED WORKS", "related_work"), ("Literature Review", "related_work"), ("Prior Work", "related_work"), ("Introduction", "other"), ("", "other"), ("  state of the art ", "related_work")],
)
def test_direct_headings(spark, heading, kind):
    assert one(spark, heading, H.from_heading("x")) == kind


@pytest.mark.parametrize(
    "heading,conf",
    [("3. Related Work", 1.0), ("iv. Prior Art", 0.8), ("3.1 Existing Approaches", 0.8), ("Overview of Methods", None), ("Visual Features", None), ("Background and Related Methods", 0.85), ("Related Studies", 0.85), ("Conclusion", None), ("", None)],
)
def test_rules(spark, heading, conf):
    assert one(spark, heading, H.fuzzy("x")) == conf


def test_cascade_and_replies(spark):
    r = one(spark, "Prior Art", H.classify("x"))
    assert (r.section_type, r.confidence) == ("related_work", 0.8)
    assert one(spark, "Xyz", H.classify("x")).section_type == "other"
    assert one(spark, "not json", H.parse_reply("x")).confidence == 0.1
    assert one(spark, '{"section_type":"related_work","confidence":0.7}', H.parse_reply("x")).section_type == "related_work"
    assert one(spark, '{"section_type":"method"}', H.parse_reply("x")).section_type == "other"
    assert one(spark, None, H.parse_reply("x")) is None


@pytest.mark.parametrize("h,name", [("Related Work", "Related_Work"), ("A/B: test?", "AB_test"), ("", "untitled"), ("Über uns", "Über_uns"), ("!!!", "untitled"), ("a   b", "a_b"), ("x-y_z", "x-y_z")])
def test_filenames(spark, h, name):
    assert one(spark, h, H.safe_filename("x")) == name


def test_cleaning_chain(spark):
    src = "See \\cite{a} in Fig.~\\ref{f} and $x^2$ with \\textbf{bold} text , 5\\% of \\emph{it} et al. (2023) [1, 2]..\n\n\n\n\\begin{figure}gone\\end{figure}End~here --- so."
    out = one(spark, src, M.clean_chain("x"))
    assert "bold" in out and "5% of it" in out and "gone" not in out and "et al" not in out and "2023" not in out and "\\" not in out and "—" in out
    # fixed cases of single steps
    for src, want in (
        ("\\textsl{kept} \\text{gone}", "kept"), ("a \\frac{a}{b} c", "a c"), ("\\setlength{\\parskip}{2pt}x", "x"), ("see [1; 2] and (1850) and [ 3,4 ]", "see and and"), ("\\begin{center}[x] y\\end{center}", "[x] y"),
        ("\\item [a] b", "b"), ("\\caption*{c}d", "d"), ("a\u00a0, b", "a, b"), ("a . . b,,c", "a. b,c"), ("et al", ""), ("\\citep*[see][p. 2]{a,b} ok", "ok"),
    ):
        assert one(spark, src, M.clean_chain("x")) == want, src
    assert M.render_one("Caf\\'e \\cite{x} \\\"{o} \\ref{y} \\ss") == "Café <cit.> ö <ref> ß"
    assert one(spark, None, M.clean_chain("x")) is None and one(spark, "", M.clean_chain("x")) == ""
    assert one(spark, "a % c\n50\\% b%x", M.strip_comments("x")) == "a \n50\\% b"


def test_null_and_empty(spark):
    assert one(spark, None, T.clean_text("x")) is None
    assert one(spark, "", T.citation_count("x")) == 0 and one(spark, "", T.paragraph_count("x")) == 1
    assert one(spark, "", T.alpha_ratio("x")) == 0.0
