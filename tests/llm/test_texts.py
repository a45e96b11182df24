"""Problems 1, 4, 5, 6, 8 and 10."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import p1_markup, p1_shared, p4_quality, p5_garbled, p6_level, p8_leak, p10_pii
from scriptorium.llm import textbytes as tb

WORDS = [("en", w, i) for i, w in enumerate("the of and in to a that is are for with on it was as by".split(), 1)] + [("de", w, i) for i, w in enumerate("der die das und zu den".split(), 1)]


def common(spark):
    return spark.createDataFrame(WORDS, "lang string, word string, rank_no int")


# ------------------------------------------------------------------------------------- primitives


def test_words_and_hashes():
    texts = ["Straße, ÉCOLE и ДОМ!", "", None, "a“b”c 12 x1"]
    data, off = tb.as_utf8(pa.array(texts))
    low = tb.lower(data)
    s, e, r = tb.spans(tb.word_mask(data), off)
    assert [bytes(low[a:b]).decode() for a, b in zip(s, e)] == ["straße", "école", "и", "дом", "a", "b", "c", "x"]
    assert r.tolist() == [0] * 4 + [3] * 4
    assert [int(h) for h in tb.hashes(low, s, e)] == [tb.hash_word(bytes(low[a:b])) for a, b in zip(s, e)]
    a = pa.array(["x" * 10, "y" * 3, "z"] * 50)
    rows = [k for i, j, d, o in tb.chunks(a, 40) for k in range(i, j)]
    assert rows == list(range(150))
    assert tb.chunks(pa.array([], pa.string())) is not None and list(tb.chunks(pa.array([None, None], pa.string())))[0][1] == 2


# ----------------------------------------------------------------------------------------- markup


@pytest.mark.parametrize(
    "text",
    ["a <b>c</b>", "x &amp; y", "\\textbf{a}", "is $x_i$ b", "M\\\"obi", "``q''", "[[a|b]]", "'''a'''", "{{t}}", "== H ==", "## H", "**b**", "`c`", "[a](http://x.y)", "![a](b.png)", "> q", "* [[x]]", "|---|---|", "a\n===", "[^1]: see", "~~s~~", "_em_ x", "__b__", "<!-- c -->", "5\\% b", "<br/>", "% todo", "&#8212;", "[http://a.b c]", "\\(a\\)", "__TOC__", "[a b][4]"],
)
def test_markup_is_found(text):
    assert p1_markup.has_piece(text) and p1_markup.marked(pa.array([text])) == [True], text


@pytest.mark.parametrize(
    "text",
    ["see <cit.>, <ref>", "< g r a p h i c s >", "a < b and c > d", "p < 0.05, n > 3", "cost $4 and $9 (each)", "$9 in {B} or $4", "as in [7] and [12][13]", "Q&A and R&D", "C++ and C# rank #1", "5 * 3 * 2", "(*) and (*)", "max_seq_len", "{B, I, O}", "3 ~ 4", "- a\n- b", "1. a\n2. b", "(a) x", "100% (i.e. 1/1)", "x_34[92]", "[14:55:01] INFO lr=1e-5", "'in'/'out'", "", "snake_case and other_name here"],
)
def test_plain_text_is_left(text):
    assert not p1_markup.has_piece(text), text
    assert p1_markup.clean(text) == (text, 0)


def test_markup_structure():
    src = "<h2>Head</h2>\n<p>One &amp; <b>two</b>.</p><ul><li>a<li>b</ul>\n<pre><code>x = 1\ny = 2</code></pre>\n\\begin{equation}\nE = m\n\\end{equation}\n| A | B |\n|---|---|\n| 1 | 2 |\nsee \\cite{k} <cit.>"
    out, n = p1_markup.clean(src)
    assert n > 8 and "# Head" in out and "One & two." in out and "- a\n- b" in out and "    x = 1" in out and "$E = m$" in out and "1\t2" in out and "<cit.>" in out
    assert "<h2>" not in out and "\\begin" not in out and "&amp;" not in out
    assert p1_markup.clean("&lt;p class=x&gt;Hi&lt;/p&gt;")[0] == "Hi"
    big = "**x** " * 20_000
    assert p1_markup.clean(big)[1] >= 20_000


def test_markup_operator(spark):
    rows = [(1, "a **b**"), (2, "plain"), (3, None), (4, ""), (5, "a **b**")]
    d = spark.createDataFrame(rows, "id long, t string").withColumn("field", F.lit("clash")).withColumn("_text", F.lit("clash"))
    got = {r.row_id: r for r in p1_markup.cleaned([(d, "f.t", "id", "t")]).collect()}
    assert got[1].clean == got[5].clean == "a b" and got[2].clean == "plain" and got[3].clean is None and got[4].clean == ""
    assert sorted(r.row_id for r in p1_markup.pieces([(d, "f.t", "id", "t")]).collect()) == [1, 5]
    assert p1_markup.cleaned([(d.limit(0), "f.t", "id", "t")]).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a B1<>/\\$~`{}[]()|!_'=*#%&;:.-^\n\tö", max_size=40))
def test_no_piece_without_a_mark(text):
    """The first pass never hides a text from the lexer."""
    assert p1_markup.marked(pa.array([text, None]))[0] or not p1_markup.has_piece(text)
    once, _ = p1_markup.clean(text)
    assert isinstance(once, str)


def test_markup_has_no_size_limit():
    word = "alpha " * 3000
    for t in ("{{" + word + "}}", "`" + word + "x`", "a *" + word + "x* b", "~~" + word + "x~~", "$x_" + word + "y$"):
        assert p1_markup.has_piece(t), t[:10]
    deep = "x"
    for _ in range(12):
        deep = "{{a|" + deep + "}}"
    assert p1_markup.clean("b " + deep + " c")[0].split() == ["b", "c"]
    assert p1_markup.clean("&amp;" + "amp;" * 9 + "lt;b&gt;")[0] == ""


def covered(pages, width):
    """Brute force: tokens in a window of width tokens that an earlier page has."""
    seen, out = {}, []
    for k, p in enumerate(pages):
        for i in range(len(p) - width + 1):
            seen.setdefault(tuple(p[i : i + width]), k)
    for k, p in enumerate(pages):
        m = [False] * len(p)
        for i in range(len(p) - width + 1):
            if seen[tuple(p[i : i + width])] < k:
                m[i : i + width] = [True] * width
        out.append(m)
    return out


def test_shared_runs_both_ways(spark):
    import random

    rnd = random.Random(5)
    foot = [f"foot{i}" for i in range(9)]
    pages = []
    for k in range(14):
        p = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 40))]
        i = rnd.randint(0, len(p))
        pages.append(p[:i] + (foot if k % 3 else []) + p[i:])
    pages += [pages[3], []]
    width = 6
    want = covered(pages, width)
    ids = {}
    flat = [x for k, p in enumerate(pages) for x in [*[ids.setdefault(w, len(ids)) for w in p], -1 - k]]
    mask = p1_shared.shared_mask(np.array(flat), np.array([k for k, p in enumerate(pages) for _ in range(len(p) + 1)]), width)
    assert mask.tolist() == [x for m in want for x in [*m, False]]
    rows = [(k, "h", " ".join(p)) for k, p in enumerate(pages)] + [(90, "other", " ".join(foot)), (91, None, None), (92, None, "")]
    d = spark.createDataFrame(rows, "page_id long, h string, t string").withColumn("host", F.lit("clash"))
    for limit in (10**9, 10):  # one task; windows by hash
        got = {r.page_id: r for r in p1_shared.shared_runs(d, "h", ["page_id"], "t", width, limit).collect()}
        assert [got[k].shared_tokens for k in range(len(pages))] == [sum(m) for m in want]
        assert [got[k].unique_text.split() for k in range(len(pages))] == [[w for w, x in zip(p, m) if not x] for p, m in zip(pages, want)]
        assert got[90].shared_tokens == 0 and got[91].unique_text is None and got[92].unique_text == ""
    assert p1_shared.shared_runs(d.limit(0), "h", ["page_id"], "t").count() == 0


def test_shared_runs_split_at_all_blanks(spark):
    foot = [f"foot{i}" for i in range(7)]
    gaps = ["\u00a0", " ", "\u0085", "\u2003", "\n", "\x1c", "\u3000"]
    join = lambda ws, k: "".join(w + gaps[(i + k) % len(gaps)] for i, w in enumerate(ws))
    pages = [[f"p{k}w{i}" for i in range(5 + k)] + foot + [f"p{k}end{i}" for i in range(6)] for k in range(8)]
    width = 6
    want = covered(pages, width)
    d = spark.createDataFrame([(k, "h", join(p, k)) for k, p in enumerate(pages)], "page_id long, h string, t string")
    for limit in (10**9, 10):
        got = {r.page_id: r for r in p1_shared.shared_runs(d, "h", ["page_id"], "t", width, limit).collect()}
        assert [got[k].n_tokens for k in range(len(pages))] == [len(p) for p in pages]
        assert [got[k].shared_tokens for k in range(len(pages))] == [sum(m) for m in want]
        assert [got[k].unique_text.split() for k in range(len(pages))] == [[w for w, x in zip(p, m) if not x] for p, m in zip(pages, want)]


# ------------------------------------------------------------------------------ quality and level

EASY = "We took the old box home and put it on the desk. It was not hard to lift, but the lid was stuck. My friend had a good plan, so we went on. "
HARD = "The statistical calibration of hierarchical encoders requires considerable regularization, although contemporary evaluations underestimate the reproducibility of probabilistic interpretations in multilingual collections. "


def test_quality(spark):
    texts = [EASY * 3, HARD, "Frühere Arbeiten verwendeten Verfahren, die für den Zweck nicht ausreichten und das Problem offen ließen.", "alpha; beta systems; gamma rays; delta functions; epsilon nets; query plans; state machines", "Model P R\nNetA 61.2 71.3\nNetB 44.1 52.9\nNetC 33.3 80.1", "n/a\nn/a\nn/a\nn/a\nn/a", "", None, "  \n "]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("row_id", F.lit("clash"))
    r = {x.row_id: x for x in p4_quality.quality([(d, "f", "id", "t")], common(spark)).collect()}
    assert [r[k].is_prose for k in range(9)] == [True, True, True, False, False, False, None, None, None]
    assert r[0].n_words == len(EASY.replace(",", "").split()) * 3 and r[6].n_words == 0 and r[6].mean_word_length is None
    assert r[0].stop_line_share == 1.0 and r[5].repeated_line_share == 1.0
    assert p4_quality.quality([(d.limit(0), "f", "id", "t")], common(spark)).count() == 0


def test_texts_of_markup_alone(spark):
    pipes = "".join(f"| Net{x} | 6{i}.7 | 4{i}.8 |\n" for i, x in enumerate("ABCDEFG"))
    code = "for s in sents:\n    total += len(s)\nprint(x_42[68])  # {}\nwhile queue:\n    node = queue.pop()\n"
    texts = [pipes, "Scores\n" + pipes, f"```\n{code}```", f"\\begin{{lstlisting}}\n{code}\\end{{lstlisting}}", EASY * 3 + "\n" + pipes, "<b></b>", " \n"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    r = {x.row_id: x for x in p4_quality.quality([(d, "f", "id", "t")], common(spark)).collect()}
    assert [r[k].is_prose for k in (0, 1, 2, 3, 4, 6)] == [False, False, False, False, True, None]
    assert r[5].is_prose is not None and r[0].n_lines == 7 and r[0].n_words == 7
    assert r[4].n_words == len(EASY.replace(",", "").split()) * 3


def test_specimens_are_their_own_profile():
    P = p4_quality.Profiles([(a, b, c) for a, b, c in WORDS])
    for name, (prose, xs) in p4_quality.SPECIMENS.items():
        data, off = tb.as_utf8(p4_quality.plain(pa.array(list(xs))))
        best, d, _ = P.nearest(p4_quality.measure(data, off, P.fw))
        assert (P.prose[best] == prose).all() and d.max() < 1e-6, name
    assert np.allclose(p4_quality.divergence(np.array([[1.0, 0.0]]) + 1e-12, np.array([[0.0, 1.0]]) + 1e-12), 1.0, atol=1e-6)


def test_specimens_are_of_no_corpus():
    """No line of a specimen stands in a test table; lines that are markup alone say nothing."""
    import glob

    import pyarrow.parquet as pq

    tables = [pq.read_table(f) for f in glob.glob("/root/testdata/sf0.01/*.parquet") + glob.glob("/root/testdata/sf0.001/*.parquet")]
    every = "\n".join(x for t in tables for f in t.schema if pa.types.is_string(f.type) for x in t.column(f.name).to_pylist() if x)
    lines = [x for _, xs in p4_quality.SPECIMENS.values() for t in xs for x in t.split("\n") if len(x) > 11 and not x.startswith(("\\begin{", "\\end{", "{|"))]
    assert len(lines) > 100 and not [x for x in lines if x[:60] in every]


def test_levels(spark):
    rows = [(i, EASY * 4) for i in range(20)] + [(100 + i, HARD * 4) for i in range(20)] + [(200, "Das alte Haus und die Katze und der Hund zu Hause und den Weg."), (201, ""), (202, None), (203, "n/a\nn/a\nn/a\nn/a"), (204, EASY[:48])]
    d = spark.createDataFrame(rows, "record_id long, t string")
    lv = p6_level.levels(d, common(spark), "record_id", "t")
    young = {r.record_id for r in p6_level.young(lv).collect()}
    assert young == set(range(20)) | {204}
    assert lv.count() == 43 and lv.filter("record_id = 200").first().is_english is False
    none = p6_level.levels(d.filter("record_id > 199"), common(spark), "record_id", "t")
    assert none.filter("level is not null").count() == 0
    assert p6_level.levels(d.limit(0), common(spark), "record_id", "t").count() == 0


MIDDLE = "The harbour was rebuilt after the winter storms, and most of the fishing boats returned to it within a year. Visitors can still see where the older wall ended, although much of the original stone was removed when the market was extended. "


def test_levels_cover_all_grades(spark):
    assert all(a[2] == b[1] for a, b in zip(p6_level.LEVELS, p6_level.LEVELS[1:]))
    rows = [(i, EASY * 4) for i in range(20)] + [(100 + i, HARD * 4) for i in range(20)] + [(200 + i, MIDDLE * 3) for i in range(20)]
    d = spark.createDataFrame(rows, "record_id long, t string")
    lv = p6_level.levels(d, common(spark), "record_id", "t")
    grades = {k: {r.grade for r in lv.filter(f"record_id between {a} and {a + 19}").collect()} for k, a in (("easy", 0), ("hard", 100), ("middle", 200))}
    assert grades["middle"] == {10} and max(grades["easy"]) <= 8 and min(grades["hard"]) >= 12
    assert {r.record_id for r in p6_level.young(lv).collect()} == set(range(20))


def test_every_seed_text_counts(spark):
    """A level whose texts have the highest hashes of a large table: a share by hash would leave them out."""
    late = F.pmod(F.xxhash64("record_id"), F.lit(1 << 30)) > int(0.6 * (1 << 30))
    ids = spark.range(60_000).select(F.col("id").alias("record_id"), late.alias("late"))
    middle = [r.record_id for r in ids.filter("late").orderBy("record_id").limit(12).collect()]
    text = F.when(F.col("record_id").isin(middle), MIDDLE * 3).when(F.col("record_id") % 2000 == 0, EASY * 4).when(F.col("record_id") % 2000 == 1, HARD * 4).otherwise("x y")
    lv = p6_level.levels(ids.select("record_id", text.alias("t")), common(spark), "record_id", "t")
    assert [r.grade for r in lv.filter(F.col("record_id").isin(middle)).collect()] == [10] * 12
    assert lv.count() == 60_000


def test_a_text_is_no_evidence_for_itself():
    """The only seed of a level, of words that many texts of another level have too."""
    own = np.repeat(np.arange(10), 45)
    words, n = np.concatenate((np.arange(50), np.arange(10))), np.concatenate((np.full(50, 1000), np.full(10, 45)))
    m = p6_level.Models(pa.table({"level": pa.array([1] * 50 + [3] * 10, pa.int32()), "word": words, "n": n, "docs": np.where(np.arange(60) % 50 == 0, 1, 0)}))
    h, r = own.astype(np.uint64), np.zeros(450, int)
    best = lambda seed: m.levels[m.score(h, r, 1, np.array([seed])).argmax()]
    assert m.levels == [1, 3] and best(3) == 1 and best(-1) == 3


def test_counts_in_parts_are_the_same(spark, monkeypatch):
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([t * 4])], names=["_text"]) for t in (EASY, HARD, MIDDLE) * 5])

    def counts():
        total = {}
        for b in p6_level._seed_counts(WORDS)(batches()):
            for k, w, n, docs in zip(*(b[c].to_pylist() for c in ("level", "word", "n", "docs"))):
                total[k, w] = total.get((k, w), 0) + n
                total[k] = total.get(k, 0) + docs
        return total

    whole = counts()
    monkeypatch.setattr(p6_level, "FLUSH_WORDS", 20)
    assert counts() == whole and sum(n for k, n in whole.items() if isinstance(k, int)) == 15


# ---------------------------------------------------------------------------------------- garbled


def test_chains_round_trip():
    c = p5_garbled.Chains()
    for word in ("naïve", "Größe", "“quoted”", "качество", "→"):
        for codec in ("cp1252", "latin_1", "cp1251", "cp437", "mac_roman"):
            bad = "".join(c.table[codec][b] for b in word.encode())
            assert (f"utf_8>{codec}", word) in c.undo(bad)
    assert dict(c.undo("качество".encode("koi8_r").decode("cp1251")))["koi8_r>cp1251"] == "качество"
    assert p5_garbled.shape("fa�ade") == p5_garbled.shape("façade")


def test_garbled_records(spark):
    clean = ["Le résumé naïve de la façade à l’école", "Качество моделей заметно выросло за годы", "Größe und Höhe – schön", "NAÇÃO e noção", "25 °C ± 2"] * 12
    bad = ["Le résumé naïve".encode().decode("cp1252"), "Качество моделей заметно".encode("koi8_r").decode("cp1251"), "fa�ade", "schön – Höhe".encode().decode("latin_1"), "résumé façade".encode().decode("mac_roman")]
    rows = [(i, t) for i, t in enumerate(clean)] + [(500 + i, t) for i, t in enumerate(bad)] + [(900, None), (901, ""), (902, "ascii only")]
    d = spark.createDataFrame(rows, "id long, t string").withColumn("token", F.lit("clash")).withColumn("source", F.lit("x"))
    parts = [(d, "f.t", "id", "t", "cast(null as string)")]
    tok = p5_garbled.words(parts)
    found = p5_garbled.estimate(tok)
    assert {r.row_id for r in p5_garbled.affected(tok, found).collect()} == {500, 501, 502, 503, 504}
    rep = {r.row_id: r.repaired for r in p5_garbled.repaired(parts, tok, found).collect()}
    assert rep[500] == "Le résumé naïve" and rep[502] == "façade" and rep[503] == "schön – Höhe" and rep[501].startswith("Качество")
    empty = p5_garbled.words([(d.limit(0), "f.t", "id", "t", "source")])
    assert p5_garbled.affected(empty, p5_garbled.estimate(empty)).count() == 0


# ------------------------------------------------------------------------------------------ leaks

ITEM = "The night clerk of Lower Brask observed that the totals agreed although no single column did, and that eighty-nine of the chess problems had to be summarised again with two mirrors and a tuning fork."
ASK = "Which of the following statements is best supported by the passage?"


def test_leaks(spark):
    other = ITEM.replace("night clerk", "museum guard").replace("Lower Brask", "Dunmarrow").replace("totals agreed although no single column did", "first frost had left the pages red").replace("chess problems", "tide tables").replace("summarised", "weighed").replace("two mirrors and a tuning fork", "knots tied in gum arabic")
    items = spark.createDataFrame([(1, f"{ITEM} {ASK}"), (2, f"{other} {ASK}"), (3, None), (4, "")], "item_id long, text string")
    cut = ITEM.upper().replace("COLUMN", "COL-\n  umn".replace("umn", "umn")).replace(" AND THAT ", " <cit.> AND THAT ")
    docs = [(1, f"Before. {ITEM} After."), (2, cut), (3, ASK), (4, "an older note mentions no single column did without comment"), (5, None), (6, ""), (7, ITEM.replace("observed", "noted").replace("again ", "")), (8, f"Before. {ITEM} After."), (9, "x " * 50_000 + ITEM)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in p8_leak.leaks(d, items).collect()}
    assert got == {(k, 1) for k in (1, 2, 7, 8, 9)}
    # the same items in several blocks, their shared sentences counted on the executors
    blocks = {(r.doc_id, r.item_id) for r in p8_leak.leaks(d, items, max_chars=150).collect()}
    assert blocks == got and len(list(p8_leak.item_blocks(items, 150))) > 1
    assert p8_leak.leaks(d.limit(0), items).count() == 0 and p8_leak.leaks(d, items.limit(0)).count() == 0


def test_other_values_are_no_leak(spark):
    text = "A tank holds 412 litres of water and is filled by 7 pumps that run for 35 minutes each day, while 18 valves lose 9 litres in 4 hours until Harwick closes them after 26 days."
    other = text
    for a, b in (("412", "980"), ("7 pumps", "3 pumps"), ("35", "52"), ("18", "44"), ("9 litres", "6 litres"), ("4 hours", "8 hours"), ("Harwick", "Bramley"), ("26", "31")):
        other = other.replace(a, b)
    items = spark.createDataFrame([(1, text), (2, "It is said that Bramley and Harwick are far away, and nothing else stands in this item at all.")], "item_id long, text string")
    d = spark.createDataFrame([(1, f"Before. {text} After."), (2, f"Before. {other} After."), (3, text.replace("holds", "keeps").replace("412", "413"))], "doc_id long, text string")
    found = p8_leak.leaks(d, items)
    assert {(r.doc_id, r.kind) for r in found.collect()} == {(1, "copy"), (2, "other values"), (3, "changed copy")}
    assert {r.doc_id for r in p8_leak.leaked(found).collect()} == {1, 3}


# ------------------------------------------------------------------------------------------ names


def test_personal_data(spark):
    authors = spark.createDataFrame([(["Anna Korbel", "Anna Velten", "Bruno Korbel", "Bruno Sandig", None, ""],), ([],), (None,)], "authors array<string>")
    seed = ["Contact Anna Korbel, 12 Mill Street, Norton; tel. +1 646 555 0138; SSN 974-44-7926; mail anna@lab.example.org.", "Write to bruno [at] cs [dot] example [dot] edu or call (212) 555-0168.", "Signed: Bruno Sandig", "Velten, Anna lives at Lindenstr. 11, 00858 Norton", "grant agreement 871-40-7468 and ISSN 0000-1062", "precision@5 and @property are fine", "as Korbel <cit.> and Sandig et al. argue", "pages 3121-3134 (2015-2025)"]
    rows = [(i, s) for i, s in enumerate(seed * 6)] + [(900, None), (901, ""), (902, "x " * 60_000 + "mail a.b@c.example.org")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii_kind", F.lit("clash"))
    got = {}
    for r in p10_pii.found(d, authors).collect():
        got.setdefault(r.doc_id, set()).add(r.pii_kind)
    assert got[0] == {"person", "address", "phone", "id_number", "email"} and got[1] == {"email", "phone"} and got[2] == {"person"} and got[3] == {"person", "address"}
    assert not set(got) & {4, 5, 6, 7, 900, 901} and got[902] == {"email"}
    red = {r.doc_id: r.redacted for r in p10_pii.redacted(d, authors).collect()}
    assert "<person>" in red[0] and "974-44-7926" not in red[0] and red[4] == seed[4] and red[900] is None and red[901] == ""
    assert p10_pii.found(d.limit(0), authors.limit(0)).count() == 0


def test_names_of_all_papers(spark):
    n = 2_500_000
    rare = F.concat(F.lit("Q"), F.translate(F.format_string("%05d", (F.col("id") / 12_500).cast("int")), "0123456789", "abcdefghij"), F.lit("son"))
    name = F.when(F.col("id") % 12_500 == 0, rare).otherwise("Korbel")
    given, family = p10_pii.name_lists(spark.range(n).select(F.array(F.concat(F.lit("Anna "), name), F.concat(F.lit("p"), F.col("id"))).alias("authors")))
    want = ["q" + "".join("abcdefghij"[int(c)] for c in f"{k:05d}") + "son" for k in range(n // 12_500)]
    assert all(w in family for w in [*want, "korbel"]) and not any(f"{w}x" in family for w in want)
    assert "anna" in given and all(w in given for w in p10_pii.GIVEN)


def test_filter_misses_no_hash():
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    b = tb.Bits().add(h[:10_000])
    assert b.has(h[:10_000]).all() and not b.has(h[10_000:]).any() and not tb.Bits().has(h).any()


def random_model(seed):
    rnd = np.random.default_rng(seed)
    n, k = 5, p10_pii.N_LABEL
    m = p10_pii.Model(np.zeros((p10_pii.BUCKETS, k)), rnd.normal(size=(k, k)), np.zeros((2, k, k)))
    m.weights[1 : n + 1] = rnd.normal(size=(n, k)) * 2
    s = rnd.normal(size=(2, k, k))
    m.skip[:] = s + s.transpose(0, 2, 1)
    return m, n, k


def marginals(m, n, k, skips):
    marg = np.zeros((n, k))
    for y in np.ndindex(*(k,) * n):
        v = np.exp(sum(m.weights[1 + i, y[i]] for i in range(n)) + sum(m.trans[y[i], y[i + 1]] for i in range(n - 1)) + sum(m.skip[t, y[a], y[b]] for a, b, t in skips))
        for i in range(n):
            marg[i, y[i]] += v
    return marg


def test_belief_propagation_is_exact_on_chains():
    m, n, k = random_model(0)
    x = np.arange(1, n + 1)[:, None]
    assert (p10_pii.infer(m, x, np.zeros(n, int), np.zeros((0, 3), int)) == marginals(m, n, k, []).argmax(1)).all()
    # two chains joined by one skip edge are a tree: messages are exact there too
    two = np.array([0, 0, 0, 1, 1])
    t = p10_pii.Model(m.weights, m.trans, m.skip)
    trans = m.trans.copy()
    got = p10_pii.infer(t, x, two, np.array([[1, 4, 1]]))
    marg = np.zeros((n, k))
    for y in np.ndindex(*(k,) * n):
        v = np.exp(sum(m.weights[1 + i, y[i]] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in (0, 1, 3)) + m.skip[1, y[1], y[4]])
        for i in range(n):
            marg[i, y[i]] += v
    assert (got == marg.argmax(1)).all()


def test_skip_edges():
    words = "Dr Quorvin Zelphaard and later Quorvin Zelphard met Ostrel , Quorvyn".split()
    e = p10_pii.skip_edges(words, [1] * len(words)).tolist()
    assert [1, 5, 1] in e and [2, 6, 1] in e and [1, 10, 0] in e and len(e) == 3
    assert not len(p10_pii.skip_edges(words, list(range(len(words)))))


@pytest.fixture(scope="module")
def trained():
    """A model learnt from the texts of a test table."""
    import pyarrow.parquet as pq

    b = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{b}/documents.parquet", columns=["doc_id", "text"]).slice(3000).to_pydict()
    names = [w.lower() for x in pq.read_table(f"{b}/paper_metadata.parquet", columns=["authors"]).to_pydict()["authors"] for y in x or [] for w in [(y or "").split(" ")[-1]] if len(w) > 3]
    h = lambda ws: np.array([tb.hash_word(w) for w in ws], np.uint64)
    given, family = tb.Bits().add(h(p10_pii.GIVEN)), tb.Bits().add(h(names))
    wins = [(k, w) for k, t in zip(docs["doc_id"], docs["text"]) if t for w in cut(t, p10_pii.Names(given, family))]
    return p10_pii.learn(wins, given, family)


def test_training_memory_does_not_grow_with_the_windows():
    import tracemalloc

    def peak(n):
        rnd = np.random.default_rng(n)
        x = rnd.integers(0, p10_pii.BUCKETS, (n, p10_pii.N_FEATURE)).astype(np.uint16)
        y, start, skips = rnd.integers(0, p10_pii.N_LABEL, n), rnd.random(n) < 0.1, np.column_stack((rnd.integers(0, n, (n // 5, 2)), rnd.integers(0, 2, n // 5)))
        tracemalloc.start()
        p10_pii.fit(x, y, start, skips, rounds=1)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(200_000) < peak(20_000) + 40 * 180_000


def test_training_in_blocks_gives_the_same_model(monkeypatch):
    rnd = np.random.default_rng(3)
    n = 500
    x, y, start = rnd.integers(0, 90, (n, p10_pii.N_FEATURE)).astype(np.uint16), rnd.integers(0, p10_pii.N_LABEL, n), rnd.random(n) < 0.1
    skips = np.column_stack((rnd.integers(0, n, (80, 2)), rnd.integers(0, 2, 80)))
    whole = p10_pii.fit(x, y, start, skips)
    monkeypatch.setattr(p10_pii, "FIT_TOKENS", 7)
    parts = p10_pii.fit(x, y, start, skips)
    assert all(np.allclose(getattr(whole, k), getattr(parts, k), atol=1e-4) for k in ("weights", "trans", "skip")) and np.abs(whole.skip).max() > 0.01


def cut(text, names):
    data, off = tb.as_utf8(pa.array([text]))
    return [bytes(data[s:e]).decode("utf-8", "replace") for _, s, e in p10_pii.windows(data, off, names)]


def persons(text, trained):
    model, names = trained
    w = cut(text, names)
    return [x[a:b] for x, got in zip(w, p10_pii.find(w, [0] * len(w), model, names)) for a, b, k in got if k == 5]


def test_repeated_name_without_title_needs_the_skip_edges(trained, monkeypatch):
    first = "Ask for Dr Quorvin Zelphaard on 020 7946 0089 before release. " + "Nobody answered for a week and nothing else was said. " * 3
    later = ("Contact\nQuorvin Zelphaard\n+44 20 7946 0089", "Later Quorvin Zelphaard, who was late, came.", "Ask for Quorvin Zelphaard.", "We thank Quorvin Zelphaard for proofreading.", "The notes of Quorvin Zelphaard were lost.", "Quorvin Zelphaard, ORCID 0000-0000-1234-5678")
    with_edges = [len(persons(first + x, trained)) for x in later]
    # no given name, no title: alone it isn't a person
    assert all(persons(x, trained) == [] for x in later)
    monkeypatch.setattr(p10_pii, "skip_edges", lambda *_: np.zeros((0, 3), int))
    without = [len(persons(first + x, trained)) for x in later]
    assert all(a >= b for a, b in zip(with_edges, without)) and sum(with_edges) > sum(without) and max(with_edges) == 2


def test_field_decides_without_patterns(trained, monkeypatch):
    """Texts the model has not seen, labelled after the patterns that labelled the sample are taken away."""
    import pyarrow.parquet as pq

    model, names = trained
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 3000).to_pydict()
    wins = [(k, w) for k, x in zip(t["doc_id"], t["text"]) if x for w in cut(x, names)]
    want = {(k, label) for k, w in wins for _, _, label in p10_pii.strict(w, names)}
    monkeypatch.setattr(p10_pii, "strict", None)
    for n in ("EMAIL", "PHONE", "ID_FULL", "ADDRESS", "_PERSON_RX"):
        monkeypatch.setattr(p10_pii, n, None)
    got = {(k, label) for (k, _), spans in zip(wins, p10_pii.find([w for _, w in wins], [k for k, _ in wins], model, names)) for _, _, label in spans}
    assert len(want) > 300 and len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
