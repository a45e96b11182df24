"""Parsing, records, sources, sinks, scoring and incremental runs."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import parse as P
from scriptorium.operators import records as R
from scriptorium.operators import scoring as SC
from scriptorium.plans.pipeline import Config, Pipeline, convert
from scriptorium.schemas import PAPER_METADATA, PAPER_RECORD
from scriptorium.sources import files as FS
from scriptorium.sources import metadata as MD
from scriptorium.sources import sinks
from scriptorium.streaming import incremental as I

TEX = "\\documentclass{a}\n\\begin{abstract} An abstract. \\end{abstract}\n\\section{Introduction}Intro text. % note\n\\input{sec/rw}\n\\section*{Conclusion}Done."
RW = "\\section[short]{A {Deep} Related Work}\nOld work \\cite{x} matters.\n\\subsection{More}Sub text."


def test_sections(spark):
    files = spark.createDataFrame([("p", "main.tex", TEX), ("p", "sec/rw.tex", RW), ("q", "x.tex", "1. First Part\nbody\n2. Second Part\nmore"), ("r", "e.tex", "")], "arxiv_id string, path string, text string")
    rows = {(r.arxiv_id, r.order): r for r in P.sections(P.assemble(files)).collect()}
    assert [rows["p", k].heading for k in range(4)] == ["Abstract", "Introduction", "A {Deep} Related Work", "Conclusion"]
    assert "note" not in rows["p", 1].content and "Sub text." in rows["p", 2].content and "subsection" not in rows["p", 2].content
    assert [rows["q", k].heading for k in range(2)] == ["First Part", "Second Part"]
    assert not [k for k in rows if k[0] == "r"]


def test_includes_and_root(spark):
    rows = [("1", "a.tex", "\\documentclass{a}x \\input{b} y"), ("1", "d/b.tex", "B\\include{c}\\input{ c.tex }"), ("1", "d/c.tex", "C"), ("2", "a.tex", "q\\input{a}\\input{gone}r"), ("3", "m.tex", "\\input{./s/n}\\input{s/n}"), ("3", "s/n.tex", "\\input{k}"), ("3", "t/k.tex", "deep"), ("4", "z.tex", None)]
    rows += [("5", "r.tex", "\\documentclass{a}0\\input{f1}")] + [("5", f"f{k}.tex", f"{k}\\input{{f{k + 1}}}") for k in range(1, 14)]
    t = {r.arxiv_id: r.text for r in P.assemble(spark.createDataFrame(rows, "arxiv_id string, path string, text string")).collect()}
    assert t["1"] == "\\documentclass{a}x BCC y" and t["2"] == "qr" and t["3"] == "deepdeep" and t["4"] == ""
    # ten levels are put in place, what they include stays as it is written
    assert t["5"].startswith("\\documentclass{a}0123456789") and t["5"].endswith("10\\input{f11}")
    f = spark.createDataFrame([("p", "zz.tex", "long text but no class"), ("p", "main.tex", "short"), ("q", "b.tex", "x" * 9), ("q", "a.tex", "x" * 9)], "arxiv_id string, path string, text string")
    assert {r.arxiv_id: r.root for r in P.root_file(f).collect()} == {"p": "main.tex", "q": "a.tex"}


def test_merge_and_records(spark):
    s = spark.createDataFrame([(1, "p", "Related Work", "A", 0), (2, "p", None, None, 1), (3, "p", "prior art", "B", 2)], "section_id long, arxiv_id string, heading string, content string, section_order int")
    m = {r.section_type: r for r in R.merge_sections(R.classify_sections(s)).collect()}
    assert m["related_work"].content == "A\n\nB" and m["related_work"].confidence == 0.8 and m["other"].content == ""
    meta = spark.createDataFrame([("p", "T", ["x", "y"], ["cs.A"], "cs.A", "2015-01-01", "u", None, None), ("q", "U", [], [], None, None, None, None, None)], PAPER_METADATA)
    out = {r.arxiv_id: r for r in Pipeline(spark, Config()).records(meta, s).collect()}
    assert out["p"].related_work == "A\n\nB" and out["p"].authors == "x; y" and out["p"].sections_found == "related_work, other"
    assert out["q"].related_work == "" and out["q"].extraction_success is False and out["q"].raw_section_count == 0


def test_records_keep_all_parts(spark, tmp_path):
    s = spark.createDataFrame([(k, "p", "Related Work" if k % 2 else "Methods", f"{k}" * 30, k) for k in range(8)], "section_id long, arxiv_id string, heading string, content string, section_order int")
    meta = spark.createDataFrame([("p", "T", ["x"], ["cs.A"], "cs.A", "2015-01-01", "u", None, None), ("q", "U", [], [], None, None, None, None, None)], PAPER_METADATA)
    n = s.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("raw_section_count"))
    out = R.build_records(meta, R.merge_sections(R.classify_sections(s), part_chars=50), n)
    got = sorted((r.arxiv_id, r.part_no, r.related_work, r.extraction_success, r.sections_found, r.raw_section_count) for r in out.collect())
    assert len(got) == 3 and [r[1] for r in got] == [0, 1, 0]
    assert "\n\n".join(r[2] for r in got[:2]) == "\n\n".join(str(k) * 30 for k in (1, 3, 5, 7))
    assert {r[3:] for r in got[:2]} == {(True, "other, related_work", 8)} and got[2][2:] == ("", False, "", 0)
    path = str(tmp_path / "batches")
    for b in (0, 1):
        I.merge_batch(path, lambda x: x)(out, b)
    assert sorted((r.arxiv_id, r.part_no) for r in I.latest(spark, path).collect()) == [("p", 0), ("p", 1), ("q", 0)]


def test_joins(spark):
    p = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "arxiv_id string")
    pr = spark.createDataFrame([("a", "completed"), ("b", "pending")], "arxiv_id string, status string")
    assert sorted(r.arxiv_id for r in R.to_process(p, pr).collect()) == ["b", "c", "c"]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "arxiv_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3)], "arxiv_id string, v int")
    assert sorted(tuple(r) for r in R.merge_records(old, new).collect()) == [("a", 1), ("b", 2), ("b", 3)]
    twice = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, None), ("b", None, "x")], "arxiv_id string, m double, t string")
    assert sorted((r.arxiv_id, r.m, r.t) for r in R.left_metrics(p, twice, ["arxiv_id"]).collect() if r.arxiv_id != "c") == [("a", 1.0, None), ("b", None, "x")]
    doubled = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "arxiv_id string, m double")
    with pytest.raises(Exception, match="several rows for a"):
        R.left_metrics(p, doubled, ["arxiv_id"]).collect()


def test_sources(spark, tmp_path):
    t = tmp_path / "txt" / "cs" / "0006023"
    t.mkdir(parents=True)
    (t / "00_A b.txt").write_text("hello", encoding="utf-8")
    r = FS.load_corpus(spark, str(tmp_path / "txt"), "2015").first()
    assert (r.arxiv_id, r.filename, r.raw_text) == ("cs/0006023", "00_A b.txt", "hello")
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as tf:
        for name in ("main.tex", "../evil.tex", "/abs.tex"):
            i = tarfile.TarInfo(name)
            i.size = 4
            tf.addfile(i, io.BytesIO(b"caf\xe9"))
    arch = tmp_path / "arch"
    arch.mkdir()
    (arch / "1501.00001.tar.gz").write_bytes(b.getvalue())
    (arch / "1501.00002.gz").write_bytes(gzip.compress(b"\\section{A}"))
    got = {(r.arxiv_id, r.path): r.text for r in FS.load_archives(spark, str(arch)).collect()}
    assert got == {("1501.00001", "main.tex"): "café", ("1501.00002", "main.tex"): "\\section{A}"}
    snap = tmp_path / "s.json"
    good = {"id": "1408.2103", "title": "A\n  B", "abstract": " x ", "categories": "cs.CL math.X", "doi": "", "update_date": "2015", "authors_parsed": [["Doe", "Jane", ""], ["Solo"]], "versions": [{"version": "v1", "created": "Mon, 2 Apr 2015 19:18:42 GMT"}]}
    late = good | {"id": "2", "versions": [{"version": "v1", "created": "Fri, 31 Dec 2015 10:00:00 GMT"}]}
    snap.write_text("\n".join([json.dumps(good), "{broken", json.dumps(late), json.dumps(good | {"id": "3", "versions": []}), json.dumps(good | {"id": "4", "categories": "math.X"})]))
    rows = MD.load_snapshot(spark, str(snap), "2015-01-01", "2015-12-31").collect()
    assert [(r.arxiv_id, r.title, r.authors, r.published, r.doi) for r in rows] == [("1408.2103", "A B", ["Jane Doe"], "2015-04-02T19:18:42", None)]
    xml = "<record><header><datestamp>2016-01-01</datestamp></header><metadata><arXivRaw><id>77</id><version version='v1'><date>Mon, 2 Apr 2015 19:18:42 GMT</date></version><title>T</title><authors>A B (X)\nC D</authors><categories>cs.AI cs.CL</categories><abstract> z </abstract></arXivRaw></metadata></record>"
    x = MD.parse_records(spark.createDataFrame([(xml,)], "value string")).first()
    assert (x.arxiv_id, x.published, x.updated, x.authors, x.primary_category) == ("77", "2015-04-02", "2016-01-01", ["A B", "C D"], "cs.AI")
    heads = spark.createDataFrame([("a", 200, "application/pdf"), ("b", 200, "application/gzip"), ("c", 404, None), ("d", None, None)], "arxiv_id string, status_code int, content_type string")
    assert {r.arxiv_id: r.has_source for r in FS.probe(heads).collect()} == {"a": False, "b": True, "c": False, "d": False}
    assert MD.load_cache(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_run_is_resumable(spark, tmp_path):
    meta = spark.createDataFrame([("p", "T", ["x"], ["cs.A"], "cs.A", "2015-01-01", "u", None, None), ("z", "T", ["x"], ["math.A"], "math.A", "2015-01-01", "u", None, None)], PAPER_METADATA)
    src = spark.createDataFrame([("p", "main.tex", TEX), ("p", "sec/rw.tex", RW)], "arxiv_id string, path string, text string")
    c = Config(output=str(tmp_path / "o"), progress=str(tmp_path / "pr"), text_export=str(tmp_path / "txt"))
    assert Pipeline(spark, c).run(meta, src).count() == 1
    assert Pipeline(spark, c).run(meta, src).count() == 0
    rec = FS.existing_records(spark, c.output).collect()
    assert len(rec) == 1 and rec[0].extraction_success and "<cit.>" in rec[0].related_work
    assert len(list((tmp_path / "txt" / "p").glob("*.txt"))) == 2
    # a version that was never finished is not read, and not built upon
    sinks.write_records(spark.createDataFrame([], PAPER_RECORD), c.output + "/v=00000007", "snappy")
    (tmp_path / "o" / "v=00000007" / "_SUCCESS").unlink()
    assert FS.existing_records(spark, c.output).count() == 1 and MD.next_version(spark, c.output).endswith("v=00000002")
    st = {r.status: r["count"] for r in convert(spark, src, str(tmp_path / "c")).collect()}
    assert st == {"succeeded": 1} and len(list((tmp_path / "c" / "p").glob("*.txt"))) == 4


def test_existing_output_is_found_on_the_default_file_system(spark, tmp_path):
    """A path without a scheme is the one Spark writes to, not the driver's disk as such."""
    (tmp_path / "x").mkdir()
    assert MD.exists(spark, str(tmp_path / "x")) and MD.exists(spark, f"file://{tmp_path}/x") and not MD.exists(spark, str(tmp_path / "y"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://nowhere/")
        with pytest.raises(Exception):
            MD.exists(spark, str(tmp_path / "x"))
    finally:
        conf.set("fs.defaultFS", old)


def test_model_decides_what_rules_leave(spark):
    rows = [(1, "p", "Related Work", "A"), (2, "p", "Overview", "earlier systems"), (3, "p", "Results", "ours"), (4, "p", "Odd", "fail"), (5, "q", "Overview", "earlier systems")]
    s = spark.createDataFrame([(a, b, c, d, a) for a, b, c, d in rows], "section_id long, arxiv_id string, heading string, content string, section_order int")

    def make():
        def call(prompt):
            if "fail" in prompt:
                raise OSError("no answer")
            return '{"section_type": "related_work", "confidence": 0.6}' if "earlier" in prompt else "no JSON"

        return call

    got = {r.section_id: (r.section_type, r.confidence, r.method) for r in R.classify_sections(R.model_sections(s, make, max_calls=3)).collect()}
    assert got[1] == ("related_work", 1.0, "latex_parsed") and got[2] == ("related_work", 0.6, "llm_classified") and got[3] == ("other", 0.1, "llm_classified")
    assert got[4] == ("other", 0.0, "latex_parsed") and got[5] == ("other", 0.0, "latex_parsed")
    assert R.prompt(None, None) and len(R.prompt("h", "x" * 9000)) < 900
    c = Config()
    meta = spark.createDataFrame([("p", "T", ["x"], ["cs.A"], "cs.A", "2015-01-01", "u", None, None)], PAPER_METADATA)
    assert Pipeline(spark, c, make).records(meta, s).first().related_work == "A\n\nearlier systems"


def test_downloads_and_harvest(spark, tmp_path):
    import http.server
    import threading

    asked = []
    page = "<x><record><header><datestamp>2016-01-01</datestamp></header><metadata><arXivRaw><id>{i}</id><title>T</title><authors>A B</authors><categories>{c}</categories></arXivRaw></metadata></record>{t}</x>"

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.reply(False)

        def do_GET(self):
            self.reply(True)

        def reply(self, body):
            asked.append((self.command, self.path))
            kind, data = "application/gzip", gzip.compress(b"\\section{A}")
            if self.path.startswith("/oai"):
                last = "resumptionToken" in self.path
                kind, data = "text/xml", page.format(i=2 if last else 1, c="cs.A" if last else "math.X cs.B", t="" if last else "<resumptionToken>k</resumptionToken>").encode()
            elif "none" in self.path:
                self.send_response(404)
                self.end_headers()
                return
            elif "pdf" in self.path:
                kind = "application/pdf"
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            if body:
                self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        ids = spark.createDataFrame([("a1",), ("none",), ("pdf",)], "arxiv_id string")
        for _ in range(2):  # the second time all are staged
            got = {r.arxiv_id: r.has_source for r in FS.download(spark, ids, base + "/{id}", str(tmp_path / "st"), parts=2, delay=0).collect()}
            assert got == {"a1": True, "none": False, "pdf": False}
        assert sorted(asked) == [("GET", "/a1"), ("HEAD", "/a1"), ("HEAD", "/none"), ("HEAD", "/pdf")]
        files = FS.unpack(spark.read.parquet(str(tmp_path / "st")).filter("content is not null")).collect()
        assert [(r.arxiv_id, r.path, r.text) for r in files] == [("a1", "main.tex", "\\section{A}")]
        m = MD.load_metadata(spark, str(tmp_path / "cache"), url=base + "/oai", start="2015-01-01", end="2016-01-01")
        assert sorted(r.arxiv_id for r in m.collect()) == ["1", "2"]
        n = len(asked)
        assert MD.load_metadata(spark, str(tmp_path / "cache"), url=base + "/oai").count() == 2 and len(asked) == n
        assert list(FS.members("x", gzip.compress(b"\\section{A}" * 2000)[:60])) == []
    finally:
        server.shutdown()


def test_scores_are_resumable(spark, tmp_path):
    from scriptorium.plans import score

    t = spark.createDataFrame([(f"p{k}", "2015", f"the cat {k} sat on the mat") for k in range(7)], "arxiv_id string, year_group string, text_clean string")
    m = SC.train_ngrams(t)
    out = str(tmp_path / "s")
    # a run that stopped after two rows
    sinks.append_scores(SC.score(t.filter("arxiv_id in ('p1', 'p2')"), lambda: m, score.KEYS), out + ".partial")
    assert score.run(spark, t, out, lambda: m, block_rows=2) == 5
    assert spark.read.option("header", True).csv(out).count() == 7 and not MD.exists(spark, out + ".partial")
    assert score.run(spark, t, out, lambda: m) == 0
    assert score.run(spark, t, str(tmp_path / "l"), lambda: m, limit=3) == 3


def test_padded_batches():
    ws = [[1], [1, 2, 3], [4, 5], [], [6, 7, 8, 9]]
    got = list(SC.padded(ws, 2))
    assert [r for rows, *_ in got for r in rows] == [2, 1, 4] and got[0][1:] == ([[4, 5, 0], [1, 2, 3]], [[1, 1, 0], [1, 1, 1]])
    assert SC.choose_device(True, True) == "cuda" and SC.choose_device(False, True) == "mps" and SC.choose_device(False, False) == "cpu"


def test_streaming_batches(spark, tmp_path):
    inp = tmp_path / "in"
    inp.mkdir()
    (inp / "1.json").write_text('{"arxiv_id":"a","v":1}\n{"arxiv_id":"b","v":1}\n')
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    go = lambda: I.run_batches(I.read_stream(spark, str(inp), spark.createDataFrame([], "arxiv_id string, v int").schema), I.merge_batch(out, lambda b: b), ck).awaitTermination()
    go()
    (inp / "2.json").write_text('{"arxiv_id":"b","v":2}\n')
    go()
    go()
    assert sorted((r.arxiv_id, r.v) for r in I.latest(spark, out).collect()) == [("a", 1), ("b", 2)]


def test_status_windows(spark):
    log = spark.createDataFrame([("completed", "2025-01-01 10:05:00"), ("completed", "2025-01-01 10:55:00"), ("failed_parse", "2025-01-01 11:00:00")], "status string, t string").withColumn("logged_at", F.to_timestamp("t"))
    assert sorted((r.status, r.n) for r in I.status_stream(log).collect()) == [("completed", 2), ("failed_parse", 1)]


def test_windows_and_scores(spark):
    for n in (0, 1, 2, 10, 1024, 1025, 3000):
        seen = [k for b, e, f in SC.windows(n) for k in range(f, e)]
        assert seen == list(range(n))
    ids = list(range(2500))
    flat = lambda x: [1.0] * max(0, len(x) - 1)
    assert SC.doc_log_ppl(ids, flat) == (1.0, 2499) and SC.doc_log_ppl([1], flat) == (None, 0)
    assert SC.burstiness([1.0, 3.0]) == (pytest.approx(2**0.5), pytest.approx(2**0.5 / 2)) and SC.burstiness([1.0]) == (None, None)
    p = spark.createDataFrame([("a", "the cat sat on the mat today. the cat sat on a hat now."), ("b", ""), ("c", None)], "arxiv_id string, text_clean string")
    m = SC.train_ngrams(p)
    rows = {r.arxiv_id: r for r in SC.score(p, lambda: m, ["arxiv_id"]).collect()}
    assert rows["a"].n_sentences_scored == 2 and rows["a"].perplexity > 1 and rows["b"].log_perplexity is None
    r = SC.ratio(SC.score(p, lambda: m, ["arxiv_id"]), SC.score(p, lambda: m, ["arxiv_id"]), ["arxiv_id"])
    assert r.filter("arxiv_id = 'a'").first().binoculars_score == pytest.approx(1.0)


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([("a", 1, "x/y", "related_work", "t"), ("a", 2, None, "other", "u")], "arxiv_id string, section_order int, heading string, section_type string, content string")
    t = sinks.section_table(s, related_only=True)
    assert [r.filename for r in t.collect()] == ["01_xy.txt"]
    sinks.append_batch(t, str(tmp_path / "b"), 3)
    sinks.append_batch(t, str(tmp_path / "b"), 3)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1
    assert F is not None
