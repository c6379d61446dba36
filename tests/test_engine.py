"""Corpus, ranking, replies, graph, sources, sinks, streams and the engine."""

import io
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.engine import Engine
from lexmill.operators import candidates, corpus, fit, graph, measures, ranking, relations, reply
from lexmill.sources import readers, sinks
from lexmill.streaming import live


def edges(spark):
    rows = [(0, "a", "r", "b"), (1, "b", "r", "c"), (2, "c", "r", "d"), (3, "a", "r", "b"), (4, "e", "q", "e"), (5, "Pay", "q", "a")]
    return spark.createDataFrame([(*x, "r" if x[0] != 5 else None, None, "f", x[0]) for x in rows], "id long, s string, r string, o string, r_lex string, pattern string, source string, sent_idx int")


def test_graph(spark):
    e = edges(spark)
    assert {r["entity"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 3, "b": 3, "c": 2, "d": 1, "e": 2, "Pay": 1}
    start = spark.createDataFrame([("a",)], "entity string")
    assert {(r["id"], r["hop"]) for r in graph.neighbourhood(start, e, 2).collect()} == {(0, 1), (3, 1), (5, 1), (1, 2)}
    names = spark.createDataFrame([("Pay",), ("PAY ",), ("ds",), ("zz",), ("",)], "name string")
    assert {r["name"]: r["entity"] for r in graph.resolved(names, e).collect()} == {"Pay": "Pay", "PAY ": "Pay", "ds": "d", "zz": None, "": None}
    lines = [r["line"] for r in graph.facts("a", e).orderBy("place").collect()]
    assert lines == ["a (2 facts, hops=1)", "a r b #0,3", graph.DIVIDER, "Pay q a #5"]
    got = {r["id"]: r["status"] for r in graph.provenance(spark.createDataFrame([(0,), (99,), (-1,)], "id long"), e, spark.createDataFrame([], "source string, sent_idx int, text string"), 200).collect()}
    assert got == {0: "known", 99: "retired", -1: "unknown"}
    assert graph.communities(graph.ppmi(e)).count() == 5


def test_summaries(spark):
    t = spark.createDataFrame([(i, s, "r", o, f"{s} meets {o}") for i, (s, o) in enumerate([("ann", "bob"), ("bob", "cid"), ("ann", "cid"), ("xan", "yul"), ("yul", "zoe"), ("xan", "zoe")])], "id long, s string, r string, o string, text string")
    out = graph.summarized(t, lambda prompt: "ann and zoe", min_size=3, top_k=2).collect()
    assert len(out) == 2 and {r["grounding"] for r in out} == {0.5} and not any(r["accepted"] for r in out)


def pack_by_hand(lines, head, budget):
    kept, seen, chars, skips = [], set(), head, 0
    for place, text, width in lines:
        if skips >= 32:
            break
        if text in seen:
            continue
        if max(1, (chars + width + 1) // 4) > budget:
            skips += 1
            continue
        skips = 0
        seen.add(text)
        kept.append(place)
        chars += width + 1
    return kept


def test_packing_equals_a_greedy_loop(spark):
    rng = random.Random(9)
    sents = [(i, "f.md", "x" * rng.choice([5, 30, 200, 900]) + str(rng.randrange(300)), "") for i in range(400)]
    scores = [(q, i, rng.choice([0.0, rng.random()])) for q in range(4) for i in range(400)]
    qs = [(0, 100), (1, 600), (2, 2000), (3, None)]
    s = spark.createDataFrame(sents, "pos long, source string, text string, shown string")
    got = {}
    for r in reply.packed(spark.createDataFrame(scores, "qid long, pos long, score double"), spark.createDataFrame(qs, "qid long, budget int"), s).orderBy("qid", "line_no").collect():
        got.setdefault(r["qid"], []).append(r["pos"])
    for q, budget in qs:
        order = [i for _, i, x in sorted((y for y in scores if y[0] == q and y[2] > 0), key=lambda y: (-y[2], y[1]))]
        assert got[q] == pack_by_hand([(i, sents[i][2], len(f"[f.md] {sents[i][2]}")) for i in order], len(reply.HEAD), budget or 600)


def test_packing_reads_as_many_ranks_as_it_takes(spark):
    """One text in 4,500 copies stands before the others: the copies are passed over, the rest fills the budget."""
    sents = [(i, "f.md", "the same line" if i < 4500 else "x" * (20 + i % 50) + str(i), "") for i in range(4600)]
    s = spark.createDataFrame(sents, "pos long, source string, text string, shown string")
    scores = spark.createDataFrame([(q, i, 5000.0 - i) for q in (1, 2) for i in range(4600)], "qid long, pos long, score double")
    got = {}
    for r in reply.packed(scores, spark.createDataFrame([(1, 600), (2, 4000)], "qid long, budget int"), s).orderBy("qid", "line_no").collect():
        got.setdefault(r["qid"], []).append(r["pos"])
    for q, budget in ((1, 600), (2, 4000)):
        assert got[q] == pack_by_hand([(i, x[2], len(f"[f.md] {x[2]}")) for i, x in enumerate(sents)], len(reply.HEAD), budget) and len(got[q]) > 20


def test_section_paths(spark):
    t = "# T\n## A\nx\n```\n# no\n```\n### B\ny\n## C\nz"
    u = "# One\na\n# Two\r\n## [B]* `c`  d #\nb\n### " + "w" * 50 + "\nc"
    docs = spark.createDataFrame([("t.md", t), ("u.md", u), ("v.md", "no heading")], "source string, text string")
    rows = [("t.md", i, t.rindex(c), True) for i, c in enumerate("xyz")] + [("u.md", i, u.index(c), True) for i, c in enumerate(("\na", "\nb", "\nc"))] + [("v.md", 0, 0, True), ("x.py", 0, 0, False)]
    s = spark.createDataFrame(rows, "source string, sent_idx int, char_offset int, is_prose boolean")
    got = {(r["source"], r["sent_idx"]): r["section"] for r in corpus.with_sections(s, docs).collect()}
    assert [got["t.md", i] for i in range(3)] == ["A", "A › B", "C"]
    assert [got["u.md", i] for i in range(3)] == ["One", "Two › B c d", "Two › B c d › " + "w" * 40]
    assert got["v.md", 0] == got["x.py", 0] == ""
    assert corpus.with_sections(s.limit(0), docs).count() == 0


def test_rebuilt_code(spark):
    src = "def f(x):\n    y = 1\n\n    return y\n"
    rows = [("f.py", line.strip(), src.index(line.strip()), False) for line in src.split("\n") if line.strip()]
    s = spark.createDataFrame(rows, "source string, text string, char_offset int, is_prose boolean")
    assert corpus.rebuilt_code(s).first()["text"] == "def f(x):\n    y = 1\n     return y"


def test_numbering(spark):
    from lexmill.operators.shared import numbered_rows

    df = spark.createDataFrame([(f"s{i:03d}",) for i in random.Random(1).sample(range(500), 500)], "source string")
    assert [r["n"] for r in numbered_rows(df, ["source"], "n", 7).orderBy("source").collect()] == list(range(7, 507))
    assert numbered_rows(df.limit(0), ["source"], "n").count() == 0
    sents = spark.createDataFrame([(d, i) for d in (0, 99_999, 100_000, 350_000) for i in range(3)], "doc_seq long, sent_idx int")
    assert [r["pos"] for r in corpus.numbered(sents).orderBy("doc_seq", "sent_idx").collect()] == list(range(12))


def test_statements_for_a_graph_database(spark):
    e = spark.createDataFrame([(1, "a", "a-b", "b", "f"), (2, "a", "a_b", "b", "f")], "id long, s string, r string, o string, source string")
    rows = sinks.cypher(e).collect()
    assert {r["r"] for r in rows} == {"a-b", "a_b"} and len({r["query"] for r in rows}) == 1 and "{type: $r, source: $src}" in rows[0]["query"]
    more = e.selectExpr("*", "'t' sentence", "0 s_span", "1 o_span", "'c' r_class", "1 pattern", "false swapped")
    assert sinks.cypher(more, provenance=True).first()["query"].endswith("r.pattern = $pattern, r.swapped = $swapped")
    assert any("(n.value, n.kind)" in c for c in sinks.CONSTRAINTS)


def test_packing_measures_code_below_its_file(spark):
    s = spark.createDataFrame([(i, "a.py", i, f"x{i} = {'1' * 50}", "", False) for i in range(20)], "pos long, source string, sent_idx int, text string, shown string, is_prose boolean")
    scores = spark.createDataFrame([(1, i, 50.0 - i) for i in range(20)], "qid long, pos long, score double")
    lines = reply.packed(scores, spark.createDataFrame([(1, 200)], "qid long, budget int"), s, grouped=True)
    text = "\n".join([reply.HEAD, *[r["line"] for r in reply.grouped_code(lines, s).orderBy("order").collect()]])
    assert len(text) // 4 <= 200 < (len(text) + 1 + 60) // 4 and text.count("[a.py]") == 1


def test_learned_order_and_weights():
    w = ranking.Weights()
    assert ranking.Weights.from_json(w.to_json()) == w
    for bad in ({"std": [0.0] * 12}, {"w": [1.0]}, {"features": ["x"]}, {"mean": [float("nan")] * 12}):
        with pytest.raises(ValueError):
            ranking.Weights.from_json(json.dumps({**json.loads(w.to_json()), **bad}))


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_fit_finds_the_informative_feature(spark, monkeypatch, one_task):
    monkeypatch.setattr(fit, "ONE_TASK", one_task)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x[:, 2] = 5
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    w = fit.fit(df, features=("a", "b", "c"), shrink=0.9, steps=30 if one_task == 0 else 500)
    assert w.w[0] > 5 * abs(w.w[1]) and w.std[2] == 1.0 and abs(w.w[2]) < 1e-6
    with pytest.raises(ValueError):
        fit.fit(df, features=("a", "b", "c"), l2=1e-6)


def test_relations(spark):
    # "the parser was written by Ann": written(2) <- parser nsubjpass, by agent, Ann pobj
    rows = [(1, 0, "parser", "parser", "NOUN", "NN", "nsubjpass", 2), (1, 1, "was", "be", "AUX", "VBD", "auxpass", 2), (1, 2, "written", "write", "VERB", "VBN", "ROOT", 2), (1, 3, "by", "by", "ADP", "IN", "agent", 2), (1, 4, "Ann", "Ann", "PROPN", "NNP", "pobj", 3)]
    rows += [(2, 0, "Ann", "Ann", "PROPN", "NNP", "nsubj", 2), (2, 1, "not", "not", "PART", "RB", "neg", 2), (2, 2, "looks", "look", "VERB", "VBZ", "ROOT", 2), (2, 3, "up", "up", "ADP", "RP", "prt", 2), (2, 4, "names", "name", "NOUN", "NNS", "dobj", 2)]
    t = spark.createDataFrame(rows, "sent int, i int, text string, lemma string, pos string, tag string, dep string, head int")
    p = spark.createDataFrame([(1, 0, 4), (2, 0, 4)], "sent int, s int, o int")
    got = {r["sent"]: (r["label"], r["pattern"], r["swapped"]) for r in relations.lexicalized(t, p).collect()}
    assert got == {1: ("write", 1, True), 2: ("not_look_up", 2, False)}
    spans = relations.candidate_spans(t, spark.createDataFrame([("name",), ("parser",)], "token string")).collect()
    assert {(r["sent"], r["entity"], r["i"]) for r in spans} == {(1, "parser", 0), (2, "name", 4)}


def test_code_edges():
    src = "import os\n\nclass A(Base):\n    def go(self):\n        run(os.path)\n"
    assert set(relations.python_edges(src, "d/m.py")) == {("m.py", "imports", "os", 0), ("m.py", "defines", "A", 2), ("A", "inherits", "Base", 2), ("A", "contains", "go", 3), ("go", "calls", "run", 4)}
    assert relations.python_edges("def broken(", "m.py") == []


def test_decoding(spark):
    nodes = spark.createDataFrame([(1, i, e) for i, e in enumerate([3.0, 3.0, -3.0])] + [(2, 0, -1.0), (2, 1, -1.0)], "id int, i int, exist double")
    cells = spark.createDataFrame([(1, 0, 0, 1, 2.0), (1, 0, 1, 0, -2.0), (1, 0, 0, 0, 9.0), (1, 0, 0, 2, 9.0), (2, 0, 0, 1, -5.0), (2, 0, 1, 0, -4.0)], "id int, r int, i int, j int, adj double")
    got = {(r["id"], r["i"], r["r"], r["j"], r["forced"]) for r in measures.decoded(nodes, cells, force_first=True).collect()}
    assert got == {(1, 0, 0, 1, False), (2, 1, 0, 0, True)}


def office(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return b.getvalue()


def test_readers(spark, tmp_path):
    files = {
        "a.txt": b"plain text",
        "b.html": b"<html><nav>no</nav><body>out<article><p>One&nbsp;&amp; two</p><script>x<p></script><table>t</table></article></body></html>",
        "c.rtf": rb"{\rtf1{\fonttbl{\f0 X;}}Caf\'e9\par \{x\}{\*\gone no}\u8364?{\info{\title t}}}",
        "d.ipynb": json.dumps({"cells": [{"source": ["a\n", "b"]}, {"source": "c"}]}).encode(),
        "e.eml": b"Subject: Hi\nFrom: a@b.org\n\nBody here",
        "f.docx": office(word__document_dot_xml="<d xmlns:w='w'><w:p><w:r><w:t>A</w:t><w:tab/><w:t>B</w:t></w:r></w:p><w:p/></d>"),
        "g.xlsx": office(xl__sharedStrings_dot_xml="<s><si><t>k</t></si></s>", xl__worksheets__sheet1_dot_xml="<s><row><c t='s'><v>0</v></c><c><v>2</v></c></row></s>"),
        "h.pptx": office(**{"ppt__slides__slide10_dot_xml": "<s><p><t>ten</t></p></s>", "ppt__slides__slide2_dot_xml": "<s><p><t>two</t></p></s>"}),
        "i.odt": office(content_dot_xml="<d><h>H</h><p>a  b</p></d>"),
        "j.epub": office(**{"META-INF__container_dot_xml": "<c><rootfile full-path='o/p.opf'/></c>", "o__p_dot_opf": "<p><item id='1' href='x.html'/><itemref idref='1'/></p>", "o__x_dot_html": "<p>chapter</p>"}),
        "k.bin": b"\x00\x01",
        "l.docx": b"broken",
        "m.doc": b"old",
        "node_modules/x.txt": b"no",
        ".git/x.txt": b"no",
        ".github/x.txt": b"kept",
    }
    for n, data in files.items():
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(data)
    got = {r["source"]: r for r in readers.read_sources(spark, str(tmp_path)).collect()}
    text = {k: v["text"] for k, v in got.items() if v["error"] is None}
    assert text == {"a.txt": "plain text", "b.html": "One & two", "c.rtf": "Café\n{x}€", "d.ipynb": "a\nb\n\nc", "e.eml": "Subject: Hi\nFrom: a@b.org\n\nBody here", "f.docx": "A B", "g.xlsx": "k | 2", "h.pptx": "two\n\nten", "i.odt": "H\na b", "j.epub": "chapter", ".github/x.txt": "kept"}
    assert set(got) - set(text) == {"k.bin", "l.docx", "m.doc"}
    with pytest.raises(readers.Unreadable):
        readers.read_strict(spark, str(tmp_path))
    assert {r["source"] for r in readers.listed(spark, str(tmp_path)).collect()} == set(got)


def test_versions(spark, tmp_path):
    v = sinks.Versions(spark, str(tmp_path))
    assert v.current() is None and v.read("docs") is None
    v.write(docs=spark.range(3))
    v.write(docs=spark.range(5))
    assert v.current() == 2 and v.read("docs").count() == 5 and v.read("docs", 1).count() == 3
    (tmp_path / sinks.POINTER).write_text("{broken")
    assert v.current() is None and list(tmp_path.glob("_CURRENT.corrupt-*"))
    sinks.write_shards(spark.range(10).coalesce(1), str(tmp_path / "s"), 4)
    shards = sinks.read_shards(spark, str(tmp_path / "s"))
    assert shards.select("shard", "row").distinct().count() == 10 and shards.select("shard").distinct().count() == 3


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: live.ingest_stream(live.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ckpt")).awaitTermination()
    (tmp_path / "in/a.txt").write_text("first")
    run()
    (tmp_path / "in/b.txt").write_text("second")
    run()
    v = sinks.Versions(spark, str(tmp_path / "store"))
    assert {(r["source"], r["text"]) for r in v.read("docs").collect()} == {("a.txt", "first"), ("b.txt", "second")}
    before = v.current()
    live.upsert_batch(v, spark.createDataFrame([("a.txt", "first")], "source string, text string"))  # delivered again
    assert v.current() == before
    live.upsert_batch(v, spark.createDataFrame([("a.txt", "third")], "source string, text string"))
    assert [r["source"] for r in v.read("docs").orderBy("doc_seq").collect()] == ["b.txt", "a.txt"]


DOC = "# Guide\n## Storage\nThe indexer keeps every heading path. It stores them by file.\n## Speed\nThe packer fits the best lines into a budget. Ann Lee wrote the packer in 2019.\n" + "Filler words about nothing in particular go here. " * 30


FACTS = "s string, r string, o string, r_lex string, pattern string, source string, sent_idx int"


@pytest.fixture(scope="module")
def guide(spark):
    e = Engine(spark)
    assert [r["status"] for r in e.add(DOC, "guide.md").collect()] == ["ingested"]
    e.add("def pay(amountDue):\n    return amountDue * 2\n", "pay.py")
    return e


def test_engine_answers(spark, guide):
    e = guide
    assert [r["status"] for r in e.add(DOC, "guide.md").collect()] == ["unchanged"]
    a = e.ask("Who wrote the packer?", 100)
    assert "Ann Lee wrote the packer in 2019." in a and "[guide.md § Speed]" in a
    assert e.ask("zzz qqq", 100) == reply.NONE
    code = e.ask("amount due", 100, scorer="lexical")
    assert "[pay.py]\n  def pay(amountDue):\n  return amountDue * 2" in code
    assert "Question: Who" in e.context("Who wrote the packer?")
    many = spark.createDataFrame([(1, "Who wrote the packer?", None), (2, "What does the indexer keep?", 200), (3, "zzz qqq", 100)], "qid long, question string, budget int")
    got = {r["qid"]: r["reply"] for r in e.answers(many).collect()}
    assert "[guide.md § Speed] Ann Lee wrote the packer in 2019." in got[1] and "heading path" in got[2] and got[3] == reply.NONE
    with pytest.raises(ValueError):
        e.answers(many, scorer="other")
    assert [r["text"] for r in e.search("HEADING path").collect()] and e.search("HEADING path").count() == 1
    calls = {r["tool"]: r["calls"] for r in e.ledger().collect()}
    assert calls == {"ask": 4, "search": 2} and e.stats().first()["served"] > 0


def test_engine_facts_and_versions(spark, tmp_path):
    e = Engine(spark, save_to=str(tmp_path / "corpus"))
    e.add(DOC, "guide.md")
    e.add_edges(spark.createDataFrame([("ann", "wrote", "packer", "wrote", None, "guide.md", 3), ("ann", "near", "packer", None, None, "guide.md", 3)], FACTS))
    lines = [r["line"] for r in e.query("Ann").orderBy("place").collect()]
    assert sorted(lines[1:]) == sorted(["ann wrote packer #1", graph.DIVIDER, "ann near packer #0"])
    assert "no entity matches" in e.query("nobody").first()["line"] and e.provenance(0).first()["status"] == "known"
    whole = e.ask("What did ann do with the packer?", full=True)
    assert whole.startswith("entities: ") and "ann" in whole.split("\n")[0] and "ann wrote packer #1" in whole and 'guide.md s3: "Ann Lee' in whole
    assert whole.index("wrote packer #1") < whole.index(graph.DIVIDER) < whole.index("near packer #0") < whole.index("\n--\n")
    s = e.stats().first()
    assert s["docs"] == 1 and s["edges"] == 2 and s["entities"] == 2
    e.add(DOC.replace("2019", "2020"), "guide.md")
    assert "2020" in e.ask("Who wrote the packer?", 100) and e.edges.count() == 0
    e.add_edges(spark.createDataFrame([("x", "y", "z", "y", None, "guide.md", 0)], FACTS))
    status = {r["id"]: r["status"] for r in e.provenance(0, 1, 2, 3).collect()}
    assert status == {0: "retired", 1: "retired", 2: "known", 3: "unknown"}  # ids are never given twice
    e.add("Another text.", "b.txt")
    again = Engine(spark, save_to=str(tmp_path / "corpus"))
    assert again.docs.count() == 2 and again.next_id == 3 and again.edges.count() == 1
    again.drop("guide.md")
    assert again.docs.count() == 1 and again.edges.count() == 0


def test_engine_reads_facts_with_an_extractor(spark, tmp_path):
    seen = []

    def extract(sentences):
        seen.append(sorted(r[0] for r in sentences.select("source").distinct().collect()))
        return sentences.filter("text like '%packer in%'").select(F.lit("ann").alias("s"), F.lit("wrote").alias("r"), F.lit("packer").alias("o"), F.lit("wrote").alias("r_lex"), F.lit(None).cast("string").alias("pattern"), "source", "sent_idx")

    (tmp_path / "guide.md").write_text(DOC)
    (tmp_path / "bad.docx").write_bytes(b"broken")
    e = Engine(spark)
    e.add(f"file://{tmp_path}")
    assert {r["source"] for r in e.docs.collect()} == {"guide.md"} and e.errors.count() == 1
    with pytest.raises(RuntimeError):
        e.deep()
    e.deep(extract)
    e.add("Nothing to see.", "b.txt")
    assert e.edges.count() == 1 and seen == [["guide.md"], ["b.txt"]]


def test_engine_with_vectors(spark):
    e = Engine(spark, vectors=True)
    e.add(DOC, "guide.md")
    q = spark.createDataFrame([(1, "Who wrote the packer?"), (2, "Zork plugh xyzzy the packer?")], "qid long, question string")
    assert "packer" in {r["qid"]: r["reply"] for r in e.answers(q, scorer="dense", hop=False).collect()}[1]
    got = {r["qid"]: r for r in e.answers(q, hop=False).collect()}
    assert "packer" in got[1]["reply"] and got[2]["conf"] is not None
    with pytest.raises(ValueError):
        Engine(spark, vectors=True, encode=lambda texts: [[3.0, 4.0]] * len(texts))


def test_candidates(spark):
    m = spark.createDataFrame([(r, i, f"e{(7 * r + i) % 60}") for r in range(20) for i in range(r * 2)] + [(3, 99, "e21")], "rec int, at int, entity string")
    pool = spark.createDataFrame([(f"e{i}",) for i in range(60)] + [("e1",)], "entity string")
    gold = spark.createDataFrame([(3, "e21", "nowhere")], "rec int, s string, o string")
    got = {}
    for r in candidates.candidate_lists(m, pool, gold, cap=20, extra=5).orderBy("rec", "place").collect():
        got.setdefault(r["rec"], []).append(r)
    for r in range(1, 20):
        text = list(dict.fromkeys(f"e{(7 * r + i) % 60}" for i in range(r * 2)))[:15]
        rows = got[r]
        assert [x["entity"] for x in rows if x["from_text"]] == text and [x["place"] for x in rows] == list(range(1, len(rows) + 1))
        others = [x["entity"] for x in rows if not x["from_text"]]
        assert len(set(others)) == len(others) == 5 and not set(others) & set(text)
        assert {x["entity"] for x in rows if x["exists"]} == ({"e21"} if r == 3 else set())
    assert candidates.candidate_lists(m, pool.limit(0), gold).filter("not from_text").count() == 0
    docs = spark.createDataFrame([(i, "A sentence that is long enough to be a unit. Too short. " * 3) for i in range(100)], "doc_id long, text string")
    one, two = (candidates.prose_sample(docs, 10_000).collect() for _ in range(2))
    assert one == two and 40 < len(one) < 150 and len(candidates.prose_sample(docs, 7).collect()) == 7


def test_metrics_are_appended(spark, tmp_path):
    for step in range(2):
        sinks.append_metrics(spark.createDataFrame([(step, 0.5)], "step int, loss double"), str(tmp_path / "m"))
    assert sorted(r["step"] for r in spark.read.json(str(tmp_path / "m")).collect()) == [0, 1]


def test_a_cluster_needs_a_shared_folder(spark):
    from lexmill.operators import shared

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Cluster)

        class conf:
            get = staticmethod(lambda key, default=None: default)

        class getCheckpointDir:
            isDefined = staticmethod(lambda: False)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.checkpoint_dir(Cluster)


def test_small_tables(spark):
    t = spark.createDataFrame([], "pos long, text string")
    s = ranking.tokenized(t, F.col("text"))
    assert ranking.vocabulary(s, ranking.postings(s)).count() == 0 and ranking.mean_length(s).first()["avgdl"] == 1.0
    assert corpus.sequences(spark.createDataFrame([("g", i, i) for i in range(7)], "g string, o int, v int"), "g", "o", "v", 3).count() == 2
