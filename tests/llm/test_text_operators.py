"""Operators on texts: tokens, look-alikes, markup, sentences, languages."""

import base64
import random
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import languages, lookalikes, markup, sentences, tokens

DIRTY = "id long, text string, ids string, form string, clean string, unit int, start_at int, language string"


def dirty(spark):
    """Nulls, empty, blank, long and repeated texts; extra columns named like results."""
    long = "The indexer keeps long lines. " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Plain text."), (5, "Plain text."), (6, long), (7, "é" * 3), (8, "e\u0301" * 3), (None, "no id")]
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2, "w") for i, t in rows], DIRTY)


# ---- tokens ----


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_those_of_the_public_library(reference):
    rng = random.Random(3)
    letters = "abcdefghij  \n\t0123456789.,!?'sétñßжщ日本語ไทย🙂_-/\\<>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    texts += ["<|endoftext|> is text", "a" * 3000, "ab" * 700, "日本" * 400, " " * 70 + "x", "don't we'll I'd", "", None]
    flat, off = tokens.encoder(tokens.vocabulary_path()).encode(texts)
    for i, t in enumerate(texts):
        assert flat[off[i] : off[i + 1]].tolist() == (reference.encode_ordinary(t) if t else [])


def test_some_words_need_the_merges(reference):
    e = tokens.SpeculativeBPE(tokens.vocabulary_path())
    e.encode(["indexing unsupervised mispropounded xqzvkk heteroscedasticity"])
    assert len(e.pairs) and not e.fits.all() and e.fits.any()


def test_ids_of_dirty_rows(spark):
    got = {r["id"]: r["ids"] for r in tokens.encode_texts(dirty(spark), "id", "text").collect()}
    assert got[1] == [] and got[2] == [] and got[4] == got[5] and len(got[6]) > 100_000
    assert tokens.encode_texts(spark.createDataFrame([], "id long, text string"), "id").count() == 0


# ---- look-alikes ----


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｆｕｌｌ width", "Full width"), ("cafe\u0301", "café"), ("in\u200bdex\u00ad", "index"), ("a\u00a0b\u2009c", "a b c"), ("\u0430\u0441\u0435", "ace"), ("\ufb01le", "file"), ("\u2f42字", "文字"), ("\u1100\u1161\u11a8", "각"), ("\u0627\u0655", "إ"), ("カ\u3099", "ガ"), ("ĳs", "ijs"), ("\u0391\u0392", "AB"), ("a\u2011b\u2010c", "a-b-c"), ("\u03bd", "v"), ("Ꭰ", "D"), ("ս", "u"), ("\u0261", "g"), ("\u04cf", "\u04cf")],
)
def test_same_look_same_form(a, b):
    x, y = lookalikes.one_form_array(pa.array([a, b])).to_pylist()
    assert x == y


@pytest.mark.parametrize(("a", "b"), [("resume", "résumé"), ("Case", "case"), ("1", "l"), ("n.º", "n.o"), ("x²", "x2"), ("a b", "ab"), ("тест", "test"), ("a\nb", "a b")])
def test_other_look_other_form(a, b):
    x, y = lookalikes.one_form_array(pa.array([a, b])).to_pylist()
    assert x != y


def test_form_is_the_composed_one_and_stable():
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x330)]
    texts = ["".join(rng.choice("aeoucnszAEO xk") + "".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(12)) for _ in range(200)] + [None, ""]
    out = lookalikes.one_form_array(pa.array(texts)).to_pylist()
    assert out == [None if t is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if c != "\u034f")) for t in texts]
    assert lookalikes.one_form_array(pa.array(out)).to_pylist() == out


def test_look_pairs(spark):
    rows = [(1, "ab"), (2, "a\u200bb"), (3, "ab"), (4, "ａb"), (5, None), (6, ""), (7, " "), (8, "\u00a0"), (9, "aB")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, look int")
    got = {(r["a"], r["b"]) for r in lookalikes.look_pairs(df).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    classes = {r["doc_id"]: (r["class_id"], r["n_docs"], r["n_texts"]) for r in lookalikes.look_classes(df).collect()}
    assert classes == {**dict.fromkeys((1, 2, 3, 4), (1, 4, 3)), 9: (9, 1, 1)}
    many = spark.createDataFrame([(i, "same") for i in range(300)] + [(1000, "s\u0430me"), (1001, "s\u200bame")], "doc_id long, text string")
    assert lookalikes.look_pairs(many).distinct().count() == lookalikes.look_pairs(many).count() == 601
    assert lookalikes.look_pairs(df.limit(0)).count() == 0 and lookalikes.look_forms(dirty(spark), "id").count() == 9


# ---- markup ----

PAGES = {
    "html": '<script>var t = "<p>";</script><h2 class="t">Head</h2><p>Some <em>text</em> of the &laquo;page&raquo; that goes on for a while.</p><ul><li>One<li>Two</ul><pre><code>if (a &lt; 1) return;\n</code></pre>',
    "markdown": "Head\n========\n\nSome **text** of the [page](x.md) that goes on for a while.\n\n- One\n- Two\n\n```py\nif a < 1:  # no heading\n```\n\n| a | b |\n|---|---|\n| x | 1 |",
    "wiki": "== Head ==\nSome '''text''' of the [[page|page]] that goes on for a while.\n# One\n# Two\n{| class=\"grid\"\n! a\n|-\n| 1\n|}\n[[Category:x]]",
    "latex": "\\section*{Head}\nSome \\textbf{text} of the page~\\cite{x} that goes on for a while.\n\\begin{itemize}\n  \\item One\n  \\item Two\n\\end{itemize}\n\\[ a_{1} = \\frac{u}{v} \\]\n\\begin{verbatim}\nif (a < 1) {}\n\\end{verbatim}",
}


@pytest.mark.parametrize("notation", PAGES)
def test_pages(notation):
    r = markup.clean(PAGES[notation])
    assert r.notations == [notation]
    by = {}
    for k, t in zip(r.kinds, r.texts):
        by.setdefault(k, []).append(t)
    assert by["heading"] == ["Head"] and by["list"] == ["One", "Two"]
    body = by["text"][0]
    assert body.startswith("Some text of the") and "goes on for a while" in body and not any(c in body for c in "<*[]{}\\&'")
    if notation in ("html", "markdown", "latex"):
        assert "a < 1" in by["code"][0]
    if notation == "latex":
        assert "\\frac" in by["formula"][0]
    assert not markup.notations_of("\n".join(t for k, t in zip(r.kinds, r.texts) if k not in ("code", "formula")))


@pytest.mark.parametrize("t", ["n < 40 and i <= j && j > 0", "C# and R&D (a * b) [2] #3", "US$5, not US$6 (x_min, x_max) ($40)", "lief am\n4. Mai um 4.15 Uhr\n> 0.05", "{k} a/b 50 % 2^k [sic]", "l''", "rows\n-> columns\n* 3"])
def test_signs_of_prose_are_no_markup(t):
    r = markup.clean(t)
    assert r.notations == [] and r.text == t


@pytest.mark.parametrize(("t", "n"), [("The router $O(n^{2})$", "latex"), ("x~\\ref{s}", "latex"), ("a<br>", "html"), ("a &amp; b", "html"), ("''x y''", "wiki"), ("{{h|x}}", "wiki"), ("## x", "markdown"), ("`cache` x", "markdown"), ("text\n\n<br/><sub>LL-1</sub>", "html")])
def test_residues(t, n):
    assert markup.notations_of(t) == [n]


def test_surge_and_dive():
    thin, text = [8, 0, 9, 0, 7, 0, 0, 0], [120, 90, 150, 110, 80]
    body = markup.between_surge_and_dive(thin + text + thin[::-1])
    assert body == [False] * 8 + [True] * 5 + [False] * 8
    two = markup.between_surge_and_dive(text + [0] * 6 + [5] + [0] * 6 + text)
    assert two == [True] * 5 + [False] * 13 + [True] * 5
    assert markup.between_surge_and_dive([]) == [] and markup.between_surge_and_dive([30]) == [True] and not any(markup.between_surge_and_dive([0, 0]))
    nav = "".join(f"<a href='/{i}'>N{i}</a><br><br><br><br>" for i in range(12))
    page = f"{nav}<p>{'The body of the page goes on and on. ' * 8}</p><p>{'It has a second paragraph as well. ' * 8}</p>" + nav
    r = markup.clean(page)
    assert r.texts[0].startswith("The body") and len(r.texts) == 2  # without the step the links would stay


@pytest.mark.parametrize("mark", ["<script>x ", "<!-- a ", "$$ a ", "\\[ a ", "<pre> a ", "```x\n a", "\\begin{align} a ", "<p   ", "# a   ", "'''''a ", "**a ", "[a](", "{{a ", "$a "])
def test_marks_that_stay_open_cost_no_more_than_others(mark):
    def took(n):
        text = mark * n
        began = time.perf_counter()
        markup.clean(text)
        return time.perf_counter() - began

    took(100)
    assert min(took(16_000) for _ in range(2)) < 12 * max(min(took(4_000) for _ in range(3)), 0.004)


def test_display_formula_loses_its_marks():
    r = markup.clean("Text that stands before it.\n$$ a^{24} + b_k $$\nText after it, and 5\\% more.")
    assert r.kinds == ["text", "formula", "text"] and r.texts == ["Text that stands before it.", "a^{24} + b_k", "Text after it, and 5% more."]


def test_mask_keeps_places():
    t = PAGES["markdown"]
    m = markup.mask(t)
    assert len(m) == len(t) and m.index("goes on") == t.index("goes on") and "if a" not in m


def test_clean_dirty_rows(spark):
    got = {r["id"]: r for r in markup.clean_texts(dirty(spark), "id").collect()}
    assert got[1]["clean"] is None and got[1]["blocks"] == [] and got[2]["clean"] == "" and got[3]["clean"] == "" and len(got[6]["clean"]) > 500_000
    assert markup.clean_texts(dirty(spark).limit(0), "id").count() == 0


# ---- sentences ----


HELD = lambda t: zlib.crc32(t.encode()) % 5 == 0


@pytest.fixture(scope="module")
def held(spark):
    """Reference sentences that no model of these tests is trained on, by language."""
    out = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/lang_refs.parquet").collect():
        if HELD(r["text"]):
            out.setdefault(r["sonar_lang"], []).append(r["text"])
    return out


@pytest.fixture(scope="module")
def model(spark, held):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    delivered = read("sentences").filter("is_prose")
    whole, units = sentences.training_units(read("lang_refs"), delivered)
    out = [u for us in held.values() for u in us]
    apart = lambda us: [(k, u) for k, u in us if not any(h in u or u.strip() in h for h in out)]
    assert len(apart(whole)) < len(whole)
    return sentences.train(apart(units), short=sentences.abbreviations(delivered), asides=sentences.corpus_asides(read("documents").select("text")), whole=apart(whole))


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. Wexmor noted a drop of 56.56 percent in Fig. 41.", "“Does it still converge?” asked Sorford after run No. 39.", "The indexer keeps duplicate passages."],
        ["As a rule, the indexer keeps unsigned edges.", "The folder holds keys, vectors, logs, etc.", "Why does the indexer fail at 4.5 seconds?"],
        ["El Dr. Helsel observó una caída del 8,4 % en la fig. 40.", "En cambio, el constructor de grafos omite todas las cifras."],
    ],
)
def test_units_of_spaced_scripts(model, units):
    for gap in (" ", "\n", "\n\n", "  "):
        text = gap.join(units)
        at = model.begins("  " + text)
        assert [text[a - 2 :][: len(u)] for a, u in zip(at, units)] == units and len(at) == len(units)


def test_units_of_unspaced_scripts(model):
    zh = ["段落库收集两列分数，而分句模块保存重复的段落。", "“它还收敛吗？”Brivash在第40次运行后问道。", "丢失了54个分片！"]
    assert model.begins("".join(zh)) == [0, len(zh[0]), len(zh[0]) + len(zh[1])]
    th = ["ตัวสร้างกราฟข้ามคะแนนสองคอลัมน์ในรอบที่สอง", "ตัวทำดัชนีรวบรวมคะแนนสองคอลัมน์เมื่อคลังมีขนาดเล็ก"]
    assert model.begins(" ".join(th)) == [0, len(th[0]) + 1]


def found(model, units, gap, n=40, bare=False):
    """(recall, precision) of the joins of random sentences."""
    rng = random.Random(4)
    right = got_all = true = 0
    for _ in range(n):
        part = [rng.choice(units) for _ in range(3)]
        part = [sentences.without_marks(u, True) for u in part] if bare else part
        want, at = set(), 0
        for u in part[:-1]:
            at += len(u) + len(gap)
            want.add(at)
        got = set(model.begins(gap.join(part))[1:])
        right, got_all, true = right + len(want & got), got_all + len(got), true + len(want)
    return right / true, right / max(got_all, 1)


def test_held_out_units(model, held):
    """Sentences the model was not trained on: nearly every boundary and no other."""
    assert len(held) == 13
    got = {lang: found(model, us, "" if lang[:3] in ("zho", "jpn") else " ") for lang, us in held.items()}
    assert sum(r for r, _ in got.values()) / 13 > 0.97 and all(r >= 0.9 and p > 0.97 for r, p in got.values()), got


def test_held_out_units_without_marks_or_spaces(model, held):
    """No mark and no space between held-out sentences: every character is a place. In Thai an adverbial may as well
    end one sentence as begin the next, so not all boundaries can be told."""
    by = {lang[:3]: found(model, held[lang], "", bare=True) for lang in held if lang[:3] in ("zho", "jpn", "tha")}
    assert by["jpn"][0] > 0.9 and by["zho"][0] > 0.7 and by["tha"][0] > 0.3
    assert by["jpn"][1] > 0.9 and by["zho"][1] > 0.9 and by["tha"][1] > 0.5


def test_every_character_of_unspaced_scripts_is_a_place():
    at, keys = sentences.run_places("段落库收集两列分数และ")
    assert at.tolist() == list(range(1, 12))
    assert keys.shape == (len(at), sentences.RUN_WIDTH) and not len(sentences.run_places("plain words, no more")[0])


def test_split_dirty_rows(spark, model):
    rows = sentences.split_units(dirty(spark), model, "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert not {1, 2, 3} & set(by) and len(by[4]) == 1 and len(by[6]) == 20_000
    assert sentences.split_units(dirty(spark).limit(0), model, "id").count() == 0
    assert sentences.train([]).begins("One. Two.")[0] == 0  # an empty training set gives a model that still answers


# ---- languages ----


@pytest.fixture(scope="module")
def profiles(spark, sf, held):
    """Trained without the held-out sentences and without any text that holds one."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    out = {u for us in held.values() for u in us}
    docs = [r for r in read("documents").filter("modality = 'prose'").selectExpr("sonar_lang AS label", "text").collect() if r["text"] and not any(u in r["text"] for u in out)]
    refs = [r for r in read("lang_refs").collect() if r["text"] not in out]
    assert docs and len(refs) < 520
    return languages.train(spark.createDataFrame(refs), [spark.createDataFrame(docs, "label string, text string")])


def test_held_out_language(profiles, held):
    p, _ = profiles
    rows = [(lang, u) for lang, us in held.items() for u in us]
    ok = sum(st == [lang] for st, (lang, _) in zip(p.spoken_of([u for _, u in rows]), rows))
    assert ok / len(rows) > 0.9


def test_confidence_is_calibrated(profiles, held):
    """Among held-out sentences and their halves and quarters, the mean confidence is near the share that is right."""
    p, _ = profiles
    trials = [(lang, u[len(u) * i // n : len(u) * (i + 1) // n]) for lang, us in held.items() for u in us for n in (1, 2, 4) for i in range(n)]
    best = [max(st, key=lambda x: x[4]) if st else None for st in p.stretches_of([t for _, t in trials])]
    seen = [(b[6], p.names[b[2]] == lang) for b, (lang, _) in zip(best, trials) if b and b[2] >= 0]
    assert abs(sum(c for c, _ in seen) / len(seen) - sum(r for _, r in seen) / len(seen)) < 0.1
    assert all(0 <= c <= 1 for c, _ in seen)


def test_cosines_are_those_of_bundles(profiles, held):
    p, _ = profiles
    for t in [us[0] for us in held.values()] + [held["eng_Latn"][0] * 30]:
        bundle = np.zeros(languages.DIM)
        for w in languages._RUN.findall(t):
            gs = languages.word_grams(languages.plain_word(w))
            bundle += np.array([p.worth.get(g, 1.0) for g in gs]) @ languages.gram_vectors(gs).astype(float)
        true = p.protos @ bundle / np.linalg.norm(bundle)
        assert np.abs(p.cosines([t])[0][0] - true).max() < 0.01


def test_kept_words_change_no_answer(profiles, held, monkeypatch):
    p, _ = profiles
    texts = [" ".join(us) + f" zq{i}xv" for i, us in enumerate(held.values())]
    want = [p.stretches(t) for t in texts]
    monkeypatch.setattr(languages, "N_KEPT", 50)
    got = [p.stretches(t) for t in texts + texts[::-1]]
    assert got == want + want[::-1] and p.stretches_of(texts) == want


def test_mixed_text_and_labels(profiles, spark):
    p, labels = profiles
    en = "The sentence splitter keeps duplicate passages before the first question arrives."
    de = "Der Satztrenner überschreibt zwei Spalten mit Werten im zweiten Durchgang."
    st = p.stretches(f"{en}\n\n{de}")
    assert [p.names[x[2]] for x in st] == ["eng_Latn", "deu_Latn"] and all(0 < x[3] for x in st)
    fold = languages.fold_label
    assert {labels[fold(x)] for x in ("eng_Latn", "EN", " eng-Latn", "eng", "ENG_LATN")} == {"eng_Latn"}
    assert not any(fold(x) in labels for x in ("und", "n/a", "mul", "", " ", "xxx_Xxxx", None))
    rows = [(1, en, "en"), (2, en, "deu_Latn"), (3, f"{en} {de}", "eng"), (4, en, None), (5, None, "en"), (6, " ", "en"), (7, "12345", "en"), (8, "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in en), "en")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, label string, sonar_lang string")
    got = {(r[0], r[1]) for r in languages.missing_languages(df, p, labels, "id", "text", "label").collect()}
    assert got == {(2, "eng_Latn"), (3, "deu_Latn"), (4, "eng_Latn")}
    assert {r["id"] for r in languages.language_stretches(df, p, "id").collect()} == {1, 2, 3, 4, 7, 8}
    assert languages.language_stretches(dirty(spark).limit(0), p, "id").count() == 0
