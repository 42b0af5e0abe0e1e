"""Language, toxicity and main text: held-out figures, and the input's edges."""

import time
import zlib
from collections import Counter

import numpy as np
import pytest
from newsloom.llm import dom, html, langid, toxicity
from tests_llm import docs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    return langid.trained_on(spark.read.parquet(f"{SF}/documents.parquet"))


def test_language_of_held_out_documents(spark, languages):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.predict(d, languages, ("doc_id", "lang")).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) == d.count() and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98


def test_language_edges(spark, languages):
    d = docs(spark, [None, "", "123 !?", "the", "der " * 30000, "\0\0"]).selectExpr("*", "'x' as score", "1 as lang_pred")
    got = {r["doc_id"]: r for r in langid.predict(d, languages).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.with_language(d, languages)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {3, 4}
    assert langid.predict(d.limit(0), languages).count() == 0


def test_no_labels_and_very_many_languages(spark):
    d = spark.createDataFrame([(i, f"abc def {i}", None) for i in range(9)] + [(10, None, "en"), (11, "12", None)], "doc_id long, text string, lang string")
    for some in (d, d.limit(0)):
        model = langid.trained_on(some)
        assert {(r["lang_pred"], r["score"]) for r in langid.predict(some, model).collect()} <= {("und", 0.0)}
        assert langid.with_language(some, langid.with_limit(some)).count() == some.where("doc_id < 10").count()
    letters = [chr(0x4E00 + k) for k in range(140)]
    d = spark.createDataFrame([(100 * k + i, f"{c}{c} {c}abc{c} {c}{i}" * 5, f"l{k}") for k, c in enumerate(letters) for i in range(4)], "doc_id long, text string, lang string")
    model = langid.train(d)
    assert len(model.names) == 140 and len(model.masks) == 3
    got = langid.predict(d, model, ("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_letters():
    code = langid.letters()
    assert all((code[i] == i) == chr(i).isalpha() for i in range(1, 0x30000) if i != langid.BLANK)


def test_false_positives_are_corrected(languages):
    assert all(0 <= r < 0.05 for r in languages.rate)
    name, score = languages.predict(["the and of the", "und der die"])
    assert name == ["en", "de"] and (score > 0.3).all()


@pytest.fixture(scope="module")
def toxic(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(d, toxicity.training_labels(labels))


def test_toxicity_of_held_out_documents(spark):
    """Over sf0.1: sf0.01 holds out six toxic documents, two of them in words that no training document tells."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, toxicity.training_labels(labels))
    rows = [r for r in toxicity.toxicity(d, model).join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    bad, good = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    area = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert area >= 0.95 and len(bad) > 90
    assert sum(b >= 0.5 for b in bad) >= 0.85 * len(bad) and sum(g >= 0.5 for g in good) <= 0.01 * len(good)


def test_small_letters_keep_their_places():
    text = "ÀÉÜ ЖЯ ΩΣ İß × ǅ Ꙗ aZ"
    got = toxicity.small(np.frombuffer(text.encode(), np.uint8))
    want = "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) == 2 or "A" <= c <= "Z" else c for c in text).encode()
    assert all(int(x) in (y, 0) for x, y in zip(got, want, strict=True)) and bytes(got[:6]).decode() == "àéü"


def test_offending_sentences(spark, toxic):
    text = "The and of it. É you are an idiot and a moron, loser. On the in!\nof"
    d = docs(spark, [text, None, "", "nothing at all", "the of. " * 20000]).selectExpr("*", "1 as score")
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, toxic).collect()}
    found = [text.encode()[s["start"] : s["end"]].decode().strip() for s in got[0]["offending"]]
    assert found == ["É you are an idiot and a moron, loser."]
    assert got[0]["score"] >= 0.5 and got[1]["score"] == got[2]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(d.limit(0), toxic).count() == 0


@pytest.mark.parametrize("n", [10, 100, 10_000, 100_000])
def test_length_is_not_toxicity(spark, toxic, n):
    clean = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id").collect() if r["text"]]
    real = "\n".join(clean * (1 + n // len(clean)))[: n * 40]
    plain = "a quiet line of words. " * n
    insult = "word of the day. " * (n // 2) + "You are an idiot and a moron, loser. " + "it is at the. " * (n // 2)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(spark, [plain, real, insult]), toxic).collect()}
    assert got[0]["score"] < 0.5 and got[1]["score"] < 0.5
    assert got[2]["score"] >= 0.5 and len(got[2]["offending"]) == 1


def test_noisy_or_against_brute_force(toxic):
    r = np.random.default_rng(4)
    w, b, leak = r.normal(0, 2, 6), -1.0, -3.0
    docs_ = [[[0, 1], [2]], [[3]], [], [[4, 5, 0], [1]], [[2, 3]]]
    y = np.array([1.0, 0, 0, 1, 1])
    weight = r.random(5)
    inst, feat, owner = [], [], []
    for d, sentences in enumerate(docs_):
        for f in sentences:
            inst += [len(owner)] * len(f)
            feat += f
            owner.append(d)
    inst, feat, owner = map(np.array, (inst, feat, owner))

    def likelihood(x):
        total, one = 0.0, lambda z: 1 / (1 + np.exp(-z))
        for d, sentences in enumerate(docs_):
            none = 1 - one(x[-1])
            for f in sentences:
                none *= 1 - one(x[-2] + sum(x[k] for k in f))
            total += weight[d] * np.log(1 - none if y[d] else none)
        return total

    x = np.r_[w, b, leak]
    value, grad = toxicity.slope(w, b, leak, inst, feat, owner, y, weight)
    assert np.isclose(value, likelihood(x))
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = 1e-6
        assert np.isclose(grad[k], (likelihood(x + e) - likelihood(x - e)) / 2e-6, atol=1e-6)
    clean = np.log1p(-np.array([0.6, 0.7, 0.1, 0.3, 0.15, 0.05]))
    got = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -6.0, -4.0).documents(clean, np.array([0, 0, 0, 1, 1, 2]), 4)
    leak = 1 / (1 + np.exp(4.0))
    assert np.allclose(got, [1 - (1 - leak) * 0.4 * 0.3, 1 - (1 - leak) * 0.7, 1 - (1 - leak) * 0.95, 0.0])


def test_nothing_to_learn_from(spark):
    d = docs(spark, ["a", "b"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] < 0.5 for r in toxicity.toxicity(d, toxicity.train(d, none)).collect()] == [True, True]


@pytest.fixture(scope="module")
def trees(spark):
    return html.train(spark, pages=500, rounds=25)


def test_pages_of_many_templates(trees):
    scores = []
    for seed in range(200):
        page = html.Writer(seed).page()
        gold = " ".join(s for _, _, s in dom.parse(page).text if html.MARK not in s and not s.startswith("&copy")).split()
        got = html.main_text(page.replace(html.MARK, ""), trees).split()
        common = sum((Counter(gold) & Counter(got)).values())
        scores.append(2 * common / max(1, len(gold) + len(got)))
    assert sum(scores) / len(scores) >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<nav class=menu><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>Head &amp; line</h1><p>First <b>para</b>graph\n with  a long text that goes on, and on.<br>Next line.<p>Second &lt;one&gt; &#233;&nbsp;end of it, with more words.</p>
<!-- <p>hidden</p> --><div class="ad">Buy now</div></article><section class="comments"><h3>Comments</h3><div class=comment><p>I disagree with this.</p></div></section><footer>&copy; site</footer></body></html>"""


def test_one_page(trees):
    assert html.main_text(PAGE, trees) == "Head & line First paragraph with a long text that goes on, and on. Next line. Second <one> é end of it, with more words."


def test_pages_cut_inside_a_tag():
    for page in ("<p>text</p><a " + "x='1' y=\"2\" " * 5000, "<p>text</p>" + "<a b=\"" * 50_000, "<p>text</p>" + "<div>" * 30_000 + "</p>" * 30_000, "<p>text</p>" + "<b><p>" * 20_000, "<p>text</p><a title='it's \"" + "=" * 100_000):
        began = time.time()
        t = dom.parse(page)
        assert "".join(s for _, _, s in t.text).startswith("text") and time.time() - began < 5
    t = dom.parse("<p a=\"x>y\" b='<'>one</p> 1 < 2 <i>two</i><b c=\"> three</b> four <u")
    assert "".join(s for _, _, s in t.text) == "one 1 < 2 two three four "


def test_declarations_that_never_end_take_linear_time():
    for unit in ("<!", "<?", "<! ", "<!-", "<", "</", "<a "):
        page = "<p>text</p>" + unit * (1_000_000 // len(unit))
        began = time.time()
        t = dom.parse(page)
        assert "".join(s for _, _, s in t.text).startswith("text") and time.time() - began < 20, unit


def test_groups_of_nodes_change_nothing(spark, trees):
    pages = [(i, "u", html.Writer(500 + i).page().replace(html.MARK, "")) for i in range(12)] + [(50, "u", "<p>" + "<i>a </i>" * 30_000), (51, "u", None)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(d, trees).collect()}
    assert got == {i: html.main_text(p, trees) for i, _, p in pages}


def test_page_edges(spark, trees):
    deep = "<div>" * 3000 + "text" + "</div>" * 10
    rows = [(1, None), (2, ""), (3, "no markup, only a line of text."), (4, "<p>" + "word " * 60000), (5, "</p></div><<<>"), (6, deep), (7, "<article><p>a < b and c</p>")]
    d = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(d, trees).collect()}
    assert len(got) == 7 and got[1] == got[2] == ""
    assert all(t is not None and not t.startswith(" ") for t in got.values())
    assert html.extract(d.limit(0), trees).count() == 0


def test_a_kept_node_keeps_what_is_below():
    t = dom.parse("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    p = np.full(len(t.tag), 0.1)
    p[1:4] = (0.9, 0.9, 0.48)
    assert dom.chosen_text(t, dom.decode(t, p)) == "a b"
