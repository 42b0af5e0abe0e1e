"""Personal data: base patterns as written, added spans on texts with known answers, calibration, redaction, edges."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from newsloom.llm import pii, queries
from tests_llm import DATA, docs

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    """The base patterns exactly as they are written."""
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m.group())
            good = [
                lambda: True,
                lambda: all(int(x) <= 255 for x in m.group().split(".")),
                lambda: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                lambda: 10 <= len(d) <= 15,
            ][kind]()
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


def test_base_patterns_as_written():
    r, found = random.Random(5), 0
    for _ in range(20_000):
        text = "".join(r.choices("0123456789" * 2 + "..@ -+()aé%_", k=r.randint(0, 40)))
        want = brute(text)
        found += len(want)
        assert pii.base_spans(text) == want, text
    assert found > 1000


def test_scans_are_linear():
    for unit in ("1", "a", "1.2.", "a@", "+1", "+1 (", "a at b.c ", "::", "1:", "(", "1[.]", "a (at) "):
        text = unit * (300_000 // len(unit))
        began = time.time()
        pii.base_spans(text)
        n = sum(1 for _ in pii.candidates(text))
        assert time.time() - began < 20, (unit, n)


def test_texts_with_known_answers(model):
    hit = wrong = missed = 0
    for seed in range(300):
        text, gold = pii.Writer(seed).text()
        base = pii.base_spans(text)
        added = {s for s, _ in model.added(text, base)}
        gold -= set(base)
        hit, wrong, missed = hit + len(added & gold), wrong + len(added - gold), missed + len(gold - added)
    assert hit > 500 and wrong <= 0.03 * hit and missed <= 0.1 * hit


@pytest.mark.parametrize("text, span, kind", [
    ("write to anna.lee [at] example [dot] com today", "anna.lee [at] example [dot] com", "email"),
    ("mail: bob at example dot org", "bob at example dot org", "email"),
    ("the server 203[.]0[.]113[.]7 answers", "203[.]0[.]113[.]7", "ip"),
    ("host 2001:db8:85a3:0:0:8a2e:370:7334 is up", "2001:db8:85a3:0:0:8a2e:370:7334", "ip"),
    ("card 4111.1111.1111.1111 was used", "4111.1111.1111.1111", "card"),
    ("please call (555) 123-4567 now", "(555) 123-4567", "phone"),
])
def test_added_spans(model, text, span, kind):
    assert [(text[s:e], pii.KINDS[k]) for (s, k, e), _ in model.added(text, pii.base_spans(text))] == [(span, kind)]


@pytest.mark.parametrize("text", ["on 2024-05-17 at 10:20:30 we met at home. The", "version 1.20.3 of 1990-1995", "token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\"", "ISBN 978-3-16-148410-0", "4111.1111.1111.1112 is no card", "look at the dot there"])
def test_clean_texts_stay(model, text):
    assert pii.base_spans(text) == [] and model.added(text, []) == []


def test_calibration_against_brute_force():
    r = np.random.default_rng(3)
    score = r.integers(0, 40, 300) / 40
    label = (r.random(300) < score).astype(float)
    (start, p), least = pii.calibrated(score, label, 0.8)
    value = {}
    xs = np.unique(score)
    y = {x: (label[score == x].sum(), (score == x).sum()) for x in xs}
    for k, x in enumerate(xs):  # isotonic regression as max over lower ends of min over upper ends of means
        mean = lambda a, b: sum(y[v][0] for v in xs[a : b + 1]) / sum(y[v][1] for v in xs[a : b + 1])
        value[x] = max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1))
    got = [p[np.searchsorted(start, x, "right") - 1] for x in xs]
    assert np.allclose(got, [value[x] for x in xs])
    assert label[[value[x] >= least for x in score]].mean() >= 0.8


def test_disjoint_against_brute_force():
    r = random.Random(2)
    for _ in range(300):
        spans = list({(a := r.randint(0, 30), r.randint(0, 3), a + r.randint(1, 8)) for _ in range(r.randint(0, 12))})
        score = np.array([r.choice((0.3, 0.6, 0.7, 0.9)) for _ in spans])
        taken = []
        for i in sorted(range(len(spans)), key=lambda i: (-score[i], spans[i][0] - spans[i][2], spans[i])):
            if score[i] >= 0.5 and all(spans[i][2] <= s or spans[i][0] >= e for s, _, e in taken):
                taken.append(spans[i])
        assert [s for s, _ in pii.disjoint(spans, score)] == sorted(taken)
        base = sorted(spans[:3])
        assert pii.free(base, set(spans)) == sorted(c for c in spans if all(c[2] <= s or c[0] >= e for s, _, e in base))


def test_query(spark, model):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_pii"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        base, mine = brute(r["text"] or ""), got[r["doc_id"]]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert mine["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [mine[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        spans = [x.split(":") for x in mine["spans"].split(",") if x]
        assert set(text.split(",")) - {""} <= set(mine["spans"].split(","))
        order = [(int(s), pii.KINDS.index(k)) for k, s, _ in spans]
        assert order == sorted(order)


def test_edges_and_redaction(spark, model):
    mail = "a@b.co"
    long = "word " * 200_000 + mail
    d = docs(spark, [None, "", f"é😀 {mail}, {mail}", long, "+1 (743) 555-3824 190.137.223.204", (2, f"é😀 {mail}, {mail}")]).selectExpr("*", "1 as base", "2 as added")
    got = {r["doc_id"]: r for r in pii.find(d.drop("base", "added"), model).collect()}
    assert got[0]["base"] == got[1]["base"] == got[0]["added"] == []
    assert [(s["start"], s["end"]) for s in got[2]["base"]] == [(3, 9), (11, 17)]
    assert [(s["start"], s["end"]) for s in got[3]["base"]] == [(1_000_000, 1_000_006)]
    assert pii.find(d, model).count() == 6
    text = {r["doc_id"]: r["text"] for r in pii.redacted(d, model).collect()}
    assert text[0] == text[1] == "" and text[2] == "é😀 [EMAIL], [EMAIL]" and text[3].endswith("word [EMAIL]")
    assert pii.find(d.limit(0), model).count() == pii.redacted(d.limit(0), model).count() == 0
