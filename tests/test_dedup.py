import hashlib
import random
import re
from difflib import SequenceMatcher

import numpy as np
from helpers import DATA, rows
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import dedup, resolve
from newsloom.sources import views


def fingerprint(text):
    v = [0] * 64
    for token in text.lower().split():
        h = int(hashlib.md5(token.encode()).hexdigest(), 16)
        for i in range(64):
            v[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if v[i] > 0)


def test_greedy_near_duplicates_in_order(spark):
    news = [(r["id"], r["content"]) for r in views.news(spark, DATA).select("id", "content").orderBy("id").collect()]
    for t in (3, 4):
        kept, want = [], set()
        for i, text in news:
            h = fingerprint(text)
            if all((h ^ k).bit_count() > t for k in kept):
                kept.append(h)
                want.add(i)
        got = {r["id"] for r in dedup.dedup_news(views.news(spark, DATA), t).where("kept").collect()}
        assert got == want


def test_greedy_is_not_components(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    near = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert rows(dedup.greedy_leaders(ids, near)) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_similar_events_fold_into_the_earliest(spark):
    e = spark.createDataFrame([(1, "storm hits coast", ["a"], "s1"), (2, "storm hits coasts", ["b"], "s2"), (3, "vote held", ["c"], "s1")], "id int, abstract string, entities array<string>, source string")
    assert rows(dedup.merge_similar_events(e, 0.8).select("leader", "n", "entities", "sources")) == [(1, 2, ["a", "b"], ["s1", "s2"]), (3, 1, ["c"], ["s1"])]


def test_name_similarity(spark):
    d = spark.createDataFrame([("a b", "a b"), ("A-B", "ab"), ("北京", "Beijing")], "a string, b string")
    got = [r[0] for r in d.select(dedup.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.98, 0.0]


def test_first_fit_buckets(spark):
    e = spark.createDataFrame([("a", "2024-01-01", ["x"]), ("b", "2024-01-02", ["y"]), ("c", "2024-01-03", ["x", "y"]), ("d", "2024-03-01", ["x"])], "event_id string, time string, entities array<string>").withColumn("time", F.to_timestamp_ntz("time"))
    got = dict(rows(dedup.bucket_events(e, 7, 1, 50)))
    assert got["a"] == got["c"] != got["b"] and got["d"] not in (got["a"], got["b"])


def test_redirects_close_and_cycles_stay(spark):
    r = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (7, 5), (8, 8)], "from_id int, to_id int")
    assert rows(resolve.resolve_redirects(r)) == [(1, 4), (2, 4), (3, 4)]


def test_merged_edges_have_no_loops(spark):
    e = spark.createDataFrame([(1, 2, "follows", 0.1, 5), (3, 2, "follows", 0.9, 7), (1, 3, "causes", 0.5, 1)], "from_id int, to_id int, edge_type string, confidence double, time int")
    c = spark.createDataFrame([(3, 1)], "from_id int, to_id int")
    assert rows(resolve.merge_event_edges(e, c)) == [(1, 2, "follows", 0.9, 5)]


def test_refresh_does_not_mix_types(spark):
    e = spark.createDataFrame([("1", "Acme", 3), ("2", "acme", 1), ("3", "甲公司", 1), ("4", "甲公司市", 1)], "entity_id string, name string, first_seen int")
    none = spark.createDataFrame([], "from_id string, to_id string")
    rules = spark.createDataFrame([], "alias string, primary string")
    assert rows(resolve.refresh(e, none, rules, 0.9)) == [("1", "2")]


def test_long_chains_and_cycles(spark):
    r = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (301, 300)], "from_id long, to_id long")
    assert rows(resolve.resolve_redirects(r)) == sorted([(i, 100) for i in range(100)] + [(301, 300)], key=repr)
    assert resolve.resolve_redirects(r.limit(0)).count() == 0


def test_chains_of_near_rows(spark):
    ids = spark.createDataFrame([(i,) for i in range(12)], "id long")
    near = spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    assert sorted(tuple(r) for r in dedup.greedy_leaders(ids, near).collect()) == [(i, i - i % 2) for i in range(12)]


def test_equal_names_follow_the_first(spark):
    n = spark.createDataFrame([(1, "Anna Smith"), (2, "Bob Jones"), (3, "Anna Smyth"), (4, "Anna Smyth"), (5, "Bob Jones")], "id long, name string")
    assert rows(dedup.precluster(n, 0.93)) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 2)]


def greedy(texts, near):
    """Each id's leader, row after row."""
    leaders, out = [], []
    for i, t in texts:
        lead = next((j for j, u in leaders if near(u, t)), i)
        if lead == i:
            leaders.append((i, t))
        out.append((i, lead))
    return sorted(out)


def variants(n, seed=7):
    """Texts of few words with letters changed anywhere, the first ones too, repeats, an empty one and other scripts."""
    r = random.Random(seed)
    base = ["the storm hit the northern coast", "a vote was held in parliament", "Anna Maria Smith", "Acme Corp.", "北京大学", "aab"]
    out = ["", "Acme-Corp", "ACME corp", "北京 大学"]
    while len(out) < n:
        t = list(r.choice(base))
        for _ in range(r.randrange(5)):
            i = r.randrange(len(t))
            t[i : i + r.randrange(2)] = r.choice("abst 1北")
        out.append("".join(t))
    r.shuffle(out)
    return list(enumerate(out))


def test_events_merge_as_row_after_row(spark):
    texts = variants(150)
    e = spark.createDataFrame([(i, t or None, ["x"], "s") for i, t in texts], "id long, abstract string, entities array<string>, source string")
    for least in (0.6, 0.8):
        want = greedy(texts, lambda u, t: SequenceMatcher(None, t, u).ratio() >= least)  # noqa: B023
        n = {}
        for _, lead in want:
            n[lead] = n.get(lead, 0) + 1
        assert rows(dedup.merge_similar_events(e, least).select("leader", "n")) == rows(spark.createDataFrame(list(n.items()), "leader long, n long"))
    assert dedup.merge_similar_events(e.limit(0)).count() == 0


def h14(a, b):
    letters = lambda t: "".join(c for c in t if c.isalnum() or c == "_").lower()
    han = lambda t: any("\u4e00" <= c <= "\u9fff" for c in t)
    if a == b:
        return 1.0
    if letters(a) and letters(a) == letters(b):
        return 0.98
    jw = dedup.jaro_winkler_of(a.lower(), b.lower())
    return jw * 0.3 if han(a) != han(b) else jw


def test_names_cluster_as_row_after_row(spark):
    texts = variants(150, 11)
    n = spark.createDataFrame([*texts, (900, None)], "id long, name string")
    for least in (0.75, 0.93):
        want = greedy(texts, lambda u, t: h14(u, t) >= least)  # noqa: B023
        assert sorted(tuple(r) for r in dedup.precluster(n, least).collect()) == want
    e = spark.createDataFrame([(1, "Storm hits", "the coast"), (2, "storm hits", "the coasts"), (3, "Vote", None)], "id long, abstract string, summary string")
    assert rows(dedup.precluster_events(e)) == [(1, 1), (2, 1), (3, 3)]


def test_first_fit_is_exact_over_components(spark):
    r = random.Random(3)
    day = [r.randrange(60) for _ in range(120)]
    events = [(f"e{i:03}", d, sorted({f"x{r.randrange(40)}" for _ in range(r.randrange(4))})) for i, d in enumerate(day)]
    e = spark.createDataFrame(events, "event_id string, day int, entities array<string>").select("event_id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(day)").alias("time"), "entities")
    for overlap, most in ((0, 6), (1, 3), (2, 50)):
        buckets = []
        for ident, d, ents in sorted(events, key=lambda x: (x[1], x[0])):
            for b in buckets:
                if len(b["ids"]) < most and d - b["hi"] <= 2 and (overlap == 0 or len(b["e"] & set(ents)) >= overlap):
                    break
            else:
                b = {"ids": set(), "e": set(), "hi": d}
                buckets.append(b)
            b["ids"].add(ident)
            b["e"] |= set(ents)
            b["hi"] = d
        got = {}
        for ident, b in dedup.bucket_events(e, 2, overlap, most).collect():
            got.setdefault(b, set()).add(ident)
        assert sorted(map(sorted, got.values())) == sorted(sorted(b["ids"]) for b in buckets)


def test_pairs_similar_against_all_pairs(spark):
    names = ["Harbour storm", "harbour  storm", "Harbour storms", "Harbour star", "Harbours", "", None, "Harbour storm", "Market storm"]
    got = resolve.pairs_similar(spark.createDataFrame(list(enumerate(names)), "id int, name string"))
    plain = [(n or "").strip().lower().replace(" ", "") for n in names]
    want = []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            score = SequenceMatcher(None, plain[a], plain[b]).ratio()
            if plain[a][:6] == plain[b][:6] and score >= 0.92:
                want.append((a, b, round(score, 9)))
    assert sorted((r.a, r.b, round(r.score, 9)) for r in got.collect()) == want
    assert (0, 2, round(24 / 25, 9)) in want


def test_history_is_skipped_before_the_fingerprints(spark):
    texts = ["one two three four", "one two three four", "five six seven", None]
    news = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id int, source string, content string")
    done = spark.createDataFrame([("s", "0")], "source string, id string").select(expr.global_id(F.col("source"), F.col("id")).alias("global_id"))
    kept, counts = dedup.dedup_with_history(news, done)
    assert sorted(r.id for r in kept.collect()) == [1, 2]  # the first text's copy now comes first
    assert [tuple(r) for r in counts.collect()] == [(4, 2, 2)]


def test_primary_of_equal_names_is_the_smallest_id(spark):
    rows = [("g", i, "Name", 3) for i in (7, 2, 5)]
    got = resolve.choose_primary(spark.createDataFrame(rows, "leader string, id int, name string, first_seen int"))
    assert [r.primary for r in got.collect()] == [2]


def test_a_long_chain_as_row_after_row(spark):
    """100,000 rows, each near the next: every second one stays."""
    n = 100_000
    ids = spark.range(n)
    near = ids.where(f"id < {n - 1}").selectExpr("id as a", "id + 1 as b")
    got = dedup.greedy_leaders(ids, near)
    assert got.count() == n and got.where("leader <> id - id % 2").count() == 0


def test_rounds_and_replay_agree(spark):
    rng = random.Random(3)
    for n, pairs in ((60, 90), (200, 150), (40, 300)):
        edges = sorted({(min(x), max(x)) for x in ((rng.randrange(n), rng.randrange(n)) for _ in range(pairs)) if x[0] != x[1]})
        kept, want = set(), []
        for b in range(n):
            low = [a for a, c in edges if c == b and a in kept]
            kept |= set() if low else {b}
            want.append((b, min(low, default=b)))
        ids = spark.range(n)
        near = spark.createDataFrame(edges, "a long, b long")
        for most in (0, 20, 10**6):
            assert sorted(tuple(r) for r in dedup.greedy_leaders(ids, near, most).collect()) == want


def test_similar_names_against_all_pairs_of_a_block(spark):
    from newsloom.plans import resolve as plans

    names = [r["abstract"] for r in views.mentions(spark, DATA).select("abstract").distinct().collect()]
    plain = {n: re.sub(r"[\s·•\-_.,，。（）()\[\]{}\"']", "", n.lower()) for n in names}
    want = set()
    for x in names:
        for y in names:
            if x < y and plain[x][:6] == plain[y][:6] and SequenceMatcher(None, plain[x], plain[y]).ratio() >= 0.92:
                want.add((x, y))
    got = {(r["a"], r["b"]) for r in plans.QUERIES["C15_pairs_similar"](spark, DATA).collect()}
    assert got == want and want


def test_semantic_matches_in_pruned_tiles(spark, monkeypatch):
    """Clusters far apart: the same matches as all pairs, and most tiles are left out."""
    monkeypatch.setattr(resolve, "CELL", 16)
    r = np.random.default_rng(7)
    centre = r.normal(size=(12, 8))
    vectors = [(i, (centre[i % 12] + 0.05 * r.normal(size=8)).tolist(), i % 2) for i in range(400)] + [(400, [0.0] * 8, 0), (401, None, 0), (402, [1.0] * 8, None)]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in vectors[:400]}
    for least in (0.97, 0.8, 0.3):
        stats = []
        got = {(x["query_id"], x["vec_id"]): x["score"] for x in resolve.semantic_matches(d.where("vec_id % 5 = 0"), d, least, "label", stats).collect()}
        want = {(a, b): (unit[a] @ unit[b] + 1) / 2 for a in range(0, 400, 5) for b in range(400) if a != b and a % 2 == b % 2 and (unit[a] @ unit[b] + 1) / 2 >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        if least == 0.97:
            assert stats[0]["kept"] < 0.5 * stats[0]["tiles"]
