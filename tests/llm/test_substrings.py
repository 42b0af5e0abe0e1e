import hashlib
import random

from newsloom.llm import substrings
from tests_llm import DATA, docs, same


def brute(rows, k=13):
    """rows: [(doc_id, text)], unique ids -> {doc_id: (n_words, n_removed, sha)}."""
    split = {d: (t or "").encode().split() for d, t in rows}
    first = {}
    for d in sorted(split):
        for i in range(len(split[d]) - k + 1):
            first.setdefault(tuple(split[d][i : i + k]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_matches_sql(spark, duck):
    same(spark, duck, substrings.op2_substrings, substrings.OP2_SQL)


def test_random_passages(spark):
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(8)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
        rows.append((d, rng.choice((" ", "\n", "  ")).join(w)))
    assert result(substrings.repeated_passages(docs(spark, rows))) == brute(rows)


def test_separators_do_not_matter(spark):
    rng = random.Random(12)
    between = lambda: rng.choice((" ", " ", "  ", "\n", "\n\n", "\r\n", "\n        ", "\t", " " * 40, "\n" * 300))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passages = [[word() for _ in range(rng.randint(13, 60))] for _ in range(8)]
    rows = []
    for d in range(80):
        w = [word() for _ in range(rng.randint(1, 20))] + rng.choice(passages) + [word() for _ in range(rng.randint(1, 20))]
        rows.append((d, "".join(x + between() for x in w)))
    assert result(substrings.repeated_passages(docs(spark, rows))) == brute(rows)


def test_edges_of_the_input(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    part = " ".join(f"w{i}" for i in range(100, 160))
    rows = [(5, None), (4, ""), (3, "one two"), (2, long), (9, part), (8, part + " tail"), (1, "w100 " + "x " * 20)]
    got = result(substrings.repeated_passages(docs(spark, rows)))
    assert got == brute(rows)
    assert substrings.repeated_passages(docs(spark, rows).limit(0)).count() == 0


def test_repeated_ids_and_no_id(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substrings.repeated_passages(docs(spark, [(1, t), (1, t), (None, t), (2, t)])).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (None, 20), (2, 20)], key=repr)


def test_texts_are_cut(spark):
    t = " ".join(f"w{i}" for i in range(20))
    d = docs(spark, [(1, t), (2, "a " + t + "  b"), (3, t), (4, "short  text")])
    out = substrings.without_repeats(d)
    assert out.columns == d.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {1: (t, len(t)), 2: ("a b", 3), 4: ("short  text", 11)}


def test_the_rest_of_the_table(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert result(substrings.op2_substrings(spark, DATA)) == brute(list(text.items()))


def test_branching_graph_and_cycles(spark):
    """Paths that fork and meet, words that go round, and sources that lie in different documents."""
    rng = random.Random(6)
    parts = [[f"p{i}w{j}" for j in range(rng.randint(3, 40))] for i in range(12)]
    ring = [f"r{j}" for j in range(17)]
    rows = [(d, " ".join(w for _ in range(rng.randint(1, 5)) for w in rng.choice(parts))) for d in range(60)]
    rows += [(100 + d, " ".join((ring * 6)[d * 5 : d * 5 + 40])) for d in range(8)]
    chain = [f"c{j}" for j in range(200)]
    rows += [(200 + d, " ".join(chain[d * 9 : d * 9 + 30])) for d in range(18)] + [(300, " ".join(chain))]
    assert result(substrings.repeated_passages(docs(spark, rows))) == brute(rows)
    spans = substrings.repeated_spans(docs(spark, rows)).collect()
    words = {d: t.split() for d, t in rows}
    for r in spans:
        assert r["source_doc_id"] < r["doc_id"] and r["n_words"] >= 13
        assert words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] == words[r["source_doc_id"]][r["source_start"] : r["source_start"] + r["n_words"]]
    last = sorted((r["offset"], r["unitig"]) for r in spans if r["doc_id"] == 300)
    assert len({u for _, u in last}) == 1 and [o for o, _ in last] == sorted({o for o, _ in last})  # one path through all sources


def test_equal_hashes_of_different_words(spark):
    """With hashes of eight bits very many windows collide: their words decide."""
    rng = random.Random(8)
    passages = [[f"{i}.{j}" for j in range(rng.randint(13, 30))] for i in range(5)]
    rows = [(d, " ".join([f"x{rng.randrange(99)}" for _ in range(rng.randint(1, 9))] + rng.choice(passages) + rng.choice(passages)[:15])) for d in range(40)]
    assert result(substrings.repeated_passages(docs(spark, rows), bits=8)) == brute(rows)


def test_clashing_columns(spark):
    t = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(1, t, "a", 7, "x", 1), (2, t + " z", "b", 8, "y", 2), (None, None, None, None, None, None)], "doc_id long, text string, row string, n_words int, kept_text string, _row int")
    out = substrings.without_repeats(d)
    assert out.columns == d.columns
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([(1, t, "a", 7, "x", 1), (2, "z", "b", 8, "y", 2), (None, None, None, None, None, None)], key=repr)
