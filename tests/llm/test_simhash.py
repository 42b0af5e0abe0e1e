import random
import re

import numpy as np
import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.operators.components import components
from tests_llm import DATA, docs


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, budget=4):
    """prints: [(id, fp)] -> smallest id reachable, per row."""
    label = [i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for x in range(len(prints)):
            for y in range(x):
                if (prints[x][1] ^ prints[y][1]).bit_count() <= budget and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    return label


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One two THREE", "É a b c d É", "a b c d " * 300, "x\x85y\xa0z w v u"])
def test_fingerprint(text):
    assert simhash.text_fingerprint(text) == brute_print(text)


def test_whole_table(spark):
    got = simhash.op1_simhash(spark, DATA).orderBy("doc_id").collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = [(r["doc_id"], brute_print(text[r["doc_id"]])) for r in got]
    assert [r["fingerprint"] for r in got] == [f"{p:016x}" for _, p in prints]
    assert [r["component_id"] for r in got] == brute_components(prints)


def test_trie_walk_finds_all_links():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in base for _ in range(40)})
    v = np.array(values, np.uint64)
    i, j = simhash.trie_links(v, np.zeros(len(v), np.int64), 4)
    root = simhash.roots(len(v), i, j)
    want = brute_components(list(enumerate(values)))
    assert root.tolist() == want


def test_hot_group_is_split(spark):
    """A dense group larger than the limit gives the same components."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(40), 6)) for _ in range(250)} | {rng.getrandbits(64) for _ in range(30)}
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in sorted(values)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = components(simhash.links_within(frame, 4, most=40)).collect()
    label = {r["node"]: r["label"] for r in found}
    want = brute_components([(x, x & (2**64 - 1)) for x in signed])
    group = {}
    for x, w in zip(signed, want, strict=True):
        group.setdefault(w, set()).add(x)
    for members in group.values():
        assert len({label.get(x, x) for x in members}) == 1
    assert len({label.get(x, x) for x in signed}) == len(group)


def test_edges_of_the_input(spark):
    d = docs(spark, [(3, None), (1, ""), (None, "  "), (7, "a b c d e f"), (7, "a b c d e f"), (9, "Z " * 20000)])
    d = d.withColumn("fp", d.doc_id).withColumn("component_id", d.doc_id)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(d).collect()), key=repr)
    assert got == sorted([(3, 1), (1, 1), (None, 1), (7, 7), (7, 7), (9, 9)], key=repr)
    assert simhash.simhash_components(d.limit(0)).count() == 0
    left = simhash.near_duplicates(d)
    assert left.columns == d.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "7", "7", "9", "None"]


def test_clashing_columns(spark):
    d = docs(spark, [(1, "a b c d e"), (2, "a b c d e"), (3, "v w x y z")])
    for c in ("_gone", "component_id", "fp"):
        d = d.withColumn(c, d["doc_id"] + 1)
    out = simhash.near_duplicates(d)
    assert out.columns == d.columns and sorted((r["doc_id"], r["_gone"]) for r in out.collect()) == [(1, 2), (3, 4)]


def test_a_chain_of_revisions(spark):
    """Each fingerprint is four bits from the one before; the ids are in another order than the chain."""
    r = random.Random(9)
    chain = [r.getrandbits(64)]
    while len(chain) < 500:
        nxt = chain[-1]
        for b in r.sample(range(64), 4):
            nxt ^= 1 << b
        chain.append(nxt)
    signed = [v - 2**64 if v >= 2**63 else v for v in chain]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components(simhash.links_within(frame, 4)).collect()
    assert {x["node"] for x in found} == set(signed) and {x["label"] for x in found} == {min(signed)}
