"""Merkle manifest: against a plain tree in Python and against SQL; shapes of trees, edges, tampering."""

import zlib
from hashlib import sha256

import pytest
from newsloom.llm import manifest, queries
from tests_llm import same


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    text = row[4]
    if low and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text), from whole trees in memory."""

    def tree(nodes):
        paths, groups, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
        while len(level) > 1:
            up, own = [], []
            for i in range(0, len(level), 16):
                run = level[i : i + 16]
                for k in range(len(run)):
                    for x in groups[i + k]:
                        paths[x].append((run[:k], run[k + 1 :]))
                up.append(H(*run))
                own.append([x for g in groups[i : i + 16] for x in g])
            level, groups = up, own
        return (level[0] if level else None), paths

    none = lambda v: (v is not None, v)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    part = [sorted((r for r in rows if r[1] == s), key=lambda r: (none(r[0]), leaf(r))) for s in sources]
    sub = [tree([leaf(r) for r in p]) for p in part]
    root, above = tree([s for s, _ in sub])
    out = []
    for p, (top, paths), over in zip(part, sub, above, strict=True):
        for r, path in zip(p, paths, strict=True):
            whole = path + over
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest = leaf(r, bad)
            for left, right in whole:
                digest = H(*left, digest, *right)
            out.append((r[0], leaf(r), top, root, H(*(x for left, right in whole for x in left + right)), digest))
    return out


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17], [1, 256, 257, 3], [700, 1, 15] + [1] * 20])
def test_against_a_plain_tree(spark, sizes):
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n * 7 % 1009, None if k == 0 else f"s{k}", "en" if n % 3 else None, n, None if n % 11 == 0 else f"Text Ä {n}"))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as tree", "2 as at", "3 as leaf")
    got = manifest.Manifest(manifest.leaves(d, manifest.tampered())).proofs().collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, plain(rows)))
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert sum(not r["verified"] for r in got) == sum(r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows)


def test_edges(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    empty = manifest.Manifest(manifest.leaves(spark.createDataFrame([], kind), manifest.tampered()))
    assert empty.root is None and empty.proofs().count() == 0
    rows = [(1, "a", None, None, None), (1, "a", None, None, None), (None, None, "", 0, ""), (None, None, None, None, "A" * 2_000_000), (2, "b", "x", 1, "ÄB")]
    got = manifest.Manifest(manifest.leaves(spark.createDataFrame(rows, kind))).proofs().collect()
    assert len(got) == 5 and all(r["verified"] for r in got)
    want = plain(rows)
    assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(repr(w[:5]) for w in want)


def test_only_every_second_level_is_stored(spark):
    d = spark.range(5000).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "'t' as text")
    m = manifest.Manifest(manifest.leaves(d))
    assert [t.count() for t in m.levels] == [5000, 20, 1]
    assert all(r["verified"] for r in m.proofs().collect())


def test_matches_sql(spark, duck):
    same(spark, duck, queries.QUERIES["op12_manifest"], queries.ORACLE["op12_manifest"])
