import gzip
import hashlib
import math
import uuid

import numpy as np
import pytest
from newsloom.llm import search, warc
from tests_llm import DATA, same


@pytest.mark.parametrize("query, sql", [(search.op4_topk, search.OP4_SQL), (warc.op5_warc, warc.OP5_SQL)])
def test_matches_sql(spark, duck, query, sql):
    same(spark, duck, query, sql)


def brute(queries, rows, k):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    out = []
    for qid, q in queries:
        if not ok(q):
            continue
        score = [(-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, v, strict=True)), i) for i, v in rows if i is not None and i != qid and ok(v) and len(v) == len(q)]
        out += [(qid, r + 1, i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


def test_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4]) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 2.0]), (2003, [1.0, float("nan"), 2.0]), (2004, [1.0, float("inf"), 2.0]), (2005, [1.0, 2.0]), (2006, [1e12, 1e12, -3e11]), (2100, [1e12, 1.5, 2.5]), (None, [1.0, 1.0, 1.0])]
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 as score", "2 as width")
    asked = df.where("vec_id % 300 = 0 or vec_id = 2002")
    rows = [r for r in rows if r[0] not in (2006, 2100)]
    df = df.where("vec_id is null or vec_id not in (2006, 2100)")
    asked = asked.where("vec_id <> 2100")
    got = sorted(tuple(r) for r in search.top_k(asked, df, 10).collect())
    assert got == brute([r for r in rows[:1509] if r[0] is not None and (r[0] % 300 == 0 or r[0] == 2002) and r[0] != 2100], rows, 10)
    assert search.top_k(asked, df.limit(0), 10).count() == 0


def test_large_numbers_stay_exact():
    a = np.floor(np.array([[2.0**33 + 1, 3.0]])), np.floor(np.array([[2.0**28 + 1, 5.0]]))
    assert search.products(*a)[0, 0] == (2**33 + 1) * (2**28 + 1) + 15
    far = search.products(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**40)], [1.0]]))
    assert far.tolist() == [[2**63 - 1, -(2**63), 2**40]]


def test_scores_beyond_a_long_and_repeated_queries(spark):
    rows = spark.createDataFrame([(0, [1e12, 1.0]), (0, [-1.0, 2.0]), (1, [1e12, 0.0]), (2, [2e12, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search.top_k(rows.where("vec_id = 0"), rows, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2 * 2**20), (0, 2, 1, -(10**12) * 2**20)]
    got = [tuple(r) for r in search.top_k(rows.where("vec_id = 1"), rows.where("vec_id in (0, 2)"), 9).orderBy("rank").collect()]
    assert [(i, s) for _, _, i, s in got] == [(0, 2**63 - 1), (2, 2**63 - 1), (0, -(10**12) * 2**20)]


def test_round_trip(spark, tmp_path):
    trap = "x" * 200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nfoo"
    rows = [(1, "u", trap), (2, "u\nv", trap), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (9, "é", "é" * 60), (8, "w", "é" * 60), (None, "n", "é" * 60), (7, "y", "y" * 200000), (1, "u", trap)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as bytes", "2 as digest")
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write_warc(pages, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in warc.read_warc(spark, path).collect()), key=repr)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((x for x, _, y in rows if y == h and x is not None), default=None)
        again = len(b) >= 100 and i != first
        want.append((i, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest(), b"" if again else b))
    assert got == sorted(want, key=repr)


def test_chain_is_what_counts(spark):
    links = spark.createDataFrame([(1, 0, 10), (1, 10, 30), (1, 15, 20), (1, 20, 30), (1, 30, 99), (2, 5, 9), (3, 0, 7)] + [(4, i, i + 1) for i in range(300)], "file long, at long, next long")
    got = sorted((r["file"], r["at"]) for r in warc.reachable(links).collect())
    assert got == [(1, 0), (1, 10), (1, 30), (3, 0)] + [(4, i) for i in range(300)]


def record(i, body):
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i, len(http), http)


def test_files_of_many_members_and_broken_files(spark, tmp_path):
    fake = record(9, b"inside")
    parts = [record(i, fake if i == 2 else b"body %d" % i) for i in range(5)]
    files = {"one": b"".join(parts), "members": b"".join(map(gzip.compress, parts)), "whole": gzip.compress(b"".join(parts))}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == [(i, fake if i == 2 else b"body %d" % i) for i in range(5)]
    cut = {"short": parts[0] + parts[1][:-3], "wrong": parts[0] + b"x" + parts[1], "member": gzip.compress(parts[0]) + gzip.compress(parts[1])[:-9]}
    for name, data in cut.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(ValueError, match="1 files"):
            warc.read_warc(spark, f"file://{tmp_path}/{name}")
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}", strict=False).collect()
        assert 0 in [r["page_id"] for r in got]


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(none, f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_whole_table(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r["page_id"]: r["payload_digest"] for r in warc.op5_warc(spark, DATA).collect()}
    assert got == {i: hashlib.sha256((h or "").encode()).hexdigest() for i, h in html.items()}
