import html
import json
import random
import re
import time

from helpers import DATA, rows
from pyspark.sql import functions as F

from newsloom.operators import resolve
from newsloom.sources import news, views


def test_malformed_lines_are_left_out(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id": "1", "title": "a"}\nnot json\n{"id": "2"}\n')
    assert sorted(r["id"] for r in news.read_news_jsonl(spark, str(tmp_path / "n.jsonl")).collect()) == ["1", "2"]


def test_articles_first_row_per_url(spark):
    a = [{"url": "x/a", "title": "T", "snippet": "S", "seendate": "2025-12-27 10:11:12"}, {"url": "x/a", "title": "U", "snippet": "V", "seendate": ""}, {"url": "x/b", "title": "B", "snippet": "", "seendate": "20251227101112"}]
    df = spark.createDataFrame([(a,)], "articles array<struct<url:string,title:string,snippet:string,seendate:string>>")
    assert rows(news.normalize_articles(df).select("id", "title", "content", F.col("published_at").cast("string"))) == [("x/a", "T", "S", "2025-12-27 10:11:12"), ("x/b", "B", "B", "2025-12-27 10:11:12")]


def test_events_in_three_forms(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"abstract": "a"}')
    (tmp_path / "many.json").write_text(json.dumps([{"abstract": "b"}, {"abstract": "c"}]))
    (tmp_path / "lines.jsonl").write_text('{"abstract": "d"}\n{"abstract": "e"}\n')
    got = [sorted(r["abstract"] for r in news.read_events_any(spark, str(tmp_path / n)).collect()) for n in ("one.json", "many.json", "lines.jsonl")]
    assert got == [["a"], ["b", "c"], ["d", "e"]]
    text = spark.createDataFrame([('[{"abstract": "x"}, {"abstract": "y"}]',), ('{"abstract": "z"}',)], "j string")
    assert sorted(r["abstract"] for r in news.events_from_text(text, "j").collect()) == ["x", "y", "z"]


def test_newest_files(spark, tmp_path):
    import os

    for i in range(3):
        p = tmp_path / f"extracted_events_{i}.jsonl"
        p.write_text(json.dumps({"abstract": str(i)}) + "\n")
        os.utime(p, (1000 + i, 1000 + i))
    assert sorted(r["abstract"] for r in news.read_extracted_events(spark, f"{tmp_path}/extracted_events_*.jsonl", 2).collect()) == ["1", "2"]


def test_documents_round_trip(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"Ann": {"sources": ["s1", "s2"], "first_seen": "2024"}, "Bob": {"sources": [], "published_at": "2023"}}))
    e, _ = news.import_documents(spark, str(tmp_path / "e.json"), None)
    assert rows(e.select("name", "source", "reported_at")) == [("Ann", "s1", "2024"), ("Bob", None, "2023")]
    news.write_json(e, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_snapshots(spark, tmp_path):
    n, e = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    for kind in ("GE", "EE"):
        news.write_snapshot(n, e, kind, str(tmp_path / "s"))
    assert rows(news.list_snapshots(spark, str(tmp_path / "s"))) == [("EE", 2, 1), ("GE", 2, 1)]
    assert news.read_snapshot(spark, str(tmp_path / "s"), "GE")[1].count() == 1


def test_a_crash_between_writes_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    n, e = spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    s = news.Snapshots(spark, str(tmp_path / "s"))
    assert s.list().count() == 0
    s.write({"GE": (n, e), "EE": (n, e)}, "one")

    def crash(folders):
        raise OSError("gone")

    monkeypatch.setattr(s, "publish", crash)
    try:
        s.write({"GE": (n.limit(1), e), "EE": (n.limit(1), e)}, "two")
    except OSError:
        pass
    reader = news.Snapshots(spark, str(tmp_path / "s"))
    assert {(r["graph_type"], r["n_nodes"], r["params"]) for r in reader.list().collect()} == {("GE", 2, "one"), ("EE", 2, "one")}
    reader.write({"GE": (n.limit(1), e)}, "three")
    assert {(r["graph_type"], r["n_nodes"], r["params"]) for r in reader.list().collect()} == {("GE", 1, "three"), ("EE", 2, "one")}


def test_visible_text_as_the_patterns_tell():
    """The same text as one pattern after another gives, on pages of all kinds of broken tags."""

    def plain(t):
        t = re.sub(r"(?s)<!--.*?-->", "", t)
        for tag in news.SKIPPED:
            t = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", t)
        t = re.sub(rf"(?i)</?(?:{'|'.join(news.BLOCKS)})\b[^>]*>", "\n", t)
        return html.unescape(re.sub(r"(?s)<[!/a-zA-Z][^>]*>", "", t))

    r = random.Random(8)
    piece = ["<p>", "</p>", "<script", "<script>", "</script>", "</SCRIPT >", "<style a='>'>", "</style>", "<nav>", "</nav", "</nav>", "<!--", "-->", "<!-->", "<", ">", "< b", "text", " &amp; ", "&lt;p&gt;", "\n", "<h1 x>", "<scripts>", "<br/>", "<aside>", "</aside>"]
    for _ in range(20_000):
        page = "".join(r.choices(piece, k=r.randint(0, 14)))
        assert news.visible(page) == plain(page), page


def test_unclosed_tags_take_linear_time():
    for unit in ("<script", "<script>", "<!--", "<nav ", "<p ", "<script </script", "<style></script>"):
        page = unit * (1_000_000 // len(unit))
        for text in (page, page + "</script>", page + "</style>"):
            began = time.time()
            news.visible(text)
            assert time.time() - began < 5, unit


def test_search_articles(spark):
    df = spark.sql("select 't' as title, 'd' as description, '' as content, 'u' as url, '2024-01-02T03:04:05Z' as publishedAt, named_struct('name', 's') as source")
    r = news.normalize_search_articles(df).first()
    assert (r["id"], r["content"], r["source"], str(r["published_at"])) == ("u", "d", "s", "2024-01-02 03:04:05")


def test_page_text(spark):
    page = "<html><head><title>Real Title</title><style>p{}</style><script>var secret=1</script></head><body><nav>Menu menu menu menu menu menu menu menu</nav><article><h1>Real Title</h1><p>This is the first paragraph &amp; it is long enough.</p><p>short</p></article><footer>foot.</footer></body></html>"
    got = news.main_text(spark.createDataFrame([(1, "u", page), (2, "v", None)], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert got[0]["text"].split("\n")[-1] == "This is the first paragraph & it is long enough."
    assert "secret" not in got[0]["text"] and "Real Title" in got[0]["text"] and got[1]["text"] == ""


def test_responses_with_a_fence(spark):
    d = spark.createDataFrame([(1, 'Sure:\n```json\n{"events": [{"abstract": "a", "event_summary": "s", "entities": ["x", "y", "x"], "relations": [{"subject": "x", "predicate": "合作", "object": "y"}, {"subject": "x", "predicate": "p", "object": "x"}]}]}\n```'), (2, "nothing")], "id int, response string")
    ok, bad = resolve.parse_responses(d)
    c = resolve.clean_extractions(ok).first()
    assert c["entities"] == ["x", "y"] and [(r["subject"], r["relation_kind"]) for r in c["relations"]] == [("x", "event")]
    assert [r["id"] for r in bad.collect()] == [2]


def test_all_snapshots_keep_their_parameters(spark, tmp_path):
    from newsloom.plans.graph import kg

    got = news.snapshot_all(kg(spark, DATA)[3], views.relations(spark, DATA), views.event_edges(spark, DATA), str(tmp_path), 50, 200)
    got = {r["graph_type"]: r for r in got.collect()}
    assert sorted(got) == ["EE", "EE_EVO", "EVENT_EVO", "GE", "GET"]
    assert got["GE"]["n_nodes"] == 50 and got["GE"]["n_edges"] <= 200 and '"top_nodes": 50' in got["EE"]["params"]
