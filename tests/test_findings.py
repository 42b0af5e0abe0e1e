"""Rows and texts on which queries once differed from their SQL, and steps that once grew with the square of a key."""

import random
from datetime import datetime

import pandas as pd
import pytest
from helpers import DATA, rows
from pyspark.sql import functions as F

from newsloom.operators import dedup, graph, quality, resolve, temporal
from newsloom.sources import news, views


def test_equal_intervals_are_one(spark):
    at = lambda c: F.to_timestamp_ntz(c).alias(c)
    frames = spark.createDataFrame([(0, "2024-01-01"), (1, "2024-02-01")], "idx int, ts string").select("idx", at("ts"))
    spans = spark.createDataFrame([("a", "2024-01-01", "2024-01-01")] * 2 + [("a", "2024-01-01", None), ("b", "2024-01-01", "2024-01-01")], "id string, start string, end string").select("id", at("start"), at("end"))
    assert rows(temporal.frame_deltas(frames, spans)) == [("a", 0, 1), ("a", 0, None), ("b", 0, 1)]


def test_references_without_an_end_stay():
    assert news.visible("a &amp b &ampc &notit; &lt; &#65; &#x42; &amp;lt; &nope; &") == "a &amp b &ampc &notit; < A B &lt; &nope; &"


def test_newest_articles_of_each_form(spark, monkeypatch):
    """Forms of one to five words, of many entities and in many articles, by the automaton and by runs of words, against brute force."""
    r = random.Random(3)
    texts = [(i, f"u{i % 4}", r.randrange(6), " ".join(r.choice("abcd") for _ in range(12))) for i in range(80)]
    forms = [(f"e{r.randrange(25)}", " ".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))) for _ in range(60)]
    n = spark.createDataFrame(texts, "id long, url string, d int, content string").withColumn("published_at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(d)")).drop("d")
    f = spark.createDataFrame(forms, "entity_id string, form string")
    want = []
    for e in sorted({e for e, _ in forms}):
        best = {}
        for i, u, d, t in texts:
            if any(f" {x} " in f" {t} " for y, x in forms if y == e):
                best[u, d] = min(i, best.get((u, d), i))
        want += [(e, i, k + 1) for k, (_, i) in enumerate(sorted((-d, i) for (_, d), i in best.items())[:3])]
    got = lambda: rows(quality.news_for_entities(n, f, 3).select("entity_id", "id", "n"))
    assert got() == sorted(want, key=repr)
    monkeypatch.setattr(quality, "FORMS", 0)
    met = quality.news_for_entities(n, f, 3)
    assert rows(met.select("entity_id", "id", "n")) == sorted(want, key=repr)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("row_number") >= 2  # of a form no more than k articles spread


def test_stream_state_is_one_value(spark):
    """A batch reads and writes each key's state once, however many rows it has."""
    from newsloom.streaming import jobs

    class Handle:
        def __init__(self):
            self.calls = 0

        def getValueState(self, *_):
            self.value = None
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    at = pd.Timestamp("2024-01-01")
    h, t = Handle(), jobs._Triple(False)
    t.init(h)
    new = lambda lo: pd.DataFrame({"time": [at + pd.Timedelta(days=d) for d in range(lo, lo + 50)], "event": range(50), "line": 1, "kind": "state", "evidence": "x"})
    assert [len(next(t.handleInputRows(("a", "b", "c"), iter([new(lo)]), None))) for lo in (0, 50)] == [50, 51] and h.calls == 3
    h, e = Handle(), jobs._Entity()
    e.init(h)
    rows_ = pd.DataFrame({"name": "n", "seq": range(50), "first_seen": at, "last_seen": at, "source": [f"s{k % 40}" for k in range(50)], "form": None})
    out = [next(e.handleInputRows(("k",), iter([rows_]), None)).iloc[0] for _ in range(2)][-1]
    assert out["sources"] == [f"s{k}" for k in range(40)] and out["forms"] == [] and out["rev"] == 2 and h.calls == 3


def test_redirect_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    """However small the table is, no round broadcasts it: the rounds of a long chain would add up."""
    plans, settle = [], resolve.settle

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    monkeypatch.setattr(resolve, "settle", seen)
    chain = spark.range(1, 40).select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("to_id"))
    out = resolve.resolve_redirects(chain)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, out.collect())) == [(k, 0) for k in range(1, 40)]
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)


def test_many_lines_are_dealt_to_more_tasks(spark, monkeypatch):
    """A task joins a bounded number of line items, whatever size they compress to, and the relations stay the same."""
    few = views.relations(spark, DATA).count()
    monkeypatch.setattr(views, "LINES", 500)
    many = views.relations(spark, DATA)
    assert many.count() == few
    assert "RepartitionByExpression [l_orderkey" in many._jdf.queryExecution().optimizedPlan().toString() and views.dealt_lines(views.table(spark, DATA, "lineitem")).rdd.getNumPartitions() >= few // 500


def test_full_text_keeps_references_without_an_end(spark):
    """The length of the text that replaces the content, as its SQL counts it."""
    pages = spark.createDataFrame([("u", "<p>" + "x" * 250 + " a &amp b</p>"), ("v", "<p>short &amp</p>")], "url string, html string").withColumn("page_id", F.lit(1))
    n = spark.createDataFrame([(1, "u", "u"), (2, "v", "v"), (3, "w", "w")], "id int, url string, content string")
    got = news.enrich_fulltext(n, news.main_text(pages)).select("id", F.length("content"))
    assert rows(got) == [(1, 259), (2, 1), (3, 1)]


def test_page_queries_skip_and_decode_what_their_sql_does(spark, tmp_path):
    """K9 and K10 on pages with more kinds of elements, references and spaces than their SQL knows, repeated and missing urls."""
    import duckdb

    from newsloom.plans import sources

    inner = "<header>Head of the page. </header><aside>Beside it.</aside><noscript>None. </noscript><svg>s.</svg>&nbsp;&copy; &#8217; a  b &amp;lt; &lt;i&gt;<nav>gone</nav>" + "word " * 60
    pages = [(1, "u", inner), (2, "u", "<p>short</p>"), (3, None, inner), (4, "v", None), (5, "w", "<script>a</script\x0b>. b</script>" + inner)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for query, oracle in ((sources.k9, sources.K9), (sources.k10, sources.K10)):
        assert rows(query(spark, str(tmp_path))) == sorted(db.execute(oracle).fetchall(), key=repr)


def test_upserts_make_no_python_call_per_entity(spark, tmp_path):
    """The state of L2 is Spark's own, an item of an entity at a time; a batch logs only the items it has."""
    from newsloom.operators import ingest
    from newsloom.streaming import jobs

    log, source, c = jobs.Log(spark, f"{tmp_path}/log"), f"{tmp_path}/in", f"{tmp_path}/c"
    kind = "entity string, source string, seq long, reported_at timestamp_ntz"
    first = [(f"e{k}", f"s{k % 3}", k, datetime(2024, 1, 1)) for k in range(50)] + [(" e1", None, 60, datetime(2023, 1, 1)), (None, "s9", 61, datetime(2023, 1, 1))]
    later = [("e1", "s0", 70, datetime(2024, 2, 1)), ("e1", "s1", -1, datetime(2024, 1, 5))]
    for batch in (first, later):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_upserts(spark.readStream.schema(kind).parquet(source), log)
        assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
        before = set(log.batches())
        jobs.run_once(stream, jobs.following(log, c), c)
    assert sum(spark.read.parquet(f"{log.path}/{n}").count() for n in set(log.batches()) - before) == 4  # a name, a form and two sources
    want = ingest.upsert_entities(None, ingest.entity_rows(spark.createDataFrame(first + later, kind).where("entity is not null")))
    same = lambda df: rows(df.select("entity_id", "name", F.col("first_seen").cast("string"), F.col("last_seen").cast("string"), "sources", "forms"))
    assert same(jobs.entities(log)) == same(want)


def test_a_reply_is_parsed_once(spark, monkeypatch):
    """One parse for lists and one for objects of either kind, however often their events are used."""
    plans, settle = [], resolve.settle
    monkeypatch.setattr(resolve, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df))
    replies = [(1, '[{"abstract": "a"}, {"abstract": null}]'), (2, '```json\n{"events": [{"abstract": "b"}, {"abstract": "c"}]}\n```'), (3, '{"abstract": "d"}'), (4, '{"events": []}'), (5, "none"), (6, None), (7, '{"event_summary": "e"}')]
    ok, failed = resolve.parse_responses(spark.createDataFrame(replies, "id int, response string"))
    assert rows(ok.select("id", "n", "event.abstract")) == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c"), (3, 0, "d")]
    assert rows(failed.select("id")) == [(4,), (5,), (6,), (7,)]
    assert plans[0].count("from_json") == 2


@pytest.mark.parametrize("threshold", [4])
def test_crowded_fingerprints_come_in_batches(spark, monkeypatch, threshold):
    """Leaders as row after row, in tiles and batches of any size, and pairs are made only of rows that no earlier batch decides."""
    for name, value in (("BUCKET", 128), ("FEW", 4), ("SIDE", 7), ("CHUNK", 50), ("START", 150), ("FACTOR", 3)):
        monkeypatch.setattr(dedup, name, value)
    r = random.Random(5)
    hubs = [r.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    prints = list({h ^ sum(1 << i for i in r.sample(range(64), r.choice((1, 2, 2, 3, 9)))) for h in hubs for _ in range(100)})
    r.shuffle(prints)
    kept, want, near = [], {}, []
    for i, p in enumerate(prints):
        near += [(j, i) for j in range(i) if (p ^ prints[j]).bit_count() <= threshold]
        want[i] = next((j for j in kept if (p ^ prints[j]).bit_count() <= threshold), i)
        if want[i] == i:
            kept.append(i)
    first = spark.createDataFrame([(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)], "id long, fp long")
    assert rows(dedup.near_fingerprints(first, threshold)) == sorted(near, key=repr)
    given, whole = [], dedup.greedy_leaders
    monkeypatch.setattr(dedup, "greedy_leaders", lambda left, pairs: given.append(pairs.distinct().count()) or whole(left, pairs))
    got = dedup.fingerprint_leaders(first, threshold)
    assert dict(rows(got)) == want and got.count() == len(prints)
    assert len(given) > 2 and sum(given) < len(near) / 4


def test_fingerprints_of_tokens_seen_before(monkeypatch):
    """A token's digest is worked out once, also when the digests are given up in between; long texts count every token."""
    from test_dedup import fingerprint

    texts = ["a b c", "A b  c d", "", None, " ".join(f"w{i % 300}" for i in range(5000)), "a b c"]
    want = [fingerprint(t or "") for t in texts]
    asked, md5 = [], dedup.hashlib.md5
    monkeypatch.setattr(dedup.hashlib, "md5", lambda x: asked.append(x) or md5(x))
    dedup._DIGESTS.clear()
    assert [int(x) % 2**64 for x in dedup._simhash(pd.Series(texts))] == want
    assert len(asked) == len(set(asked)) == 304


def test_sessions_need_no_groups_and_are_worked_out_once(spark):
    """Against row after row, with null times, long sessions and null evidences; no aggregate but the look for hot triples, and no union of two plans."""
    r = random.Random(3)
    data = [(r.choice("ab"), r.choice("x"), r.choice(["o", None]), None if r.random() < 0.1 else datetime(2024, r.randrange(1, 13), r.randrange(1, 28)), e, e % 3, None if e % 7 == 0 else f"e{e}") for e in range(90)]
    rel = spark.createDataFrame(data, "subject string, predicate string, object string, time timestamp_ntz, event long, line long, evidence string")
    want, open_ = [], {}
    for x in sorted(data, key=lambda x: (x[3] is not None, x[3] or datetime.min, x[4], x[5])):
        key, last = x[:3], open_.get(x[:3])
        if last is None or (last["end"] is not None and x[3] is not None and (x[3] - last["end"]).total_seconds() > 10 * 86400):
            last = open_[key] = {"key": key, "session": 0 if last is None else last["session"] + 1, "start": None, "n": 0, "evidence": []}
            want.append(last)
        last["start"], last["end"], last["n"] = last["start"] or x[3], x[3], last["n"] + 1
        last["evidence"] = (last["evidence"] + [x[6]])[:5]
    got = temporal.gap_sessions(rel, 10)
    assert rows(got.select("subject", "predicate", "object", "session", "start", "end", "n", "evidence")) == sorted([(*w["key"], w["session"], w["start"], w["end"], w["n"], w["evidence"]) for w in want], key=repr)
    edges = graph.graph_ee_evo(graph.sessions_as_states(got))[1]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Union" not in plan
    assert edges.count() == 2 * len(want) and edges.columns == ["src", "dst", "type", "time"]
