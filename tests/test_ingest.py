from helpers import rows
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import ingest, quality


def test_upsert_keeps_bounds_and_order(spark):
    m = spark.createDataFrame([(1, "e", " Ann ", "2024-01-02", "k1"), (2, "e", " Ann ", "2024-01-01", "k0"), (3, "e", " Ann ", "2024-01-03", "k1")], "seq long, abstract string, entity string, reported_at string, source string")
    m = m.withColumn("event_type", F.lit("t"))
    one = ingest.upsert_entities(ingest.upsert_entities(None, ingest.entity_rows(m.where("seq < 2"))), ingest.entity_rows(m.where("seq >= 2"))).first()
    assert (one["name"], one["first_seen"], one["last_seen"], one["sources"]) == ("Ann", "2024-01-01", "2024-01-03", ["k1", "k0"])


def test_relation_kind(spark):
    d = spark.createDataFrame([("", "合作"), ("", "关联"), ("Static", "合作"), ("动作", "x"), (None, None)], "k string, p string")
    assert [r[0] for r in d.select(expr.relation_kind(F.col("k"), F.col("p"))).collect()] == ["event", "state", "state", "event", ""]


def test_normalized_names(spark):
    d = spark.createDataFrame([(" A.b-C (d)",), (None,)], "n string")
    assert [r[0] for r in d.select(expr.normalize_name(F.col("n"))).collect()] == ["abcd", ""]


def test_ids(spark):
    import hashlib

    got = spark.range(1).select(expr.entity_id(F.lit(" E1 "))).first()[0]
    assert got == hashlib.sha1(b"ent:E1").hexdigest()


def test_article_metrics(spark):
    news = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "id int, url string")
    ev = spark.createDataFrame([(1, 2, 1), (1, 1, 0), (3, 2, 1), (3, 1, 0)], "id int, n_entities int, n_relations int")
    r = quality.article_metrics(news, ev).first()
    assert (r["fetched"], r["deduped"], r["processed"], r["events"], r["entities"], r["relations"]) == (3, 2, 2, 4, 6, 2)


def test_signal_check(spark):
    e = spark.createDataFrame([("a", "2025-12-31T12:34:56Z"), ("b", None)], "event_id string, start_text string")
    s = spark.createDataFrame([("a", "20251231", 2)], "event_id string, sql_date string, num_mentions int")
    n = spark.createDataFrame([("a", 1), ("b", 1)], "event_id string, n int")
    assert rows(quality.check_signals(e, s, n)) == [("a", "num_mentions", "mismatch"), ("a", "start_date", "match"), ("b", "num_mentions", "unknown"), ("b", "start_date", "unknown")]


def test_roles_and_first_per(spark):
    d = spark.sql("select map('a', array('x')) as l, map('a', array('y', 'x'), 'b', array('z')) as r, array(named_struct('id', 1, 'v', 'p'), named_struct('id', 1, 'v', 'q')) as s")
    r = d.select(expr.merged_roles(F.col("l"), F.col("r")).alias("m"), expr.first_per(F.col("s"), "id").alias("s")).first()
    assert r["m"] == {"a": ["x", "y"], "b": ["z"]} and [x["v"] for x in r["s"]] == ["p"]


def test_source_lists(spark):
    import hashlib

    from newsloom.functions import expr

    sha = lambda n: hashlib.sha1(f"src:{n}".encode()).hexdigest()
    kind = "l array<struct<id:string,name:string,url:string>>, n array<string>"
    d = spark.createDataFrame([([(None, " a ", "u"), ("i", None, None), ("", "", "x"), (sha("a"), "b", ""), ("i", "c", "")], [" a", "a", "", None, "b"]), (None, [])], kind)
    got = d.select(expr.source_list(F.col("l")).alias("l"), expr.named_sources(F.col("n")).alias("n")).collect()
    assert [tuple(x) for x in got[0]["l"]] == [(sha("a"), "a", "u"), ("i", "i", "")]
    assert [tuple(x) for x in got[0]["n"]] == [(sha("a"), "a", ""), (sha("b"), "b", "")]
    assert got[1]["l"] is None and got[1]["n"] == []


def test_forms_in_texts_both_ways(spark, monkeypatch):
    from newsloom.operators import quality

    t = spark.createDataFrame([(1, "a storm hits the coast"), (2, "the coast"), (3, None), (4, ""), (5, "storm storm hits"), (6, "coasts")], "id long, t string")
    f = spark.createDataFrame([("storm",), ("the coast",), ("storm hits",), ("coast",), ("",)], "form string")
    want = [(1, "coast"), (1, "storm"), (1, "storm hits"), (1, "the coast"), (2, "coast"), (2, "the coast"), (5, "storm"), (5, "storm hits")]
    assert sorted(tuple(r) for r in quality.forms_in(t, f).collect()) == want
    monkeypatch.setattr(quality, "FORMS", 3)
    assert sorted(tuple(r) for r in quality.forms_in(t, f).collect()) == want
