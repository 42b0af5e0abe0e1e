"""Each stream must end where the batch job ends."""

import glob

import pytest
from helpers import DATA, rows
from pyspark.sql import functions as F

from newsloom.operators import ingest, temporal
from newsloom.sources import views
from newsloom.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Mentions, relations and news in several files each."""
    base = tmp_path_factory.mktemp("stream")
    v = {"mentions": views.mentions(spark, DATA), "relations": views.relations(spark, DATA).where("subject < 'Supplier#000000004'"), "news": views.news(spark, DATA).select("id", "source", "language", "published_at")}
    for name, df in v.items():
        for k in range(3):
            df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(base / name))
    assert len(glob.glob(str(base / "mentions" / "*.parquet"))) == 3
    return base, v


def stream(spark, base, name, df):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(base / name))


def entity_rows(df):
    return rows(df.select("entity_id", "name", F.col("first_seen").cast("string"), F.col("last_seen").cast("string"), "sources", "forms"))


def state_rows(df):
    return rows(df.select("state_id", "event", "line", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "state_text"))


def upsert(spark, mentions, log, checkpoint):
    return jobs.run_once(jobs.stream_upserts(mentions, log), jobs.following(log, checkpoint), checkpoint)


def relate(spark, relations, log, checkpoint, late=None):
    return jobs.run_once(jobs.stream_states(relations, log, late), jobs.following(log, checkpoint), checkpoint)


def test_upserts_in_three_batches(spark, parts, tmp_path):
    base, v = parts
    log = jobs.Log(spark, f"{tmp_path}/entities")
    upsert(spark, stream(spark, base, "mentions", v["mentions"]), log, str(tmp_path / "c"))
    assert len(log.batches()) >= 3
    assert entity_rows(jobs.entities(log)) == entity_rows(ingest.upsert_entities(None, ingest.entity_rows(v["mentions"])))


def test_states_in_three_batches(spark, parts, tmp_path):
    base, v = parts
    log = jobs.Log(spark, f"{tmp_path}/states")
    relate(spark, stream(spark, base, "relations", v["relations"]), log, str(tmp_path / "c"))
    assert len(log.batches()) >= 3
    assert state_rows(jobs.states(log)) == state_rows(temporal.relation_states(v["relations"]))


def test_a_restart_and_a_new_checkpoint(spark, parts, tmp_path):
    """Batch numbers begin again with a new checkpoint; nothing may be lost or counted twice."""
    _, v = parts
    for name, df, run, table, batch in (
        ("m", v["mentions"], upsert, lambda g: entity_rows(jobs.entities(g)), entity_rows(ingest.upsert_entities(None, ingest.entity_rows(v["mentions"])))),
        ("r", v["relations"], relate, lambda g: state_rows(jobs.states(g)), state_rows(temporal.relation_states(v["relations"]))),
    ):
        log, source = jobs.Log(spark, f"{tmp_path}/{name}/log"), f"{tmp_path}/{name}/in"
        piece = lambda k: df.where(F.pmod(F.xxhash64(*df.columns), F.lit(3)) == k).coalesce(1)  # noqa: E731, B023
        following = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        for k, checkpoint in ((0, "one"), (1, "one"), (2, "two")):
            if checkpoint == "two":
                source = f"{tmp_path}/{name}/more"
            piece(k).write.mode("append").parquet(source)
            run(spark, following.parquet(source), log, f"{tmp_path}/{name}/{checkpoint}")
        assert len({n.rsplit("-", 1)[0] for n in log.batches()}) == 2
        assert table(log) == batch


def test_a_batch_changes_only_its_keys(spark, parts, tmp_path):
    _, v = parts
    log, source, one = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in"), str(tmp_path / "c")
    r = v["relations"]
    r.coalesce(1).write.mode("append").parquet(source)
    relate(spark, spark.readStream.schema(r.schema).parquet(source), log, one)
    before = set(log.batches())
    r.limit(1).withColumn("event", F.lit(10**9).cast(r.schema["event"].dataType)).write.mode("append").parquet(source)
    relate(spark, spark.readStream.schema(r.schema).parquet(source), log, one)
    new = [n for n in log.batches() if n not in before]
    assert sum(spark.read.parquet(f"{log.path}/{n}").count() for n in new) <= 2


def test_state_shrinks_behind_the_watermark(spark, tmp_path):
    kind = "subject string, predicate string, object string, time timestamp_ntz, event long, line long, kind string, evidence string"
    log, source = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in")
    for k, days in enumerate(([1, 3, 2, 4], [40, 41], [5], [80])):
        row = [f"('a', 'p', 'b', timestamp_ntz'2024-01-01' + interval {d} day, {d}L, 1L, 'state', 'e{d}')" for d in days]
        spark.sql(f"select * from values {', '.join(row)} as t(subject, predicate, object, time, event, line, kind, evidence)").coalesce(1).write.mode("append").parquet(source)
        progress = relate(spark, spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), log, str(tmp_path / "c"), "10 days")
    got = {r["event"]: (r["valid_to"] - r["valid_from"]).days if r["valid_to"] else None for r in jobs.states(log).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 36, 40: 1, 41: 39, 80: None}  # day 5 came 26 days too late
    assert progress["stateOperators"][0]["numRowsTotal"] <= 4


def test_no_triple_costs_a_call(spark, tmp_path):
    """Rows that come twice or late, each once in the table; the stream calls no Python and keeps nothing that it doesn't need."""
    kind = "subject string, predicate string, object string, time timestamp_ntz, event long, line long, kind string, evidence string"
    log, source, c = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in"), str(tmp_path / "c")
    d = spark.range(40_000).select(
        F.concat(F.lit("s"), F.col("id") % 20_000).alias("subject"), F.lit("p").alias("predicate"), F.lit("b").alias("object"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 7 as int))").alias("time"), F.col("id").alias("event"), F.lit(1).cast("long").alias("line"), F.lit("state").alias("kind"), F.lit("e").alias("evidence"),
    )
    again = d.where("event % 3 = 0").withColumn("evidence", F.lit("f"))
    for part in (d.where("event >= 20000"), d.where("event < 20000").union(again)):
        part.coalesce(1).write.mode("append").parquet(source)
        out = jobs.stream_states(spark.readStream.schema(kind).parquet(source), log)
        assert "State" not in out._jdf.queryExecution().logical().toString()
        progress = jobs.run_once(out, jobs.following(log, c), c)
    assert not progress["stateOperators"] and len(log.batches()) == 2
    want = d.where("event % 3 <> 0").union(again)
    assert state_rows(jobs.states(log)) == state_rows(temporal.relation_states(want))


def test_revisions_of_states(spark, parts, tmp_path):
    """Those who follow states get the rows whose next row a batch changes too; the table is the same."""
    _, v = parts
    log, source, c = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in"), str(tmp_path / "c")
    r = v["relations"].where("subject < 'Supplier#000000002'")
    for k in range(2):
        r.where(F.pmod(F.xxhash64("event", "line"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(source)
        jobs.run_once(jobs.stream_state_revisions(spark.readStream.schema(r.schema).parquet(source), log), jobs.following(log, c), c)
    assert log.read().where("rev > 1").count() > 0
    assert state_rows(jobs.states(log)) == state_rows(temporal.relation_states(r))


def test_failures_come_again(spark, parts, tmp_path):
    _, v = parts
    log, source, c = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in"), str(tmp_path / "c")
    n = v["news"].where("id < 20")
    n.coalesce(1).write.parquet(source)
    follow = lambda: spark.readStream.schema(n.schema).parquet(source)
    jobs.run_once(follow(), jobs.processed_batches(log, c, lambda d: d.where("id % 2 = 0").select("global_id", "id")), c)
    again = []
    c = str(tmp_path / "new")
    jobs.run_once(follow(), jobs.processed_batches(log, c, lambda d: again.extend(r["id"] for r in d.collect()) or d.select("global_id", "id")), c)
    assert sorted(again) == [i for i in range(20) if i % 2]
    assert log.read().count() == log.read().distinct().count() == 20


def test_a_batch_that_failed_half_way(spark, parts, tmp_path):
    _, v = parts
    log, source, c = jobs.Log(spark, f"{tmp_path}/log"), str(tmp_path / "in"), str(tmp_path / "c")
    n = v["news"].where("id < 20")
    n.coalesce(1).write.parquet(source)

    def fail(d):
        raise ValueError("no model")

    follow = lambda: spark.readStream.schema(n.schema).parquet(source)
    with pytest.raises(Exception, match="no model"):
        jobs.run_once(follow(), jobs.processed_batches(log, c, fail), c)
    assert log.read() is None
    jobs.run_once(follow(), jobs.processed_batches(log, c, lambda d: d.select("global_id", "id")), c)
    assert log.read().count() == 20


def test_news_after_the_watermark(spark, tmp_path):
    """Late repeats go, and so does what is too late to tell; the state holds no more than the last hour's ids."""
    source = str(tmp_path / "in")
    kind = "id long, source string, published_at timestamp"
    for k, (ids, hour) in enumerate((([1, 2], 0), ([1, 3], 0), ([4], 5), ([5], 9), ([2, 6], 1))):
        spark.sql(f"select explode(array({', '.join(map(str, ids))})) as x").selectExpr("cast(x as long) as id", "'s' as source", f"timestamp'2024-01-01 00:00:00' + interval {hour} hour as published_at").coalesce(1).write.mode("append").parquet(source)
        s = jobs.stream_news(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), late="1 hour")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5]
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 2


def test_news_once(spark, parts, tmp_path):
    base, v = parts
    n = v["news"]
    n.limit(30).write.mode("append").parquet(str(base / "news"))
    s = jobs.stream_news(spark.readStream.schema(n.schema).parquet(str(base / "news")), late="30 days")
    q = s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == n.count()


def test_sessions(spark, parts, tmp_path):
    base, v = parts
    s = jobs.stream_sessions(spark.readStream.schema(v["relations"].schema).parquet(str(base / "relations")), 30)
    q = s.writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("sessions").select("subject", "predicate", "object", F.col("start").cast("string"), F.col("end").cast("string"), "n")
    want = temporal.gap_sessions(v["relations"], 30).select("subject", "predicate", "object", F.col("start").cast("string"), F.col("end").cast("string"), "n")
    assert rows(got) == rows(want)
