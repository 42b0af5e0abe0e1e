"""Keys that hold all rows, cut into slices, give what one window gives; sweeps against brute force."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from newsloom.operators import temporal


@pytest.fixture(scope="module")
def relations(spark):
    r = random.Random(2)
    some = [("a", "p", "b", d, r.randrange(9), r.randrange(3), r.choice(("state", "event")), f"e{r.randrange(20)}") for d in (r.randrange(900) for _ in range(400))]
    some += [("a", None, "b", d, 1, 1, "state", "x") for d in (5, 5, 80)] + [("c", "p", "d", 3, 1, 1, "state", None)]
    some = list({(x[0], x[1], x[2], x[3], x[4], x[5]): x for x in some}.values())  # (time, event, line) is unique in a triple
    df = spark.createDataFrame(some, "subject string, predicate string, object string, day int, event long, line int, kind string, evidence string")
    return df.withColumn("time", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, day)")).drop("day")


def text(df):
    return rows(df.select(*[F.col(c).cast("string") for c in sorted(df.columns)]))


@pytest.mark.parametrize("job", [
    temporal.relation_states, lambda r: temporal.gap_sessions(r, 10), lambda r: temporal.relation_history(r, 7),
    lambda r: temporal.before_edges(r.select(F.col("subject").alias("entity_id"), F.col("event").cast("string").alias("event_id"), "time").distinct()),
])
def test_slices_change_nothing(spark, relations, monkeypatch, job):
    want = text(job(relations))
    monkeypatch.setattr(temporal, "HOT", 20)
    assert text(job(relations)) == want and want


def test_sweeps_against_brute_force(spark):
    r = random.Random(5)
    spans = [(k, r.randrange(40), r.choice((None, r.randrange(60)))) for k in range(120)]
    spans = [(k, s, e if e is None or e >= s else s) for k, s, e in spans]
    ticks = sorted(r.sample(range(70), 25))
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, {c})")
    d = spark.createDataFrame(spans, "id int, s int, e int").select("id", at("s").alias("valid_from"), at("e").alias("valid_to"))
    frames = spark.createDataFrame(list(enumerate(ticks)), "idx int, t int").select("idx", at("t").alias("time"))
    got = rows(temporal.active_per_frame(d, frames))
    assert got == sorted(((i, sum(s <= t and (e is None or e >= t) for _, s, e in spans), sum(s <= t for _, s, _ in spans)) for i, t in enumerate(ticks)), key=repr)
    want = []
    for k, s, e in spans:
        if s > ticks[-1] or e is not None and e < ticks[0]:
            continue
        enters = min(i for i, t in enumerate(ticks) if t >= s)
        exits = None if e is None else min((i for i, t in enumerate(ticks) if t > e), default=None)
        if exits is None or enters < exits:
            want.append((k, enters, exits))
    found = temporal.frame_deltas(frames.withColumnRenamed("time", "ts"), d.toDF("id", "start", "end"))
    assert rows(found) == sorted(want, key=repr)


def test_many_frames_in_one_day(spark):
    """A million frames and as many states in one day: the work is one sort by time."""
    n = 1_000_000
    at = lambda c: F.expr(f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, ({c}) / 100000.0)")
    frames = spark.range(n).select(F.col("id").cast("int").alias("idx"), at("id").alias("time"))
    states = spark.range(n).select(at("id").alias("valid_from"), at("id + 5").alias("valid_to"))
    got = temporal.active_per_frame(states, frames)
    assert got.agg(F.count("*"), F.max("active"), F.sum("started")).first()[:3] == (n, 6, n * (n + 1) // 2)
