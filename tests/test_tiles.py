"""Pairs of large events in tiles of entities: the same as brute force, with and without the events."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph


@pytest.mark.parametrize("events", [5, 60])
def test_tiles_and_light_events(spark, monkeypatch, events):
    """Large events, small ones beside them, entities in both: counts and events of each pair; tiles are multiplied or counted event by event."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "SIDE", 16)
    r = random.Random(events)
    rows = [(f"e{r.randrange(5)}", f"x{r.randrange(60):02}") for _ in range(300)] + [(f"l{r.randrange(events)}", f"x{r.randrange(90):02}") for _ in range(200)]
    of = {}
    for e, x in rows:
        of.setdefault(x, set()).add(e)
    want = {(a, b): sorted(of[a] & of[b]) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= 2}
    got = graph.cooccurrence(spark.createDataFrame(rows, "event_id string, entity_id string"), 2, listed=True).collect()
    assert len(got) == len(want) and {(g.a, g.b): g.events for g in got} == want and all(g.n == len(g.events) for g in got)


def test_pairs_of_large_events_are_not_shuffled(spark):
    """Twenty events of the same 2,000 entities: 2e6 pairs, each counted where its tile lies."""
    d = spark.range(40_000).select(F.concat(F.lit("e"), F.col("id") % 20).alias("event_id"), F.concat(F.lit("x"), (F.col("id") / 20).cast("int")).alias("entity_id"))
    out = graph.cooccurrence(d, 20)
    assert out.agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (2000 * 1999 // 2, 20, 20)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()


def test_weights_are_summed_in_tiles(spark, monkeypatch):
    """Strips and blocks of many and of few entities, and events of all sizes, against the sums over all pairs."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "SIDE", 8)
    r = random.Random(9)
    rows = [(f"v{e}", f"e{k}") for e in range(60) for k in r.sample(range(70), r.choice((3, 12, 50)))]
    d = spark.createDataFrame(rows, "event_id string, entity_id string")
    for strips in (1, 3):
        monkeypatch.setattr(graph, "STRIPS", strips)
        want = {}
        for p in graph.cooccurrence(d, 7).collect():
            for e in (p["a"], p["b"]):
                want[e] = want.get(e, 0) + p["n"]
        got = graph.cooccurrence(d, 7, summed=True)
        assert {x["entity_id"]: x["weight"] for x in got.collect()} == want and want
        assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_read_blocks_where_they_lie(spark, monkeypatch):
    """Tiles of several strips: each pair once, and what is shuffled for tiles is one copy of each block."""
    monkeypatch.setattr(graph, "BLOCK", 8)
    monkeypatch.setattr(graph, "SIDE", 4)
    monkeypatch.setattr(graph, "STRIPS", 3)
    monkeypatch.setattr(graph, "SMALL", 2)
    r = random.Random(3)
    rows = [(f"e{r.randrange(6)}", f"x{k:03}") for k in range(130) for _ in range(4)]
    of = {}
    for e, x in rows:
        of.setdefault(x, set()).add(e)
    want = {(a, b): sorted(of[a] & of[b]) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= 2}
    out = graph.cooccurrence(spark.createDataFrame(rows, "event_id string, entity_id string"), 2, listed=True)
    got = out.collect()
    assert len(got) == len(want) and {(g.a, g.b): g.events for g in got} == want
    tiles = out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[1]
    assert "CartesianProduct" in tiles and "explode" not in tiles
