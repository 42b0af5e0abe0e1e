"""Pairs of large groups, cut into blocks."""

import random
from collections import Counter
from itertools import combinations

from newsloom.operators import graph


def brute(rows, least):
    events = {}
    for event, entity in rows:
        if event is not None and entity is not None:
            events.setdefault(event, set()).add(entity)
    n = Counter(p for members in events.values() for p in combinations(sorted(members), 2))
    return sorted((*p, c) for p, c in n.items() if c >= least)


def test_light_and_heavy_events(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(f"e{k}", f"x{rng.randrange(90):02}") for k, size in enumerate((1, 2, 3, 8, 9, 20, 70, 70, 5)) for _ in range(size)] + [("e0", None), (None, "x1"), ("e1", "x1"), ("e1", "x1")]
    d = spark.createDataFrame(rows, "event_id string, entity_id string")
    for least in (1, 2, 3):
        assert sorted(tuple(r) for r in graph.cooccurrence(d, least).collect()) == brute(rows, least)
    swapped = [(b, a) for a, b in rows]
    assert sorted(tuple(r) for r in graph.event_pairs(d).collect()) == brute(swapped, 2)
    assert graph.cooccurrence(d.limit(0)).count() == 0


def test_a_large_event_is_many_tasks(spark):
    """Three events of 3,000 entities each: no row of the plan holds more than two blocks."""
    d = spark.range(9000).selectExpr("concat('e', id % 3) as event_id", "concat('x', id div 3) as entity_id")
    out = graph.cooccurrence(d, 3)
    assert out.count() == 3000 * 2999 // 2 and out.where("n <> 3 or a >= b").count() == 0
