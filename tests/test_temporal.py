from helpers import rows
from pyspark.sql import functions as F

from newsloom.operators import graph, temporal


def rel(spark, data):
    return spark.createDataFrame(data, "event int, line int, subject string, predicate string, object string, time string, kind string, evidence string").withColumn("time", F.to_timestamp_ntz("time"))


def test_states_follow_each_other(spark):
    s = temporal.relation_states(rel(spark, [
        (1, 1, "E1", "关联", "E2", "2025-12-31 12:00:00", "state", "ev1"),
        (2, 1, "E1", "关联", "E2", "2025-12-31 13:00:00", "state", "ev2"),
        (3, 1, "E1", "合作", "E2", "2025-12-31 00:00:00", "event", "x"),
    ]))
    got = {r["event"]: (str(r["valid_from"]), str(r["valid_to"])) for r in s.collect()}
    assert got[1] == ("2025-12-31 12:00:00", "2025-12-31 13:00:00")
    assert got[2] == ("2025-12-31 13:00:00", "None")
    assert got[3][0] == got[3][1]


def test_frame_deltas(spark):
    ts = lambda df, *c: df.withColumns({x: F.to_timestamp_ntz(x) for x in c})
    frames = ts(spark.createDataFrame([(0, "2025-01-01"), (1, "2025-01-10"), (2, "2025-01-20")], "idx int, ts string"), "ts")
    iv = ts(spark.createDataFrame([
        ("r1", "2025-01-05", "2025-01-15"), ("r2", "2024-12-25", "2025-01-05"), ("r3", "2025-01-12", None), ("r4", "2024-12-01", "2024-12-15"),
    ], "id string, start string, end string"), "start", "end")
    assert rows(temporal.frame_deltas(frames, iv)) == [("r1", 1, 2), ("r2", 0, 1), ("r3", 2, None)]


def test_default_projection_prefers_the_revised_default(spark):
    o = spark.createDataFrame([("o0", "e", "start_time", "a", 0, 1, 1), ("o1", "e", "start_time", "b", 1, 1, 0), ("o2", "e", "start_time", "c", 5, 0, 9)],
                              "observation_id string, event_id string, field string, value_text string, revision int, is_default int, updated_at int")
    assert [r["value_text"] for r in temporal.default_projection(o).collect()] == ["b"]


def test_state_nodes_sit_between_their_ends(spark):
    s = spark.createDataFrame([("rs1", "Alice", "ally", "Bob", "2025-01-01", "2025-02-01")], "state_id string, subject string, predicate string, object string, valid_from string, valid_to string")
    nodes, edges = graph.graph_ee_evo(s)
    assert [(r["node"], r["type"]) for r in nodes.collect()] == [("rs1", "relation_state")]
    assert rows(edges.select("src", "dst", "type")) == [("Alice", "rs1", "rel_in"), ("rs1", "Bob", "rel_out")]


def test_empty_history(spark):
    none = rel(spark, [])
    assert temporal.relation_states(none).count() == 0
    assert temporal.gap_sessions(none).count() == 0
