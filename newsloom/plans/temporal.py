"""Queries of newsloom.operators.temporal."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import temporal as T
from newsloom.plans.views import KG, MENTION, REL, sql, ts
from newsloom.sources import views as V

tt = lambda c: expr.ts_text(F.col(c)).alias(c)
STATES = """st AS (SELECT subject, predicate, object, kind, event, line, time AS valid_from,
  CASE WHEN kind = 'state' THEN lead(time) OVER (PARTITION BY subject, predicate, object ORDER BY time, event, line) ELSE time END AS valid_to,
  concat_ws(' ', subject, predicate, object, evidence)[:240] AS state_text, evidence[:180] AS quote FROM rel)"""
#: Observations made from mentions: a field per event type, revision by source.
OBS = """obs AS (SELECT 'o' || seq AS observation_id, entity AS event_id, event_type AS field, source AS value_text, (seq % 3)::INT AS revision,
  (seq % 7 = 0)::INT AS is_default, reported_at AS updated_at FROM mention)"""


def observations(spark, d):
    m = V.mentions(spark, d)
    return m.select(F.concat(F.lit("o"), F.col("seq").cast("string")).alias("observation_id"), F.col("entity").alias("event_id"), F.col("event_type").alias("field"), F.col("source").alias("value_text"), (F.col("seq") % 3).cast("int").alias("revision"), (F.col("seq") % 7 == 0).cast("int").alias("is_default"), F.col("reported_at").alias("updated_at"))


def states(spark, d):
    return T.relation_states(V.relations(spark, d))


def e1(spark, d):
    return states(spark, d).select("state_id", "subject", "predicate", "object", "kind", "event", "line", tt("valid_from"), tt("valid_to"), "state_text", "quote")


E1 = sql(f"""SELECT sha1('rel_state:' || concat_ws('|', subject, predicate, object, {ts('valid_from')}, coalesce({ts('valid_to')}, ''), state_text, 'timeline', '0')) AS state_id,
subject, predicate, object, kind, event, line, {ts('valid_from')} AS valid_from, {ts('valid_to')} AS valid_to, state_text, quote FROM st""", REL, STATES)


def e2(spark, d):
    return T.before_edges(V.participants(V.mentions(spark, d))).select("entity_id", "from_id", "to_id", tt("time"))


E2 = sql(f"""SELECT * FROM (SELECT entity_id, lag(event_id) OVER (PARTITION BY entity_id ORDER BY time, event_id) AS from_id, event_id AS to_id, {ts('time')} AS time FROM part_) WHERE from_id IS NOT NULL""", KG)


def e3(spark, d):
    o = T.gap_sessions(V.relations(spark, d), 30)
    return o.select("subject", "predicate", "object", "session", tt("start"), tt("end"), "n", F.array_join("evidence", ",").alias("evidence"))


E3 = sql(f""", g AS (SELECT *, CASE WHEN time > lag(time) OVER w + INTERVAL 30 DAYS THEN 1 ELSE 0 END AS cut FROM rel WINDOW w AS (PARTITION BY subject, predicate, object ORDER BY time, event, line)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY subject, predicate, object ORDER BY time, event, line ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT subject, predicate, object, session::BIGINT AS session, {ts('min(time)')} AS start, {ts('max(time)')} AS "end", count(*) AS n,
array_to_string(list(evidence ORDER BY time, event, line)[:5], ',') AS evidence FROM s GROUP BY subject, predicate, object, s.session""", REL)


def e4(spark, d):
    return T.default_projection(observations(spark, d)).select("event_id", "field", "value_text", "observation_id", "revision")


E4 = sql("""SELECT event_id, field, value_text, observation_id, revision FROM obs
QUALIFY row_number() OVER (PARTITION BY event_id, field ORDER BY is_default DESC, revision DESC, updated_at DESC, observation_id) = 1""", MENTION, OBS)


def f6(spark, d):
    return T.list_observations(observations(spark, d), "user_7").select("field", "revision", "observation_id", "value_text")


F6 = sql("SELECT field, revision, observation_id, value_text FROM obs WHERE event_id = 'user_7'", MENTION, OBS)


def e5(spark, d):
    return T.keyframes(V.relations(spark, d), 60).select("pos", tt("time"))


E5 = sql(f""", s AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM rel))
SELECT pos, {ts('time')} AS time FROM s WHERE pos % greatest(1, ceil(n / 60)::BIGINT) = 0 OR pos = n - 1""", REL)


def e6(spark, d):
    return T.uniform_frames(states(spark, d), 12).select("idx", tt("time"))


E6 = sql(f""", b AS (SELECT epoch(min(valid_from))::BIGINT AS lo, epoch(max(greatest(valid_from, coalesce(valid_to, valid_from))))::BIGINT AS hi FROM st)
SELECT i::INT AS idx, strftime(make_timestamp((lo + i * (hi - lo) // 11) * 1000000), '%Y-%m-%d %H:%M:%S') AS time FROM b, range(12) r(i)""", REL, STATES)


def e7(spark, d):
    s = states(spark, d).withColumn("valid_to", F.when(F.col("line") == 7, F.col("valid_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to")))
    return T.interval_bounds(s).select(tt("lo"), tt("hi"), "open", "n")


E7 = sql(f""", c AS (SELECT valid_from, CASE WHEN line = 7 THEN NULL WHEN valid_to >= valid_from THEN valid_to END AS valid_to FROM st)
SELECT {ts('min(valid_from)')} AS lo, {ts('max(coalesce(valid_to, valid_from))')} AS hi, count(*) FILTER (valid_to IS NULL) AS open, count(*) AS n FROM c""", REL, STATES)


def e8(spark, d):
    s = states(spark, d)
    return T.relation_timeline(s, "Supplier#000000007", "N", "NATION_3").select("event", "line", tt("valid_from"), tt("valid_to"))


E8 = sql(f"""SELECT event, line, {ts('valid_from')} AS valid_from, {ts('valid_to')} AS valid_to FROM st
WHERE subject = 'Supplier#000000007' AND predicate = 'N' AND object = 'NATION_3' ORDER BY st.valid_from, st.valid_to NULLS LAST, event, line LIMIT 200""", REL, STATES)


def c16(spark, d):
    s = states(spark, d)
    at = T.active_at(s, "1998-06-15 00:00:00")
    return at.groupBy("predicate", "kind").count().withColumnRenamed("count", "n")


C16 = sql("SELECT predicate, kind, count(*) AS n FROM st WHERE valid_from <= TIMESTAMP '1998-06-15' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1998-06-15') GROUP BY ALL", REL, STATES)


def frames(spark, d):
    return V.relations(spark, d).select(F.trunc("time", "quarter").cast("timestamp_ntz").alias("time")).distinct().withColumn("idx", (F.year("time") * 4 + F.quarter("time")).cast("int"))


FRAMES = "fr AS (SELECT DISTINCT date_trunc('quarter', time)::TIMESTAMP AS time, (year(time) * 4 + quarter(time))::INT AS idx FROM rel)"


def c16b(spark, d):
    return T.active_per_frame(states(spark, d), frames(spark, d))


C16B = sql("""SELECT idx, count(*) FILTER (valid_to IS NULL OR valid_to >= fr.time) AS active, count(*) AS started FROM fr JOIN st ON valid_from <= fr.time GROUP BY idx
UNION ALL SELECT idx, 0, 0 FROM fr WHERE NOT EXISTS (SELECT 1 FROM st WHERE valid_from <= fr.time)""", REL, STATES, FRAMES)


def c17(spark, d):
    s = states(spark, d).select(F.concat_ws("-", "event", "line").alias("id"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"))
    return T.frame_deltas(frames(spark, d).select("idx", F.col("time").alias("ts")), s).select("id", "enters", F.coalesce("exits", F.lit(-1)).alias("exits"))


C17 = sql(""", s AS (SELECT event || '-' || line AS id, valid_from AS a, valid_to AS b FROM st), f AS (SELECT * FROM fr)
SELECT id, enters, coalesce(exits, -1)::INT AS exits FROM (SELECT id, any_value(a) AS a, any_value(b) AS b, (SELECT min(idx) FROM f WHERE f.time >= s.a) AS enters, (SELECT min(idx) FROM f WHERE f.time > s.b) AS exits FROM s GROUP BY id, s.a, s.b)
WHERE a <= (SELECT max(time) FROM f) AND (b IS NULL OR b >= (SELECT min(time) FROM f)) AND (exits IS NULL OR enters < exits)""", REL, STATES, FRAMES)


def d9(spark, d):
    return T.relation_summary(V.relations(spark, d)).select("subject", "predicate", "object", tt("first_time"), tt("last_time"), "n", F.array_join("evidence", ",").alias("evidence"))


D9 = sql(f""", e AS (SELECT subject, predicate, object, evidence, min((time, event, line)) AS place, min(time) AS lo, max(time) AS hi, count(*) AS n FROM rel GROUP BY ALL)
SELECT subject, predicate, object, {ts('min(lo)')} AS first_time, {ts('max(hi)')} AS last_time, sum(n)::BIGINT AS n, array_to_string(list(evidence ORDER BY place)[:5], ',') AS evidence FROM e GROUP BY subject, predicate, object""", REL)


def d18(spark, d):
    return T.relation_history(V.relations(spark, d), 5).select("subject", "object", "n", "predicate", tt("time"), "event", "line")


D18 = sql(f"SELECT subject, object, n::INT AS n, predicate, {ts('time')} AS time, event, line FROM (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY time, event, line) AS n FROM rel) q WHERE n <= 5".replace("strftime(time", "strftime(q.time"), REL)


def c5(spark, d):
    r = V.relations(spark, d)
    m = r.where("line > 2").select("event", F.concat_ws("-", "event", "line").alias("mention_id"), F.col("evidence").alias("quote"), F.col("time").alias("reported_at"))
    return T.relation_context(r, m).select("event", "line", "subject", "mention_id", "quote")


C5 = sql(""", m AS (SELECT event, arg_min(event || '-' || line, (time, event || '-' || line)) AS mention_id, arg_min(evidence, (time, event || '-' || line)) AS quote FROM rel WHERE line > 2 GROUP BY event)
SELECT event, line, subject, mention_id, quote FROM rel LEFT JOIN m USING (event)""", REL)


def c7(spark, d):
    r = V.relations(spark, d)
    return T.missing_states(r, T.relation_states(r.where("event % 3 = 0")))


C7 = sql("SELECT DISTINCT subject, predicate, object FROM rel EXCEPT SELECT subject, predicate, object FROM rel WHERE event % 3 = 0", REL)


def g2(spark, d):
    return T.distinct_triples(V.relations(spark, d))


G2 = sql("SELECT DISTINCT subject, predicate, object FROM rel", REL)

QUERIES = {
    "E1_relation_states": e1, "E2_before_edges": e2, "E3_gap_sessions": e3, "E4_default_projection": e4, "E5_keyframes": e5, "E6_uniform_frames": e6, "E7_interval_bounds": e7, "E8_relation_timeline": e8,
    "C5_relation_context": c5, "C7_missing_relation_states": c7, "C16_active_states_at": c16, "C16_active_states_per_frame": c16b, "C17_frame_deltas": c17,
    "D9_relation_summary": d9, "D18_relation_history": d18, "F6_list_observations": f6, "G2_distinct_triples": g2,
}
ORACLE = {
    "E1_relation_states": E1, "E2_before_edges": E2, "E3_gap_sessions": E3, "E4_default_projection": E4, "E5_keyframes": E5, "E6_uniform_frames": E6, "E7_interval_bounds": E7, "E8_relation_timeline": E8,
    "C5_relation_context": C5, "C7_missing_relation_states": C7, "C16_active_states_at": C16, "C16_active_states_per_frame": C16B, "C17_frame_deltas": C17,
    "D9_relation_summary": D9, "D18_relation_history": D18, "F6_list_observations": F6, "G2_distinct_triples": G2,
}
