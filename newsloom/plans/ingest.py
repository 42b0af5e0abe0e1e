"""Queries of newsloom.operators.ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import ingest as I
from newsloom.plans.temporal import STATES
from newsloom.plans.views import ENT, KG, MENTION, NEWS, REL, sql, ts
from newsloom.sources import views as V


def _half(m, later: bool):
    return m.where((F.col("seq") % 2 == 1) if later else (F.col("seq") % 2 == 0))


def d1(spark, d):
    m = V.mentions(spark, d)
    stored = I.upsert_entities(None, I.entity_rows(m.where("reported_at < '2024-01-16'")))
    out = I.upsert_entities(stored, I.entity_rows(m.where("reported_at >= '2024-01-16'")))
    return out.select("entity_id", "name", expr.ts_text(F.col("first_seen")).alias("first_seen"), expr.ts_text(F.col("last_seen")).alias("last_seen"), F.array_join("sources", ",").alias("sources"), F.size("forms").cast("long").alias("n_forms"))


D1 = sql(f"""SELECT sha1('ent:' || entity) AS entity_id, entity AS name, {ts('min(a)')} AS first_seen, {ts('max(b)')} AS last_seen,
string_agg(source, ',' ORDER BY s) AS sources, 1::BIGINT AS n_forms
FROM (SELECT entity, source, min(seq) AS s, min(reported_at) AS a, max(reported_at) AS b FROM mention GROUP BY ALL) GROUP BY entity""", MENTION)


def d2(spark, d):
    told = V.mentions(spark, d).withColumn("start", F.when(F.col("seq") % 3 == 0, F.col("reported_at")))  # some events tell their start
    o = I.upsert_events(I.event_rows(told))
    return o.select("event_id", "abstract", "summary", expr.ts_text(F.col("start")).alias("start"), expr.ts_text(F.col("first_seen")).alias("first_seen"), expr.ts_text(F.col("last_seen")).alias("last_seen"), F.array_join("event_types", ",").alias("event_types"), F.array_join("sources", ",").alias("sources"))


D2 = sql(f"""SELECT sha1('evt:' || abstract) AS event_id, abstract, arg_max(summary, (length(summary), -seq)) AS summary,
{ts('arg_min(reported_at, seq) FILTER (seq % 3 = 0)')} AS start, {ts('min(reported_at)')} AS first_seen, {ts('max(reported_at)')} AS last_seen,
any_value(event_type) AS event_types, any_value(sources) AS sources
FROM (SELECT *, event_type || ' ' || entity || ' ' || source AS summary FROM mention)
JOIN (SELECT abstract, string_agg(source, ',' ORDER BY s) AS sources FROM (SELECT abstract, source, min(seq) AS s FROM mention GROUP BY ALL) GROUP BY abstract) USING (abstract)
GROUP BY abstract""", MENTION)


def d3(spark, d):
    m = I.mention_rows(V.mentions(spark, d))
    m = m.withColumn("_h", F.substring("mention_id", 1, 1))
    out = I.append_mentions(m.where("_h < '8'"), m)
    return out.select("mention_id", "name_text", expr.ts_text(F.col("reported_at")).alias("reported_at"), "resolved_entity_id")


D3 = sql(f"""SELECT DISTINCT mention_id, entity AS name_text, {ts('reported_at')} AS reported_at, sha1('ent:' || entity) AS resolved_entity_id
FROM (SELECT *, sha1('ent_mention:' || entity || '|' || {ts('reported_at')} || '|' || source) AS mention_id FROM mention) WHERE mention_id[1] >= '8'""", MENTION)


def d4(spark, d):
    m = V.mentions(spark, d)
    rows = m.select(expr.event_id(F.col("abstract")).alias("event_id"), expr.entity_id(F.col("entity")).alias("entity_id"), F.col("source").alias("role"), "reported_at", "seq")
    return I.upsert_participants(rows).select("event_id", "entity_id", "role", expr.ts_text(F.col("reported_at")).alias("reported_at"))


D4 = sql(f"""SELECT sha1('evt:' || abstract) AS event_id, sha1('ent:' || entity) AS entity_id, arg_max(source, (reported_at, seq)) AS role, {ts('max(reported_at)')} AS reported_at
FROM mention GROUP BY abstract, entity""", MENTION)


def d5(spark, d):
    r = V.relations(spark, d).withColumn("kind", F.when(F.col("line") % 3 == 0, "").when(F.col("kind") == "event", "action").otherwise("Persistent"))
    return I.upsert_relations(r).select("event", "subject", "predicate", "object", "kind", "evidence", expr.ts_text(F.col("time")).alias("time"))


D5 = sql(f"""SELECT event, subject, predicate, object, arg_max(k, (time, line)) AS kind, arg_max(evidence, (time, line)) AS evidence, {ts('max(time)')} AS time
FROM (SELECT *, CASE WHEN line % 3 = 0 THEN 'state' ELSE kind END AS k FROM rel) GROUP BY event, subject, predicate, object""", REL)


def d6(spark, d):
    m = V.mentions(spark, d)
    rows = m.select(F.col("entity").alias("event_id"), F.col("event_type").alias("field"), F.col("source").alias("value_text"), F.col("reported_at").alias("created_at"), "seq")
    o = I.upsert_replace(rows, ["event_id", "field"], "seq")
    return o.select("event_id", "field", "value_text", expr.ts_text(F.col("created_at")).alias("created_at"), "seq")


D6 = sql(f"SELECT entity AS event_id, event_type AS field, arg_max(source, seq) AS value_text, {ts('min(reported_at)')} AS created_at, max(seq) AS seq FROM mention GROUP BY ALL", MENTION)


def c8(spark, d):
    n = V.news(spark, d)
    done = n.where("language = 'de' or length(title) % 3 = 0").select(expr.global_id(F.col("source"), F.col("id").cast("string")).alias("global_id"))
    return I.drop_processed(n, done).select("global_id", "language")


C8 = sql("SELECT source || ':' || id AS global_id, language FROM news WHERE NOT (language = 'de' OR length(title) % 3 = 0)", NEWS)


def c12(spark, d):
    m, r = V.mentions(spark, d), V.relations(spark, d)
    refs = r.select(F.col("subject").alias("name"), "time").union(r.select(F.col("object").alias("name"), "time")).union(m.select("entity", "reported_at"))
    return I.complete_missing(V.entities(m), refs).select("entity_id", "name", expr.ts_text(F.col("first_seen")).alias("first_seen"))


C12 = sql(f"""SELECT sha1('ent:' || name) AS entity_id, name, {ts('min(time)')} AS first_seen
FROM (SELECT subject AS name, time FROM rel UNION ALL SELECT object, time FROM rel) GROUP BY name""", REL)


def a16(spark, d):
    m = V.mentions(spark, d)
    forms = lambda x: I.ordered_items(x.withColumn("entity_id", expr.entity_id(F.col("entity"))), ["entity_id"], "source", "seq", "forms")
    add, known = I.append_only(forms(m.where("reported_at < '2024-01-03'")), forms(m.where("reported_at >= '2024-01-03'")))
    tell = lambda x, s: x.select("entity_id", F.lit(s).alias("state"), F.array_join(F.array_sort("forms"), ",").alias("forms"))
    return tell(add, "new").union(tell(known, "known"))


A16 = sql("""SELECT sha1('ent:' || entity) AS entity_id, CASE WHEN bool_or(old) THEN 'known' ELSE 'new' END AS state, string_agg(DISTINCT source, ',' ORDER BY source) AS forms
FROM (SELECT entity, source, reported_at < TIMESTAMP '2024-01-03' AS old FROM mention) GROUP BY entity HAVING bool_or(NOT old)""", MENTION)


def g4(spark, d):
    m = V.mentions(spark, d)
    return I.new_vs_known(m, m.where("seq % 100 < 40 and event_type = 'error'"), "abstract")


G4 = sql("SELECT abstract, bool_or(seq % 100 < 40 AND event_type = 'error') AS known FROM mention GROUP BY abstract", MENTION)


def d19(spark, d):
    m = V.mentions(spark, d)
    return I.change_summary(m.where("reported_at >= '2024-01-20'"), m.where("reported_at < '2024-01-20' and value < 5"))


D19 = sql("""SELECT 'entities' AS what, count(*) FILTER (NOT known) AS new, count(*) FILTER (known) AS repeated
FROM (SELECT entity, bool_or(reported_at < '2024-01-20' AND value < 5) AS known, bool_or(reported_at >= '2024-01-20') AS now FROM mention GROUP BY entity) WHERE now
UNION ALL SELECT 'events', count(*) FILTER (NOT known), count(*) FILTER (known)
FROM (SELECT abstract, bool_or(reported_at < '2024-01-20' AND value < 5) AS known, bool_or(reported_at >= '2024-01-20') AS now FROM mention GROUP BY abstract) WHERE now""", MENTION)


#: Per table of D20 its key, and what else must agree.
_KEYS = {"entities": ["entity_id"], "events": ["event_id"], "participants": ["event_id", "entity_id"], "entity_mentions": ["mention_id"], "event_mentions": ["mention_id"], "news_event": ["news_id", "event_id"], "relations": ["event", "subject", "predicate", "object"], "states": ["event", "line"]}
_MORE = {"entities": lambda: F.concat_ws(",", F.col("sources.id")), "events": lambda: F.concat_ws(",", F.col("sources.name")), "relations": lambda: F.col("kind"), "states": lambda: expr.ts_text(F.col("valid_to"))}


def d20(spark, d):
    """A row per row of every table: its key, and a column more of some."""
    out = None
    for name, df in I.ingest(V.mentions(spark, d), V.relations(spark, d)).items():
        more = _MORE[name]() if name in _MORE else F.lit(None)
        one = df.select(F.lit(name).alias("table"), F.concat_ws("|", *_KEYS[name]).alias("key"), more.cast("string").alias("more"))
        out = one if out is None else out.unionByName(one)
    return out


D20 = sql(f"""SELECT 'entities' AS "table", sha1('ent:' || entity) AS key, string_agg(sha1('src:' || source), ',' ORDER BY s) AS more FROM (SELECT entity, source, min(seq) AS s FROM mention GROUP BY ALL) GROUP BY entity
UNION ALL SELECT DISTINCT 'entities', sha1('ent:' || name), '' FROM (SELECT subject AS name FROM rel UNION SELECT object FROM rel) WHERE name NOT IN (SELECT entity FROM mention)
UNION ALL SELECT 'events', sha1('evt:' || abstract), string_agg(source, ',' ORDER BY s) FROM (SELECT abstract, source, min(seq) AS s FROM mention GROUP BY ALL) GROUP BY abstract
UNION ALL SELECT 'participants', event_id || '|' || entity_id, NULL FROM part_
UNION ALL SELECT DISTINCT 'entity_mentions', sha1('ent_mention:' || entity || '|' || {ts('reported_at')} || '|' || source), NULL FROM mention
UNION ALL SELECT DISTINCT 'event_mentions', sha1('evt_mention:' || abstract || '|' || {ts('reported_at')} || '|' || source), NULL FROM mention
UNION ALL SELECT DISTINCT 'news_event', source || '|' || sha1('evt:' || abstract), NULL FROM mention
UNION ALL SELECT 'relations', event || '|' || subject || '|' || predicate || '|' || object, arg_max(kind, (time, line)) FROM rel GROUP BY event, subject, predicate, object
UNION ALL SELECT 'states', event || '|' || line, {ts('valid_to')} FROM st""", KG, REL, STATES)


def h10(spark, d):
    """Each entity's sources as structs; every other mention has an id only, or a name with blanks."""
    m = V.mentions(spark, d)
    one = F.struct(F.when(F.col("seq") % 3 == 0, F.col("source")).alias("id"), F.when(F.col("seq") % 3 != 0, F.concat(F.lit(" "), "source")).alias("name"), F.lit("u").alias("url"))
    first = m.groupBy("entity", one.alias("x")).agg(F.min("seq").alias("seq"))
    packed = first.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("seq", "x"))).alias("l"))  # distinct sources
    e = packed.select("entity", F.explode(expr.source_list(F.transform("l", lambda y: y["x"]))).alias("s"))
    return e.select("entity", "s.id", "s.name", "s.url")


H10 = sql("""SELECT entity, id, arg_min(name, seq) AS name, 'u' AS url FROM (SELECT entity, seq, source AS name, CASE WHEN seq % 3 = 0 THEN source ELSE sha1('src:' || source) END AS id FROM mention) GROUP BY entity, id""", MENTION)

QUERIES = {
    "D1_upsert_entities": d1, "D2_upsert_events": d2, "D3_append_mentions": d3, "D4_upsert_participants": d4, "D5_upsert_relations": d5, "D6_upsert_replace": d6,
    "C8_drop_processed_news": c8, "C12_complete_missing_entities": c12, "A16_append_only_update": a16, "G4_new_vs_known": g4, "D19_change_summary": d19, "D20_ingest_events": d20, "H10_source_lists": h10,
}
ORACLE = {
    "D1_upsert_entities": D1, "D2_upsert_events": D2, "D3_append_mentions": D3, "D4_upsert_participants": D4, "D5_upsert_relations": D5, "D6_upsert_replace": D6,
    "C8_drop_processed_news": C8, "C12_complete_missing_entities": C12, "A16_append_only_update": A16, "G4_new_vs_known": G4, "D19_change_summary": D19, "D20_ingest_events": D20, "H10_source_lists": H10,
}
