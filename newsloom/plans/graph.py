"""Queries of newsloom.operators.graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import graph as G
from newsloom.operators import temporal as T
from newsloom.plans.temporal import STATES
from newsloom.plans.views import EDGE, KG, MENTION, REL, sql, ts
from newsloom.sources import views as V

tt = lambda c: expr.ts_text(F.col(c)).alias(c)
MAIN = "main AS (SELECT event_id, upper(abstract) AS display FROM ev WHERE event_type = 'error')"
GE = "ge AS (SELECT entity_id AS src, event_id AS dst, time FROM part_)"
DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {0} UNION ALL SELECT dst FROM {0}) GROUP BY node)"
TOP = "top AS (SELECT * FROM deg ORDER BY degree DESC, node LIMIT {})"
COOC = "co AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS n FROM part_ x JOIN part_ y ON x.event_id = y.event_id AND x.entity_id < y.entity_id GROUP BY ALL)"
INSIDE = "src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)"


def kg(spark, d):
    m = V.mentions(spark, d)
    return m, V.entities(m), V.events(m), V.participants(m)


def main(ev):
    return ev.where("event_type = 'error'").select("event_id", F.upper("abstract").alias("display"))


def c1(spark, d):
    _, _, ev, p = kg(spark, d)
    return G.participants_with_events(p, ev, main(ev)).select("event_id", "entity_id", "abstract", tt("time"))


C1 = sql(f"SELECT event_id, entity_id, coalesce(display, abstract) AS abstract, {ts('part_.time')} AS time FROM part_ JOIN ev USING (event_id) LEFT JOIN main USING (event_id)", KG, MAIN)


def c2(spark, d):
    _, _, ev, _ = kg(spark, d)
    return G.display_names(ev.select("event_id", F.col("abstract").alias("name")), main(ev), "event_id")


C2 = sql("SELECT event_id, coalesce(display, abstract) AS name FROM ev LEFT JOIN main USING (event_id)", KG, MAIN)


def names(ent):
    """The same entity under its main name, its name and an alias, in that order of trust."""
    return ent.where("length(name) = 6").select(F.upper("name").alias("name"), "entity_id", F.lit(1).alias("way")).union(ent.select("name", "entity_id", F.lit(2))).union(
        ent.select(F.concat(F.lit("u"), F.regexp_extract("name", r"(\d)\d*$", 1)), "entity_id", F.lit(3)))


NAMES = "nm AS (SELECT upper(name) AS name, entity_id, 1 AS way FROM ent WHERE length(name) = 6 UNION ALL SELECT name, entity_id, 2 FROM ent UNION ALL SELECT 'u' || regexp_extract(name, '(\\d)\\d*$', 1), entity_id, 3 FROM ent)"


def c3(spark, d):
    _, ent, ev, p = kg(spark, d)
    ids = G.lookup(names(ent), spark.createDataFrame([("USER_7",), ("user_12",), ("u5",)], "name string"))
    return G.entity_timeline(p, ev.withColumn("start", F.when(F.col("event_type") == "click", F.col("last_seen"))), ids).select("event_id", "abstract", tt("time"))


C3 = sql(f""", ids AS (SELECT arg_min(entity_id, (way, entity_id)) AS entity_id FROM nm WHERE name IN ('USER_7', 'user_12', 'u5') GROUP BY name)
SELECT DISTINCT event_id, abstract, {ts("CASE WHEN event_type = 'click' THEN last_seen ELSE first_seen END")} AS time FROM part_ JOIN ev USING (event_id) WHERE entity_id IN (SELECT entity_id FROM ids)""", KG, NAMES)


def c19(spark, d):
    _, ent, _, _ = kg(spark, d)
    return G.lookup(names(ent), names(ent).select("name"))


C19 = sql("SELECT name, arg_min(entity_id, (way, entity_id)) AS entity_id, min(way) AS way FROM nm GROUP BY name", KG, NAMES)


def c19b(spark, d):
    """Asked by upper-case main names (every third user), names, aliases ("a_" + name) and aliases that a redirect moves."""
    _, ent, _, _ = kg(spark, d)
    k = F.regexp_extract("name", r"(\d+)", 1).cast("int")
    main = ent.where(k % 3 == 0).select("entity_id", F.upper("name").alias("main_name"))
    alias = ent.select("entity_id", F.concat(F.lit("a_"), F.col("name")).alias("alias"))
    moved = ent.where(k >= 40).select(F.col("entity_id").alias("from_id"), expr.entity_id(F.concat(F.lit("user_"), (k % 40).cast("string"))).alias("to_id"))
    asked = main.select(F.col("main_name").alias("name")).union(ent.select("name")).union(alias.select("alias"))
    return G.entity_records(ent, asked, main, alias, moved).select("name", "entity_id", "main_name", "way", tt("first_seen"), F.array_join("aliases", ",").alias("aliases"))


C19B = sql(f""", k AS (SELECT *, regexp_extract(name, '(\\d+)', 1)::INT AS k FROM ent),
w AS (SELECT upper(name) AS name, entity_id, 0 AS way FROM k WHERE k % 3 = 0 UNION ALL SELECT name, entity_id, 1 FROM k
UNION ALL SELECT 'a_' || name, CASE WHEN k >= 40 THEN sha1('ent:user_' || (k % 40)) ELSE entity_id END, 2 FROM k)
SELECT w.name, entity_id, CASE WHEN k % 3 = 0 THEN upper(k.name) ELSE k.name END AS main_name, way, {ts('first_seen')} AS first_seen, 'a_' || k.name AS aliases FROM w JOIN k USING (entity_id)""", KG)


def c4(spark, d):
    _, ent, _, p = kg(spark, d)
    return G.cooccurrence(p, 20)


C4 = sql("SELECT a, b, n FROM co WHERE n >= 20", KG, COOC)


def c4b(spark, d):
    _, _, _, p = kg(spark, d)
    return G.cooccurrence(p, 24, listed=True).select("a", "b", F.array_join("events", ",").alias("events"))


C4B = sql("""SELECT a, b, string_agg(x.event_id, ',' ORDER BY x.event_id) AS events FROM co JOIN part_ x ON x.entity_id = a JOIN part_ y ON y.entity_id = b AND y.event_id = x.event_id WHERE n >= 24 GROUP BY a, b""", KG, COOC)


def c9(spark, d):
    r = V.relations(spark, d)
    n = r.select(F.col("subject").alias("name")).union(r.select("object")).distinct().select(expr.entity_id(F.col("name")).alias("entity_id"), F.lower("name").alias("name"))
    r = r.select("event", "line", expr.entity_id(F.col("subject")).alias("subject_id"), expr.entity_id(F.col("object")).alias("object_id"))
    return G.relations_named(r, n).select("event", "line", "subject_name", "object_name")


C9 = sql("SELECT event, line, lower(subject) AS subject_name, lower(object) AS object_name FROM rel", REL)


def _bridge(m):
    return G.news_bridge(m.select(F.col("source").alias("news_id"), "abstract"))


def c10(spark, d):
    m, _, ev, _ = kg(spark, d)
    b = _bridge(m)
    got = G.events_by_news(b, ev, b.select("news_id"))
    return got.groupBy("news_id").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max("abstract").alias("last_abstract"))


C10 = sql("SELECT source AS news_id, count(*) AS n_events, min(e) AS first_event, max(abstract) AS last_abstract FROM (SELECT DISTINCT source, abstract, sha1('evt:' || abstract) AS e FROM mention) GROUP BY source", MENTION)


def c10b(spark, d):
    m, _, ev, _ = kg(spark, d)
    news = m.groupBy(F.col("source").alias("news_id")).agg(F.min("seq").alias("first_seq"))
    return G.news_by_event(_bridge(m), news, ev.where("event_type <> 'click'")).select("event_id", "news_id", "first_seq")


C10B = sql("SELECT DISTINCT sha1('evt:' || abstract) AS event_id, source AS news_id, first_seq FROM mention JOIN (SELECT source, min(seq) AS first_seq FROM mention GROUP BY source) USING (source) WHERE event_type <> 'click'", MENTION)


def c11(spark, d):
    return G.event_samples(kg(spark, d)[3], 5).select("entity_id", "event_id", "n", tt("time"))


C11 = sql(f"SELECT entity_id, event_id, n::INT AS n, {ts('q.time')} AS time FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY time DESC, event_id) AS n FROM part_) q WHERE n <= 5", KG)


def c13(spark, d):
    return G.event_pairs(kg(spark, d)[3], 20, 500)


C13 = sql("SELECT x.event_id AS a, y.event_id AS b, count(*) AS n FROM part_ x JOIN part_ y ON x.entity_id = y.entity_id AND x.event_id < y.event_id GROUP BY ALL HAVING count(*) >= 20 ORDER BY n DESC, a, b LIMIT 500", KG)


def d15(spark, d):
    return G.cooccurrence_weight(kg(spark, d)[3], 30, 20)


D15 = sql("SELECT entity_id, sum(n)::BIGINT AS weight FROM (SELECT a AS entity_id, n FROM co WHERE n >= 20 UNION ALL SELECT b, n FROM co WHERE n >= 20) GROUP BY entity_id ORDER BY weight DESC, entity_id LIMIT 30", KG, COOC)


def c18(spark, d):
    return G.neighbours(V.event_edges(spark, d))


C18 = sql("SELECT from_id AS node, to_id AS other, 'out' AS direction, edge_type FROM edge UNION ALL SELECT to_id, from_id, 'in', edge_type FROM edge", EDGE)


def ge(p):
    return p.select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"), "time")


def d10(spark, d):
    return G.degree(ge(kg(spark, d)[3]))


D10 = sql("SELECT node, degree FROM deg", KG, GE, DEG.format("ge"))


def f1(spark, d):
    return G.top_pooled(G.degree(ge(kg(spark, d)[3])), 40)


F1 = sql("SELECT node, degree FROM top", KG, GE, DEG.format("ge"), TOP.format(40))


def f2(spark, d):
    _, ent, _, p = kg(spark, d)
    g = G.degree(ge(p)).join(ent.select(F.col("entity_id").alias("node"), F.lit("entity").alias("t")), "node", "left")
    return G.top_per_type(g.select("node", "degree", F.coalesce("t", F.lit("event")).alias("type")), 15)


F2 = sql("""SELECT node, degree, type, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY degree DESC, node) AS rank FROM
(SELECT node, degree, CASE WHEN node IN (SELECT entity_id FROM ent) THEN 'entity' ELSE 'event' END AS type FROM deg)) WHERE rank <= 15""", KG, GE, DEG.format("ge"))


def f3(spark, d):
    e = ge(kg(spark, d)[3])
    return G.cap_edges(e, G.top_pooled(G.degree(e), 100), 200, ["time", "src", "dst"]).select("src", "dst", tt("time"))


F3 = sql(f"SELECT src, dst, {ts('ge.time')} AS time FROM ge WHERE {INSIDE} ORDER BY ge.time, src, dst LIMIT 200", KG, GE, DEG.format("ge"), TOP.format(100))


def f5(spark, d):
    _, _, ev, p = kg(spark, d)
    o = G.event_timeline(ev.select("event_id", "abstract", F.col("first_seen").alias("time")), p, 25)
    return o.select("event_id", "abstract", tt("time"), F.array_join("entities", ",").alias("entities"))


F5 = sql(f"""SELECT event_id, abstract, {ts('first_seen')} AS time, (SELECT array_to_string(list(entity_id ORDER BY entity_id)[:20], ',') FROM part_ WHERE part_.event_id = e.event_id) AS entities
FROM (SELECT * FROM ev ORDER BY first_seen, event_id LIMIT 25) e""", KG)


def j8(spark, d):
    e = V.event_edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.k_hop(e, [3, 10, 400], 3)[0]


J8 = sql(""", b AS (SELECT from_id AS s, to_id AS t FROM edge UNION SELECT to_id, from_id FROM edge),
w AS (SELECT unnest([3, 10, 400])::BIGINT AS node, 0 AS hop UNION SELECT t, hop + 1 FROM w JOIN b ON s = node WHERE hop < 3)
SELECT node, min(hop)::INT AS hop FROM w GROUP BY node""", EDGE, recursive=True)


def j10(spark, d):
    e = V.event_edges(spark, d).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return G.min_degree_subgraph(e, 2, 3000)[1].select("src", "dst")


J10 = sql(f"SELECT src, dst FROM e WHERE {INSIDE}", EDGE, "e AS (SELECT from_id AS src, to_id AS dst FROM edge)", DEG.format("e"), "top AS (SELECT * FROM deg WHERE degree >= 2 ORDER BY degree DESC, node LIMIT 3000)")


def g1(spark, d):
    m, ent, ev, p = kg(spark, d)
    r, x = V.relations(spark, d), V.event_edges(spark, d)
    nodes = ent.select(F.col("entity_id").alias("node")).union(ev.select("event_id")).union(r.where("subject < 'Supplier#000000050'").select(expr.entity_id(F.col("subject")))).union(r.select(expr.entity_id(F.col("object")))).union(x.where("to_id % 2 = 0 or from_id % 5 = 0").select(F.col("to_id").cast("string")))
    return G.all_edges(p, r, x, nodes).groupBy("type", "title").agg(F.count("*").alias("n"), tt_min("time"))


def tt_min(c):
    return expr.ts_text(F.min(c)).alias(c)


G1 = sql(f""", n AS (SELECT entity_id AS node FROM ent UNION SELECT event_id FROM ev UNION SELECT sha1('ent:' || subject) FROM rel WHERE subject < 'Supplier#000000050' UNION SELECT sha1('ent:' || object) FROM rel
 UNION SELECT to_id::VARCHAR FROM edge WHERE to_id % 2 = 0 OR from_id % 5 = 0),
a AS (SELECT entity_id AS src, event_id AS dst, 'involved_in' AS type, '' AS title, time FROM part_ UNION ALL SELECT sha1('ent:' || subject), sha1('ent:' || object), 'relation', predicate, time FROM rel UNION ALL SELECT from_id::VARCHAR, to_id::VARCHAR, 'event_edge', edge_type, time FROM edge)
SELECT type, title, count(*) AS n, {ts('min(a.time)')} AS time FROM a WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY type, title""", KG, REL, EDGE)


def j1(spark, d):
    return G.graph_ge(kg(spark, d)[3], 60, 300)[1].select("src", "dst", tt("time"))


J1 = sql(f"SELECT src, dst, {ts('ge.time')} AS time FROM ge WHERE {INSIDE} ORDER BY ge.time, src, dst LIMIT 300", KG, GE, DEG.format("ge"), TOP.format(60))


def j2(spark, d):
    p = kg(spark, d)[3]
    return G.graph_get(p, T.before_edges(p), 60, 300)[1].select("src", "dst", "type", tt("time"))


J2 = sql(f""", bf AS (SELECT lag(event_id) OVER (PARTITION BY entity_id ORDER BY time, event_id) AS src, event_id AS dst, time FROM part_)
SELECT src, dst, 'involved_in' AS type, {ts('x.time')} AS time FROM (SELECT * FROM ge WHERE {INSIDE} ORDER BY time, src, dst LIMIT 300) x
UNION ALL SELECT src, dst, 'before', {ts('min(bf.time)')} FROM bf WHERE {INSIDE} GROUP BY src, dst""", KG, GE, DEG.format("ge"), TOP.format(60))


def j3(spark, d):
    return G.graph_ee(T.relation_summary(V.relations(spark, d)), 60, 400)[1].select("src", "dst", "predicate", "n", tt("first_time"), tt("last_time"))


J3 = sql(f"""SELECT src, dst, predicate, n, {ts('lo')} AS first_time, {ts('hi')} AS last_time FROM s WHERE {INSIDE} ORDER BY n DESC, src, dst, predicate LIMIT 400""",
         REL, "s AS (SELECT subject AS src, object AS dst, predicate, count(*) AS n, min(time) AS lo, max(time) AS hi FROM rel GROUP BY ALL)", DEG.format("s"), TOP.format(60))


def j4(spark, d):
    return G.graph_ee_evo(T.relation_states(V.relations(spark, d)))[1].select("src", "dst", "type", tt("time"))


SID = f"sid AS (SELECT *, sha1('rel_state:' || concat_ws('|', subject, predicate, object, {ts('valid_from')}, coalesce({ts('valid_to')}, ''), state_text, 'timeline', '0')) AS state_id FROM st)"
J4 = sql(f"SELECT subject AS src, state_id AS dst, 'rel_in' AS type, {ts('valid_from')} AS time FROM sid UNION ALL SELECT state_id, object, 'rel_out', {ts('valid_from')} FROM sid", REL, STATES, SID)


def j4b(spark, d):
    s = G.sessions_as_states(T.gap_sessions(V.relations(spark, d), 30))
    return G.graph_ee_evo(s)[1].groupBy("src", "type").agg(F.count("*").alias("n")).where("n > 1")


J4B = sql(""", g AS (SELECT *, CASE WHEN time > lag(time) OVER (PARTITION BY subject, predicate, object ORDER BY time, event, line) + INTERVAL 30 DAYS THEN 1 ELSE 0 END AS cut FROM rel),
s AS (SELECT DISTINCT subject, predicate, object, sum(cut) OVER (PARTITION BY subject, predicate, object ORDER BY time, event, line ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT subject AS src, 'rel_in' AS type, count(*) AS n FROM s GROUP BY subject HAVING count(*) > 1""", REL)


def j5(spark, d):
    return G.graph_event_evo(V.event_edges(spark, d), 2000, 500)[1].select("src", "dst", "edge_type", "confidence")


J5 = sql(f"SELECT src, dst, edge_type, confidence FROM e WHERE {INSIDE} ORDER BY confidence DESC, src, dst LIMIT 500", EDGE, "e AS (SELECT from_id AS src, to_id AS dst, edge_type, confidence FROM edge)", DEG.format("e"), TOP.format(2000))


def j6(spark, d):
    m = V.mentions(spark, d)
    role = F.when(F.col("seq") % 11 == 0, F.array(F.lit("主办"), F.lit("被告"))).otherwise(F.array("event_type"))
    p = m.select(expr.event_id(F.col("abstract")).alias("event_id"), expr.entity_id(F.col("entity")).alias("entity_id"), role.alias("roles"))
    return G.affects_edges(p).distinct()


J6 = sql("SELECT DISTINCT sha1('evt:' || abstract) AS src, sha1('ent:' || entity) AS dst FROM mention WHERE seq % 11 = 0", MENTION)


def j7(spark, d):
    """The visual graph: participants of the last ten days among the top of each type, with capped titles."""
    _, ent, ev, p = kg(spark, d)
    return G.graph_visual(p, ent, ev, "2024-01-21 00:00:00")[1]


J7 = sql(""", e AS (SELECT entity_id AS src, event_id AS dst FROM part_ WHERE time >= TIMESTAMP '2024-01-21'), """ + DEG.format("e") + """,
t AS (SELECT node, CASE WHEN node IN (SELECT entity_id FROM ent) THEN 'entity' ELSE 'event' END AS type, degree FROM deg),
top AS (SELECT node FROM t QUALIFY row_number() OVER (PARTITION BY type ORDER BY degree DESC, node) <= 20)
SELECT src, dst, abstract[:12] AS title FROM e JOIN ev ON dst = event_id WHERE """ + INSIDE, KG)


def j9(spark, d):
    m = V.mentions(spark, d)
    docs = m.groupBy("abstract").agg(F.collect_set("entity").alias("entities"))
    nodes, edges = G.document_to_graph(docs)
    return nodes.groupBy("type").agg(F.count("*").alias("n")).union(edges.agg(F.lit("edge"), F.count("*")))


J9 = sql("SELECT 'entity' AS type, count(*) AS n FROM ent UNION ALL SELECT 'event', count(*) FROM ev UNION ALL SELECT 'edge', count(*) FROM part_", KG)


def j12(spark, d):
    _, ent, ev, p = kg(spark, d)
    line = G.entity_timeline(p, ev.withColumn("start", F.lit(None).cast("timestamp_ntz")), ent.where("name = 'user_33'"))
    return G.entity_story(line, "2024-01-05 00:00:00", "2024-01-25 00:00:00").select("from_id", "to_id", tt("time"))


J12 = sql(f"""SELECT coalesce(lag(event_id) OVER (ORDER BY first_seen, event_id), 'start') AS from_id, event_id AS to_id, {ts('first_seen')} AS time
FROM ev WHERE event_id IN (SELECT event_id FROM part_ JOIN ent USING (entity_id) WHERE name = 'user_33') AND ev.first_seen BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""", KG)


def d7(spark, d):
    m, ent, _, p = kg(spark, d)
    return G.entity_stats(ent.select("entity_id", "name"), p, m.select(expr.entity_id(F.col("entity")).alias("entity_id"), "source"))


D7 = sql("SELECT sha1('ent:' || entity) AS entity_id, entity AS name, count(DISTINCT abstract) AS n_events, count(*) AS n_mentions, count(DISTINCT source) AS n_sources FROM mention GROUP BY entity", MENTION)


def d8(spark, d):
    return V.mentions(spark, d).groupBy(expr.event_id(F.col("abstract")).alias("event_id")).agg(F.count("*").alias("n"))


D8 = sql("SELECT sha1('evt:' || abstract) AS event_id, count(*) AS n FROM mention GROUP BY abstract", MENTION)


def d11(spark, d):
    m, ent, ev, p = kg(spark, d)
    return G.stats({"entities": ent, "events": ev, "participants": p, "mentions": m, "relations": V.relations(spark, d)})


D11 = sql("SELECT 'entities' AS name, count(*) AS n FROM ent UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'participants', count(*) FROM part_ UNION ALL SELECT 'mentions', count(*) FROM mention UNION ALL SELECT 'relations', count(*) FROM rel", KG, REL)


def d16(spark, d):
    types, span = G.facets(kg(spark, d)[2])
    return types.select("event_type", "n").union(span.select(F.concat_ws(" ", expr.ts_text(F.col("lo")), expr.ts_text(F.col("hi"))), F.lit(0).cast("long")))


D16 = sql(f"SELECT event_type, count(*) AS n FROM ev GROUP BY event_type UNION ALL SELECT {ts('min(first_seen)')} || ' ' || {ts('max(last_seen)')}, 0 FROM ev", KG)


def d17(spark, d):
    _, _, ev, p = kg(spark, d)
    return G.entity_evidence(p, ev, 3, 9)


D17 = sql("SELECT entity_id, n::INT AS n, abstract[:9] AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY time, event_id) AS n FROM part_) JOIN ev USING (event_id) WHERE n <= 3", KG)

_NAMES = {
    "C1": "participants_with_events", "C2": "display_names", "C3": "entity_timeline", "C4": "entity_cooccurrence", "C4B": "shared_events", "C9": "relations_named", "C10": "events_by_news", "C10B": "news_by_event", "C11": "entity_event_samples",
    "C13": "event_pairs", "C18": "neighbour_edges", "C19": "lookup_entity", "C19B": "entity_records", "D7": "entity_stats", "D8": "mention_counts", "D10": "node_degree", "D11": "kg_stats", "D15": "cooccurrence_weight", "D16": "facets", "D17": "entity_evidence",
    "F1": "top_nodes_pooled", "F2": "top_nodes_per_type", "F3": "cap_edges", "F5": "event_timeline", "G1": "all_edges", "J1": "graph_ge", "J2": "graph_get", "J3": "graph_ee", "J4": "graph_ee_evo", "J4B": "graph_ee_evo_sessions",
    "J5": "graph_event_evo", "J6": "affects_edges", "J7": "graph_visual", "J8": "k_hop", "J9": "document_to_graph", "J10": "min_degree_subgraph", "J12": "entity_story",
}
QUERIES = {f"{k}_{v}": globals()[k.lower()] for k, v in _NAMES.items()}
ORACLE = {f"{k}_{v}": globals()[k] for k, v in _NAMES.items()}
