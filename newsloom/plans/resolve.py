"""Queries of newsloom.operators.resolve and newsloom.operators.dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import dedup as D
from newsloom.operators import graph as G
from newsloom.operators import resolve as R
from newsloom.plans.graph import kg
from newsloom.plans.views import EDGE, KG, MENTION, NEWS, REDIRECT, REL, TASK, sql, ts
from newsloom.sources import views as V

tt = lambda c: expr.ts_text(F.col(c)).alias(c)
#: Part names as entity forms: 64 names among them.
FORM = "form AS (SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] || CASE WHEN p_partkey % 2 = 0 THEN ' .' ELSE '' END AS form, p_name FROM part)"
#: The similarity of two texts of ASCII letters, and greedy leaders over first(id, t): each text's earliest leader that is similar.
LIKE = "(CASE WHEN {0} = {1} THEN 1.0 WHEN regexp_replace(lower({0}), '\\W', '', 'g') = regexp_replace(lower({1}), '\\W', '', 'g') THEN 0.98 ELSE jaro_winkler_similarity(lower({0}), lower({1})) END >= 0.93)"
LED = f"""heads AS (SELECT list_reduce(list([t] ORDER BY id), lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: {LIKE.format('h', 'x[1]')})) > 0 THEN acc ELSE list_concat(acc, x) END) AS h FROM first),
led AS (SELECT f.id, f.t, min(m.id) AS leader FROM first f JOIN (SELECT unnest(h) AS t FROM heads) USING (t) JOIN first m ON m.id = f.id GROUP BY ALL
  UNION SELECT f.id, f.t, min(m.id) AS leader FROM first f, (SELECT first.* FROM first JOIN (SELECT unnest(h) AS t FROM heads) USING (t)) m WHERE m.id < f.id AND f.t NOT IN (SELECT unnest(h) FROM heads) AND {LIKE.format('m.t', 'f.t')} GROUP BY ALL)"""
CLOSED = "closed AS (SELECT from_id, 0::BIGINT AS to_id FROM redirect)"


def forms(spark, d):
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.when(F.col("p_partkey") % 2 == 0, " .").otherwise("")).alias("form"))


def c14(spark, d):
    return R.pairs_same_form(forms(spark, d))


C14 = sql("SELECT x.id AS a, y.id AS b, replace(x.p_name, ' ', '') AS key FROM form x JOIN form y ON x.p_name = y.p_name AND x.id < y.id", FORM)


def c14b(spark, d):
    return R.pairs_same_form(V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("form")), star=True)


C14B = sql("SELECT a, p_partkey AS b, replace(p_name, ' ', '') AS key FROM part JOIN (SELECT p_name, min(p_partkey) AS a FROM part GROUP BY p_name) USING (p_name) WHERE p_partkey > a")


def c15(spark, d):
    """Events of one kind whose dates differ in a digit."""
    n = V.mentions(spark, d).select(F.col("abstract").alias("name")).distinct()
    return R.pairs_similar(n.select("name", F.col("name").alias("id"))).select(F.round("score", 6).alias("score"), "a", "b")


def c15b(spark, d):
    """Jaro-Winkler over part names of one first letter."""
    n = V.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    x, y = n.select(F.col("name").alias("a"), F.substring("name", 1, 1).alias("k")), n.select(F.col("name").alias("b"), F.substring("name", 1, 1).alias("k"))
    return x.join(y, "k").where("a < b").select("a", "b", F.round(D.jaro_winkler(F.col("a"), F.col("b")), 6).alias("score")).where("score >= 0.85")


C15B = sql("SELECT x.p_name AS a, y.p_name AS b, round(jaro_winkler_similarity(x.p_name, y.p_name), 6) AS score FROM n x JOIN n y ON x.p_name < y.p_name AND x.p_name[1] = y.p_name[1] WHERE round(jaro_winkler_similarity(x.p_name, y.p_name), 6) >= 0.85", "n AS (SELECT DISTINCT p_name FROM part)")


def i1(spark, d):
    return D.dedup_news(V.news(spark, d), 3)


def i1b(spark, d):
    n = V.news(spark, d)
    done = n.where("language = 'de'").select(expr.global_id(F.col("source"), F.col("id").cast("string")).alias("global_id"))
    return D.dedup_with_history(n, done, 4)[1]


def i1c(spark, d):
    return D.dedup_by_url(V.news(spark, d)).select("id", "url")


I1C = sql("SELECT min(id) AS id, url FROM news GROUP BY url", NEWS)


def i2(spark, d):
    m = V.mentions(spark, d)
    e = m.groupBy("abstract").agg(F.min("seq").alias("id"), F.collect_set("entity").alias("entities"), F.min("source").alias("source"))
    return D.merge_similar_events(e).select("leader", "abstract", "n", F.size("entities").alias("n_entities"))


def i3(spark, d):
    n = V.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return D.precluster(n)


I3 = sql("SELECT id, leader FROM led", "first AS (SELECT min(p_partkey) AS id, p_name AS t FROM part GROUP BY p_name)", LED)


def i3b(spark, d):
    m = V.mentions(spark, d)
    e = m.groupBy("abstract").agg(F.min("seq").alias("id"), F.min("source").alias("summary"))
    return D.precluster_events(e)


I3B = sql("SELECT id, leader FROM led", MENTION, "first AS (SELECT min(seq) AS id, lower(abstract || ' ' || min(source)) AS t FROM mention GROUP BY abstract)", LED)


def i4(spark, d):
    return R.block_cross_type(groups(spark, d)).select("leader", "id")


def groups(spark, d):
    p = V.table(spark, d, "part")
    suffix = F.when(F.col("p_partkey") % 5 == 0, "市").when(F.col("p_partkey") % 7 == 0, "公司").otherwise("")
    return p.select((F.col("p_partkey") % 300).alias("leader"), F.col("p_partkey").alias("id"), F.concat(F.translate("p_name", " ", ""), suffix).alias("name"), (F.col("p_size") % 4).alias("first_seen"))


GROUPS = """grp AS (SELECT p_partkey % 300 AS leader, p_partkey AS id, replace(p_name, ' ', '') || CASE WHEN p_partkey % 5 = 0 THEN '市' WHEN p_partkey % 7 = 0 THEN '公司' ELSE '' END AS name, p_size % 4 AS first_seen,
  CASE WHEN p_partkey % 5 = 0 THEN 'geo' WHEN p_partkey % 7 = 0 THEN 'org' END AS type FROM part)"""
I4 = sql("SELECT leader, id FROM grp WHERE leader NOT IN (SELECT leader FROM grp GROUP BY leader HAVING count(DISTINCT type) > 1)", GROUPS)


def i5(spark, d):
    g = groups(spark, d)
    return R.choose_primary(g).join(g.select(F.col("id").alias("primary"), "name"), "primary").select("leader", "name")


I5 = sql("SELECT leader, arg_min(name, (CASE WHEN type IS NULL THEN 1 ELSE 0 END, first_seen, length(name), name)) AS name FROM grp GROUP BY leader", GROUPS)


def fold(spark, d):
    """Entities user_k redirect to user_(k mod 40), through a chain of two."""
    ent = kg(spark, d)[1].select(F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("k"))
    name = lambda c: expr.entity_id(F.concat(F.lit("user_"), c.cast("string")))
    half = ent.where("k >= 80").select(name(F.col("k")).alias("from_id"), name(F.col("k") - 40).alias("to_id"))
    return R.resolve_redirects(half.union(ent.where("k >= 40 and k < 80").select(name(F.col("k")), name(F.col("k") - 40))))


FOLD = """fold AS (SELECT entity_id AS from_id, sha1('ent:user_' || (regexp_extract(name, '(\\d+)', 1)::INT % 40)) AS to_id FROM ent WHERE regexp_extract(name, '(\\d+)', 1)::INT >= 40)"""


def i6(spark, d):
    m, ent, _, p = kg(spark, d)
    return R.merge_entities(ent, fold(spark, d)).select("entity_id", "name", tt("first_seen"), tt("last_seen"), F.array_join("aliases", ",").alias("aliases"))


I6 = sql(f""", e AS (SELECT ent.*, coalesce(to_id, entity_id) AS id FROM ent LEFT JOIN fold ON entity_id = from_id)
SELECT id AS entity_id, coalesce(max(name) FILTER (id = entity_id), min(name)) AS name, {ts('min(first_seen)')} AS first_seen, {ts('max(last_seen)')} AS last_seen, string_agg(name, ',' ORDER BY name) AS aliases FROM e GROUP BY id""", KG, FOLD)


def i6b(spark, d):
    m, _, _, _ = kg(spark, d)
    p = m.groupBy(expr.event_id(F.col("abstract")).alias("event_id"), expr.entity_id(F.col("entity")).alias("entity_id")).agg(F.min("reported_at").alias("time"), F.collect_set("source").alias("roles"))
    return R.merge_participants(p, fold(spark, d)).select("event_id", "entity_id", tt("time"), F.array_join("roles", ",").alias("roles"))


I6B = sql(f"""SELECT sha1('evt:' || abstract) AS event_id, coalesce(to_id, sha1('ent:' || entity)) AS entity_id, {ts('min(reported_at)')} AS time, string_agg(DISTINCT source, ',' ORDER BY source) AS roles
FROM mention LEFT JOIN fold ON from_id = sha1('ent:' || entity) GROUP BY ALL""", KG, FOLD)


def i6c(spark, d):
    r = V.relations(spark, d)
    c = r.select(F.col("object").alias("from_id")).distinct().where("from_id > 'NATION_2'").select("from_id", F.lit("NATION_1").alias("to_id")).union(r.select("subject").distinct().where("subject < 'Supplier#000000005'").select("subject", F.lit("NATION_1")))
    return R.merge_relations(r, R.resolve_redirects(c)).select("event", "subject", "predicate", "object", tt("time"), F.array_join("evidence", ",").alias("evidence"))


I6C = sql(f""", r AS (SELECT event, CASE WHEN subject < 'Supplier#000000005' THEN 'NATION_1' ELSE subject END AS subject, predicate, CASE WHEN object > 'NATION_2' THEN 'NATION_1' ELSE object END AS object, time, evidence FROM rel)
SELECT event, subject, predicate, object, {ts('min(r.time)')} AS time, string_agg(DISTINCT evidence, ',' ORDER BY evidence) AS evidence FROM r WHERE subject <> object GROUP BY event, subject, predicate, object""", REL)


def i7(spark, d):
    e = V.event_edges(spark, d)
    c = e.select(F.col("to_id").alias("from_id")).union(e.select("from_id")).distinct().where("from_id % 8 <> 0").select("from_id", (F.col("from_id") - F.col("from_id") % 8).alias("to_id"))
    return R.merge_event_edges(e, c).select("from_id", "to_id", "edge_type", "confidence", tt("time"))


I7 = sql(f"SELECT from_id - from_id % 8 AS from_id, to_id - to_id % 8 AS to_id, edge_type, max(confidence) AS confidence, {ts('min(edge.time)')} AS time FROM edge WHERE from_id - from_id % 8 <> to_id - to_id % 8 GROUP BY 1, 2, edge_type", EDGE)


def i7b(spark, d):
    m = V.mentions(spark, d)
    prec = F.element_at(F.array(*map(F.lit, expr.PRECISION)), (F.col("seq") % 4 + 1).cast("int"))
    e = m.select(F.col("seq").alias("event_id"), "abstract", F.concat_ws(" ", "entity", "source").alias("summary"), F.when(F.col("seq") % 3 != 0, F.col("reported_at")).alias("start"), prec.alias("precision"), F.col("reported_at").alias("first_seen"))
    c = m.where("seq % 10 <> 0").select(F.col("seq").alias("from_id"), (F.col("seq") - F.col("seq") % 10).alias("to_id"))
    return R.merge_events(e, c).select("event_id", "abstract", "summary", tt("start"), tt("first_seen"))


I7B = sql(f""", e AS (SELECT *, seq - seq % 10 AS id, entity || ' ' || source AS summary, CASE WHEN seq % 3 <> 0 THEN reported_at END AS start FROM mention)
SELECT id AS event_id, max(abstract) FILTER (seq = id) AS abstract, arg_max(summary, (length(summary), summary)) AS summary, {ts('arg_min(start, (-(seq % 4), start)) FILTER (start IS NOT NULL)')} AS start, {ts('min(reported_at)')} AS first_seen FROM e GROUP BY id""", MENTION)


def i8(spark, d):
    v = V.table(spark, d, "embeddings")
    return R.semantic_matches(v.where("vec_id % 25 = 0"), v, 0.7, "label").select("query_id", "vec_id", F.round("score", 5).alias("score"))


I8 = sql("""SELECT q.vec_id AS query_id, v.vec_id, round((list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2, 5) AS score
FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 25 = 0 AND (list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2 >= 0.7""")


def i9(spark, d):
    return R.resolve_redirects(V.redirects(spark, d))


I9 = sql("SELECT from_id, min(to_id) AS to_id FROM w GROUP BY from_id", REDIRECT, "w AS (SELECT from_id, to_id FROM redirect UNION ALL SELECT w.from_id, r.to_id FROM w JOIN redirect r ON w.to_id = r.from_id)", recursive=True)


def i10(spark, d):
    ent = kg(spark, d)[1]
    rules = ent.where("name like 'user_1%'").select(F.col("name").alias("alias"), F.concat(F.lit("user_2"), F.substring("name", 7, 5)).alias("primary")).union(spark.createDataFrame([("user_2", "user_3")], "alias string, primary string"))
    return R.apply_merge_rules(ent, rules)


I10 = sql(""", r AS (SELECT name, 'user_2' || name[7:] AS p FROM ent WHERE name LIKE 'user_1%' UNION ALL SELECT 'user_2', 'user_3')
SELECT sha1('ent:' || name) AS from_id, sha1('ent:' || CASE WHEN p = 'user_2' THEN 'user_3' ELSE p END) AS to_id FROM r WHERE name IN (SELECT name FROM ent)""", KG)


def i11(spark, d):
    f = forms(spark, d)
    same = lambda n: R.first_pairs_same_form(f, n)
    none = lambda n: R.first_pairs_same_form(f, n, "id % 10 = 0").select("a", "b", F.lit(0.95).alias("score"))
    queued = lambda pairs: pairs.where("(a + b) % 3 = 0").select(expr.payload_hash(F.concat_ws(",", "a", "b")).alias("input_hash"), F.lit("pending").alias("status"))
    return R.enqueue_candidates(same, none, queued, 1000).select("a", "b", "priority", "input_hash")


I11 = sql("SELECT x.id AS a, y.id AS b, 100 AS priority, sha1('payload:' || x.id || ',' || y.id) AS input_hash FROM form x JOIN form y ON x.p_name = y.p_name AND x.id < y.id WHERE (x.id + y.id) % 3 <> 0 ORDER BY a, b LIMIT 1000", FORM)


def i12(spark, d):
    p = kg(spark, d)[3]
    return R.enqueue_event_candidates(G.event_pairs(p, 30, 50), p, 5).select("a", "b", "n", "priority", F.array_join("entities", ",").alias("entities"))


I12 = sql(""", c AS (SELECT x.event_id AS a, y.event_id AS b, count(*) AS n, array_to_string(list(x.entity_id ORDER BY x.entity_id)[:5], ',') AS entities FROM part_ x JOIN part_ y ON x.entity_id = y.entity_id AND x.event_id < y.event_id GROUP BY ALL)
SELECT a, b, n, least(100, n * 10)::INT AS priority, entities FROM c WHERE n >= 30 ORDER BY n DESC, a, b LIMIT 50""", KG)


def _tasks(spark, d):
    t = V.tasks(spark, d).withColumn("input_hash", expr.payload_hash(F.col("task_id").cast("string")))
    t = t.select("input_hash", "task_id", F.col("task_id").alias("a"), (F.col("task_id") + 7).alias("b"), F.concat(F.lit("n"), F.col("task_id").cast("string")).alias("name_a"), F.concat(F.lit("m"), (F.col("task_id") * 3).cast("string")).alias("name_b"))
    out = F.when(F.col("task_id") % 3 == 0, F.concat(F.lit('{"merge": true, "decision": "merge", "canonical_name": "n'), F.col("task_id").cast("string"), F.lit('"}'))).when(F.col("task_id") % 3 == 1, '{"merge": true, "decision": "evolve", "edge_type": "causes", "confidence": 0.5}').otherwise("not json")
    return t, t.select("input_hash", out.alias("output"))


def i13(spark, d):
    return R.plan_entity_merges(*_tasks(spark, d))


I13 = sql("""SELECT CASE WHEN keep_a THEN b ELSE a END AS from_id, CASE WHEN keep_a THEN a ELSE b END AS to_id FROM (SELECT task_id AS a, task_id + 7 AS b, task_id % 3 = 0 OR length('n' || task_id) >= length('m' || task_id * 3) AS keep_a FROM task WHERE task_id % 3 < 2)""", TASK)


def i14(spark, d):
    merge, evolve, skip = R.plan_event_decisions(*_tasks(spark, d))
    return merge.select(F.lit("merge").alias("what"), "from_id", "to_id").union(evolve.select(F.concat_ws(" ", F.lit("evolve"), "edge_type"), "from_id", "to_id")).union(skip.agg(F.lit("skip"), F.count("*"), F.lit(0).cast("long")))


I14 = sql("""SELECT 'merge' AS what, task_id + 7 AS from_id, task_id AS to_id FROM task WHERE task_id % 3 = 0 UNION ALL SELECT 'evolve causes', task_id, task_id + 7 FROM task WHERE task_id % 3 = 1
UNION ALL SELECT 'skip', count(*), 0 FROM task WHERE task_id % 3 = 2""", TASK)


def i15(spark, d):
    t = V.tasks(spark, d)
    return R.upsert_decisions(t.select("input_hash", F.concat_ws("-", "type", "priority").alias("output"), F.col("task_id").alias("seq")), "seq")


I15 = sql("SELECT input_hash, arg_max(type || '-' || priority, task_id) AS output, max(task_id) AS seq FROM task GROUP BY input_hash", TASK)


def i15b(spark, d):
    t = V.tasks(spark, d).withColumn("updated_at", F.col("created_at")).withColumn("status", F.when(F.col("status") == "pending", "running").otherwise(F.col("status")))
    t = R.complete_tasks(R.requeue_stale(t, "1998-01-01 00:00:00", 60), t.where("task_id % 4 = 0").select("input_hash"))
    return t.groupBy("status").agg(F.count("*").alias("n"))


I15B = sql("""SELECT CASE WHEN task_id % 5000 % 4 = 0 THEN 'done' WHEN status = 'pending' THEN CASE WHEN created_at < TIMESTAMP '1997-12-31 23:00:00' THEN 'pending' ELSE 'running' END ELSE status END AS status, count(*) AS n FROM task GROUP BY 1""", TASK)


def i16(spark, d):
    m = V.mentions(spark, d)
    e = m.groupBy("abstract").agg(F.min("reported_at").alias("time"), F.collect_set("entity").alias("entities")).withColumnRenamed("abstract", "event_id")
    return D.bucket_events(e, 3, 10, 5)


def i17(spark, d):
    ent = kg(spark, d)[1].select(F.col("entity_id").alias("id"), "name")
    m = V.mentions(spark, d).where("seq % 30 = 0")
    return R.set_main_names(ent, m.select(expr.entity_id(F.col("entity")).alias("id"), F.upper("entity").alias("name"), "seq"))


I17 = sql("SELECT entity_id AS id, CASE WHEN name IN (SELECT entity FROM mention WHERE seq % 30 = 0) THEN upper(name) ELSE name END AS name FROM ent", KG)


def i18(spark, d):
    """Candidates of one form, all decided to merge, applied to the names."""
    f = forms(spark, d)
    e = f.select(F.col("id").alias("entity_id"), F.col("form").alias("name"), F.lit(0).alias("first_seen"), F.lit(0).alias("last_seen"))
    merged, _ = R.resolve_end_to_end(e, R.pairs_same_form(f, star=True), lambda t: t.select("input_hash", F.lit('{"merge": true}').alias("output")))
    return merged.select("entity_id", "name", F.size("aliases").alias("n_aliases"))


I18 = sql(""", g AS (SELECT id, form, p_name, min(id) OVER (PARTITION BY p_name) AS a, min(id) FILTER (id % 2 = 0) OVER (PARTITION BY p_name) AS even FROM form),
t AS (SELECT *, CASE WHEN a % 2 = 0 THEN a WHEN id % 2 = 0 THEN id ELSE coalesce(even, a) END AS entity_id FROM g)
SELECT entity_id, max(form) FILTER (id = entity_id) AS name, count(DISTINCT form)::INT AS n_aliases FROM t GROUP BY entity_id""", FORM)


def i19(spark, d):
    p = V.table(spark, d, "part")
    e = p.select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").alias("first_seen"))
    decided = e.where("entity_id like '1_'").select(F.col("entity_id").alias("from_id"), F.substring("entity_id", 1, 1).alias("to_id"))
    return R.refresh(e, decided, spark.createDataFrame([("x", "y")], "alias string, primary string"))


I19 = sql(""", best AS (SELECT leader, arg_min(e.id, (size, length(e.t), e.t, e.id)) AS best FROM e JOIN led USING (t) GROUP BY leader),
m AS (SELECT e.id AS from_id, best AS to_id FROM e JOIN led USING (t) JOIN best USING (leader) WHERE e.id <> best)
SELECT * FROM m UNION ALL SELECT p_partkey::VARCHAR, coalesce((SELECT to_id FROM m WHERE from_id = '1'), '1') FROM part WHERE p_partkey::VARCHAR LIKE '1_'""",
    "e AS (SELECT p_partkey::VARCHAR AS id, p_name AS t, p_size AS size FROM part WHERE p_partkey::VARCHAR NOT LIKE '1_')", "first AS (SELECT min(id) AS id, t FROM e GROUP BY t)", LED)


def responses(spark, d):
    r = V.relations(spark, d)
    ev = r.groupBy("event").agg(F.array_sort(F.collect_set("subject")).alias("s"), F.array_sort(F.collect_set("object")).alias("o"), F.array_sort(F.collect_list(F.struct("line", F.struct("subject", "predicate", "object", F.lit("state").alias("relation_kind"), F.array("evidence").alias("evidence"))))).alias("rel"))
    one = F.struct(F.concat(F.lit("event "), F.col("event").cast("string")).alias("abstract"), F.when(F.col("event") % 7 == 0, "").otherwise("a summary").alias("event_summary"), F.array(F.lit("t"), F.lit("t")).alias("event_types"), F.concat("s", "o").alias("entities"), F.transform("rel", lambda x: x["col2"]).alias("relations"))
    j = F.to_json(one)
    text = F.when(F.col("event") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n["), j, F.lit("]\n```\nDone."))).when(F.col("event") % 3 == 1, F.concat(F.lit('{"events": ['), j, F.lit("]}"))).otherwise(j)
    return ev.select(F.col("event").alias("id"), F.when(F.col("event") % 11 == 0, "no json here").otherwise(text).alias("response"))


def k6(spark, d):
    ok, failed = R.parse_responses(responses(spark, d))
    return ok.select("id", F.col("event.abstract").alias("abstract"), F.size("event.relations").cast("long").alias("n")).union(failed.select("id", F.lit("failed"), F.lit(0).cast("long")))


K6 = sql("SELECT event AS id, CASE WHEN event % 11 = 0 THEN 'failed' ELSE 'event ' || event END AS abstract, CASE WHEN event % 11 = 0 THEN 0 ELSE count(*) END AS n FROM rel GROUP BY event", REL)


def k7(spark, d):
    c = R.clean_extractions(R.parse_responses(responses(spark, d))[0])
    return c.select("id", "abstract", F.size("entities").cast("long").alias("n_entities"), F.size("event_types").cast("long").alias("n_types"), F.size("relations").cast("long").alias("n_relations"))


K7 = sql("SELECT event AS id, 'event ' || event AS abstract, count(DISTINCT subject) + count(DISTINCT object) AS n_entities, 1::BIGINT AS n_types, count(DISTINCT (subject, predicate, object)) AS n_relations FROM rel WHERE event % 11 <> 0 AND event % 7 <> 0 GROUP BY event", REL)


def k11(spark, d):
    r = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit('```\n[{"primary": "'), "n_name", F.lit('", "duplicates": ["'), "n_name", F.lit('", "r'), F.col("n_regionkey").cast("string"), F.lit('"]}]\n```')).alias("response"))
    return R.parse_merge_decisions(r)


K11 = "SELECT 'r' || n_regionkey AS duplicate, arg_min(n_name, n_nationkey) AS primary FROM nation GROUP BY n_regionkey"

_NAMES = {
    "C14": "pairs_same_form", "C14B": "pairs_same_form_star", "C15": "pairs_similar", "C15B": "pairs_jaro_winkler", "I1": "dedup_news_simhash", "I1B": "dedup_with_history", "I1C": "dedup_by_url", "I2": "merge_similar_events", "I3": "precluster_entities", "I3B": "precluster_events",
    "I4": "block_cross_type_groups", "I5": "choose_primary", "I6": "merge_entities", "I6B": "merge_participants", "I6C": "merge_relations", "I7": "merge_event_edges", "I7B": "merge_events", "I8": "semantic_entity_matches", "I9": "resolve_redirects",
    "I10": "apply_merge_rules", "I11": "enqueue_entity_candidates", "I12": "enqueue_event_candidates", "I13": "plan_entity_merges", "I14": "plan_event_decisions", "I15": "upsert_merge_decisions", "I15B": "complete_and_requeue_tasks", "I16": "bucket_events",
    "I17": "set_main_names", "I18": "resolve_end_to_end", "I19": "refresh_graph", "K6": "parse_llm_responses", "K7": "clean_extractions", "K11": "merge_decisions_parse",
}
QUERIES = {f"{k}_{v}": globals()[k.lower()] for k, v in _NAMES.items()}
ORACLE = {f"{k}_{v}": globals()[k] for k, v in _NAMES.items() if k in globals()}
