"""Queries of newsloom.operators.quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.operators import quality as Q
from newsloom.plans.graph import kg
from newsloom.plans.views import EDGE, KG, MENTION, NEWS, REL, TASK, sql, ts
from newsloom.sources import views as V

tt = lambda c: expr.ts_text(F.col(c)).alias(c)


def extracted(spark, d):
    """Events as an extractor returns them, with gaps."""
    n = V.news(spark, d)
    words = F.split("title", " ")
    return n.select(
        "id", F.when(F.col("id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), "title")).alias("abstract"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("language")).alias("event_summary"),
        F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(words).alias("entities"),
        F.when(F.col("id") % 3 == 0, F.slice(words, 1, 2)).alias("entities_original"),
    )


EXTRACTED = """x AS (SELECT id, CASE WHEN id % 7 = 0 THEN '  ' ELSE ' ' || title END AS abstract, CASE WHEN id % 5 = 0 THEN NULL ELSE language END AS event_summary,
  CASE WHEN id % 11 = 0 THEN []::VARCHAR[] ELSE string_split(title, ' ') END AS entities, CASE WHEN id % 3 = 0 THEN string_split(title, ' ')[:2] END AS entities_original FROM news)"""


def b1(spark, d):
    return Q.validate_events(extracted(spark, d)).select("id", "event_summary")


B1 = sql("SELECT id, event_summary FROM x WHERE trim(abstract) <> '' AND trim(event_summary) <> '' AND len(entities) > 0", NEWS, EXTRACTED)


def b2(spark, d):
    j = lambda c: F.array_join(c, "|").alias(c)
    return Q.clean_events(extracted(spark, d)).select("id", "abstract", "event_summary", j("entities"), j("entities_original"), F.size("entities_original").cast("long").alias("n"))


B2 = sql("""SELECT id, trim(abstract) AS abstract, coalesce(event_summary, '') AS event_summary, array_to_string(list_transform(entities, lambda e: trim(e)), '|') AS entities,
array_to_string(list_concat(coalesce(entities_original, []), list_transform(range(len(entities)), lambda i: ''))[:len(entities)], '|') AS entities_original, len(entities) AS n FROM x""", NEWS, EXTRACTED)


def b3(spark, d):
    return Q.quality_errors(extracted(spark, d), ["abstract", "event_summary"]).select("id", F.array_join("errors", ";").alias("errors"))


B3 = sql("SELECT id, array_to_string(list_filter([CASE WHEN trim(abstract) = '' THEN 'missing abstract' END, CASE WHEN event_summary IS NULL THEN 'missing event_summary' END], lambda e: e IS NOT NULL), ';') AS errors FROM x", NEWS, EXTRACTED)


def b4(spark, d):
    return Q.days_window(V.mentions(spark, d), "reported_at", "2024-01-30 00:00:00", 7).select("seq", "entity")


B4 = sql("SELECT seq, entity FROM mention WHERE reported_at >= TIMESTAMP '2024-01-23'", MENTION)


def b5(spark, d):
    e = kg(spark, d)[2].select("event_id", F.array("event_type", F.lit("any")).alias("event_types"), F.when(F.col("event_type") == "click", F.col("first_seen")).alias("time"))
    return Q.by_type_and_date(e, "any", "2024-01-05", "2024-01-10").select("event_id", tt("time"))


B5 = sql(f"SELECT event_id, CASE WHEN event_type = 'click' THEN {ts('first_seen')} END AS time FROM ev WHERE event_type <> 'click' OR first_seen BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'", KG)


def b6(spark, d):
    _, ent, _, p = kg(spark, d)
    e = p.select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"), "time").where("time < '2024-01-30'")
    edges, nodes = Q.recent_edges(e, ent.select(F.col("entity_id").alias("node"), "name"), "2024-01-30 00:00:00", 12)
    return nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")), "node").select("name", "n")


B6 = sql("SELECT name, count(*) AS n FROM part_ JOIN ent USING (entity_id) WHERE part_.time < TIMESTAMP '2024-01-30' AND part_.time >= TIMESTAMP '2024-01-29 12:00:00' GROUP BY name", KG)


def b7(spark, d):
    m = V.mentions(spark, d)
    n = m.select(F.when(F.col("seq") % 9 != 0, F.concat_ws("-", "entity", "source")).alias("node"), F.when(F.col("seq") % 4 == 0, " ").otherwise(F.col("abstract")).alias("label"), F.col("event_type").alias("type"))
    return Q.normalize_nodes(n, {"click": "#111111", "error": "#ff0000"})


B7 = sql("""SELECT entity || '-' || source AS node, CASE WHEN seq % 4 = 0 THEN entity || '-' || source ELSE abstract END AS label, event_type AS type,
CASE event_type WHEN 'click' THEN '#111111' WHEN 'error' THEN '#ff0000' ELSE '#999999' END AS colour FROM mention WHERE seq % 9 <> 0""", MENTION)


def b8(spark, d):
    m = V.mentions(spark, d)
    nodes = m.select(F.when(F.col("seq") % 9 != 0, F.col("entity")).alias("node"), F.col("abstract").alias("label"))
    edges = m.select(F.col("entity").alias("src"), F.when(F.col("seq") % 13 != 0, F.col("abstract")).otherwise("").alias("dst"))
    return Q.validate_snapshot(nodes, edges, spark.createDataFrame([(10_000, 9_990)], "n_nodes long, n_edges long"))


B8 = sql("""SELECT * FROM (SELECT 'blank node' AS problem, count(*) FILTER (seq % 9 = 0) AS n FROM mention UNION ALL SELECT 'blank dst', count(*) FILTER (seq % 13 = 0) FROM mention
UNION ALL SELECT 'n_nodes differs', abs(count(*) - 10000) FROM mention UNION ALL SELECT 'n_edges differs', abs(count(*) - 9990) FROM mention) WHERE n > 0""", MENTION)


def b9(spark, d):
    e = kg(spark, d)[1]
    return Q.recent_entities(e.withColumn("first_seen", F.col("last_seen")), "2024-01-31 00:00:00", 1, 25).select("entity_id", "name", tt("first_seen"))


B9 = sql(f"SELECT entity_id, name, {ts('last_seen')} AS first_seen FROM ent WHERE ent.last_seen >= TIMESTAMP '2024-01-30' ORDER BY ent.last_seen DESC, entity_id LIMIT 25", KG)


def b10(spark, d):
    m = V.mentions(spark, d)
    e = m.select(F.col("entity").alias("name"), F.col("source").alias("form"))
    return Q.expand_synonyms(e.select("name").union(e.select("form")).distinct(), e).select("name", F.array_join("synonyms", ",").alias("synonyms"))


B10 = sql(""", e AS (SELECT entity AS name, source AS form FROM mention), b AS (SELECT name, form FROM e UNION SELECT form, name FROM e UNION SELECT name, name FROM e UNION SELECT form, form FROM e)
SELECT name, string_agg(form, ',' ORDER BY form) AS synonyms FROM b GROUP BY name""", MENTION)


def b11(spark, d):
    return Q.keyword_search(V.news(spark, d), [["idiot", "License"], ["the", "der"]]).select("id", "source")


B11 = sql("SELECT id, source FROM news WHERE (contains(lower(content), 'idiot') OR contains(lower(content), 'license')) AND (contains(lower(content), 'the') OR contains(lower(content), 'der'))", NEWS)


def b12(spark, d):
    return Q.search(kg(spark, d)[2], "abstract", "CLICK", since="2024-01-04", limit=10, offset=5).select("event_id", "abstract")


B12 = sql("SELECT event_id, abstract FROM ev WHERE contains(lower(abstract), 'click') AND first_seen >= TIMESTAMP '2024-01-04' ORDER BY first_seen DESC, abstract LIMIT 10 OFFSET 5", KG)


def b13(spark, d):
    r = Q.time_ranges(spark, "2024-02-01", 2, "2023-12-25")
    return r.join(Q.counts_in_ranges(r, V.mentions(spark, d), "reported_at"), "idx", "left").select("idx", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


B13 = sql(""", r AS (SELECT i::INT AS idx, greatest(DATE '2024-02-01' - i::INT * 3 - 2, DATE '2023-12-25') AS a, DATE '2024-02-01' - i::INT * 3 AS b FROM range(13) t(i))
SELECT idx, a::VARCHAR AS start, b::VARCHAR AS "end", count(seq) AS n FROM r LEFT JOIN mention ON reported_at::DATE BETWEEN a AND b WHERE b >= a GROUP BY ALL""", MENTION)


def b14(spark, d):
    m = V.mentions(spark, d)
    stops = m.where("value < 0.05").select(F.col("entity").alias("word")).distinct()
    return Q.stop_words(m.select("seq", "entity"), "entity", stops)


B14 = sql("SELECT seq, entity FROM mention WHERE entity NOT IN (SELECT entity FROM mention WHERE value < 0.05)", MENTION)


def b15(spark, d):
    return V.news(spark, d).select("id", Q.truncated(F.col("content"), 500).alias("content"))


B15 = sql("SELECT id, CASE WHEN length(content) > 500 THEN content[:500] || '...[cut]' ELSE content END AS content FROM news", NEWS)


def b16(spark, d):
    n = V.news(spark, d)
    e = n.select(F.col("title").alias("abstract"), "published_at", "source", F.array("language", "source").alias("entities"), F.col("language").alias("summary"))
    return Q.event_report(e, 30).withColumn("published_at", expr.ts_text(F.col("published_at"))).withColumn("total", F.col("total").cast("long"))


B16 = sql(f"""SELECT row_number() OVER (ORDER BY n.published_at DESC, title)::INT AS rank, title AS abstract, {ts('n.published_at')} AS published_at, source, language || ', ' || source AS entities, language AS summary, count(*) OVER () AS total
FROM news n ORDER BY n.published_at DESC, abstract LIMIT 30""", NEWS)


def b17(spark, d):
    n = V.news(spark, d)
    f = n.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity_id"), F.lower(F.regexp_extract("content", r"([\p{L}\p{N}_]{6,}(?: [\p{L}\p{N}_]+)?)", 1)).alias("form")).where("form <> ''")
    return Q.news_for_entities(n, f, 5).select("entity_id", "id", "n", tt("published_at"))


B17 = sql(f""", p AS (SELECT id, url, published_at, ' ' || trim(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS t FROM news),
f AS (SELECT 'e' || id AS entity_id, lower(regexp_extract(content, '([\\p{{L}}\\p{{N}}_]{{6,}}(?: [\\p{{L}}\\p{{N}}_]+)?)', 1)) AS form FROM news),
g AS (SELECT form, url, p.published_at, min(id) AS id FROM (SELECT DISTINCT form FROM f WHERE form <> '') q JOIN p ON contains(t, ' ' || form || ' ') GROUP BY ALL)
SELECT entity_id, id, n::INT AS n, {ts('q.published_at')} AS published_at FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY published_at DESC, id) AS n FROM f JOIN g USING (form)) q WHERE n <= 5""", NEWS)


def d12c(spark, d):
    t = V.tasks(spark, d)
    return Q.evolution_stats(V.event_edges(spark, d), t.where("status = 'done'"), t, "event_merge")


D12C = sql("""SELECT (SELECT count(*) FROM edge) AS event_edges, count(*) FILTER (status = 'done') AS decisions, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM task WHERE type = 'event_merge'""", EDGE, TASK)


def c6b(spark, d):
    m, _, ev, _ = kg(spark, d)
    seen = m.where("event_type <> 'error'").select(expr.event_id(F.col("abstract")).alias("event_id"), F.when(F.col("seq") % 2 == 0, "builder").otherwise("seed").alias("algorithm"))
    return Q.missing_by_algorithm(ev, seen, "builder").select("event_id", expr.ts_text(F.col("first_seen")).alias("first_seen"))


C6B = sql(f"SELECT event_id, {ts('ev.first_seen')} AS first_seen FROM ev WHERE abstract NOT IN (SELECT abstract FROM mention WHERE event_type <> 'error' AND seq % 2 = 0)", KG)


def f4(spark, d):
    return Q.next_task_per_type(V.tasks(spark, d)).select("type", "task_id", "priority")


F4 = sql("SELECT type, task_id, priority FROM task WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY type ORDER BY priority DESC, created_at, task_id) = 1", TASK)


def d12(spark, d):
    return Q.queue_stats(V.tasks(spark, d))


D12 = sql("SELECT type, count(*) AS n, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM task GROUP BY type", TASK)


def d12b(spark, d):
    return Q.failed_tasks(V.tasks(spark, d), 20).select("task_id", tt("created_at"))


D12B = sql(f"SELECT task_id, {ts('task.created_at')} AS created_at FROM task WHERE status = 'failed' ORDER BY task.created_at DESC, task_id LIMIT 20", TASK)


def d14(spark, d):
    n = V.news(spark, d)
    x = n.where("id % 3 <> 0").select("id", (F.length("title") % 5).cast("long").alias("n_entities"), (F.length("content") % 3).cast("long").alias("n_relations"))
    return Q.article_metrics(n, x)


D14 = sql(""", f AS (SELECT min(id) AS id FROM news GROUP BY url), e AS (SELECT id, length(title) % 5 AS n_entities, length(content) % 3 AS n_relations FROM news WHERE id % 3 <> 0 AND id IN (SELECT id FROM f))
SELECT (SELECT count(*) FROM news) AS fetched, (SELECT count(DISTINCT url) FROM news) AS deduped, count(DISTINCT id) AS processed, count(*) AS events, sum(n_entities)::BIGINT AS entities, sum(n_relations)::BIGINT AS relations,
round(count(*) / greatest(count(DISTINCT id), 1), 4) AS events_per_article FROM e""", NEWS)


def k1(spark, d):
    m, ent, _, _ = kg(spark, d)
    stored = m.where("seq % 40 = 0").select(expr.entity_id(F.col("entity")).alias("entity_id"))
    return Q.backfill_mentions(ent, stored).select("mention_id", "entity_id", tt("reported_at"))


K1 = sql(f"SELECT sha1('ent_mention_backfill:' || entity_id || '|' || {ts('first_seen')} || '|backfill') AS mention_id, entity_id, {ts('first_seen')} AS reported_at FROM ent WHERE name NOT IN (SELECT entity FROM mention WHERE seq % 40 = 0)", KG)


def k2(spark, d):
    r = V.relations(spark, d).withColumn("kind", F.when(F.col("line") == 5, " ").otherwise(F.col("kind")))
    fixed, triples = Q.backfill_kind(r)
    return fixed.join(triples, ["subject", "predicate", "object"], "left_semi").groupBy("predicate", "kind").agg(F.count("*").alias("n"))


K2 = sql("SELECT predicate, CASE WHEN line = 5 THEN 'state' ELSE kind END AS kind, count(*) AS n FROM rel WHERE (subject, predicate, object) IN (SELECT (subject, predicate, object) FROM rel WHERE line = 5) GROUP BY ALL", REL)


def _checks(spark, d):
    m, _, ev, _ = kg(spark, d)
    n = m.groupBy(expr.event_id(F.col("abstract")).alias("event_id")).agg(F.count("*").alias("n"))
    h = F.dayofmonth("first_seen") % 7
    sig = ev.join(n, "event_id").where(h != 0).select("event_id", F.when(h == 1, "19990101").otherwise(F.date_format("first_seen", "yyyyMMdd")).alias("sql_date"), (F.col("n") + F.when(h == 2, 1).otherwise(0)).alias("num_mentions"))
    return Q.check_signals(ev.select("event_id", F.when(F.col("event_type") != "error", expr.ts_text(F.col("first_seen"))).alias("start_text")), sig, n)


CHECKS = """chk AS (SELECT event_id, c.* FROM (SELECT event_id, unnest([
  {'check': 'start_date', 'status': CASE WHEN event_type = 'error' OR h = 0 THEN 'unknown' WHEN h = 1 THEN 'mismatch' ELSE 'match' END},
  {'check': 'num_mentions', 'status': CASE WHEN h = 0 THEN 'unknown' WHEN h = 2 THEN 'mismatch' ELSE 'match' END}]) AS c FROM (SELECT *, day(first_seen) % 7 AS h FROM ev)))"""


def k3(spark, d):
    return _checks(spark, d)


K3 = sql('SELECT event_id, "check", status FROM chk', KG, CHECKS)


def d13(spark, d):
    return Q.check_summary(_checks(spark, d))


D13 = sql('SELECT "check", status, count(*) AS n FROM chk GROUP BY ALL', KG, CHECKS)


def event_mentions(m):
    return m.select(expr.event_id(F.col("abstract")).alias("event_id"), F.concat(F.lit("m"), F.col("seq").cast("string")).alias("mention_id"), "reported_at")


def c6(spark, d):
    m, _, ev, _ = kg(spark, d)
    obs = m.where("value > 20").select(expr.event_id(F.col("abstract")).alias("event_id"), F.col("event_type").alias("field"))
    return Q.missing_observations(ev, obs, "click").select("event_id")


C6 = sql("SELECT event_id FROM ev WHERE event_id NOT IN (SELECT sha1('evt:' || abstract) FROM mention WHERE value > 20 AND event_type = 'click')", KG)


def k4(spark, d):
    m, _, ev, _ = kg(spark, d)
    e = ev.select("event_id", "abstract", F.when(F.col("event_type") != "error", F.col("first_seen")).alias("start"))
    return Q.seed_observations(e, event_mentions(m)).select("observation_id", "event_id", "field", "value_text", F.array_join("evidence", ",").alias("evidence"))


K4 = sql(f""", f AS (SELECT sha1('evt:' || abstract) AS event_id, array_to_string(list('m' || seq ORDER BY reported_at, 'm' || seq)[:3], ',') AS evidence FROM mention GROUP BY abstract),
o AS (SELECT event_id, 'description' AS field, abstract AS value_text FROM ev UNION ALL SELECT event_id, 'start_time', {ts('first_seen')} FROM ev WHERE event_type <> 'error')
SELECT sha1('obs:' || concat_ws('|', event_id, field, value_text, '', '', '', 'seed', '0')) AS observation_id, event_id, field, value_text, evidence FROM o JOIN f USING (event_id)""", KG)


def k5(spark, d):
    m, _, ev, p = kg(spark, d)
    return Q.event_context(ev, event_mentions(m), p, 4).select("event_id", F.array_join("mentions", ",").alias("mentions"), F.size("participants").cast("long").alias("n"))


K5 = sql(""", f AS (SELECT sha1('evt:' || abstract) AS event_id, array_to_string(list('m' || seq ORDER BY reported_at, 'm' || seq)[:4], ',') AS mentions, count(DISTINCT entity) AS n FROM mention GROUP BY abstract)
SELECT event_id, mentions, n FROM f""", KG)


def k8(spark, d):
    m = V.mentions(spark, d)
    raw = m.select(F.col("abstract").alias("event_id"), F.col("event_type").alias("field"), F.when(F.col("seq") % 3 == 0, " ").otherwise(F.col("source")).alias("value_text"), F.array(F.struct(F.col("seq").cast("string").alias("mention_id"), F.when(F.col("seq") % 2 == 0, F.col("entity")).alias("quote")), F.struct(F.lit("x").alias("mention_id"), F.when(F.col("seq") % 5 == 0, F.lit("q")).alias("quote"))).alias("evidence"))
    return Q.accept_observations(raw, ["click", "error"]).select("event_id", "field", "value_text", F.array_join(F.transform("evidence", lambda x: x["mention_id"]), ",").alias("evidence"), "revision")


K8 = sql("""SELECT abstract AS event_id, event_type AS field, source AS value_text, concat_ws(',', CASE WHEN seq % 2 = 0 THEN seq::VARCHAR END, CASE WHEN seq % 5 = 0 THEN 'x' END) AS evidence, 1 AS revision
FROM mention WHERE event_type IN ('click', 'error') AND seq % 3 <> 0 AND (seq % 2 = 0 OR seq % 5 = 0)""", MENTION)

_NAMES = {"D12C": "evolution_stats", "C6B": "missing_by_algorithm", 
    "B1": "validate_events", "B2": "clean_events", "B3": "quality_errors", "B4": "days_window_filter", "B5": "filter_by_type_and_date", "B6": "filter_edges_by_hours", "B7": "normalize_nodes", "B8": "validate_snapshot", "B9": "recent_entities",
    "B10": "expand_synonyms", "B11": "keyword_search", "B12": "search_events", "B13": "time_ranges", "B14": "stop_word_filter", "B15": "truncate_content", "B16": "event_report_rows", "B17": "news_for_entities",
    "F4": "next_task_per_type", "D12": "queue_stats", "D12B": "failed_tasks", "D13": "signal_check_summary", "D14": "article_metrics", "C6": "missing_observations",
    "K1": "backfill_mentions", "K2": "backfill_relation_kind", "K3": "validate_against_signals", "K4": "seed_observations", "K5": "event_context", "K8": "accept_observations",
}
QUERIES = {f"{k}_{v}": globals()[k.lower()] for k, v in _NAMES.items()}
ORACLE = {f"{k}_{v}": globals()[k] for k, v in _NAMES.items()}
