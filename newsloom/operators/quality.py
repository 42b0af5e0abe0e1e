"""Filters, validation and reports (B*), task statistics (D12-D14, F4), and consistency checks (K*)."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import ship_package

TEXTS = "array<string>"


def validate_events(df: DataFrame) -> DataFrame:
    """B1: rows with an abstract, entities and a summary."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return df.where(filled("abstract") & filled("event_summary") & (F.size("entities") > 0))


def clean_events(df: DataFrame) -> DataFrame:
    """B2: trimmed and defaulted fields; entities_original cut or padded to entities."""
    n = F.size("entities")
    original = F.coalesce("entities_original", F.array().cast(TEXTS))
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    done = {
        "abstract": text("abstract"), "event_summary": text("event_summary"),
        "entities": F.transform(F.coalesce("entities", F.array().cast(TEXTS)), lambda x: F.trim(x)).alias("entities"),
        "entities_original": F.slice(F.concat(original, F.array_repeat(F.lit(""), n)), F.lit(1), n).alias("entities_original"),
    }
    return df.select(*[done.get(c, F.col(c)) for c in df.columns])


def quality_errors(df: DataFrame, required: list[str]) -> DataFrame:
    """Errors: the names of required fields that are missing or blank."""
    blank = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]
    return df.withColumn("errors", F.array_compact(F.array(*blank)))


def days_window(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows no older than `days` before as_of; unreadable times go; no filter for days <= 0."""
    if days <= 0:
        return df
    t = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    return df.where(F.col(column) >= t)


def by_type_and_date(df: DataFrame, kind: str, start: str, end: str) -> DataFrame:
    """Events of a type, in a range of dates or without a date."""
    return df.where(F.array_contains("event_types", kind) & (F.col("time").isNull() | F.col("time").between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)))))


def recent_edges(edges: DataFrame, nodes: DataFrame, as_of: str, hours: int) -> tuple[DataFrame, DataFrame]:
    """(edges of the last hours or undated, the nodes they touch)."""
    e = edges.where(F.col("time").isNull() | (F.col("time") >= F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {hours} HOURS")))
    return e, nodes.join(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")


def normalize_nodes(nodes: DataFrame, colours: dict[str, str], default: str = "#999999") -> DataFrame:
    """Node, label (the id if blank), type, colour by type; rows without an id go."""
    chain = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in colours.items()], F.lit(default))
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), "node")
    return nodes.where(F.coalesce(F.trim("node"), F.lit("")) != "").select("node", label.alias("label"), F.coalesce("type", F.lit("unknown")).alias("type"), chain.alias("colour"))


def validate_snapshot(nodes: DataFrame, edges: DataFrame, meta: DataFrame) -> DataFrame:
    """Problems of a snapshot: blank fields by kind with their number, and counts that differ from meta(n_nodes, n_edges)."""
    def blanks(df, cols):
        return [df.agg(F.lit(f"blank {c}").alias("problem"), F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias("n")) for c in cols]

    rows = [*blanks(nodes, ("node", "label")), *blanks(edges, ("src", "dst"))]
    for df, c in ((nodes, "n_nodes"), (edges, "n_edges")):
        count = df.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
        told = meta.select(F.col(c).alias("m")).withColumn("k", F.lit(1))
        rows.append(count.join(told, "k").select(F.lit(f"{c} differs").alias("problem"), F.abs(F.col("n") - F.col("m")).alias("n")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


def recent_entities(entities: DataFrame, as_of: str, days: int, k: int) -> DataFrame:
    """The k newest entities of the last days."""
    return days_window(entities, "first_seen", as_of, days).orderBy(F.desc("first_seen"), "entity_id").limit(k)


def expand_synonyms(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """asked(name) with the names one step away over edges(name, form), in both directions: (name, synonyms sorted)."""
    both = edges.select("name", "form").union(edges.select("form", "name")).distinct()
    out = asked.join(both, "name").select("name", "form").union(asked.select("name", F.col("name").alias("form"))).distinct()
    return out.groupBy("name").agg(F.array_sort(F.collect_set("form")).alias("synonyms"))


def keyword_search(news: DataFrame, groups: list[list[str]]) -> DataFrame:
    """News that contain a keyword of every group."""
    for words in groups:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower("content"), F.lit(w.lower()))
        news = news.where(hit)
    return news


def search(df: DataFrame, column: str, query: str, since: str | None = None, time: str = "first_seen", limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows whose column contains the query, newest first, a page of them."""
    hit = df.where(F.contains(F.lower(column), F.lit(query.lower())))
    hit = hit.where(F.col(time) >= F.to_timestamp_ntz(F.lit(since))) if since else hit
    return hit.orderBy(F.desc(time), column).offset(offset).limit(limit)


def time_ranges(spark, as_of: str, days: int, earliest: str = "2020-01-01") -> DataFrame:
    """(idx, start, end): windows of `days` days back from as_of, one day apart, to the earliest date."""
    step = days + 1
    n = f"floor(datediff(DATE '{as_of}', DATE '{earliest}') / {step})"
    w = spark.range(1).select(F.explode(F.expr(f"sequence(0, cast({n} as int))")).alias("idx"))
    end = F.date_sub(F.lit(as_of).cast("date"), F.col("idx") * step)
    return w.select("idx", F.greatest(F.date_sub(end, F.lit(days)), F.lit(earliest).cast("date")).alias("start"), end.alias("end")).where("end >= start")


def counts_in_ranges(ranges: DataFrame, news: DataFrame, time: str = "published_at") -> DataFrame:
    """News by window. News are counted by day before they meet the windows' days."""
    per_day = news.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    days = ranges.select("idx", F.explode(F.sequence("start", "end")).alias("day"))
    return days.join(per_day, "day").groupBy("idx").agg(F.sum("n").alias("n"))


def stop_words(df: DataFrame, column: str, stops: DataFrame) -> DataFrame:
    """B14"""
    return df.join(stops.select(F.col("word").alias(column)), column, "left_anti")


def truncated(text: Column, most: int = 2000, mark: str = "...[cut]") -> Column:
    """B15"""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def event_report(events: DataFrame, k: int) -> DataFrame:
    """The newest k events as report rows, with the total."""
    total = events.count()
    top = events.orderBy(F.desc("published_at"), "abstract").limit(k)
    # at most k rows are ranked in one window
    rank = F.row_number().over(W.orderBy(F.desc("published_at"), "abstract"))
    return top.select(rank.alias("rank"), "abstract", "published_at", "source", F.array_join("entities", ", ").alias("entities"), "summary", F.lit(total).alias("total"))


#: Characters of all forms up to which they are one automaton in every task (some twenty times that in memory).
FORMS = 8 << 20
#: Words that more forms than that meet texts on, at most.
HEAD = 3
_BUILT: dict = {}


def _automaton(shared):
    """The automaton of the broadcast forms, built once per worker process."""
    import ahocorasick

    if _BUILT.get("forms") is not shared.value:
        a = ahocorasick.Automaton()
        for form in shared.value:
            a.add_word(f" {form} ", form)
        a.make_automaton()
        _BUILT.update(forms=shared.value, automaton=a)
    return _BUILT["automaton"]


def _scan(batches, shared):
    a = _automaton(shared)
    for b in batches:
        ids, forms = [], []
        for i, text in enumerate(b.column("t").to_pylist()):
            for form in dict.fromkeys(f for _, f in a.iter(f" {text or ''} ")):
                ids.append(i)
                forms.append(form)
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), pa.array(forms, pa.string())], ["id", "form"])


def forms_in(texts: DataFrame, forms: DataFrame) -> DataFrame:
    """texts(id, t) and forms(form), both of words with one blank between -> (id, form): the forms that are whole words of each text.

    Forms of up to FORMS characters are one automaton, with which each text is read once. More of them meet the texts'
    runs of up to HEAD words; longer ones meet on their first HEAD words and are then looked for in the text.
    """
    f = forms.select("form").where("form <> ''").distinct()
    if (f.agg(F.sum(F.length("form"))).first()[0] or 0) <= FORMS:
        ship_package(texts.sparkSession)
        shared = texts.sparkSession.sparkContext.broadcast([r["form"] for r in f.collect()])  # at most FORMS characters
        kind = texts.schema["id"].dataType.simpleString()
        return texts.select("id", "t").mapInArrow(partial(_scan, shared=shared), f"id {kind}, form string")
    f = f.withColumn("w", F.size(F.split("form", " "))).withColumn("key", F.substring_index("form", " ", HEAD))
    lengths = sorted(r[0] for r in f.select(F.least("w", F.lit(HEAD))).distinct().collect())  # HEAD rows at most
    words = texts.select("id", F.split("t", " ").alias("_w"))
    run = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.array_join(F.slice("_w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    met = words.select("id", F.explode(F.array_distinct(F.concat(*[run(n) for n in lengths]))).alias("key")).join(f, "key")
    whole = met.where(F.col("w") <= HEAD).select("id", "form")
    if f.where(F.col("w") > HEAD).limit(1).count():  # a text comes once to all long forms that begin in it
        long = met.where(F.col("w") > HEAD).groupBy("id").agg(F.collect_set("form").alias("_f")).join(texts.select("id", F.concat(F.lit(" "), "t", F.lit(" ")).alias("_t")), "id")
        inside = F.filter("_f", lambda x: F.contains(F.col("_t"), F.concat(F.lit(" "), x, F.lit(" "))))
        whole = whole.union(long.select("id", F.explode(inside).alias("form")))
    return whole


def news_for_entities(news: DataFrame, forms: DataFrame, k: int) -> DataFrame:
    """forms(entity_id, form) of one or more words: the newest k articles that contain one, once per (entity, url, published_at)."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    f = forms.select("entity_id", plain("form").alias("form")).where("form <> ''").distinct()
    found = forms_in(news.select("id", plain("content").alias("t")), f)
    hit = found.join(news.select("id", "url", "published_at"), "id")
    # what is among an entity's newest k is among the newest k of the form that its article is met by first, so no more of a form spreads to its entities
    newest = lambda key: W.partitionBy(key).orderBy(F.desc("published_at"), "id")
    best = hit.groupBy("form", "url", "published_at").agg(F.min("id").alias("id")).withColumn("n", F.row_number().over(newest("form"))).where(F.col("n") <= k).drop("n")
    one = best.join(f, "form").groupBy("entity_id", "url", "published_at").agg(F.min("id").alias("id"))
    return one.withColumn("n", F.row_number().over(newest("entity_id"))).where(F.col("n") <= k)


def next_task_per_type(tasks: DataFrame) -> DataFrame:
    """of each type the pending task of the highest priority, the oldest first."""
    w = W.partitionBy("type").orderBy(F.desc("priority"), "created_at", "task_id")
    return tasks.where("status = 'pending'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def queue_stats(tasks: DataFrame) -> DataFrame:
    """D12"""
    return tasks.groupBy("type").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "done", "failed")])


def evolution_stats(edges: DataFrame, decisions: DataFrame, tasks: DataFrame, kind: str) -> DataFrame:
    """One row: event edges, decisions of one kind of review, and its tasks by status; decisions(type), tasks(type, status)."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_k", F.lit(1))
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "failed")]
    out = one(edges, F.count("*").alias("event_edges")).join(one(decisions.where(F.col("type") == kind), F.count("*").alias("decisions")), "_k")
    return out.join(one(tasks.where(F.col("type") == kind), *by), "_k").drop("_k")


def failed_tasks(tasks: DataFrame, k: int) -> DataFrame:
    """The k latest failures."""
    return tasks.where("status = 'failed'").orderBy(F.desc("created_at"), "task_id").limit(k)


def article_metrics(news: DataFrame, extracted: DataFrame) -> DataFrame:
    """Fetched, deduped (by url), processed; events, entities, relations and their averages per processed article.

    extracted(id, n_entities, n_relations): a row per event. A url counts through its first id.
    """
    first = news.groupBy("url").agg(F.min("id").alias("id"))
    e = extracted.join(first.select("id"), "id", "left_semi")
    a = news.agg(F.count("*").alias("fetched"), F.count_distinct("url").alias("deduped")).withColumn("k", F.lit(1))
    b = e.agg(F.count_distinct("id").alias("processed"), F.count("*").alias("events"), F.coalesce(F.sum("n_entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("n_relations"), F.lit(0)).alias("relations")).withColumn("k", F.lit(1))
    return a.join(b, "k").drop("k").withColumn("events_per_article", F.round(F.col("events") / F.greatest("processed", F.lit(1)), 4))


def backfill_mentions(entities: DataFrame, stored: DataFrame, source: str = "backfill") -> DataFrame:
    """K1: a mention for each entity that has none."""
    m = entities.select(expr.backfill_mention_id(F.col("entity_id"), expr.ts_text(F.col("first_seen")), F.lit(source)).alias("mention_id"), "entity_id", F.col("first_seen").alias("reported_at"))
    return m.join(stored.select("entity_id").distinct(), "entity_id", "left_anti")


def backfill_kind(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K2: (relations with blank kinds filled, the triples to rebuild)."""
    blank = F.coalesce(F.trim("kind"), F.lit("")) == ""
    fixed = relations.withColumn("kind", F.when(blank, expr.relation_kind(F.lit(""), F.col("predicate"))).otherwise(F.col("kind")))
    return fixed, relations.where(blank).select("subject", "predicate", "object").distinct()


def check_signals(events: DataFrame, signals: DataFrame, counts: DataFrame) -> DataFrame:
    """K3: (event_id, check, status): start date and mention count against signals(event_id, sql_date, num_mentions)."""
    j = events.join(signals, "event_id", "left").join(counts, "event_id", "left")
    ours, theirs = expr.yyyymmdd(F.col("start_text")), F.col("sql_date")

    def status(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | b.isNull(), "unknown").when(a == b, "match").otherwise("mismatch")

    both = F.array(F.struct(F.lit("start_date").alias("check"), status(ours, theirs).alias("status")), F.struct(F.lit("num_mentions").alias("check"), status(F.col("n"), F.col("num_mentions")).alias("status")))
    return j.select("event_id", F.explode(both).alias("_c")).select("event_id", "_c.*")


def check_summary(checks: DataFrame) -> DataFrame:
    """D13"""
    return checks.groupBy("check", "status").agg(F.count("*").alias("n"))


def missing_observations(events: DataFrame, observations: DataFrame, field: str) -> DataFrame:
    """Events without an observation of the field."""
    return events.join(observations.where(F.col("field") == field).select("event_id").distinct(), "event_id", "left_anti")


def missing_by_algorithm(events: DataFrame, observations: DataFrame, algorithm: str, k: int | None = None) -> DataFrame:
    """Event ids without an observation of the algorithm, the earliest seen first; the first k, if set."""
    left = events.join(observations.where(F.col("algorithm") == algorithm).select("event_id").distinct(), "event_id", "left_anti")
    out = left.select("event_id", "first_seen").orderBy("first_seen", "event_id")
    return out if k is None else out.limit(k)


def seed_observations(events: DataFrame, mentions: DataFrame, k: int = 3) -> DataFrame:
    """K4: start_time and description observations of every event, with its first k mentions as evidence."""
    w = W.partitionBy("event_id").orderBy("reported_at", "mention_id")
    first = mentions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    ev = first.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_n", "mention_id"))).alias("_m"))
    e = events.join(ev, "event_id", "left").withColumn("evidence", F.transform("_m", lambda x: x["mention_id"])).drop("_m")
    value = F.explode(F.array(F.struct(F.lit("start_time").alias("field"), expr.ts_text(F.col("start")).alias("value_text")), F.struct(F.lit("description").alias("field"), F.col("abstract").alias("value_text"))))
    o = e.select("event_id", "evidence", value.alias("_v")).select("event_id", "_v.*", "evidence").where("value_text is not null")
    n = F.lit("")
    ident = expr.observation_id(F.col("event_id"), F.col("field"), F.col("value_text"), n, n, n, F.lit("seed"), F.lit(0))
    return o.withColumn("observation_id", ident).withColumn("revision", F.lit(0)).withColumn("is_default", F.lit(1))


def event_context(events: DataFrame, mentions: DataFrame, participants: DataFrame, k: int = 25) -> DataFrame:
    """K5: per event its first k mentions and its participants, packed."""
    w = W.partitionBy("event_id").orderBy("reported_at", "mention_id")
    m = mentions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("_n", "mention_id"))).alias("mentions"))
    p = participants.groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("participants"))
    out = events.join(m, "event_id", "left").join(p, "event_id", "left")
    return out.withColumn("mentions", F.transform("mentions", lambda x: x["mention_id"]))


def accept_observations(raw: DataFrame, fields: list[str]) -> DataFrame:
    """K8: revision-1 default observations from raw(event_id, field, value_text, evidence array<struct<mention_id, quote>>)."""
    full = F.filter("evidence", lambda x: (F.coalesce(x["mention_id"], F.lit("")) != "") & (F.coalesce(F.trim(x["quote"]), F.lit("")) != ""))
    ok = raw.where(F.col("field").isin(*fields) & (F.coalesce(F.trim("value_text"), F.lit("")) != "")).withColumn("evidence", full).where(F.size("evidence") > 0)
    return ok.withColumn("revision", F.lit(1)).withColumn("is_default", F.lit(1))


def standard_event_pipeline(events: DataFrame, required: tuple[str, ...] = ("abstract", "event_summary"), most: int = 2000, stages=()) -> DataFrame:
    """M2: extracted events validated, cleaned, marked with their errors, their abstracts truncated; then the caller's own stages, DataFrame to DataFrame."""
    out = events.transform(validate_events).transform(clean_events).transform(lambda t: quality_errors(t, list(required)))
    out = out.withColumn("abstract", truncated(F.col("abstract"), most))
    for stage in stages:
        out = out.transform(stage)
    return out
