"""Knowledge-graph inputs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, abstract, entity, reported_at, source, event_type, value: one row per row of events."""
    return mentions_of(table(spark, sf_dir, "events"))


def mentions_of(e: DataFrame) -> DataFrame:
    """Mentions from rows of events, a stream of them too."""
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("abstract"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"),
        F.col("ts").alias("reported_at"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("source"),
        "event_type", "value",
    )


#: Line items that one task joins with their orders, about.
LINES = 1_000_000


def dealt_lines(lines: DataFrame) -> DataFrame:
    """Stored line items dealt by order to so many tasks that each sorts about LINES of them: partitions that are only merged by their compressed size sort many more."""
    n = -(-lines.count() // LINES)  # the files' footers tell
    return lines.repartition(max(n, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey") if n > 1 else lines


def relations(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """From line items (or a stream of them): event, line, subject, predicate, object, time, kind, evidence: one row per line item."""
    t = lambda n: table(spark, sf_dir, n)
    # an order's nation is found before its lines come, so that these are dealt out once
    whose = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    order = t("orders").select("o_orderkey", "o_custkey").join(whose, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    li = (dealt_lines(t("lineitem")) if lines is None else lines).join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(
        F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("line"), F.col("s_name").alias("subject"),
        F.col("l_returnflag").alias("predicate"), F.col("n_name").alias("object"), F.col("l_shipdate").alias("time"),
        F.when(F.col("l_linestatus") == "O", "state").otherwise("event").alias("kind"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("evidence"),
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id, edge_type, time, confidence: consecutive orders of a customer."""
    o = table(spark, sf_dir, "orders")
    last = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    kinds = F.create_map(*[F.lit(x) for kv in (("1", "causes"), ("2", "escalates"), ("3", "responds_to"), ("4", "related"), ("5", "follows")) for x in kv])
    e = o.select(last.alias("from_id"), F.col("o_orderkey").alias("to_id"), kinds[F.substring("o_orderpriority", 1, 1)].alias("edge_type"), F.col("o_orderdate").alias("time"), F.round(F.col("o_totalprice") % 1, 2).alias("confidence"))
    return e.where("from_id is not null")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_id, to_id: each part key to its half."""
    return table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("from_id"), F.expr("p_partkey div 2").alias("to_id"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, url, title, content, language, published_at: documents as articles."""
    return news_of(table(spark, sf_dir, "documents"))


def news_of(d: DataFrame) -> DataFrame:
    """Articles from documents, a stream of them too."""
    return d.select(
        F.col("doc_id").alias("id"), "source",
        F.concat(F.lit("http://"), F.col("source"), F.lit("/"), (F.col("doc_id") % 300).cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.col("lang").alias("language"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("published_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, type, status, priority, input_hash, created_at, updated_at, error: orders as review tasks."""
    o = table(spark, sf_dir, "orders")
    status = F.create_map(*[F.lit(x) for kv in (("O", "pending"), ("F", "done"), ("P", "failed")) for x in kv])
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderkey") % 2 == 0, "entity_merge").otherwise("event_merge").alias("type"),
        status[F.col("o_orderstatus")].alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        expr.payload_hash((F.col("o_orderkey") % 5000).cast("string")).alias("input_hash"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("score"),
    )


def entities(m: DataFrame) -> DataFrame:
    """entity_id, name, first_seen, last_seen from mentions."""
    return m.groupBy(F.col("entity").alias("name")).agg(F.min("reported_at").alias("first_seen"), F.max("reported_at").alias("last_seen")).withColumn("entity_id", expr.entity_id(F.col("name")))


def events(m: DataFrame) -> DataFrame:
    """event_id, abstract, event_type, first_seen, last_seen from mentions."""
    e = m.groupBy("abstract", "event_type").agg(F.min("reported_at").alias("first_seen"), F.max("reported_at").alias("last_seen"))
    return e.withColumn("event_id", expr.event_id(F.col("abstract")))


def participants(m: DataFrame) -> DataFrame:
    """event_id, entity_id, time: who takes part in what, since when."""
    p = m.groupBy("abstract", "entity").agg(F.min("reported_at").alias("time"))
    return p.select(expr.event_id(F.col("abstract")).alias("event_id"), expr.entity_id(F.col("entity")).alias("entity_id"), "time")
