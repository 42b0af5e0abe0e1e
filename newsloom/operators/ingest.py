"""Upserts of mentions into canonical tables (D*), and what keeps them complete.

Every merge is one shuffle on the canonical key with map-side partial aggregates; lists are
pre-aggregated by their items first, so a hot key gathers distinct items, never its mentions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import settle
from newsloom.operators import temporal


def ordered_items(df: DataFrame, keys: list[str], item: str, seq: str, name: str) -> DataFrame:
    """keys, name: the distinct items of each key as an array, by first appearance."""
    one = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(seq).alias("_s"))
    packed = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_s", F.col(item).alias("_i")))).alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda x: x["_i"]).alias(name))


def last_by(df: DataFrame, keys: list[str], order: list[str], keep: dict[str, Column] | None = None) -> DataFrame:
    """The last row of each key by order (D4, D5, D6, I15); keep: aggregates that replace single columns."""
    keep = keep or {}
    rest = [c for c in df.columns if c not in keys and c not in keep]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), *[v.alias(k) for k, v in keep.items()])
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest], *keep).select(*df.columns)


def entity_rows(mentions: DataFrame) -> DataFrame:
    """Mentions as entity rows: entity_id, name, first_seen, last_seen, source, form, seq."""
    return mentions.select(
        expr.entity_id(F.col("entity")).alias("entity_id"), F.trim("entity").alias("name"), F.col("reported_at").alias("first_seen"),
        F.col("reported_at").alias("last_seen"), "source", F.col("entity").alias("form"), "seq",
    )


def upsert_entities(stored: DataFrame | None, rows: DataFrame) -> DataFrame:
    """entity_id, name (last), first_seen (min), last_seen (max), sources, forms (ordered unions).

    stored has the result's columns; its items come before the new ones.
    """
    if stored is not None:
        back = stored.select("entity_id", "name", "first_seen", "last_seen", F.posexplode_outer(F.arrays_zip("sources", "forms")).alias("_p", "_z"))
        rows = back.select("entity_id", "name", "first_seen", "last_seen", F.col("_z.sources").alias("source"), F.col("_z.forms").alias("form"), (F.col("_p") - (1 << 40)).cast("long").alias("seq")).unionByName(rows)
    base = rows.groupBy("entity_id").agg(F.max_by("name", "seq").alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    for item, name in (("source", "sources"), ("form", "forms")):
        base = base.join(ordered_items(rows, ["entity_id"], item, "seq", name), "entity_id", "left")
    return base


def event_rows(mentions: DataFrame) -> DataFrame:
    """Mentions as event rows; a mention's start time, where it has one, is in a column `start`."""
    start = F.col("start") if "start" in mentions.columns else F.lit(None).cast(mentions.schema["reported_at"].dataType)
    return mentions.select(
        expr.event_id(F.col("abstract")).alias("event_id"), F.trim("abstract").alias("abstract"), F.concat_ws(" ", "event_type", "entity", "source").alias("summary"),
        F.col("event_type"), "source", start.alias("start"), "reported_at", "seq",
    )


def upsert_events(rows: DataFrame) -> DataFrame:
    """Per event the longest summary (first of equals), first non-empty start, earliest report, last sight, ordered types and sources."""
    base = rows.groupBy("event_id").agg(
        F.max_by("abstract", "seq").alias("abstract"), F.max_by("summary", F.struct(F.length("summary"), -F.col("seq"))).alias("summary"),
        F.min_by("start", F.when(F.col("start").isNotNull(), F.col("seq"))).alias("start"), F.min("reported_at").alias("first_seen"), F.max("reported_at").alias("last_seen"),
    )
    for item, name in (("event_type", "event_types"), ("source", "sources")):
        base = base.join(ordered_items(rows, ["event_id"], item, "seq", name), "event_id", "left")
    return base


def append_mentions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """D3: the mentions to add: unseen mention_ids, one row each."""
    return new.dropDuplicates(["mention_id"]).join(stored.select("mention_id"), "mention_id", "left_anti")


def mention_rows(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        expr.entity_mention_id(F.col("entity"), expr.ts_text(F.col("reported_at")), F.col("source")).alias("mention_id"),
        F.col("entity").alias("name_text"), "reported_at", expr.entity_id(F.col("entity")).alias("resolved_entity_id"),
    )


def upsert_participants(rows: DataFrame) -> DataFrame:
    """The last write of each (event_id, entity_id), by (reported_at, seq)."""
    return last_by(rows, ["event_id", "entity_id"], ["reported_at", "seq"])


def upsert_relations(rows: DataFrame) -> DataFrame:
    """The last write of each (event, subject, predicate, object), its kind normalized or told from the predicate."""
    kind = rows.withColumn("kind", expr.relation_kind(F.col("kind"), F.col("predicate")))
    return last_by(kind, ["event", "subject", "predicate", "object"], ["time", "line"])


def upsert_replace(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Full replacement per key by the last row, keeping the earliest created_at."""
    return last_by(rows, keys, [seq], {"created_at": F.min("created_at")})


def drop_processed(news: DataFrame, processed: DataFrame) -> DataFrame:
    """News whose global id (source:id) was not processed yet."""
    return news.withColumn("global_id", expr.global_id(F.col("source"), F.col("id").cast("string"))).join(processed.select("global_id"), "global_id", "left_anti")


def complete_missing(entities: DataFrame, references: DataFrame) -> DataFrame:
    """Rows for referenced names that no entity has: entity_id, name, first_seen (earliest reference)."""
    refs = references.groupBy("name").agg(F.min("time").alias("first_seen"))
    refs = refs.select(expr.entity_id(F.col("name")).alias("entity_id"), "name", "first_seen")
    return refs.join(entities.select("entity_id"), "entity_id", "left_anti")


def append_only(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities to add, known entities with their forms extended). Both have entity_id and forms."""
    add = new.join(stored.select("entity_id"), "entity_id", "left_anti")
    both = stored.join(new.select("entity_id", F.col("forms").alias("_f")), "entity_id")
    return add, both.select("entity_id", F.array_union("forms", "_f").alias("forms"))


def new_vs_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Each new key and whether it is known."""
    marked = known.select(key).distinct().withColumn("_k", F.lit(True))
    return new.select(key).distinct().join(marked, key, "left").select(key, F.coalesce("_k", F.lit(False)).alias("known"))


def event_mention_rows(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        expr.event_mention_id(F.col("abstract"), expr.ts_text(F.col("reported_at")), F.col("source")).alias("mention_id"),
        F.col("abstract").alias("abstract_text"), "reported_at", expr.event_id(F.col("abstract")).alias("resolved_event_id"),
    )


def ingest(mentions: DataFrame, relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """All canonical tables of a batch of mentions, and of the relations that came with them.

    Sources are lists of structs (H10). With relations, their last writes, the states of all of them, and
    entities that only they name come too.
    """
    mentions, relations = settle(mentions), relations if relations is None else settle(relations)  # read by every table
    part = mentions.select(expr.event_id(F.col("abstract")).alias("event_id"), expr.entity_id(F.col("entity")).alias("entity_id"), F.array("event_type").alias("roles"), "reported_at", "seq")
    listed = lambda df: df.withColumn("sources", F.coalesce(expr.named_sources(F.col("sources")), F.array().cast("array<struct<id:string,name:string,url:string>>")))
    entities = listed(upsert_entities(None, entity_rows(mentions)))
    out = {
        "events": listed(upsert_events(event_rows(mentions))),
        "participants": upsert_participants(part),
        "entity_mentions": mention_rows(mentions).dropDuplicates(["mention_id"]),
        "event_mentions": event_mention_rows(mentions).dropDuplicates(["mention_id"]),
        "news_event": mentions.select(F.col("source").alias("news_id"), expr.event_id(F.col("abstract")).alias("event_id")).distinct(),
    }
    if relations is not None:
        named = relations.select(F.col("subject").alias("name"), "time").union(relations.select("object", "time"))
        more = complete_missing(entities, named.where("name is not null"))
        kind = entities.schema["sources"].dataType.simpleString()
        more = more.select("entity_id", "name", "first_seen", F.col("first_seen").alias("last_seen"), F.array().cast(kind).alias("sources"), F.array("name").alias("forms"))
        entities = entities.unionByName(more)
        out |= {"relations": upsert_relations(relations), "states": temporal.relation_states(relations)}
    return {"entities": entities, **out}


def change_summary(batch: DataFrame, before: DataFrame) -> DataFrame:
    """Per batch the new entities, new events and repeats, against what came before."""
    out = None
    for what, col in (("entities", "entity"), ("events", "abstract")):
        flags = new_vs_known(batch, before, col)
        one = flags.agg(F.lit(what).alias("what"), F.count_if(~F.col("known")).alias("new"), F.count_if("known").alias("repeated"))
        out = one if out is None else out.unionByName(one)
    return out
