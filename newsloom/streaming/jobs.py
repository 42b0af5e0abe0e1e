"""Structured Streaming versions of the ingest jobs.

Upserts (L2) and relation states (L3) append what a batch brings to a log: L2 the items of entities that it changes, as least
and greatest values, L3 the rows of triples. Merging what is merged changes nothing, so the table comes from the whole log,
whichever query wrote it. Their state is Spark's own: L2's items, and L3's rows that are not older than its watermark. The
`revisions` of both keep whole keys in the state store and log a revision per key. A batch's folder is named after its query and its
number, so a batch that is replayed after a failure replaces itself, and a query with a new
checkpoint never meets the names of an older one. Such a query adds to the table as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsloom.functions import expr
from newsloom.functions.shared import file_system, ship_package
from newsloom.operators import ingest, temporal


class Log:
    """An append-only table under a path that all machines share: a folder per query and batch, complete or not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs, self._at = file_system(spark, path)

    def batches(self) -> list[str]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(n for n in names if self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        have = self.batches()
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in have]) if have else None

    def done(self, query: str, batch: int) -> bool:
        return f"{query}-{batch}" in self.batches()

    def write(self, df: DataFrame, query: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{query}-{batch}")

    def latest(self, keys: list[str]) -> DataFrame | None:
        """The last revision of each key."""
        log = self.read()
        return None if log is None else log.groupBy(*keys).agg(F.max_by(F.struct("*"), "rev").alias("_r")).select("_r.*")


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that a checkpoint belongs to: it outlives restarts, and each new checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def following(log: Log, checkpoint: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends each batch to a log."""

    def run(batch: DataFrame, batch_id: int) -> None:
        log.write(batch, query_id(log.spark, checkpoint), batch_id)

    return run


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_once(stream: DataFrame, batch, checkpoint: str) -> dict:
    """Process all that is there, then stop; returns the last progress."""
    conf, (name, store) = stream.sparkSession.conf, STORE
    before = conf.get(name, None)
    conf.set(name, store)
    try:
        q = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return json.loads(q.lastProgress.json) if q.lastProgress else {}


def stream_news(news: DataFrame, time: str = "published_at", late: str = "1 hour") -> DataFrame:
    """L1: each news item once, by source:id, within the watermark."""
    n = news.withColumn(time, F.col(time).cast("timestamp")).withColumn("global_id", expr.global_id(F.col("source"), F.col("id").cast("string")))
    return n.withWatermark(time, late).dropDuplicatesWithinWatermark(["global_id"])


# ---------------------------------------------------------------- L2


class _Entity(StatefulProcessor):
    """An entity's name by its last mention, its times, and the first mention of each source and form, as one value: a batch reads and writes it once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.one = handle.getValueState("one", ENTITY.split(", ", 1)[1])

    def _merge(self, rows: pd.DataFrame, state: tuple | None, lists: tuple[dict, dict]) -> tuple:
        last = rows.loc[rows["seq"].idxmax()]
        name, seq, lo, hi = last["name"], int(last["seq"]), rows["first_seen"].min(), rows["last_seen"].max()
        rev = 0
        if state is not None:
            rev, lo, hi = state[4], min(lo, state[2]), max(hi, state[3])
            if state[1] > seq:
                name, seq = state[0], state[1]
        for column, known in zip(("source", "form"), lists, strict=True):
            for item, at in zip(rows[column].tolist(), rows["seq"].tolist(), strict=True):
                if item is not None and at < known.get(item, at + 1):
                    known[item] = at
        return name, seq, lo, hi, rev

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.one.get()) if self.one.exists() else None
        lists = ({}, {}) if state is None else tuple(dict(zip(state[i], state[i + 1], strict=True)) for i in (5, 7))
        for part in rows:
            state = self._merge(part, state, lists)
        value = [*state[:4], state[4] + 1]
        for known in lists:
            pairs = sorted((seq, item) for item, seq in known.items())
            value += [[i for _, i in pairs], [int(s) for s, _ in pairs]]
        self.one.update(tuple(value))
        yield pd.DataFrame([[key[0], *value]], columns=[c.split()[0] for c in ENTITY.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.one.update((r.name, int(r.seq), r.first_seen, r.last_seen, int(r.rev), *[list(x) if i % 2 == 0 else [int(s) for s in x] for i, x in enumerate((r.sources, r.sources_seq, r.forms, r.forms_seq))]))

    def close(self) -> None:
        pass


ENTITY = "entity_id string, name string, seq long, first_seen timestamp, last_seen timestamp, rev long, sources array<string>, sources_seq array<long>, forms array<string>, forms_seq array<long>"


def _instants(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


#: What a batch logs: an entity's names (with its times), sources and forms, each with the first and the last mention that has it.
NAME, SOURCE, FORM = 0, 1, 2
_ITEM = ["entity_id", "kind", "item"]


def _merged(rows: DataFrame) -> DataFrame:
    """One row per item of an entity; merging what is merged changes nothing, so batches may come in any order and twice."""
    return rows.groupBy(*_ITEM).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def stream_upserts(mentions: DataFrame, log: Log | None = None) -> DataFrame:
    """L2: the items of entities that each batch changes, merged with all before, in any order of arrival.

    Mentions without an entity go; sources and forms that are null are not listed. The state is Spark's own aggregation
    by item, so no entity costs a call of its own, and one with very many items is many small values. Nothing of the log is read.
    """
    rows = _instants(ingest.entity_rows(mentions.where("entity is not null")), "first_seen", "last_seen")
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("item")) for k, c in ((NAME, "name"), (SOURCE, "source"), (FORM, "form"))])
    each = rows.select("entity_id", F.col("seq").alias("lo"), F.col("seq").alias("hi"), "first_seen", "last_seen", F.inline(items))
    return _merged(each.where("item is not null"))


def entities(log: Log) -> DataFrame:
    """The table of L2: as ingest.upsert_entities gives it."""
    one = _merged(log.read().repartition("entity_id"))
    named = F.col("kind") == NAME
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("lo", "item")))), lambda x: x["item"])
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    table = one.groupBy("entity_id").agg(
        F.max_by("item", F.when(named, F.struct("hi", "item"))).alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), listed(SOURCE).alias("sources"), listed(FORM).alias("forms"),
    )
    return table.select("entity_id", "name", "first_seen", "last_seen", full("sources"), full("forms"))


def stream_revisions(mentions: DataFrame, log: Log) -> DataFrame:
    """L2 with a whole entity and its revision out of every batch, for those who follow entities rather than the table.

    A Python call per entity and batch, which costs milliseconds each. A new query goes on from the last revisions in the log.
    """
    ship_package(log.spark)
    rows = _instants(ingest.entity_rows(mentions.where("entity is not null")), "first_seen", "last_seen")
    known = log.latest(["entity_id"])
    start = None if known is None else known.groupBy("entity_id")
    return rows.groupBy("entity_id").transformWithStateInPandas(_Entity(), ENTITY, "Update", "None", start)


# ---------------------------------------------------------------- L3

_ROWS = "time array<timestamp>, event array<long>, line array<long>, kind array<string>, evidence array<string>, rev array<long>"
STATE = "subject string, predicate string, object string, time timestamp, event long, line long, kind string, evidence string, next timestamp, rev long"


class _Triple(StatefulProcessor):
    """A triple's rows in order; a row comes out when it is new or when what follows it has changed.

    The rows are one value, which a batch reads and writes once. With a watermark, rows before it can get no new follower: only the last of them stays, by a timer if no more rows come.
    """

    def __init__(self, bounded: bool):
        self.bounded = bounded

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", _ROWS)

    def _known(self) -> dict[tuple, list]:
        return {tuple(r[:3]): list(r[3:]) for r in zip(*self.rows.get(), strict=True)} if self.rows.exists() else {}

    def _keep(self, known: dict[tuple, list]) -> None:
        self.rows.update(tuple(map(list, zip(*[(*k, *v) for k, v in known.items()], strict=True))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        order = sorted(known)
        follower = dict(zip(order, [*order[1:], None], strict=False))
        for part in rows:
            for r in part.itertuples():
                known[(r.time, int(r.event), int(r.line))] = [r.kind, r.evidence, known.get((r.time, int(r.event), int(r.line)), (0, 0, 0))[2]]
        order, out = sorted(known), []
        for k, after in zip(order, [*order[1:], None], strict=True):
            if k not in follower or (follower[k] or (None,))[0] != (after or (None,))[0]:
                kind, evidence, rev = known[k]
                known[k] = [kind, evidence, rev + 1]
                out.append((*key, *k, kind, evidence, after[0] if after else pd.NaT, rev + 1))
        if self.bounded:
            self._forget(known, timerValues)
            self.handle.registerTimer(int(order[-1][0].timestamp() * 1000) + 1)
        self._keep(known)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    def _forget(self, known: dict[tuple, list], timerValues) -> None:
        mark, order = timerValues.getCurrentWatermarkInMs(), sorted(known)
        for k, after in zip(order, order[1:], strict=False):
            if after[0].timestamp() * 1000 < mark:
                del known[k]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._known()
        if known:
            self._forget(known, timerValues)
            self._keep(known)
        return iter(())

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known = self._known()
        for r in initialState.itertuples():
            known[(r.time, int(r.event), int(r.line))] = [r.kind, r.evidence, int(r.rev)]
        self._keep(known)

    def close(self) -> None:
        pass


def _rows(relations: DataFrame, late: str | None) -> DataFrame:
    r = relations.select(*temporal.TRIPLE, F.col("time").cast("timestamp").alias("time"), F.col("event").cast("long").alias("event"), F.col("line").cast("long").alias("line"), "kind", "evidence")
    return r.withWatermark("time", late) if late else r


_ROW = [*temporal.TRIPLE, *temporal.ORDER]


def stream_states(relations: DataFrame, log: Log, late: str | None = None) -> DataFrame:
    """L3: the relation rows of each batch, in any order of arrival; `states` tells what follows each.

    Without `late` every row counts, so the log is all there is to keep, and no state is. With it, rows that come later than
    that are dropped (Spark counts them) by Spark's own aggregation by row, whose state holds no row behind the watermark.
    No triple costs a call of its own, and a hot one is many rows.
    """
    r = _rows(relations, late)
    return r.groupBy(*_ROW).agg(F.max(F.struct("kind", "evidence")).alias("_v")).select(*_ROW, "_v.*") if late else r


def stream_state_revisions(relations: DataFrame, log: Log, late: str | None = None) -> DataFrame:
    """L3 with the rows of each batch and those whose next row it changes, the time of the next row and a revision, for those who follow states rather than the table.

    A Python call per triple and batch, which costs milliseconds each. A new query goes on from the last revisions in the log.
    Without `late` every row of a triple is kept; with it the state of a triple shrinks to one row when it is quiet.
    """
    ship_package(log.spark)
    known = log.latest(_ROW)
    start = None if known is None else known.groupBy(*temporal.TRIPLE)
    return _rows(relations, late).groupBy(*temporal.TRIPLE).transformWithStateInPandas(_Triple(bool(late)), STATE, "Update", "EventTime" if late else "None", start)


def states(log: Log) -> DataFrame:
    """The table of L3: as temporal.relation_states gives it, of a row that came more than once one.

    Rows of a triple are sorted once; of equal ones, which lie side by side, the last stays.
    """
    rows = log.read().select(*_ROW, "kind", "evidence").withColumn("time", F.col("time").cast("timestamp_ntz"))
    rows = rows.withColumn("_at", F.struct(*temporal.ORDER))
    order = [*temporal.ORDER, "kind", "evidence"]
    seen = temporal.by_heat(rows, temporal.TRIPLE, lambda r, hot: temporal.stepped(r, temporal.TRIPLE, order, "_at", "_next", 1, hot), stored=True)
    return temporal.states_of(seen.where(~F.col("_next").eqNullSafe(F.col("_at"))).withColumn("next", F.col("_next.time")))


# ---------------------------------------------------------------- L4, L5


def processed_batches(log: Log, checkpoint: str, extract: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """L4: a foreachBatch function that extracts from unprocessed news and marks only what succeeded; failures come again.

    extract(news with global_id) -> rows with global_id of what succeeded. The rows are the marks, so no crash can part them.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        query = query_id(log.spark, checkpoint)
        if log.done(query, batch_id):
            return
        known = log.read()
        fresh = batch.withColumn("global_id", expr.global_id(F.col("source"), F.col("id").cast("string"))) if known is None else ingest.drop_processed(batch, known)
        log.write(extract(fresh), query, batch_id)

    return run


def stream_sessions(relations: DataFrame, gap_days: int = 30, late: str = "0 seconds") -> DataFrame:
    """Gap sessions of each triple on a stream; a gap of exactly gap_days stays together, as in the batch job."""
    r = relations.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    w = F.session_window("time", f"{gap_days} days")
    return r.groupBy(*temporal.TRIPLE, w.alias("w")).agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n")).drop("w")
