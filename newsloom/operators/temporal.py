"""Validity intervals, sessions, frames and timelines (E*, and the interval joins of C*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import settle

TRIPLE = ["subject", "predicate", "object"]
ORDER = ["time", "event", "line"]


#: Rows of one key that a window may sort in one task; keys with more are cut into slices of time.
HOT = 1_000_000


def sliced(rows: DataFrame, *order: str) -> DataFrame:
    """rows dealt by ranges of order, with the number of the range as _p, as a table."""
    return settle(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def by_heat(rows: DataFrame, keys: list[str], job, stored: bool = False) -> DataFrame:
    """job(rows, False), for keys with up to about HOT rows, with job(rows, True) for the others, if there are any.

    Both give the same rows, so a sample, in which a key of HOT rows has about 10,000, tells well enough which way a key takes.
    """
    rows = rows if stored else settle(rows)  # what the rows come from is worked out once
    step = max(1, HOT // 10_000)
    some = rows if step == 1 else rows.sample(1 / step, 7)
    hot = some.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * step > HOT).select(*keys)
    if not hot.limit(1).count():
        return job(rows, False)
    hot = settle(hot)
    same = [rows[k].eqNullSafe(hot[k]) for k in keys]
    return job(rows.join(hot, same, "left_anti"), False).unionByName(job(rows.join(hot, same, "left_semi"), True))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left as l and right as r, joined on keys, nulls included."""
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def stepped(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str, step: int = 1, hot: bool = False) -> DataFrame:
    """rows with a column's value in the next row of the key (step 1) or in the one before (step -1).

    Hot keys are cut into slices by range; a slice's last (first) row takes the value from the first (last) row of
    the next slice (the one before), of which there is one per key and slice.
    """
    near = F.lead if step > 0 else F.lag
    if not hot:
        return rows.withColumn(name, near(column).over(W.partitionBy(*keys).orderBy(*order)))
    part = sliced(rows, *keys, *order)
    item = F.struct(F.struct(*order), F.col(column).alias("v"))
    edge = part.groupBy("_p", *keys).agg((F.min(item) if step > 0 else F.max(item)).alias("_e"))
    edge = edge.withColumn("_e", near("_e").over(W.partitionBy(*keys).orderBy("_p")))
    inside = part.withColumn("_in", near(F.struct(F.col(column).alias("v"))).over(W.partitionBy("_p", *keys).orderBy(*order)))
    value = F.when(F.col("l._in").isNotNull(), F.col("l._in.v")).otherwise(F.col("r._e.v"))
    return _beside(inside, edge, ["_p", *keys]).select(*[F.col(f"l.{c}") for c in rows.columns], value.alias(name))


def summed(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str, hot: bool = False) -> DataFrame:
    """rows with the running sum of a column per key; of hot keys by slices, with the sums of the slices before added."""
    run = lambda *by: F.sum(column).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    if not hot:
        return rows.withColumn(name, run(*keys))
    part = sliced(rows, *keys, *order)
    w = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = part.groupBy("_p", *keys).agg(F.sum(column).alias("_s")).withColumn("_low", F.coalesce(F.sum("_s").over(w), F.lit(0)))
    return _beside(part.withColumn("_in", run("_p", *keys)), before, ["_p", *keys]).select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_in") + F.col("_low")).alias(name))


def top_rows(rows: DataFrame, keys: list[str], order: list[str], k: int, name: str, hot: bool = False) -> DataFrame:
    """The first k rows of each key, numbered; of hot keys first those of each slice."""
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    if hot:
        rows = sliced(rows, *keys, *order).withColumn("_k", rank("_p", *keys)).where(F.col("_k") <= k).drop("_k", "_p")
    return rows.withColumn(name, rank(*keys)).where(F.col(name) <= k)


def relation_states(relations: DataFrame, algorithm: str = "timeline") -> DataFrame:
    """One state per relation row, valid to the triple's next row (null: open); an event's state ends where it starts.

    Per triple by (time, event, line). state_text is capped at 240 characters, quote at 180.
    """
    return states_of(by_heat(relations, TRIPLE, lambda r, hot: stepped(r, TRIPLE, ORDER, "time", "next", 1, hot)), algorithm)


def states_of(rows: DataFrame, algorithm: str = "timeline") -> DataFrame:
    """The states of relation rows that know the time of their triple's next row."""
    to = F.when(F.col("kind") == "state", F.col("next")).otherwise(F.col("time"))
    text = F.substring(F.concat_ws(" ", *TRIPLE, "evidence"), 1, 240)
    s = rows.select(*TRIPLE, "kind", "event", "line", F.col("time").alias("valid_from"), to.alias("valid_to"), text.alias("state_text"), F.substring("evidence", 1, 180).alias("quote"))
    ident = expr.state_id(*[F.col(c) for c in TRIPLE], expr.ts_text(F.col("valid_from")), expr.ts_text(F.col("valid_to")), F.col("state_text"), F.lit(algorithm), F.lit(0))
    return s.withColumn("state_id", ident).withColumn("algorithm", F.lit(algorithm)).withColumn("revision", F.lit(0))


def before_edges(participants: DataFrame) -> DataFrame:
    """(entity_id, from_id, to_id, time): each entity's consecutive events."""
    rows = participants.select("entity_id", "event_id", "time")
    p = by_heat(rows, ["entity_id"], lambda r, hot: stepped(r, ["entity_id"], ["time", "event_id"], "event_id", "from_id", -1, hot))
    return p.select("entity_id", "from_id", F.col("event_id").alias("to_id"), "time").where("from_id is not null")


def _sessions(rows: DataFrame, gap: Column) -> DataFrame:
    """Sessions of triples that one task may sort: each from its last row, by two windows of one order and no groups.

    Nulls of time come first, so they are in a triple's first session only.
    """
    w = W.partitionBy(*TRIPLE).orderBy(*ORDER)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    apart = lambda early, late: F.coalesce(F.col(late) > F.col(early) + gap, F.lit(False))
    five = F.array(F.col("evidence"), *[F.lead("evidence", k).over(w) for k in range(1, 5)])
    rows = rows.select(*TRIPLE, *ORDER, F.row_number().over(w).alias("_place"), five.alias("_five"), F.lag("time").over(w).alias("_before"), F.lead("time").over(w).alias("_after"), F.lead(F.lit(1)).over(w).alias("_more"))
    rows = rows.withColumn("_cut", apart("_before", "time")).withColumn("_last", F.col("_more").isNull() | apart("time", "_after"))
    first = F.when(F.col("_cut") | (F.col("_place") == 1), F.struct(F.col("_place").alias("place"), "time", F.col("_five").alias("five")))
    rows = rows.select(*TRIPLE, "time", "_place", "_last", F.sum(F.col("_cut").cast("int")).over(so_far).alias("session"), F.last(first, ignorenulls=True).over(so_far).alias("_open"), F.min("time").over(so_far).alias("_low")).where("_last")
    rows = rows.withColumn("n", (F.col("_place") - F.col("_open.place") + 1).cast("long"))
    few = F.transform(F.slice("_open.five", F.lit(1), F.least(F.col("n"), F.lit(5)).cast("int")), lambda x, k: F.struct((k + 1).alias("_n"), x.alias("evidence")))
    return rows.select(*TRIPLE, "session", F.when(F.col("session") == 0, F.col("_low")).otherwise(F.col("_open.time")).alias("start"), F.col("time").alias("end"), "n", few.alias("_e"))


def gap_sessions(relations: DataFrame, gap_days: int = 30) -> DataFrame:
    """A triple's history split where the gap exceeds gap_days: start, end, n, the first five evidences."""
    key, gap = [*TRIPLE, "session"], F.expr(f"INTERVAL {gap_days} DAYS")

    def job(rows: DataFrame, hot: bool) -> DataFrame:
        if not hot:
            return _sessions(rows, gap)
        marked = stepped(rows, TRIPLE, ORDER, "time", "_before", -1, hot)
        marked = marked.withColumn("_cut", F.coalesce(F.col("time") > F.col("_before") + gap, F.lit(False)).cast("int"))
        numbered = settle(summed(marked, TRIPLE, ORDER, "_cut", "session", hot))
        few = top_rows(numbered, key, ORDER, 5, "_n", hot).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_n", "evidence"))).alias("_e"))
        whole = numbered.groupBy(*key).agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("n"))
        return _beside(whole, few, key).select("l.*", "r._e")

    return by_heat(relations, TRIPLE, job).withColumn("evidence", F.transform("_e", lambda x: x["evidence"])).drop("_e")


def default_projection(observations: DataFrame) -> DataFrame:
    """The best observation of each (event_id, field): default first, then revision, then update; ties by observation_id."""
    order = [F.desc("is_default"), F.desc("revision"), F.desc("updated_at"), F.asc("observation_id")]
    return observations.withColumn("_r", F.row_number().over(W.partitionBy("event_id", "field").orderBy(*order))).where("_r = 1").drop("_r")


def list_observations(observations: DataFrame, event_id: str) -> DataFrame:
    """an event's observations in order of field, revision (newest first)."""
    return observations.where(F.col("event_id") == event_id).orderBy("field", F.desc("revision"), "observation_id")


def keyframes(starts: DataFrame, max_frames: int = 60) -> DataFrame:
    """E5: (idx, time): every k-th distinct start and the last, about max_frames of them.

    Starts are numbered inside range partitions and shifted by the counts before, so no task sorts all of them.
    """
    spark = starts.sparkSession
    part = settle(starts.select("time").where("time is not null").distinct().repartitionByRange("time").withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["count"]) for r in part.groupBy("_p").count().collect())  # a row per partition
    low, before = 0, []
    for p, n in counts:
        before.append((p, low))
        low += n
    step = max(1, -(-low // max_frames))
    first = spark.createDataFrame(before, "_p int, _low long")
    rank = F.row_number().over(W.partitionBy("_p").orderBy("time")) + F.col("_low")
    kept = part.join(F.broadcast(first), "_p").select("time", (rank - 1).alias("pos"))  # broadcast: a row per partition
    return kept.where((F.col("pos") % step == 0) | (F.col("pos") == low - 1)).select("pos", "time")


def uniform_frames(intervals: DataFrame, n: int = 10) -> DataFrame:
    """N evenly spaced instants between the first start and the last end or start."""
    b = intervals.agg(F.min("valid_from").alias("lo"), F.max(F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))).alias("hi"))
    span = F.unix_seconds(F.col("hi").cast("timestamp")) - F.unix_seconds(F.col("lo").cast("timestamp"))
    return b.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"), "lo", span.alias("span")).select(
        "idx", F.timestamp_seconds(F.unix_seconds(F.col("lo").cast("timestamp")) + F.expr(f"idx * span div {max(1, n - 1)}")).alias("time")
    )


def clean_intervals(states: DataFrame) -> DataFrame:
    """Intervals that end before they start become open."""
    return states.withColumn("valid_to", F.when(F.col("valid_to") >= F.col("valid_from"), F.col("valid_to")))


def interval_bounds(states: DataFrame) -> DataFrame:
    c = clean_intervals(states)
    return c.agg(F.min("valid_from").alias("lo"), F.max(F.coalesce("valid_to", "valid_from")).alias("hi"), F.count_if(F.col("valid_to").isNull()).alias("open"), F.count("*").alias("n"))


def relation_timeline(states: DataFrame, subject: str, predicate: str, object_: str, limit: int = 200) -> DataFrame:
    """A triple's states in order."""
    hit = states.where((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_))
    return hit.orderBy("valid_from", F.col("valid_to").asc_nulls_last(), "event", "line").limit(limit)


def active_at(states: DataFrame, at) -> DataFrame:
    """States that hold at an instant."""
    t = F.lit(at).cast(states.schema["valid_from"].dataType)
    return states.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t)))


def active_per_frame(states: DataFrame, frames: DataFrame) -> DataFrame:
    """(idx, active, started): states that hold at each frame, and all that have started by then.

    One sweep: starts, frames and ends are merged in order of time, starts before and ends after the frames of
    their instant, and counted by running sums inside ranges of time, to which the counts of the ranges before are added.
    """
    ends = F.explode(F.array(F.struct(F.col("valid_from").alias("t"), F.lit(0).alias("k")), F.struct(F.col("valid_to").alias("t"), F.lit(2).alias("k"))))
    marks = states.where("valid_from is not null").select(ends.alias("_m")).select("_m.*").where("t is not null")  # both ends of a state in one pass
    marks = marks.union(frames.select(F.col("time").alias("t"), F.lit(1)).where("t is not null"))
    count = lambda k: (F.col("n") * (F.col("k") == k).cast("int")).alias("se"[k // 2])
    part = sliced(marks.groupBy("t", "k").agg(F.count("*").alias("n")).select("t", "k", count(0), count(2)), "t", "k")
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    before = part.groupBy("_p").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).select("_p", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in "se"])
    run = W.partitionBy("_p").orderBy("t", "k").rowsBetween(W.unboundedPreceding, 0)
    at = part.select("_p", "t", "k", *[F.sum(c).over(run).alias(f"{c}1") for c in "se"]).where("k = 1").join(before, "_p")
    at = at.select(F.col("t").alias("time"), (F.col("s0") + F.col("s1")).alias("started"), (F.col("e0") + F.col("e1")).alias("ended"))
    return frames.select("idx", "time").join(at, "time").select("idx", (F.col("started") - F.col("ended")).alias("active"), "started")


def frame_deltas(frames: DataFrame, intervals: DataFrame) -> DataFrame:
    """C17: (id, enters, exits): the frames at which an interval enters and leaves the picture, for those that are seen.

    frames(idx, ts), idx in order of ts; intervals of one id, start and end are one. One sweep: starts, frames and ends are merged in order of time, starts
    before and ends after the frames of their instant, and each takes the next frame of its range of time, or else the
    first one of the ranges behind.
    """
    fr = settle(frames.select("idx", "ts"))
    span = fr.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()  # one row
    if span["lo"] is None:
        return intervals.select("id", F.lit(None).cast("int").alias("enters"), F.lit(None).cast("int").alias("exits")).limit(0)
    kind = intervals.schema["start"].dataType
    lo, hi = (F.lit(str(span[c])).cast(kind) for c in ("lo", "hi"))
    seen = intervals.where((F.col("start") <= hi) & (F.col("end").isNull() | (F.col("end") >= lo)))
    seen = settle(seen.select("id", "start", "end").distinct())
    mark = lambda c, k: seen.where(f"{c} is not null").select(F.col(c).alias("t")).distinct().select("t", F.lit(k).alias("k"), F.lit(None).cast("int").alias("idx"))
    part = sliced(mark("start", 0).union(mark("end", 2)).union(fr.groupBy(F.col("ts").cast(kind).alias("t")).agg(F.min("idx").alias("idx")).select("t", F.lit(1), F.col("idx").cast("int"))), "t", "k")
    behind = F.min("idx").over(W.orderBy("_p").rowsBetween(1, W.unboundedFollowing))  # a row per range
    later = part.groupBy("_p").agg(F.min("idx").alias("idx")).select("_p", behind.alias("later"))
    here = F.min("idx").over(W.partitionBy("_p").orderBy("t", "k").rowsBetween(0, W.unboundedFollowing))
    at = settle(part.withColumn("here", here).where("k <> 1").join(later, "_p").select("t", "k", F.coalesce("here", "later").alias("frame")))
    first, last = (at.where(F.col("k") == k).select(F.col("t").alias(c), F.col("frame").alias(n)) for k, c, n in ((0, "start", "enters"), (2, "end", "exits")))
    out = seen.join(first, "start", "left").join(last, "end", "left")
    return out.where(F.col("exits").isNull() | (F.col("enters") < F.col("exits"))).select("id", "enters", "exits")


def relation_summary(relations: DataFrame, k: int = 5) -> DataFrame:
    """Per triple the first and last time, its rows, and the first k distinct evidences by (time, event, line)."""
    one = relations.groupBy(*TRIPLE, "evidence").agg(F.min(F.struct("time", "event", "line")).alias("at"), F.max("time").alias("hi"), F.count("*").alias("n"))
    one = one.withColumn("_n", F.row_number().over(W.partitionBy(*TRIPLE).orderBy("at", "evidence")))
    few = F.array_sort(F.collect_list(F.when(F.col("_n") <= k, F.struct("_n", "evidence"))))  # k at most are kept
    out = one.groupBy(*TRIPLE).agg(F.min("at.time").alias("first_time"), F.max("hi").alias("last_time"), F.sum("n").alias("n"), few.alias("_e"))
    return out.withColumn("evidence", F.transform("_e", lambda x: x["evidence"])).drop("_e")


def relation_history(relations: DataFrame, k: int = 200) -> DataFrame:
    """Per (subject, object) the first k (time, predicate, evidence), numbered."""
    pair = ["subject", "object"]
    return by_heat(relations, pair, lambda r, hot: top_rows(r, pair, ORDER, k, "n", hot))


def relation_context(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations with their event's first mention (mention_id, quote)."""
    first = mentions.groupBy("event").agg(F.min_by(F.struct("mention_id", "quote"), F.struct("reported_at", "mention_id")).alias("_m"))
    return relations.join(first, "event", "left").select(*relations.columns, F.col("_m.mention_id").alias("mention_id"), F.col("_m.quote").alias("quote"))


def missing_states(relations: DataFrame, states: DataFrame) -> DataFrame:
    """Triples that have relations but no state yet."""
    return relations.select(*TRIPLE).distinct().join(states.select(*TRIPLE).distinct(), TRIPLE, "left_anti")


def distinct_triples(relations: DataFrame) -> DataFrame:
    """G2"""
    return relations.select(*TRIPLE).distinct()
