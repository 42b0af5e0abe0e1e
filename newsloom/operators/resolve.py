"""Candidates, decisions, redirects and merges of entities and events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from newsloom.functions import expr
from newsloom.functions.shared import Scratch, settle, ship, ship_package
from newsloom.operators import dedup

# ---------------------------------------------------------------- candidates


#: Ids of a key that one row pairs with those of another block; larger keys are cut into such blocks.
BLOCK = 512
#: Blocks of a key beyond which these grow instead, up to so many times BLOCK: each block is sent to the tiles of all others.
GROW = 16
#: Tasks that the pairs of all blocks are dealt to at most.
TASKS = 20_000


def blocks(n: Column) -> Column:
    """How many blocks a key of n ids is cut into."""
    return F.least(F.ceil(n / BLOCK), F.greatest(F.lit(GROW), F.ceil(n / (GROW * BLOCK)))).cast("int")


def pairs_same_form(forms: DataFrame, star: bool = False) -> DataFrame:
    """C14: forms(id, form) -> (a, b, key), a < b, whose forms are equal once normalized; of several such keys the smallest.

    A key's ids are cut into blocks, and every two of its blocks are one row, which gives its pairs where it lies: no pair is
    shuffled. An id of several keys carries those before each with it, so that a pair is given out by its smallest key only.

    star pairs each id of a key with the smallest one only: as many rows as ids, and the same merges,
    for keys that very many ids share.
    """
    f = forms.select("id", expr.normalize_name(F.col("form")).alias("key")).where("key <> ''").distinct()
    if star:
        low = f.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
        pair = f.join(low, "key").select("key", "a", F.col("id").alias("b"))
        return pair.where("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))
    keys = f.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    f = keys.select("id", F.posexplode("keys").alias("_i", "key"), "keys").select("id", "key", F.slice("keys", F.lit(1), F.col("_i")).alias("before"))
    f = settle(f)
    size = f.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", blocks(F.col("n")).alias("blocks"))
    cut = f.join(size, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = settle(cut.groupBy("key", "blocks", "block").agg(F.array_sort(F.collect_list(F.struct("id", "before"))).alias("x")))  # about BLOCK, or GROW times that
    other = cut.select("key", F.col("block").alias("other"), F.col("x").alias("y"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    tiles = spread.join(other, ["key", "other"]).select("key", "block", "other", "x", "y")
    # a few tiles are a task, however few bytes they hold
    whole = cut.select("key", "blocks").distinct().agg(F.sum(F.col("blocks").cast("long") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    tiles = tiles.repartition(min(TASKS, int(whole) // 4 + 1), "key", "block", "other")
    pair = tiles.select("key", "y", (F.col("block") == F.col("other")).alias("same"), F.explode("x").alias("p")).select("key", "same", "p", F.explode("y").alias("q"))
    pair = pair.where("(not same or p.id < q.id) and (size(p.before) = 0 or size(q.before) = 0 or not arrays_overlap(p.before, q.before))")
    return pair.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), "key")


def first_pairs_same_form(forms: DataFrame, most: int, begin: str = "true") -> DataFrame:
    """C14: of the pairs (a, b, key) of forms(id, form) whose a fulfils `begin` (a condition on id) the `most` first by a and b, without making the others.

    Each id that is not a key's last one begins a pair, so the `most` smallest such ids are all that the first pairs can begin with. How many
    ids follow each in its keys is known from its place, so as many of them go on as give `most` pairs, with the next `most` ids of their keys.
    """
    f = settle(forms.select("id", expr.normalize_name(F.col("form")).alias("key")).where("key <> '' and id is not null").distinct())
    size = settle(f.groupBy("key").agg(F.max("id").alias("last"), F.count("*").alias("n")))
    heads = settle(f.join(size, "key").where("id < last").where(begin).select("id").distinct().orderBy("id").limit(most))
    top = heads.agg(F.max("id")).first()[0]
    low = f.where(F.col("id") <= F.lit(top)).withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("id")))
    firsts = settle(low.join(heads, "id").join(size, "key").where("id < last").select("key", F.col("id").alias("a"), (F.col("n") - F.col("_r")).alias("after")))
    before = F.sum("m").over(W.orderBy("a").rowsBetween(W.unboundedPreceding, -1))  # over `most` rows at most
    few = firsts.groupBy("a").agg(F.max("after").alias("m")).withColumn("_s", F.coalesce(before, F.lit(0))).where(F.col("_s") < most).select("a")
    firsts = settle(firsts.join(few, "a").select("key", "a"))
    ends = firsts.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    reach = f.join(ends, "key").where("id > lo").select("key", F.col("id").alias("b"), "hi")
    place = F.row_number().over(W.partitionBy("key").orderBy("b"))
    later = reach.where("b > hi").withColumn("_n", place).where(F.col("_n") <= most).select("key", "b")
    pair = firsts.join(reach.where("b <= hi").select("key", "b").union(later), "key").where("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))
    return pair.orderBy("a", "b").limit(most)


def pairs_similar(entities: DataFrame, least: float = 0.92, block: int = 6) -> DataFrame:
    """entities(id, name) -> (a, b, score) of equal first normalized letters."""
    n = entities.select("id", expr.normalize_name(F.col("name")).alias("name"))
    return dedup.blocked_pairs(n, "name", F.substring("name", 1, block), dedup.ratio, least)


def enqueue_candidates(same, similar, tasks, most: int) -> DataFrame:
    """(a, b, score, priority, input_hash) of both kinds, the best score of a pair, those not queued yet, the `most` best.

    Pairs come in order of score, a and b, so the first of them, each pair once, are the best ones. Four times `most` are
    taken, and of those what is queued goes; if too few are left, four times as many are taken, until enough are left or all
    were taken. Neither the pairs nor the queue are shuffled.

    same(a, b) and similar(a, b, score) are DataFrames, or functions that give the first n of their pairs in this order, each
    with a < b; tasks(input_hash, status) is the queue, or a function that gives its rows for pairs(a, b, input_hash). So not all pairs need be made.
    """
    first = lambda pairs, n: pairs(n) if callable(pairs) else pairs
    n = max(4 * most, 1)
    while True:
        both = first(same, n).select("a", "b", F.lit(1.0).alias("score")).union(first(similar, n).select("a", "b", "score"))
        both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").orderBy(F.desc("score"), "a", "b")
        rows = settle(both.limit(n))
        one = rows.groupBy("a", "b").agg(F.max("score").alias("score"))
        hashed = one.select("a", "b", "score", F.floor(F.col("score") * 100).cast("int").alias("priority"), expr.payload_hash(F.concat_ws(",", "a", "b")).alias("input_hash"))
        queued = first(tasks, hashed.select("a", "b", "input_hash")).where("status in ('pending', 'running')").select("input_hash")
        known = queued.join(F.broadcast(hashed.select("input_hash")), "input_hash", "left_semi").distinct()  # broadcast: n rows at most
        fresh = settle(hashed.join(known, "input_hash", "left_anti").orderBy(F.desc("score"), "a", "b").limit(most))
        if fresh.count() >= most or rows.count() < n:
            return fresh.orderBy(F.desc("score"), "a", "b")
        n *= 4


def enqueue_event_candidates(pairs: DataFrame, participants: DataFrame, most_entities: int = 30) -> DataFrame:
    """(a, b, priority, entities): event pairs with the first shared entities; pairs(a, b, n)."""
    p = participants.select("event_id", "entity_id").distinct()
    both = pairs.join(p.select(F.col("event_id").alias("a"), "entity_id"), "a").join(p.select(F.col("event_id").alias("b"), "entity_id"), ["b", "entity_id"])
    place = F.row_number().over(W.partitionBy("a", "b").orderBy("entity_id"))
    few = both.withColumn("_n", place).where(F.col("_n") <= most_entities)
    packed = few.groupBy("a", "b", "n").agg(F.array_sort(F.collect_list("entity_id")).alias("entities"))
    return packed.withColumn("priority", F.least(F.lit(100), F.col("n") * 10).cast("int"))


# ---------------------------------------------------------------- decisions


def plan_entity_merges(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """tasks(input_hash, a, b, name_a, name_b), decisions(input_hash, output) -> (from_id, to_id).

    The name that the decision prefers stays, else the longer, else the first.
    """
    d = decisions.select("input_hash", F.from_json("output", "merge boolean, canonical_name string").alias("d")).where("d.merge")
    j = tasks.join(d, "input_hash")
    keep_a = F.when(F.col("d.canonical_name") == F.col("name_a"), True).when(F.col("d.canonical_name") == F.col("name_b"), False).otherwise(F.length("name_a") >= F.length("name_b"))
    return j.select(F.when(keep_a, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(keep_a, F.col("a")).otherwise(F.col("b")).alias("to_id")).distinct()


def resolve_end_to_end(entities: DataFrame, pairs: DataFrame, decisions) -> tuple[DataFrame, DataFrame]:
    """(merged entities, the closure (from_id, to_id)): candidate pairs(a, b), decided, applied.

    decisions(tasks with input_hash, a, b, name_a, name_b) -> (input_hash, output), as a model or a reviewer gives them.
    """
    name = lambda k: entities.select(F.col("entity_id").alias(k), F.col("name").alias(f"name_{k}"))
    tasks = pairs.select("a", "b").distinct().withColumn("input_hash", F.sha1(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))).join(name("a"), "a").join(name("b"), "b")
    tasks = settle(tasks)
    closure = resolve_redirects(plan_entity_merges(tasks, decisions(tasks)))
    return merge_entities(entities, closure), closure


def plan_event_decisions(tasks: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merges (from_id, to_id), evolutions (from_id, to_id, edge_type, confidence), skipped (input_hash))."""
    j = tasks.join(decisions.select("input_hash", F.from_json("output", "decision string, edge_type string, confidence double").alias("d")), "input_hash")
    merge = j.where("d.decision = 'merge'").select(F.greatest("a", "b").alias("from_id"), F.least("a", "b").alias("to_id")).distinct()
    evolve = j.where("d.decision = 'evolve'").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.coalesce("d.edge_type", F.lit("related")).alias("edge_type"), F.coalesce("d.confidence", F.lit(0.0)).alias("confidence"))
    skip = j.where("d.decision is null or d.decision not in ('merge', 'evolve')").select("input_hash").distinct()
    return merge, evolve, skip


def upsert_decisions(decisions: DataFrame, seq: str) -> DataFrame:
    """The last decision of each input_hash."""
    from newsloom.operators.ingest import last_by

    return last_by(decisions, ["input_hash"], [seq])


def requeue_stale(tasks: DataFrame, as_of: str, minutes: int) -> DataFrame:
    """Running tasks not touched for `minutes` are pending again."""
    old = (F.col("status") == "running") & (F.col("updated_at") < F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {minutes} MINUTES"))
    return tasks.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def complete_tasks(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Tasks that have a decision are done."""
    d = decisions.select("input_hash").distinct().withColumn("_d", F.lit(True))
    return tasks.join(d, "input_hash", "left").withColumn("status", F.when(F.col("_d"), "done").otherwise(F.col("status"))).drop("_d")


def set_main_names(current: DataFrame, updates: DataFrame) -> DataFrame:
    """(id, name): the update where there is one, by the last seq."""
    u = updates.groupBy("id").agg(F.max_by("name", "seq").alias("new"))
    return current.join(u, "id", "left").select("id", F.coalesce("new", "name").alias("name"))


# ---------------------------------------------------------------- redirects


def resolve_redirects(redirects: DataFrame) -> DataFrame:
    """redirects(from_id, to_id) -> (from_id, to_id) with chains followed to their end, by doubling jumps.

    Of several targets the smallest counts. Rounds go on until every chain has ended: on a chain some id ends in
    each round, so ids still under way after a round in which none ended are on or behind a cycle. Those, and
    self redirects, stay where they are: they are not returned. The sides are merged: a broadcast in every round would
    send the whole table to the driver as often as a chain doubles.
    """
    one = settle(redirects.where("from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id")))
    source = one.select(F.col("from_id").alias("to_id")).hint("merge")
    m, waiting = one, None
    while True:
        left = m.join(source, "to_id", "left_semi").count()
        if left == 0 or left == waiting:
            return m.join(source, "to_id", "left_anti").select("from_id", "to_id")
        waiting = left
        nxt = m.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next")).hint("merge")
        m = settle(m.join(nxt, "to_id", "left").select("from_id", F.coalesce("next", "to_id").alias("to_id")))


def rekeyed(df: DataFrame, column: str, closure: DataFrame) -> DataFrame:
    c = closure.select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    return df.join(c, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merge_participants(participants: DataFrame, closure: DataFrame, key: str = "entity_id") -> DataFrame:
    """participants(event_id, entity_id, roles, time) on canonical ids: roles united, the earliest time."""
    p = rekeyed(participants, key, closure)
    roles = p.select("event_id", "entity_id", F.explode_outer("roles").alias("r")).groupBy("event_id", "entity_id").agg(F.array_sort(F.collect_set("r")).alias("roles"))
    return p.groupBy("event_id", "entity_id").agg(F.min("time").alias("time")).join(roles, ["event_id", "entity_id"])


def merge_relations(relations: DataFrame, closure: DataFrame) -> DataFrame:
    """relations(event, subject, predicate, object, time, evidence) on canonical ids: evidence united, the earliest time, no self-loops."""
    r = rekeyed(rekeyed(relations, "subject", closure), "object", closure).where("subject <> object")
    return r.groupBy("event", "subject", "predicate", "object").agg(F.min("time").alias("time"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def merge_entities(entities: DataFrame, closure: DataFrame) -> DataFrame:
    """entities(entity_id, name, first_seen, last_seen) with the merged ones folded in: the target's name, all names as aliases."""
    e = entities.withColumn("_own", F.col("entity_id"))
    e = rekeyed(e, "entity_id", closure)
    return e.groupBy("entity_id").agg(
        F.coalesce(F.max(F.when(F.col("_own") == F.col("entity_id"), F.col("name"))), F.min("name")).alias("name"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
    )


def merge_event_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Event edges on canonical ids: no self-loops, one per (from, to, type) with the highest confidence and the earliest time."""
    e = rekeyed(rekeyed(edges, "from_id", closure), "to_id", closure).where("from_id <> to_id")
    return e.groupBy("from_id", "to_id", "edge_type").agg(F.max("confidence").alias("confidence"), F.min("time").alias("time"))


def merge_events(events: DataFrame, closure: DataFrame) -> DataFrame:
    """events(event_id, abstract, summary, start, precision, first_seen): the longest summary, the most precise and then earliest start."""
    e = rekeyed(events.withColumn("_own", F.col("event_id")), "event_id", closure)
    rank = F.struct(-expr.precision_rank(F.col("precision")), F.col("start"))
    return e.groupBy("event_id").agg(
        F.coalesce(F.max(F.when(F.col("_own") == F.col("event_id"), F.col("abstract"))), F.min("abstract")).alias("abstract"),
        F.max_by("summary", F.struct(F.length("summary"), "summary")).alias("summary"),
        F.min_by("start", F.when(F.col("start").isNotNull(), rank)).alias("start"), F.min("first_seen").alias("first_seen"),
    )


def apply_merge_rules(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(alias, primary): (from_id, to_id) of the entities that a rule renames, chains closed."""
    named = rules.select(expr.entity_id(F.col("alias")).alias("from_id"), expr.entity_id(F.col("primary")).alias("to_id"))
    return resolve_redirects(named).join(entities.select(F.col("entity_id").alias("from_id")), "from_id", "left_semi")


# ---------------------------------------------------------------- groups


def block_cross_type(groups: DataFrame) -> DataFrame:
    """I4: groups(leader, id, name): groups that do not mix known types."""
    t = groups.withColumn("type", expr.entity_type(F.col("name")))
    mixed = t.where("type <> 'unknown'").groupBy("leader").agg(F.count_distinct("type").alias("n")).where("n > 1")
    return groups.join(mixed, "leader", "left_anti")


def choose_primary(groups: DataFrame) -> DataFrame:
    """Of each leader's group the primary: Chinese names first, then the earliest, the shortest, the name, the id."""
    order = F.struct((~expr.is_chinese(F.col("name"))).cast("int"), "first_seen", F.length("name"), "name", "id")
    return groups.groupBy("leader").agg(F.min_by("id", order).alias("primary"))


#: Vectors in a cell, about, and pivots that the vectors of one block are dealt by at most.
CELL, PIVOTS = 1024, 64


def _unit(t: pa.Table, column: str) -> np.ndarray:
    v = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each vector's cell: its nearest pivot."""
    if not rows.num_rows or not pivots.num_rows:
        return rows.select(["block", "id", "v"]).append_column("cell", pa.array(np.zeros(rows.num_rows, np.int32)))
    x, p = _unit(rows, "v"), _unit(pivots, "v")
    return rows.select(["block", "id", "v"]).append_column("cell", pa.array((x @ p.T).argmax(1).astype(np.int32)))


def _ball(t: pa.Table) -> pa.Table:
    """A cell's part: its middle direction and the largest angle from it."""
    x = _unit(t, "v")
    middle = x.mean(0)
    size = np.linalg.norm(middle)
    middle = middle / size if size > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ middle, -1, 1)).max())
    return pa.table([t.column("block").slice(0, 1), t.column("part").slice(0, 1), pa.array([middle.tolist()], pa.list_(pa.float64())), pa.array([radius])], ["block", "part", "middle", "radius"])


def _tile(least: float):
    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        score = (_unit(q, "v") @ _unit(x, "v").T + 1) / 2
        a, b = q.column("id").to_numpy(), x.column("id").to_numpy()
        i, j = np.nonzero((score >= least) & (a[:, None] != b[None, :]))
        return pa.table([pa.array(a[i]), pa.array(b[j]), pa.array(score[i, j])], ["query_id", "vec_id", "score"])

    return run


def semantic_matches(asked: DataFrame, vectors: DataFrame, least: float, block: str, stats: list | None = None) -> DataFrame:
    """I8: (query_id, vec_id, score): vectors of the same block whose (cos + 1) / 2 with the asked one is at `least` or more.

    The vectors of a block go to the nearest of at most PIVOTS of them, and these cells in parts of about CELL. A part is a
    ball of directions; the angle between two members is at least that of the middles less both radii, so pairs of
    parts that are too far apart are left out, exactly. Each other pair is one task and one matrix product. Null and
    zero vectors and null blocks match nothing. Vectors of a block must be of one length. If `stats` is given, how many tiles there are and are kept is appended.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "matches")
    has = F.col("embedding").isNotNull() & F.exists("embedding", lambda c: c != 0)
    both = [d.where(has & F.col(block).isNotNull()).select(F.col(block).alias("block"), F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("v"), F.lit(k).alias("side")) for k, d in enumerate((asked, vectors))]
    both = scratch.settle(both[0].union(both[1]))
    size = scratch.settle(both.where("side = 1").groupBy("block").agg(F.count("*").alias("n")))
    place = F.row_number().over(W.partitionBy("block").orderBy("h", "id"))
    lot = both.where("side = 1").join(size, "block").withColumn("h", F.xxhash64("id")).where(F.pmod("h", F.greatest(F.col("n") / (4 * PIVOTS), F.lit(1)).cast("long")) == 0)
    pivots = lot.withColumn("k", place).where(F.col("k") <= PIVOTS).select("block", "v")  # of about 4 * PIVOTS rows of a block
    kind = both.schema["block"].dataType.simpleString()
    slices = both.join(size, "block").withColumn("slice", F.pmod(F.xxhash64("id", "side"), F.ceil(F.col("n") / (64 * CELL)))).drop("n")
    dealt = pivots.join(size, "block").select(F.col("block").alias("block"), F.col("v").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (64 * CELL)) - 1)).alias("slice"))

    def cells(side: int) -> DataFrame:
        one = slices.where(F.col("side") == side).groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInArrow(_nearest, f"block {kind}, id long, v array<double>, cell int")
        one = scratch.settle(one)
        n = one.groupBy("block", "cell").agg(F.ceil(F.count("*") / CELL).alias("parts"))
        return scratch.settle(one.join(n, ["block", "cell"]).select("block", "id", "v", F.concat_ws("/", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("string")).alias("part")))

    q, x = cells(0), cells(1)
    ball = f"block {kind}, part string, middle array<double>, radius double"
    a, b = (scratch.settle(d.groupBy("block", "part").applyInArrow(_ball, ball)) for d in (q, x))
    dot = F.aggregate(F.zip_with("a.middle", "b.middle", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    far = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("a.radius") - F.col("b.radius")
    angle = float(np.arccos(np.clip(2 * least - 1, -1, 1))) + 1e-7
    pairs = scratch.settle(a.alias("a").join(b.alias("b"), F.col("a.block") == F.col("b.block")).select(F.col("a.block").alias("block"), F.col("a.part").alias("pa"), F.col("b.part").alias("pb"), (far <= angle).alias("near")))
    if stats is not None:
        stats.append(pairs.agg(F.count("*").alias("tiles"), F.count_if("near").alias("kept")).first().asDict())
    near = pairs.where("near").drop("near")
    key = ["block", "pa", "pb"]
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])  # noqa: E731  columns of its own for each side
    left, right = fresh(q.withColumnRenamed("part", "pa").join(near, ["block", "pa"])), fresh(x.withColumnRenamed("part", "pb").join(near, ["block", "pb"]))
    out = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(ship(_tile)(least), "query_id long, vec_id long, score double")
    out = settle(out)
    scratch.close()
    return out


def refresh(entities: DataFrame, decided: DataFrame, rules: DataFrame, least: float = 0.93) -> DataFrame:
    """The closure (from_id, to_id) of decided merges, rules and similar names whose groups do not mix types.

    entities(entity_id, name, first_seen); the primaries of I5 are what groups merge into.
    """
    known = resolve_redirects(decided.select("from_id", "to_id").unionByName(apply_merge_rules(entities, rules)))
    left = entities.join(known.select(F.col("from_id").alias("entity_id")), "entity_id", "left_anti").select(F.col("entity_id").alias("id"), "name", "first_seen")
    lead = dedup.precluster(left, least)
    groups = block_cross_type(left.join(lead, "id"))
    merges = groups.join(choose_primary(groups), "leader").where("id <> primary").select(F.col("id").alias("from_id"), F.col("primary").alias("to_id"))
    return resolve_redirects(known.unionByName(merges))


# ---------------------------------------------------------------- stored responses

EVENT = "struct<abstract:string,event_summary:string,event_types:array<string>,entities:array<string>,entities_original:array<string>,entity_roles:map<string,array<string>>,relations:array<struct<subject:string,predicate:string,object:string,relation_kind:string,evidence:array<string>>>>"


def json_span(text: Column) -> Column:
    """What a reply holds inside its code fence, from the first bracket to the last."""
    bare = F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*|```.*$", "")
    body = F.when(text.contains("```"), bare).otherwise(text)
    return F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: responses(id, response) -> (events: id, n, event), (failures: id, response). A list, {"events": [...]} and one event are read."""
    once = lambda df, name, value: df.select("id", "response", *[c for c in df.columns if c == "j"], F.explode(F.array(value)).alias(name))  # noqa: E731  a value that is used twice is not worked out twice
    span = once(responses.select("id", "response"), "j", json_span(F.col("response")))
    either = EVENT.replace("struct<", f"struct<events:array<{EVENT}>,", 1)
    fields = [f.name for f in _parse_datatype_string(EVENT).fields]
    whole = F.transform(F.array(F.from_json("j", either)), lambda x: F.coalesce(x["events"], F.array(F.struct(*[x[c].alias(c) for c in fields]))))[0]  # an object is parsed once, whichever kind it is
    picked = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{EVENT}>")).otherwise(whole)
    got = once(span, "events", F.filter(picked, lambda e: e["abstract"].isNotNull()))
    got = settle(got.select("id", "events", F.when(F.coalesce(F.size("events"), F.lit(0)) <= 0, F.col("response")).alias("response")))
    ok = got.where(F.size("events") > 0).select("id", F.posexplode("events").alias("n", "event"))
    return ok, got.where(F.coalesce(F.size("events"), F.lit(0)) <= 0).select("id", "response")


def clean_extractions(events: DataFrame) -> DataFrame:
    """K7: events(id, n, event struct) -> flat, checked: roles of listed entities only, unique types, relations with listed ends, no self-loops, valid kinds, unique keys.

    Events without abstract, entities or summary go.
    """
    e = events.select("id", "n", "event.*")
    names = F.array_distinct(F.filter(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    e = e.withColumn("entities", names).where((F.coalesce(F.trim("abstract"), F.lit("")) != "") & (F.coalesce(F.trim("event_summary"), F.lit("")) != "") & (F.size("entities") > 0))
    e = e.withColumn("entity_roles", F.map_filter(F.coalesce("entity_roles", F.create_map().cast("map<string,array<string>>")), lambda k, _: F.array_contains("entities", k)))
    e = e.withColumn("event_types", F.array_distinct(F.coalesce("event_types", F.array().cast("array<string>"))))
    fixed = F.transform("relations", lambda r: r.withField("relation_kind", expr.relation_kind(r["relation_kind"], r["predicate"])))
    e = e.withColumn("relations", F.filter(fixed, lambda r: F.array_contains("entities", r["subject"]) & F.array_contains("entities", r["object"]) & (r["subject"] != r["object"]) & (F.coalesce(r["predicate"], F.lit("")) != "")))
    key = lambda r: F.concat_ws("\u0001", r["subject"], r["predicate"], r["object"])
    keys = F.transform("relations", key)
    return e.withColumn("relations", F.filter("relations", lambda r, i: F.array_position(keys, key(r)) == i + 1))


def parse_merge_decisions(responses: DataFrame) -> DataFrame:
    """responses(id, response) of groups [{primary, duplicates}] -> (duplicate, primary), the first primary of each duplicate."""
    j = F.from_json(json_span(F.col("response")), "array<struct<primary:string,duplicates:array<string>>>")
    g = responses.select("id", F.posexplode(j).alias("n", "g"))
    d = g.select("id", "n", F.col("g.primary").alias("primary"), F.explode("g.duplicates").alias("duplicate")).where("duplicate <> primary")
    return d.groupBy("duplicate").agg(F.min_by("primary", F.struct("id", "n")).alias("primary"))
