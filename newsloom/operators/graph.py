"""Joins over the graph (C*), its projections (J*), degrees, top-k and set operations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import settle, ship_package


def participants_with_events(participants: DataFrame, events: DataFrame, main: DataFrame) -> DataFrame:
    """Participants with their event's display abstract; main(event_id, display)."""
    shown = display_names(events.select("event_id", F.col("abstract").alias("name")), main, "event_id")
    return participants.join(shown, "event_id").withColumnRenamed("name", "abstract")


def display_names(rows: DataFrame, main: DataFrame, key: str) -> DataFrame:
    """rows(key, name) with the display name where one is set."""
    return rows.join(main.select(key, "display"), key, "left").withColumn("name", F.coalesce("display", "name")).drop("display")


def relations_named(relations: DataFrame, names: DataFrame) -> DataFrame:
    """names(entity_id, name) looked up for subject_id and object_id."""
    s = names.select(F.col("entity_id").alias("subject_id"), F.col("name").alias("subject_name"))
    o = names.select(F.col("entity_id").alias("object_id"), F.col("name").alias("object_name"))
    return relations.join(s, "subject_id").join(o, "object_id")


def lookup(names: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(name) -> entity_id by the best way it is known: names(name, entity_id, way), the lowest way wins, then the id."""
    hit = asked.select("name").distinct().join(names, "name")
    return hit.groupBy("name").agg(F.min(F.struct("way", "entity_id")).alias("_b")).select("name", F.col("_b.entity_id").alias("entity_id"), F.col("_b.way").alias("way"))


def entity_records(entities: DataFrame, asked: DataFrame, main_names: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """asked(name) -> name, the record of the entity it is known as (its columns, main_name, aliases) and the way it was found.

    entities(entity_id, name, ...), main_names(entity_id, main_name), aliases(entity_id, alias), redirects(from_id, to_id).
    Main names come before names, names before aliases; an alias follows redirects to their end. Of several entities
    the smallest id counts. Names that nobody has give no row.
    """
    from newsloom.operators.resolve import rekeyed, resolve_redirects

    known = main_names.select(F.col("main_name").alias("name"), "entity_id", F.lit(0).alias("way"))
    known = known.union(entities.select("name", "entity_id", F.lit(1)))
    far = rekeyed(aliases.select(F.col("alias").alias("name"), "entity_id", F.lit(2).alias("way")), "entity_id", resolve_redirects(redirects))
    live = entities.select("entity_id")
    want = asked.select(F.trim("name").alias("name")).where("name <> ''")
    hit = lookup(known.unionByName(far).join(live, "entity_id", "left_semi"), want)
    mine = aliases.join(hit.select("entity_id").distinct(), "entity_id", "left_semi").where(F.trim("alias") != "")
    mine = mine.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    full = hit.join(entities.withColumnRenamed("name", "_own"), "entity_id").join(main_names.select("entity_id", "main_name"), "entity_id", "left").join(mine, "entity_id", "left")
    return full.withColumn("main_name", F.coalesce("main_name", "_own")).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("_own")


def event_records(events: DataFrame, asked: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """C19 for events(event_id, abstract, ...): asked(name) by abstract, else by alias and redirects."""
    none = events.select(F.col("event_id").alias("entity_id"), F.col("abstract").alias("main_name")).limit(0)
    e = events.withColumnsRenamed({"event_id": "entity_id", "abstract": "name"})
    found = entity_records(e, asked, none, aliases.withColumnRenamed("event_id", "entity_id"), redirects)
    return found.withColumnsRenamed({"entity_id": "event_id", "main_name": "abstract"})


def news_bridge(extracted: DataFrame) -> DataFrame:
    """(news_id, event_id), each once, from extracted events(news_id, abstract); rows that lack either go."""
    return extracted.where("trim(news_id) <> '' and trim(abstract) <> ''").select("news_id", expr.event_id(F.col("abstract")).alias("event_id")).distinct()


def events_by_news(bridge: DataFrame, events: DataFrame, asked: DataFrame) -> DataFrame:
    """The events of asked(news_id)."""
    return bridge.join(asked.select("news_id").distinct(), "news_id", "left_semi").join(events, "event_id")


def news_by_event(bridge: DataFrame, news: DataFrame, asked: DataFrame) -> DataFrame:
    """The news of asked(event_id)."""
    return bridge.join(asked.select("event_id").distinct(), "event_id", "left_semi").join(news, "news_id")


def entity_timeline(participants: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of the entities in ids(entity_id), dated by their start, else their first report."""
    mine = participants.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("event_id").distinct()
    return mine.join(events, "event_id").select("event_id", "abstract", F.coalesce("start", "first_seen").alias("time")).orderBy("time", "event_id")


#: Members of a group that one task pairs with those of another block; larger groups are cut into such blocks.
BLOCK = 512
#: Entities in a side of a tile and their places in events, about; events that a tile multiplies at once; pairs that it gives out at once.
SIDE, PLACES, EVENTS, CHUNK = 2048, 2_000_000, 2048, 1 << 14
#: Such sides in a block at most: fewer, larger blocks are read by fewer tiles.
STRIPS = 8
#: Blocks that are cut to such sides, so that there are tiles enough for all tasks.
SMALL = 24


def cooccurrence(participants: DataFrame, least: int = 2, listed: bool = False, summed: bool = False) -> DataFrame:
    """C4: (a, b, n): entities that share at least `least` events, a < b; n counts events once. listed adds the events, sorted.
    summed gives (entity_id, weight) instead, the sum of n over an entity's pairs: a tile adds up its own, so no pair leaves it.

    Entities get numbers first, so that a pair is two longs. An event of up to BLOCK entities is one row, whose pairs
    are made where it lies. Of larger ones the entities are cut into blocks, and every two blocks are a tile, which
    counts all events of its pairs, so no pair of them is shuffled; where that would move more than the pairs themselves (many
    entities in few large events each), an event's own blocks meet instead.
    Partial sums shrink the pairs before the shuffle; entities in fewer than `least` events are left out before.
    """
    p = participants.select("event_id", "entity_id").where(F.col("event_id").isNotNull() & F.col("entity_id").isNotNull()).distinct()
    often = p.groupBy("entity_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("entity_id")
    ids = settle(numbered(often, "entity_id", "k"))
    p = settle(p.join(ids, "entity_id").select("event_id", "k", "entity_id"))
    size = p.groupBy("event_id").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    size = settle(size)
    light = size.where("blocks = 1").select("event_id")
    heavy = size.where("blocks > 1").select("event_id", "blocks")
    work = size.where("blocks > 1").agg(F.sum(F.col("m") * F.col("m"))).first()[0] or 0
    tiles = dense = None
    if work:
        dense = settle(p.join(heavy, "event_id", "left_semi").select("k").distinct())
        mine = p.join(dense, "k", "left_semi")
        places, many = mine.agg(F.count("*"), F.count_distinct("k")).first()
        blocks = max(-(-many // (SIDE * STRIPS)), -(-places // PLACES), min(8, -(-many // 256)), min(SMALL, -(-many // SIDE)))
        if places * blocks <= 2 * work:
            tiles = _sums(mine, blocks, least) if summed else _tiles(mine, blocks, least, listed)
        else:
            dense = None
    one = p.join(light, "event_id")
    if dense is not None:
        one = one.join(dense.withColumn("d", F.lit(True)), "k", "left").withColumn("d", F.coalesce("d", F.lit(False)))
    else:
        one = one.withColumn("d", F.lit(False))
    one = one.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("x"))  # at most BLOCK
    inside = one.select(F.posexplode("x").alias("_i", "a"), "x").select("a", F.explode(F.slice("x", F.col("_i") + 2, BLOCK)).alias("b"))
    pair = inside.where("not (a.d and b.d)").select("a.k", "b.k").toDF("a", "b")  # pairs of two dense ones are in tiles
    if work and tiles is None:
        cut = settle(p.join(heavy, "event_id").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))).groupBy("event_id", "blocks", "block").agg(F.array_sort(F.collect_list("k")).alias("x")))  # about BLOCK
        other = cut.select("event_id", F.col("block").alias("other"), F.col("x").alias("y"))
        spread = cut.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
        both = spread.join(other, ["event_id", "other"]).select("x", "y", (F.col("block") == F.col("other")).alias("same"))
        across = both.select(F.explode("x").alias("p"), "y", "same").select("p", "same", F.explode("y").alias("q")).where("not same or p < q")
        pair = pair.union(across.select(F.least("p", "q"), F.greatest("p", "q")))
    found = pair.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if summed:
        each = found.select(F.explode(F.array("a", "b")).alias("k"), F.col("n").alias("weight"))
        each = (each if tiles is None else each.unionByName(tiles)).groupBy("k").agg(F.sum("weight").alias("weight"))
        return each.join(ids, "k").select("entity_id", "weight")
    back = lambda c: ids.select(F.col("k").alias(f"{c}_k"), F.col("entity_id").alias(c))
    named = found.withColumnsRenamed({"a": "a_k", "b": "b_k"}).join(back("a"), "a_k").join(back("b"), "b_k")
    out = named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n")
    if listed:
        out = settle(out)
        out = out.join(shared_events(p, out), ["a", "b"])
    return out if tiles is None else out.unionByName(tiles)


def _tiles(members: DataFrame, blocks: int, least: int, listed: bool) -> DataFrame:
    """(a, b, n), and events if listed, for members(event_id, k, entity_id): every two blocks of entities are a row, which counts the events of its pairs."""
    kind = {c: members.schema[c].dataType.simpleString() for c in ("entity_id", "event_id")}
    out = f"a {kind['entity_id']}, b {kind['entity_id']}, n long" + (f", events array<{kind['event_id']}>" if listed else "")
    made = _block_pairs(members, blocks).mapInArrow(partial(_counted, least=least, listed=listed, side=SIDE), out)
    return made.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})


def _sums(members: DataFrame, blocks: int, least: int) -> DataFrame:
    """(k, weight), several times: what each pair of blocks adds to the weights of its entities."""
    numbers = members.select("event_id", "k", F.col("k").alias("entity_id"))
    return _block_pairs(numbers, blocks).mapInArrow(partial(_added, least=least, side=SIDE), "k long, weight long")


def _block_pairs(members: DataFrame, blocks: int) -> DataFrame:
    """Every two blocks of entities, one with itself too, as a row of a task that is about as large as all others.

    A block is a partition, which the tasks of its tiles read where it lies: no copies of blocks are shuffled.
    """
    ship_package(members.sparkSession)
    kind = {c: members.schema[c].dataType.simpleString() for c in ("entity_id", "event_id")}
    shape = f"block int, name array<{kind['entity_id']}>, size array<int>, code array<int>, event array<{kind['event_id']}>"
    dealt = members.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    packed = settle(dealt.groupBy("block").applyInArrow(_packed, shape)).repartitionById(blocks, "block")
    side = lambda n: packed.select(F.col("block").alias(n), F.struct("name", "size", "code", "event").alias(f"{n}_side"))
    return side("i").join(side("j").hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))


def _packed(t: pa.Table) -> pa.Table:
    """A block as one row: its entities, how many events each has, and these as places in the sorted list of the block's events."""
    names, which = np.unique(t.column("k").to_numpy(), return_inverse=True)
    event = t.column("event_id").combine_chunks().dictionary_encode()
    by = pa.compute.sort_indices(event.dictionary)
    code = np.argsort(by.to_numpy())[event.indices.to_numpy()]
    order = np.lexsort((code, which))
    code = code[order]
    first = np.searchsorted(which[order], np.arange(len(names)))
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.table([
        t.column("block").slice(0, 1).combine_chunks(), one(t.column("entity_id").combine_chunks().take(pa.array(order[first]))),
        one(pa.array(np.bincount(which, minlength=len(names)).astype(np.int32))), one(pa.array(code.astype(np.int32))), one(event.dictionary.take(by)),
    ], ["block", "name", "size", "code", "event"])


def _counted(batches: Iterator[pa.RecordBatch], least: int, listed: bool, side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield from _tile(batch.column("i_side")[r], batch.column("j_side")[r], batch.column("i")[r].as_py() == batch.column("j")[r].as_py(), least, listed, side)


def _added(batches: Iterator[pa.RecordBatch], least: int, side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield _tile_sums(batch.column("i_side")[r], batch.column("j_side")[r], batch.column("i")[r].as_py() == batch.column("j")[r].as_py(), least, side)


def _tile_sums(x: pa.StructScalar, y: pa.StructScalar, same: bool, least: int, side: int) -> pa.RecordBatch:
    """What the pairs of two blocks, or of one with itself, that share enough events add to each entity, in strips of `side` entities."""
    events, owner, code = _placed(x, y)
    names = [s["name"].values for s in (x, y)]
    total = [np.zeros(len(n), np.float64) for n in names]  # sums stay far below 2^53
    for p in range(0, len(names[0]), side):
        for q in range(p if same else 0, len(names[1]), side):
            ends = min(p + side, len(names[0])), min(q + side, len(names[1]))
            here = [(owner[k] >= lo) & (owner[k] < end) for k, (lo, end) in enumerate(zip((p, q), ends, strict=True))]
            count = _counts([owner[0][here[0]] - p, owner[1][here[1]] - q], [code[k][here[k]] for k in (0, 1)], ends[0] - p, ends[1] - q, len(events))
            count[count < least] = 0
            inner = same and p == q
            if inner:
                np.fill_diagonal(count, 0)
            total[0][p : ends[0]] += count.sum(1, dtype=np.float64)
            if not inner:
                total[1][q : ends[1]] += count.sum(0, dtype=np.float64)
    if same:
        names, total = names[:1], [total[0] + total[1]]
    weight = np.concatenate(total).astype(np.int64)
    some = np.flatnonzero(weight)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(names).take(pa.array(some)), pa.array(weight[some])], ["k", "weight"])


def _placed(x: pa.StructScalar, y: pa.StructScalar) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """The sorted events of two blocks, and for each side its entities' numbers and the places of their events in that list."""
    events = pa.compute.unique(pa.concat_arrays([x["event"].values, y["event"].values]))
    events = events.take(pa.compute.sort_indices(events))
    owner, code = [], []
    for s in (x, y):
        size = s["size"].values.to_numpy()
        owner.append(np.repeat(np.arange(len(size)), size))
        code.append(pa.compute.index_in(s["event"].values, events).to_numpy()[s["code"].values.to_numpy()])
    return events, owner, code


def _tile(x: pa.StructScalar, y: pa.StructScalar, same: bool, least: int, listed: bool, side: int) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, or of one with itself, that share enough events, in strips of `side` entities."""
    names = [s["name"].values for s in (x, y)]
    events, owner, code = _placed(x, y)
    sets = [np.split(c, np.cumsum(np.bincount(o, minlength=len(n)))[:-1]) for c, o, n in zip(code, owner, names, strict=True)] if listed else None
    for i in range(0, len(names[0]), side):
        for j in range(i if same else 0, len(names[1]), side):
            size = [min(side, len(n) - lo) for n, lo in zip(names, (i, j), strict=True)]
            here = [slice(*np.searchsorted(o, (lo, lo + n))) for o, lo, n in zip(owner, (i, j), size, strict=True)]  # owners ascend
            count = _counts([owner[0][here[0]] - i, owner[1][here[1]] - j], [code[k][here[k]] for k in (0, 1)], *size, len(events))
            enough = count >= least
            a, b = np.nonzero(np.triu(enough, 1) if same and i == j else enough)
            for lo in range(0, len(a), CHUNK):
                p, q = a[lo : lo + CHUNK], b[lo : lo + CHUNK]
                out = [names[0].take(pa.array(p + i)), names[1].take(pa.array(q + j)), pa.array(count[p, q].astype(np.int64))]
                if listed:
                    out.append(_shared(p + i, q + j, sets, events))
                yield pa.RecordBatch.from_arrays(out, ["a", "b", "n", "events"][: len(out)])


def _counts(owner: list[np.ndarray], code: list[np.ndarray], n: int, m: int, events: int) -> np.ndarray:
    """How many events each of n and each of m entities share: by products of incidence matrices, or event by event where these are nearly empty."""
    each = [np.bincount(c, minlength=events) for c in code]
    count = np.zeros((n, m), np.float32)
    if n * m * events <= 50 * int((each[0].astype(np.int64) * each[1]).sum()):
        for lo in range(0, events, EVENTS):
            inc = []
            for k, rows in enumerate((n, m)):
                one = np.zeros((rows, min(EVENTS, events - lo)), np.float32)
                here = (code[k] >= lo) & (code[k] < lo + EVENTS)
                one[owner[k][here], code[k][here] - lo] = 1
                inc.append(one)
            count += inc[0] @ inc[1].T
    else:
        held = [np.split(owner[k][np.argsort(code[k], kind="stable")], np.cumsum(each[k])[:-1]) for k in (0, 1)]
        for e in np.flatnonzero(each[0] * each[1]).tolist():
            count[np.ix_(held[0][e], held[1][e])] += 1
    return count


def _shared(p: np.ndarray, q: np.ndarray, sets: list, events: pa.Array) -> pa.ListArray:
    """The sorted events that sets[0][p] and sets[1][q] share, pair by pair; p ascends, so each of its sets is marked once."""
    mark, out, at = np.zeros(len(events), bool), [], None
    for i, j in zip(p.tolist(), q.tolist(), strict=True):
        if i != at:
            mark[:] = False
            mark[sets[0][i]], at = True, i
        other = sets[1][j]
        out.append(other[mark[other]])
    offset = pa.array(np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32))
    return pa.ListArray.from_arrays(offset, events.take(pa.array(np.concatenate(out))))


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a distinct long each: the number in its partition, below the partition's own range."""
    return rows.select(key, F.monotonically_increasing_id().alias(name))


def shared_events(participants: DataFrame, pairs: DataFrame) -> DataFrame:
    """C4: the events behind given pairs(a, b), as a sorted list: each side's sorted list comes to the pair, and what both hold stays."""
    p = participants.select("event_id", "entity_id").distinct().groupBy("entity_id").agg(F.sort_array(F.collect_list("event_id")).alias("l"))
    both = pairs.select("a", "b").join(p.toDF("a", "la"), "a").join(p.toDF("b", "lb"), "b")
    return both.select("a", "b", F.array_intersect("la", "lb").alias("events")).where(F.size("events") > 0)


def event_pairs(participants: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(a, b, n): events that share at least `least` entities; the `most` best, by n and ids, if set."""
    out = cooccurrence(participants.select(F.col("entity_id").alias("event_id"), F.col("event_id").alias("entity_id")), least)
    return out.orderBy(F.desc("n"), "a", "b").limit(most) if most else out


def cooccurrence_weight(participants: DataFrame, k: int, least: int = 2) -> DataFrame:
    """The k entities with the largest sum of pair weights, over pairs that share at least `least` events."""
    w = cooccurrence(participants, least, summed=True)
    return w.orderBy(F.desc("weight"), "entity_id").limit(k)


def event_samples(participants: DataFrame, k: int) -> DataFrame:
    """C11: each entity's latest k events, numbered."""
    w = W.partitionBy("entity_id").orderBy(F.desc("time"), "event_id")
    return participants.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def entity_evidence(participants: DataFrame, events: DataFrame, k: int, most: int) -> DataFrame:
    """Each entity's first k event snippets of at most `most` characters."""
    w = W.partitionBy("entity_id").orderBy("time", "event_id")
    few = participants.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return few.join(events.select("event_id", "abstract"), "event_id").select("entity_id", "n", F.substring("abstract", 1, most).alias("snippet"))


def neighbours(edges: DataFrame, node=None) -> DataFrame:
    """Edges of a node, in both directions, or of all nodes: node, other, direction, edge_type."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.lit("out").alias("direction"), "edge_type")
    inn = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), F.lit("in").alias("direction"), "edge_type")
    both = out.unionByName(inn)
    return both if node is None else both.where(F.col("node") == node)


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_pooled(degrees: DataFrame, k: int) -> DataFrame:
    """the k nodes of the highest degree, ties by id."""
    return degrees.orderBy(F.desc("degree"), "node").limit(k)


def top_per_type(degrees: DataFrame, k: int) -> DataFrame:
    """degrees(node, type, degree): the top k of each type."""
    return degrees.withColumn("rank", F.row_number().over(W.partitionBy("type").orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= k)


def cap_edges(edges: DataFrame, nodes: DataFrame, most: int, order: list) -> DataFrame:
    """the first `most` edges whose ends are both kept."""
    return inside(edges, nodes).orderBy(*order).limit(most)


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node").distinct()
    e = edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi")
    return e.join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def used_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi")


def min_degree_subgraph(edges: DataFrame, least: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among the k nodes of the highest degree, of at least `least`; nodes that no edge uses go."""
    top = top_pooled(degree(edges).where(F.col("degree") >= least), k)
    e = inside(edges, top)
    return used_nodes(top, e), e


def k_hop(edges: DataFrame, focus: list, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` undirected steps of the focus, with their distance, and the edges among them.

    Each hop's new nodes are a table of their own, so the plan of a hop does not hold those before. A hop without new nodes is the last.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct()
    seen = front = settle(spark.createDataFrame([(f, 0) for f in focus], f"node {edges.schema['src'].dataType.simpleString()}, hop int").distinct())
    for hop in range(1, depth + 1):
        near = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = settle(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen, inside(edges, seen)


def all_edges(participants: DataFrame, relations: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: involved_in, relation and event_edge edges as src, dst, type, title, time; edges with unknown ends go."""
    a = participants.select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"), F.lit("involved_in").alias("type"), F.lit("").alias("title"), "time")
    b = relations.select(expr.entity_id(F.col("subject")).alias("src"), expr.entity_id(F.col("object")).alias("dst"), F.lit("relation").alias("type"), F.col("predicate").alias("title"), "time")
    c = edges.select(F.col("from_id").cast("string").alias("src"), F.col("to_id").cast("string").alias("dst"), F.lit("event_edge").alias("type"), F.col("edge_type").alias("title"), "time")
    return inside(a.unionByName(b).unionByName(c), nodes)


def graph_visual(participants: DataFrame, entities: DataFrame, events: DataFrame, since: str, per_type: int = 20, title: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, degree, type, title; edges: src, dst, title) of the participants since an instant among the top of each type.

    Titles are cut to `title` characters; an edge has its event's. Nodes that no edge uses stay.
    """
    e = participants.where(F.col("time") >= F.lit(since).cast(participants.schema["time"].dataType)).select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"))
    name = entities.select(F.col("entity_id").alias("node"), F.col("name").alias("_e"))
    what = events.select(F.col("event_id").alias("node"), F.col("abstract").alias("_v"))
    n = degree(e).join(name, "node", "left").join(what, "node", "left")
    n = n.select("node", "degree", F.when(F.col("_e").isNull(), "event").otherwise("entity").alias("type"), F.substring(F.coalesce("_e", "_v"), 1, title).alias("title"))
    top = top_per_type(n, per_type)
    return top, inside(e, top).join(top.select(F.col("node").alias("dst"), "title"), "dst").select("src", "dst", "title")


def graph_ge(participants: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The entity-event graph among the k nodes of the highest degree: (nodes, at most `most` edges)."""
    e = participants.select(F.col("entity_id").alias("src"), F.col("event_id").alias("dst"), "time")
    nodes = top_pooled(degree(e), k)
    return nodes, cap_edges(e, nodes, most, ["time", "src", "dst"])


def graph_get(participants: DataFrame, before: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """J1 with edges between an entity's consecutive kept events."""
    nodes, e = graph_ge(participants, k, most)
    b = inside(before.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "time"), nodes).groupBy("src", "dst").agg(F.min("time").alias("time"))
    return nodes, e.withColumn("type", F.lit("involved_in")).unionByName(b.withColumn("type", F.lit("before")))


def graph_ee(summary: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Entity relations summed by triple (D9), among the k entities of the highest degree."""
    e = summary.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate", "n", "first_time", "last_time")
    nodes = top_pooled(degree(e), k)
    return nodes, cap_edges(e, nodes, most, [F.desc("n"), "src", "dst", "predicate"])


def graph_ee_evo(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node per relation state between its subject and object: rel_in and rel_out edges."""
    nodes = states.select(F.col("state_id").alias("node"), F.lit("relation_state").alias("type"), F.col("predicate").alias("label"), "valid_from", "valid_to")
    edge = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), F.col("valid_from").alias("time"))
    both = F.explode(F.array(edge("subject", "state_id", "rel_in"), edge("state_id", "object", "rel_out")))  # a union would work out the states twice
    return nodes, states.select(both.alias("e")).select("e.*")


def sessions_as_states(sessions: DataFrame) -> DataFrame:
    """J4 without stored states: gap sessions (E3) in the shape of states."""
    ident = expr.state_id(F.col("subject"), F.col("predicate"), F.col("object"), expr.ts_text(F.col("start")), expr.ts_text(F.col("end")), F.array_join("evidence", " "), F.lit("sessions"), F.lit(0))
    return sessions.select(ident.alias("state_id"), "subject", "predicate", "object", F.col("start").alias("valid_from"), F.col("end").alias("valid_to"))


def graph_event_evo(edges: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Event-to-event edges with type and confidence, among the k events of the highest degree."""
    e = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "edge_type", "confidence", "time")
    nodes = top_pooled(degree(e), k)
    return nodes, cap_edges(e, nodes, most, [F.desc("confidence"), "src", "dst"])


def affects_edges(participants: DataFrame) -> DataFrame:
    """Event -> entity where one of its roles is passive."""
    return participants.where(expr.passive_role(F.col("roles"))).select(F.col("event_id").alias("src"), F.col("entity_id").alias("dst"))


def event_timeline(events: DataFrame, participants: DataFrame, n: int, most: int = 20) -> DataFrame:
    """the first n dated events with up to `most` entities each."""
    first = events.where("time is not null").orderBy("time", "event_id").limit(n)
    ranked = participants.join(first.select("event_id"), "event_id", "left_semi").select("event_id", "entity_id").distinct()
    ranked = ranked.withColumn("_n", F.row_number().over(W.partitionBy("event_id").orderBy("entity_id"))).where(F.col("_n") <= most)
    packed = ranked.groupBy("event_id").agg(F.array_sort(F.collect_list("entity_id")).alias("entities"))
    return first.join(packed, "event_id", "left")


def facets(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct event types with their counts; the range of times."""
    return events.groupBy("event_type").agg(F.count("*").alias("n")), events.agg(F.min("first_seen").alias("lo"), F.max("last_seen").alias("hi"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """The number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def entity_stats(entities: DataFrame, participants: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per entity its events, mentions and sources; each side is aggregated before the joins."""
    e = participants.groupBy("entity_id").agg(F.count_distinct("event_id").alias("n_events"))
    m = mentions.groupBy("entity_id").agg(F.count("*").alias("n_mentions"), F.count_distinct("source").alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.join(e, "entity_id", "left").join(m, "entity_id", "left").select(*entities.columns, zero("n_events"), zero("n_mentions"), zero("n_sources"))


def entity_story(timeline: DataFrame, start, end) -> DataFrame:
    """One entity's dated events in a range as a chain: from_id (start first), to_id, time."""
    kept = timeline.where((F.col("time") >= F.lit(start)) & (F.col("time") <= F.lit(end)))
    w = W.partitionBy(F.lit("one entity")).orderBy("time", "event_id")
    return kept.select(F.coalesce(F.lag("event_id").over(w), F.lit("start")).alias("from_id"), F.col("event_id").alias("to_id"), "time")


def document_to_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(abstract, entities array) as nodes (node, type) and edges (src, dst)."""
    e = documents.select(F.explode("entities").alias("name"), "abstract").select(expr.entity_id(F.col("name")).alias("src"), expr.event_id(F.col("abstract")).alias("dst"), "name", "abstract")
    nodes = e.select(F.col("src").alias("node"), F.col("name").alias("label"), F.lit("entity").alias("type")).union(e.select("dst", "abstract", F.lit("event"))).distinct()
    return nodes, e.select("src", "dst").distinct()
