"""Near-duplicate removal in arrival order (I1-I3), first-fit buckets (I16) and the similarity functions.

"Keep a row unless an earlier kept row is near" is not connected components, but no row depends on rows
outside its component: each is replayed in order of arrival by one task. Components too large for that go by rounds
over the near pairs: a row all of whose earlier neighbours are dropped is kept, a row with a kept
earlier neighbour is dropped, until all are decided.

Of fingerprints the near pairs grow much faster than the rows, those with a kept row hardly. So they come in a few
batches in order of arrival, each several times the one before: rows near a row that was kept before go at once,
and only pairs of what is left are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions import expr
from newsloom.functions.shared import Scratch, settle, ship, ship_package
from newsloom.operators.components import components

# ---------------------------------------------------------------- similarity


def simhash(text: Column) -> Column:
    """64 bits, each the majority over the low 64 bits of the tokens' MD5; 0 for no tokens."""
    return ship(F.pandas_udf(_simhash, "long"))(text)


class _Digests(dict):
    """The low 64 bits of tokens' MD5, each worked out once; emptied when there are very many."""

    def __missing__(self, token: str) -> bytes:
        if len(self) >= 500_000:
            self.clear()
        low = self[token] = hashlib.md5(token.encode()).digest()[8:]
        return low


_DIGESTS = _Digests()


def _simhash(text: pd.Series) -> pd.Series:
    def one(t):
        tokens = (t or "").lower().split()
        if not tokens:
            return 0
        low = b"".join(map(_DIGESTS.__getitem__, tokens))
        each = np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1)
        bits = sum(each[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(each), 255))
        return int.from_bytes(np.packbits(2 * bits > len(tokens)).tobytes(), "big", signed=True)

    return text.map(one).astype("int64")


def ratio(a: Column, b: Column) -> Column:
    """The share of matching characters."""
    return ship(F.pandas_udf(_ratio, "double"))(a, b)


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def jaro_winkler_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(la, lb) // 2 - 1
    free, used_a = [True] * lb, []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                used_a.append(ch)
                break
    m = len(used_a)
    if not m:
        return 0.0
    used_b = [ch for j, ch in enumerate(b) if not free[j]]
    swaps = sum(x != y for x, y in zip(used_a, used_b, strict=True)) // 2
    jaro = (m / la + m / lb + (m - swaps) / m) / 3
    lead = 0
    while lead < min(4, la, lb) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    return ship(F.pandas_udf(_jaro_winkler, "double"))(a, b)


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column, semantic: Column | None = None) -> Column:
    """1 for equal names, 0.98 for equal letters, else Jaro-Winkler; across scripts 0.3 of it, with 0.7 of the semantic score if there is one."""
    jw = jaro_winkler(F.lower(a), F.lower(b))
    na, nb = expr.normalize_alnum(a), expr.normalize_alnum(b)
    mixed = jw * 0.3 if semantic is None else F.coalesce(semantic * 0.7 + jw * 0.3, jw * 0.3)
    return F.when(a == b, 1.0).when((na != "") & (na == nb), 0.98).when(expr.is_chinese(a) != expr.is_chinese(b), mixed).otherwise(jw)


def cosine(a: Column, b: Column) -> Column:
    """(cos + 1) / 2 of two arrays; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return (F.when(size > 0, dot(a, b) / size) + 1) / 2


# ---------------------------------------------------------------- greedy


def _replay(batches):
    """Edges (label, b, a) in this order -> (id, leader) of every b: its earliest kept neighbour, or itself."""
    label, gone, last, lead = object(), set(), None, None
    for batch in batches:
        ids, leaders = [], []
        for tag, b, a in zip(*(batch.column(c).to_pylist() for c in ("label", "b", "a")), strict=True):
            if last is not None and (tag != label or b != last):
                ids.append(last)
                leaders.append(last if lead is None else lead)
                if lead is not None:
                    gone.add(last)
                last = lead = None
            if tag != label:
                label, gone = tag, set()
            if lead is None and a not in gone:
                lead = a
            last = b
        yield _leaders(batch, ids, leaders)
    if last is not None:
        yield _leaders(batch, [last], [last if lead is None else lead])


def _leaders(batch: pa.RecordBatch, ids: list, leaders: list) -> pa.RecordBatch:
    kind = batch.schema.field("b").type
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(leaders, kind)], ["id", "leader"])


def _rounds(near: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, leader) of every b of near(a, b): rows all of whose earlier neighbours are decided are decided, until all are.

    Only open rows' edges are written again from round to round.
    """
    late = near.select(F.col("b").alias("id")).distinct()
    first = near.join(late.withColumn("late", F.lit(True)), F.col("a") == F.col("id"), "left").select("a", "b", F.when(F.col("late").isNull(), F.lit(True)).alias("kept"))
    edges, made = scratch.settle(first), []
    while True:
        each = edges.groupBy("b").agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("drop"), F.count_if(F.col("kept").isNull()).alias("wait"), F.min(F.when(F.col("kept"), F.col("a"))).alias("low"))
        sure = (F.col("wait") == 0) | F.col("drop")
        new = scratch.settle(each.where(sure).select(F.col("b").alias("id"), (~F.col("drop")).alias("now")))
        if not new.limit(1).count():
            break
        made.append(new)
        left = edges.join(new.select(F.col("id").alias("b")), "b", "left_anti").join(new.withColumnRenamed("id", "a"), "a", "left")
        fewer = scratch.settle(left.select("a", "b", F.coalesce("kept", "now").alias("kept")))
        scratch.drop(edges)
        edges = fewer
    decided = scratch.settle(reduce(DataFrame.union, made))
    gone = decided.where("not now").select("id")
    low = near.join(gone.withColumnRenamed("id", "b"), "b", "left_semi").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("leader"))
    return decided.where("now").select("id", F.col("id").alias("leader")).union(low.select("b", "leader"))


def greedy_leaders(rows: DataFrame, near: DataFrame, most: int = 2_000_000) -> DataFrame:
    """rows(id), near(a, b) with a earlier than b -> (id, leader): kept rows lead themselves, others go to their earliest kept neighbour.

    Earlier means the smaller id. A row depends on rows of its own component only, so each component of up to `most`
    pairs is replayed in order by one task, a pair at a time; larger ones go by rounds, each of which decides every
    row whose earlier neighbours are decided.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "leaders")
    near = scratch.settle(near.select("a", "b").distinct())
    label = components(near)
    edges = scratch.settle(near.join(label.withColumnRenamed("node", "a"), "a").select("label", "b", "a"))
    size = scratch.settle(edges.groupBy("label").agg(F.count("*").alias("n")))
    ship_package(spark)
    small = edges.join(size.where(F.col("n") <= most).select("label"), "label", "left_semi").repartition("label").sortWithinPartitions("label", "b", "a")
    kind = near.schema["a"].dataType.simpleString()
    lead = small.mapInArrow(_replay, f"id {kind}, leader {kind}")
    if size.where(F.col("n") > most).limit(1).count():
        large = scratch.settle(edges.join(size.where(F.col("n") > most).select("label"), "label", "left_semi").select("a", "b"))
        lead = lead.union(_rounds(large, scratch))
    out = settle(rows.select("id").join(lead, "id", "left").select("id", F.coalesce("leader", "id").alias("leader")))
    scratch.close()
    return out


def band_masks(threshold: int) -> list[int]:
    """Of threshold + 2 groups of bits two agree at least: the masks of each choice of two, as signed longs."""
    n = threshold + 2
    group = [sum(1 << i for i in range(b, 64, n)) for b in range(n)]
    return [int(np.array(x | y, np.uint64).view(np.int64)) for x, y in combinations(group, 2)]


#: Rows of a bucket that are compared where they lie, about; larger buckets are cut into blocks of half as many, every two of which meet in a tile.
BUCKET = 16_384
#: Up to this size a bucket's rows are compared together with those of other buckets; rows that a task compares at once; sides of a product.
FEW, CHUNK, SIDE = 64, 100_000, 2048
#: Rows of which a first batch has at most so many; how many times as many the next one has, with all before it.
START, FACTOR = 100_000, 8


def near_fingerprints(prints: DataFrame, threshold: int) -> DataFrame:
    """prints(id, fp), one id per fingerprint -> (a, b), a < b, within `threshold` bits: no pair is missed."""
    return near_links(prints.select("id", "fp", F.lit(True).alias("new")), threshold, prints.count()).select("a", "b").distinct()


def near_links(rows: DataFrame, threshold: int, n: int) -> DataFrame:
    """rows(id, fp, new), about n of them, one id per fingerprint and old ones before new ones -> (a, b, old), several times, within `threshold` bits.

    With old, a is an old row near the new row b: all pairs but those that can't be b's earliest. Without it, a < b are
    new rows: all pairs but some of which one has an old row near. Rows meet in buckets, in which the bits of two groups agree;
    a sample tells which are large.
    """
    ship_package(rows.sparkSession)
    masks = band_masks(threshold)
    key = lambda r: r.select("id", "fp", "new", F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])).alias("band"))
    band, one = key(rows), F.lit(0)
    if n > BUCKET:
        step = max(1, BUCKET // 256)
        some = key(rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)).groupBy("band").agg((F.count("*") * step).alias("size"))
        hot = settle(some.where(F.col("size") > BUCKET).select("band", F.ceil(F.col("size") * 2 / BUCKET).cast("int").alias("blocks")))
        cut = band.join(hot, "band", "left").withColumn("c", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).otherwise(0))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        band = cut.select("band", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("half"), "new", "id", "fp")
    else:
        band = band.select("band", one.alias("i"), one.alias("j"), F.lit(False).alias("half"), "new", "id", "fp")
    kind = rows.schema["id"].dataType.simpleString()
    dealt = band.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "half", "new", "id")
    found = dealt.mapInArrow(partial(_near, threshold=threshold), f"a {kind}, b {kind}, old boolean")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "old").where("a < b")


def _near(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, i, j, half, new, id, fp) in this order, tile by tile -> (a, b, old); a tile may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > CHUNK:
            t = pa.Table.from_batches(held)
            last = _tile_starts(t)[-1]
            if last:
                yield from _near_in(t.slice(0, last), threshold)
                held = t.slice(last).to_batches()
    if held:
        yield from _near_in(pa.Table.from_batches(held), threshold)


def _tile_starts(t: pa.Table) -> np.ndarray:
    change = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in ("band", "i", "j"):
        change |= np.diff(t.column(c).to_numpy()) != 0
    return np.r_[0, np.flatnonzero(change) + 1]


def _near_in(t: pa.Table, threshold: int) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    start = _tile_starts(t)
    size = np.diff(np.r_[start, t.num_rows])
    fp, ids = t.column("fp").to_numpy().view(np.uint64), t.column("id").combine_chunks()
    new, half = (t.column(c).to_numpy() for c in ("new", "half"))
    whole = t.column("i").to_numpy()[start] == t.column("j").to_numpy()[start]
    few = whole & (size <= FEW)
    some = np.flatnonzero(np.repeat(few & (size > 1), size))
    tile = np.repeat(np.arange(len(start)), size)
    out = [_near_few(fp, tile, new, some, threshold)]
    for k in np.flatnonzero(~few).tolist():
        at = np.arange(start[k], start[k] + size[k])
        out += _near_whole(fp, at, new, threshold) if whole[k] else _near_across(fp, at[~half[at]], at[half[at]], new, threshold)
    a, b, old = (np.concatenate(x) for x in zip(*out, strict=True))
    for lo in range(0, len(a), CHUNK):
        x, y = (ids.take(pa.array(v[lo : lo + CHUNK])) for v in (a, b))
        yield pa.RecordBatch.from_arrays([x, y, pa.array(old[lo : lo + CHUNK])], ["a", "b", "old"])


def _near_few(fp, tile, new, some, threshold):
    """(a, b, old) of many small tiles at once: each row with the next one, the one after that and so on."""
    fp, tile, new = fp[some], tile[some], new[some]
    at, step, found = np.arange(len(some)), 1, [(np.zeros(0, np.int64),) * 2]
    while len(at):
        at = at[at + step < len(some)]
        at = at[tile[at + step] == tile[at]]
        hit = at[new[at + step] & (np.bitwise_count(fp[at] ^ fp[at + step]) <= threshold)]
        found.append((hit, hit + step))
        step += 1
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    old = ~new[a]
    order = np.lexsort((a[old], b[old]))
    led, first = np.unique(b[old][order], return_index=True)
    gone = np.zeros(len(some), bool)
    gone[led] = True
    left = ~old & ~gone[a] & ~gone[b]
    return some[np.r_[a[old][order][first], a[left]]], some[np.r_[led, b[left]]], np.arange(len(led) + left.sum()) < len(led)


def _near_whole(fp, at, new, threshold):
    *led, left = _near_old(fp, at[new[at]], at[~new[at]], threshold)
    return [tuple(led), _near_new(fp, left, left, threshold, True)]


def _near_across(fp, one, other, new, threshold):
    *led, x = _near_old(fp, one[new[one]], other[~new[other]], threshold)
    *more, y = _near_old(fp, other[new[other]], one[~new[one]], threshold)
    return [tuple(led), tuple(more), _near_new(fp, x, y, threshold, False)]


def _near_old(fp, new, old, threshold):
    """(a, b, old) with each new row's first near old row, and the new rows that have none."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(old), SIDE):
        left = []
        for k in range(0, len(new), SIDE):
            rows = new[k : k + SIDE]
            near = np.bitwise_count(fp[rows][:, None] ^ fp[old[lo : lo + SIDE]][None, :]) <= threshold
            some = near.any(1)
            a.append(old[lo + near[some].argmax(1)])
            b.append(rows[some])
            left.append(rows[~some])
        new = np.concatenate(left) if left else new
    a, b = np.concatenate(a), np.concatenate(b)
    return a, b, np.ones(len(a), bool), new


def _near_new(fp, x, y, threshold, same):
    """(a, b, not old) for the near pairs of two lists of rows, or of one list, whose rows ascend."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(0, len(x), SIDE):
        for q in range(p if same else 0, len(y), SIDE):
            i, j = np.nonzero(np.bitwise_count(fp[x[p : p + SIDE]][:, None] ^ fp[y[q : q + SIDE]][None, :]) <= threshold)
            i, j = x[p + i], y[q + j]
            up = i < j if same else slice(None)
            a.append(i[up])
            b.append(j[up])
    a, b = np.concatenate(a), np.concatenate(b)
    return a, b, np.zeros(len(a), bool)


def _cuts(rows: DataFrame, n: int) -> list:
    """Ids at which rows(id), n of them, are cut into batches, by a sample of some thousand ids; any cuts are right."""
    parts, m = [], n
    while m > START:
        m /= FACTOR
        parts.append(m / n)
    if not parts:
        return []
    ids = [r["id"] for r in rows.select("id").where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 4096))) == 0).orderBy("id").collect()]
    return sorted({ids[int(len(ids) * p)] for p in parts}) if ids else []


def fingerprint_leaders(first: DataFrame, threshold: int) -> DataFrame:
    """first(id, fp), one id per fingerprint -> (id, leader): fingerprints within `threshold` bits are near.

    As greedy_leaders over all near pairs, batch by batch in order of id.
    """
    scratch = Scratch(first.sparkSession, "batches")
    n = first.count()
    cuts, kept, out = _cuts(first, n), None, []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        mine = first
        mine = mine if low is None else mine.where(F.col("id") > F.lit(low))
        mine = mine if high is None else mine.where(F.col("id") <= F.lit(high))
        rows = mine.select("id", "fp", F.lit(True).alias("new"))
        if kept is not None:
            rows = rows.union(kept.select("id", "fp", F.lit(False)))
        links = scratch.settle(near_links(rows, threshold, n))
        near = links.where("not old").select("a", "b")
        if kept is not None:
            led = scratch.settle(links.where("old").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")))
            out.append(led)
            mine = mine.join(led, "id", "left_anti")
            near = near.join(led.select(F.col("id").alias("a")), "a", "left_anti").join(led.select(F.col("id").alias("b")), "b", "left_anti")
        lead = greedy_leaders(mine, near)
        out.append(lead)
        if high is not None:
            now = scratch.settle(mine.join(lead.where("id = leader").select("id"), "id", "left_semi").select("id", "fp"))
            kept = now if kept is None else kept.union(now)
        scratch.drop(links)
    done = settle(reduce(DataFrame.unionByName, out))
    scratch.close()
    return done


def dedup_news(news: DataFrame, threshold: int = 3, text: str = "content") -> DataFrame:
    """news(id, text) -> (id, fp, kept, leader), in order of id; empty texts go.

    Only the first row of each fingerprint takes part in the batches; the others follow it.
    """
    prints = settle(news.where(F.coalesce(F.trim(text), F.lit("")) != "").select("id", simhash(F.col(text)).alias("fp")))
    first = settle(prints.groupBy("fp").agg(F.min("id").alias("id")))
    lead = fingerprint_leaders(first, threshold)
    group = first.join(lead, "id").select("fp", F.col("id").alias("first"), "leader")
    return prints.join(group, "fp").select("id", "fp", (F.col("id") == F.col("leader")).alias("kept"), "leader")


def dedup_with_history(news: DataFrame, processed: DataFrame, threshold: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept news, counts): rows whose global id is in processed(global_id) are skipped before the fingerprints."""
    from newsloom.operators.ingest import drop_processed

    fresh = drop_processed(news, processed)
    found = settle(dedup_news(fresh, threshold))
    counts = news.agg(F.count("*").alias("read")).withColumn("k", F.lit(1)).join(found.agg(F.count("*").alias("fresh"), F.count_if("kept").alias("kept")).withColumn("k", F.lit(1)), "k").drop("k")
    return fresh.join(found.where("kept").select("id"), "id", "left_semi"), counts


def dedup_by_url(news: DataFrame, keys: tuple[str, ...] = ("url",)) -> DataFrame:
    """The first row (by id) of each url."""
    return news.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where("_n = 1").drop("_n")


def blocked_pairs(rows: DataFrame, text: str, block: Column, score, least: float) -> DataFrame:
    """rows(id, text) -> (a, b, score), a < b, of one block and with lengths that allow the score, at `least` or more."""
    r = rows.select("id", F.col(text).alias("t"), block.alias("block"), F.length(text).alias("n"))
    x, y = r.select(F.col("id").alias("a"), F.col("t").alias("ta"), "block", F.col("n").alias("na")), r.select(F.col("id").alias("b"), F.col("t").alias("tb"), "block", F.col("n").alias("nb"))
    can = 2 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb"))
    return x.join(y, "block").where((F.col("a") < F.col("b")) & can).select("a", "b", score(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") >= least)


def _marks(text: pd.Series) -> pd.Series:
    """Each character with the number of its occurrence in the text so far."""

    def one(t):
        seen, out = {}, []
        for ch in t:
            seen[ch] = seen.get(ch, 0) + 1
            out.append(f"{ch}{seen[ch]}")
        return out

    return text.map(one)


def overlapping_pairs(texts: DataFrame, own_need, pair_need) -> DataFrame:
    """texts(id, t), one id per text -> (a, b), a < b: all pairs with pair_need(n, m) characters in common, repeats counted.

    n and m are the lengths, and own_need(n) is the least that a text of length n needs with any partner. In one
    order of all marks (character and occurrence), the rarest first, two such texts share one of their first
    n - own_need(n) + 1, so no pair is missed; where they first agree, what follows must still reach the need.
    """
    marked = settle(texts.where("t is not null").select("id", ship(F.pandas_udf(_marks, "array<string>"))(F.col("t")).alias("marks")))
    each = marked.select("id", F.size("marks").alias("n"), F.explode("marks").alias("mark"))
    often = each.groupBy("mark").agg(F.count("*").alias("often"))
    place = F.row_number().over(W.partitionBy("id").orderBy("often", "mark"))
    head = each.join(often, "mark").withColumn("place", place).where(F.col("place") <= F.col("n") - F.greatest(own_need(F.col("n")), F.lit(1)) + 1)
    head = settle(head.where("often > 1").select("id", "n", "mark", "place"))
    x, y = (head.select("mark", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "place")]) for k in "ab")
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    pair = x.join(y, "mark").where((F.col("id_a") < F.col("id_b")) & (rest >= pair_need(F.col("n_a"), F.col("n_b"))))
    pair = pair.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    x, y = (marked.select(F.col("id").alias(k), F.col("marks").alias(f"m{k}")) for k in "ab")
    return pair.join(x, "a").join(y, "b").where(F.size(F.array_intersect("ma", "mb")) >= pair_need(F.size("ma"), F.size("mb"))).select("a", "b")


#: Against rounding: a need that is too small by this costs nothing.
_SLACK = 1e-9


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x, y = (texts.select(F.col("id").alias(k), F.col("t").alias(f"t{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b")


def ratio_pairs(texts: DataFrame, least: float) -> DataFrame:
    """texts(id, t) -> (a, b), a < b: the ratio (H15) of the later text to the earlier is `least` (above 0) or more."""
    own = lambda n: F.ceil(n * (least / (2 - least)) - _SLACK)
    both = lambda n, m: (n + m) * (least / 2) - _SLACK
    return with_texts(overlapping_pairs(texts, own, both), texts).where(ratio(F.col("tb"), F.col("ta")) >= least).select("a", "b")


def name_pairs(texts: DataFrame, least: float) -> DataFrame:
    """texts(id, t) -> (a, b), a < b, whose similarity (H14) is `least` (above 0) or more.

    A Jaro-Winkler of w needs a Jaro of (w - 0.4) / 0.6, which is (k/n + k/m + 1) / 3 at most with k common
    characters. Names of equal letters meet on those.
    """
    jaro = (least - 0.4) / 0.6
    own = lambda n: F.ceil(n * (3 * jaro - 2) - _SLACK)
    both = lambda n, m: n * m / (n + m) * (3 * jaro - 1) - _SLACK
    close = overlapping_pairs(texts.select("id", F.lower("t").alias("t")), own, both)
    key = texts.select("id", expr.normalize_alnum(F.col("t")).alias("key")).where("key <> ''")
    equal = key.select("key", F.col("id").alias("a")).join(key.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    return with_texts(close.union(equal).distinct(), texts).where(similarity(F.col("ta"), F.col("tb")) >= least).select("a", "b")


def _lead(rows: DataFrame, text: Column, pairs) -> DataFrame:
    """(id, leader): greedy over the distinct texts, pairs(texts) being the near ones; rows of one text go where its first row goes."""
    all_ = rows.select("id", text.alias("t"))
    first = settle(all_.groupBy("t").agg(F.min("id").alias("id")).where("t is not null"))
    lead = first.join(greedy_leaders(first, pairs(first)), "id").select("t", "leader")
    return all_.join(lead, "t").select("id", "leader")


def merge_similar_events(events: DataFrame, least: float = 0.8) -> DataFrame:
    """events(id, abstract, entities, source) -> leaders with the united entities and sources of what they absorb.

    An event goes to the earliest kept one whose abstract is similar (H15); a null abstract is an empty one.
    """
    lead = settle(_lead(events, F.coalesce("abstract", F.lit("")), lambda t: ratio_pairs(t, least)))
    both = events.join(lead, "id")
    ents = both.select("leader", F.explode("entities").alias("e")).groupBy("leader").agg(F.array_sort(F.collect_set("e")).alias("entities"))
    rest = both.groupBy("leader").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))
    return rest.join(ents, "leader", "left").join(events.select(F.col("id").alias("leader"), "abstract"), "leader")


def precluster(rows: DataFrame, least: float = 0.93, name: str = "name") -> DataFrame:
    """rows(id, name) -> (id, leader) by greedy leader clustering on H14; rows without a name go."""
    return _lead(rows, F.col(name), lambda t: name_pairs(t, least))


def precluster_events(events: DataFrame, least: float = 0.93, most: int | None = None) -> DataFrame:
    """events(id, abstract, summary) -> (id, leader) on abstract and summary together, the first `most` characters of it if set."""
    summary = F.trim(F.coalesce("summary", F.lit("")))
    text = F.lower(F.concat(F.col("abstract"), F.lit(" "), summary if most is None else F.substring(summary, 1, most)))
    return _lead(events, text, lambda t: name_pairs(t, least))


# ---------------------------------------------------------------- first-fit buckets


def linked(members: DataFrame) -> DataFrame:
    """members(id, key) -> (id, label): the smallest id reachable through shared keys. A key of any size is a star, not a clique."""
    members = settle(members.where("id is not null").distinct())
    first = members.where("key is not null").groupBy("key").agg(F.min("id").alias("b"))
    label = components(members.join(first, "key").select(F.col("id").alias("a"), "b"))
    return members.select("id").distinct().join(label.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _first_fit(days: int, overlap: int, most: int):
    window = days * 86400

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "event_id"])
        live, made, out = {}, 0, []  # bucket -> [events, last time, entities], in order of opening; only those that may still take events
        for t, entities in zip(group["t"], group["entities"], strict=True):
            mine = set(() if entities is None else entities)
            live = {k: b for k, b in live.items() if t - b[1] <= window and b[0] < most}
            k = next((k for k, b in live.items() if overlap <= 0 or len(b[2] & mine) >= overlap), made)
            made = max(made, k + 1)
            size, _, known = live.get(k, (0, t, set()))
            live[k] = (size + 1, t, known | mine)
            out.append(k)
        return pd.DataFrame({"event_id": group["event_id"], "bucket": [f"{p}-{k}" for p, k in zip(group["part"], out, strict=True)]})

    return run


def bucket_events(events: DataFrame, days: int = 7, overlap: int = 1, most: int = 50) -> DataFrame:
    """I16: events(event_id, time, entities) -> (event_id, bucket), first fit in time order; events without a time go.

    A bucket never spans a gap longer than `days`, so the history is cut there. With an overlap of 1 or more it never
    spans events that no chain of shared entities links either, so each stretch falls into those components. Both
    cuts are exact. One component of one stretch (with overlap 0, one stretch) is one task.
    """
    w = W.partitionBy(F.lit(0)).orderBy("day")
    day = events.where("time is not null").select(F.to_date("time").alias("day")).distinct()  # a row per day of history
    part = day.withColumn("part", F.sum(F.coalesce(F.datediff("day", F.lag("day").over(w)) > days + 1, F.lit(False)).cast("int")).over(w))
    e = events.where("time is not null").select("event_id", "entities", F.unix_seconds(F.col("time").cast("timestamp")).alias("t"), F.to_date("time").alias("day"))
    e = e.join(part, "day").drop("day").withColumn("part", F.col("part").cast("string"))
    if overlap > 0:
        e = settle(e)
        tied = linked(e.select(F.col("event_id").alias("id"), F.explode("entities").alias("entity"), "part").select("id", F.struct("part", "entity").alias("key")))
        e = e.join(tied.withColumnRenamed("id", "event_id"), "event_id", "left").withColumn("part", F.concat_ws("/", "part", F.coalesce("label", "event_id"))).drop("label")
    return e.groupBy("part").applyInPandas(ship(_first_fit)(days, overlap, most), "event_id string, bucket string")
