"""Packing token pieces into sequences by bin completion.

Sequences depend only on how many pieces have each length, and there are at most `capacity` lengths,
so the search runs on that bounded histogram. Around the largest piece left, undominated fillings
are enumerated depth first, larger pieces first; a branch is pruned when the space it must waste is
not below the incumbent's, and the first incumbent is the best-fit filling. The filling found is
used as often as the counts allow. Spark then deals the pieces into the slots by their rank.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.util import SPACE, arrow_map, materialize, slices, text_buffers, words_of

# ---------------------------------------------------------------- tokens

_WORDS: dict[str, dict[bytes, bytes]] = {}
_PARTS: dict[str, dict[str, bytes]] = {}
_TOKENIZER: dict[str, object] = {}
KEPT_WORDS = 1_000_000
#: Words, in lower case, that the tokenizer certainly cuts into one run of letters and the marks around it: Latin letters, no apostrophe, no digit, no <.
PLAIN = re.compile("([.,;:!?()#$%&*-]*)([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?()#$%&*-]*)")


def _encode_words(words: list[bytes], known: dict[bytes, bytes], path: str) -> None:
    """Add the words' ids to `known`. Plain words are cut into letters in lower case and marks, so that only new parts are encoded, many in one text."""
    if path not in _TOKENIZER:
        from tokenizers import Tokenizer

        _TOKENIZER[path] = Tokenizer.from_file(path)
    encoder, parts = _TOKENIZER[path], _PARTS.setdefault(path, {"": b""})
    waiting, other = [], []
    have, cut = parts.get, PLAIN.fullmatch
    for w, low in zip(words, b" ".join(words).decode().lower().split(" "), strict=True):
        m = cut(low)
        if m is None:
            other.append(w)
            continue
        before, stem, after = m.groups()
        x, y, z = have(before), have(stem), have(after)
        if x is None or y is None or z is None:
            waiting.append((w, before, stem, after))
        else:
            known[w] = x + y + z
    new = set()
    for _, before, stem, after in waiting:
        new.update((before, stem, after))
    new = [p for p in new if p not in parts]
    for lo in range(0, len(new), 20_000):
        some = new[lo : lo + 20_000]
        code = encoder.encode(" ".join(some), add_special_tokens=False)
        ids, of = np.array(code.ids, "<u4"), np.array(code.word_ids)
        at = np.searchsorted(of, np.arange(len(some) + 1)).tolist()
        if of[-1] + 1 != len(some):
            raise ValueError("the tokenizer does not keep runs of letters and of marks whole")
        raw = ids.tobytes()
        parts.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, at, at[1:], strict=False))
    for w, x, y, z in waiting:
        known[w] = parts[x] + parts[y] + parts[z]
    if other:
        coded = encoder.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, coded, strict=True))


def token_ids(col: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): each text's ids, with `end_id` after them.

    The tokenizer never merges over white space, so ids are looked up by white-space-separated word, each
    distinct word of the slice once, in a bounded table that each Python worker keeps.
    """
    known = _WORDS.setdefault(path, {})
    if len(known) > KEPT_WORDS:
        known.clear(), _PARTS[path].clear()
        _PARTS[path][""] = b""
    data, off = text_buffers(col)
    start, end, first = words_of(data, off)
    bound = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=bound[1:])
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bound), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    code = list(map(known.get, distinct))
    new = [i for i, c in enumerate(code) if c is None]
    if new:
        _encode_words([distinct[i] for i in new], known, path)
        for i in new:
            code[i] = known[distinct[i]]
    code.append(np.array([end_id], "<u4").tobytes())
    size = np.fromiter(map(len, code), np.int64, len(code)) // 4
    flat = np.frombuffer(b"".join(code), "<u4")
    which = np.insert(words.indices.to_numpy().astype(np.int64), first[1:], len(distinct))
    n = size[which]
    after = np.cumsum(n)
    ids = flat[np.repeat((np.cumsum(size) - size)[which] - (after - n), n) + np.arange(n.sum())]
    return ids, np.r_[0, after[first[1:] + np.arange(len(off) - 1)]]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, ids: bool) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    for b in (part for batch in batches for part in slices(batch, most=4 << 20)):
        all_ids, off = token_ids(b.column("text"), path, end_id)
        n = np.diff(off)
        count = -(-n // capacity)
        piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(np.repeat(n, count) - start, capacity)
        at = np.repeat(off[:-1], count) + start
        raw = memoryview(all_ids.tobytes())
        crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
        doc = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), count)))
        cols = [doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:  # pieces lie one after the other
            cols, names = [*cols, pa.ListArray.from_arrays(pa.array(np.r_[at, len(all_ids)].astype(np.int32)), pa.array(all_ids.astype(np.int32)))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(cols, names)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and `end_id`, cut only where longer than capacity. Null text: empty."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id, ids=ids), kind)


# ---------------------------------------------------------------- bin completion

def best_filling(room: int, have: dict[int, int], sizes: list[int], effort: int | None, enough: int = 0) -> list[int]:
    """Sizes that fill `room` with the least waste; larger sizes first, so dominated fillings come later and are pruned.

    sizes: descending, have: count of each. The first descent is the best-fit filling, the incumbent.
    The search ends at a waste of `enough` or less, or after `effort` branches (None: when all are searched or pruned).
    """
    down = [-s for s in sizes]
    total = [0] * (len(sizes) + 1)  # of all pieces from a size on: what a branch can fill at most
    for i in range(len(sizes) - 1, -1, -1):
        total[i] = total[i + 1] + have[sizes[i]] * sizes[i]
    best, waste, i = [], room, 0
    while i < len(sizes):
        i = max(i, bisect_left(down, -waste))
        if i < len(sizes):
            fit = min(have[sizes[i]], waste // sizes[i])
            best += [sizes[i]] * fit
            waste -= fit * sizes[i]
            i += 1
    used: dict[int, int] = {}
    chosen: list[int] = []
    open_ = [(room, 0)]  # per piece chosen, the space left and the next size to try
    left = math.inf if effort is None else effort
    while open_ and waste > enough and left > 0:
        space, i = open_.pop()
        i = max(i, bisect_left(down, -space))
        if i == len(sizes) or space - total[i] >= waste:
            if chosen:
                used[chosen.pop()] -= 1
            continue
        open_.append((space, i + 1))
        left -= 1
        s = sizes[i]
        if have[s] > used.get(s, 0):
            used[s] = used.get(s, 0) + 1
            chosen.append(s)
            open_.append((space - s, i))
            if space - s < waste:
                best, waste = chosen.copy(), space - s
    return best


def _complete(hist: dict[int, int], capacity: int, effort: int | None, enough: int) -> list[tuple[list[int], int]]:
    have = {s: c for s, c in hist.items() if c > 0}
    sizes = sorted(have, reverse=True)
    bins = []
    while sizes:
        top = sizes[0]
        have[top] -= 1
        rest = best_filling(capacity - top, have, [s for s in sizes if have[s] > 0], effort, enough)
        have[top] += 1
        need: dict[int, int] = {}
        for s in (top, *rest):
            need[s] = need.get(s, 0) + 1
        times = min(have[s] // c for s, c in need.items())
        for s, c in need.items():
            have[s] -= c * times
        bins.append(([top, *rest], times))
        sizes = [s for s in sizes if have[s] > 0]
    return bins


def fill_bins(hist: dict[int, int], capacity: int, effort: int | None = 3000) -> list[tuple[list[int], int]]:
    """[(sizes of one bin, number of such bins)] that hold all pieces of hist = {size: count}.

    The solution that takes every bin's best-fit filling (it equals first-fit decreasing) is the first
    incumbent; searches that accept more or less waste in a bin follow until one reaches the lower bound.
    Packing is NP-hard: `effort` bounds the branches of a bin (None: no bound); what is left over then
    keeps the incumbent's filling.
    """
    total, n = sum(s * c for s, c in hist.items()), sum(hist.values())
    least = max(-(-total // capacity), sum(c for s, c in hist.items() if 2 * s > capacity))
    mean = (least * capacity - total) // max(1, least)
    best: list[tuple[list[int], int]] = []
    fewest = n + 1
    for enough in dict.fromkeys((capacity, 0, mean, 2 * mean, capacity // 64)):
        bins = _complete(hist, capacity, effort, enough)
        if (count := sum(k for _, k in bins)) < fewest:
            best, fewest = bins, count
        if fewest <= least:
            break
    return best


# ---------------------------------------------------------------- Spark

def pack(pieces: DataFrame, capacity: int = 2048, size: str = "length", by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id (long) and offset (long, the place inside the sequence).

    Every row is placed once; repeated rows are separate pieces. Rows of one size are ranked inside
    salted groups of about the square root of all rows, so a size that a third of the rows share is
    not sorted in one task. Sizes must be 1 to capacity.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy(size).count().collect()  # at most `capacity` rows
    hist = {int(r[size]): int(r["count"]) for r in counts}
    if hist and not 1 <= min(hist) <= max(hist) <= capacity:
        raise ValueError(f"sizes must be 1 to {capacity}")
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for bin_, times in fill_bins(hist, capacity):
        at = 0
        for s in dict.fromkeys(bin_):
            each, low = bin_.count(s), taken.get(s, 0)
            runs.setdefault(s, []).append((low, low + each * times, sequence, each, at))
            taken[s] = low + each * times
            at += s * each
        sequence += times
    slot = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("low", "high", "sequence", "each", "at")]))
    slots = spark.createDataFrame(list(runs.items()), T.StructType([T.StructField(size, T.LongType()), T.StructField("_runs", slot)]))
    salts = max(1, math.isqrt(sum(hist.values())))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    first = salted.groupBy(size, "_salt").agg(F.count("*").alias("_n"))
    first = first.select(size, "_salt", (F.sum("_n").over(W.partitionBy(size).orderBy("_salt")) - F.col("_n")).alias("_first"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(size, "_salt").orderBy(*by)))
    # slots: one row for each of at most `capacity` sizes, and at most that many runs in all bins together
    placed = ranked.join(first, [size, "_salt"]).join(F.broadcast(slots), size).withColumn("_rank", F.col("_first") + F.col("_rank") - 1)
    run = F.element_at(F.filter("_runs", lambda x: (x.low <= F.col("_rank")) & (F.col("_rank") < x.high)), 1)
    within = F.col("_rank") - F.col("_run.low")
    placed = placed.withColumn("_run", run)
    return placed.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(within / F.col("_run.each"))).cast("long").alias("sequence_id"),
        (F.col("_run.at") + F.col(size) * (within % F.col("_run.each"))).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, ids: bool = True) -> DataFrame:
    """The pieces of all documents with their places; with ids, also the tokens themselves (array<int>)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(token_pieces(docs, tokenizer, capacity, end_id, ids), "pieces")
    return pack(pieces, capacity)


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
