"""Removing passages that repeat across documents, by a compacted de Bruijn graph of word windows.

Edges of the graph are windows of k words that several documents have, nodes the k - 1 words that
neighbours share. An edge's coordinate is its first place in the corpus: words are numbered through
all documents in doc_id order.

1. Only windows that can repeat become edges: a window's minimizer (a three-word gram, the one with
   the most bytes in its words and then the lowest by hash) must occur in two different texts. One count over minimizers, about
   a sixth of the windows, decides that.
2. Edges found in two documents keep the smallest coordinate. Both nodes of each edge are emitted, and one
   count finds the nodes with more than one edge in or out.
3. Edges whose sources follow each other over a node that doesn't branch are one segment. Segments of different
   documents that meet in a node with one edge in and one out are linked by a join, and pointer jumping along
   these links gives each segment its place in a nonbranching path (a unitig).
4. Occurrences in later documents that follow their sources become spans, cut where segments end, with
   their place in the unitig.
5. Both ends' words are read again by their coordinates, and their SHA-256 must agree. Windows of spans that
   don't (hashes have 64 bits) are decided by their words alone.

Texts of equal words are one node class from the start: copies never meet as windows. What is collected for
one document (its grams, its edges' places, its spans) is never more than its own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.util import U, arrow_map, materialize, mix, own_names, slices, span_hash, text_buffers, window_hashes, word_hashes, words_of

GRAM = 3
NOTHING = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- inside tasks

def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, n_words, sha256 of the words joined by one space."""
    for b in batches:
        n, sha = [], []
        for t in b.column("text").to_pylist():
            words = (t or "").encode().split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row", "n_words", "sha"])


def windows(b: pa.RecordBatch, k: int):
    """(window hash, position among the slice's words, text, minimizer hash), and per text its class and its first word's position."""
    data, off = text_buffers(b.column("text"))
    start, end, first = words_of(data, off)
    word = word_hashes(data, start, end)
    edge, pos, doc = window_hashes(word, first, k)
    whole = span_hash(word, first[:-1], first[1:]) if len(word) else np.zeros(len(first) - 1, U)
    if not len(edge):
        return edge, pos, doc, edge, whole, first
    gram = span_hash(word, np.arange(len(word) - GRAM + 1), np.arange(GRAM, len(word) + 1), 1)
    letters = np.r_[0, np.cumsum(end - start)]  # the words' own bytes: what stands between them must not count
    size = np.minimum(letters[GRAM:] - letters[:-GRAM], 255).astype(U)
    order = ((U(255) - size) << U(56)) | (mix(gram) >> U(8))
    at = np.lib.stride_tricks.sliding_window_view(order, k - GRAM + 1)[pos].argmin(axis=1) + pos
    return edge, pos, doc, gram[at], whole, first


def _minimizers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            _, _, doc, gram, whole, _ = windows(b, k)
            row = b.column("row").to_numpy()
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            doc = doc[new]
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(row[doc]), pa.array(whole.view(np.int64)[doc])], ["gram", "row", "class"])


def _edges(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Edges whose minimizer is among the text's repeated ones."""
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            edge, pos, doc, gram, _, first = windows(b, k)
            lists = b.column("grams")
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            known = lists.flatten().to_numpy().view(U)
            hit = np.isin(gram ^ mix(doc.astype(U)), known ^ mix(of.astype(U)))
            base = b.column("base").to_numpy()[doc[hit]]
            yield pa.RecordBatch.from_arrays([pa.array((edge[hit] >> U(64 - bits)).view(np.int64)), pa.array(base + pos[hit] - first[doc[hit]]), pa.array(base)], ["edge", "coord", "base"])


def _nodes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Both nodes of each edge that has its source in the text: node, coord of the edge, out (the edge leaves the node), border (no such edge before, or after)."""
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            data, off = text_buffers(b.column("text"))
            start, end, first = words_of(data, off)
            word = word_hashes(data, start, end)
            lists, base = b.column("at"), b.column("base").to_numpy()
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = lists.flatten().to_numpy()
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            apart = np.ones(len(at) + 1, bool)
            apart[1:-1] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            pos, coord = first[doc] + at, base[doc] + at
            into, out = span_hash(word, pos + 1, pos + k, 1), span_hash(word, pos, pos + k - 1, 1)
            cols = [np.r_[out, into].view(np.int64), np.r_[coord, coord], np.r_[base[doc], base[doc]], np.arange(2 * len(at)) < len(at), np.r_[apart[:-1], apart[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["node", "coord", "base", "out", "border"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of occurrences, sorted by coord, that follow their source."""
    for b in batches:
        if not b.num_rows:
            continue
        coord, base, c, cb = (b.column(n).to_numpy() for n in ("coord", "base", "c", "cb"))
        new = np.ones(len(coord), bool)
        step = coord[1:] - coord[:-1]
        new[1:] = ~((base[1:] == base[:-1]) & (cb[1:] == cb[:-1]) & (step == c[1:] - c[:-1]) & (step <= 1))
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(coord)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (base[at], coord[at] - base[at], coord[last] - coord[at] + 1, cb[at], c[at] - cb[at])], ["base", "start", "n", "cb", "cstart"])


def _span_sha(words: list[bytes], start: int, n: int, k: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start : start + n + k - 1])).digest()


def _sources(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple[int, int, int, bytes]] = []
        for base, text, asked in zip(b.column("base").to_pylist(), b.column("text"), b.column("asked").to_pylist(), strict=True):
            words = text.as_py().encode().split()
            out += [(base, a["cstart"], a["n"], _span_sha(words, a["cstart"], a["n"], k)) for a in asked]
        yield pa.RecordBatch.from_pylist([dict(zip(("cb", "cstart", "n", "digest"), x, strict=True)) for x in out], pa.schema([("cb", pa.int64()), ("cstart", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))


def _cut(batches: Iterator[pa.RecordBatch], k: int, text_out: bool) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its spans; `other`: the windows of spans whose words are not their source's, which stay."""
    for b in batches:
        n_removed, sha, kept_text, other = [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            words = text.as_py().encode().split()
            gone = bytearray(len(words))
            other.append([])
            for s in spans:
                if _span_sha(words, s["start"], s["n"], k) != s["digest"]:
                    other[-1] += range(s["start"], s["start"] + s["n"])
                    continue
                size = s["n"] + k - 1
                gone[s["start"] : s["start"] + size] = b"\1" * size
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
            n_removed.append(sum(gone))
            sha.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode())
        cols, names = [b.column("base"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(other, pa.list_(pa.int64()))], ["base", "n_removed", "kept_sha256", "other"]
        if text_out:
            cols, names = [*cols, pa.array(kept_text, pa.string())], [*names, "kept_text"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _windows_at(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """base, start, hash of the windows at the places `at` of each text (of all, without such a column), and the SHA-256 of their words."""
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            edge, pos, doc, _, _, first = windows(b, k)
            if "at" in b.schema.names:
                asked = b.column("at")
                of = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
                keep = np.isin(pos, first[of] + asked.flatten().to_numpy())
                edge, pos, doc = edge[keep], pos[keep], doc[keep]
            words = [w for t in b.column("text").to_pylist() for w in (t or "").encode().split()]
            digest = [hashlib.sha256(b" ".join(words[p : p + k])).digest() for p in pos.tolist()]
            base = b.column("base").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(base), pa.array(pos - first[doc]), pa.array((edge >> U(64 - bits)).view(np.int64)), pa.array(digest, pa.binary())], ["base", "start", "edge", "digest"])


# ---------------------------------------------------------------- Spark

def numbered(reps: DataFrame) -> DataFrame:
    """reps(row, did, sha, n_words) with base: the number of words before the document, in doc_id order (null last)."""
    key = [F.col("did").isNull(), F.col("did"), F.col("row"), F.col("sha")]
    n = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = materialize(reps.repartitionByRange(n, *key).withColumn("_p", F.spark_partition_id()), "part")
    sums = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.sum("n_words").alias("n")).collect()}  # one row per partition
    before, low = [], 0
    for p in sorted(sums):
        before.append((p, low))
        low += sums[p]
    spark = reps.sparkSession
    first = spark.createDataFrame(before, "_p int, _low long")
    upto = F.sum("n_words").over(W.partitionBy("_p").orderBy(*key))
    return part.withColumn("_upto", upto).join(first, "_p").select("row", "did", "sha", "n_words", (F.col("_low") + F.col("_upto") - F.col("n_words")).alias("base"))


def _classes(measured: DataFrame) -> DataFrame:
    """(sha, did, row): each word sequence's smallest doc_id (nulls last) and the row that stands for it."""
    low = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row"))
    return measured.groupBy("sha").agg(low.alias("m"), F.min("n_words").alias("n_words")).select("sha", F.col("m.doc_id").alias("did"), F.col("m.row").alias("row"), "n_words")


def _candidates(base: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """(row, did, base, grams) of documents that share a minimizer with another text."""
    found = arrow_map(base, partial(_minimizers, k=k), "gram long, row long, class long")
    twice = found.groupBy("gram").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("gram")
    twice = materialize(twice, "twice")  # as a table, so that the join below can split a gram that very many texts have
    by = found.select("gram", "row").join(twice, "gram").groupBy("row").agg(F.collect_list("gram").alias("grams"))
    return materialize(by.join(order.select("row", "did", "base"), "row"), "candidates")


def _edge_table(pending: DataFrame, k: int, bits: int) -> DataFrame:
    return arrow_map(pending.select("text", "base", "grams"), partial(_edges, k=k, bits=bits), "edge long, coord long, base long")


def _repeated(pending: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """(edge, c, cb): the graph's edges, windows that two documents or more have, with their first place."""
    source = _edge_table(pending, k, bits).groupBy("edge").agg(F.min("coord").alias("c"), F.min("base").alias("cb"), F.max("base").alias("mb")).where("mb > cb").select("edge", "c", "cb")
    return materialize(source, "source")  # as a table, so that the join can split a hot edge


def linked_segments(nodes: DataFrame) -> DataFrame:
    """nodes(node, coord, base, out, border) -> (coord, n, base, unitig, offset): segments of n edges and their place in a nonbranching path.

    A path that returns to its beginning has no first segment; its segments stay apart.
    """
    branch = nodes.groupBy("node").agg(F.count_if("out").alias("o"), F.count_if(~F.col("out")).alias("i")).where("o > 1 or i > 1").select("node")
    branch = materialize(branch, "branch")
    begins = nodes.where("out and border").select("base", "coord").union(nodes.where("out and not border").join(branch, "node").select("base", "coord"))
    stops = nodes.where("not out and border").select("base", (F.col("coord") + 1).alias("coord"))
    bounds = begins.withColumn("begins", F.lit(True)).union(stops.withColumn("begins", F.lit(False)))
    segment = bounds.withColumn("n", F.lead("coord").over(W.partitionBy("base").orderBy("coord")) - F.col("coord")).where("begins").select("base", "coord", "n")
    segment = materialize(segment, "segments")

    heads = nodes.where("out and border").select("node", F.col("coord").alias("seg"))
    tails = nodes.where("not out and border").select("node", F.col("coord").alias("last"))
    link = tails.join(heads, "node").join(branch, "node", "left_anti")
    link = link.join(segment.select((F.col("coord") + F.col("n") - 1).alias("last"), F.col("coord").alias("to"), F.col("n").alias("dist")), "last")
    jump = materialize(link.select("seg", "to", "dist"), "jump")
    waiting = None
    while True:  # every round doubles the jumps; only cycles never get to a first segment
        then = jump.select(F.col("seg").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"))
        both = jump.join(then, "to", "left")
        left = both.where("_to is not null").count()
        if left == 0 or left == waiting:
            ended = both.where("_to is null").select("seg", "to", "dist")
            break
        waiting = left
        jump = materialize(both.select("seg", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist")), "jump")
    out = segment.join(ended.withColumnRenamed("seg", "coord"), "coord", "left")
    return out.select("coord", "n", "base", F.coalesce("to", "coord").alias("unitig"), F.coalesce("dist", F.lit(0)).alias("offset"))


def _segments(pending: DataFrame, source: DataFrame, k: int) -> DataFrame:
    at = source.groupBy(F.col("cb").alias("base")).agg(F.collect_list(F.col("c") - F.col("cb")).alias("at"))
    texts = pending.select("text", "base").dropDuplicates(["base"])
    nodes = arrow_map(texts.join(at, "base").select("text", "base", "at"), partial(_nodes, k=k), "node long, coord long, base long, out boolean, border boolean")
    return materialize(linked_segments(materialize(nodes, "nodes")), "unitigs")


#: Coordinates are joined by ranges of so many words.
RANGE = 1024


def _compact(pending: DataFrame, source: DataFrame, segments: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """(base, start, n, cb, cstart, unitig, offset): n windows from word `start` of a document repeat those from `cstart` of an earlier one, in one segment."""
    later = _edge_table(pending, k, bits).join(source, "edge").where("base > cb").select("coord", "base", "c", "cb")
    paths = arrow_map(later.repartition("base").sortWithinPartitions("coord"), _paths, "base long, start long, n long, cb long, cstart long").distinct()
    paths = materialize(paths, "paths").withColumn("c", F.col("cb") + F.col("cstart"))
    ranges = lambda low, n: F.explode(F.sequence(F.floor(low / RANGE), F.floor((low + n - 1) / RANGE)))
    a = paths.select("*", ranges(F.col("c"), F.col("n")).alias("_r"))
    b = segments.select(F.col("coord").alias("_c"), F.col("n").alias("_n"), "unitig", "offset", ranges(F.col("coord"), F.col("n")).alias("_r"))
    low, high = F.greatest("c", "_c"), F.least(F.col("c") + F.col("n"), F.col("_c") + F.col("_n"))
    met = a.join(b, "_r").where((low < high) & (F.col("_r") == F.floor(low / RANGE)))  # a pair meets in the range of its first common word only
    cut = met.select("base", (F.col("start") + low - F.col("c")).alias("start"), (high - low).alias("n"), "cb", (low - F.col("cb")).alias("cstart"), "unitig", (F.col("offset") + low - F.col("_c")).alias("offset"))
    return materialize(cut, "spans")


def _exact(texts: DataFrame, cut: DataFrame, k: int, bits: int) -> DataFrame:
    """(base, start, n, digest) of the windows in doubt that do repeat an earlier document's words.

    In doubt are all windows of all documents that share a hash with a window that was not its source's.
    """
    seen = texts.join(cut.where(F.size("other") > 0).select("base", F.col("other").alias("at")), "base").select("text", "base", "at")
    kind = "base long, start long, edge long, digest binary"
    doubt = materialize(arrow_map(seen, partial(_windows_at, k=k, bits=bits), kind).select("edge").distinct(), "doubt")
    all_ = arrow_map(texts.select("text", "base"), partial(_windows_at, k=k, bits=bits), kind).join(doubt, "edge", "left_semi")
    all_ = materialize(all_.select("base", "start", "digest"), "doubtful")
    first = all_.groupBy("digest").agg(F.min("base").alias("cb"))
    return all_.join(first, "digest").where("base > cb").select("base", "start", F.lit(1).cast("long").alias("n"), "digest")


def _checked(pending: DataFrame, spans: DataFrame, k: int, text_out: bool, bits: int) -> DataFrame:
    """(base, n_removed, kept_sha256[, kept_text]) of the documents that lose words."""
    asked = materialize(spans.select("cb", "cstart", "n").distinct(), "asked")
    many = asked.groupBy("cb").agg((F.lit(1) + F.floor(F.count("*") / 1000)).alias("parts")).where("parts > 1")
    asked = asked.join(materialize(many, "many"), "cb", "left").withColumn("part", F.pmod(F.xxhash64("cstart", "n"), F.coalesce("parts", F.lit(1))))
    asked = materialize(asked.select("cb", "part", "cstart", "n"), "asked")  # as a table, so that the join can split a source with very many spans
    asked = asked.groupBy("cb", "part").agg(F.collect_list(F.struct("cstart", "n")).alias("asked"))
    texts = pending.select("base", "text").dropDuplicates(["base"])
    source = arrow_map(asked.join(texts, F.col("cb") == F.col("base")).select("base", "text", "asked"), partial(_sources, k=k), "cb long, cstart long, n long, digest binary")
    kind = "base long, n_removed long, kept_sha256 string, other array<long>" + (", kept_text string" if text_out else "")

    def cut(told: DataFrame) -> DataFrame:
        by = told.groupBy("base").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
        return materialize(arrow_map(texts.join(by, "base").select("base", "text", "spans"), partial(_cut, k=k, text_out=text_out), kind), "cut")

    told = materialize(spans.join(source, ["cb", "cstart", "n"]).select("base", "start", "n", "digest"), "told")
    out = cut(told)
    if out.where(F.size("other") > 0).limit(1).count():
        out = cut(told.union(_exact(texts, out, k, bits)))
    return out.drop("other")


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, start, n_words, source_doc_id, source_start, unitig, offset): the stretches of documents that earlier documents have, as nonbranching paths give them.

    start counts words from 0; n_words is k or more. Copies of a whole text are told of the first one only.
    Nulls and repeated rows are as in repeated_passages; hashes are not checked here.
    """
    _, _, order, pending = _prepared(docs, k)
    source = _repeated(pending, k)
    spans = _compact(pending, source, _segments(pending, source, k), k)
    ids = order.select("did", "base")
    out = spans.join(ids.withColumnRenamed("did", "doc_id"), "base").join(ids.select(F.col("did").alias("source_doc_id"), F.col("base").alias("cb")), "cb")
    return out.select("doc_id", "start", (F.col("n") + k - 1).alias("n_words"), "source_doc_id", F.col("cstart").alias("source_start"), "unitig", "offset")


def _prepared(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    measured = materialize(arrow_map(base, _measure, "doc_id long, row long, n_words long, sha string"), "measured")
    classes = materialize(_classes(measured), "classes")
    order = materialize(numbered(classes.where(F.col("n_words") >= k).select("row", "did", "sha", "n_words")), "order")
    candidates = _candidates(base, order, k)
    same = (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("did"))  # a row hash alone is not an identity
    pending = materialize(base.join(candidates.withColumnRenamed("row", "_row"), same).select("text", "base", "grams"), "pending")
    return measured, classes, order, pending


def repeated_passages(docs: DataFrame, k: int = 13, text_out: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, row (hash of doc_id and text), n_words, n_removed, kept_sha256[, kept_text where words went]; a row per input row.

    A word goes if a window of k words covers it that also starts in a document with a smaller
    doc_id. Null text has no words. A null doc_id counts as larger than all others. Rows that repeat
    one doc_id with equal words are one document; with different words, the one with the smaller
    hash counts as the earlier. Texts under k words lose nothing. Other columns are ignored.
    Windows whose hash (of `bits` bits) belongs to other words too are told apart by the words.
    """
    measured, classes, order, pending = _prepared(docs, k)
    source = _repeated(pending, k, bits)
    spans = _compact(pending, source, _segments(pending, source, k), k, bits)
    cut = _checked(pending, spans, k, text_out, bits).join(order.select("base", "sha"), "base").drop("base")
    told = materialize(classes.select("sha", "did").join(cut, "sha", "left"), "told")
    out = measured.join(told, "sha")  # the only join that a text of very many copies meets, so that it can be split
    copy = (F.col("n_words") >= k) & F.coalesce(F.col("doc_id") > F.col("did"), F.col("doc_id").isNull() & F.col("did").isNotNull())
    more = [F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if text_out else []
    return out.select(
        "doc_id", "row", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *more,
    )


def without_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """docs without repeated passages: kept words joined by one space where any went; documents that lost all words go.

    n_chars, if docs has it, follows. Other columns are passed on, whatever their names.
    """
    own, name = own_names(docs)
    found = repeated_passages(own.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text")), k, text_out=True)
    found = found.where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "n_words", "n_removed", "kept_text").dropDuplicates(["_id", "_row"])
    doc_id, old = F.col(name["doc_id"]).cast("long"), F.col(name["text"]).cast("string")
    out = own.join(found, (F.xxhash64(doc_id, old) == F.col("_row")) & doc_id.eqNullSafe(F.col("_id")), "left")
    out = out.where(F.col("n_removed").isNull() | (F.col("n_removed") < F.col("n_words")))
    new = {"text": F.coalesce("kept_text", old)}
    if "n_chars" in name:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col(name["n_chars"])).otherwise(F.length("kept_text").cast("long"))
    return out.select(*[new.get(c, F.col(n)).alias(c) for c, n in name.items()])


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, (SELECT unnest(range(13)) AS j)),
kept AS (SELECT d.doc_id, d.w, d.i FROM (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)) d
         LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
