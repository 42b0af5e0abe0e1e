"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with a known feature (words, whole and by their first
bytes) gets a logistic score p; one without has p = 0, so text without any sign of toxicity adds nothing,
however long it is. The document's score is the noisy-or of its sentences and of a leak, which stands for what
no sentence tells: 1 - (1 - leak) * prod(1 - p). Only documents have labels; the likelihood of the
noisy-or trains the sentence scores and the leak, and the sentence scores then point at the offending
sentences. When texts are scored, sentences below `LEAST` do not add up: of those only the likeliest
counts, or ten thousand faint signs in a long text would weigh as much as an insult.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.util import _RND, U, arrow_map, slices, span_hash, table, text_buffers

PREFIXES = (4, 5, 6)
#: Sentences at this score or more are combined.
LEAST = 0.2
#: Bytes of words: letters and digits in small letters, and all bytes of other characters; 0 separates.
BYTE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
#: The small letter of every character of two bytes in UTF-8 (Latin, Greek, Cyrillic), if it has one of two bytes.
SMALL = np.arange(0x800)
SMALL[0x80:] = [ord(c.lower()) if len(c.lower()) == 1 and 0x80 <= ord(c.lower()) < 0x800 else ord(c) for c in map(chr, range(0x80, 0x800))]
ENDS = np.zeros(256, bool)
ENDS[[*b".!?\n"]] = True


def small(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in small letters, each character with as many bytes as before."""
    low = BYTE[data]
    lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
    code = SMALL[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
    return low


def features(b: pa.RecordBatch):
    """(hashes, sentence of each) of every word feature; per sentence its text, start and end byte in that text (sentences without words too)."""
    data, off = text_buffers(b.column("text"))
    n = len(data)
    low = small(data)
    cut = np.zeros(n + 1, bool)
    cut[1:] = ENDS[data]
    cut[off] = True
    bound = np.flatnonzero(cut)
    bound = bound[bound < n]
    text = np.searchsorted(off, bound, "right") - 1
    ends = np.minimum(np.r_[bound[1:], n], off[text + 1])
    word = low > 0
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | cut[:n]))
    end = np.flatnonzero(word & (~after | cut[1:])) + 1
    values = _RND[2][low]
    hashes, owner = [span_hash(values, start, end)] if n else [], [np.searchsorted(bound, start, "right") - 1] if n else []
    for k in PREFIXES:
        long = end - start > k
        s = start[long]
        if n:
            hashes.append(span_hash(values, s, s + k) ^ U(k))
            owner.append(owner[0][long])
    return (np.concatenate(hashes), np.concatenate(owner)) if n else (np.zeros(0, U), np.zeros(0, np.int64)), (text, bound - off[text], ends - off[text])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature, the number of toxic and of clean documents that have it, and both totals in the row of feature 0."""
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            toxic = b.column("toxic").to_numpy().astype(bool)
            (h, s), (text, _, _) = features(b)
            pair = np.unique(np.rec.fromarrays([h, text[s]], names="h,d"))
            one, inv = np.unique(pair["h"], return_inverse=True)
            bad = np.bincount(inv, weights=toxic[pair["d"]], minlength=len(one)).astype(np.int64)
            all_ = np.bincount(inv, minlength=len(one)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[one.view(np.int64), 0]), pa.array(np.r_[bad, toxic.sum()]), pa.array(np.r_[all_ - bad, (~toxic).sum()])], ["h", "bad", "good"])


class Model:
    """Sorted feature hashes, their weights, the bias of a sentence with features, and the leak of a document (as a logit)."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, bias: float, leak: float):
        self.vocabulary, self.weights, self.bias, self.leak = vocabulary, weights, bias, leak

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are known, their numbers)."""
        if not len(self.vocabulary):
            z = np.zeros(0, np.int64)
            return z, z
        if not hasattr(self, "_slot"):
            slot = np.zeros(1 << 20, bool)
            slot[(self.vocabulary >> U(44)).astype(np.int64)] = True
            self._slot = slot
        maybe = np.flatnonzero(self._slot[(h >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == h[maybe]
        return maybe[ok], at[ok]

    def sentences(self, h: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """log(1 - p) of each of n sentences, 0 without known features; a feature counts once in a sentence."""
        hit, at = self.lookup(h)
        pair = np.unique(np.stack([s[hit], at]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
        z = self.bias + np.bincount(pair[0], weights=self.weights[pair[1]], minlength=n)
        return np.where(np.bincount(pair[0], minlength=n) > 0, -np.logaddexp(0, z), 0.0)

    def documents(self, clean: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from log(1 - p) of their sentences: the noisy-or of the leak, the sentences at LEAST or more, and the likeliest one."""
        first = np.zeros(n)
        np.minimum.at(first, text, clean)
        strong = np.where(clean <= np.log1p(-LEAST), clean, 0.0)
        some = np.bincount(text, weights=strong, minlength=n)
        score = -np.expm1(np.minimum(some, first) - np.logaddexp(0, self.leak))
        return np.where(np.bincount(text, minlength=n) > 0, np.clip(score, 0.0, 1.0), 0.0)


def _bags(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document its label, and (sentence, feature number) of every known feature."""
    model = Model(vocabulary, np.zeros(len(vocabulary)), 0.0, 0.0)
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            (h, s), (text, _, _) = features(b)
            hit, at = model.lookup(h)
            first = np.searchsorted(text, np.arange(b.num_rows))
            d = text[s[hit]]
            order = np.lexsort((at, s[hit], d))
            d, sent, at = d[order], (s[hit] - first[d])[order], at[order]
            cut = np.searchsorted(d, np.arange(b.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for x in (sent, at)]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), *lists], ["toxic", "sentence", "feature"])


def fit(bags: pa.Table, size: int, steps: int = 400, rate: float = 0.1, ridge: float = 0.002) -> tuple[np.ndarray, float, float]:
    """(weights, bias, leak) by Adam on the noisy-or's likelihood; classes have equal weight in total up to a factor of 3."""
    y = bags.column("toxic").to_numpy().astype(float)
    lists = [bags.column(c).combine_chunks() for c in ("sentence", "feature")]
    length = lists[0].value_lengths().to_numpy()
    doc = np.repeat(np.arange(len(y)), length)
    sent, feat = (x.flatten().to_numpy() for x in lists)
    triple = np.unique(np.stack([doc, sent, feat]), axis=1)
    doc, sent, feat = triple
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(sent) != 0)] if len(doc) else np.zeros(0, bool)
    inst = np.cumsum(new) - 1
    owner = doc[new]
    m = len(owner)
    bad = max(y.mean(), 1e-6)
    weight = np.where(y > 0, min(3.0, (1 - bad) / bad), 1.0) / len(y)
    w, b, leak = np.full(size, 0.5), -6.0, -6.0
    g1, g2 = np.zeros(size + 2), np.zeros(size + 2)
    for t in range(1, steps + 1):
        likelihood, grad = slope(w, b, leak, inst, feat, owner, y, weight)
        grad[:size] -= ridge * w / max(size, 1)
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad * grad
        move = rate * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-9)
        w, b, leak = np.clip(w + move[:-2], -3, 12), float(np.clip(b + move[-2], -14, -3)), float(np.clip(leak + move[-1], -14, -3))
    return w, b, leak


def slope(w, b, leak, inst, feat, owner, y, weight) -> tuple[float, np.ndarray]:
    """The weighted log-likelihood of the labels y and its gradient by weights, bias and leak.

    inst and feat list the features of each sentence, owner the document of each sentence.
    """
    size, m = len(w), len(owner)
    z = b + np.bincount(inst, weights=w[feat], minlength=m)
    p, p0 = 1 / (1 + np.exp(-np.clip(z, -40, 40))), 1 / (1 + np.exp(-leak))
    clean = np.bincount(owner, weights=-np.logaddexp(0, z), minlength=len(y)) - np.logaddexp(0, leak)
    bag = -np.expm1(np.minimum(clean, -1e-9))
    pull = weight * np.where(y > 0, (1 - bag) / np.maximum(bag, 1e-9), -1.0)
    gz = pull[owner] * p
    likelihood = (weight * np.where(y > 0, np.log(np.maximum(bag, 1e-300)), clean)).sum()
    return float(likelihood), np.r_[np.bincount(feat, weights=gz[inst], minlength=size), gz.sum(), pull.sum() * p0]


def train(docs: DataFrame, labels: DataFrame, most_documents: int = 20_000, most_features: int = 4096, lift: float = 6.0, chance: float = 1.0) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), one label per doc_id.

    At most about `most_documents` documents are used, those with the lowest hashed ids. Of the word
    features that are `lift` times as frequent in toxic documents, and more often than chance explains for any of so
    many features, the `most_features` that tell most are kept.
    """
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = F.broadcast(labels.where(part < min(1.0, most_documents / max(n, 1))))  # about most_documents rows of two numbers
    some = docs.where(F.col("text").isNotNull()).join(few, "doc_id").select(F.col("text").cast("string"), F.col("toxic").cast("int"))
    counts = arrow_map(some, _counts, "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.where("h = 0").first()
    if total is None or not total["bad"] or not total["good"]:
        return Model(np.zeros(0, U), np.zeros(0), -6.0, -6.0)
    a, c = (F.col("bad") + 0.5) / (total["bad"] + 1), (F.col("good") + 0.5) / (total["good"] + 1)
    lifted = counts.where((F.col("h") != 0) & (F.col("bad") >= 3))
    most = max(lifted.count(), 1)
    q, n = total["bad"] / (total["bad"] + total["good"]), F.col("bad") + F.col("good")
    part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * share))).otherwise(0.0)
    # Chernoff's bound: by chance alone, at most about `chance` features would get in.
    kept = lifted.where((a >= lift * c) & (part("bad", q) + part("good", 1 - q) >= math.log(most / chance))).orderBy(F.desc(F.col("bad") * F.log(a / c)), "h").limit(most_features)
    vocabulary = np.sort(np.array([r["h"] for r in kept.select("h").collect()], np.int64).view(U))
    bags = arrow_map(some, partial(_bags, vocabulary=vocabulary), "toxic int, sentence array<int>, feature array<int>").toArrow()
    return Model(vocabulary, *fit(bags, len(vocabulary)))


def _score(batches: Iterator[pa.RecordBatch], model, locate: float | None) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for b in slices(batch, most=1 << 20):
            (h, s), (text, start, end) = features(b)
            clean = m.sentences(h, s, len(text))
            score = m.documents(clean, text, b.num_rows)
            names = [n for n in b.schema.names if n != "text"]
            cols = [*[b.column(n) for n in names], pa.array(score)]
            if locate is not None:
                p = -np.expm1(clean)
                hit = np.flatnonzero(p >= locate)
                cut = np.searchsorted(text[hit], np.arange(b.num_rows + 1))
                part = pa.StructArray.from_arrays([pa.array(start[hit].astype(np.int32)), pa.array(end[hit].astype(np.int32)), pa.array(p[hit])], ["start", "end", "score"])
                cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), part))
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", *(["offending"] if locate is not None else [])])


def toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), locate: float | None = 0.5) -> DataFrame:
    """keep, score, offending: byte bounds (in UTF-8) and scores of the sentences at `locate` or more.

    Null and empty texts have no sentence and score 0; texts without known features score the leak. One row per input row; whole texts are scored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_features weights
    few = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema if f.name != "text") + ", score double"
    kind += ", offending array<struct<start:int,end:int,score:double>>" if locate is not None else ""
    return arrow_map(few, partial(_score, model=shared, locate=locate), kind)


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training folds; null labels and ids are left out, toxic wins where an id has two labels."""
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    out = toxicity(docs, model, locate=None)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
