"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter cell holds a bit for each language. An n-gram's cells, combined by AND, give all languages
that contain it in one lookup. A text's n-grams are counted by language, the counts are corrected for
each slice's rate of false positives, and the language with the largest share is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.util import U, arrow_map, mix, slices

SIZES = (2, 3, 4)
BLANK = 32
#: Bytes of text that are counted at once.
SLICE = 1 << 19
#: How far below the lowest hundredth of its language's documents a text's share of known n-grams may lie, and by how many standard deviations of the share more.
MARGIN, SLACK = 0.1, 3.0


@lru_cache(1)
def letters() -> np.ndarray:
    """Of each code point: itself if it is a letter (0 stays, as the mark between texts), else a blank."""
    code = np.arange(0x110000, dtype=np.uint32)
    code[~np.strings.isalpha(code.view("U1"))] = BLANK
    code[0] = 0
    return code


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per n: hashes and text indices of all n-grams of letters and blanks (no double blanks); and which texts have a letter."""
    joined = "\0".join(f" {(t or '').replace(chr(0), ' ')} " for t in texts).lower()
    code = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    twice = np.zeros(len(code), bool)
    twice[1:] = (code[1:] == BLANK) & (code[:-1] == BLANK)
    code = code[~twice].astype(U)
    text = np.cumsum(code == 0)
    has = np.bincount(text[code > BLANK], minlength=len(texts))[: len(texts)] > 0
    hashes, owners = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            hashes.append(np.zeros(0, U)), owners.append(np.zeros(0, np.int64))
            continue
        h, ok = np.full(m, n, U), np.ones(m, bool)
        for j in range(n):
            c = code[j : j + m]
            h = h * U(0x100000001B3) + c
            ok &= c > 0
        hashes.append(mix(h[ok])), owners.append(text[:m][ok])
    return hashes, owners, has


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, most=SLICE):
            hashes, owners, _ = ngrams(b.column("text").to_pylist())
            cut = [np.searchsorted(o, np.arange(b.num_rows + 1)) for o in owners]
            of: dict[str, list[np.ndarray]] = {}
            for i, one in enumerate(b.column("lang").to_pylist()):
                own = np.concatenate([h[c[i] : c[i + 1]] for h, c in zip(hashes, cut, strict=True)])
                of.setdefault(one, []).append(np.unique(own))
            for one, grams in of.items():
                gram, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & U((1 << bits) - 1)).astype(np.int64), (h >> U(64 - bits)).astype(np.int64)


class Filters:
    """names: the languages; masks: the filter, a bit per language in each cell, for each 64 languages; rate: each slice's share of false positives.

    limit: per language, the least share of n-grams known to any language that its documents have (0: no limit).
    """

    def __init__(self, names: list[str], masks: list[np.ndarray], bits: int, limit: np.ndarray | None = None):
        self.names, self.masks, self.bits = names, masks, bits
        self.limit = np.zeros(len(names)) if limit is None else limit
        one, other = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << bits, (2, 1 << 20))
        hit = np.zeros(len(one), bool)
        for mask in masks:
            hit |= (mask[one] & mask[other]) != 0
        self.any_rate = min(float(np.mean(hit)), 0.999)
        self.rate = np.array([float(np.mean(self.of(masks[k // 64], k))) ** 2 for k in range(len(names))])

    @staticmethod
    def of(mask: np.ndarray, k: int) -> np.ndarray:
        return (mask >> mask.dtype.type(k % 64) & mask.dtype.type(1)).astype(bool)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: its n-grams; those of each language; the share known to any language, false positives taken out; whether it has a letter."""
        hashes, owners, has = ngrams(texts)
        n, count, known = np.zeros(len(texts)), np.zeros((len(self.names), len(texts))), np.zeros(len(texts))
        for h, o in zip(hashes, owners, strict=True):
            a, b = cells(h, self.bits)
            n += np.bincount(o, minlength=len(texts))[: len(texts)]
            some = np.zeros(len(o), bool)
            for word, mask in enumerate(self.masks):
                both = mask[a] & mask[b]
                some |= both != 0
                for k in range(64 * word, min(64 * word + 64, len(self.names))):
                    count[k] += np.bincount(o[self.of(both, k)], minlength=len(texts))[: len(texts)]
            known += np.bincount(o[some], minlength=len(texts))[: len(texts)]
        return n, count, np.maximum(known / np.maximum(n, 1) - self.any_rate, 0) / (1 - self.any_rate), has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        n, count, known, has = self.counts(texts)
        true = np.maximum(count - n * self.rate[:, None], 0) / (1 - self.rate)[:, None]
        total = true.sum(0)
        best = true.argmax(0)
        share = np.where(total > 0, true.max(0) / np.where(total > 0, total, 1), 1 / len(self.names))
        limit = self.limit[best]
        has = has & (known >= limit - SLACK * np.sqrt(limit * (1 - limit) / np.maximum(n, 1)))
        return [self.names[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, share, 0.0)


def train(labelled: DataFrame, least_share: float = 0.004, beside: float = 0.2, bits: int = 20) -> Filters:
    """Filters from all of labelled(text, lang), lang not null.

    An n-gram belongs to a language if `least_share` of its documents have it (two at least), and if
    that share is `beside` times the largest share in any language. The filters take 2^bits / 8 bytes for each
    language; every 64 languages have a table of their own. Without labelled rows there is no language, and every text is `und`.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    names = sorted(counts, key=lambda x: (-counts[x], x))
    if not names:
        return Filters([], [], bits)
    df = arrow_map(labelled.select("text", "lang"), _documents_with, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    of = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(counts[n]))]), F.col("lang"))
    bit = F.element_at(F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]), F.col("lang"))
    df = df.select("gram", (F.col("n") / of).alias("share"), bit.alias("bit"), "n")
    df = df.where((F.col("share") >= least_share) & (F.col("n") >= F.when(of_small(counts), 1).otherwise(2)))
    by = df.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("share", "bit")).alias("each"))
    kept = by.select("gram", F.explode("each").alias("e"), "top").where(F.col("e.share") >= F.col("top") * beside)
    low = F.col("gram").bitwiseAND((1 << bits) - 1)
    high = F.shiftrightunsigned("gram", 64 - bits)
    cell = kept.select(F.explode(F.array(low, high)).alias("cell"), F.floor(F.col("e.bit") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("e.bit") % 64).cast("int")).alias("bit"))
    rows = cell.groupBy("cell", "word").agg(F.bit_or("bit").alias("mask")).toArrow()  # 2^bits rows at most for each 64 languages
    table = np.zeros((-(-len(names) // 64), 1 << bits), np.int64)
    table[rows.column("word").to_numpy(), rows.column("cell").to_numpy()] = rows.column("mask").to_numpy()
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(64, len(names)) <= np.dtype(t).itemsize * 8)
    return Filters(names, [mask.view(np.uint64).astype(width) for mask in table], bits)


def of_small(counts: dict[str, int]):
    """Whether there are too few documents to ask for an n-gram twice."""
    return F.lit(min(counts.values()) < 20)


def _predict(batches: Iterator[pa.RecordBatch], model, text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, most=SLICE):
            lang, score = model.value.predict(b.column("text").to_pylist())
            names = [n for n in b.schema.names if text or n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep (with or without the text), lang_pred, score of every row: `und` and 0 where the text is null, has no letter or is under the model's limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits cells of 1 to 8 bytes
    rest = [c for c in keep if c != "text"]
    few = docs.select(*rest, F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema if f.name in keep)
    return arrow_map(few, partial(_predict, model=shared, text="text" in keep), f"{kind}, lang_pred string, score double")


def remainder(doc_id: str = "doc_id", n: int = 4):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def trained_on(docs: DataFrame, **options) -> Filters:
    """Filters learnt from all documents outside the held-out fold."""
    return train(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 2)).select("text", "lang"), **options)


def _known(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, most=SLICE):
            _, _, known, has = model.value.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(known)], ["lang", "known"]).filter(pa.array(has))


def with_limit(docs: DataFrame) -> Filters:
    """Filters that also tell texts in no learned language.

    Two of the training folds teach the n-grams. On the third, the limit is set for each language:
    the share of known n-grams that all but the lowest hundredth of its documents reach, less MARGIN.
    All documents of these folds are used. A language without documents in the third has no limit.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    model = train(labelled.where(~remainder().isin(2, 3)))
    own = labelled.where((remainder() == 3) & F.col("lang").isin(model.names))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    low = arrow_map(own.select("text", "lang"), partial(_known, model=shared), "lang string, known double").groupBy("lang").agg(F.percentile_approx("known", 0.01, 10000).alias("low")).collect()
    least = {r["lang"]: max(r["low"] - MARGIN, 0.0) for r in low}
    return Filters(model.names, model.masks, model.bits, np.array([least.get(n, 0.0) for n in model.names]))


def with_language(docs: DataFrame, model: Filters) -> DataFrame:
    """docs without those whose language can't be told (no letters, or too few known n-grams for the model's limit); columns unchanged.

    A model without languages (nothing was labelled) can't tell any: then only texts without letters go.
    """
    if not model.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"_{i}" if c != "text" else c for i, c in enumerate(docs.columns)}  # no clash with the results' names
    out = predict(docs.select(*[F.col(c).alias(n) for c, n in own.items()]), model, tuple(own.values()))
    return out.where("lang_pred <> 'und'").select(*[F.col(n).alias(c) for c, n in own.items()])


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, trained_on(docs))
    return out.select("doc_id", (remainder() == 2).alias("held_out"), "lang_pred", "score")
