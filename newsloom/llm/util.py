"""Shared pieces of the training-data operators: tables in the shared folder, Arrow text access, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsloom.functions.shared import settle as materialize
from newsloom.functions.shared import remove, shared_dir, workspace
from newsloom.functions.shared import ship_package as ship

__all__ = ["materialize", "remove", "shared_dir", "ship", "workspace"]

U = np.uint64
#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with names that no operator uses, and these names by column: an operator's own columns never clash with a caller's."""
    name = {c: f"_own{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*name.values()), name


# ---------------------------------------------------------------- Arrow text

def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have length zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    big = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if len(col) == 0:
        off = np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None and len(col) else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each (one row at least), so that memory is bounded."""
    if batch.num_rows == 0:
        return
    _, off = text_buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


# ---------------------------------------------------------------- word hashes

_RND = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, (3, 256), np.int64).astype(U) * U(2) + U(1)
_BASE = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_INV = tuple(U(pow(int(b), -1, 2**64)) for b in _BASE)
_POW: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, inverse: bool, n: int) -> np.ndarray:
    have = _POW.get((base, inverse))
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), (_INV if inverse else _BASE)[base], U)
        a[0] = 1
        have = _POW[(base, inverse)] = np.cumprod(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end], all at once (arithmetic modulo 2^64)."""
    acc = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, True, len(values)), out=acc[1:])
    return mix((acc[end] - acc[start]) * powers(base, False, len(values) + 1)[start] + (end - start).astype(U))


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of each word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(_RND[0][data], start, end)


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position in words, text index) of every run of k words inside one text."""
    n = len(words)
    if n < k:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pos = np.arange(n - k + 1)
    pos = pos[doc[pos] == doc[pos + k - 1]]
    return span_hash(words, pos, pos + k, 1), pos, doc[pos]


# ---------------------------------------------------------------- Arrow batches

#: Rows in an Arrow batch: the default of 10,000 whole texts does not fit next to a small executor's heap.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    name, default, ours = BATCH_ROWS
    if spark.conf.get(name) == default:
        spark.conf.set(name, ours)
    return df.mapInArrow(fn, schema)
