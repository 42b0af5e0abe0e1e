import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from newsloom.llm import pack
from pyspark.sql import functions as F
from tests_llm import DATA, docs
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(spark):
    t = Tokenizer.from_file(PATH)
    texts = ["", "Hello, World!", "it's ‘odd’ – naïve éÉ\x85x\xa0y\x1cz", "a<|endoftext|>b c", "数 字 123", "don't\tstop\n\nnow  " * 40, "ﬁ ǅ İ ẞ ΑΣ Σ"]
    texts += [None, "Größe, (ÉCOLE) ÀÿÞß. #$%&* -- ...a... Ñandú!? x-y it's <b>bold</b> ﬀ ß-ß 12a a12", "***", "a" * 5000, "Æther×÷ª º K Å"]
    ids, off = pack.token_ids(pa.array(texts), PATH, 7)
    for text, a, b in zip(texts, off, off[1:], strict=False):
        assert ids[a:b].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 7]
    assert pack.token_ids(pa.array([], pa.string()), PATH, 7)[1].tolist() == [0]


def test_ids_of_generated_texts():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aBcÉßñöÿÐ.,;:!?()#$%&*-'’<>|19 \n\t ") for _ in range(60)) for _ in range(600)]
    ids, off = pack.token_ids(pa.array(texts), PATH, 0)
    for text, a, b in zip(texts, off, off[1:], strict=False):
        assert ids[a : b - 1].tolist() == t.encode(text, add_special_tokens=False).ids, text


def first_fit_decreasing(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        for k, r in enumerate(room):
            if r >= s:
                room[k] -= s
                break
        else:
            room.append(capacity - s)
    return len(room)


def check(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table(spark):
    t = Tokenizer.from_file(PATH)
    rows = pack.op7_pack(spark, DATA).collect()
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r["doc_id"], k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check(rows) <= first_fit_decreasing([r["length"] for r in rows], 2048)


def test_small_cases_are_optimal():
    assert sum(n for _, n in pack.fill_bins({6: 2, 4: 2, 5: 4}, 10)) == 4
    assert sum(n for _, n in pack.fill_bins({7: 1, 6: 1, 3: 2, 2: 1, 1: 1, 8: 1}, 10)) == 3
    assert pack.fill_bins({}, 10) == []


def test_bins_of_very_many_pieces():
    for hist in ({2045: 3, 45: 1, 2: 1006}, {2000: 3, 1: 5000, 2: 5000, 3: 7}, {1: 10**9}):
        bins = pack.fill_bins(dict(hist), 2048)
        assert sum(n * sum(sizes) for sizes, n in bins) == sum(s * c for s, c in hist.items())
    assert sum(n for _, n in pack.fill_bins({7: 1, 6: 1, 3: 2, 2: 1, 1: 1, 8: 1}, 10, effort=None)) == 3


def test_random_histograms():
    rng = random.Random(2)
    for _ in range(40):
        cap = rng.randint(5, 60)
        hist = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        bins = pack.fill_bins(dict(hist), cap)
        used = {}
        for sizes, n in bins:
            assert sum(sizes) <= cap
            for s in sizes:
                used[s] = used.get(s, 0) + n
        assert used == hist
        assert sum(n for _, n in bins) <= first_fit_decreasing([s for s, c in hist.items() for _ in range(c)], cap)


def test_odd_rows(spark):
    d = docs(spark, [(1, None), (1, None), (None, "a"), (2, "b " * 5000), (3, "")]).withColumn("length", F.lit(5))
    rows = pack.pack_documents(d).collect()
    check(rows)
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "2", "2", "3", "None"]
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert pack.pack_documents(d.limit(0)).count() == 0
