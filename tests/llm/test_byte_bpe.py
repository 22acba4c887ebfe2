import os
import random

import pytest

from ledgerloom.llm.byte_bpe import DEFAULT_RANKS, Encoder, count_tokens, encode_texts, merge_many, merge_one

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no vocabulary here")
JSON = os.path.join(os.path.dirname(DEFAULT_RANKS), "byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def strange_texts():
    rng = random.Random(7)
    alphabet = [
        chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x85, 0xA0, 0x1680, 0xFEFF, 0x1F600, 0x4E00, 0x0915, 0x094D]
    ]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return texts + ["<|endoftext|> a", "a" * 3000, "ab" * 4000, "日本語" * 900, " \n\n  x ", "don't we'll"]


def test_like_the_library():
    encode, own = reference(), Encoder(DEFAULT_RANKS)
    for s in strange_texts():
        assert own.encode([s])[0].tolist() == encode(s)


def test_both_trees_agree():
    own = Encoder(DEFAULT_RANKS)
    words = [w.encode() for s in strange_texts() for w in own.find(s)]
    assert merge_many(words, own.table) == [merge_one(w, own.table) for w in words]


def test_columns(spark):
    rows = [(1, "one text", "a"), (2, "", "b"), (3, None, "c"), (4, "one text", None), (4, "one text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_texts(docs).collect())
    one = reference()("one text")
    assert got == [(1, one), (2, []), (3, []), (4, one), (4, one)]
    assert sorted(map(tuple, count_tokens(docs).collect())) == [(k, len(v)) for k, v in got]
    assert encode_texts(docs.limit(0)).count() == 0


def test_slices_cover_a_batch(monkeypatch):
    import pyarrow as pa

    import ledgerloom.llm.byte_bpe as m

    monkeypatch.setattr(m, "CHARS_AT_ONCE", 10)
    texts = ["x" * 30, None, "", "abc", "d" * 8, "e", "f" * 9, "g" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(m._slices(batch))
    assert [i for a, _ in parts for i in a.to_pylist()] == list(range(8)) and [t for _, ts in parts for t in ts] == texts
    assert all(len(ts) == 1 or sum(len(t or "") for t in ts) <= 10 for _, ts in parts)
