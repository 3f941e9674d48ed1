import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dimlens.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(coded):
    return [np.frombuffer(x, dtype=np.int32).tolist() for x in coded]


def same(library, texts):
    coded = library.encode_batch(texts, add_special_tokens=False)
    for _ in range(3):  # learned, remembered, and looked up
        assert ids(bpe.codec(PATH).encode_batch(texts)) == [c.ids for c in coded]
    decoded = library.decode_batch([c.ids for c in coded], skip_special_tokens=False)
    assert bpe.codec(PATH).decode(pa.array([c.ids for c in coded], pa.list_(pa.int32()))).to_pylist() == decoded


def test_letters_of_all_planes(library):
    points = [*range(1, 0x3100), *range(0x3100, 0x30000, 97)]
    same(library, [f"a{chr(p)}b !{chr(p)}!" for p in points if not 0xD800 <= p < 0xE000])


def test_random_texts(library):
    r = random.Random(4)
    pool = "abcdeèéßüİΣσςñ'sre’́̈ \n\t\x1c 　一二한글😀!?.,-<|endoftext|>12½٣"
    same(library, ["".join(r.choices(pool, k=r.randint(0, 30))) + r.choice(["", "<|endoftext|>"])
                   for _ in range(2000)])


def test_long_words(library):
    r = random.Random(5)
    same(library, ["".join(r.choices("aeioulnrst", k=n)) for n in (40, 47, 48, 49, 100, 1000, 5000) * 9] + ["a" * 3000, "ab" * 2000])


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 60)
    own = bpe.WordCodec(PATH)
    texts = [" ".join(f"w{i % 9}x{j}" for j in range(9)) for i in range(60)]
    assert ids(own.encode_batch(texts)) == [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_pairs_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 30)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    own = bpe.WordCodec(PATH)
    for part in range(6):
        texts = [" ".join(f"word{part}{i}x{j} zqj{i * j}" for j in range(9)) for i in range(12)]
        assert ids(own.encode_batch(texts)) == [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    assert len(own.pairs) < 30 + 400 and own.pairs[-1] == np.iinfo(np.int64).max


def test_frame(hard_documents, hard_items, library):
    found = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.round_trip(hard_documents, PATH).collect()}
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in hard_items]
    assert found == {(i, tuple(x), library.decode(x, skip_special_tokens=False)) for i, x in coded}


def test_batches_of_many_rows(spark, library):
    texts = [None if i % 7 == 0 else f"row {i}, number {i * i} <|endoftext|>" for i in range(1500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    ids = F.when(F.col("doc_id") % 7 > 0, bpe.encode(F.col("text"), PATH))
    rows = frame.select("doc_id", ids.alias("ids")).select("doc_id", "ids", bpe.decode(F.col("ids"), PATH).alias("t"))
    for r in rows.collect():
        if texts[r.doc_id] is None:
            assert r.ids is None and r.t is None
        else:
            assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.t == library.decode(r.ids, skip_special_tokens=False)


def test_empty(no_documents):
    assert bpe.round_trip(no_documents, PATH).collect() == []
