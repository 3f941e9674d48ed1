import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dimlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(counts, capacity):
    """The fewest bins, by trying every content for the longest item."""
    @lru_cache(None)
    def bins(items):
        if not items:
            return 0
        best, rest = len(items), items[1:]

        def grow(at, room, left):
            nonlocal best
            best = min(best, 1 + bins(left))
            for i in range(at, len(rest)):
                if rest[i] <= room and (i == at or rest[i] != rest[i - 1]):
                    grow(i + 1, room - rest[i], _without(left, rest[i]))

        grow(0, capacity - items[0], rest)
        return best

    return bins(tuple(sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)))


def _without(items, item):
    at = items.index(item)
    return items[:at] + items[at + 1:]


def held(filled):
    total = Counter()
    for content, bins in filled:
        for n, copies in content:
            total[n] += copies * bins
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(12, 16))
def test_reduction_keeps_the_fewest(items, capacity):
    counts = dict(Counter(items))
    fixed, left = packing.reduce_by_dominance(counts, capacity)
    assert held(fixed) + Counter(left) == Counter(items)
    assert all(sum(n * c for n, c in f.content) <= capacity for f in fixed)
    assert sum(f.bins for f in fixed) + fewest(left, capacity) == fewest(counts, capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 200), max_size=30))
def test_plan_holds_every_item(counts):
    filled = packing.plan(counts, 60)
    assert held(filled) == Counter(counts)
    assert all(sum(n * c for n, c in f.content) <= 60 and f.bins > 0 for f in filled)


def check_packing(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_pieces_equal_the_tokenizer(hard_documents, hard_items):
    library = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, text in hard_items:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 100 or 100
        cuts = [0, *range(first, len(ids) + 1, 100)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, p, a, b - a, ids[a:b].tobytes()] += 1
    found = packing.token_pieces(hard_documents, PATH, 100)
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.collect()) == expected
    placed = packing.pack(found.withColumn("sequence_id", F.lit("taken")), 100).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in placed) == expected
    used, tokens = check_packing(placed, 100), sum(r.length for r in placed)
    assert used <= -(-tokens // 100) + 2


def test_faster_words_equal_the_tokenizer():
    r = random.Random(2)
    pool = "abcdeèéßüΣσςñ'sre’ \n\t\x1c\x85 　一二한글ªº²!?.,-<|endoftext|>12½"
    texts = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(3000)]
    texts += [f"a {chr(p)}{chr(p)} b{chr(p)}1" for p in range(1, 0xFFFF) if not 0xD800 <= p < 0xE000]
    texts += ["".join(r.choices(["a", "Bc", "1", " ", "\n", "."], k=r.randint(0, 12))) for _ in range(6000)]
    own = packing.codec(PATH)
    assert [np.frombuffer(own.encode(t), dtype="<u4").tolist() for t in texts] == [
        e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_frequent_length_and_empty(spark, no_documents):
    lengths = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50 + 1).alias("length"))
    placed = packing.pack(lengths.repartition(7), 50).collect()
    assert len(placed) == 5000
    assert check_packing(placed, 50) <= 1.01 * sum(r.length for r in placed) / 50
    assert packing.pack(packing.token_pieces(no_documents, PATH)).collect() == []


def test_wrong_length(spark):
    with pytest.raises(ValueError, match="outside"):
        packing.pack(spark.createDataFrame([(0,)], "length long"))
