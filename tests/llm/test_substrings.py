import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from dimlens.llm import queries, substrings
from dimlens.llm.substrings import remove_repeats
from tests.llm.conftest import SCHEMA, rows

COLUMNS = ("doc_id", "n_words", "n_removed", "text")
SHORT = "doc_id long, text string, n_words string, _runs string, start string"


def brute_force(items, window=20):
    """Every window of every document in order; rows that are equal as a whole are one document."""
    def content(text):
        return np.int64(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)))

    order = sorted({(i is not None, i or 0, content(t), t or "") for i, t in items})
    seen, kept = set(), {}
    for known, i, _, text in order:
        words = text.encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            passage = tuple(words[at:at + window])
            if passage in seen:
                gone[at:at + window] = [True] * window
            seen.add(passage)
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        kept[i if known else None, text] = len(words), sum(gone), left
    return Counter((i, *kept[i, t or ""]) for i, t in items)


def found(documents, window=20):
    return Counter(map(tuple, remove_repeats(documents, window).select(*COLUMNS).collect()))


def passages(seed, n):
    """Documents out of few words and shared passages, whole or in part, in hot surroundings."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    shared = [" ".join(r.choices(words, k=r.randint(20, 90))) for _ in range(5)]
    hot = " ".join(f"h{i}" for i in range(60))
    items = []
    for i in range(n):
        parts = [" ".join(f"{w}{r.randrange(3)}" for w in r.choices(words, k=r.randint(0, 50))) for _ in range(3)]
        if r.random() < 0.4:
            parts.insert(r.randrange(4), hot)
        if r.random() < 0.5:
            cut = r.choice(shared).split()
            parts.insert(r.randrange(4), "\n".join(cut[r.randrange(5):len(cut) - r.randrange(5)]))
        items.append((i, "  ".join(parts)))
    return items


def frame(spark, items):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in items], SHORT).repartition(6)


@pytest.fixture(scope="module")
def many():
    items = passages(2, 300)
    items += [(1000 + i, items[4][1]) for i in range(20)]
    return [*items, (5, items[6][1]), (7, items[7][1]), (None, items[8][1]), (None, items[8][1]), (2000, None),
            (2001, " \x0b\x0c"), (2002, "same " * 300), (2003, "a b c " * 50), (2004, "nbsp joins 　 " * 30)]


def test_hard_documents(hard_documents, hard_items):
    assert found(hard_documents) == brute_force(hard_items)
    assert remove_repeats(hard_documents).columns == [*hard_documents.columns, "n_words", "n_removed"]


@pytest.mark.parametrize("window", [20, 2, 1])
def test_equals_brute_force(spark, many, window):
    documents = frame(spark, many)
    assert found(documents, window) == brute_force(many, window)


def test_buckets_that_are_split(spark, many, monkeypatch):
    monkeypatch.setattr(substrings, "FULL", 8)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 30000)
    documents = frame(spark, many)
    assert found(documents) == brute_force(many)


def test_query_and_sql(spark, tmp_path, many):
    items = list({i: t for i, t in many if i is not None}.items())
    spark.createDataFrame(rows(items), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for (i, n, removed, text), times in brute_force(items).items():
        expected[i, n, removed, hashlib.sha256(text.encode()).hexdigest()] += times
    assert Counter(map(tuple, queries.op11_substring_dedup(spark, str(tmp_path)).collect())) == expected
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert Counter(map(tuple, base.execute(queries.OP11_SQL).fetchall())) == expected


def test_very_long_texts_are_cut_between_windows(monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 50)
    text = " ".join(f"w{i % 7}" + "x" * (i % 9) for i in range(200)).encode() + b" " + b"y" * 300 + b" end " * 30
    words = text.split()
    windows = [words[i:i + 20] for i in range(len(words) - 19)]
    got = {}
    for before, piece in substrings._pieces(text, 20):
        own = piece.split()
        for i in range(len(own) - 19):
            assert before + i not in got
            got[before + i] = own[i:i + 20]
    assert [got[i] for i in range(len(windows))] == windows and len(got) == len(windows)


def test_super_windows_hold_every_window_once():
    data = "\n".join(t for _, t in passages(4, 20)).replace("\n\n", "\n").encode()
    lines = [line.split() for line in data.split(b"\n")]
    expected = {(n, i): b" ".join(line[i:i + 20]) for n, line in enumerate(lines) for i in range(len(line) - 19)}
    got, minimisers = {}, {}
    for line, word, count, minimiser, start, end in zip(*substrings._super_windows(data, 20), strict=True):
        words = data[start:end].split()
        assert len(words) == count + 19
        for i in range(count):
            passage = b" ".join(words[i:i + 20])
            assert (line, word + i) not in got and minimisers.setdefault(passage, minimiser) == minimiser
            got[line, word + i] = passage
    assert got == expected


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings, "_grams", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), np.uint64))
    keys = np.array([(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 0, 0)], substrings.KEY)
    blob = substrings._packed(keys, [b"a b", b"a c", b"a b"], np.empty(0, substrings.REPEAT))
    repeats = substrings._repeated([blob], 2)[0]
    assert [tuple(r["key"]) for r in repeats] == [(1, 3, 0, 0)]


def test_travel_compressed(many):
    texts = [(i, t or "") for i, t in many if i is not None]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array([i for i, _ in texts]), "content": pa.array([0] * len(texts)),
        "text": pa.array([t for _, t in texts])})
    (keys, data), = substrings._slices(iter([batch]), 20)
    sent = sum(len(blob) for _, _, blob in substrings._dealt(data, keys, 20, 4, {}))
    assert sent < len(data)


def test_empty(spark, no_documents):
    assert remove_repeats(no_documents).collect() == []
