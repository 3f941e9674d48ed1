import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimlens.llm import ann, topk
from dimlens.llm.vectors import usable

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("part", T.StringType()), T.StructField("vector", T.StringType()),
    T.StructField("score", T.StringType())])


def items(n, dims, seed):
    r = random.Random(seed)
    found = [(i, [r.choice([-1.0, -0.5, 0.25, 0.5, r.random()]) for _ in range(dims)]) for i in range(n)]
    found += [(n + i, list(found[3][1])) for i in range(n // 3)]  # a third is one vector
    found += [(None, [1.0] * dims), (5000, None), (5020, [float("nan")] * dims), (5040, [None] * dims),
              (5060, [0.0] * dims), (5080, [float("inf")] + [0.0] * (dims - 1)), (5100, [1.0] * (dims + 1)),
              (20, list(found[20][1])), (5120, [])]
    return found


def frame(spark, found):
    return spark.createDataFrame([(*x, "p", "v", "s") for x in found], SCHEMA).repartition(5)


def taking_part(found, dims, zero):
    return {i: v for i, v in found if i is not None and v is not None and len(v) == dims
            and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}


def as_floats(v):
    return [float(np.float32(x)) for x in v]


def test_usable_takes_the_usual_length_and_the_first_vector(spark):
    found = frame(spark, [(1, [2.0, 1.0]), (1, [1.0, 5.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [7.0, 7.0])])
    assert {r.vec_id: list(r.vector) for r in usable(found, True).collect()} == {
        1: [1.0, 5.0], 3: [0.0, 0.0], 4: [7.0, 7.0]}


@pytest.mark.parametrize(("n", "dims"), [(300, 10), (24, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, n, dims):
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "GROUPS", 3)
    found = items(n, dims, n)
    vectors = topk.integer_vectors(frame(spark, found))
    known = {i: [math.floor(64 * x) for x in as_floats(v)] for i, v in taking_part(found, dims, True).items()}
    expected = set()
    for q in (i for i in known if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(known[q], v, strict=True)), i)
                        for i, v in known.items() if i != q)
        expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:20])}
    assert {tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0")).collect()} == expected


def batch(ids, vectors, cutoff=None):
    return pa.RecordBatch.from_pydict({
        "vec_id": pa.array(ids, pa.int64()), "vector": pa.array([list(map(float, v)) for v in vectors]),
        "cutoff": pa.array([cutoff] * len(ids), pa.int64())})


@pytest.mark.parametrize("cutoff", [None, 40])
def test_every_pair_is_scored_at_most_once(monkeypatch, cutoff):
    monkeypatch.setattr(topk, "CHUNK", (5, 13))
    scored = Counter()

    def counted(queries, candidates, given=topk._partial):
        scored.update((tuple(q), tuple(c)) for q in queries for c in candidates)
        return given(queries, candidates)

    monkeypatch.setattr(topk, "_partial", counted)
    r = np.random.default_rng(4)
    vectors = np.unique(r.integers(-9, 10, (150, 6)) * r.integers(1, 30, (150, 1)), axis=0)
    ids = np.arange(len(vectors))
    order = np.argsort(-np.linalg.norm(vectors, axis=1))
    best = topk._Best(4)
    best.add(batch(ids[:9], vectors[:9], cutoff))
    best.add(batch(ids[9:20], vectors[9:20], cutoff))
    for part in np.array_split(order, 6):
        best.score(batch(ids[part], vectors[part]))
    found = {}
    for q, i, s in zip(*(c.to_pylist() for c in best.result().columns), strict=True):
        found.setdefault(q, []).append((-s, i))
    for q in range(20):
        scores = sorted((-int(vectors[q] @ vectors[i]), int(i)) for i in ids if i != q)
        assert sorted(found.get(q, [])) == [x for x in scores[:4] if cutoff is None or -x[0] >= cutoff]
    assert set(scored.values()) == {1} and len(scored) <= 20 * len(vectors)
    # Short vectors that cannot reach the cutoffs are passed over.
    assert len(scored) < 20 * len(vectors) * 0.95


def test_what_groups_send_grows_with_the_queries(spark):
    sent = {}
    for n in (400, 1600):
        vectors = topk.integer_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(
            np.random.default_rng(1).standard_normal((n, 4)))]))
        queries = vectors.where("vec_id < 40")
        dealt = vectors.withColumn("group", F.lit(1))
        asked = queries.withColumn("groups", F.array(F.lit(1))).withColumn("cutoff", F.lit(None).cast("long"))
        sent[n] = topk._searched(asked, dealt, 5, 1).count()
    assert sent == {400: 200, 1600: 200}


def test_top_k_of_large_numbers(spark):
    vectors = spark.createDataFrame([(i, [float(2**30 + i), float(2**29 - i)]) for i in range(40)],
                                    "vec_id long, vector array<double>")
    found = topk.top_k(vectors, vectors.where("vec_id = 0"), 3).collect()
    whole = sorted((-(2**30 * (2**30 + i) + 2**29 * (2**29 - i)), i) for i in range(1, 40))[:3]
    assert [(r.vec_id, r.score) for r in found] == [(i, -s) for s, i in whole]


def brute_nearest(known, queries, k):
    expected = {}
    for q in queries:
        far = sorted((math.dist(known[q], v), i) for i, v in known.items() if i != q)
        expected[q] = far[:k]
    return expected


def test_nearest_of_few_is_exact(spark):
    found = items(30, 4, 8)
    known = {i: as_floats(v) for i, v in taking_part(found, 4, False).items()}
    rows = ann.nearest(frame(spark, found), F.col("vec_id") % 10 == 0, 50).collect()
    for q, far in brute_nearest(known, [i for i in known if i % 10 == 0], 50).items():
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[1] for r in own] == [i for _, i in far]
        assert np.allclose([r[2] for r in own], [d for d, _ in far], rtol=1e-12)
        assert [r[0] for r in own] == list(range(1, len(far) + 1))


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", (9, 100))
    r = np.random.default_rng(3)
    vectors = r.standard_normal((12, 24))[r.integers(0, 12, 1500)] + 0.7 * r.standard_normal((1500, 24))
    found = [(i, v.tolist()) for i, v in enumerate(vectors)]
    known = {i: as_floats(v) for i, v in found}
    rows = ann.nearest(frame(spark, found), F.col("vec_id") % 10 == 0, sample=700).collect()
    hits = 0
    for q, far in brute_nearest(known, range(0, 1500, 10), 10).items():
        own = [x for x in rows if x.query_id == q]
        assert len(own) == 10
        assert all(abs(x.score - math.dist(known[q], known[x.vec_id])) < 1e-12 for x in own)
        hits += len({x.vec_id for x in own} & {i for _, i in far})
    assert hits >= 0.9 * 1500


def test_copies_of_one_vector(spark):
    found = [(i, [1.0, 2.0] if i < 700 else [float(i), 1.0]) for i in range(1000)]
    rows = ann.nearest(frame(spark, found), F.col("vec_id") == 500).collect()
    assert [r.vec_id for r in sorted(rows, key=lambda r: r.rank)] == list(range(10))


def test_empty(spark):
    none = frame(spark, [])
    assert ann.nearest(none, F.col("vec_id") % 10 == 0).collect() == []
    vectors = topk.integer_vectors(none)
    assert topk.top_k(vectors, vectors).collect() == []
