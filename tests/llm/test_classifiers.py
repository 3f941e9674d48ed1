import random
from zlib import crc32

import numpy as np
import pytest

from dimlens.llm import quality, toxicity
from dimlens.llm.labelled import calibrated, logistic

BAD = ["foul", "vile", "nasty", "rotten"]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(300)]
    items = []
    for i in range(900):
        text = r.choices(words, k=r.randint(5, 120))
        toxic, junk = int(r.random() < 0.2), int(r.random() < 0.2)
        if junk:
            text = [w.upper() + "!!" for w in text] if i % 2 else [w for w in text[:9] for _ in range(12)]
        if toxic:
            for w in r.choices(BAD, k=r.randint(2, 6)):
                text.insert(r.randint(0, len(text)), w)
        items.append((i, " ".join(text).capitalize() + ".", 1 - junk, toxic))
    return items


def labels(spark, corpus):
    rows = [(i, q, t) for i, _, q, t in corpus if i % 3]
    rows += [(None, 1, 1), (rows[0][0], rows[0][1], None), (10**6, 0, 1), (rows[1][0], 7, rows[1][2])]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def right(scored, corpus, column):
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == len(corpus)
    held = [x for x in corpus if rows[x[0]].held_out]
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    return np.mean([rows[x[0]].predicted == x[column] for x in held]), rows


@pytest.mark.parametrize(("module", "column", "modulus", "remainder"), [(quality, 2, 4, 2), (toxicity, 3, 3, 1)])
def test_held_out_accuracy(spark, corpus, module, column, modulus, remainder):
    documents = spark.createDataFrame([(i, t) for i, t, _, _ in corpus], "doc_id long, text string")
    accuracy, rows = right(module.score(documents, labels(spark, corpus)), corpus, column)
    assert accuracy >= 0.95
    assert all(rows[i].held_out == (crc32(str(i).encode()) % modulus == remainder) for i in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_held_out_labels_change_nothing(spark, corpus, module):
    documents = spark.createDataFrame([(i, t) for i, t, _, _ in corpus[:300]], "doc_id long, text string")
    modulus, remainder = (4, 2) if module is quality else (3, 1)
    turned = [(i, q, t) if crc32(str(i).encode()) % modulus != remainder else (i, 1 - q, 1 - t)
              for i, _, q, t in corpus[:300]]
    given = [(i, q, t) for i, _, q, t in corpus[:300]]
    scores = [{r.doc_id: round(r.score, 9) for r in module.score(documents, spark.createDataFrame(
        x, "doc_id long, quality int, toxic int")).collect()} for x in (given, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_hard_documents(spark, hard_documents, hard_items, no_documents, corpus, module):
    scored = module.score(hard_documents, labels(spark, corpus)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in scored) == sorted(
        (i is not None, i or 0) for i, _ in hard_items)
    assert all(0 <= r.score <= 1 for r in scored)
    assert module.score(no_documents, labels(spark, corpus)).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(hard_documents, none).collect()} == {0.5 if module is quality else 0.0}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.score(hard_documents, one).collect()} == {1.0 if module is quality else 0.0}


def test_all_words_of_long_documents_are_learned_from(spark):
    words = [f"w{i}" for i in range(5000)]
    lowest = min(words, key=lambda w: toxicity.word_codes(w)[0])
    highest = max(words, key=lambda w: toxicity.word_codes(w)[0])
    items = [(i, " ".join(w for w in words if i < 4 or w not in (lowest, highest))) for i in range(12)]
    model = toxicity.train(spark.createDataFrame(items, "doc_id long, text string"), spark.createDataFrame(
        [(i, int(i < 4)) for i in range(12)], "doc_id long, toxic int"))
    for word in (lowest, highest):
        assert model.strength[toxicity.buckets(toxicity.word_codes(word))[0, 0]] > 0
    assert model.centre[-1] >= np.log1p(4990)


def test_priors_above_one_half_hold(spark, monkeypatch):
    documents = spark.createDataFrame([(i, f"word w{i}") for i in range(10)], "doc_id long, text string")
    toxic = spark.createDataFrame([(i, int(i < 8)) for i in range(10)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda sample, prior: prior)
    found = [toxicity.train(documents, toxic, prior=p) for p in (None, 0.9, 1.0, 0.0)]
    assert found == [0.8, 0.9, 1 - 1e-4, 1e-4]


def test_corrected_risk_gradient():
    r = np.random.default_rng(1)
    p, u, prior, step = r.standard_normal(5), r.standard_normal(9), 0.3, 1e-6

    def risk(p, u):
        return (prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    gp, gu = toxicity.non_negative_risk(p, u, prior)
    for i in range(5):
        assert abs((risk(p + step * (np.arange(5) == i), u) - risk(p, u)) / step - gp[i]) < 1e-4
    for i in range(9):
        assert abs((risk(p, u + step * (np.arange(9) == i)) - risk(p, u)) / step - gu[i]) < 1e-4
    gp, gu = toxicity.non_negative_risk(np.full(5, 4.0), np.full(9, -9.0), prior)  # the rest is negative
    assert (gp > 0).all() and (gu < 0).all()


def test_discriminant_is_the_log_density():
    r = np.random.default_rng(2)
    x = [r.standard_normal((400, 3)) @ r.standard_normal((3, 3)) + m for m in (0, 2)]
    moments = {k: (float(len(v)), v.sum(axis=0), v.T @ v) for k, v in enumerate(x)}
    found = quality.fit(moments, 0.0, 0.0).difference(x[0])
    logs = []
    for v in x:
        c = np.cov(v.T, bias=True) + 1e-6 * np.eye(3)
        d = x[0] - v.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c))))
    assert np.allclose(found, logs[1] - logs[0], atol=1e-6)


def test_calibration():
    x = np.linspace(-5, 5, 41)
    slope, offset = calibrated(x, 1e4 * logistic(1.5 * x - 1), 1e4 * logistic(1 - 1.5 * x))
    assert abs(slope - 1.5) < 0.01 and abs(offset + 1) < 0.01
