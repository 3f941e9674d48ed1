import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from dimlens.llm import merkle, queries
from tests.llm.conftest import SCHEMA, rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, tree string, item string, path string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = text.translate(LOWER) if lower and text is not None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def first(value):
    return (value is not None, value or 0)


def levels(nodes):
    """All levels of a tree, lowest first; nodes is the lowest."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        start = at - at % 8
        yield "".join(level[start:at]), "".join(level[at + 1:start + 8])
        at //= 8


def brute_force(given):
    trees = defaultdict(list)
    for row in given:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (first(r[0]), leaf(r)))
    built = [levels([leaf(r) for r in trees[name]]) for name in names]
    above = levels([t[-1][0] for t in built])
    root, out = above[-1][0], Counter()
    for n, name in enumerate(names):
        for at, row in enumerate(trees[name]):
            path = [*steps(built[n], at), *steps(above, n)]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf(row, tampered)
            for left, right in path:
                folded = h(left + folded + right)
            out[row[0], leaf(row), built[n][-1][0], root, h("".join(a + b for a, b in path)), folded, folded == root] += 1
    return out


def found(spark, folder):
    return Counter(map(tuple, queries.op12_merkle_manifest(spark, str(folder)).collect()))


def test_hard_documents_equal_brute_force(spark, hard_documents, hard_items, tmp_path):
    hard_documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spark, tmp_path) == brute_force(rows(hard_items))


@pytest.fixture(scope="module")
def many():
    given = [(i * 3, f"Text {i}", "en", "s", i, "x", "x", "x") for i in range(4200)]
    given += [(i, "Old" if i % 2 else None, None, None, None, "x", "x", "x") for i in range(9)]
    given += [(i, "É Ä Z", f"l{i % 70}", "s", 5, "x", "x", "x") for i in range(300)]
    given += [(7, "alone", "ü", "s", 5, "x", "x", "x"), (8, "two", "", "s", 5, "x", "x", "x"), (8, "two", "", "s", 5, "x", "x", "x")]
    return given


def test_several_blocks_and_many_languages(spark, many, tmp_path):
    spark.createDataFrame(many, DOCUMENTS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    expected = brute_force(many)
    assert found(spark, tmp_path) == expected
    assert {r[6] for r in expected} == {True, False}
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert Counter(map(tuple, base.execute(queries.OP12_SQL).fetchall())) == expected


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_sizes(spark, tmp_path, n):
    given = [(i, f"T{i}", "en", "s", i, "x", "x", "x") for i in range(n)]
    spark.createDataFrame(given, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(spark, tmp_path) == brute_force(given)


def test_empty(spark, no_documents):
    assert merkle.manifest(no_documents).collect() == []
    assert no_documents.schema == SCHEMA


def test_proofs_are_emitted_without_joins(spark, hard_documents):
    plan = merkle.manifest(hard_documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate explode" in plan


def test_digits_are_grouped_away_after_one_exchange(spark, hard_documents):
    nodes = merkle.ranked(merkle.leaves(hard_documents).selectExpr(
        "lang tree", "doc_id", "leaf digest", "struct(doc_id) item"), ["doc_id", "digest"])
    plan = merkle._blocks(nodes, 0)._jdf.queryExecution().sparkPlan().toString()
    executed = merkle._blocks(nodes, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_list") and executed.count("Exchange hashpartitioning(tree") == 1
