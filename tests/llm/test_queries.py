"""The registered queries and their digests against plain Python and the SQL, on the hard documents."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
from dimlens.llm import queries
from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_line_dedup import brute_force as kept_lines
from tests.llm.test_pii import brute_force as personal
from tests.llm.test_simhash import grouped

COLUMNS = {
    "op1_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, "
               "spans string, n_terms bigint",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                            "sequence_id bigint, offset bigint",
    "op3_secrets": "doc_id bigint, start bigint, end bigint, value_sha256 string, probability double, is_secret int",
    "op4_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op5_learned_partitions": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op11_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op12_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
                            "folded_root string, verified boolean",
    "op13_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                                "illegal bigint, cost bigint, audit string, repaired_sha256 string",
}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, hard_items):
    path = str(tmp_path_factory.mktemp("tables"))
    pii = [(900, "write a.b@c.de, +49 (170) 123-4567 or 4111 1111 1111 1111 from 10.0.0.255"), (901, "é a@b.c 1.2.3.256")]
    spark.createDataFrame(rows([*hard_items, *pii]), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    vectors = np.random.default_rng(5).standard_normal((130, 6)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "Hello."), (1, 1, "assistant", None)],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path, [*hard_items, *pii]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, folder, name):
    found = contract.queries()[name](spark, folder[0])
    assert ", ".join(f"{n} {t}" for n, t in found.dtypes) == COLUMNS[name]


def counted(spark, folder, name):
    return Counter(map(tuple, queries.QUERIES[name](spark, folder[0]).collect()))


def test_personal_data(spark, folder):
    expected = Counter()
    for i, text in folder[1]:
        found = personal(text)
        counts = [sum(k == kind for k, _, _ in found) for kind in ("email", "ip", "card", "phone")]
        expected[i, *counts, sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))] += 1
    assert Counter(tuple(r)[:6] for r in queries.op1_pii(spark, folder[0]).collect()) == expected


def test_packing(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text in folder[1]:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in queries.op2_best_fit_packing(spark, folder[0]).collect()) == expected


def test_round_trip(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for i, text in folder[1]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), sha(" ".join(map(str, ids))), sha(decoded)] += 1
    assert counted(spark, folder, "op4_bpe_round_trip") == expected


def test_line_dedup(spark, folder):
    expected = Counter()
    for (i, text, n, dropped), times in kept_lines(folder[1]).items():
        expected[i, n, dropped, sha(text)] += times
    assert counted(spark, folder, "op6_line_dedup") == expected


def test_simhash(spark, folder):
    marks, group, ids = grouped(folder[1])
    assert counted(spark, folder, "op7_simhash") == Counter((i, f"{f:016x}", ids.get(group[f])) for i, f in marks)


def test_top_k_sql(spark, folder):
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder[0]}/embeddings.parquet/*.parquet'")
        expected = Counter(map(tuple, base.execute(queries.ORACLE_SQL["op10_exact_top_k"]).fetchall()))
    assert counted(spark, folder, "op10_exact_top_k") == expected


def test_line_dedup_sql(spark, folder, tmp_path):
    items = [(i, t) for i, t in {i: t for i, t in folder[1] if i is not None}.items() if "\x00" not in (t or "")]
    spark.createDataFrame(rows(items), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = Counter(map(tuple, base.execute(queries.ORACLE_SQL["op6_line_dedup"]).fetchall()))
    assert Counter(map(tuple, queries.op6_line_dedup(spark, str(tmp_path)).collect())) == expected
