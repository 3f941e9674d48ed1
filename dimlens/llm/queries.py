"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimlens.llm import ann, bpe, conversations, line_dedup, merkle, packing, pii, quality, secrets, simhash, substrings, topk, toxicity
from dimlens.llm.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    listed = "transform({}, s -> concat_ws(':', s.kind, s.start, s.end))"
    base = f"filter(spans, s -> s.kind <> '{pii.TERM}')"
    return found.select(
        "doc_id", *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
                    for k in pii.KINDS),
        F.sha2(F.array_join(F.expr(listed.format(base)), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(listed.format("spans")), ",").alias("spans"),
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{pii.TERM}')) as bigint)").alias("n_terms"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"),
                        "probability", "is_secret")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"),
                           public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS position
    FROM documents),
keys AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines),
repeated AS (
    SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT k.*, coalesce(r.last <> k.doc_id, false) AS dropped
    FROM keys k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
                        "component_id")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(topk.integer_vectors(_table(spark, sf_dir, "embeddings")), "integers")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP10_SQL = """
WITH vectors AS (
    SELECT vec_id, min([CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    GROUP BY vec_id),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
        CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH split AS (
    SELECT doc_id, [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS words
    FROM documents),
numbered AS (SELECT doc_id, words, unnest(range(len(words))) AS place FROM split),
windows AS (
    SELECT doc_id, place, CASE WHEN place + 20 <= len(words)
        THEN array_to_string(words[place + 1:place + 20], ' ') END AS passage
    FROM numbered),
judged AS (
    SELECT doc_id, place, passage IS NOT NULL AND
        row_number() OVER (PARTITION BY passage ORDER BY doc_id, place) > 1 AS repeated
    FROM windows),
covered AS (
    SELECT doc_id, place, max(repeated) OVER (
        PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM judged),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
        string_agg(words[place + 1], ' ' ORDER BY place) FILTER (WHERE NOT gone) AS text
    FROM covered JOIN split USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(_table(spark, sf_dir, "documents"))
    beside = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    proved = found.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"),
                          merkle.folded(F.col("tampered_leaf"), F.col("path")).alias("folded_root"))
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql(levels: int = 7, above: int = 3) -> str:
    """SQL for trees of up to 8**levels leaves and 8**above languages: one table per level."""
    def coded(value: str) -> str:
        text = f"CAST({value} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    def tree(name: str, first: str, count: int) -> list[str]:
        """Tables name0, …: nodes (tree, r, n, h) of each level with the digests left and right of them."""
        out = [f"{name}_h0 AS ({first})"]
        for k in range(count):
            run = "OVER (PARTITION BY tree, r // 8 ORDER BY r ROWS BETWEEN"
            out.append(f"""{name}{k} AS (SELECT tree, r, n, h,
    coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}_h{k})""")
            out.append(f"""{name}_h{k + 1} AS (SELECT tree, r // 8 AS r, n,
    CASE WHEN n > {8**k} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE min(h) END AS h
    FROM {name}_h{k} GROUP BY tree, r // 8, n)""")
        return out

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = "sha256(" + " || ".join(map(coded, fields)) + ")"
    other = "sha256(" + " || ".join(coded(lower if f == "text" else f) for f in fields) + ")"
    steps = [("d", k, "l.r") for k in range(levels)] + [("u", k, "s.r") for k in range(above)]
    joins = "".join(f"\nJOIN {t}{k} ON {t}{k}.tree IS NOT DISTINCT FROM {'l.tree' if t == 'd' else '0'} "
                    f"AND {t}{k}.r = {r} // {8**k}" for t, k, r in steps)
    used = [(f"{t}{k}.n > {8**k}", f"{t}{k}") for t, k, _ in steps]
    proof = " || ".join(f"CASE WHEN {c} THEN {t}.before || {t}.after ELSE '' END" for c, t in used)
    tables = [f"""crcs AS (SELECT doc_id, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
        [CAST(ord(x) AS UBIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda acc, b: list_reduce(
            list_prepend(xor(acc, b), [CAST(i AS UBIGINT) FOR i IN range(8)]),
            lambda a, i: xor(a >> 1, CAST(3988292384 AS UBIGINT) * (a & 1)))) AS c
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
              f"""leaves AS (SELECT doc_id, lang AS tree, {leaf} AS leaf, CASE WHEN (
        SELECT xor(c, 4294967295) % 3 FROM crcs WHERE crcs.doc_id = documents.doc_id) = 0
    THEN {other} ELSE {leaf} END AS tampered FROM documents)""",
              """l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r
    FROM leaves)""",
              *tree("d", "SELECT tree, r, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM l", levels),
              f"""s AS (SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS r FROM d_h{levels})""",
              *tree("u", "SELECT 0 AS tree, r, count(*) OVER () AS n, h FROM s", above)]
    folds, at = [], "f0"
    tables.append(f"f0 AS (SELECT l.doc_id, l.leaf, s.h AS subroot, u_h{above}.h AS root, sha256({proof}) AS proof_sha256, "
                  "l.tampered AS f, " + ", ".join(f"CASE WHEN {c} THEN {t}.before END AS b{i}, {t}.after AS a{i}"
                                                  for i, (c, t) in enumerate(used))
                  + f"\nFROM l JOIN s ON s.tree IS NOT DISTINCT FROM l.tree CROSS JOIN u_h{above}{joins})")
    for i in range(len(used)):
        folds.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN b{i} IS NULL THEN f ELSE sha256(b{i} || f || a{i}) END AS f) "
                     f"FROM {at})")
        at = f"f{i + 1}"
    return "WITH " + ",\n".join(tables + folds) + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM {at}"""


OP12_SQL = _merkle_sql()


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", *conversations.COUNTS, "audit",
                        F.sha2(conversations.turns_text(F.col("turns")), 256).alias("repaired_sha256"))


OP13_SQL = r"""
WITH RECURSIVE named AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations),
crcs AS (
    SELECT name, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
        [CAST(ord(x) AS UBIGINT) FOR x IN string_split(name, '')]), lambda acc, b: list_reduce(
            list_prepend(xor(acc, b), [CAST(i AS UBIGINT) FOR i IN range(8)]),
            lambda a, i: xor(a >> 1, CAST(3988292384 AS UBIGINT) * (a & 1)))), 4294967295) % 20 AS kind
    FROM (SELECT DISTINCT name FROM named)),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM named JOIN crcs USING (name)),
placed AS (
    SELECT *, left(role, 1) AS initial, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
marked AS (
    SELECT *, CASE WHEN content = '' THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
        WHEN right(content, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM placed),
inserted(state, after, more) AS (VALUES ('n', 'n', ''), ('n', 'u', 'I'), ('n', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'),
    ('s', 'a', 'II'), ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')),
ways AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS n, after AS state, {'cost': 2 * length(more), 'audit': more} AS way
    FROM (SELECT DISTINCT conv_id FROM marked) JOIN inserted ON state = 'n'
    UNION ALL
    SELECT conv_id, n, after, min({'cost': cost + 2 * length(more), 'audit': audit || more}) AS way
    FROM (
        SELECT w.conv_id, m.n, e.edit, w.way.audit || e.edit AS audit,
            w.way.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
                + CASE WHEN e.edit <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
            CASE e.edit WHEN 'D' THEN w.state WHEN 'K' THEN m.initial ELSE CASE w.state WHEN 'u' THEN 'a' ELSE 'u' END END AS state
        FROM ways w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
        JOIN (VALUES ('D'), ('K'), ('R')) e(edit) ON e.edit = 'D' OR (m.fault NOT IN ('blank', 'duplicate')
            AND (e.edit = 'R' OR w.state || m.initial IN ('ns', 'nu', 'su', 'ua', 'au')))) c
    JOIN inserted i ON i.state = c.state
    GROUP BY conv_id, n, after),
best AS (
    SELECT w.conv_id, min(w.way) AS way FROM ways w
    JOIN (SELECT conv_id, max(n) AS n FROM marked GROUP BY conv_id) l
        ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.n
    WHERE state IN ('n', 'a') GROUP BY w.conv_id),
edits AS (
    SELECT conv_id, unnest(string_split(way.audit, '')) AS edit, unnest(range(length(way.audit))) AS place FROM best
    WHERE way.audit <> ''),
counted AS (
    SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS n, count(*) FILTER (WHERE edit <> 'D') OVER w AS given
    FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
turns AS (
    SELECT c.conv_id, c.place, c.edit, c.given, m.role, m.initial, CASE WHEN c.edit = 'I' THEN '' ELSE m.text END AS text,
        max(CASE WHEN c.given = 1 AND c.edit = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS led
    FROM counted c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.n = c.n WHERE c.edit <> 'D'),
repaired AS (
    SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (given - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || text, chr(10) ORDER BY place) AS body FROM turns GROUP BY conv_id),
totals AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(way.cost, 0) AS BIGINT) AS cost,
    coalesce(way.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_best_fit_packing, op3_secrets, op4_bpe_round_trip,
                             op5_learned_partitions, op6_line_dedup,
                             op7_simhash, op8_quality, op9_toxicity, op10_exact_top_k,
                             op11_substring_dedup, op12_merkle_manifest,
                             op13_conversation_repair)}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op10_exact_top_k": OP10_SQL,
                              "op11_substring_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL,
                              "op13_conversation_repair": OP13_SQL}
