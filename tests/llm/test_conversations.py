import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from dimlens.llm import conversations, queries
from dimlens.llm.line_dedup import WHITE_SPACE

ROWS = "conv_id long, turn long, role string, text string, live string, pos long, part string"
LEGAL = re.compile("(s?(ua)+)?")


def damage(given):
    """Rows of (conv_id, turn, role, text) after damage, and all conversations."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in given:
        name = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows = [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        out[conv] += rows
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
            for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        content = text.strip(WHITE_SPACE)
        out.append("blank" if not content else "duplicate" if (role, text) in seen
                   else "truncated" if content[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, marks):
    """(cost, audit, roles given) by all ways forward, row by row; roles of edits stand for themselves."""
    def inserted(ways):
        todo = list(ways.items())
        while todo:
            (state, (cost, audit, given)) = todo.pop()
            role = "a" if state == "u" else "u"
            better = (cost + 2, audit + "I", (*given, role))
            if role not in ways or better[:2] < ways[role][:2]:
                ways[role] = better
                todo.append((role, better))
        return ways

    ways = inserted({"": (0, "", ())})
    for initial, mark in zip(initials, marks, strict=True):
        after = {}
        for state, (cost, audit, given) in ways.items():
            options = [(state, (cost + 3, audit + "D", given))]
            extra = mark == "truncated"
            if mark not in ("blank", "duplicate"):
                if (state, initial) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    options.append((initial, (cost + extra, audit + "K", (*given, initial))))
                role = "a" if state == "u" else "u"
                options.append((role, (cost + 2 + extra, audit + "R", (*given, role))))
            for state_after, way in options:
                if state_after not in after or way[:2] < after[state_after][:2]:
                    after[state_after] = way
        ways = inserted(after)
    return min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])


def brute_force(given):
    out = Counter()
    for conv, rows in damage(given).items():
        marks, turns = faults(rows), {t for t, _, _ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        cost, audit, _ = cheapest(initials, marks)
        repaired, state, at = [], "", 0
        for edit in audit:
            due = ("assistant", "a") if state == "u" else ("user", "u")
            if edit == "I":
                repaired.append(f"{due[0]}:")
                state = due[1]
                continue
            _, role, text = rows[at]
            at += 1
            if edit != "D":
                role, state = (role, role[0]) if edit == "K" else due
                repaired.append(f"{role}:{text}")
        assert LEGAL.fullmatch("".join(x[0] for x in repaired)) and at == len(rows)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest()] += 1
    return out


def conversation(r, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "unknown"]
    texts = ["Fine.", "Well!", "cut off", "", " \t", None, "so?", "line\none.", "ü é.", ". "]
    rows = []
    for i in range(n):
        role = r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[i % 2]
        text = r.choice(texts) if r.random() < 0.3 else f"Text {i} of it{r.choice('.!?x')}"
        turn = None if r.random() < 0.05 else r.randrange(n) if r.random() < 0.1 else i
        rows.append((conv, turn, role, text, "x", 1, "x"))
    return rows


@pytest.fixture(scope="module")
def hard():
    r = random.Random(3)
    given = [row for c in range(150) for row in conversation(r, c, r.choice([1, 2, 3, 5, 9, 20]))]
    given += conversation(r, None, 12) + conversation(r, 1000, 3000)
    given += [(2000, i, "user", "the same text of many rows", "x", 1, "x") for i in range(400)]
    given += [(2001, 5, "user", "the same row.", "x", 1, "x")] * 300
    given += [(2002, None, "assistant", "No number.", "x", 1, "x"), (2003, 1, "user", "word " * 100000, "x", 1, "x")]
    # Conversations of which nothing is left.
    gone = [c for c in range(3000, 3200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    return given + [(c, 1, "user", "Gone.", "x", 1, "x") for c in gone]


def found(spark, folder):
    return Counter(map(tuple, queries.op13_conversation_repair(spark, str(folder)).collect()))


@pytest.mark.parametrize("partitions", [1, 40])
def test_equals_brute_force(spark, hard, tmp_path, partitions):
    spark.createDataFrame(hard, ROWS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, tmp_path) == brute_force(hard)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_short_sequences():
    """Every audit of up to three rows with up to two inserts in each place, tried one by one."""
    def tried(symbols):
        best = None
        for edits in itertools.product("DKR", repeat=len(symbols)):
            for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
                audit, given, cost = "I" * inserts[0], "", 0
                for e, n in zip(edits, inserts[1:], strict=True):
                    audit += e + "I" * n
                at = 0
                for e in audit:
                    due = "a" if given[-1:] == "u" else "u"
                    if e == "I":
                        given, cost = given + due, cost + 2
                        continue
                    symbol = symbols[at]
                    at += 1
                    if e == "D":
                        cost += 3
                        continue
                    cost += symbol.isupper() + 2 * (e == "R")
                    given += due if e == "R" else symbol.lower()
                    if symbol == "x":
                        cost = 10**6
                if LEGAL.fullmatch(given) and (best is None or (cost, audit) < best):
                    best = cost, audit
        return best

    for n in range(4):
        for symbols in itertools.product("suaoUAx" if n < 3 else "suaAx", repeat=n):
            assert conversations._whole_plan("".join(symbols)) == tried(symbols), symbols


def test_powers_of_runs_equal_single_steps():
    r = random.Random(1)
    for _ in range(200):
        symbols = "".join(r.choice("suaoSUAOx") * r.choice([1, 1, 2, 7, 33]) for _ in range(6))
        after = conversations.FINAL
        for symbol in reversed(symbols):
            after = conversations._advance(symbol, 1, after)
        cost, audit, _ = conversations.plan(symbols)
        assert cost == after[0]
        marks = ["blank" if s == "x" else "truncated" if s.isupper() else "" for s in symbols]
        initials = ["t" if s in "oO" else s.lower() for s in symbols]
        assert conversations._whole_plan(symbols) == cheapest(initials, marks)[:2]


def test_long_run_is_planned_by_powers():
    cost, audit = conversations._whole_plan("u" * 10**5)
    assert cost == 10**5 and len(audit) >= 10**5


def test_empty(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert not found(spark, tmp_path)


def test_sql_equals_brute_force(hard, tmp_path):
    short = [r for r in hard if r[0] is None or r[0] not in (1000, 2000, 2001)]
    columns = {n: [r[i] for r in short] for i, n in enumerate(("conv_id", "turn", "role", "text"))}
    types = (pa.int64(), pa.int64(), pa.string(), pa.string())
    conversations = pa.table({n: pa.array(v, t) for (n, v), t in zip(columns.items(), types, strict=True)})
    with duckdb.connect() as base:
        base.register("conversations", conversations)
        assert Counter(map(tuple, base.execute(queries.OP13_SQL).fetchall())) == brute_force(short)
