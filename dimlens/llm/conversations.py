"""Conversations repaired until their roles alternate, by dynamic programming over runs of equal rows."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dimlens.llm.line_dedup import WHITE_SPACE
from dimlens.llm.storage import stored

#: What ends a whole sentence, what stands for a null, and the costs of edits.
ENDS = ".!?"
NULL = " "
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States by the roles given so far: nothing, system, ... user, ... assistant.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The role due in each state, the state it leads to, and the states in which a role may be kept.
DUE = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER,
        ("a", USER): ASSISTANT}
#: What each state lacks at the end: inserts that complete the last pair.
ENDING = ("", "II", "I", "")
FAR = 1 << 60
#: Symbols of rows: initial of the role (o: any other), upper case if truncated; x has to be deleted.
FORCED = "x"
ROW_BITS = 33

Vector = tuple[int, int, int, int]
FINAL: Vector = tuple(INSERT * len(e) for e in ENDING)


@functools.cache
def _choices(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(audit, cost, state after) of a row: inserts before it, then one edit; ASCII-least audit first."""
    out, inserts, cost = [], "", 0
    while len(inserts) < len(STATES):
        out.append((inserts + "D", cost + DELETE, state))
        if symbol != FORCED:
            kept = KEPT.get((symbol.lower(), state))
            extra = cost + TRUNCATED * symbol.isupper()
            if kept is not None:
                out.append((inserts + "K", extra, kept))
            out.append((inserts + "R", extra + REROLE, NEXT[state]))
        inserts, cost, state = inserts + "I", cost + INSERT, NEXT[state]
    return tuple(sorted(out))


@functools.cache
def _power(symbol: str, k: int) -> tuple[Vector, ...]:
    """Min-plus transition of 2**k equal rows: cost from each state to each state."""
    if k == 0:
        rows = [[FAR] * len(STATES) for _ in STATES]
        for state in STATES:
            for _, cost, after in _choices(symbol, state):
                rows[state][after] = min(rows[state][after], cost)
        return tuple(map(tuple, rows))
    half = _power(symbol, k - 1)
    return tuple(tuple(min(FAR, *(a + half[via][to] for via, a in enumerate(row))) for to in STATES) for row in half)


def _advance(symbol: str, n: int, after: Vector) -> Vector:
    """Cost to go before a run of n equal rows, from the cost to go after it."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            after = tuple(min(FAR, *(a + b for a, b in zip(row, after, strict=True))) for row in _power(symbol, k))
    return after


def _unroll(symbol: str, n: int, state: int, after: Vector, audit: list[str]) -> int:
    """Append the choices for a run of equal rows, ASCII-least among the cheapest; the state after it."""
    if n == 1:
        best = min(_choices(symbol, state), key=lambda c: (c[1] + after[c[2]], c[0]))
        audit.append(best[0])
        return best[2]
    half = n // 2
    state = _unroll(symbol, n - half, state, _advance(symbol, half, after), audit)
    return _unroll(symbol, half, state, after, audit)


def plan(symbols: str, start: int = NOTHING, final: Vector = FINAL) -> tuple[int, str, int]:
    """(cost, audit, state after) of the cheapest edits of rows, ASCII-least among equal ones.

    Equal consecutive symbols are one run. Going back from the end, every run costs as many steps
    as its length has binary digits; going forward, choices are unrolled run by run, halving runs,
    so that no more than a logarithm of a run's costs is held at a time. No row's choices are a
    prefix of another's, so the least choice row by row is the least audit.
    """
    runs = [(symbol, len(list(same))) for symbol, same in itertools.groupby(symbols)]
    after = [final]
    for symbol, n in reversed(runs):
        after.append(_advance(symbol, n, after[-1]))
    cost, state, audit = after[-1][start], start, []
    if cost >= FAR:
        return FAR, "", start
    for (symbol, n), to_go in zip(runs, after[-2::-1], strict=True):
        state = _unroll(symbol, n, state, to_go, audit)
    return cost, "".join(audit), state


def _whole_plan(symbols: str) -> tuple[int, str]:
    cost, audit, state = plan(symbols)
    return cost, audit + ENDING[state]


_short_plan = functools.lru_cache(maxsize=65536)(_whole_plan)


def render(audit: str, rows: Iterable[tuple[str, str]], state: int = NOTHING) -> list[dict]:
    """The turns that an audit makes of (role, text) rows."""
    out, given = [], iter(rows)
    for edit in audit:
        role, text = (DUE[state], "") if edit == "I" else next(given)
        if edit == "D":
            continue
        if edit == "R":
            role = DUE[state]
        out.append({"role": role, "text": text})
        state = KEPT[role[:1], state]
    return out


def _symbol(initial: str, whole: bool) -> str:
    symbol = initial if initial in ("s", "u", "a") else "o"
    return symbol if whole else symbol.upper()


def _illegal(before: str | None, initial: str) -> bool:
    return before is not None and before + initial not in ("su", "ua", "au")


def _repaired(rows: list[tuple]) -> dict:
    """The result for one whole conversation of (turn, role, text) rows in order."""
    seen, turns, symbols, before = set(), set(), [], None
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for turn, role, text in rows:
        content, initial = text.strip(WHITE_SPACE), role[:1]
        whole = content[-1:] in ENDS
        fault = "blank" if not content else "duplicate" if (role, text) in seen else None if whole else "truncated"
        seen.add((role, text))
        turns.add(turn)
        if fault:
            counts[fault] += 1
        counts["illegal"] += _illegal(before, initial)
        before = initial
        symbols.append(FORCED if fault in ("blank", "duplicate") else _symbol(initial, whole))
    turns.discard(None)
    solve = _whole_plan if len(symbols) > 64 else _short_plan
    cost, audit = solve("".join(symbols))
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts, "cost": cost,
            "audit": audit, "turns": render(audit, (r[1:] for r in rows))}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS = "array<struct<role:string,text:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): rows damaged by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays, not live, so that its conversation is known), 1 empties its text,
    2 removes ``.!?`` from it, 3 repeats the row, 4 gives it the role user. Nulls in role and text,
    and in the text that is hashed, are one space.
    """
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("conv_id", "turn")))
    kind = F.crc32(named) % 20
    text, role = (F.coalesce(F.col(c), F.lit(NULL)) for c in ("text", "role"))
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")


def _in_order(rows: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """Results of conversations that lie within one partition, and the rows of all others.

    Rows are range-partitioned by conversation, turn, role and text, so that one conversation with
    most of the rows fills many partitions. Only the first and the last conversation of a partition
    can go on in another: their rows are handed on with their place, the first ones as they come.
    """
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = (f"conv_id {conv_type}, {counts}, audit string, turns {TURNS}, "
              f"pos long, turn {turn_type}, role string, text string, live boolean")
    keys = ["conv_id", "turn", "role", "text", "_row"]
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, first, same, held = TaskContext.get().partitionId() << ROW_BITS, 0, True, None, []
        started = False

        def table(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if started and row["conv_id"] != same:
                    if not first:
                        live = [(r["turn"], r["role"], r["text"]) for r in held if r["live"]]
                        out.append({"conv_id": same, **_repaired(live)})
                    first, held = False, []
                started, same = True, row["conv_id"]
                row["pos"] = part + place
                place += 1
                (out if first else held).append(row)
            if out:
                yield table(out)
        if held:
            yield table(held)

    return rows.mapInArrow(work, schema)


SEGMENT = ("rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
           "low {turn}, high {turn}, first_turn {turn}, last_turn {turn}, distinct_turns long, "
           "costs array<long>, order array<int>, audits array<string>")


def _segments(open_rows: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """One row per conversation and partition: counts, and the cheapest edits from each state to each.

    A row repeats an earlier one if it is not at the first place of its role and text in the whole
    conversation; those places are found by an aggregation.
    """
    live = open_rows.where("live")
    part = F.shiftright("pos", ROW_BITS).alias("part")
    first = live.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos")).select("conv_id", part, "pos")
    content = F.btrim("text", F.lit(WHITE_SPACE))
    light = live.select("conv_id", part, "pos", "turn", F.substring("role", 1, 1).alias("initial"),
                        (content == "").alias("blank"), F.right(content, F.lit(1)).isin(*ENDS).alias("whole"))
    schema = f"conv_id {conv_type}, part long, " + SEGMENT.format(turn=turn_type)

    def segment(key, rows: pa.Table, firsts: pa.Table) -> pa.Table:
        fresh = set(firsts["pos"].to_pylist())
        rows = sorted(rows.to_pylist(), key=lambda r: r["pos"])
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        symbols, before, turns = [], None, set()
        for r in rows:
            fault = ("blank" if r["blank"] else "duplicate" if r["pos"] not in fresh
                     else None if r["whole"] else "truncated")
            if fault:
                out[fault] += 1
            out["illegal"] += _illegal(before, r["initial"])
            before = r["initial"]
            turns.add(r["turn"])
            symbols.append(FORCED if fault in ("blank", "duplicate") else _symbol(before, r["whole"]))
        turns.discard(None)
        units = [tuple(0 if s == e else FAR for s in STATES) for e in STATES]
        plans = [plan("".join(symbols), s, units[e]) for s in STATES for e in STATES]
        audits = [p[1] for p in plans]
        order = [sorted(audits[i // 4 * 4:i // 4 * 4 + 4]).index(a) for i, a in enumerate(audits)]
        out |= {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "rows": len(rows), "first": rows[0]["initial"],
                "last": before, "low": min(turns, default=None), "high": max(turns, default=None),
                "first_turn": rows[0]["turn"], "last_turn": rows[-1]["turn"], "distinct_turns": len(turns),
                "costs": [p[0] for p in plans], "order": order, "audits": audits}
        return pa.Table.from_pylist([out], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keys = ["conv_id", "part"]
    return light.groupBy(*keys).cogroup(first.groupBy(*keys)).applyInArrow(segment, schema)


def _chained(segments: DataFrame, conv_type: str) -> DataFrame:
    """(conv_id, part, start, end, last, counts): the states between which each segment's edits run.

    A conversation has one row per partition that it fills, so its chain is short. Costs are added
    from the end; of equally cheap ends of a segment the one with the ASCII-least audit is taken.
    """
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv_id {conv_type}, part long, start int, end int, last boolean, {counts}"

    def chain(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        to_go, ends = list(FINAL), []
        for r in reversed(rows):
            best = [min((r["costs"][s * 4 + e] + to_go[e], r["order"][s * 4 + e], e) for e in STATES) for s in STATES]
            to_go, chosen = [b[0] for b in best], [b[2] for b in best]
            ends.append(chosen)
        totals = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        distinct = sum(r["distinct_turns"] for r in rows)
        for a, b in itertools.pairwise(rows):
            totals["illegal"] += _illegal(a["last"], b["first"])
            distinct -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
        low = min((r["low"] for r in rows if r["low"] is not None), default=None)
        high = max((r["high"] for r in rows if r["high"] is not None), default=None)
        totals |= {"gaps": 0 if low is None else high - low + 1 - distinct, "cost": to_go[NOTHING]}
        out, state = [], NOTHING
        for r, chosen in zip(rows, reversed(ends), strict=True):
            out.append({"conv_id": r["conv_id"], "part": r["part"], "start": state, "end": chosen[state],
                        "last": r is rows[-1], **totals})
            state = chosen[state]
        return pa.Table.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return segments.drop("audits").groupBy("conv_id").applyInArrow(chain, schema)


def _open_results(open_rows: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """Results of conversations whose rows lie in several partitions, or at the end of one."""
    segments = stored(_segments(open_rows, conv_type, turn_type), "segments")
    chained = stored(_chained(segments, conv_type), "chained")
    right = segments.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "audits")
    met = chained.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    audit = F.col("audits")[F.col("start") * len(STATES) + F.col("end")]
    ending = F.array(*map(F.lit, ENDING))[F.col("end")]
    chosen = met.select("conv_id", "part", "start", *COUNTS,
                        F.when(F.col("last"), F.concat(audit, ending)).otherwise(audit).alias("audit"))
    chosen = stored(chosen, "chosen")
    schema = f"conv_id {conv_type}, part long, turns {TURNS}"

    def rendered(key, rows: pa.Table, choice: pa.Table) -> pa.Table:
        given = sorted(rows.to_pylist(), key=lambda r: r["pos"])
        choice = choice.to_pylist()[0]
        turns = render(choice["audit"], ((r["role"], r["text"]) for r in given), choice["start"])
        return pa.Table.from_pylist([{"conv_id": choice["conv_id"], "part": choice["part"], "turns": turns}],
                                    schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    keys = ["conv_id", "part"]
    rows = open_rows.where("live").select("conv_id", F.shiftright("pos", ROW_BITS).alias("part"), "pos", "role", "text")
    pieces = rows.groupBy(*keys).cogroup(chosen.select(*keys, "start", "audit").groupBy(*keys)).applyInArrow(
        rendered, schema)
    both = chosen.select(*keys, *COUNTS, "audit").unionByName(pieces, allowMissingColumns=True).unionByName(
        open_rows.select("conv_id").distinct(), allowMissingColumns=True)
    turns = F.sort_array(F.collect_list(F.when(F.col("turns").isNotNull(), F.struct("part", "turns"))))
    audits = F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))
    return both.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in COUNTS),
        F.array_join(audits["audit"], "").alias("audit"), F.flatten(turns["turns"]).alias("turns"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns), one per conversation.

    ``rows`` are (conv_id, turn, role, text, live); rows that are not live only name their
    conversation. A conversation's rows are taken by turn, nulls first, those of a turn by role and
    text. A row's first fault counts: blank (nothing but white space), duplicate (role and text
    seen earlier in the conversation), truncated (the last character is not one of ``.!?``).
    ``gaps`` are numbers without a row between the least and the largest turn, ``illegal``
    adjacent rows whose roles' initials are not su, ua or au.

    ``turns`` are the cheapest repair whose initials read ``(s?(ua)+)?``: keeping a row costs 0,
    giving it the role that is due 2, deleting it 3 (blank and duplicate rows have to be), inserting
    an empty row of the role that is due 2, and a truncated row that stays 1 more. ``audit`` holds
    the initials of the edits in order; of equally cheap ones it is ASCII-least. Roles count by
    their first letter; others than s, u and a cannot be kept.

    Null ids name one conversation. Equal rows are in any order, which changes nothing. An empty
    table gives an empty result. Other columns are left out. The result of a conversation is one
    row, but its rows are searched where they lie: see ``_in_order`` and ``_chained``.
    """
    types = dict(rows.dtypes)
    conv_type, turn_type = types["conv_id"], types["turn"]
    found = stored(_in_order(rows.select("conv_id", "turn", "role", "text", "live"), conv_type, turn_type), "in_order")
    columns = ["conv_id", *COUNTS, "audit", "turns"]
    whole = found.where("pos is null").select(*columns)
    parts = found.where("pos is not null").select("conv_id", "pos", "turn", "role", "text", "live")
    return whole.unionByName(_open_results(parts, conv_type, turn_type).select(*columns))


def turns_text(turns: Column) -> Column:
    """Turns as ``role:text``, joined by line breaks."""
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
