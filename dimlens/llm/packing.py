"""Best-fit packing of token pieces, after a reduction by dominance."""

from __future__ import annotations

import itertools
import json
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dimlens.llm.bpe import COMMON_LETTERS, RARE, byte_letters
from dimlens.llm.storage import stored, texts

#: Fixed value: how byte-level BPE splits text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same words where white space does not pile up.
PLAIN_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""
#: Uncommon letters, or white space of other kinds than spaces and line breaks.
UNUSUAL = re.compile(f"[^\x00-\x08\n\x0e-\x1b\x20-\x84\x86-\x9f\xa1-\u024f{COMMON_LETTERS}]")
#: Spaces and line breaks that pile up: three in a row, or two at the end. The pairs are a quick sign
#: that they might.
PILED_SPACE = re.compile(r"[ \n]{3}|[ \n]{2}\Z")
PAIRS = ("  ", "\n\n", " \n", "\n ")
#: The id at the end of every document.
END = bytes(4)
#: Texts whose pieces a worker hands on together.
SENT = 512


class ByteCodec:
    """Encodes with the vocabulary of a byte-level BPE file, to little-endian unsigned 32-bit ids.

    Texts of common letters are encoded by a faster library with the same ranks; where white space
    does not pile up, with a form of the word pattern that looks neither ahead nor back. Texts with
    uncommon letters or the string of a special token go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(byte_of[x] for x in token): i for token, i in spec["model"]["vocab"].items()}
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole, self.plain = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                                  .encode_ordinary for p in (WORDS, PLAIN_WORDS))

    @cached_property
    def exact(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        unusual = UNUSUAL.search(text)
        if unusual and RARE.search(text) or any(s in text for s in self.special):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        elif unusual or any(p in text for p in PAIRS) and PILED_SPACE.search(text):
            ids = self.whole(text)
        else:
            ids = self.plain(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def token_pieces(documents: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every whole text and the end id, cut.

    ``ids`` holds little-endian unsigned 32-bit ids. A document of more than ``capacity`` ids is
    cut into pieces of that many; only its first piece may be shorter. A null or empty text is the
    end id alone. One set of pieces per row of documents. The file must be on every executor.
    """
    rows = texts(documents)
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(
        "piece int, start long, length long, ids binary")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = codec(path).encode, 4 * capacity
        for batch in batches:
            for at in range(0, len(batch), SENT):  # few texts' ids are held at a time
                part = batch.slice(at, SENT)
                owner, piece, start, ids = [], [], [], []
                for row, text in enumerate(part["text"]):
                    whole = encode(text.as_py()) + END
                    cuts = [0, *range(len(whole) % size or size, len(whole), size), len(whole)]
                    owner += [row] * (len(cuts) - 1)
                    piece += range(len(cuts) - 1)
                    start += [c // 4 for c in cuts[:-1]]
                    ids += [whole[a:b] for a, b in itertools.pairwise(cuts)]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary())], names=schema.names)
                pa.default_memory_pool().release_unused()

    return rows.mapInArrow(cut, schema)


class Filled(NamedTuple):
    """``bins`` bins of the same content: (length, copies) one after another."""

    content: tuple[tuple[int, int], ...]
    bins: int


def _best_pair(lengths: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two items of the largest sum that fits, larger first; of equal sums the widest apart."""
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[j], lengths[i]
        if a + b > room or (i == j and left[a] < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Filled], dict[int, int]]:
    """Bins that some best packing holds, and the items that remain.

    From the longest item on, an item is fixed with a set of at most two others when that set
    dominates every other set that could share its bin: when nothing fits beside it; when only one
    more fits, with the longest that does; when the longest that fits leaves no room, or is at
    least as long as the best two that fit; and when just two fit, the longest among them, and no
    two items longer than the shorter one do. Copies of a length are fixed at once.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed = []
    for n in sorted(left, reverse=True):
        while left.get(n):
            own = left.pop(n)
            if own > 1:
                left[n] = own - 1
            room, lengths = capacity - n, sorted(left)
            small, total = 0, 0
            for m in lengths[:3]:  # how many of the shortest fit beside it, three standing for more
                for _ in range(min(left[m], 3 - small)):
                    if small < 3 and total + m <= room:
                        total, small = total + m, small + 1
            others: tuple[int, ...] | None = None
            if small == 0:
                others = ()
            else:
                longest = lengths[bisect_left(lengths, room + 1) - 1]
                pair = _best_pair(lengths, left, room) if small == 2 else None
                if small == 1 or longest == room or (pair and longest >= sum(pair)):
                    others = (longest,)
                elif pair and pair[0] == longest:
                    above = [m for m in lengths[bisect_left(lengths, pair[1] + 1):][:2]
                             for _ in range(min(2, left[m]))][:2]
                    if len(above) < 2 or sum(above) > room:
                        others = pair
            left[n] = own
            if others is None:
                break
            needed = {m: (n, *others).count(m) for m in (n, *others)}
            times = min(left[m] // c for m, c in needed.items())
            for m, c in needed.items():
                left[m] -= times * c
                if not left[m]:
                    del left[m]
            fixed.append(Filled(tuple((m, c) for m, c in needed.items()), times))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Filled]:
    """Longest first, each item into the fullest bin that it fits; alike bins are filled together."""
    rooms: list[int] = []
    open_bins: dict[int, list[Filled]] = {}

    def put(room: int, bins: Filled) -> None:
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append(bins)

    for n in sorted(counts, reverse=True):
        count = counts[n]
        at = bisect_left(rooms, n)
        while count and at < len(rooms):
            room = rooms[at]
            bins = open_bins[room].pop()
            each = min(room // n, count)
            used = min(bins.bins, count // each)
            count -= used * each
            if bins.bins > used:
                open_bins[room].append(Filled(bins.content, bins.bins - used))
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            put(room - each * n, Filled((*bins.content, (n, each)), used))
            at = bisect_left(rooms, n)
        each = capacity // n
        if count // each:
            put(capacity - each * n, Filled(((n, each),), count // each))
        if count % each:
            put(capacity - count % each * n, Filled(((n, count % each),), 1))
    return [b for bins in open_bins.values() for b in bins]


def plan(counts: dict[int, int], capacity: int) -> list[Filled]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def _places(filled: Iterable[Filled]) -> dict[str, np.ndarray]:
    """For runs of the ranks of a length: the first sequence, copies in each, and their offset."""
    rows, next_rank, sequence = [], {}, 0
    for content, bins in filled:
        offset = 0
        for n, copies in content:
            rank = next_rank.get(n, 0)
            next_rank[n] = rank + copies * bins
            rows.append((n, rank, sequence, copies, offset))
            offset += n * copies
        sequence += bins
    rows.sort()
    names = ("length", "rank", "sequence", "copies", "offset")
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(names)}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset: as few sequences of at most ``capacity`` as it can.

    ``pieces`` has a column length from 1 to ``capacity``; all its columns are kept, but for
    sequence_id and offset, which are replaced. Packing needs only how many pieces have each
    length, so the plan is made from at most ``capacity`` counts and has at most a few bins' kinds
    per length, whatever the number of pieces. Each piece is then placed by its rank among those
    of its length: its rank in its own stored part after the counts of earlier parts, so that a
    frequent length is never in one task. An empty table gives an empty result.
    """
    numbered = stored(pieces.drop("sequence_id", "offset").withColumn("_part", F.spark_partition_id())
                      .withColumn("_row", F.monotonically_increasing_id()), "pieces")
    by_part = stored(numbered.groupBy("length", "_part").agg(F.count("*").alias("_n")), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if wrong := [n for n in counts if n is None or not 1 <= n <= capacity]:
        raise ValueError(f"piece lengths outside 1 to {capacity}: {wrong[:5]}")
    places = _places(plan(counts, capacity))
    before = by_part.select("length", "_part", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_row")) - 1
    ranked = numbered.withColumn("_rank", rank).join(stored(before, "before"), ["length", "_part"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), ranks.to_numpy()
        run = np.searchsorted(places["length"] * (1 << 44) + places["rank"], n * (1 << 44) + r, "right") - 1
        instance, copy = np.divmod(r - places["rank"][run], places["copies"][run])
        return pd.DataFrame({"sequence_id": places["sequence"][run] + instance,
                             "offset": places["offset"][run] + copy * n})

    placed = ranked.withColumn("_at", place("length", F.col("_rank") + F.col("_before")))
    return placed.select(*(c for c in pieces.columns if c not in ("sequence_id", "offset")),
                         "_at.sequence_id", "_at.offset")
