"""Passages repeated across documents, removed everywhere but at their first place."""

from __future__ import annotations

import functools
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimlens.llm.membership import separated
from dimlens.llm.storage import stored, texts

#: Words whose hash ranks them as a window's minimiser.
MINIMISER = 3
#: Bytes of text that a worker looks at together, and bytes that are hashed together.
SLICE, HASHED = 2 << 20, 1 << 20
#: Bytes of text for each bucket, how many buckets there are at most, and how many strings fill one.
BUCKET_BYTES, MOST_BUCKETS, FULL = 1 << 19, 1_000_000, 16384
#: Odd 64-bit constants that mix bits of hashes (any would do).
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _SHIFT)) * _B
    return values ^ (values >> _SHIFT)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd constant and of its inverse modulo 2**64."""
    out = []
    for base in (int(_A), pow(int(_A), -1, 1 << 64)):
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte string start and end."""
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edges[0::2], edges[1::2]


def _word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word by its bytes alone, few bytes at a time."""
    raw, out, at = np.frombuffer(data, dtype=np.uint8), np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASHED)))
        a, b = start[at], end[to - 1]
        powers, inverses = _powers(max(HASHED, 1 << int(b - a).bit_length()))
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * powers[:b - a], out=sums[1:])
        out[at:to] = (sums[end[at:to] - a] - sums[start[at:to] - a]) * inverses[start[at:to] - a]
        at = to
    return _mixed(out)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words from those of words, spans doubled and joined."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out, have, span, size = None, 0, hashes, 1
    while True:
        factor = np.uint64(pow(int(_A), size, 1 << 64))
        if n & size:
            many = len(hashes) - have - size + 1
            out = span[:many] if out is None else out[:many] * factor + span[have:have + many]
            have += size
        if have == n:
            return _mixed(out)
        span, size = span[:-size] * factor + span[size:], size * 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``new[i]`` tells whether one starts at i."""
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def _super_windows(data: bytes, window: int) -> tuple[np.ndarray, ...]:
    """(line, first word in it, windows, minimiser, start byte, end byte) of a text's super-windows.

    Lines are documents, or parts of one. Consecutive windows of a line whose minimisers are equal
    are one super-window. The minimiser is the least hash of any few consecutive words in it.
    """
    start, end = _words(data)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), start)
    none = np.empty(0, np.int64)
    if len(start) < window:
        return none, none, none, none.view(np.uint64), none, none
    grams = min(MINIMISER, window)
    minimiser = _least(_grams(_word_hashes(data, start, end), grams), window - grams + 1)
    whole = np.flatnonzero(line[:len(minimiser)] == line[window - 1:])
    if not len(whole):
        return none, none, none, none.view(np.uint64), none, none
    first, count = _runs(np.concatenate([[True], (np.diff(whole) != 1) | (np.diff(line[whole]) != 0)
                                         | (minimiser[whole][1:] != minimiser[whole][:-1])]))
    at = whole[first]
    return (line[at], at - np.searchsorted(line, line[at]), count, minimiser[at],
            start[at], end[at + count + window - 2])


KEY = np.dtype([("known", "i1"), ("doc_id", "<i8"), ("content", "<i8"), ("start", "<i8")])


def _packed(keys: np.ndarray, lines: list[bytes], repeats: np.ndarray) -> bytes:
    """Super-windows and where they start, and repeats (key and windows) found already, as one string."""
    head = struct.pack("<II", len(keys), len(repeats))
    return zstandard.ZstdCompressor(level=1).compress(
        head + keys.tobytes() + repeats.tobytes() + b"\n".join(lines))


REPEAT = np.dtype([("key", KEY), ("n", "<i8")])


def _unpacked(blob: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<II", raw)
    at = 8 + n * KEY.itemsize
    to = at + m * REPEAT.itemsize
    return (np.frombuffer(raw, KEY, n, 8), raw[to:].split(b"\n") if n else [], np.frombuffer(raw, REPEAT, m, at))


def _pieces(text: bytes, window: int) -> Iterator[tuple[int, bytes]]:
    """(words before it, text): a very long text in parts; each starts with the words that windows share."""
    at, words, shared = 0, 0, []
    while True:
        found = _BLANK.search(text, at + SLICE) if at + SLICE < len(text) else None
        cut = found.start() if found else len(text)
        own = [*shared, *text[at:cut].split()]
        yield words, b" ".join(own)
        if cut == len(text):
            return
        shared = own[max(0, len(own) - window + 1):]
        words, at = words + len(own) - len(shared), cut


def _slices(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """(key of each line, lines): documents of (doc_id, content, text), some at a time, in order of their keys."""
    for batch in batches:
        known = np.asarray(batch["doc_id"].is_valid())
        ids = np.asarray(batch["doc_id"].fill_null(0), dtype=np.int64)
        content = np.asarray(batch["content"])
        keys, lines, size = [], [], 0
        for i in np.lexsort((content, ids, known)):
            for words, line in _pieces(batch["text"][i].as_py().encode(), window):
                keys.append((known[i], ids[i], content[i], words))
                lines.append(line)
                size += len(line) + 1
                if size >= SLICE:
                    yield np.array(keys, KEY), b"\n".join(lines)
                    keys, lines, size = [], [], 0
        if keys:
            yield np.array(keys, KEY), b"\n".join(lines)


def _bucket_of(minimisers: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(minimisers) % np.uint64(buckets)).astype(np.int64)


def _bucket_sizes(words: DataFrame, window: int, buckets: int) -> dict[int, int]:
    """Buckets that get over twice their fill, with how many groups they are split into.

    Every task counts its super-windows per bucket. There are at most a million buckets, so that
    the counts are few whatever the input.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for _, data in _slices(batches, window):
            minimisers = _super_windows(data, window)[3]
            counts += np.bincount(_bucket_of(minimisers, buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    sizes = stored(words.mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "sizes")
    full = max(FULL, 2 * (sizes.agg(F.sum("n")).first()[0] or 0) // buckets)
    return {r["bucket"]: -(-r["n"] // full) for r in sizes.where(F.col("n") > 2 * full).collect()}


def _dealt(data: bytes, keys: np.ndarray, window: int, buckets: int, split: dict[int, int]) -> Iterator[tuple]:
    """(bucket, part, packed string): the super-windows of some lines for each bucket.

    Equal super-windows among the lines travel once: all but the first are known as repeats.
    """
    line, word, count, minimiser, start, end = _super_windows(data, window)
    own = keys[line]
    own["start"] += word
    bucket = _bucket_of(minimiser, buckets)
    part = np.zeros(len(bucket), dtype=np.int64)
    if split:
        groups = np.array([split.get(b, 1) for b in bucket.tolist()], dtype=np.uint64)
        spread = _mixed(own["content"].view(np.uint64) + own["start"].view(np.uint64) * _A)
        part = (spread % groups).astype(np.int64)
    first: dict[bytes, int] = {}
    strings = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    leader = np.fromiter((first.setdefault(s, i) for i, s in enumerate(strings)), np.int64, len(strings))
    alone = leader == np.arange(len(strings))
    # Rows that are equal as a whole are one document: they repeat nothing of each other.
    twin = ~alone & (own == own[leader])
    order = np.lexsort((part, bucket))
    begin, size = _runs(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(part[order]) != 0)]))
    for a, n in zip(begin.tolist(), size.tolist(), strict=True):
        group = order[a:a + n]
        sent, known = group[alone[group]], group[~alone[group] & ~twin[group]]
        repeats = np.empty(len(known), REPEAT)
        repeats["key"], repeats["n"] = own[known], count[known]
        yield bucket[group[0]], part[group[0]], _packed(own[sent], [strings[i] for i in sent.tolist()], repeats)


def _repeated(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """What a group's windows tell: runs that start earlier elsewhere, and those that do not.

    Returns the runs (key and number of windows), and key, hash and words of the first of all equal
    windows. Windows are sorted by a hash in the order of their keys; those with equal hashes are
    told apart by their words.
    """
    parts = [_unpacked(blob) for blob in blobs]
    keys, lines = np.concatenate([p[0] for p in parts]), list(itertools.chain(*(p[1] for p in parts)))
    order = np.lexsort([keys[f] for f in reversed(KEY.names)])
    keys, data = keys[order], b"\n".join([lines[i] for i in order.tolist()])
    start, end = _words(data)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), start)
    hashes = _grams(_word_hashes(data, start, end), window)
    whole = np.flatnonzero(line[:len(hashes)] == line[len(line) - len(hashes):])
    owner, hashes, begin, stop = line[whole], hashes[whole], start[whole], end[whole + window - 1] if len(whole) else whole
    own = keys[owner]
    own["start"] += whole - np.searchsorted(line, owner)
    leader, order = np.arange(len(whole)), np.argsort(hashes, kind="stable")
    if len(whole):
        runs, sizes = _runs(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        for a, n in zip(runs[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            same, first = order[a:a + n], {}
            places = zip(same.tolist(), begin[same].tolist(), stop[same].tolist(), strict=True)
            leader[same] = [first.setdefault(data[b:e], i) for i, b, e in places]
    fresh = leader == np.arange(len(whole))
    found = np.flatnonzero(~fresh & (own != own[leader]))
    follows = (np.diff(found) == 1) & (owner[found][1:] == owner[found][:-1])
    at, n = _runs(np.concatenate([[True], ~follows])) if len(found) else (found, found)
    repeats = np.empty(len(at), REPEAT)
    repeats["key"], repeats["n"] = own[found[at]], n
    return (np.concatenate([repeats, *(p[2] for p in parts)]), own[fresh], hashes[fresh],
            [data[a:b] for a, b in zip(begin[fresh].tolist(), stop[fresh].tolist(), strict=True)])


RUNS = "doc_id long, content long, start long, n long, bucket long, blob binary"
_RUNS = pa.schema([*((n, pa.int64()) for n in ("doc_id", "content", "start", "n", "bucket")), ("blob", pa.binary())])


def _runs_table(repeats: np.ndarray, later: list[tuple[int, bytes]]) -> pa.Table:
    key, nulls = repeats["key"], len(later)
    columns = [pa.array(key["doc_id"], mask=key["known"] == 0), *(pa.array(key[c]) for c in ("content", "start")),
               pa.array(repeats["n"])]
    columns = [pa.concat_arrays([c, pa.nulls(nulls, c.type)]) for c in columns]
    bucket, blob = (pa.array([None] * len(repeats) + [r[i] for r in later], type=t)
                    for i, t in ((0, pa.int64()), (1, pa.binary())))
    return pa.Table.from_arrays([*columns, bucket, blob], schema=_RUNS)


def repeated_windows(documents: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, content, runs): for each document, where windows start that also start earlier.

    A window is ``window`` consecutive words of one document; earlier is a smaller doc_id, or an
    earlier start in the same document. ``runs`` are (start, n): n windows from word ``start`` on.
    ``content`` is a hash of the text: rows that share a doc_id are ordered by it, equal rows are
    one document, and rows without a doc_id come before all others.

    Consecutive windows whose minimiser is the same travel as one string to the minimiser's bucket,
    about three times the text in all, compressed by bucket. There all windows are sorted; each
    meets every equal one, as equal windows have equal minimisers. A bucket that a frequent passage
    overfills is split by place; the first of equal windows in each part then meets those of the
    other parts in a second round, by its own hash.
    """
    words = texts(documents).select(F.col("doc_id").cast("long").alias("doc_id"),
                                    F.xxhash64("text").alias("content"), "text")
    size = words.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, size // BUCKET_BYTES))
    split = _bucket_sizes(words, window, buckets)
    second = max(1, 4 * sum(split.values()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data in _slices(batches, window):
            rows = list(zip(*_dealt(data, keys, window, buckets, split), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["bucket", "part", "blob"])

    def resolve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        repeats, keys, hashes, lines = _repeated(table["blob"].to_pylist(), window)
        later = []
        if key[0].as_py() in split and len(lines):
            bucket = _bucket_of(hashes, second)
            order = np.argsort(bucket, kind="stable")
            begin, size = _runs(np.concatenate([[True], np.diff(bucket[order]) != 0]))
            for a, n in zip(begin.tolist(), size.tolist(), strict=True):
                group = order[a:a + n]
                later.append((int(bucket[group[0]]), _packed(keys[group], [lines[i] for i in group.tolist()],
                                                             np.empty(0, REPEAT))))
        return _runs_table(repeats, later)

    def resolve_again(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _runs_table(_repeated(table["blob"].to_pylist(), window)[0], [])

    dealt = words.mapInArrow(deal, "bucket long, part long, blob binary")
    found = stored(dealt.groupBy("bucket", "part").applyInArrow(resolve, RUNS), "runs")
    runs = found.where("blob is null")
    if split:
        runs = runs.unionByName(found.where("blob is not null").groupBy("bucket").applyInArrow(resolve_again, RUNS))
    return runs.groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


RESULT = "struct<n_words:long,n_removed:long,text:string>"


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """The documents without words that a repeated window covers; see ``repeated_windows``.

    One row per row of documents, with all its columns: ``text`` holds the words left, joined by one
    space, ``n_words`` and ``n_removed`` replace columns of these names. Words are what stands
    between blanks (space and \\t to \\r). Windows are judged on the input, not on what is left. A
    null or empty text has no words, a text shorter than a window keeps all of them. An empty table
    gives an empty result.
    """
    runs = stored(repeated_windows(documents, window), "repeated")

    @F.arrow_udf(RESULT)
    def kept(texts_: pa.Array, runs_: pa.Array) -> pa.Array:
        counts, removed, out = [], [], []
        for text, found in zip(texts_, runs_, strict=True):
            words = text.as_py().encode().split()
            counts.append(len(words))
            left = words
            if found.is_valid:
                runs = found.values
                at, n = (np.asarray(runs.field(f)) for f in ("start", "n"))
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, at + n + window - 1, -1)
                left = list(itertools.compress(words, np.cumsum(depth) == 0))
            removed.append(len(words) - len(left))
            out.append(b" ".join(left).decode())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
            names=["n_words", "n_removed", "text"])

    def content(prefix: str) -> Column:
        return F.xxhash64(F.coalesce(F.col(f"{prefix}text"), F.lit("")))

    # Only documents that lose a word move to meet their runs, and the few that are taken for such.
    losing, whole = separated(documents, lambda p: F.xxhash64(F.col(f"{p}doc_id").cast("long"), content(p)),
                              runs.select(F.xxhash64("doc_id", "content").alias("hash")))
    here = F.col("d.doc_id").cast("long").eqNullSafe(F.col("r.doc_id")) & (content("d.") == F.col("r.content"))
    # Given columns are numbered in between, so that none of them meets a name of ours.
    given = [c for c in documents.columns if c not in ("text", "n_words", "n_removed")]

    def result(rows: DataFrame, found: Column) -> DataFrame:
        numbered = rows.select(*(F.col(f"d.`{c}`").alias(f"_{i}") for i, c in enumerate(given)),
                               kept(F.coalesce(F.col("d.text"), F.lit("")), found).alias("kept"))
        names = {c: F.col(f"_{i}") for i, c in enumerate(given)} | {"text": F.col("kept.text")}
        return numbered.select(*(names[c].alias(c) for c in documents.columns if c in names),
                               "kept.n_words", "kept.n_removed")

    met = losing.alias("d").join(runs.alias("r"), here, "left")
    return result(met, F.col("r.runs")).unionByName(
        result(whole.alias("d"), F.lit(None).cast(runs.schema["runs"].dataType)))
