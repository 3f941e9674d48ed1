"""Byte-pair encoding by speculation: greedy words, checked pairs, exact merging where a check fails."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dimlens.llm.storage import texts

#: Words remembered by one Python worker; the memory starts anew when it is full. And how many marks
#: tell words that came up before.
REMEMBERED = 600_000
SEEN = 1 << 23
#: Checked pairs remembered by one Python worker; their memory starts anew as well.
PAIRS = 2_000_000
#: Stand for the end of a word: no byte of a text in UTF-8, and no letter that stands for a byte.
END = b"\xff"
STOP = "\x01"
#: Code points of the texts whose words are verified together.
BATCH_CHARS = 4_000_000
#: White space that str.split() and the pattern's \s do not agree on.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters outside ranges that all versions of Unicode class, compose and lower-case alike. Texts
#: that hold any are normalised, and their words found, by the tokenizer's own first steps.
COMMON_LETTERS = "\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
RARE = re.compile(f"[^\x00-\u024f{COMMON_LETTERS}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordCodec:
    """Vocabulary, merges and the tables of checked pairs of one tokenizer file.

    Handles files of byte-level BPE over words with a suffix at the end of each word, lower-cased
    text and white space dropped.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.ids = model["vocab"]
        self.letters = byte_letters()
        self.byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.tokens = np.full(1 + max(chain(self.ids.values(), (t["id"] for t in spec["added_tokens"]))),
                              "", dtype=object)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        # The library that merges knows no word ends: the byte END, which no text holds, stands for
        # one, and joining it to the last byte of a word comes before all merges.
        bases = [i for i, t in enumerate(self.tokens) if t and len(t.removesuffix(self.suffix)) == 1
                 and t not in self.special]
        bases.sort(key=lambda i: self.tokens[i].endswith(self.suffix) and self.tokens[i] != self.suffix)
        self.of_rank = [*bases, *(self.ids[a + b] for a, b in model["merges"])]
        self.bytes_of = {i: self._bytes(self.tokens[i]) for i in self.of_rank}
        self.merger = tiktoken.Encoding(
            "merges", pat_str=r"[\s\S]+", special_tokens={},
            mergeable_ranks={self.bytes_of[i]: r for r, i in enumerate(self.of_rank)})._encode_single_piece
        self._check_merges()
        self.rank_ids = np.array(self.of_rank, dtype=np.int32)
        self.longest, self.lengths = ahocorasick.Automaton(), np.zeros(len(self.tokens), dtype=np.int64)
        for i in self.of_rank:
            token = self.tokens[i]
            if token.endswith(self.suffix) and len(token) > len(self.suffix):
                token = token.removesuffix(self.suffix) + STOP
            self.longest.add_word(token, i)
            self.lengths[i] = len(token)
        self.longest.make_automaton()
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern["pattern"]["Regex"])
        self.path = path
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.chunks: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        self.token_array = pa.array(self.tokens, type=pa.string())
        self.pairs, self.stays = np.array([np.iinfo(np.int64).max]), np.array([False])

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _words(self, chunk: str) -> list[str]:
        """Words of a normalised chunk, a letter for each of their bytes."""
        if chunk.isascii() and chunk.isprintable():  # such bytes stand for themselves
            return [chunk] if chunk.isalpha() else self.pattern.findall(chunk)
        if RARE.search(chunk):
            return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
        return ["".join([self.letters[b] for b in w.encode()]) for w in self.pattern.findall(chunk)]

    def _bytes(self, letters: str, ended: bool = False) -> bytes:
        if letters.endswith(self.suffix) and len(letters) > len(self.suffix):
            letters, ended = letters.removesuffix(self.suffix), True
        return bytes([self.byte_of[x] for x in letters]) + (END if ended else b"")

    def _check_merges(self) -> None:
        """The library merges what is a token, whatever the pair; the file lists pairs. Both give the
        same if every token is what its own text merges to, which the file's order has to grant."""
        for rank, token in enumerate(self.of_rank):
            if self.merger(self.bytes_of[token]) != [rank]:
                raise ValueError(f"token {self.tokens[token]!r} is not what its own text merges to")

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of the lowest rank first, the leftmost of equal ones."""
        return [self.of_rank[r] for r in self.merger(word)]

    def _propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match from the left: tokens, the word of each, and which words they cover."""
        line = STOP.join(words) + STOP
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        matched = np.fromiter(chain.from_iterable(self.longest.iter_long(line)), dtype=np.int64).reshape(-1, 2)
        owner = np.searchsorted(stops, matched[:, 0])
        length = np.bincount(owner, weights=self.lengths[matched[:, 1]], minlength=len(words))
        return matched[:, 1], owner, length == np.diff(stops, prepend=-1)

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two adjacent tokens stay as they are when merged by themselves.

        A sequence of tokens is the exact encoding of its word if and only if every token is the
        encoding of its own text (``second`` is -1) and every adjacent pair that of its text: the
        first merge across a boundary would also happen with the two neighbours alone.
        """
        codes = (first.astype(np.int64) << 32) | (second.astype(np.int64) + 1)
        distinct, where = np.unique(codes, return_inverse=True)
        if len(self.pairs) > PAIRS:
            self.pairs, self.stays = self.pairs[-1:], self.stays[-1:]
        at = np.searchsorted(self.pairs, distinct)
        fresh = distinct[self.pairs[np.minimum(at, len(self.pairs) - 1)] != distinct]
        if len(fresh):
            stays = []
            for code in fresh.tolist():
                pair = [code >> 32] + ([(code & 0xFFFFFFFF) - 1] if code & 0xFFFFFFFF else [])
                stays.append(self.merge(b"".join(map(self.bytes_of.__getitem__, pair))) == pair)
            to = np.searchsorted(self.pairs, fresh)
            self.pairs, self.stays = np.insert(self.pairs, to, fresh), np.insert(self.stays, to, stays)
            at = np.searchsorted(self.pairs, distinct)
        return self.stays[at][where]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: proposed, verified all at once, and merged exactly where that fails."""
        flat, owner, good = self._propose(words)
        inner = owner[1:] == owner[:-1]
        good[owner[~self._compatible(flat, np.full(len(flat), -1))]] = False
        good[owner[:-1][inner][~self._compatible(flat[:-1][inner], flat[1:][inner])]] = False
        ends = 4 * np.searchsorted(owner, np.arange(len(words)), "right")
        ids = flat.astype(np.int32).tobytes()
        found = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        failed = np.flatnonzero(~good).tolist()
        merged = [self.merger(words[i].encode() + END if words[i].isascii() else self._bytes(words[i], ended=True))
                  for i in failed]
        ids = self.rank_ids[np.fromiter(chain.from_iterable(merged), dtype=np.int64)].tobytes()
        start = 0
        for i, ranks in zip(failed, merged, strict=True):
            found[i] = ids[start:start + 4 * len(ranks)]
            start += 4 * len(ranks)
        return found

    def _chunks_of(self, text: str) -> list[str]:
        """Parts that no word crosses: between white space, or the whole text where that is unsure."""
        if RARE.search(text):
            text = self.tokenizer.normalizer.normalize_str(text)
        else:
            text = text if text.isascii() else unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # each letter by itself, no final sigma
        return [text] if ODD_SPACE.search(text) else text.split()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        plain = [c for c in chunks if c.isalpha() and c.isascii()]  # words as they are
        rest = [(c, self._words(c)) for c in chunks.difference(plain)]
        distinct = list(dict.fromkeys(chain(plain, chain.from_iterable(w for _, w in rest))))
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True)) if distinct else {}
        found = {c: ids[c] for c in plain}
        found.update((c, b"".join([ids[w] for w in words])) for c, words in rest)
        return found

    def _remember(self, fresh: dict[str, bytes]) -> None:
        """Keep what comes up a second time: most rare words never do."""
        for chunk, ids in fresh.items():
            bit = hash(chunk) & (len(self.seen) - 1)
            if self.seen[bit]:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks.clear()
                self.chunks[chunk] = ids
            else:
                self.seen[bit] = 1

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, 32 bits each; strings of special tokens are these tokens."""
        found: list[bytes] = []
        start = 0
        while start < len(batch):  # as many texts at once as BATCH_CHARS allows, one at least
            end, chars = start + 1, len(batch[start])
            while end < len(batch) and chars + len(batch[end]) <= BATCH_CHARS:
                chars += len(batch[end])
                end += 1
            found.extend(self._encode_some(batch[start:end]))
            start = end
        return found

    def _encode_some(self, batch: list[str]) -> list[bytes]:
        split, missing = [], set()
        for text in batch:
            parts = self.split_special.split(text) if any(s in text for s in self.special) else [text]
            for i, part in enumerate(parts):
                if i % 2 == 0:
                    chunks = self._chunks_of(part)
                    ids = list(map(self.chunks.get, chunks))
                    if None in ids:
                        missing.update([c for c, x in zip(chunks, ids, strict=True) if x is None])
                    parts[i] = (chunks, ids)
            split.append(parts)
        fresh = self._learn(missing) if missing else {}
        found = []
        for parts in split:
            for i, part in enumerate(parts):
                if i % 2:
                    parts[i] = array("i", [self.special[part]]).tobytes()
                else:
                    chunks, ids = part
                    parts[i] = b"".join([fresh[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
                                        if None in ids else ids)
            found.append(b"".join(parts))
        self._remember(fresh)
        return found

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by a space, as a file without a decoder has it."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.cumsum([0, *sizes], dtype=np.int32))
        words = pa.ListArray.from_arrays(ends, self.token_array.take(ids.flatten()))
        return pc.if_else(pc.is_null(ids), None, pc.binary_join(words, " "))


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def _encoded(column: pa.Array, path: str) -> pa.ListArray:
    words, parts, sizes = codec(path), [], [0]
    for i in range(0, len(column), 512):
        ids = words.encode_batch([t or "" for t in column.slice(i, 512).to_pylist()])
        sizes.extend(len(x) // 4 for x in ids)
        parts.append(b"".join(ids))
    flat = np.frombuffer(b"".join(parts), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(flat))


def _decoded(column: pa.ListArray, path: str) -> pa.Array:
    parts = [codec(path).decode(column.slice(i, 512)) for i in range(0, len(column), 512)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())


def encode(text: Column, path: str) -> Column:
    """Array of ids for a column of texts; a null text is an empty one. The file must be on every executor."""
    @F.arrow_udf("array<int>")
    def encoded(column: pa.Array) -> pa.Array:
        return _encoded(column, path)

    return encoded(text)


def decode(ids: Column, path: str) -> Column:
    """Text of a column of id arrays; null for null. Ids outside the vocabulary raise."""
    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return _decoded(column, path)

    return decoded(ids)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): every whole text encoded, and its ids decoded again.

    One row per row of documents. Null and empty texts, and texts of white space, have no ids and
    decode to an empty text. Texts are encoded where they are, once, and nothing is shuffled.
    """
    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(column: pa.Array) -> pa.Array:
        ids = _encoded(column, path)
        return pa.StructArray.from_arrays([ids, _decoded(ids, path)], names=["ids", "decoded"])

    return texts(documents).select("doc_id", both("text").alias("coded")).select("doc_id", "coded.*")
