"""Byte-level BPE encoding and decoding by padded numpy matrices.

A text is cut into units at single spaces that follow a non-space (no match of the pattern crosses such a place); known
units come from a bounded memo. The pattern's matches in unknown units are encoded together: rows of bytes, bucketed by
length, in padded matrices. Each round every row merges its leftmost pair of least rank, looked up in a hashed pair table,
and is compacted; rows without a pair leave. Matches over ``LONG`` bytes are merged by the same order with a heap.

Defined results: null text is empty: no ids, hash of no bytes; a null doc_id is kept; repeated rows repeat; texts of any length are
encoded whole; an empty table gives none. Ids outside the vocabulary can't be decoded and raise.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKETS = (*range(1, 17), 20, 24, 32, 48, 64)
LONG = BUCKETS[-1]
#: The bucket of each length.
BUCKET_OF = [next(b for b in BUCKETS if n <= b) for n in range(LONG + 1)]
NONE = np.int32(2**31 - 1)
#: Every white-space character followed by a space: only there a space may belong to the match before it.
DOUBLE = tuple(c + " " for c in map(chr, range(0x3001)) if c.isspace())
MARKS = tuple(",.;:!?")
AFTER_TEXT = re.compile(r"(?<=\S) ")


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, shift = np.arange(len(keys)), np.uint64(0)
        slots, self.probes = self._slot(keys), 0
        while len(todo):
            self.probes += 1
            at = (slots[todo] + shift) & np.uint64((1 << self.bits) - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], merged[todo[put]]
            todo, shift = todo[~put], shift + np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair (the merged id), ``NONE`` if there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).ravel()
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + np.uint64(1)) & np.uint64((1 << self.bits) - 1)
            slots[open_] = at
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != np.uint64(2**64 - 1))]
        return out.reshape(left.shape)


class Codec:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str, pattern: str, memo: int = 300_000):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ranks, self.pattern, self.limit = ranks, regex.compile(pattern), memo
        self.of_last = None
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(np.array(left), np.array(right), np.array(merged, np.int32))
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.lengths = np.fromiter(map(len, parts), np.int64, size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.units: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def merge_long(self, piece: bytes) -> bytes:
        """Leftmost pair of least rank first, by a heap over a linked list."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs(np.array([a]), np.array([b]))[0])
            return known[a, b]

        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (s := rank(ids[k], ids[after[k]])) != NONE:
                    heapq.heappush(heap, (s, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge_bucket(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        joined = b"".join(pieces)
        if len(joined) < n * width:
            joined = b"".join([p.ljust(width, b"\0") for p in pieces])
        raw = np.frombuffer(joined, np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.of_byte[raw], -1).astype(np.int32)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        if self.of_last is not None:
            ids[rows, size - 1] = self.of_last[raw[rows, size - 1]]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = np.where(ids[:, 1:] >= 0, self.pairs(ids[:, :-1].clip(0), ids[:, 1:].clip(0)), NONE)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                raw, row = ids[done].astype("<u4").tobytes(), 4 * width
                for k, (i, m) in enumerate(zip(rows[done].tolist(), (4 * size[done]).tolist(), strict=True)):
                    out[i] = raw[k * row : k * row + m]
                keep = ~done
                rows, ids, ranks, size, at, least = rows[keep], ids[keep], ranks[keep], size[keep], at[keep], least[keep]
                if not len(rows):
                    return out
            k = np.arange(len(rows))
            take = column + (column > at[:, None])
            last = take >= width
            take[last] = width - 1
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[last], ranks[last] = -1, NONE
            ids[k, at] = least
            size -= 1
            right = ids[k, np.minimum(at + 1, width - 1)]
            has = (at + 1 < size)
            ranks[k, at] = np.where(has, self.pairs(least, right.clip(0)), NONE)
            prev = np.maximum(at - 1, 0)
            ranks[k, prev] = np.where(at > 0, self.pairs(ids[k, prev], least), ranks[k, prev])

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(BUCKET_OF[len(p)], []).append(i)
        for width, members in buckets.items():
            step = max(1, 400_000 // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self.merge_bucket([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    @staticmethod
    def split(text: str) -> list[str]:
        """Units whose matches don't depend on the text around them; all but the first begin with their space."""
        if any(d in text for d in DOUBLE if ord(d[0]) < 128) or not text.isascii() and any(d in text for d in DOUBLE):
            return AFTER_TEXT.split(text)
        return text.split(" ")

    def matches_of(self, unit: str) -> list[str]:
        """The pattern's matches in a unit; most are one word with or without a mark after it, which needs no regex."""
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha() and max(body) < "\u0250":
            return [unit]
        if body[-1:] in MARKS and body[:-1].isalpha() and max(body) < "\u0250":
            return [unit[:-1], unit[-1]]
        return self.pattern.findall(unit)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        units, matches = self.units, self.matches
        if len(units) > self.limit:
            units.clear()
        if len(matches) > self.limit:
            matches.clear()
        cut = []
        for text in texts:
            parts = self.split(text)
            parts[1:] = [" " + p for p in parts[1:]]
            cut.append(parts)
        new = set().union(*cut).difference(units)
        pieces = {u: self.matches_of(u) for u in new}
        fresh = list(set().union(*pieces.values()).difference(matches))
        matches.update(zip(fresh, self.merge_all([p.encode() for p in fresh]), strict=True))
        units.update((u, matches[p[0]] if len(p) == 1 else b"".join(map(matches.__getitem__, p))) for u, p in pieces.items())
        return [b"".join(map(units.__getitem__, parts)) for parts in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        if not len(ids):
            return b""
        size, start = self.lengths[ids], self.starts[ids]
        if (size == 0).any():
            raise ValueError("ids outside the vocabulary")
        end = np.cumsum(size)
        return self.bytes[np.repeat(start - (end - size), size) + np.arange(end[-1])].tobytes()


def make_codec(vocabulary: str = VOCABULARY) -> Codec:
    return Codec(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ``ids`` (array of int) of each row's text."""

    def make():
        codec = make_codec(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

        return work

    return map_rows(_rows(docs), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ``bytes`` of each row's ``ids``."""

    def make():
        codec = make_codec(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [codec.decode(np.asarray(x.values)) if x.is_valid else b"" for x in batch.column("ids")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

        return work

    return map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary")


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts and hashes of ids and of the bytes decoded from them, in one pass."""

    def make():
        codec = make_codec(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            out = [batch.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded])]
            out.append(pa.array([hashlib.sha256(codec.decode(np.frombuffer(c, "<u4"))).hexdigest() for c in coded]))
            return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_rows(_rows(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ``n_tokens`` of each row."""

    def make():
        codec = make_codec(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = codec.encode([t or "" for t in batch.column("text").to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(c) // 4 for c in coded], pa.int64())], ["doc_id", "n_tokens"])

        return work

    return map_rows(_rows(docs), make, "doc_id long, n_tokens long")
