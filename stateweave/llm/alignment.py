"""Alignment of two tokenizers by pointer jumping.

Every text, with a space before it, is cut by a byte-level BPE (A) and by a piece model (B, which adds the space itself).
Over the bytes of a whole batch, every token points to its farthest-right overlapping token: the one of the other side
that holds its last byte, or itself if none reaches farther (of two tokens that end together A's points to B's). Doubling
the pointers, all tokens at once, ends at each component's terminal B token, which labels the groups; a batch takes as
many rounds as the logarithm of its longest chain.

The terminal tokens of a group end together: they are its link. Links are counted over the corpus in two groupings. Of two
tokens that end together one is a suffix of the other, so there are at most as many different pairs as bytes in the two
vocabularies (about half a million): that table, and nothing that grows with the corpus, goes to all tasks.

Defined results: texts that are null or empty, and texts whose tokens' bytes differ from the text's (a literal U+2581, an
unknown piece), have no tokens: zeros and an empty ``groups_sha256``; a null doc_id is kept; repeated rows count each; an
empty table gives none.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import Codec
from .common import map_rows, materialize
from .worker import shared

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
#: Texts that are aligned together.
ROWS = 256


class Vocabulary:
    """Bytes of each id, end to end, to check and measure sequences of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(ids) or not end[-1]:
            return b""
        return self.bytes[np.repeat(self.start[ids] - (end - size), size) + np.arange(end[-1])].tobytes()


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update((chr(0x100 + k), b) for k, b in enumerate(sorted(set(range(256)).difference(plain))))
    return out


class Tokenizers:
    """Both tokenizers with the bytes of their tokens.

    A text goes to A in units cut at spaces after text, which none of A's matches crosses (see ``byte_bpe.Codec.split``); the ids of
    known units come from a bounded memo.
    """

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, memo: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(public_tokenizers.path(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.units: dict[str, bytes] = {}
        self.limit = memo
        letters = byte_letters()
        entry = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))
        self.bytes_a = Vocabulary([entry(i) for i in range(self.a.get_vocab_size())])
        self.bytes_b = Vocabulary([self._piece(i) for i in range(self.b.get_piece_size())])

    def _piece(self, i: int) -> bytes:
        """No bytes for the unknown piece, so that its text counts as different."""
        name = self.b.id_to_piece(i)
        return b"" if self.b.IsUnknown(i) else bytes([int(name[3:5], 16)]) if self.b.IsByte(i) else name.replace("\u2581", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; two empty ones where there are no tokens to align."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        left = self._left(spaced)
        right = [np.asarray(e, np.int64) for e in self.b.encode([texts[k] for k in some], num_threads=1)]
        out = [none] * len(texts)
        for k, text, x, y in zip(some, spaced, left, right, strict=True):
            raw = text.encode()
            if self.bytes_a.joined(x) == raw and self.bytes_b.joined(y) == raw:
                out[k] = (x, y)
        return out


    def _left(self, texts: list[str]) -> list[np.ndarray]:
        units = self.units
        if len(units) > self.limit:
            units.clear()
        cut = []
        for text in texts:
            parts = Codec.split(text)
            parts[1:] = [" " + p for p in parts[1:]]
            cut.append(parts)
        new = list(set().union(*cut).difference(units))
        coded = self.a.encode_batch_fast(new, add_special_tokens=False)
        units.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(new, coded, strict=True))
        return [np.frombuffer(b"".join(map(units.__getitem__, parts)), "<u4").astype(np.int64) for parts in cut]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B, given where they end over the same bytes: the terminal B token of its component."""
    n = len(end_a)
    to_b = np.searchsorted(end_b, end_a)  # the B token that holds the last byte
    to_a = np.searchsorted(end_a, end_b)
    next_ = np.concatenate([n + to_b, np.where(end_a[to_a] > end_b, to_a, n + np.arange(len(end_b)))])
    while True:
        farther = next_[next_]
        if np.array_equal(farther, next_):
            return next_[:n] - n, next_[n:] - n
        next_ = farther


def worker_tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    """One pair of tokenizers, with its bounded memo, for all aligning tasks of a Python worker."""
    return shared(Tokenizers, byte_level, pieces)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of 0 to n - 1, a row each with room for a separator, and how many there are."""
    width = len(str(n))
    digits = np.zeros((n, width + 1), np.uint8)
    size = np.fromiter((len(str(i)) for i in range(n)), np.int64, n)
    for i in range(n):
        digits[i, : size[i]] = np.frombuffer(str(i).encode(), np.uint8)
    return digits, size


def spelled(ids: np.ndarray, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids in decimals, each with its mark behind it, as bytes; and where each ends."""
    digits, size = table[0][ids], table[1][ids]
    digits[np.arange(len(ids)), size] = marks
    return digits[np.arange(digits.shape[1]) <= size[:, None]], np.cumsum(size + 1)


def align(pairs: list[tuple[np.ndarray, np.ndarray]], bytes_a: Vocabulary, bytes_b: Vocabulary, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Groups of each text, the hashes of their spelling, and all links in order (A's id times 2^32 plus B's)."""
    a, b = (np.concatenate([p[k] for p in pairs]) for k in range(2))
    if not len(a):
        return np.zeros(len(pairs), np.int64), [""] * len(pairs), np.zeros(0, np.int64)
    end_a, end_b = np.cumsum(bytes_a.size[a]), np.cumsum(bytes_b.size[b])  # texts follow each other: all end on both sides
    last_a, last_b = terminals(end_a, end_b)
    last = last_b == np.arange(len(b))
    group_of = np.cumsum(last) - 1  # of terminal B tokens
    group_a, group_b = group_of[last_a], group_of[last_b]
    twin = np.searchsorted(end_a, end_b[last])  # A's token that ends with each terminal
    links = a[twin] << 32 | b[last]
    # a group's A tokens, then its B tokens
    before_b = np.cumsum(np.bincount(group_b)) - np.bincount(group_b)
    through_a = np.cumsum(np.bincount(group_a))
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + through_a[group_b]
    ids[place_a], ids[place_b] = a, b
    marks[place_a[twin]], marks[place_b[last]] = ord("|"), ord(";")
    raw, ends = spelled(ids, marks, table)
    tokens = np.cumsum([len(x) + len(y) for x, y in pairs])
    stop = np.concatenate(([0], ends))[tokens].tolist()
    hashes, at = [], 0
    for z in stop:
        hashes.append(hashlib.sha256(raw[at : z - 1]).hexdigest() if z > at else "")
        at = z
    groups = np.diff(np.concatenate(([0], np.cumsum(last)))[np.concatenate(([0], np.cumsum([len(y) for _, y in pairs])))])
    return groups, hashes, links


def groups(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and ``links`` (A's id times 2^32 plus B's) of every row."""

    def make():
        both = worker_tokenizers(byte_level, pieces)
        table = _decimals(max(len(both.bytes_a.size), len(both.bytes_b.size)))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = both.encode(batch.column("text").to_pylist())
            n, hashes, links = align(coded, both.bytes_a, both.bytes_b, table)
            counts = [[len(p[k]) for p in coded] for k in range(2)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(links))
            cols = [*(pa.array(c, pa.int64()) for c in (*counts, n, n)), pa.array(hashes, pa.string()), lists]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], [*NAMES, "links"])

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>", ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count) over all links; at most a row for each byte of the vocabularies."""
    return aligned.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))


def digest(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """A row for every row: counts, the groups' hash, and how its links stand in the corpus (n_best, count_sum)."""
    aligned = materialize(groups(docs, byte_level, pieces), "aligned")
    found = pair_counts(aligned).toArrow()
    pair, count = (np.asarray(found.column(k).combine_chunks()) for k in range(2))
    order = np.argsort(pair)
    pair, count = pair[order], count[order]
    right = pair & 0xFFFFFFFF
    most = np.zeros(int(right.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, right, count)
    best = (count == most[right]).astype(np.int64)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("links")
            ends = np.asarray(lists.offsets).astype(np.int64)
            at = np.searchsorted(pair, np.asarray(lists.values)[ends[0] : ends[-1]])
            sums = [np.diff(np.concatenate(([0], np.cumsum(x[at])))[ends - ends[0]]) for x in (best, count)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES), *map(pa.array, sums)], [*NAMES, "n_best", "count_sum"])

        return work

    out = map_rows(aligned, make, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long", 4096)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
