"""Packing: sequences of at most 2048 tokens, planned by non-negative least squares on the length histogram.

Every document's ids (and an end id) are cut into windows of 2048 and a rest; the histogram of rests has at most 2047
bins whatever the corpus. Shallow combinations of lengths that fill a window are enumerated: all of 2 and 3 lengths, and of 4
to 8 those whose lengths but one are among the commonest (about ``COLUMNS`` for each number). Non-negative least squares finds
how often to repeat each, counts are rounded down, and what is left is packed best fit decreasing, by counts. The plan is a short list of runs: the pieces of a length with ranks
from..to go to consecutive sequences at one offset. Ranks come from counts by (task, length), so no task sees all pieces.

Defined results: null text is empty and gives its end id alone; a null doc_id stays null; repeated rows are packed each;
an empty table gives no piece.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import Codec, PairTable
from .common import map_rows, materialize
from .worker import shared

VOCABULARY = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
COLUMNS = 12_000
DEPTH = 8
#: Latin letters whose lower case is one letter, and a mark.
PLAIN = re.compile("([A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]{1,30})([.,;:!?]?)").fullmatch


class WordCodec:
    """Ids as the tokenizers library gives them, by a bounded memo of space-separated chunks.

    No match crosses ASCII white space. Plain Latin words are merged in padded matrices; any other chunk is left to the library.
    """

    def __init__(self, path: str, memo: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path) as file:
            model = json.load(file)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
        self.merger = Codec.__new__(Codec)
        self.merger.of_byte = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.merger.of_last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges])
        if not (np.diff(ids[:, 2]) > 0).all():
            raise ValueError("merged ids must follow the order of the merges")
        self.merger.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2].astype(np.int32))
        self.memo: dict[str, bytes] = {}
        self.limit = memo

    @staticmethod
    def plain(chunk: str) -> list[bytes] | None:
        """The pieces of a Latin word with or without a mark after it; None for any other chunk."""
        if m := PLAIN(chunk):
            return [m[1].lower().encode(), m[2].encode()] if m[2] else [chunk.lower().encode()]
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        # str.split also cuts at four control characters that the library keeps
        cut = [t.split() if not any(c in t for c in "\x1c\x1d\x1e\x1f") else t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*cut).difference(memo)
        new.discard("")
        memo[""] = b""
        pieces = {c: p for c in new if (p := self.plain(c))}
        fresh = list(set().union(*pieces.values()))
        known = dict(zip(fresh, self.merger.merge_all(fresh), strict=True))
        memo.update((c, known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p))) for c, p in pieces.items())
        odd = list(new.difference(pieces))
        if odd:
            coded = self.library.encode_batch_fast(odd, add_special_tokens=False)
            memo.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(odd, coded, strict=True))
        return [b"".join(map(memo.__getitem__, chunks)) for chunks in cut]


def word_codec(path: str) -> WordCodec:
    """One codec, with its bounded memo, for all packing tasks of a Python worker."""
    return shared(WordCodec, path)


PIECES = "part int, doc_id long, doc_tokens long, start long, length int, ids_crc32 long, rank long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """Pieces of each document, numbered within (task, length)."""

    def make():
        codec = word_codec(public_tokenizers.path(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), codec.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    size = min(window, n - at)
                    out.append((part, doc, n, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), int(seen[size])))
                    seen[size] += 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, PIECES, 1024)


def combinations(histogram: np.ndarray, window: int, columns: int = COLUMNS, depth: int = DEPTH) -> np.ndarray:
    """Distinct ascending rows of lengths of the histogram that fill a window exactly, padded with 0."""
    there = np.flatnonzero(histogram[:window] > 0)
    there = there[there > 0]
    a, b = np.meshgrid(there, there, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    parts = [np.column_stack([a, b])[a + b == window], np.column_stack([a, b, window - a - b])[window - a - b >= b]]
    common = there[np.argsort(-histogram[there], kind="stable")]
    for size in range(4, depth + 1):
        top = 1
        while top < len(common) and math.comb(top + size - 1, size - 1) <= columns:
            top += 1
        chosen = np.array(list(itertools.combinations_with_replacement(common[:top].tolist(), size - 1)), np.int64).reshape(-1, size - 1)
        parts.append(np.column_stack([chosen, window - chosen.sum(1)]))
    rows = []
    for part in parts:
        part = part[part[:, -1] > 0]
        part = part[histogram[part[:, -1]] > 0]
        part = np.sort(part, 1) if part.shape[1] < 4 else np.unique(np.sort(part, 1), axis=0)
        rows.append(np.hstack([np.zeros((len(part), depth - part.shape[1]), np.int64), part]))
    return np.concatenate(rows)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 120) -> np.ndarray:
    """x >= 0 that nearly minimises |Ax - histogram|, by accelerated projected gradients; A's columns count lengths."""
    rows, cols = combos.ravel(), np.repeat(np.arange(len(combos)), combos.shape[1])
    rows, cols = rows[rows > 0], cols[rows > 0]
    times = lambda x: np.bincount(rows, x[cols], len(histogram))
    back = lambda r: np.bincount(cols, r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, z - back(times(z) - histogram) / (1.01 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = nxt, nxt + (t - 1) / t2 * (nxt - x), t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Runs (length, from_rank, count, first_sequence, offset) that place every piece of ``histogram`` (index: length)."""
    left = histogram.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int, int]] = []
    used, sequences = np.zeros_like(left), 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), count, sequence, offset))
        used[length] += count
        left[length] -= count

    place(window, int(left[window]), 0, 0)
    sequences = int(histogram[window])
    combos = combinations(left[:window].clip(0), window)
    if len(combos):
        x = least_squares(combos, left[:window].astype(float))
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            lengths, counts = np.unique(combos[k][combos[k] > 0], return_counts=True)
            times = int(min(x[k] // 1, (left[lengths] // counts).min()))
            if times < 1:
                continue
            offset = 0
            for length in combos[k][combos[k] > 0]:
                place(int(length), times, sequences, offset)
                offset += int(length)
            sequences += times
    spaces: dict[int, list[tuple[int, int]]] = {}  # free tokens: (first sequence, how many)
    for length in range(window - 1, 0, -1):
        while left[length]:
            free = min((s for s in spaces if s >= length), default=window)
            first, many = spaces[free].pop() if free < window else (sequences, int(left[length]) // (window // length) or 1)
            if free < window and not spaces[free]:
                del spaces[free]
            if free == window:
                sequences += many
            count = min(many, int(left[length]))
            if count < many:
                spaces.setdefault(free, []).append((first + count, many - count))
            place(length, count, first, window - free)
            if free > length:
                spaces.setdefault(free - length, []).append((first, count))
    return np.array(runs, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """One row per piece, with its sequence and offset."""
    parts = materialize(pieces(docs, vocabulary, window), "pieces")
    counts = materialize(parts.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        histogram[length] = n
    runs = plan(histogram, window)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    runs = runs[runs[:, 2] > 0]
    span = int(histogram.max(initial=0)) + 1
    key = runs[:, 0] * span + runs[:, 1]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            length, rank = np.asarray(batch.column("length")).astype(np.int64), np.asarray(batch.column("rank"))
            run = runs[np.searchsorted(key, length * span + rank, "right") - 1]
            new = [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + new, [*names, "sequence_id", "offset"])

        return work

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = parts.join(firsts, ["part", "length"]).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("rank") + F.col("first")).alias("rank")
    )
    return map_rows(ranked, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", 50_000)
