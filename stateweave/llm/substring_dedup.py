"""Substring deduplication: passages of ``MIN_WORDS`` words or more that repeat, nearly, in an earlier document.

A text's tokens are its 5-word shingles (A-Z in lower case). For each of ``HASHES`` hash functions the compact windows are
the nodes of the Cartesian tree over the tokens' min-hashes that span ``SPAN`` tokens or more: all subsequences around a
node inside its span share its minimum as signature. Only positions that are the minimum of some ``SPAN`` tokens can be
such nodes, so the tree is built over these alone. A window has a key for each side on which the token ``ASIDE`` places from
its minimum lies in its span: the minimum with that token, so that a shared short line doesn't bring unlike passages
together. The document of least id with a key is the key's first; every other window with the key points to it. Windows of
the same two documents are joined into the interval within ``REACH`` of their minima, and the passages in it are verified on
all their tokens: runs of tokens that the first document has too, with Jaccard similarity ``SIMILARITY`` or more to the part
that they match.

Windows that lie in no passage found get finer keys, and so do all windows that share a key with them: first the tokens at
both ends of stretches of ``STRETCH`` tokens around the minimum with the minimum itself, then, for those still open, hashes
of all runs of ``SPAN`` tokens. Each finer key's windows are compared with its first document in turn. So a line that very
many documents share costs a comparison for each of its windows and keys, never one for each two documents.

A passage of ``MIN_WORDS`` words or more without an edit is found whatever other documents hold parts of it: its minimum is a
window, and a key of it, in both documents for every hash function (a span of ``SPAN`` tokens reaches ``ASIDE`` places to one
side at least), and if the key's first document has only a part, the passage's runs of ``SPAN`` tokens are keys that all
their holders share whole. An edited passage is found if the first document of one of its keys holds it; the share that is
found is measured in the README.

``repeats`` gives a row per repeated passage: doc_id, start_word, end_word (exclusive), n_words, first_doc_id and similarity.
``apply`` removes them and leaves first occurrences.

Defined results: null, empty and short texts repeat nothing; documents without an id take no part (and stay); repeats inside
one document, or between rows of one id, aren't reported; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, mix, shingles, small, spread_join, word_hashes

WIDTH = 5
MIN_WORDS = 50
SPAN = MIN_WORDS - WIDTH + 1
HASHES = 4
ASIDE = 12
REACH = 2 * SPAN
#: Finer keys: the length of a stretch of tokens around a minimum, and places of the minimum in it; a run of SPAN tokens holds one of them.
STRETCH, PLACES = 36, (0, 10, 20, 30, 35)
SIMILARITY = 0.8
#: A changed word leaves WIDTH tokens unmatched.
GAPS = (2 * WIDTH + 1, WIDTH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SALT = np.random.default_rng(5).integers(1, 2**63, HASHES, np.uint64)


#: Tokens of texts that are worked on together; a longer text goes alone.
TOGETHER = 16_384


def token_runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of many texts: numbers of some texts (those of ``MIN_WORDS`` words), their tokens in a row, and their ends there."""
    hashes, counts = word_hashes(texts)
    rows = np.flatnonzero(counts >= MIN_WORDS)
    every, stops = shingles(hashes, WIDTH), np.cumsum(counts)[rows]
    begins, stops = stops - counts[rows], stops - WIDTH + 1
    total = np.cumsum(stops - begins)
    a = 0
    while a < len(rows):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + TOGETHER, "right")))
        yield rows[a:b], np.concatenate([every[x:y] for x, y in zip(begins[a:b].tolist(), stops[a:b].tolist(), strict=True)]), total[a:b] - before
        a = b


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over each run of ``width`` along the last axis."""
    done = 1
    while 2 * done <= width:
        x = pick(x[..., :-done], x[..., done:])
        done *= 2
    return pick(x[..., : x.shape[-1] - (width - done)], x[..., width - done :]) if done < width else x


def spans(values: list[int], at: list[int], begin: int, end: int) -> tuple[list[int], list[int]]:
    """The span (first, last) in [begin, end) of each node of the Cartesian tree over positions ``at``; the left of equal values is higher."""
    first, last, stack = [begin] * len(at), [end - 1] * len(at), []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            last[stack.pop()] = at[k] - 1
        first[k] = at[stack[-1]] + 1 if stack else begin
        stack.append(k)
    return first, last


def compact_windows(seq: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of all hash functions' compact windows of a token sequence: function, keys (left, right), place, first and last.

    With ``ends`` the sequence is that of several texts, of ``SPAN`` tokens or more each, in a row; windows lie inside a text.
    """
    n = len(seq)
    if n < SPAN:
        return np.zeros(0, int), np.zeros((2, 0), np.uint64), *(np.zeros(0, int),) * 3
    ends = np.array([n]) if ends is None else ends
    values = (mix(seq[None, :] ^ _SALT[:, None]) >> np.uint64(32)).astype(np.uint32)
    least = sliding(values, SPAN, np.minimum)
    least[:, (ends[:-1, None] - np.arange(1, SPAN)).ravel()] = 0  # spans that go on in the next text
    pad = np.zeros((HASHES, SPAN - 1), np.uint32)
    k, at = np.nonzero(sliding(np.hstack([pad, least, pad]), SPAN, np.maximum) == values)
    heights, places = values[k, at].tolist(), at.tolist()
    cuts = np.searchsorted(k * n + at, (np.arange(HASHES)[:, None] * n + ends).ravel()).tolist()
    first, last, a = [], [], 0
    for b, begin, end in zip(cuts, np.tile(np.append(0, ends[:-1]), HASHES).tolist(), np.tile(ends, HASHES).tolist(), strict=True):
        lows, highs = spans(heights[a:b], places[a:b], begin, end)
        first += lows
        last += highs
        a = b
    first, last = np.array(first), np.array(last)
    wide = np.flatnonzero(last - first >= SPAN - 1)
    k, at, first, last = k[wide], at[wide], first[wide], last[wide]
    sides = seq[np.stack([at - ASIDE, at + ASIDE]).clip(0, n - 1)]
    return k, mix(mix(seq[at] + k.astype(np.uint64)) + mix(sides) * np.array([[3], [5]], np.uint64)), at, first, last


def _windows():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids = np.asarray(batch.column("doc_id"))
        with np.errstate(over="ignore"):
            for rows, seq, ends in token_runs(batch.column("text")):
                _, key, at, first, last = compact_windows(seq, ends)
                text = np.searchsorted(ends, at, "right")
                doc, place = ids[rows[text]], at - np.append(0, ends[:-1])[text]
                for side, inside in zip(key, (at - ASIDE >= first, at + ASIDE <= last), strict=True):
                    keys.append(side[inside]), docs.append(doc[inside]), places.append(place[inside])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "doc_id", "at"])

    return work


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sequences(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, seq): token sequences of the documents in ``ids`` as 32-bit values; of rows with one id, the longest."""
    ids = small(ids)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            seqs = [b""] * batch.num_rows
            for rows, seq, ends in token_runs(batch.column("text")):
                for k, part in zip(rows.tolist(), np.split((seq >> np.uint64(32)).astype(np.uint32), ends[:-1]), strict=True):
                    seqs[k] = part.tobytes()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(seqs, pa.binary())], ["doc_id", "seq"])

        return work

    return map_rows(_rows(docs).join(ids, "doc_id", "left_semi"), make, "doc_id long, seq binary", 128)


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs (first, last, similarity) of tokens of ``a`` that repeat a part of ``b``, ``SPAN`` tokens or longer."""
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    place = np.searchsorted(sorted_b, a).clip(0, len(b) - 1)
    hit = np.flatnonzero(sorted_b[place] == a)
    where = order[place[hit]]
    out: list[tuple[int, int, float]] = []

    def runs(lo: int, hi: int, gaps: tuple[int, ...]) -> None:
        for part in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(hit[lo:hi]) > gaps[0]) + 1):
            if not len(part) or (first := int(hit[part[0]])) > (last := int(hit[part[-1]])) - SPAN + 1:
                continue
            lag = where[part] - hit[part]
            close = where[part][np.abs(lag - np.median(lag)) <= REACH]
            if not len(close):
                continue
            mine, other = np.unique(a[first : last + 1]), np.unique(b[close.min() : close.max() + 1])
            both = len(np.intersect1d(mine, other, assume_unique=True))
            share = both / (len(mine) + len(other) - both)
            if share >= SIMILARITY:
                out.append((first, last, share))
            elif len(gaps) > 1:
                runs(int(part[0]), int(part[-1]) + 1, gaps[1:])

    runs(0, len(hit), (*GAPS, 1))
    return out


def _held(windows: DataFrame) -> DataFrame:
    """``windows`` (key, doc_id, at) whose key is in two documents or more, with n (the key's windows) and its first document."""
    keys = windows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("first < most")
    keys = materialize(keys.drop("most"), "shared")
    return materialize(spread_join(windows, keys, "key", keys.select("key", "n"), F.col("doc_id")), "held")


def _verified(asked: DataFrame, seqs: DataFrame) -> DataFrame:
    """The passages that windows ``asked`` share with the first documents of their keys."""
    reach = F.greatest(F.min("at") - REACH, F.lit(0)).alias("lo"), (F.max("at") + REACH).alias("hi")
    pairs = materialize(asked.groupBy("doc_id", "first").agg(*reach), "passage-pairs")
    cut = F.expr("substring(seq, 4 * lo + 1, 4 * (hi - lo + 1))").alias("mine")
    both = pairs.join(seqs, "doc_id").select("doc_id", "first", "lo", cut)
    rows = pairs.groupBy("first").agg(F.count("*").alias("n"))
    both = spread_join(both, seqs.select(F.col("doc_id").alias("first"), F.col("seq").alias("other")), "first", rows, F.col("doc_id"), 1024)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            mine, other = batch.column("mine"), batch.column("other")
            for k, (doc, first, lo) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "lo")), strict=True)):
                for a, b, share in matched(np.frombuffer(mine[k].as_buffer(), np.uint32), np.frombuffer(other[k].as_buffer(), np.uint32)):
                    out.append((doc, lo + a, lo + b + WIDTH, b - a + WIDTH, first, share))
            kinds = (pa.int64(),) * 5 + (pa.float64(),)
            cols = zip(*out, strict=True) if out else ((),) * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "start_word", "end_word", "n_words", "first_doc_id", "similarity"])

        return work

    return materialize(map_rows(both, make, "doc_id long, start_word long, end_word long, n_words long, first_doc_id long, similarity double", 128), "passages")


def _outside(windows: DataFrame, found: DataFrame) -> DataFrame:
    """The windows whose minimum lies in no passage of ``found``."""
    f = found.select(F.col("doc_id").alias("d"), "start_word", "end_word").distinct()
    inside = (F.col("doc_id") == F.col("d")) & (F.col("start_word") <= F.col("at")) & (F.col("at") + WIDTH <= F.col("end_word"))
    return materialize(windows.join(f, inside, "left_anti"), "open-windows")


def _new(more: DataFrame, found: DataFrame) -> DataFrame:
    """``more`` without passages that lie in a longer one, or in an equal one of an earlier document."""
    every = found.unionByName(more).select(F.col("doc_id").alias("d"), F.col("start_word").alias("s"), F.col("end_word").alias("e"), F.col("first_doc_id").alias("f")).distinct()
    around = (F.col("doc_id") == F.col("d")) & (F.col("s") <= F.col("start_word")) & (F.col("e") >= F.col("end_word"))
    return more.distinct().join(every, around & ((F.col("e") - F.col("s") > F.col("n_words")) | (F.col("f") < F.col("first_doc_id"))), "left_anti")


def stretches(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their minima, of the stretches of ``STRETCH`` tokens around the minima ``at``."""
    shift = np.array(PLACES)
    begin = (at[:, None] - shift).ravel()
    inside = (begin >= 0) & (begin + STRETCH <= len(seq))
    middle, shift, begin = np.repeat(at, len(shift))[inside], np.tile(shift, len(at))[inside], begin[inside]
    s = seq.astype(np.uint64)
    return mix(mix(mix(s[begin] + shift.astype(np.uint64)) ^ s[middle]) ^ s[begin + STRETCH - 1]).view(np.int64), middle


def runs(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, and begins, of all runs of ``SPAN`` tokens that hold one of the places ``at``."""
    begin = np.unique((at[:, None] - np.arange(SPAN)).ravel())
    begin = begin[(begin >= 0) & (begin + SPAN <= len(seq))]
    key = np.zeros(len(begin), np.uint64)
    for k in range(SPAN):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + seq[begin + k])
    return key.view(np.int64), begin


def _finer(held: DataFrame, left: DataFrame, seqs: DataFrame, keys) -> DataFrame:
    """(key, doc_id, at): ``keys`` (``stretches`` or ``runs``) of all windows of ``held`` under a key of an open window in ``left``."""
    wanted = left.select("key", "n").distinct()
    some = spread_join(held.select("key", "doc_id", "at"), wanted.select("key"), "key", wanted, F.col("doc_id"))
    some = some.groupBy("doc_id").agg(F.collect_set("at").alias("ats"))  # places in one text

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list[np.ndarray]] = [[], [], []]
            with np.errstate(over="ignore"):
                for doc, seq, at in zip(batch.column("doc_id").to_pylist(), batch.column("seq"), batch.column("ats"), strict=True):
                    key, places = keys(np.frombuffer(seq.as_buffer(), np.uint32), np.asarray(at.values).astype(np.int64))
                    for col, x in zip(out, (key, np.full(len(key), doc), places), strict=True):
                        col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, (np.int64, np.int64, np.int32), strict=True)], ["key", "doc_id", "at"])

        return work

    return materialize(map_rows(seqs.join(some, "doc_id"), make, "key long, doc_id long, at int", 256), "finer-windows")


def repeats(docs: DataFrame) -> DataFrame:
    """One row per repeated passage; see the module."""
    held = _held(materialize(map_rows(_rows(docs), _windows, "key long, doc_id long, at int"), "windows"))
    seqs = materialize(_sequences(docs, materialize(held.select("doc_id").distinct(), "passage-ids")), "sequences")
    seqs = materialize(seqs.groupBy("doc_id").agg(F.max_by("seq", F.length("seq")).alias("seq")), "sequences")
    asked = held.where("doc_id <> first")
    found = _verified(asked, seqs)
    left = _outside(asked.select("key", "n", "doc_id", "at"), found)
    for keys in (stretches, runs):
        left = left.where("n > 2")  # of two windows with a key, one is the first document's
        if left.isEmpty():
            break
        held = _held(_finer(held, left, seqs, keys))
        open_ = left.select("doc_id", "at").distinct() if keys is stretches else left.select("doc_id").distinct()
        asked = held.where("doc_id <> first").join(open_, open_.columns, "left_semi")
        more = _verified(asked, seqs)
        found = materialize(found.unionByName(_new(more, found)), "passages")
        if keys is stretches:
            left = _outside(asked.select("key", "n", "doc_id", "at"), more)
    return found


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of the ``cuts`` (word numbers) and the white space after them."""
    gone = sorted(cuts)
    begins = [m.start() for m in WORD.finditer(text)]
    begins.append(len(text))
    out, at = [], 0
    for start, end in gone:
        start, end = min(start, len(begins) - 1), min(end, len(begins) - 1)
        if begins[start] >= at:
            out.append(text[at : begins[start]])
        at = max(at, begins[end])
    return "".join(out) + text[at:]


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; documents of which nothing is left go."""
    found = materialize(repeats(docs), "repeats")
    cuts = found.groupBy(F.col("doc_id").alias("_sw_id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("_sw_cuts"))
    cuts = small(materialize(cuts, "cuts"))
    joined = docs.join(cuts, F.col("doc_id").cast("long") == F.col("_sw_id"), "left").drop("_sw_id")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, keep = [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("_sw_cuts").to_pylist(), strict=True):
                if gone:
                    text = without(text, [(c["start_word"], c["end_word"]) for c in gone])
                texts.append(text)
                keep.append(not gone or WORD.search(text) is not None)
            names = [n for n in batch.schema.names if n != "_sw_cuts"]
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

        return work

    out = map_rows(joined, make, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
