"""Quality rules: per-document base rules and cross-document line frequency.

Every document's lines are normalised (A-Z in lower case, runs of white space as one space) and hashed. Per host
(``source``) and line the distinct documents that hold it are counted; documents are told apart by a hash of their whole
text, so that a group of exact copies counts once and isn't taken for boilerplate. A line over ``max_docs`` documents is
removed. A document that loses more than ``max_removed`` of its words so is depleted and rejected.

Defined results: null or empty text has no words (so it fails the base rules); a null host is one host of its own;
rows that repeat give repeated results; an empty table gives none; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, is_small, map_rows, materialize, small, spread_join

MAX_DOCS = 100
MAX_REMOVED_PERCENT = 70
SYMBOLS = "#*$%&|<>"


def normal_line(line: str) -> bytes:
    return b" ".join(line.encode().lower().split())


def line_hash(line: str) -> int:
    """Signed 64-bit hash of the normalised line; 0 if it has no word."""
    n = normal_line(line)
    return int.from_bytes(xxhash.xxh3_64_digest(n), "little", signed=True) if n else 0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(index) == n:
        return 0
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[hit + k] = True
    return int(mark.sum())


PROFILE = (
    "row_id long, key struct<a:long,b:long>, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "doc_key long, lines array<struct<line:long,words:int>>"
)


def _profile():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        flat_hash, flat_words, ends = [], [], [0]
        for text in batch.column("text").to_pylist():
            text = text or ""
            words = text.encode().split()
            seen: dict[str, int] = {}
            dup = 0
            for line in text.split("\n"):
                if not line.strip(SPACES):
                    continue
                dup += line in seen
                seen[line] = 1
            distinct: dict[int, int] = {}
            for line in seen:
                norm = normal_line(line)
                h = int.from_bytes(xxhash.xxh3_64_digest(norm), "little", signed=True)
                distinct[h] = norm.count(b" ") + 1
            # a line that the document repeats loses all its copies
            if dup:
                distinct = dict.fromkeys(distinct, 0)
                for line in text.split("\n"):
                    if line.strip(SPACES):
                        norm = normal_line(line)
                        distinct[int.from_bytes(xxhash.xxh3_64_digest(norm), "little", signed=True)] += norm.count(b" ") + 1
            flat_hash += distinct.keys()
            flat_words += distinct.values()
            ends.append(len(flat_hash))
            out.append((
                len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words),
                int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "little", signed=True),
            ))
        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        pairs = pa.StructArray.from_arrays([pa.array(flat_hash, pa.int64()), pa.array(flat_words, pa.int32())], ["line", "words"])
        lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        names = ["row_id", "key", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "doc_key", "lines"]
        return pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("key"), batch.column("doc_id"), batch.column("host"), *cols, lines], names)

    return work


def _key() -> F.Column:
    """What rows of one id, host and text share, nulls included: two hashes."""
    parts = (F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(3), *parts).alias("b"))


def profile(docs: DataFrame) -> DataFrame:
    """One row per document: base figures and its distinct normalised lines, written to the shared folder."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), _key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"),
    )
    return materialize(map_rows(rows, _profile, PROFILE), "quality")


def frequent_lines(profiles: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines (``at``: host and line) over the limit and the rows ``n`` that have them. Both groupings reduce within tasks first, so a line in all documents costs no more."""
    lines = profiles.select("host", "doc_key", F.explode("lines.line").alias("line"))
    per_text = lines.groupBy("host", "line", "doc_key").agg(F.count("*").alias("rows"))
    per_line = per_text.groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("rows").alias("n"))
    return per_line.where(F.col("docs") > max_docs).select(F.struct("host", "line").alias("at"), "n")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """One row per document: base figures, ``removed_words``, ``removed_lines`` (hashes), ``base_failed`` and ``kept``."""
    profiles = profile(docs)
    frequent = materialize(frequent_lines(profiles, max_docs), "frequent-lines")
    lines = profiles.select("row_id", "host", F.explode("lines").alias("l")).select("row_id", F.struct("host", "l.line").alias("at"), "l.words")
    joined = lines.join(F.broadcast(frequent), "at") if is_small(frequent) else spread_join(lines, frequent.select("at"), "at", frequent, F.col("row_id"))
    removed = joined.groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.collect_list("at.line").alias("removed_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        profiles.drop("lines", "host", "doc_key").join(removed, "row_id", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("removed_words") <= max_removed_percent * F.col("n_words")))
    )


def digest(docs: DataFrame, **limits) -> DataFrame:
    return judge(docs, **limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"
    )


def _without_lines():
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("_sw_lines").to_pylist(), strict=True):
            if lines and text:
                gone = set(lines)
                text = "\n".join(x for x in text.split("\n") if line_hash(x) not in gone)
            texts.append(text)
        names = batch.schema.names[:-1]
        cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names)

    return work


def apply(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents without their frequent lines, in the columns of ``docs``."""
    verdict = judge(docs, **limits).where("not kept or removed_lines is not null")
    verdict = verdict.groupBy(F.col("key").alias("_sw_key")).agg(F.first("removed_lines", True).alias("_sw_lines"), F.min("kept").alias("_sw_kept"))
    verdict = small(materialize(verdict, "verdicts"))
    joined = docs.withColumn("_sw_row", _key()).join(verdict, F.col("_sw_row") == F.col("_sw_key"), "left")
    joined = joined.where("_sw_kept is null or _sw_kept").select(*(docs[c] for c in docs.columns), "_sw_lines")
    schema = ", ".join(f"`{c}` {t}" for c, t in joined.dtypes if c != "_sw_lines")
    out = map_rows(joined, _without_lines, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
