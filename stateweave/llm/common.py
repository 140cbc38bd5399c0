"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .worker import prepared, release

SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stateweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


#: The most bytes of Parquet of a table that is broadcast.
BROADCAST_BYTES = 16_000_000
#: Rows of a key that make it hot: they are dealt out over several tasks.
HOT_ROWS = 4096


def is_small(df: DataFrame) -> bool:
    """Whether the files of ``df``, a written table read whole, are few enough bytes for a broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table read whole, marked for broadcast if its files are small; joins shuffle it otherwise."""
    return F.broadcast(df) if is_small(df) else df


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: DataFrame, by: Column, size: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``key``; the rows of ``left`` under a hot key go, by a hash of ``by``, to several copies of ``right``'s row.

    ``rows`` has key and n, the rows of ``left`` with it; there are at most (rows of left) / ``size`` hot keys.
    """
    hot = rows.where(F.col("n") > size).select(key, F.ceil(F.col("n") / size).cast("int").alias("_sw_parts"))
    if hot.isEmpty():
        return left.join(right, key)
    hot = small(materialize(hot, "hot-keys"))
    parts = F.coalesce("_sw_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_sw_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_sw_parts")
    copied = right.join(hot, key, "left").withColumn("_sw_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_sw_parts")
    return dealt.join(copied, [key, "_sw_part"]).drop("_sw_part")


#: Bytes of a slice that ``map_rows`` hands over; a single larger row goes alone.
SLICE_BYTES = 8_000_000


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows and ``SLICE_BYTES``; ``make`` runs once per task and returns the slice function."""

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > SLICE_BYTES):
            half = batch.num_rows // 2 if batch.num_rows < 2 * rows else batch.num_rows // (2 * rows) * rows
            yield from slices(batch.slice(0, half))
            yield from slices(batch.slice(half))
        elif batch.num_rows:
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(make)
        for batch in batches:
            for part in slices(batch):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out
        del work
        release()

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse, by 2^64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, b, np.uint64))) for b in (base, pow(base, -1, 2**64)))


#: Bytes that are hashed together.
_BLOCK = 32_768
_POWERS = _powers(_BLOCK)
#: A random number for each byte; A-Z have those of a-z.
_LETTER = np.random.default_rng(17).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_WORD = ~np.isin(np.arange(256), list(SPACES.encode()))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, A-Z as a-z, and each text's number of words.

    A word's hash is a polynomial in its bytes' numbers, from sums over the whole buffer, with no object for a word.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = _WORD[data]
    apart = np.zeros(len(data) + 1, bool)
    apart[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | apart[1:-1]
    last[:-1] &= ~inside[1:] | apart[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + _BLOCK, "right")))
        part = data[begin[a] : end[b - 1]]
        power, inverse = _POWERS if len(part) <= _BLOCK else _powers(len(part))
        sums = np.append(np.uint64(0), np.cumsum(_LETTER[part] * power[: len(part)]))
        at = begin[a:b] - begin[a]
        out[a:b] = (sums[end[a:b] - begin[a]] - sums[at]) * inverse[at]
        a = b
    return mix(out + (end - begin).astype(np.uint64)), np.diff(np.searchsorted(begin, bounds))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of the whole sequence if it is shorter; none of no words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : n - width + 1 + k]
    return mix(out)
