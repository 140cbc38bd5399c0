"""Running sums whose groups may be larger than a task: block totals, offsets of blocks and a scan within each block."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stateweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; it goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in names))


def dealt_blocks(df: DataFrame, keys: list[str], order: list[Column], block: str = "_sw_block") -> DataFrame:
    """``df`` sorted over all tasks by keys and order and written, with the number of the range each row lies in.

    A key's rows fill consecutive ranges, so that a key with most of the rows is spread over most of them; rows equal in keys
    and order share one. The table is written, as a range's number must not change between its readers.
    """
    return written(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn(block, F.spark_partition_id()), "blocks")


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """``df`` with the inclusive running sums ``sums`` (name to value; null counts as 0) of each key's rows in ``order``.

    With ``totals`` also the whole key's sums, as name_total. ``order`` should be total within a key: rows equal in it are summed in
    any order. Null keys are a key. No window holds more than one range of one key, or a row for each range of one key. An empty
    table gives none.
    """
    values = {f"_sw_v{k}": F.coalesce(v, F.lit(0)) for k, v in enumerate(sums.values())}
    placed = dealt_blocks(df.withColumns(values), keys, order)
    by = [*keys, "_sw_block"]
    before = Window.partitionBy(*keys).orderBy("_sw_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*by).agg(*(F.sum(v).alias(v) for v in values))
    every = [F.sum(v).over(Window.partitionBy(*keys)).alias(f"{v}_total") for v in values] if totals else []
    offsets = blocks.select(*by, *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values), *every)
    inside = Window.partitionBy(*(placed[c] for c in by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = placed.join(offsets, _same(placed, offsets, by))
    found = [(F.sum(v).over(inside) + F.col(f"{v}_before")).alias(n) for n, v in zip(sums, values, strict=True)]
    whole = [F.col(f"{v}_total").alias(f"{n}_total") for n, v in zip(sums, values, strict=True)] if totals else []
    return both.select(*(placed[c] for c in df.columns), *found, *whole)
