"""Running sums over ranges against plain windows."""

import numpy as np
from pyspark.sql import functions as F

from stateweave.operators import scan


def test_like_a_window(spark):
    rng = np.random.default_rng(1)
    rows = [(["hot", "b", None][min(2, int(k))] if k < 3 else f"k{k}", i, None if i % 11 == 0 else float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 40, 3000), rng.integers(0, 99, 3000), strict=True))]
    rows += [("hot", 10_000 + i, 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, i long, v double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan.running_sums(df, ["key"], [F.desc("i")], {"s": F.col("v"), "n": F.lit(1)}).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.toPandas().sort_values("i", ascending=False)
    want["s"] = want.fillna({"v": 0.0}).groupby("key", dropna=False)["v"].cumsum()
    want["n"] = want.groupby("key", dropna=False).cumcount() + 1
    both = got.merge(want, on="i")
    assert len(both) == len(rows) and (both.s_x == both.s_y).all() and (both.n_x == both.n_y).all()
    assert scan.running_sums(df.where("i < 0"), ["key"], [F.col("i")], {"s": F.col("v")}).count() == 0


def test_a_hot_key_is_dealt_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("one").alias("key"), F.col("id").alias("i"))
        blocks = scan.dealt_blocks(df, ["key"], [F.col("i")]).groupBy("_sw_block").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(blocks) >= 3 and max(b["count"] for b in blocks) < 20_000
