"""Series tables: (series_id string, t int from 1, y double, null if missing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(rows: DataFrame, series: F.Column, time: str, unit: str, value: F.Column) -> DataFrame:
    """(series_id, ts, y): ``value``, an aggregate, per series and calendar bucket."""
    return rows.groupBy(series.cast("string").alias("series_id"), F.date_trunc(unit, time).cast("timestamp_ntz").alias("ts")).agg(value.cast("double").alias("y"))


def densify(series: DataFrame, step: str) -> DataFrame:
    """A row for every bucket between the first and last of all series; y is null where a series has none; t counts from 1."""
    ends = series.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    calendar = ends.select(F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("ts"))
    ids = series.select("series_id").distinct()
    numbered = calendar.select("ts", F.row_number().over(Window.orderBy("ts")).alias("t"))  # one calendar, not data
    grid = ids.join(F.broadcast(numbered))
    return grid.join(series, ["series_id", "ts"], "left").select("series_id", "t", "ts", "y")


COUNTS = ("poisson", "binomial", "negative binomial")


def problems(series: DataFrame, dist: str = "gaussian") -> DataFrame:
    """series_id, problem and rows: what a model of ``dist`` can't take. No row means that all series are usable.

    ``infinite`` y; ``negative`` (counts, gamma), ``zero`` (gamma) and ``fractional`` y (counts); ``over trials`` (binomial,
    y > u); ``bad exposure`` (u missing, infinite or not over 0); ``repeated`` and ``missing`` t between 1 and the last one;
    ``short``: fewer than two times; ``no value`` at all. A null y is a missing value and no problem.
    """
    y, u = F.col("y"), F.col("u") if "u" in series.columns else F.lit(1.0)
    infinite = F.isnan(y) | (F.abs(y) == float("inf"))
    fine = y.isNotNull() & ~infinite
    never = F.lit(False)
    marks = {
        "infinite": infinite, "negative": fine & (y < 0) if dist in (*COUNTS, "gamma") else never, "zero": fine & (y == 0) if dist == "gamma" else never,
        "fractional": fine & (y != F.floor(y)) if dist in COUNTS else never, "over trials": fine & (y > u) if dist == "binomial" else never,
        "bad exposure": u.isNull() | F.isnan(u) | (u == float("inf")) | (u <= 0),
    }
    per_time = series.groupBy("series_id", "t").agg(F.count("*").alias("n"), F.count("y").alias("seen"), *(F.sum(F.when(m, 1).otherwise(0)).alias(k) for k, m in marks.items()))
    inside = F.col("t").isNotNull() & (F.col("t") >= 1)
    found = per_time.groupBy("series_id").agg(
        *(F.sum(k).alias(k) for k in marks), F.sum(F.col("n") - 1).alias("repeated"), (F.greatest(F.max("t"), F.lit(0)) - F.sum(inside.cast("long"))).alias("missing"),
        F.when(F.count("*") < 2, 1).otherwise(0).alias("short"), F.when(F.sum("seen") == 0, 1).otherwise(0).alias("no value"),
    )
    kinds = [*marks, "repeated", "missing", "short", "no value"]
    long = found.select("series_id", F.explode(F.array(*(F.struct(F.lit(k).alias("problem"), F.col(k).cast("long").alias("rows")) for k in kinds))).alias("p"))
    return long.select("series_id", "p.problem", "p.rows").where(F.col("rows") > 0)


def numbered(series: DataFrame) -> DataFrame:
    """t from 1 by the order of ts inside each series, without filling gaps."""
    return series.withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")))


def packed(series: DataFrame, *extra: str) -> DataFrame:
    """A row per series: ``steps``, an array of (t, y, ...) ordered by t. A recursion needs a series in one place."""
    return series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "y", *extra))).alias("steps"))


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and day."""
    return densify(bucketed(table(spark, sf_dir, "events"), F.col("event_type"), "ts", "day", F.count("*")), "1 day")


def daily_user_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per user and day; most days are missing."""
    return densify(bucketed(table(spark, sf_dir, "events"), F.col("user_id"), "ts", "day", F.avg("value")), "1 day")


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per priority and month, in thousands of total price."""
    rows = table(spark, sf_dir, "orders")
    return densify(bucketed(rows, F.col("o_orderpriority"), "o_orderdate", "month", F.sum("o_totalprice") / 1e5), "1 month")
