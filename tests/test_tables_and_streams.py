"""Table functions in SQL and the general online filter against the batch filter."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.functions import tables
from stateweave.operators import inference, kernels, models, steps
from stateweave.streaming.states import online_states

MODEL = '{"sd_level": 0.7, "sd_slope": 0.2, "sd_y": 1.5, "P1": [[9.0, 0.0], [0.0, 4.0]]}'
TREND = models.structural(sd_level=0.7, sd_slope=0.2, sd_y=1.5, P1=np.diag([9.0, 4.0]))


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    rows = [(k, t, None if (t + k) % 7 == 3 else float(v), "other") for k in range(5) for t, v in enumerate(np.cumsum(rng.normal(size=12 + k)), 1)]
    frame = spark.createDataFrame(rows, "series_id int, t int, y double, note string").repartition(6)
    frame.createOrReplaceTempView("walks")
    tables.register(spark)
    return frame


def test_filter_in_sql_equals_batch(spark, series):
    got = spark.sql(f"select * from state_filter(table(walks) partition by series_id order by t, model => '{MODEL}')")
    assert got.dtypes == [("series_id", "int"), ("t", "int"), ("att", "array<double>"), ("ptt", "array<double>"), ("loglik", "double")]
    want = inference.kalman_filter(series.withColumn("series_id", F.col("series_id").cast("string")), TREND).where("att is not null").collect()
    found = {(str(r.series_id), r.t): r for r in got.collect()}
    assert len(found) == len(want)
    for w in want:
        g = found[w.series_id, w.t]
        assert np.allclose(g.att, w.att) and np.allclose(g.ptt, w.ptt)
    last = {r.series_id: r for r in spark.sql(f"select * from state_loglik(table(walks) partition by series_id order by t, model => '{MODEL}')").collect()}
    assert all(abs(last[int(w.series_id)].loglik - w.loglik) < 1e-9 for w in want) and last[2].n == 14


def test_forecast_in_sql(spark, series):
    got = spark.sql(f"select * from state_forecast(table(walks) partition by series_id order by t, model => '{MODEL}', horizon => 3) order by series_id, t").collect()
    assert [r.t for r in got[:3]] == [13, 14, 15] and len(got) == 15
    y = np.array([[np.nan if r.y is None else r.y] for r in series.where("series_id = 0").orderBy("t").collect()])
    longer = kernels.kalman(TREND.build(np.zeros(0)), np.vstack([y, np.full((3, 1), np.nan)]))
    for h in range(3):
        assert np.allclose(got[h].mean, longer["a"][12 + h][:1]) and np.allclose(got[h].cov, longer["P"][12 + h][0, 0] + 1.5**2)


def test_matrices_and_several_variables_in_sql(spark):
    model = '{"Z": [[1, 0], [0.5, 1]], "T": [[0.9, 0.1], [0, 0.8]], "R": [[1, 0], [0, 0.5]], "H": [[1, 0], [0, 2]], "a1": [0, 1], "P1": [[4, 0], [0, 4]]}'
    rng = np.random.default_rng(4)
    y = rng.normal(size=(9, 2))
    y[3, 0] = y[5] = np.nan
    rows = [("a", t + 1, [None if np.isnan(v) else float(v) for v in r]) for t, r in enumerate(y)]
    spark.createDataFrame(rows, "series_id string, t int, y array<double>").createOrReplaceTempView("pairs")
    tables.register(spark)
    got = spark.sql(f"select * from state_filter(table(pairs) partition by series_id order by t, model => '{model}') order by t").collect()
    want = kernels.kalman(steps.from_json(model), y)
    assert np.allclose([r.att for r in got], want["att"]) and abs(got[-1].loglik - want["loglik"]) < 1e-9


def test_errors_name_the_argument(spark, series):
    for sql, words in (
        ("select * from state_filter(table(select 1 as series_id, 2 as t) partition by series_id order by t, model => '{}')", "no column y"),
        (f"select * from state_filter(table(walks) partition by series_id order by t, model => '{MODEL}', key => 'nothing')", "nothing"),
    ):
        with pytest.raises(Exception, match=words):
            spark.sql(sql).collect()
    assert spark.sql(f"select * from state_filter(table(select * from walks where t < 0) partition by series_id order by t, model => '{MODEL}')").count() == 0


def _stream(spark, path, parts, y, build, delay):
    for part in parts:
        spark.createDataFrame(part, f"series_id string, ts timestamp, y {y}").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(f"series_id string, ts timestamp, y {y}").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = "states_" + y.replace("<", "_").replace(">", "")
    q = online_states(stream, build, delay).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_online_trend_equals_batch_under_late_data(spark, tmp_path):
    rng = np.random.default_rng(9)
    at = lambda h, m=0: datetime(2024, 1, 1) + timedelta(hours=h, minutes=m)
    rows = [("a", at(t), None if t == 5 else float(v)) for t, v in enumerate(np.cumsum(rng.normal(size=12)))]
    twice = [("b", at(6), 1.0), ("b", at(6), 4.0)]
    parts = [[rows[k] for k in (1, 0, 3, 2)], [rows[k] for k in (6, 4, 8)] + twice + [("a", None, 7.0)], [rows[k] for k in (5, 7, 10)], [rows[k] for k in (9, 11)] + [("a", at(2, 30), 50.0)]]
    got = _stream(spark, tmp_path, parts, "double", lambda: TREND.build(np.zeros(0)), "4 hours")
    a = got.where("series_id = 'a'").orderBy("ts").collect()
    y = np.array([[np.nan if r[2] is None else r[2]] for r in rows])
    batch = kernels.kalman(TREND.build(np.zeros(0)), y[:8])
    assert [r.ts.hour for r in a] == list(range(len(a))) and len(a) >= 7
    assert np.allclose([r.att for r in a], batch["att"][: len(a)]) and np.allclose([r.ptt for r in a], batch["Ptt"][: len(a)].reshape(len(a), 4))
    b = got.where("series_id = 'b'").collect()
    assert len(b) == 1 and np.allclose(b[0].att, kernels.kalman(TREND.build(np.zeros(0)), np.array([[1.0]]))["att"][0])


def test_online_filter_of_several_variables(spark, tmp_path):
    model = steps.from_json('{"Z": [[1, 0], [0.5, 1]], "T": [[0.9, 0.1], [0, 0.8]], "R": [[1, 0], [0, 0.5]], "H": [[1, 0], [0, 2]], "a1": [0, 1], "P1": [[4, 0], [0, 4]]}')
    y = np.random.default_rng(4).normal(size=(9, 2))
    y[3, 0] = np.nan
    rows = [("a", datetime(2024, 1, 1, t), [None if np.isnan(v) else float(v) for v in r]) for t, r in enumerate(y)]
    got = _stream(spark, tmp_path, [rows[:4], rows[4:7], rows[7:]], "array<double>", lambda: model, "1 hour").orderBy("ts").collect()
    want = kernels.kalman(model, y)
    assert len(got) >= 7 and np.allclose([r.att for r in got], want["att"][: len(got)]) and abs(got[6].loglik - kernels.kalman(model, y[:7])["loglik"]) < 1e-9
