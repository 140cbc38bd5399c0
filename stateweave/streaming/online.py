"""Online local-level filter over a stream: the filter's state per series is a mean, a variance and a log-likelihood."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "a double, p double, loglik double, upto bigint, held_at array<bigint>, held_y array<double>"
OUTPUT = "series_id string, at bigint, att double, ptt double, loglik double"


def online_filter(stream: DataFrame, sd_state: float = 1.0, sd_y: float = 1.0, p1: float = 1e7, delay: str = "1 hour") -> DataFrame:
    """Filtered level after each observation of a stream (series_id string, ts timestamp, y double).

    Rows wait in the state until the watermark, ``delay`` behind the latest ts, has passed them and are then filtered in
    the order of ts, so rows that come late by less than ``delay`` are still placed rightly. Rows behind the watermark or
    with a null ts are left out; of rows of one series with the same ts the smallest y counts, missing ones last. A missing
    y only adds the state's variance. A series' state is 4 numbers and its rows of the last ``delay``.
    """
    q, h = sd_state**2, sd_y**2

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, p, ll, upto, held_at, held_y = state.get if state.exists else (0.0, p1, 0.0, None, [], [])
        new = [(c["at"].to_numpy(np.int64), c["y"].to_numpy(float)) for c in chunks]
        at = np.concatenate([np.asarray(held_at, np.int64), *(x for x, _ in new)])
        y = np.concatenate([np.asarray(held_y, float), *(x for _, x in new)])
        order = np.lexsort((y, at))
        at, y = at[order], y[order]
        watermark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(at, watermark * 1000, "right"))
        out = []
        for t, v in zip(at[:ready].tolist(), y[:ready].tolist(), strict=True):
            if upto is not None and t <= upto:
                continue
            att, ptt = a, p
            if not math.isnan(v) and p + h > 1e-12:
                f, e = p + h, v - a
                k = p / f
                att, ptt = a + k * e, (1 - k) ** 2 * p + k * k * h
                ll -= 0.5 * (math.log(2 * math.pi * f) + e * e / f)
            out.append((key[0], t, att, ptt, ll))
            a, p, upto = att, ptt + q, t
        state.update((a, p, ll, upto, at[ready:].tolist(), y[ready:].tolist()))
        if ready < len(at):
            state.setTimeoutTimestamp(max(watermark + 1, -int(-at[ready] // 1000) - 1))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "at", "att", "ptt", "loglik"])

    rows = stream.where("ts is not null").withWatermark("ts", delay).select("series_id", "ts", F.unix_micros("ts").alias("at"), F.col("y").cast("double").alias("y"))
    out = rows.groupBy("series_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("series_id", F.timestamp_micros("at").alias("ts"), "att", "ptt", "loglik")
