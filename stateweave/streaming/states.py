"""Online filter of any linear Gaussian state over a stream, one or several variables, with state, waiting rows and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.models import Matrices
from ..operators.steps import Stepper, values

OUTPUT = "series_id string, at bigint, att array<double>, ptt array<double>, loglik double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Online(StatefulProcessor):
    """Value state: the filter between two observations. Map state: rows (by time) that the watermark hasn't passed. Timers: when it passes them."""

    def __init__(self, build: Callable[[], Matrices]):
        self.build = build

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.model = handle, self.build()
        self.state = handle.getValueState("filter", "a array<double>, p array<double>, loglik double, steps int, upto bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "y array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = self.model.Z.shape[-2]
        upto = self.state.get()[4] if self.state.exists() else None
        timers = {t for t in self.handle.listTimers()}
        for frame in rows:  # one chunk at a time goes to the state store
            for at, y in zip(frame["at"].tolist(), frame["y"].tolist(), strict=True):
                if upto is not None and at <= upto:
                    continue
                new = values(y, p)
                if self.waiting.containsKey((at,)):
                    old = values(list(self.waiting.getValue((at,))[0]), p)
                    new = np.fmin(old, new)
                self.waiting.updateValue((at,), ([None if np.isnan(v) else float(v) for v in new],))
                due = -(-at // 1000)
                if due not in timers:
                    timers.add(due)
                    self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = self.model.Z.shape[-2]
        a, P, loglik, steps, upto = self.state.get() if self.state.exists() else (None, None, 0.0, 0, None)
        step = Stepper(self.model, a, P, loglik, steps)
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        ready = sorted(k[0] for k in self.waiting.keys() if k[0] <= until)  # of one timer: all but the last millisecond's are gone
        out = []
        for at in ready:
            att, ptt = step.step(values(list(self.waiting.getValue((at,))[0]), p))
            self.waiting.removeKey((at,))
            out.append((key[0], at, att.tolist(), ptt.ravel().tolist(), float(step.loglik)))
            upto = at
        self.state.update((step.a.tolist(), step.P.ravel().tolist(), float(step.loglik), step.t, upto))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "at", "att", "ptt", "loglik"])


def online_states(stream: DataFrame, build: Callable[[], Matrices], delay: str = "1 hour") -> DataFrame:
    """Filtered state (mean and flattened covariance) after each observation of a stream (series_id string, ts timestamp, y double or array<double>).

    ``build()`` gives the model; a matrix over time is read by the number of observations of the series so far. Rows wait in the state
    store until the watermark, ``delay`` behind the latest ts, has passed them, and are filtered in the order of ts, so rows that
    come late by less than ``delay`` are placed rightly. Rows behind the watermark, behind a row that was filtered, or with a null ts are left
    out; of rows of one series and ts the smallest values count, missing ones last. A missing y only moves the state on.
    Nothing of a micro-batch is gathered: rows go to the store chunk by chunk. Needs the RocksDB state store (``PROVIDER``).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    y = F.col("y") if dict(stream.dtypes)["y"].startswith("array") else F.array("y")
    rows = stream.where("ts is not null").withWatermark("ts", delay).select("series_id", "ts", F.unix_micros("ts").alias("at"), y.cast("array<double>").alias("y"))
    out = rows.groupBy("series_id").transformWithStateInPandas(_Online(build), OUTPUT, "Append", "EventTime")
    return out.select("series_id", F.timestamp_micros("at").alias("ts"), "att", "ptt", "loglik")
