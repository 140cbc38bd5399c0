"""Table functions for SQL: filters, likelihoods and forecasts of TABLE(...) PARTITION BY series_id ORDER BY t.

Rows come one at a time and in order; a function keeps the filter's state and nothing else, so a series' length doesn't matter.
The model is JSON (see ``steps.from_json``). The first column of the result is the partitioning column, of its own type.

    tables.register(spark)
    spark.sql('''select * from state_filter(table(series) partition by series_id order by t, model => '{"sd_level": 3, "sd_y": 8}')''')

A null or NaN ``y`` is a missing value; ``y`` may be an array of the model's variables; other columns of the table are not read. An empty
table gives no row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..operators.steps import Stepper, from_json, values

DOUBLES = ArrayType(DoubleType())


def _schema(table: AnalyzeArgument, model: AnalyzeArgument, key: AnalyzeArgument | None, columns: list[tuple]) -> AnalyzeResult:
    """The key column of the table, then ``columns``; errors name what is wrong with the arguments."""
    if not table.isTable or not isinstance(table.dataType, StructType):
        raise ValueError("the first argument must be a TABLE(...)")
    name = "series_id" if key is None else key.value
    names = table.dataType.fieldNames()
    if missing := [c for c in (name, "t", "y") if c not in names]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    if model.value is None:
        raise ValueError("model must be a constant text")
    from_json(model.value)
    return AnalyzeResult(StructType([StructField(name, table.dataType[name].dataType), *(StructField(c, t) for c, t in columns)]))


class _Filter:
    """What the functions share: the model, built once, and the state of the partition's series."""

    def __init__(self):
        self.filter = self.name = None

    def advance(self, row, model: str, key: str):
        if self.filter is None:
            self.filter, self.name = Stepper(from_json(model)), row[key]
        return self.filter.step(values(row["y"], self.filter.model.Z.shape[-2]))


@udtf
class StateFilter(_Filter):
    """t, the filtered state's mean and covariance (flattened), and the log-likelihood so far, for every row."""

    @staticmethod
    def analyze(table, model, key=None):
        return _schema(table, model, key, [("t", IntegerType()), ("att", DOUBLES), ("ptt", DOUBLES), ("loglik", DoubleType())])

    def eval(self, table, model, key="series_id"):
        att, ptt = self.advance(table, model, key)
        yield self.name, table["t"], att.tolist(), ptt.ravel().tolist(), float(self.filter.loglik)


@udtf
class StateLogLik(_Filter):
    """One row a series: its number of times and log-likelihood."""

    @staticmethod
    def analyze(table, model, key=None):
        return _schema(table, model, key, [("n", IntegerType()), ("loglik", DoubleType())])

    def eval(self, table, model, key="series_id"):
        self.advance(table, model, key)

    def terminate(self):
        if self.filter is not None:
            yield self.name, self.filter.t, float(self.filter.loglik)


@udtf
class StateForecast(_Filter):
    """The next ``horizon`` times of a series: t, mean and covariance (flattened) of its observations."""

    @staticmethod
    def analyze(table, model, horizon, key=None):
        return _schema(table, model, key, [("t", IntegerType()), ("mean", DOUBLES), ("cov", DOUBLES)])

    def __init__(self):
        super().__init__()
        self.horizon = 0

    def eval(self, table, model, horizon, key="series_id"):
        self.horizon = horizon
        self.advance(table, model, key)

    def terminate(self):
        if self.filter is not None:
            for h, (mean, cov) in enumerate(self.filter.forecast(self.horizon), 1):
                yield self.name, self.filter.t + h, mean.tolist(), cov.ravel().tolist()


FUNCTIONS = {"state_filter": StateFilter, "state_loglik": StateLogLik, "state_forecast": StateForecast}


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
