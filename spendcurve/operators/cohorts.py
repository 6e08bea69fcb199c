"""Retention by acquisition cohort: what the log shows, and what a fitted model says of survival."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcurve.functions import periods
from spendcurve.operators.customer_base import CustomerBase, normalized_log
from spendcurve.operators.purchase_models import BGNBD, PurchaseModel
from spendcurve.operators.results import Prediction, SmallResult
from spendcurve.plans import figures

METRICS = ("retention", "revenue")


def cohort_cells(log: DataFrame, period: str, metric: str) -> DataFrame:
    """(cohort_ord, period_number, value) where something happened, from a normalized log.

    Customers and periods are made distinct before they are counted, so no distinct count is needed;
    the cohort is the least period of the customer's rows. The first exchange is by customer and period, after
    partial sums, and the second by customer: a customer with very many rows costs no task more than its periods.
    """
    active = log.filter("id IS NOT NULL AND ts IS NOT NULL").withColumn("bucket", periods.ordinal(F.col("ts"), period))
    value = F.sum("amount").alias("value") if metric == "revenue" else F.lit(1).alias("value")
    pairs = active.groupBy("id", "bucket").agg(value) if metric == "revenue" else active.groupBy("id", "bucket").agg(F.lit(1).cast("bigint").alias("value"))
    placed = pairs.withColumn("cohort_ord", F.min("bucket").over(Window.partitionBy("id")))
    kind = "double" if metric == "revenue" else "bigint"
    return placed.groupBy("cohort_ord", (F.col("bucket") - F.col("cohort_ord")).alias("period_number")).agg(F.coalesce(F.sum("value"), F.lit(0)).cast(kind).alias("value"))


def triangle(cells: DataFrame, period: str, last: int) -> DataFrame:
    """Every cohort at every age up to period `last`: 0 where nothing happened. There are at most periods squared cells."""
    first = cells.filter("period_number = 0").select("cohort_ord")
    age = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint") - F.col("cohort_ord"))).alias("period_number")
    ages = first.select("cohort_ord", age)
    full = ages.join(cells, ["cohort_ord", "period_number"], "left")
    return full.select("cohort_ord", periods.label(F.col("cohort_ord"), period).alias("cohort"), "period_number", F.coalesce("value", F.lit(0)).cast(dict(cells.dtypes)["value"]).alias("value"))


class CohortMatrix:
    """Active customers or revenue by cohort and age, long form in Spark and wide form in pandas."""

    def __init__(self, cells: DataFrame, *, metric: str, period: str):
        self._cells, self.metric, self.period = cells, metric, period
        self._held: DataFrame | None = None

    @classmethod
    def from_transactions(
        cls,
        transactions: DataFrame | pd.DataFrame,
        *,
        period: str = "M",
        metric: str = "retention",
        customer_id_col: str = "customer_id",
        datetime_col: str = "date",
        amount_col: str | None = "amount",
        datetime_format: str | None = None,
    ) -> CohortMatrix:
        """Rows without an id or date are left out; refunds count as activity and take from revenue."""
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
        if metric == "revenue" and amount_col is None:
            raise ValueError("metric='revenue' needs an amount_col, got None")
        if isinstance(transactions, pd.DataFrame):
            if transactions.empty:
                raise ValueError("empty transaction log: there is no cohort in it")
            transactions = SparkSession.builder.getOrCreate().createDataFrame(transactions)
        log = normalized_log(transactions, customer_id_col, datetime_col, amount_col if metric == "revenue" else None, datetime_format)
        cells = cohort_cells(log, period, metric).persist()
        last = cells.agg(F.max(F.col("cohort_ord") + F.col("period_number"))).first()[0]
        if last is None:
            raise ValueError("empty transaction log: there is no cohort in it")
        out = cls(triangle(cells, period, last), metric=metric, period=period)
        out._held = cells
        return out

    def unpersist(self) -> None:
        """Release the cells; results are computed from the log again."""
        if self._held is not None:
            self._held.unpersist()

    def to_spark(self, *, relative: bool = False) -> DataFrame:
        """(cohort_ord, cohort, period_number, value). Relative values are shares of the cohort's first; null if that is 0."""
        if not relative:
            return self._cells
        first = F.max(F.when(F.col("period_number") == 0, F.col("value"))).over(Window.partitionBy("cohort_ord"))
        return self._cells.withColumn("value", F.try_divide(F.col("value").cast("double"), first.cast("double")))

    def curve(self) -> DataFrame:
        """Mean relative value by age over the cohorts observed at it, and how many those are."""
        cells = self.to_spark(relative=True)
        return cells.groupBy("period_number").agg(F.avg("value").alias("value"), F.count("value").cast("bigint").alias("cohorts"))

    def to_pandas(self, *, relative: bool = False) -> pd.DataFrame:
        long = self.to_spark(relative=relative).toPandas()
        wide = long.pivot(index=["cohort_ord", "cohort"], columns="period_number", values="value").sort_index()
        return wide.droplevel("cohort_ord").astype(float)

    def to_json(self, *, relative: bool = False) -> str:
        return self.to_pandas(relative=relative).to_json(orient="index")

    def plot_data(self) -> DataFrame:
        return self.to_spark(relative=True)

    def plot(self, ax=None, *, relative: bool = True, **kwargs):
        return figures.draw_heatmap(self.to_pandas(relative=relative), ax, **kwargs)

    def __repr__(self) -> str:
        return f"CohortMatrix({self.metric}, by {self.period!r})"


class AliveModel(Protocol):
    def fit(self, cb: CustomerBase) -> AliveModel: ...

    def probability_alive(self, cb: CustomerBase | None = None) -> Prediction: ...


def cohort_ordinal(cb: CustomerBase, period: str) -> Column:
    """A customer's acquisition period from the age: the grain's bucket is found back, then filed by where it starts."""
    grain = cb.collapse
    if periods.finer(period, grain):
        raise ValueError(f"period={period!r} is finer than collapse={grain!r}, the grain at which first purchases are known")
    last = periods.ordinal_of(cb.observation_period_end, grain)
    bucket = F.lit(last).cast("bigint") - F.round(F.col("T") * cb.periods_per_time_unit).cast("bigint")
    if periods.unit(period) == periods.unit(grain):
        return bucket
    return periods.ordinal(periods.start(bucket, grain), period)


class SurvivalCurve(SmallResult):
    """Per cohort: age in periods, customers, and the mean probability of being alive."""

    def __init__(self, frame: DataFrame, *, period: str):
        self._frame, self.period = frame, period
        self._pandas: pd.DataFrame | None = None

    @property
    def _data(self) -> pd.DataFrame:
        if self._pandas is None:
            self._pandas = self._frame.toPandas().sort_values("cohort_ord").drop(columns="cohort_ord").set_index("cohort")
        return self._pandas

    def to_spark(self) -> DataFrame:
        return self._frame

    def plot_data(self) -> DataFrame:
        return self._frame

    def plot(self, ax=None, **kwargs):
        return figures.draw_line(self._data, "age", "survival", ax, **kwargs)

    def __repr__(self) -> str:
        return f"SurvivalCurve(by {self.period!r})"


class CohortSurvival:
    """Mean P(alive) by acquisition cohort, from any model that has it."""

    def __init__(self, transaction_model: AliveModel | None = None):
        self.transaction_model = transaction_model if transaction_model is not None else BGNBD()
        self._base: CustomerBase | None = None

    def fit(self, cb: CustomerBase) -> CohortSurvival:
        if not isinstance(cb, CustomerBase):
            raise TypeError(f"CohortSurvival expects a CustomerBase, got {type(cb).__name__}")
        self.transaction_model.fit(cb)
        self._base = cb
        return self

    def predict(self, *, period: str | None = None) -> SurvivalCurve:
        if self._base is None:
            raise RuntimeError("CohortSurvival is not fitted; call fit(cb) first")
        cb = self._base
        period = period if period is not None else cb.collapse
        at = cohort_ordinal(cb, period)
        if isinstance(self.transaction_model, PurchaseModel):
            alive = type(self.transaction_model).alive_column(self.transaction_model._fitted(), F.col("frequency"), F.col("recency"), F.col("T"))
            scored = cb.to_spark().select(at.alias("cohort_ord"), alive.alias("alive"))
        else:
            frame = self.transaction_model.probability_alive().to_spark()
            scored = cb.to_spark().select(cb.id_col, at.alias("cohort_ord")).join(frame.toDF(cb.id_col, "alive"), cb.id_col)
        curve = scored.groupBy("cohort_ord").agg(F.count("*").cast("bigint").alias("customers"), F.avg("alive").alias("survival"))
        end = periods.ordinal_of(cb.observation_period_end, period)
        return SurvivalCurve(
            curve.select("cohort_ord", periods.label(F.col("cohort_ord"), period).alias("cohort"), (F.lit(end).cast("bigint") - F.col("cohort_ord")).alias("age"), "customers", "survival"),
            period=period,
        )

    def __repr__(self) -> str:
        return f"CohortSurvival({self.transaction_model!r})"
