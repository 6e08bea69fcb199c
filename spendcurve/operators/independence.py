"""Does spend depend on how often a customer buys? Correlations and explained variance over repeat buyers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcurve.functions.special import correlation_p
from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.results import SmallResult
from spendcurve.plans import figures

MAX_CORRELATION, MAX_ETA_SQUARED = 0.30, 0.25


class MonetaryIndependenceWarning(UserWarning):
    """Spend and frequency look dependent, which biases a lifetime value that multiplies them."""


class IndependenceCheck(SmallResult):
    def __init__(self, buyers: DataFrame, statistics: dict[str, float]):
        super().__init__(pd.DataFrame({"value": list(statistics.values())}, index=pd.Index(list(statistics), name="statistic")), buyers.sparkSession)
        self._buyers = buyers
        self.n_customers = int(statistics["n_customers"])
        self.pearson_r, self.pearson_p = statistics["pearson_r"], statistics["pearson_p"]
        self.spearman_rho, self.spearman_p = statistics["spearman_rho"], statistics["spearman_p"]
        self.eta_squared = statistics["eta_squared"]

    def holds(self, *, max_correlation: float = MAX_CORRELATION, max_eta_squared: float = MAX_ETA_SQUARED) -> bool:
        """Whether the rank correlation and the explained share of variance are both low."""
        return abs(self.spearman_rho) < max_correlation and self.eta_squared < max_eta_squared

    def grouped_spend(self, max_frequency: int = 7) -> dict[str, np.ndarray]:
        """Mean spends by number of repeats, the last group open. Brings every repeat buyer's to the driver: `plot_data` does not."""
        if max_frequency < 1:
            raise ValueError(f"max_frequency must be >= 1, got {max_frequency!r}")
        out: dict[str, np.ndarray] = {}
        data = self._buyers.select(F.least("frequency", F.lit(max_frequency)).alias("k"), "monetary_value").toPandas()
        for k, group in data.groupby("k"):
            out[f"{int(k)}+" if k == max_frequency else str(int(k))] = np.sort(group["monetary_value"].to_numpy())
        return out

    def plot_data(self, max_frequency: int = 7) -> DataFrame:
        """Box statistics by number of repeats, without moving the customers."""
        return box_stats(self._buyers, max_frequency)

    def plot(self, ax=None, **kwargs):
        return figures.draw_boxes(self.plot_data().orderBy("level").toPandas(), ax, **kwargs)

    def unpersist(self) -> None:
        """Release the repeat buyers; plots read the base again."""
        self._buyers.unpersist()

    def __repr__(self) -> str:
        return f"IndependenceCheck(rho={self.spearman_rho:.2f}, eta2={self.eta_squared:.2f}, {'holds' if self.holds() else 'violated'})"


def box_stats(buyers: DataFrame, max_frequency: int) -> DataFrame:
    level = F.least("frequency", F.lit(max_frequency)).alias("level")
    quarters = F.percentile("monetary_value", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    boxes = buyers.select(level, "monetary_value").groupBy("level").agg(F.count("*").cast("bigint").alias("customers"), quarters.alias("q"))
    return boxes.select("level", "customers", *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))])


def eta_squared(buyers: DataFrame) -> DataFrame:
    """One row: the share of the variance of spend between frequency levels; 0 if there is no variance."""
    z = F.col("monetary_value")
    levels = buyers.groupBy("frequency").agg(F.count("*").alias("n"), F.avg(z).alias("m"), F.var_pop(z).alias("v"))
    within, n = F.sum(F.col("n") * F.col("v")), F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / n
    sums = levels.agg(within.alias("within"), n.alias("n"), grand.alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"))
    # the between part as the variance of the level means, weighted: never negative
    between = F.greatest(F.col("squares") - F.col("n") * F.col("grand") * F.col("grand"), F.lit(0.0))
    total = between + F.col("within")
    return sums.select(F.when(total > 0, between / total).otherwise(F.lit(0.0)).alias("eta_squared"))


def spearman(buyers: DataFrame) -> float:
    """Rank correlation with average ranks on ties; ranks come from a distributed sort."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    both = VectorAssembler(inputCols=["frequency", "monetary_value"], outputCol="v").transform(buyers.select(F.col("frequency").cast("double"), "monetary_value"))
    return float(Correlation.corr(both, "v", "spearman").first()[0].toArray()[0, 1])


def check_monetary_independence(cb: CustomerBase, *, exclude: Iterable = ()) -> IndependenceCheck:
    """Assess the repeat buyers of a base, without the customers named in `exclude`."""
    if not isinstance(cb, CustomerBase):
        raise TypeError(f"expected a CustomerBase, got {type(cb).__name__}")
    if not cb.has_monetary:
        raise ValueError("the independence check needs spend: make the CustomerBase with an amount_col")
    summary, left_out = cb.to_spark(), list(exclude)
    if left_out:
        named = summary.sparkSession.createDataFrame([(i,) for i in left_out], summary.select(cb.id_col).schema)
        unknown = named.join(summary, cb.id_col, "left_anti").collect()
        if unknown:
            raise KeyError(f"exclude names customers not in this base: {[r[0] for r in unknown]}")
        summary = summary.join(F.broadcast(named), cb.id_col, "left_anti")  # as long as the caller's list
    buyers = summary.filter("frequency > 0").select(cb.id_col, "frequency", "monetary_value").persist()
    z = "monetary_value"
    n, low, high, least, most = buyers.agg(F.count("*"), F.min("frequency"), F.max("frequency"), F.min(z), F.max(z)).first()
    if not n:
        raise ValueError("no repeat buyers: nothing to assess")
    if low == high:
        raise ValueError(f"all repeat buyers have frequency {low}: one level shows no dependence")
    # a constant has no correlation
    r, rho = (float(buyers.agg(F.corr("frequency", z)).first()[0]), spearman(buyers)) if least < most else (float("nan"), float("nan"))
    eta = float(eta_squared(buyers).first()[0])
    return IndependenceCheck(
        buyers,
        {"n_customers": float(n), "pearson_r": r, "pearson_p": correlation_p(r, n), "spearman_rho": rho, "spearman_p": correlation_p(rho, n), "eta_squared": eta},
    )
