"""Gamma-Gamma: mean spend per purchase, independent of how often a customer buys."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.functions import special
from spendcurve.functions.optimize import minimize
from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.results import Prediction

LOCAL_ROWS = 2_000_000


class GammaGamma:
    """p, q and gamma by maximum likelihood over repeat buyers."""

    def __init__(self) -> None:
        self.params_: pd.Series | None = None
        self.log_likelihood_: float | None = None
        self._base: CustomerBase | None = None

    @staticmethod
    def log_likelihood(params, x, mean) -> np.ndarray:
        """Per customer; minus infinity outside the parameter space."""
        p, q, gamma = (float(v) for v in params)
        x, mean = np.asarray(x, dtype=float), np.asarray(mean, dtype=float)
        if min(p, q, gamma) <= 0:
            return np.full(x.shape, -np.inf)
        # the terms that grow with q and gamma are kept as ratios
        shape = special.lgamma_ratio(q, p * x) - special.lgamma(p * x)
        return shape - q * np.log1p(x * mean / gamma) + (p * x - 1) * np.log(mean) + p * x * np.log(x) - p * x * np.log(gamma + x * mean)

    @staticmethod
    def log_likelihood_column(params, x: Column, mean: Column) -> Column:
        p, q, gamma = (float(v) for v in params)
        px = F.lit(p) * x
        shape = special.lgamma_ratio_column(q, px) - special.lgamma_column(px)
        return shape - q * F.log1p(x * mean / gamma) + (px - 1) * F.ln(mean) + px * F.ln(x) - px * F.ln(gamma + x * mean)

    @staticmethod
    def spend_column(params, x: Column, mean: Column) -> Column:
        """Expected spend: the customer's mean, drawn to the population's; the latter without repeats."""
        p, q, gamma = (float(v) for v in params)
        return F.when(x > 0, F.lit(p) * (gamma + x * mean) / (F.lit(p) * x + q - 1)).otherwise(F.lit(p * gamma / (q - 1)))

    def fit(self, cb: CustomerBase) -> GammaGamma:
        buyers = self._buyers(cb)
        n, mean = buyers.agg(F.count("*"), F.avg("monetary_value")).first()
        if n <= LOCAL_ROWS:
            data = buyers.groupBy("frequency", "monetary_value").agg(F.count("*").alias("w")).toPandas()
            x, z, w = (data[c].to_numpy(float) for c in ("frequency", "monetary_value", "w"))
            found = minimize(lambda points: [-float(w @ self.log_likelihood(np.exp(v), x, z)) for v in points], np.log([1.0, 2.0, float(mean)]))
        else:
            buyers = buyers.persist()
            try:
                found = minimize(self._distributed(buyers), np.log([1.0, 2.0, float(mean)]))
            finally:
                buyers.unpersist()
        if not found.converged:
            raise RuntimeError(f"the Gamma-Gamma fit did not converge: {np.exp(found.x)}")
        self.params_ = pd.Series(np.exp(found.x), index=["p", "q", "gamma"])
        self.log_likelihood_, self._base = -found.value, cb
        if np.any(np.abs(found.x - [0, 0, np.log(float(mean))]) > 10):
            warnings.warn(f"GammaGamma ran to the border of the parameter space: {self.params_.to_dict()}; spend hardly differs between customers", UserWarning, stacklevel=2)
        return self

    def _distributed(self, buyers: DataFrame):
        def objective(points: list[np.ndarray]) -> list[float]:
            each = [self.log_likelihood_column(np.exp(v), F.col("frequency"), F.col("monetary_value")) for v in points]
            row = buyers.agg(*[F.sum(e).alias(f"v{k}") for k, e in enumerate(each)]).first()
            return [float("nan") if v is None else -float(v) for v in row]

        return objective

    def predict(self, cb: CustomerBase | None = None) -> Prediction:
        """Expected spend per purchase of every customer."""
        params = self._fitted()
        base = require_monetary(cb if cb is not None else self._base, "GammaGamma")
        value = self.spend_column(params, F.col("frequency"), F.col("monetary_value"))
        return Prediction(base.to_spark().select(base.id_col, value.alias("expected_spend")), name="expected_spend", description="expected spend per purchase")

    def population_mean(self) -> float:
        p, q, gamma = self._fitted()
        return p * gamma / (q - 1)

    def _fitted(self) -> list[float]:
        if self.params_ is None:
            raise RuntimeError("GammaGamma is not fitted; call fit(cb) first")
        return [float(v) for v in self.params_]

    @staticmethod
    def _buyers(cb: CustomerBase) -> DataFrame:
        require_monetary(cb, "GammaGamma")
        repeat = cb.to_spark().filter("frequency > 0")
        z = F.col("monetary_value")
        n, below, zero = repeat.agg(F.count("*"), F.count(F.when(z < 0, 1)), F.count(F.when(z == 0, 1))).first()
        if not n:
            raise ValueError("no repeat buyers: their spend is what GammaGamma is fitted on")
        if below:
            raise ValueError(f"GammaGamma needs positive monetary_value, {below} of {n} repeat buyers have a negative one")
        if zero:
            if zero == n:
                raise ValueError(f"{zero} of {n} repeat buyers have monetary_value 0: no spend to fit on")
            warnings.warn(f"{zero} of {n} repeat buyers have monetary_value 0 and are left out of the fit", UserWarning, stacklevel=3)
        return repeat.filter("monetary_value > 0").select("frequency", "monetary_value")

    def __repr__(self) -> str:
        if self.params_ is None:
            return "GammaGamma(not fitted)"
        return f"GammaGamma({', '.join(f'{k}={v:.4g}' for k, v in self.params_.items())})"


def require_monetary(cb: CustomerBase, who: str) -> CustomerBase:
    if not isinstance(cb, CustomerBase):
        raise TypeError(f"expected a CustomerBase, got {type(cb).__name__}")
    if not cb.has_monetary:
        raise ValueError(f"{who} needs spend: make the CustomerBase with an amount_col")
    return cb
