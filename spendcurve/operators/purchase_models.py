"""BG/NBD and MBG/NBD: purchases until an unseen dropout. Fits on the compressed summary, scores by projection.

x is frequency, t recency, T age. Purchases come at a gamma(r, alpha) rate; after each repeat (and, in the
modified model, also at the start) a customer drops out with a beta(a, b) probability.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.functions import special
from spendcurve.functions.optimize import minimize
from spendcurve.operators.bootstrap import ParameterUncertainty, parametric_bootstrap
from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.results import Prediction

#: Groups of equal (x, t, T) that are fitted on the driver; beyond, every step of the search is a distributed sum.
LOCAL_GROUPS = 2_000_000
NAMES = ("r", "alpha", "a", "b")


class PurchaseModel:
    """What both models share. `extra` is 1 where the first purchase may also be the last."""

    extra: ClassVar[int]

    def __init__(self) -> None:
        self.params_: pd.Series | None = None
        self.log_likelihood_: float | None = None
        self.converged_: bool | None = None
        self._base: CustomerBase | None = None

    # ---- likelihood

    @classmethod
    def log_likelihood(cls, params, x, t, T) -> np.ndarray:
        """Per customer, at params (r, alpha, a, b)."""
        r, alpha, a, b = (float(p) for p in params)
        x, t, T = (np.asarray(v, dtype=float) for v in (x, t, T))
        lg, e = special.lgamma, cls.extra
        scale = lg(r + x) - lg(r) + r * np.log(alpha)
        stays = lg(a + b) + lg(b + x + e) - lg(b) - lg(a + b + x + e)
        alive = -(r + x) * np.log(alpha + T)
        last = np.log(a) - np.log(b + np.maximum(x, 1 - e) + e - 1) - (r + x) * np.log(alpha + t)
        if not e:
            last = np.where(x > 0, last, -np.inf)
        return scale + stays + np.logaddexp(alive, last)

    @classmethod
    def log_likelihood_column(cls, params, x: Column, t: Column, T: Column) -> Column:
        """The same as an expression; x is whole, so gamma ratios are sums of x logarithms."""
        r, alpha, a, b = (float(p) for p in params)
        e = cls.extra
        n = x + e
        scale = special.log_rising(r, x) + F.lit(r) * F.ln(F.lit(alpha))
        stays = special.log_rising(b, n) - special.log_rising(a + b, n)
        alive = -(F.lit(r) + x) * F.ln(F.lit(alpha) + T)
        last = F.ln(F.lit(a)) - F.ln(F.lit(b) + F.greatest(x, F.lit(1 - e)) + (e - 1)) - (F.lit(r) + x) * F.ln(F.lit(alpha) + t)
        top = F.greatest(alive, last)
        both = top + F.log1p(F.exp(-F.abs(alive - last)))
        return scale + stays + (both if e else F.when(x > 0, both).otherwise(alive))

    # ---- scores

    @classmethod
    def alive_column(cls, params, x: Column, t: Column, T: Column) -> Column:
        r, alpha, a, b = (float(p) for p in params)
        e = cls.extra
        odds = F.lit(a) / (F.lit(b) + F.greatest(x, F.lit(1 - e)) + (e - 1)) * F.pow((F.lit(alpha) + T) / (F.lit(alpha) + t), F.lit(r) + x)
        return 1 / (1 + (odds if e else F.when(x > 0, odds).otherwise(F.lit(0.0))))

    @classmethod
    def alive(cls, params, x, t, T) -> np.ndarray:
        r, alpha, a, b = params
        e = cls.extra
        with np.errstate(over="ignore"):
            odds = a / (b + np.maximum(x, 1 - e) + e - 1) * ((alpha + T) / (alpha + t)) ** (r + x)
        return 1 / (1 + (odds if e else np.where(x > 0, odds, 0.0)))

    @classmethod
    def expected(cls, params, horizon, x, t, T) -> np.ndarray:
        """Expected purchases in the next `horizon` units, by the transformed hypergeometric series.

        At a = 1 the formula is 0 / 0; a is moved by 1e-6 there.
        """
        r, alpha, a, b = (float(p) for p in params)
        a = a if abs(a - 1) > 1e-6 else 1 + 1e-6
        e = cls.extra
        z = horizon / (alpha + T + horizon)
        left = (1 - z) ** (a - 1) * special.hyp2f1(a + b - 1 + e - r, a - 1, a + b + x - 1 + e, z)
        return (a + b + x - 1 + e) / (a - 1) * (1 - left) * cls.alive(params, x, t, T)

    @classmethod
    def expected_column(cls, params, horizon: float, x: Column, t: Column, T: Column, terms: int = 400) -> Column:
        """The same as an expression, with a fixed number of terms."""
        r, alpha, a, b = (float(p) for p in params)
        e = cls.extra
        z = F.lit(float(horizon)) / (F.lit(alpha) + T + float(horizon))
        series = special.hyp2f1_column(F.lit(a + b - 1 + e - r), F.lit(a - 1), F.lit(a + b - 1 + e) + x, z, terms)
        left = F.pow(1 - z, F.lit(a - 1)) * series
        return (F.lit(a + b - 1 + e) + x) / F.lit(a - 1) * (1 - left) * cls.alive_column(params, x, t, T)

    # ---- fit

    def fit(self, cb: CustomerBase) -> PurchaseModel:
        """Maximum likelihood over all customers. Warns if the search does not settle or runs to a border."""
        checked(cb)
        groups = cb.sufficient_statistics()
        if groups.limit(LOCAL_GROUPS + 1).count() <= LOCAL_GROUPS:
            data = groups.toPandas()
            found = self.fit_groups(*(data[c].to_numpy(dtype=float) for c in ("frequency", "recency", "T", "customers")))
        else:
            groups = groups.persist()
            try:
                found = self._search(self._distributed(groups))
            finally:
                groups.unpersist()
        self.params_ = pd.Series(np.exp(found.x), index=list(NAMES))
        self.log_likelihood_, self.converged_, self._base = -found.value, found.converged, cb
        if not found.converged or np.any(np.abs(found.x) > 12):
            warnings.warn(f"{type(self).__name__} did not settle inside the parameter space: {self.params_.to_dict()}", UserWarning, stacklevel=2)
        return self

    @classmethod
    def fit_groups(cls, x, t, T, weight):
        return cls._search(lambda points: [-float(weight @ cls.log_likelihood(np.exp(p), x, t, T)) for p in points])

    @classmethod
    def _search(cls, objective):
        return minimize(objective, np.zeros(4))

    def _distributed(self, groups: DataFrame):
        def objective(points: list[np.ndarray]) -> list[float]:
            each = [self.log_likelihood_column(np.exp(p), F.col("frequency"), F.col("recency"), F.col("T")) for p in points]
            row = groups.agg(*[F.sum(F.col("customers") * e).alias(f"v{k}") for k, e in enumerate(each)]).first()
            return [math.nan if v is None else -float(v) for v in row]

        return objective

    def _fitted(self) -> list[float]:
        if self.params_ is None:
            raise RuntimeError(f"{type(self).__name__} is not fitted; call fit(cb) first")
        return [float(p) for p in self.params_]

    def _scored(self, cb: CustomerBase | None) -> CustomerBase:
        self._fitted()
        if cb is None:
            if self._base is None:
                raise RuntimeError(f"{type(self).__name__} is not fitted on a base; pass cb")
            return self._base
        checked(cb, empty_ok=True)
        if self._base is not None:
            for name in ("time_unit", "collapse"):
                mine, its = getattr(self._base, name), getattr(cb, name)
                if mine != its:
                    raise ValueError(f"the model was fitted with {name}={mine!r}, the base to score has {name}={its!r}")
        return cb

    # ---- predictions

    def predict(self, t: float, cb: CustomerBase | None = None) -> Prediction:
        """Expected purchases in the next `t` time units, per customer."""
        if not t > 0:
            raise ValueError(f"t must be positive, got {t!r}")
        base = self._scored(cb)
        values = self.cumulative([float(t)], base).select(base.id_col, F.col("cumulative")[0].alias("expected_purchases"))
        return Prediction(values, name="expected_purchases", description=f"purchases expected in the next {t:g} {base.time_unit}")

    def cumulative(self, times: list[float], cb: CustomerBase | None = None) -> DataFrame:
        """(id, cumulative array): expected purchases up to each time, in one pass."""
        base = self._scored(cb)
        return base.to_spark().select(base.id_col, self.cumulative_column(times))

    def cumulative_column(self, times: list[float]) -> Column:
        """The same as a column of a summary."""
        params, cls = self._fitted(), type(self)

        @F.pandas_udf("array<double>")
        def score(x: pd.Series, t: pd.Series, T: pd.Series) -> pd.Series:
            values = [cls.expected(params, h, x.to_numpy(float), t.to_numpy(float), T.to_numpy(float)) for h in times]
            return pd.Series(list(np.stack(values, axis=1))) if len(x) else pd.Series([], dtype=object)

        return score(F.col("frequency").cast("double"), F.col("recency").cast("double"), F.col("T").cast("double")).alias("cumulative")

    def probability_alive(self, cb: CustomerBase | None = None) -> Prediction:
        base = self._scored(cb)
        value = self.alive_column(self._fitted(), F.col("frequency"), F.col("recency"), F.col("T")).alias("probability_alive")
        frame = base.to_spark().select(base.id_col, value)
        silence = base.to_spark().select((F.col("T") - F.col("recency")).alias("silence"), "frequency", value)
        return Prediction(frame, name="probability_alive", description="probability of being alive", silence=silence, time_unit=base.time_unit)

    def parameter_uncertainty(self, *, n: int = 200, seed: int | None = None, confidence: float = 0.95) -> ParameterUncertainty:
        """Standard errors and intervals from refits on n simulated bases of the same ages."""
        if self.params_ is None or self._base is None:
            raise RuntimeError(f"{type(self).__name__} is not fitted; call fit(cb) first")
        return parametric_bootstrap(self, self._base, n=n, seed=seed, confidence=confidence)

    @classmethod
    def simulate(cls, params, T: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Draw (x, t) for customers of ages T: exponential gaps until the age, a dropout draw after each repeat."""
        r, alpha, a, b = params
        T = np.asarray(T, dtype=float)
        rate = np.maximum(rng.gamma(r, 1 / alpha, len(T)), 1e-12)
        drop = rng.beta(a, b, len(T))
        x, t, clock = np.zeros(len(T)), np.zeros(len(T)), np.zeros(len(T))
        going = np.arange(len(T))
        if cls.extra:
            going = going[rng.random(len(T)) >= drop]
        while len(going):
            clock[going] += rng.exponential(1 / rate[going])
            going = going[clock[going] <= T[going]]
            x[going] += 1
            t[going] = clock[going]
            going = going[rng.random(len(going)) >= drop[going]]
        return x, t

    def __repr__(self) -> str:
        if self.params_ is None:
            return f"{type(self).__name__}(not fitted)"
        return f"{type(self).__name__}({', '.join(f'{k}={v:.4g}' for k, v in self.params_.items())})"


class BGNBD(PurchaseModel):
    """Beta-geometric/NBD: who never repeated is alive for certain."""

    extra = 0


class MBGNBD(PurchaseModel):
    """Modified BG/NBD: the first purchase may also be the last."""

    extra = 1


def checked(cb: CustomerBase, empty_ok: bool = False) -> DataFrame:
    """The summary of a base, if it is one and can be true; one small job."""
    if not isinstance(cb, CustomerBase):
        raise TypeError(f"expected a CustomerBase, got {type(cb).__name__}")
    summary = cb.to_spark()
    missing = [c for c in ("frequency", "recency", "T") if c not in summary.columns]
    if missing:
        raise ValueError(f"CustomerBase lacks required columns: {missing}")
    wrong = F.col("recency") > F.col("T")
    below = (F.col("frequency") < 0) | (F.col("recency") < 0) | (F.col("T") < 0)
    n, later, negative = summary.agg(F.count("*"), F.count(F.when(wrong, 1)), F.count(F.when(below, 1))).first()
    if not n and not empty_ok:
        raise ValueError("CustomerBase is empty: nothing to fit")
    if later:
        raise ValueError(f"CustomerBase has {later} customers with recency > T")
    if negative:
        raise ValueError(f"CustomerBase has {negative} customers with negative frequency, recency or T")
    return summary


def simulated_groups(cls: type[PurchaseModel], params, ages: np.ndarray, counts: np.ndarray, rng: np.random.Generator, block: int = 500_000) -> Iterator[np.ndarray]:
    """Simulated (x, t, T) rows for a base of these ages, in blocks of customers."""
    ends = np.cumsum(counts)
    for a in range(0, int(ends[-1]), block):
        b = min(a + block, int(ends[-1]))
        T = ages[np.searchsorted(ends, np.arange(a, b), side="right")]
        x, t = cls.simulate(params, T, rng)
        yield np.stack([x, t, T], axis=1)
