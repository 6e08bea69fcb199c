"""Discounted lifetime value: expected purchases per period, discounted, times expected spend and margin."""

from __future__ import annotations

import warnings
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.independence import IndependenceCheck, MonetaryIndependenceWarning, check_monetary_independence
from spendcurve.operators.purchase_models import BGNBD, PurchaseModel
from spendcurve.operators.results import Prediction
from spendcurve.operators.spend_model import GammaGamma, require_monetary
from spendcurve.plans import figures


class TransactionModel(Protocol):
    def fit(self, cb: CustomerBase) -> TransactionModel: ...

    def predict(self, t: float, cb: CustomerBase | None = None) -> Prediction: ...


class MonetaryModel(Protocol):
    def fit(self, cb: CustomerBase) -> MonetaryModel: ...

    def predict(self, cb: CustomerBase | None = None) -> Prediction: ...


def discounted(cumulative: Column, horizon: int, rate: float) -> Column:
    """Sum over periods t of the purchases in t over (1 + rate) ** t, from an array of cumulative purchases."""

    def part(t: Column) -> Column:
        before = F.when(t > 1, F.element_at(cumulative, F.greatest(t - 1, F.lit(1)))).otherwise(F.lit(0.0))
        return (F.element_at(cumulative, t) - before) / F.pow(F.lit(1.0 + rate), t)

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.lit(0.0), lambda s, t: s + part(t))


class CLVResult:
    """Per customer: expected_purchases, discounted_expected_transactions, expected_spend, clv."""

    def __init__(self, frame: DataFrame, *, horizon: int, discount_rate: float, margin: float, time_unit: str):
        self._frame = frame
        self.horizon, self.discount_rate, self.margin, self.time_unit = horizon, discount_rate, margin, time_unit

    @property
    def description(self) -> str:
        return f"lifetime value over {self.horizon} {self.time_unit}, discounted at {self.discount_rate:g} a {self.time_unit}, margin {self.margin:g}"

    def to_spark(self) -> DataFrame:
        return self._frame

    def to_pandas(self) -> pd.DataFrame:
        return self._frame.toPandas().set_index(self._frame.columns[0])

    def to_json(self) -> str:
        return self.to_pandas().to_json(orient="index")

    def plot_data(self) -> DataFrame:
        """Levels of the iso-value curves and the colour ceiling."""
        return figures.iso_levels(self._frame)

    def plot(self, ax=None, **kwargs):
        return figures.draw_points(figures.some(self._frame).toPandas(), "discounted_expected_transactions", "expected_spend", "discounted purchases", "expected spend", ax, **kwargs)

    def __repr__(self) -> str:
        return f"CLVResult({self.description})"


class CLV:
    """A transaction model and a monetary model, fitted together."""

    def __init__(self, transaction_model: TransactionModel | None = None, monetary_model: MonetaryModel | None = None, *, check_independence: bool = True):
        self.transaction_model = transaction_model if transaction_model is not None else BGNBD()
        self.monetary_model = monetary_model if monetary_model is not None else GammaGamma()
        self.check_independence = check_independence
        self._base: CustomerBase | None = None
        self._check: IndependenceCheck | None = None

    def fit(self, cb: CustomerBase) -> CLV:
        if not isinstance(cb, CustomerBase):
            raise TypeError(f"CLV expects a CustomerBase, got {type(cb).__name__}")
        if not cb.has_monetary:
            raise ValueError("CLV is a monetary quantity: make the CustomerBase with an amount_col")
        for model in (self.transaction_model, self.monetary_model):
            model.fit(cb)
        self._base, self._check = cb, None
        if self.check_independence:
            self._warn_of_dependence()
        return self

    def _warn_of_dependence(self) -> None:
        try:
            found = self.independence_check()
        except ValueError:  # too little data to assess is no verdict
            return
        if not found.holds():
            text = f"spend and frequency are not independent (rho={found.spearman_rho:.2f}, eta2={found.eta_squared:.2f}): CLV multiplies them as if they were"
            warnings.warn(text, MonetaryIndependenceWarning, stacklevel=3)

    def independence_check(self, cb: CustomerBase | None = None) -> IndependenceCheck:
        """Of the base given, or of the fitted one, for which it is computed once."""
        if cb is not None:
            return check_monetary_independence(cb)
        self._check = self._check or check_monetary_independence(self._fitted_base())
        return self._check

    def _fitted_base(self) -> CustomerBase:
        if self._base is None:
            raise RuntimeError("CLV is not fitted; call fit(cb) first")
        return self._base

    def predict(self, *, horizon: int, discount_rate: float = 0.0, margin: float = 1.0, cb: CustomerBase | None = None) -> CLVResult:
        """Value over the next `horizon` time units; `discount_rate` is per time unit."""
        if isinstance(horizon, bool) or horizon != int(horizon) or horizon <= 0:
            raise ValueError(f"horizon must be a positive whole number, got {horizon!r}")
        if discount_rate <= -1:
            raise ValueError(f"discount_rate must be above -1, got {discount_rate!r}")
        if margin <= 0:
            raise ValueError(f"margin must be positive, got {margin!r}")
        base, horizon = self._fitted_base() if cb is None else cb, int(horizon)
        key = base.id_col
        frame = self._scored(horizon, base, cb)
        det = discounted(F.col("cumulative"), horizon, float(discount_rate))
        frame = frame.select(
            key, F.element_at("cumulative", horizon).alias("expected_purchases"), det.alias("discounted_expected_transactions"), F.col("expected_spend").cast("double").alias("expected_spend")
        ).withColumn("clv", F.lit(float(margin)) * F.col("expected_spend") * F.col("discounted_expected_transactions"))
        return CLVResult(frame, horizon=horizon, discount_rate=float(discount_rate), margin=float(margin), time_unit=base.time_unit)

    def _scored(self, horizon: int, base: CustomerBase, cb: CustomerBase | None) -> DataFrame:
        """(id, cumulative, expected_spend): one select over the summary for the models here, joins for any other."""
        buys, spends = self.transaction_model, self.monetary_model
        if isinstance(buys, PurchaseModel) and isinstance(spends, GammaGamma):
            if cb is not None:
                buys._scored(cb)  # refuses another ruler
            spend = spends.spend_column(spends._fitted(), F.col("frequency"), F.col("monetary_value"))
            summary = require_monetary(base, "GammaGamma").to_spark()
            return summary.select(base.id_col, buys.cumulative_column([float(t) for t in range(1, horizon + 1)]), spend.alias("expected_spend"))
        spend = spends.predict(cb).to_spark()
        return self._cumulative(horizon, cb).join(spend.toDF(base.id_col, "expected_spend"), base.id_col)

    def _cumulative(self, horizon: int, cb: CustomerBase | None) -> DataFrame:
        """(id, cumulative): one pass for the models here, one prediction per period for any other."""
        times = [float(t) for t in range(1, horizon + 1)]
        if hasattr(self.transaction_model, "cumulative"):
            return self.transaction_model.cumulative(times, cb)
        out = None
        for k, t in enumerate(times):
            one = self.transaction_model.predict(t, cb).to_spark()
            one = one.toDF(one.columns[0], f"_c{k}")
            out = one if out is None else out.join(one, one.columns[0])
        return out.select(out.columns[0], F.array(*[F.col(f"_c{k}").cast("double") for k in range(horizon)]).alias("cumulative"))

    def __repr__(self) -> str:
        return f"CLV({self.transaction_model!r}, {self.monetary_model!r})"
