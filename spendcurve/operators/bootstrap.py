"""Parametric bootstrap: every replicate is a task that simulates a base and refits it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spendcurve.operators.results import SmallResult
from spendcurve.plans import figures


class ParameterUncertainty(SmallResult):
    """Per parameter: estimate, se, ci_low, ci_high."""

    def __init__(self, data: pd.DataFrame, spark, *, model_name: str, n_replicates: int, confidence: float, seed: int | None):
        super().__init__(data, spark)
        self.model_name, self.n_replicates, self.confidence, self.seed = model_name, n_replicates, confidence, seed

    def plot_data(self) -> pd.DataFrame:
        return self.to_pandas()

    def plot(self, ax=None, **kwargs):
        return figures.draw_intervals(self._data, ax, **kwargs)

    def __repr__(self) -> str:
        return f"ParameterUncertainty({self.model_name}, {self.n_replicates} replicates, {self.confidence:.0%})"


def parametric_bootstrap(model, cb, *, n: int, seed: int | None, confidence: float) -> ParameterUncertainty:
    """Refit the model on n bases drawn from its parameters, each customer keeping their age.

    The result depends on the seed alone, not on how replicates are spread over tasks. Refits without
    finite parameters are left out; two at least must remain.
    """
    if model.params_ is None:
        raise RuntimeError("the bootstrap needs a fitted model; this one is not fitted")
    if isinstance(n, bool) or int(n) != n or n < 2:
        raise ValueError(f"n must be a whole number of at least 2, got {n!r}")
    if not 0 < confidence < 1:
        raise ValueError(f"confidence must be in (0, 1), got {confidence!r}")
    from spendcurve.operators.purchase_models import simulated_groups

    summary = cb.to_spark()
    spark, cls, params = summary.sparkSession, type(model), [float(p) for p in model.params_]
    # one row per distinct age: as many as the observed span has periods
    ages = summary.groupBy("T").agg(F.count("*").alias("n")).orderBy("T").toPandas()
    at, counts = ages["T"].to_numpy(float), ages["n"].to_numpy(np.int64)
    entropy = np.random.SeedSequence(seed).entropy

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng(np.random.SeedSequence(entropy, spawn_key=(int(i),)))
                groups, weight = np.zeros((0, 3)), np.zeros(0)
                for rows in simulated_groups(cls, params, at, counts, rng):
                    # a block is folded into counts: customers without a repeat, most of them, are one row for each age
                    groups, place = np.unique(np.concatenate([groups, rows]), axis=0, return_inverse=True)
                    weight = np.bincount(place.ravel(), weights=np.concatenate([weight, np.ones(len(rows))]), minlength=len(groups))
                found = cls.fit_groups(groups[:, 0], groups[:, 1], groups[:, 2], weight)
                yield pd.DataFrame([[int(i), *np.exp(found.x)]], columns=["replicate", "r", "alpha", "a", "b"])

    n = int(n)
    frame = spark.range(0, n, 1, n).mapInPandas(refit, "replicate long, r double, alpha double, a double, b double")
    fits = frame.toPandas().sort_values("replicate").drop(columns="replicate").replace([np.inf, -np.inf], np.nan).dropna()
    if len(fits) < 2:
        raise RuntimeError(f"only {len(fits)} of {n} refits gave finite parameters")
    tail = (1 - confidence) / 2
    data = pd.DataFrame(
        {"estimate": model.params_, "se": fits.std(ddof=1), "ci_low": fits.quantile(tail), "ci_high": fits.quantile(1 - tail)}, index=pd.Index(model.params_.index, name="parameter")
    )
    return ParameterUncertainty(data, spark, model_name=cls.__name__, n_replicates=len(fits), confidence=confidence, seed=seed)
