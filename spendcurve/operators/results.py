"""What an operator returns: a lazy DataFrame behind to_spark, to_pandas, to_json and plot."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from spendcurve.plans import figures


class Result(Protocol):
    def to_spark(self) -> DataFrame: ...

    def to_pandas(self) -> pd.DataFrame: ...

    def to_json(self) -> str: ...

    def plot(self): ...


class Prediction:
    """One number per customer under a name; `description` says what it is, with its unit."""

    def __init__(self, frame: DataFrame, *, name: str, description: str, silence: DataFrame | None = None, time_unit: str = ""):
        self._frame, self.name, self.description = frame, name, description
        self._silence, self._time_unit = silence, time_unit

    @property
    def id_col(self) -> str:
        return self._frame.columns[0]

    def to_spark(self) -> DataFrame:
        return self._frame

    def to_pandas(self) -> pd.DataFrame:
        return self._frame.toPandas().set_index(self.id_col)

    def to_json(self) -> str:
        return self.to_pandas().to_json(orient="index")

    def plot_data(self) -> DataFrame:
        """The points of silence against P(alive) where they are known, else histogram bins."""
        return self._silence if self._silence is not None else figures.histogram(self._frame, self.name)

    def plot(self, ax=None, **kwargs):
        if self._silence is not None:
            return figures.draw_points(figures.some(self._silence).toPandas(), "silence", self.name, f"silence ({self._time_unit})", self.description, ax, **kwargs)
        return figures.draw_bars(self.plot_data().toPandas(), self.description, ax, **kwargs)

    def __repr__(self) -> str:
        return f"Prediction({self.name!r}: {self.description})"


def values_of(prediction: Prediction) -> pd.Series:
    """The numbers of a prediction, whatever it is named, by customer."""
    return prediction.to_pandas().iloc[:, 0]


class SmallResult:
    """A result that fits the driver, with its rows as pandas."""

    def __init__(self, data: pd.DataFrame, spark):
        self._data, self._spark = data, spark

    def to_pandas(self) -> pd.DataFrame:
        return self._data.copy()

    def to_spark(self) -> DataFrame:
        return self._spark.createDataFrame(self._data.reset_index())

    def to_json(self) -> str:
        return self._data.to_json(orient="index")
