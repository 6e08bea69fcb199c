"""What figures show, as small DataFrames; drawing needs matplotlib, which is imported only then."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Points of a scatter plot at most: those of the lowest hashes.
POINTS = 20_000


def some(frame: DataFrame) -> DataFrame:
    """A plot's points: all, or of more than POINTS an even sample that is the same every time."""
    return frame.orderBy(F.xxhash64(*frame.columns)).limit(POINTS)


def _axes(ax):
    if ax is not None:
        return ax
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise ImportError("plot() needs matplotlib; plot_data() gives the numbers without it") from e
    return plt.subplots()[1]


def histogram(frame: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count) over the finite values of a column; one bin if they are all the same."""
    value = F.col(f"`{column}`").cast("double")
    known = frame.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    low, high = known.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return frame.sparkSession.createDataFrame([], "bin int, low double, high double, count bigint")
    width = (high - low) / bins if high > low else 1.0
    at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    cells = known.groupBy(at.alias("bin")).agg(F.count("*").cast("bigint").alias("count"))
    return cells.select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), "count").orderBy("bin")


def iso_levels(frame: DataFrame, column: str = "clv", low: float = 0.40, high: float = 0.97, count: int = 4) -> DataFrame:
    """(kind, value): geometric levels between two quantiles, snapped to 1, 2 or 5 times a power of ten, and the colour ceiling."""
    spots = frame.filter(F.col(column) > 0).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q"), F.percentile(column, F.lit(0.95)).alias("top")).first()
    rows: list[tuple[str, float]] = []
    if spots.q and spots.q[0] is not None:
        a, b = spots.q
        raw = [a * (b / a) ** (k / (count - 1)) for k in range(count)] if a > 0 else []
        for level in sorted({min((m * 10.0**e for e in range(math.floor(math.log10(v)) - 1, math.floor(math.log10(v)) + 2) for m in (1, 2, 5)), key=lambda s: abs(math.log(s / v))) for v in raw}):
            rows.append(("level", level))
        rows.append(("ceiling", float(spots.top)))
    return frame.sparkSession.createDataFrame(rows, "kind string, value double")


def draw_bars(data: pd.DataFrame, label: str, ax=None, **kwargs):
    ax = _axes(ax)
    ax.bar(data["low"], data["count"], width=data["high"] - data["low"], align="edge", **kwargs)
    ax.set_xlabel(label)
    ax.set_ylabel("customers")
    return ax


def draw_points(data: pd.DataFrame, x: str, y: str, x_label: str, y_label: str, ax=None, **kwargs):
    ax = _axes(ax)
    ax.scatter(data[x], data[y], **{"s": 8, "alpha": 0.4} | kwargs)
    ax.set_xlabel(x_label)
    ax.set_ylabel(y_label)
    return ax


def draw_intervals(data: pd.DataFrame, ax=None, **kwargs):
    ax = _axes(ax)
    spread = [data["estimate"] - data["ci_low"], data["ci_high"] - data["estimate"]]
    ax.errorbar(data["estimate"], range(len(data)), xerr=spread, fmt="o", **kwargs)
    ax.set_yticks(range(len(data)), list(data.index))
    return ax


def draw_boxes(boxes: pd.DataFrame, ax=None, **kwargs):
    """Boxes from their five numbers, level by level; the last level is open."""
    ax = _axes(ax)
    last = boxes["level"].max() if len(boxes) else 0
    stats = [
        {"label": f"{int(r.level)}+" if r.level == last else str(int(r.level)), "whislo": r.low, "q1": r.q1, "med": r.median, "q3": r.q3, "whishi": r.high}
        for r in boxes.itertuples()
    ]
    ax.bxp(stats, **{"showfliers": False} | kwargs)
    ax.set_xlabel("repeat purchases")
    ax.set_ylabel("mean spend")
    return ax


def draw_heatmap(wide: pd.DataFrame, ax=None, **kwargs):
    ax = _axes(ax)
    ax.set_facecolor("lightgrey")
    ax.imshow(wide.to_numpy(dtype=float), aspect="auto", **kwargs)
    ax.set_yticks(range(len(wide)), [str(i) for i in wide.index])
    ax.set_xlabel("periods since the first purchase")
    return ax


def draw_line(data: pd.DataFrame, x: str, y: str, ax=None, **kwargs):
    ax = _axes(ax)
    data = data.sort_values(x)
    ax.plot(data[x], data[y], **{"marker": "o"} | kwargs)
    ax.set_ylim(0, 1)
    ax.set_xlabel("periods since the first purchase")
    ax.set_ylabel("share alive")
    return ax
