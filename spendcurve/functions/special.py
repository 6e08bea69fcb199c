"""Special functions in numpy, and the few that are needed as Catalyst expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8
#: Coefficients of the Stirling series, B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x) -> np.ndarray:
    """Log of the gamma function for positive numbers: Stirling's series after eight steps up."""
    x = np.asarray(x, dtype=float)
    product = np.ones_like(x)
    log_product = 0.0
    for k in range(_SHIFT):
        product = product * (x + k)
        if k == _SHIFT // 2:
            log_product, product = np.log(product), np.ones_like(x)
    log_product = log_product + np.log(product)
    z = x + _SHIFT
    series = sum(c / z ** (2 * k + 1) for k, c in enumerate(_STIRLING))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - log_product


def lgamma_ratio(q, s) -> np.ndarray:
    """ln gamma(q + s) - ln gamma(q) without the loss of digits that the difference has at large q."""
    q, s = np.asarray(q, dtype=float), np.asarray(s, dtype=float)
    z = q + _SHIFT
    steps = sum(np.log1p(s / (q + k)) for k in range(_SHIFT))
    series = sum(c * ((z + s) ** -(2 * k + 1) - z ** -(2 * k + 1)) for k, c in enumerate(_STIRLING))
    return (z - 0.5) * np.log1p(s / z) + s * np.log(z + s) - s + series - steps


def lgamma_column(x: Column) -> Column:
    """The same as an expression."""
    steps = F.lit(0.0)
    for k in range(_SHIFT):
        steps = steps + F.ln(x + k)
    z = x + _SHIFT
    series = F.lit(0.0)
    for k, c in enumerate(_STIRLING):
        series = series + F.lit(c) / F.pow(z, F.lit(float(2 * k + 1)))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def lgamma_ratio_column(q: float, s: Column) -> Column:
    """ln gamma(q + s) - ln gamma(q) as an expression, by ratios as `lgamma_ratio`."""
    z = q + _SHIFT
    steps, series = F.lit(0.0), F.lit(0.0)
    for k in range(_SHIFT):
        steps = steps + F.log1p(s / (q + k))
    for k, c in enumerate(_STIRLING):
        series = series + F.lit(c) * (F.pow(s + z, F.lit(-float(2 * k + 1))) - z ** -(2 * k + 1))
    return F.lit(z - 0.5) * F.log1p(s / z) + s * F.ln(s + z) - s + series - steps


def log_rising(r: float, x: Column) -> Column:
    """ln gamma(r + x) - ln gamma(r) for whole x >= 0: a sum of x logarithms."""
    k = F.when(x > 0, F.sequence(F.lit(0).cast("bigint"), x.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(k, F.lit(0.0), lambda s, i: s + F.ln(F.lit(float(r)) + i))


def hyp2f1(a, b, c, z, tolerance: float = 1e-15, limit: int = 20000) -> np.ndarray:
    """The Gauss series for 0 <= z < 1, summed until every element's next term is negligible."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z)))
    total, term = np.ones(z.shape), np.ones(z.shape)
    for k in range(limit):
        term = term * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        total = total + term
        if np.all(np.abs(term) <= tolerance * np.abs(total)):
            break
    return total


def hyp2f1_column(a: Column, b: Column, c: Column, z: Column, terms: int) -> Column:
    """The first terms of the Gauss series."""
    state = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        term = acc.getField("t") * (a + k) * (b + k) / ((c + k) * (k + 1)) * z
        return F.struct(term.alias("t"), (acc.getField("s") + term).alias("s"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), state, step, lambda acc: acc.getField("s"))


def beta_regularized(x: float, a: float, b: float) -> float:
    """The incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularized(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, out = 1.0, d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs: Student's t with n - 2 degrees of freedom."""
    if n < 3 or not math.isfinite(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return beta_regularized(df / (df + r * r * df / (1 - r * r)), df / 2, 0.5)
