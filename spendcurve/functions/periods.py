"""Calendar periods as 64-bit ordinals, in Catalyst expressions and for single timestamps."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From the finest to the coarsest.
UNITS = ("h", "D", "W", "M", "Q", "Y")
_ALIASES = {"H": "h", "A": "Y", "ME": "M", "QE": "Q", "YE": "Y", "d": "D"}


def unit(alias: str) -> str:
    """The canonical name of a period alias."""
    name = _ALIASES.get(alias, alias)
    if name not in UNITS:
        raise ValueError(f"period alias must be one of {UNITS}, got {alias!r}")
    return name


def finer(a: str, b: str) -> bool:
    return UNITS.index(unit(a)) < UNITS.index(unit(b))


def ruler_ratio(collapse: str, time_unit: str) -> int:
    """Grain periods in one ruler unit: 1 for equal ones, 7 for days in weeks."""
    grain, ruler = unit(collapse), unit(time_unit)
    if grain == ruler:
        return 1
    if finer(ruler, grain):
        raise ValueError(f"time_unit={time_unit!r} is finer than collapse={collapse!r}: events merged at the coarser grain have no place on it")
    if (grain, ruler) == ("D", "W"):
        return 7
    raise ValueError(f"there is no exact conversion from collapse={collapse!r} to time_unit={time_unit!r}")


def ordinal(ts: Column, alias: str) -> Column:
    """Periods since the one that holds 1970-01-01; weeks end on Sunday."""
    day = F.unix_date(ts.cast("date")).cast("bigint")
    months = (F.year(ts).cast("bigint") - 1970) * 12 + F.month(ts) - 1
    return {
        "h": lambda: day * 24 + F.hour(ts),
        "D": lambda: day,
        "W": lambda: F.floor((day + 10) / 7).cast("bigint"),
        "M": lambda: months,
        "Q": lambda: F.floor(months / 3).cast("bigint"),
        "Y": lambda: F.year(ts).cast("bigint") - 1970,
    }[unit(alias)]()


def ordinal_of(when, alias: str) -> int:
    """The ordinal of one timestamp."""
    at = pd.Timestamp(when)
    day = (at.date() - dt.date(1970, 1, 1)).days
    months = (at.year - 1970) * 12 + at.month - 1
    return {"h": day * 24 + at.hour, "D": day, "W": (day + 10) // 7, "M": months, "Q": months // 3, "Y": at.year - 1970}[unit(alias)]


def start(at: Column, alias: str) -> Column:
    """First day of a period, from its ordinal."""
    months = {"M": at, "Q": at * 3, "Y": at * 12}
    name = unit(alias)
    if name in months:
        m = months[name]
        return F.make_date((F.lit(1970) + F.floor(m / 12)).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))
    day = {"h": F.floor(at / 24), "D": at, "W": at * 7 - 10}[name]
    return F.date_from_unix_date(day.cast("int"))


def start_of(at: int, alias: str) -> pd.Timestamp:
    """First instant of a period, from its ordinal."""
    name = unit(alias)
    epoch = pd.Timestamp(1970, 1, 1)
    if name in ("M", "Q", "Y"):
        m = at * {"M": 1, "Q": 3, "Y": 12}[name]
        return pd.Timestamp(1970 + m // 12, m % 12 + 1, 1)
    return epoch + (pd.Timedelta(hours=at) if name == "h" else pd.Timedelta(days=at if name == "D" else 7 * at - 10))


def label(at: Column, alias: str) -> Column:
    """A period's name: 2024-01-05 09:00, 2024-01-05, 2024-01-01/2024-01-07, 1998-01, 1998Q1, 1998."""
    name, first = unit(alias), start(at, alias)
    year = F.date_format(first, "yyyy")
    return {
        "h": F.concat(F.date_format(first, "yyyy-MM-dd "), F.lpad(F.pmod(at, F.lit(24)).cast("string"), 2, "0"), F.lit(":00")),
        "D": F.date_format(first, "yyyy-MM-dd"),
        "W": F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(first, 6), "yyyy-MM-dd")),
        "M": F.date_format(first, "yyyy-MM"),
        "Q": F.concat(year, F.lit("Q"), F.quarter(first).cast("string")),
        "Y": year,
    }[name]


def timestamps(c: Column, kind: str, datetime_format: str | None = None) -> Column:
    """A date column as a timestamp: strings are parsed (Java pattern), an unreadable one raises; others pass."""
    if kind != "string":
        return c
    return F.to_timestamp(c, datetime_format) if datetime_format else F.to_timestamp(c)
