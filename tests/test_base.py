"""Logs whose summaries are known by hand, and every warning and refusal."""

import datetime as dt
import random
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendcurve import CustomerBase
from spendcurve.functions import periods


def log(spark, rows, parts=2):
    return spark.createDataFrame([(i, None if d is None else pd.Timestamp(d).to_pydatetime(), a) for i, d, a in rows], "customer_id string, date timestamp_ntz, amount double").repartition(parts)


def base(spark, rows, *args, **options):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = CustomerBase.from_transactions(log(spark, rows), *args, **options)
    return found, [str(w.message) for w in said if w.category is UserWarning]


def rows_of(cb):
    return {r[0]: tuple(r)[1:] for r in cb.to_spark().collect()}


A = [("A", f"2020-01-{d:02}", float(10 * k)) for k, d in enumerate((1, 5, 10, 15, 20), 1)]


def test_ordinals_equal_pandas(spark):
    rng = random.Random(0)
    stamps = [dt.datetime(1900, 1, 1) + dt.timedelta(seconds=rng.randrange(201 * 365 * 86400)) for _ in range(500)]
    frame = spark.createDataFrame([(k, s) for k, s in enumerate(stamps)], "k int, ts timestamp_ntz")
    for unit in periods.UNITS:
        got = {r.k: (r.o, r.s, r.l) for r in frame.select("k", periods.ordinal(F.col("ts"), unit).alias("o"), periods.start(periods.ordinal(F.col("ts"), unit), unit).alias("s"), periods.label(periods.ordinal(F.col("ts"), unit), unit).alias("l")).collect()}
        for k, stamp in enumerate(stamps):
            own = pd.Timestamp(stamp).to_period(unit)
            assert got[k][0] == own.ordinal == periods.ordinal_of(stamp, unit)
            assert got[k][1] == own.start_time.date() and periods.start_of(own.ordinal, unit) == own.start_time
            assert got[k][2] == str(own)


@pytest.mark.parametrize(
    ("rows", "options", "want"),
    [
        (A, {}, {"A": (4, 19, 19, 35.0)}),
        ([A[0], A[-1], ("B", "2020-01-01", 100.0)], {}, {"A": (1, 19, 19, 50.0), "B": (0, 0, 19, 0.0)}),
        ([("C", "2020-02-01", 10.0), ("C", "2020-02-01", 15.0), ("C", "2020-02-05", 20.0)], {}, {"C": (1, 4, 4, 20.0)}),
        ([("A", "2020-01-01", 1.0), ("A", "2020-01-11", 2.0)], {"observation_period_end": "2020-01-21"}, {"A": (1, 10, 20, 2.0)}),
        ([("D", "2020-01-01", 10.0), ("D", "2020-01-01", -3.0), ("D", "2020-01-10", 5.0), ("D", "2020-01-10", -8.0)], {}, {"D": (1, 9, 9, 0.0)}),
        ([("A", "2020-01-01", 10.0), ("A", "2020-01-10", 0.0), ("B", "2020-01-01", 0.0)], {}, {"A": (1, 9, 9, 0.0), "B": (0, 0, 9, 0.0)}),
        ([("R", "2020-01-01", -10.0), ("Z", "2020-01-05", 100.0)], {}, {"Z": (0, 0, 0, 0.0)}),
        ([("E", "2020-01-01", 10.0), ("E", "2020-01-10", -5.0), ("E", "2020-01-20", 7.0)], {"on_negative": "drop"}, {"E": (1, 19, 19, 7.0)}),
        ([("N", "2020-01-01", 10.0), ("N", "2020-01-03", float("nan")), ("N", "2020-01-05", 7.0)], {}, {"N": (1, 4, 4, 7.0)}),
    ],
)
def test_summaries(spark, rows, options, want):
    assert rows_of(base(spark, rows, **options)[0]) == want


def test_ruler_and_grain(spark):
    rows = [("alice", "2024-01-01", 10.0), ("alice", "2024-01-03", 20.0), ("alice", "2024-02-05", 30.0)]
    fine, said = base(spark, rows, time_unit="W", collapse="D")
    assert rows_of(fine) == {"alice": (2, 5.0, 5.0, 25.0)} and not said
    assert dict(fine.to_spark().dtypes) == {"customer_id": "string", "frequency": "bigint", "recency": "double", "T": "double", "monetary_value": "double"}
    coarse, said = base(spark, rows, time_unit="W")
    assert rows_of(coarse)["alice"][0] == 1 and "collapsed 1 of 3 transactions" in said[0]
    assert not base(spark, rows, time_unit="W", collapse="W")[1] and not base(spark, rows, time_unit="h")[1]
    with pytest.raises(ValueError, match="finer"):
        base(spark, rows, time_unit="D", collapse="W")
    with pytest.raises(ValueError, match="no exact conversion"):
        base(spark, rows, time_unit="M", collapse="D")
    with pytest.raises(ValueError, match="period alias"):
        base(spark, rows, time_unit="fortnight")


MIXED = [
    ("alice", "2024-01-01", 10.0), ("alice", "2024-01-03", 20.0), ("alice", "2024-02-05", 30.0), ("bob", "2024-01-02", 5.0), ("bob", "2024-01-20", 8.0), ("bob", "2024-01-20", -8.0),
    ("carol", "2024-02-10", 40.0), ("carol", "2024-03-01", 9.0), ("dave", "2024-01-15", 12.0), ("dave", "2024-02-01", -12.0), ("erin", "2024-03-05", 3.0), ("erin", "2024-03-06", 4.0),
]


@pytest.mark.parametrize("parts", [1, 2, 5, 12])
def test_result_does_not_depend_on_partitions(spark, parts):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = CustomerBase.from_transactions(log(spark, MIXED, parts), time_unit="W", collapse="D")
    assert rows_of(found)["alice"] == (2, 5.0, 65 / 7, 25.0) and rows_of(found)["dave"] == (0, 0.0, 51 / 7, 0.0)
    assert [str(w.message)[:40] for w in said if w.category is UserWarning] == ["on_negative='net' netted 1 of 10 purchas"]
    assert found.sufficient_statistics().agg(F.sum("customers")).first()[0] == 5


def test_policies_agree_on_timing(spark):
    nets, drops = (base(spark, MIXED, on_negative=p)[0] for p in ("net", "drop"))
    assert {k: v[:3] for k, v in rows_of(nets).items()} == {k: v[:3] for k, v in rows_of(drops).items()}


def test_warnings(spark):
    assert "1 of 3 rows have no 'customer_id'" in base(spark, [("A", "2020-01-01", 1.0), (None, "2020-01-02", 7.0), ("A", "2020-01-10", 2.0)])[1][0]
    assert "1 of 2 rows have no date" in base(spark, [("A", "2020-01-01", 1.0), ("A", None, 7.0)])[1][0]
    assert "dropped 1 of 2 customers entirely" in base(spark, [("R", "2020-01-01", -10.0), ("Z", "2020-01-05", 1.0)])[1][0]
    assert "discarded 1 of 3 transactions" in base(spark, [("E", "2020-01-01", 10.0), ("E", "2020-01-10", -5.0), ("E", "2020-01-20", 7.0)], on_negative="drop")[1][0]
    assert "netted 2 of 3 purchase events" in base(spark, [("A", "2020-01-01", 10.0), ("A", "2020-01-10", 0.0), ("B", "2020-01-01", 0.0)])[1][0]


def test_summary_takes_two_exchanges_and_no_sort(spark):
    lazy, _ = base(spark, A, validate=False, observation_period_end="2020-01-20")
    plan = lazy.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan and "Sort" not in plan


def test_mean_spend_leaves_the_first_event_out_exactly(spark):
    days = pd.date_range("2020-01-01", periods=5).strftime("%Y-%m-%d")
    logs = {
        "cents": [1e9, 0.1, 0.2, 10.1, 12.34], "fine": [7.123456789, 1 / 3, 2 / 7, 0.1, 5.0], "huge": [1e15, 3.0, 4.0, 5.0, 6.0], "refunded": [-5.0, 8.5, 0.0, 8.5, 8.5],
    }
    rows = [(who, d, v) for who, values in logs.items() for d, v in zip(days, values)]
    found = {r.customer_id: r.monetary_value for r in base(spark, rows)[0].to_spark().collect()}
    assert found["cents"] == 5.685
    assert found["fine"] == pytest.approx((1 / 3 + 2 / 7 + 0.1 + 5.0) / 4, rel=1e-14)
    assert found["huge"] == pytest.approx(4.5, rel=0.05)  # beyond whole parts a sum of doubles is less its first part
    assert found["refunded"] == 8.5


def test_refusals(spark):
    with pytest.raises(ValueError, match="on_negative must be one of"):
        base(spark, A, on_negative="ignore")
    with pytest.raises(ValueError, match="does not truncate the log"):
        base(spark, A, observation_period_end="2020-01-10")
    with pytest.raises(ValueError, match="negative amounts found"):
        base(spark, [("F", "2020-01-01", -1.0)], on_negative="raise")
    with pytest.raises(TypeError):
        CustomerBase.from_transactions([1, 2])
    with pytest.raises(KeyError):
        base(spark, A, "nobody")
    with pytest.raises(ValueError, match="validate=False"):
        base(spark, A, validate=False)
    lazy, said = base(spark, A, validate=False, observation_period_end="2020-01-20")
    assert rows_of(lazy) == {"A": (4, 19, 19, 35.0)} and not said
    with pytest.raises(ValueError, match="split"):
        CustomerBase.from_summary(lazy.to_spark()).split(calibration_period_end="2020-01-05")


def test_inputs_of_other_kinds(spark):
    frame = pd.DataFrame({"who": [1.0, 1.0, float("nan")], "day": ["01/02/2020", "05/02/2020", "06/02/2020"], "extra": [1, 2, 3]})
    with pytest.warns(UserWarning, match="1 of 3 rows"):
        found = CustomerBase.from_transactions(frame, "who", "day", None, datetime_format="dd/MM/yyyy")
    assert rows_of(found) == {1.0: (1, 4, 4)} and not found.has_monetary
    assert found.to_spark().columns == ["who", "frequency", "recency", "T"]
    empty, _ = base(spark, [])
    assert empty.to_spark().count() == 0 and "0 customers" in repr(empty)


def test_split(spark):
    rows = [("A", f"2020-0{m}-01", 10.0 * m) for m in range(1, 6)] + [("C", "2020-02-15", 60.0), ("B", "2020-05-01", 100.0)]
    early, late = base(spark, rows)[0].split(calibration_period_end="2020-03-31", observation_period_end="2020-06-30")
    assert rows_of(early) == {"A": (2, 60, 90, 25.0), "C": (0, 0, 45, 0.0)}
    assert {r[0]: tuple(r)[1:] for r in late.collect()} == {"A": (2, 45.0, 91), "C": (0, 0.0, 91)} or {r.customer_id: (r.frequency_holdout, r.monetary_value_holdout, r.duration_holdout) for r in late.collect()} == {"A": (2, 45.0, 91), "C": (0, 0.0, 91)}
    assert base(spark, rows)[0].split(calibration_period_end="2020-03-31")[1].first().duration_holdout == 31
    weekly = base(spark, rows, time_unit="W")[0].split(calibration_period_end="2020-03-31", observation_period_end="2020-06-30")[1]
    assert weekly.first().duration_holdout == 13
    assert early.observation_period_end == pd.Timestamp("2020-03-31")


def test_display_is_inert(spark):
    found, _ = base(spark, MIXED, time_unit="W", collapse="D")
    assert "\n" not in repr(found) and "W/D" in repr(found) and "5 customers" in repr(found)
    text = str(found)
    assert "2024-03-06" in text and "events kept at 'D'" in text and "repeat buyers carry the likelihood" in text and "GammaGamma" in text
    none, _ = base(spark, MIXED, amount_col=None)
    assert "amount_col=None" in str(none) and "refused" in str(none) and "[D]" in repr(none)
    half = CustomerBase.__new__(CustomerBase)
    assert "CustomerBase" in repr(half) and "CustomerBase" in str(half)


def test_sinks(spark):
    found, _ = base(spark, A)
    copy = found.to_pandas()
    copy.loc["A", "frequency"] = 99
    assert found.to_pandas().loc["A", "frequency"] == 4 and '"A"' in found.to_json()
