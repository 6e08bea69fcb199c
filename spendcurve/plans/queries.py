"""The queries of the core library and their SQL. Model scores are taken at given parameters, so that SQL can follow."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcurve.functions import periods
from spendcurve.operators import customer_base as cbase
from spendcurve.operators import independence, recipes
from spendcurve.operators.cohorts import CohortMatrix, CohortSurvival, cohort_ordinal
from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.lifetime_value import CLV
from spendcurve.operators.purchase_models import BGNBD, MBGNBD
from spendcurve.operators.spend_model import GammaGamma
from spendcurve.plans import figures, logs
from spendcurve.sources.logs import as_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Parameters at which the queries score, near the fits on the lapsing log.
EVENT_PARAMS = (0.5, 62.0, 2.0, 8.0)
SPEND_PARAMS = (6.25, 3.75, 1_500_000.0)
HORIZON, RATE, MARGIN = 6, 0.01, 0.25
CALIBRATION_END = "2000-01-31"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def quiet(log: DataFrame, *columns, **options) -> CustomerBase:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return CustomerBase.from_transactions(log, *columns, **options)


def in_money(frame: DataFrame, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.col(name) / 100.0)
    return frame


# ---- periods, events, summaries

_ORDINALS = {"h": "hour_ord", "D": "day_ord", "W": "week_ord", "M": "month_ord", "Q": "quarter_ord", "Y": "year_ord"}


@query("bucket_ordinals", "SELECT event_id, " + ", ".join(f"CAST({logs.ordinal(u)} AS BIGINT) AS {n}" for u, n in _ORDINALS.items()) + " FROM events")
def bucket_ordinals(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", *[periods.ordinal(F.col("ts"), u).cast("bigint").alias(n) for u, n in _ORDINALS.items()])


@query(
    "period_labels",
    f"""SELECT DISTINCT strftime(DATE '1970-01-01' + CAST(w * 7 - 10 AS INTEGER), '%Y-%m-%d') || '/' || strftime(DATE '1970-01-01' + CAST(w * 7 - 4 AS INTEGER), '%Y-%m-%d') AS week,
      strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y') || 'Q' || quarter(ts) AS quarter, strftime(ts, '%Y') AS year
      FROM (SELECT o_orderdate AS ts, {logs.ordinal("W", "o_orderdate")} AS w FROM orders)""",
)
def period_labels(spark, d):
    ts = F.col("date")
    named = [periods.label(periods.ordinal(ts, u), u).alias(n) for u, n in (("W", "week"), ("M", "month"), ("Q", "quarter"), ("Y", "year"))]
    return logs.orders(spark, d).select(*named).distinct()


def _events(policy: str) -> Query:
    def run(spark, d):
        log = cbase.normalized_log(logs.refunds(spark, d), "customer_id", "date", "amount")
        events = cbase.purchase_events(cbase.bucket_totals(log, "D", True), policy, True)
        return in_money(events.withColumnRenamed("id", "customer_id"), "spend")

    return run


for _policy in ("net", "drop"):
    query(f"events_{_policy}", f"WITH {logs.events(logs.REFUNDS, 'D', _policy)} SELECT id AS customer_id, CAST(b AS BIGINT) AS bucket, CAST(spend AS DOUBLE) / 100.0::DOUBLE AS spend FROM events")(_events(_policy))


@query("events_raise", f"WITH {logs.events(logs.ORDERS, 'D', 'drop')} SELECT id AS customer_id, CAST(b AS BIGINT) AS bucket, spend / 100.0::DOUBLE AS spend FROM events")
def events_raise(spark, d):
    base = quiet(logs.orders(spark, d), on_negative="raise")
    return in_money(base.events().withColumnRenamed("id", "customer_id"), "spend")


@query("events_timing_only", f"WITH {logs.events(logs.PURCHASES, 'D')} SELECT id AS customer_id, CAST(b AS BIGINT) AS bucket FROM events")
def events_timing_only(spark, d):
    return quiet(logs.purchases(spark, d), amount_col=None).events().withColumnRenamed("id", "customer_id")


def _rfm(source: Callable, monetary: bool = True, **options) -> Query:
    def run(spark, d):
        extra = {} if monetary else {"amount_col": None}
        out = quiet(source(spark, d), **extra, **options).to_spark()
        return in_money(out, "monetary_value") if monetary else out

    return run


_RFM = {
    "rfm_daily": (logs.orders, logs.ORDERS, {"time_unit": "D"}),
    "rfm_weekly_ruler": (logs.orders, logs.ORDERS, {"time_unit": "W", "collapse": "D"}),
    "rfm_weekly_grain": (logs.orders, logs.ORDERS, {"time_unit": "W"}),
    "rfm_monthly": (logs.orders, logs.ORDERS, {"time_unit": "M"}),
    "rfm_quarterly": (logs.orders, logs.ORDERS, {"time_unit": "Q"}),
    "rfm_yearly": (logs.orders, logs.ORDERS, {"time_unit": "Y"}),
    "rfm_null_ids": (logs.orders_without_ids, logs.NO_IDS, {"time_unit": "D"}),
    "rfm_net": (logs.refunds, logs.REFUNDS, {"time_unit": "D", "on_negative": "net"}),
    "rfm_drop": (logs.refunds, logs.REFUNDS, {"time_unit": "D", "on_negative": "drop"}),
}
for _name, (_source, _sql, _how) in _RFM.items():
    _grain = _how.get("collapse", _how["time_unit"])
    query(_name, logs.rfm(_sql, _grain, 7 if _grain != _how["time_unit"] else 1, _how.get("on_negative", "net")))(_rfm(_source, **_how))
query("rfm_hourly", logs.rfm(logs.PURCHASES, "h", monetary=False))(_rfm(logs.purchases, monetary=False, time_unit="h"))
query("rfm_timing_only", logs.rfm(logs.ORDERS, "D", monetary=False))(_rfm(logs.orders, monetary=False, time_unit="D"))
query("rfm_obs_end", logs.rfm(logs.ORDERS, "D", end=logs.DAY.format(ts="DATE '2002-01-01'")))(_rfm(logs.orders, time_unit="D", observation_period_end="2002-01-01"))


@query("rfm_string_dates", logs.rfm(logs.ORDERS, "D"))
def rfm_string_dates(spark, d):
    log = logs.orders(spark, d).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return in_money(quiet(log).to_spark(), "monetary_value")


@query("rfm_formatted_dates", logs.rfm(logs.ORDERS, "D", 7))
def rfm_formatted_dates(spark, d):
    log = logs.orders(spark, d).withColumn("date", F.date_format("date", "dd/MM/yyyy HH:mm"))
    return in_money(quiet(log, time_unit="W", collapse="D", datetime_format="dd/MM/yyyy HH:mm").to_spark(), "monetary_value")


@query("sufficient_stats", f'SELECT frequency, recency, "T", CAST(count(*) AS BIGINT) AS customers FROM ({logs.rfm(logs.ORDERS, "D", 7)}) GROUP BY ALL')
def sufficient_stats(spark, d):
    return quiet(logs.orders(spark, d), time_unit="W", collapse="D").sufficient_statistics()


@query("repeat_buyers", f"SELECT customer_id, frequency, monetary_value FROM ({logs.rfm(logs.ORDERS, 'D')}) WHERE frequency > 0")
def repeat_buyers(spark, d):
    return in_money(quiet(logs.orders(spark, d)).to_spark().filter("frequency > 0").select("customer_id", "frequency", "monetary_value"), "monetary_value")


@query("collapse_absorbed", f"WITH {logs.totals(logs.ORDERS, 'M')} SELECT CAST(sum(n) AS BIGINT) AS transactions, CAST(sum(n) - count(*) AS BIGINT) AS absorbed FROM totals")
def collapse_absorbed(spark, d):
    c = quiet(logs.orders(spark, d), time_unit="M")._counts
    return spark.createDataFrame([(c["rows"], c["rows"] - c["buckets"])], "transactions bigint, absorbed bigint")


@query(
    "policy_counts",
    f"""WITH {logs.totals(logs.REFUNDS, "D")}, c AS (SELECT id, max(nn) > 0 AS kept FROM totals GROUP BY id)
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM c) AS customers, (SELECT CAST(count(*) FILTER (NOT kept) AS BIGINT) FROM c) AS erased,
    CAST(count(*) FILTER (nn > 0) AS BIGINT) AS events, CAST(count(*) FILTER (nn > 0 AND net <= 0) AS BIGINT) AS netted, CAST(sum(neg) AS BIGINT) AS discarded, CAST(sum(n) AS BIGINT) AS transactions FROM totals""",
)
def policy_counts(spark, d):
    c = quiet(logs.refunds(spark, d))._counts
    row = (c["customers"], c["customers"] - c["with_events"], c["n_events"], c["netted"], c["negative"], c["rows"])
    return spark.createDataFrame([row], "customers bigint, erased bigint, events bigint, netted bigint, discarded bigint, transactions bigint")


# ---- split

_CUT = logs.DAY.format(ts=f"DATE '{CALIBRATION_END}'")
_EARLY = f"WITH {logs.events(logs.ORDERS, 'D')}, early AS (SELECT * FROM events WHERE b <= {_CUT})"
_HOLDOUT = f"""late AS (SELECT id, count(*) AS n, avg(spend) AS m FROM events WHERE b > {_CUT} GROUP BY id),
  holdout AS (SELECT e.id AS customer_id, CAST(coalesce(n, 0) AS BIGINT) AS frequency_holdout, coalesce(m, 0.0::DOUBLE) / 100.0::DOUBLE AS monetary_value_holdout,
  CAST((SELECT {logs.ordinal("D", "max(ts)")} FROM log) - {_CUT} AS DOUBLE) / 7.0::DOUBLE AS duration_holdout FROM (SELECT DISTINCT id FROM early) e LEFT JOIN late USING (id))"""


def _split(spark, d):
    return quiet(logs.orders(spark, d), time_unit="W", collapse="D").split(calibration_period_end=CALIBRATION_END)


@query("split_calibration", f'{_EARLY}, {logs.summary("D", 7, _CUT, source="early")} SELECT id AS customer_id, frequency, recency, "T", monetary_value / 100.0::DOUBLE AS monetary_value FROM rfm')
def split_calibration(spark, d):
    return in_money(_split(spark, d)[0].to_spark(), "monetary_value")


@query("split_holdout", f"{_EARLY}, {_HOLDOUT} SELECT * FROM holdout")
def split_holdout(spark, d):
    return in_money(_split(spark, d)[1], "monetary_value_holdout")


# ---- model scores at given parameters, on the lapsing log

_BASE = (
    f"WITH {logs.LAPSING.format(day=logs.DAY.format(ts='o_orderdate'), div='//')}, "
    + logs.summary("D", 7, "(SELECT last FROM horizon)", source="kept")
)
_r, _alpha, _a, _b = EVENT_PARAMS
_p, _q, _g = SPEND_PARAMS
_ODDS = '{a} / ({b} + {x} - 1 + {e}) * power(({al} + "T") / ({al} + recency), {r} + frequency)'


def _alive_sql(e: int) -> str:
    odds = _ODDS.format(a=_a, b=_b, x="frequency" if e else "greatest(frequency, 1)", e=e, al=_alpha, r=_r)
    return f"1 / (1 + {odds if e else f'CASE WHEN frequency > 0 THEN {odds} ELSE 0 END'})"


def _loglik_sql(e: int, params=EVENT_PARAMS) -> str:
    r, alpha, a, b = params
    x, n = "frequency", f"(frequency + {e})"
    alive = f'(-({r} + {x}) * ln({alpha} + "T"))'
    last = f"(ln({a}) - ln({b} + greatest({x}, {1 - e}) + {e - 1}) - ({r} + {x}) * ln({alpha} + recency))"
    both = f"(greatest({alive}, {last}) + ln(1 + exp(-abs({alive} - {last}))))"
    tail = both if e else f"CASE WHEN {x} > 0 THEN {both} ELSE {alive} END"
    return f"lgamma({r} + {x}) - lgamma({r}) + {r} * ln({alpha}) + lgamma({a} + {b}) + lgamma({b} + {n}) - lgamma({b}) - lgamma({a} + {b} + {n}) + {tail}"


def _expected_sql(e: int, horizon, terms: int = 80) -> str:
    ca, cb, cc = f"{_a + _b - 1 + e - _r}", f"{_a - 1}", f"({_a + _b - 1 + e} + frequency)"
    z = f'({horizon} / ({_alpha} + "T" + {horizon}))'
    series = f"list_sum(list_transform(range(0, {terms}), lambda k: exp(lgamma({ca} + k) - lgamma({ca}) + lgamma({cb} + k) - lgamma({cb}) + lgamma({cc}) - lgamma({cc} + k) - lgamma(k + 1) + k * ln({z}))))"
    return f"{cc} / {_a - 1} * (1 - power(1 - {z}, {_a - 1}) * {series}) * {_alive_sql(e)}"


def lapsing_base(spark, d) -> CustomerBase:
    log, last = logs.lapsing(spark, d)
    return quiet(log, time_unit="W", collapse="D", observation_period_end=last)


def at_params(model, cb: CustomerBase, params=EVENT_PARAMS):
    """A model with given parameters instead of a fit."""
    names = ("p", "q", "gamma") if isinstance(model, GammaGamma) else ("r", "alpha", "a", "b")
    model.params_, model._base = pd.Series(params, index=list(names)), cb
    return model


def rounded(frame: DataFrame, digits: int, *names: str) -> DataFrame:
    for name in names:
        frame = frame.withColumn(name, F.round(name, digits))
    return frame


@query("rfm_lapsing", f'{_BASE} SELECT id AS customer_id, frequency, recency, "T", monetary_value / 100.0::DOUBLE AS monetary_value FROM rfm')
def rfm_lapsing(spark, d):
    return in_money(lapsing_base(spark, d).to_spark(), "monetary_value")


_EVENT_NAMES, _SPEND_NAMES = ("r", "alpha", "a", "b"), ("p", "q", "gamma")
_FACTORS = (0.5, 1.0, 2.0)


def _grid_case(e: int, k: int) -> str:
    """The log-likelihood with the k-th parameter times `factor`."""
    scaled = [f"({v} * factor)" if i == k else v for i, v in enumerate(EVENT_PARAMS)]
    return f"WHEN '{_EVENT_NAMES[k]}' THEN {_loglik_sql(e, scaled)}"


def _quietly(f: Callable, *args):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return f(*args)


def _optimum_sql(names: tuple[str, ...]) -> str:
    rows = ", ".join(f"('{n}', {f}::DOUBLE, TRUE)" for n in names for f in (0.9, 1.1))
    return f"SELECT * FROM (VALUES {rows}) AS t(parameter, factor, falls)"


def _optimum(spark, model, objective: Callable, names: tuple[str, ...]) -> DataFrame:
    best = model.params_.to_numpy(float)
    rows = [(n, f, np.where(np.arange(len(best)) == k, f, 1.0) * best) for k, n in enumerate(names) for f in (0.9, 1.1)]
    top, *values = objective([np.log(p) for p in [best, *(v for _, _, v in rows)]])
    return spark.createDataFrame([(n, f, bool(v > top)) for (n, f, _), v in zip(rows, values, strict=True)], "parameter string, factor double, falls boolean")


def _model_queries(name: str, cls, e: int) -> None:
    columns = lambda: (F.col("frequency"), F.col("recency"), F.col("T"))

    @query(f"{name}_loglik", f"{_BASE} SELECT id AS customer_id, round({_loglik_sql(e)}, 8) AS loglik FROM rfm")
    def loglik(spark, d):
        return lapsing_base(spark, d).to_spark().select("customer_id", F.round(cls.log_likelihood_column(EVENT_PARAMS, *columns()), 8).alias("loglik"))

    @query(f"{name}_palive", f"{_BASE} SELECT id AS customer_id, round({_alive_sql(e)}, 8) AS probability_alive FROM rfm")
    def palive(spark, d):
        cb = lapsing_base(spark, d)
        return rounded(at_params(cls(), cb).probability_alive().to_spark(), 8, "probability_alive")

    @query(f"{name}_expected", f"{_BASE} SELECT id AS customer_id, round({_expected_sql(e, 12.0)}, 8) AS expected_purchases FROM rfm")
    def expected(spark, d):
        return lapsing_base(spark, d).to_spark().select("customer_id", F.round(cls.expected_column(EVENT_PARAMS, 12.0, *columns(), terms=80), 8).alias("expected_purchases"))

    @query(f"{name}_predict", f"{_BASE} SELECT id AS customer_id, round({_expected_sql(e, 12.0)}, 8) AS expected_purchases FROM rfm")
    def predict(spark, d):
        return rounded(at_params(cls(), lapsing_base(spark, d)).predict(12.0).to_spark(), 8, "expected_purchases")

    grid = ", ".join(f"('{p}', {f}::DOUBLE)" for p in _EVENT_NAMES for f in _FACTORS)
    total = f"CASE parameter {' '.join(_grid_case(e, k) for k in range(4))} END"

    @query(f"{name}_objective", f"{_BASE}, grid(parameter, factor) AS (VALUES {grid}) SELECT parameter, factor, round(sum({total}), 5) AS loglik FROM rfm, grid GROUP BY 1, 2")
    def objective(spark, d):
        """What the distributed fit minimizes, at many points in one pass."""
        rows = [(p, f, [v * (f if i == k else 1.0) for i, v in enumerate(EVENT_PARAMS)]) for k, p in enumerate(_EVENT_NAMES) for f in _FACTORS]
        values = cls()._distributed(lapsing_base(spark, d).sufficient_statistics())([np.log(v) for _, _, v in rows])
        return spark.createDataFrame([(p, f, round(-v, 5)) for (p, f, _), v in zip(rows, values, strict=True)], "parameter string, factor double, loglik double")

    @query(f"{name}_fit_optimum", _optimum_sql(_EVENT_NAMES))
    def optimum(spark, d):
        """Whether the likelihood falls on either side of every fitted parameter."""
        cb = lapsing_base(spark, d)
        model = _quietly(cls().fit, cb)
        return _optimum(spark, model, cls()._distributed(cb.sufficient_statistics()), _EVENT_NAMES)

    @query(f"{name}_fit")
    def fit(spark, d):
        model = cls().fit(lapsing_base(spark, d))
        rows = [(k, float(v)) for k, v in model.params_.items()] + [("log_likelihood", float(model.log_likelihood_))]
        return spark.createDataFrame(rows, "parameter string, value double")


_model_queries("bgnbd", BGNBD, 0)
_model_queries("mbgnbd", MBGNBD, 1)

_SPEND = f"CASE WHEN frequency > 0 THEN {_p} * ({_g} + frequency * monetary_value) / ({_p} * frequency + {_q} - 1) ELSE {_p * _g / (_q - 1)!r}::DOUBLE END"
_X, _Z = "frequency", "monetary_value"
_GG = f"""lgamma({_p} * {_X} + {_q}) - lgamma({_p} * {_X}) - lgamma({_q}) + {_q} * ln({_g}) + ({_p} * {_X} - 1) * ln({_Z}) + {_p} * {_X} * ln({_X})
  - ({_p} * {_X} + {_q}) * ln({_g} + {_X} * {_Z})"""


@query("gg_loglik", f"{_BASE} SELECT id AS customer_id, round({_GG}, 6) AS loglik FROM rfm WHERE frequency > 0 AND monetary_value > 0")
def gg_loglik(spark, d):
    buyers = lapsing_base(spark, d).to_spark().filter("frequency > 0 AND monetary_value > 0")
    return buyers.select("customer_id", F.round(GammaGamma.log_likelihood_column(SPEND_PARAMS, F.col("frequency"), F.col("monetary_value")), 6).alias("loglik"))


@query("expected_spend", f"{_BASE} SELECT id AS customer_id, round({_SPEND}, 4) AS expected_spend FROM rfm")
def expected_spend(spark, d):
    return rounded(at_params(GammaGamma(), lapsing_base(spark, d), SPEND_PARAMS).predict().to_spark(), 4, "expected_spend")


@query("gg_fit_optimum", _optimum_sql(_SPEND_NAMES))
def gg_fit_optimum(spark, d):
    cb = lapsing_base(spark, d)
    model = _quietly(GammaGamma().fit, cb)
    buyers = cb.to_spark().filter("frequency > 0 AND monetary_value > 0").select("frequency", "monetary_value")
    return _optimum(spark, model, model._distributed(buyers), _SPEND_NAMES)


@query("gg_fit")
def gg_fit(spark, d):
    model = GammaGamma().fit(lapsing_base(spark, d))
    rows = [(k, float(v)) for k, v in model.params_.items()] + [("population_mean", model.population_mean()), ("log_likelihood", float(model.log_likelihood_))]
    return spark.createDataFrame(rows, "parameter string, value double")


def _det_sql(e: int) -> str:
    steps = [f"({_expected_sql(e, float(t), 40)})" for t in range(1, HORIZON + 1)]
    each = ", ".join(f"{s} AS e{t}" for t, s in enumerate(steps, 1))
    det = " + ".join(f"(e{t} - {f'e{t - 1}' if t > 1 else '0'}) / power({1 + RATE}, {t})" for t in range(1, HORIZON + 1))
    return f"{_BASE}, steps AS (SELECT id, {each}, {_SPEND} AS spend FROM rfm), det AS (SELECT id, e{HORIZON} AS expected, {det} AS det, spend FROM steps)"


def _clv_sql(e: int, margin: float) -> str:
    return f"""{_det_sql(e)} SELECT id AS customer_id, round(expected, 7) AS expected_purchases, round(det, 7) AS discounted_expected_transactions,
      round(spend / 100, 4) AS expected_spend, round({margin} * spend * det / 100, 4) AS clv FROM det"""


def _clv(spark, d, model, margin: float = 1.0) -> DataFrame:
    cb = lapsing_base(spark, d)
    clv = CLV(at_params(model, cb), at_params(GammaGamma(), cb, SPEND_PARAMS))
    clv._base = cb
    out = in_money(clv.predict(horizon=HORIZON, discount_rate=RATE, margin=margin).to_spark(), "expected_spend", "clv")
    return rounded(rounded(out, 7, "expected_purchases", "discounted_expected_transactions"), 4, "expected_spend", "clv")


@query("det", f"{_det_sql(0)} SELECT id AS customer_id, round(det, 7) AS discounted_expected_transactions FROM det")
def det(spark, d):
    return _clv(spark, d, BGNBD()).select("customer_id", "discounted_expected_transactions")


@query("clv_table", _clv_sql(0, 1.0))
def clv_table(spark, d):
    return _clv(spark, d, BGNBD())


@query("clv_margin", _clv_sql(0, MARGIN))
def clv_margin(spark, d):
    return _clv(spark, d, BGNBD(), MARGIN)


@query("clv_mbgnbd", _clv_sql(1, 1.0))
def clv_mbgnbd(spark, d):
    return _clv(spark, d, MBGNBD())


@query("clv_fitted")
def clv_fitted(spark, d):
    """The flagship: fit everything, value everyone."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fitted = CLV(MBGNBD()).fit(lapsing_base(spark, d))
    return in_money(fitted.predict(horizon=52, discount_rate=0.001).to_spark(), "expected_spend", "clv")


@query("bootstrap")
def bootstrap(spark, d):
    return MBGNBD().fit(lapsing_base(spark, d)).parameter_uncertainty(n=4, seed=1).to_spark()


@query("silence_vs_alive", f'{_BASE} SELECT "T" - recency AS silence, frequency, round({_alive_sql(0)}, 8) AS probability_alive FROM rfm')
def silence_vs_alive(spark, d):
    return rounded(at_params(BGNBD(), lapsing_base(spark, d)).probability_alive().plot_data(), 8, "probability_alive")


@query(
    "clv_plot_levels",
    f"""WITH v AS (SELECT clv FROM ({_clv_sql(0, 1.0)}) WHERE clv > 0), q AS (SELECT quantile_cont(clv, 0.40) AS a, quantile_cont(clv, 0.97) AS b, quantile_cont(clv, 0.95) AS top FROM v),
    raw AS (SELECT k, a * power(b / a, k / 3.0) AS r FROM q, range(4) AS t(k)), snaps AS (SELECT m * power(10.0::DOUBLE, e) AS s FROM range(-8, 16) AS t(e), (VALUES (1), (2), (5)) AS u(m)),
    picked AS (SELECT DISTINCT level FROM (SELECT k, arg_min(s, abs(ln(s / r))) AS level FROM raw, snaps GROUP BY k))
    SELECT 'level' AS kind, round(level, 6) AS value FROM picked UNION ALL SELECT 'ceiling', round(top, 4) FROM q""",
)
def clv_plot_levels(spark, d):
    digits = F.when(F.col("kind") == "level", F.round("value", 6)).otherwise(F.round("value", 4))
    return figures.iso_levels(_clv(spark, d, BGNBD())).withColumn("value", digits)


@query(
    "alive_histogram",
    f"""{_BASE}, v AS (SELECT round({_alive_sql(0)}, 8) AS v FROM rfm), m AS (SELECT min(v) AS low, max(v) AS high, (max(v) - min(v)) / 30 AS w FROM v),
    cells AS (SELECT CAST(least(floor((v - low) / w), 29) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM v, m GROUP BY 1)
    SELECT bin, round(low + bin * w, 8) AS low, round(low + (bin + 1) * w, 8) AS high, n AS count FROM cells, m""",
)
def alive_histogram(spark, d):
    alive = rounded(at_params(BGNBD(), lapsing_base(spark, d)).probability_alive().to_spark(), 8, "probability_alive")
    return rounded(figures.histogram(alive, "probability_alive"), 8, "low", "high")


# ---- independence

_BUYERS = f"buyers AS (SELECT customer_id, frequency, monetary_value FROM ({logs.rfm(logs.ORDERS, 'D')}) WHERE frequency > 0)"
_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_SPEARMAN = f"SELECT corr(rx, rz) FROM (SELECT {_RANK.format(c='frequency')} AS rx, {_RANK.format(c='monetary_value')} AS rz FROM {{t}})"
_ETA = """SELECT sum(n * (m - grand) ** 2) / (sum(n * (m - grand) ** 2) + sum(n * v)) FROM
  (SELECT count(*) AS n, avg(monetary_value) AS m, var_pop(monetary_value) AS v, (SELECT avg(monetary_value) FROM {t}) AS grand FROM {t} GROUP BY frequency)"""


def _buyers(spark, d) -> DataFrame:
    return in_money(quiet(logs.orders(spark, d)).to_spark().filter("frequency > 0"), "monetary_value")


@query("pearson", f"WITH {_BUYERS} SELECT round(corr(frequency, monetary_value), 8) AS pearson_r FROM buyers")
def pearson(spark, d):
    return _buyers(spark, d).agg(F.round(F.corr("frequency", "monetary_value"), 8).alias("pearson_r"))


@query("spearman", f"WITH {_BUYERS} SELECT round(({_SPEARMAN.format(t='buyers')}), 8) AS spearman_rho")
def spearman(spark, d):
    return spark.createDataFrame([(round(independence.spearman(_buyers(spark, d)), 8),)], "spearman_rho double")


@query("eta_squared", f"WITH {_BUYERS} SELECT round(({_ETA.format(t='buyers')}), 8) AS eta_squared")
def eta_squared(spark, d):
    return rounded(independence.eta_squared(_buyers(spark, d)), 8, "eta_squared")


def _check(spark, d, exclude=()) -> DataFrame:
    found = independence.check_monetary_independence(quiet(logs.orders(spark, d)), exclude=exclude)
    row = (found.n_customers, round(found.pearson_r, 8), round(found.spearman_rho, 8), round(found.eta_squared, 8), found.holds())
    return spark.createDataFrame([row], "n_customers bigint, pearson_r double, spearman_rho double, eta_squared double, holds boolean")


def _check_sql(where: str) -> str:
    stats = f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM chosen) AS n_customers, round((SELECT corr(frequency, monetary_value) FROM chosen), 8) AS pearson_r,
      round(({_SPEARMAN.format(t="chosen")}), 8) AS spearman_rho, round(({_ETA.format(t="chosen")}), 8) AS eta_squared"""
    return f"WITH {_BUYERS}, chosen AS (SELECT * FROM buyers {where}), s AS ({stats}) SELECT *, abs(spearman_rho) < 0.30 AND eta_squared < 0.25 AS holds FROM s"


@query("independence_check", _check_sql(""))
def independence_check(spark, d):
    return _check(spark, d)


@query("independence_excluding", _check_sql("WHERE customer_id NOT IN (1, 2)"))
def independence_excluding(spark, d):
    return _check(spark, d, exclude=[1, 2])


@query(
    "independence_report",
    f"""WITH c AS ({_check_sql("")}) SELECT 'n_customers' AS statistic, CAST(n_customers AS DOUBLE) AS value FROM c UNION ALL SELECT 'pearson_r', pearson_r FROM c
    UNION ALL SELECT 'spearman_rho', spearman_rho FROM c UNION ALL SELECT 'eta_squared', eta_squared FROM c""",
)
def independence_report(spark, d):
    """Without the p-values, for which SQL has no distribution; tests hold them against known ones."""
    report = independence.check_monetary_independence(quiet(logs.orders(spark, d))).to_spark()
    return rounded(report.filter("statistic NOT LIKE '%_p'"), 8, "value")


@query(
    "grouped_spend",
    f"""WITH {_BUYERS} SELECT least(frequency, 7) AS level, CAST(count(*) AS BIGINT) AS customers, round(min(monetary_value), 4) AS low, round(quantile_cont(monetary_value, 0.25), 4) AS q1,
    round(quantile_cont(monetary_value, 0.5), 4) AS median, round(quantile_cont(monetary_value, 0.75), 4) AS q3, round(max(monetary_value), 4) AS high FROM buyers GROUP BY 1""",
)
def grouped_spend(spark, d):
    boxes = independence.box_stats(_buyers(spark, d), 7)
    return rounded(boxes.withColumn("level", F.col("level").cast("bigint")), 4, "low", "q1", "median", "q3", "high")


# ---- cohorts


def _cells_sql(unit: str, value: str) -> str:
    inner = {"retention": "1", "revenue": "sum(amount)"}[value]
    return f"""WITH pairs AS (SELECT id, {logs.ordinal(unit)} AS b, {inner} AS v FROM ({logs.ORDERS}) WHERE id IS NOT NULL GROUP BY 1, 2),
      placed AS (SELECT *, min(b) OVER (PARTITION BY id) AS c FROM pairs),
      cells AS (SELECT c, b - c AS k, sum(v) AS v FROM placed GROUP BY 1, 2),
      grid AS (SELECT c, unnest(range(0, (SELECT max(b) FROM pairs) - c + 1)) AS k FROM (SELECT DISTINCT c FROM cells)),
      full_cells AS (SELECT CAST(g.c AS BIGINT) AS c, CAST(g.k AS BIGINT) AS k, coalesce(v, 0) AS v FROM grid g LEFT JOIN cells USING (c, k))"""


def _matrix(spark, d, period: str = "M", metric: str = "retention") -> CohortMatrix:
    return CohortMatrix.from_transactions(logs.orders(spark, d), period=period, metric=metric)


def _retention(period: str) -> Query:
    return lambda spark, d: _matrix(spark, d, period).to_spark().drop("cohort")


for _name, _unit in (("cohort_retention", "M"), ("cohort_quarterly", "Q"), ("cohort_weekly", "W"), ("cohort_yearly", "Y")):
    query(_name, f"{_cells_sql(_unit, 'retention')} SELECT c AS cohort_ord, k AS period_number, CAST(v AS BIGINT) AS value FROM full_cells")(_retention(_unit))


@query("cohort_revenue", f"{_cells_sql('M', 'revenue')} SELECT c AS cohort_ord, k AS period_number, CAST(v AS DOUBLE) / 100.0::DOUBLE AS value FROM full_cells")
def cohort_revenue(spark, d):
    return in_money(_matrix(spark, d, metric="revenue").to_spark().drop("cohort"), "value")


_SHARE = "CAST(v AS DOUBLE) / nullif(CAST(max(CASE WHEN k = 0 THEN v END) OVER (PARTITION BY c) AS DOUBLE), 0)"


@query("cohort_relative", f"{_cells_sql('M', 'retention')} SELECT c AS cohort_ord, k AS period_number, {_SHARE} AS value FROM full_cells")
def cohort_relative(spark, d):
    return _matrix(spark, d).to_spark(relative=True).drop("cohort")


@query("retention_curve", f"{_cells_sql('M', 'retention')} SELECT period_number, round(avg(value), 8) AS value, CAST(count(value) AS BIGINT) AS cohorts FROM (SELECT k AS period_number, {_SHARE} AS value FROM full_cells) GROUP BY 1")
def retention_curve(spark, d):
    return rounded(_matrix(spark, d).curve(), 8, "value")


_FIRST = 'SELECT *, CAST((SELECT last FROM horizon) - CAST(round("T" * 7) AS BIGINT) AS BIGINT) AS first FROM rfm'


def _month_of(day: str) -> str:
    return logs.ordinal("M", f"(DATE '1970-01-01' + CAST({day} AS INTEGER))")


@query("cohort_of_customer", f"{_BASE} SELECT id AS customer_id, CAST({_month_of('first')} AS BIGINT) AS cohort_ord FROM ({_FIRST})")
def cohort_of_customer(spark, d):
    cb = lapsing_base(spark, d)
    return cb.to_spark().select("customer_id", cohort_ordinal(cb, "M").alias("cohort_ord"))


def _survival(spark, d, period: str) -> DataFrame:
    cb = lapsing_base(spark, d)
    model = CohortSurvival(at_params(BGNBD(), cb))
    model._base = cb
    return rounded(model.predict(period=period).to_spark().drop("cohort"), 8, "survival")


def _survival_sql(unit: str) -> str:
    date = "(DATE '1970-01-01' + CAST({x} AS INTEGER))"
    at, end = logs.ordinal(unit, date.format(x="first")), logs.ordinal(unit, date.format(x="(SELECT last FROM horizon)"))
    return f"""{_BASE}, scored AS (SELECT CAST({at} AS BIGINT) AS cohort_ord, {_alive_sql(0)} AS alive FROM ({_FIRST}))
      SELECT cohort_ord, CAST({end} AS BIGINT) - cohort_ord AS age, CAST(count(*) AS BIGINT) AS customers, round(avg(alive), 8) AS survival FROM scored GROUP BY 1"""


query("cohort_survival", _survival_sql("D"))(lambda spark, d: _survival(spark, d, "D"))
query("cohort_survival_coarse", _survival_sql("M"))(lambda spark, d: _survival(spark, d, "M"))


# ---- recipes


@query(
    "orders_from_line_items",
    """SELECT o_custkey AS customer_id, CAST(l_orderkey AS VARCHAR) AS invoice, CAST(min(l_shipdate) AS DATE) AS date, CAST(sum(l_quantity * round(l_extendedprice * 100)) AS DOUBLE) / 100.0::DOUBLE AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1, 2""",
)
def orders_from_line_items(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select("o_custkey", F.col("l_orderkey").cast("string").alias("invoice_no"), F.col("l_shipdate").cast("date").alias("shipped"), "l_quantity", logs.cents("l_extendedprice").alias("price"))
    out = recipes.orders_from_line_items(lines, customer_id_col="o_custkey", invoice_col="invoice_no", datetime_col="shipped", quantity_col="l_quantity", price_col="price")
    return in_money(out, "amount")


@query(
    "readiness",
    f"""WITH log AS ({logs.REFUNDS}), c AS (SELECT id, count(*) AS n, min(ts) AS a, max(ts) AS b, count(*) FILTER (amount <= 0) AS bad FROM log WHERE id IS NOT NULL GROUP BY id),
    t AS (SELECT count(*) AS customers, count(*) FILTER (n > 1) AS repeat, date_diff('day', CAST(min(a) AS DATE), CAST(max(b) AS DATE)) AS days, sum(bad) AS bad, sum(n) AS rows FROM c)
    SELECT 'repeat buyers' AS "check", CAST(repeat AS BIGINT) AS found, CAST(customers AS BIGINT) AS total, repeat >= 100 AND repeat > 0.05 * customers AS ok FROM t
    UNION ALL SELECT 'calendar span', CAST(days AS BIGINT), CAST(180 AS BIGINT), days >= 180 FROM t
    UNION ALL SELECT 'non-positive amounts', CAST(bad AS BIGINT), CAST(rows AS BIGINT), bad = 0 FROM t""",
)
def readiness(spark, d):
    return recipes.readiness(logs.refunds(spark, d))


@query(
    "holdout_by_bucket",
    f"""{_EARLY}, {_HOLDOUT}, {logs.summary("D", 7, _CUT, source="early")}, scored AS (SELECT id AS customer_id, frequency, {_expected_sql(0, 26.0, 120)} AS predicted FROM rfm)
    SELECT least(frequency, 7) AS bucket, CAST(count(*) AS BIGINT) AS customers, round(avg(predicted), 6) AS predicted, round(avg(frequency_holdout), 6) AS actual FROM scored JOIN holdout USING (customer_id) GROUP BY 1""",
)
def holdout_by_bucket(spark, d):
    base, holdout = _split(spark, d)
    predicted = BGNBD.expected_column(EVENT_PARAMS, 26.0, F.col("frequency"), F.col("recency"), F.col("T"), terms=120)
    return rounded(recipes.by_frequency(base.to_spark(), predicted, holdout, "customer_id"), 6, "predicted", "actual")


@query(
    "naive_vs_actual",
    f"""{_EARLY}, {_HOLDOUT}, {logs.summary("D", 7, _CUT, source="early")} SELECT id AS customer_id, round(CASE WHEN "T" > 0 THEN frequency / "T" ELSE 0 END * 26 * monetary_value / 100, 4) AS naive,
    round(frequency_holdout * monetary_value_holdout, 4) AS actual FROM rfm JOIN holdout ON id = customer_id""",
)
def naive_vs_actual(spark, d):
    base, holdout = _split(spark, d)
    both = base.to_spark().join(holdout, "customer_id")
    spent = F.col("frequency_holdout") * F.col("monetary_value_holdout") / 100
    return both.select("customer_id", F.round(recipes.naive_value(26.0) / 100, 4).alias("naive"), F.round(spent, 4).alias("actual"))


_TOP = "(SELECT customer_id FROM v ORDER BY {c} DESC, customer_id LIMIT (SELECT CAST(floor(count(*) * 0.10) AS BIGINT) FROM v))"


@query(
    "top_decile_overlap",
    f"""WITH v AS (SELECT c.customer_id, clv, past FROM ({_clv_sql(0, 1.0)}) c JOIN ({_BASE} SELECT id AS customer_id, frequency * monetary_value AS past FROM rfm) USING (customer_id)),
    s AS {_TOP.format(c="past")}, t AS {_TOP.format(c="clv")}
    SELECT 'both' AS part, (SELECT CAST(count(*) AS BIGINT) FROM s WHERE customer_id IN (FROM t)) AS customers
    UNION ALL SELECT 'only_first', (SELECT CAST(count(*) AS BIGINT) FROM s WHERE customer_id NOT IN (FROM t))
    UNION ALL SELECT 'only_second', (SELECT CAST(count(*) AS BIGINT) FROM t WHERE customer_id NOT IN (FROM s))""",
)
def top_decile_overlap(spark, d):
    past = lapsing_base(spark, d).to_spark().select("customer_id", (F.col("frequency") * F.col("monetary_value")).alias("past"))
    return recipes.overlap(recipes.top_share(past, "customer_id", "past"), recipes.top_share(_clv(spark, d, BGNBD()), "customer_id", "clv"), "customer_id")


@query("summary_json", f"SELECT CAST(customer_id AS VARCHAR) AS customer_id, frequency, recency, \"T\", monetary_value FROM ({logs.rfm(logs.ORDERS, 'D')})")
def summary_json(spark, d):
    """The JSON of the summary, read back."""
    rows = as_json(quiet(logs.orders(spark, d)).to_spark(), "customer_id")
    back = F.from_json("json", "frequency bigint, recency bigint, T bigint, monetary_value double").alias("j")
    return in_money(rows.select("customer_id", back).select("customer_id", "j.*"), "monetary_value")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
