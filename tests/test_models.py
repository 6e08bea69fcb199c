"""Pinned likelihoods, closed forms, quadrature, simulation, and what the models refuse."""

import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendcurve import BGNBD, CLV, MBGNBD, CustomerBase, GammaGamma, MonetaryIndependenceWarning, check_monetary_independence
from spendcurve.functions import optimize, special
from spendcurve.operators import independence
from spendcurve.operators.lifetime_value import discounted
from spendcurve.operators.results import Prediction, values_of

POINT = (0.243, 4.414, 0.793, 2.426)
OTHER = (0.5, 6.0, 1.5, 3.0)


def summary(spark, x, t, T, z=None):
    data = {"customer_id": [f"c{i}" for i in range(len(x))], "frequency": np.asarray(x, dtype=np.int64), "recency": np.asarray(t, float), "T": np.asarray(T, float)}
    if z is not None:
        data["monetary_value"] = np.asarray(z, float)
    return CustomerBase.from_summary(spark.createDataFrame(pd.DataFrame(data)), time_unit="W", collapse="D")


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(3)
    T = rng.integers(26 * 7, 52 * 7, 4000) / 7
    x, t = BGNBD.simulate((0.4, 8, 0.8, 2.5), T, rng)
    mean = 15.44 / rng.gamma(3.74, 1, len(x))
    z = np.where(x > 0, rng.gamma(6.25 * np.maximum(x, 1), 1) / np.maximum(x, 1) * mean, 0)
    return summary(spark, x, np.minimum(np.round(t * 7) / 7, T), T, z)


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1, 3.3, 10, 200, 1e5])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-14)
    assert np.allclose(special.lgamma_ratio(x, 2.5), [math.lgamma(v + 2.5) - math.lgamma(v) for v in x], rtol=1e-9)
    assert abs(special.hyp2f1(1, 1, 2, 0.5) - 2 * math.log(2)) < 1e-14
    assert abs(special.beta_regularized(0.3, 2, 3) - 0.3483) < 1e-12 and special.beta_regularized(0, 1, 1) == 0 and special.beta_regularized(1, 1, 1) == 1
    assert abs(special.correlation_p(0.3, 30) - 0.1072459) < 1e-6 and math.isnan(special.correlation_p(0.1, 2)) and special.correlation_p(1.0, 9) == 0


def test_optimiser_on_a_curved_valley():
    found = optimize.minimize(lambda points: [(1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2 for p in points], np.array([-1.0, 1.0]))
    assert np.allclose(found.x, 1, atol=1e-3) and found.converged


def test_pinned_likelihoods():
    assert abs(BGNBD.log_likelihood(POINT, [4], [30.7], [38.9])[0] / -15.32935235570709 - 1) < 1e-11
    assert abs(MBGNBD.log_likelihood(POINT, [4], [30.7], [38.9])[0] / -15.487436077892465 - 1) < 1e-11
    r, alpha, a, b = POINT
    T = 20.0
    assert abs(BGNBD.log_likelihood(POINT, [0], [0], [T])[0] - r * math.log(alpha / (alpha + T))) < 1e-12
    assert abs(MBGNBD.log_likelihood(POINT, [0], [0], [T])[0] - math.log((b * (alpha / (alpha + T)) ** r + a) / (a + b))) < 1e-12


@pytest.mark.parametrize("cls", [BGNBD, MBGNBD])
def test_columns_equal_arrays(spark, cls):
    rng = np.random.default_rng(1)
    T = rng.uniform(1, 50, 60)
    x, t = cls.simulate(OTHER, T, rng)
    frame = summary(spark, x, t, T).to_spark()
    args = [F.col(c) for c in ("frequency", "recency", "T")]
    got = frame.select("customer_id", cls.log_likelihood_column(OTHER, *args).alias("l"), cls.alive_column(OTHER, *args).alias("p"), cls.expected_column(OTHER, 12, *args, terms=300).alias("e")).toPandas()
    got = got.set_index("customer_id").loc[[f"c{i}" for i in range(60)]]
    assert np.allclose(got["l"], cls.log_likelihood(OTHER, x, t, T), rtol=1e-10)
    assert np.allclose(got["p"], cls.alive(OTHER, x, t, T), rtol=1e-12)
    assert np.allclose(got["e"], cls.expected(OTHER, 12, x, t, T), rtol=1e-9)


def test_expected_purchases():
    assert abs(BGNBD.expected(OTHER, 12, 3, 20, 26) - 0.6958870318060314) < 1e-12
    assert abs(MBGNBD.expected(OTHER, 12, 3, 20, 26) - 0.7557484032483872) < 1e-12
    r, alpha, a, b = OTHER
    for h in (1.0, 20.0):
        origin = b / (a - 1) * (1 - (alpha / (alpha + h)) ** r * special.hyp2f1(r, b + 1, a + b, h / (alpha + h)))
        assert abs(MBGNBD.expected(OTHER, h, 0, 0, 0) - origin) < 1e-10
    near = [float(BGNBD.expected((0.5, 6.0, a, 3.0), 12, 3, 20, 26)) for a in (0.9999, 1.0, 1.0001)]
    assert near[0] < near[2] or near[0] > near[2]
    assert abs(near[1] - (near[0] + near[2]) / 2) < 1e-5


@pytest.mark.parametrize("cls", [BGNBD, MBGNBD])
def test_simulated_parameters_are_found_again(cls):
    rng = np.random.default_rng(5)
    truth = (0.8, 8.0, 0.8, 2.5)
    T = rng.uniform(26, 52, 15000)
    x, t = cls.simulate(truth, T, rng)
    assert np.all(t <= T) and np.all((x == 0) == (t == 0))
    r, alpha, a, b = np.exp(cls.fit_groups(x, t, T, np.ones(len(T))).x)
    assert abs((r / alpha) / 0.1 - 1) < 0.15 and abs((a / (a + b)) / (0.8 / 3.3) - 1) < 0.2


def test_fit_predict_and_score(spark, simulated):
    model = BGNBD().fit(simulated)
    assert model.converged_ and model.params_.index.tolist() == ["r", "alpha", "a", "b"]
    small = summary(spark, [0, 2, 5], [0, 10, 30], [40, 40, 40])
    alive = model.probability_alive(small).to_pandas()["probability_alive"]
    assert alive["c0"] == 1.0 and alive["c2"] > alive["c1"]
    more, less = (values_of(model.predict(t, small)) for t in (10, 5))
    assert (more > less).all() and "10" in model.predict(10, small).description
    with pytest.raises(ValueError, match="t must be positive"):
        model.predict(0)
    other = CustomerBase.from_summary(small.to_spark(), time_unit="D")
    with pytest.raises(ValueError, match="time_unit"):
        model.predict(1, other)
    with pytest.raises(ValueError, match="collapse"):
        model.predict(1, CustomerBase.from_summary(small.to_spark(), time_unit="W"))
    assert model.probability_alive(small).plot_data().columns == ["silence", "frequency", "probability_alive"]
    assert model.predict(5, small).plot_data().count() >= 1
    with pytest.raises((ImportError, AttributeError), match="plot_data|matplotlib"):
        model.predict(5, small).plot()


def test_distributed_objective_equals_the_local_one(spark, simulated, monkeypatch):
    groups = simulated.sufficient_statistics()
    data = groups.toPandas()
    local = -float(data["customers"].to_numpy() @ BGNBD.log_likelihood(OTHER, data["frequency"], data["recency"], data["T"]))
    values = BGNBD()._distributed(groups)([np.log(OTHER), np.log(POINT), np.log(OTHER)])  # one pass for all points
    assert abs(values[0] - local) < 1e-6 * abs(local) and values[0] == values[2] != values[1]


@pytest.mark.parametrize("where", ["purchases", "spend"])
def test_distributed_fits_equal_local_ones(spark, simulated, monkeypatch, where):
    from spendcurve.operators import purchase_models, spend_model

    few = CustomerBase.from_summary(simulated.to_spark().limit(400).persist(), time_unit="W", collapse="D")
    make = BGNBD if where == "purchases" else GammaGamma
    local = make().fit(few)
    monkeypatch.setattr(purchase_models, "LOCAL_GROUPS", 0)
    monkeypatch.setattr(spend_model, "LOCAL_ROWS", 0)
    monkeypatch.setattr(optimize, "simplex", lambda f, x0: optimize.Minimum(np.log(local.params_.to_numpy()) + 0.05, np.inf, 0, True))
    far = make().fit(few)
    assert np.allclose(far.params_, local.params_, rtol=2e-3) and abs(far.log_likelihood_ / local.log_likelihood_ - 1) < 1e-7
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(few.sufficient_statistics()._jdf).isDefined()


def test_optimiser_asks_for_independent_points_at_once():
    asked = []

    def bowl(points):
        asked.append(len(points))
        return [float(p @ p) for p in points]

    optimize.minimize(bowl, np.array([1.0, 2.0, 3.0]))
    assert asked[0] == 4 and 6 in asked


def test_value_of_the_models_here_needs_no_join(simulated):
    clv = CLV(BGNBD(), GammaGamma(), check_independence=False).fit(simulated)
    frame = clv.predict(horizon=3).to_spark()
    assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert frame.count() == simulated.to_spark().count()


class Recorder:
    """Axes that note what is called."""

    def __init__(self):
        self.calls = {}

    def __getattr__(self, name):
        return lambda *a, **k: self.calls.setdefault(name, (a, k))


def test_drawing_passes_the_numbers_on(spark, simulated, monkeypatch):
    from spendcurve.plans import figures

    model = BGNBD().fit(simulated)
    ax = Recorder()
    assert model.probability_alive().plot(ax) is ax and len(ax.calls["scatter"][0][0]) == simulated.to_spark().count()
    monkeypatch.setattr(figures, "POINTS", 50)
    ax = Recorder()
    clv = CLV(model, GammaGamma(), check_independence=False).fit(simulated)
    clv.predict(horizon=2).plot(ax)
    assert len(ax.calls["scatter"][0][0]) == 50 and "set_xlabel" in ax.calls
    ax = Recorder()
    model.predict(4).plot(ax)
    assert sum(ax.calls["bar"][0][1]) == simulated.to_spark().count()
    ax = Recorder()
    check = check_monetary_independence(simulated)
    check.plot(ax)
    assert [b["label"] for b in ax.calls["bxp"][0][0]][-1].endswith("+") and all(b["q1"] <= b["med"] <= b["q3"] for b in ax.calls["bxp"][0][0])
    check.unpersist()
    ax = Recorder()
    model.parameter_uncertainty(n=2, seed=1).plot(ax)
    assert len(ax.calls["errorbar"][0][0]) == 4


def test_refusals_of_event_models(spark):
    with pytest.raises(RuntimeError, match="not fitted"):
        BGNBD().predict(1)
    with pytest.raises(RuntimeError, match="not fitted"):
        MBGNBD().parameter_uncertainty()
    with pytest.raises(TypeError, match="CustomerBase"):
        BGNBD().fit("base")
    with pytest.raises(ValueError, match="empty"):
        BGNBD().fit(summary(spark, [1], [1], [1]).__class__.from_summary(summary(spark, [1], [1], [1]).to_spark().limit(0)))
    with pytest.raises(ValueError, match="recency > T"):
        BGNBD().fit(summary(spark, [1], [5], [1]))
    with pytest.raises(ValueError, match="negative"):
        MBGNBD().fit(summary(spark, [-1], [0], [1]))
    with pytest.raises(ValueError, match="required columns"):
        BGNBD().fit(CustomerBase.from_summary(summary(spark, [1], [1], [1]).to_spark().drop("T")))
    assert "not fitted" in repr(BGNBD())


def test_bootstrap(spark, simulated):
    model = BGNBD().fit(simulated)
    one, two = (model.parameter_uncertainty(n=3, seed=4).to_pandas() for _ in range(2))
    assert one.equals(two) and one.columns.tolist() == ["estimate", "se", "ci_low", "ci_high"] and (one["se"] > 0).all()
    for n in (1, 2.5):
        with pytest.raises(ValueError, match="n must be"):
            model.parameter_uncertainty(n=n)
    with pytest.raises(ValueError, match="confidence"):
        model.parameter_uncertainty(n=3, confidence=1)


def test_gamma_gamma(spark, simulated):
    x, z = [1, 3, 6, 21], [12.2, 55, 80.6, 4.1]
    p, q, g = 2.8, 3.1, 9.4
    want = [math.lgamma(p * a + q) - math.lgamma(p * a) - math.lgamma(q) + q * math.log(g) + (p * a - 1) * math.log(m) + p * a * math.log(a) - (p * a + q) * math.log(g + a * m) for a, m in zip(x, z)]
    assert np.allclose(GammaGamma.log_likelihood((p, q, g), x, z), want, rtol=1e-12)
    assert np.all(np.isneginf(GammaGamma.log_likelihood((-1, q, g), x, z)))
    frame = spark.createDataFrame(list(zip(map(float, x), map(float, z))), "x double, z double")
    for q in (q, 3e4):  # the expression keeps the digits that large parameters cost
        column = GammaGamma.log_likelihood_column((p, q, g), F.col("x"), F.col("z"))
        assert np.allclose([r.v for r in frame.select(column.alias("v")).collect()], GammaGamma.log_likelihood((p, q, g), x, z), rtol=1e-11)
    model = GammaGamma().fit(simulated)
    assert np.allclose(model.params_, [6.25, 3.74, 15.44], rtol=0.25)
    spend = model.predict(summary(spark, [0, 3], [0, 3], [9, 9], [0, 50])).to_pandas()["expected_spend"]
    assert spend["c0"] == pytest.approx(model.population_mean()) and model.population_mean() < spend["c1"] < 50
    with pytest.raises(ValueError, match="amount_col"):
        GammaGamma().fit(summary(spark, [1], [1], [1]))
    with pytest.raises(ValueError, match="repeat"):
        GammaGamma().fit(summary(spark, [0], [0], [1], [0]))
    with pytest.raises(ValueError, match="positive monetary_value"):
        GammaGamma().fit(summary(spark, [1], [1], [1], [-1]))
    with pytest.raises(ValueError, match="1 of 1 repeat buyers"):
        GammaGamma().fit(summary(spark, [1], [1], [1], [0]))
    with pytest.raises(RuntimeError, match="not fitted"):
        GammaGamma().predict()
    zero = summary(spark, [1] * 30 + [2], [1] * 31, [9] * 31, [5 + k % 7 for k in range(30)] + [0])
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        try:
            GammaGamma().fit(zero)
        except RuntimeError:
            pass
    assert any("1 of 31 repeat buyers have monetary_value" in str(w.message) for w in said)


def test_independence(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 9, 500)
    z = np.where(x > 0, rng.gamma(4, 10, 500), 0)
    found = check_monetary_independence(summary(spark, x, x, x + 5, z))
    pairs = pd.DataFrame({"x": x, "z": z})[x > 0]
    assert found.n_customers == len(pairs) and found.holds()
    assert found.pearson_r == pytest.approx(pairs["x"].corr(pairs["z"])) and found.spearman_rho == pytest.approx(pairs["x"].rank().corr(pairs["z"].rank()))
    within = pairs.groupby("x")["z"].transform("mean")
    assert found.eta_squared == pytest.approx(((within - pairs["z"].mean()) ** 2).sum() / ((pairs["z"] - pairs["z"].mean()) ** 2).sum())
    groups = found.grouped_spend(3)
    assert list(groups) == ["1", "2", "3+"] and sum(map(len, groups.values())) == len(pairs)
    assert found.plot_data(3).count() == 3 and found.to_pandas().loc["n_customers", "value"] == len(pairs)
    with pytest.raises(ValueError, match="max_frequency"):
        found.grouped_spend(0)
    dependent = summary(spark, x, x, x + 5, np.where(x > 0, 10.0 * x + rng.normal(size=500), 0))
    assert not check_monetary_independence(dependent).holds()
    buyer = int(np.flatnonzero(x > 0)[0])
    assert check_monetary_independence(dependent, exclude=[f"c{buyer}"]).n_customers == len(pairs) - 1
    with pytest.raises(KeyError, match="not in this base"):
        check_monetary_independence(dependent, exclude=["nobody"])
    with pytest.raises(ValueError, match="amount_col"):
        check_monetary_independence(summary(spark, [1], [1], [1]))
    with pytest.raises(ValueError, match="repeat"):
        check_monetary_independence(summary(spark, [0], [0], [1], [0]))
    with pytest.raises(ValueError, match="frequency"):
        check_monetary_independence(summary(spark, [1, 1], [1, 1], [2, 2], [3, 4]))
    flat = summary(spark, [1, 2], [1, 1], [2, 2], [3, 3]).to_spark()
    assert independence.eta_squared(flat).first()[0] == 0


class Steady:
    """Buys at a fixed rate; anything with fit and predict can take a model's place."""

    def __init__(self, rate=0.5):
        self.rate, self.times = rate, []

    def fit(self, cb):
        self.cb = cb
        return self

    def predict(self, t, cb=None):
        self.times.append(t)
        frame = (cb or self.cb).to_spark()
        return Prediction(frame.select("customer_id", F.lit(self.rate * t).alias("n")), name="n", description="n")


class Spender(Steady):
    def predict(self, cb=None):
        return Prediction((cb or self.cb).to_spark().select("customer_id", F.lit(10.0).alias("s")), name="s", description="s")


def test_clv_of_injected_models(spark):
    cb = summary(spark, [1, 2], [1, 1], [2, 2], [3, 4])
    clv = CLV(Steady(), Spender(), check_independence=False).fit(cb)
    out = clv.predict(horizon=3, discount_rate=0.1, margin=0.5).to_pandas()
    det = sum(0.5 / 1.1**t for t in (1, 2, 3))
    assert np.allclose(out.loc["c0"], [1.5, det, 10.0, 0.5 * 10 * det]) and clv.transaction_model.times == [1.0, 2.0, 3.0]
    assert out.columns.tolist() == ["expected_purchases", "discounted_expected_transactions", "expected_spend", "clv"]
    for bad, word in (({"horizon": 0}, "horizon"), ({"horizon": 1.5}, "horizon"), ({"horizon": 1, "discount_rate": -1}, "discount_rate"), ({"horizon": 1, "margin": 0}, "margin")):
        with pytest.raises(ValueError, match=word):
            clv.predict(**bad)
    with pytest.raises(RuntimeError, match="not fitted"):
        CLV().predict(horizon=1)
    with pytest.raises(RuntimeError, match="not fitted"):
        CLV().independence_check()
    with pytest.raises(TypeError, match="CustomerBase"):
        CLV().fit(1)
    with pytest.raises(ValueError, match="CLV is a monetary quantity.*amount_col"):
        CLV().fit(summary(spark, [1], [1], [1]))


def test_clv_warns_of_dependence_and_adds_up(spark, simulated):
    x = np.arange(1, 200) % 9
    dependent = summary(spark, x, x, x + 5, np.where(x > 0, 10.0 * x + 1, 0))
    with pytest.warns(MonetaryIndependenceWarning, match="independen"):
        CLV(Steady(), Spender()).fit(dependent)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        CLV(Steady(), Spender()).fit(summary(spark, [1, 1], [1, 1], [2, 2], [3, 4]))
    clv = CLV().fit(simulated)
    result = clv.predict(horizon=4)
    out = result.to_pandas()
    assert np.allclose(out["expected_purchases"], out["discounted_expected_transactions"])
    assert np.allclose(out["expected_purchases"], values_of(clv.transaction_model.predict(4)).loc[out.index])
    assert {r.kind for r in result.plot_data().collect()} == {"level", "ceiling"} and "4 W" in repr(result)


def test_discounting(spark):
    frame = spark.createDataFrame([([1.0, 3.0],)], "c array<double>")
    assert frame.select(discounted(F.col("c"), 2, 1.0)).first()[0] == pytest.approx(1 / 2 + 2 / 4)
