"""Triangles, curves, recipes, sources and the stream, on logs that can be checked by hand."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendcurve import BGNBD, CohortMatrix, CohortSurvival, CustomerBase
from spendcurve.operators import recipes
from spendcurve.operators.results import Prediction
from spendcurve.sources import logs
from spendcurve.streaming.events import streaming_totals

ROWS = [
    ("A", "2020-01-05", 20.0), ("A", "2020-03-03", 30.0), ("B", "2020-01-20", 30.0), ("B", "2020-02-11", 20.0), ("B", "2020-03-30", 50.0), ("C", "2020-02-10", 65.0), ("D", "2020-03-01", 70.0), ("D", "2020-03-09", 0.0),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, None if d is None else pd.Timestamp(d).to_pydatetime(), a) for i, d, a in rows], "customer_id string, date timestamp_ntz, amount double")


def test_triangles(spark):
    matrix = CohortMatrix.from_transactions(frame(spark))
    wide = matrix.to_pandas()
    assert wide.index.tolist() == ["2020-01", "2020-02", "2020-03"]
    assert wide.iloc[0].tolist() == [2, 1, 2] and wide.iloc[1].tolist()[:2] == [1, 0] and wide.iloc[1:].isna().to_numpy().sum() == 3
    assert json.loads(matrix.to_json())["2020-02"]["2"] is None
    assert matrix.to_pandas(relative=True).iloc[0].tolist() == [1, 0.5, 1]
    revenue = CohortMatrix.from_transactions(frame(spark), metric="revenue").to_pandas()
    assert revenue.iloc[0].tolist() == [50, 20, 80] and revenue.iloc[2, 0] == 70
    assert CohortMatrix.from_transactions(frame(spark), period="Y").to_pandas().to_numpy().tolist() == [[4]]
    curve = {r.period_number: (r.value, r.cohorts) for r in matrix.curve().collect()}
    assert curve == {0: (1.0, 3), 1: (0.25, 2), 2: (1.0, 1)}


@pytest.mark.parametrize("parts", [1, 5, 12])
def test_triangle_does_not_depend_on_partitions(spark, parts):
    assert CohortMatrix.from_transactions(frame(spark).repartition(parts)).to_pandas().iloc[0].tolist() == [2, 1, 2]


def test_edges_of_the_matrix(spark):
    rows = ROWS + [(None, "2021-01-01", 1.0), ("E", None, 1.0)]
    assert CohortMatrix.from_transactions(frame(spark, rows)).to_pandas().shape == (3, 3)
    zero = CohortMatrix.from_transactions(frame(spark, [("A", "2020-01-01", 0.0), ("A", "2020-02-01", 5.0)]), metric="revenue")
    assert zero.to_spark(relative=True).filter("value IS NOT NULL").count() == 0
    refund = CohortMatrix.from_transactions(frame(spark, [("A", "2020-01-01", 5.0), ("A", "2020-02-01", -5.0)]), metric="revenue").to_pandas()
    assert refund.iloc[0].tolist() == [5, -5]
    with pytest.raises(ValueError, match="metric"):
        CohortMatrix.from_transactions(frame(spark), metric="profit")
    with pytest.raises(ValueError, match="amount_col"):
        CohortMatrix.from_transactions(frame(spark), metric="revenue", amount_col=None)
    for empty in (frame(spark, []), pd.DataFrame({"customer_id": [], "date": [], "amount": []})):
        with pytest.raises(ValueError, match="empty transaction log"):
            CohortMatrix.from_transactions(empty)


class Known:
    """P(alive) by name."""

    def __init__(self, alive):
        self.alive = alive

    def fit(self, cb):
        self.cb = cb
        return self

    def probability_alive(self, cb=None):
        value = F.create_map(*[F.lit(x) for pair in self.alive.items() for x in pair])[F.col("customer_id")]
        return Prediction(self.cb.to_spark().select("customer_id", value.alias("p")), name="p", description="p")


def test_survival(spark):
    rows = [("A", "1998-01-05", 1.0), ("B", "1998-01-20", 1.0), ("C", "1998-02-03", 1.0), ("D", "1998-03-09", 1.0)]
    monthly = CustomerBase.from_transactions(frame(spark, rows), time_unit="M", observation_period_end="1998-04-30")
    fitted = CohortSurvival(Known({"A": 0.8, "B": 0.6, "C": 0.5, "D": 1.0})).fit(monthly)
    curve = fitted.predict().to_pandas()
    assert curve.index.tolist() == ["1998-01", "1998-02", "1998-03"] and curve["survival"].round(9).tolist() == [0.7, 0.5, 1.0]
    assert curve["customers"].tolist() == [2, 1, 1] and curve["age"].tolist() == [3, 2, 1]
    quarter = fitted.predict(period="Q").to_pandas()
    assert quarter.index.tolist() == ["1998Q1"] and quarter["customers"].tolist() == [4] and quarter["age"].tolist() == [1] and quarter["survival"].round(9).tolist() == [0.725]
    with pytest.raises(ValueError, match="finer"):
        fitted.predict(period="D")
    with pytest.raises(RuntimeError, match="not fitted"):
        CohortSurvival().predict()
    with pytest.raises(TypeError, match="CustomerBase"):
        CohortSurvival(BGNBD()).fit(1)


def test_survival_over_fractional_ages(spark):
    rows = [(f"a{k}", "2024-01-05", 1.0) for k in range(3)] + [(f"b{k}", "2024-01-13", 1.0) for k in range(2)]
    base = CustomerBase.from_transactions(frame(spark, rows), time_unit="W", collapse="D", observation_period_end="2024-02-14")
    curve = CohortSurvival(Known({f"{c}{k}": 0.5 for c in "ab" for k in range(3)})).fit(base).predict(period="W").to_pandas()
    assert curve["customers"].to_dict() == {"2024-01-01/2024-01-07": 3, "2024-01-08/2024-01-14": 2}
    straddling = CustomerBase.from_transactions(frame(spark, [("S", "2024-02-02", 1.0)]), time_unit="W", observation_period_end="2024-03-01")
    assert CohortSurvival(Known({"S": 1.0})).fit(straddling).predict(period="M").to_pandas().index.tolist() == ["2024-01"]


def test_recipes(spark):
    lines = spark.createDataFrame(
        [(1, "100", "2020-01-02", 2.0, 3.0), (1, "100", "2020-01-01", 1.0, 4.0), (1, "C101", "2020-01-03", 2.0, 3.0), (None, "102", "2020-01-01", 1.0, 1.0), (2, "103", "2020-01-01", -1.0, 1.0)],
        "c long, i string, d string, q double, p double",
    )
    orders = recipes.orders_from_line_items(lines, customer_id_col="c", invoice_col="i", datetime_col="d", quantity_col="q", price_col="p").collect()
    assert [tuple(r) for r in orders] == [(1, "100", "2020-01-01", 10.0)]
    found = {r.check: (r.found, r.total, r.ok) for r in recipes.readiness(frame(spark)).collect()}
    assert found == {"repeat buyers": (3, 4, False), "calendar span": (85, 180, False), "non-positive amounts": (1, 8, False)}
    scores = spark.createDataFrame([(k, float(k % 7)) for k in range(40)], "id long, s double")
    top = recipes.top_share(scores, "id", "s")
    assert sorted(r.id for r in top.collect()) == [6, 13, 20, 27]
    assert {r.part: r.customers for r in recipes.overlap(top, scores.filter("id < 10").select("id"), "id").collect()} == {"both": 1, "only_first": 3, "only_second": 9}
    value = spark.createDataFrame([(0, 0, 5.0), (4, 8, 5.0)], "frequency long, T long, monetary_value double")
    assert [r.v for r in value.select(recipes.naive_value(6).alias("v")).collect()] == [0.0, 15.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log.txt").write_text("00001 1 19970101 1 11.77\n\n 00002  2 19970112   5 77.00\n")
    rows = logs.read_whitespace(spark, f"file://{tmp_path}/log.txt", {"master": "string", "id": "int", "day": "string", "n": "int", "amount": "double"}).collect()
    assert [tuple(r) for r in rows] == [("00001", 1, "19970101", 1, 11.77), ("00002", 2, "19970112", 5, 77.0)]
    logs.write_csv(frame(spark), f"file://{tmp_path}/csv")
    assert logs.read_csv(spark, f"file://{tmp_path}/csv", "customer_id string, date timestamp, amount double").count() == len(ROWS)
    frame(spark).write.parquet(f"file://{tmp_path}/pq")
    assert logs.read_parquet(spark, f"file://{tmp_path}/pq").count() == len(ROWS)
    one = logs.as_json(spark.createDataFrame([(1, None, 2.0)], "id long, a string, b double"), "id").first()
    assert one.id == "1" and json.loads(one.json) == {"a": None, "b": 2.0}


def test_stream_makes_the_totals_of_a_batch(spark, tmp_path):
    frame(spark).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(frame(spark).schema).parquet(f"file://{tmp_path}/in")
    run = streaming_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.id, r.period_start.date().isoformat()): r.net for r in spark.table("totals").collect()}
    assert got == {(i, d): a for i, d, a in ROWS}
    with pytest.raises(ValueError, match="collapse"):
        streaming_totals(stream, collapse="M")


def test_entry_without_the_llm_part(tmp_path):
    """A copy without the folder and the pipeline still imports and answers."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "spendcurve", tmp_path / "spendcurve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), any(n.startswith('op') for n in q), 'pipeline' in q, set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and int(out[1]) > 60 and out[2:] == ["False", "False", "True"]


def test_drawing_of_cohorts_and_release(spark):
    from test_models import Recorder

    matrix = CohortMatrix.from_transactions(frame(spark))
    ax = Recorder()
    matrix.plot(ax)
    assert ax.calls["imshow"][0][0].shape[0] == matrix.to_pandas().shape[0]
    before = matrix.to_pandas()
    matrix.unpersist()
    assert matrix.to_pandas().equals(before)
