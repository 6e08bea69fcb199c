"""The transaction logs that the queries read, as DataFrames and as DuckDB SQL. Amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cents(name: str):
    return F.round(F.col(name) * 100).cast("double")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("date"), cents("o_totalprice").alias("amount"))


def orders_without_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_orderdate").alias("date"), cents("o_totalprice").alias("amount"))


def refunds(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    sign = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 4), -1.0).otherwise(1.0)
    return lines.select(F.col("o_custkey").alias("customer_id"), F.col("l_shipdate").alias("date"), (sign * cents("l_extendedprice")).alias("amount"))


def purchases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'purchase'")
    return rows.select(F.col("user_id").alias("customer_id"), F.col("ts").alias("date"))


LAPSING = """
thin AS (SELECT o_custkey AS id, {day} AS b, round(o_totalprice * 100) AS cents FROM orders
         WHERE (o_orderkey * 31) % 101 < 4 + (((o_custkey * 37) % 101) * ((o_custkey * 37) % 101)) {div} 110),
days AS (SELECT id, b, sum(cents) AS spend FROM thin GROUP BY id, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) AS rn FROM days),
kept AS (SELECT id, b, spend FROM ranked
         WHERE rn <= 1 + floor(ln(((id * 53) % 97 + 0.5) / 97) / ln(1.0 - (0.03 + 0.17 * ((id * 29) % 5))))),
horizon AS (SELECT max(b) AS last FROM days)
"""


def lapsing(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Orders thinned so that customers buy at different rates and drop out, and the last day of observation."""
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    ctes = "WITH " + LAPSING.format(day="unix_date(CAST(o_orderdate AS DATE))", div="div")
    log = spark.sql(f"{ctes} SELECT id AS customer_id, date_from_unix_date(CAST(b AS INT)) AS date, CAST(spend AS DOUBLE) AS amount FROM kept")
    last = spark.sql(f"{ctes} SELECT CAST(date_from_unix_date(CAST(last AS INT)) AS STRING) FROM horizon").first()[0]
    return log, last


DAY = "date_diff('day', DATE '1970-01-01', CAST({ts} AS DATE))"
ORDERS = "SELECT o_custkey AS id, o_orderdate AS ts, round(o_totalprice * 100) AS amount FROM orders"
NO_IDS = "SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END AS id, o_orderdate AS ts, round(o_totalprice * 100) AS amount FROM orders"
REFUNDS = """SELECT o_custkey AS id, l_shipdate AS ts,
  CASE WHEN l_returnflag = 'R' AND l_linenumber > 4 THEN -1.0 ELSE 1.0 END * round(l_extendedprice * 100) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PURCHASES = "SELECT user_id AS id, ts, 1.0 AS amount FROM events WHERE event_type = 'purchase'"


def ordinal(unit: str, ts: str = "ts") -> str:
    day = DAY.format(ts=ts)
    return {
        "h": f"({day} * 24 + hour({ts}))", "D": f"({day})", "W": f"(({day} + 10) // 7)", "M": f"((year({ts}) - 1970) * 12 + month({ts}) - 1)",
        "Q": f"((year({ts}) - 1970) * 4 + quarter({ts}) - 1)", "Y": f"(year({ts}) - 1970)",
    }[unit]


def totals(log: str, unit: str) -> str:
    return f"""log AS ({log}), totals AS (SELECT id, {ordinal(unit)} AS b, count(*) AS n, count(*) FILTER (amount >= 0) AS nn,
      count(*) FILTER (amount < 0) AS neg, sum(amount) AS net, coalesce(sum(amount) FILTER (amount >= 0), 0) AS gross FROM log WHERE id IS NOT NULL GROUP BY 1, 2)"""


def events(log: str, unit: str, policy: str = "net") -> str:
    spend = "CASE WHEN net > 0 THEN net END" if policy == "net" else "gross"
    return f"{totals(log, unit)}, events AS (SELECT id, b, {spend} AS spend FROM totals WHERE nn > 0)"


def summary(unit: str, ratio: int, end: str, monetary: bool = True, source: str = "events", name: str = "rfm") -> str:
    """rfm: id, frequency, recency, T, monetary_value in cents, from a CTE of events; `end` is SQL for the last bucket."""
    whole = (lambda e: f"CAST({e} AS BIGINT)") if ratio == 1 else (lambda e: f"CAST({e} AS DOUBLE) / {ratio}.0::DOUBLE")
    mean = ", coalesce(CAST(sum(CASE WHEN b > fb THEN spend END) AS DOUBLE) / CAST(count(CASE WHEN b > fb THEN spend END) AS DOUBLE), 0.0::DOUBLE) AS monetary_value" if monetary else ""
    return f"""{name} AS (SELECT id, CAST(count(*) - 1 AS BIGINT) AS frequency, {whole("max(b) - min(b)")} AS recency,
      {whole(f"{end} - min(b)")} AS "T"{mean} FROM (SELECT *, min(b) OVER (PARTITION BY id) AS fb FROM {source}) GROUP BY id)"""


def rfm(log: str, unit: str, ratio: int = 1, policy: str = "net", monetary: bool = True, end: str | None = None) -> str:
    """The whole SELECT, spend in money."""
    last = end or f"(SELECT {ordinal(unit, 'max(ts)')} FROM log WHERE id IS NOT NULL)"
    money = ", monetary_value / 100.0::DOUBLE AS monetary_value" if monetary else ""
    return f'WITH {events(log, unit, policy)}, {summary(unit, ratio, last, monetary)} SELECT id AS customer_id, frequency, recency, "T"{money} FROM rfm'
