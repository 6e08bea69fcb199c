"""Common preparations and reports around a customer base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orders_from_line_items(
    lines: DataFrame, *, customer_id_col: str, invoice_col: str, datetime_col: str, quantity_col: str, price_col: str, cancelled_prefix: str = "C"
) -> DataFrame:
    """(customer_id, invoice, date, amount): one row per invoice, without cancellations, unknown customers and free or returned lines."""
    good = lines.filter(F.col(customer_id_col).isNotNull() & ~F.col(invoice_col).cast("string").startswith(cancelled_prefix) & (F.col(quantity_col) > 0) & (F.col(price_col) > 0))
    by = good.groupBy(F.col(customer_id_col).alias("customer_id"), F.col(invoice_col).alias("invoice"))
    return by.agg(F.min(datetime_col).alias("date"), F.sum(F.col(quantity_col) * F.col(price_col)).alias("amount"))


def readiness(log: DataFrame, *, customer_id: str = "customer_id", date: str = "date", amount: str = "amount") -> DataFrame:
    """Three checks of a log before a fit: check, found, total, ok."""
    stats = [F.count("*").alias("n"), F.min(date).alias("a"), F.max(date).alias("b"), F.count(F.when(F.col(amount) <= 0, 1)).alias("bad")]
    each = log.filter(F.col(customer_id).isNotNull()).groupBy(customer_id).agg(*stats)
    total = each.agg(
        F.count("*").alias("customers"), F.count(F.when(F.col("n") > 1, 1)).alias("repeat"), F.datediff(F.max("b"), F.min("a")).cast("bigint").alias("days"), F.sum("bad").alias("bad"), F.sum("n").alias("rows")
    )
    rows = F.array(
        F.struct(F.lit("repeat buyers").alias("check"), F.col("repeat").alias("found"), F.col("customers").alias("total"), ((F.col("repeat") >= 100) & (F.col("repeat") > 0.05 * F.col("customers"))).alias("ok")),
        F.struct(F.lit("calendar span").alias("check"), F.col("days").alias("found"), F.lit(180).cast("bigint").alias("total"), (F.col("days") >= 180).alias("ok")),
        F.struct(F.lit("non-positive amounts").alias("check"), F.col("bad").alias("found"), F.col("rows").alias("total"), (F.col("bad") == 0).alias("ok")),
    )
    return total.select(F.inline(rows))


def naive_value(horizon: float) -> Column:
    """Past rate times horizon times mean spend; 0 for a customer of age 0."""
    return F.coalesce(F.try_divide(F.col("frequency").cast("double"), F.col("T").cast("double")), F.lit(0.0)) * float(horizon) * F.col("monetary_value")


def by_frequency(calibration: DataFrame, predicted: Column, holdout: DataFrame, id_col: str, pool: int = 7) -> DataFrame:
    """Mean predicted and actual holdout purchases by calibration frequency, `pool` and more together."""
    both = calibration.withColumn("predicted", predicted).join(holdout.select(id_col, "frequency_holdout"), id_col, "left")
    level = F.least("frequency", F.lit(pool).cast("bigint")).alias("bucket")
    return both.groupBy(level).agg(F.count("*").cast("bigint").alias("customers"), F.avg("predicted").alias("predicted"), F.avg(F.coalesce("frequency_holdout", F.lit(0))).alias("actual"))


def top_share(frame: DataFrame, id_col: str, score: str, share: float = 0.10) -> DataFrame:
    """The ids of the top share by a score, whole number rounded down, ties by id."""
    n = int(frame.count() * share)
    return frame.orderBy(F.desc(score), id_col).limit(n).select(id_col)


def overlap(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """(part, customers): ids in both, only in the first, only in the second."""
    parts = [("both", a.join(b, id_col, "left_semi")), ("only_first", a.join(b, id_col, "left_anti")), ("only_second", b.join(a, id_col, "left_anti"))]
    out = None
    for name, part in parts:
        one = part.agg(F.count("*").cast("bigint").alias("customers")).select(F.lit(name).alias("part"), "customers")
        out = one if out is None else out.unionByName(one)
    return out
