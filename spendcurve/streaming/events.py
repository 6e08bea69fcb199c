"""Purchase events kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Windows that the batch grain also has; streams have no calendar months.
WINDOWS = {"h": "1 hour", "D": "1 day"}


def streaming_totals(log: DataFrame, *, collapse: str = "D", watermark: str = "2 days", id_col: str = "customer_id", datetime_col: str = "date", amount_col: str = "amount") -> DataFrame:
    """(id, period_start, n_rows, n_vouched, net, gross) per customer and period, from a streaming log.

    The same totals that a batch makes of the log; rows later than the watermark are dropped.
    """
    if collapse not in WINDOWS:
        raise ValueError(f"collapse must be one of {tuple(WINDOWS)} for a stream, got {collapse!r}")
    amount = F.col(amount_col).cast("double")
    rows = log.filter(F.col(id_col).isNotNull()).withColumn("ts", F.col(datetime_col).cast("timestamp")).withWatermark("ts", watermark)
    sums = rows.groupBy(F.col(id_col).alias("id"), F.window("ts", WINDOWS[collapse])).agg(
        F.count("*").alias("n_rows"), F.count(F.when(amount >= 0, 1)).alias("n_vouched"), F.sum(amount).alias("net"), F.sum(F.when(amount >= 0, amount)).alias("gross")
    )
    return sums.select("id", F.col("window.start").alias("period_start"), "n_rows", "n_vouched", "net", "gross")
