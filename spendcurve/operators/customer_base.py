"""Transaction log -> purchase events -> one row of recency, frequency and age per customer."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendcurve.functions import periods
from spendcurve.plans import display

POLICIES = ("net", "drop", "raise")


@dataclass(frozen=True)
class Provenance:
    """How a summary was made."""

    id_col: str
    time_unit: str
    collapse: str
    ratio: int
    has_monetary: bool
    on_negative: str
    observation_end: pd.Timestamp

    @property
    def last_bucket(self) -> int:
        return periods.ordinal_of(self.observation_end, self.collapse)


def normalized_log(log: DataFrame, id_col: str, datetime_col: str, amount_col: str | None, datetime_format: str | None = None) -> DataFrame:
    """id, ts and, with amounts, amount: NaN amounts and ids become null, string dates are parsed; nothing else is read."""
    for name in (id_col, datetime_col, *([amount_col] if amount_col else [])):
        if name not in log.columns:
            raise KeyError(f"the log has no column {name!r}")
    kinds = dict(log.dtypes)
    key = F.col(f"`{id_col}`")
    if kinds[id_col] in ("double", "float"):
        key = F.when(~F.isnan(key), key)
    columns = [key.alias("id"), periods.timestamps(F.col(f"`{datetime_col}`"), kinds[datetime_col], datetime_format).alias("ts")]
    if amount_col:
        amount = F.col(f"`{amount_col}`").cast("double")
        columns.append(F.when(~F.isnan(amount), amount).alias("amount"))
    return log.select(*columns)


def bucket_totals(log: DataFrame, collapse: str, has_monetary: bool) -> DataFrame:
    """One row per (id, bucket): everything that policies, counters and summary need, from one aggregation of the log."""
    sums = [F.count("*").alias("n_rows"), F.max("ts").alias("last_ts")]
    if has_monetary:
        amount = F.col("amount")
        sums += [
            F.count(F.when(amount >= 0, 1)).alias("n_vouched"),
            F.count(F.when(amount < 0, 1)).alias("n_negative"),
            F.coalesce(F.sum("amount"), F.lit(0.0)).alias("net"),
            F.coalesce(F.sum(F.when(amount >= 0, amount)), F.lit(0.0)).alias("gross"),
        ]
    return log.withColumn("bucket", periods.ordinal(F.col("ts"), collapse)).groupBy("id", "bucket").agg(*sums)


def spend_of(policy: str) -> Column:
    """What an event spent: under net a total that is not positive is no spend."""
    return {"net": F.when(F.col("net") > 0, F.col("net")), "drop": F.col("gross"), "raise": F.col("net")}[policy]


def purchase_events(totals: DataFrame, policy: str, has_monetary: bool) -> DataFrame:
    """(id, bucket[, spend]): buckets with a non-negative amount, under any policy."""
    if not has_monetary:
        return totals.select("id", "bucket")
    return totals.filter("n_vouched > 0").select("id", "bucket", spend_of(policy).alias("spend"))


#: Amounts that are whole in this part of a unit are summed as whole numbers.
_PARTS = 10_000


def _summary_sums(event: Column, spend: Column | None) -> list[Column]:
    """Aggregates over a customer's buckets: how many events, first and last bucket, and what the mean spend after the first needs."""
    bucket = F.when(event, F.col("bucket"))
    sums = [F.count(bucket).alias("n_events"), F.min(bucket).alias("first_bucket"), F.max(bucket).alias("last_bucket")]
    if spend is not None:
        spend = F.when(event, spend)
        whole = F.when(F.abs(spend) < 1e11, F.round(spend * _PARTS).cast("bigint"))
        whole = F.when(whole / _PARTS == spend, whole)
        sums += [
            F.count(spend).alias("n_spends"), F.count(whole).alias("n_whole"), F.sum(spend).alias("spent"), F.try_sum(whole).alias("spent_whole"),
            F.min_by(spend, bucket).alias("first_spend"), F.min_by(whole, bucket).alias("first_whole"),
        ]
    return sums


def _mean_again() -> Column:
    """Mean spend of the events after the first, 0 without any: a sum less its first part, exact where all amounts are whole parts."""
    n = F.col("n_spends") - F.when(F.col("first_spend").isNotNull(), 1).otherwise(0)
    exact = (F.col("n_whole") == F.col("n_spends")) & F.col("spent_whole").isNotNull()
    rest = F.col("spent") - F.coalesce("first_spend", F.lit(0.0))
    rest = F.when(exact, (F.col("spent_whole") - F.coalesce("first_whole", F.lit(0))) / _PARTS).otherwise(rest)
    return F.when(n > 0, rest / n).otherwise(0.0)


def summarize(events: DataFrame, has_monetary: bool) -> DataFrame:
    """Per customer: number of events, first and last bucket, mean spend of the events after the first (0 without any)."""
    customers = events.groupBy("id").agg(*_summary_sums(F.lit(True), F.col("spend") if has_monetary else None))
    return customers.withColumn("monetary_value", _mean_again()) if has_monetary else customers


def rfm(summary: DataFrame, made: Provenance) -> DataFrame:
    """id, frequency, recency, T[, monetary_value] in the ruler's unit: whole numbers unless grain and ruler differ."""

    def ruler(c: Column) -> Column:
        return c.cast("bigint") if made.ratio == 1 else c.cast("double") / F.lit(float(made.ratio))

    columns = [
        F.col("id").alias(made.id_col),
        (F.col("n_events") - 1).cast("bigint").alias("frequency"),
        ruler(F.col("last_bucket") - F.col("first_bucket")).alias("recency"),
        ruler(F.lit(made.last_bucket) - F.col("first_bucket")).alias("T"),
    ]
    return summary.select(*columns, *(["monetary_value"] if made.has_monetary else []))


class CustomerBase:
    """The summary of a log, with how it was made. Lazy but for one pass that counts what warnings need."""

    def __init__(self, summary: DataFrame, made: Provenance, events: DataFrame | None = None, counts: dict | None = None):
        self._summary, self._made, self._events, self._counts = summary, made, events, counts
        self._held: DataFrame | None = None

    time_unit = property(lambda self: self._made.time_unit)
    collapse = property(lambda self: self._made.collapse)
    periods_per_time_unit = property(lambda self: self._made.ratio)
    observation_period_end = property(lambda self: self._made.observation_end)
    has_monetary = property(lambda self: self._made.has_monetary)
    on_negative = property(lambda self: self._made.on_negative)
    id_col = property(lambda self: self._made.id_col)
    provenance = property(lambda self: self._made)

    @classmethod
    def from_transactions(
        cls,
        transactions: DataFrame | pd.DataFrame,
        customer_id_col: str = "customer_id",
        datetime_col: str = "date",
        amount_col: str | None = "amount",
        *,
        time_unit: str = "D",
        collapse: str | None = None,
        observation_period_end: str | pd.Timestamp | None = None,
        datetime_format: str | None = None,
        on_negative: str = "net",
        validate: bool = True,
    ) -> CustomerBase:
        """Summarise a log.

        `time_unit` is the unit of recency and T, `collapse` (the same unless given) the grain at which
        transactions merge into one event. `on_negative` says what an event with refunds spent: the net
        total, the total without negatives, or an error. `datetime_format` is a Java pattern for string
        dates. Rows without an id or a date are dropped with a warning. `validate=False` skips every
        count, so nothing runs; the end of observation must then be given.
        """
        if on_negative not in POLICIES:
            raise ValueError(f"on_negative must be one of {POLICIES}, got {on_negative!r}")
        if isinstance(transactions, pd.DataFrame):
            transactions = SparkSession.builder.getOrCreate().createDataFrame(transactions)
        if not isinstance(transactions, DataFrame):
            raise TypeError(f"the log must be a Spark or pandas DataFrame, got {type(transactions).__name__}")
        grain = collapse if collapse is not None else time_unit
        ratio = periods.ruler_ratio(grain, time_unit)
        has_monetary = amount_col is not None
        log = normalized_log(transactions, customer_id_col, datetime_col, amount_col, datetime_format)
        totals = bucket_totals(log, grain, has_monetary)
        customers = per_customer(totals, on_negative, has_monetary)
        if validate:
            customers = customers.persist()
            counts = _counts(customers)
            end = _checked_end(counts, observation_period_end, on_negative)
            _warn(counts, customer_id_col, collapse, grain, on_negative, has_monetary)
        elif observation_period_end is None:
            raise ValueError("validate=False needs observation_period_end: the last transaction is not looked up")
        else:
            counts, end = None, pd.Timestamp(observation_period_end)
        made = Provenance(customer_id_col, time_unit, grain, ratio, has_monetary, on_negative, end)
        events = purchase_events(totals.filter("id IS NOT NULL AND bucket IS NOT NULL"), on_negative, has_monetary)
        out = cls(rfm(customers.filter("id IS NOT NULL AND n_events > 0"), made), made, events, counts)
        out._held = customers if validate else None
        return out

    def unpersist(self) -> None:
        """Release the customers that were held for counting; results are computed from the log again."""
        if self._held is not None:
            self._held.unpersist()

    @classmethod
    def from_summary(cls, summary: DataFrame, *, id_col: str = "customer_id", time_unit: str = "D", collapse: str | None = None, observation_period_end="1970-01-01") -> CustomerBase:
        """Wrap a summary that is already there; it has no events, so it can't be split."""
        grain = collapse or time_unit
        made = Provenance(id_col, time_unit, grain, periods.ruler_ratio(grain, time_unit), "monetary_value" in summary.columns, "net", pd.Timestamp(observation_period_end))
        return cls(summary, made)

    def split(self, *, calibration_period_end, observation_period_end=None) -> tuple[CustomerBase, DataFrame]:
        """A base of the events up to one bucket, and what its customers did from there to the end.

        Buckets are compared, so the whole bucket that holds the cut is calibration. The holdout frame has
        frequency_holdout (events), monetary_value_holdout (mean spend, 0 without any) and duration_holdout.
        """
        if self._events is None:
            raise ValueError("split needs the purchase events, which a base made from a summary does not have")
        made = self._made
        end = pd.Timestamp(observation_period_end) if observation_period_end is not None else made.observation_end
        cut = pd.Timestamp(calibration_period_end)
        first, last = periods.ordinal_of(cut, made.collapse), periods.ordinal_of(end, made.collapse)
        before = replace(made, observation_end=cut)
        early = self._events.filter(F.col("bucket") <= first)
        base = CustomerBase(rfm(summarize(early, made.has_monetary), before), before, early)
        late = (F.col("bucket") > first) & (F.col("bucket") <= last)
        sums = [F.count(F.when(F.col("bucket") <= first, 1)).alias("n_before"), F.count(F.when(late, 1)).cast("bigint").alias("frequency_holdout")]
        if made.has_monetary:
            sums.append(F.coalesce(F.avg(F.when(late, F.col("spend"))), F.lit(0.0)).alias("monetary_value_holdout"))
        span = last - first
        duration = F.lit(span).cast("bigint") if made.ratio == 1 else F.lit(span / made.ratio)
        holdout = self._events.groupBy("id").agg(*sums).filter("n_before > 0").drop("n_before")
        return base, holdout.withColumnRenamed("id", made.id_col).withColumn("duration_holdout", duration)

    def sufficient_statistics(self) -> DataFrame:
        """How many customers share (frequency, recency, T): all that the event models' likelihoods depend on."""
        return self._summary.groupBy("frequency", "recency", "T").agg(F.count("*").cast("bigint").alias("customers"))

    def events(self) -> DataFrame | None:
        return self._events

    def to_spark(self) -> DataFrame:
        return self._summary

    def to_pandas(self) -> pd.DataFrame:
        return self._summary.toPandas().set_index(self._made.id_col)

    def to_json(self) -> str:
        return self.to_pandas().to_json(orient="index")

    def __repr__(self) -> str:
        return display.short(self)

    def __str__(self) -> str:
        return display.long(self)


def per_customer(totals: DataFrame, policy: str, has_monetary: bool) -> DataFrame:
    """A row for each id, null included: all counters, and what the summary needs. Partial sums by bucket come first, so a hot customer costs no task more than its buckets; there is no sort."""
    known = F.col("id").isNotNull() & F.col("bucket").isNotNull()
    rows = F.col("n_rows")
    event = known & (F.col("n_vouched") > 0) if has_monetary else known
    sums = [
        F.sum(rows).alias("all_rows"),
        F.sum(F.when(F.col("id").isNull(), rows)).alias("no_id"),
        F.sum(F.when(F.col("id").isNotNull() & F.col("bucket").isNull(), rows)).alias("no_date"),
        F.max(F.when(F.col("id").isNotNull(), F.col("last_ts"))).alias("last_ts"),
        F.sum(F.when(known, rows)).alias("rows"),
        F.count(F.when(known, 1)).alias("buckets"),
        *_summary_sums(event, spend_of(policy) if has_monetary else None),
    ]
    if has_monetary:
        sums += [
            F.sum(F.when(known, F.col("n_negative"))).alias("negative"),
            F.count(F.when(event & (F.col("net") <= 0), 1)).alias("netted"),
        ]
    customers = totals.groupBy("id").agg(*sums)
    inner = ["first_spend", "first_whole", "n_spends", "n_whole", "spent", "spent_whole"]
    return customers.withColumn("monetary_value", _mean_again()).drop(*inner) if has_monetary else customers


def _counts(customers: DataFrame) -> dict:
    """All counters in one row."""
    names = [c for c in ("all_rows", "no_id", "no_date", "rows", "buckets", "n_events", "negative", "netted") if c in customers.columns]
    over = [F.sum(c).alias(c) for c in names]
    over += [
        F.max("last_ts").cast("string").alias("last_ts"),
        F.count(F.when(F.col("buckets") > 0, F.col("id"))).alias("customers"),
        F.count(F.when(F.col("n_events") > 0, F.col("id"))).alias("with_events"),
        F.count(F.when(F.col("n_events") > 1, F.col("id"))).alias("repeat_buyers"),
    ]
    found = customers.agg(*over).first().asDict()
    return {k: (v if k == "last_ts" else int(v or 0)) for k, v in found.items()}


def _checked_end(counts: dict, given, policy: str) -> pd.Timestamp:
    last = pd.Timestamp(counts["last_ts"]) if counts["last_ts"] else None
    if policy == "raise" and counts.get("negative"):
        raise ValueError(f"negative amounts found in {counts['negative']} of {counts['rows']} transactions and on_negative='raise'")
    if given is None:
        return last if last is not None else pd.Timestamp("1970-01-01")
    end = pd.Timestamp(given)
    if last is not None and end < last:
        raise ValueError(f"observation_period_end={end} is before the last transaction ({last}): it does not truncate the log; filter the log first")
    return end


def _warn(c: dict, id_col: str, collapse: str | None, grain: str, policy: str, has_monetary: bool) -> None:
    def say(text: str) -> None:
        warnings.warn(text, UserWarning, stacklevel=4)

    if c["no_id"]:
        say(f"{c['no_id']} of {c['all_rows']} rows have no {id_col!r} and were dropped")
    if c["no_date"]:
        say(f"{c['no_date']} of {c['all_rows']} rows have no date and were dropped")
    absorbed = c["rows"] - c["buckets"]
    if collapse is None and absorbed and periods.finer("D", grain):
        cure = "pass collapse='D' to keep them on the same ruler" if periods.unit(grain) == "W" else "use a finer time_unit to keep them"
        say(f"time_unit={grain!r} collapsed {absorbed} of {c['rows']} transactions into others of the same period; {cure}, or collapse={grain!r} to say that this is meant")
    if not has_monetary:
        return
    if erased := c["customers"] - c["with_events"]:
        say(f"on_negative={policy!r} dropped {erased} of {c['customers']} customers entirely: they have no amount that is not negative")
    if policy == "net" and c["netted"]:
        say(f"on_negative='net' netted {c['netted']} of {c['n_events']} purchase events to no spend; they still count in frequency, recency and T")
    if policy == "drop" and c["negative"]:
        say(f"on_negative='drop' discarded {c['negative']} of {c['rows']} transactions from what was spent; frequency, recency and T are as before")
