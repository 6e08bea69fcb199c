"""Transaction logs from files, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, *, header: bool = True, sep: str = ",") -> DataFrame:
    """CSV with a given schema, so that the file is read once."""
    return spark.read.csv(path, schema=schema, header=header, sep=sep)


def read_whitespace(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A text table of fields between white space; `columns` maps names to types, in order. Blank lines are skipped."""
    fields = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).filter(F.length(F.trim(F.col("value"))) > 0)
    return rows.select(*[fields[k].cast(kind).alias(name) for k, (name, kind) in enumerate(columns.items())])


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").csv(path, header=True)


def as_json(frame: DataFrame, id_col: str) -> DataFrame:
    """(id, json): one JSON object per row, nulls kept, without collecting anything."""
    rest = [c for c in frame.columns if c != id_col]
    return frame.select(F.col(id_col).cast("string").alias(id_col), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))
