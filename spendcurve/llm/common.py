"""Session settings, durable intermediates and small helpers shared by the operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: a batch of long documents must still fit a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

#: Session setting under which Spark deletes a query's shuffle files when the query has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folders: dict[str, str] = {}
_swept: set[str] = set()
#: What this process holds from one task to the next, by name.
held: dict[str, object] = {}


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, so that a Python worker's memory does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def drop_held() -> None:
    """In the worker's own module: a function that is sent to workers would clear a copy."""
    held.clear()


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library would keep it as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker is small again when its task has ended, as workers outlive tasks and queries.

    Unless it `holds` things itself, it first drops what tasks of other operators have held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            drop_held()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for a while."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of its own only where that is unset on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_folders:
        holder = tempfile.TemporaryDirectory(prefix="spendcurve-")
        atexit.register(holder.cleanup)
        _own_folders[app] = f"file://{holder.name}"
    return _own_folders[app]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sweep(spark: SparkSession, folder: str) -> None:
    with suppress(Exception):  # at the interpreter's end, when the JVM may have gone
        _delete(spark, folder)


class Stash:
    """Written intermediates of one operator call, in the shared folder; cuts lineage, survives lost executors.

    What no later step reads is dropped as soon as it can be; results may read the rest, which goes when the
    driver's interpreter ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        app = f"{shared_folder(spark).rstrip('/')}/spendcurve-{spark.sparkContext.applicationId}"
        self.root = f"{app}/{name}-{uuid.uuid4().hex}"
        if app not in _swept:
            _swept.add(app)
            atexit.register(_sweep, spark, app)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write and read again; with `by` in a folder for each value of that column, which can be dropped by itself."""
        path = f"{self.root}/{name}"
        writer = df.write.mode("overwrite")
        # what is shuffled for this is not read again
        with setting(self.spark, CLEAN_SHUFFLES, "true"):
            (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete intermediates that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def by_id(ids: DataFrame) -> DataFrame:
    """A table of different ids for the small side of a join with texts: a hash table a partition, so that texts are shuffled but not sorted."""
    return ids.hint("shuffle_hash")


def hot_keys(counts: DataFrame, key: str, pieces: int = 1024) -> DataFrame:
    """(key, __pieces): keys with over 1 / `pieces` of all rows, from a table (key, n); there are less than `pieces` of them."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(total // pieces, 1000)
    return counts.filter(F.col("n") > part).select(key, F.ceil(F.col("n") / part).cast("int").alias("__pieces"))


def salted(left: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """The many rows of a join, those of hot keys dealt over __salt."""
    return left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__pieces", F.lit(1)))).drop("__pieces")


def spread(right: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The one row for each key of the same join, repeated for every __salt of a hot key."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__pieces", F.lit(1)).cast("long") - 1))
    return right.join(F.broadcast(hot), key, "left").withColumn("__salt", salts).drop("__pieces")


def matched(rows: DataFrame, key: str, by: str, values: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """rows joined to values on `key`, of which rows may have any number: those of hot keys are dealt over tasks by the column `by`.

    `counted` is a written table with the same keys, where counting rows would compute them once more.
    """
    hot = hot_keys((rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("n")), key)
    return salted(rows, hot, key, by).join(spread(values, hot, key), [key, "__salt"]).drop("__salt")


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that no caller's column can clash with."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
