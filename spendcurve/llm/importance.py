"""Quality by importance resampling: two generative models over hashed n-grams, and a Gumbel top-k sample.

The target model counts n-grams of labelled good documents, the raw model those of all documents. A
document's log weight is the log ratio of both models' probabilities of its n-grams. Adding Gumbel noise to
the log weights and keeping the k highest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, bounded_batches, trimmed, two_columns
from spendcurve.llm.textops import U64, Chunk, chunks, constants, mix, ngrams

#: Hash buckets of unigrams and bigrams together.
BITS = 16
#: Labelled rows that the target model and the cutoff are fitted on, at most: those of the lowest hashes.
MAX_LABELLED = 50_000
#: Rows that are sorted on the driver when the k-th key is looked for, at most.
LAST_ROWS = 10_000
SEED = 20

_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[[b for b in range(256) if b >= 128 or chr(b).isalnum() or b == ord("_")]] = 1


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all unigrams and bigrams, document by document, and their counts.

    Tokens are runs of letters and digits, lower-cased, and runs of one mark.
    """
    data = chunk.data
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(chunk.n_docs, dtype=np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data), dtype=bool)
    edge[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (data[1:] != data[:-1]))
    edge[chunk.offsets[chunk.offsets < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    token = kind[starts] > 0
    starts, ends = starts[token], ends[token]
    hashes = chunk.spans_hash(chunk.running(lower=True), starts, ends)
    first = np.searchsorted(starts, chunk.offsets)
    n = np.diff(first)
    pairs = ngrams(hashes, 2)
    inside = np.ones(len(pairs), dtype=bool)
    last = first[1:][n > 0] - 1
    inside[last[last < len(pairs)]] = False
    doc = np.repeat(np.arange(chunk.n_docs), n)
    at = np.concatenate([np.arange(len(hashes)), np.flatnonzero(inside)])
    buckets = np.concatenate([hashes, pairs[inside]]) >> U64(64 - BITS)
    order = np.argsort(doc[at], kind="stable")
    counts = n + np.maximum(n - 1, 0)
    return buckets[order].astype(np.int64), counts


@dataclass
class Model:
    """Log ratio of target and raw probability for each bucket."""

    ratio: np.ndarray

    def weights(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        buckets, counts = features(chunk)
        # summed document by document, so that a weight does not depend on the documents around it
        out = np.full(chunk.n_docs, -np.inf)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.add.reduceat(self.ratio[buckets], (np.cumsum(counts) - counts)[some])
        return out, counts


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that an id always gets again."""
    u = (mix(ids.astype(np.int64).view(U64) ^ constants(1, seed)[0]) >> U64(11)).astype(np.float64) / 2.0**53
    return -np.log(-np.log(np.clip(u, 1e-300, 1 - 1e-16)))


def fit(docs: DataFrame, good: DataFrame) -> Model:
    """docs: __id, __text; good: id. Counts over all documents; smoothed by one a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            flags = np.asarray(batch.column(2).fill_null(False))
            for chunk in chunks(batch.column(1)):
                buckets, counts = features(chunk)
                raw += np.bincount(buckets, minlength=1 << BITS)
                mine = np.repeat(flags[chunk.first : chunk.first + chunk.n_docs], counts)
                target += np.bincount(buckets[mine], minlength=1 << BITS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    flagged = docs.join(F.broadcast(good.select(F.col("id").alias("__id"), F.lit(True).alias("__good"))), "__id", "left").select("__id", "__text", "__good")
    rows = flagged.mapInArrow(trimmed(count), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for row in rows:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() == len(target):
        return Model(np.zeros(1 << BITS))
    return Model(np.log(target / target.sum()) - np.log(raw / raw.sum()))


def best_cutoff(weights: np.ndarray, good: np.ndarray, cost: int = 4) -> float:
    """The weight that parts labelled good from labelled bad rows at the least loss, the middle of the widest such gap.

    A good row under it counts `cost` times, as losing a good document is worse than keeping a bad one.
    """
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(np.int64)
    errors = cost * np.concatenate([[0], np.cumsum(g)]) + np.concatenate([[0], np.cumsum(1 - g)])[-1] - np.concatenate([[0], np.cumsum(1 - g)])
    inner = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    k = max(inner, key=lambda i: edges[i + 1] - edges[i])
    return float((edges[k] + edges[k + 1]) / 2)


def kth_key(scored: DataFrame, k: int) -> tuple[float, int]:
    """The k-th highest (key, then lowest id), by narrowing a histogram; rows equal to it count as kept."""
    lo, hi = scored.agg(F.min("key"), F.max("key")).first()
    above, part = 0, scored.filter("key IS NOT NULL")
    while True:
        rows = part.count()
        if rows <= LAST_ROWS or lo == hi:
            last = sorted(((-r.key, r.id) for r in part.select("key", "id").orderBy(F.desc("key"), "id").limit(LAST_ROWS).collect()), key=lambda x: (x[0], x[1] is None, x[1]))
            spot = last[min(max(k - above, 1), len(last)) - 1]
            return -spot[0], spot[1]
        step = (hi - lo) / 1024
        slot = F.least(F.floor((F.col("key") - lo) / step), F.lit(1023))
        counts = {r.slot: (r.n, r.lo, r.hi) for r in part.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for s in sorted(counts, reverse=True):
            if above + counts[s][0] >= k:
                lo, hi = counts[s][1:]
                break
            above += counts[s][0]
        part = part.filter((F.col("key") >= lo) & (F.col("key") <= hi))


@dataclass
class Resampler:
    """What a fit leaves: the model and the last kept key."""

    model: Model
    key: float | None
    key_id: int | None
    seed: int

    def kept(self, id_col: str, text_col: str) -> Column:
        """A boolean column: whether the sample holds a row; the same as importance_resample says."""
        model, key, key_id, seed = self.model, self.key, self.key_id, self.seed

        @F.arrow_udf("boolean")
        def keep(ids: pa.Array, texts: pa.Array) -> pa.Array:
            out = []
            named = np.asarray(ids.fill_null(0))
            for chunk in chunks(texts):
                own = named[chunk.first : chunk.first + chunk.n_docs]
                weights, counts = model.weights(chunk)
                keys = weights + gumbel(own, seed)
                out.append(counts > 0 if key is None else (keys > key) | ((keys == key) & (own <= key_id)))
            return pa.array(np.concatenate(out) if out else np.zeros(0, dtype=bool))

        return keep(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def importance_resample(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int | None = None,
    raw: DataFrame | None = None,
    seed: int = SEED,
    max_labelled: int = MAX_LABELLED,
) -> tuple[DataFrame, Resampler]:
    """One row per input row: id, n_features, log_weight, key, kept; and what decides.

    `labels` has `id_col` and quality (1: target). At most `max_labelled` labelled rows, those of the
    lowest hashes, are used: half of the good ones make the target model, the others and the bad ones set
    the cutoff, so that it is not set on what the model has counted. The raw model counts every document of
    `raw`, which also has the labelled texts; without it, `df` is the raw text. Without `k`, as many rows
    are drawn as have a log weight over the cutoff that parts the labelled rows best.

    A text without tokens (null, empty, blank) has log weight and key null and is not kept. Rows with the
    same id and text share a key and a fate; a null id draws its noise as 0 does. Without labelled good
    rows all weights are 0; without good or without bad labels all rows with tokens are kept. Null labels
    are left out; of several labels of one id the highest counts, of several rows of a labelled id the lowest
    weight counts for the cutoff. Other columns are not returned.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "importance")
    docs = two_columns(df, id_col, text_col)
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
    named = named.groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_labelled)
    named = stash.keep(named.withColumn("fits", (F.col("quality") == 1) & (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(2)) == 0)), "labelled")
    source = docs if raw is None else two_columns(raw, id_col, text_col)
    model = fit(source, named.filter("fits").select("id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                weights, counts = model.weights(chunk)
                own = ids.slice(chunk.first, chunk.n_docs)
                keys = weights + gumbel(np.asarray(own.fill_null(0)), seed)
                none = counts == 0
                yield pa.RecordBatch.from_arrays([own, pa.array(counts), pa.array(weights, mask=none), pa.array(keys, mask=none)], names=["id", "n_features", "log_weight", "key"])

    columns = "id long, n_features long, log_weight double, key double"
    scored = stash.keep(docs.mapInArrow(trimmed(score), columns), "scored")
    total = scored.filter("key IS NOT NULL").count()
    if k is None:
        others = F.broadcast(named.filter("NOT fits").select("id", "quality"))  # max_labelled rows at most
        if raw is None:
            known = scored.join(others, "id")
        else:
            known = source.join(others.withColumnRenamed("id", "__id"), "__id", "left_semi").select("__id", "__text").mapInArrow(trimmed(score), columns).join(others, "id")
        # one row for each labelled id, of which there are max_labelled at most
        fitted = known.filter("key IS NOT NULL").groupBy("id").agg(F.min("log_weight").alias("log_weight"), F.first("quality").alias("quality")).collect()
        good = np.array([r.quality == 1 for r in fitted], dtype=bool)
        if good.any() and not good.all():
            cutoff = best_cutoff(np.array([r.log_weight for r in fitted]), good)
            k = scored.filter(F.col("log_weight") > cutoff).count()
    if k is None or not total:
        key, key_id = None, None
    elif k <= 0:
        key, key_id = float("inf"), 0
    else:
        key, key_id = kth_key(scored.select("key", F.coalesce("id", F.lit(0)).alias("id")), min(k, total))
    last = Resampler(model, key, key_id, seed)
    kept = F.col("key").isNotNull()
    if key is not None:
        kept = kept & ((F.col("key") > key) | ((F.col("key") == key) & (F.coalesce("id", F.lit(0)) <= key_id)))
    return scored.withColumn("kept", kept).withColumnRenamed("id", id_col), last
