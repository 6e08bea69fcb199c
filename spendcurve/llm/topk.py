"""Exact top-k inner products over norm buckets.

Vectors are sorted by length into stripes, a stripe for each task, and these into buckets. Every query visits the
stripes that can hold a result of it and walks their buckets in falling length. The query's k-th best score so
far over the product of its length and the bucket's greatest is the cosine that a vector there must reach: over
one, the bucket is skipped; if it is high, vectors are cut by the range that their share in the query's
largest coordinate must lie in; else by their length alone. Products of what is left are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcurve.llm.common import Stash, bounded_batches, shuffle_partitions

#: Vectors of a bucket and of a stripe, and queries of a block, at most.
BUCKET, STRIPE, QUERIES = 4096, 65_536, 1024
#: Local cosine from which the coordinate is used rather than the length.
COORDINATE_FROM = 0.6
#: Room for rounding in bounds, which only ever lets more vectors through.
SLACK = 1e-7


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """q @ c.T of whole numbers, exact: in doubles while every sum is under 2 ** 53, else in 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if top < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def survivors(q: np.ndarray, q_norm: float, least: float, norms: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Places in a bucket (norms falling; shares: vectors over their lengths) that can reach score `least`."""
    if least <= 0 or q_norm == 0:
        return np.arange(len(norms))
    cosine = least / (q_norm * norms[0]) if norms[0] > 0 else np.inf
    if cosine > 1 + SLACK:
        return np.zeros(0, dtype=np.int64)
    long = int(np.searchsorted(-norms, -least / q_norm * (1 - SLACK), side="right"))
    if cosine < COORDINATE_FROM:
        return np.arange(long)
    f = int(np.argmax(np.abs(q)))
    own, cosine = q[f] / q_norm, min(cosine, 1.0)
    # the angle to the coordinate's axis may differ from the query's by no more than the angle of `cosine`
    half = np.sqrt((1 - cosine**2) * max(0.0, 1 - own**2))
    low = -1.0 if own < -cosine else own * cosine - half
    high = 1.0 if own > cosine else own * cosine + half
    column = shares[:long, f]
    return np.flatnonzero((column >= low - SLACK) & (column <= high + SLACK))


class Bucket:
    """Vectors in falling length, with their ids and lengths."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, norms: np.ndarray):
        self.rows, self.ids, self.norms = rows, ids, norms
        self.shares = rows / np.where(norms > 0, norms, 1)[:, None]


class Search:
    """The k best rows of each of some queries so far; ties to the smaller id. `leasts`: what a score must reach to count."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, leasts: np.ndarray, k: int):
        self.queries, self.ids, self.leasts, self.k = queries, ids, leasts.astype(np.float64), k
        self.norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        # found so far: place of the query, id, score
        self.found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def visit(self, bucket: Bucket) -> None:
        top = bucket.norms[0] if len(bucket.norms) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            cosines = np.where((self.leasts > 0) & (self.norms > 0), self.leasts / (self.norms * top), 0.0)
        cosines = np.where(np.isnan(cosines), np.inf, cosines)
        hits = [self.found]
        for i in np.flatnonzero((cosines >= COORDINATE_FROM) & (cosines <= 1 + SLACK)).tolist():
            some = survivors(self.queries[i].astype(np.float64), self.norms[i], self.leasts[i], bucket.norms, bucket.shares)
            if len(some):
                scores = products(self.queries[i : i + 1], bucket.rows[some])[0]
                good = (scores >= self.leasts[i]) & (bucket.ids[some] != self.ids[i])
                hits.append((np.full(int(good.sum()), i), bucket.ids[some][good], scores[good]))
        wide = np.flatnonzero(cosines < COORDINATE_FROM)
        if len(wide):
            # the longest vectors that any of these queries needs
            with np.errstate(divide="ignore"):
                need = np.where((self.leasts[wide] > 0) & (self.norms[wide] > 0), self.leasts[wide] / self.norms[wide], 0.0).min() * (1 - SLACK)
            long = int(np.searchsorted(-bucket.norms, -need, side="right"))
            scores = products(self.queries[wide], bucket.rows[:long])
            good = (scores >= self.leasts[wide, None]) & (bucket.ids[None, :long] != self.ids[wide, None])
            at, row = np.nonzero(good)
            hits.append((wide[at], bucket.ids[row], scores[at, row]))
        if len(hits) > 1:
            self._merge(hits)

    def _merge(self, hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        query, ids, scores = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        kept = rank < self.k
        last = rank == self.k - 1
        self.leasts[query[last]] = np.maximum(self.leasts[query[last]], scores[last])
        self.found = query[kept], ids[kept], scores[kept]


def _quantized(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, norm, width, vec): whole-numbered vectors as int64 bytes; what takes no part is left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = vector.values if vector.is_valid else None
                if doc is None or values is None or values.null_count:
                    continue
                x = np.asarray(values, dtype=np.float64)
                if np.all(np.isfinite(x)):
                    v = np.floor(scale * x)
                    out.append((doc, float(np.sqrt((v * v).sum())), len(v), v.astype("<i8").tobytes()))
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["id", "norm", "width", "vec"])

    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{vector_col}`").cast("array<double>").alias("__v"))
    return picked.mapInArrow(work, "id long, norm double, width int, vec binary")


def _whole(matrix: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers in the smallest type that holds it."""
    top = int(np.abs(matrix).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, matrix.astype(kind).tobytes()


_BLOCK = pa.schema([("stripe", pa.int32()), ("top_norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("norms", pa.binary()), ("kind", pa.string()), ("matrix", pa.binary())])
_BLOCK_SQL = "stripe int, top_norm double, n int, ids binary, norms binary, kind string, matrix binary"


def _blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Pack the rows of each partition, in their order, into blocks; `stripe` is the partition's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, float, bytes]] = []
        stripe = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            matrix = np.zeros((len(held), width), dtype="<i8")
            for k, (_, _, data) in enumerate(held):
                v = np.frombuffer(data, dtype="<i8")
                matrix[k, : len(v)] = v
            ids, norms = np.array([h[0] for h in held], dtype="<i8"), np.array([h[1] for h in held], dtype="<f8")
            kind, data = _whole(matrix)
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, (stripe, float(norms.max()), len(held), ids.tobytes(), norms.tobytes(), kind, data), strict=True))], schema=_BLOCK)

        for batch in batches:
            for one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(one)
                if len(held) == size:
                    yield block()
                    held = []
        if held:
            yield block()

    return rows.select("id", "norm", "vec").mapInArrow(work, _BLOCK_SQL)


def _unpacked(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's vectors, ids and lengths."""
    ids = np.frombuffer(row["ids"], dtype="<i8")
    return np.frombuffer(row["matrix"], dtype=row["kind"]).reshape(len(ids), width).astype(np.int64), ids, np.frombuffer(row["norms"], dtype="<f8")


def exact_top_k(df: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows with the highest inner products of floor(scale * x).

    `queries` has the same two columns; without it every row is a query. A row with the query's id is never
    its result. Ties go to the smaller id; with fewer rows all are returned. Vectors that are null, or hold
    null or non-finite components, and rows without an id take no part; shorter vectors count as filled
    up with zeros. Of several query rows with one id the first by its bytes is asked; repeated rows stay
    candidates each. Scores must fit 64 bits. Empty tables give an empty result; other columns are not read.

    Rows are shuffled once, to stripes; each block of queries goes to the stripes that can hold a result. There
    are as many stripes as shuffle partitions, and more only where a stripe would have over STRIPE rows.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "topk")
    rows = stash.keep(_quantized(df, id_col, vector_col, scale), "rows")
    asked = _quantized(queries if queries is not None else df, id_col, vector_col, scale)
    asked = stash.keep(asked.groupBy("id").agg(F.min_by(F.struct("norm", "width", "vec"), "vec").alias("r")).select("id", "r.norm", "r.width", "r.vec"), "queries")
    schema = "query_id long, rank int, vec_id long, score long"
    n, width = rows.agg(F.count("*"), F.max("width")).first()
    n_asked, asked_width = asked.agg(F.count("*"), F.max("width")).first()
    if not n or not n_asked:
        return spark.createDataFrame([], schema)
    width = max(width, asked_width)
    # equal lengths are dealt on by id, so no length is too frequent for a stripe
    n_stripes = max(-(-n // STRIPE), min(shuffle_partitions(spark), -(-n // 256)))
    ranged = rows.repartitionByRange(n_stripes, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    buckets = stash.keep(_blocks(ranged, BUCKET, width), "buckets")
    n_blocks = max(1, -(-n_asked // QUERIES))
    blocks = _blocks(asked.repartition(n_blocks, "id").sortWithinPartitions(F.desc("norm")), QUERIES, width)
    blocks = stash.keep(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    parts = ["ids", "norms", "kind", "matrix"]
    # the longest bucket, of at most BUCKET vectors, gives every query a first bound
    longest = Bucket(*_unpacked(buckets.orderBy(F.desc("top_norm"), "stripe").first().asDict(), width))
    # two numbers for each stripe
    tops = sorted((r.stripe, r.top) for r in buckets.groupBy("stripe").agg(F.max("top_norm").alias("top")).collect())
    numbers, top_norms = (np.array(x) for x in zip(*tops, strict=True))

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix, ids, norms = _unpacked(row, width)
                found = Search(matrix, ids, np.full(len(ids), -np.inf), k)
                found.visit(longest)
                reach = np.where(found.leasts > 0, found.leasts / np.where(norms > 0, norms, 1), 0.0).min()
                near = numbers[top_norms * (1 + SLACK) >= reach]
                yield pa.RecordBatch.from_pydict(
                    {"block": [row["block"]], "leasts": [found.leasts.astype("<f8").tobytes()], "stripes": [near.tolist()]},
                    schema=pa.schema([("block", pa.int64()), ("leasts", pa.binary()), ("stripes", pa.list_(pa.int32()))]),
                )

    bounds = stash.keep(blocks.select("block", *parts).mapInArrow(first_bounds, "block long, leasts binary, stripes array<int>"), "bounds")
    # numbers first: a block's vectors go where its weakest query can find something
    visits = bounds.select("block", "leasts", F.explode("stripes").alias("stripe"))
    sent = blocks.drop("stripe").join(visits, "block").select("stripe", F.lit(1).alias("turn"), "top_norm", "leasts", *parts)
    held = buckets.select("stripe", F.lit(0).alias("turn"), "top_norm", F.lit(None).cast("binary").alias("leasts"), *parts)
    met = held.unionByName(sent).repartitionById(int(numbers.max()) + 1, "stripe").sortWithinPartitions("stripe", "turn", F.desc("top_norm"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe's buckets come first and are held; then its blocks of queries one by one."""
        stripe, own = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["stripe"] != stripe:
                    stripe, own = row["stripe"], []
                if row["turn"] == 0:
                    own.append(Bucket(*_unpacked(row, width)))
                    continue
                matrix, ids, _ = _unpacked(row, width)
                found = Search(matrix, ids, np.frombuffer(row["leasts"], dtype="<f8"), k)
                for bucket in own:
                    found.visit(bucket)
                query, vec, score = found.found
                if len(query):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
