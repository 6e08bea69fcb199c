"""Directly addressable codes for token ids: files in which any token is read without decoding others.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, a
bitmap telling which of them go on at level k + 1, and a rank directory: the number of set bits before
every 512th bit. The place of an id's next chunk is the rank of its bit, one directory entry and at most
64 bytes of bitmap away.

A shard is one such file with the ids of consecutive documents. Shards lie in Parquet containers, so that
every store that Spark reaches can hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendcurve.llm.common import bounded_batches, shuffle_partitions, two_columns
from spendcurve.llm.tokens import encoder

MAGIC = b"DACT\x01"
BLOCK = 512
#: Tokens after which a shard is closed; a longer document is a shard by itself.
SHARD_TOKENS = 2 << 20
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """The levels of some ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    parts, n_levels = [], 0
    while n_levels == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)])
        ones = _POPCOUNT[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if len(ones) else np.zeros(0, dtype="<u8")
        parts += [struct.pack("<QQ", len(rest), len(directory)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        rest = rest[more] >> np.uint32(8)
        n_levels += 1
    return struct.pack("<B", n_levels) + b"".join(parts)


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A shard's bytes: the documents' ids and ends, then the levels. A null document id is marked as such."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64) if ids else np.zeros(0, dtype=np.int64)
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    every = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    return MAGIC + struct.pack("<Q", len(ids)) + named.tobytes() + null.tobytes() + ends.astype("<i8").tobytes() + pack_ids(every)


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(MAGIC)
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        named, null, self.ends = take(n, "<i8"), take(n, "u1"), take(n, "<i8")
        self.doc_ids = [None if z else int(d) for d, z in zip(named, null, strict=True)]
        self.levels = []
        n_levels = data[at]
        at += 1
        for _ in range(n_levels):
            count, blocks = struct.unpack_from("<QQ", data, at)
            at += 16
            self.levels.append((take(count, "u1"), take(blocks * BLOCK // 8, "u1"), take(blocks, "<u8")))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The id at place i, by one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (low, bits, directory) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // BLOCK
            inside = bits[block * BLOCK // 8 : byte]
            i = int(directory[block]) + int(_POPCOUNT[inside].sum()) + int(_POPCOUNT[bits[byte] & ((1 << bit) - 1)])
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(0, dtype=np.uint32)
        for low, bits, _ in reversed(self.levels):
            more = np.unpackbits(bits, bitorder="little")[: len(low)].astype(bool)
            here = low.astype(np.uint32)
            here[more] |= out << np.uint32(8)
            out = here
        return out

    def document(self, k: int) -> np.ndarray:
        a = int(self.ends[k - 1]) if k else 0
        return np.array([self.token(i) for i in range(a, int(self.ends[k]))], dtype=np.uint32)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the rising bounds lie under a value, by halving; 0 for null."""
    if not bounds:
        return F.lit(0)
    # one literal, however many bounds there are
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def halve(under: Column, step: Column) -> Column:
        return F.when((under + step <= len(bounds)) & (F.get(listed, under + step - 1) < value), under + step).otherwise(under)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def write_tokens(
    df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every text, add `end_id`, and write shards in ascending id order under `path`.

    Null texts count as empty: they have the end id alone. Rows with a null id come first; rows with
    the same id are ordered by text. An empty table writes no shard. Other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = two_columns(df, id_col, text_col)
    parts = max(shuffle_partitions(spark), 1)
    # bounds from the ids alone: repartitionByRange would read every text once more to sample it
    bounds = docs.approxQuantile("__id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    ranged = docs.repartitionById(parts, range_of(F.col("__id"), sorted({int(b) for b in bounds}))).sortWithinPartitions("__id", "__text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = start = 0

        def shard() -> pa.RecordBatch:
            arrays = [[part], [start], [held], [len(ids)], [write_shard(doc_ids, ids)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)], names=["part", "start", "n_tokens", "n_docs", "shard"])

        for batch in batches:
            texts = coder.encode(batch.column(1))
            for doc, found in zip(batch.column(0).to_pylist(), texts, strict=True):
                one = np.concatenate([found, tail])
                if ids and held + len(one) > shard_tokens:
                    yield shard()
                    start, held, doc_ids, ids = start + held, 0, [], []
                doc_ids.append(doc)
                ids.append(one)
                held += len(one)
        if ids:
            yield shard()

    ranged.mapInArrow(write, "part int, start long, n_tokens long, n_docs long, shard binary").write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files under `path`: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    `start` counts the ids of all documents before it. Files of no shards give no rows.
    """
    bounded_batches(spark)
    shards = spark.read.schema("part int, start long, n_tokens long, n_docs long, shard binary").parquet(path)
    # a row for each partition that was written: as many as the writer had tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    schema = "part int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                shard = Shard(data.as_buffer().to_pybytes())
                ids, ends = shard.all().astype("<u4"), shard.ends.tolist()
                first = [0, *ends[:-1]]
                columns = [
                    pa.array([part.as_py()] * len(ends), pa.int32()),
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array([start.as_py() + a for a in first], pa.int64()),
                    pa.array([b - a for a, b in zip(first, ends, strict=True)], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(first, ends, strict=True)], pa.int64()),
                ]
                names = ["part", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([*first, len(ids)], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = shards.select("part", "start", "shard").mapInArrow(read, schema)
    out = docs.join(F.broadcast(offsets), "part")
    return out.select("doc_id", (F.col("part_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
