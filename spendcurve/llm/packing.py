"""Best-fit packing by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover injects whole well-filled bins of one parent into the other,
removes the bins that now hold duplicates, and best-fits the documents that this displaced; a bin that one
or two more of them would fill to the last token gets these at once. Items are dealt into shards; every shard
is evolved by several islands, each a task of its own, and between rounds the best solutions move to the
next island of the shard. What lies in a shard's worst bins, and in some of its bins of many small
documents, is then gathered and packed again with that of other shards, until one shard is left.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, bounded_batches, trimmed, two_columns
from spendcurve.llm.tokens import encoder

SHARD_ITEMS = 4096
#: Shards whose items are sorted and dealt in one task.
GROUP = 64
ISLANDS = 2
ROUNDS = 2
#: Generations at most, and those without a better solution after which an island stops.
GENERATIONS, PATIENCE = 24, 6
POPULATION = 6
#: The worst bins with at most this share of a shard's items, and of the full ones those of the most, are packed again with those of other shards.
LEFT_OVER = 1 / 8

Bins = list[list[int]]


def best_fit(order: list[int], lengths: list[int], capacity: int, bins: Bins | None = None, room: list[int] | None = None) -> tuple[Bins, list[int]]:
    """Put items, in this order, each where it leaves the least room. Bins of equal room are held in stacks, found by a bit mask."""
    bins, room = bins if bins is not None else [], room if room is not None else []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, r in enumerate(room):
        if r > 0:
            stacks[r].append(k)
            mask |= 1 << r
    for i in order:
        size = lengths[i]
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
            bins[k].append(i)
            r -= size
            room[k] = r
        else:
            k, r = len(bins), capacity - size
            bins.append([i])
            room.append(r)
        if r > 0:
            if not stacks[r]:
                mask |= 1 << r
            stacks[r].append(k)
    return bins, room


def exact_fit(order: list[int], lengths: list[int], capacity: int, bins: Bins | None = None, room: list[int] | None = None) -> tuple[Bins, list[int]]:
    """Best fit, but a bin that one or two of the later items would fill to the last token gets them at once.

    `order` must fall by length or nearly so. Bit masks tell which lengths still wait, from either end: a
    pair of lengths with a given sum is a bit that both masks share.
    """
    bins, room = bins if bins is not None else [], room if room is not None else []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = back = 0
    for i in reversed(order):
        size = lengths[i]
        if not waiting[size]:
            there |= 1 << size
            back |= 1 << (capacity - size)
        waiting[size].append(i)

    def take(size: int) -> int:
        nonlocal there, back
        i = waiting[size].pop()
        if not waiting[size]:
            there ^= 1 << size
            back ^= 1 << (capacity - size)
        placed.add(i)
        return i

    placed: set[int] = set()
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for k, r in enumerate(room):
        if r > 0:
            stacks[r].append(k)
            mask |= 1 << r
    for first in order:
        if first in placed:
            continue
        size = lengths[first]
        i = take(size)
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = stacks[r].pop()
            if not stacks[r]:
                mask ^= 1 << r
            bins[k].append(i)
            r -= size
        else:
            k, r = len(bins), capacity - size
            bins.append([i])
            room.append(r)
        if r and there >> r & 1:
            bins[k].append(take(r))
            r = 0
        elif r > 1:
            pairs = there & (back >> (capacity - r)) & ((1 << (r // 2 + 1)) - 1)
            while pairs:
                size = pairs.bit_length() - 1
                if 2 * size != r or len(waiting[size]) > 1:
                    bins[k] += [take(r - size), take(size)]
                    r = 0
                    break
                pairs ^= 1 << size
        room[k] = r
        if r > 0:
            if not stacks[r]:
                mask |= 1 << r
            stacks[r].append(k)
    return bins, room


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Few bins first, then unevenly filled ones: higher is better."""
    full = 1.0 - np.asarray(room, dtype=float) / capacity
    return -len(room), float((full * full).sum())


def crossover(a: tuple[Bins, list[int]], b: tuple[Bins, list[int]], lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Inject a share of b's best-filled bins into a, remove a's bins with duplicates, best-fit what they alone held."""
    ranked = sorted(range(len(b[0])), key=lambda k: (b[1][k], rng.random()))
    chosen = [k for k in ranked[: max(1, (2 * len(ranked)) // 3)] if rng.random() < 0.5]
    bins, room = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen]
    inside = {i for one in bins for i in one}
    displaced = []
    for one, r in zip(*a, strict=True):
        if inside.isdisjoint(one):
            bins.append(list(one))
            room.append(r)
        else:
            displaced += [i for i in one if i not in inside]
    displaced.sort(key=lambda i: -lengths[i])
    return rng.choice((best_fit, exact_fit))(displaced, lengths, capacity, bins, room)


def mutate(a: tuple[Bins, list[int]], lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """Empty all bins that waste the most and as many others again, then fit their items anew."""
    n = len(a[0])
    ranked = sorted(range(n), key=lambda k: -a[1][k])
    worst = set(ranked[: max(2, n // 50)])
    worst |= {rng.randrange(n) for _ in range(2 * len(worst))}
    keep = [k for k in range(n) if k not in worst]
    free = sorted((i for k in worst for i in a[0][k]), key=lambda i: -lengths[i])
    return rng.choice((best_fit, exact_fit))(free, lengths, capacity, [list(a[0][k]) for k in keep], [a[1][k] for k in keep])


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[Bins], generations: int = GENERATIONS, population: int = POPULATION) -> list[Bins]:
    """The two best solutions of an island, from scratch or from elites.

    Parents are chosen by tournament; the best solution stays. An island ends when all bins but one are
    full, which nothing can better, when PATIENCE generations have brought nothing better, or after `generations`.
    """
    rng = random.Random(seed)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    score = lambda s: fitness(s[1], capacity)
    pool = [(bins, [capacity - sum(lengths[i] for i in one) for one in bins]) for bins in elites]
    if not pool:
        pool = [fit(down, lengths, capacity) for fit in (best_fit, exact_fit)]
    pool.sort(key=score, reverse=True)
    stale = 0
    for _ in range(generations):
        if sum(r > 0 for r in pool[0][1]) <= 1 or stale >= PATIENCE:
            break
        while len(pool) < population:
            noisy = sorted(down, key=lambda i: -lengths[i] * rng.uniform(0.9, 1.0))
            pool.append(best_fit(noisy, lengths, capacity))
        pool.sort(key=score, reverse=True)
        best = score(pool[0])
        # the lower of two drawn places is the fitter one
        a, b = (pool[min(rng.randrange(population), rng.randrange(population))] for _ in range(2))
        pool = pool[: population - 2] + [crossover(a, b, lengths, capacity, rng), mutate(pool[0], lengths, capacity, rng)]
        pool.sort(key=score, reverse=True)
        stale = 0 if score(pool[0]) > best else stale + 1
    return [bins for bins, _ in pool[:2]]


def _to_bytes(bins: Bins, n: int) -> bytes:
    of = np.zeros(n, dtype="<u4")
    for k, one in enumerate(bins):
        of[one] = k
    return of.tobytes()


def _to_bins(data: bytes) -> Bins:
    of = np.frombuffer(data, dtype="<u4")
    bins: Bins = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return bins


def _evolve_shards(shards: DataFrame, capacity: int, n_shards: int) -> DataFrame:
    """(shard, lengths) -> (shard, solution): the best of all islands after the last round."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = evolve(row["lengths"], capacity, row["shard"] * 1009 + row["island"] * 31 + row["round"], [_to_bins(e) for e in row["elites"]])
                best = [_to_bytes(bins, len(row["lengths"])) for bins in found]
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "n_bins": len(found[0]), "elites": best, "lengths": row["lengths"]}],
                    schema=pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("n_bins", pa.int32()), ("elites", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))]),
                )

    none = F.array().cast("array<binary>")
    state = shards.select("shard", "lengths", F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"), none.alias("elites"))
    for step in range(ROUNDS):
        ready = state.withColumn("round", F.lit(step)).repartition(min(n_shards * ISLANDS, 4096), F.col("shard"), F.col("island"))
        evolved = ready.select("shard", "island", "round", "lengths", "elites").mapInArrow(trimmed(work), "shard long, island int, n_bins int, elites array<binary>, lengths array<int>")
        gathered = evolved.groupBy("shard").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "n_bins", "elites"))).alias("all"))
        # migration: an island goes on with its own best two and the best of the island before it
        state = gathered.select("shard", "lengths", F.posexplode("all").alias("at", "own"), "all").select(
            "shard",
            "lengths",
            F.col("own.island").alias("island"),
            F.concat("own.elites", F.slice(F.element_at("all", (F.col("at") + F.lit(ISLANDS - 1)) % F.lit(ISLANDS) + 1).getField("elites"), 1, 1)).alias("elites"),
        )
    best = F.array_min(F.transform("all", lambda x: F.struct(x.getField("n_bins").alias("n"), x.getField("island").alias("i"), x.getField("elites").getItem(0).alias("s"))))
    return gathered.select("shard", best.getField("s").alias("solution"))


def _deal(items: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(shard, lengths, keys, parts): items dealt by falling length, so that shards are alike.

    Items go to groups of some GROUP shards by hash; a group is sorted and dealt to its shards to and fro.
    """
    groups = -(-n_shards // GROUP)
    per_group = -(-n_shards // groups)

    def deal(group: pa.Table) -> pa.Table:
        number, key, part, length = (group.column(k).to_numpy() for k in range(4))
        order = np.lexsort((part, key, -length))
        turn, place = np.divmod(np.arange(len(order)), per_group)
        shard = np.where(turn % 2, per_group - 1 - place, place)
        order = order[np.argsort(shard, kind="stable")]
        sizes = np.bincount(shard, minlength=per_group)
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(column[order])) for column in (length, key, part)]
        out = pa.table([pa.array(number[0] * per_group + np.arange(per_group)), *lists], names=["shard", "lengths", "keys", "parts"])
        return out.filter(pa.array(sizes > 0))

    named = items.select(F.pmod(F.xxhash64("key", "part", F.lit(seed)), F.lit(groups)).cast("long").alias("group"), "key", "part", "length")
    return named.groupBy("group").applyInArrow(deal, "shard long, lengths array<int>, keys array<long>, parts array<int>")


def pack(items: DataFrame, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Add `sequence_id` and `offset` to items (key long, part int, length int): bins of at most `capacity`.

    Items must have 1 <= length <= capacity; their (key, part) must differ. An empty table gives an empty
    result. Equal lengths are placed in key order. Every sequence is filled without gaps from 0.
    """
    spark = items.sparkSession
    bounded_batches(spark, rows=16)
    stash = Stash(spark, "packing")
    level, done = 0, []
    pool = items.select("key", "part", "length")
    while True:
        n = pool.count()
        n_shards = max(1, -(-n // shard_items))
        shards = stash.keep(_deal(pool, n_shards, level), f"shards{level}")
        solved = _evolve_shards(shards.select("shard", "lengths"), capacity, n_shards)
        last = n_shards == 1

        def place(batches: Iterator[pa.RecordBatch], level: int = level, last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    lengths, bins = row["lengths"], _to_bins(row["solution"])
                    filled = [sum(lengths[i] for i in one) for one in bins]
                    open_bins: set[int] = set()
                    if not last:
                        left = 0
                        # after the bins with room those of many documents, without which the others could not be filled
                        for k in sorted(range(len(bins)), key=lambda k: (filled[k], -len(bins[k]))):
                            if left + len(bins[k]) > LEFT_OVER * len(lengths):
                                break
                            left += len(bins[k])
                            open_bins.add(k)
                    out = []
                    for k, one in enumerate(bins):
                        at = 0
                        for i in sorted(one):
                            out.append((row["keys"][i], row["parts"][i], lengths[i], None if k in open_bins else (level << 56) + (row["shard"] << 24) + k, at))
                            at += lengths[i]
                    columns = list(zip(*out, strict=True)) or [[]] * 5
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "part", "length", "sequence_id", "offset"])

        placed = stash.keep(shards.join(solved, "shard").mapInArrow(trimmed(place), "key long, part int, length int, sequence_id long, offset long"), f"placed{level}")
        done.append(placed.filter("sequence_id IS NOT NULL"))
        stash.drop(f"shards{level}")
        if last:
            break
        pool = placed.filter("sequence_id IS NULL").select("key", "part", "length")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pieces(df: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each text's ids and the end id, cut into pieces of `capacity` from the end, so that only the first may be shorter; each with a key of its own."""
    bounded_batches(df.sparkSession)
    schema = "key long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = encoder(vocabulary), struct.pack("<I", end_id)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1)), strict=True):
                ids = ids.tobytes() + tail
                total = len(ids) // 4
                edges = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    one = ids[4 * a : 4 * b]
                    rows.append((key, doc, k, a, b - a, zlib.crc32(one), one)[: 6 + with_ids])
                    key += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 + with_ids]
            names = ["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return two_columns(df, id_col, text_col).mapInArrow(trimmed(cut, holds=True), schema)


def pack_documents(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = True
) -> DataFrame:
    """Encode all texts and pack their pieces into sequences of at most `capacity` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids
    (little-endian uint32). A null or empty text is its end id alone. A piece that fills a sequence has it
    to itself. Repeated rows are packed as often as they come, told apart by a number of their own; a
    null id stays null. An empty table gives an empty result. Other columns are not returned.
    """
    spark = df.sparkSession
    stash = Stash(spark, "pieces")
    cut = stash.keep(pieces(df, vocabulary, id_col, text_col, capacity, end_id, with_ids), "cut")
    full = F.col("length") == capacity
    short = pack(cut.filter(~full).select("key", F.lit(0).alias("part"), F.col("length").cast("int").alias("length")), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    # full pieces number their sequences from the key, below zero: no clash with the packed ones
    alone = cut.filter(full).withColumn("sequence_id", -F.col("key") - 1).withColumn("offset", F.lit(0).cast("long"))
    packed = cut.filter(~full).join(short.select("key", "sequence_id", "offset"), "key")
    return alone.select(*names).unionByName(packed.select(*names)).withColumnRenamed("doc_id", id_col)
