"""MinHash near-duplicates with tensored banding, and every candidate verified on full shingle sets.

Two small collections of half keys, each half key made of a few min-hashes, are combined pairwise: m + m
half keys give m * m table keys. Two sets meet in a table if they share a half key of either collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, bounded_batches, by_id, hot_keys, matched, salted, spread, trimmed, two_columns
from spendcurve.llm.components import connected_components
from spendcurve.llm.textops import U64, chunks, constants, mix, shingle_lists, word_hashes

#: Half keys in each collection and min-hashes in each half key: 64 tables of 4 min-hashes out of 32. Two
#: sets at similarity 0.85 meet with probability (1 - (1 - 0.85 ** 2) ** 8) ** 2 = 0.9999.
HALVES, ROWS = 8, 2
#: Sets whose table keys are made by one task, about: a task sorts 64 rows for each, however few files hold the sets.
SLICE = 8192
#: Members of a block when buckets that span several components are compared.
BLOCK = 4096
#: Sets that hold a rare shingle, at most. Any number gives the same links; a larger one counts more pairs by shingles and leaves less to the comparison in blocks.
RARE = 64
#: Half keys out of 2 * HALVES that a pair in such a bucket shares at least, from 0.85 on and below; a pair at 0.85 and one at 0.8 have fewer with a chance of about 1e-5 and 3e-5.
LEAST_SHARED, LEAST_SHARED_BELOW = 4, 3


def _shingle_sets(chunk_words: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.unique(x) for x in shingle_lists(chunk_words, first, n)]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, f1, f2, a, b): set size, an order-free fingerprint of the set, and the half keys of both collections."""
    count = 2 * HALVES * ROWS
    factors, shifts = constants(count, 11) | U64(1), constants(count, 12)
    salts = constants(2 * HALVES, 13)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets = _shingle_sets(*word_hashes(chunk), shingle)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                every = np.concatenate(sets)
                some = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[some]
                f1, f2 = np.zeros(len(sets), dtype=U64), np.zeros(len(sets), dtype=U64)
                halves = np.zeros((len(sets), 2 * HALVES), dtype=U64)
                if len(some):
                    f1[some] = np.add.reduceat(every, at)
                    f2[some] = np.add.reduceat(mix(every ^ U64(0x5DEECE66D)), at)
                    for k in range(2 * HALVES):
                        key = np.full(len(some), salts[k], dtype=U64)
                        for r in range(ROWS):
                            i = k * ROWS + r
                            key = mix(key + np.minimum.reduceat(every * factors[i] + shifts[i], at))
                        halves[some, k] = key
                lists = halves.view(np.int64)
                ends = pa.array(np.arange(0, HALVES * len(sets) + 1, HALVES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n_docs),
                        pa.array(sizes),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(lists[:, :HALVES]).ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(lists[:, HALVES:]).ravel())),
                    ],
                    names=["id", "n", "f1", "f2", "a", "b"],
                )

    return docs.mapInArrow(trimmed(sign), "id long, n long, f1 long, f2 long, a array<long>, b array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes): sorted distinct 64-bit shingle hashes as bytes."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets = _shingle_sets(*word_hashes(chunk), shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.n_docs), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "hashes"]
                )

    return docs.mapInArrow(trimmed(collect), "id long, hashes binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written pairs (a, b) that are similar on their full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            ok = [
                similar(np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64), percent)
                for x, y in zip(left, right, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    met = matched(matched(pairs, "a", "b", x), "b", "a", y, counted=pairs)
    return met.select("a", "b", "x", "y").mapInArrow(trimmed(check), "a long, b long")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id, n): the keys of all tables for every set, made in slices of about SLICE sets."""
    dealt = classes.repartition(max(1, -(-classes.count() // SLICE)), "f1", "f2")
    keyed = dealt.select("id", "n", F.posexplode("a").alias("i", "p"), "b").select("id", "n", "i", "p", F.posexplode("b").alias("j", "q"))
    return keyed.select(F.xxhash64("i", "p", "j", "q").alias("key"), "id", "n")


def _shingles(sets: DataFrame) -> DataFrame:
    """(id, h): a row for each shingle of a set."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = np.frombuffer(data.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), doc, dtype=np.int64)), pa.array(hashes)], names=["id", "h"])

    return sets.mapInArrow(trimmed(flat), "id long, h long")


def _matchable(sets: DataFrame) -> DataFrame:
    """(id, m): how many of a set's shingles occur in another of these sets. No intersection is larger."""
    every = _shingles(sets).groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    alone = every.filter("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = sets.select("id", (F.octet_length("hashes") / 8).cast("long").alias("n"))
    return sizes.join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"))


def _may(most: Column, percent: int) -> Column:
    """Whether sets of n1 and n2 shingles can be similar if no more than `most` are common."""
    return 100 * most >= percent * (F.col("n1") + F.col("n2") - most)


def _by_rare(sets: DataFrame, placed: DataFrame, percent: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share a rare shingle and may be similar; and (id, n, m), m counting a set's other, frequent shingles.

    Rare shingles occur in 2 to RARE of the sets, so that there are at most RARE pairs for each of their places.
    The rare shingles of a pair are counted in full, so that no intersection is larger than their number and the lesser m.
    Pairs without a rare shingle have no more common shingles than the lesser m.
    """
    flat = stash.keep(_shingles(sets), "flat")
    counts = stash.keep(flat.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "flat-counts")
    hot = stash.keep(hot_keys(counts, "h"), "flat-hot")
    found = salted(flat, hot, "h", "id").join(spread(counts.withColumnRenamed("n", "c"), hot, "h"), ["h", "__salt"]).select("id", "h", "c")
    found = stash.keep(found, "flat-found")
    frequent = found.groupBy("id").agg(F.count_if(F.col("c") > RARE).alias("m"))
    sizes = sets.select("id", (F.octet_length("hashes") / 8).cast("long").alias("n"))
    core = stash.keep(sizes.join(frequent, "id", "left").select("id", "n", F.coalesce("m", F.lit(0)).alias("m")), "core")
    places = found.filter(F.col("c") <= RARE).select("id", "h").join(core.join(placed, "id"), "id")
    left, right = (places.select("h", *[F.col(c).alias(f"{c}{k}") for c in ("id", "component", "n", "m")]) for k in (1, 2))
    met = left.join(right, "h").filter("id1 < id2 AND component1 <> component2").filter(_may(F.least("n1", "n2"), percent))
    both = met.groupBy("id1", "id2", "n1", "n2", "m1", "m2").agg(F.count("*").alias("c"))
    pairs = stash.keep(both.filter(_may(F.col("c") + F.least("m1", "m2"), percent)).select(F.col("id1").alias("a"), F.col("id2").alias("b")), "rare-pairs")
    stash.drop("flat", "flat-counts", "flat-hot", "flat-found")
    return pairs, core


def _across(residual: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in a bucket that may be similar, block by block: no task holds more than two blocks.

    `residual` has key, size, id, component, main, n, m, a and b; `main` is a component of the bucket, whose members meet
    those of the others only. With at most min(m1, m2) common shingles most pairs are out at once; of the rest only
    those that share enough half keys are returned. A pair is returned from one bucket alone, that of the first half keys
    of either collection that it shares.
    """
    dealt = residual.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ("id", "component", "main", "n", "m", "a", "b")
    left = dealt.filter("component <> main").withColumn("j", F.explode(others)).select("key", F.col("block").alias("i"), "j", *[F.col(c).alias(f"{c}1") for c in columns])
    right = dealt.withColumn("i", F.explode(others)).select("key", "i", F.col("block").alias("j"), *[F.col(c).alias(f"{c}2") for c in columns])
    same_a, same_b = (F.zip_with(f"{c}1", f"{c}2", lambda x, y: x == y) for c in ("a", "b"))
    shared = F.size(F.filter(same_a, lambda x: x)) + F.size(F.filter(same_b, lambda x: x))
    i, j = ((F.array_position(same, True) - 1).cast("int") for same in (same_a, same_b))
    first = F.when((i >= 0) & (j >= 0), F.xxhash64(i, F.get("a1", i), j, F.get("b1", j)))
    once = (F.col("component2") == F.col("main2")) | (F.col("id1") < F.col("id2"))
    met = left.join(right, ["key", "i", "j"]).filter((F.col("component1") != F.col("component2")) & once & _may(F.least("m1", "m2"), percent))
    return met.filter((first == F.col("key")) & (shared >= (LEAST_SHARED if percent >= 85 else LEAST_SHARED_BELOW))).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))


def _open(near: DataFrame, percent: int) -> DataFrame:
    """The rows of `near` that can have a partner of another component in their bucket, with its size and main component, that of most rows.

    A partner of x has at most x's m of common shingles, and so no more shingles than those allow; the bucket's
    least set tells whether there can be one.
    """
    counted = near.groupBy("key", "component").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    main = F.max(F.struct("k", "component"))["component"]
    per = counted.groupBy("key").agg(F.sum("k").alias("size"), main.alias("main"), F.min("least").alias("least"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    hot = hot_keys(per.select("key", F.col("size").alias("n")), "key")
    met = salted(near, hot, "key", "id").join(spread(per, hot, "key"), ["key", "__salt"]).drop("__salt")
    return met.filter(f"(100 + {percent}) * m >= {percent} * (n + least)").drop("least")


def _spanning(members: DataFrame, comps: DataFrame, hot: DataFrame, stash: Stash, name: str) -> DataFrame:
    """The members of buckets that span several components, with theirs and that of the bucket's lead."""
    placed = members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "id").alias("lead_component"))
    return stash.keep(placed.join(spread(spans.filter("lo <> hi").select("key", "lead_component"), hot, "key"), ["key", "__salt"]), name)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85) -> DataFrame:
    """One row per input row with an id: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z). Documents are linked if their sets of `shingle`-word shingles have
    100 * intersection >= percent * union; `component_id` is the smallest id reachable over links, and
    `kept` tells whether it is the document's own. With fewer words the whole sequence is the one shingle;
    a null, empty or blank text has no shingles and no links. Rows with the same id are one document to
    the links. Rows without an id are left out. Other columns are not returned. `percent` is 80 at least:
    the tables are laid out for that.

    Exact copies are gathered by fingerprint first. Every set meets the first of its buckets' leads, and then
    the other leads with which it is not yet linked; buckets that still span several components are
    compared in blocks, so that no link is lost.
    """
    if not 80 <= percent <= 100:
        raise ValueError(f"percent must be from 80 to 100, got {percent!r}")
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "minhash")
    docs = two_columns(df, id_col, text_col).filter("__id IS NOT NULL")
    rows = stash.keep(signatures(docs, shingle), "signatures")
    some = rows.filter("n > 0")
    classes = stash.keep(
        some.groupBy("n", "f1", "f2").agg(F.min_by(F.struct("id", "a", "b"), "id").alias("r")).select("n", "f1", "f2", "r.id", "r.a", "r.b"), "classes"
    )
    keyed = table_keys(classes)
    # the first id of a bucket, and its least and largest set, as an id may have several texts
    low, high = F.min(F.struct("id", "n")), F.min(F.struct("id", (-F.col("n")).alias("m")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), low.alias("low"), high.alias("high")).filter("size > 1")
    shared = stash.keep(shared.select("key", "size", F.col("low.id").alias("lead"), F.col("low.n").alias("low"), (-F.col("high.m")).alias("high")), "shared")
    hot = stash.keep(hot_keys(shared.select("key", F.col("size").alias("n")), "key"), "hot")
    fits = f"lead < id AND 100 * high >= {percent} * n AND 100 * n >= {percent} * low"
    members = salted(keyed, hot, "key", "id").join(spread(shared.drop("size"), hot, "key"), ["key", "__salt"])
    members = stash.keep(members.select("key", "__salt", "id", "lead", F.expr(fits).alias("fits")), "members")
    wanted = members.select(F.col("id").alias("__id")).distinct()
    sets = stash.keep(shingle_sets(docs.join(by_id(wanted), "__id", "left_semi"), shingle), "sets")
    # rows of one id with different texts are one document
    own = some.join(classes.select("n", "f1", "f2", F.col("id").alias("rep")), ["n", "f1", "f2"]).select("id", "n", "rep")
    own = stash.keep(own, "own")
    split = own.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    # first every set meets the least of the leads of its buckets, then those with which it is not yet linked
    pairs = stash.keep(members.filter("fits").groupBy("id").agg(F.min("lead").alias("a")).select("a", F.col("id").alias("b")), "pairs")
    edges = stash.keep(verify(pairs, sets, percent), "links").unionByName(split)
    left = _spanning(members, stash.keep(connected_components(edges, stash, "first"), "components"), hot, stash, "waiting")
    again = left.filter("fits AND component <> lead_component").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    again = stash.keep(again.join(pairs, ["a", "b"], "left_anti"), "more_leads")
    edges = edges.unionByName(stash.keep(verify(again, sets, percent), "lead_links"))
    pairs = pairs.unionByName(again)
    comps = stash.keep(connected_components(edges, stash, "second"), "lead_components")
    left = _spanning(left.drop("component", "lead_component"), comps, hot, stash, "residual")
    if not left.isEmpty():
        # a set that mostly holds shingles of its own is similar to none of the others; twice, as others are then gone
        open_sets = sets.join(left.select("id").distinct(), "id", "left_semi")
        for step in range(2):
            counts = stash.keep(_matchable(open_sets).filter(f"100 * m >= {percent} * n"), f"matchable-{step}")
            open_sets = sets.join(counts.select("id"), "id", "left_semi")
        placed = left.select("id", "component").distinct()
        rare, core = _by_rare(open_sets, placed, percent, stash)
        rare = stash.keep(rare.join(pairs, ["a", "b"], "left_anti"), "more_rare")
        edges = edges.unionByName(stash.keep(verify(rare, sets, percent), "rare_links"))
        comps = stash.keep(connected_components(edges, stash, "third"), "rare_components")
        pairs = pairs.unionByName(rare)
        # what is left shares frequent shingles only
        near = left.select("key", "id").join(core.filter(f"100 * m >= {percent} * n"), "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
        near = stash.keep(near, "near")
        for step in range(2):
            near = stash.keep(_open(near.select("key", "id", "n", "m", "component"), percent), f"open-{step}")
        more = _across(near.join(classes.select("id", "a", "b"), "id"), percent).distinct().join(pairs, ["a", "b"], "left_anti")
        more = stash.keep(more, "more_pairs")
        late = stash.keep(verify(more, sets, percent), "more_links")
        comps = stash.keep(connected_components(edges.unionByName(late), stash, "fourth"), "all_components")
    stash.drop("shared", "hot", "members", "pairs", "sets", "links", "waiting", "more_leads", "lead_links", "residual", "matchable-0", "matchable-1", "core", "rare-pairs", "more_rare", "rare_links", "rare_components", "near", "open-0", "open-1", "more_pairs", "more_links")
    found = own.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    none = rows.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    # an id with an empty and a non-empty row keeps the component of the latter
    out = found.unionByName(none)
    return out.withColumn("kept", F.col("id") == F.col("component_id")).withColumnRenamed("id", id_col)
