"""LM scoring by a hierarchical Pitman-Yor model whose Chinese-restaurant seating is sampled by Gibbs.

Every word sits in the restaurant of the word before it; the tables of all restaurants send their customers
to one parent restaurant of single words, over a uniform base. A chain of sweeps takes every customer of
every restaurant away and seats them again given the others; after BURN_IN sweeps each further one is a
sample, and probabilities are averaged over samples.

Tokens are dealt to buckets by word, so a bucket holds all that the parent has of a word, and its seating; words
too frequent for that are dealt on by context, and their few sums meet on the driver. Within a sweep a
bucket sees its own seating as it changes, and of other buckets what the last sweep left: the tables of a
restaurant, which are summed by context between sweeps in a shuffle of their own, and two totals of the parent.
A type that occurs once always has one table: only the others take part in sweeps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, bounded_batches, setting, two_columns
from spendcurve.llm.seating import Seating
from spendcurve.llm.textops import U64, chunks, constants, mix, word_hashes

#: Bits of a context's hash: two of a billion contexts share one with a chance of 2 ** -40.
CONTEXT_BITS = 40
#: Tokens of a bucket, about; the number of buckets grows with the corpus. Contexts are summed in a quarter as many parts.
BUCKET_TOKENS = 1_000_000
BURN_IN, SAMPLES = 2, 3
#: Share of the tokens from which a first pass counts words, and the least one that a second pass counts: 2 / LEAST_SHARE words are dealt on at most, at any size.
SHARE, LEAST_SHARE = 1e-4, 1e-5
STRENGTH, ROOT_STRENGTH = 1.0, 1.0
#: Documents of a chunk at most: their places fit 15 bits. Bytes of a batch.
ROWS, BATCH = 10_000, 8 << 20
END, START = (int(x) for x in constants(2, 61))
_CODEC = pa.Codec("zstd", compression_level=1)
_MASK = U64((1 << CONTEXT_BITS) - 1)
_SCHEMA = "bucket long, kind string, part long, data binary"


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each with its type and length."""
    raw = b"".join(f"{a.dtype.str}:{len(a)};".encode() for a in arrays) + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unzip(data: bytes) -> list[np.ndarray]:
    raw = _CODEC.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
    head, _, _ = raw.partition(b"\n")
    at, out = len(head) + 1, []
    for part in head.decode().split(";")[:-1]:
        kind, n = part.split(":")
        out.append(np.frombuffer(raw, dtype=kind, count=int(n), offset=at))
        at += out[-1].nbytes
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents: word hashes with an end for each, the context of each, and tokens per document."""
    words, contexts, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
    for chunk in chunks(batch.column(1)):
        hashes, first = word_hashes(chunk)
        n = np.diff(first)
        # every document's words, then its end
        total = len(hashes) + chunk.n_docs
        ends = np.cumsum(n + 1) - 1
        own = np.full(total, END, dtype=U64)
        inner = np.ones(total, dtype=bool)
        inner[ends] = False
        own[inner] = hashes
        before = np.empty(total, dtype=U64)
        before[1:] = own[:-1]
        before[ends - n] = START
        words.append(own)
        contexts.append(mix(before) & _MASK)
        counts.append(n + 1)
    return np.concatenate(words), np.concatenate(contexts), np.concatenate(counts)


def _runs_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the first of equal neighbours are."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def _low_high(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (contexts & U64(0xFFFFFFFF)).astype("<u4"), (contexts >> U64(32)).astype(np.uint8)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | (high.astype(U64) << U64(32))


def frequent_words(docs: DataFrame, share: float, stash: Stash) -> tuple[int, dict[int, int]]:
    """All tokens, and the words that may have `share` of them: who has it in all has it in some batch. At most 2 / share are returned."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, _, _ = _tokens(batch)
            if not len(words):
                continue
            words = np.sort(words)
            starts = _runs_of(words)
            n = np.diff(np.append(starts, len(words)))
            many = n >= max(2, share * len(words))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[starts][many].view(np.int64), 0)), pa.array(np.append(n[many], len(words))), pa.array(np.append(np.zeros(many.sum(), bool), True))], names=["word", "n", "all"])

    rows = stash.keep(docs.mapInArrow(work, "word long, n long, all boolean").groupBy("all", "word").agg(F.sum("n").alias("n")), "frequent")
    total = rows.filter("all").agg(F.sum("n")).first()[0] or 0
    found = rows.filter(~F.col("all") & (F.col("n") >= share * total / 2)).collect()
    return int(total), {int(np.int64(r.word).view(U64)): int(r.n) for r in found}


def deal(docs: DataFrame, n_buckets: int, splits: dict[int, int]) -> DataFrame:
    """Rows of each chunk's tokens by bucket (kind tokens), and of its documents, once (kind docs); `part` is the chunk."""
    key_shift = U64(64 - n_buckets.bit_length())
    word_shift = U64(n_buckets.bit_length() + 14)
    hot = np.array(sorted(splits), dtype=U64)
    pieces = np.array([splits[int(h)] for h in hot], dtype=U64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for seq, batch in enumerate(_slices(batches)):
            words, contexts, counts = _tokens(batch)
            if not len(words):
                continue
            chunk = (task << 24) + seq
            ids = batch.column(0).to_pylist()
            held = np.array([held_out(i) for i in ids], dtype=bool)
            doc = np.repeat((np.arange(len(ids)) * 2 + held).astype(np.uint16), counts)
            bucket = ((words >> U64(32)) % U64(n_buckets)).astype(np.uint32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                is_hot = hot[at] == words
                bucket[is_hot] = (bucket[is_hot] + mix(contexts[is_hot]) % pieces[at[is_hot]]) % U64(n_buckets)
                del at, is_hot
            # by bucket, then by the first bits of word and context, in which equal ones mostly lie side by side and as in the bucket; what does not is merged there
            order = np.argsort((bucket.astype(U64) << key_shift) | ((words >> word_shift) << U64(14)) | (contexts >> U64(CONTEXT_BITS - 14)))
            bucket, words, contexts, doc = bucket[order], words[order], contexts[order], doc[order]
            starts = _runs_of(bucket, words, contexts)
            runs = np.diff(np.append(starts, len(order))).astype("<u4")
            bucket, words, contexts = bucket[starts], words[starts], contexts[starts]
            starts = np.append(starts, len(order))
            edges = np.append(_runs_of(bucket), len(bucket))
            named = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            rows = [(int(chunk % n_buckets), "docs", chunk, _zip(named, np.array([i is None for i in ids]), held, counts))]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = words[a:b]
                at = _runs_of(own)
                many = np.diff(np.append(at, len(own))).astype("<u4")
                rows.append((int(bucket[a]), "tokens", chunk, _zip(own[at], many, *_low_high(contexts[a:b]), runs[a:b], doc[starts[a] : starts[b]])))
            yield _rows(rows)

    return docs.mapInArrow(work, _SCHEMA)


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple[int, str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=["bucket", "kind", "part", "data"])


@dataclass
class Group:
    """The rows of a bucket, or of a part of the contexts."""

    rows: list[tuple[int, str, int, bytes]]

    @staticmethod
    def of(table: pa.Table) -> Group:
        return Group(list(zip(*(table.column(k).to_pylist() for k in ("bucket", "kind", "part", "data")), strict=True)))

    def each(self, kind: str) -> list[tuple[int, int, list[np.ndarray]]]:
        """(bucket, part, arrays) of a kind, in their order."""
        return sorted(((b, p, _unzip(d)) for b, k, p, d in self.rows if k == kind), key=lambda r: r[:2])

    def one(self, kind: str) -> list[np.ndarray] | None:
        found = self.each(kind)
        return found[0][2] if found else None


@dataclass
class Types:
    """A bucket's (word, context) pairs sorted by word, with training counts; which words are split over buckets; and its contexts.

    Contexts are numbered part by part, as replies come; `edges` tells where the parts start.
    """

    words: np.ndarray
    split: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray

    @staticmethod
    def read(arrays: list[np.ndarray]) -> Types:
        words, split, word, low, high, count = arrays
        return Types(words, split.astype(bool), word.astype(np.int64), _whole(low, high), count.astype(np.int64))

    def pack(self) -> bytes:
        return _zip(self.words, self.split, self.word.astype("<i4"), *_low_high(self.context), self.count.astype("<u4"))

    def contexts(self, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The different contexts in their order, and each type's number."""
        different, number = np.unique(self.context, return_inverse=True)
        order = np.argsort(different % U64(n_parts), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        return different[order], place[number]


def _by_part(bucket: int, kind: str, contexts: np.ndarray, n_parts: int, *values: np.ndarray) -> list[tuple[int, str, int, bytes]]:
    """Rows of values by context for each part; contexts are in part order."""
    parts = (contexts % U64(n_parts)).astype(np.int64)
    edges = np.append(_runs_of(parts), len(parts))
    return [
        (bucket, kind, int(parts[a]), _zip(*_low_high(contexts[a:b]), *(v[a:b].astype("<u4") for v in values)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
    ]


def sums_by_context(rows: DataFrame, given: int = 0) -> DataFrame:
    """For each row `asks` (contexts and values) a row `reply` with the sums over all buckets; of the so many values in rows `gives` instead, if any are given."""

    def total(table: pa.Table) -> pa.Table:
        group = Group.of(table)
        asked = [(b, p, _whole(a[0], a[1]), a[2:]) for b, p, a in group.each("asks")]
        added = [(_whole(a[0], a[1]), a[2:]) for _, _, a in group.each("gives")] if given else [(c, v) for _, _, c, v in asked]
        width = given or len(asked[0][3])
        different = np.unique(np.concatenate([c for _, _, c, _ in asked]))
        sums = np.zeros((width, len(different)))
        for contexts, values in added:
            at = np.searchsorted(different, contexts)
            for k, v in enumerate(values):
                sums[k, at] += v  # a row's contexts differ
        out = []
        for b, p, contexts, _ in asked:
            at = np.searchsorted(different, contexts)
            out.append((b, "reply", p, _zip(*(sums[k, at].astype("<u4") for k in range(width)))))
        return pa.Table.from_batches([_rows(out)])

    return rows.groupBy("part").applyInArrow(total, _SCHEMA)


def _replies(group: Group) -> list[np.ndarray]:
    """The sums of all parts in a row, for each value."""
    return [np.concatenate(x).astype(np.int64) for x in zip(*(arrays for _, _, arrays in group.each("reply")), strict=True)]


@dataclass
class State:
    """What all buckets share in a sweep."""

    tokens: int
    vocabulary: int
    discount: float
    root_discount: float
    root_customers: float
    root_tables: float
    #: Words that are split over buckets, rising, with their counts, and customers and tables at the root.
    split: np.ndarray
    split_count: np.ndarray
    split_customers: np.ndarray
    split_tables: np.ndarray

    def new(self) -> float:
        """The root's pull of a new table."""
        return (ROOT_STRENGTH + self.root_discount * self.root_tables) / (self.vocabulary + 1)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probabilities of words with so many customers and tables there."""
        return (customers - self.root_discount * np.minimum(tables, customers) + self.new()) / (ROOT_STRENGTH + self.root_customers)

    def of_split(self, words: np.ndarray, which: np.ndarray, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """`own`, with the values of split words in their places."""
        out = own.astype(np.float64)
        if which.any():
            out[which] = values[np.searchsorted(self.split, words[which])]
        return out


def root_pull(state: State) -> Callable:
    """The root's pull of a new table, whose others are as the last sweep left them."""
    return lambda dishes, tables, closed: np.full(len(dishes), state.new())


class Chain:
    """A bucket's seating: of the types with two customers or more, and of its whole words at the root."""

    NAMES = ("words", "split", "word", "context", "number", "known", "kinds", "count", "dish", "size", "root_dish", "root_size")

    def __init__(self, **arrays: np.ndarray):
        self.a = arrays

    @staticmethod
    def start(types: Types, contexts: np.ndarray, number: np.ndarray, known: np.ndarray) -> Chain:
        """Every type and every word at one table."""
        active = np.flatnonzero(types.count > 1)
        used, place = np.unique(number[active], return_inverse=True)
        kinds = np.bincount(types.word, weights=types.count > 0, minlength=len(types.words)).astype(np.int64)
        seats, root = Seating.together(types.count[active]), Seating.together(np.where(types.split, 0, kinds))
        return Chain(
            words=types.words, split=types.split, word=types.word[active], context=contexts[used], number=place, known=known[used], kinds=kinds,
            count=types.count[active], dish=seats.dish, size=seats.size, root_dish=root.dish, root_size=root.size,
        )

    @staticmethod
    def read(arrays: list[np.ndarray]) -> Chain:
        out = Chain(**dict(zip(Chain.NAMES, arrays, strict=True)))
        out.a["context"] = out.a["context"].astype(U64)
        out.a["split"] = out.a["split"].astype(bool)
        for name in set(Chain.NAMES) - {"words", "split", "context"}:
            out.a[name] = out.a[name].astype(np.int64)
        return out

    def pack(self) -> bytes:
        small = {"word", "number", "known", "kinds", "count", "dish", "size", "root_dish", "root_size"}
        return _zip(*(self.a[n].astype("<u4") if n in small else self.a[n] for n in Chain.NAMES))

    def seats(self) -> Seating:
        return Seating(len(self.a["count"]), self.a["dish"], self.a["size"])

    def root(self) -> Seating:
        return Seating(len(self.a["words"]), self.a["root_dish"], self.a["root_size"])

    def extra(self) -> np.ndarray:
        """Tables beyond the first of each type, by context."""
        return np.bincount(self.a["number"], weights=self.seats().tables() - 1, minlength=len(self.a["context"]))

    def sent(self, tables: np.ndarray) -> np.ndarray:
        """The customers that a word's types send to the root."""
        return self.a["kinds"] + np.bincount(self.a["word"], weights=tables - 1, minlength=len(self.a["words"])).astype(np.int64)

    def sweep(self, state: State, others: np.ndarray, rng: np.random.Generator) -> None:
        """Reseat every customer, given the tables of each context in all buckets; then the root's."""
        word, number = self.a["word"], self.a["number"]
        seats, root = self.seats(), self.root()
        began = seats.tables()
        # what is at the root now: of a split word all buckets' customers, of which this one's change
        customers = state.of_split(self.a["words"], self.a["split"], state.split_customers, self.sent(began))
        tables = state.of_split(self.a["words"], self.a["split"], state.split_tables, root.tables())

        def pull(dishes: np.ndarray, now: np.ndarray, closed: np.ndarray) -> np.ndarray:
            customers[:] -= np.bincount(word[dishes], weights=closed, minlength=len(customers))
            strength = STRENGTH + state.discount * (others[number[dishes]] - began[dishes] + now)
            opened[dishes] = closed
            return strength * state.root(customers[word[dishes]], tables[word[dishes]])

        def note(dishes: np.ndarray, change: np.ndarray) -> None:
            # what has closed is taken off already
            customers[:] += np.bincount(word[dishes], weights=change + opened[dishes], minlength=len(customers))

        opened = np.zeros(len(word), dtype=np.int64)
        seats.sweep(state.discount, pull, rng, note)
        self.a["dish"], self.a["size"] = seats.dish, seats.size
        root.resize(np.where(self.a["split"], 0, self.sent(seats.tables())), state.root_discount, root_pull(state), rng)
        root.sweep(state.root_discount, root_pull(state), rng)
        self.a["root_dish"], self.a["root_size"] = root.dish, root.size

    def sums(self) -> bytes:
        """The root's customers and tables of whole words, and the customers of each split one."""
        sent, split = self.sent(self.seats().tables()), self.a["split"]
        whole = np.array([sent[~split].sum(), len(self.a["root_dish"])], dtype=np.float64)
        return _zip(whole, self.a["words"][split], sent[split].astype(np.float64))

    def sample(self) -> bytes:
        """What probabilities need: tables of types, and customers and tables of words."""
        tables = self.seats().tables()
        return _zip(tables.astype("<u4"), self.sent(tables).astype("<u4"), self.root().tables().astype("<u4"))


def gather(parts: list[tuple[int, list[np.ndarray]]], hot: np.ndarray) -> tuple[Types, bytes, bytes]:
    """Of a bucket's tokens by chunk: its types; per chunk each token's type and document; and counts for all buckets' sums."""
    sizes = [int(a[1].sum()) for _, a in parts]
    runs = np.concatenate([a[4] for _, a in parts])
    docs = np.concatenate([a[5] for _, a in parts])
    words, word = np.unique(np.concatenate([a[0] for _, a in parts]), return_inverse=True)
    word = np.repeat(word, np.concatenate([a[1] for _, a in parts]))
    key = (word.astype(U64) << U64(CONTEXT_BITS)) | np.concatenate([_whole(a[2], a[3]) for _, a in parts])
    del word
    keys, kind = np.unique(key, return_inverse=True)
    del key
    count = np.bincount(np.repeat(kind, runs)[(docs & 1) == 0], minlength=len(keys))
    types = Types(words, np.isin(words, hot), (keys >> U64(CONTEXT_BITS)).astype(np.int64), keys & _MASK, count)
    starts = np.cumsum(sizes) - sizes
    steps = np.diff(kind, prepend=0)
    steps[starts] = kind[starts]
    uses = _zip(
        np.array([c for c, _ in parts], dtype=np.int64), np.array(sizes, dtype=np.int64), np.array([len(a[5]) for _, a in parts], dtype=np.int64),
        steps.astype("<i4"), runs.astype("<u4"), docs,
    )
    by_word = np.bincount(types.word, weights=count, minlength=len(words))
    kinds = np.bincount(types.word, weights=count > 0, minlength=len(words))
    whole = ~types.split
    facts = [count.sum(), (by_word[whole] > 0).sum(), (count == 1).sum(), (count == 2).sum(), (kinds[whole] == 1).sum(), (kinds[whole] == 2).sum(), kinds[whole].sum()]
    sums = _zip(np.array(facts, dtype=np.float64), words[types.split], np.stack([by_word, kinds], axis=1)[types.split].ravel())
    return types, uses, sums


def _total(rows: DataFrame) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Sum the rows (sums, words, values of each) over all buckets, in parts of 32, so that the driver sees few."""

    def add(packed: Iterator[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        total, split = 0, {}
        for data in packed:
            part, words, values = _unzip(data)
            total = total + part
            for w, v in zip(words.tolist(), values.reshape(len(words), -1) if len(words) else [], strict=True):
                split[w] = split.get(w, 0) + v
        return total, split

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, split = add(one.as_buffer().to_pybytes() for batch in batches for one in batch.column(0))
        if not isinstance(total, int):
            packed = _zip(total, np.array(list(split), dtype=U64), np.array(list(split.values()), dtype=np.float64).ravel())
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["data"])

    rows = rows.select("data")
    n = rows.count()
    while n > 32:
        n = -(-n // 32)
        rows = rows.repartition(n).mapInArrow(work, "data binary")
    return add(bytes(row.data) for row in rows.collect())


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def probabilities(types: Types, known: tuple[np.ndarray, np.ndarray], number: np.ndarray, states: list[State], samples: list[list[np.ndarray]], extras: list[np.ndarray]) -> np.ndarray:
    """Each type's probability, averaged over samples."""
    customers, kinds = known
    active = np.flatnonzero(types.count > 1)
    chance = np.zeros(len(types.count))
    for state, (tables, sent, at_root), extra in zip(states, samples, extras, strict=True):
        own = (types.count > 0).astype(np.float64)
        own[active] = tables
        sent = state.of_split(types.words, types.split, state.split_customers, sent)
        at_root = state.of_split(types.words, types.split, state.split_tables, at_root)
        here, there = customers[number], (kinds + extra)[number]
        parent = state.root(sent, at_root)[types.word]
        chance += (types.count - state.discount * own + (STRENGTH + state.discount * there) * parent) / (STRENGTH + here)
    return chance / len(states)


def pitman_yor_scores(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 6
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are lower-cased (A-Z) and followed by one end, which is a token too. Documents with
    crc32(id as text) mod 7 = 2 are held out, all others train. base_score is the log10 probability under
    add-one unigrams with one unknown word; score is the model's, which also shares the base among the
    known words and one unknown; perplexity is 10 ** (-score / n_tokens). A null or empty text is its end
    alone. A null id counts as an empty text in the crc32. Repeated rows train and are scored one by one.
    Without training tokens both models give every token the whole base. An empty table gives an empty
    result; other columns are not returned. Discounts are set from the counts of ones and twos.
    """
    spark = df.sparkSession
    bounded_batches(spark, ROWS, BATCH)
    stash = Stash(spark, "pitman-yor")
    docs = two_columns(df, id_col, text_col)
    schema = "__id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    sizes, often = frequent_words(docs, SHARE, stash)
    if not sizes:
        return spark.createDataFrame([], schema).withColumnRenamed("__id", id_col)
    n_buckets = max(2, -(-sizes // bucket_tokens))
    n_parts = -(-n_buckets // 4)
    share = max(LEAST_SHARE, 0.125 / n_buckets)
    if share < 2 * SHARE:
        sizes, often = frequent_words(docs, share, stash)
    often = {w: n for w, n in often.items() if n >= share * sizes}
    hot = np.array(sorted(often), dtype=U64)
    splits = {w: max(1, math.ceil(4 * n * n_buckets / sizes)) for w, n in often.items()}

    def gathered(table: pa.Table) -> pa.Table:
        group = Group.of(table)
        bucket = group.rows[0][0]
        out = [r for r in group.rows if r[1] == "docs"]
        tokens = [(p, a) for _, p, a in group.each("tokens")]
        if tokens:
            types, uses, sums = gather(tokens, hot)
            contexts, number = types.contexts(n_parts)
            customers = np.bincount(number, weights=types.count, minlength=len(contexts))
            kinds = np.bincount(number, weights=types.count > 0, minlength=len(contexts))
            out += [(bucket, "types", 0, types.pack()), (bucket, "uses", 0, uses), (bucket, "sums", 0, sums)]
            out += _by_part(bucket, "asks", contexts, n_parts, customers, kinds)
        return pa.Table.from_batches([_rows(out)])

    def each_bucket(rows: DataFrame, work: Callable, out: str = _SCHEMA) -> DataFrame:
        return rows.groupBy("bucket").applyInArrow(work, out)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        """Write rows of large binaries, reading others one by one, not by thousands."""
        with setting(spark, "spark.sql.parquet.enableVectorizedReader", "false"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "64"):
            return stash.keep(rows, name, by="kind" if "kind" in rows.columns else None)

    def of(rows: DataFrame, *kinds: str) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds))

    buckets = stash.keep(each_bucket(deal(docs, n_buckets, splits), gathered), "buckets", by="kind")
    facts, split = _total(of(buckets, "sums"))
    words = np.array(sorted(split), dtype=U64)
    counts = np.array([split[int(w)][0] for w in words])
    kinds = np.array([split[int(w)][1] for w in words]).astype(np.int64)
    known = kinds > 0
    vocabulary = int(facts[1]) + int(known.sum())
    state = State(
        int(facts[0]), vocabulary, _discount(facts[2], facts[3]), _discount(facts[4] + (kinds == 1).sum(), facts[5] + (kinds == 2).sum()),
        float(facts[6] + kinds.sum()), float(vocabulary), words, counts, kinds.astype(np.float64), known.astype(np.float64),
    )
    split_root = Seating.together(kinds)
    replies = kept(sums_by_context(of(buckets, "asks")), "known")

    def chain_row(bucket: int, chain: Chain) -> list[tuple[int, str, int, bytes]]:
        rows = [(bucket, "chain", 0, chain.pack()), (bucket, "sums", 0, chain.sums())]
        return rows + _by_part(bucket, "asks", chain.a["context"], n_parts, chain.extra())

    def begin(table: pa.Table) -> pa.Table:
        group = Group.of(table)
        arrays = group.one("types")
        if arrays is None:
            return pa.Table.from_batches([_rows([])])
        types = Types.read(arrays)
        chain = Chain.start(types, *types.contexts(n_parts), _replies(group)[1])
        return pa.Table.from_batches([_rows(chain_row(group.rows[0][0], chain))])

    rows = kept(each_bucket(of(buckets, "types").unionByName(replies), begin), "chain0")
    last = burn_in + samples

    def sweep(step: int, state: State) -> Callable:
        def move(table: pa.Table) -> pa.Table:
            group = Group.of(table)
            bucket, chain = group.rows[0][0], Chain.read(group.one("chain"))
            extra = _replies(group)
            chain.sweep(state, chain.a["known"] + (extra[0] if extra else 0), np.random.default_rng([seed, step, bucket]))
            out = chain_row(bucket, chain)
            if step > burn_in:
                out.append((bucket, "sample", step, chain.sample()))
                none = np.zeros(len(chain.a["context"]))
                out += _by_part(bucket, "gives", chain.a["context"], n_parts, *(chain.extra() if k == step else none for k in range(burn_in + 1, last + 1)))
            return pa.Table.from_batches([_rows(out)])

        return move

    states: list[State] = []
    sampled: DataFrame | None = None
    for step in range(1, last + 1):
        moved = kept(each_bucket(of(rows, "chain").unionByName(sums_by_context(of(rows, "asks"))), sweep(step, state)), f"chain{step}")
        stash.drop(*[f"chain{step - 1}/kind={kind}" for kind in ("chain", "asks", "sums")])
        rows = moved
        whole, split = _total(of(rows, "sums"))
        sent = np.array([split[int(w)][0] for w in words]).astype(np.int64)
        rng = np.random.default_rng([seed, step])
        split_root.resize(sent, state.root_discount, root_pull(state), rng)
        split_root.sweep(state.root_discount, root_pull(state), rng)
        at_root = split_root.tables()
        state = State(
            state.tokens, vocabulary, state.discount, state.root_discount, float(whole[0] + sent.sum()), float(whole[1] + at_root.sum()), words, counts, sent.astype(np.float64), at_root.astype(np.float64)
        )
        if step > burn_in:
            states.append(state)
            sampled = rows if sampled is None else sampled.unionByName(rows)

    stash.drop(f"chain{last}/kind=chain", f"chain{last}/kind=asks")
    extras = kept(sums_by_context(of(buckets, "asks").unionByName(of(sampled, "gives")), given=samples), "extras")
    stash.drop("buckets/kind=asks", *[f"chain{k}/kind=gives" for k in range(burn_in + 1, last + 1)])

    def score(table: pa.Table) -> pa.Table:
        group = Group.of(table)
        chunk, kind, out = [], [], []
        for b, k, p, d in group.rows:
            if k == "docs":
                chunk.append(p)
                kind.append(1)
                out.append(d)
        arrays = group.one("types")
        if arrays is not None:
            types = Types.read(arrays)
            _, number = types.contexts(n_parts)
            asked = Group([(b, "reply", p, d) for b, k, p, d in group.rows if k == "known"])
            chance = probabilities(types, _replies(asked), number, states, [a for _, _, a in group.each("sample")], _replies(group))
            by_word = np.bincount(types.word, weights=types.count, minlength=len(types.words))
            seen = state.of_split(types.words, types.split, state.split_count, by_word)[types.word]
            model, base = np.log10(chance), np.log10((seen + 1) / (state.tokens + state.vocabulary + 1))
            names, n_types, n_tokens, steps, runs, docs_of = group.one("uses")
            ends, token_ends = np.cumsum(n_types), np.cumsum(n_tokens)
            for c, a, e, ta, te in zip(names.tolist(), (ends - n_types).tolist(), ends.tolist(), (token_ends - n_tokens).tolist(), token_ends.tolist(), strict=True):
                each = np.repeat(np.cumsum(steps[a:e].astype(np.int64)), runs[a:e])
                place, doc = np.unique(docs_of[ta:te] >> 1, return_inverse=True)
                sums = [np.bincount(doc, weights=v[each]) for v in (model, base, seen > 0)]
                chunk.append(c)
                kind.append(0)
                # half the digits are plenty for the model's part of a document, of which the sum is taken in doubles
                out.append(_zip(place.astype("<u2"), sums[0].astype(np.float32), sums[1], sums[2].astype("<u4")))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "type": pa.array(kind, pa.int32()), "data": pa.array(out, pa.binary())})

    renamed = replies.withColumn("kind", F.lit("known"))
    every = of(buckets, "types", "uses", "docs").unionByName(renamed).unionByName(of(sampled, "sample")).unionByName(extras)
    parts = kept(each_bucket(every, score, "chunk long, type int, data binary"), "parts")
    stash.drop("buckets", "known", "extras", *[f"chain{k}" for k in range(burn_in, last + 1)])
    tokens = state.tokens

    def finish(table: pa.Table) -> pa.Table:
        model, base, seen = np.zeros(ROWS), np.zeros(ROWS), np.zeros(ROWS, dtype=np.int64)
        for kind, data in sorted(zip(table.column("type").to_pylist(), table.column("data").to_pylist(), strict=True)):
            arrays = _unzip(data)
            if kind == 1:
                ids, null, held, counts = arrays
            else:
                for total, part in zip((model, base, seen), arrays[1:], strict=True):
                    total[arrays[0]] += part
        n = len(ids)
        return pa.table(
            {
                "__id": pa.array(ids, mask=null.astype(bool)),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(counts),
                "n_known": pa.array(seen[:n]),
                "train_tokens": pa.array(np.full(n, tokens, dtype=np.int64)),
                "base_score": pa.array(base[:n]),
                "score": pa.array(model[:n]),
                "perplexity": pa.array(10.0 ** np.minimum(300, -model[:n] / counts)),
            }
        )

    return parts.groupBy("chunk").applyInArrow(finish, schema).withColumnRenamed("__id", id_col)
