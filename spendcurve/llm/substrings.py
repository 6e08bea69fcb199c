"""Passages that repeat across documents, by compact windows.

The Cartesian tree over a document's hashed shingles has one node for each shingle that is the minimum of a
maximal window; the node's window (a, c, b) stands for all runs of shingles between a and b that hold c.
A passage of `least_words` words with few enough changed words holds an unchanged run of `sure_run` shingles,
whose minimum is a node on both sides with the same c. So the windows of that least length are kept, under
the words from c on and up to c as far as half such a run, where the window reaches that far: one of
both is shared for sure.

Documents that share such words meet the first document of their group alone. They are aligned and verified
on their words. Where no verified passage holds a window, the alignment about it ends before a passage does, and
documents that have more in common with each other than with the first one go on alike behind one of its
ends: so the window is grouped anew with those that have the same next shingle there, and meets the first
document of that group. Every such step has a word more in common, so there are `least_words` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import Stash, bounded_batches, by_id, hot_keys, matched, salted, spread, trimmed, two_columns
from spendcurve.llm.textops import U64, Chunk, chunks, constants, mix, ngrams, span_hasher, word_hashes

SHINGLE = 5
#: Aligned runs of equal shingles are one passage across gaps and shifts of at most this many shingles: two changed words.
GAP = 10


def shingle_positions(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 5-word windows of a chunk, and the range of each document's among them."""
    every = ngrams(words, SHINGLE)
    return every, first[:-1], np.maximum(first[1:] - SHINGLE + 1, first[:-1])


def compact_windows(h: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(range number, a, c, b): the nodes of every range's Cartesian tree whose windows have at least `least` members.

    These nodes are the leftmost minima of all runs of `least` members, found by doubling runs. A node's
    window ends before the next smaller member on either side; that member's own window is larger, so it is
    a node too, and it is found among the nodes by following their neighbours.
    """
    none = np.zeros(0, dtype=np.int64)
    which = np.flatnonzero(high - low >= least)
    n = len(h)
    if not len(which):
        return none, none, none, none
    bits = max(1, n.bit_length())
    place = U64((1 << bits) - 1)
    # the place in the low bits breaks ties to the left and tells where the minimum is
    runs = (h & ~place) | np.arange(n, dtype=U64)
    width = 1
    while width < least:
        step = min(width, least - width)
        runs[: n - step] = np.minimum(runs[: n - step], runs[step:])
        width += step
    first, count = low[which], high[which] - least + 1 - low[which]
    ends = np.cumsum(count)
    starts = np.arange(ends[-1]) + np.repeat(first - ends + count, count)
    minimum = (runs[starts] & place).astype(np.int64)
    owner = np.repeat(np.arange(len(which)), count)
    new = np.ones(len(minimum), dtype=bool)
    new[1:] = (minimum[1:] != minimum[:-1]) | (owner[1:] != owner[:-1])
    c, owner = minimum[new], owner[new]
    value = (h[c] & ~place) | c.astype(U64)
    edges = np.searchsorted(owner, np.arange(len(which) + 1))
    a = _next_smaller(value, edges[owner] - 1, -1)
    b = _next_smaller(value, edges[owner + 1], 1)
    low, high = low[which][owner], high[which][owner]
    left = np.where(a >= edges[owner], c[np.maximum(a, 0)] + 1, low)
    right = np.where(b < edges[owner + 1], c[np.minimum(b, len(c) - 1)] - 1, high - 1)
    return which[owner], left, c, right


def _next_smaller(value: np.ndarray, border: np.ndarray, step: int) -> np.ndarray:
    """The nearest place with a smaller value on one side, or the border: all places jump at once over what their neighbours have passed."""
    at = np.arange(len(value)) + step
    going = np.flatnonzero(at != border)
    while len(going):
        going = going[value[at[going]] > value[going]]
        at[going] = at[at[going]]
        going = going[at[going] != border[going]]
    return at


def sure_run(least_words: int, percent: int) -> int:
    """Shingles in a row, at least, that both sides of a passage share however its words were replaced, inserted and deleted.

    k changes that take g shingles on one side take g - k at least on the other and leave k + 1 runs; a
    change takes 5 on one side at least.
    """
    least = best = least_words - SHINGLE + 1
    for k in range(1, least):
        for g in range(SHINGLE * k, SHINGLE * k + least):
            shared = max(least - g, -(-percent * (2 * g - k) // (100 - percent)) if percent < 100 else least * (k + 1))
            best = min(best, -(-shared // (k + 1)))
    return max(best, 1)


def windows(docs: DataFrame, least_words: int, percent: int) -> DataFrame:
    """(key, id, hash, at): the words on either side of each compact window's c, from word `at` on."""
    factor, shift = constants(1, 31)[0] | U64(1), constants(1, 32)[0]
    run = sure_run(least_words, percent)
    half = (run - 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for chunk in chunks(batch.column(1)):
                words, first = word_hashes(chunk)
                every, low, high = shingle_positions(words, first)
                doc, a, c, b = compact_windows(every * factor + shift, low, high, run)
                if len(doc):
                    left, right = c - half >= a, c + half <= b
                    at = np.concatenate([c[left] - half, c[right]])
                    doc = np.concatenate([doc[left], doc[right]])
                    own = chunk.first + doc
                    key = ngrams(words, half + SHINGLE)[at]
                    arrays = [pa.array(key.view(np.int64)), pa.array(ids[own]), pa.array(hashes[own]), pa.array((at - first[doc]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "id", "hash", "at"])

    return docs.mapInArrow(trimmed(work), "key long, id long, hash long, at int")


def _leads(rows: DataFrame) -> DataFrame:
    """(key, lead, n): the groups of several documents, each with the id and the text's hash of the first."""
    groups = rows.groupBy("key").agg(F.min(F.struct("id", "hash")).alias("lead"), F.max("id").alias("last"), F.count("*").alias("n"))
    return groups.filter("lead.id < last").select("key", "lead", "n")


def shared_windows(docs: DataFrame, least_words: int, percent: int, stash: Stash) -> DataFrame:
    """(key, id, hash, at, lead): the windows that several documents have, with the first of these."""
    every = windows(docs, least_words, percent)
    leads = stash.keep(_leads(every), "leads")
    hot = stash.keep(hot_keys(leads, "key"), "hot")
    shared = salted(every, hot, "key", "id").join(spread(leads.drop("n"), hot, "key"), ["key", "__salt"]).drop("__salt")
    return stash.keep(shared, "shared")


def unexplained(rows: DataFrame, found: DataFrame, words: int) -> DataFrame:
    """The windows whose so many words lie in no passage found in their document."""
    spans = found.select("id", "hash", "start", "end").distinct().groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    inside = F.exists("__spans", lambda s: (s["start"] <= F.col("at")) & (F.col("at") + words <= s["end"]))
    return rows.join(spans, ["id", "hash"], "left").filter(~F.coalesce(inside, F.lit(False))).select(*rows.columns)


#: Places to compare one by one; more are compared at once, by hashes of runs.
FEW = 8


def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(start in y, start in x, length): y cut from the left into its longest runs of shingles that x also has in a row, the first of equal ones."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    left, right = np.searchsorted(ranked, y, side="left"), np.searchsorted(ranked, y, side="right")
    there = np.flatnonzero(right > left).tolist()
    hashers = None
    out = []
    done = 0
    for j in there:
        if j < done:
            continue
        places = order[left[j] : right[j]]
        if len(places) > FEW:
            hashers = hashers or (span_hasher(x), span_hasher(y))
            length = _common(*hashers, places, j, len(x), len(y))
            k = int(np.argmax(length))
            at, best = int(places[k]), int(length[k])
        else:
            best, at = 0, 0
            for i in places.tolist():
                n, step = 1, 64
                limit = min(len(x) - i, len(y) - j)
                while n < limit:
                    m = min(limit, n + step)
                    same = x[i + n : i + m] == y[j + n : j + m]
                    if same.all():
                        n, step = m, step * 2
                    else:
                        n += int(np.argmin(same))
                        break
                if n > best:
                    best, at = n, i
        out.append((j, at, best))
        done = j + best
    return out


def _common(hash_x, hash_y, places: np.ndarray, j: int, n_x: int, n_y: int) -> np.ndarray:
    """How far x from each of some places and y from j agree, by halving."""
    low, high = np.ones(len(places), dtype=np.int64), np.minimum(n_x - places, n_y - j)
    while (going := low < high).any():
        mid = (low + high + 1) // 2
        same = hash_x(places, places + mid) == hash_y(np.full(len(places), j), j + mid)
        low, high = np.where(going & same, mid, low), np.where(going & ~same, mid - 1, high)
    return low


def chained(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Runs (start in y, start in x, length) of equal shingles, chained over small gaps and shifts."""
    out: list[list[tuple[int, int, int]]] = []
    for run in _runs(x, y):
        j, i, _ = run
        if out:
            pj, pi, pn = out[-1][-1]
            if 0 <= j - (pj + pn) <= GAP and 0 <= i - (pi + pn) <= GAP:
                out[-1].append(run)
                continue
        out.append([run])
    return [np.array(chain) for chain in out]


def passages(x: np.ndarray, y: np.ndarray, least_words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in x, end in x, similarity) of the passages of y, in words, that x has too.

    Of a chain the longest stretches of whole runs count that have `least_words` words and whose shingle
    sets on both sides have the Jaccard similarity. A stretch that ends within a run would gain by the rest of it.
    """
    return [part for chain in chained(x, y) for part in _stretches(x, y, chain, least_words, percent)]


def _stretches(x: np.ndarray, y: np.ndarray, chain: np.ndarray, least_words: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """A chain's stretches that count and lie in no other that counts."""
    n = len(chain)
    first, first_x = chain[:, 0], chain[:, 1]
    last, last_x = first + chain[:, 2], first_x + chain[:, 2]
    if last[-1] - first[0] + SHINGLE - 1 < least_words:
        return []
    if n == 1:
        # one run of equal shingles: both sides have the same set
        return [(int(first[0]), int(last[0]) + SHINGLE - 1, int(first_x[0]), int(last_x[0]) + SHINGLE - 1, 1.0)]
    mine, its = y[first[0] : last[-1]], x[first_x[0] : last_x[-1]]
    different, number = np.unique(np.concatenate([mine, its]), return_inverse=True)
    sides = []
    for numbers, starts, ends in ((number[: len(mine)], first, last), (number[len(mine) :], first_x, last_x)):
        sides.append((numbers, starts - starts[0], np.searchsorted(ends - starts[0], np.arange(len(numbers)), side="right")))
    out: list[tuple[int, int, int, int, float]] = []
    done = -1
    for p in range(n):
        if done == n - 1:
            break
        # the run with which each shingle enters either side's set when stretches start at run p
        enters = []
        for numbers, starts, run in sides:
            enter = np.full(len(different), n)
            enter[numbers[starts[p] :][::-1]] = run[starts[p] :][::-1]
            enters.append(enter)
        sizes = [np.cumsum(np.bincount(e, minlength=n + 1)[:n]) for e in (*enters, np.maximum(*enters))]
        both, union = sizes[2], sizes[0] + sizes[1] - sizes[2]
        counts = (100 * both >= percent * union) & (last - first[p] + SHINGLE - 1 >= least_words)
        counts[: max(p, done + 1)] = False
        if counts.any():
            done = q = int(np.flatnonzero(counts)[-1])
            out.append((int(first[p]), int(last[q]) + SHINGLE - 1, int(first_x[p]), int(last_x[q]) + SHINGLE - 1, float(both[q] / union[q])))
    return out


def _align(pairs: DataFrame, texts: DataFrame, least_words: int, percent: int, words: int) -> DataFrame:
    """Align the pairs (lead, lead_hash, id, hash, windows of key and at).

    A row per passage, with start to similarity; and with key and at up to two rows for each window whose so
    many words lie in none: its key with the next shingle behind either end of the alignment about it.
    """
    names = ["lead", "id", "hash", "start", "end", "lead_start", "lead_end", "similarity", "key", "at"]
    kinds = [pa.int64()] * 7 + [pa.float64(), pa.int64(), pa.int32()]
    behind, before = constants(2, 41)

    def further(keys: np.ndarray, at: np.ndarray, y: np.ndarray, aligned: list[np.ndarray], found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(at), dtype=bool)
        for start, end, *_ in found:
            inside |= (start <= at) & (at + words <= end)
        keys, at = keys[~inside], at[~inside]
        begins, ends = np.array([c[0, 0] for c in aligned]), np.array([c[-1, 0] + c[-1, 2] for c in aligned])
        k = np.maximum(np.searchsorted(begins, at, side="right") - 1, 0)
        held = (begins[k] <= at) & (at < ends[k])
        keys, at, k = keys[held], at[held], k[held]
        right, left = ends[k] < len(y), begins[k] > 0
        # sums, so that both ends may be passed in any order
        new = np.concatenate([keys[right] + mix(y[ends[k[right]]] + behind), keys[left] + mix(y[begins[k[left]] - 1] + before)])
        at = np.concatenate([at[right], at[left]])
        _, first = np.unique(new, return_index=True)
        return new[first].view(np.int64), at[first]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(4), batch.column(5)):
                own: list[np.ndarray] = []
                for chunk in chunks(column):
                    every, low, high = shingle_positions(*word_hashes(chunk))
                    own += [every[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                sides.append(own)
            lists = batch.column(3)
            edges = np.asarray(lists.offsets)
            keys, ats = np.asarray(lists.values.field(0)).view(U64), np.asarray(lists.values.field(1))
            rows, again = [], [(np.zeros(0, dtype=np.int64),) * 4]
            for n, (lead, doc, its, x, y) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), *sides, strict=True)):
                aligned = chained(x, y)
                found = [part for chain in aligned for part in _stretches(x, y, chain, least_words, percent)]
                rows += [(lead, doc, its, *p, None, None) for p in found]
                if aligned:
                    new, at = further(keys[edges[n] : edges[n + 1]], ats[edges[n] : edges[n + 1]], y, aligned, found)
                    again.append((np.full(len(new), doc), np.full(len(new), its), new, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            doc, its, new, at = (np.concatenate(x) for x in zip(*again, strict=True))
            if len(new):
                none = [pa.nulls(len(new), t) for t in kinds]
                yield pa.RecordBatch.from_arrays([none[0], pa.array(doc), pa.array(its), *none[3:8], pa.array(new), pa.array(at.astype(np.int32))], names=names)

    left = texts.select(F.col("id").alias("lead"), F.col("hash").alias("__hash"), F.col("text").alias("x"))
    right = texts.select("id", F.col("hash").alias("__hash"), F.col("text").alias("y"))
    # joined on ids, of which few have several texts
    met = matched(pairs, "lead", "id", left).filter("lead_hash = __hash").drop("__hash")
    met = matched(met, "id", "lead", right, counted=pairs).filter("hash = __hash")
    schema = "lead long, id long, hash long, start long, end long, lead_start long, lead_end long, similarity double, key long, at int"
    return met.select("lead", "id", "hash", "windows", "x", "y").mapInArrow(trimmed(work), schema)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, percent: int = 80) -> DataFrame:
    """One row per passage that an earlier document has too: id, text_hash, match_id, start, end, match_start, match_end, n_words, similarity.

    Positions count words from 0, ends are exclusive; `match_id` is smaller than the id. Words are cut at
    blanks and lower-cased (A-Z). A passage has at least `least_words` words and a Jaccard similarity of
    its 5-word shingles of at least `percent`. Copies of a passage are all joined to the document that has
    it first, not to each other; a passage that repeats within one document alone is not returned.

    Null, empty and short texts have no passages. Rows without an id are left out. Of rows with the same id
    every different text is looked at, and `text_hash` (xxhash64) tells whose words are counted; passages
    that only texts of one id share are not returned. An empty table gives an empty result; other columns
    are not returned.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    stash = Stash(spark, "substrings")
    docs = two_columns(df, id_col, text_col).filter("__id IS NOT NULL").withColumn("__hash", F.xxhash64("__text"))
    words = (sure_run(least_words, percent) - 1) // 2 + SHINGLE
    shared = shared_windows(docs, least_words, percent, stash)
    wanted = shared.select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct()
    # equal rows are one text
    texts = docs.join(by_id(wanted), ["__id", "__hash"], "left_semi").groupBy("__id", "__hash").agg(F.first("__text").alias("text"))
    texts = stash.keep(texts.toDF("id", "hash", "text"), "texts")
    found, step = None, 0
    placed = shared
    while True:
        pairs = placed.filter("lead.id < id").groupBy(F.col("lead.id").alias("lead"), F.col("lead.hash").alias("lead_hash"), "id", "hash")
        pairs = stash.keep(pairs.agg(F.collect_list(F.struct("key", "at")).alias("windows")), f"pairs{step}")
        aligned = stash.keep(_align(pairs, texts, least_words, percent, words), f"aligned{step}")
        stash.drop(f"pairs{step}", f"placed{step}")
        own = aligned.filter("start IS NOT NULL").drop("key", "at")
        found = own if found is None else found.unionByName(own)
        left = stash.keep(unexplained(aligned.filter("start IS NULL").select("key", "id", "hash", "at"), found, words), f"left{step}")
        leads = stash.keep(_leads(left), f"leads{step}")
        if leads.isEmpty():
            break
        step += 1
        placed = stash.keep(matched(left, "key", "id", leads.drop("n")), f"placed{step}")
        stash.drop(f"left{step - 1}", f"leads{step - 1}")
    stash.drop("leads", "hot", "shared", "texts")
    return found.distinct().select(
        F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.col("lead").alias("match_id"), "start", "end",
        F.col("lead_start").alias("match_start"), F.col("lead_end").alias("match_end"), (F.col("end") - F.col("start")).alias("n_words"), "similarity",
    )


def without_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of some spans; the white space before each goes too."""
    if not text or not spans:
        return text
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    chunk = Chunk(data, np.array([0, len(data)]), 0)
    starts, ends, _ = chunk.words()
    raw, out, at = data.tobytes(), [], 0
    for a, b in sorted(spans):
        b = min(b, len(starts))
        if a >= b:
            continue
        cut = int(ends[a - 1]) if a else 0
        out.append(raw[at : max(at, cut)])
        at = max(at, int(ends[b - 1]))
    out.append(raw[at:])
    return b"".join(out).decode().strip(" \t\n\r\x0b\x0c")


def removed(spans: Column, text: Column) -> Column:
    """A text column without the spans (array of start, end) of another."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([without_words(t, [(s["start"], s["end"]) for s in (own or [])]) for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.string())

    return cut.asNondeterministic()(text, spans)  # so that plans run it once
