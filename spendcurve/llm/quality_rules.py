"""Line-first cleaning: judge every line, drop the lines that fail, then reject documents that lost too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendcurve.llm.common import bounded_batches, two_columns
from spendcurve.llm.textops import _LOW_BYTES, SPACE, Chunk, chunks, ngrams, word_hashes

#: The symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Lower-case phrases that mark a line as boilerplate or navigation.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of service",
    "enable javascript", "click here", "subscribe to our", "sign up for", "skip to content", "back to top",
)
#: Characters that end a sentence, in any script; a line of few words that ends otherwise is a heading or a menu.
TERMINAL = ".!?…。！？؟।\"')”’»」』）"
#: Words that part the entries of a menu or a path.
SEPARATORS = "|·•»›>/–—-"
SCHEMA = (
    "__id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_failed_lines long, n_words_kept long, base_failed boolean, kept boolean"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True  # letters of other scripts have no ASCII byte
_END = np.array(sorted(int.from_bytes(c.encode()) for c in TERMINAL), dtype=np.int64)


def last_characters(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes of the character before each end, as a number."""
    out = np.zeros(len(ends), dtype=np.int64)
    more = np.ones(len(ends), dtype=bool)
    for k in range(4):
        byte = data[np.maximum(ends - 1 - k, 0)].astype(np.int64)
        out = np.where(more, out | (byte << (8 * k)), out)
        more &= (byte & 0xC0) == 0x80
    return out


def _separator_hashes() -> np.ndarray:
    return word_hashes(next(chunks(pa.array([" ".join(SEPARATORS)]))), lower=False)[0]


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def repeated_words(grams: np.ndarray, n_words: int) -> int:
    """Words that lie in a 3-word window found twice or more among `grams`, the hashes of all windows."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n_words, dtype=bool)
    hits = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        twice[hits + k] = True
    return int(twice.sum())


def measure(chunk: Chunk, max_loss: float, min_words: int, with_text: bool) -> dict[str, np.ndarray | list]:
    """All figures of a chunk's documents."""
    data, run = chunk.data, chunk.running(lower=False)
    starts, ends, first = chunk.words()
    n_words = np.diff(first)
    code_points = _sums(((data & 0xC0) != 0x80) & ~SPACE[data])
    symbols, bangs = _sums(_SYMBOL[data]), _sums(data == ord("!"))
    word_hash = chunk.spans_hash(run, starts, ends)
    grams = ngrams(word_hash, 3)
    bounds = first.tolist()
    repeat = [repeated_words(grams[a : max(a, b - 2)], b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    l_start, l_end, l_first = chunk.lines()
    w_a, w_b = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    l_words = w_b - w_a
    worded = l_words > 0
    l_chars = code_points[l_end] - code_points[l_start]
    l_doc = np.repeat(np.arange(chunk.n_docs), np.diff(l_first))
    l_hash = chunk.spans_hash(run, l_start, l_end)
    order = np.lexsort((np.arange(len(l_hash)), l_hash, l_doc))
    order = order[worded[order]]
    again = np.zeros(len(l_hash), dtype=bool)
    if len(order):
        again[order[1:]] = (l_hash[order[1:]] == l_hash[order[:-1]]) & (l_doc[order[1:]] == l_doc[order[:-1]])
    ended = np.zeros(len(l_hash), dtype=bool)
    ended[worded] = np.isin(last_characters(data, ends[w_b[worded] - 1]), _END)
    separators = _sums(np.isin(word_hash, _separator_hashes()))
    letters = _sums(_LETTER[data])
    boiler = np.zeros(len(l_hash), dtype=bool)
    body = _LOW_BYTES[data].tobytes()
    for phrase in BOILERPLATE:
        mark = phrase.encode()
        at = body.find(mark)
        while at >= 0:
            line = int(np.searchsorted(l_start, at, side="right")) - 1
            if at + len(mark) <= l_end[line]:
                boiler[line] = True
            at = body.find(mark, at + 1)
    failed = worded & (
        again
        | boiler
        | (10 * (symbols[l_end] - symbols[l_start]) > l_chars)
        | (10 * (bangs[l_end] - bangs[l_start]) > l_chars)
        | ((l_words < 4) & ~ended)
        | (4 * (separators[w_b] - separators[w_a]) >= np.maximum(l_words, 4))
        | (letters[l_end] == letters[l_start])
    )
    docs = chunk.n_docs
    words_kept = np.bincount(l_doc[worded & ~failed], weights=l_words[worded & ~failed], minlength=docs).astype(np.int64)
    repeat = np.array(repeat, dtype=np.int64)
    base_failed = (n_words < min_words) | (100 * repeat > 50 * n_words)
    lost = (n_words - words_kept) * 1000 > round(max_loss * 1000) * n_words
    out: dict[str, np.ndarray | list] = {
        "n_words": n_words,
        "word_chars": code_points[chunk.offsets[1:]] - code_points[chunk.offsets[:-1]],
        "n_symbols": symbols[chunk.offsets[1:]] - symbols[chunk.offsets[:-1]],
        "n_dup_lines": np.bincount(l_doc[again], minlength=docs),
        "n_repeat_words": repeat,
        "n_lines": np.bincount(l_doc[worded], minlength=docs),
        "n_failed_lines": np.bincount(l_doc[failed], minlength=docs),
        "n_words_kept": words_kept,
        "base_failed": base_failed,
        "kept": ~base_failed & ~lost,
    }
    if with_text:
        raw, texts, edges, clean = data.tobytes(), [], l_first.tolist(), (~failed).tolist()
        spans = list(zip(l_start.tolist(), l_end.tolist(), strict=True))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            texts.append(b"\n".join(raw[s:e] for (s, e), ok in zip(spans[a:b], clean[a:b], strict=True) if ok).decode("utf-8", "replace"))
        out["clean_text"] = texts
    return out


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = 0.3, min_words: int = 50, with_text: bool = True
) -> DataFrame:
    """One row per input row: its figures, `base_failed`, `kept` and, unless `with_text` is false, `clean_text`.

    A line with a word fails if it repeats an earlier line of its document, holds a boilerplate phrase,
    has more than a tenth of its characters in symbols or in exclamation marks, has under four words
    and no final punctuation of any script, has a separator (|, >, - and the like alone) for every four of its
    words, or has no letter. A document is rejected if it has under `min_words` words, if over half its
    words lie in repeated 3-word windows, or if failed lines held more than `max_loss` of its words.

    A null or empty text has no words and is rejected; its clean text is empty. Repeated rows are judged
    one by one. A null id stays null. Other columns are not returned, whatever their names; an empty
    table gives an empty result. Texts of any length are judged whole.
    """
    bounded_batches(df.sparkSession)
    schema = SCHEMA + (", clean_text string" if with_text else "")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                out = measure(chunk, max_loss, min_words, with_text)
                own = [ids.slice(chunk.first, chunk.n_docs)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(out[n]) for n in names[1:]], names=names)

    return two_columns(df, id_col, text_col).mapInArrow(judge, schema).withColumnRenamed("__id", id_col)
