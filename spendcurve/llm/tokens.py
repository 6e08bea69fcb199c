"""Exact encoding with a public tokenizer file, with the units of a text encoded once and reused."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from spendcurve.llm.common import held
from spendcurve.llm.textops import U64, Chunk, chunks, constants, mix

#: Units and ids that a worker's table holds at most; it starts anew before it has more. Bounds memory, changes no result.
CACHE_UNITS, CACHE_IDS = 1 << 20, 1 << 23
#: Bytes of a unit that is kept in the table; a text with a longer one is encoded whole.
UNIT_BYTES = 256
#: Units that the library is given in one text.
JOINED = 16

#: ASCII white space, and control bytes that count as white space in some rules only.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UNSURE = np.zeros(256, dtype=bool)
_UNSURE[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_SECOND = constants(256, 3)
_RARE = np.zeros(256, dtype=bool)
_RARE[[0xC2, 0xE1, 0xE2, 0xE3, 0x3C]] = True


class UnitTable:
    """Hashed units and their ids: open addressing in arrays, so that a known unit costs no Python object.

    A unit is known by two 64-bit hashes of its bytes.
    """

    def __init__(self, units: int = CACHE_UNITS, ids: int = CACHE_IDS):
        self.most, self.most_ids = units, ids
        self.size = 1 << max(4, (2 * units - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.size, dtype=U64)
        self.entry = np.zeros(self.size, dtype=np.int32)
        self.check = np.zeros(1024, dtype=U64)
        self.start = np.zeros(1024, dtype=np.int64)
        self.count = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(1024, dtype="<u4")
        self.n = self.n_ids = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each unit, or -1."""
        out = np.full(len(key), -1, dtype=np.int64)
        going = np.arange(len(key))
        at = (key & U64(self.size - 1)).astype(np.int64)
        while len(going):
            there = self.key[at]
            entry = self.entry[at]
            hit = (there == key[going]) & (self.check[entry] == check[going])
            out[going[hit]] = entry[hit]
            on = ~hit & (there != 0)
            going, at = going[on], (at[on] + 1) & (self.size - 1)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Put new, different units in. There must be room: see `fits`."""
        n, m = self.n + len(key), self.n_ids + len(ids)
        for name, need in (("check", n), ("start", n), ("count", n), ("ids", m)):
            old = getattr(self, name)
            if len(old) < need:
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old), need - len(old)), dtype=old.dtype)]))
        self.check[self.n : n], self.count[self.n : n], self.ids[self.n_ids : m] = check, counts, ids
        self.start[self.n : n] = self.n_ids + np.cumsum(counts) - counts
        going, at = np.arange(len(key)), (key & U64(self.size - 1)).astype(np.int64)
        while len(going):
            # of those that meet at an empty place the first gets it
            free = np.flatnonzero(self.key[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.entry[at[won]] = key[going[won]], self.n + going[won]
            lost = np.ones(len(going), dtype=bool)
            lost[won] = False
            going, at = going[lost], (at[lost] + 1) & (self.size - 1)
        self.n, self.n_ids = n, m

    def fits(self, units: int, ids: int) -> bool:
        return self.n + units <= self.most and self.n_ids + ids <= self.most_ids

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some entries in a row, and the number of each."""
        counts = self.count[entries]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.start[entries] - ends + counts, counts)], counts


class Encoder:
    """Byte-level BPE by the tokenizers library: the ids of whole texts.

    Such a vocabulary cuts a text, before any merge, in front of a blank that a word follows, around other
    white space and between letters and what is none. So texts are cut into units at some of these places
    (those that ASCII bytes tell) and each different unit is encoded once. Texts with white space beyond
    ASCII, with the mark of a special token or with very long units are encoded whole, and so are all
    texts if the file cuts in another way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_units = cuts_known(json.loads(self.tokenizer.to_str()))
        alone = self.whole("\n").tolist()
        self.by_units, self.line_break = self.by_units and len(alone) == 1, alone[0] if alone else 0
        self.table = UnitTable()

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text as little-endian uint32; null counts as empty."""
        out: list[np.ndarray] = []
        for chunk in chunks(texts):
            out += self._chunk(chunk)
        return out

    def _chunk(self, chunk: Chunk) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * chunk.n_docs
        data, offsets = chunk.data, chunk.offsets
        edge, unsure = unit_edges(chunk) if self.by_units else (np.zeros(len(data), dtype=bool), np.ones(chunk.n_docs, dtype=bool))
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))
        first = np.searchsorted(starts, offsets)
        long = np.flatnonzero(ends - starts > UNIT_BYTES)
        unsure[np.searchsorted(first, long, side="right") - 1] = True
        unsure &= np.diff(offsets) > 0
        raw = data.tobytes()
        for i in np.flatnonzero(unsure).tolist():
            out[i] = self.whole(raw[offsets[i] : offsets[i + 1]].decode())
        sizes = np.where(unsure, 0, np.diff(first))
        if not sizes.any():
            return out
        if unsure.any():
            own = np.repeat(~unsure, np.diff(first))
            starts, ends = starts[own], ends[own]
        entries = self._entries(chunk, raw, starts, ends)
        ids, counts = self.table.gather(entries)
        edges = np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(sizes))].tolist()
        for i in np.flatnonzero(sizes).tolist():
            out[i] = ids[edges[i] : edges[i + 1]]
        return out

    def _entries(self, chunk: Chunk, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each unit; what is missing is encoded first."""
        table = self.table
        key = chunk.spans_hash(chunk.running(lower=False), starts, ends) | U64(1)
        check = chunk.spans_hash(chunk.running_of(_SECOND), starts, ends)
        entries = table.find(key, check)
        missing = np.flatnonzero(entries < 0)
        if not len(missing):
            return entries
        new = missing[_first_of(key[missing], check[missing])]
        new = new[np.argsort(_BLANK[chunk.data[ends[new] - 1]], kind="stable")]  # units of white space last
        units = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        ids, counts = self._learn(units, int((~_BLANK[chunk.data[ends[new] - 1]]).sum()))
        if not table.fits(len(new), len(ids)):
            # a chunk's units always fit an empty table that has grown for them
            known = np.flatnonzero(entries >= 0)
            kept, again = np.unique(entries[known], return_inverse=True)
            old_ids, old_counts = table.gather(kept)
            one = np.empty(len(kept), dtype=np.int64)
            one[again] = known
            table.clear()
            if len(kept) + len(new) > table.size // 2:
                table.size = 1 << (2 * (len(kept) + len(new)) - 1).bit_length()
                table.clear()
            table.add(key[one], check[one], old_counts, old_ids)
        table.add(key[new], check[new], counts, ids)
        return table.find(key, check)


    def _learn(self, units: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some units in a row, and the number of each. The first `words` end in no white space: line breaks between them are units by themselves."""
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        found: list[int] = []
        for one in encode(["\n".join(units[k : min(k + JOINED, words)]) for k in range(0, words, JOINED)]):
            found += one
            found.append(self.line_break)
        ids = np.asarray(found, dtype="<u4")
        breaks = np.flatnonzero(ids == self.line_break)
        counts = np.diff(breaks, prepend=-1) - 1
        rest = encode(units[words:])
        counts = np.append(counts, np.array([len(r) for r in rest], dtype=np.int64))
        return np.concatenate([np.delete(ids, breaks), np.array([i for r in rest for i in r], dtype="<u4")]).astype("<u4"), counts


def _first_of(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """A place of each different pair."""
    order = np.lexsort((check, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    return order[new]


def cuts_known(file: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the cuts that `unit_edges` relies on."""
    before = file.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = all(t["content"].startswith("<|") for t in file.get("added_tokens") or [])
    return bool(plain and added and not file.get("normalizer") and (file.get("model") or {}).get("type") == "BPE")


def unit_edges(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and which documents must be encoded whole.

    White space in a row is one unit up to its last character; that one belongs to the word behind it if
    it is a blank and is a unit by itself if not. A mark behind a letter starts a unit.
    """
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    blank = _BLANK[data]
    edge = np.zeros(n, dtype=bool)
    unsure = np.zeros(n, dtype=bool)
    if n:
        inner = offsets[1:-1][offsets[1:-1] < n]
        follows = np.zeros(n, dtype=bool)  # a byte of the same document that is no white space follows
        follows[:-1] = ~blank[1:]
        follows[inner[inner > 0] - 1] = False
        edge[1:] = (blank[1:] & (~blank[:-1] | follows[1:])) | (blank[:-1] & (data[:-1] != 0x20) & ~blank[1:]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        edge[offsets[:-1][offsets[:-1] < n]] = True
        unsure |= _UNSURE[data]
        rare = np.flatnonzero(_RARE[data])
        if len(rare):
            one = data[rare]
            two, three = data[np.minimum(rare + 1, n - 1)], data[np.minimum(rare + 2, n - 1)]
            # fixed values: UTF-8 of the white space beyond ASCII, and the start of a special token
            wide = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
            wide |= (one == 0xE1) & (((two == 0x9A) & (three == 0x80)) | ((two == 0xA0) & (three == 0x8E)))
            wide |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8B) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
            wide |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
            wide |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
            wide |= (one == 0x3C) & (two == 0x7C)
            unsure[rare[wide]] = True
    sums = np.concatenate([[0], np.cumsum(unsure)])
    return edge, sums[offsets[1:]] > sums[offsets[:-1]]


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
