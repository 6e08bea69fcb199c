"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The search reads a text character by character. It holds the positions from which a piece can still go on, no
more than the longest piece has characters, with the best path to each. Whenever the paths of all of them and
of the text's end go through one boundary, what lies before it can't change any more: its ids are committed
and forgotten. Where the end alone is left, the search is back in its first state, so that the ids of what
comes next depend on its characters alone and can be looked up if the same stretch has been read before.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendcurve.llm.common import bounded_batches, two_columns

BLANK = "▁"
#: Stretches in a worker's cache and their characters at most; it starts anew before it has more, and longer ones are not kept. Bounds memory, changes no result.
CACHE_ENTRIES, CACHE_CHARACTERS = 1_000_000, 64
#: Committed characters after which the search drops them.
FORGET = 256


class PieceModel:
    """Pieces and scores of a SentencePiece file: a path of highest total score, ties to the longer last piece.

    A character that no piece covers costs ten more than the worst piece and becomes its bytes' ids, or
    the unknown id where the file has no byte pieces.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        self.bytes_of: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append("" if sp.is_control(i) else piece)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[piece] = (i, sp.get_score(i))
        self._index(sp.unk_id())

    def _index(self, unknown: int) -> None:
        self.unknown = unknown
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        # by character: the node behind it, with a piece's score and id where one ends
        self.root: dict = {}
        for piece, (number, score) in self.pieces.items():
            at = self.root
            for c in piece[:-1]:
                at = at.setdefault(c, [{}, None, None])[0]
            last = at.setdefault(piece[-1], [{}, None, None])
            last[1], last[2] = score, number
        # no piece goes on from another character into a blank: in front of such a blank the end alone is left
        self.words_apart = not any(BLANK in p.lstrip(BLANK) for p in self.pieces)
        self.together = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        # of whole words, and of the stretches that they are made of
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _ids(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found:
            return [found[0]]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")] if len(self.byte_ids) == 256 else [self.unknown]

    def stream(self, characters: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of characters, in parts, each as soon as it is certain."""
        start_of, unknown = self.root.get, self.unknown_score
        text: list[str] = []  # what is not forgotten yet
        score: list[float] = [0.0]  # of the best path to each of its positions
        back: list[int] = [0]  # where the last piece of that path starts
        live: list[tuple] = []  # (position, score there, node): from where a piece can go on, and how far it has come
        end = done = 0  # `done`: what is committed
        for c in characters:
            text.append(c)
            best, at, going = -1e300, end, []
            for start, before, node in live:  # the earliest start, that of the longest last piece, wins a tie
                after = node.get(c)
                if after is not None:
                    own = after[1]
                    if own is not None and before + own > best:
                        best, at = before + own, start
                    if after[0]:
                        going.append((start, before, after[0]))
            base = score[end]
            after = start_of(c)
            if after is None or after[1] is None:
                total = base + unknown
            else:
                total = base + after[1]
            if total > best:
                best, at = total, end
            lost = len(going) < len(live)
            if after is not None and after[0]:
                going.append((end, base, after[0]))
            live = going
            end += 1
            score.append(best)
            back.append(at)
            if lost or not live:
                meet = end
                if live:
                    # the last boundary that the paths of all live positions and of the end share
                    meet = live[0][0]
                    for other in [x[0] for x in live[1:]] + [end]:
                        while other != meet:
                            if other > meet:
                                other = back[other]
                            else:
                                meet = back[meet]
                if meet > done:
                    yield self._ids_of(text, back, done, meet)
                    done = meet
                    if done > FORGET:
                        base = score[done]
                        text, score, back = text[done:], [s - base for s in score[done:]], [max(0, b - done) for b in back[done:]]
                        live = [(start - done, before - base, node) for start, before, node in live]
                        end, done = end - done, 0
        if end > done:
            yield self._ids_of(text, back, done, end)

    def _ids_of(self, text: list[str], back: list[int], begin: int, end: int) -> list[int]:
        """Ids of the best path from one boundary to another."""
        cuts = []
        while end > begin:
            cuts.append("".join(text[back[end] : end]))
            end = back[end]
        out: list[int] = []
        for piece in reversed(cuts):
            found = self.pieces.get(piece)
            if found is None:
                out += self._ids(piece)
            else:
                out.append(found[0])
        return out

    def words(self, text: str) -> list[str]:
        """A text's characters, blanks marked and one put in front, cut before blanks behind which the search starts anew."""
        marked = BLANK + text.replace(" ", BLANK)
        if not self.words_apart:
            return [marked]
        words = marked.split(BLANK)[1:]
        if "" not in words[:-1]:
            return [BLANK + w for w in words]
        # blanks in a row belong to one word
        out, gap = [], 0
        for k, w in enumerate(words):
            gap += 1
            if w or k == len(words) - 1:
                out.append(BLANK * gap + w)
                gap = 0
        return out

    def stretches(self, word: str) -> list[str]:
        """A word cut where no piece holds both neighbours: no position before stays live there."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _search(self, word: str, parts: dict[str, bytes]) -> bytes:
        """A word's ids; `parts` holds those of stretches that have been read."""
        out = []
        for stretch in self.stretches(word):
            ids = parts.get(stretch)
            if ids is None:
                ids = array("I", [i for part in self.stream(stretch) for i in part]).tobytes()
                if len(stretch) <= CACHE_CHARACTERS and len(parts) < CACHE_ENTRIES:
                    parts[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32 bytes; null and empty texts have none."""
        out = []
        cache = self.cache
        for text in texts:
            words = self.words(text) if text else []
            try:
                out.append(b"".join([cache[w] for w in words]))
            except KeyError:
                if len(cache) + len(words) > CACHE_ENTRIES or len(self.parts) >= CACHE_ENTRIES:
                    cache.clear()
                    self.parts.clear()
                new = {w: self._search(w, self.parts) for w in set(words) if w not in cache}
                out.append(b"".join([cache[w] if w in cache else new[w] for w in words]))
                cache.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_CHARACTERS)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: blanks for the blank mark, without the one put in front; bytes that are no UTF-8 become U+FFFD."""
        if self.bytes_of and np.isin(ids, self._byte_array()).any():
            parts = [bytes([self.bytes_of[i]]) if i in self.bytes_of else self.text[i].replace(BLANK, " ").encode() for i in ids.tolist()]
            text = b"".join(parts).decode("utf-8", "replace")
        else:
            text = "".join(map(self.text.__getitem__, ids.tolist())).replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text

    def _byte_array(self) -> np.ndarray:
        return np.fromiter(self.bytes_of, dtype=np.int64)


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_crc32, decoded_crc32, round_trip and, if asked for, ids and the decoded text.

    The checksums are of the ids as little-endian uint32 and of the decoded text as UTF-8. `round_trip`
    tells whether decoding gives the text again; a text with the blank mark itself comes back with
    blanks. A null or empty text has no ids and decodes to the empty text. Repeated rows are encoded one
    by one, a null id stays null, an empty table gives an empty result, other columns are not returned.
    """
    bounded_batches(df.sparkSession)
    schema = "__id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_text else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = piece_model(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            coded = sp.encode(texts)
            ids = [np.frombuffer(c, dtype="<u4") for c in coded]
            back = [sp.decode(i) for i in ids]
            columns = [
                batch.column(0),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                pa.array([zlib.crc32(b.encode()) for b in back], pa.int64()),
                pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
            names = ["__id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(back, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return two_columns(df, id_col, text_col).mapInArrow(work, schema).withColumnRenamed("__id", id_col)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) for an array column of ids; null ids give an empty text."""
    bounded_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = piece_model(model)
        for batch in batches:
            back = [sp.decode(np.asarray(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["__id", "decoded"])

    picked = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    return picked.mapInArrow(work, "__id long, decoded string").withColumnRenamed("__id", id_col)
