"""SentencePiece encoding and decoding of whole texts.

An Aho-Corasick automaton over the pieces reads a text once. At each place, its output links give all pieces that
end there, and the best way to that place is relaxed over them:

* models of kind unigram: the sum of the pieces' scores, an unknown character being dearer than any piece;
* models of kind BPE: merging has one result, so the way is the piece that merging leaves last. A piece may follow
  another if no merge across the seam comes before those that build the two.

Unknown characters become byte pieces where the model has these. Results equal the library's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import caches
from .scratch import bounded_batches

SPACE = "▁"
_UNIGRAM, _BPE = 1, 2
_CACHE = 700_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            at += size
            yield key >> 3, raw[at - size : at]


@dataclass
class Vocabulary:
    """Pieces, scores and kind of a model; ``prefix``: a space is put before each text."""

    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    kind: int
    prefix: bool = True
    unknown: int = 0
    byte: dict[int, int] = field(default_factory=dict)

    @classmethod
    def read(cls, model: bytes) -> Vocabulary:
        out = cls([], [], [], _UNIGRAM)
        for key, value in _fields(model):
            if key == 1:
                own = dict(_fields(value))
                piece, kind = own.get(1, b"").decode(), own.get(3, 1)
                if kind == 2:
                    out.unknown = len(out.pieces)
                elif kind == 6:
                    out.byte[int(piece[3:5], 16)] = len(out.pieces)
                out.pieces.append(piece)
                out.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                out.normal.append(kind in (1, 4))
            elif key == 2:
                out.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif key == 3:
                own = dict(_fields(value))
                if own.get(2) or own.get(4, 1):
                    raise ValueError("only models that leave texts as they are can be used here: no character map, no removal of spaces")
                out.prefix = bool(own.get(3, 1))
        return out


class _Words(dict):
    """Ids of words with one space before them, found when first asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) > _CACHE:
            self.clear()
        codec = self.codec
        if codec.by_line and "\n" in word:
            first, *rest = word.split("\n")
            lines = [self[first] if first else codec.cached(SPACE), *map(codec.cached, rest)]
            ids = codec.cached("\n").join(lines)
        else:
            ids = np.array(codec.unit(SPACE + word), "<u4").tobytes()
        self[word] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.id = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i]}
        self.score = vocabulary.scores
        self.unknown_score = min((s for s, n in zip(self.score, vocabulary.normal, strict=True) if n), default=0.0) - 10
        self.automaton = ahocorasick.Automaton()
        if vocabulary.kind == _BPE:
            self._merge_tables()
        for p, i in self.id.items():
            if vocabulary.kind != _BPE or i in self.left:
                self.automaton.add_word(p, (i, len(p)))
        if len(self.automaton):
            self.automaton.make_automaton()
        # units can be encoded each by itself if no piece has a space after another character
        self.by_unit = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        # nor can a merge cross a line's end if no piece has one; if it is bytes, these stand by themselves
        self.by_line = bool(vocabulary.byte) and not any("\n" in p for p in self.id)
        self.known: dict[str, bytes] = {}
        self.words = _Words(self)
        self.seam: dict[tuple[int, int], bool] = {}
        raw = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(vocabulary.pieces, vocabulary.normal, strict=True)]
        raw[vocabulary.unknown] = " ⁇ ".encode()
        for b, i in vocabulary.byte.items():
            raw[i] = bytes([b])
        self.raw = raw

    # -- merging -------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The symbols that merging leaves: best score first, of equals the leftmost. Time grows as n log n."""
        id, score = self.id, self.score
        symbols: list[str | None] = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-score[id[a + b]], k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in id]
        heapify(queue)
        while queue:
            _, k, a, b = heappop(queue)
            j = after[k]
            if symbols[k] != a or j >= n or symbols[j] != b:  # one of the two has been merged
                continue
            symbols[k], symbols[j] = a + b, None
            after[k] = to = after[j]
            if to < n:
                before[to] = k
                if (pair := a + b + symbols[to]) in id:
                    heappush(queue, (-score[id[pair]], k, a + b, symbols[to]))
            if (at := before[k]) >= 0 and (pair := symbols[at] + a + b) in id:
                heappush(queue, (-score[id[pair]], at, symbols[at], a + b))
        return [x for x in symbols if x is not None]

    def _merge_tables(self) -> None:
        """For each piece that merging makes of its own characters: the chains of symbols at its two ends.

        ``left[i]`` and ``right[i]`` hold (rank, symbol) in order of creation; the rank is the score, negated.
        """
        self.left: dict[int, list[tuple[float, str]]] = {}
        self.right: dict[int, list[tuple[float, str]]] = {}
        self.plain = True  # every symbol is made after its parts
        for p, i in sorted(self.id.items(), key=lambda x: len(x[0])):
            symbols, left, right, last = list(p), [(-float("inf"), p[0])], [(-float("inf"), p[-1])], -float("inf")
            while len(symbols) > 1:
                found = [(-self.score[self.id[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.id]
                if not found:
                    break
                rank, k = min(found)
                self.plain &= rank >= last or len(found) == 0
                last = max(last, rank)
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                if k == 0:
                    left.append((last, symbols[0]))
                if k == len(symbols) - 1:
                    right.append((last, symbols[-1]))
            if len(symbols) == 1:
                self.left[i], self.right[i] = left, right

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' joined characters leaves just the two."""
        got = self.seam.get((a, b))
        if got is None:
            if len(self.seam) > _CACHE:
                self.seam.clear()
            got = self.seam[a, b] = self._seam(self.right[a], self.left[b])
        return got

    def _seam(self, ends: list[tuple[float, str]], begins: list[tuple[float, str]]) -> bool:
        i = j = 0
        while True:
            cross = self.id.get(ends[i][1] + begins[j][1])
            after = ends[i + 1][0] if i + 1 < len(ends) else float("inf")
            over = begins[j + 1][0] if j + 1 < len(begins) else float("inf")
            if cross is not None:
                rank = -self.score[cross]
                if rank < after and rank <= over:  # the merge in the left piece is further left, so it goes first
                    return False
            if after == over == float("inf"):
                return True
            if after <= over:
                i += 1
            else:
                j += 1

    # -- encoding ------------------------------------------------------------------------------------------

    def unit(self, text: str) -> list[int]:
        """Ids of normalised text."""
        if self.v.kind == _BPE and (not self.plain or text[:2] == SPACE * 2):  # runs of spaces have pieces of equal score
            symbols = self.merged(text)
            return self._without_unknown(text, [self.id.get(x, -1) for x in symbols], [len(x) for x in symbols])
        n, unknown = len(text), self.unknown_score
        back = [-1] * (n + 1)  # the piece by which each place is best reached
        size = [1] * (n + 1)
        ends = self.automaton.iter(text) if len(self.automaton) else iter(())
        if self.v.kind == _BPE:
            seam = self.seam
            for end, (i, k) in ends:
                end += 1
                if back[end] < 0:  # else its piece is known: there is but one
                    before = back[end - k] if end > k else -1  # the begin, and unknown characters, may be followed by any
                    if before < 0 or (seam[before, i] if (before, i) in seam else self._may_follow(before, i)):
                        back[end], size[end] = i, k
        else:
            best = [0.0] * (n + 1)
            reached = 0
            for end, (i, k) in ends:
                end += 1
                while reached < end:  # an unknown character is a way to each place
                    reached += 1
                    best[reached] = best[reached - 1] + unknown
                value = best[end - k] + self.score[i]
                if value > best[end] or value == best[end] and back[end] < 0:
                    best[end], back[end], size[end] = value, i, k
            # what comes after the last piece is unknown: nothing to relax there
        ids, sizes, at = [], [], n
        while at:
            ids.append(back[at])
            sizes.append(size[at])
            at -= size[at]
        return self._without_unknown(text, ids[::-1], sizes[::-1])

    def _without_unknown(self, text: str, ids: list[int], sizes: list[int]) -> list[int]:
        if min(ids, default=0) >= 0:
            return ids
        out, at, before = [], 0, False
        for i, k in zip(ids, sizes, strict=True):
            if i >= 0:
                out.append(i)
            elif self.v.byte:
                out += [self.v.byte[b] for b in text[at : at + k].encode()]
            elif not before:  # neighbours that are unknown are one
                out.append(self.v.unknown)
            before, at = i < 0, at + k
        return out

    def cached(self, unit: str) -> bytes:
        ids = self.known.get(unit)
        if ids is None:
            if len(self.known) > _CACHE:
                self.known.clear()
            ids = self.known[unit] = np.array(self.unit(unit), "<u4").tobytes() if unit else b""
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.by_unit and self.v.prefix and SPACE not in text and "" not in (words := text.split(" ")):
            return b"".join(list(map(self.words.__getitem__, words)))  # one space before each word
        text = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        if not self.by_unit:
            return np.array(self.unit(text), "<u4").tobytes()
        # a unit: spaces, then all up to the next space
        parts, out, spaces = text.split(SPACE), [], 0
        for k, part in enumerate(parts):
            if k:
                spaces += 1
            if part or k == len(parts) - 1:
                unit = SPACE * spaces + part
                spaces = 0
                out.append(self.cached(unit))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        if self.v.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def _codec(model) -> Codec:
    return caches.only(("codec", model.id), lambda: Codec(Vocabulary.read(model.value)))


class _Shared:
    """A model's bytes as a broadcast variable, with a key by which workers keep what they built of it."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _shared(df: DataFrame, path: str) -> _Shared:
    with open(path, "rb") as f:
        model = f.read()
    return _Shared(df.sparkSession.sparkContext.broadcast(model), crc32(model))


def _encoded(model: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_ids", "ids"]
            )

    return run


def _decoded(model: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [codec.decode(x or b"") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Ids of each whole text: doc_id, n_ids, ids (binary: little-endian 32-bit numbers; null texts count as empty).

    ``model`` is the path of a SentencePiece model file on the driver. Repeated rows are each encoded; other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encoded(_shared(docs, model)), "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of ids as ``encode`` returns them: doc_id, text. Null ids give an empty text.

    The text is the encoded one, but that the model can't tell U+2581 from a space.
    """
    bounded_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decoded(_shared(encoded, model)), "doc_id long, text string")


def _tripped(model: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = [codec.encode(t) for t in texts]
            back = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([crc32(x) for x in ids], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    pa.array([crc32(x.encode()) for x in back], pa.int64()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "restored", "text_crc32"],
            )

    return run


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_ids, ids_crc32 (unsigned, of the ids' bytes), restored (whether the
    decoded text is the text), text_crc32 (of the decoded text in UTF-8).

    One row for each row: repeated rows and rows without doc_id are each encoded. A null or empty text has no ids, and
    an empty text is what these decode to. Other columns are ignored; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_tripped(_shared(docs, model)), "doc_id long, n_ids long, ids_crc32 long, restored boolean, text_crc32 long")
