"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm.

Pieces are dealt to shards of bounded size by a hash. Several islands evolve each shard, each in its own task and from
people of its own: a crossover injects whole well-filled bins of one parent into the other, removes the bins that hold
duplicates, and puts the displaced pieces back by best fit; a mutation empties a few bins and fills them again, each as
full as a subset of the pieces can. Between epochs each island's elite migrates to the next island. At the end the loosest
bins of many shards are packed together once more.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import caches
from .scratch import Scratch, bounded_batches

CAPACITY, END = 4096, 1
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 3, 2, 5, 4
#: tokenizer words whose ids one Python worker remembers.
REMEMBERED = 600_000
LOOSE, MERGED = 0.98, 128
#: mutations of a child; bins that one empties besides the emptiest, and pieces that it moves at most.
MUTATIONS, EMPTIED, MOVED = 3, 7, 64

#: Texts of these characters only (ASCII without apostrophe and <, letters of Latin-1) are lower-cased character by
#: character, and cut into words as the tokenizer cuts them by the second pattern. Others are encoded by it whole.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile("[\\t-\\r -&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_WORD = re.compile(f"[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


class _Known(dict):
    """Ids of words. Those not known yet give None, and are noted."""

    def __init__(self):
        self.asked: dict[str, None] = {}

    def __missing__(self, word: str) -> None:
        self.asked[word] = None


# How a tokenizer is described that lower-cases and cuts words as ``_WORD`` does.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def remembers_words(description: str) -> bool:
    """Whether a tokenizer (its file's text) gives a plain text the ids of its words, whose last tokens show that they end."""
    t = json.loads(description)
    cuts = (t.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        (t.get("normalizer") or {}).get("normalizers") == _NORMAL
        and len(cuts) == 2
        and cuts[0].get("type") == "Split"
        and cuts[0].get("pattern") == {"Regex": _SPLIT}
        and (cuts[0].get("behavior"), cuts[0].get("invert")) == ("Removed", True)
        and (cuts[1].get("type"), cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
        and t["model"].get("end_of_word_suffix") == "</w>"
        and not t["model"].get("dropout")
        and not any(_PLAIN.fullmatch(x["content"]) for x in t.get("added_tokens", []))
    )


class Encoder:
    """Ids of whole texts, as little-endian bytes. Of tokenizers that ``remembers_words`` accepts, words are remembered;
    others encode each text whole."""

    def __init__(self, path: str | None = None, description: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if description is None:
            with open(path, encoding="utf-8") as f:
                description = f.read()
        self.tokenizer, self.known, self.by_word = Tokenizer.from_str(description), _Known(), remembers_words(description)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Many words to a text: an id that ends a word shows where the next begins."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        groups = [words[k : k + 64] for k in range(0, len(words), 64)]
        for group, raw in zip(groups, self._whole([" ".join(g) for g in groups]), strict=True):
            cut = (4 * np.concatenate([[0], np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1])).tolist()
            if len(cut) == len(group) + 1 and cut[-1] == len(raw):
                self.known.update((x, raw[i:j]) for x, i, j in zip(group, cut, cut[1:], strict=False))
            else:
                self.known.update(zip(group, self._whole(group), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        known = self.known
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t)]
        out = [b""] * len(texts)
        split = [_WORD.findall(texts[i].lower()) for i in plain]
        parts = [list(map(known.__getitem__, s)) for s in split]
        if known.asked:
            asked, known.asked = list(known.asked), {}
            self._learn(asked)
            parts = [[known[w] if x is None else x for w, x in zip(s, p, strict=True)] if None in p else p for s, p in zip(split, parts, strict=True)]
        for i, p in zip(plain, parts, strict=True):
            out[i] = b"".join(p)
        rest = sorted(set(range(len(texts))) - set(plain))
        for i, raw in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            out[i] = raw
        return out


def _pieces(description, key: int, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = caches.only(("encoder", key), lambda: Encoder(description=description.value))  # a worker keeps it from task to task
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for begin in range(0, batch.num_rows, 256):
                own = batch.slice(begin, 256)
                for doc, ids in zip(own["doc_id"].to_pylist(), encode([t or "" for t in own["text"].to_pylist()]), strict=True):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def best_fit(length: np.ndarray, items: np.ndarray, bin_of: np.ndarray, free: list[int], capacity: int) -> None:
    """Put each of ``items``, in that order, into the fullest open bin that takes it; ``free`` holds bins' room."""
    room = sorted((f, b) for b, f in enumerate(free) if 0 < f < capacity)
    empty = [b for b, f in enumerate(free) if f == capacity]
    for i in items.tolist():
        n = int(length[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            f, b = room.pop(at)
        elif empty:
            f, b = capacity, empty.pop()
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        free[b] = f - n
        bin_of[i] = b
        if f > n:
            insort(room, (f - n, b))


def _dense(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].reshape(-1).astype(np.int64)


def fitness(length: np.ndarray, bin_of: np.ndarray, capacity: int) -> float:
    """Fewer bins first; of equals, the more uneven filling (which leaves the emptiest bins to be emptied)."""
    fill = np.bincount(bin_of, length) / capacity
    return -float(len(fill)) + float((fill**2).mean()) if len(fill) else 0.0


def decreasing(length: np.ndarray, capacity: int, noise: float = 0.0, random: np.random.Generator | None = None) -> np.ndarray:
    """Best fit in order of decreasing length, or of lengths blurred by ``noise``."""
    key = length * (1 + noise * random.standard_normal(len(length))) if random is not None and noise else length
    bin_of = np.zeros(len(length), np.int64)
    best_fit(length, np.argsort(-key, kind="stable"), bin_of, [], capacity)
    return bin_of


def crossover(length: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """A child of two packings: some well-filled bins of the donor whole, what is left of the other, the rest by best fit."""
    fill = np.bincount(donor, length)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = np.zeros(len(fill), bool)
    taken[random.choice(good, max(1, len(good) // 3), replace=False)] = True
    moved = taken[donor]
    hit = np.zeros(int(into.max()) + 1, bool)
    hit[into[moved]] = True
    # mutation: the emptiest of the other's bins is emptied too
    own = np.bincount(into, length)
    hit[np.where(hit, np.inf, own).argmin()] = True
    kept = ~hit[into]
    child = np.full(len(length), -1, np.int64)
    child[kept] = _dense(into[kept])
    base = int(child.max()) + 1 if kept.any() else 0
    child[moved] = _dense(donor[moved]) + base
    count = int(child.max()) + 1 if (kept | moved).any() else 0
    free = (capacity - np.bincount(child[child >= 0], length[child >= 0], minlength=count)).astype(int).tolist()
    rest = np.flatnonzero(child < 0)
    best_fit(length, rest[np.argsort(-length[rest], kind="stable")], child, free, capacity)
    return _dense(child)


def fullest(length: list[int], room: int) -> list[int]:
    """Places of a subset of ``length`` whose sum is the greatest that fits ``room``."""
    mask = (1 << room + 1) - 1
    reach = [1]  # bit x: some of the first pieces add up to x
    for n in length:
        reach.append((reach[-1] | reach[-1] << n) & mask)
        if reach[-1] >> room:
            break
    left, out = reach[-1].bit_length() - 1, []
    for k in range(len(reach) - 2, -1, -1):
        if not reach[k] >> left & 1:
            out.append(k)
            left -= length[k]
    return out


def mutated(length: np.ndarray, bin_of: np.ndarray, capacity: int, random: np.random.Generator) -> np.ndarray:
    """A packing whose emptiest bin and a few others are filled anew, if that makes it fitter; else itself."""
    fill = np.bincount(bin_of, length)
    bins = np.unique(np.append(random.integers(len(fill), size=EMPTIED), fill.argmin()))
    moved = np.flatnonzero(np.isin(bin_of, bins))
    if len(moved) > MOVED:
        return bin_of
    left = moved[np.argsort(-length[moved], kind="stable")].tolist()
    sums, child, number = [], bin_of.copy(), len(fill)
    while left:
        first, *rest = left
        random.shuffle(rest)
        taken = fullest(length[rest].tolist(), int(capacity - length[first]))
        own = [first, *(rest[k] for k in taken)]
        child[own] = number
        number += 1
        sums.append(int(length[own].sum()))
        left = sorted(set(left) - set(own), key=lambda i: -length[i])
    before = (-len(bins), float((fill[bins] ** 2).sum()))
    return _dense(child) if (-len(sums), float((np.array(sums, float) ** 2).sum())) > before else bin_of


def evolve(
    length: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, plain: bool = True
) -> np.ndarray:
    """The best packing after some generations (one at least) of a small population that starts from the elites.

    ``plain``: best fit decreasing is among the first people; others come from blurred lengths.
    """
    random = np.random.default_rng(seed)
    people = list(elites) or [decreasing(length, capacity)] * plain
    bound = -(-int(length.sum()) // capacity)
    while len(people) < POPULATION:
        people.append(decreasing(length, capacity, 0.05 * (len(people) + 1), random))
    score = [fitness(length, p, capacity) for p in people]
    for _ in range(generations):
        order = np.argsort(score)[::-1]
        a, b = order[0], order[1 + random.integers(len(people) - 1)]
        for into, donor in ((a, b), (b, a)):
            child = crossover(length, people[into], people[donor], capacity, random)
            for _ in range(MUTATIONS):
                child = mutated(length, child, capacity, random)
            value, worst = fitness(length, child, capacity), int(np.argmin(score))
            # of equals the child, so that a population goes on moving
            if value >= score[worst]:
                people[worst], score[worst] = child, value
        if -max(score) <= bound:  # no packing has fewer bins
            break
    return people[int(np.argmax(score))]


def _ordered(items: pa.Table) -> pa.Table:
    return items.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])


def _epoch(capacity: int, turn: int):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table, elites: pa.Table) -> pa.Table:
        shard, island = (x.as_py() for x in key)
        length = _ordered(items)["length"].to_numpy()
        came = [np.frombuffer(x, "<i4").astype(np.int64) for x in elites["bins"].to_pylist()]
        best = evolve(length, came, capacity, hash((shard, island, turn)) % (1 << 32), plain=island == 0) if len(length) else np.zeros(0, np.int64)
        return pa.table(
            {
                "shard": pa.array([shard], pa.int64()),
                "island": pa.array([island], pa.int32()),
                "value": [fitness(length, best, capacity)],
                "bins": pa.array([best.astype("<i4").tobytes()], pa.binary()),
            }
        )

    return run


def _placed(items: pa.Table, length: np.ndarray, bin_of: np.ndarray, base: int) -> pa.Table:
    """The items with their sequence, place in it and its filling."""
    order = np.argsort(bin_of, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    first = np.concatenate([[True], bin_of[order][1:] != bin_of[order][:-1]])
    begin = np.maximum.accumulate(np.where(first, before, 0))
    offset = np.empty(len(length), np.int64)
    offset[order] = before - begin
    fill = np.bincount(bin_of, length)[bin_of].astype(np.int64)
    items = items.select(["doc_id", "piece", "start", "length", "ids_crc32", "shard"])
    for name, x in (("sequence_id", bin_of + base), ("offset", offset), ("filled", fill)):
        items = items.append_column(name, pa.array(x.astype(np.int64)))
    return items


def _unpacked(items: pa.Table, elites: pa.Table) -> pa.Table:
    items = _ordered(items)
    at = int(np.argmax(elites["value"].to_numpy()))
    bin_of = np.frombuffer(elites["bins"][at].as_py(), "<i4").astype(np.int64)
    return _placed(items, items["length"].to_numpy(), bin_of, int(elites["shard"][0].as_py()) << 32)


def _repacked(capacity: int):
    """Loose bins of several shards, packed together if that saves any."""

    def run(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
        items = _ordered(items)
        length = items["length"].to_numpy()
        now = decreasing(length, capacity)
        if now.max() + 1 >= len(np.unique(items["sequence_id"].to_numpy())):
            return items
        return _placed(items, length, now, (key[0].as_py() << 32) + (1 << 62))

    return run


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, shard long, sequence_id long, offset long, filled long"


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, shard: int = SHARD) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens. ``tokenizer``: a file on the driver.

    A document is its ids, then ``end``; a null or empty text is ``end`` alone. Only a document longer than a sequence
    is cut. Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are
    packed each. Rows without doc_id are left out. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    with open(tokenizer, encoding="utf-8") as f:
        description = f.read()
    shared = spark.sparkContext.broadcast(description)
    pieces = rows.mapInArrow(_pieces(shared, crc32(description.encode()), capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = scratch.write(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    islands = F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island")
    items = pieces.select("shard", islands, "doc_id", "piece", "length")
    elites = spark.createDataFrame([], "shard long, island int, value double, bins binary")
    for turn in range(EPOCHS):
        # the elite of the island before joins the island's own
        came = elites.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), "bins").unionByName(elites.select("shard", "island", "bins"))
        grown = items.groupBy("shard", "island").cogroup(came.groupBy("shard", "island"))
        elites = scratch.write(grown.applyInArrow(_epoch(capacity, turn), elites.schema), f"elites-{turn}")
    placed = pieces.groupBy("shard").cogroup(elites.groupBy("shard")).applyInArrow(_unpacked, _OUT)
    placed = scratch.write(placed, "placed")
    tight = F.col("filled") >= int(LOOSE * capacity)
    loose = placed.where(~tight).groupBy(F.floor(F.col("shard") / MERGED).alias("band")).applyInArrow(_repacked(capacity), _OUT)
    return placed.where(tight).unionByName(loose).drop("shard", "filled")
