"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes over hashed n-gram and
skip features (the word before, the two before, the second and the third before). The most frequent words are
slots of small head classes; all other words belong to a tail class by their last two bytes, and are distributed in
it by their smoothed counts. Training runs in rounds over disjoint parts of the training documents, which together
are all of them: a round has one task for each core (more, where a task would read over ``TASK_TOKENS``), so that what
the tasks send doesn't grow with the partitions of the input. Each makes AdaGrad steps on its documents, and the tasks'
updates are averaged, row by row, by how often each task used the row. Counts of all words come from one aggregation;
only the ``TOP`` most frequent travel to the tasks, and the counts of the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Scratch, bounded_batches
from .words import U, Texts, mix

#: a model has any number of head classes, which its priors tell: ``HEADS`` is the least, ``score`` takes ``SCORE_HEADS``.
HEADS, SCORE_HEADS, SLOTS, TAILS = 8, 16, 32, 32
CLASSES = HEADS + TAILS
#: rows of the hashed weights of both factors (at least; see ``sized``), words whose counts are sent to every task, rounds, tokens of a step.
ROWS, WORD_ROWS, TOP, ROUNDS, STEP, RATE = 1 << 15, 1 << 14, 1 << 17, 3, 8192, 0.25
FEATURES = 4
#: tokens that a task of a round learns from at most, on average.
TASK_TOKENS = 1 << 29
_BLOCK = 512
#: rows of one weight in a step that are added turn by turn; those of longer runs are added at once.
_LONG_RUN = 16
#: block numbers of the second factor's weights begin here.
_SECOND = 1 << 24
#: hashes that stand for the end of a text and for what lies before its begin.
END, BEGIN = U(0x454E44), U(0x424547494E)
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], U)


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all rows (each row's words, then END), their tail class, and the cut between rows."""
    many = texts.counts()
    cut = texts.cut + np.arange(len(texts) + 1)
    token = np.full(len(texts.hash) + len(texts), END, U)
    tail = np.zeros(len(token), np.int64)
    at = np.arange(len(texts.hash)) + np.repeat(np.arange(len(texts)), many)
    token[at] = texts.hash
    last = _folded(texts.bytes[texts.end - 1]).astype(np.int64)
    before = np.where(texts.end - texts.start > 1, _folded(texts.bytes[np.maximum(texts.end - 2, 0)]), 0).astype(np.int64)
    tail[at] = (last * 31 + before * 17 + (before >> 3)) % TAILS
    return token, tail, cut


def _folded(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b | 0x20, b)


def features(token: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token's history (tokens x FEATURES)."""
    place = np.arange(len(token)) - np.repeat(cut[:-1], np.diff(cut))
    back = []
    for k in (1, 2, 3):
        x = np.full(len(token), BEGIN, U)
        x[k:] = token[:-k] if k < len(token) else token[:0]
        x[place < k] = BEGIN
        back.append(x)
    return np.stack([mix(back[0] * _SALT[0]), mix(back[0] * _SALT[1] + mix(back[1])), mix(back[1] * _SALT[2]), mix(back[2] * _SALT[3])], 1)


@dataclass
class Model:
    """``word`` (sorted hashes), their counts and slots (-1: none) of the TOP words; priors; weights of both factors."""

    word: np.ndarray
    count: np.ndarray
    slot: np.ndarray
    class_prior: np.ndarray
    slot_prior: np.ndarray
    tail_mass: np.ndarray
    weights: np.ndarray
    word_weights: np.ndarray

    def places(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place in ``word`` (-1: not there), and its slot."""
        at = np.minimum(np.searchsorted(self.word, token), len(self.word) - 1)
        at = np.where(self.word[at] == token, at, -1)
        return at, np.where(at >= 0, self.slot[at], -1)

    def log_likelihoods(self, feature: np.ndarray, slot: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Natural log of each token's class and, in head classes, of the word in it."""
        out = np.empty(len(slot))
        for at in range(0, len(slot), STEP):
            own = _Step(self, feature[at : at + STEP], slot[at : at + STEP], tail[at : at + STEP])
            out[at : at + STEP] = np.log(own.p[np.arange(len(own.target)), own.target])
            out[at + own.head] += np.log(own.q[np.arange(len(own.head)), own.word])
        return out


class _Step:
    """The forward pass over some tokens: probabilities of both factors, and the rows of weights they use."""

    def __init__(self, model: Model, feature: np.ndarray, slot: np.ndarray, tail: np.ndarray):
        self.target = np.where(slot >= 0, slot // SLOTS, len(model.slot_prior) + tail)
        self.rows = (feature & U(len(model.weights) - 1)).astype(np.int64)
        self.p = _softmax(_summed(model.weights, self.rows, model.class_prior))
        self.head = np.flatnonzero(slot >= 0)
        self.word = slot[self.head] % SLOTS
        own = self.target[self.head]
        self.word_rows = (mix(feature[self.head] + (own.astype(U) + U(1))[:, None] * _SALT[3]) & U(len(model.word_weights) - 1)).astype(np.int64)
        self.q = _softmax(_summed(model.word_weights, self.word_rows, model.slot_prior[own]))


def _summed(weights: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    for k in range(FEATURES):
        part = weights.take(rows[:, k], axis=0, mode="clip")
        part += out
        out = part
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return np.maximum(x, np.float32(1e-30), out=x)


def _sums(p: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``order[first : first + n]`` of ``p``. Most runs are of one row, so copies of a run are added turn by turn."""
    out = p.take(order[first], axis=0, mode="clip")
    for k in np.flatnonzero(n > _LONG_RUN).tolist():
        out[k] = p.take(order[first[k] : first[k] + n[k]], axis=0, mode="clip").sum(0)
    turn, some = 1, np.flatnonzero((n > 1) & (n <= _LONG_RUN))
    while len(some):
        out[some] += p.take(order[first[some] + turn], axis=0, mode="clip")
        turn += 1
        some = some[n[some] > turn]
    return out


def _ascend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, p: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on the rows that a batch of tokens used; the gradient is the target's indicator less p."""
    p = np.negative(p)
    p[np.arange(len(target)), target] += 1
    for k in range(rows.shape[1]):
        own = rows[:, k]
        order = np.argsort(own.astype(np.uint16), kind="stable")  # by radix: the lower 16 bits, then those above
        for bits in range(16, (len(weights) - 1).bit_length(), 16):
            order = order[np.argsort((own[order] >> bits).astype(np.uint16), kind="stable")]
        where = own[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        gradient = _sums(p, order, first, np.diff(np.append(first, len(where))))
        row = where[first]
        squares[row] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        gradient *= (RATE / np.sqrt(squares[row] + 1.0))[:, None]
        gradient += weights.take(row, axis=0, mode="clip")
        weights[row] = gradient


def _trained(model):
    """One task's updates: its rows' changes times how often it used them, and that number, in blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        own = Model(m.word, m.count, m.slot, m.class_prior, m.slot_prior, m.tail_mass, m.weights.copy(), m.word_weights.copy())
        squares = [np.zeros(len(w), np.float32) for w in (m.weights, m.word_weights)]
        used = [np.zeros(len(w), np.int64) for w in (m.weights, m.word_weights)]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                token, tail, cut = tokens(Texts(batch["text"].slice(start, 256), lower=True))
                feature, slot = features(token, cut), own.places(token)[1]
                seen: tuple[list, list] = ([], [])
                for at in range(0, len(token), STEP):
                    s = _Step(own, feature[at : at + STEP], slot[at : at + STEP], tail[at : at + STEP])
                    _ascend(own.weights, squares[0], s.rows, s.p, s.target)
                    if len(s.head):
                        _ascend(own.word_weights, squares[1], s.word_rows, s.q, s.word)
                    seen[0].append(s.rows.ravel())
                    seen[1].append(s.word_rows.ravel())
                for part, rows in enumerate(seen):
                    used[part] += np.bincount(np.concatenate(rows), minlength=len(used[part])) if rows else 0
        for part, (new, old) in enumerate(((own.weights, m.weights), (own.word_weights, m.word_weights))):
            blocks = [b for b in range(len(new) // _BLOCK) if used[part][b * _BLOCK : (b + 1) * _BLOCK].any()]
            for at in range(0, len(blocks), 64):
                some = blocks[at : at + 64]
                cut_out = [slice(b * _BLOCK, (b + 1) * _BLOCK) for b in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part * _SECOND + b for b in some], pa.int32()),
                        pa.array([(new[c] - old[c]).astype("<f2").tobytes() for c in cut_out], pa.binary()),
                        pa.array([used[part][c].astype("<u4").tobytes() for c in cut_out], pa.binary()),
                    ],
                    ["block", "change", "used"],
                )

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' changes of each block that falls to this task, averaged in a stream."""
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, change, used in zip(*(batch[c].to_pylist() for c in ("block", "change", "used")), strict=True):
            n = np.frombuffer(used, "<u4").astype(np.int64)
            x = np.frombuffer(change, "<f2").reshape(_BLOCK, -1).astype(np.float64) * n[:, None]
            a, b = total.get(block, (0.0, 0))
            total[block] = a + x, b + n
    mean = [(a / np.maximum(b, 1)[:, None]).astype("<f4").tobytes() for a, b in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(mean, pa.binary())], ["block", "change"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token, tail, _ = tokens(Texts(batch["text"], lower=True))
        word, first, n = np.unique(token, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(tail[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "tail", "n"]
        )


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        mass = np.log10(m.tail_mass)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                token, tail, cut = tokens(Texts(part["text"], lower=True))
                at, slot = m.places(token)
                known = at >= 0
                seen = np.where(known, np.log10(m.count[at] + 0.5), 0.0)
                score = m.log_likelihoods(features(token, cut), slot, tail) / np.log(10)
                score += np.where(slot >= 0, 0.0, seen - mass[tail])
                rare = np.flatnonzero(~known)
                where = np.searchsorted(rare, cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["row"],
                        part["doc_id"],
                        pa.array(np.diff(cut)),
                        pa.array(np.add.reduceat(known, cut[:-1], dtype=np.int64)),
                        pa.array(np.add.reduceat(seen, cut[:-1])),
                        pa.array(np.add.reduceat(score, cut[:-1])),
                        pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(token[rare].view(np.int64))),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "seen", "score", "rare"],
                )

    return run


def sized(learnable: int) -> tuple[int, int]:
    """Rows of both factors' weights: a power of two, one at least for each word seen as often as a row has weights."""
    rows = max(ROWS, 1 << max(0, learnable - 1).bit_length())
    return rows, rows * WORD_ROWS // ROWS


def _start(counts: DataFrame) -> tuple[Model, int, int]:
    """The untrained model, whose factors are the smoothed counts; and the numbers of training tokens and of words."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") >= SCORE_HEADS + TAILS).alias("learnable")).first()
    rows, word_rows = sized(int(total["learnable"] or 0))
    # the least count that no more than TOP words reach, from a coarse histogram: nothing is sorted, no task sends its own top
    coarse = F.floor(F.log("n") * 64)
    bins = sorted(((r["b"], r["k"]) for r in counts.groupBy(coarse.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least = max((b for b, k in zip((b for b, _ in bins), np.cumsum([k for _, k in bins]), strict=True) if k > TOP), default=-1)
    top = counts.where((coarse > least) | (F.col("word") == int(END))).toPandas()
    word, n, tail = top["word"].to_numpy(np.int64).view(U), top["n"].to_numpy(np.int64), top["tail"].to_numpy(np.int64)
    slot = np.full(len(word), -1, np.int64)
    order = np.lexsort((word, -n))
    word, n, tail = word[order], n[order], tail[order]
    # END has a slot whatever its count; the most frequent others have the rest
    ranked = np.concatenate([np.flatnonzero(word == END), np.flatnonzero(word != END)])[: SCORE_HEADS * SLOTS]
    ranked = ranked[np.argsort(-n[ranked], kind="stable")]
    slot[ranked] = np.arange(len(ranked))
    mass = {r["tail"]: r["mass"] for r in counts.groupBy("tail").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect()}
    tail_mass = np.array([mass.get(t, 0.0) for t in range(TAILS)]) + 0.5
    np.subtract.at(tail_mass, tail[ranked], n[ranked] + 0.5)
    tail_mass = np.maximum(tail_mass, 0.5)
    slots = np.zeros((SCORE_HEADS, SLOTS))
    slots.reshape(-1)[: len(ranked)] = n[ranked] + 0.5
    heads = slots.sum(1)
    prior = np.log(np.maximum(np.concatenate([heads, tail_mass]), 1e-9))
    inner = np.where(slots > 0, np.log(np.maximum(slots, 1e-9)), -60.0)
    if not len(word):  # nothing was learned: all that is left is the tail classes' mass for unknown words
        word, n, slot = np.ones(1, U), np.zeros(1, np.int64), np.full(1, -1)
    order = np.argsort(word)
    model = Model(
        word[order], n[order], slot[order], prior.astype(np.float32), inner.astype(np.float32), tail_mass,
        np.zeros((rows, SCORE_HEADS + TAILS), np.float32), np.zeros((word_rows, SLOTS), np.float32),
    )
    return model, int(total["n"] or 0), int(total["v"])


def score(docs: DataFrame, training: Column, *, rounds: int = ROUNDS) -> DataFrame:
    """Score whole texts (doc_id long, text string) by a model learned from the rows for which ``training`` holds.

    Tokens are words, in which A-Z count as a-z, and one end for each text; a null text is an end alone. Returns one
    row per input row: doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score (log10, smoothed
    unigrams), score (log10, the model's). Repeated rows are each learned from and each scored. Rows without doc_id
    are left out. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), training.alias("training"))
    learned = rows.where("training")
    counts = learned.select("text").mapInArrow(_counted, "word long, tail int, n long")
    counts = scratch.write(counts.groupBy("word").agg(F.sum("n").alias("n"), F.max("tail").alias("tail")), "counts")
    model, train_tokens, words = _start(counts)
    tasks = max(spark.sparkContext.defaultParallelism, -(-train_tokens // (rounds * TASK_TOKENS)))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = learned.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(rounds)) == turn).select("text")
        changes = part.coalesce(tasks).mapInArrow(_trained(shared), "block int, change binary, used binary")
        changes = scratch.write(changes.repartition("block").mapInArrow(_averaged, "block int, change binary"), f"round-{turn}")
        for r in changes.toLocalIterator():  # as many rows as the weights have blocks
            weights, b = (model.word_weights, r["block"] - _SECOND) if r["block"] >= _SECOND else (model.weights, r["block"])
            weights[b * _BLOCK : (b + 1) * _BLOCK] += np.frombuffer(r["change"], "<f4").reshape(_BLOCK, -1)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    # a row's number is written with its results, so that rows which share a doc_id stay apart
    scored = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _scored(shared), "row long, doc_id long, n_tokens long, known long, seen double, score double, rare array<long>"
    )
    scored = scratch.write(scored, "scored")
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_seen"), F.count("n").alias("rare_known")
    )
    more = F.coalesce("rare_seen", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("seen") + more - F.col("n_tokens") * float(np.log10(train_tokens + 0.5 * (words + 1)))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
