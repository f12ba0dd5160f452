"""Removal of passages that an earlier document has too, through a compressed FM-index per shard.

Shards are cut by content, so that work grows with the text and not with shards times documents:

1. Every window of ``window`` words has an anchor: its phrase of ``anchor`` words with the least hash. Equal
   windows have equal anchors, wherever they stand. A document's anchors are few (one in about 22 words).
2. Anchors that occur in one document only can't belong to a repeated window; neither can the windows of the
   anchor's smallest document be repeats. For the others, the text around the anchor (all windows that have it)
   goes to the anchor's shard.
3. A shard's FM-index holds the distinct sequences that may be originals (all but the anchor's last document's);
   the sequences that may be repeats (all but the first document's) are streamed through it by backward search
   over its wavelet tree. Where a matching statistic reaches ``window`` and the least document among the matches
   is smaller than the streamed one, the window's words are to go.
4. An anchor in more than ``hot`` places doesn't fit a shard. Its windows are counted by a 128-bit hash, with map-side
   aggregation, to learn which repeat and which document has them first; from those documents' texts the runs of such
   windows are cut, so that each repeated window is there once. These runs are indexed in parts of bounded size, and
   the anchor's texts are streamed through each part in groups of bounded size: shards as above, but many an anchor.

Words are compared by 64-bit hashes. Spans belong to a doc_id with the hash of its text, so that rows which share a doc_id
are judged each by its own text, and repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex
from .scratch import Scratch, bounded_batches
from .words import _BASE, U, Texts, mix

WINDOW, ANCHOR = 50, 8
#: places of an anchor beyond which it is split by window, and words in one index.
HOT, SHARD_WORDS = 10_000, 250_000
#: words of the repeated windows of a hot anchor that one index holds.
PART_WORDS = 1 << 17
#: windows of one text around an anchor.
LONG = 64
#: texts of a hot anchor that meet a part of its repeated windows, at least, and words of the part for each more of them:
#: an index isn't built for fewer words than it has itself.
SALTED, WORDS_A_TEXT = 1024, 64
INDEX, STREAM, SPLIT = 1, 2, 4


def anchors(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window of a document's words: the anchor's hash."""
    wide = window - anchor + 1
    if len(h) < window:
        return np.zeros(0, U)
    phrase = h[: len(h) - anchor + 1].copy()
    for j in range(1, anchor):
        phrase = phrase * U(_BASE) + h[j : len(h) - anchor + 1 + j]
    phrase = mix(phrase)
    out = np.empty(len(h) - window + 1, U)
    for at in range(0, len(out), 1 << 15):
        view = np.lib.stride_tricks.sliding_window_view(phrase[at : at + (1 << 15) + wide - 1], wide)[: len(out) - at]
        out[at : at + len(view)] = view.min(1)
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each run of windows with equal anchors, and the end of the run.

    In a text that repeats itself, the anchor is another place of the same phrase for each window: still one run.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(key))


def _joined_sha(words: list[bytes]) -> str:
    return sha256(b" ".join(words)).hexdigest()


def _surveyed(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch["text"])
            found = []
            for i in range(len(texts)):
                key = anchors(texts.of(i), window, anchor)
                found.append(key[_runs(key)[0]].view(np.int64))
            offset = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            data = texts.bytes.tobytes()
            sha = [_joined_sha(data[texts.offset[i] : texts.offset[i + 1]].split()) for i in range(len(texts))]
            keys = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["h"], pa.array(texts.counts().astype(np.int64)), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offset, pa.int32()), keys)],
                ["doc_id", "h", "n_words", "sha", "anchors"],
            )

    return run


def _cut(window: int, anchor: int):
    """The text around each anchor that is to be looked at: (anchor, doc, h, first word, role, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, plan = Texts(batch["text"]), batch["plan"]
            docs, hashes = batch["doc_id"].to_pylist(), batch["h"].to_pylist()
            rows: list[tuple] = []
            for i in range(len(texts)):
                key = anchors(texts.of(i), window, anchor)
                first, end = _runs(key)
                # long runs, as of a text that repeats itself, in pieces: streams are stepped together, and all as often as the longest
                many = -(-(end - first) // LONG)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                first, end = np.repeat(first, many) + place * LONG, np.repeat(end, many)
                end = np.minimum(first + LONG, end)
                mine = plan[i].values
                wanted = mine.field("anchor").to_numpy()
                order = np.argsort(wanted)
                wanted, role = wanted[order], mine.field("role").to_numpy()[order]
                own = key[first].view(np.int64)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                for j in np.flatnonzero(wanted[at] == own).tolist():
                    w = texts.cut[i]
                    body = texts.text(w + first[j], w + end[j] + window - 1)
                    rows.append((int(own[j]), docs[i], hashes[i], int(first[j]), int(role[at[j]]), body))
            for at in range(0, len(rows), 20_000):
                columns = list(zip(*rows[at : at + 20_000], strict=True))
                kinds = (*[pa.int64()] * 4, pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "doc", "h", "first", "role", "body"])

    return run


def _match(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """One shard: (doc, h, first word, end word) of each repeated run in rows of (doc, h, first, role, hashes)."""
    owner: dict[bytes, int] = {}
    sequence: dict[bytes, np.ndarray] = {}
    streams: dict[bytes, list[tuple[int, int, int]]] = {}
    for doc, h, first, role, words in rows:
        key = words.tobytes()
        sequence[key] = words
        if role & INDEX:
            owner[key] = min(doc, owner.get(key, doc))
        if role & STREAM:
            streams.setdefault(key, []).append((doc, h, first))
    if not owner or not streams:
        return
    index = FMIndex([sequence[k] for k in owner], np.array(list(owner.values())), window)
    keys = list(streams)
    length, least = index.matching_statistics([sequence[k] for k in keys])
    for k, got, low in zip(keys, length, least, strict=True):
        begins = np.flatnonzero(got >= window)
        if not len(begins):
            continue
        for doc, h, first in streams[k]:
            here = begins[low[begins] < doc]
            if len(here):
                breaks = np.flatnonzero(np.diff(here) > window)
                for a, b in zip(here[np.concatenate([[0], breaks + 1])], here[np.append(breaks, len(here) - 1)], strict=True):
                    yield doc, h, first + int(a), first + int(b) + window


def _sharded(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            out = list(zip(*_match(rows, window), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc", "h", "start", "stop"])

        for batch in batches:
            texts = Texts(batch["body"].cast(pa.string()) if batch.num_rows else pa.array([], pa.string()))
            columns = (batch[c].to_pylist() for c in ("part", "doc", "h", "first", "role"))
            for i, (part, doc, h, first, role) in enumerate(zip(*columns, strict=True)):
                if part != last and held >= SHARD_WORDS:
                    yield flush()
                    rows, held = [], 0
                rows.append((doc, h, first, role, texts.of(i).copy()))
                held, last = held + len(rows[-1][-1]), part
        if rows:
            yield flush()

    return run


def _window_keys(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a batch's rows: row, place in it, and a hash of the words in two halves."""
    h, many = texts.hash, np.maximum(texts.counts() - window + 1, 0)
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = texts.cut[row] + place
    halves = []
    for base in (_BASE, 0xC2B2AE3D27D4EB4F):
        up = np.cumprod(np.concatenate([[U(1)], np.full(len(h), base, U)]))
        down = np.cumprod(np.concatenate([[U(1)], np.full(len(h), pow(base, -1, 1 << 64), U)]))
        total = np.concatenate([[U(0)], np.cumsum(h * up[:-1])])
        halves.append(mix((total[at + window] - total[at]) * down[at]).view(np.int64) if len(at) else np.zeros(0, np.int64))
    return row, place, halves[0], halves[1]


def _windows(window: int):
    """The distinct windows of hot anchors' texts in each batch, with their least and greatest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, high, low = _window_keys(Texts(batch["body"].cast(pa.string())), window)
            order = np.lexsort((low, high))
            row, high, low = row[order], high[order], low[order]
            first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(row) else row
            anchor, doc = (batch[c].to_numpy()[row] for c in ("anchor", "doc"))
            least, most = (f.reduceat(doc, first) if len(first) else doc for f in (np.minimum, np.maximum))
            columns = (anchor[first], high[first], low[first], least, most)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "w1", "w2", "least", "most"])

    return run


def _first_runs(window: int):
    """The runs of windows that are repeated and that no smaller document has, cut from a hot anchor's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, wanted = Texts(batch["body"].cast(pa.string())), [], batch["wanted"]
            row, place, high, _ = _window_keys(texts, window)
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            for i, (anchor, doc) in enumerate(zip(batch["anchor"].to_pylist(), batch["doc"].to_pylist(), strict=True)):
                own = slice(cut[i], cut[i + 1])
                # one half is enough here: whatever a document really has may be indexed as its own
                begins = place[own][np.isin(high[own], wanted[i].values.to_numpy())]
                breaks = np.flatnonzero(np.diff(begins) > 1)
                for a, b in zip(begins[np.concatenate([[0], breaks + 1])], begins[np.append(breaks, len(begins) - 1)], strict=True) if len(begins) else ():
                    n = int(b - a) + window
                    out.append((anchor, doc, n, texts.text(texts.cut[i] + a, texts.cut[i] + a + n)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (*[pa.int64()] * 3, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["anchor", "doc", "words", "body"])

    return run


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = Texts(batch["text"])
        data = texts.bytes.tobytes()
        total, removed, sha, left = [], [], [], []
        for i, spans in enumerate(batch["spans"].to_pylist()):
            n = int(texts.cut[i + 1] - texts.cut[i])
            gone = covered([(x["start"], x["stop"]) for x in spans], n)
            row = data[texts.offset[i] : texts.offset[i + 1] - 1]
            words = row.split()
            total.append(n)
            removed.append(int(gone.sum()))
            sha.append(_joined_sha([w for w, g in zip(words, gone, strict=True) if not g]))
            # the text without the spans: white space outside them stays as it is
            pieces, at, base = [], 0, texts.offset[i]
            step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                pieces.append(row[at : texts.start[texts.cut[i] + a] - base])
                at = texts.end[texts.cut[i] + b - 1] - base
            left.append((b"".join(pieces) + row[at:]).strip())
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array([x.decode() if r else None for x, r in zip(left, removed, strict=True)], pa.string()),
                batch["h"],
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "text_hash"],
        )


def _split(cut: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """Hot anchors' shards: parts of their repeated windows, each with a group of the texts."""
    hot = cut.where(f"role >= {SPLIT}")
    windows = hot.mapInArrow(_windows(window), "anchor long, w1 long, w2 long, least long, most long")
    repeated = windows.groupBy("anchor", "w1", "w2").agg(F.min("least").alias("doc"), F.max("most").alias("most")).where("doc < most")
    wanted = repeated.groupBy("anchor", "doc").agg(F.collect_list("w1").alias("wanted"))
    runs = hot.where(f"role & {INDEX} > 0").select("anchor", "doc", "body").join(wanted, ["anchor", "doc"])
    runs = scratch.write(runs.mapInArrow(_first_runs(window), "anchor long, doc long, words long, body binary"), "runs")
    texts = hot.where(f"role & {STREAM} > 0")
    parts = runs.groupBy("anchor").agg(F.sum("words").alias("words")).join(texts.groupBy("anchor").agg(F.count("*").alias("texts")), "anchor")
    group = F.greatest(F.lit(SALTED), F.least(F.col("words"), F.lit(PART_WORDS)) / WORDS_A_TEXT)
    parts = parts.select("anchor", F.ceil(F.col("words") / PART_WORDS).alias("chunks"), F.ceil(F.col("texts") / group).alias("salts"))

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    known = runs.join(parts, "anchor").withColumn("chunk", F.pmod(F.xxhash64("body"), "chunks")).withColumn("salt", every("salts"))
    asked = texts.join(parts, "anchor").withColumn("salt", F.pmod(F.xxhash64("doc", "first"), "salts")).withColumn("chunk", every("chunks"))
    known = known.withColumns({"h": F.lit(0).cast("long"), "first": F.lit(0).cast("long"), "role": F.lit(INDEX)})
    asked = asked.withColumn("role", F.lit(STREAM))
    columns = [F.xxhash64("anchor", "chunk", "salt").alias("part"), "doc", "h", "first", "role", "body"]
    return known.select(*columns).unionByName(asked.select(*columns))


def repeated_spans(docs: DataFrame, scratch: Scratch, *, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """A survey of all documents (doc_id, h, n_words, sha, anchors) and the repeated spans (doc_id, h, spans).

    ``docs`` has doc_id, h (a hash of the text) and text only. A span is (start, stop) in words, stop not included.
    """
    survey = scratch.write(docs.mapInArrow(_surveyed(window, anchor), "doc_id long, h long, n_words long, sha string, anchors array<long>"), "survey")
    places = survey.select(F.col("doc_id").alias("doc"), "h", F.explode("anchors").alias("anchor"))
    shared = places.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
    shared = shared.where("low < high")
    role = F.expr(f"if(doc < high, {INDEX}, 0) + if(doc > low, {STREAM}, 0) + if(n > {hot}, {SPLIT}, 0)").cast("int")
    plan = places.join(shared, "anchor").select("doc", "h", F.struct("anchor", role.alias("role")).alias("p"))
    plan = scratch.write(plan.groupBy(F.col("doc").alias("doc_id"), "h").agg(F.collect_set("p").alias("plan")), "plan")

    cut = docs.join(plan, ["doc_id", "h"]).mapInArrow(_cut(window, anchor), "anchor long, doc long, h long, first long, role int, body binary")
    cut = scratch.write(cut, "cut")
    shards = cut.where(f"role < {SPLIT}").withColumnRenamed("anchor", "part").unionByName(_split(cut, scratch, window))
    spans = shards.repartition("part").sortWithinPartitions("part").mapInArrow(_sharded(window), "doc long, h long, start long, stop long")
    spans = spans.groupBy(F.col("doc").alias("doc_id"), "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return survey, scratch.write(spans, "spans")


def _own(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which also starts in a document of smaller doc_id.

    Windows are judged on the input. Returns one row per row: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words, joined by one space), kept_text (null if nothing was removed; else the text without the spans), text_hash
    (``xxhash64`` of the row's text). Null, blank and short texts lose nothing. Of rows that share a doc_id, none is a
    repeat of another, and each is judged by its own text. Rows without doc_id can't be named and are left out. Other
    columns are ignored. An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    scratch, docs = Scratch(docs.sparkSession, "substring"), _own(docs)
    survey, spans = repeated_spans(docs, scratch, window=window, anchor=anchor, hot=hot)
    after = docs.join(spans, ["doc_id", "h"]).mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, text_hash long"
    )
    rest = survey.join(spans.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        F.col("sha").alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
        F.col("h").alias("text_hash"),
    )
    return rest.unionByName(after)


SQL = r"""
WITH listed AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  windows AS MATERIALIZED (
    SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM listed)),
  firsts AS MATERIALIZED (SELECT seq, min(doc_id) AS first FROM windows GROUP BY seq),
  covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (seq) WHERE first < doc_id),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM listed),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (doc_id)
"""
