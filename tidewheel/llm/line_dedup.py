"""Line deduplication by pairwise alignment.

Documents that share lines are found through line hashes: each is paired with the first document that has the line, and
with the first that has a run of lines of just enough words, from each line on and up to each line; so pairs grow with
the lines and not with the square of a line's documents, and every block that any earlier document has brings a document
together with one that has it, or its parts. Each pair is aligned by patience diff over line hashes, and aligned blocks
are deleted from the later document. Blocks that stand in another order can't be aligned together; what is left of them
is deleted by their runs, which are the exact check after the alignment. Documents of identical lines are one class: only
its first is aligned, the others lose all that they share with it, which is everything.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, bounded_batches

#: a block has so many words at least.
BLOCK_WORDS = 10
#: lines in more documents than this are joined by broadcast: they are few, and none of them gathers in one task.
HOT = 10_000
#: and so many of them at most: where there would be more, it takes more documents to be one.
BROADCAST = 500_000


def line_hash(line: bytes) -> int:
    """Of the line's words, whatever white space lies between; 0 for a blank line."""
    words = line.split()
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) or 1 if words else 0


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first) in which the second rises."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [y], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], rising in both: common ends first, then lines unique in both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while m > i and n > j and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        where = {x: y for y, x in enumerate(b[j:n], j) if in_b[x] == 1}
        anchors = _longest_rising([(k, where[x]) for k, x in enumerate(a[i:m], i) if in_a[x] == 1 and x in where])
        for x, y in anchors:
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        if anchors:
            todo.append((i, m, j, n))
    return sorted(out)


def blocks(matches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs (first, length) of matches that follow each other on both sides, as places of the first side."""
    out: list[tuple[int, int]] = []
    for k, (i, j) in enumerate(matches):
        if k and matches[k - 1] == (i - 1, j - 1):
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((i, 1))
    return out


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, h, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "h", "text")), strict=True):
            raw = (text or "").encode()
            lines = [x for x in raw.split(b"\n") if x.split()]
            hashes = [line_hash(x) for x in lines]
            same = blake2b(np.array(hashes, "<i8").tobytes(), digest_size=16).digest()
            rows.append((doc, h, hashes, [len(x.split()) for x in lines], same, len(text or ""), sha256(raw).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "h", "lines", "words", "same", "n_chars", "sha"])


def least_runs(words: list[int], block_words: int) -> list[tuple[int, int]]:
    """Runs (first, end) of just so many words: the shortest from each line on, and the shortest up to each line."""
    total = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    at = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + block_words)
    first = np.searchsorted(total, total[1:] - block_words, side="right") - 1
    runs = [(i, e) for i, e in zip(at.tolist(), end.tolist(), strict=True) if e <= len(words)]
    return sorted({*runs, *((f, i + 1) for i, f in zip(at.tolist(), first.tolist(), strict=True) if f >= 0)})


def _keyed(block_words: int):
    """A row for each least run of a document: its key (of the hashes of its lines), first line and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # a batch's lines have many times its size as rows
                out: list[tuple[int, int, int, int, int]] = []
                part = batch.slice(start, 64)
                for doc, part_of, lines, words in zip(*(part[c].to_pylist() for c in ("doc", "h", "lines", "words")), strict=True):
                    raw = np.array(lines, "<i8").tobytes()
                    for first, end in least_runs(words, block_words):
                        key = blake2b(raw[8 * first : 8 * end], digest_size=8).digest()
                        out.append((doc, part_of, int.from_bytes(key, "little", signed=True), first, end))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc", "h", "run", "first", "end"])

    return run


def _aligned(block_words: int):
    """The lines (places among non-blank lines) that each pair deletes from its later document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes, gone = [], [], []
            columns = (batch[c].to_pylist() for c in ("doc", "h", "lines", "words", "other"))
            for doc, h, lines, words, other in zip(*columns, strict=True):
                found = [
                    k for first, n in blocks(patience(lines, other)) if sum(words[first : first + n]) >= block_words for k in range(first, first + n)
                ]
                if found:
                    docs.append(doc)
                    hashes.append(h)
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc", "h", "gone"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, h, text, gone, n in zip(*(batch[c].to_pylist() for c in ("doc_id", "h", "text", "gone", "n_aligned")), strict=True):
            drop, place, kept = set(gone), -1, []
            for line in (text or "").encode().split(b"\n"):
                place += bool(line.split())
                if not line.split() or place not in drop:
                    kept.append(line)
            raw = b"\n".join(kept)
            out.append((doc, place + 1, len(drop), n, len(raw.decode()), sha256(raw).hexdigest(), raw.decode(), h))
        columns = list(zip(*out, strict=True)) or [()] * 8
        kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            ["doc_id", "n_lines", "n_removed", "n_aligned", "kept_chars", "kept_sha256", "kept_text", "text_hash"],
        )


def _owned(scratch: Scratch, places: DataFrame, key: str, hot: int) -> DataFrame:
    """The places (doc, key, ..) whose key an earlier document has, with the first that has it (owner)."""
    owners = places.groupBy(key).agg(F.min("doc").alias("owner"), F.count("*").alias("docs"), F.max("doc").alias("last"))
    owners = scratch.write(owners.where("last > owner").drop("last"), f"{key}-owners")
    total = owners.agg(F.sum("docs").alias("n")).first()["n"] or 0
    hot = max(hot, total // BROADCAST)  # no more than BROADCAST keys have so many
    many = F.broadcast(owners.where(F.col("docs") > hot).drop("docs"))
    few = places.join(many.select(key), key, "left_anti").join(owners.where(F.col("docs") <= hot).drop("docs"), key)
    return places.join(many, key).unionByName(few).where("doc > owner")


def remove_shared_lines(docs: DataFrame, *, block_words: int = BLOCK_WORDS, hot: int = HOT) -> DataFrame:
    """Delete from each document (doc_id, text) the blocks of lines that an earlier one (smaller doc_id) has too.

    Blank lines are neither compared nor deleted; lines are equal if their words are. Blocks are judged on the input.
    Returns one row per row: doc_id, n_lines (not blank), n_removed, n_aligned (those that an alignment removed, or that
    a copy lost as a whole), kept_chars, kept_sha256 (of the text that is left, its lines joined as they were), kept_text
    (null if nothing was deleted), text_hash (``xxhash64`` of the row's text). Null texts are empty. Of rows that share a
    doc_id, none is earlier than another, and each is judged by its own text. Rows without doc_id are left out. Other
    columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    survey = docs.mapInArrow(_surveyed, "doc_id long, h long, lines array<long>, words array<int>, same binary, n_chars long, sha string")
    survey = scratch.write(survey, "survey")
    # a class is known by its first row's doc_id and text
    classes = survey.where("size(lines) > 0").groupBy("same").agg(F.min(F.struct(F.col("doc_id").alias("doc"), F.col("h").alias("part"))).alias("c"))
    classes = scratch.write(classes.select("same", "c.doc", "c.part"), "classes")
    firsts = survey.withColumnsRenamed({"doc_id": "doc", "h": "part"}).join(classes.drop("same"), ["doc", "part"], "left_semi")
    firsts = scratch.write(firsts.select("doc", F.col("part").alias("h"), "lines", "words").dropDuplicates(["doc", "h"]), "firsts")

    places = firsts.select("doc", "h", F.explode(F.array_distinct("lines")).alias("line"))
    runs = scratch.write(firsts.mapInArrow(_keyed(block_words), "doc long, h long, run long, first int, end int"), "runs")
    runs = scratch.write(_owned(scratch, runs, "run", hot).drop("run"), "repeated")
    pairs = _owned(scratch, places, "line", hot).select("doc", "h", "owner").unionByName(runs.select("doc", "h", "owner")).distinct()
    both = scratch.write(pairs, "pairs").join(firsts, ["doc", "h"]).join(firsts.select(F.col("doc").alias("owner"), F.col("lines").alias("other")), "owner")
    aligned = both.select("doc", "h", "lines", "words", "other").mapInArrow(_aligned(block_words), "doc long, h long, gone array<int>")
    runs = runs.select("doc", "h", F.sequence("first", F.col("end") - 1).alias("gone"))
    found = aligned.withColumn("by", F.lit(0)).unionByName(runs.withColumn("by", F.lit(1))).groupBy("doc", "h")

    def lines_of(by: int | None):
        own = F.col("gone") if by is None else F.when(F.col("by") == by, F.col("gone"))
        return F.array_distinct(F.flatten(F.collect_list(own)))

    gone = scratch.write(found.agg(lines_of(None).alias("gone"), F.size(lines_of(0)).alias("n_aligned")), "gone")

    # later members of a class: all lines, as one aligned block; of fewer words than a block has, the class loses nothing
    total = F.aggregate("words", F.lit(0), lambda a, x: a + x)
    members = survey.where(total >= block_words).join(classes, "same").select("doc_id", "h", "doc", "part", F.size("lines").alias("n"))
    copies = members.where("doc_id <> doc").select("doc_id", "h", F.sequence(F.lit(0), F.col("n") - 1).alias("gone"), F.col("n").alias("n_aligned"))
    own = members.where("doc_id = doc").join(gone.withColumnsRenamed({"h": "part"}), ["doc", "part"]).select("doc_id", "h", "gone", "n_aligned")
    every = scratch.write(own.unionByName(copies).dropDuplicates(["doc_id", "h"]), "every")
    after = docs.join(every, ["doc_id", "h"]).mapInArrow(
        _kept,
        "doc_id long, n_lines long, n_removed long, n_aligned long, kept_chars long, kept_sha256 string, kept_text string, text_hash long",
    )
    none = F.lit(0).cast("long")
    rest = survey.join(every.select("doc_id", "h"), ["doc_id", "h"], "left_anti").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        none.alias("n_removed"),
        none.alias("n_aligned"),
        F.col("n_chars").alias("kept_chars"),
        F.col("sha").alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
        F.col("h").alias("text_hash"),
    )
    return rest.unionByName(after)
