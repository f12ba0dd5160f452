"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

1. Each document's set of word shingles gets a SuperMinHash signature (Ertl 2017): every element walks through
   one random permutation of the slots, so an element's ranks are correlated and the estimate's variance is
   below MinHash's; a document stops as soon as no further step can lower a slot.
2. Documents with identical sets are one class; one document stands for it. Signatures are cut into bands.
3. In each bucket every member is paired with the smallest one only (a star: rows grow with members, not with
   pairs), and each pair is confirmed on full sets. Links are grouped by union-find.
4. A star can miss the link of two members that are both unlike the smallest. So buckets that still hold more
   than one group are taken up again: signatures name the members that may be similar to a member of another
   group, and those are compared, on full sets, with the whole of that group. Both sides are cut into blocks, so that
   a task holds two blocks, however many members there are. Nothing is capped.

Two documents of similarity s share no bucket with probability (1 - s**rows)**bands: 5e-6 at 0.8 with 40 bands
of 6; a candidate of step 4 is left out if its estimate is more than 0.15 below the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .scratch import Scratch, bounded_batches
from .words import U, Texts, mix, shingles

BANDS, ROWS = 40, 6
SLACK = 0.15
#: signatures of one side that a task compares, and texts.
BLOCK, TEXTS = 2048, 512
#: ids that may be broadcast to filter the texts (8 bytes each); beyond it, a shuffled join does the same.
BROADCAST_IDS = 1_000_000


def _step(j: int) -> np.uint64:
    return U(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64))


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (uint64, len(sets) x slots) of sets of distinct hashes; an empty set's are all ones.

    A slot's value is j + r for the step j at which an element came to it and a random r in [0, 1), in fixed
    point: j << 48 | r.
    """
    assert slots <= 256
    out = np.full((len(sets), slots), ~U(0), U)
    flat = out.reshape(-1)
    live = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    order: np.ndarray | None = None
    element = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, U)
    row = np.repeat(live, [len(sets[i]) for i in live]) if len(live) else np.zeros(0, np.int64)
    for j in range(slots):
        if not len(element):
            break
        random = mix(element + _step(j))
        k = j + ((random >> U(48)) * U(slots - j) >> U(16)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if order is None:  # step 0 of those that go on: slots 0 and k0 change places
                first = ((mix(element + _step(0)) >> U(48)) * U(slots) >> U(16)).astype(np.int64)
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
                at = np.arange(len(element))
                order[at, first], order[:, 0] = 0, first
            at = np.arange(len(element))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, j]
            order[at, j] = slot
        np.minimum.at(flat, row * slots + slot, U(j) << U(48) | random & U((1 << 48) - 1))
        done = out[live].max(1) < U(j + 1) << U(48)
        if done.any():
            gone = np.zeros(len(sets), bool)
            gone[live[done]] = True
            stay = ~gone[row]
            element, row, live = element[stay], row[stay], live[~done]
            order = None if order is None else order[stay]
    return out


def _signed(shingle: int, slots: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = Texts(part["text"], lower=lower)
                sets = [shingles(texts.of(i), shingle) for i in range(len(texts))]
                sig = superminhash(sets, slots)
                short = (mix(sig) >> U(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                    ],
                    ["doc_id", "n", "same", "sig"],
                )

    return run


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def _confirmed(shingle: int, percent: int, lower: bool):
    """Keep pairs (a, b, ta, tb) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [Texts(batch[c], lower=lower) for c in ("ta", "tb")]
            hit, known = [], {}
            for i, a in enumerate(batch["a"].to_pylist()):
                if a not in known:
                    known = {a: shingles(sides[0].of(i), shingle)}
                x, y = known[a], shingles(sides[1].of(i), shingle)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(bool(_linked(inter, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _candidates(slots: int, percent: int):
    """Of a bucket's block of members and one of its strays: which strays may be similar to a member of which other group."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, slots)
        n, label = table["n"].to_numpy(), table["label"].to_numpy()
        doc, guest = table["doc"].to_numpy(), table["guest"].to_numpy(zero_copy_only=False)
        home, stray = np.flatnonzero(~guest), np.flatnonzero(guest)
        own_sig, own_n, own_label = sig[home], n[home], label[home]
        docs, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in stray:
            size_ok = 100 * np.minimum(own_n, n[i]) >= percent * np.maximum(own_n, n[i])
            other = np.flatnonzero(size_ok & (own_label != label[i]))
            near = other[(own_sig[other] == sig[i]).mean(1) >= percent / 100 - SLACK]
            to = np.unique(own_label[near])
            docs.append(np.full(len(to), doc[i]))
            labels.append(to)
        return pa.table({"doc": np.concatenate(docs), "label": np.concatenate(labels)})

    return run


def _compared(shingle: int, percent: int, lower: bool):
    """Of a block of a group and one of the strays sent to it: the links, by exact counts of common shingles."""

    def run(table: pa.Table) -> pa.Table:
        texts = Texts(table["text"], lower=lower)
        doc, stray = table["doc"].to_numpy(), table["guest"].to_numpy(zero_copy_only=False)
        sets = [shingles(texts.of(i), shingle) for i in range(len(texts))]
        home = [i for i in np.flatnonzero(~stray) if len(sets[i])]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if home:
            size = np.array([len(sets[i]) for i in home])
            every = np.concatenate([sets[i] for i in home])
            owner = np.repeat(np.arange(len(home)), size)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for i in np.flatnonzero(stray):
                lo, hi = np.searchsorted(every, sets[i]), np.searchsorted(every, sets[i], "right")
                many = hi - lo
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                inter = np.bincount(owner[at], minlength=len(home))
                hit = np.flatnonzero(_linked(inter, size, len(sets[i]), percent))
                a.append(np.full(len(hit), doc[i]))
                b.append(doc[[home[x] for x in hit]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _many(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _met(home: DataFrame, strays: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of both sides such that each block (of ``blocks``) of ``home`` meets each part (of ``guests``) of the strays."""

    def own(many: str) -> Column:
        return F.pmod(F.xxhash64("doc"), F.col(many)).cast("int")

    def each(many: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(many) - 1))

    home = home.select(key, own("blocks").alias("block"), each("guests").alias("part"), *columns, F.lit(False).alias("guest"))
    return home.unionByName(strays.select(key, each("blocks").alias("block"), own("guests").alias("part"), *columns, F.lit(True).alias("guest")))


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    lower: bool = True,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Group documents (doc_id long, text string) whose shingle sets' Jaccard similarity is at least ``percent``.

    Returns one row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept
    (doc_id = component_id). Null or wordless texts have an empty set and are linked with nothing. Rows that share
    a doc_id are one document. Rows without doc_id can't be named and are left out. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch, slots = Scratch(spark, "near"), bands * rows
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    signed = docs.mapInArrow(_signed(shingle, slots, lower), "doc_id long, n long, same binary, sig binary")
    signed = scratch.write(signed, "signed")

    classes = signed.where("n > 0").groupBy("same", "n").agg(F.min("doc_id").alias("rep"))
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("doc"), "n", "sig"
    )
    reps = scratch.write(reps, "reps")

    bucket = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda b: F.xxhash64(b, F.col("sig").substr(b * (2 * rows) + 1, F.lit(2 * rows))),
        )
    )
    buckets = reps.select("doc", bucket.alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = scratch.write(buckets.join(shared, "bucket"), "buckets")

    members = buckets.select("doc").distinct()
    few = members.count() <= BROADCAST_IDS
    texts = docs.withColumnRenamed("doc_id", "doc").join(F.broadcast(members) if few else members, "doc", "left_semi")
    texts = scratch.write(texts, "texts")

    stars = scratch.write(buckets.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct(), "stars")
    pairs = stars.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    pairs = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    links = scratch.write(pairs.mapInArrow(_confirmed(shingle, percent, lower), "a long, b long"), "links")
    groups = scratch.write(components(links, scratch, "groups"), "grouped")

    # members of other groups in the same bucket; a bucket of two was decided by its star
    labelled = buckets.where("size > 2").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    labelled = scratch.write(labelled.select("bucket", "doc", F.coalesce("label", "doc").alias("label")), "labelled")
    counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", "n").alias("main"))
    mixed = mixed.where("labels > 1").select("bucket", "main", _many(F.col("size"), BLOCK).alias("blocks"), _many(F.col("size") - F.col("most"), BLOCK).alias("guests"))
    rest = labelled.join(mixed, "bucket")
    met = _met(rest, rest.where("label <> main"), "bucket", "doc", "label").join(reps, "doc")
    sent = met.groupBy("bucket", "block", "part").applyInArrow(_candidates(slots, percent), "doc long, label long").distinct()
    sent = scratch.write(sent, "sent")

    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    asked = sent.groupBy("label").agg(F.count("*").alias("strays")).join(sizes, "label", "left")
    asked = asked.select("label", _many(F.coalesce("size", F.lit(1)), TEXTS).alias("blocks"), _many(F.col("strays"), TEXTS).alias("guests"))
    at_home = asked.join(groups, "label", "left").select("label", F.coalesce("node", "label").alias("doc"), "blocks", "guests")
    both = _met(at_home, sent.join(asked, "label"), "label", "doc").join(texts, "doc").select("label", "block", "part", "doc", "guest", "text")
    more = both.groupBy("label", "block", "part").applyInArrow(_compared(shingle, percent, lower), "a long, b long")
    more = scratch.write(more, "more")

    found = groups if more.isEmpty() else components(groups.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more), scratch, "final")
    rep_of = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("same", "n", F.coalesce("label", "rep").alias("component"))
    out = signed.select("doc_id", "n", "same").join(scratch.write(rep_of, "classes"), ["same", "n"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


SQL = r"""
WITH RECURSIVE listed AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
  sets AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM listed),
  members AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
  links AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reach(d, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT d, y FROM reach JOIN links ON x = r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) USING (doc_id)
"""
