"""Language identification by mixture inference.

Each language has a smoothed distribution of hashed byte trigrams, learned from labelled documents. A document is
taken as a mixture: each of its words is in one language, with the likelihood that the word's trigrams give it.
Expectation-maximisation estimates the proportions, and the set of languages is the one of greatest likelihood less
a penalty (half the logarithm of the number of words for each language beyond the first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import bounded_batches
from .words import Texts

BUCKETS = 1 << 15
#: labelled documents of each language from which the distributions are fitted, at most (chosen by a hash of doc_id).
SAMPLE = 4000
ROUNDS = 8
_SPACE = 0x20

_FOLD = np.full(256, _SPACE, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(raw: np.ndarray) -> np.ndarray:
    """Bytes in lower case (ASCII and Latin-1 letters), with everything that is no letter as a space."""
    out = _FOLD[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = out[latin]
    out[latin] = np.where((second >= 0x80) & (second <= 0x9E), second | 0x20, second)
    return out


def trigrams(text: np.ndarray) -> np.ndarray:
    """For each byte, the bucket of it and the two before; BUCKETS where a space follows a space."""
    x = text.astype(np.uint32)
    key = x * np.uint32(0x9E3779B1)
    key[1:] += x[:-1] * np.uint32(0x85EBCA6B)
    key[2:] += x[:-2] * np.uint32(0xC2B2AE35)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x2C1B3C6D)
    out = (key >> np.uint32(17)).astype(np.int64) % BUCKETS
    blank = text == _SPACE
    blank[1:] &= text[:-1] == _SPACE
    blank[:1] = text[:1] == _SPACE
    out[blank] = BUCKETS
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts = Texts(batch["text"])
        grams = trigrams(folded(texts.bytes))
        for i, lang in enumerate(batch["lang"].to_pylist()):
            own = np.bincount(grams[texts.offset[i] : texts.offset[i + 1]], minlength=BUCKETS + 1)[:BUCKETS]
            total[lang] = total.get(lang, 0) + own
    for lang, count in total.items():
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen)), pa.array(seen), pa.array(count[seen].astype(np.int64))], ["lang", "bucket", "n"]
        )


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and their log likelihood of each bucket, from (doc_id, text, lang) rows."""
    rows = labelled.where("lang is not null and text is not null")
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    # the share of each language's rows whose hash is low enough; all of them where there are few
    share = F.lit(0.0)
    for lang, n in many.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    counts = chosen.select("text", "lang").mapInArrow(_counted, "lang string, bucket long, n long")
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(many)
    table = np.full((BUCKETS, len(langs)), 0.1)
    at = {lang: k for k, lang in enumerate(langs)}
    np.add.at(table, (got["bucket"].to_numpy(), got["lang"].map(at).to_numpy(np.int64)), got["n"].to_numpy())
    table = np.log(table / table.sum(0))
    return langs, np.concatenate([table, np.zeros((1, len(langs)))]).astype(np.float32)


def _expectation(p: np.ndarray, cut: np.ndarray, many: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document after the rounds, from its words' relative likelihoods."""
    share, row = start, np.repeat(np.arange(len(many)), many)
    for _ in range(ROUNDS):
        part = p * share[row]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, cut, axis=0) / many[:, None]
    return share, np.add.reduceat(np.log((p * share[row]).sum(1, dtype=np.float64)), cut)


def mixture(word: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen set's strongest language and its share in the full mixture, for documents of ``many`` words each.

    ``word``: each word's log likelihood by language. Every document has words.
    """
    cut = np.cumsum(many) - many
    single = np.add.reduceat(word, cut, axis=0, dtype=np.float64)
    top = word.max(1, keepdims=True)
    base = np.add.reduceat(top[:, 0], cut, dtype=np.float64)
    p = np.maximum(np.exp(word - top), np.float32(1e-30))
    languages = word.shape[1]
    share, full = _expectation(p, cut, many, np.full((len(many), languages), 1 / languages, np.float32))
    best, penalty = single.argmax(1), 0.5 * np.log(many + 1.0)
    # no set does better than all languages: where even that gains less than one penalty, one language is the set
    for i in np.flatnonzero(full + base - single.max(1) > penalty):
        own, order = p[cut[i] : cut[i] + many[i]], np.argsort(-share[i], kind="stable")
        value, pick = single[i].max(), best[i]
        for k in range(2, languages + 1):
            some = order[:k]
            s, got = _expectation(np.ascontiguousarray(own[:, some]), np.zeros(1, np.int64), many[i : i + 1], np.full((1, k), 1 / k, np.float32))
            if got[0] + base[i] - (k - 1) * penalty[i] > value:
                value, pick = got[0] + base[i] - (k - 1) * penalty[i], some[s[0].argmax()]
        best[i] = pick
    return best, np.clip(share[np.arange(len(many)), best], 0, 1)


def _lettered(texts: Texts) -> np.ndarray:
    raw = texts.bytes
    ascii_letter = ((raw | 0x20) >= 97) & ((raw | 0x20) <= 122) & (raw < 0x80)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    wide = np.concatenate([[0], np.cumsum(raw >= 0x80)])
    out = total[texts.offset[1:]] > total[texts.offset[:-1]]
    for i in np.flatnonzero(~out & (wide[texts.offset[1:]] > wide[texts.offset[:-1]])):
        out[i] = any(c.isalpha() for c in raw[texts.offset[i] : texts.offset[i + 1]].tobytes().decode())
    return out


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = Texts(part["text"])
                lettered = _lettered(texts)
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                text = folded(texts.bytes)
                inside = text != _SPACE
                start = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
                many = np.diff(np.searchsorted(start, texts.offset))
                if langs and len(start):
                    grams = trigrams(text)
                    # blocks of bytes, cut where words begin, bound the gathered table rows
                    word, first = [], 0
                    while first < len(start):
                        last = max(first + 1, int(np.searchsorted(start, start[first] + (1 << 20))))
                        to = start[last] if last < len(start) else len(text)
                        word.append(np.add.reduceat(table[grams[start[first] : to]], start[first:last] - start[first], axis=0))
                        first = last
                    rows = np.flatnonzero(many)
                    best, share = mixture(np.concatenate(word), many[rows])
                    for i, b, s in zip(rows, best, share, strict=True):
                        if lettered[i]:
                            lang[i], score[i] = langs[b], s
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The language of each document (doc_id, text), learned from ``labelled`` (doc_id, text, lang).

    Returns doc_id, lang_pred (a learned language; ``und`` if the text is null or has no letter, or if nothing was
    learned), score (the language's proportion in the mixture of all languages; 0 for ``und``). Ties go to the
    language first in order. Repeated rows are each predicted, and other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")), sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def _kept(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predicted(model)
        for batch in batches:
            if not model.value[0]:  # nothing was learned that could tell a text with letters from another
                yield batch.filter(pa.array(_lettered(Texts(batch["text"].cast(pa.string()))))) if batch.num_rows else batch
                continue
            found = pa.Table.from_batches(predict(iter([batch])))["lang_pred"].combine_chunks() if batch.num_rows else pa.array([], pa.string())
            at = batch.schema.get_field_index("lang")
            if at >= 0:
                batch = batch.set_column(at, batch.schema.field(at), found.cast(batch.schema.field(at).type))
            yield batch.filter(pa.array([x != "und" for x in found.to_pylist()], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, labelled: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, whose language ``identify`` tells; in one pass, without a shuffle.

    Their lang becomes what is predicted from the text, whether it was null, right or wrong. Those that go are null or
    have no letter; if nothing was learned, all others are kept as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(fit(labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")), sample))
    return docs.mapInArrow(_kept(model), docs.schema)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts
