"""Plain versions of the operators, for small inputs, and inputs that are hard on purpose."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: null, empty and blank texts, one word, copies, a repeated row, a very long text, wide characters, extreme ids.
EDGE = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "word"), (5, "word"), (6, "Word\n"), (7, "tick tock " * 30_000), (8, "Éa 😀 中文 naïve"),
    (9, "x" * 50_000), (-(2**63), "least id"), (2**63 - 1, "least  id"), (10, "1 2 3 - !?"), (11, "twice the row"), (11, "twice the row"),
]


def frame(spark, rows, schema: str = "doc_id long, text string"):
    """Documents with more columns, whose names operators use inside."""
    df = spark.createDataFrame(rows, schema)
    for name in ("n", "h", "key", "norm", "label", "component", "same", "sig", "spans", "plan", "doc", "kept", "n_words", "shard", "lines", "group_size"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return [w for w in SPACE.split(text.translate(LOWER) if lower else text) if w]


def exact(rows) -> dict:
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((-len(text or ""), doc))
    return {
        doc: (min(groups[k])[1], len(groups[k]), doc == min(groups[k])[1], hashlib.sha256(k.encode()).hexdigest())
        for doc, text in rows
        for k in [SPACE.sub("", text or "")]
    }


def shingle_set(text, k: int, lower: bool = True) -> set:
    w = words(text, lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(rows, k: int, percent: int = 80) -> dict:
    sets = {doc: shingle_set(text, k) for doc, text in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(rows, window: int) -> dict:
    """doc: (words, removed flags)."""
    first: dict = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        out[doc] = (w, gone)
    return out


def digest(w, gone) -> str:
    return hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()
