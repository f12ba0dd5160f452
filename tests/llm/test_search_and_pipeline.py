import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import check
from tests.llm import brute
from tidewheel.llm import ball_tree, packing, queries, stages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    check(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def _plain(rows, asked, k):
    out = {}
    for q, v in rows:
        if asked(q):
            scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))
            for rank, (s, i) in enumerate(scored[:k], 1):
                out[q, rank] = (i, -s)
    return out


@pytest.mark.parametrize("shard", [16_384, 40])
def test_search_equals_brute_force(spark, shard):
    r = random.Random(1)
    rows = [(k, [r.randint(-3, 3) for _ in range(6)]) for k in range(300)]  # small numbers, many ties
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, [1 << 40] * 6), (2050, [-(1 << 30)] * 6), (3000, [1, 2]), (3050, [5, 5]), (3100, []), (4000, [0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), k=5, shard=shard, roots=4_000_000 if shard == 40 else 0).collect()
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found} == _plain(rows, lambda q: q % 50 == 0, 5)
    assert len(found) == len({(x.query_id, x.rank) for x in found})


def test_shards_out_of_reach_are_not_searched(spark):
    # one cluster far out on each axis: the queries' best lie in one of them
    r = random.Random(4)
    rows = [(k, [1000 * (j == k % 8) + r.randint(-2, 2) for j in range(8)]) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for roots in (0, 4_000_000):
        found = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), k=5, shard=100, roots=roots).collect()
        assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found} == _plain(rows, lambda q: q % 50 == 0, 5)
    tree = ball_tree.BallTree(np.array([v for k, v in rows if k % 8 == 1]))
    queries = np.array([rows[0][1], rows[1][1]])
    assert tree.bounds(queries)[0, 0] < 100_000 < tree.bounds(queries)[1, 0]


@pytest.mark.parametrize("shard", [16_384, 2])
def test_scores_beyond_a_long_count_as_the_nearest(spark, shard):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 0.0]), (3, [1e300, -1.0]), (4, [0.5, 0.5]), (50, [-1e18, 3.0])]
    df = ball_tree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    v = {x.vec_id: list(x.v) for x in df.collect()}
    least, most = -(1 << 63), (1 << 63) - 1
    assert v[3] == [most, -256] and v[0] == [256 * 10**15, 256]
    want = {}
    for q in (0, 50):
        scored = sorted((-min(max(sum(a * b for a, b in zip(v[q], w, strict=True)), least), most), i) for i, w in v.items() if i != q)
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(scored, 1)}
    found = ball_tree.top_k(df, df.where("vec_id % 50 = 0"), k=5, shard=shard).collect()
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found} == want


@pytest.mark.parametrize("shard", [16_384, 3])
def test_copies_of_a_vector_take_one_place(spark, shard):
    rows = [(0, [1, 0])] + [(1, [9, 0])] * 5 + [(k, [k % 7, 1]) for k in range(2, 12)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = ball_tree.top_k(df, df.where("vec_id = 0"), k=5, shard=shard).collect()
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in found} == _plain(list(dict(rows).items()), lambda q: q == 0, 5)


def test_vectors_with_nulls_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-0.001, 0.5]), (None, [1.0, 1.0])]
    df = brute.frame(spark, rows, "vec_id long, embedding array<double>")
    assert {x.vec_id: list(x.v) for x in ball_tree.quantised(df).collect()} == {0: [256, 512], 5: [-1, 128]}
    none = ball_tree.quantised(df.limit(0))
    assert ball_tree.top_k(none, none).count() == 0
    one = ball_tree.quantised(df.where("vec_id = 0"))
    assert ball_tree.top_k(one, one).count() == 0


def test_bounds_prune():
    r = np.random.default_rng(3)
    centre = r.normal(0, 100, (20, 8))
    vectors = (np.repeat(centre, 200, 0) + r.normal(0, 2, (4000, 8))).astype(np.int64)
    tree, seen = ball_tree.BallTree(vectors), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    tree.vectors = tree.vectors.view(Counted)
    got = tree.search(vectors[17], 5, np.arange(4000), 17, -(1 << 63))
    want = sorted(((-int(s), i) for i, s in enumerate(vectors @ vectors[17]) if i != 17))[:5]
    assert got == [(-s, i) for s, i in want] and sum(seen) < 2000


def _documents(spark):
    r = random.Random(8)
    word = [f"{a}{b}" for a in ("the", "and", "of", "der", "und", "nicht") for b in ("", "ing", "er", "ung", "ed", "ly", "en", "est", "ish", "bar")]
    texts = []
    for k in range(120):
        kind = r.random()
        if texts and kind < 0.2:
            t = list(r.choice(texts))
            if kind > 0.08:
                t[r.randrange(len(t))] = "changed"
        else:
            t = [r.choice(word) for _ in range(r.choice([5, 60, 150, 300]))]
            if texts and kind < 0.4:
                t[3:3] = r.choice(texts)[:80]
        texts.append(t)
    rows = [(k, r.choice([" ", "\n"]).join(t), "en" if k % 3 else "de") for k, t in enumerate(texts)]
    rows += [(500, None, None), (501, "", "en"), (502, "123 456", None), (503, "plain words", None), (504, rows[40][1], "en"), (504, rows[40][1], "en")]
    return spark.createDataFrame([(k, t, x, f"s{k % 5}", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_the_pipeline_equals_a_plain_one(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = _documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x.doc_id: x.text for x in docs.collect() if x.text and any(c.isalpha() for c in x.text)}
    kept = brute.exact(sorted(rows.items()))
    rows = {k: t for k, t in rows.items() if kept[k][2]}
    parts = brute.components(sorted(rows.items()), 5)
    rows = {k: t for k, t in rows.items() if parts[k][1] == k}
    left = {k: [w for w, g in zip(*v, strict=True) if not g] for k, v in brute.repeats(sorted(rows.items()), 50).items()}
    left = {k: w for k, w in left.items() if w}
    assert len(left) < len(rows) or sum(map(len, left.values())) < sum(len(brute.words(t)) for t in rows.values())

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    found = docs.collect()
    assert {x.doc_id: brute.words(x.text) for x in found} == left and len(found) == len(left)
    assert all(x.n_chars == len(x.text) for x in found)
    untouched = [x for x in found if len(brute.words(rows[x.doc_id])) == len(left[x.doc_id])]
    assert untouched and all(x.text == rows[x.doc_id] for x in untouched)

    encode = packing.Encoder(queries.tokenizer_file("word_bpe_49k.json"))
    pieces = {}
    for k, w in left.items():
        ids = np.append(np.frombuffer(encode([" ".join(w)])[0], "<u4"), 1).astype("<u4")
        pieces |= {(k, p): (len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {(x.doc_id, x.piece): (x.length, x.ids_crc32) for x in out.collect()} == pieces
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").isEmpty()


def test_without_labels_no_text_with_letters_goes(spark):
    docs = _documents(spark).withColumn("lang", F.lit(None).cast("string"))
    want = sorted(x.doc_id for x in docs.collect() if any(c.isalpha() for c in x.text or ""))
    assert sorted(x.doc_id for x in stages.known_language(spark, docs, "").collect()) == want


def test_languages_come_from_the_texts(spark):
    words = {"en": "the and of with that this from which", "de": "der die und nicht auf ist ein das"}
    rows = [(k, " ".join(random.Random(k).choices(words[x].split(), k=30)), x) for k in range(80) for x in [("en", "de")[k % 2]]]
    rows += [(100, "der und die ist das", "en"), (101, "the and of this", None), (102, "?! 12", "en"), (103, None, "de")]
    docs = spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.lang for x in stages.known_language(spark, docs, "").collect()}
    # a filter of letters would have left the languages as they came
    assert got == {k: ("en", "de")[k % 2] for k in range(80)} | {100: "de", 101: "en"}


def test_texts_that_share_a_doc_id_all_stay(spark):
    rows = [(1, "one text here"), (1, "another text of this id"), (1, "another  text of this id"), (2, "one text here"), (3, "third"), (3, "third")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.one_of_equal(spark, docs, "")
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(1, "another  text of this id"), (1, "one text here"), (3, "third")]
    assert kept.columns == docs.columns
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"a {passage}"), (2, f"b {passage} c"), (2, "what else has this id"), (2, f"{passage} d")]
    docs = spark.createDataFrame([(k, t, "en", f"s{n}", len(t)) for n, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = stages.without_repeats(spark, docs, "")
    assert sorted((x.doc_id, x.text, x.source, x.n_chars) for x in left.collect()) == [(1, rows[0][1], "s0", len(rows[0][1])), (2, "b  c", "s1", 4), (2, "d", "s3", 1), (2, rows[2][1], "s2", len(rows[2][1]))]


def test_stages_take_empty_tables(spark):
    none = _documents(spark).limit(0)
    for stage in (stages.known_language, stages.one_of_equal, stages.one_of_near, stages.without_repeats, stages.packed):
        assert stage(spark, none, "").count() == 0
