import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewheel.llm import exact_dedup, graph, line_dedup, near_dedup, substring_dedup
from tidewheel.llm.fm_index import FMIndex
from tidewheel.llm.scratch import Scratch
from tidewheel.llm.words import Texts, shingles


def near_copies(seed: int, n: int = 60, vocabulary: int = 400) -> list[tuple[int, str]]:
    """Documents, many of them copies of others with a few words changed, some with passages of others."""
    r = random.Random(seed)
    word = [f"w{k}" for k in range(vocabulary)]
    texts: list[list[str]] = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(word)
            if kind < 0.2:
                at = r.randrange(len(t))
                other = r.choice(texts)
                t[at:at] = other[: r.randint(1, len(other))]
        else:
            t = [r.choice(word) for _ in range(r.randint(1, 120))]
        texts.append(t)
    ids = r.sample(range(10_000), n)
    return [(i, r.choice([" ", "\n", "  "]).join(t)) for i, t in zip(ids, texts, strict=True)]


# -- exact --------------------------------------------------------------------------------------------------


def _exact(df, **options):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df, **options).collect()}


def test_exact_groups(spark):
    rows = brute.EDGE[:-1] + near_copies(1)
    assert _exact(brute.frame(spark, rows + [(None, "no id")])) == brute.exact(rows)
    doubled = exact_dedup.exact_duplicates(brute.frame(spark, brute.EDGE)).where("doc_id = 11").collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in doubled] == [(11, 2, True)] * 2


def test_exact_with_colliding_hashes(spark):
    rows = [(k, f"{'a' if k % 2 else 'b'}{k % 7}") for k in range(60)]
    weak = _exact(brute.frame(spark, rows), content_hash=lambda text: F.unhex(F.md5(F.substring(text, 1, 1))))
    assert weak == brute.exact(rows)


def test_exact_runs_no_python_and_aggregates_by_hash(spark):
    plan = exact_dedup.exact_duplicates(brute.frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


# -- near ---------------------------------------------------------------------------------------------------


def _near(df, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize(("seed", "k"), [(2, 2), (3, 5)])
def test_near_groups_equal_brute_force(spark, seed, k):
    rows = brute.EDGE[:-1] + near_copies(seed, 150)
    want = {d: (n, c, d == c) for d, (n, c) in brute.components(rows, k).items()}
    assert _near(brute.frame(spark, rows + [(None, "no id")]), shingle=k) == want


def test_links_between_members_unlike_the_first_are_found(spark):
    # 1 is near to neither, but shares most of its words with both; 2 and 3 are near each other
    base = [f"b{k}" for k in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:84] + [f"x{k}" for k in range(16)])), (3, " ".join(base[:84] + [f"x{k}" for k in range(14)] + ["y", "z"]))]
    rows += [(10 + k, " ".join(base[:-1] + [f"q{k}"])) for k in range(30)]
    want = {d: (n, c, d == c) for d, (n, c) in brute.components(rows, 1).items()}
    assert want[3][1] == 2
    assert _near(brute.frame(spark, rows), shingle=1) == want


def test_strays_and_groups_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "TEXTS", 2)
    r = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(40):  # members of a bucket that are near to some others, but seldom to the first
        t = [w if r.random() > 0.1 else f"x{r.randint(0, 5)}" for w in base]
        rows.append((k, " ".join(t)))
    want = {d: (n, c, d == c) for d, (n, c) in brute.components(rows, 1).items()}
    assert 1 < len({c for _, c, _ in want.values()}) < 40
    assert _near(brute.frame(spark, rows), shingle=1) == want


def test_no_link_is_lost_at_a_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    want = {d: (n, c, d == c) for d, (n, c) in brute.components(rows, 2).items()}
    assert _near(docs, shingle=2) == want and sum(not kept for _, _, kept in want.values()) > 50


def test_superminhash_estimates_and_stops_early():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        x = r.integers(0, 2**63, 300).astype(np.uint64)
        y = np.concatenate([x[:200], r.integers(0, 2**63, 100).astype(np.uint64)])
        a, b = near_dedup.superminhash([x, y], 240)
        errors.append((a == b).mean() - 0.5)
    # plain MinHash has a standard deviation of 0.0323 here
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.0323
    one, empty = near_dedup.superminhash([x[:1], x[:0]], 240)
    assert sorted(one >> np.uint64(48)) == list(range(240)) and (empty == ~np.uint64(0)).all()
    long = near_dedup.superminhash([r.integers(0, 2**63, 50_000).astype(np.uint64)], 240)
    assert (long >> np.uint64(48)).max() == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    r.shuffle(edges)
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), Scratch(spark, "t"), "c")
    node, label = graph.union_find(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    loops = {a for a, b in edges if a == b}
    want = {int(a): int(b) for a, b in zip(node, label, strict=True)}
    got = {x.node: x.label for x in found.collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(want) - set(got) <= loops


# -- passages -------------------------------------------------------------------------------------------------


def _repeats(df, **options):
    return {r.doc_id: r for r in substring_dedup.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeats_equal_brute_force(spark, hot):
    rows = brute.EDGE[:-1] + near_copies(7, 120, 60) + [(20_000 + k, "same passage of many documents " * 3 + f"end {k % 3}") for k in range(40)]
    got = _repeats(brute.frame(spark, rows + [(None, "no id")]), window=8, anchor=3, hot=hot)
    want = brute.repeats(rows, 8)
    assert set(got) == set(want)
    for doc, (w, gone) in want.items():
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (len(w), sum(gone), brute.digest(w, gone)), doc
        if any(gone):
            assert brute.words(got[doc].kept_text) == [x for x, g in zip(w, gone, strict=True) if not g]
        else:
            assert got[doc].kept_text is None


def test_a_hot_anchor_is_indexed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_WORDS", 40)
    monkeypatch.setattr(substring_dedup, "SALTED", 3)
    r = random.Random(4)
    passages = [" ".join(r.choices("abcdefgh", k=r.randint(0, 9))) + " the hot phrase " + " ".join(r.choices("abcdefgh", k=9)) for _ in range(25)]
    rows = [(k, f"own {k} {r.choice(passages)} end {r.randint(0, 9)}") for k in r.sample(range(1000), 150)]
    want = brute.repeats(rows, 8)
    got = _repeats(brute.frame(spark, rows), window=8, anchor=3, hot=2)
    assert {d: (x.n_removed, x.kept_sha256) for d, x in got.items()} == {d: (sum(gone), brute.digest(w, gone)) for d, (w, gone) in want.items()}
    assert sum(x.n_removed for x in got.values()) > 1000


def test_windows_longer_than_the_texts(spark):
    rows = near_copies(8, 20)
    assert all(r.n_removed == 0 for r in _repeats(brute.frame(spark, [(i, " ".join(t.split()[:49])) for i, t in rows])).values())


def test_the_index_finds_longest_matches():
    r = np.random.default_rng(3)
    for trial in range(60):
        letters, depth = r.integers(1, 5), int(r.integers(1, 7))
        indexed = [r.integers(0, letters, r.integers(1, 30)).astype(np.uint64) * 7 for _ in range(r.integers(1, 8))]
        owner = r.integers(0, 100, len(indexed))
        streams = [r.integers(0, letters + trial % 2, r.integers(1, 40)).astype(np.uint64) * 7 for _ in range(5)]
        length, least = FMIndex(indexed, owner, depth).matching_statistics(streams)

        def occurs(part, indexed=indexed):
            return [k for k, s in enumerate(indexed) if any(np.array_equal(s[j : j + len(part)], part) for j in range(len(s) - len(part) + 1))]

        for s, got, low in zip(streams, length, least, strict=True):
            for i in range(len(s) - depth + 1):
                best = max([m for m in range(1, len(s) - i + 1) if occurs(s[i : i + m])], default=0)
                if best >= depth:
                    assert got[i] == best and low[i] == min(owner[k] for k in occurs(s[i : i + depth]))
                else:
                    assert low[i] == -1


# -- lines ----------------------------------------------------------------------------------------------------


def test_patience_alignment():
    assert line_dedup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert line_dedup.patience([1, 2, 9, 3], [1, 3, 2, 9]) == [(0, 0), (1, 2), (2, 3)]
    assert line_dedup.patience([7, 7, 5], [5, 7]) == [(2, 0)]
    assert line_dedup.patience([], [1]) == []
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 15))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert line_dedup.blocks([(0, 4), (1, 5), (3, 6), (4, 7)]) == [(0, 2), (3, 2)]


def _lines_brute(rows, least=10):
    """Of every document, the lines in runs of ``least`` words or more that an earlier document has as they are."""
    lines = {d: [" ".join(brute.words(x)) for x in (t or "").split("\n") if brute.words(x)] for d, t in rows}
    first: dict = {}
    gone: dict = {d: set() for d in lines}
    for d in sorted(lines):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                if sum(x.count(" ") + 1 for x in lines[d][i:j]) >= least and first.setdefault(tuple(lines[d][i:j]), d) < d:
                    gone[d] |= set(range(i, j))
    return {d: (len(lines[d]), len(gone[d])) for d in lines}


def test_shared_lines_equal_brute_force(spark):
    r = random.Random(9)
    pool = [" ".join(f"v{r.randint(0, 300)}" for _ in range(r.randint(1, 12))) for _ in range(80)]
    rows = brute.EDGE[:-1] + [(100 + k, "\n".join([*r.sample(pool, r.randint(1, 9)), "", f"own {k} {r.random()}"][: r.randint(1, 11)])) for k in range(120)]
    rows += [(900 + k, rows[40][1]) for k in range(5)]
    got = {x.doc_id: x for x in line_dedup.remove_shared_lines(brute.frame(spark, rows + [(None, "no id")])).collect()}
    assert {d: (x.n_lines, x.n_removed) for d, x in got.items()} == _lines_brute(rows)
    assert all((x.kept_text is None) == (x.n_removed == 0) for x in got.values())
    assert got[900].kept_text.split() == [] and got[7].kept_chars == len(brute.EDGE[6][1])


@pytest.mark.parametrize("hot", [10_000, 2])
def test_a_passage_in_a_third_of_the_documents_is_removed(spark, hot):
    passage = "all rights are reserved\nby the owner of this site"
    rows = [(k, f"own text of document {k}\n{passage if k % 3 == 0 else 'nothing'}\nend {k}") for k in range(60)]
    got = {x.doc_id: x.n_removed for x in line_dedup.remove_shared_lines(brute.frame(spark, rows), hot=hot).collect()}
    assert got == {k: 2 if k % 3 == 0 and k else 0 for k in range(60)}


def test_blocks_are_found_in_any_earlier_document(spark):
    a, b = "a line of but six words", "and one of five words"
    rows = [(1, f"{a}\none"), (2, f"{b}\ntwo"), (3, f"three\n{a}\n{b}"), (4, f"four\n{a}\n{b}\nmore")]
    got = {x.doc_id: x.n_removed for x in line_dedup.remove_shared_lines(brute.frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2}


@pytest.mark.parametrize("hot", [10_000, 2])
def test_all_blocks_of_earlier_documents_are_removed(spark, hot):
    r = random.Random(12)
    pool = [" ".join(f"v{r.randint(0, 300)}" for _ in range(r.randint(1, 12))) for _ in range(40)]
    rows = [(k, "\n".join(r.choices(pool, k=r.randint(1, 14)))) for k in range(90)]
    first: dict = {}
    want = {}
    for d, text in rows:
        lines, gone = text.split("\n"), set()
        runs = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(len(x.split()) for x in lines[i:j]) >= 10]
        for i, j in runs:
            if first.setdefault(tuple(lines[i:j]), d) < d:
                gone |= set(range(i, j))
        want[d] = len(gone)
    got = {x.doc_id: x.n_removed for x in line_dedup.remove_shared_lines(brute.frame(spark, rows), hot=hot).collect()}
    assert got == want and any(want.values())


# -- all ------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = brute.frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_shared_lines(none).count() == 0


@pytest.mark.parametrize("hot", [10_000, 2])
def test_rows_given_twice_come_out_twice(spark, hot):
    passage = " ".join(f"p{k}" for k in range(30))
    more = [(20, f"{passage}\nfirst"), (21, f"own\n{passage}\nend"), (22, f"{passage} and other words"), (30, f"one text\n{passage}"), (30, "another text of the same id")]
    rows = [*brute.EDGE, *more]
    for found, digest in ((substring_dedup.remove_repeats(brute.frame(spark, rows * 2), window=10, anchor=3, hot=hot), "kept_sha256"), (line_dedup.remove_shared_lines(brute.frame(spark, rows * 2), hot=hot), "kept_sha256")):
        got = sorted((x.doc_id, x.n_removed, x[digest]) for x in found.collect())
        assert len(got) == 2 * len(rows) and got[::2] == got[1::2]
        gone = {(d, n) for d, n, _ in got}
        assert {d for d, n in gone if n} >= {21, 30} and (30, 0) in gone and (20, 0) in gone
    kept = {x.doc_id: x.kept_text for x in substring_dedup.remove_repeats(brute.frame(spark, rows * 2), window=10, anchor=3, hot=hot).collect() if x.kept_text is not None}
    assert kept[21].split() == ["own", "end"] and kept[22] == "and other words" and kept[30] == "one text"


def test_most_lines_go_by_alignment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    removed, aligned = line_dedup.remove_shared_lines(docs).select(F.sum("n_removed"), F.sum("n_aligned")).first()
    assert removed > 100 and aligned >= 0.95 * removed


def test_repeated_rows_don_t_break_anything(spark):
    df = brute.frame(spark, brute.EDGE + [(11, "twice the row")])
    assert near_dedup.near_duplicates(df).where("doc_id = 11").select("component_id").distinct().count() == 1
    assert {r.n_removed for r in substring_dedup.remove_repeats(df, window=2, anchor=1).where("doc_id = 11").collect()} == {0}
    assert {r.n_removed for r in line_dedup.remove_shared_lines(df).where("doc_id = 11").collect()} == {0}


def test_words_of_arrow_buffers():
    import pyarrow as pa

    texts = ["a b", None, "", "  x\ty\nz ", "Éa 😀", "x" * 3_000_000 + " tail", "b a"]
    t = Texts(pa.array(texts).slice(0), lower=True)
    assert t.counts().tolist() == [len(brute.words(x)) for x in texts]
    assert (t.of(0) == t.of(6)[::-1]).all() and len(set(t.hash.tolist())) == len({w for x in texts for w in brute.words(x, True)})
    sliced = Texts(pa.array(texts).slice(3, 2))
    assert sliced.counts().tolist() == [3, 2]
    assert len(shingles(t.of(3), 2)) == 2 and len(shingles(t.of(3), 9)) == 1 and len(shingles(t.of(1), 2)) == 0
