import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewheel.llm import html_text, language_id, lm_scoring, packing, sentencepiece_codec
from tidewheel.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


# -- main text ---------------------------------------------------------------------------------------------------

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="top-menu">menu</div><!-- <p>no</p> -->
<div id=content><article class="post"><header><h1>T&eacute; &amp; x</h1><span class=by>by me</span></header><p>one <b>two</b>
 three<br>four<p>five&nbsp;&lt;b&gt;<ul><li>six<li>seven</ul><div class="ad-slot">buy</div><pre> a
 b </pre><table><tr><td>1<td>2</table><figure><img src=x alt=y><figcaption>cap</figcaption></figure>
<form><p>mail?</p><input></form><div class="cookie notice">ok</div><section id="comments"><article><p>first!</p></article></section></article></div>
<aside>more</aside><div role=complementary>side</div><footer>&copy;</footer></body></html>"""


def test_the_article_without_what_is_none():
    want = ["Té & x", "one two three four", "five <b>", "six", "seven", "a b", "1", "2", "cap"]
    assert html_text.Page(ARTICLE).text() == "\n\n".join(want)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("plain &lt;text&gt; only\n\n ok", "plain <text> only ok"),
        ("<div><p>a</div><p>b<script>if(a<b){}</script> c", "a\n\nb c"),
        ("<main><p>x</p></main><p>y", "x"),
        ("<article><p>open <b>never closed", "open never closed"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("<article></article>", ""),
        ("<script>only", ""),
        ("< 5 and > 3", "< 5 and > 3"),
        ("<p title='a > b'>x</p>", "x"),
        ("</div></p>stray", "stray"),
        ('<div class="no-sidebar has-menu"><p>content</p><div class=sideBar>x</div><div id="topAds">y</div></div>', "content"),
        ("<ARTICLE><P>Upper</ARTICLE>", "Upper"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ('<article><section id="discussion"><p>The main finding.</section><div class="market-share"><p>A third.</div></article>', "The main finding.\n\nA third."),
        ('<article><h2 id="Sharing">Sharing</h2><p id="ad-2024">In 2024.<p class="header-note">A note.</article>', "Sharing\n\nIn 2024.\n\nA note."),
        ("<p><a href=/o'brien>Link</a> some text here. I don't know</p><p>more", "Link some text here. I don't know\n\nmore"),
        ('<p>one <a title="x>two</a> three</p>', "one two three"),
        ('<p data-class="ad" data-id=nav>kept</p><p class=advert>gone</p><a class = "x\ty" href="a>b">c</a>', "kept\n\nc"),
        ("<p>1 < 2 <b title=a=b>x</b>", "1 < 2 x"),
        ('<article><p>text</p><div class="cookie-box">ok?</div><ul class="nav nav-tabs"><li>a</ul><div role=search>q</div></article>', "text"),
    ],
)
def test_broken_and_small_pages(html, text):
    assert html_text.Page(html).text() == text


def test_subtrees_that_recur_on_a_host_are_deleted(spark):
    def page(k, host, chrome):
        return (k, f"http://{host}/p{k}", f"<html><body><div>{chrome}</div><p>Only here {k}.</p><p>{chrome}, again</p><div><div>Said on all pages.</div></div></body></html>")

    rows = [page(k, "A.example:80", "Welcome") for k in range(8)] + [page(100 + k, "b.example", "Welcome") for k in range(3)]
    rows += [(200, None, "<p>no url"), (201, "http://A.example/x", None), (202, "", ""), (202, "", ""), (None, "http://c.example/", "<p>no id")]
    df = brute.frame(spark, rows, "page_id long, url string, html string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == f"Only here {k}." for k in range(8))
    assert text[100] == "Welcome\n\nOnly here 100.\n\nWelcome, again\n\nSaid on all pages."  # too few pages to tell
    assert (text[200], text[201], text[202], text[None]) == ("no url", "", "", "no id")
    assert html_text.extract(df.limit(0)).count() == 0


def test_extraction_equals_a_plain_count_of_subtrees(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    parsed = [html_text.Page(h) for h in pages["html"]]
    hosts = [html_text.host_of(u) for u in pages["url"]]
    count = Counter((h, d) for h, p in zip(hosts, parsed, strict=True) for d in p.subtrees())
    size = Counter(hosts)
    want = {}
    for k, h, p in zip(pages["page_id"], hosts, parsed, strict=True):
        template = frozenset(d for (g, d), n in count.items() if g == h and n >= max(html_text.MIN_PAGES, math.ceil(html_text.SHARE * size[h])))
        want[k] = p.text(template)
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert got == want and all(want.values())


def test_stray_end_tags_of_a_deep_page_take_no_longer():
    import time

    begin = time.process_time()
    assert html_text.Page("<div>" * 40_000 + "x" + "</i></b>" * 40_000).text() == "x"
    assert time.process_time() - begin < 20


def test_menus_with_states_and_counts_and_doubtful_classes_go_where_they_recur(spark):
    def page(k, host):
        menu = "".join(f'<li class="item{" active" if n == k else ""}">Part {n} ({k * 3 + n})</li>' for n in range(5))
        share = f'<div class="share-box"><span>Tell {k} friends</span><span>Send it to somebody {"x" * k}</span></div>'
        discussion = f'<div class="discussion"><h2>What follows</h2><p>{"Much. " * (k + 1)}</p>{"<table><tr><td>1</table>" * (k % 2)}</div>' if k in (2, 3) else ""
        body = f"<p>The text of page {k}, which is long enough to be what most of it is: {'word ' * 30}</p>"
        return (k, f"http://{host}/{k}", f"<body><div><ul>{menu}</ul></div><article><h1>Page {k}</h1>{body}{share}{discussion}</article></body>")

    def want(k, share):
        lines = [f"Page {k}", f"The text of page {k}, which is long enough to be what most of it is: {'word ' * 30}".strip()]
        lines += [f"Tell {k} friendsSend it to somebody {'x' * k}".strip()] * share + (["What follows", ("Much. " * (k + 1)).strip()] + ["1"] * (k % 2) if k in (2, 3) else [])
        return "\n\n".join(lines)

    rows = [page(k, "many.example") for k in range(12)] + [(100 + k, u, h) for k, u, h in (page(n, "few.example") for n in range(3))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want(k % 100, k >= 100) for k in got} and len(got) == 15
    # without an article, the menu goes as a template, whatever its states and numbers
    bare = [(k, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for k, u, h in rows]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert all(("Part" in t) == (k >= 100) for k, t in got.items()) and all(f"Page {k % 100}" in t for k, t in got.items())


def test_copies_of_an_article_are_no_template(spark):
    body = "<article><div><p>The same article, put under many addresses of one site.</p></div><div class=x>Share this</div></article>"
    rows = [(k, f"http://s.example/{k}", body) for k in range(9)]
    texts = {r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {"The same article, put under many addresses of one site."}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_copies_of_a_third_of_a_host_keep_their_text(spark, tag):
    def page(k, what):
        parts = "".join(f"<section><h2>Part {n} of {what}</h2><p>What part {n} of {what} says.</p></section>" for n in range(4))
        return (k, f"http://c.example/{k}", f"<body><div class=top>Welcome here</div><{tag}>{parts}<div class=x>Read it again</div></{tag}></body>")

    rows = [page(k, f"page {k}") for k in range(8)] + [page(100 + k, "the copied page") for k in range(4)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in got:
        what = f"page {k}" if k < 100 else "the copied page"
        assert got[k] == "\n\n".join(f"Part {n} of {what}\n\nWhat part {n} of {what} says." for n in range(4))


# -- packing ---------------------------------------------------------------------------------------------------


def _encoder():
    return packing.Encoder(tokenizer_file("word_bpe_49k.json"))


def test_ids_equal_the_tokenizers():
    encode, r = _encoder(), random.Random(1)
    letters = "abcXYZ012 \t\n\r\x0b\x0c\x1c\x85\xa0　́éÉßİΣσﬁ'’<|>中文‍😀!?.,-_$%\x00ÀÿÐ÷×"
    texts = ["".join(r.choice(letters if k % 2 else letters[:40]) for _ in range(r.randint(0, 25))) for k in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "don't we'll", "", "Plain words, and more."]
    want = [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want


def test_other_tokenizers_encode_whole_texts():
    path = tokenizer_file("byte_bpe_50k.json")
    encode = packing.Encoder(path)
    texts = ["Plain words, and more.", "", "UPPER  and\nlower 123", "ünï 中文"]
    assert not encode.by_word and _encoder().by_word
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_piece_once(spark):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma,"]) for _ in range(r.choice([3, 20, 90, 400])))) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "tick " * 3000)]
    got = packing.pack(brute.frame(spark, rows + [(None, "no id")]), tokenizer_file("word_bpe_49k.json"), capacity=256, shard=64).collect()
    encode, pieces = _encoder(), {}
    for k, t in rows:
        ids = np.append(np.frombuffer(encode([t or ""])[0], "<u4"), 1).astype("<u4")
        for p, at in enumerate(range(0, len(ids), 256)):
            pieces[k, p] = (at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes()))
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in got} == pieces and len(got) == len(pieces)
    bins: dict = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 256
    bound = -(-sum(n for _, n, _ in pieces.values()) // 256)
    assert bound <= len(bins) <= bound + max(2, bound // 50)


def test_no_documents_give_no_sequences(spark):
    assert packing.pack(brute.frame(spark, []), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_the_genetic_algorithm_only_makes_packings():
    r = np.random.default_rng(4)
    length = r.integers(1, 100, 300)
    people = [packing.decreasing(length, 100, 0.1, r) for _ in range(2)]
    for _ in range(30):
        people.append(packing.crossover(length, people[-1], people[-2], 100, r))
        fill = np.bincount(people[-1], length)
        assert fill.max() <= 100 and fill.min() > 0 and len(people[-1]) == 300
    # thirds and halves that best fit decreasing puts together badly
    hard = np.array([45, 34, 30, 36, 25, 30] * 20)
    first = packing.decreasing(hard, 100)
    best = packing.evolve(hard, [first], 100, 1, generations=40)
    assert packing.fitness(hard, best, 100) >= packing.fitness(hard, first, 100)
    assert np.bincount(best, hard).max() <= 100


@pytest.mark.parametrize("plain", [True, False])
def test_the_genetic_algorithm_reaches_what_best_fit_decreasing_misses(plain):
    # triples that fill a bin each: the optimum is known, and best fit decreasing is above it
    better = 0
    for seed in range(3):
        r = np.random.default_rng(seed)
        triples = [(a, b, 200 - a - b) for a, b in zip(r.integers(60, 85, 40), r.integers(50, 70, 40), strict=True)]
        length = r.permutation(np.array(triples).reshape(-1))
        first = packing.decreasing(length, 200)
        best = packing.evolve(length, [], 200, seed, generations=300, plain=plain)
        fill = np.bincount(best, length)
        assert fill.max() <= 200 and fill.min() > 0 and len(best) == 120
        assert first.max() + 1 > 42 and len(fill) <= 41
        better += len(fill) == 40
    assert better >= 2


def test_the_genetic_algorithm_runs_where_best_fit_is_enough(monkeypatch):
    calls, plain = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or plain(*a))
    length = np.random.default_rng(1).integers(1, 60, 500)
    best = packing.evolve(length, [], 100, 7)
    assert calls and best.max() + 1 == -(-length.sum() // 100)


def test_fullest_subsets():
    r = random.Random(3)
    for _ in range(200):
        length, room = [r.randint(1, 40) for _ in range(r.randint(0, 9))], r.randint(0, 90)
        taken = packing.fullest(length, room)
        most = max(sum(x) for n in range(len(length) + 1) for x in itertools.combinations(length, n) if sum(x) <= room)
        assert sum(length[k] for k in taken) == most and len(set(taken)) == len(taken)


# -- SentencePiece ---------------------------------------------------------------------------------------------


def test_ids_and_texts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(5)
    texts = ["".join(r.choice("aabcdeehtinors   \n\té中文😀ßΣ.,'<s>") for _ in range(r.randint(0, 40))) for _ in range(400)]
    rows = brute.EDGE + list(enumerate(texts, 1000)) + [(None, "no id")]
    encoded = sentencepiece_codec.encode(brute.frame(spark, rows), path)
    ids = {x.doc_id: np.frombuffer(bytes(x.ids), "<u4").tolist() for x in encoded.collect()}
    assert ids == {k: library.encode(t or "") for k, t in rows}
    back = {x.doc_id: x.text for x in sentencepiece_codec.decode(encoded, path).collect()}
    assert back == {k: t or "" for k, t in rows}
    assert sentencepiece_codec.round_trip(brute.frame(spark, rows), path).where("not restored").count() == 0
    assert sentencepiece_codec.encode(brute.frame(spark, []), path).count() == 0


def test_long_runs_of_spaces_and_letters_take_no_longer():
    import time

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    with open(path, "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.read(f.read()))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(8)
    texts = [" " * 5000, "  " + "ab" * 2000, "   x" + " " * 37 + "yy  z", "".join(r.choice("   ab\n") for _ in range(5000))] + [" " * n + "the" * (n % 3) for n in range(70)]
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in texts] == library.encode(texts)
    begin = time.process_time()
    assert codec.decode(codec.encode(" " * 100_000)) == " " * 100_000
    assert codec.decode(codec.encode("  " + "letter" * 15_000)) == "  " + "letter" * 15_000
    assert time.process_time() - begin < 10


def test_unigram_models_take_the_best_path():
    r = random.Random(6)
    pieces = ["<unk>", *{"".join(r.choice("abc▁") for _ in range(n)) for n in (1, 1, 1, 2, 2, 2, 3, 3, 4, 4) for _ in range(2)}]
    pieces = [p for p in dict.fromkeys(pieces) if "▁" not in p.lstrip("▁")]
    scores = [0.0] + [-r.randint(1, 60) / 4 for _ in pieces[1:]]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary(pieces, scores, [False] + [True] * (len(pieces) - 1), 1, prefix=False))
    known = dict(zip(pieces[1:], scores[1:], strict=True))
    unknown = min(scores[1:]) - 10
    for _ in range(150):
        text = "".join(r.choice("abcd▁") for _ in range(r.randint(1, 9)))
        best = -math.inf
        for cut in itertools.product([0, 1], repeat=len(text) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cut) if c], len(text)]
            parts = [text[a:b] for a, b in zip(at, at[1:], strict=False)]
            best = max(best, sum(known.get(p, unknown if len(p) == 1 else -math.inf) for p in parts))
        got, ids, k = 0.0, codec.unit(text), 0
        for i in ids:
            if i:
                got += scores[i]
                k += len(pieces[i])
        singles = len(text) - sum(len(pieces[i]) for i in ids if i)
        assert got + singles * unknown == pytest.approx(best), (text, ids)


# -- language model --------------------------------------------------------------------------------------------


def _lm_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame([(10_000 + k, t) for k, (_, t) in enumerate(brute.EDGE)] + [(None, "no id")], "doc_id long, text string"))


def test_base_scores_equal_brute_force_and_the_model_is_better(spark):
    docs = _lm_rows(spark)
    training = language_id.fold("doc_id", 5) != 1
    got = {x.doc_id: x for x in lm_scoring.score(brute.frame(spark, docs.collect()), training).collect()}
    tokens = {x.doc_id: [*brute.words(x.text, True), "\n"] for x in docs.collect() if x.doc_id is not None}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    count = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    total, distinct = sum(count.values()), len(count)
    assert set(got) == set(tokens)
    for k, t in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert got[k].base_score == pytest.approx(base) and got[k].n_tokens == len(t) and got[k].train_tokens == total
        assert got[k].n_known == sum(count[w] > 0 for w in t)
        assert got[k].score < 0
    unseen = [k for k in tokens if held[k] and k < 10_000]
    assert sum(got[k].score for k in unseen) > sum(got[k].base_score for k in unseen)


def test_rows_given_twice_score_as_each_would(spark):
    docs = _lm_rows(spark).where("doc_id is not null")
    learned = docs.withColumn("train", F.lit(True))
    asked = docs.withColumn("train", F.lit(False))
    unseen = spark.createDataFrame([(1, "words that no document has: qqx qqy qqy"), (1, "words that no document has: qqx qqy qqy"), (1, "qqz")], "doc_id long, text string")
    every = learned.unionByName(asked).unionByName(asked).unionByName(unseen.withColumn("train", F.lit(False)))
    got = lm_scoring.score(every, F.col("train")).collect()
    assert len(got) == 3 * docs.count() + 3
    tokens = [[*brute.words(x.text, True), "\n"] for x in docs.collect()]
    count = Counter(w for t in tokens for w in t)
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for x in every.collect():
        t = [*brute.words(x.text, True), "\n"]
        want[x.doc_id, len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t), 3)] += 1
    assert Counter((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 3)) for x in got) == want


def test_sums_of_runs():
    r = np.random.default_rng(5)
    rows = np.sort(r.choice([1, 2, 3, 9], 300, p=[0.5, 0.02, 0.03, 0.45]))
    rows = np.concatenate([rows, np.arange(20, 60), np.repeat(np.arange(70, 80), 3)])
    p, order = r.random((len(rows), 5), dtype=np.float32), r.permutation(len(rows))
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    got = lm_scoring._sums(p, order, first, np.diff(np.append(first, len(rows))))
    assert np.allclose(got, [p[order[rows == x]].sum(0) for x in np.unique(rows)], rtol=1e-4)


def test_nothing_to_learn_from(spark):
    got = lm_scoring.score(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((x.doc_id, x.n_tokens, x.n_known, x.train_tokens) for x in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(x.score) and math.isfinite(x.base_score) for x in got)
    assert lm_scoring.score(brute.frame(spark, []), F.lit(True)).count() == 0


def test_the_model_is_a_distribution():
    """After any history the probabilities of all known words, and one unknown for each tail class, add up to 1."""
    r = np.random.default_rng(2)
    texts = pa.array([" ".join(f"{chr(97 + x % 26)}{chr(97 + x % 7)}{x}" for x in r.zipf(1.4, 50) % 900) for _ in range(80)])
    token, tail, cut = lm_scoring.tokens(lm_scoring.Texts(texts, lower=True))
    word, first, n = np.unique(token, return_index=True, return_counts=True)
    slot = np.full(len(word), -1)
    order = np.argsort(-n, kind="stable")
    slots = lm_scoring.HEADS * lm_scoring.SLOTS
    slot[order[:slots]] = np.arange(slots)
    mass = np.full(lm_scoring.TAILS, 0.5)
    rest = slot < 0
    np.add.at(mass, tail[first][rest], n[rest] + 0.5)
    heads = (n[order[:slots]] + 0.5).reshape(lm_scoring.HEADS, lm_scoring.SLOTS)
    prior = np.log(np.concatenate([heads.sum(1), mass])).astype(np.float32)
    model = lm_scoring.Model(
        word, n, slot, prior, np.log(heads).astype(np.float32), mass,
        r.normal(0, 0.3, (lm_scoring.ROWS, lm_scoring.CLASSES)).astype(np.float32), r.normal(0, 0.3, (lm_scoring.WORD_ROWS, lm_scoring.SLOTS)).astype(np.float32),
    )
    history = lm_scoring.features(token, cut)[37]
    every = np.repeat(history[None], len(word) + lm_scoring.TAILS, 0)
    slots_of, tails_of = np.append(slot, np.full(lm_scoring.TAILS, -1)), np.append(tail[first], np.arange(lm_scoring.TAILS))
    seen = np.append(n, np.zeros(lm_scoring.TAILS)) + 0.5
    p = np.exp(model.log_likelihoods(every, slots_of, tails_of)) * np.where(slots_of >= 0, 1, seen / mass[tails_of])
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_the_model_learns_from_two_words_together(spark):
    # the third word follows from the first two, but from neither alone: 2 bits a text are left, and 3 (-0.903) without the pair
    rows = [(k, f"{'ab'[k % 2]} {'xy'[k // 2 % 2]} {'pq'[(k + k // 2) % 2]}") for k in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    mean = lm_scoring.score(docs, F.lit(True)).agg(F.avg("score")).first()[0]
    assert -0.85 < mean < -0.6


def test_the_weights_grow_with_the_words(spark):
    counts = spark.range(70_000).select(F.xxhash64("id").alias("word"), (F.col("id") % lm_scoring.TAILS).cast("int").alias("tail"), F.lit(50).cast("long").alias("n"))
    model = lm_scoring._start(counts)[0]
    assert (len(model.weights), len(model.word_weights)) == (1 << 17, 1 << 16)
    assert lm_scoring.sized(0) == lm_scoring.sized(1 << 15) == (1 << 15, 1 << 14) and lm_scoring.sized((1 << 20) + 1) == (1 << 21, 1 << 20)
    weights, squares = np.zeros((1 << 17, 2), np.float32), np.zeros(1 << 17, np.float32)
    rows = np.array([[5], [65_541], [131_071], [65_541]])
    lm_scoring._ascend(weights, squares, rows, np.full((4, 2), 0.5, np.float32), np.array([0, 1, 0, 1]))
    assert np.flatnonzero(squares).tolist() == [5, 65_541, 131_071]
    assert weights[5, 0] > 0 > weights[5, 1] and weights[65_541, 1] > 0


# -- language --------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.fold("doc_id", 4) == 2
    found = language_id.identify(docs, docs.where(~held)).join(docs.select("doc_id", "lang"), "doc_id").where(held)
    right, n = found.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.98
    assert found.where("score not between 0 and 1").isEmpty()


def test_texts_without_letters_and_mixtures(spark):
    learned = [(k, t, x) for k, (t, x) in enumerate([("the and of with that this from", "en"), ("der die und nicht auf ist ein", "de")] * 30)] + [(99, "??", None), (98, None, "en")]
    labelled = spark.createDataFrame(learned, "doc_id long, text string, lang string")
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (4, "the of the and that"), (5, "nicht der und DIE ist"), (6, "the and of this " * 30 + "und die der ist " * 60), (7, "中文"), (8, "ª")]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(brute.frame(spark, rows), labelled).collect()}
    assert {k: v[0] for k, v in got.items() if k < 7} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", 6: "de"}
    assert got[1][1] == 0 and 0.5 < got[6][1] < 0.85 and got[4][1] > 0.9 and got[7][0] != "und"
    kept = language_id.keep_identified(brute.frame(spark, rows), labelled)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(k for k, v in got.items() if v[0] != "und") and kept.columns == brute.frame(spark, rows).columns
    none = language_id.identify(brute.frame(spark, rows), labelled.limit(0)).collect()
    assert {x.lang_pred for x in none} == {"und"} and len(none) == len(rows)
    assert language_id.identify(brute.frame(spark, []), labelled).count() == 0


def test_the_language_set_is_penalised():
    r = np.random.default_rng(1)
    # 40 words that are a little likelier in the second language than chance would have it: one language is enough
    one = np.stack([r.normal(0, 0.1, 40), r.normal(-4, 0.1, 40), r.normal(-4, 0.1, 40)], 1).astype(np.float32)
    two = np.concatenate([one, one[:, [1, 2, 0]][:, [0, 2, 1]]])
    best, share = language_id.mixture(np.concatenate([one, two]), np.array([40, 80]))
    assert best[0] == 0 and share[0] > 0.9 and share[1] < 0.6
