"""Tokens, language model, classifiers, HTML: against brute force, round trips and held-out rows."""

import math
import random
import string
import time
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from runlore.llm import bpe, html_text, language_model, quality, toxicity, words

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


def test_tokens_of_odd_texts(codec):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeéñß日本 the\n\t  .,!?'s12  😀ing") for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += ["a" * 2000, " " * 3000, "ab" * 1500, "\x00\xff" * 50, "", None]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert [*map(int, ids.split())] == TIKTOKEN.encode_ordinary(text or "") and codec.decode(ids) == (text or "").encode()


def test_appends_edits_and_prefixes(codec):
    rng = random.Random(2)
    for _ in range(60):
        data = "".join(rng.choice("abcdeth ing.\n") for _ in range(rng.randint(0, 500))).encode()
        grown = bpe.PrefixEncoding(codec.vocabulary)
        for i in range(0, len(data), 7):
            grown.append(data[i : i + 7])
        assert grown.last == bpe.PrefixEncoding(codec.vocabulary, data).last
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 9))
        new = bytes(rng.choice(b"abthe ing") for _ in range(rng.randint(0, 12)))
        grown.edit(a, b, new)
        assert grown.last == bpe.PrefixEncoding(codec.vocabulary, data[:a] + new + data[b:]).last
        assert grown.tokens(a) == bpe.PrefixEncoding(codec.vocabulary, data[:a]).tokens()
    long = bpe.PrefixEncoding(codec.vocabulary, b"the thing " * 500)
    assert long.edit(1000, 1001, b"Q") < 600


def test_token_columns(docs, no_docs):
    rows = docs.select("doc_id", "text", bpe.bpe_codes(docs, RANKS, public_tokenizers.PATTERN).alias("x")).collect()
    for r in rows:
        assert r.x.token_ids == TIKTOKEN.encode_ordinary(r.text or "") and r.x.n_tokens == len(r.x.token_ids) and r.x.decoded == (r.text or "").encode()
    assert no_docs.select(bpe.bpe_digests(no_docs, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_words_in_chunks(monkeypatch):
    data = "".join(random.Random(3).choice("ab \n\x0b\x1c") for _ in range(3000)).encode() + b"x" * 900 + b" y"
    whole = words.word_places(data)
    monkeypatch.setattr(words, "_CHUNK", 64)
    for a, b in zip(whole, words.word_places(data), strict=True):
        assert (a == b).all()
    assert [data[s:e] for s, e in zip(whole[1], whole[2], strict=True)] == data.split()


def tokens(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).encode().split() + [b"</s>"]


def test_language_model(docs, corpus):
    train = [r[1] for r in corpus if r[0] is not None and r[0] % 10]
    model = language_model.train_language_model(docs.filter("doc_id % 10 <> 0"))
    texts = [tokens(t) for t in train]
    count = Counter(w for t in texts for w in t)
    total, size = sum(count.values()), len(count)
    pairs = Counter(p for t in texts for p in zip([b"<s>", *t], t))
    of_counts = Counter(pairs.values())
    d2 = language_model._discounts(np.array([of_counts[k] for k in (1, 2, 3, 4)]))
    follows = Counter(b for _, b in pairs)
    of_counts = Counter(follows.values())
    d1 = language_model._discounts(np.array([of_counts[k] for k in (1, 2, 3, 4)]))
    less = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    left = sum(less(n, d1) for n in follows.values()) / len(pairs)
    context, free = Counter(), Counter()
    for (a, _), n in pairs.items():
        context[a] += n
        free[a] += less(n, d2)

    def p(a, w):
        low = (follows[w] - less(follows[w], d1)) / len(pairs) + left / (size + 1)
        return (pairs[a, w] - less(pairs[a, w], d2)) / context[a] + free[a] / context[a] * low if context[a] else low

    assert sum(p(b"<s>", w) for w in count) + free[b"<s>"] / context[b"<s>"] * left / (size + 1) == pytest.approx(1)
    by_text = {r[1] or "": None for r in corpus}
    got = language_model.language_model_scores(docs, model).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect()
    for r in got:
        t = tokens(r.text)
        if r.text and by_text.get(r.text, 0) is None and r.n_tokens == len(t):
            assert r.n_known == sum(count[w] > 0 for w in t)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (size + 1))) for w in t))
            assert r.score == pytest.approx(sum(math.log10(p(a, w)) for a, w in zip([b"<s>", *t], t)))
    assert model.tokens == total and len(got) > 150


def test_language_model_of_nothing(no_docs, docs):
    model = language_model.train_language_model(no_docs)
    row = language_model.language_model_scores(docs, model).filter("n_tokens = 2").first()
    assert row.base_score == 0 and row.score == pytest.approx(0) and row.n_known == 0
    assert language_model.language_model_scores(no_docs, model).count() == 0


def test_counts_of_texts(corpus):
    texts = [r[1] for r in corpus]
    found, out = quality.base_counts(texts)
    for text, row in zip(texts, out.itertuples(), strict=True):
        own = (text or "").encode().split()
        windows, covered = Counter(zip(own, own[1:], own[2:])), set()
        for i in range(len(own) - 2):
            if windows[tuple(own[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert (row.n_words, row.word_chars, row.n_dup_lines, row.n_repeat_words) == (
            len(own), sum(len(w.decode()) for w in own), len(lines) - len(set(lines)), len(covered)
        )
    assert list(found.counts) == list(out["n_words"])


def labelled(rng, good):
    said = [f"{rng.choice(['ban', 'tor', 'mel', 'sin'])}{rng.choice(['da', 'ro', 'li', 'ku'])}{rng.randrange(40)}" for _ in range(120)]
    return " ".join(said) if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "***"]) for w in said)


def test_quality_on_held_out_rows(spark, docs, no_docs):
    rng = random.Random(7)
    model = quality.train_quality([(labelled(rng, i % 3 > 0), int(i % 3 > 0)) for i in range(120)])
    rows = [(labelled(rng, i % 2), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "text string, y int")
    got = df.select("y", quality.quality(df, model).alias("q")).collect()
    assert sum(r.q.kept == bool(r.y) for r in got) >= 58
    assert docs.select(quality.quality(docs, model).alias("q")).filter("q.kept is null").count() == 0
    assert no_docs.select(quality.quality(no_docs, model)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.fit_quality(docs, labels).probabilities(words.words_of(["any text"], lower=False))[0] > 0.99


def test_toxicity_of_unseen_misspellings(spark, docs, no_docs):
    rng = random.Random(8)
    bad = ["horribleperson", "worthlessfool", "despicableliar"]

    def text(toxic, spoil):
        out = labelled(rng, True).split()
        for _ in range(4 * toxic):
            w = list(rng.choice(bad))
            if spoil:
                w[rng.randrange(4, len(w))] = rng.choice("xyz")
            out[rng.randrange(len(out))] = "".join(w)
        return " ".join(out)

    model = toxicity.train_toxicity([(text(i % 4 == 0, False), int(i % 4 == 0)) for i in range(300)], min_seen=3)
    rows = [(text(i % 2, True), i % 2) for i in range(80)]
    scores = model.scores([r[0] for r in rows])
    assert sum((s >= 0.5) == r[1] for s, r in zip(scores, rows, strict=True)) >= 74
    got = docs.select(toxicity.toxicity_score(docs, model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got) and no_docs.select(toxicity.toxicity_score(no_docs, model)).count() == 0
    assert toxicity.train_toxicity([]).scores(["", None, "x"]).tolist() == [0.5] * 3


def test_rare_insults_are_learnt_by_default():
    rng = random.Random(9)
    bad = ["gorblax", "vexnip", "quzzok", "fyrwump"]  # in 6 of 24 toxic rows each
    rows = [(" ".join([labelled(rng, True), *[bad[i % 4]] * 3]), 1) for i in range(24)] + [(labelled(rng, True), 0) for _ in range(120)]
    model = toxicity.train_toxicity(rows)
    clean = labelled(rng, True)
    scores = model.scores([clean, *[f"{clean} {w} {w} {w}" for w in bad]])
    assert all(s > 1.5 * scores[0] for s in scores[1:])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside>More</aside>
<article><h1>A &amp; B</h1><p>First <b>bold</b>er\n  text&nbsp;here.<br>Next</p><form><input><button>Send</button></form><p>Second&eacute; paragraph of the text.</p>
<section class="comments"><p>A long reader comment that says a lot about nothing in particular.</p></section></article><footer>c</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "A & B First bolder text here. Next Secondé paragraph of the text."), (None, ""), ("", ""), ("plain text", "plain text"),
        ("<p>cut off <b>here", "cut off here"), ("<![weird[<p>x</p>", "x"), ("<article></article><div class='ad'>buy</div>", ""),
        ("<div id='menu'><a href='/'>a</a></div><div><h1>Head</h1><p>" + "long text " * 30 + "</p><p>short</p></div><div><a href='/x'>link</a></div>", "Head " + "long text " * 30 + "short"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "long text that says something " * 8
CARD = "<article><h3>Card</h3><p>Read on</p></article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>end</p></div>{CARD}", f"Head {LONG}{LONG}end"),
        (f"{CARD}<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>end</p></div>", f"Head {LONG}{LONG}end"),
        (f"<main>{CARD}<div><p>{LONG}</p><p>end</p></div></main>", f"{LONG}end"),
        (f"<div><p>{LONG}</p></div><article><p>{LONG}</p><p>end</p></article>", f"{LONG}{LONG}end"),
        (f"<div><p>{LONG}</p></div><main><p>Read on</p></main>", LONG.strip()),
    ],
)
def test_ratios_choose_the_region(page, text):
    assert html_text.main_text(page) == text


BODY = f"<h1>Head</h1><p>{LONG}</p><p>end</p>"
SAID = f"Head {LONG}end"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content has-sidebar'>{BODY}</div>", SAID), (f"<article class='post no-comments'>{BODY}</article>", SAID),
        (f"<div id='page' class='no-sidebar'>{BODY}</div>", SAID), (f"<div class='with_widget-area'>{BODY}</div>", SAID),
        (f"<div class='layout sidebar-left'><article>{BODY}</article></div><div class='related'><p>{LONG}</p></div>", SAID),
        (f"<div class='page widget'>{BODY}</div><div class='related'><p>Read on</p></div>", SAID),
        (f"<article><h1>Head</h1><p class='notice'>{LONG}</p><p>end</p><p class='share'><a href='/x'>Share</a></p></article>", SAID),
        (f"<main><div class='widget'><article>{BODY}</article></div></main>", SAID),
        (f"<article>{BODY}<section class='comments'><article><p>{LONG * 9}</p></article></section></article>", SAID),
        (f"<article>{BODY}</article><div id='comments'><article><p>{LONG * 9}</p></article></div>", SAID),
        (f"<article>{BODY}</article><div class='ad-no-border'>{LONG * 9}</div>", SAID),
    ],
)
def test_names_alone_drop_no_main_text(page, text):
    assert html_text.main_text(page) == text


def test_smoothing_keeps_the_mean_of_flat_ratios():
    assert html_text.smoothed(np.full(9, 3.0)) == pytest.approx(np.full(9, 3.0))


def test_page_column(spark):
    rows = spark.createDataFrame([(1, PAGE, "x"), (2, None, "y")], "page_id int, html string, text string")
    assert [r.t[:5] for r in rows.select(html_text.main_text_column().alias("t")).collect()] == ["A & B", ""]
    assert rows.filter("false").select(html_text.main_text_column()).count() == 0
    assert isinstance(pd.Series(dtype=object), pd.Series)


LONG = "The page speaks at length about what its readers came for, in whole sentences, one after the other. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><p class="ad">Buy now<p>{LONG}<p>Second: {LONG}</article>', f"{LONG}Second: {LONG}"),
        (f'<main><p>{LONG}</p><ul><li class="share">Share<li>First of the items<li>Second of them</ul></main>', f"{LONG}First of the items Second of them"),
        (f'<nav>Home</nav><div class="main-content alert"><p>{LONG * 3}</p></div>', LONG * 3),
        (f'<div><section class="related work"><p>{LONG * 2}</p></section><section><p>{LONG}</p></section></div>', LONG * 3),
        (f"<article><p>{LONG}<table><tr><td>One cell<td>another<tr><td>and a last one</table><dl><dt>word<dd>what it means</dl></article>", f"{LONG}One cell another and a last one word what it means"),
    ],
)
def test_ends_that_html_takes_as_read(page, text):
    assert html_text.main_text(page) == text.strip()


def test_ratios_decide_where_no_element_does(monkeypatch):
    links = "".join(f'<div><a href="/{i}">A teaser of another page, number {i}</a></div>' for i in range(9))
    page = f"<body><div>{links}</div><div><p>{LONG * 3}</p><p>{LONG * 2}</p></div><div>{links}</div></body>"
    assert html_text.main_text(page) == (LONG * 5).strip()
    monkeypatch.setattr(html_text, "smoothed", lambda ratios, sigma=1.0: np.ones(len(ratios)) * (len(ratios) > 0))
    assert html_text.main_text(page) != (LONG * 5).strip()


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "word", "<p>" + "<span>" * 100_000 + "<div>x" * 1_000, "<b>" * 100_000 + "<p>x y z</p>" * 2_000,
    "<p><button>" + "<div>" * 100_000, "<ul><li>" + "<b>" * 100_000 + "<li>a b c" * 1_000, "<div>" * 100_000 + "</p>" * 100_000,
])
def test_time_grows_with_the_page_alone_where_elements_nest(page):
    """A walk over all open elements for each tag would take minutes here."""
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 30


def test_starts_end_elements_that_html_takes_as_read():
    lines = html_text._Lines()
    lines.feed("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<button><div>f</div></button><div>g</div><table><tr><td>h<td>i<tr><td>j</table>")
    lines.close()
    assert [x[0] for x in lines.lines] == list("abcdeghij")  # a button's text takes no part
    assert len(lines.open) == 1 and not any(lines.places.values()) and lines.links == 0
