"""Main text of pages, and nearest neighbours."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import crf, dom, hnsw

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field():
    return crf.train(crf.labelled([]))


def test_leaf_blocks():
    page = '<p>a <b>b</b>c<br>d &amp; &#233;<p>e<script>var t="</p>";</script><ul><li>f<li>g</ul><!-- <p>no</p> --><style>p{}</style><div hidden>h</div>i'
    assert [b.text for b in dom.blocks(page)] == ["a bc d & é", "e", "f", "g", "i"]
    assert dom.blocks("") == [] and [b.text for b in dom.blocks("<p <<x>a</p")] != []


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p>a <svg class="i"/>b</p><p>c', ["a b", "c"]),
        ("<p>a <svg><title/><style/><path d=1 /></svg>b</p><p>c", ["a b", "c"]),
        ("<div><button>Share</div><p>c</p>", ["c"]),
        ("<div>a<button>Share<p>c</p></div>d", ["a", "c", "d"]),
        ("<div><object data=x><param name=y></div><p>c</p><div><object>z</object></div>e", ["c", "e"]),
        ("<p>Pick <select><option>a<option>b</select> now</p>", ["Pick now"]),
        ("<select><option>a<option>b<p>c", ["c"]),
        ("<p>a<svg-icon name=x></svg-icon>b</p><object-card>c</object-card><title-bar>d</title-bar><p>e", ["ab", "cd", "e"]),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> then", ["if x=2 then"]),
        ('<article data-title="The hidden city"><p>a</article><div class="lead hidden md:block"><p>b</div>', ["a", "b"]),
        ("<div data-x='display:none'>a</div><div title='x' hidden>b</div><div HIDDEN=''>c</div><div style='color:red;display : none'>d</div>", ["a"]),
        ("<title>t</title><script>var a = '<p>b';</script ><textarea><p>c</textarea><noscript><img src=x>d</noscript><template><p>e</p></template>f", ["f"]),
        ("<ul><li><svg><li>a</li><li>b</li></ul><p>c</p></svg>", ["a", "b", "c"]),
        ("<p><button></p><p>a</p></button>b", ["a", "b"]),
        ("<button><div>a</div></button><p>b</p><button>c", ["b"]),
    ],
)
def test_text_beside_what_is_no_text(page, texts):
    assert [b.text for b in dom.blocks(page)] == texts


def test_many_unclosed_elements_take_linear_time():
    for tag in ("button", "object", "svg", "select", "template"):
        assert [b.text for b in dom.blocks(f"<{tag}>" * 20_000 + "<p>a")] == ["a"]


def test_extraction_of_odd_layouts(field):
    page = (
        '<html><body><header><a href=x>Site</a></header><div class="menu"><ul><li><a>Home</a></li></ul></div><div class="cookie-notice">We use cookies.</div>'
        '<article><header><h1>T &amp; t</h1></header><p>Hello wor<b>ld</b>, this is text.<p>More <br>text here.<aside>pull</aside><div class="ad">buy</div>'
        '<ul><li>one<li>two</ul><section class="comments"><p>reader says.</p></section></article><aside class="sidebar"><p>side</p></aside>'
        "<form><p>sub</p><input></form><footer>&copy; me</footer></body></html>"
    )
    blocks = dom.blocks(page)
    assert " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y) == "T & t Hello world, this is text. More text here. one two"


KEPT = "<p>The council met on Monday to talk about the new bridge.</p><p>Work on it is to begin in the spring, the mayor said.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<main class="page has-sidebar">{KEPT}</main>',
        f'<article class="post comment-open tag-news">{KEPT}</article>',
        f'<article class="post has-share-bar">{KEPT}</article>',
        f'<article class="entry legal">{KEPT}</article>',
        f'<body class="single no-sidebar comments-closed"><div class="entry-header"></div><div class="post-content">{KEPT}</div><div class="comment-body"><p>Good news for all of us here.</p></div></body>',
        f'<div class="topbar"><ul><li><a href=a>Home</a></li><li><a href=b>World news</a></li><li><a href=c>Sport</a></li></ul></div><div class="story">{KEPT}</div>'
        '<div class="rail"><ul><li><a href=d>Ten towns to see</a></li><li><a href=e>What we eat</a></li><li><a href=f>Rain again</a></li></ul></div>',
        f'<div id="cookieNotice"><p>We use cookies.</p></div><article>{KEPT}<div class="related-links"><a>More</a></div></article><div class="site-footer-links"><p>Contact us</p></div>',
    ],
)
def test_names_of_a_state_leave_the_article(field, page):
    blocks = dom.blocks(f"<html>{page}</html>" if "<body" in page else f"<html><body>{page}</body></html>")
    kept = " ".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)
    assert kept == " ".join(b.text for b in dom.blocks(KEPT))


def test_meaning_of_names():
    expected = {"sidebar": "sidebar", "sidebar-left": "sidebar", "has-sidebar": "", "cookie-notice": "notice", "comment-open": "open", "comment-body": "comment", "post-header": "post", "main-content": "content", "tag-news": "news", "-": ""}
    assert {n: crf.meaning(n) for n in expected} == expected


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    monkeypatch.setattr(crf, "SAMPLE_PAGES", 5)
    seen = []
    monkeypatch.setattr(crf, "labelled", lambda sample: seen.append(sample) or [crf.compose(list(crf.FILLER), random.Random(1))])
    pages = spark.range(300).select(F.lit(1).alias("page_id"), F.concat(F.lit("<p>"), F.greatest(F.col("id"), F.lit(200))).alias("html"))
    crf.fit(pages)
    assert len(seen[0]) == 5 == len(set(seen[0]))


def test_accuracy_on_held_out_layouts(field):
    rng, wrong, n = random.Random(99), 0, 0
    for _ in range(200):
        page, labels = crf.compose(list(crf.FILLER), rng)
        wrong += sum(a != b for a, b in zip(field.decode(page), labels, strict=True))
        n += len(labels)
    assert wrong < 0.02 * n


def test_viterbi_is_the_best_of_all_labellings(field):
    rng = random.Random(3)
    for _ in range(20):
        page = crf.compose(list(crf.FILLER), rng)[0][:8]

        def value(labels, page=page):
            names = crf.features(page)
            emit = sum(field.weights.get(f, (0.0, 0.0))[y] for fs, y in zip(names, labels, strict=True) for f in fs)
            return emit + sum(field.edges[a][b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(value([k >> b & 1 for b in range(len(page))]) for k in range(2 ** len(page)))
        assert value([int(y) for y in field.decode(page)]) == pytest.approx(best)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in crf.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (None, None, "", 2), (3, "u", "<p>" + "word " * 20000, 3), (3, "u", "<p>" + "word " * 20000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = crf.main_text(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 99999, 99999]
    assert crf.main_text(pages.where("false")).count() == 0


def truth(ids, x, queries, k=5):
    out = {}
    for q in queries:
        own = x[ids.index(q)]
        best = sorted((-float(hnsw.cosine(own, row[None])[0]), i) for i, row in zip(ids, x, strict=True) if i != q)
        out[q] = [i for _, i in best[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = found(hnsw.nearest(rows, F.col("vec_id") % 50 == 0, shard_rows=500))
    best = truth(list(range(1200)), x.astype(float), range(0, 1200, 50))
    assert np.mean([len({*got[q]} & {*best[q]}) / 5 for q in best]) >= 0.9


def test_blocks_and_shards_are_not_broadcast(spark):
    """One block of 200 queries, 100 KB, meets 12 shards: 1.2 MB as a table of all visits."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1m")
    try:
        got = found(hnsw.nearest(rows, F.col("vec_id") % 6 == 0, shard_rows=100))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    best = truth(list(range(1200)), x, range(0, 1200, 6))
    assert got.keys() == best.keys() and np.mean([len({*got[q]} & {*best[q]}) / 5 for q in best]) >= 0.9


def test_vectors_meet_those_of_their_length_only(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(4, 6, 9)[i % 3]).tolist()) for i in range(300)]
    got = found(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, shard_rows=20))
    assert got.keys() == {0, 50, 100, 150, 200, 250}
    for q, near in got.items():
        own = [i for i in range(q % 3, 300, 3)]
        assert near == truth(own, np.array([rows[i][1] for i in own]), [q])[q]


def test_copies_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    x[100:250] = x[0]  # half of all rows are one vector
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(hnsw.nearest(rows, F.col("vec_id") % 50 == 0))
    assert got[0] == [100, 101, 102, 103, 104] and got[100] == [0, 101, 102, 103, 104]
    assert len(got[50]) == 5 and 50 not in got[50]


@pytest.mark.parametrize("times", [2, 7])
def test_repeated_rows_are_one(spark, times):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    x[:12] = x[0]  # more copies than can be results
    x[100:103] = x[100]  # fewer
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * times
    got = found(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    assert got == truth(list(range(200)), x, range(0, 200, 50))


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((i, [1.0, i / 100]) for i in range(1, 8)), *((i, [i / 50, 1.0]) for i in range(1, 8))]
    out = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in out) == [(k, k) for k in range(1, 6)]


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (50, None, 1), (100, [0.0, 0.0], 1), (150, [float("nan"), 1.0], 1), (200, [1.0, None], 1), (250, [1e200, 1e200], 2),
        (None, [1.0, 1.0], 1), (3, [float("inf"), 1.0], 1), (4, [2.0, 0.0], 1), (4, [2.0, 0.0], 1), (5, [1.0, 2.0, 3.0], 1), (300, [], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = found(hnsw.nearest(frame, F.col("vec_id") % 50 == 0))
    assert got[0][0] == 4 and set(got) <= {0, 250} and 0 not in got[0]
    assert hnsw.nearest(frame.where("false"), F.lit(True)).count() == 0
