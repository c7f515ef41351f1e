"""Page extraction on hand-made sites; neighbour search against brute force."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.llm import neighbours, pages

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a>News {i}</a></ul></nav>
<div class="cookie-notice">We use cookies {i}</div>
<div id="content">{open}<h1>Story&nbsp;{i}</h1><p>First <b>bo</b>ld &amp; plain&#33; {i}<br>next line<p>Second {i}
<div class="share-links">Share this</div><p class="note">Subscribe to our letter</p><form><input><button>Go</button></form>
<section class="comments"><p>Reader {i} says hi</p></section>{close}</div>
<aside>Related {i}</aside><!-- ad --><div class="ad">Buy {i}</div><footer>&copy; {i}</footer></body></html>"""


def site(n, tag):
    return [PAGE.format(i=i, open=f"<{tag}>", close=f"</{tag}>") for i in range(n)]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_template_and_regions_are_left_out(tag):
    for i, text in enumerate(pages.extract(site(8, tag))):
        assert text == f"Story {i} First bold & plain! {i} next line Second {i}"


def test_few_pages_have_no_template():
    assert pages.extract(site(1, "article")) == ["Story 0 First bold & plain! 0 next line Second 0 Subscribe to our letter"]


def test_copies_do_not_become_template():
    same = site(1, "article") * 9
    assert set(pages.extract(same)) == {"Story 0 First bold & plain! 0 next line Second 0 Subscribe to our letter"}


def test_unmarked_pages_and_broken_markup():
    assert pages.extract(["", "plain text", "<p>a<p>b < c", "<div class='x>unclosed", "<script>never closed"])[:3] == ["", "plain text", "a b < c"]
    body = "<body><div><div>nav</div><div><p>" + "long text here. " * 20 + "</p></div></div></body>"
    assert pages.extract([body])[0] == ("long text here. " * 20).strip()


@pytest.mark.parametrize("attrs", ['style="overflow: hidden"', 'title="The hidden cost"', 'href="/posts/hidden-gems"', 'data-hidden="false"', "data-class='ad' data-role=navigation", 'class="comments-open no-sidebar"', 'class="layout-with-sidebar" id="post-tags-7-view"', 'class="widget"'])
def test_words_in_other_attributes_and_parts_of_classes_drop_nothing(attrs):
    assert pages.extract([f"<body><div {attrs}><article><p>All of <a {attrs.replace('widget', 'x')}>this</a> text</article></div></body>"]) == ["All of this text"]
    assert pages.extract([f"<body><article {attrs}><p>All of this text</article></body>"]) == ["All of this text"]


@pytest.mark.parametrize("attrs", ["hidden", "hidden=''", "title='x' hidden", "class='x sidebar'", "class=share-links", "id=comments-section", "role=navigation", "class='ad unclosed"])
def test_whole_attributes_and_classes_still_drop(attrs):
    assert pages.extract([f"<body><article><p>All of this text</p><div {attrs}>no</div></article></body>"]) == ["All of this text"]


def test_region_with_most_text_is_kept_but_not_longer_comments():
    assert pages.extract(["<body><div class=ad>buy</div><div class='widget'><p>Most of the text of this page</p></div></body>"]) == ["Most of the text of this page"]
    assert pages.extract(["<article><p>Short</p><section class=comments>A reader says far more than that</section></article>"]) == ["Short"]


@pytest.mark.parametrize("first", ["", "plain text", "<body><main><p>Another layout</p></main></body>", "<body><div id=top><b>x</b></div><article><p>No letter here</p></article></body>"])
def test_template_does_not_hang_on_the_first_page(first):
    got = pages.extract([first, *site(8, "article"), first])
    assert got[1:9] == [f"Story {i} First bold & plain! {i} next line Second {i}" for i in range(8)]
    assert got[0] == got[9] == pages.extract([first])[0]


def test_two_layouts_of_a_host_each_have_their_template():
    other = [f"<body><main><h2>Note {i}</h2><p>Body {i}</p><div class=box>Always the same</div></main></body>" for i in range(5)]
    mixed = [p for pair in zip(site(5, "article"), other) for p in pair]
    got = pages.extract(mixed)
    assert got[0::2] == [f"Story {i} First bold & plain! {i} next line Second {i}" for i in range(5)]
    assert got[1::2] == [f"Note {i} Body {i}" for i in range(5)]


def test_copies_of_one_layout_among_other_pages_are_no_template():
    copy = "<body><main><h2>Title</h2><p>The only text</p></main></body>"
    assert pages.extract([*site(6, "article"), *[copy] * 6])[6:] == ["Title The only text"] * 6


def test_matching_keeps_order_and_ancestry():
    a = pages.folded(pages.parse("<div><p>1</p><ul><li>x</li></ul><h2>t</h2></div>"))
    b = pages.folded(pages.parse("<div><h2>t</h2><p>1</p><table></table><ul><li>y</li></ul></div>"))
    size, pairs = pages.align(a, b)
    assert size == len(pairs) == 5  # root, div, p, ul, li


BARE = """<html><body><div class="x1"><div class="x2">The Daily Example, since 1990</div><div class="x3">{links}</div></div>
<div class="x4"><div class="x5"><h1>Story {i}</h1><div class="x6"><p>{prose}</p><p>More of story {i}, told by hand.</p><div class="x7">All rights belong to someone.</div></div></div>
<div class="x8"><div>{links}</div><p>We print on Fridays.</p></div></div><div class="x9">Call 555</div></body></html>"""


def test_templates_without_telling_names():
    """Nothing but alignment tells what is common to the pages of a host; menus differ from page to page."""
    links = lambda i: "".join(f"<a href='/{k}'>Topic {k} of {i}</a> " for k in range(i, i + 6))
    prose = lambda i: f"On day {i} something else happened. " * (8 + i)
    made = [BARE.format(i=i, prose=prose(i), links=links(i)) for i in range(9)]
    want = [f"Story {i} {prose(i)}More of story {i}, told by hand." for i in range(9)]
    assert pages.extract(made) == want
    assert pages.extract(made[:1])[0] != want[0]  # one page shows no template
    assert pages.extract([*made[:5], "", made[5], made[5]]) == [*want[:5], "", want[5], want[5]]


def test_constant_members_of_a_run_are_template():
    made = [f"<body><article><h1>T {i}</h1><p>First {i}</p><p>Second {i}</p><p>Write to us</p></article></body>" for i in range(6)]
    assert pages.extract(made) == [f"T {i} First {i} Second {i}" for i in range(6)]


def test_names_never_drop_prose_of_the_article():
    assert pages.extract(['<article class="post comment-open"><p>Real body text</p></article>']) == ["Real body text"]
    assert pages.extract(['<article><p class="notice">One.</p><div class="side">Two.</div><p>Three.</p></article>']) == ["One. Two. Three."]
    assert pages.extract(['<body><div class="notice">Not this</div><div><p>The longer text of the page</p></div></body>']) == ["The longer text of the page"]
    made = [f'<article><h1>A {i}</h1><p>Body {i}</p><p class="notice">Mind that {i}</p><ul><li><a>See {i}</a></li></ul><section class="comments"><p>Nice {i}</p></section></article>' for i in range(6)]
    assert pages.extract(made) == [f"A {i} Body {i} Mind that {i} See {i}" for i in range(6)]


def test_deep_and_wide_pages():
    deep = lambda i: "<html><body>" + "<div>" * 5000 + f"<p>Deep {i} text</p>" + "</div>" * 5000 + "</body></html>"
    rows = lambda i: "<table>" + "".join(f"<tr class={'odd' if k % 2 else 'even'}><td>{k} of {i}</td></tr>" for k in range(10_000)) + "</table>"
    begun = time.time()
    assert pages.extract([deep(i) for i in range(5)]) == [f"Deep {i} text" for i in range(5)]
    for i, text in enumerate(pages.extract([f"<body><article>{rows(i)}</article></body>" for i in range(4)])):
        assert text == " ".join(f"{k} of {i}" for k in range(10_000))
    assert time.time() - begun < 60


def test_query_covers_every_row(spark):
    rows = [(i, f"https://Host{i % 2}.example.org/p?{i}", h) for i, h in enumerate(site(20, "article"))] + [(90, None, "<p>x"), (91, "not a url", None), (92, "http://a/", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in pages.main_texts(df.union(df.where("page_id = 3")), group=6).collect()}
    assert len(got) == 23 and got[90].text == "x" and got[91].text == "" and got[92].n_chars == 0
    assert got[4].text == "Story 4 First bold & plain! 4 next line Second 4" and got[4].n_chars == len(got[4].text)
    assert pages.main_texts(df.limit(0)).count() == 0


def brute(ids, x, k, queries):
    out = {}
    for q in queries:
        scores = (x * x[ids.index(q)]).sum(1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(ids[i], scores[i]) for i in order]
    return out


@pytest.mark.parametrize("spreaded", [False, True])
def test_neighbours(spark, spreaded):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    if spreaded:
        x *= rng.uniform(0.1, 3, (600, 1)).astype(np.float32)
    x[100:180] = x[100]  # one vector many times
    ids = list(range(600))
    rows = [(i, x[i].tolist(), 0) for i in ids] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1020, [None] + [1.0] * 15, 0), (1040, [float("inf")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(ids, x.astype(float), 20, [i for i in ids if i % 20 == 0])
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def verified(x, ids, who, k=20):
    """Share of all pairs that one region's search verifies, and its recall."""
    top = np.linalg.norm(x, axis=1).max()
    project = np.random.default_rng(neighbours.SEED).standard_normal((x.shape[1] + 1, neighbours.DIMENSIONS))
    points = np.hstack([x, np.sqrt(np.maximum(0, top**2 - (x**2).sum(1)))[:, None]]) @ project
    found, pairs = neighbours.search(ids, x, points, x[who], x[who] @ project[:-1], top, k, neighbours.chi_quantile(neighbours.CONFIDENCE, neighbours.DIMENSIONS))
    scores = x[who] @ x.T
    hits = sum(len(set(got) & set(ids[np.lexsort((ids, -s))[:k]])) for (got, _), s in zip(found, scores))
    return pairs / scores.size, hits / (k * len(who))


def test_the_stopping_test_fires_where_neighbours_are_near():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((80, 64))
    x = centres[rng.integers(0, 80, 4000)] + 0.15 * rng.standard_normal((4000, 64))
    share, recall = verified(x / np.linalg.norm(x, axis=1)[:, None], np.arange(4000), np.arange(0, 4000, 20))
    assert share < 0.1 and recall >= 0.95
    x = rng.standard_normal((2000, 64))  # all distances alike: most rows have to be looked at
    share, recall = verified(x / np.linalg.norm(x, axis=1)[:, None], np.arange(2000), np.arange(0, 2000, 20))
    assert share < 0.8 and recall >= 0.93


def test_regions_shards_and_rounds(spark):
    """Clusters in many small regions, a vector in a third of all rows, and vectors of another length."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    x = (centres[rng.integers(0, 40, 1500)] + 0.2 * rng.standard_normal((1500, 16))).astype(np.float32)
    x[1000:] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [1.0] * (3 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, region=100).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(list(range(1500)), x.astype(float), 20, range(0, 1500, 20))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(found, found[1:]))
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
        if q >= 1000:  # equal vectors: ties go to the smallest ids
            assert [f[1] for f in found] == [w[0] for w in want[q]]
    assert hits >= 0.95 * 20 * len(want)


def test_cuts_cover_everything():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.standard_normal((500, 4)), np.ones((300, 4))])
    cuts = neighbours.Cuts(points[::2], 16)
    at = cuts.region(points)
    assert 8 <= cuts.regions <= 16 and set(at) <= set(range(cuts.regions)) and np.bincount(at).max() <= 400
    assert set(neighbours.Cuts(points[:0], 5).region(points)) == {0}


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (22, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 21, 0.5), (20, 2, 22, 0.5)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_chi_square_matches_simulation():
    draws = (np.random.default_rng(0).standard_normal((200_000, 8)) ** 2).sum(1)
    for x in (2.0, 7.3, 15.5):
        assert neighbours.chi_square(np.array([x]), 8)[0] == pytest.approx((draws <= x).mean(), abs=5e-3)
