import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import pagetext as P


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_is_a_longest_common_subsequence(a, b):
    got = sorted(P.common(a, b))
    assert len(got) == longest(a, b)
    rest = iter(b)
    assert all(any(x == a[i] for x in rest) for i in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b <b>c</b>\n d<br>e", "a\nb c d e"),
        ("<nav>n</nav><article><h1>T</h1><p>x &lt; y</p></article><footer>f</footer>", "T\nx < y"),
        ('<body><div class="ad">buy<div>more</div></div><p class=x>text</p><form><p>name</p></form>', "text"),
        ('<div id="comments"><p>first!</p></div><div class="shade">kept</div>', "kept"),
        ("<script>var t='</p>'; if (a<b) x()</script><style>p{}</style><p>a</p><!-- <p>no</p> --><p title='>'>b</p>", "a\nb"),
        ("<nav><ul><li>never closed<article><p>text</p><section class='reader-comments'>c</section></article>x", "text"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("<head><title>t</title></head><header>h</header><main><header>top</header>m</main>", "top\nm"),
        ("<p>a<!-- open", "a"),
        ("<ul><li class='menu-item'>x<li>y</ul>1 < 2 <3", "y\n1 < 2 <3"),
    ],
)
def test_lines(page, want):
    blocks, inside, has_main = P.lines(page)
    assert "\n".join(b for b, i in zip(blocks, inside) if i or not has_main) == want


def test_differencing_within_hosts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        host = f"h{i % 3}.example"
        own = [f"story {i} line {k}" for k in range(rng.randrange(1, 6))]
        page = "".join(f"<div>{x}</div>" for x in [f"Welcome to {host}", *own, "All rights reserved", f"{host} imprint"])
        rows.append((i, f"http://{host}/s/{i:03}?q=1", page, "clash"))
    rows += [(100, "http://alone.example/", "<p>Welcome to h0.example</p>", "c"), (101, None, "<p>x</p>", "c"), (102, "http://h0.example/", None, "c"), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = P.main_text(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] < 60:
            assert r["text"].split("\n") == [f"story {r['page_id']} line {k}" for k in range(len(r["text"].split("\n")))]
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] >= 100} == {100: "Welcome to h0.example", 101: "x", 102: ""}


def test_same_result_for_any_number_of_ranges(spark):
    rows = [(i, f"http://h/{i % 7}/{i}", f"<p>top</p><p>own {i}</p><p>{'ab'[i % 2]}</p>") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "30"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, P.main_text(pages).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2]


def by_hand(rows, labels):
    """The whole query with one sorted list of pages and a table of alignments."""
    parsed = [P.lines(h, labels) for _, _, h in rows]
    places = [P._place(u) for _, u, _ in rows]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (places[i][1], rows[i][0])):
        first.setdefault((places[i][0], parsed[i][2], tuple(parsed[i][0])), i)
    order = sorted(first.values(), key=lambda i: (*places[i], rows[i][0]))
    size = lambda x: sum((min(255, len(y) // 8)) + 1 for y in x)
    gone = {}
    for k, i in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and places[order[j]][0] == places[i][0] and places[i][0]]
        near.sort(key=lambda j: -len(os.path.commonprefix([places[i][1], places[j][1]])))
        for j in near:
            mine, other = parsed[i][0], parsed[j][0]
            shared = P.common([P.hashed(x) for x in mine], [P.hashed(x) for x in other])
            assert len(shared) == longest(mine, other)
            if size([mine[x] for x in shared]) < P.COPY * size(mine):
                gone[i] = shared
                break
    out = []
    for i, (page, url, _) in enumerate(rows):
        blocks, inside, has_main = parsed[i]
        same = gone.get(first[places[i][0], has_main, tuple(blocks)], set())
        kept = [b for b, x in zip(blocks, inside) if x] if has_main else [b for k, b in enumerate(blocks) if k not in same]
        out.append((page, url, "\n".join(kept), len("\n".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("labels", "sent"), [(True, P.BROADCAST_LINES), (True, 0), (False, 0)])
def test_whole_query_by_hand(spark, monkeypatch, labels, sent):
    monkeypatch.setattr(P, "BROADCAST_LINES", sent)
    rng = random.Random(11)
    rows = []
    for i in range(150):
        host = rng.choice(["a.example", "b.example", "b.example", "c.example"])
        own = [f"<p>story {rng.randrange(60)} of {host} with some words</p>" for _ in range(rng.randrange(5))]
        menu = "".join(f"<li>{x}</li>" for x in rng.sample(["home", "news", "about", "shop"], 3))
        body = "".join(own)
        shape = rng.randrange(4)
        page = f"<nav>{menu}</nav>" if shape else f"<ul>{menu}</ul>"
        page += f"<article>{body}</article>" if shape == 1 else body
        page += f"<div class='ad'>buy {rng.randrange(5)}</div><footer>(c) {host}</footer><div>imprint of {host}</div>"
        rows.append((i, f"http://{host}/{rng.choice('xyz')}/{rng.randrange(40)}?q={i}", page))
    rows += [(200 + i, *rows[i][1:]) for i in range(5)] + [(300, None, "<p>x</p>"), (301, "http://a.example/x", None), (3, *rows[3][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert sorted(map(tuple, P.main_text(pages, labels).collect()), key=str) == by_hand(rows, labels)


def test_a_very_long_page(spark):
    body = "".join(f"<p>line {i} of it</p>" for i in range(30_000))
    rows = [(1, "http://a/1", f"<p>top</p>{body}<p>end</p>"), (2, "http://a/2", "<p>top</p><p>other text of this page</p><p>end</p>")]
    got = {r["page_id"]: r["text"] for r in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].split("\n") == [f"line {i} of it" for i in range(30_000)] and got[2] == "other text of this page"


def test_empty_table(spark):
    assert P.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_on_one_host_keep_their_text(spark):
    def page(*own):
        return "".join(f"<div>{x}</div>" for x in ("Welcome to the host", *own, "All rights reserved"))

    story = [f"a long line of the story, number {k}, with words enough" for k in range(30)]
    other = [f"a line of a story of another kind, number {k}" for k in range(5)]
    rows = [(i, f"http://copies.example/a?page={i}", page(*story)) for i in range(40)]
    rows += [(50, "http://copies.example/b", page(*other))]
    rows += [(60 + i, f"http://near.example/a?page={i}", page(*story, f"seen {i} times")) for i in range(10)]
    rows += [(70 + i, f"http://equal.example/{i}", page(*story)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in P.main_text(pages).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i] == story
    assert got[50] == other
    for i in [*range(60, 70), 70, 71]:
        assert set(story) <= set(got[i])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='container no-sidebar'><p>text</p></div>", "text"),
        ("<div class='content with-sidebar'><p>text</p><div class='sidebar'>s</div></div>", "text"),
        ("<div class='has-header'><div class='site-header'>h</div><p>text</p></div>", "text"),
        ("<article><div class='article-header'><h1>T</h1></div><p>x</p><section id='related-work'>w</section><div class='client-side'>c</div></article>", "T\nx\nw\nc"),
        ("<main><div class='header'><h2 class='banner'>T</h2></div>x</main>", "T\nx"),
        ("<h1 class='header'>T</h1><p>x</p>", "T\nx"),
        ("<div class='sidebar'><p>most of the text of the page</p><p class='ads'>a</p></div><p>end</p>", "most of the text of the page\nend"),
        ("<div data-role='footer'>kept</div><div role='navigation'>n</div><p>the text of this page</p>", "kept\nthe text of this page"),
        ("<p>the text of this page, and more of it</p><div class='x left-sidebar'>s</div><ul id='main_nav'><li>n</ul><div class='ad-slot-2'>a</div><div class='cookie-banner'>c</div><div class='sponsored'>s</div>", "the text of this page, and more of it"),
    ],
)
def test_names_of_furniture_are_whole_tokens(page, want):
    blocks, inside, has_main = P.lines(page)
    assert "\n".join(b for b, i in zip(blocks, inside) if i or not has_main) == want
