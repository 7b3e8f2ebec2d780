"""Page differencing: alignments against a plain table, hosts of planted templates, broken markup, whole tables."""

import random
import re

import pytest

from tablewarden.llm import page_text, queries


def plain_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        below = [0]
        for j, y in enumerate(b):
            below.append(row[j] + 1 if x == y else max(below[j], row[j + 1]))
        row = below
    return row[-1]


@pytest.mark.parametrize("bits", [page_text.TABLE_BITS, 8])
def test_alignment_is_a_longest_common_subsequence(bits, monkeypatch):
    monkeypatch.setattr(page_text, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(400):
        a, b = ([rng.randrange(rng.randint(1, 8)) for _ in range(rng.randint(0, 25))] for _ in range(2))
        at = page_text.aligned(a, b)
        assert at == sorted(set(at)) and len(at) == plain_length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)


def test_long_alignments_are_quick():
    rng = random.Random(1)
    a = [rng.randrange(50) for _ in range(8000)]
    assert len(page_text.aligned(a, a[:3000] + [-1] + a[3001:])) == 7999


def texts(page):
    return page_text.blocks_of(page)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:"</p>"}</style></head><body><div class="cookie-notice">Cookies!</div>
    <ul id="mainMenu"><li>Home<li>News</ul><p class=ad>Buy<p>One &amp; <b>t</b>wo&nbsp;
    lines<br>here<script>var a = "<p>no</p>";</script> too<!-- <p>hidden</p> --><div data-x="a > b">Three</div><form><p>Send</p></form>tail &#233; &lt;b&gt;"""
    assert texts(page) == [(0, "Cookies!"), (0, "Home"), (0, "News"), (0, "Buy"), (2, "One & two lines here too"), (2, "Three"), (0, "Send"), (2, "tail é <b>")]


def test_article_and_main():
    page = "<body><p>before<main><p>aside</p><article><header><h1>Head</h1><p>by me</p></header><p>Text<section class='comments'><article class=comment><p>No</p></article></section><p>More</article></main><footer>F"
    assert texts(page) == [(2, "before"), (2, "aside"), (1, "Head"), (0, "by me"), (1, "Text"), (0, "No"), (1, "More"), (0, "F")]
    assert texts("<p>x</p><div role=main><p>y</div>z") == [(2, "x"), (1, "y"), (2, "z")]
    assert texts('<p><span class="share">Tweet <span>now</span></span>text <span>more</span>') == [(0, "Tweet now"), (2, "text more")]


def test_attributes():
    page = '<p aria-hidden="false" data-id="sidebar" title="the class of ad">a<p CLASS=ad class=x>b<p hidden>c<div id=\'cookieBar\'>d</div><p class="article-header">e<p role=search>f'
    assert texts(page) == [(2, "a"), (0, "b"), (0, "c"), (0, "d"), (2, "e"), (0, "f")]


@pytest.mark.parametrize("page", ["", "<", "<p", "<p class='", "a < b > c", "<p class=\"x>text</p>more", "<script>never ends", "</p></div>x", "<!-- open", "<p>" * 5000 + "x"])
def test_broken_markup_is_read(page):
    page_text.blocks_of(page)


def planted(rng, hosts=6, pages=12):
    """Pages without any mark: a menu, the host's line, own paragraphs, a footer of the host; some quote a neighbour."""
    rows, wanted = [], {}
    number = 0
    for h in range(hosts):
        menu = "".join(f"<div>menu {h} {i}</div>" for i in range(5))
        for p in range(pages):
            own = [f"paragraph {rng.random()} of {number}" for _ in range(rng.randint(1, 8))]
            if p % 4 == 3:
                own.insert(1, rows[-1][2].split("<p>")[1].split("</p>")[0])  # a passage of the page before
            body = "".join(f"<p>{x}</p>" for x in own)
            rows.append((number, f"https://h{h}.example.org/a/{p:03}", f"<body><div>Site {h}</div>{menu}{body}<div>All rights {h}</div></body>"))
            wanted[number] = "\n".join(own)
            number += 1
    return rows, wanted


def extracted(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, key string, text int")
    return sorted(((r.page_id, r.text) for r in page_text.extract_text(pages.repartition(3), **options).collect()), key=str)


@pytest.mark.parametrize("trust", [True, False])
def test_templates_of_hosts_are_deleted(spark, trust):
    rows, wanted = planted(random.Random(4))
    found = dict(extracted(spark, rows, trust_markup=trust))
    assert found == wanted


def test_copies_of_a_page_keep_their_text(spark):
    rows, wanted = planted(random.Random(5), hosts=1)
    copies = [(100 + i, f"https://h0.example.org/a/{5:03}?{i}", rows[5][2]) for i in range(40)] + [rows[5]] * 3
    found = extracted(spark, rows + copies)
    assert all(text == wanted[page if page < 100 else 5] for page, text in found)
    assert len(found) == len(rows) + len(copies)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (None, "x", "<p>b</p>"), (3, "http://only.org/", "<p>alone</p>"), (4, "http://h.org/1", None), (5, "http://h.org/2", ""), (5, "http://h.org/2", "<nav>m</nav>")]
    rows += [(6, "http://t.org/a", "<p>t"), (7, "http://t.org/b", "<p>t<p>u"), (8, "http://long.org/", "<p>" + "word <p>" * 50_000)]
    found = extracted(spark, rows)
    assert [x for x in found if x[0] != 8] == sorted([(1, "a"), (None, "b"), (3, "alone"), (4, ""), (5, ""), (5, ""), (6, ""), (7, "u")], key=str)
    assert dict(found)[8].count("\n") == 49_999
    assert extracted(spark, rows[:0]) == []


def test_spans_overlap(spark, monkeypatch):
    monkeypatch.setattr(page_text, "SPAN", 4)
    rows, wanted = planted(random.Random(6), hosts=2, pages=30)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sketched = page_text.cut(page_text.sketches(pages.withColumns({"host": page_text.host_column(page_text.F.col("url")), "path": page_text.path_column(page_text.F.col("url")), "key": page_text.F.col("page_id")}), True))
    shared = {r.key: r.shared for r in page_text.deletions(sketched).collect()}
    assert {k: len(v) for k, v in shared.items()} == {k: 7 for k in wanted}


def test_query_gives_the_marked_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    found = queries.QUERIES["op11_page_text"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(pages)
    for r in found:
        marked = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [page_text.SPACE.sub(" ", page_text.html.unescape(re.sub("</?b>|<br>", " ", x))).strip() for x in re.split("</?(?:p|h1)>", marked)]
        assert r.text == "\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)
