"""Template extraction: planted pages of several templates, vectors by brute force, odd rows."""
from collections import defaultdict

import pytest
from gridweave.llm.html import TEXT, Page, classes, extracted, templates, tokenized
from pyspark.sql import functions as F

SENTENCES = ["The river rose for %d days & the bridge held.", "Nobody asked about item %d < 10.", "It was sold twice, number %d says."]


def article(i, n=3):
    return [f"Title of story {i}"] + [SENTENCES[k % 3] % (i * 7 + k) for k in range(n + i % 4)]


def escaped(x):
    return x.replace("&", "&amp;").replace("<", "&lt;")


def plain(i):
    blocks = article(i)
    body = "".join(f"<p><b>{escaped(x)}<br>" for x in blocks[1:])
    return (
        f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><script>var t=\"</p><article>\";</script></head><body><nav><ul><li><a href='/a'>Home {i}</a><li><a>News</a></ul></nav>"
        f"<div class=ad>Buy {i} now.</div><article><h1>{blocks[0]}</h1>{body}<div class='comments'><p>Reader {i} says hello.</p></div></article><footer>&copy; us {i}</footer>"
    ), blocks


def soup(i):
    """Divs without telling names, and the same line on every page inside the article."""
    blocks = article(i, 6)
    body = "".join(f"<p>{escaped(x)}</p>" for x in blocks[1:])
    menu = "".join(f"<div><a href='/{k}'>Section {k} of the site {i % 2}</a></div>" for k in range(4))
    return f"<html><body><div class='a1'>{menu}</div><div class='a2'><h1>{blocks[0]}</h1><span>Share this story</span>{body}</div><div class='a3'>Box {i}</div></body></html>", blocks


def framed(i):
    """A header, sidebars, notices, forms and comments around a main element with a list and a table."""
    blocks = article(i)
    body = "".join(f"<p>{escaped(x)}</p>" for x in blocks[1:])
    return (
        f"<html><body class='has-sidebar'><header><h1>The Site</h1><p>Of today {i}</p></header><div id='cookie-notice-{i}'>We use cookies {i}.</div>"
        f"<main><article class='post'><header><h1>{blocks[0]}</h1><p>By nobody {i}</p></header>{body}<aside>See {i} too</aside><ul><li>One {i}<li>Two {i}</ul>"
        f"<table><tr><td>Cell {i}<td>Next {i}</table><form><p>Mail {i}</p><button>Go</button></form></article><section id='comments'><article><p>I say {i}.</p></article></section></main>"
        f"<div class='sidebar-left'><p>Left {i}</p></div><div hidden>Secret {i}</div><style>p{{}}</style></body></html>"
    ), [*blocks, f"One {i}", f"Two {i}", f"Cell {i}", f"Next {i}"]


@pytest.fixture(scope="module")
def planted(spark):
    made = [(i, f"https://{name}.example.com/{i}", *f(i)) for name, f in (("plain", plain), ("soup", soup), ("framed", framed)) for i in range(12)]
    rows = [(k, url, html, "x", k) for k, (_, url, html, _) in enumerate(made)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, slots int").repartition(4), {k: "\n".join(m[3]) for k, m in enumerate(made)}


def test_articles_of_several_templates(planted):
    pages, want = planted
    got = extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_shuffled_to_large_templates(planted):
    pages, want = planted
    assert {r.page_id: r.text for r in extracted(pages, sent_tokens=0).collect()} == want


def test_classes_are_equal_vectors(planted):
    pages, _ = planted
    found = tokenized(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html")).cache()
    vectors, own, n_pages = defaultdict(dict), defaultdict(int), defaultdict(int)
    for r in pages.collect():
        host = r.url.split("/")[2]
        n_pages[host] += 1
        for role, x in Page(r.html).seen.items():
            vectors[host, role][r.page_id] = x[0]
            own[host, role] = x[5]
    want = defaultdict(set)
    for (host, role), v in vectors.items():
        if 2 * len(v) >= n_pages[host] and (own[host, role] != TEXT or len(v) >= 6):
            want[host, tuple(sorted(v.items()))].add(role)
    got = defaultdict(set)
    for r in classes(found).collect():
        got[r.host, r.f1, r.f2].add(r.role)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert {len(r.constant) for r in templates(found).collect() if r.host.startswith("soup")} == {1}


def test_a_class_in_two_orders_is_not_valid(spark):
    rows = [(i, "http://h/", "<html><body>" + ("<div class=x>a</div><div class=y>b</div>" if i % 2 else "<div class=y>b</div><div class=x>a</div>") + f"<p>Words {i}</p></body></html>") for i in range(4)]
    found = tokenized(spark.createDataFrame(rows, "page_id long, url string, html string").select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.lit("h").alias("host"), "html"))
    tags = templates(found).first().tags
    x = Page(rows[0][2])
    paths = {path for path in (v[2] for v in x.seen.values())}
    assert tags == [] and len(paths) == 6


def test_copies_are_no_template(spark):
    html = plain(3)
    rows = [(i, "http://copies.example.com/", html[0]) for i in range(9)]
    assert {r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"\n".join(html[1])}


def test_odd_rows(spark):
    rows = [
        (1, "http://a.example.com/", None), (2, None, ""), (3, "no url", "just words &amp; &#x41;&nbsp;b"), (4, None, "<p>One<p>Two</div></p>"), (4, None, "<p>One<p>Two</div></p>"), (None, "http://b", "<article>x <b>y</b>z<!-- <p> --></article"),
        (5, "http://c/", "<div>" * 3000 + "deep" + "</div>" * 2000), (6, "http://d/", "<article>" + "<p>word word</p>" * 20000 + "</article>"), (7, "http://e/", "<script>never ends <p>x"), (8, "http://f/", "<a href='x>y</a><p title=\">\">q"),
        (9, "http://g/", "<article><p>a<script>if (a < b) c()</script>b</p>&am</article>"), (10, "http://i/", "a<![CDATA[<p>&amp;]]>"),
    ]
    got = extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == texts[2] == texts[7] == [""]
    assert texts[3] == ["just words & A b"] and texts[4] == ["One\nTwo"] * 2 and texts[None] == ["x yz"]
    assert texts[5] == ["deep"] and texts[6] == ["\n".join(["word word"] * 20000)] and texts[9] == ["ab\n&am"] and texts[10] == ["a<p>&amp;"]
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
