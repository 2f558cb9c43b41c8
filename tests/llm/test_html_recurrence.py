from collections import defaultdict

import pytest

from logloom.llm.html_extract import extract_main_text, hash_subtrees, main_container, main_text, parse

SCHEMA = "page_id long, url string, html string"


def article(n):
    return f"<h1>Title {n}</h1>" + "".join(f"<p>{'words of the article ' * 10}{n} {i}</p>" for i in range(4)) + f"<ul><li>item {n}</li></ul>"


def texts(spark, pages):
    rows = [(i, f"http://a.example.org/{i}", html) for i, html in enumerate(pages)]
    return {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div class='nav'>{k}</div><article>{a}</article></body>"
    got = texts(spark, [page.format(k=i, a=article(0 if i < 20 else i)) for i in range(25)])
    assert len(got) == 25 and all(got[i].startswith(f"Title {0 if i < 20 else i} words") and got[i].endswith(f"item {0 if i < 20 else i}") for i in got)
    assert len({got[i] for i in range(20)}) == 1
    # without a named container, and with equal rows
    got = texts(spark, [article(0)] * 12 + [article(1)])
    assert all(t.endswith(f"item {i // 12}") for i, t in got.items())


def test_containers_that_recur_inside_the_article_go(spark):
    box = "<div class='x7'><p>Read our other guides</p><ul><li>one</li></ul></div>"
    quote = "<p>As everybody says here.</p>"
    page = "<body><article>{a}{b}{q}</article></body>"
    # few pages, and a small share of many pages; running text that recurs stays
    for n, every in ((6, 2), (60, 10)):
        got = texts(spark, [page.format(a=article(i), b=box if i % every == 0 else "", q=quote if i % 2 else "") for i in range(n)])
        assert not any("guides" in t for t in got.values())
        assert all(t.startswith(f"Title {i} words") and f"item {i}" in t and t.endswith("says here.") == bool(i % 2) for i, t in got.items())


def test_near_copies_of_an_article_keep_their_text(spark):
    parts = "".join(f"<section><p>{'words of a section ' * 20}{k}</p></section>" for k in range(3))
    got = texts(spark, [f"<body><article><h1>Title {i}</h1>{parts}</article></body>" for i in range(5)])
    assert all(t.count("words of a section") == 60 for t in got.values())


def test_all_main_containers_in_page_order():
    assert main_text("<body><p>x</p><article><p>a</p></article><div><article><p>longer b</p></article></div><aside><article>y</article></aside></body>") == "a longer b"
    assert main_text("<body><nav>n</nav><main><h1>Title</h1><article><p>text</p></article><p>end</p></main></body>") == "Title text end"
    assert main_text("<body><section class='content'><p>a</p></section><p>x</p><section class='content'><div class='body'><p>b c</p></div></section></body>") == "a b c"


def test_recurrence_alone_removes_blocks_without_telling_names(spark):
    """No main container, no known class name: what is left is decided by the counts."""
    chrome = "<div class='q1'><p>All stories of the week</p></div><div class='q2'><div><p>Contact the office</p></div></div>"
    got = texts(spark, [f"<body>{chrome}<div class='q3'>{article(i)}</div><div class='q4'><p>Printed in the town</p></div></body>" for i in range(6)])
    assert all(t.startswith(f"Title {i} words") and t.endswith(f"item {i}") for i, t in got.items())


def test_counts_of_hosts_equal_brute_force(spark):
    pages = {(r.page_id, r.url): r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    contents, holders = defaultdict(set), defaultdict(set)
    for (_, url), html in pages.items():
        main = main_container(parse(html))[0]
        blocks = {n.subtree for n in hash_subtrees(main) if n is not main}
        host = url.split("/")[2]
        contents[host].add(main.subtree)
        for s in blocks:
            holders[host, s].add(main.subtree)
    want = {}
    for (i, url), html in pages.items():
        host = url.split("/")[2]
        n = {s: len(holders[host, s]) for h, s in holders if h == host}
        total = len(contents[host])
        strict = {s for s, k in n.items() if k >= 10 and k > 0.6 * total}
        want[i] = main_text(html, strict, {s for s, k in n.items() if k >= 3 and k > 0.02 * total})
    assert {r.page_id: r.text for r in extract_main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()} == want


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<p ", "<", "</", "<!", "<!--", "<script>", "<div>", "</div>", "<i><li>", "<a \"'", "<b x='\"", "<p><i>", "<td>", "&", "<div><p>"])
def test_broken_markup_is_read_in_linear_time(piece):
    import time

    start = time.process_time()
    main_text(piece * 100_000)
    assert time.process_time() - start < 8


def test_broken_markup_is_read_leniently():
    assert main_text("a <b then <p>c</p>") == "a <b then c"
    assert main_text('<p title="x>y">a</p><p title="open>b</p><p>c') == "a b c"
    assert main_text("<p>1 < 2 and 3 > 2</p><a href='x") == "1 < 2 and 3 > 2"
    assert main_text("<p>a<!-- <p>x --> b</p><!doctype html><p>c<br/>d</p><!-- open <p>z") == "a b c d"
