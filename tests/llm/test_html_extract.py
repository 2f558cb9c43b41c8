import html as H
import re

from logloom.llm.html_extract import extract_main_text, host_of, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body class="page menu-open">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title&nbsp;{n}</h1></header><p>One <b>bo</b>ld<br>line{n} &lt;x&gt; &amp &am</p><div class="ad">Buy</div>
<p>Unclosed {n}<p>Next<script>var t="</p>";</script><form>Name <input></form>
<ul><li>first{n}<li>second{n}</ul><table><tr><td>c1{n}<td>c2{n}</table><div>Follow us on everything</div>
<section id="comments"><article class="comment"><p>{long}</p></article></section></article></main>
<aside>Side</aside><div id="sidebar">Bar</div><footer>&copy; 2020</footer></body></html>"""


def test_article_without_boilerplate():
    text = main_text(PAGE.format(n=1, long="reader " * 200))
    assert text == "Title 1 One bold line1 <x> & &am Unclosed 1 Next first1 second1 c11 c21 Follow us on everything"


def test_template_subtrees_are_removed_by_host(spark):
    own = lambda n: f"<p>{'words of page ' * 8}{n}</p>"
    rows = [(n, f"https://A.example.org:80/p/{n}", PAGE.format(n=n, long="x")) for n in range(12)]
    rows += [(100 + n, f"http://b.example.org/{n}", f"<div><div>Top bar<p>chrome</p></div>{own(n)}<p>{'q ' * (n % 2)}</p><ul><li><a>l{n}</a><li><a>m</a></ul></div>") for n in range(8)]
    rows += [(200, "http://c.example.org/", PAGE.format(n=5, long="x")), (None, None, None), (307, "http://x/", ""), (307, "http://x/", ""), (308, "http://y/", "<p>a<div " + "z" * 100000), (309, "", "plain &eacute; text  here")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_main_text(df).collect()), key=str)
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert "Follow us" not in by[3] and by[3].startswith("Title 3 One bold line3") and by[3].endswith("c13 c23")
    assert by[200].endswith("Follow us on everything")
    assert by[103] == ("words of page " * 8 + "3 q").strip() and by[102] == "words of page " * 8 + "2"
    assert by[None] == "" and by[307] == "" and by[309] == "plain é text here"
    assert extract_main_text(df.where("page_id = -1")).count() == 0


def test_deep_nesting():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_host():
    assert [host_of(u) for u in ("https://u:p@Ex.org:8/x", "ex.org/a", None)] == ["ex.org", "", ""]


def test_query_equals_a_plain_reading(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["op3_html_extraction"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = " ".join(H.unescape(re.sub(r"</?(h1|p|br)>", " ", re.sub(r"</?b>", "", article))).split())
        assert r.text == plain and r.n_chars == len(plain)


def test_names_of_boilerplate():
    keep = '<div class="article-header"><p>a</p></div><section class="post-content"><p>b</p></section><figure><figcaption>c</figcaption></figure><blockquote>d</blockquote>'
    drop = "".join(f"<div {a}><p>x</p></div>" for a in ('class="cookiebar"', 'id="reader-comments"', 'class="ad-slot"', 'class="siteSidebar"', 'role="complementary"', "hidden", 'style="display: none"', 'class="newsletterBox"', 'aria-hidden="true"', 'class="social-share"', 'class="notice"'))
    assert main_text(f"<body><article>{keep}{drop}<footer>f</footer></article></body>") == "a b c d"
