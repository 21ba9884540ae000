import html
import re

import pytest

from keyweave.llm.queries import op7_site_style_tree
from keyweave.llm.site_style_tree import TreeRule, extract_text, host_of, node_importance, parse_page

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><aside>Side</aside>
<article><header><h1>The  title&nbsp;here</h1></header><p>One <b>bold</b>word &amp; more<br>line<p>Two &lt;x&gt; 3 < 4
<form><input><button>Go</button></form><div class="comments"><p>Nice!</p></div></article>
<footer>End</footer></body></html>"""


def pages(spark, values):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(values)], "page_id bigint, url string, html string")


def texts_of(df):
    return [r.main_text for r in sorted(df.collect(), key=lambda r: r.page_id)]


def test_article_only(spark):
    found = texts_of(extract_text(pages(spark, [("http://a.b/c", PAGE)])))
    assert found == ["The title here One boldword & more line Two <x> 3 < 4"]


def test_repeated_branches_of_a_site_go(spark):
    layout = '<body><div class="x1"><p>Always the same line</p></div><div class="x2"><p>Own text number {i} only</p></div><div>{more}</div></body>'
    rows = [("http://s.org/%d" % i, layout.format(i=i, more=f"tail {i}")) for i in range(8)]
    found = texts_of(extract_text(pages(spark, rows)))
    assert found == [f"Own text number {i} only tail {i}" for i in range(8)]
    alone = texts_of(extract_text(pages(spark, rows[:1])))
    assert alone == ["Always the same line Own text number 0 only tail 0"]


def test_other_hosts_do_not_matter(spark):
    row = "<body><div><p>Always the same line</p></div></body>"
    found = texts_of(extract_text(pages(spark, [(f"http://h{i}.org/", row) for i in range(6)])))
    assert found == ["Always the same line"] * 6


def test_importance(spark):
    rows = [("b", "p", i) for i in range(4)]
    df = spark.createDataFrame(
        [("h", [{"path": "/a/p", "mark": 1, "digest": i, "text": "t"}, {"path": "/a/q", "mark": 1, "digest": 7, "text": "t"}], [{"path": "/a", "digest": 1}]) for i in range(len(rows))],
        "host string, blocks array<struct<path:string,mark:tinyint,digest:bigint,text:string>>, nodes array<struct<path:string,digest:bigint>>",
    )
    found = {r.path: r.importance for r in node_importance(df, TreeRule()).collect()}
    assert found["/a/p"] == pytest.approx(0.9) and found["/a/q"] == pytest.approx(0.0)


def test_odd_pages(spark):
    rows = [
        (None, None),
        ("", ""),
        ("http://a.b/", "plain text only"),
        ("http://c.d/", "<p>open <b>tags <p>and </div> stray"),
        ("http://e.f/", "<script>never closed <p>x"),
        ("http://g.h/", "<article>" + "<p>long one</p>" * 20_000),
        ("http://g.h/", '<a title="a > b" href=x>link</a> text'),
        ("http://i.j/", "<div>" * 3000 + "deep"),
    ]
    df = pages(spark, rows).selectExpr("*", "'own' AS host", "'own' AS weak", "'own' AS main_text2")
    found = texts_of(extract_text(df))
    assert found[:5] == ["", "", "plain text only", "open tags and stray", ""]
    assert found[5] == " ".join(["long one"] * 20_000)
    assert found[6:] == ["link text", "deep"]
    again = extract_text(df.union(df)).collect()
    assert len(again) == 16 and {r.host for r in again} == {"own"}
    assert extract_text(pages(spark, rows).limit(0)).collect() == []


def test_host():
    assert host_of("HTTPS://user@Www.A.org:8080/x?y#z") == "www.a.org"
    assert host_of(None) == host_of("no url") == ""


def test_noise_keeps_no_text():
    blocks, _ = parse_page("<nav>menu</nav><p>text</p>")
    assert [(b["mark"], b["text"]) for b in blocks] == [(0, None), (1, "text")]


def test_repeated_branches_inside_articles_go(spark):
    page = '<article><h1>Title {i}</h1><p>Own text number {i} of this article</p><div class="x7"><p>Follow us there</p></div></article>'
    found = texts_of(extract_text(pages(spark, [(f"http://s.org/{i}", page.format(i=i)) for i in range(6)])))
    assert found == [f"Title {i} Own text number {i} of this article" for i in range(6)]


def test_copied_articles_keep_their_text(spark):
    page = '<nav>{nav}</nav><article><h1>Title</h1><div class="body"><p>The same long text on all pages</p><p>{edit}</p></div></article>'
    equal = [("http://s.org/%d" % i, page.format(nav=f"page {i}", edit="end")) for i in range(5)]
    edited = [("http://t.org/%d" % i, page.format(nav="", edit="end" if i else "stop")) for i in range(5)]
    text = "Title The same long text on all pages "
    assert texts_of(extract_text(pages(spark, equal + edited))) == [text + "end"] * 5 + [text + "stop"] + [text + "end"] * 4
    other = [("http://s.org/o", page.replace("The same", "Another").format(nav="", edit="tail"))]
    assert texts_of(extract_text(pages(spark, equal + other)))[:5] == [text + "end"] * 5


def test_state_words_are_no_names(spark):
    rows = [
        "<body class='single has-sidebar'><article><p>text</p></article></body>",
        "<div id='content' class='with-sidebar'><article><p>text</p></article></div>",
        "<article class='post comments-open'><p>text</p></article>",
        "<body class='sidebar top'><article><p>text</p></article></body>",
        "<div aria-hidden='false' title='a hidden gem'>text</div>",
        "<p>text</p><div class='sidebar-2'>no</div><div class='post-footer'>no</div><p hidden>no</p>",
    ]
    found = texts_of(extract_text(pages(spark, [(f"http://h{i}.org/", page) for i, page in enumerate(rows)])))
    assert found == ["text"] * len(rows)


def test_comments_notices_and_adverts_inside_articles_go(spark):
    rows = [
        "<article><p>text</p><article class='comment'><p>no</p></article></article>",
        "<article><p>text</p><section id='comments'><article><p>no</p></article></section></article>",
        "<article><p>text</p><div class='user-comment'>no</div><div class='cookie-bar'>no</div><div class='ad-slot'>no</div></article>",
        "<article><p>text</p></article><article class='comment reply-2'><p>no</p></article>",
        "<main><article class='post'><p>text</p></article></main>",
        "<main><div class='widget'>text</div></main>",
        "<article><div class='wrap'><div class='entry-content'><p>text</p></div></div><article class='post comments-open'></article></article>",
        "<div class='site-header'>no</div><div>text</div>",
        "<article><h2 id='comments'>text</h2></article>",
    ]
    found = texts_of(extract_text(pages(spark, [(f"http://h{i}.org/", page) for i, page in enumerate(rows)])))
    assert found == ["text"] * len(rows)


def test_hints_of_noise_need_more_importance(spark):
    page = "<article><p>Own text number {i} of it</p><div class='{name}'><p>{text}</p></div></article>"
    for name, kept in [("widget", False), ("plain", True), ("comments-about", False)]:
        rows = [(f"http://s.org/{i}", page.format(i=i, name=name, text=["first", "second", f"tail {i}"][i % 3])) for i in range(9)]
        found = texts_of(extract_text(pages(spark, rows)))
        assert [t.endswith("of it") for t in found] == [not kept] * 9, name


def test_nested_articles_are_judged_by_their_site(spark):
    page = "<article><p>Own text number {i} of it</p><article><p>{more}</p></article></article>"
    same = texts_of(extract_text(pages(spark, [(f"http://s.org/{i}", page.format(i=i, more="Again")) for i in range(6)])))
    assert same == [f"Own text number {i} of it" for i in range(6)]
    own = texts_of(extract_text(pages(spark, [(f"http://s.org/{i}", page.format(i=i, more=f"Part {i}")) for i in range(6)])))
    assert own == [f"Own text number {i} of it Part {i}" for i in range(6)]


def test_deep_pages_take_memory_for_their_elements():
    blocks, nodes = parse_page("<div class='a'>" * 50_000 + "deep" + "<b>" * 50_000 + "er" + "<br>x</i>" * 50_000)
    assert blocks[0]["text"] == "deeper" and len(blocks) == 50_001
    assert max(len(b["path"]) for b in blocks) <= 33 and max(len(n["path"]) for n in nodes) <= 16
    first, second = parse_page("<div><p>one</p></div><div class='x'><p>two</p></div>")[0]
    assert first["path"] != second["path"]


def test_query(spark, folder):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op7_site_style_tree(spark, folder).collect()
    assert len(rows) == len(raw)
    for r in rows:
        article = re.search(r"(?s)<article>(.*?)(</article>|\Z)", raw[r.page_id])[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == " ".join(filter(None, blocks)) and r.n_chars == len(r.text)
