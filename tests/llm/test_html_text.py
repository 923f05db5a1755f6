import re
import time
from html import unescape

from tidemark.llm.html_text import _mark, _signed, host_of, main_text, nested, page_texts, parse

SF = "/root/testdata/sf0.01"


def test_articles_of_the_pages_table(spark):
    """A plain cut of the article element, the only layout of these pages, gives the same texts."""
    rows = page_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        h = html[r.page_id] or ""
        cut = re.search(r"<article>(.*?)</article>", h, re.S)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:/?p|/?h1|br)>", cut[1])] if cut else []
        assert r.text == "\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


def made(k, body):
    nav = "".join(f"<li><a href='/{i}'>Topic {i * k}</a></li>" for i in range(4))
    return (
        f"<html><body class=x><header><h2>Site {k % 3}</h2></header><div id='bar'><ul>{nav}</ul></div><div class='cookie-note'>We use cookies {k}</div>"
        f"<div id='c'><h1>Title {k}</h1>{body}<p>Read our terms before use.</p></div><section id='comments'><p>Nice one {k}</p></section>"
        f"<form><input name=q><button>Go {k}</button></form><div class=right><a href='/a'>Other story {k}</a></div></body></html>"
    )


def test_pages_without_an_article_element(spark):
    body = "<p>First words of story {k} stand here,\n and  go on &amp; on.</p><p>Second <b>part</b> of {k}.</p>"
    pages = [(k, f"http://a.example/{k}", made(k, "".join([body.format(k=k)] * (1 + k % 3)))) for k in range(30)]
    rows = {r.page_id: r.text for r in page_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(30):
        want = [f"Title {k}"] + [f"First words of story {k} stand here, and go on & on.", f"Second part of {k}."] * (1 + k % 3)
        assert rows[k].split("\n") == want


def bare(k):
    """A page whose names and tags say nothing; the story is told from the rest by the template alone."""
    rest = "".join(f"<div class=q><div class=r>Offer of the week with a few words more</div><div class=s>Call us at any hour of the day</div></div>" for _ in range(2))
    return f"<html><body><div class=a>The daily bulletin of our town and its people</div><div class=b><h1>Title {k}</h1>" + f"<p>Words of story {k} that stand nowhere else.</p>" * (1 + k % 4) + f"</div>{rest}<div class=z>Printed by the bulletin press in our town since long ago</div></body></html>"


def test_the_template_decides_where_names_say_nothing(spark):
    pages = [(k, f"http://b.example/{k}", bare(k)) for k in range(24)]
    want = {k: "\n".join([f"Title {k}"] + [f"Words of story {k} that stand nowhere else."] * (1 + k % 4)) for k in range(24)}
    for rows in (pages, pages + pages):  # repeated rows leave the classes as they are
        got = page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert all(main_text(h, {}) != want[k] for k, _, h in pages)


def test_names_around_an_article():
    for name in ("layout-sidebar-right", "content-with-sidebar", "page-with-nav", "form-page", "sidebar"):
        assert main_text(f"<div class='{name}'><p>menu</p><article><h1>t</h1><p>text</p><div class=ad>x</div></article></div>", {}) == "t\ntext"
    assert main_text("<div id=comments><article><p>reader</p></article></div><main><p>text</p></main>", {}) == "text"


def test_a_page_of_five_megabytes():
    item = "<li class=i><a href='/x'>link {k}</a><p>text {k} of the list with its words</p></li>"
    page = "<html><body><main><ul>" + "".join(item.format(k=k) for k in range(70_000)) + "</ul></main></body></html>"
    tags = sorted(set(parse(page).tags))
    began = time.time()
    text = main_text(page, {_signed(_mark(t)) or 1: hash(t[:3]) % 5 for t in tags})
    assert len(page) > 5e6 and text.count("\n") >= 70_000 and time.time() - began < 60
    deep = "<div>" * 200_000 + "<p>x</p>" + "</b></div>" * 200_000
    assert main_text(deep, {}) == "x"


def test_odd_pages(spark):
    odd = [(1, None, None), (None, "", ""), (2, "x", "no tags < at all &lt;"), (3, "http://a/", "<article>a<script>var x='</article>'</script> b<br>c</article><nav>n</nav>"), (3, "http://a/", "<article>" + "<p>w &nbsp; v</p>" * 20000), (4, "http://b", "<div title='unclosed><p>t</p>"), (5, "http://b", "<nav>only a menu</nav>")]
    out = page_texts(spark.createDataFrame([(*x, 1) for x in odd], "page_id long, url string, html string, text long")).collect()
    texts = sorted(r.text[:12] for r in out)
    assert len(out) == 7
    assert texts.count("") >= 3
    assert "a b\nc" in texts and "no tags < at" in texts
    assert max(r.n_chars for r in out) == 20000 * 4 - 1
    assert page_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_nest():
    assert nested([(0, 1, 9), (1, 5, 8), (2, 6, 8), (3, 2, 9)]) == {8, 9}
    assert len(nested([(0, 1, 9), (1, 5, 8), (2, 2, 9), (3, 6, 8)])) == 1
    assert nested([(0, 1, 9), (1, 2, 9), (2, 2, 9), (3, 1, 9)]) == set()
    assert host_of("HTTPS://u@WWW.a.b:80/c?d") == "www.a.b"
    assert main_text("<p>a</p><div class='has-sidebar'><p>b</p></div><div class=sidebar>c</div>", {}) == "a\nb"
    assert [b.text for b in parse("<p class=ad>x<p>y").blocks if b.weight] == ["y"]


PARAGRAPHS = "".join(f"<p>Part {k} of the report tells at some length what was seen.</p>" for k in range(8))
PARTS = "\n".join(f"Part {k} of the report tells at some length what was seen." for k in range(8))


def test_teasers_do_not_replace_the_article():
    teasers = "<article><a href=/1>Other story</a></article>"
    assert main_text(f"<body><div class='content'>{PARAGRAPHS}</div><div class='related'>{teasers}</div></body>", {}) == PARTS
    assert main_text(f"<body><div>{PARAGRAPHS}</div><ul>{'<li>' + teasers + '</li>'}<li>{teasers}</li></ul></body>", {}) == PARTS
    assert main_text(f"<body><article>{PARAGRAPHS}</article><div class=related>{teasers}</div></body>", {}) == PARTS


def test_names_inside_an_article_do_not_erase_it():
    for name in "banner-image promo-code-guide notice social-history form-and-function menu-item-description post-footer share".split():
        assert main_text(f"<article><h1>t</h1><div class='{name}'>{PARAGRAPHS}</div></article>", {}) == "t\n" + PARTS
    for name in "ad ad-box newsletter-signup share-buttons related-posts cookie-notice comments comment-list".split():
        assert main_text(f"<article><h1>t</h1>{PARAGRAPHS}<div class='{name}'><p>Buy now</p></div></article>", {}) == "t\n" + PARTS


def test_a_form_around_the_page_is_none():
    assert main_text(f"<body><form action=/x><div>{PARAGRAPHS}</div><input><button>Go</button></form></body>", {}) == PARTS
    assert main_text(f"<body><div>{PARAGRAPHS}</div><form><p>Write to us</p><label>Name</label></form></body>", {}) == PARTS


def test_mirrored_and_repeated_paragraphs_stay(spark):
    same = [(k, f"http://c.example/{k}", f"<body><nav>Home</nav><article>{PARAGRAPHS}<p>Version {k} of this page was saved</p></article></body>") for k in range(12)]
    lines = "<p>All readings are in metres.</p>"
    own = [(100 + k, f"http://d.example/{k}", f"<body><nav>Home</nav><article><p>Report {k} of the day</p>{lines}<p>More of {k}</p></article></body>") for k in range(12)]
    got = {r.page_id: r.text for r in page_texts(spark.createDataFrame(same + own, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"{PARTS}\nVersion {k} of this page was saved" for k in range(12))
    assert all(got[100 + k] == f"Report {k} of the day\nAll readings are in metres.\nMore of {k}" for k in range(12))


def test_broken_markup_takes_time_by_its_length():
    began = time.monotonic()
    for piece in ("<a ", "<a href=\"", "<", "<!", "<a '\">", "<a \">\"", "<!--", "<script ", "<script></script ", "</", "<p a='"):
        for tail in ("", ">", "x>\"", "'"):
            parse(piece * 20_000 + tail)
    parse("<a " * 1_700_000)
    parse("<a \">\"" * 800_000 + "\"")
    assert time.monotonic() - began < 60
    assert main_text("<p title='a > b'>x</p><p title=\"it's\">y</p><p title='open>z</p>", {}) == "x\ny\nz"
