import time

from quillspan.llm import html

LONG = "The river ran past the old stone house, and nobody knew, not even the miller, where it came from."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p><p>no, no, no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, many, many of them.</p></div>
<div id=content><article><header><h1>Head &amp; more</h1></header><p>{LONG}<p>Second&nbsp;one,  with
 <b>bold</b>, <i>it</i>alics<br>and a break.</p><ul><li>one</li><li>two</ul><table><tr><td>cell</td></tr></table><pre>code
here</pre></article><div class="comments"><p>Reader: first, and, so on, {LONG}</p></div></div>
<aside><p>{LONG}</p></aside><form><p>Name, please</p></form><footer><p>&copy; all, rights, reserved</p></footer></body></html>"""


def test_article_only():
    assert html.main_text(PAGE).split("\n") == ["Head & more", LONG, "Second one, with bold, italics and a break.", "one", "two", "cell", "code here"]


def test_div_page_without_article():
    page = f"<body><div class='sidebar'>{LONG}</div><div><div class=post><p>{LONG}</p><p>{LONG}</p></div></div><div class='footer'>x</div></body>"
    assert html.main_text(page) == f"{LONG}\n{LONG}"


def test_sections_stay_together():
    page = f"<main><section><p>{LONG}</p></section><section><p>Short.</p></section></main>"
    assert html.main_text(page) == f"{LONG}\nShort."


def test_unclosed_head_and_menu():
    assert html.main_text(f"<html><head><title>T</title><body><p>{LONG}</p>") == LONG
    assert html.main_text(f"<head><meta charset=x><p>{LONG}") == LONG
    assert html.main_text(f"<body><nav><ul><li>Menu<article><p>{LONG}</p></article>") == LONG


def test_attributes_are_read_as_such():
    page = f'<body><div data-id="nav" style="overflow: hidden" title="class=ad"><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><div class=ad><p>{LONG}</p></div></body>'
    assert html.main_text(page) == LONG


def test_odd_pages(spark):
    pages = [None, "", "plain text, no tags", "<p>a", "<p>&lt;b&gt; &#233; &bogus;</p>", "<script>x", "<!-- only -->", "<nav>menu</nav>", "a < b", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, h, "u") for i, h in enumerate(pages)], "page_id long, html string, text string")
    found = [r["text"] for r in html.extract(df, ["page_id"]).orderBy("page_id").collect()]
    assert found == ["", "", "plain text, no tags", "a", "<b> é &bogus;", "", "", "", "a < b", "deep", "deep"]
    assert html.extract(df.where("1 = 0"), ["page_id"]).count() == 0
    clash = html.extract(df.selectExpr("*", "1 as __html"), ["page_id", "TEXT", "__html"])
    assert clash.columns == ["page_id", "__html", "text"] and clash.count() == len(pages)


def test_headings_and_short_paragraphs_beside_a_div():
    page = f"<body><h1>Title</h1><div class=content>{f'<p>{LONG}</p>' * 4}</div><p>Short close.</p><p><a href='/x'>More links</a></p><footer><h2>Cut</h2></footer></body>"
    assert html.main_text(page).split("\n") == ["Title", LONG, LONG, LONG, LONG, "Short close."]


def test_only_whole_names_mark():
    def page(inner, article="article"):
        return f"<body><{article}>{inner}<p>{LONG}</p><p>{LONG}</p></{article}></body>"

    body = f"{LONG}\n{LONG}"
    assert html.main_text(f'<body><div class="layout has-sidebar"><div><p>{LONG}</p><p>{LONG}</p></div></div></body>') == body
    assert html.main_text(page('<div class="article-header"><h1>Title</h1></div>', "main")) == f"Title\n{body}"
    assert html.main_text(page('<div class="page-header"><h1>Title</h1></div>')) == f"Title\n{body}"
    assert html.main_text(page('<h2 id="related-work">Related work</h2><h3 id="comments">Comments</h3>')) == f"Related work\nComments\n{body}"
    assert html.main_text(page('<div id="notice-of-motion"><p>Moved.</p></div>')) == f"Moved.\n{body}"
    for name in ("comments", "comment-list", "post-comments", "ad-slot", "cookie_notice", "sidebar-left", "relatedPosts", "share-buttons", "newsletter-signup-form", "ad-17"):
        assert html.main_text(page(f'<div class="x {name}"><p>Not this, {LONG}</p></div>')) == body, name


def test_marked_elements_around_the_article_stay():
    assert html.main_text(f'<div class="modal-content"><article><p>{LONG}</p></article></div>') == LONG
    assert html.main_text(f'<body><div class="widget"><p>{LONG}</p><p>{LONG}</p></div><p>Hi.</p></body>').startswith(LONG)
    assert html.main_text(f'<article><p>{LONG}</p></article><div class="comments">{f"<p>{LONG} I say.</p>" * 30}</div>') == LONG


def test_quotes():
    assert html.main_text(f"<p title=it's>{LONG}</p><p>It's so.</p>") == f"{LONG}\nIt's so."
    assert html.main_text(f'<p title="a > b">{LONG}</p>') == LONG
    assert html.main_text(f'<p title="never closed>{LONG}</p>') == LONG


def test_hostile_pages_take_linear_time():
    begun = time.time()
    for piece in ('<a "x ', '<a b="> ', "<a b='>\" ", "<", "<a", "</", "<!", "<!--", "&", "&amp", "<p ", "<p a=", "<p>", "<b>", "</b>", "<li>", "<td>", "<i><div>", "x<br>", "<script>", "<p>a, b</i>"):
        html.main_text(piece * ((1 << 20) // len(piece)))
    for head, tail in (("<b>", "</i>"), ("<i><div>" + "<b>" * 1000, "</i>"), ("<ul>" + "<b>" * 1000, "<li>"), ("<article>", "<header>"), ("<div>", "<p>x, y")):
        html.main_text(head * (400_000 // len(head)) + tail * (400_000 // len(tail)))
    assert time.time() - begun < 60
