"""Main text of pages: boilerplate, markup, odd rows, and pages that mark no article."""

import pytest

from ledgerline.llm import pages

SIDES = (
    "<nav><a href=/>Home</a> <a href=/b>News</a></nav>", "<header><h2>Site name</h2><p>Slogan of the site</p></header>",
    "<footer><p>All rights reserved by a very long company name.</p></footer>", "<aside><p>Trending now in your town</p></aside>",
    '<div class="cookie-notice"><p>We use cookies to make this page better for you.</p></div>', '<div class="ad">Buy this now, only today!</div>',
    "<form><label>Mail</label><input name=a><button>Join our list</button></form>", "<script>var t='<p>no text</p>';</script>",
    "<style>p{margin:0}</style>", "<!-- <p>commented out</p> -->", '<div id=sidebar><p>Most read of all the stories here</p></div>',
    '<section class="comments"><h3>Comments</h3><p>I liked this article very much indeed.</p></section>',
    "<noscript>Turn scripts on</noscript>", '<div hidden><p>Not shown to anyone</p></div>', '<div role="banner">Welcome back, reader of ours</div>',
)
ARTICLE = "<h1>A &amp; B</h1><p>First <b>long</b>\n  paragraph&nbsp;of the text.<br>Still the first.<p>Ok.<ul><li>one<li>two</ul><blockquote>Quoted</blockquote>"
TEXT = "A & B\nFirst long paragraph of the text. Still the first.\nOk.\none\ntwo\nQuoted"


@pytest.mark.parametrize("side", SIDES)
def test_boilerplate_goes_wherever_it_stands(side):
    for place in (f"{side}<article>{ARTICLE}</article>", f"<article>{ARTICLE}</article>{side}", f"<article>{side}{ARTICLE}</article>",
                  f"<main><article>{ARTICLE}{side}</article></main>", f"<main>{side}{ARTICLE}</main>"):
        want = f"Site name\n{TEXT}" if place.startswith("<article><header>") else TEXT
        if "<article>" in place and place.endswith("</header></article></main>"):
            want = f"{TEXT}\nSite name"
        assert pages.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{place}</body></html>") == want, place


def test_long_gaps_inside_an_article_end_nothing():
    gap = "<aside>" + "<p>noise line</p>" * 30 + "</aside>"
    assert pages.main_text(f"<article><p>One.</p>{gap}<p>Two.</p></article>") == "One.\nTwo."


def test_pages_without_an_article_surge_and_dive():
    menu = "".join(f"<li><a href=/{i}>Entry {i}</a></li>" for i in range(12))
    body = "<h1>The title</h1>" + "".join(f"<div>Paragraph {i} of a text that goes on for a good while, as texts do.</div>" for i in range(5)) + "<div>End.</div>"
    tail = "".join(f"<div><a href=/t{i}>Other story number {i}</a></div>" for i in range(9))
    got = pages.main_text(f"<body><ul>{menu}</ul>{body}{tail}<div>Imprint</div></body>").split("\n")
    assert got[0] == "The title" and got[1].startswith("Paragraph 0") and got[-1].startswith("End.") and len(got) == 7


def test_marked_up_oddly():
    assert pages.main_text("<article><p title='a > b'>5 < 6 &lt; 7 &#233; &bogus; &am</article>") == "5 < 6 < 7 é &bogus; &am"
    assert pages.main_text("<article><p>a</b></div>b</article></article><p>after") == "a\nb"
    assert pages.main_text("<article><p>cut off <b>in the mid") == "cut off in the mid"
    assert pages.main_text("<article><p>text</p><script>never ends <p>x") == "text"
    assert pages.main_text("<nav>left open<article><p>text</p></article>") in ("", "text")
    assert pages.main_text("<ARTICLE><P>Upper</P></ARTICLE>") == "Upper"
    assert pages.main_text("plain text only, without any markup") == "plain text only, without any markup"


def test_long_pages_take_linear_time():
    text = pages.main_text("<article>" + "<p>word &amp; word</p>" * 100_000 + "<div><b>" * 20_000 + "x</article>")
    assert text.count("\n") == 100_000 and text.endswith("x")


def test_odd_rows(spark, table):
    rows = [(1, "u", None, "a"), (2, "u", "", "b"), (None, None, "<article>x</article>", "c"), (3, "v", "<article>x</article>", None), (3, "v", "<article>x</article>", None)]
    df = table(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, pages.extract(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, "u", "", 0), (None, None, "x", 1), (3, "v", "x", 1), (3, "v", "x", 1)], key=str)
    assert pages.extract(df, text_col="main").columns == ["page_id", "url", "html", "text", "main", "n_chars"]
    assert pages.extract(df.limit(0)).count() == 0
