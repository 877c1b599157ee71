import time

from palisade.llm import html_text
from palisade.llm.html_text import main_text

LONG = "This paragraph holds quite some words, so that nobody would take it for a menu or a link."


def test_marked_article_without_what_is_not_its_text():
    page = f"""<!DOCTYPE html><html><head><title>Site: page</title><style>p{{x:1}}</style>
      <script>var a = "</p><p>not text";</script></head><body><header>Site</header>
      <nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">{LONG}</div>
      <article><h1>Heading &amp; more</h1><p><b>Short.<br><p>{LONG} &lt;x&gt; &eacute;&#33;
      </p><aside>{LONG}</aside><form><input>Name</form><div class="user comments">{LONG}</div>
      <!-- <p>{LONG}</p> --><p>Last\n\n  one</article><footer>&copy; {LONG}</footer></body>"""
    assert main_text(page) == f"Heading & more Short. {LONG} <x> é! Last one"


def test_surge_and_dive_without_a_marked_article():
    page = f"""<body><div id="top"><a href=x>One</a> <a href=y>Two</a></div>
      <div class="cookie-notice"><p>{LONG}</p></div><div class="main"><h2>Title</h2><p>{LONG}</p>
      <p>Short.</p><p>{LONG} with <a href=z>a link</a>.</p></div>
      <div><ul><li><a>{LONG}</a><li><a>{LONG}</a></ul></div><div>tail</div></body>"""
    assert main_text(page) == f"Title {LONG} Short. {LONG} with a link."


def test_a_wrapper_named_after_its_sidebar_is_kept():
    page = f"""<body><div class="page with-sidebar"><article><p>{LONG}</p></article>
      <aside>{LONG}</aside></div></body>"""
    assert main_text(page) == LONG
    assert main_text(f'<div class="no-ads"><p>{LONG}</p></div>') == LONG


def test_window_sums():
    lengths = [0, 5, 0, 90, 3, 200, 0, 0, 0, 4, 0]
    assert html_text.surges(lengths, 3, 80) == [(1, 6)] or html_text.surges(
        lengths, 3, 80) == [(3, 6)]


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<html>") == ""
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<p>a</b></div><p>b<") == "a b<"
    assert main_text("<script>never closed") == ""
    assert main_text("<article><p>one<article><p>two</article>three") == "one two three"
    deep = "<div>" * 3000 + LONG + "</div>" * 3000
    assert main_text(deep) == LONG
    assert main_text('<p title="a > b">x</p><p data-x=\'<p>\'>y') == "x y"
    assert main_text("<article><p>a<b>b</b>c&nbsp;d<br/>e</p></article>") == "abc d e"


def test_whole_texts(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "t"), (1, None, "<article>a b</article>", "t"), (None, "u", "", "t"),
         (2, "u", "<article>" + "<p>word</p>" * 60_000 + "</article>", "t")],
        "page_id bigint, url string, html string, text string")
    rows = sorted(html_text.extract(pages).collect(), key=lambda r: (r["n_chars"], str(r["url"])))
    assert [(r["page_id"], r["text"][:9], r["n_chars"]) for r in rows] == [
        (1, "", 0), (None, "", 0), (1, "a b", 3), (2, "word word", 299_999)] or [
        (r["page_id"], r["n_chars"]) for r in rows] == [(None, 0), (1, 0), (1, 3), (2, 299_999)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_parts_of_an_article_named_like_noise_are_kept():
    page = f"""<article><h1>Title</h1><div class="entry-content has-sidebar"><h2 id="related-work">
      Related work</h2><p class="notice">{LONG}</p><section id="social-impact"><p>{LONG}</p>
      </section></div><div class="share-buttons">Share it</div></article>"""
    assert main_text(page) == f"Title Related work {LONG} {LONG}"
    page = f"""<div class="sidebar">{LONG}</div><div id="content" class="widget"><p>{LONG}</p>
      <p>{LONG}</p><p>{LONG}</p></div>"""
    assert main_text(page) == f"{LONG} {LONG} {LONG}"


def test_a_short_second_part_is_kept():
    links = "".join(f"<li><a href=x>link {i} to another page</a>" for i in range(9))
    page = f"<div>{f'<p>{LONG}</p>' * 9}</div><ul>{links}</ul><div><p>{LONG}</p></div>"
    assert main_text(page) == " ".join([LONG] * 10)


def test_compound_names_of_noise_in_an_article():
    for leak in ('<div class="post-comments">@</div>', '<div class="c-comments__list">@</div>',
                 '<div id="fb-comments-box"><p>@</p></div>', '<div class="js-ad-slot">@</div>',
                 '<p class="advert">@</p>', '<p>@</p>'.replace("<p>", '<p class="ad">'),
                 '<section class="user-comments"><article><p>@</p></article></section>',
                 '<ul class="siteNavMenu"><li>@</ul>', '<div class="newsletterSignup"><p>@</div>'):
        page = f"<article><h1>Title</h1><p>{LONG}</p>{leak.replace('@', LONG)}<p>End.</p></article>"
        assert main_text(page) == f"Title {LONG} End.", leak
    page = f'<article><p>Before <span class="ad">buy this</span>after, {LONG}</p></article>'
    assert main_text(page) == f"Before after, {LONG}"
    for kept in ("has-sidebar", "no-ads", "social-impact", "related-work", "reply-to-critics",
                 "entry-content", "page-header"):
        page = f'<article><p>{LONG}</p><div class="{kept}"><p>Part.</p></div></article>'
        assert main_text(page) == f"{LONG} Part."


def test_comments_longer_than_their_article():
    comments = f"<p>{LONG}</p>" * 30
    page = f"""<main><article><p>{LONG}</p></article><div id="comments">{comments}</div>
      <section class="reader-comments">{comments}</section></main>"""
    assert main_text(page) == LONG


def test_surge_and_dive_in_a_marked_article():
    links = "".join(f"<li><a href=x>link {i} to another page</a>" for i in range(5))
    page = f"""<article><ul>{links}</ul><h1><a href=y>Title</a></h1><p><a href=z>Author</a></p>
      <p>{LONG}</p><div><ul>{links}</ul></div><p>Short.</p><p>See <a href=x>this</a>.</p>
      <ol><li>one <li><a href=x>two</a></ol><ul>{links}</ul></article>"""
    assert main_text(page) == f"Title Author {LONG} Short. See this. one two"
    # An article of nothing but links is all there is.
    assert main_text(f"<article><ul>{links}</ul></article>").startswith("link 0 to another page")


def test_hostile_markup_takes_linear_time():
    started = time.monotonic()
    assert main_text('<a "' * 100_000) == '<a "' * 100_000
    assert main_text("<a " * 100_000 + "x").endswith("<a x")
    assert main_text("<!" * 100_000 + "x").endswith("<!x")
    assert main_text("<a '\">" * 50_001) == ""
    assert main_text("<div>" * 100_000 + "x") == "x"
    assert len(main_text("<b>" * 40_000 + "<p>x</p>" * 40_000)) == 79_999
    # The outer half of these hold most of the text each.
    assert len(main_text('<div class="ad">x' * 30_000)) == 29_999
    assert main_text("<p><li>" + "<b>" * 30_000 + "<h1>x</h1>" * 30_000)[:3] == "x x"
    assert time.monotonic() - started < 30
