"""Main text of pages of several templates, against the text that each template was filled with."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionlake.llm import htmltext
from ionlake.llm.htmltext import main_text

A = "The committee met on Tuesday, and after a long debate, it agreed on the first of the proposals."
B = "Several members, among them the treasurer, asked for figures; none were given that evening."
C = "A second meeting, open to the public, will be held in spring, when the accounts are known."
SHORT = "It rained."
MENU = '<ul><li><a href="/a">Home page</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li><li><a href="/d">About us</a></li></ul>'
JUNK = ("Home page", "Buy now", "Nice read", "Sign up", "All rights", "We use", "More stories", "track(")


def junk(cls, text):
    return f'<div class="{cls}"><p>{text}, and this sentence is long enough, with commas, to look like a paragraph of its own.</p></div>'


REST = junk("adBox", "Buy now") + junk("cookieBanner", "We use") + junk("commentlist", "Nice read") + f'<footer>All rights reserved.</footer><script>track("{A}")</script>'
TEMPLATES = {
    "semantic": f'<html><body><header><h1>The Paper</h1></header><nav>{MENU}</nav><article><header><h1>Title</h1><p>A lead paragraph.</p></header>%s<footer>All rights</footer></article>{REST}</body></html>',
    "blog": f'<body class="single comments-open"><div id="page" class="site"><div id="masthead">{MENU}</div><div id="content" class="site-content"><div class="post hentry"><h1>Title</h1><div class="entry-content"><p>A lead paragraph.</p>%s</div></div>'
    f'<div id="comments" class="comments-area"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>Nice read, I thought, and I have read a lot, believe me, on this.</p></article></li></ol></div></div><div class="article-sidebar"><p>More stories, and more, and more of them, for all of you.</p></div>{REST}</div></body>',
    "plain": f"<h1>Title</h1><p>A lead paragraph.</p>%s{REST}",
    "table": f'<table><tr><td class="main-menu">{MENU}</td><td><h1>Title</h1><p>A lead paragraph.</p>%s</td></tr></table>{REST}',
    "divs": f'<div class="top">{MENU}</div><div class="x1"><h1>Title</h1><div><p>A lead paragraph.</p></div>%s</div><div class="content-footer"><p>More stories, and more, and more of them, for you.</p></div>{REST}',
    "form": f'<form id="aspnetForm"><input type="hidden"><div role="navigation">{MENU}</div><div id="main" class="main sidebar-right"><h1>Title</h1><p>A lead paragraph.</p>%s</div>{REST}</form>',
}


@pytest.mark.parametrize("template", TEMPLATES)
def test_article_of_each_template(template):
    body = f"<p>{A}</p><p>{B}</p><h2>More</h2><p>{SHORT}</p><p>{C}</p>"
    assert main_text(TEMPLATES[template] % body).split("\n") == ["Title", "A lead paragraph.", A, B, "More", SHORT, C]


@settings(max_examples=150, deadline=None)
@given(template=st.sampled_from(sorted(TEMPLATES)), blocks=st.lists(st.tuples(st.sampled_from(["p", "h2", "blockquote", "pre", "li"]), st.sampled_from([A, B, C, SHORT, "x &lt; y &amp; z"])), min_size=1, max_size=8))
def test_random_articles(template, blocks):
    body = f"<p>{A}</p>" + "".join(f"<ul><li>{t}</li></ul>" if k == "li" else f"<{k}>{t}</{k}>" for k, t in blocks) + f"<p>{B}</p>"
    expected = ["Title", "A lead paragraph.", A, *(t.replace("&lt;", "<").replace("&amp;", "&") for _, t in blocks), B]
    assert main_text(TEMPLATES[template] % body).split("\n") == expected


@pytest.mark.parametrize("name", ["comment-body", "post-comments", "comment-content", "main-menu", "article-sidebar", "content-footer", "entry-related", "adBox", "cookieBanner", "commentlist", "social-share", "newsletter", "site-notice"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_names_that_say_something_else(name, kind):
    text = main_text(f'<article><p>{A}</p><div {kind}="{name}"><p>{B}</p></div><p>{C}</p></article>')
    assert text == f"{A}\n{C}"


@pytest.mark.parametrize("name", ["side-effects", "share-price", "widget-history", "social-science", "related-work", "notice-board"])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_names_that_only_cast_doubt(name, tag):
    for around in ("<article>%s</article>", "<div>%s</div>"):
        text = main_text(around % f'<p>{A}</p><{tag} id="{name}"><h2>More</h2><p>{SHORT}</p></{tag}><p>{C}</p>')
        assert text == f"{A}\nMore\n{SHORT}\n{C}"


def test_doubtful_names_of_links_and_forms_go():
    links = "".join(f'<li><a href="/{i}">More stories {i}</a></li>' for i in range(5))
    text = main_text(f'<div><p>{A}</p><div class="related-coverage"><ul>{links}</ul></div><div class="newsletter-signup-hook"><p>Sign up, now.</p><form><input></form></div><p>{B}</p></div>')
    assert text == f"{A}\n{B}"


def test_links_of_an_article_stay():
    links = "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(4))
    for around in ("<article>%s</article>", f"<body><div>{MENU}</div>%s</body>"):
        text = main_text(around % f'<p>{A}</p><p><a href="/">One</a> <a href="/">Two</a> <a href="/">Three</a></p><p>{B}</p><h2>References</h2><ul>{links}</ul>')
        assert text.split("\n") == [A, "One Two Three", B, "References", *(f"Source {i}" for i in range(4))]


def test_short_sections_between_siblings_stay():
    text = main_text(f"<body><div><p>{A}</p><p>{B}</p></div><div><p>{SHORT}</p></div><ul><li>one</li></ul><div><p>{C}</p><p>{A}</p></div><div><p>The end.</p></div></body>")
    assert text.split("\n") == [A, B, SHORT, "one", C, A, "The end."]


@pytest.mark.parametrize("slug", ["comments", "menu", "cookies", "notices", "social-sharing"])
def test_slugs_of_headings_cut_nothing(slug):
    for open_, close in ((f'<section id="{slug}"><h2>Slug</h2>', "</section>"), (f'<div class="section" id="{slug}"><h2>Slug</h2>', "</div>"), (f'<h2 id="{slug}">Slug</h2>', ""), (f'<h2><span class="mw-headline" id="{slug}">Slug</span></h2>', "")):
        text = main_text(f'<body><nav>{MENU}</nav><article><h1>Title</h1><p>{A}</p>{open_}<p id="{slug}-1">{B}</p><p>{SHORT}</p>{close}<p>{C}</p></article></body>')
        assert text.split("\n") == ["Title", A, "Slug", B, SHORT, C]


COMMENT = '<div class="row"><b>{}</b><time>today</time><p>Nice read, I thought, and I have read a lot, believe me, on this.</p></div>'
THREAD = COMMENT.format("Ann") + COMMENT.format("Bo")


@pytest.mark.parametrize("name", ["discussion", "discussion-thread", "user-reviews"])
def test_threads_of_readers_go(name):
    body = f"<h1>Title</h1><p>{A}</p><p>{B}</p><p>{C}</p>"
    for page in (f'<main>{body}</main><div class="{name}">{THREAD}</div>', f'<article>{body}<div class="{name}"><h3>Readers</h3><div>{THREAD}</div></div></article>', f'<article>{body}<section id="comments"><h2>Comments</h2>{THREAD}</section></article>'):
        assert main_text(page).split("\n") == ["Title", A, B, C]


def test_discussions_that_are_the_article_stay():
    section = f'<section id="discussion" class="discussion"><h2>Discussion</h2><p>{B}</p><p>{SHORT}</p></section>'
    assert main_text(f"<article><p>{A}</p>{section}<p>{C}</p></article>").split("\n") == [A, "Discussion", B, SHORT, C]
    posts = "".join(f'<div class="post"><b>Ann</b><p>{t}</p></div>' for t in (A, B, C))
    assert main_text(f'<body><nav>{MENU}</nav><div class="thread">{posts}</div></body>').split("\n") == [x for t in (A, B, C) for x in ("Ann", t)]


def test_hidden_text_and_menus_of_table_layouts_go():
    assert main_text(f'<article><p>{A}</p><p style="visibility: hidden">no</p><span class="sr-only">no</span><p>{B}</p></article>') == f"{A}\n{B}"
    menu = "".join(f'<a href="/{i}">{i}</a>' for i in range(1, 4))
    assert main_text(f"<table><tr><td>{menu}</td><td><p>{A}</p><p>{B}</p></td></tr></table>") == f"{A}\n{B}"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<nav>x</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text(f"<p>{A}<p>{B}<br>x  y\n z<!-- c --><p hidden>no</p>") == f"{A}\n{B} x y z"
    deep = "<div>" * 5000 + f"<p>{A}</p>" + "</div>" * 5000
    assert main_text(deep) == A
    long = "".join(f"<p>{A}</p>" for _ in range(20_000))
    assert main_text(f"<article>{long}</article>").count("\n") == 19_999
    assert main_text(f"<p>{A} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p>") == f"{A} x=2"
    for text in (A, "<", "a < b", "<p", f"<p>{A}</p><div class=", "&#x41;&notin;&;"):
        assert isinstance(main_text(text), str)


def test_no_junk_in_any_template():
    for page in TEMPLATES.values():
        text = main_text(page % f"<p>{A}</p>")
        assert not [j for j in JUNK if j in text]


def test_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{A}</p></article>", "x"), (1, "u", f"<article><p>{A}</p></article>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = htmltext.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, A, len(A)), (1, A, len(A))]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_shared_pages_against_a_regular_expression(spark):
    """The shared pages have one shape, of which a regular expression takes the article."""
    import html

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.DOTALL)
        blocks = re.split(r"</?(?:h1|p|li|ul|div|td|tr|table|pre|blockquote|h2|h3)\b[^>]*>", re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner[1], flags=re.DOTALL)) if inner else []
        plain = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", b) and re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        assert main_text(r.html) == "\n".join(b for b in plain if b)
