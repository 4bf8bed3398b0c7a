"""Pages whose wrappers or nesting could cost the article."""

import pytest

from pairlab.llm import htmltext

LONG = "One sentence, and another; then some more words, all of the article."


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', "title='hidden gems'", 'data-id="comment-7"', 'data-id="ad-1"', "data-role=search", 'title="a class=ad b"', "href=/x/?id=ad"])
def test_other_attributes_do_not_exclude(attributes):
    assert htmltext.main_text(f"<body><div {attributes}><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("attributes", ["hidden", 'title="x" HIDDEN', 'aria-hidden="true"', "id=ad", "class = 'x ad'", "role=search"])
def test_whole_attributes_exclude(attributes):
    assert htmltext.main_text(f"<body><div><p>{LONG}</p></div><div {attributes}><p>{LONG} Not this.</p></div></body>") == LONG


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("inner", ["div", "section", "blockquote"])
def test_nested_bodies_keep_what_surrounds_them(outer, inner):
    body = "".join(f"<p>{LONG} {LONG} {i}</p>" for i in range(8))
    page = f"<body><nav><p>{LONG}</p></nav><{outer}><p>Intro. {LONG}</p><{inner}>{body}</{inner}><p>Close. {LONG}</p></{outer}></body>"
    assert htmltext.main_text(page) == "\n\n".join([f"Intro. {LONG}", *(f"{LONG} {LONG} {i}" for i in range(8)), f"Close. {LONG}"])


@pytest.mark.parametrize("outer", ["article", "main"])
@pytest.mark.parametrize("body", ["<div>{0}</div>", "<ul><li>{0}</li></ul>", "<table><tr><td>{0}</td></tr></table>"])
def test_short_parts_beside_a_nested_body(outer, body):
    held = body.format("".join(f"<p>{LONG} {LONG} {i}</p>" for i in range(8)))
    page = f"<body><{outer}><h1>T</h1><p>intro</p>{held}<p>close</p></{outer}></body>"
    assert htmltext.main_text(page) == "\n\n".join(["T", "intro", *(f"{LONG} {LONG} {i}" for i in range(8)), "close"])


PARAGRAPHS = [f"{LONG} {LONG} Number {i}." for i in range(4)]
ARTICLE = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'title="Hidden gems"', 'data-id="social"', 'class="page has-sidebar"', 'class="no-comments content"', 'class="elementor-widget-text"',
    'class="sidebar"', 'id="related"', 'class="widget content"', 'role="form"',
])
def test_a_wrapper_that_holds_the_article_stays(attributes):
    page = f"<body><div class=menu><a>Home</a> <a>News</a></div><div {attributes}>{ARTICLE}</div><div class=footer>All rights.</div></body>"
    assert htmltext.main_text(page) == "\n\n".join(PARAGRAPHS)


def test_comments_stay_out_however_long():
    talk = "".join(f"<p>I beg to differ, {i} times; for what it is, it is not. {LONG}</p>" for i in range(30))
    for outer in ("article", "div"):
        page = f"<body><{outer}><h1>T</h1><p>{LONG} {LONG} {LONG}</p></{outer}><div class='comment-list'>{talk}</div></body>"
        assert htmltext.main_text(page) == f"T\n\n{LONG} {LONG} {LONG}"


#: Pages without article or main and without telling names: the ratios alone tell what is what.
PLAIN = [
    f"<body><div><div><a>Home</a></div><div><a>News</a></div><div><a>Sport</a></div></div><div><section>{ARTICLE}</section></div><div><div>Made by us</div><div>All rights</div></div></body>",
    f"<body><table><tr><td><a>One</a> <a>Two</a> <a>Three</a></td><td><div>{ARTICLE}</div></td><td>Today 20 degrees</td></tr></table></body>",
    f"<body><h2>Our site</h2><span>Log in here</span><div class=x><h1>Head</h1>{ARTICLE}<p>Short.</p></div><div class=y><b>More</b> <i>stuff</i></div></body>",
    f"<body><div>Menu</div><div>{ARTICLE}<ul><li><a>Read this</a></li><li><a>Read that</a></li><li><a>And this</a></li></ul>{ARTICLE}</div></body>",
]


@pytest.mark.parametrize("k", range(len(PLAIN)))
def test_ratios_decide(k):
    head = ["Head"] if k == 2 else []
    tail = ["Short."] if k == 2 else PARAGRAPHS if k == 3 else []
    assert htmltext.main_text(PLAIN[k]) == "\n\n".join([*head, *PARAGRAPHS, *tail])
    assert htmltext.main_text(PLAIN[k], strictness=-1e9) != htmltext.main_text(PLAIN[k])


@pytest.mark.parametrize("tag", ["div", "b", "li", "font", "svg", "p"])
def test_deep_pages(tag):
    import time
    import tracemalloc

    def run(n):
        page = f"<body>{ARTICLE}" + f"<{tag}>x" * n + "</q>" * n
        tracemalloc.start()
        began = time.perf_counter()
        text = htmltext.main_text(page)
        took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return text, took, peak

    text, took, peak = run(50_000)
    assert text.startswith(PARAGRAPHS[0]) and took < 30 and peak < 150e6


WHOLE = "\n\n".join(PARAGRAPHS * 2)


@pytest.mark.parametrize("outer", ["article", "main"])
@pytest.mark.parametrize("inner", ["<section id='related-work'>{}</section>", "<section id=comment-on-results>{}</section>", "<div id='form-and-function'>{}</div>"])
def test_anchors_inside_an_article_exclude_nothing(outer, inner):
    assert htmltext.main_text(f"<body><nav>x</nav><{outer}>{ARTICLE}{inner.format(ARTICLE)}</{outer}></body>") == WHOLE


@pytest.mark.parametrize("tag", ["h2 id=notice", "h2 id='form'", "h3 class=related", "p class='social'"])
def test_named_headings_and_paragraphs_of_an_article_stay(tag):
    name = tag.split()[0]
    assert htmltext.main_text(f"<body><article>{ARTICLE}<{tag}>{LONG}</{name}>{ARTICLE}</article></body>") == "\n\n".join([*PARAGRAPHS, LONG, *PARAGRAPHS])


@pytest.mark.parametrize("other", [
    "<section id='comments'>{}</section>", "<div id='comment-7'>{}</div>", "<div id='comment-list'>{}</div>", "<div class=ad>{}</div>", "<p class='ad'>Buy, now.</p>", "<div id='ad-1'>{}</div>",
    "<div id='related-posts'>{}</div>", "<div id='social-share'>{}</div>", "<div class='related-work'>{}</div>", "<p class='x comment'>Well, no.</p>",
])
def test_names_of_page_parts_inside_an_article_exclude(other):
    assert htmltext.main_text(f"<body><article>{ARTICLE}{other.format(ARTICLE)}{ARTICLE}</article></body>") == WHOLE


@pytest.mark.parametrize("outer", ["article", "main"])
def test_plain_menus_at_the_edges_of_an_article_go(outer):
    menu = lambda w, t: f"<div>{''.join(f'<{t}>{w} {i}</{t}>' for i in range(20))}</div>"
    page = f"<body><{outer}>{menu('Item', 'div')}<h1>Head</h1>{ARTICLE}{menu('Thing', 'span')}</{outer}></body>"
    assert htmltext.main_text(page) == "\n\n".join(["Head", *PARAGRAPHS])
    assert htmltext.main_text(page, strictness=-1e9) != htmltext.main_text(page)  # the ratios tell them from the text
    # Lists, tables and what lies between content are the article's, and so are a few short lines.
    listed = f"<ul>{''.join(f'<li>Item {i}</li>' for i in range(20))}</ul>"
    assert htmltext.main_text(f"<body><{outer}>{ARTICLE}{listed}</{outer}></body>") == "\n\n".join([*PARAGRAPHS, *(f"Item {i}" for i in range(20))])
    inside = menu("Line", "div")
    assert htmltext.main_text(f"<body><{outer}>{ARTICLE}{inside}{ARTICLE}</{outer}></body>") == "\n\n".join([*PARAGRAPHS, *(f"Line {i}" for i in range(20)), *PARAGRAPHS])
    few = "".join(f"<div>Line {i}</div>" for i in range(5))
    assert htmltext.main_text(f"<body><{outer}>{ARTICLE}{few}</{outer}></body>") == "\n\n".join([*PARAGRAPHS, *(f"Line {i}" for i in range(5))])
