from collections import Counter

import pytest

from gridloom.llm import html

from .planted import pages

LONG = "The council met on Monday, and after a long debate it agreed on the plan. Costs are shared, it said; work begins in May."

PAGES = {
    "plain": (
        f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li>News</li></ul></nav>"
        f"<!-- <p>hidden</p> --><div class='ad'>Buy now, cheap, today.</div><article><h1>Title &amp; more</h1><p>{LONG}<p><b>Short.</b><br>Next&nbsp;line &#8211; &eacute;&#x41;</article><footer>&copy; site</footer></body></html>",
        f"Title & more\n{LONG}\nShort. Next line – éA",
    ),
    "divs": (
        f"<body><div id='top-menu'><a>One</a> <a>Two</a></div><div class=content><h2>Head</h2><div>{LONG}</div>\n<div>{LONG}</div><ul><li>First  point</li><li>Second</li></ul></div>"
        "<div class='sidebar widget'><p>Also read, if you like, this.</p></div><div id=comments><p>I agree, fully, with all of this. Really!</p></div><form><p>Your name, please.</p></form></body>",
        f"Head\n{LONG}\n{LONG}\nFirst point\nSecond",
    ),
    "inside": (
        f"<main><article class=post><header><h1>H</h1></header><p>{LONG}</p><aside>Related, stories.</aside><section class='comments'><p>First comment, long as it may be, is out.</p></section><p>{LONG} End.</p></article></main>",
        f"H\n{LONG}\n{LONG} End.",
    ),
    "broken": (f"<p>{LONG}<div>{LONG}</span></div></p><p>a < b &unknown; <b>cut", f"{LONG}\n{LONG}\na < b &unknown; cut"),
    "text": ("  just   words ", "just words"),
    "empty": ("<html><body><nav>Menu</nav></body></html>", ""),
    "open script": ("<p>a, b.</p><script>while(1){", "a, b."),
    "cut tag": ("<p>Some text, here.</p><div class='x", "Some text, here."),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html.main_text(page) == text


def test_none_and_long():
    assert html.main_text(None) == html.main_text("") == ""
    page = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert html.main_text(page) == "\n".join([LONG] * 5000)
    assert html.main_text("<div>" * 3000 + LONG) == LONG


def test_content_paths_are_the_long_ones():
    blocks = [("/body/ul/li", 1, "Home"), ("/body/ul/li", 2, "News"), ("/body/div/p", 3, LONG), ("/body/div/p", 4, LONG)]
    assert html.content_paths(blocks) == {"/body/div/p"}


def test_frames(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (2, None, None, None), (None, "w", "", "y"), (1, "u", PAGES["plain"][0], "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == sorted((i or 0, u or "", t, len(t)) for i, u, t in [(1, "u", PAGES["plain"][1]), (2, None, ""), (None, "w", ""), (1, "u", PAGES["plain"][1])])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def shares(made):
    """Precision and recall of words over (found, true) texts."""
    common = found = true = 0
    for a, b in made:
        x, y = Counter(a.split()), Counter(b.split())
        common, found, true = common + (x & y).total(), found + x.total(), true + y.total()
    return common / max(1, found), common / true


def ablations(monkeypatch, page):
    """The page's text; with every path taken for content that no sign speaks against; with ratios but without names; with ratios alone."""
    whole = html.main_text(page)
    with monkeypatch.context() as m:
        m.setattr(html, "content_paths", lambda blocks, weights=None: {b[0] for b in blocks if weights[b[0]] == 1})
        signs = html.main_text(page)
    with monkeypatch.context() as m:
        m.setattr(html, "_weight", lambda tag, attributes: 1.0)
        no_names = html.main_text(page)
        m.setattr(html, "NEVER", frozenset())
        ratios = html.main_text(page)
    return whole, signs, no_names, ratios


def test_pages_of_many_layouts_and_what_the_ratios_are_worth(monkeypatch):
    found = pages()
    precision, recall = shares([(html.main_text(page), text) for page, text in found])
    assert precision > 0.99 and recall > 0.99
    made = [ablations(monkeypatch, page) for page, _ in found]
    assert sum(signs != whole for whole, signs, *_ in made) >= len(found) // 5  # what names and tags alone can't tell
    assert sum(no_names != whole for whole, _, no_names, _ in made) >= len(found) // 5  # and what ratios alone can't


def test_no_word_of_a_name_drops_a_paragraph_of_the_article():
    for name in ("related-work", "tags-overview", "search-methods", "share-of-votes", "notice-to-readers", "social-history", "banner-year"):
        for tag in ("div", "section"):
            page = f"<article><p>{LONG}</p><{tag} class='{name}'><p>{LONG} And more.</p></{tag}><p>{LONG}</p></article>"
            assert html.main_text(page) == f"{LONG}\n{LONG} And more.\n{LONG}", name
    for name in ("related", "comments", "post-comments", "sidebar", "newsletter-box", "cookie notice", "tags"):
        page = f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} And more.</p></div><p>{LONG}</p></article>"
        assert html.main_text(page) == f"{LONG}\n{LONG}", name
    links = "".join(f"<li><a href=/{k}>Story {k}</a></li>" for k in range(9))
    assert html.main_text(f"<article><p>{LONG}</p><div class='related-stories'><ul>{links}</ul></div><p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


def test_end_tags_take_time_by_their_number():
    import time

    for page in ("<div>" * 30_000 + "<ul><li>x</ul>" * 30_000, "<p><td>" + "<span class=ad>" * 30_000 + "<p>x</p>" * 30_000, "<ul>" * 30_000 + "<li>x</li></ol>" * 30_000):
        began = time.process_time()
        html.Page(page)
        assert time.process_time() - began < 5


def test_names_of_lines_and_of_parts():
    keeps = f"<article><p>{LONG}</p><p class='notice-period'>Three months, it says.</p><p class='cookie notice'>We use some.</p><div class='notice-box'>No.</div><h2 class='share-count'>Head</h2></article>"
    assert html.main_text(keeps) == f"{LONG}\nThree months, it says.\nHead"


def test_scripts_end_at_their_end_tag():
    assert html.main_text(f"<body><script src=/js/>var x = 1, y = 2;</script ><p>{LONG}</p><svg width=1 /><p>{LONG}</p><style/>p{{}}</style></body>") == f"{LONG}\n{LONG}"


def test_deep_pages_take_time_by_their_length():
    deep = "<div>" * 40_000 + LONG
    wide = "".join(f"<div>{LONG}" for _ in range(20_000)) + "</span></p></div>" * 20_000
    assert html.main_text(deep) == LONG
    assert html.main_text(wide) == "\n".join([LONG] * 20_000)
    page = html.Page(deep)
    assert len(page.weights) == len(page.nodes) == 40_001 and len(page.blocks) == 1
