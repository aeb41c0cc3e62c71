import random
import re
import time
from html import unescape

import pytest

from samewise.llm.html import main_text
from samewise.llm.q_html import op5_html_text
from tests.llm.html_slow import slow_text

SF = "/root/testdata/sf0.001"


def article(html):
    """What the generator's pages hold: the article element alone, tag by tag."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", html or "", re.S)
    pieces = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*$", "", inner[1])) if inner else []
    return "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in pieces) if x)


def test_pages_against_their_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op5_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == article(pages[r.page_id].html) == slow_text(pages[r.page_id].html)


def test_parts_outside_the_article():
    para = "The house is in the middle of the town and it was built by one of the people who had been there."
    html = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><p>{para} H</p></header>
    <div class="cookie-notice"><p>{para} N</p></div><div id="sidebar-2">{para} S</div><form><p>{para} F</p></form>
    <script>var x = "<p>{para}</p>";</script><main><h1>Title &amp; more</h1><p>{para}</p><p>Short&nbsp;one.<br>Next  line</p><!-- <p>{para}</p> -->
    <div class="ad"><div>{para}</div> A</div><p>1 &lt; 2 and a < b</p><p>{para}</p><ul><li><a href="x">{para}</a></li></ul></main>
    <section id="comments"><p>{para} C</p></section><footer>{para}</footer></body></html>"""
    assert main_text(html) == f"Title & more\n\n{para}\n\nShort one. Next line\n\n1 < 2 and a < b\n\n{para}"


def test_without_landmarks():
    para = "The house is in the middle of the town and it was built by one of the people who had been there."
    html = f'<div><a href="/a">Home</a> <a href="/b">About</a></div><h2>News</h2><div>{para}</div><p>Yes.</p><p>{para}</p><div><a href="#">Top</a></div><p>x</p>'
    assert main_text(html) == f"News\n\n{para}\n\nYes.\n\n{para}"


def test_edge_cases(spark):
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text('<article><p>a</p><p class="x') == "a"
    long = "<article>" + "<p>the of and</p>" * 50_000 + "</article>"
    assert main_text(long) == "\n\n".join(["the of and"] * 50_000)
    rnd = random.Random(1)
    for _ in range(300):  # any text is taken without error
        main_text("".join(rnd.choice(["<p>", "</p>", "<", ">", '"', "'", "<a href='", "&am", "p", " ", "<!--", "-->", "<article>", "</div>", "<div class=ad>"]) for _ in range(40)))


def test_hinted_elements_inside_a_line():
    for tag in ('<a class="share">', '<span class="ad">', '<a href="x" id="comment-3">', '<sup class="social">', "<x-y class=promo>"):
        name = tag[1:-1].split()[0]
        assert main_text(f"<article><p>Long article sentence {tag}Share</{name}> rest<br>of it</p><p>More</p></article>") == "Long article sentence rest of it\n\nMore"
        assert main_text(f"<article><p>Text before {tag}Share<div>Inside</div></{name}> after</p></article>") == "Text before\n\nafter"
    para = "The house is in the middle of the town and it was built by one of the people who had been there."
    assert main_text(f'<p>{para}</p><p>Yes. <a class="share">Share</a></p><div><span class="ad">Advert</span></div>') == f"{para}\n\nYes."


def test_hints_at_wrappers():
    para = "The house is in the middle of the town and it was built by one of the people who had been there."
    inner = f"<h1>Title</h1><p>{para}</p><p>Short.</p>"
    want = f"Title\n\n{para}\n\nShort."
    for tag in ("main", "article"):
        page = f'<{tag}>{inner}<div class="ad">{para}</div></{tag}><div id="comments"><p>{para}</p><p>{para}</p><article class="comment"><p>{para}</p></article></div>'
        for opening in ('<div class="layout has-sidebar">', '<div id="content" class="post comments-open">', '<div class="no-menu">', '<div data-id="menu">', '<div title="a class=ad">', "<div>"):
            assert main_text(f"{opening}{page}</div>") == want, (tag, opening)
        for opening in ('<div class="menu-layout">', '<div id="page" class="ad-free">', "<form id=f><div class=search-page>"):  # all of the text is inside
            assert main_text(f'{opening}<{tag}>{inner}<div class="ad">{para}</div></{tag}></div>') == want, (tag, opening)
    assert main_text(f'<div class="widget-page"><p>{para}</p><p>{para}</p></div><div class="menu">x</div>') == f"{para}\n\n{para}"
    assert main_text(f'<article><p>{para}</p></article><div id="comments">' + f"<p>{para}</p>" * 20 + "</div>") == para  # more comments than article
    deep = 20_000
    assert main_text("<div class=ad>" * deep + f"<p>{para}</p>" + "</div>" * deep + f"<article><p>{para}</p></article>") == para


def test_languages_without_stop_words():
    finnish = "Vanha talo seisoo keskellä kaupunkia ja sen rakensivat ihmiset jotka olivat asuneet siellä kauan ennen sotaa."
    chinese = "这座房子位于城市的中心由曾经住在那里的人们建造" * 4
    for para in (finnish, chinese):
        html = f'<div><a href="/a">{para}</a></div><div class="menu">{para}</div><h2>Otsikko</h2><p>{para}</p><p>{para}</p><footer>{para}</footer>'
        assert main_text(html) == f"Otsikko\n\n{para}\n\n{para}"
        assert main_text(f'<div class="menu-page">{html}</div>') == f"Otsikko\n\n{para}\n\n{para}"
    english = "The house is in the middle of the town and it was built by one of the people who had been there."
    assert main_text(f"<div>{english}</div><div>{finnish}</div>") == english


def generated(rnd, landmarks):
    """A random page of nested elements, with and without hints, links and long texts in several languages."""
    texts = [
        "The house is in the middle of the town and it was built by one of the people who had been there.", "Das Haus ist in der Mitte der Stadt und wurde von den Leuten gebaut, die nicht mehr da sind.",
        "Vanha talo seisoo keskellä kaupunkia ja sen rakensivat ihmiset jotka olivat asuneet siellä kauan.", "Yes.", "Read more", "A short line of it", "x &amp; y", "",
    ]
    names = ["", "", "", ' class="post-body"', ' class="ad"', ' class="cookie-notice"', ' id="comments"', ' class="sidebarLeft top"', ' class="related-work"', ' class="has-menu"', ' data-id="share"', " role=navigation", ' class="user-comments"', ' class="left-rail wide"', ' id="ad-top-box"', ' class="blog-wide-comments"', ' class="user-menu-open"']
    blocks = ["div", "section", "p", "h2", "ul", "form"] + (["article", "main", "nav", "footer", "header", "aside"] if landmarks else [])

    def element(depth):
        if depth > 4 or rnd.random() < 0.3:
            text = rnd.choice(texts)
            kind = rnd.random()
            return f"<a href='/x'>{text}</a>" if kind < 0.15 else f"<span{rnd.choice(names)}>{text}</span> " if kind < 0.3 else f"{text}<br>" if kind < 0.4 else text
        tag = rnd.choice(blocks)
        inner = "".join(element(5 if tag in ("p", "h2") else depth + 1) for _ in range(rnd.randint(1, 5)))
        return f"<{tag}{rnd.choice(names)}>{inner}</{tag}>"

    return "<html><head><title>T</title></head><body>" + "".join(element(0) for _ in range(rnd.randint(1, 8))) + "</body></html>"


def test_against_the_slow_version():
    rnd, kept = random.Random(7), 0
    for i in range(1500):
        page = generated(rnd, i % 3 == 0)
        got = main_text(page)
        assert got == slow_text(page), page
        kept += bool(got)
    assert 300 < kept < 1400


def test_names():
    para = "The house is in the middle of the town and it was built by one of the people who had been there."
    for name in ("related-work", "ad-free", "has-sidebar", "comments-open", "formula", "adverbs", "no-menu"):
        assert main_text(f'<article><p>{para}</p><section class="{name}"><p>{para}</p></section></article>') == f"{para}\n\n{para}", name
    for name in ("ad", "sidebar-2", "adBox", "x related-posts", "comment-37", "mainNav", "AD", "social_links"):
        assert main_text(f'<article><p>{para}</p><section class="{name}"><p>{para}</p></section></article>') == para, name


def test_end_tags_left_out():
    assert main_text("<article><ul><li class=ad>x<li>one<ul><li>in<li id=promo>y</ul><li>two</ul><p class=ad>z<p>a<table><tr class=ad><td>z<tr><td>b<td class=promo>c<td>d</table></article>") == "\n\n".join(["one", "in", "two", "a", "b", "d"])
    assert main_text("<article><dl><dt class=ad>x<dd>y<dt>z</dl><p class=ad>a <span class=promo>b<p>c</article>") == "y\n\nz\n\nc"


def test_hostile_pages_take_linear_time():
    pages = [
        "<div>" * 100_000 + "</b>" * 100_000, "<head>" * 160_000, "<li class=ad><ul>" + "<div>" * 100_000 + "<li>" * 100_000, "<a '" * 250_000, "<!--" * 250_000, '<a href="' * 100_000, "<p class=ad>" * 80_000,
        "<td class=ad><table>" * 50_000, "&" * 1_000_000, "<" * 1_000_000, "<div>x" * 150_000, "<head>x</head " * 70_000, "<article>" * 100_000,
    ]
    for page in pages:
        start = time.process_time()
        main_text(page)
        main_text(page[: len(page) // 2])
        assert time.process_time() - start < 12, page[:20]


PARA = "The house is in the middle of the town and it was built by one of the people who had been there."
MORE = "It is one of the many that were about to be sold, and that was when they had to leave it for all time."
PARTS = """user-comments reader-comments article-comments blog-comments comment-thread commentlist fb-comments user-reviews comments comments-section
    article-sidebar left-rail ad-slot advertising ads-wrapper cookie-law cookieconsent related-articles global-header site-footer share-buttons
    wp-comments-list visitor-comments comment_37_body adSlotTop""".split()


@pytest.mark.parametrize("name", PARTS)
def test_parts_outside_the_article(name):
    for part in (f'<div class="{name}"><p>{MORE}</p></div>', f'<section id="{name}"><div><p>{MORE}</p><p>Nice</p></div></section>'):
        assert main_text(f"<body><div><p>{PARA}</p><p>{PARA}</p></div>{part}</body>") == f"{PARA}\n\n{PARA}", part
        assert main_text(f"<body><article><p>{PARA}</p><p>{PARA}</p>{part}</article></body>") == f"{PARA}\n\n{PARA}", part
        # unless they hold all that there is
        assert main_text(f'<body><div class="{name}"><p>{PARA}</p></div></body>') == PARA


def test_nested_comment_articles():
    html = f'<article class="post"><p>{PARA}</p><p>{PARA}</p><article class="comment"><p>{MORE}</p></article><article id="comment-9"><p>{MORE}</p></article></article>'
    assert main_text(html) == f"{PARA}\n\n{PARA}"
    assert main_text(f'<article class="share"><p>{PARA}</p></article>') == PARA


def test_what_stands_between_good_blocks_stays():
    names = "Anna Berg, Carl Dorn, Emil Falk, Gerd Hansen, Ida Jung, Karl Lund, Mona Nord, Otto Prinz, Rosa Stein"
    code = "for row in table: total += row.price * row.amount; print(row.name, row.price, total, row.amount / total)"
    finnish = "Vanha talo seisoo keskellä kaupunkia ja sen rakensivat ihmiset jotka olivat asuneet siellä kauan ennen sotaa."
    link = f'<a href="/x">{MORE}</a>'
    for inner in (names, code, finnish, link):
        text = MORE if inner == link else inner
        for outer in ("div", "article", "main"):
            assert main_text(f"<{outer}><p>{PARA}</p><p>{inner}</p><p>{PARA}</p></{outer}>") == f"{PARA}\n\n{text}\n\n{PARA}", inner
        assert main_text(f"<p>{inner}</p><p>{PARA}</p><div class='ad'>{PARA}</div>") == PARA


def test_short_pages_are_not_empty():
    assert main_text("<html><body><p>One short line.</p></body></html>") == "One short line."
    assert main_text("<nav>Home</nav><div><h1>Title</h1><p>Short.</p></div><footer>Imprint</footer>") == "Title\n\nShort."
    assert main_text('<nav>Home</nav><a href="/">All</a><div class="ad">Buy</div>') == ""
