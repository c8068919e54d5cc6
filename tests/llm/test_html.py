import time

import pytest
from corpora import clashing

from tallyspark.llm.html_extract import attributes, best_container, extract, extract_main_text

PAGES = "page_id long, url string, html string"
BODY = "<p>First   paragraph &amp; more text that is long enough to matter for scores.</p><p>Second&nbsp;one,<br>with a break and <a href='x'>a link</a> in it, long enough as well.</p>"


def page(inner):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='page'><nav><ul><li><a href='/'>Home</a></ul></nav><header>Site name</header>{inner}<aside>Side</aside><footer>Foot</footer></body></html>"


TEXT = "First paragraph & more text that is long enough to matter for scores.\nSecond one, with a break and a link in it, long enough as well."


def test_parts_that_are_left_out():
    inner = f"<div class='cookie-notice'>We use cookies</div><article><header><h1>Head&#x65;r</h1><p>by someone</p></header><script>var x='</p>';</script>{BODY}<form><p>Mail<input></p></form><div class='ad-slot'>Buy</div><div id='comments'><p>{'I say this at great length. ' * 9}</p></div><ul><li>one<li>two</ul></article>"
    assert extract(page(inner), None) == f"Header\n{TEXT}\none\ntwo"


def test_broken_pages():
    assert extract("", None) == "" and extract("just text", None) == "just text"
    assert extract("<div><p>unclosed <b>bold<p>next", None) == "unclosed bold\nnext"
    assert extract("<article><p>text</p><!-- open comment <p>gone", None) == "text"
    assert extract("<p>a < b and <script>x", None) == "a < b and"
    assert extract("<p title='>'>quoted</p><p title='unclosed>next</p>", None) == "quoted\nnext"
    assert extract("<nav>only menu</nav>", None) == ""
    assert extract("<table><tr><td>a<td>b<tr><td>c</table>", None).count("\n") <= 2
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert extract(deep, None) == "deep"


def test_paths_and_votes(spark):
    usual = page(f"<div class='post p12'>{BODY}</div><div class='extra'>{BODY[:30]}</p></div>")
    odd = page(f"<div class='post p77'><p>Short.</p></div><div class='extra'><p>{'This is the larger part of the odd page. ' * 20}</p></div>")
    assert best_container(usual)[0] == "body/div.p#.post"
    rows = [(i, "http://a.org/x", usual) for i in range(5)] + [(5, "http://A.org/y", odd), (6, "http://b.org/", odd), (7, None, usual), (8, "http://a.org/", None), (9, "http://a.org/", ""), (9, "http://a.org/", usual)]
    table = clashing(spark.createDataFrame(rows, PAGES)).repartition(3)
    for size in (1 << 20, 0):  # broadcast, and the join that stands in for it
        got = {(r["page_id"], r["url"], r["n_chars"], r["text"]) for r in extract_main_text(table, broadcast_bytes=size).collect()}
        texts = {r[0]: r[3] for r in got if r[0] != 9}
        assert texts[0] == TEXT and texts[5] == "Short." and texts[6].startswith("This is the larger part") and texts[7] == TEXT and texts[8] == ""
        assert all(len(r[3]) == r[2] for r in got) and {r[3] for r in got if r[0] == 9} == {"", TEXT}
    assert extract_main_text(table.limit(0)).count() == 0


def test_articles_in_several_containers(spark):
    long, short = "A long part of the article. " * 40, "A shorter part of it. " * 15
    parts = page(f"<main><article><h1>Title</h1><section><p>{long}</p></section><section><p>{short}</p></section></article></main>")
    whole = f"Title\n{long.strip()}\n{short.strip()}"
    assert extract(parts, None) == whole and extract(parts, best_container(parts)[0]) == whole
    divs = page(f"<div class='part'><p>{long}</p></div><div class='part'><p>{short}</p></div>")
    assert extract(divs, "body/div.part") == extract(divs, None) == f"{long.strip()}\n{short.strip()}"
    links = page(f"<main><article><p>{long}</p></article><div>{'<p><a href=x>Another headline</a></p>' * 20}</div></main>")
    assert extract(links, None) == long.strip()
    table = spark.createDataFrame([(i, "http://a.org/x", parts) for i in range(3)], PAGES)
    assert {(r["text"], r["path"]) for r in extract_main_text(table).collect()} == {(whole, "body/main")}


@pytest.mark.parametrize("start", ['<article style="overflow:hidden">', '<article title="the hidden valley">', '<article data-hidden="false">', '<article data-id="share-7">', '<article class="overflow-hidden">', '<main class="content with-sidebar">', '<article class="long-form">', "<div class='layout sidebar-left'><article>", "<form id='page'><div>", "<div role='dialog'><div>", "<article class='comments-open' id=content/>"])
def test_marks_that_do_not_make_a_page_empty(start):
    assert extract(page(start + BODY), None) == TEXT


@pytest.mark.parametrize("name", ["ad", "ad-slot", "site-footer", "navBar", "comment-list", "sidebar_left", "cookie-notice", "sr-only", "related", "share-buttons", "newsletter-box", "x sponsored y"])
def test_names_of_what_is_left_out(name):
    inner = f"<article>{BODY}<div class='{name}'>Not the article.</div><div id='{name}'>Nor this.</div></article>"
    assert extract(page(inner), None) == TEXT if " " not in name else extract(page(inner), None) == f"{TEXT}\nNor this."


LONG = "An ordinary part of the article that says something at some length, as articles do. " * 2


@pytest.mark.parametrize("mark", ["sharing-data", "related-work", "social", "notice", "comments-on-the-method", "menu", "footer"])
def test_ids_of_headings_and_paragraphs_say_nothing(mark):
    for tag in ("h2", "h3", "p", "blockquote", "pre"):
        assert extract(page(f"<article>{BODY}<{tag} id='{mark}'>Kept words</{tag}><p>{LONG}</p></article>"), None) == f"{TEXT}\nKept words\n{LONG.strip()}"


@pytest.mark.parametrize("tag, name", [("section", "class=related-work"), ("section", "id=social-history"), ("div", "id=menu-planning"), ("p", "class=share-price"), ("p", "class=comment-analysis"), ("div", "class=text-widget"), ("blockquote", "class=social-contract"), ("p", "id=footer-of-the-letter"), ("div", "class=advertising-law")])
def test_ordinary_names_stay(tag, name):
    inner = f"<p>{LONG}</p>" if tag in ("section", "div") else LONG
    assert extract(page(f"<article>{BODY}<{tag} {name}>{inner}</{tag}><p>End.</p></article>"), None) == f"{TEXT}\n{LONG.strip()}\nEnd."


@pytest.mark.parametrize("name", ["social-follow", "share-this", "reader-comments", "comment-thread", "site-menu", "promo-card", "newsletter-cta", "ad-leaderboard", "article-footer", "related-posts", "notice"])
def test_more_names_of_what_is_left_out(name):
    junk = f"<p>{'Something that is not the article at all. ' * 5}</p>"
    assert extract(page(f"<article>{BODY}<div class='{name}'>{junk}</div></article>"), None) == TEXT


def test_doubtful_names_of_links_and_little_text():
    for inner in ("Follow!", "<a href=x>one</a> <a href=y>two</a> " * 30):
        assert extract(page(f"<article>{BODY}<div class='social-butterfly'>{inner}</div></article>"), None) == TEXT


def test_an_article_in_siblings_under_the_body(spark):
    text = page(f"<div class='intro'><h1>Title</h1><p>{LONG}</p></div><div class='rest'>{BODY * 2}</div><div class='extra'><p>Little.</p></div><div class='more'>{'<p><a href=x>Another headline</a></p>' * 20}</div>")
    whole = f"Title\n{LONG.strip()}\n{TEXT}\n{TEXT}"
    assert extract(text, None) == whole and best_container(text)[0] == "body/div.intro|body/div.rest" and extract(text, best_container(text)[0]) == whole
    table = spark.createDataFrame([(i, "http://a.org/x", text) for i in range(3)] + [(3, "http://a.org/y", page(f"<div class='rest'>{BODY}</div>"))], PAGES)
    assert {(r["text"], r["path"]) for r in extract_main_text(table).collect()} == {(whole, "body/div.intro|body/div.rest"), (TEXT, "body/div.intro|body/div.rest")}


def test_elements_that_end_early_or_never():
    for odd in ("<svg/>", "<iframe/>", "<svg>", "<iframe src=x>", "<textarea>", "<object data=x>", "<select>", "<noscript>", "<title>", "<canvas/>"):
        assert extract(page(f"<article><p>Lead words</p>{odd}{BODY}</article>"), None) == f"Lead words\n{TEXT}", odd
    assert extract(page(f"<article><p>Lead <svg><title>no</title><p>no</p></svg>words</p>{BODY}<object><p>no</p></object></article>"), None) == f"Lead words\n{TEXT}"
    assert extract("<p title=\"a > b\" class=x/>one<p data-x='</p>' id=a>two", None) == "one\ntwo"
    assert extract("<p>&#000065;&#99999999999999999999;&#xD800;&bogus; a &lt b</p>", None) == "A\ufffd\ufffd&bogus; a < b"
    assert attributes(" a=1 B = 'x>y' c=\"\" d e=u/v a=2/") == {"a": "1", "b": "x>y", "c": "", "d": "", "e": "u/v"}


def test_the_headline_and_lead_beside_the_article():
    top = f"<h1>Title</h1><div class='ad'>Buy</div><p class='teaser'>The lead.</p><div class='content'>{BODY}</div>"
    for around in ("{}", "<div class='wrap'>{}</div>"):
        text = page(around.format(top))
        assert extract(text, None) == extract(text, best_container(text)[0]) == f"Title\nThe lead.\n{TEXT}"
    assert extract(page(f"<header><h1>Site</h1></header><p>Stray.</p><div class='content'>{BODY}</div>"), None) == TEXT


def test_names_never_judge_the_winning_path(spark):
    """The path that a host's pages vote for holds on a page where the same names would say otherwise."""
    usual, odd = page(f"<div class='post share'><h1>T</h1>{BODY}</div>"), page(f"<div class='post share'>{BODY}</div><div><p>{'A longer other part. ' * 30}</p></div>")
    table = spark.createDataFrame([(i, "http://a.org/x", usual) for i in range(3)] + [(3, "http://a.org/y", odd)], PAGES)
    got = {r["page_id"]: (r["text"], r["path"]) for r in extract_main_text(table).collect()}
    assert got[0] == (f"T\n{TEXT}", "body/div.post.share") and got[3] == (TEXT, "body/div.post.share")


HOSTILE = {"quotes": '<p "', "raw": "<textarea x", "raw ends": "<textarea x>", "stray ends": "<div><li></p>", "quoted ends": "<p \">\"'>' ", "never ends": "<p a=\">\" b='>' c=\"", "deep": "<div>x", "items": "<ul><li>x", "tables": "<table><tr><td>", "comments": "<!--", "less": "<", "muted": "<svg><div>", "headers": "<header><h1>a<div>", "blanks": "<div a " + " " * 40}


@pytest.mark.parametrize("name", HOSTILE)
def test_reading_is_linear(name):
    def seconds(size):
        text, best = HOSTILE[name] * (size // len(HOSTILE[name])), 1e9
        for _ in range(2):
            began = time.process_time()
            extract(text, "body/div/div")
            best = min(best, time.process_time() - began)
        return best

    assert seconds(400_000) < 0.25 + 14 * seconds(50_000)  # eight times the text; the square would be 64 times
