"""Extraction on hand-made pages with known articles."""

import pytest

from skyfence.llm.html_text import best_path, extract, extract_pages
from skyfence.llm.markup import Page

LONG = "This is a sentence of the article, and it goes on for a while."
PAGE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="post-1"><header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>'
    '<!-- ad <p>no</p> --><div class="cookie-notice">We use cookies.</div><div class="ad">Buy now, cheap, good, fast.</div><article><h1>Head &amp; more</h1>'
    f"<p><b>{LONG}<br><p>One&nbsp;two\n  three<br>four &#233;&eacute;<ul><li>first<li>second</ul><table><tr><td>x<td>y</table>"
    '<form><p>Mail, me, please.</p><input></form><aside>See also</aside><div id="comments"><p>I, too, think, so.</p></div></article><div class="sidebar"><p>Side, text, here.</p></div>'
    "<footer>&copy; 2020</footer></body></html>")
TEXT = f"Head & more\n{LONG}\nOne two three four éé\nfirst\nsecond\nx\ny"


def text_of(html):
    page = Page(html)
    return extract(page, best_path(page))


def test_page():
    assert text_of(PAGE) == TEXT


@pytest.mark.parametrize("html,text", [
    ("", ""), ("no markup, but words.", "no markup, but words."), ("<p>", ""), ("<body>plain, text", "plain, text"), ("<div><p>a, b<div>c, d</div></div>", "a, b\nc, d"),
    ("<body><p>a <i>b</i><b>c</b>&lt;p&gt;</p></body>", "a bc<p>"), ("<body><script>x<p>y", ""), ("<body><p>a<!-- open", "a"), ("<body></div></p>x, y<p hidden>z</p></body>", "x, y"),
    ("<body><div class='x'><a href=1>menu</a></div><div class=main-text><p>Some words, here.</p></div>", "Some words, here."), ("<BODY><ARTICLE>A<BR/>B</ARTICLE>", "A B"),
])
def test_oddities(html, text):
    assert text_of(html) == text


def test_long_page():
    assert text_of("<body><article>" + f"<p>{LONG}</p>" * 20_000 + "</article>").count("\n") == 19_999
    assert text_of("<body>" + "<div>" * 100_000 + "deep, text" + "</div>" * 100_000 + "<p>after, it") == "deep, text\nafter, it"


def test_hosts_agree(spark):
    normal = lambda i: f'<body><div class="menu-{i}">m</div><div class="entry e{i}"><p>{LONG}</p><p>More, {i}.</p></div><div class="box"><p>Short, box.</p></div></body>'
    odd = f'<body><div class="entry e9"><p>Tiny.</p></div><div class="box"><p>{LONG} {LONG}</p></div></body>'
    rows = [(i, "https://h.example.com/x", normal(i)) for i in range(30)] + [(100, "http://H.example.com:80/y?q", odd), (101, None, PAGE), (102, "nonsense", None), (103, "http://other.example", "<p></p>"), (5, "https://h.example.com/x", normal(5))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "'x' as text", "2 as paths")
    got = {r.page_id: r for r in extract_pages(df).collect()}
    assert extract_pages(df).count() == len(rows)
    assert got[3].text == f"{LONG}\nMore, 3." and got[3].n_chars == len(got[3].text)
    assert got[100].text == f"{LONG} {LONG}"  # the host's path holds next to nothing of this page
    assert got[101].text == TEXT and got[102].text == "" and got[103].text == ""
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("html,text", [
    (f"<html><head><title>T</title><body><article><p>{LONG}</p></article>", LONG), (f"<head><meta charset=utf-8><title>T</title><p>{LONG}", LONG), (f"<html><head><title>T</title>{LONG}", LONG),
    ("<!DOCTYPE html><title>x</title><p>Article, in words.</p>", "Article, in words."), ("<html lang=en><title>x</title><h1>Head</h1><p>Article, in words.</p>", "Head\nArticle, in words."),
    (f"<title>x</title><p>{LONG}</p><div><p>Box.</p></div>", f"{LONG}\nBox."), (f"<head><title>a <b>x</b></title><style>p</style></head><body><p>{LONG}", LONG),
])
def test_omitted_tags(spark, html, text):
    assert text_of(html) == text
    assert extract_pages(spark.createDataFrame([(1, "http://h.example/", html)], "page_id bigint, url string, html string")).first().text == text


def test_small_templates_keep_their_article(spark):
    """Under a tenth of the votes, with the major path as a teaser."""
    major = lambda i: f'<body><div class="entry"><p>{LONG}</p><p>More, {i}.</p></div><div class="box"><p>Short, box.</p></div></body>'
    minor = lambda i: f'<body><div class="entry"><p>Tiny {i}.</p></div><div class="box"><p>{LONG} {LONG} {i}</p></div></body>'
    rows = [(i, "http://h.example/", major(i)) for i in range(40)] + [(100 + i, "http://h.example/", minor(i)) for i in range(3)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[100 + i] for i in range(3)] == [f"{LONG} {LONG} {i}" for i in range(3)]
    assert got[7] == f"{LONG}\nMore, 7." and len(got) == len(rows)


def test_pages_without_host_stand_alone(spark):
    rows = [(i, None, f'<body><div class="a"><p>{LONG}</p></div></body>') for i in range(9)] + [(50, "x", f'<body><div class="a"><p>Teaser.</p></div><div class="b"><p>{LONG} {LONG}</p></div></body>')]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[50] == f"{LONG} {LONG}" and got[3] == LONG


def test_prose_beside_the_container():
    many = "".join(f"<p>{LONG}</p>" for _ in range(9))
    assert text_of(f"<body><div class=post><p>Lead: {LONG}</p><div class=text>{many}</div><p>{LONG} End.</p></div><div>Some links</div></body>") == "\n".join([f"Lead: {LONG}", *[LONG] * 9, f"{LONG} End."])
    assert text_of(f"<body><p>Few words.</p><div class=text>{many}</div></body>") == "\n".join([LONG] * 9)


@pytest.mark.parametrize("part", [
    f"<section id='discussion'><p>{LONG}</p></section>", "<h2 id='related-work'>Related work</h2>", "<h2 id='search-algorithms'>Search</h2>", "<div class='entry-header'><h1>Title</h1></div>", f"<p id='side-effects'>{LONG}</p>",
    "<p>One <span id='notice'>two</span> three.</p>", f"<div id='social-theory'><p>{LONG}</p></div>", f"<div class='form-factor'><p>{LONG}</p></div>",
])
@pytest.mark.parametrize("around", ["article", "div"])
def test_names_that_articles_have(part, around):
    if around == "div" and part.startswith(("<div id", "<div class='form")):
        return  # outside an article, containers other than sections go by any word of their name
    got = text_of(f"<body><{around}><p>{LONG}</p>{part}<p>End, {LONG}</p></{around}></body>").split("\n")
    assert len(got) == 3 and got[0] == LONG


@pytest.mark.parametrize("part", [
    "<div class='related-posts'><a href=1>One more story of a kind that is like this one</a></div>", f"<div id='comments'><p>{LONG} {LONG}</p></div>", f"<ul class='comment-list'><li>{LONG}</ul>", "<div class='share'>Share this</div>",
    f"<div class='ad'><p>{LONG}</p></div>", "<div id='related'><a href=1>One more story of a kind that is like this one</a></div>", f"<div class=cookie-notice>{LONG}</div>",
])
def test_parts_left_out_of_articles(part):
    assert text_of(f"<body><article><p>{LONG}</p>{part}</article></body>") == LONG


def test_host_decides_between_comparable_parts(spark):
    normal = lambda i: f'<body><div class="entry"><p>{LONG}</p><p>More, {i}.</p></div><div class="box"><p>Short, box.</p></div></body>'
    odd = f'<body><div class="entry"><p>{LONG}</p></div><div class="box"><p>{LONG}</p><p>{LONG}</p></div></body>'
    assert text_of(odd) == "\n".join([LONG] * 3)
    rows = [(i, "https://h.example.com/x", normal(i)) for i in range(30)] + [(100, "http://H.example.com:80/y?q", odd)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[100] == LONG


@pytest.mark.parametrize("before,after", [
    ('<form id="aspnetForm" method=post>', "</form>"), ('<div class="wrapper no-sidebar">', "</div>"), ('<div id="page-with-sidebar">', "</div>"), ('<div class="social-sciences">', "</div>"), ('<div class="outer header-fixed"><form>', "</form></div>"),
])
def test_wrappers_that_hold_the_page_stay(before, after):
    inner = f"<h1>T</h1><div class=text><p>{LONG}</p><p>{LONG} End.</p></div>"
    rest = "<nav><a href=1>Menu</a></nav><div class=sidebar><p>Side, text, here.</p></div><form><p>Mail, me.</p></form><aside><p>See, also.</p></aside>"
    assert text_of(f"<body>{before}{inner}{rest}{after}</body>") == f"T\n{LONG}\n{LONG} End."
    assert text_of(f"<body><h1>T</h1>{before}<p>{LONG}</p><p>{LONG} End.</p>{after}{rest}</body>") == f"T\n{LONG}\n{LONG} End."


def test_articles_beside_each_other():
    two = f'<article class="post a"><h2>A</h2><p>{LONG}</p></article><div class=ad>Buy.</div><article class="post b"><h2>B</h2><p>{LONG}</p></article>'
    assert text_of(f"<body><main>{two}</main></body>") == f"A\n{LONG}\nB\n{LONG}"
    assert text_of(f"<body><div>{two}<p>Words.</p></div></body>") == f"A\n{LONG}\nB\n{LONG}"
    long = "".join(f"<p>{LONG}</p>" for _ in range(12))
    assert text_of(f"<body><div><article class=full>{long}</article><article class=teaser><p>Next, story.</p></article></div></body>") == "\n".join([LONG] * 12)


def test_open_quotes():
    assert text_of(f'<body><article><p title="x>{LONG}</p><p class=\'a>{LONG}</p><a href="y">z</a></article>') == f"{LONG}\n{LONG}\nz"
    assert text_of(f'<body><article><p title="a > b" data-x=\'<b>"</b>\'>{LONG}</p></article>') == LONG


def test_deep_pages():
    """Parts are left out however deep they lie, and deep containers are told apart."""
    for depth in (520, 30_000):
        inside = f"<nav><p>{LONG} {LONG}</p></nav><article><p>{LONG}</p></article><aside><p>{LONG}</p></aside><div class=ad>{LONG}</div>"
        assert text_of("<body>" + "<div>" * depth + inside + "</div>" * depth) == LONG
        many = "".join(f"<p>{LONG}</p>" for _ in range(9))
        assert text_of("<body>" + "<div>" * depth + f"<div class=a><p>Few, words.</p></div><div class=b>{many}</div>") == "\n".join([LONG] * 9)
    assert text_of("<body><div>" * 2 + "<div>" * 30_000 + f"<div class=a>{LONG * 9}</div></div><p>{LONG}</p>") == f"{LONG * 9}\n{LONG}"
    assert text_of("<body>" + "<b><i>" * 50_000 + f"<p>{LONG}") == LONG
    assert text_of("<body>" + f"<div><p>{LONG}</p>" * 20_000).count("\n") == 19_999


def vote_by_hand(rows):
    """The vote and the choice, page by page."""
    from collections import Counter
    from urllib.parse import urlsplit

    from skyfence.llm.html_text import COMPARABLE, LAST_RESORT, path_scores

    host = lambda u: (urlsplit(u or "").hostname or "") if "://" in (u or "") else ""
    votes = {}
    for _, url, html in rows:
        path = best_path(Page(html or ""))
        if host(url) and path is not None and not LAST_RESORT.fullmatch(path):
            votes.setdefault(host(url), Counter())[path] += 1
    out = []
    for page_id, url, html in rows:
        page = Page(html or "")
        own, scores, path = best_path(page), path_scores(page), None
        ranked = sorted(votes.get(host(url), Counter()).items(), key=lambda x: (-x[1], x[0])) if host(url) else []
        for candidate, n in ranked:
            if own is not None and n >= 0.1 * sum(votes[host(url)].values()) and candidate in scores and scores[candidate][0] >= COMPARABLE * scores[own][0]:
                path = candidate
                break
        out.append((page_id, extract(page, own if path is None else path)))
    return sorted(out)


def test_votes_against_a_plain_count(spark):
    import random

    r = random.Random(4)
    kinds = [lambda: f"<div class=entry><p>{LONG * r.randint(1, 3)}</p></div>", lambda: f"<div class='box b{r.randint(1, 9)}'><p>{LONG * r.randint(0, 3)}</p></div>", lambda: f"<section id=x><p>Words, here.</p>{LONG}</section>", lambda: "<p>Few.</p>",
             lambda: f"<article class=c{r.randint(1, 3)}><p>{LONG * r.randint(0, 2)}</p></article>"]
    rows = [(i, r.choice(["http://a.example/1", "https://b.example:8080/", None, "nothing", "http://c.example"]), "<body>" + "".join(r.choice(kinds)() for _ in range(r.randint(0, 6)))) for i in range(300)]
    got = sorted((x.page_id, x.text) for x in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect())
    assert got == vote_by_hand(rows)
