"""Main text of pages: planted articles in pages of many makes, and the window sums beside plain loops."""

import random

import numpy as np
import pytest
import pyarrow.dataset as ds

from kerbline.llm import page_text as P

ONE = "The first paragraph of the article is long enough to be one."
TWO = "A second paragraph, with a link in it, goes on for some words more."
WANT = ["Title of it", ONE, "Short.", TWO]
NAV = '<ul><li><a href="/a">Home</a></li><li><a href="/b">All news of the day</a></li><li><a href=/c>About us</a></li></ul>'
NOISE = "Buy our fine things today, they are cheap and good, and they are here to stay with you."
BODY = (f"<h1>Title of it</h1><p>{ONE}</p>\n<p>Short.</p><p>A second <i>paragraph</i>, with <a href='x'>a link</a> in it, "
        "goes on\n\tfor&nbsp;some   words more.</p>")


def _page(body, head="<title>A title</title><style>p{}</style><script>var t='</p><article>no';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


PAGES = {
    "article": _page(f"<nav>{NAV}</nav><div class=ad>{NOISE}</div><article>{BODY}</article><footer>&copy; us</footer>"),
    "page header": _page(f"<header><a href=/>Site</a><p>{NOISE}</p></header><main>{BODY}</main><aside>{NOISE}</aside>"),
    "named divs": _page(f"<div id='top-nav'>{NAV}</div><div class='cookie-notice'>{NOISE}</div><div id=content>{BODY}</div>"
                        f"<div class='sidebar'>{NOISE}<p>{NOISE}</p></div><div id=footer><p>{NOISE}</p></div>"),
    "body name": _page(f"<div class=wrap><p>{NOISE}</p><div class='articleBody'>{BODY}</div><div><p>{NOISE}</p></div></div>"),
    "comments": _page(f"<article>{BODY}<section class='comments'><h2>2 comments</h2><article class='comment'><p>{NOISE}</p>"
                      f"<p>{NOISE}</p></article></section></article><div id='comments'><p>{NOISE * 20}</p></div>"),
    "form around": _page(f"<form id=f method=post><div>{NAV}</div><article>{BODY}</article><input type=submit></form>"),
    "forms within": _page(f"<article>{BODY}<form><label>Mail</label><p>{NOISE}</p><button>Go</button></form></article>"),
    "advert within": _page("<article>" + BODY.replace("<p>Short.", f"<div class='ad-slot ads'><p>{NOISE}</p></div><p>Short.")
                           + "</article>"),
    "plain": _page(f"<div>{NAV}</div><div>{BODY}</div><div><p>Copyright by us</p></div>"),
    "plain table": _page(f"<table><tr><td>{NAV}</td><td>{BODY}</td></tr></table>"),
    "open tags": _page(f"<nav>{NAV}</nav><article>{BODY}").replace("</p>", "").replace("</li>", ""),
    "cut off": _page(f"<article>{BODY}").split("</body")[0] + "<p class='x",
    "upper case": _page(f"<NAV>{NAV}</NAV><ARTICLE>{BODY}</ARTICLE>"),
    "strange markup": _page(f"<!-- <article>{NOISE}</article> --><article data-x='a>b' {'class=\"\"'}><![CDATA[x]]><?php y ?>{BODY}"
                            f"<p hidden>{NOISE}</p><p style='display: none'>{NOISE}</p></article></div></section>"),
    "own header": _page(f"<article><header><h1>Title of it</h1><p>By A. Writer</p></header>{BODY.split('</h1>')[1]}"
                        f"<footer>Filed under: tests</footer></article>"),
    "hint on top": _page(f"<div class='page with-sidebar'><article>{BODY}</article><div class='sidebar'>{NOISE}</div></div>"),
    "notice": _page(f"<div role=alertdialog><p>{NOISE}</p></div><noscript>{NOISE}</noscript><main>{BODY}</main>"),
    "teasers": _page(f"<article>{BODY}</article><article><h2>Other</h2><p>Teaser.</p></article>"),
}


@pytest.mark.parametrize("name", PAGES)
def test_planted(name):
    assert P.main_text(PAGES[name]) == "\n\n".join(WANT)


def test_text_of_blocks():
    page = _page("<article><p>a&amp;b &lt;i&gt; &eacute;&#233;&#xe9; &unknown; AT&T 1 < 2 &amp</p>"
                 "<ul><li>x<li>y</ul><p>one<br>two<b> th</b>ree</p><table><tr><td>c</td><td>d</td></tr></table>"
                 "<pre> k\n  l </pre><p> \t </p><blockquote>q<p>r</p></blockquote></article>")
    assert P.main_text(page) == "\n\n".join(
        ["a&b <i> ééé &unknown; AT&T 1 < 2 &", "x", "y", "one two three", "c d", "k l", "q", "r"])


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<!-- x", "<script>x", "</p></div>", "<p title='",
                                  _page(f"<nav>{NAV}</nav>"), _page(f"<div>{NAV}</div>"), "<title>only</title>"])
def test_no_text(page):
    assert P.main_text(page) == ""


def test_bare_text():
    assert P.main_text("just  words\n") == "just words"
    assert P.main_text("x" * 3_000_000) == "x" * 3_000_000


def test_large_and_nested_pages():
    deep = "<div>" * 3000 + f"<p>{ONE}</p>" + "</div>" * 3000
    assert P.main_text(deep) == ONE
    many = "".join(f"<p>{ONE} {i}</p>" for i in range(20000))
    assert P.main_text(f"<article>{many}</article>").count("\n\n") == 19999
    assert P.main_text("<a " * 100_000) == "" and P.main_text("<p a='" * 50_000) == ""


def test_windows_beside_loops():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice((0, 0, 0, 3, 40)) for _ in range(rng.randint(0, 30))]
        x = np.array(w, dtype=np.int64)
        assert P.windows(x).tolist() == [sum(w[i:i + P.WINDOW]) for i in range(len(w))]
        kept = [False] * len(w)
        for a, b in P.spans(x):
            assert w[a] and w[b - 1] and not any(kept[a:b])
            kept[a:b] = [True] * (b - a)
        for i in range(len(w)):  # kept: text, or a gap narrower than the window between text
            near = w[i] or (any(w[max(0, i - P.WINDOW + 1):i]) and any(w[i:]) and any(
                w[j] for j in range(i, min(len(w), next(k for k in range(i, -1, -1) if w[k]) + P.WINDOW + 1))))
            assert kept[i] == bool(near)


def test_query(spark):
    rows = [(i, f"u{i}", p, "x", 7) for i, p in enumerate(PAGES.values())] + [(0, "u0", "", "x", 7), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in P.page_text(pages).collect()), key=str)
    want = [(i, f"u{i}", "\n\n".join(WANT)) for i in range(len(PAGES))] + [(0, "u0", ""), (None, None, "")]
    assert got == sorted(((*r, len(r[2])) for r in want), key=str)
    assert P.page_text(pages.limit(0)).count() == 0


def test_given_pages():
    """Every given page holds its article in one element; its blocks are found by a plain pattern."""
    import html
    import re

    for row in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().to_pylist():
        inner = re.sub(r"<[^>]*\Z", "", re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert P.main_text(row["html"]) == "\n\n".join(b for b in blocks if b)
