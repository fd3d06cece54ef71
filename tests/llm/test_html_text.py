"""Main text of pages: planted regions, character references, consensus, edge cases, an independent reading of the provided pages."""

import html
import re

import pytest

pytest.importorskip("folioflow.llm.html_text")
from folioflow.llm import html_text as H  # noqa: E402


def text(page, path=None):
    return H.text_at(*H.blocks(page), path)


def test_regions_are_left_out():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c <p>no</p> --><div class="cookie-notice">Cookies</div>
    <div class="page-with-sidebar"><article><header class="entry-header"><h1 class="entry-header">The  title</h1></header><p>One &amp; two&nbsp;three &#233; &lt;b&gt;<br>four.
    <p>Second <b>para</b>graph <a href="/l">link</a>.<div class="ad">Buy</div><form><p>mail</p><input></form><ul><li>a<li>b</ul>
    <section id="comments"><p>Nice post</p></section><aside>Side</aside></article></div><div class="sidebar"><p>Other things that are long and wordy</p></div>
    <footer>&copy; f</footer></body></html>"""
    assert text(page) == "The title\nOne & two three é <b> four.\nSecond paragraph link.\na\nb"


def test_broken_and_empty_pages():
    assert text("") == "" and text("<html><body></body></html>") == "" and text("plain & text") == "plain & text"
    assert text("<article><p>a<p>b") == "a\nb"
    assert text("<article><p>1 < 2 and x</p></article") == "1 < 2 and x"
    assert text("<script>never closed <p>x</p>") == ""
    assert text("<div><p>" + "w " * 200_000 + "</p></div>").count("w") == 200_000
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_host_path_wins(spark):
    """On one page the host's path has little text, and a box of links and blurbs more; the other pages outvote it."""
    page = lambda a, b: f'<html><body><div class="post7"><p>{a}</p></div><div class="feed"><p>{b}</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page("story " * 60, "teaser " * 10)) for i in range(5)] + [(9, "http://H.example/9", page("short story", "teaser " * 40))]
    rows += [(10, None, None), (11, "x", ""), (12, "http://other.example/", page("a", "b " * 9)), (None, "http://h.example/z", page("late", "t")), (9, "http://H.example/9", page("short story", "teaser " * 40))]
    pages = spark.createDataFrame([(*r, "t", "p") for r in rows], "page_id long, url string, html string, text string, path string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(pages).collect()), key=str)
    assert (9, "short story", 11) in got and got.count((9, "short story", 11)) == 2
    assert (10, "", 0) in got and (11, "", 0) in got and (None, "late", 4) in got and len(got) == len(rows)
    assert H.extract(pages.limit(0)).collect() == []
    H.BROADCAST_HOSTS, keep = 0, H.BROADCAST_HOSTS
    assert sorted(((r.page_id, r.text, r.n_chars) for r in H.extract(pages).collect()), key=str) == got
    H.BROADCAST_HOSTS = keep


def test_provided_pages(spark):
    """Those pages keep their text in <article>, in h1 and p; this reads them by regular expressions alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        want[r.page_id] = (r.url, "\n".join(x for x in parts if x))
    got = {r.page_id: (r.url, r.text) for r in H.extract(pages).collect()}
    assert got == want


def test_articles_of_several_containers_are_kept_whole():
    a, b, c = "title of five whole words", "lead " * 20, "body " * 300
    want = f"{a}\n{b.strip()}\n{c.strip()}"
    assert text(f"<article><h1>{a}</h1><div class=lead><p>{b}</p></div><div class=body><p>{c}</p></div></article><div class=feed><p>{b}</p></div>") == want
    assert text(f"<main><h1>{a}</h1><p>{b}</p><article><div class=x><p>{c}</p></div></article></main>") == want
    one, two = "one " * 100, "two " * 300
    assert text(f"<body><section class=intro><p>{one}</p></section><section class=main><p>{two}</p></section></body>") == f"{one.strip()}\n{two.strip()}"
    links = "<p><a href=/x>" + "link " * 40 + "</a></p>"
    assert text(f"<main><article><p>{c}</p></article><div class=more>{links}</div></main>") == c.strip()


def test_class_words_of_regions_and_of_articles():
    main = "<p>" + "story " * 50 + "</p>"
    body = ("story " * 50).strip()
    assert text(f'<body><article>{main}</article><div class="SIDEBAR"><p>other</p></div><div id="mainNAV"><p>menu</p></div></body>') == body
    assert text(f'<article><p>on <span class="social">social</span> <em class="comment">life</em></p>{main}</article>') == f"on social life\n{body}"
    assert text(f'<article><div class="entry-header"><h1>Title</h1></div>{main}</article>') == f"Title\n{body}"
    assert text(f'<div class="post"><div class="post-header"><h1>Title</h1></div>{main}</div><div class="site-header"><p>Site</p></div>') == f"Title\n{body}"
    assert text(f"<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>{main}</article>") == f"so x=2 holds\n{body}"
    assert text("<article><div class=a><p>" + "one " * 100 + "</p></div><div class=b><p>" + "two " * 60 + "</p></div></article>").split() == ["one"] * 100 + ["two"] * 60


def test_votes_against_a_plain_count(spark):
    import random

    rnd, rows = random.Random(3), []
    for i in range(120):
        parts = [f'<div class="{c}{rnd.randint(0, 9)}"><p>{" ".join(rnd.choice(["a", "bb", "<a href=x>l</a>"]) for _ in range(rnd.randint(0, 30)))}</p></div>' for c in rnd.sample("pqrs", rnd.randint(1, 4))]
        rows.append((i, f"https://h{i % 5}.example/{i}", f"<html><body>{''.join(parts)}</body></html>"))
    votes = {}
    for _, url, page in rows:
        _, scores = H.blocks(page)
        best = max((x[0] for x in scores.values()), default=0)
        for p, (s,) in scores.items():
            if best > 0 and s > 0:
                host = votes.setdefault(url.split("/")[2], {})
                host[p] = host.get(p, 0) + s / best
    won = {h: max(v, key=lambda p: (round(v[p], 5), p)) for h, v in votes.items()}
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: text(page, won.get(url.split("/")[2])) for i, url, page in rows}
