import random
import time
from html import escape

import pytest

from tallylog.llm.op7_html import extract, high_lines, main_text, named_for, op7_html, smoothed

LONG = "This is a paragraph of the article that is long enough to be told from the rest of the page by its ratio."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain words &amp; more", "plain words & more"),
        ("<article><h1>T</h1><p>a  b\n c<br>d<p>e &lt;x&gt; &#233;</article>", "T\n\na b c d\n\ne <x> é"),
        ("<nav><a href=x>Menu</a></nav><article><p>Text</p><aside>side</aside><form><p>f</p></form></article><footer>F</footer>", "Text"),
        ("<body><header>H</header><main><p>One<p>Two<ul><li>x<li>y</ul></main><div id=comments><article>no</article></div></body>", "One\n\nTwo\n\nx\n\ny"),
        ("<script>if(a<b){'<p>no</p>'}</script><style>p{}</style><article>yes<!-- no --></article>", "yes"),
        ("<article><div class='ad'>buy</div><p>keep</p><div class='cookie-notice'>n</div></article>", "keep"),
        ("<article><p>open <b>never closed<p>next</article><p>after", "open never closed\n\nnext"),
        ("<div class='post-content'><p>Short.</p></div><div class='sidebar'>s</div>", "Short."),
        ("<article><table><tr><td>a<td>b</table></article>", "a\n\nb"),
        ("<html><head><title>t</title><meta x></head><body><article>b</article></body></html>", "b"),
        ("<article>" + "<p>x" * 3000 + "</article>", "\n\n".join(["x"] * 3000)),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_without_a_marked_article():
    page = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=4>Four</a></ul></body>"
    got = main_text(page).split("\n\n")
    assert got.count(LONG) == 2 and "Short." in got and "One" not in got and "Four" not in got


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0) and len(smoothed(np.array([]))) == 0


def test_on_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a</article>"), (None, None, None), (1, "u", "<article>a</article>"), (2, "v", "<p>" + "word " * 100_000)], "page_id long, url string, html string")
    got = extract(pages).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 1, 1, 499_999] and extract(pages.limit(0)).count() == 0


def test_text_of_math_and_fallback_content_stays():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p><video src=v><source src=w>A film.</video> <svg><title>t</title><text>Axis</text></svg></p></article>"
    assert main_text(page) == "Let x=2 be.\n\nA film. Axis"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="content-notice-board"><p>The board.</p></div>', "The board."),
        ('<article><p>One.</p><div class="related-work"><p>Two.</p></div></article>', "One.\n\nTwo."),
        ('<article><section id="comments-on-policy"><p>One.</p></section><p class="side">Two.</p></article>', "One.\n\nTwo."),
        ('<div class="page sidebar-left"><h1>T</h1><p>One.</p><div class="sidebar-left">no</div></div>', "T\n\nOne."),
        ('<section class="comments"><h1>T</h1><article>no</article></section><p>One.</p>', "One."),
        ('<article><header><h1>T</h1></header><p>One.</p><footer>no</footer></article>', "T\n\nOne."),
        ('<article>a<![if x]>b<![endif]>c<!x>d<a href="never ended', "abcd"),
        ('<p>5 < 6 & 7 &lt 8', "5 < 6 & 7 < 8"),
    ],
)
def test_names_and_broken_markup(html, text):
    assert main_text(html) == text


def test_names():
    assert [named_for(x) for x in ("ad", "post cookie-notice", "Ad_Box2", "content-notice-board", "has-sidebar", "", "comment-list", "related comments", "download")] == ["other", "other", "other", "", "", "", "comments", "comments", ""]


def test_ratios_choose_the_container():
    """Neither container has a telling name; the long lines decide, and take their short neighbours along."""
    page = f"<body><div><div>Short line.</div></div><div><div><h2>Head</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div></div><div>Another line.</div></body>"
    assert main_text(page).split("\n\n") == ["Head", LONG, "Brief.", LONG]
    # An article that only teases loses against the text.
    page = f"<body><article><p>Teaser.</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text(page).split("\n\n") == [LONG, LONG]
    # A title beside the container belongs to it; several containers are taken with what lies between.
    page = f"<body><h1>T</h1><div><p>{LONG}</p></div><div><p>Brief.</p></div><div><p>{LONG}</p></div><div>Tail.</div></body>"
    assert main_text(page).split("\n\n") == ["T", LONG, "Brief.", LONG]


def test_high_lines_are_those_of_the_best_cut():
    import numpy as np

    x = np.array([1.0, 2.0, 1.0, 80.0, 120.0, 90.0, 2.0, 1.0])
    logs = np.log1p(smoothed(x))
    spread = {c: sum(g.var() * len(g) for g in (logs[logs < c], logs[logs >= c])) for c in sorted(logs)[1:]}
    assert list(high_lines(x)) == list(logs >= min(spread, key=spread.get)) and high_lines(np.ones(4)).all()


@pytest.mark.parametrize("seed", range(20))
def test_round_trip_of_built_pages(seed):
    """Article blocks written as a page with all that is to go around and between them come back as they were."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh&<é") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    blocks = [words(3, 8)] + [words(1, 90) for _ in range(r.randint(1, 12))]
    noise = ['<aside>a</aside>', '<div class="ad">buy</div>', '<form><p>mail</p></form>', "<script>if (a < b) {}</script>", '<div role="alert">n</div>', "<!-- no -->", '<ul class="share-buttons"><li>x</ul>']
    inner = "".join(r.choice([f"<p>{escape(b)}</p>", f"<p>{escape(b)}", f"<blockquote>{escape(b)}</blockquote>", f"<div>{escape(b, quote=False)}</div>", f"<ul><li>{escape(b)}</ul>"]) + r.choice(["", *noise]) for b in blocks[1:])
    tag = r.choice(["article", "main", "div class='post'"])
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><{tag}><h1>{escape(blocks[0])}</h1>{inner}</{tag.split()[0]}><section class='comments'><p>{words(50, 60)}</p></section><footer>f</footer></body></html>"
    assert main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("html", ["<b>" * 150_000 + "</i>" * 150_000, '<a href="x' * 100_000, "<p>x" * 200_000, "<![x" * 200_000, "<li>" * 200_000, "<table><tr>" + "<td>" * 200_000, "<div>" * 150_000, "<a " + "x= " * 300_000])
def test_a_megabyte_of_broken_markup(html):
    start = time.process_time()
    main_text(html)
    assert time.process_time() - start < 40


def test_article_element_decides_no_page(spark, sf_dir):
    """Without the element's name the same region is chosen on the test tables: ratios and containers find it."""
    rows = op7_html(spark, sf_dir).collect()
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert r["text"] == main_text(html[r["page_id"]].replace("<article", "<div").replace("</article", "</div")) and r["n_chars"] == len(r["text"])


def test_extra_columns(spark):
    pages = spark.createDataFrame([("<p>a</p>", "old", 1)], "html string, text string, lines int")
    assert [tuple(r) for r in extract(pages).collect()] == [("<p>a</p>", "a", 1)]
