import math
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from tidewater.llm import html
from tidewater.llm.html import extracted, main_text, smoothed

BODY = "A paragraph that is long enough to stand out among the menus and the links of a page. " * 3


def page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{before}{article}{after}</body></html>"


CASES = [
    (page("<article><h1>Head</h1><p>One&amp;two\n\t three<p>Be.</article>"), "Head\nOne&two three\nBe."),
    (page(f"<article><p>{BODY}</p></article>", "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now</div>", "<footer>&copy; x</footer>"), BODY.strip()),
    (page(f"<div id='content'><h2>T</h2><p>{BODY}</p><p>Short.</p></div>", "<header>Site</header><div class='cookie-notice'>We use cookies</div>", "<div id='comments'><p>Nice! " + BODY + "</p></div>"), "T\n" + BODY.strip() + "\nShort."),
    (page(f"<main><p>{BODY}</p><aside>Side</aside><form><input><label>Name</label></form><p>End <b>bold</b> <span hidden>x</span>text</p></main>"), BODY.strip() + "\nEnd bold text"),
    (page("<p><b>Unclosed<br><p>Next</p>"), "Unclosed\nNext"),
    (page("<article><p>a</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>"), "a\nx\ny\n1\n2"),
    (page("<nav><a>only menu</a></nav>"), ""),
    ("", ""),
    (None, ""),
    ("plain text &lt;b&gt;", "plain text <b>"),
    ("<article><p>" + "x" * 300_000 + "</p><p>tail <!-- note --> end</article>", "x" * 300_000 + "\ntail end"),
    (page(f"<ul><li><a href='/'>Home</a></li></ul><div class='t'><h1>Title</h1></div><div class='c'><div><p>{BODY}</p></div><div><p>Short.</p></div><div><p>{BODY}</p></div></div><div class='comments'><p>{BODY}</p></div>"), "Title\n" + BODY.strip() + "\nShort.\n" + BODY.strip()),
    (page(f"<div><p>{BODY}</p></div><article><h1>A</h1><p>{BODY}</p><p><a href='x'>A link</a></p></article>"), "A\n" + BODY.strip() + "\nA link"),
    ("<p>x</p> 1 < 2 <a href='", "x\n1 < 2"),
    ("<a " * 60_000, ""),
    ("<b>" * 30_000 + "<div>x</div>" * 30_000, "\n".join(["x"] * 30_000)),
    ("<article><header><h1>Own title</h1></header><p>Text</p><section class='comment-list'><p>Reader</p></section></article>", "Own title\nText"),
]


@pytest.mark.parametrize("html, want", CASES)
def test_main_text(html, want):
    assert main_text(html) == want


KEPT = [
    (page(f"<article><h2 id='related-work'>Related</h2><p>{BODY}</p><section id='side-effects'><p>Nausea.</p></section><div id='social-history'><p>None.</p></div><h2 id='search'>Search</h2></article>"), "Related\n" + BODY.strip() + "\nNausea.\nNone.\nSearch"),
    (page(f"<article><p>{BODY}</p><pre>x = 1 <span class='hljs-comment'># one</span> <i class='token comment'># two</i></pre></article>"), BODY.strip() + "\nx = 1 # one # two"),
    (page(f"<article><p>{BODY}</p><p>a</p><p>b</p><p>c</p></article><article><p>Brief.</p></article>"), BODY.strip() + "\na\nb\nc\nBrief."),
    (page(f"<div class='c'><div><p>{BODY}</p></div><div><p>a</p></div><div><p>b</p></div><div><p>c</p></div><div><p>The end.</p></div></div>"), BODY.strip() + "\na\nb\nc\nThe end."),
]
GONE = [
    (page(f"<article><p>{BODY}</p><div class='post-related-links'><p>More</p></div><div id='comments'><p>Reader</p></div></article>"), BODY.strip()),
    (page(f"<article><p>{BODY}</p><div class='related-reading'><p><a href='x'>One story</a></p><p><a href='y'>Other story</a></p></div></article>"), BODY.strip()),
    (page(f"<article><p>{BODY}</p></article><div class='related'><article><p>Teaser</p></article></div>"), BODY.strip()),
    (page(f"<div class='c'><p>{BODY}</p><p>a</p><p>b</p></div>", after="<div><p>All rights reserved</p></div>"), BODY.strip() + "\na\nb"),
]


@pytest.mark.parametrize("html, want", KEPT + GONE)
def test_article_text_and_boilerplate(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("n", [10, 201, 5000])
def test_unclosed_inline_elements_do_not_hide_a_paragraph(n):
    assert main_text(page("<p class='notice'>Note" + "<b>" * n + f"<p>{BODY}</p>")) == BODY.strip()


def plain_selected(ratios, sizes, whole):
    """The steps from ratios to selected lines, line by line."""
    kernel = [math.exp(-(k**2) / 2) for k in range(-2, 3)]
    at = lambda i: ratios[i] if 0 <= i < len(ratios) else 0
    smooth = [sum(w * at(i + k) for w, k in zip(kernel, range(-2, 3), strict=True)) / sum(kernel) if ratios[i] else 0 for i in range(len(ratios))]
    mean = sum(smooth) / len(smooth)
    threshold = min(max(smooth), math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    runs = []
    for i, x in enumerate(smooth):
        if x > 0 and x >= threshold:
            if runs and runs[-1][-1] == i - 1 and whole[i] == whole[i - 1]:
                runs[-1].append(i)
            else:
                runs.append([i])
    mass = [sum(sizes[i] * (html.WEIGHT if whole[i] else 1) for i in run) for run in runs]
    return {i for run, m in zip(runs, mass, strict=True) if m >= html.SHARE * max(mass) for i in run}


def test_selection_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 40)
        ratios = [rng.choice([0.0, rng.random() * 5, rng.random() * 200]) for _ in range(n)]
        ratios[rng.randrange(n)] = 7.3
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        whole = [rng.random() < 0.2 for _ in range(n)]
        smooth = smoothed(np.array(ratios))
        smooth[np.array(ratios) == 0] = 0
        got = html.selected(smooth, np.array(sizes), np.array(whole))
        assert set(np.flatnonzero(got).tolist()) == plain_selected(ratios, sizes, whole)


LONG = BODY.strip() * 3
#: Plain blocks: a menu of plain words, a line that stands alone, a text with a short paragraph in it.
PLAIN = page("<div><ul>" + "<li>Go</li>" * 6 + f"</ul><p>{LONG[:300]}</p><ul>" + "<li>Go</li>" * 6 + f"</ul></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>")


def test_smoothing_and_threshold_select(monkeypatch):
    want = "\n".join([LONG, "Short.", LONG])
    assert main_text(PLAIN) == want
    with monkeypatch.context() as m:
        m.setattr(html, "smoothed", lambda ratios: ratios.copy())
        assert main_text(PLAIN) != want
    with monkeypatch.context() as m:
        m.setattr(html, "clusters", lambda smooth, kind: (smooth > 0).astype(int))
        assert main_text(PLAIN) != want


MASS = [
    (page(f"<article><p>Teaser of another story.</p></article><div class='c'><p>{LONG}</p><p>{LONG}</p></div>"), f"{LONG}\n{LONG}"),
    (page(f"<div class='c'><div><p>Lead.</p><p>{BODY}</p></div><div><p>Brief.</p></div><div><p>{BODY}</p></div></div>", "<div><p>Site</p></div>"), "\n".join(["Lead.", BODY.strip(), "Brief.", BODY.strip()])),
    (page(f"<div class='c'><p>{BODY}</p><p><a href='x'>Source</a></p><p>{BODY}</p><p><a href='y'>One</a></p><p><a href='z'>Two</a></p></div>"), "\n".join([BODY.strip(), "Source", BODY.strip()])),
]


@pytest.mark.parametrize("html, want", MASS)
def test_mass_selects_regions(html, want):
    assert main_text(html) == want


def planted(html):
    """The article of a generated page, by its own tags."""
    inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", html, re.S)[1])
    blocks = re.split(r"</?(?:h1|p|div|ul|li)>", inner.replace("<br>", " "))
    return [w for b in blocks for w in unescape(b).split()]


@pytest.mark.parametrize("hidden", [False, True])
def test_planted_articles(spark, hidden):
    """With ``hidden`` every element that says what it is becomes a plain block, so that ratios alone select."""
    found = right = wanted = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        source = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", r.html.replace(' class="ad"', "")) if hidden else r.html
        got, want = main_text(source).split(), planted(r.html)
        found, wanted = found + len(got), wanted + len(want)
        right += sum((Counter(got) & Counter(want)).values())
    print(f"recall {right / wanted:.4f}, precision {right / found:.4f}")
    assert right / wanted > 0.99 and right / found > (0.97 if hidden else 0.999)


def test_smoothing_keeps_mass():
    assert np.isclose(smoothed(np.array([0, 0, 0, 8.0, 0, 0, 0])).sum(), 8)
    assert len(smoothed(np.array([1.0]))) == 1


def test_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", "a"), (1, "u", "<p>x</p>", "a"), (None, None, None, None), (2, "v", "", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extracted(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extracted(df.limit(0)).count() == 0
