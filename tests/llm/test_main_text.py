"""Main text of hand-written pages, to the letter."""

from __future__ import annotations

import numpy as np
import pytest

from factorloom.llm import html_extract


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


DROPPED = ["Share", "<a href='/x'>More</a>", "<span class='s'>x</span>", "<div class='ad'>x</div>", "<ul><li>x</li></ul>", "<nav>x</nav>", "<math><mi>x</mi></math>", "<form>x<input></form>", "<table><tr><td>x</td></tr></table>", "Share <b>now</b><br>", "<p class='n'>x", "<!-- c -->Share", "<section>x<p>y</p></section>", "<button>Go</button>", "<script>x</script>Share"]
FRAMES = ["{}", "<body>{}</body>", "<article>{}</article>", "<main><div><section>{}</section></div></main>"]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("inner", DROPPED)
def test_blocks_stay_apart_whatever_is_dropped_between_them(frame, inner):
    page = frame.format(f"<p id='k'>One.</p>{inner}<p id='k'>Two.</p>")
    nodes = html_extract.listed(html_extract.parse(page))
    keep = np.array([v.attrs.strip() == "id='k'" for v in nodes])
    for v in nodes:  # and what lies above the two
        if keep[v.index]:
            up = v.parent
            while up:
                keep[up.index] = True
                up = up.parent
    text = html_extract.joined(nodes, keep)
    own = [p for v in nodes if keep[v.index] and v.tag not in ("p", "html") for p in v.parts if type(p) is str and not p.isspace()]
    assert text == "One. Two." or own and text.startswith("One. ") and text.endswith(" Two.")  # text that the frame holds itself stays


def test_text_on_either_side_of_inline_elements_is_one_block():
    nodes = html_extract.listed(html_extract.parse("<p>a<b>b</b><a href='/'>c</a>d<math><mi>e</mi></math>f</p>"))
    assert html_extract.joined(nodes, np.ones(len(nodes), bool)) == "abcdef"


NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News.</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 Example Site</footer>"
FIRST, LAST = "The first paragraph of this article has some words, and more.", "The last paragraph of it ends here, with a few words."
PAGES = {
    "linked paragraph": (f"{NAV}<article><h1>Title</h1><p>{FIRST}</p><p><a href='https://x.org/r'>The whole report is available here</a></p><p>{LAST}</p></article>{FOOT}", f"Title {FIRST} The whole report is available here {LAST}"),
    "sources": (f"<header><a href='/'>Site</a></header><article><h1>Title</h1><p>{FIRST}</p><h2>Sources</h2><ul><li><a href='https://x.org'>Annual report of the office</a></li><li><a href='https://y.org'>Minutes of the council</a></li></ul></article>{FOOT}", f"Title {FIRST} Sources Annual report of the office Minutes of the council"),
    "definitions": (f"{NAV}<article><h1>Terms</h1><p>{FIRST}</p><dl><dt>Alpha</dt><dd>The first of the letters, and so on.</dd><dt>Beta</dt><dd>The second one.</dd></dl></article><aside class='sidebar'><h3>Related</h3><ul><li><a href='/x'>x</a></li></ul></aside>", f"Terms {FIRST} Alpha The first of the letters, and so on. Beta The second one."),
    "folds": (f"<main><h1>Guide</h1><p>{FIRST}</p><details><summary>What does it cost?</summary><p>It costs nothing at all, as we said.</p></details><p>{LAST}</p></main><div class='cookie'>We use cookies. <button>OK</button></div>", f"Guide {FIRST} What does it cost? It costs nothing at all, as we said. {LAST}"),
    "formula in the body": (f"<p>{FIRST}</p><math><mi>a</mi><mo>=</mo><mi>b</mi></math><p>{LAST}</p>", f"{FIRST} a=b {LAST}"),
    "formula in the article": (f"{NAV}<article><p>{FIRST}</p><p>Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> hold, as before.</p><p>{LAST}</p></article>", f"{FIRST} Let a=b hold, as before. {LAST}"),
    "captions": (f"<header class='site-header'><h2>My site</h2></header><div class='content'><h1>Birds</h1><p>{FIRST}</p><figure><img src='a.png'><figcaption>A bird on a branch.</figcaption></figure><pre>tweet tweet</pre></div>{FOOT}", f"Birds {FIRST} A bird on a branch. tweet tweet"),
    "boilerplate inside": (f"{NAV}<article><p>{FIRST}</p><div class='share'><ul><li><a href='/f'>Post</a></li><li><a href='/t'>Mail</a></li></ul></div><p>{LAST}</p></article><div class='comments'><h3>Comments</h3><div class='comment'><b>Jo</b><p>I liked this text very much, thanks.</p></div></div>", f"{FIRST} {LAST}"),
    "entities and blanks": (f"{NAV}<article><p>Fish &amp;\n  chips &#8211; &lt;cheap&gt;,\tsold by the harbour.</p><p>{LAST}</p></article>{FOOT}", f"Fish & chips – <cheap>, sold by the harbour. {LAST}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_written_pages(model, name):
    html, want = PAGES[name]
    assert html_extract.main_text(model, [f"<!DOCTYPE html><html><head><title>T</title></head><body>{html}</body></html>"]) == [want]


def test_held_out_pages_of_the_writer(model):
    """Labels of nodes on pages that the trees have not seen."""
    writer, right, total = html_extract.Writer(4321), 0, 0
    for _ in range(120):
        nodes, good = html_extract.labelled(writer.page())
        keep = html_extract.decode(nodes, model.log_odds(html_extract.features(nodes)))
        right, total = right + int((keep[1:] == good[1:]).sum()), total + len(nodes) - 1
    assert right >= 0.96 * total


def test_texts_longer_than_a_slice(spark, model):
    body = "".join(f"<p>Paragraph {k} of a very long article, with words in it.</p>" for k in range(60_000))
    table = spark.createDataFrame([(1, "u", f"<html><body>{NAV}<article>{body}</article>{FOOT}</body></html>"), (2, "v", f"<article><p>{FIRST}</p><p>{LAST}</p></article>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(table, model).collect()}
    assert got[2] == f"{FIRST} {LAST}" and got[1].count("of a very long article") == 60_000 and "Home" not in got[1]
