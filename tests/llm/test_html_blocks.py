"""The block labeller beside a plain reading of the pages' own tags, on pages of other layouts, and on odd html."""

import html
import re

import numpy as np
import pytest

from rippleset.llm import html_blocks
from rippleset.llm.html_blocks import blocks

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, page string, keys int, features int"


@pytest.fixture(scope="module")
def model(spark):
    return html_blocks.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_registered(spark):
    """The given pages name their article: what stands in it, without tags."""
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_blocks.op11_html_blocks(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        pieces = [html.unescape(p) for p in re.split(r"<[^>]*>", re.sub(r"</?(?:h1|p|br)>", " \n ", inner))]
        text = " ".join("".join(pieces).split())
        assert got[r["page_id"]] == (r["url"], text, len(text))


def test_other_layouts(spark, model):
    """Held-out made pages: nearly all blocks are right, and the surroundings of a known page are gone."""
    paragraphs = [text for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for path, text, _ in blocks(r["html"]) if "article" in path]
    rng = np.random.default_rng(99)
    pages = [html_blocks.made_page(rng, paragraphs) for _ in range(200)]
    chosen = model.article([of for of, _ in pages], html_blocks.Features())
    assert np.mean(np.concatenate([c == np.array(labels, bool) for c, (_, labels) in zip(chosen, pages, strict=True)])) > 0.96
    body = "<p>The ship came late into the harbour. Nobody had waited.</p><p>So the captain went ashore alone, and found the town asleep.</p>"
    page = f"""<html><body><div class="site"><div class="navbar"><a href="/">Home</a> <a href="/x">More</a></div><div id="cookie-notice">We use cookies on this site.</div>
      <div class="post-content"><h1>Late arrival</h1>{body}<form class="newsletter"><label>Your mail</label><button>Send</button></form></div>
      <div class="sidebar"><ul><li><a href="/a">Other news</a></li></ul></div><section class="comments"><p>What a fine story, thank you for it.</p><p>I did not like it much.</p></section>
      <div class="footer">Copyright of the paper</div></div></body></html>"""
    kept = [text for (_, text, _), good in zip(blocks(page), model.article([blocks(page)], html_blocks.Features())[0], strict=True) if good]
    assert kept == ["Late arrival", "The ship came late into the harbour. Nobody had waited.", "So the captain went ashore alone, and found the town asleep."]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []), ("", []), (" <p> </p>", []),
        ("a<b>b</b>c <i>d</i><br>e", ["abc d", "e"]),
        ("<p>one<p>two<div>three", ["one", "two", "three"]),
        ("x &amp;amp; &lt;p&gt; &eacute;&#233;&#xe9;&nbsp;y &am &copy z", ["x &amp; <p> \u00e9\u00e9\u00e9 y &am \u00a9 z"]),
        ("<script>if (a < b) { x = '</p>' }</script>ok<style>p{}</style><!-- <p>no</p> -->!", ["ok!"]),
        ("one<!-- never <p>closed", ["one"]), ("1 <b", ["1 <b"]), ("<!-->x", ["x"]),
        ("<script>never closed <p>x", []),
        ("<a title='1 > 0' href=\"x>y\">link</a> 1 < 2 <3", ["link 1 < 2 <3"]),
        ("</p></div>stray<ul><li>1<li>2</ul>", ["stray", "1", "2"]),
        ("<p title=\"open>text</p>", ["text"]),
    ],
)
def test_blocks(page, expected):
    assert [text for _, text, _ in blocks(page)] == expected


def test_paths():
    found = blocks("<div class='post-body mainText' id=x1><nav><a href=y>go</a></nav><table><tr><td>1<td>2</table></div>z")
    assert found == [(("div", "post", "body", "main", "text", "x", "1", "nav"), "go", 1.0), (("div", "post", "body", "main", "text", "x", "1", "table", "tr", "td"), "1", 0.0),
                     (("div", "post", "body", "main", "text", "x", "1", "table", "tr", "td"), "2", 0.0), ((), "z", 0.0)]


def test_long_pages_in_pieces(model, monkeypatch):
    """Long sequences give what short ones of the same blocks give; deep and long pages end soon."""
    page = blocks("<article>" + "<p>Some words of a text.</p>" * 3000 + "</article><footer>end</footer>")
    alone = model.article([page], html_blocks.Features())[0]
    monkeypatch.setattr(html_blocks, "PADDED", 1)
    assert (model.article([page, page[:5]], html_blocks.Features())[0] == alone).all() and alone[:-1].all() and not alone[-1]
    assert len(blocks("<div>" * 20_000 + "x" + "</p></div>" * 20_000)) == 1
    assert blocks("<!" * 100_000) and blocks("<a " * 100_000 + ">x")
    assert len(blocks("<p title=\"" * 3000)) <= 1


def test_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Some words of a text.</p></article>"), (3, "v", "<nav><a href=x>menu</a></nav>"), (3, "v", "<nav><a href=x>menu</a></nav>")]
    df = spark.createDataFrame([(*r, "a", 1, 1) for r in rows], SCHEMA)
    out = html_blocks.main_text(df, model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [(1, "u", "", 0), (2, None, "", 0), (None, "u", "Some words of a text.", 21), (3, "v", "", 0), (3, "v", "", 0)]))
    assert html_blocks.main_text(df.limit(0), html_blocks.fit(df.limit(0))).collect() == []
