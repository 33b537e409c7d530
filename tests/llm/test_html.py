"""Main text of pages."""

import random
import re
from pathlib import Path

import pytest

from estatemap.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head&nbsp;line</h1><p>One <b>two</b>
three.<br>four<p>Five &lt;six&gt; &eacute;</p><ul><li>a<li>b</ul><aside>Side</aside><form><label>Name</label><input></form>
<div class="comments"><p>Nice post</p></div>{more}</article><footer>&copy; us</footer></body></html>"""
EXPECTED = "Head line\nOne two three. four\nFive <six> é\na\nb"


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<p>unclosed <b>bold", "unclosed bold"),
    (PAGE.format(more=""), EXPECTED), (PAGE.format(more="")[:-30], EXPECTED), ("<div>x<div>y</div>z</div>", "x\ny\nz"),
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</table>", "1 2\n3"), ("<p>&#x41;&#66; &amp;amp;</p>", "AB &amp;"),
    ("<script>if (a < b) {}</script><p>t</p>", "t"), ("<p>5 < 6 & 7 > 2</p>", "5 < 6 & 7 > 2"), ("</p></div><p>a</p></article>", "a"),
    ("<textarea>no</textarea><select><option>no</select><p>yes</p>", "yes"), ("<div class='cookie-notice'>We</div><p>a</p>", "a"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<p hidden>no</p><p>a</p>", "a"), ("<![CDATA[x]]><p>a</p><!-- open", "a"),
    ("<p>" + "long " * 50_000 + "</p>", ("long " * 50_000).strip()), ("<nav><p>only menu</p></nav>", ""),
    ("<p>cut</p><a href='x", "cut"), ("<p>a <", "a <"),
])
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def site(spark):
    """Two hosts: one with a promotion without a telling name on each page, one where all pages are alike."""
    dealt = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows, expected = [], {}
    for i in range(12):
        own = [" ".join(dealt.choice(words) for _ in range(12)) for _ in range(3)]
        body = "".join(f"<p>{block}</p>" for block in own)
        rows.append((i, f"http://a.example.com/{i}", f"<body><div class='x1'><p>Best offers of the week</p></div><div class='x2'>{body}</div></body>"))
        expected[i] = "\n".join(own)
    for i in range(12, 18):
        rows.append((i, f"http://B.example.com:80/{i}", "<body><div><p>Always the same</p></div></body>"))
        expected[i] = "Always the same"
    rows += [(20, None, "<p>lost</p>"), (21, "http://c.example.com/", None), (None, "http://c.example.com/", ""), (20, None, "<p>lost</p>")]
    expected |= {20: "lost", 21: "", None: ""}
    return spark.createDataFrame([(*row, "h", 3) for row in rows], "page_id long, url string, html string, host string, node int"), expected


def test_site_tree(spark):
    frame, expected = site(spark)
    found = htmltext.extract(frame).collect()
    assert len(found) == frame.count()
    for row in found:
        assert row.text == expected[row.page_id] and row.n_chars == len(row.text)


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    frame, expected = site(spark)
    monkeypatch.setattr(htmltext, "BROADCAST_NODES", 0)
    assert all(row.text == expected[row.page_id] for row in htmltext.extract(frame).collect())


def test_no_pages(spark):
    frame, _ = site(spark)
    assert htmltext.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize("html,text", [
    ("<p>x</p><![foo[bar]]><p>y</p>", "x\ny"), ("<p>a</p>if (a<![0]) b><p>c</p>", "a\nif (a\nc"), ("<p>a</p><![if !IE]><p>b</p><![endif]><p>c</p>", "a\nb\nc"),
    ("<p>a &#" + "9" * 5000 + "; b</p><p>c</p>", "a � b\nc"), ("<p>a &#" + "0" * 5000 + "65; b</p>", "a A b"),
])
def test_text_around_what_the_parser_cannot_read(html, text):
    assert htmltext.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<div class='content with-sidebar'><p>a</p></div><div class='sidebar'>no</div>", "a"), ("<div class='no-sidebar'><p>a</p></div>", "a"),
    ("<div id='page' class='has-footer'><article><p>a</p></article></div>", "a"), ("<div class='site-footer'>no</div><p>a</p>", "a"),
    ("<article><section id='related-work'><h2 id='search'>h</h2><p>a</p></section><div class='comments'>no</div></article>", "h\na"),
    ("<article class='post category-social tag-search'><p>a</p></article>", "a"), ("<div class='sidebar'><main><p>a</p></main></div><p>out</p>", "a"),
    ("<div class='widget'><p>" + "long " * 99 + "end</p></div><p>a</p>", "long " * 99 + "end\na"),
    ("<div class='comments'><article>no</article></div><article><p>a</p></article>", "a"), ("<p>a <span class='ad'>no</span> b</p>", "a b"),
])
def test_named_wrappers(html, text):
    assert htmltext.main_text(html) == text


def test_repeated_headings_and_copied_pages(spark):
    dealt = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    text = lambda: " ".join(dealt.choice(words) for _ in range(15))
    rows, expected = [], {}
    for i in range(8):
        a, b = text(), text()
        rows.append((i, f"http://cook.example/{i}", f"<body><article><h2>Ingredients</h2><p>{a}</p><h2>Method</h2><p>{b}</p></article></body>"))
        expected[i] = f"Ingredients\n{a}\nMethod\n{b}"
    quote, part = text(), text()
    for i in range(10, 18):
        a = text()
        copied = i < 14
        body = f"<blockquote>{quote}</blockquote><p>{part}</p>" if copied else f"<p>{a}</p>"
        rows.append((i, f"http://copy.example/{i}", f"<head><title>{i}</title></head><body><div>{body}</div></body>"))
        expected[i] = f"{quote}\n{part}" if copied else a
    rows += [rows[8], rows[9]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {row.page_id: row.text for row in htmltext.extract(frame).collect()} == expected


FORM = "<body><form id='aspnetForm'><div class='menu'>m</div><{tag}><h1>h</h1><p>" + "word " * 60 + "</p></{tag}></form></body>"


@pytest.mark.parametrize("html,text", [
    (FORM.format(tag="article"), "h\n" + ("word " * 60).strip()), (FORM.format(tag="div"), "h\n" + ("word " * 60).strip()),
    ("<div class='post'><p>" + "word " * 120 + "</p></div><article><h3>t</h3><p>teaser</p></article>", ("word " * 120).strip() + "\nt\nteaser"),
    ("<article><h1>short</h1></article><div>" + "word " * 120 + "</div>", "short"), ("<p style='Display : none'>no</p><p>a</p>", "a"),
    ("<nav>" + "<a href='/x'>" + "menu " * 80 + "</a>" + "</nav><p>a</p>", "a"), ("<header><p>" + "word " * 80 + "</p></header><p>a</p>", ("word " * 80).strip() + "\na"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>a</p>", "deep\na"), ("<div class='ad'>" * 300 + "deep" + "</div>" * 300 + "<p>a</p>", "a"),
])
def test_wrappers_teasers_and_depth(spark, html, text):
    assert htmltext.main_text(html) == text
    assert all(len(node["above"]) <= htmltext.DEEPEST + 1 for node in htmltext.page_record(html)["nodes"])


PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def given(spark):
    """(id, url, html, blocks of the article) of the given pages."""
    if not Path(PAGES).exists():
        pytest.skip("the driver's tables are not here")
    rows = [(row.page_id, row.url, row.html) for row in spark.read.parquet(PAGES).collect()]
    return [(*row, [block for article in re.findall("<article.*?</article>", row[2], re.S) for block in htmltext.main_text(article).split("\n")]) for row in rows]


def extracted(spark, given, change):
    frame = spark.createDataFrame([(key, url, change(html)) for key, url, html, _ in given], "page_id long, url string, html string")
    return {row.page_id: row.text.split("\n") for row in htmltext.extract(frame).collect()}


def test_given_pages(spark, given):
    assert extracted(spark, given, lambda html: html) == {key: blocks for key, _, _, blocks in given}
    assert extracted(spark, given, lambda html: re.sub("(</?)article", r"\1div", html)) == {key: blocks for key, _, _, blocks in given}


def test_tree_alone(spark, given):
    """Without any telling name the tree finds menus, adverts and footers: 0.95 of the blocks are right, 0.99 of the article's are there."""
    found = extracted(spark, given, lambda html: re.sub("(</?)(?:article|nav|footer|header|aside|form)", r"\1div", html).replace(" class=\"ad\"", ""))
    right = sum(len(set(found[key]) & set(blocks)) for key, _, _, blocks in given)
    assert right >= 0.99 * sum(len(set(blocks)) for *_, blocks in given)
    assert right >= 0.95 * sum(len(set(blocks)) for blocks in found.values())


def test_records_are_stored_small(spark):
    """What is kept of the pages between two steps counts as disk, so it is not left at the default codec."""
    rows = [(i, f"http://h{i % 3}.org/{i}", f"<body><article><p>{'word and more words, ' * 40}{i}</p></article></body>") for i in range(60)]
    records = htmltext.parsed(spark.createDataFrame(rows, "id long, url string, html string"))
    assert records.count() == 60
    assert all(name.endswith(".zstd.parquet") for name in records.inputFiles())
