from __future__ import annotations

import pytest

from signals.llm.html_extract import (
    NO_TEMPLATE, ROOT, Seen, extract_main_text, host_templates, main_text, page_tokens, parse, valid_tokens,
)

SCHEMA = "page_id bigint, url string, html string, text string, tokens int, host string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


PAGES = [
    ("<body><nav>Menu</nav><article><h1>T&eacute;</h1><p>One  two<br>three<p>Four</article><footer>F</footer>", "Té\n\nOne two three\n\nFour"),
    ("<article><p>a &lt;b&gt; &amp;amp; &#x41;&nbsp;z &unknown; &am</p></article>", "a <b> &amp; A z &unknown; &am"),
    ("<main><div class='ad-box'>buy</div><p>x<b>y</b> z</p><form><input>q</form><section id=comments><p>no</section></main>", "xy z"),
    ("<article>a<script>var t='</p><p>';</script>b<style>p{}</style><!-- <p>c</p> -->d</article>", "abd"),
    ("<article><header><h1>Title</h1></header>text<aside>side</aside></article><article class=comment>no</article>", "Title\n\ntext"),
    ("<div class='site-header'>top</div><div><p>plain body 1 < 2</p></div><div class=sidebar>s</div>", "plain body 1 < 2"),
    ("<title>only</title>", ""), ("", ""), ("no markup at\n all", "no markup at all"),
    ("<article><p>cut off in a <b>tag", "cut off in a tag"), ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert main_text(page, NO_TEMPLATE) == text


def test_template_texts_and_menus_of_plain_pages_go(spark):
    page = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>Welcome to our site</div><div><p>{}</p><p>{}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"http://Host.example/{i}", page.format(f"story {i} begins", f"and {i} ends")) for i in range(6)]
    rows += [(100, "http://other.example/1", page.format("alone", "here"))]
    got = {r.page_id: r.text for r in extract_main_text(table(spark, rows)).collect()}
    assert all(got[i] == f"story {i} begins\n\nand {i} ends" for i in range(6))
    assert got[100] == "Welcome to our site\n\nalone\n\nhere\n\nAll rights kept"


def test_classes_share_vectors(spark):
    rows = [(i, "http://h/", f"<article><h1>{i}</h1>{'<p>x</p>' * (i + 1)}</article><footer>f</footer>") for i in range(3)]
    df = table(spark, rows).selectExpr("url AS _url", "html AS _body", "'h' AS _host")
    (row,) = host_templates(df, "_host", "_body", 0.5).collect()
    tokens = page_tokens(list(parse(rows[1][2])))
    sizes = sorted(len(c) for c in row.tokens)
    assert sizes == [2, 4]  # p with its text; article, h1, footer and the footer's text
    assert valid_tokens(tokens, [list(c) for c in row.tokens]) == {t for c in row.tokens for t in c}
    assert ROOT not in {t for c in row.tokens for t in c}


def test_invalid_classes_are_left():
    places = {t: Seen(1, at, 0) for t, at in {1: 1, 2: 9, 3: 4, 4: 12, 5: 2, 6: 3}.items()}
    assert valid_tokens(places, [[1, 2], [3, 4], [5, 6], [6, 5], [1, 99]]) == {1, 2, 5, 6}


def texts_of(spark, pages, host="http://h.example/"):
    rows = [(i, f"{host}{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in sorted(extract_main_text(table(spark, rows)).collect(), key=lambda r: r.page_id)]


def story(i):
    return f"<p>story {i} begins with words of its own, {i * 7} of them</p><p>and ends {i * 13} lines later</p>"


def test_template_texts_inside_an_article_go(spark):
    """Without the classes the line that every article of the host shows would stay."""
    page = "<nav>x</nav><article><h1>Title {}</h1>{}<div><p>Sent by our readers</p><p>Print this page</p></div></article><footer>f</footer>"
    pages = [page.format(i, story(i)) for i in range(5)]
    got = texts_of(spark, pages)
    assert got == [f"Title {i}\n\nstory {i} begins with words of its own, {i * 7} of them\n\nand ends {i * 13} lines later" for i in range(5)]
    assert all("Print this page" in main_text(p, NO_TEMPLATE) for p in pages)


def test_template_outweighs_a_wrong_main_element(spark):
    """Without the classes the teaser's article element would be taken."""
    page = "<body><article class=teaser><p>Also {}</p></article><div class=story><h1>Title {}</h1>{}</div></body>"
    pages = [page.format(i, i, story(i) * 3) for i in range(5)]
    got = texts_of(spark, pages)
    assert all(t.startswith(f"Title {i}\n\nstory {i}") and "Also" not in t for i, t in enumerate(got))
    assert [main_text(p, NO_TEMPLATE) for p in pages] == [f"Also {i}" for i in range(5)]


def test_copies_of_one_article_keep_it(spark):
    page = "<article><h1>One title</h1>" + story(1) * 4 + "<p>seen {}</p></article>"
    got = texts_of(spark, [page.format(i) for i in range(4)])
    assert all(t.startswith("One title\n\nstory 1") and t.endswith(f"seen {i}") for i, t in enumerate(got))


def test_honest_parts_of_an_article_stay(spark):
    page = """<article><h2 id="share-of-market">Share of market</h2><section id="related-work"><p>related {0}</p></section>
        <p class="notice-of-rights">rights {0}</p><math><mi>x</mi></math><label>label {0}</label><p class="notice">once {0}</p></article>"""
    page = f"<html><body>{page}</body></html>"
    want = "Share of market\n\nrelated {0}\n\nrights {0}\n\nxlabel {0}\n\nonce {0}"
    others = [f"<html><body><article><h1>t{i}</h1>{story(i)}</article></body></html>" for i in range(4)]
    got = texts_of(spark, [page.format(0), *others])
    assert " ".join(got[0].split()) == " ".join(want.format(0).split())
    # On every page of the host the notice is furniture, as is an advert on any.
    many = texts_of(spark, [page.format(i).replace("<math>", "<div class='ad box'>buy</div><math>") for i in range(4)], "http://n.example/")
    assert all(f"rights {i}" in t and f"label {i}" in t and "once" not in t and "buy" not in t for i, t in enumerate(many))


def test_repeated_rows_change_no_template(spark):
    page = "<body><div><a href=1>Home</a></div><div>Welcome to our site</div><div><p>{}</p><p>{}</p></div><div>All rights kept</div></body>"
    rows = [(i, f"http://h/{i}", page.format(f"story {i}", f"ends {i}")) for i in range(4)]
    got = extract_main_text(table(spark, rows + rows)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, f"story {i}\n\nends {i}") for i in range(4) for _ in range(2))


def test_layouts_of_a_host_are_told_apart(spark):
    """Three layouts of a third each: the frame of each is on all pages of its own layout."""
    page = "<body><div class=layout{0}><div>Frame of layout {0}</div><div><p>{1}</p><p>more {1}</p></div><div>Foot of layout {0}</div></div></body>"
    got = texts_of(spark, [page.format("abc"[i % 3], f"text {i}") for i in range(12)])
    assert got == [f"text {i}\n\nmore text {i}" for i in range(12)]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no address", ""), (3, "http://h/", "<p>" * 3_000 + "deep"), (4, "http://h/", "<article>" + "word " * 50_000),
            (5, "http://h/", "<p>same"), (5, "http://h/", "<p>same"), (None, "http://h/x", "<article>n")]
    got = [(r.page_id, r.text) for r in extract_main_text(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, ""), (2, ""), (3, "deep"), (4, ("word " * 50_000).strip()), (5, "same"), (5, "same"), (None, "n")], key=str
    )
    assert extract_main_text(table(spark, [])).count() == 0
