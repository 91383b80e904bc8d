"""Selectors on pages with nested, unclosed and unquoted markup, and items by them."""

import duckdb
import pytest

from gavelspark.queries import ORACLES, QUERIES
from gavelspark.sources.html_items import selected_cards
from gavelspark.sources.selectors import Tree

PAGE = """<div class="list card-list"><div class=card id=one data-k=x><h3>First <b>house</b> of all</h3><a href=/lote/1>see<img src='/a.jpg'></a>
<div class="card inner"><h3>Nested one here</h3><span class="price">R$ 1.234,50</span></div></div>
<p>one<p>two<br>three<script>var t = "</p><div class='card'>";</script>
<div class="other"><ul><li>a<li class="b c">b &amp; c</ul></span></div>"""


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        (".card", ["Firsthouseof allseeNested one hereR$ 1.234,50", "Nested one hereR$ 1.234,50"]), ("div.card > h3", ["Firsthouseof all", "Nested one here"]), ("#one .card h3", ["Nested one here"]), ("p", ["one", "twothree"]),
        ("li.b.c, span", ["R$ 1.234,50", "b & c"]), ('[data-k="x"] > a', ["see"]), ("[class*=other] li", ["a", "b & c"]), ('img[src$=".jpg"][src^="/"]', [""]), ("b > h3", []), ("*[data-k]", ["Firsthouseof allseeNested one hereR$ 1.234,50"]), ('div[class*="nothing"]', []),
    ],
)
def test_selectors(selector, texts):
    tree = Tree(PAGE)
    assert [tree.text(i) for i in tree.select(selector)] == texts


@pytest.mark.parametrize("wrong", ["", "a,", "> ", "a:b"])
def test_what_is_no_selector(wrong):
    with pytest.raises((ValueError, IndexError)):
        Tree(PAGE).select(wrong)


def test_selected_cards(spark):
    links = "".join(f'<a href="/imovel/{i}">House number {i}</a>' for i in range(30)) + '<a href="/about">About us and more</a><a href="/lote/9">short</a>'
    many = "".join(f'<article><h2>Lot of number {i}</h2><img src="i{i}.png"></article>' for i in range(60))
    rows = [(1, "http://s.com/x/", PAGE), (2, "http://s.com/x/", links), (3, "http://s.com/x/", many), (4, "http://s.com/", None), (5, "http://s.com/", "<p>nothing"), (6, "http://s.com/q", '<section class=unit><div class=titulo>Ten letters or more</div><i class="lance">900,5</i><i class=cidade>Rio</i></section>')]
    got = selected_cards(spark.createDataFrame(rows, "id int, url string, html string"), {"card": "section.unit"}, ["id"]).orderBy("id", "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert [(r.title, r.source_url, r.price, r.image_url) for r in by[1]] == [("Firsthouseof all", "http://s.com/lote/1", 1234.5, "http://s.com/a.jpg")] * 2 + [("Nested one here", "http://s.com/x/", 1234.5, "")]
    assert [r.title for r in by[2]] == [f"House number {i}" for i in range(20)] and by[2][3].source_url == "http://s.com/imovel/3" and by[2][3].price is None
    assert len(by[3]) == 50 and by[3][49].image_url == "http://s.com/x/i49.png" and by[3][0].source_url == "http://s.com/x/"
    assert [(r.title, r.price, r.location) for r in by[6]] == [("Ten letters or more", 900.5, "Rio")]
    assert set(by) == {1, 2, 3, 6}


def test_character_references_of_titles_as_sql_reads_them(spark, tmp_path):
    titles = ["a token = &quot;0123456789", "The first &amp;&amp; the second", "Words that are cut here &amp", "&lt;b&gt; is &amp;lt;b&amp;gt;", "Marks &#39; &#x27; &eacute; &copy", "AT&T and a b&c", "&ltno end and &gt no"]
    rows = [(i, f"http://s.com/{i}", f"<html><body><article><h1>{t}</h1><p>x &quot; y</p></article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = dict(con.execute(f"SELECT page_id, title FROM ({ORACLES['selected_cards']})").fetchall())
    got = {r.page_id: r.title for r in QUERIES["selected_cards"](spark, str(tmp_path)).collect()}
    assert len(got) == len(titles) and got == theirs
    assert [Tree("<p>a &quot;b&quot; &amp c").text(0), Tree("<p>a &quot;b&quot; &amp c", ()).text(0)] == ['a "b" & c', "a &quot;b&quot; &amp c"]
