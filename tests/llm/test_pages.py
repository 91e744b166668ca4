"""Main texts of small page fixtures."""

from lintlake.llm import site_style


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, blocks int")
    return {r.page_id: r for r in site_style.main_texts(pages).collect()}


def page(k, body, url="http://a.example/x"):
    return (k, url, body, "t", "h", 1)


def test_named_elements_and_references(spark):
    html = (
        "<!DOCTYPE html><html><head><title>No</title><script>var t='</p>';</script></head><body><header>top</header><nav><li>menu</ul></nav>"
        "<div class='cookie-notice'>cookies</div><article><header><h1>A &amp;&eacute; B</h1></header><p><b>One\n\n two<br>three<p>fo<i>ur</i> &lt;x&gt;"
        "<div class=comments><p>me too</div><form><p>mail</form></article><aside>side</aside><footer>&copy;</footer></body></html>"
    )
    got = texts(spark, [page(1, html), page(2, None), page(3, ""), page(4, "plain <b>te</b>xt", None), page(1, html)])
    assert got[1].text == "A &é B One two three four <x>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert got[4].text == "plain text"


def test_wrappers_with_noise_names_keep_the_article(spark):
    story = "<div><p>A long story about the town</p><p>and its river, told twice</p></div>"
    names = ["content has-sidebar", "layout-no-sidebar", "no-ads", "site navigation-top"]
    rows = [page(k, f"<div class='{n}'><div class=ad>Buy now</div>{story}</div>") for k, n in enumerate(names)]
    rows += [
        page(10, "<div class='no-sidebar'><h1>Short</h1></div><div><p>A longer text beside it</p></div>"),
        page(11, "<div class='widget'>First half!</div><div class='related'>Other half!</div><div class='share'>Third part!</div>"),
        page(12, "<div><a name=top><div>Kept after an open anchor</div></div>"),
        page(13, "<div><h2><a href='/x'>Linked heading</a></h2><div><a href='/y'>Menu</a> <a href='/z'>Items</a></div><p>Text</p></div>"),
    ]
    rows = [(r[0], f"http://h{r[0]}.example/", *r[2:]) for r in rows]
    got = {k: r.text for k, r in texts(spark, rows).items()}
    assert all(got[k] == "A long story about the town and its river, told twice" for k in range(4))
    assert got[10] == "Short A longer text beside it" and got[11] == "First half! Other half! Third part!"
    assert got[12] == "Kept after an open anchor" and got[13] == "Linked heading Text"


def test_repeated_branches_of_a_site_leave(spark):
    def body(k):
        return (
            f"<div class=c1><p>Read our <b>magazine</b> today</p></div><div class=c2><p>Story {k} begins</p><p>and ends {k * 7}</p></div>"
            "<div class=c3><span>All rights reserved</span></div>"
        )

    got = texts(spark, [page(k, body(k)) for k in range(12)] + [page(100, body(100), "http://b.example/")])
    assert all(got[k].text == f"Story {k} begins and ends {k * 7}" for k in range(12))
    assert "magazine" in got[100].text  # one page tells nothing about its site


def test_a_site_of_equal_pages_keeps_its_text(spark):
    got = texts(spark, [page(k, "<article><p>The same story</p></article>") for k in range(8)])
    assert {r.text for r in got.values()} == {"The same story"}


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    got = texts(spark, [page(1, deep), page(2, "<p>" + "word " * 50_000)])
    assert got[1].text == "core" and got[2].n_chars == 50_000 * 5 - 1


def test_empty_table(spark):
    assert texts(spark, []) == {}


def test_importance_composes():
    import pandas as pd

    nodes = pd.DataFrame({
        "node": [1, 2, 3], "parent": [0, 1, 1], "pages": [10, 10, 10], "shapes": [1, 1, 1], "presentation": [0.0, 0.0, 0.0], "content": [None, 0.0, 1.0],
    })
    got = site_style.importances(nodes)
    assert got[2] == 0.0 and got[3] == 1.0 and abs(got[1] - 0.45) < 1e-9
