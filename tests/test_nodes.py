"""Node tables: enclosing ranges against a plain walk, pages there and back, edits and exports of odd books."""

import random

import pytest

from quire.functions import markdown as M
from quire.operators import nodes as N

BOOK = """<!DOCTYPE html>
<html lang="ko"><body><h1>Top</h1><img src="a.png" alt="page 3"/><section id="one"><h2> One <b>x</b> </h2><div><p>t &amp; <i>u</i></p><figure><img src="b.png" alt="z"/><figcaption>See Page 12</figcaption></figure></div>
<section id="in"><h2>Inner</h2><p><img/></p><div class="my-8 y"><h4>Flow</h4><div class="mermaid">Graph TD<b> A</b></div></div></section><div class="mermaid"></div></section><section><h2>no id</h2></section><section id="bare"><p>x</p></section>
<section id="two"><h2>Two</h2><div class="tip-box"><p>tip</p></div><img src="data:image/png;base64,QUJD" alt="d"/><img src="data:text/plain,%20" alt="e"/><pre><code class="language-py">a &lt; b</code></pre></section></body></html>"""


def pages(spark, *html):
    return M.html_nodes(spark.createDataFrame(list(enumerate(html)), "page long, html string"), "page", "html").cache()


def test_pages_come_back(spark):
    odd = "<p>a<br/>b &lt; c</p><!--x--><script>1 < 2 && 3</script><ul><li>q</li></ul>text"
    got = {r.page: r.html for r in N.html_of(pages(spark, BOOK, odd, ""), ["page"]).collect()}
    assert got == {0: BOOK, 1: odd}


def test_images(spark):
    got = [(r.n, r.src, r.alt, r.caption, r.section, r.page_no) for r in N.images(pages(spark, BOOK), "page").orderBy("n").collect()]
    assert got[:3] == [(1, "a.png", "page 3", "", N.NO_SECTION, 3), (2, "b.png", "z", "See Page 12", "Onex", 12), (3, "", "", "", "Inner", None)]
    assert [x[4] for x in got[3:]] == ["Two", "Two"]


def test_diagrams_and_elements(spark):
    nodes = pages(spark, BOOK)
    got = [(r.title, r.kind, r.code, r.section) for r in N.diagrams(nodes, "page").orderBy("n").collect()]
    assert got == [("Flow", "graph", "Graph TDA", "Inner"), (N.DIAGRAM_TITLE + "2", "diagram", "", "Onex")]
    shown = N.elements(nodes, "page").orderBy("display_index").collect()
    assert [(r.kind, r.n) for r in shown] == [("image", 1), ("image", 2), ("image", 3), ("diagram", 1), ("diagram", 2), ("image", 4), ("image", 5)]
    assert [r.extra for r in shown][:4] == ["p.3", "p.12", "-", "graph"]
    own = N.visuals_of(N.sections(nodes, "page"), N.elements(nodes, "page"), "page")
    assert sorted((r.id, r.display_index) for r in own.collect()) == [("in", 3), ("in", 4), ("one", 2), ("one", 5), ("two", 6), ("two", 7)]


def test_sections_count_what_lies_in_them(spark):
    got = {r.id: (r.title, r.word_count, r.image_count, r.diagram_count) for r in N.sections(pages(spark, BOOK), "page").collect()}
    assert got == {"one": ("Onex", 13, 2, 2), "in": ("Inner", 5, 1, 1), "two": ("Two", 5, 2, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_enclosing_is_that_of_a_walk(spark, seed):
    rnd = random.Random(seed)
    html = []
    for _ in range(5):
        out, stack = [], []
        for _ in range(rnd.randint(0, 60)):
            if stack and rnd.random() < 0.45:
                out.append(f"</{stack.pop()}>")
            else:
                tag = rnd.choice(["div", "section", "p", "figure"])
                out.append(f"<{tag}>" + rnd.choice(["", "t", "<img/>"]))
                stack.append(tag)
        html.append("".join(out) + "".join(f"</{t}>" for t in reversed(stack)))
    nodes = pages(spark, *html)
    rows = {(r.page, r.ix): r for r in nodes.collect()}
    want = {}
    for (page, ix), r in rows.items():
        up = r.parent
        while up is not None and rows[page, up].tag not in ("div", "section"):
            up = rows[page, up].parent
        want[page, ix] = up
    got = N.nearest_enclosing(nodes.select("page", "ix"), nodes.filter("tag in ('div', 'section')").select("page", "ix", "last"), "page")
    assert {(r.page, r.ix): r.inside for r in got.collect()} == want


def test_saved_edits(spark):
    nodes = pages(spark, BOOK)
    edits = spark.createDataFrame([(0, "image", 2, "delete", None), (0, "image", 3, "replace", 'n"&.png'), (0, "diagram", 1, "delete", None), (0, "image", 99, "delete", None), (0, "image", 1, "replace", "c.png"), (0, "image", 4, "delete", None), (0, "image", 4, "replace", "gone.png")], "page long, kind string, n int, op string, value string")
    html = N.html_of(N.saved(nodes, edits, "page"), ["page"]).first().html
    want = BOOK.replace('<figure><img src="b.png" alt="z"/><figcaption>See Page 12</figcaption></figure>', "").replace("<img/>", '<img src="n&quot;&amp;.png"/>').replace('src="a.png"', 'src="c.png"').replace('<div class="my-8 y"><h4>Flow</h4><div class="mermaid">Graph TD<b> A</b></div></div>', "").replace('<img src="data:image/png;base64,QUJD" alt="d"/>', "")
    assert html == want


def test_exported_sections(spark):
    files = {r.path: r.content for r in N.exported(pages(spark, BOOK), "page").collect()}
    assert set(files) == {"001_one.md", "002_in.md", "004_two.md", "images/two-1.png"}
    assert files["images/two-1.png"] == "QUJD"
    assert files["004_two.md"] == "# Two\n\n> tip\n\n![d](images/two-1.png)![e](data:text/plain,%20)\n\n```py\na < b\n```\n"
    assert files["002_in.md"] == "# Inner\n\n![]()\n\n#### Flow\n\n```mermaid\nGraph TD A\n```\n".replace("#### Flow", "### Flow")


def test_export_moves_attributes_and_texts_few_times(spark):
    import re

    nodes = M.html_nodes(spark.createDataFrame([(1, "<section id='a'><h2>T</h2><p>x</p></section>")], "page long, html string"), "page", "html")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as over large tables
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = N.exported(nodes, "page")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 3 and sum("attrs#" in x for x in moved) <= 2


def test_export_of_nested_sections_scripts_and_images_in_headings(spark):
    png = "data:image/png;base64,AAAA"
    html = f"<section id='a'><section id='b'><h2>B <img src='{png}'> c</h2><p>x</p><script>1 < 2</script><p>a &lt; b</p></section><p>y <img src='{png}'></p></section>"
    nodes = M.html_nodes(spark.createDataFrame([(1, html)], "page long, html string"), "page", "html")
    got = {r.path: r.content for r in N.exported(nodes, "page").collect()}
    assert got == {"001_a.md": "# Bc\n\ny ![](images/a-2.png)\n", "002_b.md": "# Bc\n\nx\n\na < b\n", "images/b-1.png": "AAAA", "images/a-2.png": "AAAA"}
