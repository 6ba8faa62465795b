"""Whole books: ids, links, images, split chapters, contents."""

import base64
import unicodedata

from quire.operators import bookbuild as B

CHAPTERS = "book string, pos long, path string, part_label string, text string, split boolean, tip string, override string"
BOOKS = "book string, title string, language string, color string, css string"
IMAGES = "book string, path string, base64 string"


def build(spark, chapters, images=(), title="T"):
    books = spark.createDataFrame([("b", title, "en", None, None), ("none", "x", "en", None, None)], BOOKS)
    rows = [("b", i, *c) for i, c in enumerate(chapters)]
    pages, missing = B.built(books, spark.createDataFrame(rows, CHAPTERS), spark.createDataFrame(list(images), IMAGES))
    return pages.collect(), missing.collect()


def plain(path, text, part=None, split=False, tip=None, override=None):
    return (path, part, text, split, tip, override)


def test_equal_titles_have_ids_of_their_own_and_links_find_them(spark):
    pages, _ = build(spark, [plain("a/one.md", "# Start\n\n[to](../b/two.md#x) [me](./one.md) [gone](three.md) [web](https://e.org/one.md) [here](#y)"), plain("b/two.md", "# Start\n\n[back](../a/one.md)"), plain("c.md", None)])
    assert len(pages) == 1
    html = pages[0].html
    assert [x in html for x in ('id="start"', 'id="start-2"', 'id="c"')] == [True] * 3
    assert '<a href="#start-2">to</a> <a href="#start">me</a> <a href="three.md">gone</a> <a href="https://e.org/one.md">web</a> <a href="#y">here</a>' in html
    assert '<a href="#start">back</a>' in html and html.count("<section") == 3 and (pages[0].n_chapters, pages[0].n_sections) == (3, 3)


def test_images_are_embedded_and_missing_ones_told(spark):
    data = base64.b64encode(b"png").decode()
    pages, missing = build(spark, [plain("a/x.md", "# A\n\n![p](../img/p.PNG) ![q](q.gif) ![w](http://e.org/w.png)")], [("b", "img/p.PNG", data), ("other", "a/q.gif", data)])
    assert f'src="data:image/png;base64,{data}"' in pages[0].html and 'src="q.gif"' in pages[0].html and 'src="http://e.org/w.png"' in pages[0].html
    assert [(r.path, r.src) for r in missing] == [("a/q.gif", "q.gif")]


def test_split_chapters_stand_under_their_title(spark):
    text = "# Whole\n\nintro\n\n## One\n\na\n\n### Deep\n\n## Two\n\nb"
    pages, _ = build(spark, [plain("s.md", text, "Part I", True), plain("t.md", "# T\n\n[s](s.md)", "Part I"), plain("u.md", "# U\n\nno heading", None, True)])
    html = pages[0].html
    assert pages[0].n_sections == 5 and pages[0].n_chapters == 3
    toc = html[html.index('<div id="toc">') : html.index("</nav>")]
    assert [x.split(">")[1].split("<")[0] for x in toc.split("\n") if "<a" in x] == ["Whole", "Whole", "One", "Two", "Part I", "T", "U"]
    assert '<a href="#whole">s</a>' in html and '<h2 id="one">One</h2>' in html and '<h4 id="deep">Deep</h4>' in html


def test_names_are_composed_and_overrides_win(spark):
    nfd = unicodedata.normalize("NFD", "é.md")
    pages, _ = build(spark, [plain("é.md", "# É & <b>", override="own"), plain("x.md", f"[l]({nfd})\n\n> TIP: t", tip=r"^\s*(TIP)")], title="É <T>")
    html = pages[0].html
    assert '<a href="#own">l</a>' in html and '<div class="tip-box">' in html and "<title>É &lt;T&gt;</title>" in html
    assert pages[0].file == "e-t.html"


def test_diagrams_need_a_script(spark):
    live, _ = build(spark, [plain("a.md", "# A\n\n```mermaid\ng\n```")])
    none, _ = build(spark, [plain("a.md", '# A\n\n@@HTML_START@@\n<div class="mermaid" data-prerendered="true"><svg/></div>\n@@HTML_END@@')])
    assert live[0].needs_diagrams and B.DIAGRAM_SCRIPT in live[0].html
    assert not none[0].needs_diagrams and B.DIAGRAM_SCRIPT not in none[0].html
