"""Pages and documents composed from words: tables between columns, headings, code, images, page numbers, repeated lines."""

from quire.operators import page_import as P
from quire.operators.paragraphs import CODE, CODE_END, HEADING

WORDS = "doc_id long, page int, t int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"
PAGES = "doc_id long, page int, height double"
IMAGES = "doc_id long, page int, n int, path string, x0 double, x1 double, top double, bottom double"


class Page:
    """Words of a page, placed by line and place."""

    def __init__(self, doc, page):
        self.doc, self.page, self.rows, self.top = doc, page, [], 100.0

    def line(self, text, x=72.0, size=11.0, font="Times", step=20.0, top=None):
        y = self.top if top is None else top
        for word in text.split():
            self.rows.append((self.doc, self.page, len(self.rows), word, x, x + 6.0 * len(word), y, y + 12.0, size, font))
            x += 6.0 * (len(word) + 1)
        if top is None:
            self.top += step
        return self

    def cells(self, *cells, at=(72.0, 250.0, 430.0)):
        for x, cell in zip(at, cells):
            self.line(cell, x, top=self.top)
        self.top += 20.0
        return self


def texts(spark, pages, heights=1000.0, images=None, **kw):
    words = spark.createDataFrame([r for p in pages for r in p.rows], WORDS)
    sizes = spark.createDataFrame([(p.doc, p.page, heights) for p in pages], PAGES)
    found = None if images is None else spark.createDataFrame(images, IMAGES)
    return sizes, words, found, {(r.doc_id, r.page): r.text for r in P.page_texts(sizes, words, found, **kw).collect()}


def test_a_table_between_prose(spark):
    p = Page(1, 0).line("before the table stands a line").cells("a|b", "two", "c").cells("1", "2", "3").cells("p", "q", "r s").line("and after it")
    got = texts(spark, [p, Page(1, 1)])[3]
    assert got == {(1, 0): "before the table stands a line\n\n| a\\|b | two | c   |\n| ---- | --- | --- |\n| 1    | 2   | 3   |\n| p    | q   | r s |\n\nand after it", (1, 1): ""}


def test_columns_are_read_one_after_the_other(spark):
    p = Page(1, 0)
    for i in range(6):
        p.line(f"left column line {i} goes", 72.0, top=p.top).line(f"right column line {i} too", 330.0, top=p.top)
        p.top += 20.0
    got = texts(spark, [p])[3][1, 0]
    assert got == "\n".join(f"left column line {i} goes" for i in range(6)) + "\n\n" + "\n".join(f"right column line {i} too" for i in range(6))


def test_headings_code_images_and_numbers(spark):
    p = Page(1, 0)
    p.line("7", 300.0, top=20.0).line("Chapter One", size=20.0, step=60.0)
    for i in range(30):
        p.line(f"some body text of line {i} in the usual size")
    p.line("def f():", font="CourierNew").line("return 1", font="CourierNew")
    p.rows.append((1, 0, 999, "bad\x07word", 500.0, 520.0, 100.0, 112.0, 11.0, "Times"))
    image = [(1, 0, 0, "images/p1.png", 72.0, 200.0, p.top + 40, p.top + 90)]
    sizes, words, found, got = texts(spark, [p], images=image)
    lines = got[1, 0].split("\n")
    assert lines[0] == f"{HEADING} Chapter One" and "7" not in lines and "bad\x07word" not in got[1, 0]
    assert lines[-5:] == [CODE, "def f():", "return 1", CODE_END, "![](images/p1.png)"]
    files = {r.path: r.content for r in P.imported(sizes, words, found).collect()}
    body = files["1.md"]
    assert body.startswith("# 1\n\n## Chapter One\n\nsome body text of line 0 in the usual size some body") and "```\ndef f():\nreturn 1\n```\n\n![](images/p1.png)\n" in body
    assert files["book.yaml"] == "language: en\nsplit:\n  files:\n  - 1.md\n  heading_level: 2\n"
    plain = texts(spark, [p], headings=False)[3][1, 0]
    assert plain.startswith("Chapter One\n")


def test_running_lines_go_and_paragraphs_cross_pages(spark):
    pages = []
    for n in range(4):
        pages.append(Page(2, n).line("The Running Title").line(f"page {n} has a sentence that goes").line("on here" if n < 3 else "to its end."))
    sizes, words, _, _ = texts(spark, pages)
    files = {r.path: r.content for r in P.imported(sizes, words).collect()}
    assert "Running" not in files["2.md"] and files["2.md"].endswith("to its end.\n") and files["book.yaml"] == "language: en\n"


def test_no_words(spark):
    sizes, words = spark.createDataFrame([(1, 0, 10.0)], PAGES), spark.createDataFrame([], WORDS)
    assert [tuple(r) for r in P.page_texts(sizes, words).collect()] == [(1, 0, "")]
    assert {r.path: r.content for r in P.imported(sizes, words).collect()} == {"1.md": "# 1\n\n\n", "book.yaml": "language: en\n"}


def _late_heading():
    """A book whose first ten pages hold a word each, and whose chapter begins after them."""
    pages = [Page(3, n).line("word") for n in range(10)]
    last = Page(3, 10).line("Chapter Late", size=20.0, step=60.0)
    for i in range(30):
        last.line(f"some body text of line {i} in the usual size")
    return [*pages, last]


def test_sizes_come_from_all_pages(spark):
    assert texts(spark, _late_heading())[3][3, 10].startswith(f"{HEADING} Chapter Late\n")


def test_documents_have_headings_that_begin_late(spark):
    sizes, words, _, _ = texts(spark, _late_heading())
    files = {r.path: r.content for r in P.imported(sizes, words).collect()}
    assert "\n## Chapter Late\n" in files["3.md"] and "heading_level: 2" in files["book.yaml"]


def test_words_without_place_or_text(spark):
    rows = [(1, 0, 0, "a", None, None, 10.0, 12.0, None, None), (1, 0, 1, None, 90.0, 99.0, 10.0, 12.0, 11.0, "Times"), (1, 0, 2, "b", 80.0, None, 11.0, None, 11.0, None), (1, 0, 3, "lost", 1.0, 2.0, None, 12.0, 11.0, None), (None, 0, 0, "x", 1.0, 2.0, 3.0, 4.0, 5.0, "f")]
    pages = spark.createDataFrame([(1, 0, 1000.0), (2, 0, None)], PAGES)
    assert {tuple(r) for r in P.page_texts(pages, spark.createDataFrame(rows, WORDS)).collect()} == {(1, 0, "a\n\nb"), (2, 0, "")}
