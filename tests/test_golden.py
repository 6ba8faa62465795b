"""Known inputs and outcomes of single operators."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import blocks as B
from quire.functions import markdown as M
from quire.functions import text as X
from quire.operators import corpus as C
from quire.operators import editing as E
from quire.operators import layout as L
from quire.operators import splitting as S
from quire.operators import translation as T
from quire.operators.paragraphs import repair
from quire.sources import corpus as source


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("분산 Query 실행 계획 읽기", "분산-query-실행-계획-읽기"), ("Café du matin", "cafe-du-matin"), ("!!!", "section"), ("a - b", "a---b")])
def test_slug(spark, text, want):
    assert one(spark, X.slug(F.lit(text))) == want


def test_suffixes(spark):
    df = spark.createDataFrame([(0, "개요"), (1, "b"), (2, "개요"), (3, "개요")], "pos int, k string")
    assert [r.suffix for r in C.dedupe_suffix(df, "k", "pos").orderBy("pos").collect()] == ["", "", "-2", "-3"]


def test_convention_order(spark):
    paths = ["00_intro.md", "99_afterword.md", "Part_I_only/Chapter_01_x.md", "Appendix/A_glossary.md", "other/x.md"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "pos long, path string")
    got = C.convention_order(df).orderBy("pos_out").collect()
    assert [r.path for r in got] == [paths[0], paths[2], paths[1], paths[3]]
    assert got[1].label == "I부. only"


def test_toc_order_and_tiers(spark):
    files = [("toc.md", "```toc\n1|서론|1|x|y\n2|b|1|x|y\nshort|row\n```"), ("Part_I_a/Chapter_01_x.md", ""), ("README.md", "")]
    df = spark.createDataFrame(files, "path string, text string")
    got, tier = source.resolve(df, None)
    assert tier == "toc" and [(r.path, r.part_label) for r in got.collect()] == [("Part_I_a/Chapter_01_x.md", "Part 1. 서론")]
    got, tier = source.resolve(df.filter("path <> 'toc.md'"), None)
    assert tier == "convention" and [r.path for r in got.collect()] == ["Part_I_a/Chapter_01_x.md"]
    got, tier = source.resolve(spark.createDataFrame([("b/10.md", ""), ("b/9.md", "")], "path string, text string"), None)
    assert tier == "natural" and [r.path for r in got.orderBy("pos_out").collect()] == ["b/9.md", "b/10.md"]
    got, tier = source.resolve(df, source.Book(order=source.Order(files=["Part_*/*.md", "README.md"])))
    assert tier == "explicit" and [r.path for r in got.orderBy("pos_out").collect()] == ["Part_I_a/Chapter_01_x.md", "README.md"]


def test_book_configuration():
    book = source.read_book("title: x\nunknown: 1\nexclude: [a.md]\nsplit: {files: [b.md], heading_level: 3}\n")
    assert (book.title, book.exclude, book.split.heading_level, book.language) == ("x", ["a.md"], 3, "ko")
    assert source.read_book("a: [") is None and source.read_book(None) is None
    assert source.write_book("en", title="é") == "language: en\ntitle: é\n"
    with pytest.raises(TypeError):
        source.read_book("split: {nope: 1}")


def test_files_of_a_tree(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / unicodedata.normalize("NFD", "é.md")).write_text("# t", encoding="utf-8")
    (tmp_path / "x.txt").write_text("no")
    assert [tuple(r) for r in source.markdown_files(spark, str(tmp_path)).collect()] == [("b/é.md", "# t")]


@pytest.mark.parametrize("bands,want", [([(10, 20), (0, 5), (4, 12)], [(0, 20)]), ([(0, 5), (5, 10)], [(0, 10)]), ([(0, 1), (2, 3)], [(0, 1), (2, 3)])])
def test_interval_union(spark, bands, want):
    df = spark.createDataFrame([(1, a, b) for a, b in bands], "id int, y0 int, y1 int")
    assert sorted((r.y0, r.y1) for r in C.interval_union(df, "id").collect()) == want
    assert S.free_gaps(bands).ravel()[1:-1].tolist() == [x for band in want for x in band]


def test_page_cuts():
    assert S.page_cuts(2500, [], 1000, 1000) == [0, 1000, 2000, 2500]
    assert S.page_cuts(50, [], 1000, 100) == [0, 50]
    assert S.nearest_free(1000, S.free_gaps([(950, 1050)]), 400, 1000) == 950
    for seed in range(30):
        bands = [(i * 37 % 900, i * 37 % 900 + seed + 5) for i in range(12)]
        cuts = S.page_cuts(3000, bands, 700, 60 + 20 * seed)
        assert cuts[0] == 0 and cuts[-1] == 3000 and all(0 < b - a <= 700 for a, b in zip(cuts, cuts[1:]))


def test_nearest_free_is_the_first_of_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(400):
        bands = [(float(a), float(a + w)) for a, w in zip(rng.integers(0, 120, 6), rng.integers(1, 25, 6))]
        low, high = sorted(rng.integers(0, 130, 2).astype(float))
        target = min(max(float(rng.integers(0, 130)), low), high)
        edges = sorted(bands)
        union = [edges[0]]
        for a, b in edges[1:]:
            union = [*union[:-1], (union[-1][0], max(union[-1][1], b))] if a <= union[-1][1] else [*union, (a, b)]
        walk = sorted((abs(k), target + 2 * k) for k in range(-70, 71) if low <= target + 2 * k <= high and not any(a < target + 2 * k < b for a, b in union))
        assert S.nearest_free(target, S.free_gaps(bands), low, high) == (walk[0][1] if walk else target)


def test_figure_cuts_of_nulls(spark):
    rows = [(1, 900.0, [[300.0, 500.0]], 400.0, 400.0), (2, None, [], 400.0, 400.0), (3, 900.0, None, 400.0, 400.0), (4, 500.0, [None, [1.0, None]], 400.0, 400.0), (5, 9.0, [], 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, h double, bands array<array<double>>, p double, f double")
    got = {r.id: r.c for r in df.select("id", S.figure_cuts("h", "bands", "p", "f").alias("c")).collect()}
    assert got == {1: [0, 300, 700, 900], 2: None, 3: None, 4: [0, 400, 500], 5: None}


def test_outline(spark):
    df = spark.createDataFrame([(1, 0, "I", 2), (1, 1, "I", 3), (1, 2, "II", 1)], "book int, pos int, part_label string, n int")
    got = C.part_headings(C.page_offsets(df, ["book"], "pos", F.col("n")), ["book"], "pos", True).orderBy("pos").collect()
    assert [(r.heading, r.offset) for r in got] == [("I", 0), (None, 2), ("II", 5)]


def test_part_headings_differ_on_nulls(spark):
    df = spark.createDataFrame([(1, 0, "A"), (1, 1, None), (1, 2, "A")], "book int, pos int, part_label string")
    count = lambda nulls: C.part_headings(df, ["book"], "pos", nulls).filter("heading is not null").count()
    assert (count(False), count(True)) == (1, 2)


def words(spark, rows):
    return spark.createDataFrame([(1, 0, r, i, t, float(x), float(x + 6 * len(t)), float(100 + 20 * r), float(112 + 20 * r), 12.0, None) for i, (r, t, x) in enumerate(rows)], "doc_id int, page int, row int, t int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")


def test_table_run(spark):
    w = words(spark, [(r, "ab", x) for r in range(4) for x in (72, 250, 400)])
    assert [(r.start_row, r.end_row) for r in L.table_runs(w).collect()] == [(0, 4)]
    assert L.table_markdown(w).first().table_md.split("\n")[:2] == ["| ab | ab | ab |", "| -- | -- | -- |"]


def test_rows_are_anchored(spark):
    w = words(spark, [(0, "a", 10), (0, "b", 20), (0, "c", 30)]).withColumn("top", 100.0 + 2 * F.col("t"))
    assert [r.row_ix for r in L.anchored_rows(w).orderBy("t").collect()] == [0, 0, 1]


@pytest.mark.parametrize("sizes,want", [([12.0] * 40 + [20.0] * 3, 12.0), ([11.9, 12, 12.1, 11.95, 12.05] * 6, 12.0), ([12.0, 12.0], None)])
def test_body_size(spark, sizes, want):
    df = spark.createDataFrame([(1, 0, i, float(s)) for i, s in enumerate(sizes)], "doc_id int, page int, t int, size double")
    assert L.body_size(df).first().body_size == want


def test_repeated_lines(spark):
    pages = {1: ["Footer", "a", "| h |"], 2: ["Footer ", "b", "| h |"], 3: ["x", "x", "| h |"], 4: ["c", "| h |"]}
    df = spark.createDataFrame([("d", p, i, x) for p, ls in pages.items() for i, x in enumerate(ls)] + [("e", 1, 0, "Footer"), ("f", 1, 0, "only"), ("f", 2, 0, "only")], "doc string, page int, ln int, line string")
    got = {(r.doc, r.page): r.text for r in C.strip_repeated_lines(df).collect()}
    assert got == {("d", 1): "a\n| h |", ("d", 2): "b\n| h |", ("d", 3): "x\nx\n| h |", ("d", 4): "c\n| h |", ("e", 1): "Footer", ("f", 1): "", ("f", 2): ""}


def test_chunks(spark):
    text = "\n\n".join("x" * 30 for _ in range(4))
    got = one(spark, T.chunk_text(F.lit(text), 100))
    assert len(got) == 2 and got[0] == "\n\n".join(["x" * 30] * 3)
    assert one(spark, T.chunk_text(F.lit(""), 10)) == [] and one(spark, T.chunk_text(F.lit(" \n\n "), 10)) == [" \n\n "]


@pytest.mark.parametrize("a,b,want", [("x" * 50, "x" * 50, True), ("AOO Stack", "AOO Stack", False), ("§14", "§14", False), ("y" * 30, "y" * 30 + "\n", True)])
def test_echo(spark, a, b, want):
    assert one(spark, T.is_echo(F.lit(a), F.lit(b))) is want
    assert T.failed_in_python(a, b, "ko") is want


def test_cells_of_a_table():
    sent = []
    f = lambda x: sent.append(x) or x.upper()
    hangul = lambda c: any("가" <= x <= "힣" for x in c)
    table = "| # | 문제 | 담당 |\n|---|---|---|\n| A1 | 모호한 지시 | 방법론 |"
    out = M.map_chunk(f"prose\n\n{table}\n\nmore", f, hangul, lambda a, b: "\n" in b)
    assert sent == ["prose", "문제", "담당", "모호한 지시", "방법론", "more"]
    assert out.startswith("PROSE\n\n| # | 문제 | 담당 |\n|---|---|---|\n| A1 |") and M.table_like(table) and not M.table_like("a | b\ntext")
    assert M.map_cells("| 가 |\n|---|\n| 나 |", lambda x: x + "\nz", hangul, lambda a, b: "\n" in b) == "| 가 |\n|---|\n| 나 |"


def test_bounded_retry(spark):
    df = spark.createDataFrame([("p", 1, "a" * 30, "ko"), ("p", 2, "fine", "ko"), ("p", 3, "  ", "ko")], "path string, chunk_ix long, original string, lang string")
    got = {r.chunk_ix: (r.attempts, r.failed) for r in T.map_with_retry(df, lambda s, seed: s, T.failed_in_python).collect()}
    assert got == {1: (3, True), 2: (1, False), 3: (0, False)}


def repaired(spark, text, page=1):
    df = spark.createDataFrame([("d", page, i, x) for i, x in enumerate(text.split("\n"))], "doc string, page int, ln int, line string")
    return repair(df).first().text


@pytest.mark.parametrize("text,want", [
    ("exam-\nple", "example"), ("South-\nKorea", "South- Korea"), ("● a ● b", "● a\n\n● b"), ("one\ntwo.\nthree", "one two.\n\nthree"), ("a\n\n\nb", "a\n\nb"),
    ("x\n| a | b |\n| c | d |\ny", "x\n\n| a | b |\n| c | d |\n\ny"), ("# no heading", "\\# no heading"), ("\x01HEADING\x01 Title\nbody", "## Title\n\nbody"),
    ("a\n\x01CODE\x01\n  x = 1\n\n# y\n\x01/CODE\x01\nb", "a\n\n```\n  x = 1\n\n# y\n```\n\nb"), ("see #1) first", "see\n\n\\#1) first"), ("- a\n- b", "- a\n\n- b"), ("", ""),
    ("\n".join(["q one"] * 5), "\n\n".join(["q one"] * 5)), ("\n".join(["q one"] * 4), " ".join(["q one"] * 4)),
])
def test_paragraphs(spark, text, want):
    assert repaired(spark, text) == want


def test_headings_move(spark):
    assert one(spark, X.demote_headings(F.lit("<h1>T</h1><h4>A</h4>"))) == "<h2>T</h2><h5>A</h5>"


def test_split(spark):
    md = "# T\n\nintro\n## A\nx\n```\n## no\n```\n> ```\n## no\n> ```\n@@HTML_START@@\n## no\n@@HTML_END@@\n## B\ny"
    df = spark.createDataFrame([(1, md), (2, "# T\n\n## A\nx"), (3, "plain"), (4, "## A\n### B")], "id int, text string")
    got = {}
    for r in S.split_pieces(df, "id", "text").orderBy("id", "piece_ix").collect():
        got.setdefault(r.id, []).append(r.md)
    assert [len(v) for v in got.values()] == [3, 1, 1, 1]
    assert got[1][1].startswith("# A\nx\n```") and got[1][2] == "# B\ny" and got[2] == ["# A\nx"] and got[3] == ["plain"]
    level3 = [r.md for r in S.split_pieces(df.filter("id = 4"), "id", "text", 3).orderBy("piece_ix").collect()]
    assert level3 == ["## A", "## B"]


def test_unique_ids(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a_2", "a", "a"])], "book int, pos int, id string")
    assert [r.new_id for r in S.unique_ids(df, "book", "pos").orderBy("pos").collect()] == ["a", "a_2", "a_3", "a_4"]


def test_reinsertion(spark):
    nodes = spark.createDataFrame([("s", 0, "content", "p1"), ("s", 1, "diagram", "D1"), ("s", 2, "diagram", "D2"), ("s", 3, "content", "p2"), ("s", 4, "figure", "F")], "id string, ix int, kind string, html string")
    fresh = spark.createDataFrame([("s", 0, "n1"), ("s", 1, "n2")], "id string, ix int, html string")
    assert [r.html for r in E.reinserted(nodes, fresh).orderBy("pos").collect()] == ["n1", "D1", "D2", "n2", "F"]


def test_render():
    html = M.render("# Héllo\n\nA *b* **c** `x<y`\nnext\n\n- a\n    - b\n\n1. x\n\n| a | b |\n|---|:-:|\n| 1 | `x|y` |\n\n```py\nx < 1\n```", None)
    for part in ('<h1 id="hello">', "<em>b</em> <strong>c</strong> <code>x&lt;y</code><br />", "<ol>\n<li>x</li>", '<div class="table-wrap"><table>', "<code>x|y</code>", '<pre><code class="language-py">x &lt; 1\n</code></pre>'):
        assert part in html
    tips = M.render("> TIP: t\n>\n> plain", M.tip_pattern(["TIP"]))
    assert '<div class="tip-box"><p>TIP: t</p>' in tips and "<blockquote><p>plain</p>" in tips
    assert "tip-box" not in M.render("> TIP: t", M.tip_pattern([]))
    kept = M.render('```mermaid\nA["x<br/>y"]\n```\n\n@@HTML_START@@\n<b>1</b>\n@@HTML_END@@\n\n> ```py\n> a<b\n> ```')
    assert 'data-lf-preserve="mermaid">A["x\\ny"]' in kept and '<div class="lf-html-block" data-lf-preserve="html"><b>1</b></div>' in kept and '<code class="language-py">a&lt;b</code>' in kept


def test_markdown_comes_back():
    md = "Intro **x** and `c` with [l](a.md)\n\n### T\n\n* a\n* b\n\n```py\nx = 1\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert M.to_markdown(M.render(md)) == md
    left = M.to_markdown('<section><h2>T</h2><p>a</p><figure>f</figure><div class="my-8"><div class="mermaid">g</div></div><div class="tip-box">t</div><script>s</script><p>b</p></section>')
    assert left == "a\n\nb"


def test_blocks_are_restored():
    text = "a\n```py\n## x\n```\nb\n@@HTML_START@@\n```\n@@HTML_END@@\n> ```\n> y\n> ```\n```mermaid\ng\n```\n"
    masked, kept = B.protect(text)
    assert len(kept) == 4 and kept[1].startswith("@@HTML_START@@") and kept[3].startswith("```mermaid") and B.restore(masked, kept) == text


def test_blocks_lie_end_to_end():
    """Whatever the text, the sources joined are the text; code takes the blank lines behind it; what isn't closed is prose."""
    rnd = np.random.default_rng(5)
    parts = ["```", "```py", "> ```", "> ```py", "> x", "@@HTML_START@@", "@@HTML_END@@", "```mermaid", "", "  ", "a", "b @@HTML_START@@", "```py extra", "<i>"]
    for _ in range(3000):
        text = "\n".join(rnd.choice(parts, rnd.integers(0, 14)))
        assert "".join(b.source for b in B.scan(text)) == text
        masked, kept = B.protect(text)
        assert B.restore(masked, kept) == text
    assert [(b.kind, b.source) for b in B.scan("```\nx\n```\n\n \nnext")] == [("code", "```\nx\n```\n\n "), ("prose", "\nnext")]
    assert [b.kind for b in B.scan("```py\nnever closed")] == ["prose"]
    assert B.restore("@@TBLOCK_7@@", []) == "@@TBLOCK_7@@"


def test_deep_and_long_pages_are_converted():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert M.to_markdown(deep) == "x"
    assert M.render("```\n" * 20001).count("<pre>") >= 1


def test_quotes_and_verbatim_lines():
    assert M.render("> TIP: a\n>\n> - x\n>\n> b", M.tip_pattern(["TIP"])) == '<div class="tip-box"><p>TIP: a</p>\n<ul>\n<li>x</li>\n</ul>\n</div>\n<blockquote><p>b</p>\n</blockquote>'
    mixed = M.render("before\n@@HTML_START@@\n<b>1</b>\n@@HTML_END@@\nafter")
    assert mixed == '<p>before<br />\n<div class="lf-html-block" data-lf-preserve="html"><b>1</b></div><br />\nafter</p>'


def test_labels():
    assert M.wrap_label("short") == "short" and M.wrap_label("a\\nb" * 20) == "a\\nb" * 20
    for label in ("실전 AI 에이전트 하네스 엔지니어링", "someVeryLongCamelCaseIdentifierHere/withPath", "가" * 40, "plain words that go on and on"):
        parts = M.wrap_label(label).split("\\n")
        assert all(M.columns(p) <= 18 for p in parts) and "".join(parts).replace(" ", "") == label.replace(" ", "")


def test_long_digit_runs_sort_by_value(spark):
    from quire.functions.text import natural_key

    names = ["v" + "9" * 50, "v1" + "0" * 50, "v002", "v10", "v" + "0" * 60 + "3"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r.path for r in df.orderBy(natural_key(F.col("path")), "path").collect()]
    assert got == ["v002", "v" + "0" * 60 + "3", "v10", "v" + "9" * 50, "v1" + "0" * 50]


def test_null_chunks_pass_through(spark):
    from quire.operators.translation import failed_in_python, map_with_retry

    df = spark.createDataFrame([("a", 0, None, "en"), ("a", 1, "x", "en")], "path string, chunk_ix long, original string, lang string")
    got = sorted(map_with_retry(df, lambda s, seed: s.upper(), failed_in_python).collect())
    assert [(r.result, r.attempts, r.failed) for r in got] == [(None, 0, False), ("X", 1, False)]


def test_unknown_theme_is_an_error(spark):
    from quire.functions.theme import theme_css

    df = spark.createDataFrame([("Teal",), (None,)], "name string")
    assert [r[0] is None for r in df.select(theme_css(F.col("name"))).collect()] == [False, True]
    with pytest.raises(Exception, match="unknown colour theme"):
        spark.createDataFrame([("mauve",)], "name string").select(theme_css(F.col("name"))).collect()


def test_override_keys_are_composed():
    from quire.sources.corpus import read_book

    key = unicodedata.normalize("NFD", "\u00e9.md")
    assert len(key) == 5 and read_book(f"section_id_overrides:\n  '{key}': x\n").section_id_overrides == {"\u00e9.md": "x"}


@pytest.mark.parametrize("seed", range(3))
def test_unique_ids_are_those_of_probing(spark, seed):
    rnd = np.random.default_rng(seed)
    rows = [(int(rnd.integers(3)), i, str(rnd.choice(["a", "a_2", "a_3", "a_2_2", "b", "b_5", "a_02", "a_1", "_2", ""]))) for i in range(120)]
    want = {}
    for book in range(3):
        taken, seen = {x for b, _, x in rows if b == book}, {}
        for b, i, x in rows:
            if b == book:
                seen[x] = n = seen.get(x, 0) + 1
                new = x
                if n > 1:
                    while (new := f"{x}_{n}") in taken:
                        n += 1
                    taken.add(new)
                want[b, i] = new
    got = S.unique_ids(spark.createDataFrame(rows, "book int, pos int, id string"), "book", "pos")
    assert {(r.book, r.pos): r.new_id for r in got.collect()} == want


def test_toc_links_follow_renamed_sections(spark):
    ids = spark.createDataFrame([(1, i, "a") for i in range(3)] + [(1, 9, "b")], "book int, pos int, id string")
    links = spark.createDataFrame([(1, i, "#a") for i in range(5)] + [(1, 7, "#b")], "book int, ix int, href string")
    got = S.followed_links(links, S.unique_ids(ids, "book", "pos"), "book")
    assert [r.href for r in got.orderBy("ix").collect()] == ["#a", "#a_2", "#a", "#a_3", "#a", "#b"]


def test_each_book_takes_its_first_tier(spark):
    parts = ["Part_I_a/Chapter_01_x.md", "Part_II_b/Chapter_001_y.md", "Chapter_9_z.md", "README.md", "10.md", "9.md"]
    files = [(b, p, "# x") for b in ("listed", "toc", "named", "none", "gone") for p in parts if b != "gone"]
    files = [(b, p.replace("Part_", "Sec_") if b == "none" else p, t) for b, p, t in files]
    files += [("toc", "b_toc.md", "```toc\n1|One|1|s\n2|Two|1|s\n3|Three|9|s\n1|One|7|s\n```"), ("toc", "c_toc.md", "```toc\n1|X|1|s\n```"), ("toc", "deep/a.md", "```toc\n1|X|1|s\n```")]
    books = [("listed", "order: {files: ['Part_*/*.md', 9.md, 9.md]}"), ("toc", None), ("named", "exclude: [README.md, '1*.md']"), ("none", "a: ["), ("gone", None)]
    got = source.resolve_books(spark.createDataFrame(files, "book string, path string, text string"), spark.createDataFrame(books, "book string, config string"))
    want = {}
    for r in got.orderBy("book", "pos_out").collect():
        want.setdefault((r.book, r.tier), []).append((r.path, r.part_label))
    assert want == {
        ("listed", "explicit"): [(parts[0], None), (parts[1], None), ("9.md", None), ("9.md", None)],
        ("toc", "toc"): [(parts[0], "Part 1. One"), (parts[1], "Part 2. Two"), ("Chapter_9_z.md", "Part 3. Three")],
        ("named", "convention"): [("9.md", None), ("Chapter_9_z.md", None), (parts[0], "I부. a"), (parts[1], "II부. b")],
        ("none", "natural"): [("9.md", None), ("10.md", None), ("Chapter_9_z.md", None), ("Sec_I_a/Chapter_01_x.md", None), ("Sec_II_b/Chapter_001_y.md", None)],
    }
