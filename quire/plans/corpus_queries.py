"""Queries on ordering, identity, linking and diagnostics, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.theme import THEMES, theme_css
from ..operators import corpus as C
from .views import v_bands, v_chapters, v_html, v_images, v_lines, with_views

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def a2(spark, d):
    return C.strip_repeated_lines(v_lines(spark, d), 0.02)


def a3(spark, d):
    images = v_images(spark, d)
    found = C.repeated(images, "doc", "page", F.col("hash"), 0.02).withColumnRenamed("key", "hash")
    return images.join(found, ["doc", "hash"], "left_anti").select("doc", "page", "pos", "hash")


def a4(spark, d):
    lettered = v_lines(spark, d).withColumn("line", F.when(F.col("ln") % 3 == 0, F.concat(F.substring("line", 1, 1), F.lit(" "), F.col("line"))).otherwise(F.col("line")))
    return C.bullet_chars(lettered)


def a19(spark, d):
    return v_lines(spark, d).groupBy("page").agg(X.ordered_concat(F.col("line"), [F.col("ln")], "\n\n").alias("text"))


def g2(spark, d):
    return v_lines(spark, d).select("page", F.col("ln").cast("long").alias("ln"), "line")


def g3(spark, d):
    doubled = F.replace(F.col("line"), F.lit(" the "), F.lit("\n\n\nthe "))
    return v_lines(spark, d).select("page", "ln", F.posexplode(F.split(doubled, "\n\n")).alias("ix", "para"))


def u6(spark, d):
    return v_lines(spark, d).select("doc", "page", X.strip(F.col("line")).alias("line")).distinct()


def u5(spark, d):
    images = v_images(spark, d).select("doc", "page", "pos", "hash")
    gone = images.filter("page % 7 = 0").select("hash").distinct()
    return images.join(gone, "hash", "left_anti")


def u1(spark, d):
    images = v_images(spark, d).select("page", F.concat(F.lit("![]("), F.col("src"), F.lit(")")).alias("text"), F.lit(0.0).alias("x0"))
    return v_lines(spark, d).select("page", F.col("line").alias("text"), F.lit(72.0).alias("x0"), F.col("ln").cast("double").alias("top")).unionByName(images, allowMissingColumns=True)


def sk9(spark, d):
    n = F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos"))
    return v_images(spark, d).withColumn("n", n).select("doc", "page", "pos", F.format_string("page%04d_img%d.png", F.col("page"), F.col("n")).alias("file"), F.concat(F.lit("![](images/"), F.format_string("page%04d_img%d.png", F.col("page"), F.col("n")), F.lit(")")).alias("text"))


def f8(spark, d):
    return v_images(spark, d).filter("width >= 20 and height >= 20").select("doc", "page", "pos", "width", "height")


def j4(spark, d):
    """Decoded bytes to positions by page and name; of several with one name the last counts."""
    images = v_images(spark, d).withColumn("name", F.regexp_replace("src", "\\.[^.]*$", ""))
    decoded = images.groupBy("page", "name").agg(F.max_by("hash", "pos").alias("hash"))
    return images.select("page", "pos", "name").join(decoded, ["page", "name"])


def j5(spark, d):
    a = v_lines(spark, d).select("page", F.col("ln").alias("ix"), "line")
    b = v_images(spark, d).select("page", F.col("pos").alias("ix"), "hash")
    return a.join(b, ["page", "ix"])


def s1(spark, d):
    w = Window.partitionBy("folder").orderBy("key", "pos")
    c = v_chapters(spark, d).withColumn("key", X.natural_key(F.col("path"))).withColumn("folder", F.regexp_extract("path", "^([^/]*)/", 1))
    return c.select("pos", "path", F.row_number().over(w).alias("rank"))


def s2(spark, d):
    return v_chapters(spark, d).select("pos", X.roman_rank(F.regexp_extract("path", "^Part_([A-Z]+)_", 1)).alias("rank"))


def s3(spark, d):
    n = C.leading_number(C.file_name(F.col("path")))
    return v_chapters(spark, d).select("pos", F.when(F.coalesce(n, F.lit(0)) >= 50, "back").otherwise("front").alias("side"))


def sc6(spark, d):
    return C.convention_order(v_chapters(spark, d)).select("pos", "path", "section", "label", F.col("pos_out").cast("long").alias("pos_out"))


def u3(spark, d):
    return C.convention_order(v_chapters(spark, d)).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("pos_out").alias("first"), F.max("pos_out").alias("last"))


def sc2(spark, d):
    files = v_chapters(spark, d).select("path").distinct()
    return C.explicit_order(files, ["Part_I_*/Chapter_0?_src[1-3].md", "Appendix/*.md", "00_top_src0.md", "Part_I_*/Chapter_02*.md", "absent.md"])


def sc8(spark, d):
    files = v_chapters(spark, d).select("path").distinct()
    return C.explicit_order(files, ["Part_X_*/*.md", "Appendix/*.md", "Appendix/*src1.md", "absent.md"]).select("path").distinct()


def j17(spark, d):
    targets = sc8(spark, d).withColumn("is_target", F.lit(True))
    return v_chapters(spark, d).join(targets, "path", "left").select("pos", "path", F.coalesce("is_target", F.lit(False)).alias("is_target"))


def f1(spark, d):
    return C.excluded(v_chapters(spark, d), ["*_src1.md", "Chapter_?_src2.md", "[0-4]*_top_*"]).select("pos", "path")


def x3(spark, d):
    return v_chapters(spark, d).select("pos", X.nfc(F.col("title")).alias("title"))


def x1(spark, d):
    return v_chapters(spark, d).select("pos", X.slug(F.concat_ws(" ", F.col("title"), F.col("text"))).alias("slug"))


def w1(spark, d):
    return C.dedupe_suffix(v_chapters(spark, d), "title", "pos").select("pos", "title", "suffix")


def x2(spark, d):
    over = F.when(F.col("pos") % 11 == 0, F.concat(F.lit("id-"), F.col("pos").cast("string")))
    base = F.coalesce(over, X.slug(F.when(F.col("pos") % 5 == 0, F.regexp_extract("path", "([^/]*)\\.md$", 1)).otherwise(F.col("title"))))
    return C.dedupe_suffix(v_chapters(spark, d).withColumn("base", base), "base", "pos").select("pos", F.concat("base", "suffix").alias("sid"))


def w3(spark, d):
    c = v_chapters(spark, d).withColumn("book", F.floor(F.col("pos") / 100).cast("long"))
    return C.part_headings(c, ["book"], "pos", nulls_count=False).filter("heading is not null").select("pos", "heading")


def w4(spark, d):
    c = v_chapters(spark, d).withColumn("book", F.floor(F.col("pos") / 100).cast("long"))
    return C.part_headings(c, ["book"], "pos", nulls_count=True).filter("heading is not null").select("pos", "heading")


def w5(spark, d):
    c = v_chapters(spark, d).withColumn("book", F.floor(F.col("pos") / 100).cast("long"))
    return C.page_offsets(c, ["book"], "pos", F.ceil(F.col("n_chars") / 2000)).select("pos", "page_count", "offset")


def sk3(spark, d):
    c = v_chapters(spark, d).withColumn("book", F.floor(F.col("pos") / 100).cast("long"))
    o = C.part_headings(C.page_offsets(c, ["book"], "pos", F.ceil(F.col("n_chars") / 2000)), ["book"], "pos", nulls_count=True)
    parts = o.filter("heading is not null").select("book", "pos", F.lit(0).alias("depth"), F.col("heading").alias("title"), "offset")
    return parts.unionByName(o.select("book", "pos", F.when(F.col("part_label").isNull(), 0).otherwise(1).alias("depth"), "title", "offset"))


def a1(spark, d):
    c = v_chapters(spark, d).withColumn("source", F.regexp_extract("path", "(src\\d+)\\.md$", 1))
    return C.duplicate_titles(c, ["source"])


def x4(spark, d):
    md = F.concat(F.lit("intro\n#  "), F.col("title"), F.lit("  \nbody"))
    return v_chapters(spark, d).select("pos", X.raw_h1(F.when(F.col("pos") % 3 == 0, F.col("title")).otherwise(md)).alias("h1"))


def x5(spark, d):
    return v_html(spark, d).select("page_id", X.first_h1(F.col("html")).alias("h1"))


def x6(spark, d):
    return v_html(spark, d).select("page_id", F.md5(X.demote_headings(F.col("html"))).alias("digest"), F.regexp_count(X.demote_headings(F.col("html")), F.lit("<h2")).alias("n_h2"))


def x7(spark, d):
    down = X.demote_headings(X.demote_headings(F.col("html")))
    return v_html(spark, d).select("page_id", F.md5(X.promote_headings(down)).alias("digest"))


def x8(spark, d):
    return v_html(spark, d).select("page_id", X.strip_tags(F.col("html")).alias("text"))


def x9(spark, d):
    tabled = F.replace(F.replace("html", F.lit("<nav>"), F.lit("<table>")), F.lit("</nav>"), F.lit("</table>"))
    return v_html(spark, d).select("page_id", F.md5(X.wrap_tables(tabled)).alias("digest"))


def x10(spark, d):
    return v_html(spark, d).select("page_id", F.md5(X.html_escape(F.col("html"))).alias("digest"))


def x11(spark, d):
    linked = F.regexp_replace("html", 'href="/([^"]*)"', 'href="/$1.md#x"')
    return v_html(spark, d).select("page_id", F.md5(F.regexp_replace(linked, '<a href="[^":#]*\\.md(#[^"]*)?">(.*?)</a>', "$2")).alias("digest"))


def x12(spark, d):
    imaged = F.replace("html", F.lit('<a href="/'), F.lit('<img src="img/'))
    return v_html(spark, d).select("page_id", F.md5(F.regexp_replace(imaged, '<img src="(?:\\./)?(img/[^"]*)"', '<img src="file:///book/$1"')).alias("digest"))


def _hrefs(spark, d):
    href = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return v_html(spark, d).select("page_id", F.posexplode(href).alias("ix", "href"))


def g5(spark, d):
    return _hrefs(spark, d)


def f15(spark, d):
    h = _hrefs(spark, d)
    kind = F.when(F.col("href").rlike("^(https?://|data:|#|mailto:)"), "skip").when(F.regexp_replace("href", "#.*$", "").endswith(".md"), "internal").otherwise("other")
    mixed = F.when(F.col("ix") % 3 == 0, F.concat(F.lit("https://x.org"), F.col("href"))).when(F.col("ix") % 3 == 1, F.concat(F.col("href"), F.lit(".md#f"))).otherwise(F.col("href"))
    return h.withColumn("href", mixed).select("page_id", "ix", kind.alias("kind"))


def f16(spark, d):
    c = F.col("src")
    web = c.rlike("^(https?://|data:)")
    src = F.element_at(F.array(*[F.lit(x) for x in ("https://", "data:", "file://", "#", "")]), (F.col("ix") % 5 + 1).cast("int"))
    h = _hrefs(spark, d).withColumn("src", F.concat(src, "href"))
    return h.select("page_id", "ix", (web | c.rlike("^(file://|#)")).alias("skip_html"), (web | c.rlike("^file://")).alias("skip_pdf"), (web | c.rlike("^#")).alias("skip_check"))


def j1(spark, d):
    """Links of pages (made relative Markdown paths) to the first section of the file."""
    sections = v_chapters(spark, d).select("path", "pos", F.concat(F.lit("sec-"), F.col("pos").cast("string")).alias("sid"))
    path = F.concat(F.lit("../Appendix/./A"), (F.col("page_id") * 13 % 500).cast("string"), F.lit("_src"), (F.col("page_id") * 13 % 20).cast("string"), F.lit(".md#top"))
    href = F.when(F.col("ix") % 4 == 0, F.col("href")).when(F.col("ix") % 4 == 1, path).when(F.col("ix") % 4 == 2, F.lit("absent.md")).otherwise(F.concat(F.lit("https://x.org"), F.col("href")))
    links = _hrefs(spark, d).withColumn("href", href).withColumn("folder", F.lit("Part_I_some_name"))
    return C.resolve_links(links, sections, ["page_id", "ix"])


def j2(spark, d):
    return v_chapters(spark, d).groupBy("path").agg(F.min_by("title", "pos").alias("sid"), F.min("pos").alias("pos"))


def j3(spark, d):
    images = v_images(spark, d).select("doc", "page", "pos", "src")
    files = images.filter("page % 3 <> 0").select(F.col("src").alias("path"))
    return C.missing_references(images, files, "^(https?://|data:|#)")


def sk13(spark, d):
    c = v_chapters(spark, d)
    dup = c.groupBy("title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n_duplicates"))
    return c.agg(F.count(F.lit(1)).alias("n_chapters")).join(dup).join(j3(spark, d).agg(F.count(F.lit(1)).alias("n_missing")))


def j6(spark, d):
    """Manifest rows to folders and files by pattern, the first by path; without a folder of that part anywhere."""
    rows = v_chapters(spark, d).select("pos", (F.col("pos") / 10 % 12).cast("int").cast("string").alias("part_no"), (F.col("pos") % 7).cast("string").alias("chapter_no"))
    romans = F.create_map(*[F.lit(x) for k, v in X.ROMAN.items() for x in (str(v), k)])
    rows = rows.withColumn("alt", F.coalesce(romans[F.col("part_no")], F.col("part_no")))
    files = v_chapters(spark, d).select("path").distinct().withColumn("folder", F.regexp_extract("path", "^([^/]*)/", 1))
    # a numeral only has to be followed by something that isn't a digit, so II also begins with I: every such beginning is a key
    token = F.regexp_extract("folder", "^Part_?0*(\\d+|[A-Z]+)", 1)
    starts = F.when(token.rlike("^\\d"), F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substring(token, F.lit(1), i)))
    files = files.filter(token != "").withColumn("part", F.explode(starts)).withColumn("chapter", F.regexp_extract("path", "/Chapter_?0*(\\d+)\\D", 1))
    numerals = rows.select("pos", "chapter_no", F.explode(F.array_distinct(F.array("part_no", "alt"))).alias("part"))
    hit = numerals.join(files, ["part"]).filter(F.col("chapter") == F.col("chapter_no"))
    return hit.groupBy("pos").agg(F.min(F.struct("folder", "path")).alias("f")).select("pos", F.col("f.path").alias("path"))


def w9(spark, d):
    return C.interval_union(v_bands(spark, d), "id")


def sc16(spark, d):
    rows = v_images(spark, d).select("src").distinct().filter(F.contains(F.lower("src"), F.lit("a")) & F.lower("src").rlike("\\.(png|jpe?g|webp|gif)$"))
    return C.page_slice(rows, ["src"], 2, 24)


def a16(spark, d):
    return sc16(spark, d).groupBy("total", "pages").agg(F.count(F.lit(1)).alias("shown"))


def s6(spark, d):
    return C.numbered(v_images(spark, d).select("doc", "page", "pos"), ["doc"], ["page", "pos"], "rn").filter("rn between 25 and 48").select("doc", "page", "pos", "rn")


def s7(spark, d):
    return v_images(spark, d).groupBy("doc", "src").agg(F.min_by(F.struct("page", "pos"), F.struct("page", "pos")).alias("f")).select("doc", "src", "f.page", "f.pos")


def s5(spark, d):
    """Five best alternatives of each image by distance of page numbers, a page number of 0 counting as none."""
    cur = v_images(spark, d).filter("pos = 0").select(F.col("page").alias("id"), (F.col("page") % 40).alias("p"))
    files = v_images(spark, d).select("src").distinct().withColumn("fp", F.regexp_extract("src", "(?i)page_?(\\d+)", 1).cast("int"))
    # files by page number are a short list; the score only depends on the two numbers
    by_page = files.groupBy("fp").agg(F.slice(F.array_sort(F.collect_set("src")), 1, 5).alias("srcs"))
    diff = F.abs(F.col("fp") - F.col("p"))
    score = F.when((F.col("p") > 0) & (F.col("fp") > 0), F.when(diff == 0, 100).when(diff <= 2, 50).when(diff <= 5, 25).otherwise(10)).otherwise(5)
    pairs = cur.select("p").distinct().join(F.broadcast(by_page)).select("p", score.alias("score"), F.explode("srcs").alias("src"))
    best = pairs.withColumn("ix", F.row_number().over(Window.partitionBy("p").orderBy(F.col("score").desc(), "src"))).filter("ix <= 5")
    return cur.join(best, "p").select("id", "ix", "src", "score")


def x13(spark, d):
    ext = F.regexp_extract(F.lower("src"), "\\.([a-z]+)$", 1)
    mime = F.when(ext == "png", "image/png").when(ext == "svg", "image/svg+xml").when(ext.isin("jpg", "jpeg"), "image/jpeg").otherwise("application/octet-stream")
    data = F.regexp_replace(F.base64(F.encode("hash", "UTF-8")), "\\s", "")
    return v_images(spark, d).select("doc", "page", "pos", F.concat(F.lit("data:"), mime, F.lit(";base64,"), data).alias("uri"))


def x22(spark, d):
    uri = F.col("uri")
    p = "(?s)^data:([^;,]*)?(;base64)?,(.*)$"
    return x13(spark, d).select("doc", "page", "pos", F.regexp_extract(uri, p, 1).alias("mime"), F.decode(F.unbase64(F.regexp_extract(uri, p, 3)), "UTF-8").alias("data"))


def sk11(spark, d):
    ok = F.regexp_extract("uri", "^data:([^;,]*);base64,", 1)
    ext = F.when(ok == "image/png", ".png").when(ok == "image/jpeg", ".jpg").otherwise(".png")
    uri = F.when(F.col("page") % 5 == 0, F.concat(F.lit("data:image/jpeg;base64,"), F.lit("###"))).when(F.col("page") % 5 == 1, F.lit("data:image/png,raw")).otherwise(F.col("uri"))
    x = x13(spark, d).withColumn("uri", uri).withColumn("bytes", F.try_to_binary(F.regexp_extract("uri", "^data:[^;,]*;base64,(.*)$", 1), F.lit("base64")))
    good = F.col("uri").rlike("^data:[^;,]*;base64,") & F.col("bytes").isNotNull()
    return x.select("doc", "page", "pos", F.when(good, F.concat(F.md5("bytes"), ext)).alias("file"))


def a13(spark, d):
    t = X.strip_tags(F.col("html"))
    return v_html(spark, d).select("page_id", X.word_count(t).alias("n_words"), F.regexp_count("html", F.lit("<a ")).alias("n_links"), F.regexp_count("html", F.lit("<script")).alias("n_scripts"))


def a21(spark, d):
    return v_html(spark, d).groupBy(F.lit("th").alias("q")).agg(F.sum(F.regexp_count(F.lower(X.strip_tags(F.col("html"))), F.lit("\\Qth\\E"))).cast("long").alias("hits"))


def w21(spark, d):
    # counted in a step of its own: texts are split once, however often the number is used
    counted = v_chapters(spark, d).select("pos", X.word_count(F.col("text")).alias("n"))
    n = F.col("n")
    return counted.select("pos", F.when(n > 0, F.pmod(F.lit(-1), n)).alias("prev_of_first"), F.when(n > 0, F.pmod(n, n)).alias("next_of_last"))


def g6(spark, d):
    return v_chapters(spark, d).select("pos", F.explode(F.sequence(F.lit(0), F.col("n_chars").cast("int"), F.lit(20))).alias("y"))


def x27(spark, d):
    names = F.element_at(F.array(*map(F.lit, ("Purple", "BLUE", "green", "tEAL", "red", "Orange", "gray"))), (F.col("pos") % 7 + 1).cast("int"))
    return v_chapters(spark, d).select("pos", theme_css(names).alias("css"))


def j16(spark, d):
    table = F.create_map(*[F.lit(x) for kv in {"ko": "일치 없음", "en": "No matches"}.items() for x in kv])
    lang = F.element_at(F.array(*map(F.lit, ("ko", "en", "fr"))), (F.col("pos") % 3 + 1).cast("int"))
    return v_chapters(spark, d).select("pos", F.coalesce(table[lang], table[F.lit("ko")]).alias("no_match"))


def j14(spark, d):
    return x2(spark, d).filter("sid like 'id-%'")


def j15(spark, d):
    """Model names: an exact match, else the first with the same base name."""
    have = spark.createDataFrame([(0, "corvid2.1:7b"), (1, "corvid2.1:35b-half"), (2, "heron:8b"), (3, "plover")], "ix int, name string")
    want = F.element_at(F.array(*map(F.lit, ("corvid2.1:35b", "heron:8b", "plover:2b", "wren"))), (F.col("pos") % 4 + 1).cast("int"))
    asked = v_chapters(spark, d).select("pos", want.alias("want"))
    base = lambda c: F.regexp_replace(c, ":.*$", "")
    hit = asked.join(F.broadcast(have), base(F.col("want")) == base(F.col("name")), "left")
    return hit.groupBy("pos", "want").agg(F.min_by("name", F.struct((F.col("name") != F.col("want")).alias("a"), "ix")).alias("name"))


REPEATED = """pages_n AS (SELECT doc, count(DISTINCT page) AS np FROM {0} GROUP BY doc),
rep AS (SELECT doc, k FROM (SELECT doc, {1} AS k, count(DISTINCT page) AS n FROM {0} WHERE {2} GROUP BY ALL) JOIN pages_n USING (doc) WHERE np >= 2 AND k <> '' AND n >= greatest(2, round_even(np * 0.02, 0)))"""
NAT = "list_transform(regexp_extract_all(lower({0}), '\\d+|\\D+'), lambda r: CASE WHEN regexp_matches(r, '^\\d') THEN lpad(r, 20, '0') ELSE r END)"
SRC = "'images/page_' || (page % 40) || '_' || substr(md5(line), 1, 2) || '.png'"
SLUG = "CASE WHEN {0} = '' THEN 'section' ELSE {0} END"


def slug_sql(c: str) -> str:
    made = f"regexp_replace(lower({STRIP.format('regexp_replace(strip_accents(' + c + '), ' + chr(39) + '[^\\p{L}\\p{N}_\\s-]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}), '[\\s_]+', '-', 'g')"
    return SLUG.format(made)


HREFS = "hrefs AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS ix FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM v_html))"
CONV = """conv AS (SELECT *, CASE WHEN top = '' AND coalesce(try_cast(nullif(regexp_extract(path, '^(\\d+)', 1), '') AS INT), 0) < 50 THEN 0 WHEN regexp_matches(top, '^Part_[IVX]+_') THEN 1 WHEN top = '' THEN 2 WHEN lower(top) = 'appendix' THEN 3 END AS section,
 regexp_extract(top, '^Part_([IVX]+)_', 1) AS part FROM (SELECT *, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS top FROM v_chapters)),
 ordered AS (SELECT pos, path, section, CASE WHEN section = 1 THEN part || '부. ' || replace(regexp_extract(top, '^Part_[IVX]+_(.*)$', 1), '_', ' ') WHEN section = 3 THEN 'Appendix' END AS label,
 row_number() OVER (ORDER BY section, CASE WHEN section = 1 THEN coalesce(list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X'], part), 99) ELSE 0 END, """ + NAT.format("path") + """, path, pos) AS pos_out FROM conv WHERE section IS NOT NULL)"""

ALL = {
    "a2_repeated_line_removal": (a2, with_views(f"""WITH {REPEATED.format('v_lines', STRIP.format('line'), "NOT regexp_matches(" + STRIP.format('line') + ", '^\\|.*\\|$')")},
 kept AS (SELECT doc, page, string_agg(line, chr(10) ORDER BY ln) AS text FROM v_lines l WHERE regexp_matches({STRIP.format('line')}, '^\\|.*\\|$') OR NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc = l.doc AND r.k = {STRIP.format('l.line')}) GROUP BY ALL)
 SELECT doc, page, coalesce(text, '') AS text FROM (SELECT DISTINCT doc, page FROM v_lines) LEFT JOIN kept USING (doc, page)""", "v_lines")),
    "a3_repeated_images": (a3, with_views(f"WITH {REPEATED.format('v_images', 'hash', 'true')} SELECT doc, page, pos, hash FROM v_images i WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc = i.doc AND r.k = i.hash)", "v_images")),
    "a4_bullet_chars": (a4, with_views("SELECT doc, lower(ch) AS ch, count(*) AS n FROM (SELECT doc, regexp_extract(trim(CASE WHEN ln % 3 = 0 THEN substr(line, 1, 1) || ' ' || line ELSE line END), '^([A-Za-z\\x{e000}-\\x{f8ff}])\\s+\\S', 1) AS ch FROM v_lines) WHERE lower(ch) NOT IN ('', 'a', 'i') GROUP BY ALL HAVING count(*) >= 5", "v_lines")),
    "a19_ordered_concat": (a19, with_views("SELECT page, string_agg(line, chr(10) || chr(10) ORDER BY ln) AS text FROM v_lines GROUP BY page", "v_lines")),
    "g2_lines": (g2, with_views("SELECT page, ln, line FROM v_lines", "v_lines")),
    "g3_paragraphs": (g3, with_views("SELECT page, ln::INT AS ln, unnest(p) AS para, (generate_subscripts(p, 1) - 1)::INT AS ix FROM (SELECT page, ln, string_split(replace(line, ' the ', chr(10) || chr(10) || chr(10) || 'the '), chr(10) || chr(10)) AS p FROM v_lines)", "v_lines")),
    "u6_distinct_lines": (u6, with_views(f"SELECT DISTINCT doc, page, {STRIP.format('line')} AS line FROM v_lines", "v_lines")),
    "u5_set_difference": (u5, with_views("SELECT doc, page, pos, hash FROM v_images WHERE hash NOT IN (SELECT hash FROM v_images WHERE page % 7 = 0)", "v_images")),
    "u1_union_words_images": (u1, with_views("SELECT page, line AS text, 72.0::DOUBLE AS x0, ln::DOUBLE AS top FROM v_lines UNION ALL SELECT page, '![](' || src || ')', 0.0, NULL FROM v_images", "v_images")),
    "sk9_image_files": (sk9, with_views("SELECT doc, page, pos, printf('page%04d_img%d.png', page, row_number() OVER w) AS file, '![](images/' || printf('page%04d_img%d.png', page, row_number() OVER w) || ')' AS text FROM v_images WINDOW w AS (PARTITION BY doc, page ORDER BY pos)", "v_images")),
    "f8_tiny_images": (f8, with_views("SELECT doc, page, pos, width, height FROM v_images WHERE NOT (width < 20 OR height < 20)", "v_images")),
    "j4_image_positions": (j4, with_views("SELECT i.page, i.pos, i.name, last.hash FROM (SELECT page, pos, regexp_replace(src, '\\.[^.]*$', '') AS name FROM v_images) i JOIN (SELECT page, regexp_replace(src, '\\.[^.]*$', '') AS name, hash FROM v_images QUALIFY row_number() OVER (PARTITION BY page, src ORDER BY pos DESC) = 1) last USING (page, name)", "v_images")),
    "j5_zip_join": (j5, with_views("SELECT l.page, l.ln::INT AS ix, l.line, i.hash FROM v_lines l JOIN v_images i ON i.page = l.page AND i.pos = l.ln", "v_images")),
    "s1_natural_sort": (s1, with_views(f"SELECT pos, path, row_number() OVER (PARTITION BY CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END ORDER BY {NAT.format('path')}, pos)::INT AS rank FROM v_chapters", "v_chapters")),
    "s2_roman_rank": (s2, with_views("SELECT pos, CASE regexp_extract(path, '^Part_([A-Z]+)_', 1) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'IV' THEN 4 WHEN 'X' THEN 10 ELSE 99 END AS rank FROM v_chapters", "v_chapters")),
    "s3_front_back": (s3, with_views("SELECT pos, CASE WHEN regexp_matches(path, '(^|/)[0-9]+[^/]*$') AND regexp_extract(path, '(^|/)([0-9]+)[^/]*$', 2)::INT >= 50 THEN 'back' ELSE 'front' END AS side FROM v_chapters", "v_chapters")),
    "sc6_convention_order": (sc6, with_views(f"WITH {CONV} SELECT * FROM ordered", "v_chapters")),
    "u3_section_union": (u3, with_views(f"WITH {CONV} SELECT section, count(*) AS n, min(pos_out) AS first, max(pos_out) AS last FROM ordered GROUP BY section", "v_chapters")),
    "sc2_explicit_order": (sc2, with_views("SELECT ix::INT AS pattern_ix, path FROM (SELECT DISTINCT path FROM v_chapters) JOIN (VALUES (0, '^Part_I_[^/]*/Chapter_0[^/]_src[1-3]\\.md$'), (1, '^Appendix/[^/]*\\.md$'), (2, '^00_top_src0\\.md$'), (3, '^Part_I_[^/]*/Chapter_02[^/]*\\.md$')) p(ix, re) ON regexp_matches(path, re)", "v_chapters")),
    "sc8_split_targets": (sc8, with_views("SELECT DISTINCT path FROM v_chapters WHERE path LIKE 'Part_X_%/%.md' OR path LIKE 'Appendix/%.md'", "v_chapters")),
    "j17_split_membership": (j17, with_views("SELECT pos, path, path LIKE 'Part\\_X\\_%/%.md' ESCAPE '\\' OR path LIKE 'Appendix/%.md' AS is_target FROM v_chapters", "v_chapters")),
    "f1_exclude_globs": (f1, with_views("SELECT pos, path FROM (SELECT *, string_split(path, '/')[-1] AS n FROM v_chapters) WHERE NOT n GLOB '*_src1.md' AND NOT n GLOB 'Chapter_?_src2.md' AND NOT n GLOB '[0-4]*_top_*'", "v_chapters")),
    "x3_nfc": (x3, with_views("SELECT pos, nfc_normalize(title) AS title FROM v_chapters", "v_chapters")),
    "x1_slug": (x1, with_views(f"SELECT pos, {slug_sql('s')} AS slug FROM (SELECT pos, title || ' ' || text AS s FROM v_chapters)", "v_chapters")),
    "w1_dedupe_suffix": (w1, with_views("SELECT pos, title, CASE WHEN n = 1 THEN '' ELSE '-' || n END AS suffix FROM (SELECT pos, title, row_number() OVER (PARTITION BY title ORDER BY pos) AS n FROM v_chapters)", "v_chapters")),
    "x2_section_id": (x2, with_views(f"""WITH b AS (SELECT pos, CASE WHEN pos % 11 = 0 THEN 'id-' || pos ELSE {slug_sql('s')} END AS base FROM (SELECT pos, CASE WHEN pos % 5 = 0 THEN regexp_extract(path, '([^/]*)\\.md$', 1) ELSE title END AS s FROM v_chapters))
 SELECT pos, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS sid FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS n FROM b)""", "v_chapters")),
    "j14_id_override": (j14, with_views("SELECT pos, 'id-' || pos AS sid FROM v_chapters WHERE pos % 11 = 0", "v_chapters")),
    "w3_toc_headings": (w3, with_views("SELECT pos, part_label AS heading FROM (SELECT pos, part_label, last_value(part_label IGNORE NULLS) OVER (PARTITION BY pos // 100 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM v_chapters) WHERE part_label IS NOT NULL AND part_label IS DISTINCT FROM p", "v_chapters")),
    "w4_outline_headings": (w4, with_views("SELECT pos, part_label AS heading FROM (SELECT pos, part_label, lag(part_label) OVER (PARTITION BY pos // 100 ORDER BY pos) AS p FROM v_chapters) WHERE part_label IS NOT NULL AND part_label IS DISTINCT FROM p", "v_chapters")),
    "w5_page_offsets": (w5, with_views("SELECT a.pos, ceil(a.n_chars / 2000)::BIGINT AS page_count, coalesce((SELECT sum(ceil(b.n_chars / 2000)) FROM v_chapters b WHERE b.pos // 100 = a.pos // 100 AND b.pos < a.pos), 0)::BIGINT AS \"offset\" FROM v_chapters a", "v_chapters")),
    "sk3_outline": (sk3, with_views("""WITH o AS (SELECT pos // 100 AS book, pos, title, part_label, coalesce(sum(ceil(n_chars / 2000)) OVER (PARTITION BY pos // 100 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", lag(part_label) OVER (PARTITION BY pos // 100 ORDER BY pos) AS p FROM v_chapters)
 SELECT book, pos, 0 AS depth, part_label AS title, "offset" FROM o WHERE part_label IS NOT NULL AND part_label IS DISTINCT FROM p UNION ALL SELECT book, pos, CASE WHEN part_label IS NULL THEN 0 ELSE 1 END, title, "offset" FROM o""", "v_chapters")),
    "a1_duplicate_titles": (a1, with_views("SELECT regexp_extract(path, '(src\\d+)\\.md$', 1) AS source, title, count(*) AS n, string_agg(path, ';' ORDER BY pos) AS paths FROM v_chapters WHERE title <> '' GROUP BY ALL HAVING count(*) > 1", "v_chapters")),
    "x4_raw_h1": (x4, with_views("SELECT pos, CASE WHEN pos % 3 = 0 THEN NULL ELSE title END AS h1 FROM v_chapters", "v_chapters")),
    "x5_first_h1": (x5, with_views(f"SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<h1[^>]*>.*?</h1>') THEN {STRIP.format('regexp_replace(regexp_extract(html, ' + chr(39) + '(?s)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1), ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} END AS h1 FROM v_html", "v_html")),
    "x6_demote_headings": (x6, with_views("WITH m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(</?h)4([\\s>])', '\\15\\2', 'g'), '(</?h)3([\\s>])', '\\14\\2', 'g'), '(</?h)2([\\s>])', '\\13\\2', 'g'), '(</?h)1([\\s>])', '\\12\\2', 'g') AS h FROM v_html) SELECT page_id, md5(h) AS digest, len(regexp_extract_all(h, '<h2'))::INT AS n_h2 FROM m", "v_html")),
    "x7_promote_headings": (x7, with_views("WITH m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(</?h)2([\\s>])', '\\1@3\\2', 'g'), '(</?h)1([\\s>])', '\\12\\2', 'g') AS h FROM v_html) SELECT page_id, md5(replace(replace(h, '<h@3', '<h3'), '</h@3', '</h3')) AS digest FROM m", "v_html")),
    "x8_strip_tags": (x8, with_views("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM v_html", "v_html")),
    "x9_wrap_tables": (x9, with_views("SELECT page_id, md5(replace(replace(html, '<nav>', '<div class=\"table-wrap\"><table>'), '</nav>', '</table></div>')) AS digest FROM v_html", "v_html")),
    "x10_html_escape": (x10, with_views("SELECT page_id, md5(replace(html_escape(html, true), '&#039;', '&#x27;')) AS digest FROM (SELECT page_id, html FROM v_html)".replace("replace(html_escape(html, true), '&#039;', '&#x27;')", "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"), "v_html")),
    "x11_unlink_files": (x11, with_views("SELECT page_id, md5(regexp_replace(regexp_replace(html, 'href=\"/([^\"]*)\"', 'href=\"/\\1.md#x\"', 'g'), '<a href=\"[^\":#]*\\.md(#[^\"]*)?\">(.*?)</a>', '\\2', 'g')) AS digest FROM v_html", "v_html")),
    "x12_image_paths": (x12, with_views("SELECT page_id, md5(replace(html, '<a href=\"/', '<img src=\"file:///book/img/')) AS digest FROM v_html", "v_html")),
    "g5_find_all": (g5, with_views(f"WITH {HREFS} SELECT page_id, ix::INT AS ix, href FROM hrefs", "v_html")),
    "f15_link_classes": (f15, with_views(f"WITH {HREFS} SELECT page_id, ix::INT AS ix, CASE ix % 3 WHEN 0 THEN 'skip' WHEN 1 THEN CASE WHEN regexp_matches(href, '^(https?://|data:|#|mailto:)') THEN 'skip' WHEN contains(href, '#') THEN 'other' ELSE 'internal' END ELSE CASE WHEN regexp_matches(href, '^(https?://|data:|#|mailto:)') THEN 'skip' ELSE 'other' END END AS kind FROM hrefs", "v_html")),
    "f16_image_classes": (f16, with_views(f"WITH {HREFS}, s AS (SELECT page_id, ix, ['https://','data:','file://','#',''][ix % 5 + 1] || href AS src FROM hrefs) SELECT page_id, ix::INT AS ix, regexp_matches(src, '^(http://|https://|data:|file://|#)') AS skip_html, regexp_matches(src, '^(http://|https://|data:|file://)') AS skip_pdf, regexp_matches(src, '^(http://|https://|data:|#)') AS skip_check FROM s", "v_html")),
    "j1_internal_links": (j1, with_views(f"""WITH {HREFS}, l AS (SELECT page_id, ix, CASE ix % 4 WHEN 0 THEN href WHEN 1 THEN '../Appendix/./A' || (page_id * 13 % 500) || '_src' || (page_id * 13 % 20) || '.md#top' WHEN 2 THEN 'absent.md' ELSE 'https://x.org' || href END AS href,
 'Appendix/A' || (page_id * 13 % 500) || '_src' || (page_id * 13 % 20) || '.md' AS p FROM hrefs), f AS (SELECT path, min(pos) AS pos FROM v_chapters GROUP BY path)
 SELECT page_id, ix::INT AS ix, href, CASE WHEN ix % 4 = 1 AND f.pos IS NOT NULL THEN '#sec-' || f.pos ELSE href END AS target FROM l LEFT JOIN f ON f.path = l.p""", "v_html", "v_chapters")),
    "j2_first_piece": (j2, with_views("SELECT path, title AS sid, pos FROM v_chapters QUALIFY row_number() OVER (PARTITION BY path ORDER BY pos) = 1", "v_chapters")),
    "j3_missing_images": (j3, with_views("SELECT doc, page, pos, src FROM v_images WHERE src NOT IN (SELECT src FROM v_images WHERE page % 3 <> 0)", "v_images")),
    "sk13_report": (sk13, with_views("SELECT (SELECT count(*) FROM v_chapters) AS n_chapters, (SELECT count(*) FROM (SELECT title FROM v_chapters GROUP BY title HAVING count(*) > 1)) AS n_duplicates, (SELECT count(*) FROM v_images WHERE src NOT IN (SELECT src FROM v_images WHERE page % 3 <> 0)) AS n_missing", "v_images", "v_chapters")),
    "j6_manifest_lookup": (j6, with_views("""WITH r AS (SELECT pos, ((pos // 10) % 12)::VARCHAR AS n, (pos % 7)::VARCHAR AS c FROM v_chapters), f AS (SELECT DISTINCT path FROM v_chapters WHERE contains(path, '/'))
 SELECT pos, min(path) AS path FROM r JOIN f ON regexp_matches(path, '^Part_?0*(' || n || '|' || coalesce(['I','II','III','IV','V','VI','VII','VIII','IX','X'][nullif(n::INT, 0)], n) || ')\\D') AND regexp_matches(path, '/Chapter_?0*' || c || '\\D') GROUP BY pos""", "v_chapters")),
    "w9_interval_union": (w9, with_views("""WITH i AS (SELECT *, CASE WHEN y0 > max(y1) OVER (PARTITION BY id ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM v_bands),
 k AS (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS g FROM i) SELECT id, min(y0) AS y0, max(y1) AS y1 FROM k GROUP BY id, g""", "v_bands")),
    "sc16_gallery": (sc16, with_views("WITH g AS (SELECT DISTINCT src FROM v_images WHERE contains(lower(src), 'a')) SELECT src, (SELECT count(*) FROM g) AS total, greatest(1, ceil((SELECT count(*) FROM g) / 24))::BIGINT AS pages FROM g ORDER BY src LIMIT 24 OFFSET 24", "v_images")),
    "a16_gallery_totals": (a16, with_views("WITH g AS (SELECT DISTINCT src FROM v_images WHERE contains(lower(src), 'a')) SELECT count(*) AS total, ceil(count(*) / 24)::BIGINT AS pages, least(24, count(*) - 24)::BIGINT AS shown FROM g", "v_images")),
    "s6_pagination": (s6, with_views("SELECT doc, page, pos, row_number() OVER (PARTITION BY doc ORDER BY page, pos)::INT AS rn FROM v_images QUALIFY rn BETWEEN 25 AND 48", "v_images")),
    "s7_first_match": (s7, with_views("SELECT doc, src, page, pos FROM v_images QUALIFY row_number() OVER (PARTITION BY doc, src ORDER BY page, pos) = 1", "v_images")),
    "s5_alternatives": (s5, with_views("""WITH c AS (SELECT page AS id, page % 40 AS p FROM v_images WHERE pos = 0), f AS (SELECT DISTINCT src, regexp_extract(src, 'page_?(\\d+)', 1)::INT AS fp FROM v_images),
 s AS (SELECT p, src, CASE WHEN p > 0 AND fp > 0 THEN CASE WHEN p = fp THEN 100 WHEN abs(p - fp) <= 2 THEN 50 WHEN abs(p - fp) <= 5 THEN 25 ELSE 10 END ELSE 5 END AS score FROM (SELECT DISTINCT p FROM c) CROSS JOIN f),
 b AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, src) AS ix FROM s) SELECT id, ix::INT AS ix, src, score FROM c JOIN b USING (p) WHERE ix <= 5""", "v_images")),
    "x13_data_uri": (x13, with_views("SELECT doc, page, pos, 'data:image/png;base64,' || to_base64(encode(hash)) AS uri FROM v_images", "v_images")),
    "x22_data_uri_parse": (x22, with_views("SELECT doc, page, pos, 'image/png' AS mime, hash AS data FROM v_images", "v_images")),
    "sk11_data_uri_file": (sk11, with_views("SELECT doc, page, pos, CASE WHEN page % 5 < 2 THEN NULL ELSE md5(hash) || '.png' END AS file FROM v_images", "v_images")),
    "a13_section_stats": (a13, with_views("SELECT page_id, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '\\S+'))::INT AS n_words, len(regexp_extract_all(html, '<a '))::INT AS n_links, len(regexp_extract_all(html, '<script'))::INT AS n_scripts FROM v_html", "v_html")),
    "a21_search_hits": (a21, with_views("SELECT 'th' AS q, sum(len(regexp_extract_all(lower(regexp_replace(html, '<[^>]+>', '', 'g')), 'th')))::BIGINT AS hits FROM v_html", "v_html")),
    "w21_search_cursor": (w21, with_views("SELECT pos, CASE WHEN n > 0 THEN n - 1 END::INT AS prev_of_first, CASE WHEN n > 0 THEN 0 END::INT AS next_of_last FROM (SELECT pos, len(regexp_extract_all(text, '\\S+')) AS n FROM v_chapters)", "v_chapters")),
    "g6_ruler_rows": (g6, with_views("SELECT pos, unnest(range(0, n_chars + 1, 20))::INT AS y FROM v_chapters", "v_chapters")),
    "x27_theme_css": (x27, with_views(f"SELECT pos, '/* ── color theme: ' || c[1] || ' ── */' || chr(10) || ':root {{ --primary: ' || c[2] || '; --primary-light: ' || c[3] || '; --accent: ' || c[4] || '; }}' AS css FROM (SELECT pos, {[[k, *v] for k, v in THEMES.items()]}[pos % 7 + 1] AS c FROM v_chapters)", "v_chapters")),
    "j16_locale_lookup": (j16, with_views("SELECT pos, CASE WHEN pos % 3 = 1 THEN 'No matches' ELSE '일치 없음' END AS no_match FROM v_chapters", "v_chapters")),
    "j15_model_names": (j15, with_views("SELECT pos, ['corvid2.1:35b','heron:8b','plover:2b','wren'][pos % 4 + 1] AS want, ['corvid2.1:7b','heron:8b','plover',NULL][pos % 4 + 1] AS name FROM v_chapters", "v_chapters")),
}
