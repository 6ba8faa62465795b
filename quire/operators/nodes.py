"""Pages as node tables: an editor's view of images, diagrams and sections, saved edits and the export of sections.

A node (ix, last) is the range of its subtree in document order. Subtrees nest, so what encloses what, and what lies inside of
what, follows from sorted positions of a page: windows, not pairs of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import VOID_TAGS, section_markdown
from ..functions.text import ordered_concat, strip

# What an editor calls a diagram without a title, and an image without a heading above it.
DIAGRAM_TITLE = "다이어그램 "
NO_SECTION = "Unknown section"
RAW_TEXT = ("script", "style")


def has_class(name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), name)


def nearest_enclosing(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points (key, ix, more) with `inside`: the ix of the innermost interval (key, ix, last) around each, itself left out; null if none.

    Sorted along a page, starts go one level down and ends one level up. The innermost interval around a point is the last one that
    started at the point's level.
    """
    more = [c for c in points.columns if c not in (key, "ix")]
    carried = F.struct(*more) if more else F.struct(F.lit(0).alias("_none"))
    kind = dict(points.select(carried.alias("m")).dtypes)["m"]
    nothing = F.lit(None).cast(kind).alias("m")
    event = lambda at, rank, step, start, m: [F.col(key), F.col(at).alias("at"), F.lit(rank).alias("rank"), F.lit(step).alias("step"), start.alias("start"), m]
    none = F.lit(None).cast("int")
    events = points.select(*event("ix", 0, 0, none, carried.alias("m"))).unionByName(intervals.select(*event("ix", 1, 1, F.col("ix"), nothing))).unionByName(intervals.select(*event("last", 2, -1, none, nothing)))
    along = Window.partitionBy(key).orderBy("at", "rank")
    level = F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))
    at_level = Window.partitionBy(key, "level").orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("level", level).withColumn("inside", F.last("start", ignorenulls=True).over(at_level)).filter("rank = 0")
    return found.select(key, F.col("at").alias("ix"), *[F.col(f"m.{c}").alias(c) for c in more], F.when(F.col("level") > 0, F.col("inside")).alias("inside"))


def first_inside(intervals: DataFrame, marks: DataFrame, key: str, name: str) -> DataFrame:
    """intervals (key, ix, last, more) with `name`: the ix of the first mark (key, ix) within each, null if there is none."""
    more = [c for c in intervals.columns if c not in (key, "ix", "last")]
    both = intervals.withColumn("_mark", F.lit(None).cast("int")).unionByName(marks.select(key, "ix", F.col("ix").alias("_mark")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("ix").desc(), F.col("_mark").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    ahead = both.withColumn("_next", F.min("_mark").over(w)).filter("_mark is null")
    return ahead.select(key, "ix", "last", *more, F.when(F.col("_next") <= F.col("last"), F.col("_next")).alias(name))


def texts_of(nodes: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, ix, said): the pieces of text in each target (key, ix, last), stripped each and joined. Targets don't nest."""
    pieces = nodes.filter("tag = '#text'").select(key, "ix", "text")
    inside = nearest_enclosing(pieces, targets.select(key, "ix", "last"), key).filter("inside is not null")
    said = inside.groupBy(key, F.col("inside").alias("ix")).agg(ordered_concat(strip(F.col("text")), [F.col("ix")], "").alias("said"))
    return targets.select(key, "ix").join(said, [key, "ix"], "left").withColumn("said", F.coalesce("said", F.lit("")))


def _headed(points: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """points with `section`: the first heading (h1 to h3) of the nearest section or div that has one."""
    headings = nodes.filter("tag in ('h1', 'h2', 'h3')").select(key, "ix", "last")
    holders = first_inside(nodes.filter("tag in ('section', 'div')").select(key, "ix", "last"), headings.select(key, "ix"), key, "heading").filter("heading is not null")
    placed = nearest_enclosing(points, holders.select(key, "ix", "last"), key)
    said = holders.select(key, F.col("ix").alias("inside"), "heading").join(texts_of(nodes, headings, key).withColumnRenamed("ix", "heading"), [key, "heading"]).select(key, "inside", F.col("said").alias("section"))
    return placed.join(said, [key, "inside"], "left").withColumn("section", F.coalesce("section", F.lit(NO_SECTION))).drop("inside")


def images(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ix, n, src, alt, caption, section, page_no, figure): images in document order, with what surrounds them."""
    img = nodes.filter("tag = 'img'")
    n = F.row_number().over(Window.partitionBy(key).orderBy("ix"))
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit("")).alias(name)
    img = img.select(key, "ix", n.alias("n"), attr("src"), attr("alt"))
    captions = nodes.filter("tag = 'figcaption'").select(key, "ix", "last")
    figures = first_inside(nodes.filter("tag = 'figure'").select(key, "ix", "last"), captions.select(key, "ix"), key, "mark")
    framed = nearest_enclosing(img, figures.select(key, "ix", "last"), key).withColumnRenamed("inside", "figure")
    caption = figures.select(key, F.col("ix").alias("figure"), "mark").join(texts_of(nodes, captions, key).withColumnRenamed("ix", "mark"), [key, "mark"]).select(key, "figure", F.col("said").alias("caption"))
    told = _headed(framed.join(caption, [key, "figure"], "left").withColumn("caption", F.coalesce("caption", F.lit(""))), nodes, key)
    number = lambda c: F.nullif(F.regexp_extract(F.col(c), r"(?i)page\s+(\d+)", 1), F.lit("")).cast("decimal(38,0)")
    return told.select(key, "ix", "n", "src", "alt", "caption", "section", F.coalesce(number("alt"), number("caption")).cast("long").alias("page_no"), "figure")


def diagrams(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ix, n, title, kind, code, section, holder): diagrams in document order; holder is the frame that goes with one."""
    own = nodes.filter((F.col("tag") == "div") & has_class("mermaid")).select(key, "ix", "last")
    n = F.row_number().over(Window.partitionBy(key).orderBy("ix"))
    heads = nodes.filter("tag = 'h4'").select(key, "ix", "last")
    frames = first_inside(nodes.filter((F.col("tag") == "div") & has_class("my-8")).select(key, "ix", "last"), heads.select(key, "ix"), key, "mark")
    placed = nearest_enclosing(own.select(key, "ix", n.alias("n")), frames.select(key, "ix", "last"), key).withColumnRenamed("inside", "holder")
    titles = frames.select(key, F.col("ix").alias("holder"), "mark").join(texts_of(nodes, heads, key).withColumnRenamed("ix", "mark"), [key, "mark"]).select(key, "holder", F.col("said").alias("title"))
    code = texts_of(nodes, own, key).withColumnRenamed("said", "code")
    told = _headed(placed.join(titles, [key, "holder"], "left").join(code, [key, "ix"]), nodes, key)
    word = F.lower(F.regexp_extract("code", r"(?U)(\S+)", 1))
    title = F.coalesce("title", F.concat(F.lit(DIAGRAM_TITLE), F.col("n").cast("string")))
    return told.select(key, "ix", "n", title.alias("title"), F.when(word == "", "diagram").otherwise(word).alias("kind"), "code", "section", F.coalesce("holder", "ix").alias("holder"))


def elements(nodes: DataFrame, key: str) -> DataFrame:
    """(key, display_index, kind, n, title, section, extra): images and diagrams together, in document order."""
    shown = F.when(F.col("alt") != "", F.col("alt")).when(F.col("caption") != "", F.col("caption")).otherwise(F.lit("설명 없음"))
    page = F.when(F.col("page_no") != 0, F.concat(F.lit("p."), F.col("page_no").cast("string"))).otherwise(F.lit("-"))
    both = images(nodes, key).select(key, "ix", F.lit("image").alias("kind"), "n", F.substring(shown, 1, 50).alias("title"), "section", page.alias("extra"))
    both = both.unionByName(diagrams(nodes, key).select(key, "ix", F.lit("diagram").alias("kind"), "n", F.substring("title", 1, 50).alias("title"), "section", F.col("kind").alias("extra")))
    return both.select(key, F.row_number().over(Window.partitionBy(key).orderBy("ix")).alias("display_index"), "kind", "n", "title", "section", "extra")


def visuals_of(sections: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, id, display_index): the elements whose section text holds the beginning of a section's title, without its number."""
    start = F.substring(F.regexp_replace("title", r"^\d+\.\s*", ""), 1, 20)
    named = sections.select(key, "id", start.alias("start"))
    # titles repeat among elements: each section meets each distinct section text of its page once
    said = shown.select(key, "section").distinct().join(named, key).filter(F.contains("section", "start")).select(key, "id", "section")
    return shown.join(said, [key, "section"]).select(key, "id", "display_index")


def sections(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ix, last, n, id, title, word_count, image_count, diagram_count) of sections that have an id and an h2.

    Counts are differences of running counts at the two ends of a section, so sections may nest.
    """
    words = F.when(F.col("tag") == "#text", F.size(F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), F.lit(1)))).otherwise(0)
    along = Window.partitionBy(key).orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    running = nodes.select(key, "ix", *[F.sum(c).over(along).alias(k) for k, c in (("words", words), ("imgs", (F.col("tag") == "img").cast("int")), ("dgms", ((F.col("tag") == "div") & has_class("mermaid")).cast("int")))])
    ends = running.select(key, F.col("ix").alias("last"), F.col("words").alias("w"), F.col("imgs").alias("i"), F.col("dgms").alias("d"))
    named = headed_sections(nodes, key).join(running.select(key, "ix", "words", "imgs", "dgms"), [key, "ix"]).join(ends, [key, "last"])
    counts = [(F.col(end) - F.col(start)).alias(name) for end, start, name in (("w", "words", "word_count"), ("i", "imgs", "image_count"), ("d", "dgms", "diagram_count"))]
    return named.select(key, "ix", "last", "n", "id", "title", *counts, "head")


def headed_sections(nodes: DataFrame, key: str) -> DataFrame:
    """(key, ix, last, n, id, title, head): sections that have an id and an h2; n counts those with an id, head is the first h2."""
    own = nodes.filter("tag = 'section' and attrs['id'] is not null").select(key, "ix", "last", F.col("attrs")["id"].alias("id"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ix")))
    heads = nodes.filter("tag = 'h2'").select(key, "ix", "last")
    headed = first_inside(own, heads.select(key, "ix"), key, "head").filter("head is not null")
    said = texts_of(nodes, heads, key).select(key, F.col("ix").alias("head"), F.col("said").alias("title"))
    return headed.join(said, [key, "head"]).select(key, "ix", "last", "n", "id", "title", "head")


# --- edits ----------------------------------------------------------------------------------------------------------------


def without(nodes: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Nodes that lie in none of the subtrees `gone` (key, ix, last): the rows that no open range covers."""
    starts = gone.select(key, F.col("ix").alias("at"), F.lit(0).alias("rank"), F.lit(1).alias("step"), F.lit(None).cast("struct<parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,last:int>").alias("m"))
    ends = gone.select(key, F.col("last").alias("at"), F.lit(2).alias("rank"), F.lit(-1).alias("step"), F.lit(None).cast("struct<parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,last:int>").alias("m"))
    rows = nodes.select(key, F.col("ix").alias("at"), F.lit(1).alias("rank"), F.lit(0).alias("step"), F.struct("parent", "depth", "tag", "attrs", "text", "last").alias("m"))
    along = Window.partitionBy(key).orderBy("at", "rank").rowsBetween(Window.unboundedPreceding, 0)
    left = rows.unionByName(starts).unionByName(ends).withColumn("open", F.sum("step").over(along)).filter("rank = 1 and open = 0")
    return left.select(key, F.col("at").alias("ix"), "m.*")


def patched(nodes: DataFrame, patch: DataFrame, key: str, attribute: str) -> DataFrame:
    """Nodes whose attribute is replaced, or set, by a patch (key, ix, value)."""
    both = nodes.join(patch.select(key, "ix", F.col("value").alias("_value")), [key, "ix"], "left")
    here = F.map_contains_key("attrs", F.lit(attribute))
    put = F.transform_values("attrs", lambda k, v: F.when(k == attribute, F.col("_value")).otherwise(v))
    changed = F.when(F.col("_value").isNull(), F.col("attrs")).when(here, put).otherwise(F.map_concat("attrs", F.create_map(F.lit(attribute), F.col("_value"))))
    return both.withColumn("attrs", changed).select(*nodes.columns)


def saved(nodes: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Nodes after edits (key, kind, n, op, value) of images and diagrams by their number.

    Deleting an image takes its figure along, deleting a diagram its frame; replacing an image sets its src to value. An image
    that is deleted isn't replaced; numbers that don't exist do nothing, and the last of several equal edits isn't told apart.
    """
    img, dgm = images(nodes, key), diagrams(nodes, key)
    targets = img.select(key, F.lit("image").alias("kind"), "n", "ix", F.coalesce("figure", "ix").alias("holder")).unionByName(dgm.select(key, F.lit("diagram").alias("kind"), "n", "ix", "holder"))
    meant = edits.join(targets, [key, "kind", "n"])
    gone = meant.filter("op = 'delete'").select(key, F.col("holder").alias("ix")).distinct().join(nodes.select(key, "ix", "last"), [key, "ix"])
    patch = meant.filter("op = 'replace' and kind = 'image'").groupBy(key, "ix").agg(F.max("value").alias("value"))
    return without(patched(nodes, patch, key, "src"), gone, key)


def escape_html(c: Column, quote: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quote else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_of(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, html): the pages that nodes stand for. Start tags sort by ix, end tags after the last node of their subtree, inner ones first."""
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_html(e["value"], True), F.lit('"'))), "")
    void = F.col("tag").isin(*VOID_TAGS)
    raw = F.coalesce(F.col("ptag").isin(*RAW_TEXT), F.lit(False))
    start = (
        F.when((F.col("tag") == "#text") & raw, F.col("text")).when(F.col("tag") == "#text", escape_html(F.col("text"))).when(F.col("tag") == "#comment", F.concat(F.lit("<!--"), "text", F.lit("-->")))
        .when(F.col("tag") == "#decl", F.concat(F.lit("<!"), "text", F.lit(">"))).otherwise(F.concat(F.lit("<"), "tag", attrs, F.when(void, "/>").otherwise(">")))
    )
    # nothing but text stands in a script or style, so that the last one ahead is the parent or none is
    ahead = Window.partitionBy(*by).orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    last_raw = F.last(F.when(F.col("tag").isin(*RAW_TEXT), F.struct("ix", "tag")), ignorenulls=True).over(ahead)
    full = nodes.withColumn("_raw", last_raw).withColumn("ptag", F.when(F.col("_raw.ix") == F.col("parent"), F.col("_raw.tag")))
    event = lambda at, rank, up, said: F.struct(at.cast("int").alias("at"), F.lit(rank).alias("rank"), up.cast("int").alias("up"), said.alias("s"))
    closing = F.when(~F.col("tag").startswith("#") & ~void, event(F.col("last"), 1, -F.col("depth"), F.concat(F.lit("</"), "tag", F.lit(">"))))
    events = full.select(*by, F.explode(F.array(event(F.col("ix"), 0, F.lit(0), start), closing)).alias("e")).filter("e is not null").select(*by, "e.*")
    return events.groupBy(*by).agg(ordered_concat(F.col("s"), [F.col("at"), F.col("rank"), F.col("up")], "").alias("html"))


# --- export ---------------------------------------------------------------------------------------------------------------


_DATA_URI = r"^data:([^;,]*)(;base64)?,([A-Za-z0-9+/=\s]*)$"
# Endings of the images that books hold.
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp", "application/octet-stream": ".bin"}


def exported(nodes: DataFrame, key: str) -> DataFrame:
    """(key, path, kind, content): the sections of books as Markdown files, and the images in them that came as data.

    Files go by the section's number and id; headings rise by one level, the section's own becomes the title. An image whose data
    can't be read stays where it is. Content of images is base64.
    """
    ids = headed_sections(nodes, key).withColumnRenamed("ix", "sec")
    # places only: attributes and texts are moved once, when it is known where they belong
    inner = nearest_enclosing(nodes.select(key, "ix"), ids.select(key, F.col("sec").alias("ix"), "last"), key).filter("inside is not null").withColumnRenamed("inside", "sec")
    data = nodes.filter("tag = 'img'").select(key, "ix", F.col("attrs")["src"].alias("src")).filter(F.col("src").startswith("data:"))
    data = data.join(inner, [key, "ix"]).join(ids.select(key, "sec", "id"), [key, "sec"])
    data = data.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("ix"))).filter(F.col("src").rlike(_DATA_URI) & F.col("src").contains(";base64,"))
    mime = F.regexp_extract("src", _DATA_URI, 1)
    ending = F.coalesce(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.when(mime == "", "application/octet-stream").otherwise(mime)], F.lit(".png"))
    data = data.withColumn("value", F.concat(F.lit("images/"), "id", F.lit("-"), F.col("k").cast("string"), ending)).withColumn("bytes", F.regexp_replace(F.regexp_extract("src", _DATA_URI, 3), r"\s", ""))
    # the first h2 of a section is that of the innermost section around it too; a range from the place before it holds the h2 itself
    heads = nodes.filter("tag = 'h2'").select(key, F.col("ix").alias("head"), "last").join(ids.select(key, "head").distinct(), [key, "head"])
    below = nearest_enclosing(inner, heads.select(key, (F.col("head") - 1).alias("ix"), "last"), key).filter("inside is null").drop("inside")
    placed = below.join(data.select(key, "ix", "value"), [key, "ix"], "left")
    kept = nodes.join(placed, [key, "ix"])
    src = F.transform_values("attrs", lambda k, v: F.when(k == "src", F.col("value")).otherwise(v))
    kept = kept.withColumn("attrs", F.when(F.col("value").isNull(), F.col("attrs")).otherwise(src))
    body = html_of(kept, [key, "sec"])
    texts = ids.join(body, [key, "sec"], "left").select(key, F.format_string("%03d_%s.md", "n", "id").alias("path"), F.lit("chapter").alias("kind"), F.concat(F.lit("# "), "title", F.lit("\n\n"), section_markdown(F.coalesce("html", F.lit(""))), F.lit("\n")).alias("content"))
    return texts.unionByName(data.select(key, F.col("value").alias("path"), F.lit("image").alias("kind"), F.col("bytes").alias("content")))
