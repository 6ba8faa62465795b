"""Page layout: rows, groups, columns, tables, headings and font calibration over a table of positioned words.

Words have keys (document and page), a row, an order `t` in the page, text, x0, x1, top, bottom, size and fontname.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["doc_id", "page"]


def anchored_rows(words: DataFrame, keys: list[str] = KEYS, tolerance: float = 3.0) -> DataFrame:
    """row_ix and word_ix: a row takes words until their top is more than the tolerance from the row's first top.

    The anchor makes this a fold. It only runs over the distinct tops of a page, so its input stays small. What it makes is one
    row a page, joined back on the keys alone: words that are dealt by them move no more.
    """
    tops = words.groupBy(*keys).agg(F.array_sort(F.collect_set("top")).alias("tops"))
    start = F.struct(F.array().cast("array<struct<top:double,row_ix:int>>").alias("out"), F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("n"))

    def step(acc: Column, top: Column) -> Column:
        new = acc.anchor.isNull() | (F.abs(top - acc.anchor) > tolerance)
        n = F.when(new, acc.n + 1).otherwise(acc.n)
        return F.struct(F.concat(acc.out, F.array(F.struct(top.alias("top"), n.alias("row_ix")))).alias("out"), F.when(new, top).otherwise(acc.anchor).alias("anchor"), n.alias("n"))

    folded = tops.select(*keys, F.map_from_entries(F.aggregate("tops", start, step, lambda a: a.out)).alias("_rows"))
    w = Window.partitionBy(*keys, "row_ix").orderBy("x0", "t")
    placed = words.filter("top is not null").join(folded, keys).withColumn("row_ix", F.col("_rows")[F.col("top")]).drop("_rows")
    return placed.withColumn("word_ix", F.row_number().over(w) - 1)


def row_groups(words: DataFrame, keys: list[str] = KEYS, gap: float = 20.0) -> DataFrame:
    """Words of a row that stand closer than the gap: g, x0 of the first and x1 of the last (not the largest)."""
    w = Window.partitionBy(*keys, "row").orderBy("x0", "t")
    flag = F.when(F.col("x0") - F.lag("x1").over(w) > gap, 1).otherwise(0)
    g = words.withColumn("_flag", flag).withColumn("g", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    last = F.max_by("x1", F.struct("x0", "t"))
    return g.groupBy(*keys, "row", "g").agg(F.min("x0").alias("x0"), last.alias("x1"), F.count(F.lit(1)).alias("n_words"))


def chain_clusters(points: DataFrame, keys: list[str], x: str, tolerance: float) -> DataFrame:
    """Sorted points chain into a cluster while the gap to the previous one is within the tolerance: cluster, center, n."""
    counted = points.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(x)
    flag = F.when(F.col(x) - F.lag(x).over(w) > tolerance, 1).otherwise(0)
    c = counted.withColumn("_flag", flag).withColumn("cluster", F.sum("_flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return c.groupBy(*keys, "cluster").agg((F.sum(F.col(x) * F.col("_n")) / F.sum("_n")).alias("center"), F.sum("_n").alias("n"))


def global_columns(groups: DataFrame, keys: list[str] = KEYS, min_cols: int = 3, gap: float = 20.0) -> DataFrame:
    """Column positions of a page, from rows that have enough groups of their own."""
    w = Window.partitionBy(*keys, "row")
    starts = groups.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= min_cols)
    return chain_clusters(starts, keys, "x0", gap / 2)


def aligned_counts(groups: DataFrame, columns: DataFrame, keys: list[str] = KEYS, gap: float = 20.0) -> DataFrame:
    """Number of columns that the groups of a row start at (each group at the first within half the gap)."""
    lists = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("cols"))
    near = F.filter("cols", lambda c: F.abs(F.col("x0") - c.center) <= gap / 2)
    hit = F.when(F.size(near) > 0, near[0]["cluster"])
    return groups.join(lists, keys, "left").groupBy(*keys, "row").agg(F.count_distinct(hit).alias("aligned"), F.max(F.coalesce(F.size("cols"), F.lit(0))).alias("n_cols"))


def table_runs(words: DataFrame, keys: list[str] = KEYS, min_rows: int = 3, min_cols: int = 3, gap: float = 20.0) -> DataFrame:
    """Longest run of aligned rows of a page as [start_row, end_row), the first of equal ones; pages without one are absent."""
    groups = row_groups(words, keys, gap)
    aligned = aligned_counts(groups, global_columns(groups, keys, min_cols, gap), keys, gap)
    w = Window.partitionBy(*keys).orderBy("row")
    ix = aligned.withColumn("ix", F.row_number().over(w) - 1).filter((F.col("aligned") >= min_cols) & (F.col("n_cols") >= min_cols))
    runs = ix.withColumn("island", F.col("ix") - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min("ix").alias("start_row"), (F.max("ix") + 1).alias("end_row"))
    runs = runs.filter(F.col("end_row") - F.col("start_row") >= min_rows)
    best = F.max_by(F.struct("start_row", "end_row"), F.struct(F.col("end_row") - F.col("start_row"), -F.col("start_row")))
    return runs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.start_row", "b.end_row")


def table_markdown(words: DataFrame, keys: list[str] = KEYS, gap: float = 20.0) -> DataFrame:
    """All rows of a page as a pipe table: each word in the nearest column, widths padded, pipes escaped."""
    columns = chain_clusters(row_groups(words, keys, gap), keys, "x0", gap / 2)
    lists = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "center"))).alias("cols"))
    far = F.transform("cols", lambda c: F.struct(F.abs(F.col("x0") - c.center).alias("d"), c.cluster.alias("cluster")))
    placed = words.join(lists, keys).withColumn("col", F.array_min(far)["cluster"]).withColumn("n_cols", F.size("cols"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "t", F.replace("text", F.lit("|"), F.lit("\\|")).alias("v")))), lambda r: r.v), " ")
    cells = placed.groupBy(*keys, "row", "n_cols", "col").agg(cell.alias("cell"))
    widths = cells.groupBy(*keys, "col").agg(F.greatest(F.lit(1), F.max(F.length("cell"))).alias("width"))
    per_page = widths.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("col", "width"))).alias("widths"))
    filled = cells.groupBy(*keys, "row", "n_cols").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("cells")).join(per_page, keys)
    ix = F.sequence(F.lit(0), F.col("n_cols") - 1)
    width = lambda i: F.coalesce(F.col("widths")[i], F.lit(1))
    line = F.concat(F.lit("| "), F.array_join(F.transform(ix, lambda i: F.rpad(F.coalesce(F.col("cells")[i], F.lit("")), width(i), " ")), " | "), F.lit(" |"))
    dashes = F.concat(F.lit("| "), F.array_join(F.transform(ix, lambda i: F.repeat(F.lit("-"), width(i))), " | "), F.lit(" |"))
    lined = filled.select(*keys, "row", line.alias("line"), dashes.alias("dashes"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r.line)
    agg = lined.groupBy(*keys).agg(rows.alias("rows"), F.first("dashes").alias("dashes"))
    return agg.select(*keys, F.array_join(F.concat(F.slice("rows", 1, 1), F.array("dashes"), F.slice("rows", 2, F.size("rows"))), "\n").alias("table_md"))


def column_bands(words: DataFrame, keys: list[str] = KEYS, min_gutter: float = 0.02, margin: float = 0.1, bin_width: float = 2.0) -> DataFrame:
    """Column bands (ix, lo, hi) of a page: uncovered runs of the x histogram that are wide enough and not in a margin split it."""
    span = words.groupBy(*keys).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi")).withColumn("span", F.col("hi") - F.col("lo"))
    at = lambda c: F.floor((F.col(c) - F.col("lo")) / bin_width).cast("int")
    n_bins = F.greatest(F.lit(1), F.floor(F.col("span") / bin_width).cast("int") + 1)
    # bins that are covered follow from intervals: a gap lies between the furthest end so far and the next start
    intervals = words.join(span, keys).select(*keys, F.greatest(F.lit(0), at("x0")).alias("a"), F.least(n_bins - 1, at("x1")).alias("b"))
    intervals = intervals.groupBy(*keys, "a").agg(F.max("b").alias("b"))
    w = Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    gaps = intervals.withColumn("reached", F.max("b").over(w)).filter(F.col("a") > F.col("reached") + 1).select(*keys, (F.col("reached") + 1).alias("run"), F.col("a").alias("stop"))
    gaps = gaps.join(span, keys)
    least = F.greatest(F.lit(2), F.floor(F.col("span") * min_gutter / bin_width).cast("int"), F.lit(int(15.0 / bin_width)))
    middle = ((F.col("lo") + F.col("run") * bin_width) + (F.col("lo") + F.col("stop") * bin_width)) / 2
    share = (middle - F.col("lo")) / F.col("span")
    gutters = gaps.filter((F.col("stop") - F.col("run") >= least) & (share > margin) & (share < 1 - margin)).select(*keys, middle.alias("cut"))
    cuts = gutters.groupBy(*keys).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    bounds = span.join(cuts, keys, "left").withColumn("b", F.concat(F.array("lo"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("hi")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.struct((i - 1).alias("ix"), F.element_at("b", i).alias("lo"), F.element_at("b", i + 1).alias("hi")))
    return bounds.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.ix", "p.lo", "p.hi")


def assign_columns(words: DataFrame, bands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """col of each word: the first band that holds its center, else that with the nearest edge."""
    lists = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ix", "lo", "hi"))).alias("bands"))
    center = (F.col("x0") + F.col("x1")) / 2
    inside = F.filter("bands", lambda b: (b.lo <= center) & (center <= b.hi))
    nearest = F.array_min(F.transform("bands", lambda b: F.struct(F.least(F.abs(center - b.lo), F.abs(center - b.hi)).alias("d"), b.ix.alias("ix"))))
    return words.join(lists, keys).withColumn("col", F.when(F.size(inside) > 0, inside[0]["ix"]).otherwise(nearest["ix"])).drop("bands")


def row_stats(words: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Of each row: words, extent, spread and mean of sizes, and whether all of it is set in a fixed-width font."""
    mono = F.coalesce(F.col("fontname").rlike("(?i)courier|consolas|mono"), F.lit(False))
    return words.groupBy(*keys, "row").agg(
        F.count(F.lit(1)).alias("n_words"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        (F.max("size") - F.min("size")).alias("spread"), F.avg("size").alias("avg_size"), F.bool_and(mono).alias("is_code"),
    )


def row_gaps(stats: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds gap_before: from the previous row's bottom to this row's top, null in the first row."""
    w = Window.partitionBy(*keys).orderBy("row")
    return stats.withColumn("gap_before", F.col("top") - F.lag("bottom").over(w))


def body_size(words: DataFrame, key: str = "doc_id", least: int = 20) -> DataFrame:
    """Most frequent size of a document in half points, the first seen of equal ones; null under `least` samples."""
    bucket = F.bround(F.col("size") * 2) / 2
    counted = words.filter("size is not null").groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "t")).alias("first"))
    return counted_body(counted, key, least)


def counted_body(counted: DataFrame, key: str = "doc_id", least: int = 20) -> DataFrame:
    """body_size() of sizes that are counted: (key, bucket, n, first)."""
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "first")
    ranked = counted.withColumn("rank", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    return ranked.filter("rank = 1").select(key, F.when(F.col("total") >= least, F.col("bucket")).alias("body_size"))


def heading_sizes(words: DataFrame, bodies: DataFrame, key: str = "doc_id", ratio: float = 1.15, most: float = 0.15) -> DataFrame:
    """Sizes that stand out and are rare against the body: (key, bucket)."""
    counted = words.filter("size is not null").groupBy(key, (F.bround(F.col("size") * 2) / 2).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counted_headings(counted, bodies, key, ratio, most)


def counted_headings(counted: DataFrame, bodies: DataFrame, key: str = "doc_id", ratio: float = 1.15, most: float = 0.15) -> DataFrame:
    """heading_sizes() of sizes that are counted: (key, bucket, n)."""
    joined = counted.join(bodies, key)
    body_n = F.max(F.when(F.col("bucket") == F.col("body_size"), F.col("n"))).over(Window.partitionBy(key))
    joined = joined.withColumn("body_n", body_n)
    return joined.filter((F.col("bucket") >= ratio * F.col("body_size")) & (F.col("body_n").isNull() | (F.col("n") / F.col("body_n") <= most))).select(key, "bucket")


def heading_rows(words: DataFrame, bodies: DataFrame, sizes: DataFrame, keys: list[str] = KEYS, key: str = "doc_id", most_words: int = 15, spread: float = 0.5, isolation: float = 1.8) -> DataFrame:
    """Rows that look like headings: short, of one size that is a heading size, and set apart from the row above.

    A document without heading sizes falls back to the ratio to its body size.
    """
    stats = row_gaps(row_stats(words, keys), keys)
    medians = stats.groupBy(*keys).agg(F.median("gap_before").alias("median_gap"))
    listed = sizes.groupBy(key).agg(F.collect_set("bucket").alias("sizes"))
    s = stats.join(medians, keys).join(bodies, key).join(listed, key, "left")
    big = stands_out(F.col("avg_size"))
    apart = F.col("gap_before").isNull() | F.col("median_gap").isNull() | (F.col("gap_before") >= F.col("median_gap") * isolation)
    return s.filter((F.col("n_words") <= most_words) & (F.col("spread") <= spread) & big & apart).select(*keys, "row")


def stands_out(size: Column) -> Column:
    """The mean size of a row is one of the document's heading sizes (sizes); where it has none, it exceeds its body_size."""
    return F.when(F.col("sizes").isNotNull(), F.array_contains("sizes", F.bround(size * 2) / 2)).otherwise(size >= F.col("body_size") * 1.15)


def heading_sanity(headings: DataFrame, stats: DataFrame, key: str = "doc_id", least: int = 50, most: float = 0.05) -> DataFrame:
    """Per document: heading rows, rows, and whether headings are rare enough to be believed."""
    return counted_sanity(headings, stats.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), key, least, most)


def counted_sanity(headings: DataFrame, totals: DataFrame, key: str = "doc_id", least: int = 50, most: float = 0.05) -> DataFrame:
    """heading_sanity() of rows that are counted: (key, n_rows)."""
    found = headings.groupBy(key).agg(F.count(F.lit(1)).alias("n_headings"))
    both = totals.join(found, key, "left").withColumn("n_headings", F.coalesce("n_headings", F.lit(0)))
    return both.select(key, "n_headings", "n_rows", ((F.col("n_rows") < least) | (F.col("n_headings") / F.col("n_rows") <= most)).alias("sane"))


def word_tolerance(gaps: DataFrame, key: str = "doc_id", default: float = 3.0, least: int = 20, jump: float = 0.5) -> DataFrame:
    """Where the sorted gaps of a document first jump: the middle of the jump, within [1, default]."""
    counted = gaps.groupBy(key, "gap").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("gap")
    c = counted.withColumn("next", F.lead("gap").over(w))
    first = F.min(F.when(F.col("next") - F.col("gap") >= jump, F.struct("gap", "next")))
    agg = c.groupBy(key).agg(F.sum("n").alias("n"), first.alias("j"))
    middle = F.greatest(F.lit(1.0), F.least(F.lit(default), (F.col("j.gap") + F.col("j.next")) / 2))
    return agg.select(key, F.when((F.col("n") >= least) & F.col("j").isNotNull(), middle).otherwise(F.lit(default)).alias("tolerance"))


def char_gaps(chars: DataFrame, keys: list[str] = KEYS, most_pages: int = 10) -> DataFrame:
    """Gaps between neighbours of a line on the first pages (a sampling operator): 0 to under 20 points."""
    w = Window.partitionBy(*keys).orderBy(F.round("top", 1), "x0")
    near = F.abs(F.col("top") - F.lag("top").over(w)) < 1
    g = chars.filter(F.col("page") < most_pages).withColumn("gap", F.when(near, F.col("x0") - F.lag("x1").over(w)))
    return g.filter("gap >= 0 and gap < 20").select(*keys, "gap")


def page_number_words(words: DataFrame, height: float, keys: list[str] = KEYS, margin: float = 0.1) -> DataFrame:
    """Words without lone numbers of up to four digits in the top or bottom margin."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, "row")) == 1
    edge = (F.col("top") < margin * height) | (F.col("bottom") > (1 - margin) * height)
    drop = alone & F.col("text").rlike("^\\d{1,4}$") & edge
    return words.withColumn("_drop", drop).filter("not _drop").drop("_drop")


def garbled_free(words: DataFrame) -> DataFrame:
    """Words without control characters."""
    return words.filter(~F.col("text").rlike("[\\x00-\\x1f\\x7f]"))


def rows_text(words: DataFrame, keys: list[str] = KEYS, least: int = 2, opening: str = "```", closing: str = "```") -> DataFrame:
    """Text of a page; runs of at least `least` fixed-width rows stand between fences."""
    lines = words.groupBy(*keys, "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "t", "text"))), lambda r: r.text), " ").alias("line"),
        F.bool_and(F.coalesce(F.col("fontname").rlike("(?i)courier|consolas|mono"), F.lit(False))).alias("is_code"),
    )
    w = Window.partitionBy(*keys).orderBy("row")
    n = lines.withColumn("ix", F.row_number().over(w)).withColumn("island", F.col("ix") - F.row_number().over(Window.partitionBy(*keys, "is_code").orderBy("row")))
    run = Window.partitionBy(*keys, "is_code", "island")
    n = n.withColumn("run", F.count(F.lit(1)).over(run)).withColumn("first", F.min("ix").over(run)).withColumn("last", F.max("ix").over(run))
    fenced = F.col("is_code") & (F.col("run") >= least)
    text = F.concat(F.when(fenced & (F.col("ix") == F.col("first")), F.lit(opening + "\n")).otherwise(""), F.col("line"), F.when(fenced & (F.col("ix") == F.col("last")), F.lit("\n" + closing)).otherwise(""))
    return n.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", text.alias("v")))), lambda r: r.v), "\n").alias("text"))
