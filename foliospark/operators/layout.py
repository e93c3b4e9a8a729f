"""Page geometry on a table of blocks (page, pos, x0, y0, x1, y1, text): bands, columns, layouts, reading order, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the page's height and width, and lengths, by which blocks are told apart.
BAND_HEIGHT, BAND_CHARS, HEADER, FOOTER, GUTTER = 0.06, 220, 0.11, 0.88, 0.04
SPARSE_CHARS, MANY_BLOCKS, SHORT_BLOCK, IN_COLUMNS = 30, 20, 25, 0.55
INDENT, MARGIN, LEADING = 0.06, 0.02, 1.6


def band(height: float) -> Column:
    """header, footer or body by place, for short low blocks."""
    thin = (F.col("y1") - F.col("y0") <= BAND_HEIGHT * height) & (F.length("text") <= BAND_CHARS)
    return F.when(thin & (F.col("y1") <= HEADER * height), "header").when(thin & (F.col("y0") >= FOOTER * height), "footer").otherwise("body")


def column(width: float) -> Column:
    """left or right of the middle with a gutter's tolerance, else full."""
    mid, gap = width / 2, GUTTER * width
    return F.when(F.col("x1") <= mid + gap, "left").when(F.col("x0") >= mid - gap, "right").otherwise("full")


def classified(blocks: DataFrame, width: float, height: float) -> DataFrame:
    return blocks.withColumn("band", band(height)).withColumn("col", column(width))


def layouts(blocks: DataFrame) -> DataFrame:
    """(page, layout) from classified blocks: figure_or_sparse, single_column, double_column or mixed_layout."""
    body = F.col("band") == "body"
    chars = F.length(F.trim("text"))
    per = blocks.groupBy("page").agg(
        F.sum(chars).alias("chars"), F.count(F.lit(1)).alias("n"), F.median(chars).alias("mid"),
        F.count_if(body & (F.col("col") == "left")).alias("l"), F.count_if(body & (F.col("col") == "right")).alias("r"), F.count_if(body & (F.col("col") == "full")).alias("f"),
        F.sum(F.when(body & (F.col("col") != "full"), chars).otherwise(0)).alias("inside"), F.sum(F.when(body, chars).otherwise(0)).alias("body_chars"),
    )
    sparse = (F.col("chars") < SPARSE_CHARS) | ((F.col("n") >= MANY_BLOCKS) & (F.col("mid") < SHORT_BLOCK))
    double = (F.col("l") >= 2) & (F.col("r") >= 2) & (F.col("inside") >= IN_COLUMNS * F.col("body_chars"))
    return per.select("page", F.when(sparse, "figure_or_sparse").when(double & (F.col("f") > 0), "mixed_layout").when(double, "double_column").otherwise("single_column").alias("layout"))


def reading_order(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """Classified blocks with `nth`, their place in reading order.

    Header, body, footer. In pages of two columns a full block ends a stretch: stretches follow one another,
    each left column before its right one. The stretch of a block is the number of full blocks that end
    above its centre, counted by a running window over ends and centres instead of a self-join.
    """
    b = blocks.join(layout, "page")
    full = F.when((F.col("col") == "full") & (F.col("band") == "body"), 1).otherwise(0)
    ends = b.where("col = 'full' and band = 'body'").select("page", F.col("y1").alias("y"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("pos"))
    centres = b.select("page", ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.lit(1).alias("side"), F.col("pos").cast("int").alias("pos"))
    w = Window.partitionBy("page").orderBy("y", "side").rowsBetween(Window.unboundedPreceding, 0)
    above = ends.unionByName(centres).withColumn("stretch", F.sum(1 - F.col("side")).over(w)).where("side = 1").select("page", "pos", "stretch")
    b = b.join(above, ["page", "pos"]).withColumn("is_full", full)
    columns = F.col("layout").isin("double_column", "mixed_layout") & (F.col("band") == "body")
    section = F.when(F.col("band") == "header", 0).when(F.col("band") == "body", 1).otherwise(2)
    side = F.when(F.col("col") == "left", 0).when(F.col("col") == "right", 1).otherwise(2)
    key = [section, F.when(columns, F.col("stretch")).otherwise(0), F.when(columns, side).otherwise(0), F.round("y0", 1), F.col("x0"), F.col("pos")]
    return b.withColumn("nth", F.row_number().over(Window.partitionBy("page").orderBy(*key))).drop("is_full", "stretch")


def naive_order(blocks: DataFrame) -> DataFrame:
    """Adds `naive`, the place by (y0, x0) alone."""
    return blocks.withColumn("naive", F.row_number().over(Window.partitionBy("page").orderBy(F.round("y0", 1), "x0", "pos")))


def alternations(blocks: DataFrame, order: str) -> DataFrame:
    """(page, switches): changes between left and right among body blocks of columns, in the given order."""
    body = blocks.where("band = 'body' and col <> 'full'")
    before = F.lag("col").over(Window.partitionBy("page").orderBy(order))
    return body.withColumn("p", before).groupBy("page").agg(F.count_if(F.col("p").isNotNull() & (F.col("p") != F.col("col"))).alias("switches"))


def is_multiline(text: Column) -> Column:
    """Whether a block holds several lines of text; blank lines and lines of up to four digits do not count."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike("^[0-9]{1,4}$"))) > 1


def double_column_check(ordered: DataFrame, width: float) -> DataFrame:
    """Per page of blocks with `nth` and `naive`: blocks left and right, bands, switches of either order, the widest block's share, and whether columns stay apart."""
    body = F.col("band") == "body"
    per = ordered.groupBy("page", "layout").agg(
        F.count_if(body & (F.col("col") == "left")).alias("n_left"), F.count_if(body & (F.col("col") == "right")).alias("n_right"), F.count_if(body & (F.col("col") == "full")).alias("n_full"),
        F.round(F.coalesce(F.max(F.when(body, F.col("x1") - F.col("x0"))), F.lit(0.0)) / width, 3).alias("widest_share"),
    )
    bands = F.when((F.col("n_left") > 0) & (F.col("n_right") > 0), F.col("n_full") + 1).otherwise(1)
    out = per.withColumn("bands", bands)
    for order in ("nth", "naive"):
        out = out.join(alternations(ordered, order).withColumnRenamed("switches", f"switches_{order}"), "page", "left").withColumn(f"switches_{order}", F.coalesce(f"switches_{order}", F.lit(0)))
    return out.select("page", "layout", "n_left", "n_right", "bands", "switches_nth", "switches_naive", "widest_share", (F.col("switches_nth") <= F.col("bands")).alias("apart"))


REFERENCES = 4  # links to articles that make a page one of references


def layout_samples(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(label, page, two_columns): a witness page of each range (label, first, last) that has pages.

    pages (page, layout, switches_naive, text). Of a range's pages of two columns the one that a naive order would
    mix most, then the longest; without such pages the longest that is not a figure. Pages of references count
    only where there are no others. Ties go to the first page.
    """
    links = (F.length("text") - F.length(F.replace("text", F.lit("doi.org"), F.lit("")))) / 7
    two = F.col("layout").isin("double_column", "mixed_layout")
    p = pages.join(F.broadcast(ranges), F.col("page").between(F.col("first"), F.col("last")))  # ranges are a few rows
    rank = F.struct(two.cast("int").alias("two"), (F.col("layout") != "figure_or_sparse").cast("int").alias("real"), (links < REFERENCES).cast("int").alias("prose"), F.when(two, F.col("switches_naive")).otherwise(0).alias("mixed"), F.length("text").alias("size"), (-F.col("page")).alias("back"))
    best = p.groupBy("label").agg(F.max_by(F.struct("page", two.alias("two")), rank).alias("b"))
    return best.select("label", "b.page", F.col("b.two").alias("two_columns"))


def paragraphs(blocks: DataFrame, width: float) -> DataFrame:
    """Ordered blocks with `group`: a line continues the one before if band and indent agree, the gap is small, neither block is a paragraph of several lines, and the one before reaches a margin or ends in a hyphen.

    A right margin is a rounded x1 that two blocks of the page share.
    """
    margins = blocks.groupBy("page", F.round("x1").alias("m")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("page").agg(F.collect_set("m").alias("margins"))
    w = Window.partitionBy("page").orderBy("nth")
    b = blocks.join(margins, "page", "left")
    before = lambda c: F.lag(c).over(w)
    b = b.withColumn("_x1", before("x1")).withColumn("_reach", F.exists(F.coalesce("margins", F.array().cast("array<double>")), lambda m: F.abs(F.col("_x1") - m) <= MARGIN * width))
    height = before("y1") - before("y0")
    joins = (before("band") == F.col("band")) & (F.abs(before("x0") - F.col("x0")) <= INDENT * width) & (F.col("y0") - before("y1") < LEADING * height) & (F.col("_reach") | before("text").endswith("-")) & ~is_multiline(before("text")) & ~is_multiline(F.col("text"))
    marked = b.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "_x1", "_reach", "margins")
