"""Page layout: columns, reading order, section tree, regions of touching boxes, and figures that cover one another.

Boxes are (l, t, r, b) from the top left of a page. A page, and the blocks of one document, are groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of headers that the section tree tells apart.
LEVELS = 6


def columns(blocks: DataFrame, page: list[str], *, order: str, gap: float = 0.02, wide: float = 0.6) -> DataFrame:
    """blocks (page…, order, l, t, r, b as shares of the page) with `band` and `col`.

    Blocks at least `wide` across span the page: each is a band of its own, and the blocks between two of them are another.
    Within a band, blocks whose horizontal intervals lie within `gap` of one another, directly or through others, share a
    column; columns count from 1 at the left. A spanning block is column 0.
    """
    spans = F.col("r") - F.col("l") >= wide
    down = Window.partitionBy(*page).orderBy("t", "l", order)
    above = F.coalesce(F.sum(F.col("_spans").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    banded = blocks.withColumn("_spans", spans).withColumn("band", F.when(F.col("_spans"), 2 * above + 1).otherwise(2 * above).cast("int"))
    across = Window.partitionBy(*page, "band").orderBy("l", "r", order)
    reach = F.max("r").over(across.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col("l") > reach + gap)).cast("int")
    numbered = banded.withColumn("_opens", opens).withColumn("col", F.sum("_opens").over(across.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.withColumn("col", F.when(F.col("_spans"), 0).otherwise(F.col("col"))).drop("_spans", "_opens")


def reading_order(blocks: DataFrame, doc: list[str], page: str, *, order: str, **options) -> DataFrame:
    """blocks with band, col and `position`, from 1 within a document: page by page, band by band, column by column, downwards."""
    placed = columns(blocks, [*doc, page], order=order, **options)
    w = Window.partitionBy(*doc).orderBy(page, "band", "col", "t", "l", order)
    return placed.withColumn("position", F.row_number().over(w))


def header_level(text: Column) -> Column:
    """Level of a numbered or marked header ("2.1 Title" is 2, "### Title" is 3); null for other text and for text of more than 120 characters."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    marks = F.length(F.regexp_extract(clean, r"^(#{1,6})\s+\S", 1))
    number = F.regexp_extract(clean, r"^(\d{1,3}(?:\.\d{1,3}){0,5})\.?\s+\p{Lu}", 1)
    level = F.when(marks > 0, marks).when(number != "", F.size(F.split(number, r"\.")))
    return F.when((F.length(clean) <= 120) & ~F.contains(clean, F.lit("\n")), level).cast("int")


def section_tree(blocks: DataFrame, doc: list[str], *, position: str = "position", level: str = "level") -> DataFrame:
    """blocks with `section` (position of the header a block stands under, its own for a header), `parent` (of that section) and `depth`.

    A header's parent is the nearest one before it of a lower level; levels may be skipped. Blocks before the first header
    have no section. depth counts the sections that hold a block; levels are 1 to LEVELS, deeper ones count as LEVELS.
    """
    w = Window.partitionBy(*doc).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(level).isNotNull(), F.least(F.col(level), F.lit(LEVELS)))
    out = blocks.withColumn("section", F.last(F.when(own.isNotNull(), F.col(position)), ignorenulls=True).over(w))
    # where the last header of each level stands, at every block; a header of level k ends the open ones of k and deeper
    lasts = [F.last(F.when(own == k, F.col(position)), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)]
    out = out.withColumn("_open", F.array(*lasts))
    here = F.col("_open")
    is_open = lambda x, k: x.isNotNull() & ~F.exists(F.slice(here, F.lit(1), k), lambda y: F.coalesce(y > x, F.lit(False)))  # noqa: E731  nothing higher came after it
    path = F.filter(F.transform(here, lambda x, k: F.when(is_open(x, k), x)), lambda x: x.isNotNull())
    out = out.withColumn("_path", path)
    parent = F.when(F.size("_path") > 1, F.try_element_at("_path", F.lit(-2)))
    return out.withColumns({"parent": parent, "depth": F.size("_path")}).drop("_open", "_path")


def sections(tree: DataFrame, doc: list[str], *, text: str = "text", position: str = "position", level: str = "level") -> DataFrame:
    """A row for each section: (doc…, section, parent, depth, title, n_blocks, body), body being its own blocks in order, without its header."""
    body = F.sort_array(F.collect_list(F.when(F.col(level).isNull(), F.struct(position, text))))
    title = F.max(F.when(F.col(level).isNotNull(), F.col(text)))
    g = tree.groupBy(*doc, "section", "parent", "depth").agg(title.alias("title"), F.count(F.when(F.col(level).isNull(), 1)).alias("n_blocks"), F.array_join(F.transform(body, lambda x: x[text]), "\n").alias("body"))
    return g


def structural_parse(blocks: DataFrame, figures: DataFrame, doc: list[str], page: str, *, order: str, text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, figures) of documents: blocks in reading order with their section and whether they are captions; figures with
    the caption below them in their column, and the section that the caption, or else the block before the figure, stands in.

    blocks: doc…, page, order, l, t, r, b, text; figures: doc…, page, fig_id, l, t, r, b. Blank blocks are left out.
    """
    from lodestone.operators import figures as fg

    shown = blocks.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    nodes = reading_order(shown, doc, page, order=order, **options).withColumns({"level": header_level(F.col(text)), "is_caption": fg.caption_kinds(F.col(text))["block"]})
    nodes = section_tree(nodes, doc)
    return nodes, bind_figures(nodes, figures, doc, page, order=order, text=text)


def bind_figures(nodes: DataFrame, figures: DataFrame, doc: list[str], page: str, *, order: str, text: str = "text", **reach) -> DataFrame:
    """figures with cap_id (position of their caption), caption and section; nodes have position, section and is_caption."""
    from lodestone.operators import figures as fg

    captions = nodes.where("is_caption").select(*doc, page, F.col("position").alias("cap_id"), F.col("l").alias("cl"), F.col("t").alias("ct"), F.col("r").alias("cr"), F.col("b").alias("cb"), F.col(order).alias("block_no"))
    bound = fg.caption_join(figures, captions, [*doc, page], **reach)
    at = nodes.select(*doc, F.col("position").alias("cap_id"), F.col("section").alias("_cap_section"), F.col(text).alias("caption"))
    bound = bound.join(at, [*doc, "cap_id"], "left")
    # the last block, in reading order of its page, that begins no lower than a figure does
    before = figures.select(*doc, page, "fig_id", F.col("t").alias("_ft")).join(nodes.select(*doc, page, F.col("t").alias("_bt"), "position", F.col("section").alias("_section")), [*doc, page]).where("_bt <= _ft")
    before = before.groupBy(*doc, page, "fig_id").agg(F.max_by("_section", "position").alias("_section"))
    out = bound.join(before, [*doc, page, "fig_id"], "left").withColumn("section", F.when(F.col("cap_id").isNotNull(), F.col("_cap_section")).otherwise(F.col("_section")))
    return out.drop("_cap_section", "_section")


#: Pages of at most so many boxes have all of them compared.
FEW = 48


def touching(boxes, gap: float):
    """Component of each box (l, t, r, b rows of an array): the number of its first box. Boxes touch where both their distances are at most gap.

    A line sweeps from left to right; only boxes that it hasn't left behind are compared.
    """
    import numpy as np

    root = list(range(len(boxes)))
    if len(boxes) <= FEW:  # plain comparisons are quicker than arrays
        rows = boxes.tolist()
        for k, (left, top, right, bottom) in enumerate(rows):
            for j in range(k):
                l, t, r, b = rows[j]  # noqa: E741
                if l - gap <= right and left - gap <= r and t - gap <= bottom and top - gap <= b:
                    x, y = k, j
                    while root[x] != x:
                        x = root[x]
                    while root[y] != y:
                        y = root[y]
                    root[max(x, y)] = min(x, y)
        for k in range(len(rows)):
            root[k] = root[root[k]]
        return root

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    open_ = np.zeros(0, "i8")
    for k in np.argsort(boxes[:, 0], kind="stable").tolist():
        left, top, _, bottom = boxes[k]
        open_ = open_[boxes[open_, 2] + gap >= left]
        for j in open_[(boxes[open_, 1] - gap <= bottom) & (top - gap <= boxes[open_, 3])].tolist():
            a, b = find(k), find(j)
            root[max(a, b)] = min(a, b)
        open_ = np.append(open_, k)
    return [find(k) for k in range(len(boxes))]


#: A region is what its strongest member is.
KINDS = ("table", "figure", "caption", "text")


def regions(boxes: DataFrame, page: list[str], *, box: str = "box_id", kind: str = "kind", text: str = "text", gap: float = 0.0) -> DataFrame:
    """Touching boxes of a page merged: (page…, region, kind, l, t, r, b, n_boxes, text).

    region is the least box id of a component, kind the strongest of KINDS among its members (unknown and null kinds count
    as text), text its members' texts downwards. Boxes with a null corner, or turned inside out, are left out.
    """
    whole = boxes.where("l is not null and t is not null and r is not null and b is not null and r >= l and b >= t")
    keys = [*page, box]

    @F.udf(T.ArrayType(T.LongType()), useArrow=True)
    def merged(corners):
        import numpy as np

        return [int(k) for k in touching(np.array([[c["l"], c["t"], c["r"], c["b"]] for c in corners], float), gap)]

    # ids first, so that texts don't go through Python; a page is a row, and many go together
    corners = [F.col(c).cast("double").alias(c) for c in "ltrb"]
    pages = whole.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(box, *corners))).alias("_b"))
    pages = pages.withColumn("_root", merged(F.transform("_b", lambda x: F.struct(*(x[c].alias(c) for c in "ltrb")))))
    found = pages.select(*page, F.explode(F.arrays_zip("_b", "_root")).alias("_x")).select(*page, F.col(f"_x._b.{box}").alias(box), F.col("_x._root").alias("_first"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)), F.lit(0))
    level = F.when(rank == 0, len(KINDS)).otherwise(rank)
    rows = whole.join(found, keys).withColumn("_kind", level)
    body = F.transform(F.sort_array(F.collect_list(F.when(F.length(F.coalesce(text, F.lit(""))) > 0, F.struct("t", "l", box, text)))), lambda x: x[text])
    agg = rows.groupBy(*page, "_first").agg(
        F.min(box).alias("region"), F.element_at(F.array(*map(F.lit, KINDS)), F.min("_kind").cast("int")).alias("kind"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n_boxes"), F.array_join(body, "\n").alias("text")
    )
    return agg.drop("_first")


def classify_boxes(blocks: DataFrame, images: DataFrame, tables: DataFrame, page: list[str]) -> DataFrame:
    """(page…, box_id, kind, l, t, r, b, text) of a page's text blocks, images and tables; images too small or as large as the page are left out.

    blocks: page…, box_id, corners, text; images: page…, box_id, corners, page_area; tables: page…, box_id, corners, text.
    """
    from lodestone.operators import figures as fg

    corners = [*page, "box_id", "l", "t", "r", "b"]
    cap = fg.caption_kinds(F.col("text"))["region"]
    text = blocks.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).select(*corners, F.when(cap, "caption").otherwise("text").alias("kind"), F.trim("text").alias("text"))
    fits = fg.region_filter(F.col("r") - F.col("l"), F.col("b") - F.col("t"), F.col("page_area"))
    image = images.where(fits).select(*corners, F.lit("figure").alias("kind"), F.lit(None).cast("string").alias("text"))
    return text.unionByName(image).unionByName(tables.select(*corners, F.lit("table").alias("kind"), "text"))


def sequential_covers(rasters: DataFrame, covers: DataFrame, page: list[str], *, order: str, width: str = "page_w", height: str = "page_h", share: float = 0.35, pad: float = 4.0) -> DataFrame:
    """Rasters of a page that stand alone, in order: each one accepted covers those after it.

    rasters: page…, order, l, t, r, b, page_w, page_h; covers: page…, ol, ot, orr, ob. A raster is left out where it is small
    (a side under 50 or an area under 4000), where a cover holds more than `share` of it, where its sides are 20 to 1 or
    more apart, or where it is nine tenths of its page. What stays gets pl, pt, pr, pb: itself widened by `pad` within the page.
    The fold over a page's rasters is one expression in the JVM.
    """
    box = "struct<l:double,t:double,r:double,b:double>"
    corner = lambda *c: F.struct(*(F.col(x).cast("double").alias(n) for x, n in zip(c, "ltrb")))
    r = rasters.where((F.col("r") - F.col("l") >= 50) & (F.col("b") - F.col("t") >= 50) & ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) >= 4000))
    listed = r.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), corner(*"ltrb").alias("x"), F.col(width).cast("double").alias("w"), F.col(height).cast("double").alias("h")))).alias("_r"))
    held = covers.groupBy(*page).agg(F.collect_list(corner("ol", "ot", "orr", "ob")).alias("_c"))
    both = listed.join(held, page, "left").withColumn("_c", F.coalesce("_c", F.array().cast(f"array<{box}>")))

    def step(state: Column, raster: Column) -> Column:
        x, w, h = raster["x"], raster["w"], raster["h"]
        area, aspect = (x["r"] - x["l"]) * (x["b"] - x["t"]), (x["r"] - x["l"]) / F.greatest(F.lit(1.0), x["b"] - x["t"])
        inter = lambda c: F.greatest(F.lit(0.0), F.least(x["r"], c["r"]) - F.greatest(x["l"], c["l"])) * F.greatest(F.lit(0.0), F.least(x["b"], c["b"]) - F.greatest(x["t"], c["t"]))
        stands = ~F.exists(state["covers"], lambda c: inter(c) / area > share) & (aspect <= 20.0) & (aspect >= 0.05) & (area / (w * h) <= 0.9)
        wider = F.struct(F.greatest(F.lit(0.0), x["l"] - pad).alias("l"), F.greatest(F.lit(0.0), x["t"] - pad).alias("t"), F.least(w, x["r"] + pad).alias("r"), F.least(h, x["b"] + pad).alias("b"))
        row = F.struct(raster["o"].alias("o"), wider.alias("p"))
        grown = F.struct(F.concat(state["covers"], F.array(wider)).alias("covers"), F.concat(state["kept"], F.array(row)).alias("kept"))
        return F.when(stands, grown).otherwise(state)

    kind = rasters.schema[order].dataType.simpleString()
    empty = F.struct(F.col("_c").alias("covers"), F.array().cast(f"array<struct<o:{kind},p:{box}>>").alias("kept"))
    kept = both.select(*page, F.explode(F.aggregate("_r", empty, step)["kept"]).alias("k")).select(*page, F.col("k.o").alias(order), *(F.col(f"k.p.{c}").alias(f"p{c}") for c in "ltrb"))
    return rasters.join(kept, [*page, order])
