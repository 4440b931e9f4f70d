"""Queries over page layouts. Blocks of the pages' HTML get a place by their number, twelve to a sheet, in thousandths of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import figures as fg
from lodestone.operators import layout
from lodestone.plans.registry import query, table, values

TAGS = "<(h[1-6]|p|li|td|blockquote)[^>]*>([^<]*)"
BLOCKS_SQL = f"""x AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{TAGS}', 1) AS tags, regexp_extract_all(coalesce(html, ''), '{TAGS}', 2) AS texts FROM pages),
u AS (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS raw, generate_subscripts(tags, 1) - 1 AS i FROM x),
blk AS (SELECT page_id, i, i // 12 + 1 AS sheet, tag, CASE WHEN tag[1:1] = 'h' THEN repeat('#', tag[2:2]::INT) || ' ' || raw ELSE raw END AS text,
  CASE WHEN i % 12 = 0 THEN 50 ELSE 50 + 480 * ((i * 7 + page_id) % 2) + 5 * (i % 3) END AS l, CASE WHEN i % 12 = 0 THEN 950 ELSE 450 + 480 * ((i * 7 + page_id) % 2) + 5 * (i % 3) END AS r,
  45 * ((i * 5 + page_id) % 12) AS t, 45 * ((i * 5 + page_id) % 12) + 40 + 40 * (i % 3) AS b FROM u)"""
NODES_SQL = f"""{BLOCKS_SQL},
s AS (SELECT *, r - l >= 600 AS spans FROM blk WHERE length(trim(text)) > 0),
bd AS (SELECT *, 2 * coalesce(sum(spans::INT) OVER (PARTITION BY page_id, sheet ORDER BY t, l, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + spans::INT AS band FROM s),
op AS (SELECT *, CASE WHEN l > 20 + max(r) OVER w THEN 1 WHEN max(r) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM bd WINDOW w AS (PARTITION BY page_id, sheet, band ORDER BY l, r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT *, CASE WHEN spans THEN 0 ELSE sum(opens) OVER (PARTITION BY page_id, sheet, band ORDER BY l, r, i ROWS UNBOUNDED PRECEDING) END AS col FROM op),
ps AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sheet, band, col, t, l, i) AS position, trim(text) AS clean FROM cl),
lv AS (SELECT *, CASE WHEN length(clean) > 120 OR contains(clean, chr(10)) THEN NULL WHEN regexp_matches(clean, '^#{{1,6}}\\s+\\S') THEN length(regexp_extract(clean, '^(#{{1,6}})\\s+\\S', 1))
   WHEN regexp_matches(clean, '^\\d{{1,3}}(?:\\.\\d{{1,3}}){{0,5}}\\.?\\s+\\p{{Lu}}') THEN len(string_split(regexp_extract(clean, '^(\\d{{1,3}}(?:\\.\\d{{1,3}}){{0,5}})\\.?\\s+\\p{{Lu}}', 1), '.')) END AS level,
   regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), {values([fg.CAPTION_BLOCK])}) AS is_caption FROM ps),
hd AS (SELECT page_id, position, level, (SELECT max(h.position) FROM lv h WHERE h.page_id = lv.page_id AND h.position < lv.position AND h.level < lv.level) AS parent FROM lv WHERE level IS NOT NULL),
tree AS (SELECT page_id, position, parent, 1 AS depth FROM hd WHERE parent IS NULL UNION ALL SELECT h.page_id, h.position, h.parent, tree.depth + 1 FROM hd h JOIN tree ON tree.page_id = h.page_id AND tree.position = h.parent),
nd AS (SELECT lv.*, (SELECT max(h.position) FROM hd h WHERE h.page_id = lv.page_id AND h.position <= lv.position) AS section FROM lv),
nodes AS (SELECT nd.*, tree.parent, coalesce(tree.depth, 0) AS depth FROM nd LEFT JOIN tree ON tree.page_id = nd.page_id AND tree.position = nd.section)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(TAGS), F.lit(1)).alias("tag"), F.regexp_extract_all(html, F.lit(TAGS), F.lit(2)).alias("raw"))
    d = table(spark, sf, "pages").select("page_id", F.posexplode(both).alias("i", "x")).select("page_id", "i", F.col("x")["tag"].alias("tag"), F.col("x")["raw"].alias("raw"))
    i, side, down = F.col("i"), (F.col("i") * 7 + F.col("page_id")) % 2, 45 * ((F.col("i") * 5 + F.col("page_id")) % 12)
    wide = i % 12 == 0
    head = F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), "raw")
    return d.select(
        "page_id", "i", (F.floor(i / 12) + 1).cast("int").alias("sheet"), "tag", F.when(F.substring("tag", 1, 1) == "h", head).otherwise(F.col("raw")).alias("text"),
        F.when(wide, 50).otherwise(50 + 480 * side + 5 * (i % 3)).alias("l"), F.when(wide, 950).otherwise(450 + 480 * side + 5 * (i % 3)).alias("r"), down.alias("t"), (down + 40 + 40 * (i % 3)).alias("b"),
    )


def _figures(blocks: DataFrame) -> DataFrame:
    """Every list item is a figure where it stands, of half its height."""
    return blocks.where("tag = 'li'").select("page_id", "sheet", F.col("i").alias("fig_id"), "l", "t", "r", (F.col("t") + (F.col("b") - F.col("t")) / 2).alias("b"))


def _parsed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = _blocks(spark, sf)
    return layout.structural_parse(b, _figures(b), ["page_id"], "sheet", order="i", gap=20, wide=600)


@query(f"WITH RECURSIVE {NODES_SQL} SELECT page_id, i::INTEGER AS i, band::INTEGER AS band, col::INTEGER AS col, position::INTEGER AS position, level::INTEGER AS level, is_caption, section::INTEGER AS section, parent::INTEGER AS parent, depth::INTEGER AS depth FROM nodes")
def structural_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every page in reading order, each with its place in the section tree."""
    nodes, _ = _parsed(spark, sf)
    return nodes.select("page_id", "i", "band", "col", "position", "level", "is_caption", "section", "parent", "depth")


@query(f"""WITH RECURSIVE {NODES_SQL} SELECT page_id, section::INTEGER AS section, parent::INTEGER AS parent, depth::INTEGER AS depth, max(text) FILTER (level IS NOT NULL) AS title, count(*) FILTER (level IS NULL) AS n_blocks,
md5(coalesce(string_agg(text, chr(10) ORDER BY position) FILTER (level IS NULL), '')) AS body_md5 FROM nodes GROUP BY page_id, section, parent, depth""")
def structural_sections(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = _parsed(spark, sf)
    return layout.sections(nodes, ["page_id"]).select("page_id", "section", "parent", "depth", "title", "n_blocks", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(f"""WITH RECURSIVE {NODES_SQL}, fig AS (SELECT page_id, sheet, i AS fig_id, l, t, r, t + (b - t) / 2 AS b FROM blk WHERE tag = 'li'),
cp AS (SELECT f.page_id, f.sheet, f.fig_id, first(n.position ORDER BY n.i) AS cap_id FROM fig f JOIN nodes n ON n.page_id = f.page_id AND n.sheet = f.sheet AND n.level IS NOT NULL AND least(f.r, n.r) - greatest(f.l, n.l) > 0.15 AND n.t - f.b BETWEEN 0 AND 200 GROUP BY ALL),
bf AS (SELECT f.page_id, f.sheet, f.fig_id, arg_max(coalesce(n.section, -1), n.position) AS section FROM fig f JOIN nodes n ON n.page_id = f.page_id AND n.sheet = f.sheet AND n.t <= f.t GROUP BY ALL)
SELECT fig.page_id, fig.fig_id::INTEGER AS fig_id, cp.cap_id::INTEGER AS cap_id, n.text AS caption, CASE WHEN cp.cap_id IS NOT NULL THEN n.section ELSE nullif(bf.section, -1) END::INTEGER AS section
FROM fig LEFT JOIN cp USING (page_id, sheet, fig_id) LEFT JOIN bf USING (page_id, sheet, fig_id) LEFT JOIN nodes n ON n.page_id = fig.page_id AND n.position = cp.cap_id""")
def structural_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Figures with the first header below them in their column, which stands in for a caption, and their section."""
    b = _blocks(spark, sf)
    nodes = layout.reading_order(b.where(F.length(F.trim("text")) > 0), ["page_id"], "sheet", order="i", gap=20, wide=600)
    nodes = layout.section_tree(nodes.withColumn("level", layout.header_level(F.col("text"))), ["page_id"])
    out = layout.bind_figures(nodes.withColumn("is_caption", F.col("level").isNotNull()), _figures(b), ["page_id"], "sheet", order="i", below=200)
    return out.select("page_id", "fig_id", "cap_id", "caption", "section")


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, bx AS (SELECT *, CASE tag WHEN 'td' THEN 'table' WHEN 'li' THEN 'figure' WHEN 'p' THEN 'text' ELSE 'caption' END AS kind FROM blk),
tc AS (SELECT page_id, sheet, i AS a, i AS z FROM bx UNION SELECT tc.page_id, tc.sheet, tc.a, y.i FROM tc JOIN bx x ON x.page_id = tc.page_id AND x.i = tc.z JOIN bx y ON y.page_id = x.page_id AND y.sheet = x.sheet AND y.l <= x.r + 2 AND x.l <= y.r + 2 AND y.t <= x.b + 2 AND x.t <= y.b + 2),
rt AS (SELECT page_id, sheet, z AS i, min(a) AS region FROM tc GROUP BY ALL)
SELECT page_id, region::INTEGER AS region, ['table', 'figure', 'caption', 'text'][min(CASE kind WHEN 'table' THEN 1 WHEN 'figure' THEN 2 WHEN 'caption' THEN 3 ELSE 4 END)] AS kind, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS n_boxes,
  md5(coalesce(string_agg(text, chr(10) ORDER BY t, l, i, text) FILTER (length(text) > 0), '')) AS text_md5 FROM bx JOIN rt USING (page_id, sheet, i) GROUP BY page_id, region""")
def page_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Touching blocks of every sheet as regions, each of the kind of its strongest block."""
    kind = F.when(F.col("tag") == "td", "table").when(F.col("tag") == "li", "figure").when(F.col("tag") == "p", "text").otherwise("caption")
    out = layout.regions(_blocks(spark, sf).withColumn("kind", kind), ["page_id", "sheet"], box="i", gap=2)
    return out.select("page_id", "region", "kind", "l", "t", "r", "b", "n_boxes", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, ra AS (SELECT *, row_number() OVER (PARTITION BY page_id, sheet ORDER BY i) AS n FROM blk WHERE i % 12 <> 0 AND r - l >= 50 AND b - t >= 50 AND (r - l) * (b - t) >= 4000),
st AS (SELECT page_id, sheet, 0::BIGINT AS n, list_transform([struct_pack(l := l, t := t, r := r, b := b)], lambda c: struct_pack(l := c.l::DOUBLE, t := c.t::DOUBLE, r := c.r::DOUBLE, b := c.b::DOUBLE)) AS covers, -1::BIGINT AS took FROM blk WHERE i % 12 = 0
  UNION ALL SELECT page_id, sheet, n, CASE WHEN ok THEN list_append(covers, struct_pack(l := greatest(0.0, l - 4)::DOUBLE, t := greatest(0.0, t - 4)::DOUBLE, r := least(1000.0, r + 4)::DOUBLE, b := least(1000.0, b + 4)::DOUBLE)) ELSE covers END, CASE WHEN ok THEN i ELSE -1 END
  FROM (SELECT s.covers, x.*, len(list_filter(s.covers, lambda c: greatest(0.0, least(x.r, c.r) - greatest(x.l, c.l)) * greatest(0.0, least(x.b, c.b) - greatest(x.t, c.t)) / ((x.r - x.l) * (x.b - x.t)) > 0.35)) = 0 AS ok
        FROM st s JOIN ra x ON x.page_id = s.page_id AND x.sheet = s.sheet AND x.n = s.n + 1))
SELECT blk.page_id, took::INTEGER AS i, greatest(0.0, l - 4)::DOUBLE AS pl, greatest(0.0, t - 4)::DOUBLE AS pt, least(1000.0, r + 4)::DOUBLE AS pr, least(1000.0, b + 4)::DOUBLE AS pb FROM st JOIN blk ON blk.page_id = st.page_id AND blk.i = st.took WHERE took >= 0""")
def raster_covers(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every sheet as rasters, its spanning one as a figure: each raster that stands alone covers those after it."""
    b = _blocks(spark, sf).withColumns({"page_w": F.lit(1000), "page_h": F.lit(1000)})
    covers = b.where("i % 12 = 0").select("page_id", "sheet", *(F.col(c).alias(n) for c, n in zip("ltrb", ("ol", "ot", "orr", "ob"))))
    out = layout.sequential_covers(b.where("i % 12 <> 0"), covers, ["page_id", "sheet"], order="i")
    return out.select("page_id", "i", "pl", "pt", "pr", "pb")
