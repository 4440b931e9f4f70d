"""Figure, fingerprint, catalogue and geometry queries. Embeddings stand in for 8 by 8 grey grids, parts and suppliers for boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.functions import vectors as vec
from lodestone.operators import figures, prompts
from lodestone.plans.registry import query, table, values
from lodestone.plans.retrieval import OVER, WITHOUT, W
from lodestone.sources import store

V = "embedding::DOUBLE[]"
FP_SQL = f"""g AS (SELECT vec_id AS id, {V} AS v, list_avg({V}) AS m, list_stddev_pop({V}) AS sd FROM embeddings),
f AS (SELECT id, list_transform(list_filter(range(1, len(v) + 1), lambda i: i % 8 <> 1), lambda i: v[i] > v[i - 1]) AS dh, list_transform(v, lambda x: x > m) AS ah,
  list_transform(v, lambda x: (x - m) / CASE WHEN sd > 1e-4 THEN sd ELSE 1.0 END) AS th,
  list_transform(range(0, 16), lambda b: len(list_filter(v, lambda x: x >= -1.0 AND x <= 1.0 AND least(15, floor((x + 1.0) / 0.125)) = b)) / (greatest(1, len(list_filter(v, lambda x: x >= -1.0 AND x <= 1.0))) * 0.125)) AS hi FROM g),
c AS (SELECT q.id AS query_id, c.id AS fig_id,
  1.0 - len(list_filter(range(1, len(q.dh) + 1), lambda i: q.dh[i] <> c.dh[i]))::DOUBLE / len(q.dh) AS d, 1.0 - len(list_filter(range(1, len(q.ah) + 1), lambda i: q.ah[i] <> c.ah[i]))::DOUBLE / len(q.ah) AS a,
  greatest(0.0, least(1.0, list_inner_product(q.th, c.th) / len(q.th))) AS n, list_transform(q.hi, lambda x: x - list_avg(q.hi)) AS qh, list_transform(c.hi, lambda x: x - list_avg(c.hi)) AS ch
  FROM f q JOIN f c ON q.id % 50 = 0 AND q.id <> c.id),
s AS (SELECT query_id, fig_id, d, a, n, greatest(0.0, least(1.0, (CASE WHEN list_inner_product(qh, qh) * list_inner_product(ch, ch) > 0 THEN list_inner_product(qh, ch) / sqrt(list_inner_product(qh, qh) * list_inner_product(ch, ch)) ELSE 0.0 END + 1.0) / 2.0)) AS h FROM c)"""


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    fp = figures.fingerprints(figures.spread(table(spark, sf, "embeddings"), "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("grid")), "grid")
    return fp.select("id", F.struct("dhash", "ahash", "thumb", "hist").alias("fp"))


@query(f"WITH {FP_SQL}, v AS (SELECT query_id, fig_id, round(greatest(0.0, least(1.0, 0.35 * d + 0.35 * n + 0.15 * a + 0.15 * h)), 6) AS similarity FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, fig_id)::INTEGER AS rank FROM v WHERE similarity >= 0.5) SELECT * FROM k WHERE rank <= 3")
def visual_similarity(spark: SparkSession, sf: str) -> DataFrame:
    fp = _fingerprints(spark, sf)
    return figures.visual_matches(fp.where(F.col("id") % 50 == 0), fp)


@query(f"WITH {FP_SQL} SELECT query_id, fig_id, round(d, 6) AS dhash_sim, round(a, 6) AS ahash_sim, round(n, 6) AS ncc, round(h, 6) AS hist_corr FROM s")
def fingerprint_parts(spark: SparkSession, sf: str) -> DataFrame:
    fp = _fingerprints(spark, sf)
    pairs = figures.fingerprint_pairs(fp.where(F.col("id") % 50 == 0), fp)  # a stated query set
    return pairs.select("query_id", "fig_id", *(F.round(c, 6).alias(name) for c, name in zip("danh", ("dhash_sim", "ahash_sim", "ncc", "hist_corr"), strict=True)))


FIG_SQL = "fg AS (SELECT p_partkey AS fig_id, p_partkey % 20 AS page, (p_partkey * 7 % 60) / 100.0::DOUBLE AS l, (p_partkey * 13 % 50) / 100.0::DOUBLE AS t, (p_partkey * 7 % 60) / 100.0::DOUBLE + 0.2 + (p_partkey % 3) / 10.0 AS r, (p_partkey * 13 % 50) / 100.0::DOUBLE + 0.1 + (p_partkey % 5) / 20.0 AS b FROM part), cp AS (SELECT c_custkey AS cap_id, c_custkey % 20 AS page, c_custkey AS block_no, (c_custkey * 11 % 60) / 100.0::DOUBLE AS cl, (c_custkey * 17 % 80) / 100.0::DOUBLE AS ct, (c_custkey * 11 % 60) / 100.0::DOUBLE + 0.3 AS cr, (c_custkey * 17 % 80) / 100.0::DOUBLE + 0.03 AS cb FROM customer)"


def _boxes(spark: SparkSession, sf: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    p, c = table(spark, sf, "part").select(F.col("p_partkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    fig = p.select(k.alias("fig_id"), (k % 20).alias("page"), (k * 7 % 60 / 100.0 * scale).alias("l"), (k * 13 % 50 / 100.0 * scale).alias("t"), ((k * 7 % 60 / 100.0 + 0.2 + k % 3 / 10.0) * scale).alias("r"), ((k * 13 % 50 / 100.0 + 0.1 + k % 5 / 20.0) * scale).alias("b"))
    cap = c.select(k.alias("cap_id"), (k % 20).alias("page"), k.alias("block_no"), (k * 11 % 60 / 100.0 * scale).alias("cl"), (k * 17 % 80 / 100.0 * scale).alias("ct"), ((k * 11 % 60 / 100.0 + 0.3) * scale).alias("cr"), ((k * 17 % 80 / 100.0 + 0.03) * scale).alias("cb"))
    return fig, cap


@query(f"WITH {FIG_SQL}, h AS (SELECT fig_id, arg_min(cap_id, block_no) AS cap_id FROM fg JOIN cp USING (page) WHERE least(r, cr) - greatest(l, cl) > 0.15 AND round(ct - b, 9) BETWEEN 0.0 AND 0.12 GROUP BY fig_id) SELECT fig_id, page, cap_id FROM fg LEFT JOIN h USING (fig_id)")
def figure_caption_join(spark: SparkSession, sf: str) -> DataFrame:
    fig, cap = _boxes(spark, sf)
    return figures.caption_join(fig, cap, ["page"]).select("fig_id", "page", "cap_id")


@query(f"WITH {FIG_SQL}, h AS (SELECT fig_id, arg_min(cap_id, block_no) AS cap_id FROM fg JOIN cp USING (page) WHERE abs(round(ct * 1000 - b * 1000, 6)) < 50 OR abs(round(cb * 1000 - t * 1000, 6)) < 50 GROUP BY fig_id) SELECT fig_id, cap_id FROM fg LEFT JOIN h USING (fig_id)")
def figure_caption_near(spark: SparkSession, sf: str) -> DataFrame:
    fig, cap = _boxes(spark, sf, 1000.0)
    r = lambda d, cols: d.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in d.columns])
    return figures.caption_near(r(fig, "ltrb"), r(cap, ("cl", "ct", "cr", "cb")), ["page"]).select("fig_id", "cap_id")


@query(f"""WITH {FIG_SQL}, e AS (SELECT page, round(l * 1000, 6) AS l, round(t * 1000, 6) AS t, round(r * 1000, 6) AS r, round(b * 1000, 6) AS b FROM fg), c AS (SELECT cap_id, page, round(ct * 1000, 6) AS ct, round(cb * 1000, 6) AS cb FROM cp),
g AS (SELECT cap_id, min(l) FILTER (b <= ct + 16 AND t >= ct - 680) AS ul, min(t) FILTER (b <= ct + 16 AND t >= ct - 680) AS ut, max(r) FILTER (b <= ct + 16 AND t >= ct - 680) AS ur, max(b) FILTER (b <= ct + 16 AND t >= ct - 680) AS ub,
 min(l) FILTER (t >= cb - 16 AND b <= cb + 680) AS dl, min(t) FILTER (t >= cb - 16 AND b <= cb + 680) AS dt, max(r) FILTER (t >= cb - 16 AND b <= cb + 680) AS dr, max(b) FILTER (t >= cb - 16 AND b <= cb + 680) AS db FROM c JOIN e USING (page) WHERE r - l > 5 AND b - t > 5 GROUP BY cap_id)
SELECT cap_id, CASE WHEN ur - ul >= 50 AND ub - ut >= 35 THEN 'figure' ELSE 'table' END AS kind, CASE WHEN ur - ul >= 50 AND ub - ut >= 35 THEN ul ELSE dl END AS l, CASE WHEN ur - ul >= 50 AND ub - ut >= 35 THEN ut ELSE dt END AS t,
 CASE WHEN ur - ul >= 50 AND ub - ut >= 35 THEN ur ELSE dr END AS r, CASE WHEN ur - ul >= 50 AND ub - ut >= 35 THEN ub ELSE db END AS b FROM g WHERE coalesce(ur - ul >= 50 AND ub - ut >= 35, false) OR coalesce(dr - dl >= 50 AND db - dt >= 35, false)""")
def box_union(spark: SparkSession, sf: str) -> DataFrame:
    fig, cap = _boxes(spark, sf, 1.0)
    r = lambda d, cols: d.select(*[F.round(F.col(c) * 1000, 6).alias(c) if c in cols else F.col(c) for c in d.columns])
    return figures.caption_boxes(r(cap, ("cl", "ct", "cr", "cb")), r(fig, "ltrb").drop("fig_id"), ["page"]).select("cap_id", "kind", "l", "t", "r", "b")


@query(f"""WITH {FIG_SQL} SELECT fig_id FROM fg WHERE NOT EXISTS (SELECT 1 FROM cp WHERE cp.page = fg.page AND greatest(0.0, least(r, cr) - greatest(l, cl)) * greatest(0.0, least(b, cb) - greatest(t, ct)) / ((r - l) * (b - t)) > 0.05)""")
def containment_anti(spark: SparkSession, sf: str) -> DataFrame:
    fig, cap = _boxes(spark, sf)
    covers = cap.select("page", F.col("cl").alias("ol"), F.col("ct").alias("ot"), F.col("cr").alias("orr"), F.col("cb").alias("ob"))
    return figures.outside_covers(fig, covers, ["page"], share=0.05).select("fig_id")


@query("""SELECT p_partkey AS k, w >= 50 AND h >= 50 AND w * h >= 4000 AND w / greatest(1.0, h) BETWEEN 0.05 AND 20 AND w * h / 500000.0 <= 0.9 AS figure, w >= 60 AND h >= 50 AND w * h < 425000 AS region, w > 60 AND h > 50 AND w * h < 425000 AS region_strict,
 p_size * 300 >= 4096 AND w >= 120 AND h >= 120 AS embedded, w >= 80 AND h >= 80 AND w * h >= 8000 AS object, round(w * h / 500000.0, 6)::DOUBLE AS area FROM (SELECT *, (p_partkey * 37 % 900)::DOUBLE AS w, (p_partkey * 53 % 700)::DOUBLE AS h FROM part)""")
def figure_size_filters(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), "p_size", (k * 37 % 900).cast("double").alias("w"), (k * 53 % 700).cast("double").alias("h"))
    w, h, a = F.col("w"), F.col("h"), F.lit(500000.0)
    return p.select("k", figures.size_filter(w, h, a).alias("figure"), figures.region_filter(w, h, a).alias("region"), figures.region_filter(w, h, a, strict=True).alias("region_strict"), figures.embedded_filter(F.col("p_size") * 300, w, h).alias("embedded"), figures.object_filter(w, h).alias("object"), F.round(w * h / a, 6).alias("area"))


_CAP = "CASE p_partkey % 4 WHEN 0 THEN 'Figure ' || p_partkey || ': ' || p_name WHEN 1 THEN '  fig. 3 ' || p_name WHEN 2 THEN 'Table' || p_name ELSE p_name || ' Figure 2' END"


@query(f"SELECT p_partkey, regexp_matches({_CAP}, {values([figures.CAPTION])}) AS is_caption FROM part")
def caption_detector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr(_CAP).rlike(figures.CAPTION).alias("is_caption"))


CHUNK_SQL = "ch AS (SELECT doc_id AS chunk_id, text || CASE WHEN doc_id % 7 = 0 THEN ' [Image URL: /i/fig' || (doc_id % 5) || '.png] [IMAGE / FIGURE: caption ' || (doc_id % 5) || ' the]' ELSE '' END AS text, source AS source_file, (doc_id // 4)::INTEGER AS page_number, CASE WHEN doc_id % 11 = 0 THEN '/i/fig' || (doc_id % 3) || '.png' ELSE '' END AS image_url FROM documents), mt AS (SELECT 'fig' || i || '.png' AS filename, 0.9 + i / 100.0::DOUBLE AS similarity FROM range(0, 2) x(i))"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    tag = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" [Image URL: /i/fig"), F.col("doc_id") % 5, F.lit(".png] [IMAGE / FIGURE: caption "), F.col("doc_id") % 5, F.lit(" the]"))).otherwise("")
    url = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("/i/fig"), F.col("doc_id") % 3, F.lit(".png"))).otherwise("")
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat("text", tag).alias("text"), F.col("source").alias("source_file"), F.floor(F.col("doc_id") / 4).cast("int").alias("page_number"), url.alias("image_url"))


@query(f"""WITH {CHUNK_SQL}, d AS (SELECT filename, chunk_id, text, source_file, page_number, similarity, greatest(0.95, similarity) AS score, 'direct' AS how FROM ch JOIN mt ON contains(text, filename) OR contains(image_url, filename)),
p AS (SELECT DISTINCT filename, source_file, page_number, similarity FROM d),
s AS (SELECT filename, chunk_id, text, source_file, page_number, similarity, greatest(0.85, similarity - 0.10) AS score, 'page' AS how FROM ch JOIN p USING (source_file, page_number) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.filename = p.filename AND d.text = ch.text))
SELECT filename, chunk_id, how, round(score, 6)::DOUBLE AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM s)""")
def figure_chunk_match(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([(f"fig{i}.png", 0.9 + i / 100.0) for i in range(2)], "filename string, similarity double")
    return figures.figure_chunks(_chunks(spark, sf), m).select("filename", "chunk_id", "how", F.round("score", 6).alias("score"))


_Q = "CASE source_file WHEN 'src0' THEN 'show me the caption diagram' WHEN 'src1' THEN 'what is the caption' WHEN 'src2' THEN 'caption without images' ELSE 'a caption word' END"


@query(f"""WITH {CHUNK_SQL}, q AS (SELECT *, {_Q} AS question, 0.3 + (chunk_id % 7) / 10.0 AS score FROM ch),
e AS (SELECT *, ({' OR '.join(f"contains(lower(question), {values([w])})" for w in tx.EXPLICIT_VISUAL)}) AS ex, ({' OR '.join(f"contains(lower(question), {values([w])})" for w in tx.NO_DIAGRAM)}) AS neg, ({' OR '.join(f"starts_with(lower(question), {values([w])})" for w in tx.CONCEPTUAL)}) AS con FROM q),
u AS (SELECT *, list_concat(CASE WHEN length(image_url) > 0 THEN [image_url] ELSE [] END, list_filter(list_transform(regexp_extract_all(text, '\\[Image URL:\\s*(.*?)\\]', 1), lambda x: trim(x)), lambda x: length(x) > 0)) AS us FROM e WHERE NOT (neg OR (con AND NOT ex))),
x AS (SELECT *, unnest(us) AS url, generate_subscripts(us, 1) AS pos FROM u),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_file, url ORDER BY chunk_id, pos) AS n FROM x) WHERE n = 1),
s AS (SELECT *, {WITHOUT(W('question'), tx.STOP_IMAGE)} AS sw, lower(regexp_extract(url, '([^/]*)$', 1) || ' ' || trim(regexp_extract(text, '(?i)\\[IMAGE / FIGURE:\\s*(.*?)\\]', 1)) || ' ' || text[1:1500]) AS body FROM f),
o AS (SELECT *, {OVER('sw', 'body')} AS overlap FROM s),
r AS (SELECT *, least(100.0, round(greatest(40.0, round(CASE WHEN score < 0.38 AND overlap = 0 THEN 0.0 WHEN overlap > 0 THEN least(1.0, greatest(0.0, least(1.0, (score - 0.38) / 0.47)) + 0.15) ELSE greatest(0.0, least(1.0, (score - 0.38) / 0.47)) END, 4)::DOUBLE * 100.0 + overlap * 8), 1)) AS relevance FROM o WHERE NOT (ex AND len(sw) > 0 AND overlap = 0) AND (ex OR overlap > 0)),
k AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY overlap DESC, relevance DESC, chunk_id, pos) AS rank FROM r)
SELECT source_file, url, overlap::INTEGER AS overlap, relevance::DOUBLE AS relevance, rank::INTEGER AS rank FROM k WHERE rank <= CASE WHEN ex THEN 3 ELSE 1 END""")
def relevant_images(spark: SparkSession, sf: str) -> DataFrame:
    """Each source is a conversation with one question."""
    c = _chunks(spark, sf).withColumns({"question": F.expr(_Q), "score": 0.3 + F.col("chunk_id") % 7 / 10.0})
    return prompts.relevant_images(c, query="source_file", question="question", text="text", score="score", order="chunk_id", url="image_url")


@query("""SELECT s_suppkey AS k, grounded OR (NOT grounded AND matched) OR (NOT grounded AND NOT matched AND top >= 0.40) AS is_grounded, CASE WHEN NOT grounded AND matched THEN greatest(conf, 0.78) WHEN NOT grounded AND top >= 0.40 THEN greatest(conf, 0.65) ELSE conf END::DOUBLE AS confidence
FROM (SELECT s_suppkey, s_suppkey % 3 = 0 AS grounded, s_suppkey % 2 = 0 AS matched, (s_suppkey % 10) / 10.0 AS top, (s_suppkey % 9) / 10.0 AS conf FROM supplier)""")
def image_grounding(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    d = table(spark, sf, "supplier").select(k.alias("k"), (k % 3 == 0).alias("is_grounded"), (k % 9 / 10.0).alias("confidence"), (k % 2 == 0).alias("m"), (k % 10 / 10.0).alias("top"))
    return prompts.image_grounding(d, grounded="is_grounded", confidence="confidence", matched=F.col("m"), has_chunks=F.lit(True), top_score=F.col("top")).select("k", "is_grounded", "confidence")


@query("WITH d AS (SELECT event_id, user_id, value, (event_id * 31 % 50)::VARCHAR AS dhash FROM events) SELECT user_id, dhash, min(event_id) AS event_id FROM d GROUP BY user_id, dhash")
def unique_figures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") * 31 % 50).cast("string").alias("dhash"))
    return figures.unique_figures(e, "user_id", "dhash", "event_id").select("user_id", "dhash", "event_id")


@query("WITH c AS (SELECT doc_id, doc_id % 7 = 0 AS has_image FROM documents) SELECT doc_id, 0.85::DOUBLE AS score FROM c WHERE has_image ORDER BY doc_id LIMIT 6")
def image_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("has_image"), F.lit("").alias("image_url"))
    return store.image_chunks(d, "doc_id").select("doc_id", "score")


@query("SELECT source AS document, count(*) AS n_chunks, count(*) FILTER (doc_id % 3 = 0) AS visual_crops, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def visual_crop_count(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("image_path", F.when(F.col("doc_id") % 3 == 0, F.lit("x")))
    return d.groupBy(F.col("source").alias("document")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("image_path").isNotNull()).alias("visual_crops"), F.sum("n_chars").alias("chars"))


# --- Catalogues ---------------------------------------------------------------------------------------------------

#: Parts of even keys stand in for a catalogue of models, those of keys divisible by three for the installed ones.
CAT_SQL = """cat AS (SELECT 'm' || p_partkey || ':' || p_size || 'b' AS name, 'm' || p_partkey AS tag, 'text' AS category, p_size / 4.0 AS size_gb, p_size / 5.0 AS required_vram_gb FROM part WHERE p_partkey % 2 = 0),
inst AS (SELECT p_partkey AS position, 'm' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '-vision' WHEN p_partkey % 5 = 0 THEN ':latest' WHEN p_partkey % 5 = 1 THEN ':' || p_size || 'b' ELSE '' END AS name FROM part WHERE p_partkey % 3 = 0)"""


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    tag, sized = F.concat(F.lit("m"), k), F.concat(F.lit(":"), "p_size", F.lit("b"))
    cat = p.where(k % 2 == 0).select(F.concat(tag, sized).alias("name"), tag.alias("tag"), F.lit("text").alias("category"), (F.col("p_size") / 4.0).alias("size_gb"), (F.col("p_size") / 5.0).alias("required_vram_gb"))
    end = F.when(k % 7 == 0, "-vision").when(k % 5 == 0, ":latest").when(k % 5 == 1, sized).otherwise("")
    return cat, p.where(k % 3 == 0).select(k.alias("position"), F.concat(tag, end).alias("name"))


_FIT = lambda v: f"CASE WHEN 4.0 >= {v} THEN 'recommended' WHEN 6.0 >= {v} THEN 'compatible' WHEN 16.0 >= {v} * 1.5 THEN 'heavy' ELSE 'unsupported' END"


@query(f"""WITH {CAT_SQL}, k AS (SELECT name, tag, category, size_gb::DOUBLE AS size_gb, required_vram_gb::DOUBLE AS required_vram_gb, EXISTS (SELECT 1 FROM inst i WHERE i.name IN (cat.name, cat.tag) OR split_part(i.name, ':', 1) = split_part(cat.name, ':', 1)) AS is_installed, {_FIT('required_vram_gb')} AS compatibility FROM cat),
o AS (SELECT name, name AS tag, CASE WHEN regexp_matches(lower(name), 'vision|moondream|llava|ocr|vl') THEN 'vision' ELSE 'text' END AS category, 2.0::DOUBLE AS size_gb, 2.5::DOUBLE AS required_vram_gb, true AS is_installed, {_FIT('2.5')} AS compatibility, true AS is_recommended FROM inst WHERE split_part(name, ':', 1) NOT IN (SELECT split_part(name, ':', 1) FROM cat))
SELECT *, compatibility IN ('recommended', 'compatible') AND size_gb <= 3.5 AS is_recommended FROM k UNION ALL SELECT * FROM o""")
def model_catalog_status(spark: SparkSession, sf: str) -> DataFrame:
    cat, inst = _catalog(spark, sf)
    return prompts.catalog_status(cat, inst, 4.0, 16.0)


@query(f"""WITH {CAT_SQL}, w AS (SELECT DISTINCT 'm' || p_partkey % 60 AS name FROM part), j AS (SELECT w.name, i.name AS inst, CASE WHEN i.name = w.name THEN 0 WHEN i.name = w.name || ':latest' THEN 1 ELSE 2 END AS o, position FROM w LEFT JOIN inst i ON contains(lower(i.name), lower(w.name)))
SELECT name, arg_min(inst, o * 1000000000 + position) AS resolved FROM j GROUP BY name""")
def vision_model_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Up to sixty names, each held against all installed models."""
    wanted = table(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey") % 60).alias("name")).distinct()
    return prompts.resolve_model(wanted, _catalog(spark, sf)[1])


@query(f"SELECT p_partkey, CASE WHEN v >= 12 THEN 'ultra' WHEN v >= 6 THEN 'high' WHEN v >= 3.5 THEN 'recommended_4gb' ELSE 'cpu_entry' END AS tier, CASE WHEN v >= n THEN 'recommended' WHEN v + 2.0 >= n THEN 'compatible' WHEN m >= n * 1.5 THEN 'heavy' ELSE 'unsupported' END AS fit, ({' OR '.join(f'contains(lower(p_name), {values([w])})' for w in prompts.VISION_MODELS)}) AS vision, regexp_replace('ollama:' || p_name, '^(local:|cloud:|ollama:)', '') AS model FROM (SELECT *, (p_partkey % 30) / 2.0 AS v, (p_partkey % 64)::DOUBLE AS m, (p_size)::DOUBLE AS n FROM part)")
def hardware_ladder(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    v, m, n = F.col("p_partkey") % 30 / 2.0, (F.col("p_partkey") % 64).cast("double"), F.col("p_size").cast("double")
    return p.select("p_partkey", sc.hardware_tier(v).alias("tier"), sc.compatibility(v, m, n).alias("fit"), prompts.is_vision_model(F.col("p_name")).alias("vision"), prompts.strip_provider(F.concat(F.lit("ollama:"), "p_name")).alias("model"))


_CATALOG_SQL = ", ".join(f"({values([n])}, {d}, {values([q])}, {values([p])})" for n, d, q, p in store.EMBEDDING_MODELS)


@query(f"WITH c AS (SELECT * FROM (VALUES {_CATALOG_SQL}) v(name, dim, query_prefix, passage_prefix)) SELECT item_id, name AS model, dim, query_prefix || text AS text FROM benchmark JOIN c ON true")
def embedding_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    c = store.embedding_catalog(spark)
    t = table(spark, sf, "benchmark").crossJoin(F.broadcast(c.select(F.col("name").alias("model"), "dim")))  # five models
    return store.with_prefix(t, c).select("item_id", "model", "dim", "text")


@query("SELECT item_id, trim(concat_ws(' ', trim(text), 'match ' || item_id, nullif(array_to_string(list_filter(regexp_split_to_array('a & bc ' || item_id, '\\s+'), lambda w: length(w) > 1 OR regexp_matches(w, '^[\\p{L}\\p{N}]$')), ' '), ''), nullif(trim(text[1:300]), ''))) AS topic, CASE WHEN item_id % 2 = 0 THEN " + values([prompts.STYLES["concise"]]) + " ELSE " + values([prompts.STYLES["detailed"]]) + " END AS suffix FROM benchmark")
def visual_topic(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    topic = prompts.visual_topic(F.col("text"), F.concat(F.lit("match "), "item_id"), F.concat(F.lit("a & bc "), "item_id"), F.col("text"))
    return b.select("item_id", topic.alias("topic"), prompts.style_suffix(F.when(F.col("item_id") % 2 == 0, "concise").otherwise("detailed")).alias("suffix"))




_CAPS = "CASE p_partkey % 8 WHEN 0 THEN 'Figure ' || p_partkey || ': ' || p_name WHEN 1 THEN '  fig. 3 ' || p_name WHEN 2 THEN 'Table' || p_name WHEN 3 THEN 'Workflow of ' || p_name WHEN 4 THEN 'Scheme A. ' || p_name WHEN 5 THEN 'Map 4' || chr(10) || p_name WHEN 6 THEN 'Photo' || repeat(p_name, 30) ELSE p_name || ' Figure 2' END"


@query(f"""WITH t AS (SELECT p_partkey, regexp_replace({_CAPS}, '^\\s+|\\s+$', '', 'g') AS t FROM part)
SELECT p_partkey, regexp_matches(trim(split_part(t, chr(10), 1)), {values([figures.CAPTION_CROP])}) AND length(t) < 2500 AS crop, regexp_matches(t, {values([figures.CAPTION_REGION])}) AND length(t) < 300 AS region, regexp_matches(t, {values([figures.CAPTION_BLOCK])}) AS block FROM t""")
def caption_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", figures.caption_kinds(F.expr(_CAPS)).alias("c")).select("p_partkey", "c.*")


@query("""WITH p AS (SELECT c_custkey AS parent_id, c_nationkey AS doc_id, [c_custkey % 5, c_custkey % 3] AS pages FROM customer),
f AS (SELECT s_suppkey, s_nationkey AS doc_id, s_suppkey % 5 AS page FROM supplier)
SELECT p.doc_id, parent_id, count(DISTINCT s_suppkey) AS n, coalesce(string_agg(DISTINCT page || ':' || s_suppkey, ',' ORDER BY page || ':' || s_suppkey), '') AS figures FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND list_contains(p.pages, f.page) GROUP BY p.doc_id, parent_id""")
def figures_of_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand in for sections, their nations for documents, suppliers for figures."""
    key = F.col("c_custkey")
    p = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc_id"), key.alias("parent_id"), F.array((key % 5).cast("long"), (key % 3).cast("long")).alias("pages"))
    f = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("doc_id"), (F.col("s_suppkey") % 5).cast("long").alias("page"), "s_suppkey")
    names = lambda held: F.array_sort(F.transform(held, lambda x: F.concat(x["page"].cast("string"), F.lit(":"), x["s_suppkey"].cast("string"))))
    listed = lambda held: {"n": F.size(held).cast("long"), "figures": F.array_join(names(held), ",")}
    out = figures.figures_of_parents(p, f, doc="doc_id", parent="parent_id", pages="pages", page="page", figure=["s_suppkey"], derived=listed)
    return out.select("doc_id", "parent_id", "n", "figures")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS fig FROM lineitem), f AS (SELECT l_orderkey, fig, min(l_linenumber) AS pos FROM x GROUP BY ALL)
SELECT l_orderkey, string_agg('fig' || fig, ',' ORDER BY pos, fig) AS figures FROM f GROUP BY l_orderkey""")
def resolved_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand in for questions, their lines for contexts with a figure each."""
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.struct(F.concat(F.lit("fig"), F.col("l_suppkey") % 4).alias("id"))).alias("figures"))
    return figures.resolved_figures(c, query="l_orderkey", order="l_linenumber").select("l_orderkey", F.array_join(F.transform("figures", lambda x: x["id"]), ",").alias("figures"))


_GRID = "concat(embedding, slice(embedding, 1, 8))"
BITS = lambda g, op, skip: f"list_transform(list_filter(range(1, 73), lambda i: i % 9 <> {skip}), lambda i: ({g}[i] > {g}[i {op} 1])::INT)"


@query(f"""WITH g AS (SELECT vec_id, list_concat({V}, ({V})[1:8]) AS g FROM embeddings), b AS (SELECT vec_id, {BITS('g', '-', 1)} AS b, {BITS('g', '+', 0)} AS r FROM g)
SELECT vec_id, len(b) AS n_bits, list_aggregate(list_transform(b, lambda x: x::VARCHAR), 'string_agg', '') AS bits,
  list_aggregate(list_transform(range(0, 16), lambda i: format('{{:x}}', r[4 * i + 1] + 2 * r[4 * i + 2] + 4 * r[4 * i + 3] + 8 * r[4 * i + 4])), 'string_agg', '') AS hex FROM b""")
def gradient_hash_64(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with their first row repeated stand in for nine by eight grids."""
    g = table(spark, sf, "embeddings").select("vec_id", F.expr(_GRID).cast("array<double>").alias("g"))
    b = g.select("vec_id", vec.gradient_hash(F.col("g"), 9).alias("b"), vec.gradient_hex(F.col("g")).alias("hex"))
    return b.select("vec_id", F.size("b").cast("long").alias("n_bits"), F.array_join(F.transform("b", lambda x: x.cast("int").cast("string")), "").alias("bits"), "hex")


@query(f"""WITH g AS (SELECT vec_id, c, list_filter(({V})[c * 21 + 1 : c * 21 + 21], lambda x: x >= -1.0 AND x <= 1.0) AS v FROM embeddings, range(0, 3) t(c))
SELECT vec_id, (c * 16 + b)::INTEGER AS slot, round(len(list_filter(v, lambda x: least(15, floor((x + 1.0) / 0.125)) = b)) / (greatest(1, len(v)) * 0.125), 6)::DOUBLE AS density FROM g, range(0, 16) s(b)""")
def colour_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Thirds of an embedding stand in for the colours of a picture."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    h = vec.colour_histogram([F.slice("e", k * 21 + 1, 21) for k in range(3)])
    return e.select("vec_id", F.posexplode(h).alias("slot", "density")).select("vec_id", "slot", F.round("density", 6).alias("density"))
