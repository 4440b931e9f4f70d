"""Retrieval queries over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.operators import chat, dense, fusion, guardrails, lexical, prompts
from lodestone.plans.registry import query, table, values
from lodestone.sources import store
from lodestone.sources.work import written

TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
W = lambda c, n=3: f"list_distinct(list_filter({TOK.format(c)}, lambda w: length(w) >= {n}))"
WITHOUT = lambda l, stop: f"list_filter({l}, lambda w: NOT list_contains([{values(stop)}], w))"
OVER = lambda l, t: f"len(list_filter({l}, lambda w: contains({t}, w)))"

BM25_SQL = f"""
bd AS (SELECT doc_id, {TOK.format('text')} AS t FROM documents),
bn AS (SELECT count(*) AS n, coalesce(avg(len(t)), 1.0) AS a FROM bd),
btf AS (SELECT doc_id, dl, term, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM bd) GROUP BY ALL),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bq AS (SELECT item_id, term, count(*) AS m FROM (SELECT item_id, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT item_id, doc_id, round(sum(m * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * dl / a))), 6) AS score
       FROM btf JOIN bdf USING (term) JOIN bq USING (term), bn GROUP BY item_id, doc_id),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0) WHERE rank <= 30)"""

HASH = lambda t, k, c: f"""
{t}w AS (SELECT {k}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: length(w) > 0) AS w FROM {c}),
{t}p AS (SELECT {k}, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM {t}w),
{t}h AS (SELECT {k}, i, md5(word) AS h FROM {t}p),
{t}v AS (SELECT {k}, ((('0x' || h[1:16])::UBIGINT::HUGEINT % 384) * (18446744073709551616::HUGEINT % 384) + ('0x' || h[17:32])::UBIGINT::HUGEINT % 384)::HUGEINT % 384 AS slot,
          CASE WHEN ('0x' || h[32:32])::INT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE / sqrt(i) AS x FROM {t}h
        UNION ALL SELECT {k}, 0, 1.0 FROM {t}w WHERE len(w) = 0),
{t}s AS (SELECT {k}, slot, sum(x) AS x FROM {t}v GROUP BY {k}, slot),
{t}e AS (SELECT {k}, slot, x / sqrt(sum(x * x) OVER (PARTITION BY {k})) AS x FROM {t}s)"""  # noqa: E731

DENSE_SQL = f"""{HASH('hd', 'doc_id', 'documents')},{HASH('hq', 'item_id', 'benchmark')},
dsum AS (SELECT item_id, doc_id, sum(d.x * q.x) AS s FROM hde d JOIN hqe q USING (slot) GROUP BY item_id, doc_id),
dall AS (SELECT b.item_id, d.doc_id, round(coalesce(s, 0.0) + 0.0, 6) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN dsum s ON s.item_id = b.item_id AND s.doc_id = d.doc_id),
drank AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dall)"""


def _dense(spark: SparkSession, sf: str, k: int) -> DataFrame:
    asked = table(spark, sf, "benchmark").select("item_id", dense.embedder()("text").alias("vector"))
    return dense.top_k(table(spark, sf, "documents"), asked, k, doc="doc_id", query="item_id", content="text", reader=dense.hashed())


def _bm25(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), doc="doc_id", query="item_id")


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM bm25")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf)


@query(f"WITH {BM25_SQL}, a AS (SELECT term, count(DISTINCT doc_id) AS df FROM btf GROUP BY term) SELECT term, df, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM a, bn")
def term_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    out = lexical.document_frequencies(table(spark, sf, "documents"), "doc_id")
    return out.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""
WITH c AS (SELECT item_id, lower(trim(text)) AS clean FROM benchmark),
t AS (SELECT item_id, list_concat(CASE WHEN len(list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: length(w) > 0)) <= 4 THEN [clean] ELSE [] END,
        list_filter({TOK.format('clean')}, lambda w: length(w) >= 4 AND NOT list_contains([{values(tx.STOP_KEYWORD)}], w))[1:3]) AS ts FROM c),
u AS (SELECT item_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS term_no FROM t),
h AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS n FROM (SELECT DISTINCT term FROM u) x JOIN documents d ON contains(lower(coalesce(d.text, '')), x.term)),
f AS (SELECT item_id, doc_id, min(term_no) AS term_no FROM u JOIN h USING (term) WHERE n <= 3 GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, 0.75::DOUBLE AS score, row_number() OVER (PARTITION BY item_id ORDER BY term_no, doc_id)::INTEGER AS rank FROM f)
SELECT * FROM r WHERE rank <= 3""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.keyword_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), doc="doc_id", query="item_id", top=3)


@query(f"WITH {HASH('hd', 'doc_id', 'documents')} SELECT doc_id, slot::INTEGER AS slot, round(x, 6) AS value FROM hde WHERE round(x, 6) <> 0")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return dense.hash_embedding(table(spark, sf, "documents"), "doc_id").select("doc_id", "slot", F.round("value", 6).alias("value")).where("value <> 0")


EMB = "list_inner_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
DENSE_EMB = lambda extra="": f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round({EMB.format('q', 'c')}, 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)"""  # noqa: E731


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def _vector_queries(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vector")


@query(DENSE_EMB() + " SELECT * FROM r WHERE rank <= 6")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return dense.top_k(v, _vector_queries(v), 6, doc="vec_id", query="query_id")


@query(DENSE_EMB("AND c.label = 3") + " SELECT * FROM r WHERE rank <= 6")
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return dense.top_k(v.where("label = 3"), _vector_queries(v), 6, doc="vec_id", query="query_id")


@query(DENSE_EMB() + " SELECT query_id, vec_id, round(greatest(0.0, 1.0 - (1.0 - score)), 4) AS score, round(1.0 - score, 4) AS distance, vec_id % 3 = 0 AS is_visual FROM r WHERE rank <= 12")
def cosine_score_projection(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    hits = dense.top_k(v, _vector_queries(v), 12, doc="vec_id", query="query_id")
    path = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("fig_"), "vec_id"))  # stands in for an image path
    return hits.select("query_id", "vec_id", sc.from_distance(1.0 - F.col("score")).alias("score"), F.round(1.0 - F.col("score"), 4).alias("distance"), path.isNotNull().alias("is_visual"))


RRF_SQL = f"""{BM25_SQL},{DENSE_SQL},
u AS (SELECT coalesce(d.item_id, b.item_id) AS item_id, coalesce(d.doc_id, b.doc_id) AS doc_id, d.rank AS dense_rank, b.rank AS bm25_rank, d.score AS dense_score
      FROM (SELECT * FROM drank WHERE rank <= 30) d FULL JOIN bm25 b ON d.item_id = b.item_id AND d.doc_id = b.doc_id),
f AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0.0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0.0), 8) AS rrf FROM u),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM f) WHERE rank <= 30)"""
RERANK_SQL = f"""{RRF_SQL},
lg AS (SELECT *, round(1.5 * (1.0 - coalesce(1.0 - dense_score, 1.0)), 7) AS logit FROM rrf),
pb AS (SELECT *, round(1.0 / (1.0 + exp(-greatest(-15.0, least(15.0, logit)))), 6) AS prob FROM lg),
rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY prob DESC, doc_id) AS final_rank FROM pb) WHERE final_rank <= 5)"""


def _rrf(spark: SparkSession, sf: str) -> DataFrame:
    d = written(_dense(spark, sf, 30))  # asked for twice
    fused = fusion.reciprocal_rank(d, _bm25(spark, sf), query="item_id", doc="doc_id")
    return fused.join(d.select("item_id", "doc_id", F.col("score").alias("dense_score")), ["item_id", "doc_id"], "left")


def _rerank(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rerank(_rrf(spark, sf).withColumn("distance", 1.0 - F.col("dense_score")), query="item_id", doc="doc_id")


@query(f"WITH {RRF_SQL} SELECT item_id, doc_id, dense_rank::INTEGER AS dense_rank, bm25_rank::INTEGER AS bm25_rank, rrf, rank::INTEGER AS rank FROM rrf")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _rrf(spark, sf).select("item_id", "doc_id", "dense_rank", "bm25_rank", "rrf", "rank")


@query(f"WITH {RERANK_SQL} SELECT item_id, doc_id, logit, prob, final_rank::INTEGER AS final_rank FROM rr")
def rerank_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return _rerank(spark, sf).select("item_id", "doc_id", "logit", "prob", "final_rank")


PARENT_SQL = "par AS (SELECT source, arg_min(text, doc_id) AS full_content FROM documents GROUP BY source)"


def _parents(spark: SparkSession, sf: str) -> DataFrame:
    """A parent for each source: its first text."""
    return table(spark, sf, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("full_content"))


def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    hits = docs.join(lexical.bounded(_rerank(spark, sf)), "doc_id")
    return fusion.expand_parents(hits, _parents(spark, sf), "source")


@query(f"WITH {RERANK_SQL}, {PARENT_SQL} SELECT item_id, rr.doc_id, final_rank::INTEGER AS final_rank, md5(coalesce(full_content, text)) AS context_md5 FROM rr JOIN documents d USING (doc_id) LEFT JOIN par ON par.source = d.source")
def parent_expand(spark: SparkSession, sf: str) -> DataFrame:
    return _expanded(spark, sf).select("item_id", "doc_id", "final_rank", F.md5(F.col("parent_context").cast("binary")).alias("context_md5"))


STATS_SQL = f"""sims AS (SELECT {EMB.format('q', 'c')} AS x FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
cs AS (SELECT count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(x) ELSE 0.42 END, 6) AS mean, round(CASE WHEN count(*) >= 10 THEN greatest(0.01, stddev_samp(x)) ELSE 0.09 END, 6) AS std FROM sims)"""


@query(f"WITH {STATS_SQL} SELECT * FROM cs")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return guardrails.pair_stats(v, _vector_queries(v), key="vec_id", query="query_id")  # a stated query set


@query(f"""WITH {RERANK_SQL}, {PARENT_SQL}, {STATS_SQL},
top AS (SELECT b.item_id, b.text AS question, rr.prob, coalesce(par.full_content, d.text) AS ctx FROM benchmark b LEFT JOIN rr ON rr.item_id = b.item_id AND final_rank = 1 LEFT JOIN documents d ON d.doc_id = rr.doc_id LEFT JOIN par ON par.source = d.source),
h AS (SELECT *, list_distinct(list_transform(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda w: length(w) > 3), lambda w: lower(w))) AS hw FROM top),
n AS (SELECT *, round(CASE WHEN len(hw) = 0 THEN 0.85 ELSE greatest(0.05, least(1.0, {OVER('hw', "lower(coalesce(ctx, ''))")}::DOUBLE / len(hw) * 1.25)) END, 6) AS nli0 FROM h),
g AS (SELECT *, CASE WHEN prob IS NULL THEN 'NO_CANDIDATES_RETRIEVED' WHEN prob < 0.5 THEN 'CROSS_ENCODER_CONFIDENCE_LOW' WHEN nli0 < 0.15 THEN 'NLI_CONTRADICTION_OR_NEUTRAL' END AS refusal_reason FROM n)
SELECT item_id, prob, CASE WHEN coalesce(refusal_reason IN ('NO_CANDIDATES_RETRIEVED', 'CROSS_ENCODER_CONFIDENCE_LOW'), false) THEN 0.0 ELSE nli0 END AS nli,
  round(CASE WHEN coalesce(refusal_reason IN ('NO_CANDIDATES_RETRIEVED', 'CROSS_ENCODER_CONFIDENCE_LOW'), false) THEN 0.0 ELSE ((ln(prob / (1.0 - prob)) + 15.0) / 30.0 - (SELECT mean FROM cs)) / (SELECT std FROM cs) END, 4) AS z,
  refusal_reason IS NULL AS passed, refusal_reason FROM g""")
def gate_ladder(spark: SparkSession, sf: str) -> DataFrame:
    top = _expanded(spark, sf).where("final_rank = 1").select("item_id", "prob", "parent_context")
    best = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")).join(top, "item_id", "left")
    stats = corpus_stats(spark, sf).select("mean", "std")  # of the stored vectors
    return guardrails.gate(best, stats, question="question", context="parent_context").select("item_id", "prob", "nli", "z", "passed", "refusal_reason")


def _candidates(spark: SparkSession, sf: str, k: int = 12) -> DataFrame:
    """Dense hits with question and text."""
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    hits = _dense(spark, sf, k).join(F.broadcast(q) if q.limit(100_001).count() <= 100_000 else q, "item_id")
    return table(spark, sf, "documents").select("doc_id", "text", "source").join(lexical.bounded(hits), "doc_id")


HITS_SQL = "c AS (SELECT r.item_id, r.doc_id, r.score, r.rank, b.text AS question, d.text, d.source FROM drank r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE r.rank <= 12)"
FILTER_SQL = lambda cut, c=HITS_SQL: f"""{DENSE_SQL},
{c},
cw AS (SELECT *, {WITHOUT(W('question'), tx.STOP_FILTER)} AS cw FROM c),
lx AS (SELECT *, len(cw) AS n, {OVER('cw', 'lower(text)')} AS lex, length(trim(question)) >= 4 AND contains(lower(text), lower(trim(question))) AS ex FROM cw),
rs AS (SELECT *, CASE WHEN ex THEN 'exact' WHEN lex >= 2 OR (lex >= 1 AND (n <= 3 OR score >= 0.22)) THEN 'lexical' WHEN score >= {cut} THEN 'score' END AS reason0 FROM lx),
ks AS (SELECT *, CASE reason0 WHEN 'exact' THEN greatest(score, 0.70) WHEN 'lexical' THEN greatest(score, 0.50 + least(0.35, lex * 0.05)) ELSE score END::DOUBLE AS kept_score,
        max((reason0 IS NOT NULL)::INT) OVER (PARTITION BY item_id) AS anyk FROM rs),
fb AS (SELECT *, anyk = 0 AND score >= CASE WHEN n = 0 THEN 0.25 ELSE 0.38 END AS fbk FROM ks),
fa AS (SELECT *, row_number() OVER (PARTITION BY item_id, fbk ORDER BY rank) AS nth FROM fb),
kept AS (SELECT *, coalesce(reason0, CASE WHEN fbk AND nth <= 4 THEN 'fallback' END) AS reason FROM fa WHERE coalesce(reason0, CASE WHEN fbk AND nth <= 4 THEN 'fallback' END) IS NOT NULL)"""  # noqa: E731


def _kept(spark: SparkSession, sf: str, cut: float = 0.35) -> DataFrame:
    return guardrails.relevance_filter(_candidates(spark, sf), query="item_id", question="question", text="text", score="score", order="rank", cut=cut)


@query(f"WITH {FILTER_SQL(0.35)} SELECT item_id, doc_id, round(kept_score, 6) AS kept_score, reason FROM kept")
def relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf, sc.threshold("balanced")).select("item_id", "doc_id", F.round("kept_score", 6).alias("kept_score"), "reason")


@query(f"""WITH {DENSE_SQL}, c AS (SELECT item_id, doc_id, score, rank FROM drank WHERE rank <= 12),
t AS (SELECT * FROM (VALUES ('strict', 0.42), ('balanced', 0.35), ('creative', 0.22)) v(strictness, cut)),
k AS (SELECT *, score >= cut AS k, max((score >= cut)::INT) OVER (PARTITION BY strictness, item_id) AS anyk, score >= 0.25 AS f FROM c, t),
a AS (SELECT *, row_number() OVER (PARTITION BY strictness, item_id, anyk = 0 AND f ORDER BY rank) AS nth FROM k)
SELECT strictness, item_id, doc_id, CASE WHEN k THEN 'score' ELSE 'fallback' END AS reason FROM a WHERE k OR (anyk = 0 AND f AND nth <= 4)""")
def relevance_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Questions without content words, at each strictness: only scores decide, and the fallback below them."""
    c = _dense(spark, sf, 12).withColumns({"question": F.lit("is the"), "text": F.lit("")})
    out = None
    for name in ("strict", "balanced", "creative"):
        k = guardrails.relevance_filter(c, query="item_id", question="question", text="text", score="score", order="rank", cut=sc.threshold(name)).select(F.lit(name).alias("strictness"), "item_id", "doc_id", "reason")
        out = k if out is None else out.unionByName(k)
    return out


HIST_SQL = """hl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
hist AS (SELECT conv_id AS item_id, string_agg(text, chr(10) ORDER BY turn) AS history FROM hl WHERE rn <= 2 GROUP BY conv_id)"""


def _with_history(spark: SparkSession, sf: str, kept: DataFrame) -> DataFrame:
    h = chat.history_text(table(spark, sf, "conversations"), "conv_id", "turn", "text").withColumnRenamed("conv_id", "item_id")
    return kept.join(h, "item_id", "left")


@query(f"""WITH {FILTER_SQL(0.35)}, {HIST_SQL},
o AS (SELECT k.item_id, k.doc_id, k.rank, kept_score, k.doc_id % 4 = 0 AS fig, {OVER(W('question'), 'lower(text)')} AS ov, CASE WHEN history IS NULL THEN 0 ELSE {OVER(W('history'), 'lower(text)')} END AS hv FROM kept k LEFT JOIN hist USING (item_id)),
s AS (SELECT *, round(kept_score * 0.65 + least(ov * 0.08, 0.25) + least(hv * 0.04, 0.10) + CASE WHEN fig THEN 0.05 ELSE 0.0 END, 6)::DOUBLE AS composite FROM o)
SELECT item_id, doc_id, composite, row_number() OVER (PARTITION BY item_id ORDER BY composite DESC, rank)::INTEGER AS attention_rank FROM s""")
def attention_rerank(spark: SparkSession, sf: str) -> DataFrame:
    k = _with_history(spark, sf, _kept(spark, sf))
    out = guardrails.attention_rerank(k, query="item_id", question="question", text="text", score="kept_score", order="rank", history="history", has_figure=F.col("doc_id") % 4 == 0)
    return out.select("item_id", "doc_id", "composite", "attention_rank")


@query(f"""WITH {FILTER_SQL(0.35)}, {HIST_SQL},
o AS (SELECT k.item_id, k.doc_id, k.rank, score, {OVER(W('question'), 'lower(text)')} AS ov, len({W('question')}) AS nq, {OVER(W('history'), 'lower(text)')} AS hv, len({W('history')}) AS nh, contains(text, '[DIAGRAM') AS tag FROM kept k LEFT JOIN hist USING (item_id)),
s AS (SELECT *, round(score + least(0.35, ov::DOUBLE / greatest(1, nq) * 0.35) + CASE WHEN nh > 0 THEN least(0.15, hv::DOUBLE / greatest(1, nh) * 0.15) ELSE 0.0 END + CASE WHEN tag THEN 0.05 ELSE 0.0 END, 6) AS composite FROM o),
r AS (SELECT item_id, doc_id, composite, row_number() OVER (PARTITION BY item_id ORDER BY composite DESC, rank)::INTEGER AS attention_rank FROM s)
SELECT * FROM r WHERE attention_rank <= 5""")
def standalone_rerank(spark: SparkSession, sf: str) -> DataFrame:
    k = _with_history(spark, sf, _kept(spark, sf))
    out = guardrails.standalone_rerank(k, query="item_id", question="question", text="text", score="score", order="rank", history="history", top=5)
    return out.select("item_id", "doc_id", "composite", "attention_rank")


@query(f"""WITH {DENSE_SQL},{BM25_SQL},
b AS (SELECT 0 AS branch, item_id, doc_id, rank FROM drank WHERE rank <= 6 UNION ALL SELECT 1, item_id, doc_id, rank FROM bm25 WHERE rank <= 6
      UNION ALL SELECT 2, item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY branch, rank) AS n FROM b)
SELECT item_id, doc_id, branch, row_number() OVER (PARTITION BY item_id ORDER BY branch, rank, doc_id)::INTEGER AS position FROM f WHERE n = 1""")
def candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    lead = table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(3)  # the lead chunks of a summary question
    w = Window.partitionBy("item_id").orderBy("doc_id")
    leads = table(spark, sf, "benchmark").select("item_id").crossJoin(F.broadcast(lead)).withColumn("rank", F.row_number().over(w))  # three rows
    pick = lambda d, k: d.where(F.col("rank") <= k).select("item_id", "doc_id", "rank")
    return fusion.union_branches([pick(_dense(spark, sf, 6), 6), pick(_bm25(spark, sf), 6), leads], query="item_id", doc="doc_id").select("item_id", "doc_id", "branch", "position")


@query(f"""WITH {FILTER_SQL(0.35)},
r AS (SELECT item_id, source, rank, round(kept_score * 100, 1) AS relevance, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS excerpt FROM kept),
b AS (SELECT item_id, source, arg_max(struct_pack(relevance := relevance, excerpt := excerpt), struct_pack(r := relevance, o := -rank)) AS b, min(rank) AS fs FROM r GROUP BY item_id, source)
SELECT item_id, source, b.relevance AS relevance, b.excerpt AS excerpt, row_number() OVER (PARTITION BY item_id ORDER BY fs)::INTEGER AS citation_no FROM b""")
def citation_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.citations(_kept(spark, sf), query="item_id", source="source", order="rank", score="kept_score")


@query(f"""WITH {FILTER_SQL(0.42)}, m AS (SELECT item_id, text AS question FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM kept WHERE kept_score >= 0.82))
SELECT item_id, 'I could not find any information about ''' || question || ''' in the uploaded documents. Please upload a document containing this topic or ask about your indexed files.' AS answer, 0.0::DOUBLE AS confidence, false AS is_grounded FROM m""")
def missing_answers(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    sure = _kept(spark, sf, sc.threshold("strict")).where("kept_score >= 0.82")  # a demanding reader: few questions count as answered
    return guardrails.missing_answers(q, sure, query="item_id", question="question")


@query(f"""WITH {FILTER_SQL(0.35)}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kept_score DESC, rank) AS rn FROM kept),
e AS (SELECT item_id, string_agg('--- DOCUMENT EXCERPT ' || rn || ' (' || source || ') ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rn) AS ctx FROM r WHERE rn <= 5 GROUP BY item_id)
SELECT item_id, length(ctx) AS n_chars, md5('KNOWLEDGE BASE CONTEXT:' || chr(10) || ctx || chr(10) || chr(10) || CASE WHEN NOT regexp_matches(lower(trim(text)), 'summary|summarise|overview|give me a summary|what is this paper about') AND regexp_matches(lower(trim(text)), '{'|'.join(prompts.FOCUS)}')
  THEN 'TARGETED FOCUS DIRECTIVE: The user is asking specifically about: ''' || text || '''. Directly explain and address this specific item.' || chr(10) || chr(10) ELSE '' END || 'USER QUERY: ' || text || chr(10) || chr(10) || 'FINISHED GROUNDED ANSWER:') AS prompt_md5
FROM e JOIN benchmark USING (item_id)""")
def prompt_assembly(spark: SparkSession, sf: str) -> DataFrame:
    k = lexical.ranked(_kept(spark, sf).withColumnRenamed("rank", "found"), "item_id", "found", 5, "kept_score")
    ctx = prompts.context_blocks(k, query="item_id", source="source", text="text", rank="rank")
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    p = ctx.join(q, "item_id")
    return p.select("item_id", F.length("context").cast("long").alias("n_chars"), F.md5(prompts.user_prompt(F.col("context"), F.col("question"), F.lit("")).cast("binary")).alias("prompt_md5"))


@query(DENSE_EMB() + """, x AS (SELECT query_id, vec_id, score, vec_id % 2 = 0 AS lexical FROM r WHERE rank <= 30)
SELECT query_id, vec_id, round(CASE WHEN score < 0.38 AND NOT lexical THEN 0.0 WHEN lexical THEN least(1.0, greatest(0.0, least(1.0, (score - 0.38) / 0.47)) + 0.15) ELSE greatest(0.0, least(1.0, (score - 0.38) / 0.47)) END, 4)::DOUBLE AS confidence FROM x""")
def confidence_calibration(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    h = dense.top_k(v, _vector_queries(v), 30, doc="vec_id", query="query_id")
    return h.select("query_id", "vec_id", sc.calibrate(F.col("score"), F.col("vec_id") % 2 == 0).alias("confidence"))


@query("""WITH c AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS slot, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, slot, avg(x) AS m FROM c GROUP BY ALL)
SELECT label, slot::INTEGER AS slot, round(m / CASE WHEN sqrt(sum(m * m) OVER (PARTITION BY label)) > 1e-12 THEN sqrt(sum(m * m) OVER (PARTITION BY label)) ELSE 1.0 END, 6) AS value FROM m""")
def late_pool(spark: SparkSession, sf: str) -> DataFrame:
    return dense.mean_pool(_vectors(spark, sf), "label").select("label", "slot", F.round("value", 6).alias("value"))


@query(f"WITH {DENSE_SQL} SELECT item_id, doc_id, rank::INTEGER AS rank FROM drank WHERE rank <= 4 + CASE WHEN item_id IN (SELECT conv_id FROM conversations WHERE role = 'user' AND contains(text, '?')) THEN 2 ELSE 0 END")
def adaptive_k(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose user asks stand in for negative feedback on the question of their number."""
    told = table(spark, sf, "conversations").where("role = 'user' AND contains(text, '?')").select(F.col("conv_id").alias("item_id"))
    return fusion.adaptive_k(_dense(spark, sf, 4 + fusion.MORE_AFTER_NEGATIVE), told, query="item_id", k=4).select("item_id", "doc_id", "rank")


IMAGE_HITS_SQL = HITS_SQL.replace("c AS (", "hits AS (", 1) + """,
fig AS (SELECT b.item_id, d.doc_id, 0.95::DOUBLE AS score, d.n AS rank, b.text AS question, d.text, d.source FROM benchmark b JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents) d ON d.n % 3 = b.item_id % 3 AND d.n <= 7),
figu AS (SELECT * EXCLUDE (nn) FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY rank DESC) AS nn FROM fig) WHERE nn = 1),
fig1 AS (SELECT * REPLACE (1 - row_number() OVER (PARTITION BY item_id ORDER BY rank DESC) AS rank) FROM figu f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_id = f.item_id AND h.text = f.text)),
c AS (SELECT item_id, doc_id, score, rank, question, text, source FROM hits UNION ALL SELECT item_id, doc_id, score, rank, question, text, source FROM fig1)"""


IMAGE_SQL = f"""{FILTER_SQL(0.35, IMAGE_HITS_SQL)},
fig2 AS (SELECT item_id, doc_id, score AS kept_score, 1 - row_number() OVER (PARTITION BY item_id ORDER BY rank DESC) AS rank, question, text FROM figu f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.item_id = f.item_id AND k.text = f.text)),
al AS (SELECT item_id, doc_id, kept_score, rank, question, text FROM kept UNION ALL SELECT * FROM fig2),
s AS (SELECT item_id, doc_id, rank, round(kept_score * 0.65 + least({OVER(W('question'), 'lower(text)')} * 0.08, 0.25) + CASE WHEN doc_id % 4 = 0 THEN 0.12 ELSE 0.0 END, 6)::DOUBLE AS composite FROM al),
r AS (SELECT item_id, doc_id, composite, row_number() OVER (PARTITION BY item_id ORDER BY composite DESC, rank)::INTEGER AS attention_rank FROM s)"""


def _image_context(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with an image: up to three of the first seven documents stand in for the figure chunks that the image matched."""
    lead = table(spark, sf, "documents").select("doc_id", "text", "source").orderBy("doc_id").limit(7)
    lead = lead.withColumn("rank", F.row_number().over(Window.orderBy("doc_id")))  # seven rows
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), (F.col("item_id") % 3).alias("third"))
    figs = q.join(F.broadcast(lead.withColumn("third", F.col("rank").cast("long") % 3)), "third").drop("third").withColumn("score", F.lit(0.95))
    return guardrails.image_context(_candidates(spark, sf, fusion.image_k(5)), figs, query="item_id", question="question", text="text", score="score", order="rank", k=5, cut=sc.threshold("balanced"), has_figure=F.col("doc_id") % 4 == 0)


@query(f"WITH {IMAGE_SQL} SELECT * FROM r WHERE attention_rank <= 5")
def image_query(spark: SparkSession, sf: str) -> DataFrame:
    return _image_context(spark, sf).select("item_id", "doc_id", "composite", "attention_rank")


@query(f"""WITH {FILTER_SQL(0.42)}, m AS (SELECT item_id, text AS question FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM kept WHERE kept_score >= 0.82))
SELECT item_id, '[General Knowledge - Not found in your documents] ' || question AS answer, 0.25::DOUBLE AS confidence, false AS is_grounded FROM m""")
def general_knowledge_answers(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    sure = _kept(spark, sf, sc.threshold("strict")).where("kept_score >= 0.82")  # a demanding reader, as in missing_answers
    return guardrails.missing_answers(q, sure, query="item_id", question="question", policy="general_knowledge")


@query("SELECT count(*) AS n FROM documents")
def collection_count(spark: SparkSession, sf: str) -> DataFrame:
    return store.count(table(spark, sf, "documents"))


@query("SELECT page_id FROM pages WHERE length(trim(coalesce(regexp_replace(html, '<[^>]*>', '', 'g')[1:3], ''))) > 0")
def answerable(spark: SparkSession, sf: str) -> DataFrame:
    """The first three characters of a page's text stand in for questions, some of which are blank."""
    q = table(spark, sf, "pages").select("page_id", F.substring(F.regexp_replace("html", "<[^>]*>", ""), 1, 3).alias("q"))
    return guardrails.answerable(q, "q").select("page_id")


@query(f"""WITH {FILTER_SQL(0.35)}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY kept_score DESC, rank) AS rn FROM kept),
e AS (SELECT item_id, string_agg('--- DOCUMENT EXCERPT ' || rn || ' (' || source || ') ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rn) AS ctx FROM r WHERE rn <= 5 GROUP BY item_id),
h AS (SELECT conv_id AS item_id, 'RECENT CONVERSATION MEMORY (PRIOR DIALOGUE TURNS):' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || trim(text), chr(10) ORDER BY turn) || chr(10) || chr(10) AS history
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4 GROUP BY conv_id),
p AS (SELECT b.item_id, 'KNOWLEDGE BASE CONTEXT:' || chr(10) || ctx || chr(10) || chr(10) || 'IMAGE: ' || b.item_id % 3 || chr(10) || coalesce(history, '') || 'GOOD: ' || b.item_id || chr(10) || 'BAD: ' || b.item_id || chr(10)
   || CASE WHEN NOT regexp_matches(lower(trim(b.text)), {values(["|".join(prompts.OVERVIEW)])}) AND regexp_matches(lower(trim(b.text)), {values(["|".join(prompts.FOCUS)])}) THEN 'TARGETED FOCUS DIRECTIVE: The user is asking specifically about: ''' || b.text || '''. Directly explain and address this specific item.' || chr(10) || chr(10) ELSE '' END
   || 'USER QUERY: ' || b.text || chr(10) || chr(10) || 'FINISHED GROUNDED ANSWER:' AS prompt FROM e JOIN benchmark b USING (item_id) LEFT JOIN h USING (item_id))
SELECT item_id, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""")
def prompt_with_all_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts with excerpts, an image's summary, the last four turns of the conversation of their number, exemplars and warnings."""
    k = lexical.ranked(_kept(spark, sf).withColumnRenamed("rank", "found"), "item_id", "found", 5, "kept_score")
    ctx = prompts.context_blocks(k, query="item_id", source="source", text="text", rank="rank")
    last = table(spark, sf, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("back <= 4")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    turns = last.groupBy(F.col("conv_id").alias("item_id")).agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))
    p = ctx.join(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")), "item_id").join(turns, "item_id", "left")
    line = lambda head, c: F.concat(F.lit(head), c.cast("string"), F.lit("\n"))
    i = F.col("item_id")
    prompt = prompts.user_prompt(F.col("context"), F.col("question"), F.coalesce(prompts.history_block(F.col("turns")), F.lit("")), line("GOOD: ", i), line("BAD: ", i), line("IMAGE: ", i % 3))
    return p.select("item_id", F.length(prompt).cast("long").alias("n_chars"), F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query("""WITH t AS (SELECT vec_id, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, v, unnest([{'a': 0, 'z': 3}, {'a': 3, 'z': 3}, {'a': 9, 'z': 12}, {'a': 5, 'z': 8}]) AS s, unnest([0, 1, 2, 3]) AS span FROM t),
p AS (SELECT vec_id, span, CASE WHEN s.a >= s.z OR s.a > 7 THEN v[least(s.a, 7) + 1:least(s.a, 7) + 1] ELSE v[s.a + 1:s.z] END AS part FROM s),
m AS (SELECT vec_id, span, list_transform(range(1, 9), lambda j: list_sum(list_transform(part, lambda r: r[j])) / len(part)) AS m FROM p)
SELECT vec_id, span, generate_subscripts(m, 1)::INTEGER - 1 AS slot, round(unnest(m) / CASE WHEN sqrt(list_inner_product(m, m)) > 1e-12 THEN sqrt(list_inner_product(m, m)) ELSE 1.0 END, 6) AS value FROM m""")
def span_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector of 64 numbers as eight tokens of eight, pooled over four spans: two whole ones, an empty one and a late one."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, F.lit(8)))
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(z).alias("end")) for a, z in ((0, 3), (3, 3), (9, 12), (5, 8))))
    d = dense.pool_spans(table(spark, sf, "embeddings").select("vec_id", tokens.alias("v"), spans.alias("s")), "v", "s")
    d = d.select("vec_id", F.posexplode("pooled").alias("span", "p")).select("vec_id", "span", F.posexplode("p").alias("slot", "value"))
    return d.withColumn("value", F.round("value", 6))
