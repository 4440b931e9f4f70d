"""Whole answers: the events of a gated answer, standalone variants, region routing and clean-up queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import claims, fusion, guardrails, prompts
from lodestone.plans.registry import query, table, values
from lodestone.plans.retrieval import DENSE_SQL, FILTER_SQL, HITS_SQL, IMAGE_SQL, OVER, WITHOUT, W, _candidates, _expanded, _image_context, _kept, corpus_stats
from lodestone.sources import store


REFUSE_SQL = lambda a: f"(regexp_matches(trim(substr(lower({a}), 1, 180)), {values([tx.LEADING_REFUSAL])}) OR regexp_matches(trim(substr(lower({a}), 1, 180)), {values([tx.LEADING_ANY])}) OR (length(trim({a})) < 220 AND regexp_matches(lower({a}), {values([tx.SHORT_REFUSAL])})))"


def extractive(context: Column, question: Column) -> Column:
    """Default generator: the first sentences of the best context. A model takes its place as a function of the same columns."""
    return F.array_join(F.slice(tx.sentences(F.trim(context)), 1, 3), " ")


def answer_events(best: DataFrame, *, query: str, question: str, context: str, reason: str, generate: Callable[[Column, Column], Column] = extractive, contexts: str | None = None, figures: str | None = None) -> DataFrame:
    """(query, position, type, payload): two statuses, then a refusal, or the model, figures, the answer's tokens, a status, its attribution, and done.

    contexts: column with all contexts in rank order, which claims are held against (else the best one); figures: column
    with the figures of those contexts. A refusal ends the events.
    """
    seen = F.array_join(contexts, " ") if contexts else F.col(context)
    a = best.withColumns({"_answer": generate(F.col(context), F.col(question)), "_model": prompts.route_model(F.col(question), F.contains(F.lower(F.coalesce(F.col(context), F.lit(""))), F.lit("table")), F.lit(False))})
    checked = claims.verified_claims(claims.claims(a.where(F.col(reason).isNull()).select(query, "_answer", F.lower(seen).alias("_ctx")), [query, "_ctx"], "_answer"), "_ctx")
    faith = claims.faithfulness(checked.drop("_ctx"), a.select(query), query)
    a = a.join(faith, query)
    ev = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.cast("string").alias("payload"))
    opened = F.array(ev("status", F.lit("retrieving")), ev("status", F.lit("evaluating")))
    refused = F.concat(opened, F.array(ev("refusal", F.col(reason))))
    shown = F.transform(F.coalesce(F.col(figures), F.array().cast("array<string>")), lambda f: ev("figure", f)) if figures else F.slice(opened, 1, 0)
    tokens = F.transform(F.split("_answer", " "), lambda w: ev("token", w))
    closing = F.array(ev("status", F.lit("verifying")), ev("attribution", F.col("faithfulness")), ev("done", F.lit("")))
    told = F.concat(opened, F.array(ev("model_selected", F.col("_model"))), shown, tokens, closing)
    return a.select(query, F.posexplode(F.when(F.col(reason).isNotNull(), refused).otherwise(told)).alias("position", "e")).select(query, "position", "e.*")


def image_answer_events(contexts: DataFrame, questions: DataFrame, *, query: str, question: str, text: str, score: str, rank: str, source: str, matched: str, generate: Callable[[Column, Column], Column] = extractive) -> DataFrame:
    """Events of questions with an image: (query, position, type, token, is_grounded, confidence, n_citations): the answer's tokens in order, then done.

    contexts: ranked chunks of each question; questions: query, question and whether the image matched a stored figure. A
    match, or a good enough chunk, grounds an answer that its words don't. Only done has the last three columns; a grounded
    answer cites each source of its contexts once. A question without contexts has an empty answer: one empty token.
    """
    best = contexts.where(F.col(rank) == 1).select(query, F.col(text).alias("_best"))
    a = questions.join(best, query, "left").withColumn("_answer", F.coalesce(tx.sanitise(generate(F.col("_best"), F.col(question))), F.lit("")))
    decided = guardrails.grounding(a.select(query, question, "_answer"), contexts, key=query, question=question, answer="_answer", text=text, score=score, rank=rank).select(query, "is_grounded", "confidence")
    held = contexts.groupBy(query).agg(F.max(score).alias("_top"), F.countDistinct(source).alias("_sources"))
    a = a.join(decided, query).join(held, query, "left")
    a = prompts.image_grounding(a, grounded="is_grounded", confidence="confidence", matched=F.col(matched), has_chunks=F.col("_top").isNotNull(), top_score=F.coalesce("_top", F.lit(0.0)))
    kind = "struct<type:string,token:string,is_grounded:boolean,confidence:double,n_citations:bigint>"
    tokens = F.transform(F.split("_answer", " ", -1), lambda w: F.struct(F.lit("token"), w, F.lit(None), F.lit(None), F.lit(None)).cast(kind))
    done = F.struct(F.lit("done"), F.lit(None), F.col("is_grounded"), F.col("confidence"), F.when(F.col("is_grounded"), F.coalesce("_sources", F.lit(0))).otherwise(0)).cast(kind)
    return a.select(query, F.posexplode(F.concat(tokens, F.array(done))).alias("position", "e")).select(query, "position", "e.*")


def _sanitised(column: str) -> str:
    for pattern, by in tx.SANITISE:
        column = f"regexp_replace({column}, {values([pattern])}, {values([by])}, 'g')"
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {IMAGE_SQL},
x AS (SELECT r.item_id, attention_rank AS rank, composite, d.text, d.source FROM r JOIN documents d USING (doc_id) WHERE attention_rank <= 5),
g AS (SELECT item_id, string_agg(lower(text), ' ' ORDER BY rank) AS ctx, round(avg(composite) FILTER (rank <= 3), 8)::DOUBLE AS top3, max(composite) AS top, count(DISTINCT source) AS sources, arg_min(text, rank) AS best FROM x GROUP BY item_id),
a AS (SELECT b.item_id, b.text AS question, b.item_id % 2 = 0 AS matched, g.*, coalesce({_sanitised("array_to_string(string_split(regexp_replace(trim(best), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ')")}, '') AS answer FROM benchmark b LEFT JOIN g USING (item_id)),
w AS (SELECT *, {WITHOUT(W('question'), tx.STOP_GROUNDING)} AS ws FROM a),
l AS (SELECT *, CASE WHEN len(ws) = 0 THEN 1 ELSE {OVER('ws', "coalesce(ctx, '')")} END AS lex, top IS NULL OR length(answer) = 0 OR {REFUSE_SQL('answer')} AS none FROM w),
f AS (SELECT *, CASE WHEN none THEN 0.0 ELSE round(CASE WHEN top3 < 0.38 AND NOT lex > 0 THEN 0.0 WHEN lex > 0 THEN least(1.0, greatest(0.0, least(1.0, (top3 - 0.38) / 0.47)) + 0.15) ELSE greatest(0.0, least(1.0, (top3 - 0.38) / 0.47)) END, 4)::DOUBLE END AS conf FROM l),
k AS (SELECT *, coalesce(NOT none AND NOT (conf < 0.2 AND lex = 0 AND len(ws) > 0), false) AS grounded FROM f),
m AS (SELECT *, CASE WHEN NOT grounded AND matched AND top IS NOT NULL THEN 2 WHEN NOT grounded AND NOT matched AND top >= 0.40 THEN 1 ELSE 0 END AS lift FROM k),
e AS (SELECT item_id, unnest(string_split(answer, ' ')) AS token, generate_subscripts(string_split(answer, ' '), 1) - 1 AS position, 'token' AS type, NULL::BOOLEAN AS is_grounded, NULL::DOUBLE AS confidence, NULL::BIGINT AS n_citations FROM m
      UNION ALL SELECT item_id, NULL, len(string_split(answer, ' ')), 'done', grounded OR lift > 0, CASE lift WHEN 2 THEN greatest(conf, 0.78) WHEN 1 THEN greatest(conf, 0.65) ELSE conf END, CASE WHEN grounded OR lift > 0 THEN coalesce(sources, 0) ELSE 0 END FROM m)
SELECT item_id, position::INTEGER AS position, type, token, is_grounded, confidence, n_citations FROM e""")
def image_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every benchmark question with an image; those of even numbers matched a stored figure."""
    ctx = _image_context(spark, sf).select("item_id", F.col("attention_rank").alias("rank"), "composite", "text", "source")
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), (F.col("item_id") % 2 == 0).alias("matched"))
    return image_answer_events(ctx, q, query="item_id", question="question", text="text", score="composite", rank="rank", source="source", matched="matched")


@query()
def gated_answer_events(spark: SparkSession, sf: str) -> DataFrame:
    ranked = F.sort_array(F.collect_list(F.struct("final_rank", "prob", "parent_context")))
    top = _expanded(spark, sf).groupBy("item_id").agg(ranked.alias("r"))  # five contexts a question
    texts = F.transform("r", lambda x: x["parent_context"])
    urls = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(prompts.URL_TAG), F.lit(1)))))
    top = top.select("item_id", F.col("r")[0]["prob"].alias("prob"), F.col("r")[0]["parent_context"].alias("parent_context"), texts.alias("contexts"), urls.alias("figures"))
    best = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")).join(top, "item_id", "left")
    stats = corpus_stats(spark, sf).select("mean", "std")
    gated = guardrails.gate(best, stats, question="question", context="parent_context")
    return answer_events(gated, query="item_id", question="question", context="parent_context", reason="refusal_reason", contexts="contexts", figures="figures")


@query(f"WITH {DENSE_SQL} SELECT item_id, count(*) AS n, round(avg(score), 4) AS confidence FROM drank WHERE rank <= 12 AND score >= 0.05 GROUP BY item_id")
def standalone_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of the chunks above a fixed cut (hash embeddings score low, so the cut is .05 here)."""
    return _candidates(spark, sf).where("score >= 0.05").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("confidence"))


def standalone_images(chunks: DataFrame, *, query: str, question: str, text: str, score: str, order: str, image_query: bool = False) -> DataFrame:
    """(query, url, relevance): images the exported server attaches; page images only on visual intent, first three for image questions, else two."""
    words = ("diagram", "figure", "chart", "plot", "graph", "architecture", "image", "photo", "show me", "table", "visual", "fig.", "fig ")
    visual = tx.any_of(F.lower(question), words) | F.lit(image_query)
    high = F.max((F.contains(F.col(text), F.lit("[DIAGRAM")) & (F.col(score) >= 0.45)).cast("int")).over(Window.partitionBy(query))
    urls = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(prompts.URL_TAG), F.lit(1)), lambda u: F.trim(u)), lambda u: F.length(u) > 0)
    c = chunks.withColumns({"_visual": visual, "_high": high}).where(F.col("_visual") | (F.col("_high") == 1)).select("*", F.posexplode(urls).alias("_pos", "url"))
    c = c.where(F.col("_visual") | ~F.contains(F.lower("url"), F.lit("_page_")))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(query, "url").orderBy(order, "_pos"))).where("_n = 1")
    c = c.withColumn("_rank", F.row_number().over(Window.partitionBy(query).orderBy(order, "_pos"))).where(F.col("_rank") <= (3 if image_query else 2))
    return c.select(query, "url", F.round(F.col(score) * 100, 1).alias("relevance"))


def unified_chunks(regions: DataFrame) -> DataFrame:
    """Regions (document, page, region_no, region_type, text_content, x1..y2, caption) as chunks: captions give none; figures and tables carry an image path."""
    name = lambda kind: F.concat(tx.slug(F.col("document")), F.lit("_p"), F.col("page"), F.lit(f"_{kind}_"), F.col("region_no"))
    kind = F.when(F.col("region_type").isin("figure", "table"), F.col("region_type")).otherwise("text")
    picture = F.when(kind != "text", F.concat(name("crop"), F.lit(".png")))
    content = F.when(kind == "text", F.trim("text_content")).otherwise(F.trim(F.concat_ws("\n", "caption", "text_content")))
    out = regions.where("region_type <> 'caption'").select(name("r").alias("id"), "document", "page", kind.alias("type"), F.array("x1", "y1", "x2", "y2").alias("bbox"), content.alias("content"), picture.alias("image_path"))
    return out.where((F.col("type") != "text") | (F.length("content") > 0))


@query("""WITH r AS (SELECT 'doc ' || (p_partkey % 9) AS document, p_partkey % 20 AS page, p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'caption' ELSE 'paragraph' END AS t, p_name FROM part)
SELECT replace(document, ' ', '_') || '_p' || page || '_r_' || n AS id, CASE WHEN t IN ('figure', 'table') THEN t ELSE 'text' END AS type, CASE WHEN t = 'paragraph' THEN trim(p_name) ELSE trim('cap' || chr(10) || p_name) END AS content,
 CASE WHEN t IN ('figure', 'table') THEN replace(document, ' ', '_') || '_p' || page || '_crop_' || n || '.png' END AS image_path FROM r WHERE t <> 'caption'""")
def region_chunks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "figure").when(k % 4 == 1, "table").when(k % 4 == 2, "caption").otherwise("paragraph")
    r = table(spark, sf, "part").select(F.concat(F.lit("doc "), k % 9).alias("document"), (k % 20).alias("page"), k.alias("region_no"), kind.alias("region_type"), F.col("p_name").alias("text_content"), F.lit("cap").alias("caption"), *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return unified_chunks(r).select("id", "type", "content", "image_path")


@query(f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(trim(replace(text, '. ', chr(10))), '\\r\\n|\\n|\\r'), lambda s: trim(s)), lambda s: length(s) > 0) AS ls FROM documents),
k AS (SELECT doc_id, text, CASE WHEN len(ls) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform(ls, lambda s: [s]), lambda acc, x: CASE WHEN lower(acc[-1]) = lower(x[1]) OR len(list_filter(acc[-4:], lambda y: y = x[1])) >= 2 THEN acc ELSE list_append(acc, x[1]) END), chr(10)) END AS t FROM l)
SELECT doc_id, CASE WHEN text IS NOT NULL AND length(t) > 5 AND NOT (length(t) < 180 AND ({' OR '.join(f"contains(lower(t), {values([w])})" for w in tx.DECLINES)})) THEN t END AS description FROM k""")
def description_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.clean_description(F.replace("text", F.lit(". "), F.lit("\n"))).alias("description"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || ('chunk_' || doc_id)::BLOB) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE h[17:17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9'
  WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("chunk_"), "doc_id")).alias("point_id"))


@query("SELECT user_id AS session_id, CASE WHEN count(*) FILTER (event_id % 3 = 0) > 0 THEN 'session' ELSE 'global' END AS store, count(*) FILTER (event_id % 3 = 0) AS own FROM events GROUP BY user_id")
def feedback_store_choice(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.count_if(F.col("event_id") % 3 == 0).alias("own"))
    return e.select("session_id", F.when(F.col("own") > 0, "session").otherwise("global").alias("store"), "own")


@query("SELECT page_id, count(*) AS n_regions FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(?:h1|p|li|div)[ >]')) AS t FROM pages) GROUP BY page_id")
def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("html", F.lit("(<(?:h1|p|li|div)[ >])"), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", n.cast("long").alias("n_regions")).where("n_regions > 0")




_VISUAL = ("diagram", "figure", "chart", "plot", "graph", "architecture", "image", "photo", "show me", "table", "visual", "fig.", "fig ")


@query(f"""WITH {DENSE_SQL}, {HITS_SQL},
t AS (SELECT *, text || ' [Image URL: /img/' || CASE WHEN doc_id % 3 = 0 THEN 'a_page_' ELSE 'f' END || doc_id % 11 || '.png]' || CASE WHEN doc_id % 5 = 0 THEN ' [DIAGRAM]' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN ' [Image URL: /img/f' || doc_id % 7 || '.png ]' ELSE '' END AS body, score + 0.4 AS s FROM c),
v AS (SELECT *, ({' OR '.join(f"contains(lower(question), {values([w])})" for w in _VISUAL)}) AS visual, max((contains(body, '[DIAGRAM') AND s >= 0.45)::INT) OVER (PARTITION BY item_id) AS high FROM t),
x AS (SELECT *, unnest(regexp_extract_all(body, '\\[Image URL:\\s*(.*?)\\]', 1)) AS raw, generate_subscripts(regexp_extract_all(body, '\\[Image URL:\\s*(.*?)\\]', 1), 1) AS pos FROM v WHERE visual OR high = 1),
u AS (SELECT *, trim(raw) AS url FROM x WHERE length(trim(raw)) > 0 AND (visual OR NOT contains(lower(trim(raw)), '_page_'))),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, url ORDER BY rank, pos) AS n FROM u) WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank, pos) AS r FROM f)
SELECT item_id, url, round(s * 100, 1)::DOUBLE AS relevance FROM k WHERE r <= 2""")
def standalone_image_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Images that the exported server attaches to each question; tags put into the hits' texts stand in for their figures."""
    k = F.col("doc_id")
    tag = lambda name: F.concat(F.lit(" [Image URL: /img/"), name, F.lit(".png]"))
    first = tag(F.concat(F.when(k % 3 == 0, "a_page_").otherwise("f"), (k % 11).cast("string")))
    second = F.when(k % 4 == 0, F.concat(F.lit(" [Image URL: /img/f"), (k % 7).cast("string"), F.lit(".png ]"))).otherwise("")
    body = F.concat("text", first, F.when(k % 5 == 0, " [DIAGRAM]").otherwise(""), second)
    c = _candidates(spark, sf).withColumns({"text": body, "score": F.col("score") + 0.4})
    return standalone_images(c, query="item_id", question="question", text="text", score="score", order="rank")


@query("SELECT doc_id, 0.8::DOUBLE AS score FROM documents ORDER BY doc_id LIMIT 4")
def lead_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The first four chunks of the store, as a summary question gets them."""
    return store.lead_chunks(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", F.col("score").cast("double").alias("score"))


@query(f"""WITH {FILTER_SQL(0.35)}, m AS (SELECT *, kept_score >= 0.6 AS grounded, max((kept_score >= 0.6)::INT) OVER (PARTITION BY item_id) AS anyg, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS nth FROM kept),
r AS (SELECT item_id, source, rank, round(kept_score * 100, 1) AS relevance FROM m WHERE grounded OR (anyg = 0 AND nth <= 3))
SELECT item_id, source, max(relevance)::DOUBLE AS relevance, row_number() OVER (PARTITION BY item_id ORDER BY min(rank))::INTEGER AS citation_no FROM r GROUP BY item_id, source""")
def citation_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of the chunks that ground an answer, or of its first three where none does."""
    held = _kept(spark, sf).withColumn("grounded", F.col("kept_score") >= 0.6)
    cited = fusion.cited(held, query="item_id", grounded="grounded", order="rank")
    return fusion.citations(cited, query="item_id", source="source", order="rank", score="kept_score").select("item_id", "source", "relevance", "citation_no")
