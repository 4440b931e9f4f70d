"""Relevance filtering, grounding decisions and refusal gates over tables of scored chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc
from lodestone.functions import text as tx
from lodestone.functions import vectors as vec


def relevance_filter(chunks: DataFrame, *, query: str, question: str, text: str, score: str, order: str, cut: float = 0.35) -> DataFrame:
    """Chunks kept, with kept_score and reason.

    Kept are chunks that hold the whole question, enough of its content words, or score at least `cut`; lexical matches
    lift the score. Where a query keeps none, its first four above a floor in input order are kept (floor .25 without
    content words, else .38).
    """
    q, t = F.col(question), F.lower(F.col(text))
    content = tx.without(tx.words(q, 3), tx.STOP_FILTER)
    c = chunks.withColumns({"_n": F.size(content), "_lex": tx.overlap(content, t), "_exact": (F.length(F.trim(q)) >= 4) & F.contains(t, F.lower(F.trim(q)))})
    s = F.col(score)
    lexical = (F.col("_lex") >= 2) | ((F.col("_lex") >= 1) & ((F.col("_n") <= 3) | (s >= 0.22)))
    c = c.withColumn("reason", F.when(F.col("_exact"), "exact").when(lexical, "lexical").when(s >= cut, "score"))
    lifted = F.when(F.col("reason") == "exact", F.greatest(s, F.lit(0.70))).when(F.col("reason") == "lexical", F.greatest(s, 0.50 + F.least(F.lit(0.35), F.col("_lex") * 0.05))).otherwise(s)
    per = Window.partitionBy(query)
    c = c.withColumn("kept_score", lifted).withColumn("_any", F.max(F.col("reason").isNotNull().cast("int")).over(per))
    fallback = (F.col("_any") == 0) & (s >= F.when(F.col("_n") == 0, 0.25).otherwise(0.38))
    c = c.withColumn("_fallback", fallback).withColumn("_at", F.row_number().over(Window.partitionBy(query, "_fallback").orderBy(order)))
    c = c.withColumn("reason", F.coalesce("reason", F.when(fallback & (F.col("_at") <= 4), "fallback")))
    return c.where("reason is not null").drop("_n", "_lex", "_exact", "_any", "_fallback", "_at")


def grounding(answers: DataFrame, chunks: DataFrame, *, key: str, question: str, answer: str, text: str, score: str, rank: str) -> DataFrame:
    """(key, is_grounded, confidence, n_citations): refusals and empty contexts aren't grounded; otherwise by the mean of the three best scores and word overlap."""
    ctx = chunks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(rank, F.lower(F.col(text)).alias("t")))).alias("_c"),
        F.avg(F.when(F.col(rank) <= 3, F.col(score))).alias("_top"),
        F.count(F.lit(1)).alias("_n"),
    )
    a = answers.join(ctx, key, "left")
    content = tx.without(tx.words(F.col(question), 3), tx.STOP_GROUNDING)
    joined = F.array_join(F.transform("_c", lambda c: c["t"]), " ")
    a = a.withColumns({"_words": F.size(content), "_lex": F.when(F.size(content) == 0, 1).otherwise(tx.overlap(content, joined))})
    none = F.col("_n").isNull() | (F.length(F.coalesce(F.col(answer), F.lit(""))) == 0) | tx.refusal(F.col(answer))
    conf = sc.calibrate(F.round("_top", 8), F.col("_lex") > 0)
    weak = (conf < 0.20) & (F.col("_lex") == 0) & (F.col("_words") > 0)
    return a.select(
        key,
        F.coalesce(~none & ~weak, F.lit(False)).alias("is_grounded"),
        F.when(none, 0.0).otherwise(conf).alias("confidence"),
        F.when(none | weak, 0).otherwise(F.col("_n")).cast("long").alias("n_citations"),
    )


def attention_rerank(chunks: DataFrame, *, query: str, question: str, text: str, score: str, order: str, history: str | None = None, has_figure: Column | None = None, image_query: bool = False) -> DataFrame:
    """Adds composite and attention_rank; history is a column with the text of the last turns."""
    t = F.lower(F.col(text))
    past = tx.overlap(tx.words(F.col(history), 3), t) if history else F.lit(0)
    composite = sc.attention(F.col(score), tx.overlap(tx.words(F.col(question), 3), t), past, F.lit(False) if has_figure is None else has_figure, image_query)
    out = chunks.withColumn("composite", F.round(composite, 6))
    return out.withColumn("attention_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("composite"), order)))


def standalone_rerank(chunks: DataFrame, *, query: str, question: str, text: str, score: str, order: str, history: str, top: int | None = None) -> DataFrame:
    """The exported server's composite; the first `top` make the context."""
    t = F.lower(F.col(text))
    q, h = tx.words(F.col(question), 3), tx.words(F.col(history), 3)
    composite = sc.standalone_attention(F.col(score), tx.overlap(q, t), F.size(q), tx.overlap(h, t), F.size(h), F.contains(F.col(text), F.lit("[DIAGRAM")))
    out = chunks.withColumn("composite", F.round(composite, 6))
    out = out.withColumn("attention_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("composite"), order)))
    return out.where(F.col("attention_rank") <= top) if top else out


def similarity_stats(sample: DataFrame, value: str, mean: float = 0.42, std: float = 0.09) -> DataFrame:
    """One row (n, mean, std): of the sample when it has ten values or more, else the defaults; std is at least .01."""
    return _stats(sample.agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s")), mean, std)


def _stats(agg: DataFrame, mean: float, std: float) -> DataFrame:
    return agg.select("n", F.round(F.when(F.col("n") >= 10, F.col("m")).otherwise(mean), 6).alias("mean"), F.round(F.when(F.col("n") >= 10, F.greatest(F.lit(0.01), "s")).otherwise(std), 6).alias("std"))


def _moments(vectors: DataFrame, vector: str) -> DataFrame:
    """(dim, i, j, x): sums over the vectors of each length of the products of their coordinates i and j, where coordinate 0 is 1."""

    def summed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.array(pc.list_value_length(column))
            for dim in np.unique(sizes).tolist():
                rows = column.filter(pa.array(sizes == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((int((sizes == 0).sum()), 0))
                one = np.hstack([np.ones((len(rows), 1)), rows])
                totals[dim] = totals.get(dim, 0.0) + one.T @ one
        for dim, g in totals.items():
            i, j = np.indices(g.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g.ravel())], ["dim", "i", "j", "x"])

    x = F.col(vector).cast("array<double>")
    whole = vectors.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda e: e.isNull())).select(x.alias("v"))
    return whole.mapInArrow(summed, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x"))


def pair_stats(vectors: DataFrame, queries: DataFrame, *, key: str, query: str, vector: str = "vector", mean: float = 0.42, std: float = 0.09) -> DataFrame:
    """similarity_stats of the inner products of every query with every vector of another id, without making the pairs.

    The products' sum is the product of the two sums, and the sum of their squares that of the two tables' moments, so each
    table is read once; the pairs of one id are taken out by a join on it. Vectors that are null, hold a null or differ in
    length give no value, as in the pairs.
    """
    vectors, queries = vectors.where(F.col(key).isNotNull()), queries.where(F.col(query).isNotNull())
    both = _moments(vectors, vector).join(_moments(queries, vector).withColumnRenamed("x", "y"), ["dim", "i", "j"])
    each = both.select(F.when((F.col("i") == 0) & (F.col("j") == 0), 0).when(F.col("i") == 0, 1).when(F.col("j") > 0, 2).alias("power"), (F.col("x") * F.col("y")).alias("z"))
    sums = [F.coalesce(F.sum(F.when(F.col("power") == k, F.col("z"))), F.lit(0.0)).alias(f"s{k}") for k in range(3)]
    same = queries.select(F.col(query).alias("_id"), F.col(vector).alias("_q")).join(vectors.select(F.col(key).alias("_id"), F.col(vector).alias("_v")), "_id")
    z = vec.dot(F.col("_q"), F.col("_v"))
    own = same.select(z.alias("z")).agg(F.count("z").alias("o0"), F.coalesce(F.sum("z"), F.lit(0.0)).alias("o1"), F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("o2"))
    left = each.agg(*sums).crossJoin(F.broadcast(own)).select(*((F.col(f"s{k}") - F.col(f"o{k}")).alias(f"s{k}") for k in range(3)))  # one row each
    n, total = F.col("s0"), F.col("s1")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") - F.when(n > 0, total * total / n)) / F.when(n > 1, n - 1.0))
    return _stats(left.select(F.round(n).cast("long").alias("n"), (total / F.when(n > 0, n)).alias("m"), spread.alias("s")), mean, std)


def gate(best: DataFrame, stats: DataFrame, *, question: str, context: str, prob: str = "prob") -> DataFrame:
    """Adds nli, z, passed and refusal_reason for the best candidate of each query (null prob: nothing retrieved). z is reported, not gated."""
    hyp = F.array_distinct(F.transform(F.filter(F.split(F.trim(F.col(question)), r"\s+"), lambda w: F.length(w) > 3), lambda w: F.lower(w)))
    nli = F.round(sc.entailment(F.size(hyp), tx.overlap(hyp, F.lower(F.coalesce(F.col(context), F.lit(""))))), 6)
    out = best.crossJoin(F.broadcast(stats.select(F.col("mean").alias("_m"), F.col("std").alias("_s"))))  # one row
    reason = sc.gate(F.col(prob), F.col("nli"))
    out = out.withColumn("nli", nli).withColumn("refusal_reason", reason)
    low = F.coalesce(F.col("refusal_reason").isin("NO_CANDIDATES_RETRIEVED", "CROSS_ENCODER_CONFIDENCE_LOW"), F.lit(False))
    return out.withColumns({"z": F.round(F.when(low, 0.0).otherwise(sc.z_score(F.col(prob), F.col("_m"), F.col("_s"))), 4), "nli": F.when(low, 0.0).otherwise(F.col("nli")), "passed": F.col("refusal_reason").isNull()}).drop("_m", "_s")


def missing_answers(queries: DataFrame, kept: DataFrame, *, query: str, question: str, policy: str = "refusal") -> DataFrame:
    """Queries without a kept chunk, with the answer the policy gives: a refusal, or a general-knowledge prompt."""
    none = queries.join(kept.select(query).distinct(), query, "left_anti")
    if policy == "general_knowledge":
        return none.select(query, F.concat(F.lit("[General Knowledge - Not found in your documents] "), question).alias("answer"), F.lit(0.25).alias("confidence"), F.lit(False).alias("is_grounded"))
    text = F.concat(F.lit("I could not find any information about '"), question, F.lit("' in the uploaded documents. Please upload a document containing this topic or ask about your indexed files."))
    return none.select(query, text.alias("answer"), F.lit(0.0).alias("confidence"), F.lit(False).alias("is_grounded"))


def answerable(queries: DataFrame, question: str) -> DataFrame:
    """Queries with a question that isn't null or blank."""
    return queries.where(F.length(F.trim(F.coalesce(F.col(question), F.lit("")))) > 0)


def image_context(hits: DataFrame, figures: DataFrame, *, query: str, question: str, text: str, score: str, order: str, k: int, cut: float, has_figure: Column | None = None) -> DataFrame:
    """Context of questions with an image: matched figure chunks before the hits, filtered, put back where the filter took them, reranked; the best k.

    hits: fusion.image_k(k) per query; figures: chunks with the same columns.
    """
    from lodestone.operators.fusion import prepend

    held = relevance_filter(prepend(hits, figures, query=query, text=text, rank=order), query=query, question=question, text=text, score=score, order=order, cut=cut)
    held = prepend(held, figures.withColumns({"kept_score": F.col(score), "reason": F.lit("figure")}), query=query, text=text, rank=order)
    out = attention_rerank(held, query=query, question=question, text=text, score="kept_score", order=order, has_figure=has_figure, image_query=True)
    return out.where(F.col("attention_rank") <= k)
