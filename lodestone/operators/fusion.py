"""Fusion and reranking: reciprocal rank fusion, sigmoid rerank, parent expansion, branch union, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as sc


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, *, query: str, doc: str, k: int = 60, top: int = 30) -> DataFrame:
    """(query, doc, dense_rank, bm25_rank, rrf, rank) of the union of both lists."""
    d = dense.select(query, doc, F.col("rank").alias("dense_rank"))
    s = sparse.select(query, doc, F.col("rank").alias("bm25_rank"))
    both = d.join(s, [query, doc], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf", F.round(part("dense_rank") + part("bm25_rank"), 8))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("rrf"), doc))).where(F.col("rank") <= top)


def rerank(candidates: DataFrame, *, query: str, doc: str, distance: str = "distance", top: int = 5, logit: Column | None = None) -> DataFrame:
    """Probability by the sigmoid of a logit (a model's, or 1.5 times the similarity), best `top`."""
    out = candidates.withColumn("logit", F.round(logit if logit is not None else sc.fallback_logit(F.coalesce(F.col(distance), F.lit(1.0))), 7))
    out = out.withColumn("prob", F.round(sc.sigmoid(F.col("logit")), 6))
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("prob"), doc))).where(F.col("final_rank") <= top)


def expand_parents(candidates: DataFrame, parents: DataFrame, key: str, own: str = "text", full: str = "full_content") -> DataFrame:
    """parent_context: the parent's full content, or the candidate's own text where it has no parent."""
    return candidates.join(parents, key, "left").withColumn("parent_context", F.coalesce(F.col(full), F.col(own)))


def union_branches(branches: list[DataFrame], *, query: str, doc: str) -> DataFrame:
    """Branches in order with ids deduplicated, first branch wins; adds branch and position (order in the result)."""
    rows = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r, allowMissingColumns=True)
    first = all_.withColumn("_n", F.row_number().over(Window.partitionBy(query, doc).orderBy("branch", "rank"))).where("_n = 1").drop("_n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("branch", "rank", doc)))


def citations(chunks: DataFrame, *, query: str, source: str, order: str, score: str = "score", text: str = "text") -> DataFrame:
    """One citation per source: the first chunk with the source's best relevance, sources in order of first appearance."""
    from lodestone.functions.text import excerpt

    c = chunks.withColumn("relevance", F.round(F.col(score) * 100, 1))
    best = c.groupBy(query, source).agg(F.max_by(F.struct(F.col("relevance"), excerpt(F.col(text)).alias("excerpt")), F.struct("relevance", -F.col(order))).alias("b"), F.min(order).alias("first_seen"))
    return best.select(query, source, "b.relevance", "b.excerpt", F.row_number().over(Window.partitionBy(query).orderBy("first_seen")).alias("citation_no"))


def cited(chunks: DataFrame, *, query: str, grounded: str, order: str, first: int = 3) -> DataFrame:
    """The chunks of each query that ground its answer; where none does, its first ones in order."""
    w = Window.partitionBy(query)
    marked = chunks.withColumns({"_any": F.max(F.col(grounded).cast("int")).over(w), "_n": F.row_number().over(w.orderBy(order))})
    return marked.where(F.col(grounded) | ((F.coalesce("_any", F.lit(0)) == 0) & (F.col("_n") <= first))).drop("_any", "_n")


#: Further hits for a query that drew negative feedback.
MORE_AFTER_NEGATIVE = 2


def adaptive_k(hits: DataFrame, negatives: DataFrame, *, query: str, k: int, rank: str = "rank") -> DataFrame:
    """The first k hits of each query, and two more for queries in negatives."""
    told = negatives.select(query).distinct().withColumn("_more", F.lit(MORE_AFTER_NEGATIVE))
    return hits.join(told, query, "left").where(F.col(rank) <= k + F.coalesce("_more", F.lit(0))).drop("_more")


def image_k(k: int) -> int:
    """Hits fetched for a question with an image, of which k stay after reranking."""
    return max(2 * k, 12)


def prepend(chunks: DataFrame, first: DataFrame, *, query: str, text: str = "text", rank: str = "rank") -> DataFrame:
    """chunks with the rows of `first` before them (ranks 0 and below, in their order), but none whose text the query's chunks have already.

    Of equal texts in `first`, the last in order is the one that stands.
    """
    w = Window.partitionBy(query, text).orderBy(F.desc(rank))
    once = first.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    fresh = once.join(chunks.select(query, text).distinct(), [query, text], "left_anti")
    fresh = fresh.withColumn(rank, 1 - F.row_number().over(Window.partitionBy(query).orderBy(F.desc(rank))))
    return chunks.unionByName(fresh, allowMissingColumns=True)
