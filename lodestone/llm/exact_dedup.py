"""Exact dedup by content-defined chunk recipes (operator 3), DataFrame functions only.

A text is cut where its content says so: after a sentence mark or line feed past MIN_CHARS, at MAX_CHARS at the latest;
equal texts get equal cuts wherever they stand. Every chunk has a 64-bit identifier. Identifiers are verified: chunks of
one identifier must agree in SHA-256; where they don't, each gets its digest as identifier instead. A
document's recipe is its ordered identifier list, and documents are equal when their recipes are. Only identifiers and
digests are shuffled; no text moves after its scan.

Defined cases: null text counts as empty; empty texts are equal to one another; rows that repeat a doc_id and its text
count in group_size and stay or go together; a null doc_id is the smallest, and stays only among null ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, table

MIN_CHARS, MAX_CHARS = 512, 4096
#: Identifiers, over all recipes that two or more documents share, up to which those recipes are broadcast; a verified one has up to 64 bytes.
BROADCAST_IDS = 1_000_000


def recipes(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256 and chunks: array of (id, digest) in order. id_bits below 64 shortens identifiers (tests of the verification)."""
    cut = rf"(?s).{{{MIN_CHARS},{MAX_CHARS - 1}}}?[.!?\n]|.{{1,{MAX_CHARS}}}"
    body = F.coalesce(F.col("text"), F.lit(""))
    mask = (1 << id_bits) - 1 if id_bits < 64 else -1
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), F.regexp_extract_all(body, F.lit(cut), F.lit(0)).alias("parts")
    ).select("row", "doc_id", "text_sha256", F.transform("parts", lambda c: F.struct(F.xxhash64(c).bitwiseAND(F.lit(mask)).alias("id"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"))


def verified(cut: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: the ordered list of verified identifiers."""
    chunks = cut.select(F.explode("chunks").alias("c")).groupBy("c.id").agg(F.min("c.digest").alias("lo"), F.max("c.digest").alias("hi"))
    clashes = materialise(chunks.where("lo <> hi").select("id"))
    n = clashes.count()
    if not n:
        return cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: c["id"]).alias("recipe"))
    parts = cut.select("row", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "c")).select("row", "doc_id", "text_sha256", "pos", "c.id", F.hex("c.digest").alias("digest"))
    named = parts.join(bounded(clashes.withColumn("clash", F.lit(True)), n), "id", "left").withColumn("ident", F.when(F.col("clash"), F.col("digest")).otherwise(F.col("id").cast("string")))
    lists = named.groupBy("row", "doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "ident")))).alias("l"))
    return lists.select("doc_id", "text_sha256", F.transform("l", lambda x: x["ident"]).alias("recipe"))


def exact_dedup(docs: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    cut = materialise(recipes(docs, id_bits))
    lists = verified(cut)
    # Only groups of two or more are joined, so most rows, and those of a hot recipe, stay where they are.
    groups = materialise(lists.groupBy("recipe").agg(F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    ids = groups.agg(F.sum(F.size("recipe") + 2)).head()[0] or 0
    joined = lists.join(bounded(groups, ids, BROADCAST_IDS), "recipe", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("most"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
