"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, packing, each over all that its predecessor kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Mixing cuts and repeats
documents, so after it a doc_id may stand in several rows. SQL cannot express a fitted model, a keyed permutation or the
packing recurrence, so ORACLE_SQL is None and the pipeline is tested against a brute-force version.

Defined cases: stages keep and drop rows, not ids, so rows that share a doc_id are judged one by one, as are rows without
one; null text counts as empty; null lang and source are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from lodestone.llm.common import BATCH_ROWS, bounded, materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _short_batches(spark: SparkSession) -> None:
    """Few rows between Spark and Python at a time, for this session: stages follow one another in the same workers, and what an earlier one took stays with its process."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    _short_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where("tox_predicted = 0").select(*COLUMNS)


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a key `_row` of its rows, and whether that is doc_id. Where ids repeat or are missing, docs is written once with a key of its own."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), True
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id())), False


def _one_each(keyed: DataFrame, groups: DataFrame, best: Column, own: bool) -> DataFrame:
    """keyed with one row of each group: the largest by `best`, then the first row. groups: (_row, grp), of rows in groups of two or more at least."""
    if not own:
        groups = groups.join(keyed.select("_row", "doc_id"), "_row")
    else:
        groups = groups.withColumn("doc_id", F.col("_row"))
    groups = materialise(groups)
    stay = groups.groupBy("grp").agg(F.max_by("_row", F.struct(best, -F.col("_row"))).alias("_row"))
    dropped = materialise(groups.select("_row").join(stay.select("_row"), "_row", "left_anti"))
    # The rows dropped are few, so a counted broadcast usually spares the texts a shuffle.
    return keyed.join(bounded(dropped, dropped.count(), jaccard_join.BROADCAST_PAIRS), "_row", "left_anti").select(*COLUMNS)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest doc_id (a null one is the smallest), the first of several."""
    _short_batches(spark)
    keyed, own = _keyed(docs)
    marks = exact_dedup.exact_dedup(keyed.select(F.col("_row").alias("doc_id"), "text"))
    groups = marks.where("group_size > 1").select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("grp"))
    return _one_each(keyed, groups, F.struct(F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")), own)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one row: that with the smallest doc_id (a null one is the largest), the first of several."""
    _short_batches(spark)
    keyed, own = _keyed(docs)
    classes = materialise(jaccard_join.jaccard_classes(keyed.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("grp")))
    linked = classes.where("_row <> grp")
    groups = linked.unionByName(linked.select(F.col("grp").alias("_row"), "grp").distinct())
    return _one_each(keyed, groups, F.struct(F.col("doc_id").isNotNull(), F.bitwise_not(F.col("doc_id").cast("long"))), own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: one row for each document and epoch that it is drawn in."""
    _short_batches(spark)
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences, a row per piece."""
    _short_batches(spark)
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_equal), ("jaccard_join", drop_near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to documents; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
