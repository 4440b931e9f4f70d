"""Queries over the stores: merges by batch, pages of files, the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import dense, index, vector_index
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import BM25_SQL, DENSE_EMB
from lodestone.sources import paged
from lodestone.sources.merge import MergeStore
from lodestone.sources.work import work_dir

CHUNKS = "chunk_id string, text_md5 string, source string, n int, meta map<string, string>"


@query("""WITH b1 AS (SELECT doc_id, 'c' || doc_id AS chunk_id, md5(coalesce(text, '')) AS text_md5, source, 1 AS n, lang AS tag FROM documents),
b2 AS (SELECT doc_id, 'c' || doc_id AS chunk_id, md5(coalesce(text, '') || '!') AS text_md5, source || '/2' AS source, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS n, lang AS tag FROM documents WHERE n_chars % 2 = 0),
b3 AS (SELECT doc_id, 'n' || doc_id AS chunk_id, md5(coalesce(text, '')) AS text_md5, source, 4 AS n, 'z' AS tag FROM documents WHERE n_chars % 5 = 0),
a AS (SELECT * FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM b2) UNION ALL SELECT * FROM b2)
SELECT chunk_id, text_md5, source, n::INTEGER AS n, tag FROM (SELECT * FROM a WHERE doc_id % 7 <> 0 UNION ALL SELECT * FROM b3)""")
def merge_store(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as chunks, a batch of changed ones that names some twice, a batch of new ones that differ in a map alone with some deleted, and the second batch again."""
    d = table(spark, sf, "documents")
    chunk = lambda name, text, source, n, tag: [F.concat(F.lit(name), F.col("doc_id")).alias("chunk_id"), F.md5(text.cast("binary")).alias("text_md5"), source.alias("source"), F.lit(n).alias("n"), F.create_map(F.lit("tag"), tag).alias("meta")]
    text, source = F.coalesce("text", F.lit("")), F.col("source")
    store = MergeStore(spark, work_dir(spark), CHUNKS, buckets=16)
    store.merge(d.select(*chunk("c", text, source, 1, F.col("lang"))), "first")
    changed = d.where("n_chars % 2 = 0")
    again = lambda rows, n: rows.select(*chunk("c", F.concat(text, F.lit("!")), F.concat(source, F.lit("/2")), n, F.col("lang")))
    second = again(changed.where("doc_id % 3 = 0"), 3).unionByName(again(changed, 2))
    store.merge(second, "second")
    new = d.where("n_chars % 5 = 0")
    third = new.select(*chunk("n", text, source, 4, F.lit("a"))).unionByName(new.select(*chunk("n", text, source, 4, F.lit("z"))))
    store.merge(third, "third", deleted=d.where("doc_id % 7 = 0").select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id")))
    store.merge(second, "second")  # a replay: the ledger has it
    return store.read().select("chunk_id", "text_md5", "source", "n", F.col("meta")["tag"].alias("tag"))


@query(r"""WITH f AS (SELECT source, doc_id // 400 AS part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents WHERE text IS NOT NULL GROUP BY source, part),
l AS (SELECT source, part, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS n, len(string_split(body, chr(10))) AS many FROM f),
p AS (SELECT source, part, n // 55 + 1 AS page, string_agg(line || CASE WHEN n < many - 1 THEN chr(10) ELSE '' END, '' ORDER BY n) AS text FROM l WHERE n < many - 1 GROUP BY ALL)
SELECT source, part, page::INTEGER AS page, length(text) AS n_chars, md5(text) AS page_md5 FROM p WHERE page BETWEEN 2 AND 40""")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files, one for each source and 400 ids, and pages 2 to 40 read back: the filter reaches the source, which cuts its ranges by it."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", "source", F.floor(F.col("doc_id") / 400).cast("long").alias("part"))
    path = work_dir(spark)
    # each (source, part) is one file, in order of doc_id
    d.repartition("source", "part").sortWithinPartitions("source", "part", "doc_id").select("text", "source", "part").write.partitionBy("source", "part").text(path)
    pages = paged.read(spark, path).where("page between 2 and 40")
    name = lambda k: F.regexp_extract("file_path", rf"{k}=([^/]*)/", 1)
    return pages.select(name("source").alias("source"), name("part").cast("long").alias("part"), "page", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("page_md5"))


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank::INTEGER AS rank FROM bm25")
def bm25_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The index written in two batches, then asked: the questions never read the corpus."""
    d, path = table(spark, sf, "documents").select("doc_id", "text"), work_dir(spark)
    index.add(d.where("doc_id % 3 > 0"), path, "first", key="doc_id")
    index.add(d.where("doc_id % 3 = 0"), path, "second", key="doc_id")
    return index.search(index.open_index(spark, path), table(spark, sf, "benchmark"), doc="doc_id", query="item_id")


#: The vectors of the table are spread evenly, so most cells hold something near: recall is 0.75 with 8 cells of 24, 0.90 with 14, 0.94 with 16.
CELLS, PROBES = 24, 16


def _indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, str]:
    v, path = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")), work_dir(spark)
    vector_index.write(v, path, vector_index.fit(v, CELLS), key="vec_id")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), path


@query(DENSE_EMB() + " SELECT * FROM r WHERE rank <= 6")
def dense_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The vector index with every cell opened: the exact result."""
    _, q, path = _indexed(spark, sf)
    return vector_index.search(spark, path, q, 6, CELLS, doc="vec_id", query="query_id")


@query()
def dense_few_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The vector index with PROBES of its cells opened for each question, and how much of the exact result that meets."""
    v, q, path = _indexed(spark, sf)
    found = vector_index.search(spark, path, q, 6, PROBES, doc="vec_id", query="query_id")
    return vector_index.recall(found, dense.top_k(v, q, 6, doc="vec_id", query="query_id"), query="query_id", doc="vec_id")
