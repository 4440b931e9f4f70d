"""Chunk store: a Parquet table with upserts by id, catalogues, feedback files and the export bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(schema: T.StructType, names: list[str]) -> list[Column]:
    """The columns as values that can be ordered: a map counts as its entries in order of their keys. Maps inside other columns need an order of their own."""
    out = []
    for n in names:
        kind = schema[n].dataType
        if isinstance(kind, T.MapType) and "map" not in kind.valueType.simpleString():
            out.append(F.array_sort(F.map_entries(n)))
        elif "map<" in kind.simpleString():
            raise ValueError(f"rows can't be ordered by {n}: name the columns to order by")
        else:
            out.append(F.col(n))
    return out


def latest(rows: DataFrame, key: str | list[str], order: list[str] | str = "all") -> DataFrame:
    """Last row of each key by the order columns, then by all others, so that no two different rows tie."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    first = [] if order == "all" else list(order)
    try:
        by = ordered(rows.schema, [*first, *(c for c in rest if c not in first)])
    except ValueError:
        if not first:
            raise
        by = ordered(rows.schema, first)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """stored with new rows added and rows of equal key replaced; of equal keys in new, the last by the order columns stays (all columns, unless given)."""
    fresh = latest(new, key, order or "all")
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """A new version of a table beside older ones; readers of those aren't disturbed."""
    path = f"{root}/v={version}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def coerce_metadata(metadata: Column) -> Column:
    """Map of strings without nulls; JSON arrays become their items joined by ", "."""
    items = lambda v: F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v)
    return F.transform_values(F.map_filter(metadata, lambda k, v: v.isNotNull()), lambda k, v: items(v))


def get(store: DataFrame, where: Column | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of a collection, optionally filtered, in store order, the first `limit`."""
    out = store.where(where) if where is not None else store
    out = out.orderBy(order) if order else out
    return out.limit(limit) if limit else out


def image_chunks(store: DataFrame, order: str, limit: int = 6) -> DataFrame:
    """Chunks with an image; where none is flagged, those of the first 50 whose text or URL shows one."""
    flagged = store.where("has_image")
    if not flagged.isEmpty():
        return flagged.orderBy(order).limit(limit).withColumn("score", F.lit(0.85))
    low = F.lower("text")
    shown = F.contains(low, F.lit("[image url:")) | F.contains(low, F.lit("[image / figure:")) | (F.length(F.coalesce("image_url", F.lit(""))) > 0)
    return store.orderBy(order).limit(50).where(shown).orderBy(order).limit(limit).withColumn("score", F.lit(0.85))


def lead_chunks(store: DataFrame, order: str, limit: int = 4) -> DataFrame:
    return store.orderBy(order).limit(limit).withColumn("score", F.lit(0.80))


def count(store: DataFrame) -> DataFrame:
    """One row: n, the chunks of a collection."""
    return store.agg(F.count(F.lit(1)).alias("n"))


def write_feedback(entries: DataFrame, session_path: str, global_path: str) -> None:
    """Entries added as JSON lines to the session's store and to the global one; what stands there isn't rewritten."""
    for path in (session_path, global_path):
        entries.write.mode("append").json(path)


def read_feedback(spark: SparkSession, session_path: str, global_path: str) -> DataFrame:
    """Feedback of a session, or the global store where the session has none; a file is a JSON array or has an entry per line."""
    schema = "query string, answer string, rating string, model string, citations array<string>, timestamp double"
    for path in (session_path, global_path):
        try:
            text = F.trim("value")
            lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.from_json(x, schema))
            entries = F.when(F.startswith(text, F.lit("[")), F.from_json(text, f"array<struct<{schema}>>")).otherwise(lines)
            df = spark.read.option("wholetext", True).text(path).select(F.explode(entries).alias("e")).select("e.*")
            if not df.isEmpty():
                return df
        except Exception as e:  # a missing store counts as empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """All tables as Parquet below a folder, with a manifest of their names and counts."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame(rows, "name string, n_rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


#: Embedding models (name, dimensions, query prefix, passage prefix).
EMBEDDING_MODELS = (
    ("BAAI/bge-base-en-v1.5", 768, "Represent this sentence for searching relevant passages: ", ""),
    ("all-MiniLM-L6-v2", 384, "", ""),
    ("BAAI/bge-m3", 1024, "", ""),
    ("BAAI/bge-large-en-v1.5", 1024, "Represent this sentence for searching relevant passages: ", ""),
    ("nomic-ai/nomic-embed-text-v1.5", 768, "search_query: ", "search_document: "),
)


def embedding_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMBEDDING_MODELS, "name string, dim int, query_prefix string, passage_prefix string")


def with_prefix(texts: DataFrame, catalog: DataFrame, kind: str = "query") -> DataFrame:
    """(…, model, text) with the model's prefix before the text."""
    from lodestone.operators.lexical import bounded

    p = catalog.select(F.col("name").alias("model"), F.col(f"{kind}_prefix").alias("_p"))
    return texts.join(bounded(p), "model", "left").withColumn("text", F.concat(F.coalesce("_p", F.lit("")), "text")).drop("_p")


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
