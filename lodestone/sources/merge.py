"""A chunk store that takes batches: rows in buckets by a hash of their key, a merge that rewrites touched buckets only.

Layout below the root:

* ``data/writing=<id>/bucket=<b>/*.parquet``: what one merge wrote, whole buckets of it;
* ``commits/version=<n>``: one row (batch_id, writing, bucket) for each bucket of that merge, written last.

The live copy of a bucket is that of its highest version, so a reader sees a merge entirely or not at all, and readers of
older copies aren't disturbed until vacuum(). A merge that dies before its commit leaves data that nothing names; running it
again writes new data. The commits are the ledger: a batch id that stands there is not merged again. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.store import latest
from lodestone.sources.work import written

COMMITS = "batch_id string, writing string, bucket int, version long"


class MergeStore:
    """Rows with one key column. A later batch replaces rows of equal key; within a batch the last by `order` stays (all columns, unless given)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, *, key: str = "chunk_id", order: list[str] | None = None, buckets: int = 64, files_per_bucket: int = 1):
        self.spark, self.root, self.key, self.order = spark, root.rstrip("/"), key, order
        self.schema = schema if isinstance(schema, T.StructType) else spark.createDataFrame([], schema).schema
        self.buckets, self.files_per_bucket = buckets, files_per_bucket

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commits(self) -> DataFrame:
        """The ledger: batch_id, writing, bucket, version."""
        path = f"{self.root}/commits"
        if not self._exists(path):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(path)

    def live(self) -> dict[int, str]:
        """bucket -> the writing that holds it; at most one entry for each bucket."""
        rows = self.commits().groupBy("bucket").agg(F.max_by("writing", "version").alias("writing")).where("bucket >= 0").collect()
        return {r.bucket: r.writing for r in rows}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of the buckets named; the filter is on partition columns, so other buckets' files aren't opened."""
        live = {b: w for b, w in self.live().items() if only is None or b in set(only)}
        if not live:
            return self.spark.createDataFrame([], self.schema)
        by_writing: dict[str, list[int]] = {}
        for b, w in live.items():
            by_writing.setdefault(w, []).append(b)
        where = F.lit(False)
        for w, bs in sorted(by_writing.items()):
            where = where | ((F.col("writing") == w) & F.col("bucket").isin(sorted(bs)))
        parts = T.StructType([*self.schema.fields, T.StructField("writing", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(parts).parquet(f"{self.root}/data").where(where).select(*self.schema.names)

    def find(self, keys: list) -> DataFrame:
        """Rows of a few keys, from their buckets alone."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        only = [r[0] for r in asked.select(self.bucket()).distinct().collect()]
        return self.read(only).where(F.col(self.key).isin(*keys))

    def merge(self, batch: DataFrame, batch_id: str, deleted: DataFrame | None = None) -> bool:
        """Adds a batch, and drops the keys in `deleted`; False, and nothing is done, where the ledger has its id. Null keys are refused."""
        if not self.commits().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        fresh = written(latest(self._shaped(batch), self.key, self.order or "all").withColumn("bucket", self.bucket()))  # parsed once
        gone = fresh.select(self.key, "bucket")
        if deleted is not None:
            gone = gone.unionByName(deleted.select(self.key).distinct().withColumn("bucket", self.bucket())).distinct()
        touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())  # at most `buckets`
        writing = f"w{uuid.uuid4().hex}"
        if touched:
            stays = self.read(touched).withColumn("bucket", self.bucket()).join(gone, [self.key, "bucket"], "left_anti")
            rows = stays.select(*self.schema.names, "bucket").unionByName(fresh.select(*self.schema.names, "bucket"))
            spread = F.pmod(F.xxhash64(F.col(self.key), F.lit(1)), F.lit(self.files_per_bucket))
            path = f"{self.root}/data/writing={writing}"
            rows.repartition("bucket", spread).write.partitionBy("bucket").parquet(path)
        version = (self.commits().agg(F.max("version")).head()[0] or 0) + 1
        held = [(batch_id, writing, b) for b in touched] or [(batch_id, writing, -1)]  # an empty batch is remembered too
        entry = self.spark.createDataFrame(held, "batch_id string, writing string, bucket int").coalesce(1)
        entry.write.mode("errorifexists").parquet(f"{self.root}/commits/version={version}")
        return True

    def _shaped(self, batch: DataFrame) -> DataFrame:
        known = set(batch.columns)
        cols = [(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        key = F.col(self.key)
        return batch.select(*cols).withColumn(self.key, F.when(key.isNull(), F.raise_error(F.lit(f"{self.key} is null")).cast(self.schema[self.key].dataType)).otherwise(key))

    def vacuum(self) -> int:
        """Deletes data that no bucket's live copy uses; how many writings went. Not while older copies are read."""
        path = f"{self.root}/data"
        if not self._exists(path):
            return 0
        hadoop, used = self.spark._jvm.org.apache.hadoop.fs, set(self.live().values())
        fs = hadoop.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        stale = [s.getPath() for s in fs.listStatus(hadoop.Path(path)) if s.getPath().getName().removeprefix("writing=") not in used]
        return sum(bool(fs.delete(p, True)) for p in stale)


def ingest(files: DataFrame, into: MergeStore, parse: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "ingest"):
    """New files of a stream parsed to chunks and merged, a batch each; a batch that runs again after a failure changes nothing."""
    return (
        files.writeStream.foreachBatch(lambda df, n: into.merge(parse(df), f"{name}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
