"""An inverted file of centroids over vectors: every row lies in the cell of its nearest centroid, a question opens a few cells.

Centroids come from Spark's k-means on a random sample of about SAMPLE rows, a bounded fit; the sample decides how even the
cells are and how many of them a question needs, never which rows are indexed. The table is written once, partitioned by
cell, so cells that no question opens are not read. Scores are exact inner products; with all cells opened the result is
that of the exact search. Lengths are taken out for the choice of cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.best import Best, arrow_type, rounded, steps
from lodestone.operators.dense import TILE, stored

SAMPLE, ROUNDS = 20_000, 10


def fit(vectors: DataFrame, cells: int, *, vector: str = "vector", sample: int = SAMPLE, seed: int = 7) -> list[list[float]]:
    """At most `cells` centroids, of length 1."""
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    share = min(1.0, sample / max(1, rows.count()))
    x = F.transform(vector, lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = rows.select(F.when(length > 0, F.transform(x, lambda v: v / length)).otherwise(x).alias("v")).sample(share, seed=seed).select(array_to_vector("v").alias("features"))
    if unit.isEmpty():
        return []
    centres = np.array(KMeans(k=max(2, cells), maxIter=ROUNDS, seed=seed).fit(unit).clusterCenters())
    size = np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres / np.where(size > 0, size, 1.0)).tolist()


def _nearest(held, many: int):
    """UDF: the numbers of the `many` nearest centroids of each vector, nearest first; none for a null or empty vector."""

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        c = np.array(held.value)
        for vs in batches:
            out: list = [None] * len(vs)
            whole = [k for k, v in enumerate(vs) if v is not None and len(v) == c.shape[1]]
            for lo in range(0, len(whole), 1024):
                fit_ = whole[lo : lo + 1024]
                s = np.array([np.asarray(vs.iloc[k], float) for k in fit_]) @ c.T
                best = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :many]
                for k, b in zip(fit_, best.tolist(), strict=True):
                    out[k] = b
            yield pd.Series(out)

    return near


def write(vectors: DataFrame, path: str, centroids: list[list[float]], *, key: str, vector: str = "vector") -> None:
    """Every row with a vector of the centroids' length, in its cell; other columns are kept."""
    spark = vectors.sparkSession
    held = spark.sparkContext.broadcast(centroids)  # cells times dimensions
    placed = vectors.withColumn("cell", F.element_at(_nearest(held, 1)(F.col(vector)), 1)).where("cell is not null")
    # a large cell is spread over several tasks
    placed.repartition("cell", F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([(k, c) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, *, doc: str, query: str, vector: str = "vector", where=None, places: int = 6) -> DataFrame:
    """(query, doc, score, rank) of the best k rows of each query's `probes` nearest cells, by inner product rounded to `places`, ties by doc.

    Queries come in tiles of bounded size, which are broadcast; a cell's rows meet only the queries that open it, and a task
    passes on at most k rows for each query. where: a filter on the indexed rows' columns.
    """
    centroids = [r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()]
    held = spark.sparkContext.broadcast(centroids)
    asked = queries.select(query, vector, _nearest(held, probes)(F.col(vector)).alias("_cells")).where("_cells is not null")
    base = spark.read.parquet(f"{path}/vectors")
    base = base if where is None else base.where(where)
    kind, out, after = base.schema[doc].dataType.simpleString(), None, None
    while True:
        tile = (asked if after is None else asked.where(F.col(query) > after)).orderBy(query).limit(TILE).collect()
        if not tile:
            break
        after = tile[-1][0]
        opened = sorted({c for r in tile for c in r["_cells"]})
        part = _tile(base.where(F.col("cell").isin(opened)).select(doc, vector, "cell"), tile, k, doc, query, vector, places, kind, queries)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.select(query).limit(0).crossJoin(base.select(doc).limit(0)).select(query, doc, F.lit(0.0).alias("score"))
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc)))
    return best.where(F.col("rank") <= k)


def _tile(rows: DataFrame, tile: list, k: int, doc: str, query: str, vector: str, places: int, kind: str, queries: DataFrame) -> DataFrame:
    id_type = arrow_type(queries, query)
    held = rows.sparkSession.sparkContext.broadcast(([r[0] for r in tile], [r[1] for r in tile], [r["_cells"] for r in tile]))

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, vectors, cells = held.value
        q, by_cell, best, read = np.array(vectors, float), {}, Best(len(ids), k), stored()
        for n, cs in enumerate(cells):
            for c in cs:
                by_cell.setdefault(c, []).append(n)
        for b in steps(batches):
            cell = np.array(b.column("cell"))
            for c in np.unique(cell).tolist():
                mine = np.array(by_cell.get(c, []), "i8")
                if len(mine):
                    part = b.filter(pa.array(cell == c))
                    at, x = read(part.column(vector))
                    best.add(rounded(x @ q[mine].T, places), part.column(doc).take(pa.array(at)), mine)
        yield from best.batches(pa.array(ids, id_type), [query, doc, "score"])

    return rows.mapInArrow(scored, f"`{query}` {dict(queries.dtypes)[query]}, `{doc}` {kind}, score double")


def recall(found: DataFrame, exact: DataFrame, *, query: str, doc: str) -> DataFrame:
    """One row: wanted (rows of the exact result), met (those of them that were found), recall."""
    both = exact.select(query, doc).join(found.select(query, doc, F.lit(1).alias("_hit")), [query, doc], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("met")).withColumn("recall", F.when(F.col("wanted") > 0, F.col("met") / F.col("wanted")))
