"""Exact top-k search by inner product (operator 10): distributed histogram selection.

Queries come in tiles of TILE rows, whose vectors are broadcast (a fixed bound: TILE rows). For a tile, every candidate is
scored; histograms of BINS bins per query are summed over all partitions, and the bin that holds a query's kth score is
refined in the next round until it is one integer wide. A last pass keeps scores at or above it. Ties at the kth score go
to the smaller vec_id; a partition keeps at most k rows per query, as no further one can be among the k first.

Scores are integers: floor(scale * x) of each component, products in float64 while the bound of a score stays below 2^53
(exact there), in int64 below 2^62, and in unbounded integers beyond it. Ranks follow the exact scores at any size; only
what is shown of a score that a long cannot hold is the nearest long. A tile's result is written before the next tile begins, and its broadcasts are dropped.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
length than the query's are no candidates of it; fewer than k candidates give all; rows that repeat a vec_id are
candidates of their own; of query rows that repeat a vec_id the least vector (component by component) asks, and a query's own
id is never its candidate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, table, work_dir

TILE, BINS, ROWS = 4096, 256, 1024

OUT = "query_id long, vec_id long, score long, beyond string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def beyond(score: int) -> str:
    """Orders scores that one long stands for: text that rises with the score, "m" for all that a long holds."""
    if LEAST <= score <= MOST:
        return "m"
    digits = str(abs(score))
    return f"p{len(digits):04d}{digits}" if score > 0 else f"a{9999 - len(digits):04d}{digits.translate(_COMPLEMENT)}"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and v: array of floor(scale * x), as whole doubles; rows that take no part are gone."""

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * scale, F.lit(1e308)), F.lit(-1e308))
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # doubles of that size are whole

    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v")
    )


def _tiles(queries: DataFrame, tile: int) -> Iterator[list]:
    """Query rows in order, tile by tile; the driver holds one tile at a time."""
    after = None
    while True:
        rows = (queries if after is None else queries.where(F.col("vec_id") > after)).orderBy("vec_id").limit(tile).collect()
        if not rows:
            return
        yield rows
        after = rows[-1].vec_id


def _reach(v) -> int:
    return sum(abs(int(x)) for x in v)


def _scorer(rows: list):
    """(ids, score function): scores of a batch of candidates for every query row of one vector length."""
    import numpy as np

    ids, q = np.array([r.vec_id for r in rows], "i8"), np.array([r.v for r in rows], "f8")
    most = max(_reach(r.v) for r in rows)

    def scored(v):
        bound = most * int(np.abs(v).max(initial=0))
        if bound < 1 << 53:
            return np.rint(v @ q.T).astype("i8")
        if bound < 1 << 62:
            return v.astype("i8") @ q.T.astype("i8")
        return np.array([[int(x) for x in r] for r in v], object) @ np.array([[int(x) for x in r] for r in q], object).T

    return ids, scored


def _batches(frames: Iterator[pd.DataFrame], dims: int):
    import numpy as np

    for b in frames:
        fit = b[b["v"].map(len) == dims]
        for lo in range(0, len(fit), ROWS):
            part = fit.iloc[lo : lo + ROWS]
            yield part.vec_id.to_numpy("i8"), np.array(part["v"].tolist(), "f8").reshape(len(part), dims)


def _select(rows: list, base: DataFrame, k: int, norms: int, path: str) -> None:
    """Adds to path the rows (query_id, vec_id, score) that hold each query's k best, and at most k per partition. norms: the largest component of base."""
    import numpy as np

    spark, dims = base.sparkSession, len(rows[0].v)
    held = spark.sparkContext.broadcast(rows)
    reach = [_reach(r.v) * norms for r in rows]
    reach = np.array(reach, "i8" if max(reach) < 1 << 61 else object)
    lo, hi, need = -reach, reach + 1, np.full(len(rows), k, "i8")  # the kth score lies in [lo, hi), with need of them wanted there
    done = np.zeros(len(rows), bool)
    while not done.all():
        width = np.maximum(-(-(hi - lo) // BINS), 1)
        state = spark.sparkContext.broadcast((lo, hi, width, done))

        def counted(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            lo_, hi_, width_, done_ = state.value
            ids, scored = _scorer(held.value)
            live = np.flatnonzero(~done_)
            counts = np.zeros(len(live) * BINS, "i8")
            base_ = np.arange(len(live)) * BINS
            for vec, v in _batches(frames, dims):
                s = scored(v)[:, live]
                at = (s - lo_[live]) // width_[live] + base_
                at[(s < lo_[live]) | (s >= hi_[live]) | (vec[:, None] == ids[live])] = -1
                counts += np.bincount(at.ravel().astype("i8") + 1, minlength=len(counts) + 1)[1:]
            hit = np.flatnonzero(counts)
            yield pd.DataFrame({"q": live[hit // BINS], "bin": hit % BINS, "n": counts[hit]})

        bins = base.mapInPandas(counted, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        wanted = spark.createDataFrame([(int(q), int(need[q])) for q in np.flatnonzero(~done)], "q long, need long")
        cut = bins.withColumn("upto", F.sum("n").over(above)).join(F.broadcast(wanted), "q").where("upto >= need and upto - n < need").select("q", "bin", F.expr("need - (upto - n) as need")).collect()
        found = np.zeros(len(rows), bool)
        for r in cut:
            lo[r.q] += r.bin * width[r.q]
            hi[r.q], need[r.q], found[r.q] = min(hi[r.q], lo[r.q] + width[r.q]), r.need, True
        done |= ~found | (hi - lo <= 1).astype(bool)  # not found: fewer than k candidates, lo keeps all that are left
        state.destroy()
    cuts = spark.sparkContext.broadcast(lo)

    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, scored = _scorer(held.value)
        best: list[pd.DataFrame] = []
        size = 0

        def trimmed() -> pd.DataFrame:
            out = pd.concat(best).sort_values(["query_id", "score", "beyond", "vec_id"], ascending=[True, False, False, True], kind="stable")
            return out[out.groupby("query_id").cumcount() < k]

        for vec, v in _batches(frames, dims):
            s = scored(v)
            c, q = np.nonzero((s >= cuts.value) & (vec[:, None] != ids))
            kept_, over = s[c, q], "m"
            if kept_.dtype == object:
                kept_, over = np.array([min(max(x, LEAST), MOST) for x in kept_], "i8"), [beyond(x) for x in kept_]
            best.append(pd.DataFrame({"query_id": ids[q], "vec_id": vec[c], "score": kept_, "beyond": over}))
            size += len(c)
            if size > 4 * k * len(ids):
                best = [trimmed()]
                size = len(best[0])
        if best:
            yield trimmed().astype({"beyond": object})  # pandas' own strings may come in no chunk or several, which Spark doesn't take

    base.mapInPandas(kept, OUT).write.mode("append").parquet(path)
    held.destroy()
    cuts.destroy()


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, scale: int = 64, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score for every query row."""
    spark, base = vectors.sparkSession, materialise(quantised(vectors, scale))
    queries = materialise(base.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    norms, path = int(base.select(F.max(F.array_max(F.transform("v", F.abs)))).head()[0] or 0), work_dir(spark)
    spark.createDataFrame([], OUT).write.parquet(path)
    for rows in _tiles(queries, tile):
        for dims in sorted({len(r.v) for r in rows}):
            _select([r for r in rows if len(r.v) == dims], base, k, norms, path)
    out = spark.read.schema(OUT).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 nearest among all other vectors; queries are the rows whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_topk_search": op10_topk_search}
ORACLES = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
}
