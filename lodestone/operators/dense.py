"""Dense retrieval: hash embeddings, exact top-k by cosine or inner product, mean pooling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vec
from lodestone.operators.best import Best, arrow_type, rounded, steps

#: What separates the words that are hashed.
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
#: Query rows whose vectors are broadcast at a time.
TILE = 4096


class _Slots(dict):
    """word -> twice its slot, plus one where it counts as positive."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        import hashlib

        h = int(hashlib.md5(word.encode()).hexdigest(), 16)
        if len(self) >= 100_000:  # a bound on memory
            self.clear()
        self[word] = 2 * (h % self.dim) + (h % 2 == 0)
        return self[word]


def _vector(text: str | None, slots: _Slots):
    """The hash embedding of one text: each word adds its sign over the root of its place, then the length is taken out."""
    import numpy as np

    codes = np.array([slots[w] for w in SPACE.split((text or "").lower()) if w], "i8")
    v = np.bincount(codes >> 1, weights=(2.0 * (codes & 1) - 1.0) / np.sqrt(np.arange(1, len(codes) + 1)), minlength=slots.dim).astype(float)  # of no words it is one of integers
    n = np.sqrt((v * v).sum())
    if n > 0:
        return v / n
    v[0] = 1.0
    return v


def hash_embedding(docs: DataFrame, key: str, text: str = "text", dim: int = 384) -> DataFrame:
    """(key, slot, value) of the non-zero coordinates, normalised; a text without words is the first unit vector. Row by row, without a shuffle."""

    def coordinates(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        slots = _Slots(dim)
        for b in steps(batches):
            v = np.stack([_vector(t, slots) for t in b.column(text).to_pylist()])
            i, at = np.nonzero(v)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(i)), pa.array(at, pa.int32()), pa.array(v[i, at])], [key, "slot", "value"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias(text)).mapInArrow(coordinates, f"`{key}` {kind}, slot int, value double")


def embedder(dim: int = 384):
    """The same embedding as a vectorised function giving array<double>; stands in for a model and may be swapped for one."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _Slots(dim)
        for texts in batches:
            yield pd.Series([_vector(t, slots) for t in texts])

    return embed


def stored():
    """Reads a column of vectors: (rows that have one, their matrix)."""

    def read(column):
        import numpy as np
        import pyarrow.compute as pc

        at = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
        held = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
        return at, held.reshape(len(at), -1) if len(at) else np.zeros((0, 0))

    return read


def hashed(dim: int = 384):
    """Reads a column of texts as their hash embeddings where they are searched, so that no vector leaves the worker. May be swapped for a model."""

    def make():
        slots = _Slots(dim)

        def read(column):
            import numpy as np

            return np.arange(len(column)), np.stack([_vector(t, slots) for t in column.to_pylist()])

        return read

    return make


def top_k(corpus: DataFrame, queries: DataFrame, k: int, *, doc: str, query: str, vector: str = "vector", places: int = 6, content: str | None = None, reader: Callable = stored) -> DataFrame:
    """(query, doc, score, rank) by inner product rounded to `places`, ties by doc; exact.

    Queries are taken in tiles of bounded size, broadcast, and multiplied with STEP rows of the corpus at a time; a partition
    passes on at most k rows per query, so neither the corpus nor the product is shuffled. content: the corpus's column that
    the reader makes vectors of, else `vector`; reader: makes the function that a task reads it with.
    """
    parts, after = [], None
    while True:
        left = queries if after is None else queries.where(F.col(query) > after)
        tile = left.select(query, vector).orderBy(query).limit(TILE).collect()
        if not tile:
            break
        after = tile[-1][0]
        parts.append(_tile(corpus.select(doc, content or vector), queries, tile, k, doc, query, content or vector, places, reader))
    if not parts:
        return queries.select(query).limit(0).crossJoin(corpus.select(doc).limit(0)).select(query, doc, F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc)))
    return best.where(F.col("rank") <= k)


def _tile(corpus: DataFrame, queries: DataFrame, tile: list, k: int, doc: str, query: str, content: str, places: int, reader: Callable) -> DataFrame:
    held = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in tile], [r[1] for r in tile]))
    kinds, id_type = dict(corpus.dtypes), arrow_type(queries, query)

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        q, best, read = np.array(held.value[1], float), Best(len(held.value[0]), k), reader()
        for b in steps(batches):
            at, rows = read(b.column(content))
            if len(at):
                best.add(rounded(rows @ q.T, places), b.column(doc).take(pa.array(at)))
        yield from best.batches(pa.array(held.value[0], id_type), [query, doc, "score"])

    return corpus.mapInArrow(scored, f"`{query}` {dict(queries.dtypes)[query]}, `{doc}` {kinds[doc]}, score double")


def mean_pool(tokens: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, slot, value): mean of a group's vectors, normalised. Sums are combined before the shuffle."""
    cells = tokens.select(group, F.posexplode(vector).alias("slot", "x")).groupBy(group, "slot").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    return cells.select(group, "slot", (F.col("m") / F.when(norm > 1e-12, norm).otherwise(1.0)).alias("value"))


def pool_spans(docs: DataFrame, vectors: str, spans: str) -> DataFrame:
    """Adds `pooled`: for each span (start, end) of token vectors their mean, normalised; an empty or late span gives one clamped token."""

    def unit(m):
        return vec.let(vec.norm(m), lambda n: F.transform(m, lambda x: x / F.when(n > 1e-12, n).otherwise(1.0)))

    def pooled(v, s):
        last = F.size(v) - 1
        single = (s["start"] >= s["end"]) | (s["start"] > last)
        part = F.when(single, F.slice(v, F.least(s["start"], last) + 1, F.lit(1))).otherwise(F.slice(v, s["start"] + 1, s["end"] - s["start"]))
        total = lambda p: F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.element_at(p, 1), lambda a, r: F.zip_with(a, r, lambda x, y: x + y))
        mean = lambda p: vec.let(total(p), lambda t: F.transform(t, lambda x: x / F.size(p)))
        # each step is named once, so nothing is computed again for every coordinate
        return vec.let(part, lambda p: vec.let(mean(p), unit))

    return docs.withColumn("pooled", F.transform(spans, lambda s: pooled(F.col(vectors), s)))
