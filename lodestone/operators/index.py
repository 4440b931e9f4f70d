"""A stored index for BM25: the words of documents and the maxima of their blocks, added to by batches, asked with blocks left out.

Layout below the path, where a block is BLOCK documents that one task read in a row:

* ``documents/batch=<id>``, a row for each document: ``key``, ``block``, ``dl`` (its words) and, as arrays, ``term`` and
  ``tf``, its different words with their counts;
* ``blocks/batch=<id>``, a row for each term of a block, by term in stretches of blocks: ``n``, ``max_tf``, ``min_dl``,
  ``sum_dl``: documents of the block that hold the term, its greatest count in one, the shortest of them in words, and their
  words together. A block that two tasks read back has two rows, and its bound is the sum of theirs, which still is a bound.

Every document also stands under the empty term of its block, which no word equals, so its rows hold the number of documents
and words. Frequencies, lengths and counts of batches add up; nothing is computed for the whole corpus when a batch comes. A
batch is written from one scan without a shuffle, and writing it again replaces it. Batches add documents; one that changes
belongs to a new index. Rows that share an id are merged by grouping.

A question first sees the maxima alone: a block's bound is what its terms would score if one document had the greatest count
of each and the least length. The SEED best blocks of each question are opened first; the kth score there is a floor under the
final one, and only blocks whose bound reaches it are opened after that. Documents are scored where they lie, and a task
passes on at most k rows for each question, so no pair of a question and a document is shuffled. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.best import steps
from lodestone.operators.lexical import bounded, idf, query_terms, ranked, repeated, scored_postings, shared, tiles, unshared, weights, words_of
from lodestone.sources.work import short_batches, written

BLOCK, SEED = 64, 4
#: Documents whose words or maxima are made in one step.
RUN = 1024
#: Scores are rounded to this many places; a bound within half of the last one counts as reaching the floor.
PLACES = 6
MAXIMA = "block long, term string, n int, max_tf int, min_dl int, sum_dl long"


@dataclass(frozen=True)
class Index:
    """documents: batch, block, key, dl, term, tf; blocks: batch, block, term, n, max_tf, min_dl, sum_dl."""

    documents: DataFrame
    blocks: DataFrame

    @cached_property
    def twice(self) -> DataFrame | None:
        return repeated(self.documents, "key")


def add(corpus: DataFrame, path: str, batch_id: str, *, key: str, text: str = "text", block: int = BLOCK) -> None:
    """Writes a batch of documents, in one scan of them."""
    number = F.shiftright(F.monotonically_increasing_id(), block.bit_length() - 1)  # rows of one task, `block` (a power of two) at a time
    t = corpus.select(F.col(key).alias("key"), number.alias("block"), tx.tokens(F.col(text)).alias("t"))
    schema, to = f"key {corpus.schema[key].dataType.simpleString()}, block long, dl int, term array<string>, tf array<int>", f"{path}/documents/batch={batch_id}"
    with short_batches(corpus.sparkSession, RUN):
        t.mapInArrow(_counted, schema).write.mode("overwrite").option("compression", "zstd").parquet(to)
        held = corpus.sparkSession.read.schema(schema).parquet(to).select("block", "dl", "term", "tf")
        held.mapInArrow(_maxima, MAXIMA).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks/batch={batch_id}")


def _counted(batches: Iterator) -> Iterator:
    """Each document's different words with their counts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in steps(batches, RUN):
        tokens = b.column("t")
        size, words = pc.list_value_length(tokens).to_numpy(zero_copy_only=False), tokens.flatten().dictionary_encode()
        many = max(1, len(words.dictionary))
        code, tf = np.unique(np.repeat(np.arange(b.num_rows), size) * many + words.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code // many, minlength=b.num_rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (words.dictionary.take(pa.array(code % many)), pa.array(tf, pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("block"), pa.array(size, pa.int32()), *lists], ["key", "block", "dl", "term", "tf"])


def _whole_blocks(batches: Iterator) -> Iterator:
    """The rows again, RUN or more at a time, cut between blocks."""
    import numpy as np
    import pyarrow as pa

    rest = None
    for b in steps(batches, RUN):
        b = b if rest is None else pa.concat_batches([rest, b])
        block = b.column("block").to_numpy()
        ends = np.flatnonzero(block[1:] != block[:-1])
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield b.slice(0, cut)
        rest = b.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _maxima(batches: Iterator) -> Iterator:
    """n, max_tf, min_dl and sum_dl of each term and block, in order of both; the empty term stands for every document."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in _whole_blocks(batches):
        size, words = pc.list_value_length(b.column("term")).to_numpy(zero_copy_only=False), b.column("term").flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        place = np.empty(len(order), "i8")
        place[order] = np.arange(1, len(order) + 1)
        blocks, at = np.unique(b.column("block").to_numpy(), return_inverse=True)
        row = np.concatenate([np.arange(b.num_rows), np.repeat(np.arange(b.num_rows), size)])
        code = np.concatenate([np.zeros(b.num_rows, "i8"), place[words.indices.to_numpy()]]) * len(blocks) + at[row]
        tf = np.concatenate([np.ones(b.num_rows, "i4"), b.column("tf").flatten().to_numpy()])
        dl = b.column("dl").to_numpy()[row]
        by = np.argsort(code, kind="stable")
        code, first, n = np.unique(code[by], return_index=True, return_counts=True)
        term = pa.concat_arrays([pa.array([""], pa.string()), words.dictionary.take(pa.array(order))]).take(pa.array(code // len(blocks)))
        numbers = [(n, "i4"), (np.maximum.reduceat(tf[by], first), "i4"), (np.minimum.reduceat(dl[by], first), "i4"), (np.add.reduceat(dl[by].astype("i8"), first), "i8")]
        yield pa.RecordBatch.from_arrays([pa.array(blocks[code % len(blocks)]), term, *(pa.array(x.astype(kind)) for x, kind in numbers)], ["block", "term", "n", "max_tf", "min_dl", "sum_dl"])


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string")) for name in ("documents", "blocks")))


def totals(index: Index) -> DataFrame:
    """One row: n documents and their mean length in words (1.0 where there are none)."""
    every = index.blocks.where(F.col("term") == "")
    return every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("sum_dl") / F.sum("n"), F.lit(1.0)).alias("avg_dl"))


def frequencies(index: Index, words: DataFrame) -> DataFrame:
    """(term, df) of the words that the index holds; rows of one id and length count once."""
    df = index.blocks.join(words, "term").groupBy("term").agg(F.sum("n").alias("df"))
    if index.twice is None:
        return df
    each = index.documents.join(index.twice, F.col("key").eqNullSafe(F.col("_twice")), "left_semi").select("key", "dl", F.explode("term").alias("term")).join(words, "term")
    less = each.groupBy("term").agg((F.count_distinct(F.struct("key", "dl")) - F.count(F.lit(1))).alias("df"))
    return df.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"))


def _gain(tf: Column, dl: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * (dl / F.col("avg_dl"))))


def bounds(index: Index, queries: DataFrame, *, query: str, text: str = "text", k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(terms, blocks): terms of the queries with times, df, n_docs, avg_dl and idf; (query, batch, block, bound) of every block that holds one. Reads maxima alone."""
    return _bounds(index, query_terms(queries, query, text), query, k1, b)


def _bounds(index: Index, asked: DataFrame, query: str, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    df = frequencies(index, bounded(asked.select("term").distinct()))
    terms = written(asked.join(df, "term").crossJoin(F.broadcast(totals(index))).withColumn("idf", idf(F.col("n_docs"), F.col("df"))))  # one row
    most = F.col("times") * F.col("idf") * _gain(F.col("max_tf").cast("double"), F.col("min_dl"), k1, b)
    held = index.blocks.select("batch", "block", "term", "max_tf", "min_dl").join(bounded(terms.select(query, "term", "times", "idf", "avg_dl")), "term")
    return terms, held.groupBy(query, "batch", "block").agg(F.sum(most).alias("bound"))


def _numbering(spark: SparkSession, words: list[str]):
    """Rows of documents to rows of postings: of their words those that are named, by number."""
    sent = spark.sparkContext.broadcast(words)

    def numbered(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = pa.array(sent.value, pa.string())
        for b in steps(batches, RUN):
            size = pc.list_value_length(b.column("term")).to_numpy(zero_copy_only=False)
            at = pc.index_in(b.column("term").flatten(), value_set=asked)
            held = pc.is_valid(at)
            row = np.repeat(np.arange(b.num_rows), size)[held.to_numpy(zero_copy_only=False)]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x.filter(held)) for x in (at, b.column("tf").flatten())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 2)), *lists], b.schema.names)

    return numbered


class _Tile:
    """The best documents of some queries."""

    def __init__(self, index: Index, queries: DataFrame, tile: list, *, doc: str, query: str, top: int, k1: float, b: float):
        self.index, self.queries, self.tile, self.doc, self.query, self.top, self.k1, self.b = index, queries, tile, doc, query, top, k1, b
        self.words, ids = words_of(tile), dict(queries.dtypes)[query]
        asked = queries.sparkSession.createDataFrame([(r[0], t.term, t.times) for r in tile for t in r.terms], f"`{query}` {ids}, term string, times long")
        self.terms, blocks = _bounds(index, asked, query, k1, b)
        self.blocks = written(blocks)
        df = {r.term: r for r in self.terms.select("term", "df", "n_docs", "avg_dl").distinct().collect()}  # at most a tile's words
        n, self.avg_dl = next(((r.n_docs, r.avg_dl) for r in df.values()), (0, 1.0))
        self.numbered = _numbering(queries.sparkSession, self.words)
        self.weight = weights(n, [df[w].df if w in df else 0 for w in self.words])

    def scored(self, which: DataFrame, merged: DataFrame | None = None) -> DataFrame:
        """(query, doc, score) of each task's best documents in these blocks, and of merged ones."""
        opened = bounded(which.select("batch", "block").distinct())
        held = self._postings(unshared(self.index.documents.join(opened, ["batch", "block"], "left_semi"), self.index.twice, "key"))
        ways = dict(doc=self.doc, query=self.query, top=self.top, k1=self.k1, b=self.b, numbered=self.numbered)
        return scored_postings(held, merged, self.queries, self.tile, self.weight, self.avg_dl, **ways)

    def _postings(self, documents: DataFrame) -> DataFrame:
        return documents.select(F.col("key").alias(self.doc), "dl", "term", "tf")

    def opened(self, seed: int) -> DataFrame:
        first = Window.partitionBy(self.query).orderBy(F.desc("bound"), "batch", "block")
        best = self.blocks.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= seed)
        down = Window.partitionBy(self.query).orderBy(F.desc("score"))
        floor = self.scored(best).withColumn("_n", F.row_number().over(down)).where(F.col("_n") == self.top).select(self.query, F.col("score").alias("floor"))
        return self.blocks.join(bounded(floor), self.query, "left").where((F.col("bound") + 10.0**-PLACES >= F.coalesce("floor", F.lit(0.0))))

    def found(self, seed: int) -> DataFrame:
        twice, merged = self.index.twice, None
        if twice is not None:
            rows = self.index.documents.join(twice, F.col("key").eqNullSafe(F.col("_twice")), "left_semi")
            held, kind = self._postings(rows), self.index.documents.schema["key"].dataType.simpleString()
            merged = shared(held.mapInArrow(self.numbered, f"`{self.doc}` {kind}, dl int, term array<int>, tf array<int>"), twice, self.doc)
        return self.scored(self.opened(seed), merged)


def opened_blocks(index: Index, queries: DataFrame, *, query: str, top: int = 30, seed: int = SEED, text: str = "text", k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(terms, blocks that must be opened): the seed blocks, and those whose bound reaches the floor that they give."""
    out = None
    for some in tiles(query_terms(queries, query, text), query):
        tile = _Tile(index, queries, some, doc="_doc", query=query, top=top, k1=k1, b=b)
        part = tile.terms, tile.opened(seed)
        out = part if out is None else tuple(x.unionByName(y) for x, y in zip(out, part))
    return out or bounds(index, queries, query=query, text=text, k1=k1, b=b)


def search(index: Index, queries: DataFrame, *, doc: str, query: str, top: int = 30, seed: int = SEED, text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, doc, score, rank) of the best `top` documents with a positive score, from the index alone; ties by doc."""
    out = None
    for tile in tiles(query_terms(queries, query, text), query):
        part = _Tile(index, queries, tile, doc=doc, query=query, top=top, k1=k1, b=b).found(seed)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.select(query).limit(0).crossJoin(index.documents.select(F.col("key").alias(doc)).limit(0)).withColumn("score", F.lit(0.0))
    return ranked(out, query, doc, top)
