"""Lexical retrieval: BM25 over a corpus table for a table of queries, and substring keyword search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.operators.best import Best, arrow_type, rounded, steps
from lodestone.sources.work import written

#: Rows of a query-side table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Queries that BM25 takes at a time, and products of a document's and a query's word that it makes in one step.
TILE, PAIRS = 4096, 1_000_000


def estimated_bytes(df: DataFrame) -> int:
    """What Catalyst takes a plan's result to be at most, from its files' sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A table whose broadcast is proven: left to Catalyst where its own estimate is below its threshold, which needs no job.

    Else the table is written in the shared folder, counted there, and hinted where it has at most `limit` rows; a larger
    one is joined by a shuffle. Either way its plan runs once.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if estimated_bytes(df) <= most:
        return df
    kept = written(df)
    return F.broadcast(kept) if kept.limit(limit + 1).count() <= limit else kept


def containing(texts: DataFrame, terms: DataFrame, *, key: str, low: str, term: str, tile: int = BROADCAST_ROWS) -> DataFrame:
    """(key, term) for every term that a lower-case text holds anywhere.

    Terms come in tiles of `tile`, each one automaton that is broadcast; every text is read once for each tile.
    """
    schema = T.StructType([texts.schema[key], T.StructField(term, T.StringType())])
    distinct, out, after = terms.where(F.col(term).isNotNull()).select(term).distinct(), None, None
    while True:
        some = [r[0] for r in (distinct if after is None else distinct.where(F.col(term) > after)).orderBy(term).limit(tile).collect()]  # at most `tile`
        if not some:
            break
        after = some[-1]
        found = texts.select(key, low).mapInArrow(_finder([t for t in some if t], key, low, term, texts), schema)
        if some[0] == "":  # an empty term stands in every text
            found = found.unionByName(texts.where(F.col(low).isNotNull()).select(key, F.lit("").alias(term)))
        out = found if out is None else out.unionByName(found)
        if len(some) < tile:
            break
    return out if out is not None else texts.sparkSession.createDataFrame([], schema)


def _finder(terms: list[str], key: str, low: str, term: str, texts: DataFrame):
    held = texts.sparkSession.sparkContext.broadcast(terms)

    def found(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for t in held.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for b in steps(batches):
            hits = [sorted({t for _, t in automaton.iter(x)}) if x and held.value else [] for x in b.column(low).to_pylist()]
            at = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(key).take(at), pa.array([t for h in hits for t in h], pa.string())], [key, term])

    return found


def corpus_stats(corpus: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents and their mean length in words (1.0 where there are none)."""
    return corpus.select(F.size(tx.tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))


def postings(corpus: DataFrame, words: list[str], key: str, text: str = "text") -> DataFrame:
    """(key, dl, term, tf): of every document its length in words and, as arrays, the numbers of the words it holds with their counts. One scan, no shuffle."""
    sent = corpus.sparkSession.sparkContext.broadcast(words)

    def matched(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = pa.array(sent.value, pa.string())
        for b in steps(batches, 1024):
            tokens = b.column("t")
            size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            at = pc.index_in(tokens.flatten(), value_set=asked)
            held = pc.is_valid(at).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)[held]
            code, tf = np.unique(row * max(1, len(asked)) + at.drop_null().to_numpy(), return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code // max(1, len(asked)), minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code % max(1, len(asked)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(size, pa.int32()), *lists], [key, "dl", "term", "tf"])

    kind = corpus.schema[key].dataType.simpleString()
    return corpus.select(key, tx.tokens(F.col(text)).alias("t")).mapInArrow(matched, f"`{key}` {kind}, dl int, term array<int>, tf array<int>")


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def document_frequencies(corpus: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, df, idf) over a corpus."""
    df = corpus.select(F.explode(F.array_distinct(tx.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(corpus_stats(corpus, text))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def query_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, times): repeated words count repeatedly."""
    return queries.select(key, F.explode(tx.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(corpus: DataFrame, queries: DataFrame, *, doc: str, query: str, top: int = 30, k1: float = 1.5, b: float = 0.75, text: str = "text") -> DataFrame:
    """(query, doc, score, rank) of the best `top` documents with a positive score. Scores are rounded to 6 places, ties by doc.

    Queries come in tiles of bounded size. The corpus is tokenised once for each and its postings of the tile's words are
    written, a row for each document; a task scores its documents where they lie and passes on at most `top` for each query,
    so no pair of a query and a document is shuffled. Rows that share an id are merged by grouping.
    """
    out = None
    for tile in tiles(query_terms(queries, query, text), query):
        part = _tile(corpus, queries, tile, doc, query, top, k1, b, text)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.select(query).limit(0).crossJoin(corpus.select(doc).limit(0)).withColumn("score", F.lit(0.0))
    return ranked(out, query, doc, top)


def tiles(terms: DataFrame, query: str) -> Iterator[list]:
    """Rows (query, terms: a list of term and times), at most TILE of them at a time."""
    asked, after = terms.groupBy(query).agg(F.collect_list(F.struct("term", "times")).alias("terms")), None
    while True:
        tile = (asked if after is None else asked.where(F.col(query) > after)).orderBy(query).limit(TILE).collect()
        if tile:
            yield tile
        if len(tile) < TILE:
            return
        after = tile[-1][0]


def words_of(tile: list) -> list[str]:
    return sorted({t.term for r in tile for t in r.terms})


def _tile(corpus: DataFrame, queries: DataFrame, tile: list, doc: str, query: str, top: int, k1: float, b: float, text: str) -> DataFrame:
    words = words_of(tile)
    held = written(postings(corpus, words, doc, text))
    n, avg_dl = held.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    twice = repeated(held, doc)
    single, merged = unshared(held, twice, doc), shared(held, twice, doc)
    seen = single.select(F.explode("term").alias("term"))
    df = dict((r[0], r[1]) for r in (seen if merged is None else seen.unionByName(merged.select("term"))).groupBy("term").count().collect())  # at most a tile's words
    weight = weights(n, [df.get(k, 0) for k in range(len(words))])
    return scored_postings(single, merged, queries, tile, weight, avg_dl, doc=doc, query=query, top=top, k1=k1, b=b)


def weights(n: int, df: list[int]) -> list[float]:
    """idf of each word, as `idf` has it."""
    import math

    return [math.log(1.0 + (n - x + 0.5) / (x + 0.5)) for x in df]


def repeated(held: DataFrame, doc: str) -> DataFrame | None:
    """(_twice) of the ids that several rows share; None where there are none."""
    twice = held.groupBy(doc).count().where("count > 1").select(F.col(doc).alias("_twice"))
    return None if twice.isEmpty() else bounded(twice)


def unshared(held: DataFrame, twice: DataFrame | None, doc: str) -> DataFrame:
    """The rows whose id stands in one row."""
    return held if twice is None else held.join(twice, F.col(doc).eqNullSafe(F.col("_twice")), "left_anti")


def shared(held: DataFrame, twice: DataFrame | None, doc: str) -> DataFrame | None:
    """(doc, dl, term, tf) of the ids that several rows share, merged and written; None where there are none."""
    if twice is None:
        return None
    each = held.join(twice, F.col(doc).eqNullSafe(F.col("_twice")), "left_semi").select(doc, "dl", F.explode(F.arrays_zip("term", "tf")).alias("x"))
    return written(each.groupBy(doc, "dl", F.col("x.term").alias("term")).agg(F.sum("x.tf").alias("tf")))


def scored_postings(
    single: DataFrame, merged: DataFrame | None, queries: DataFrame, tile: list, weight: list[float], avg_dl: float, *, doc: str, query: str, top: int, k1: float, b: float,
    numbered: Callable[[Iterator], Iterator] = iter,
) -> DataFrame:
    """(query, doc, score): of each task's postings the `top` best of each query, and all merged documents. Terms are numbers of the tile's words, or `numbered` makes them so."""
    spark = single.sparkSession
    number = {w: k for k, w in enumerate(words_of(tile))}
    uses = sorted((number[t.term], k, t.times) for k, r in enumerate(tile) for t in r.terms)
    sent = spark.sparkContext.broadcast(([r[0] for r in tile], weight, uses))
    id_type, step = arrow_type(queries, query), PAIRS

    def scored(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, idfs, pairs = sent.value
        idfs, (word, who, times) = np.array(idfs), np.array(pairs, "i8").reshape(-1, 3).T
        first, many = np.searchsorted(word, np.arange(len(idfs))), np.bincount(word, minlength=len(idfs))
        best = Best(len(ids), top)
        for batch in steps(numbered(batches)):
            size = pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False)
            row, term = np.repeat(np.arange(len(size)), size), batch.column("term").flatten().to_numpy()
            tf, dl = batch.column("tf").flatten().to_numpy().astype(float), batch.column("dl").to_numpy()[row]
            part = idfs[term] * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * (dl / avg_dl)))
            work = np.cumsum(np.bincount(row, weights=many[term], minlength=len(size)))
            lo = 0
            while lo < len(size):  # as many documents as make about `step` products, one at least
                hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + step, "right")))
                z = slice(*np.searchsorted(row, [lo, hi]))
                count = many[term[z]]
                at = np.repeat(first[term[z]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                cell = np.repeat(row[z] - lo, count) * len(ids) + who[at]
                s = np.bincount(cell, weights=np.repeat(part[z], count) * times[at], minlength=(hi - lo) * len(ids)).reshape(hi - lo, len(ids))
                best.add(rounded(s, 6), batch.column(doc).slice(lo, hi - lo), least=0.0)
                lo = hi
        yield from best.batches(pa.array(ids, id_type), [query, doc, "score"])

    out = single.mapInArrow(scored, f"`{query}` {dict(queries.dtypes)[query]}, `{doc}` {dict(single.dtypes)[doc]}, score double")
    if merged is None:
        return out
    use = spark.createDataFrame([(w, tile[k][0], m, weight[w]) for w, k, m in uses], f"term int, `{query}` {dict(queries.dtypes)[query]}, times long, idf double")
    tf, dl = F.col("tf").cast("double"), F.col("dl")
    part = F.col("idf") * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * (dl / avg_dl)))
    more = merged.join(bounded(use), "term").groupBy(query, doc).agg(F.round(F.sum(F.col("times") * part), 6).alias("score"))
    return out.unionByName(more.where("score > 0"))


def ranked(scored: DataFrame, query: str, doc: str, top: int | None, score: str = "score") -> DataFrame:
    """rank from 1 by descending score, ties by doc; the first `top` only."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), doc)))
    return out.where(F.col("rank") <= top) if top else out


def search_terms(queries: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term_no, term): the whole phrase when it has at most four words, then the first three longer words."""
    clean = F.lower(F.trim(F.col(text)))
    short = F.size(F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) > 0)) <= 4
    longer = F.filter(tx.tokens(clean), lambda w: (F.length(w) >= 4) & ~w.isin(*tx.STOP_KEYWORD))
    terms = F.concat(F.when(short, F.array(clean)).otherwise(F.array().cast("array<string>")), F.slice(longer, 1, 3))
    return queries.select(key, F.posexplode(terms).alias("term_no", "term"))


def keyword_search(corpus: DataFrame, queries: DataFrame, *, doc: str, query: str, top: int = 4, text: str = "text") -> DataFrame:
    """(query, doc, score, rank): per term the first `top` documents in store order that hold it; first term wins; at most `top`."""
    terms = search_terms(queries, query, text)
    lower = corpus.select(doc, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    hits = containing(lower, terms.select("term").distinct(), key=doc, low="low", term="term")
    first = hits.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(doc))).where(F.col("n") <= top)
    found = terms.join(first, "term").groupBy(query, doc).agg(F.min("term_no").alias("term_no"))
    order = Window.partitionBy(query).orderBy("term_no", doc)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(query, doc, F.lit(0.75).alias("score"), "rank")
