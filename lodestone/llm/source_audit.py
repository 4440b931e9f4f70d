"""Source divergence audit by sorting and streaming (operator 13).

A document lies in one row, so runs of (lang, term, source, document) can be shortened where it is read: in each stretch of
documents term occurrences are sorted by term, source and document, and a scan over the runs gives each (lang, term,
source) its documents and occurrences. These partial runs, not the occurrences, are dealt out by (lang, term) and a salt,
sorted by (lang, term, source) and scanned again; a second deal, without the salt, joins what the salts kept apart. So a
word of every document reaches a task as SALTS rows for each source, however large the table is.

The terms that a language keeps are written with their counts. A last scan over them gives, for each run of a term, the
shares of all sources of its language, adds up the divergence of every pair of sources, and passes on each group's best
TOP terms; what leaves a task is a partial sum for each pair and TOP terms for each group. Counts, sums and shares are
integers of any size; nothing is a float.

Work of the last scan is terms times pairs of sources, as the sums are over each of them; a language's list of sources lies
with each of its terms, so it should fit in memory many times. A document is cut in one task, which takes about ten bytes
of memory for each byte of the longest text.

Defined cases: null text, lang and source count as ''; each row is a document, whatever its doc_id; a language that keeps
no terms gives pairs of value 0; a language of one source gives no pairs; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, table, text_bytes

LEAST_DOCS, TOP, SCALE, SALTS = 10, 10, 1_000_000_000, 16
#: Bytes of text that are sorted at a time.
STRETCH = 8 << 20
#: Groups (lang, source) whose lists may be broadcast.
BROADCAST_GROUPS = 100_000

RUNS = "lang string, source string, term string, salt int, docs long, n long"
KEPT = "lang string, term string, docs long, sources array<string>, counts array<long>"
PARTS = "lang string, source string, part string, item string, value long"


def term_runs(body, ends, groups):
    """Runs of a stretch of documents: (terms, term of each run, group of each run, documents, occurrences), by term and group.

    body: the texts' bytes in a row (uint8). ends: where each text ends. groups: an integer for each text.
    """
    import numpy as np
    import pyarrow as pa

    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    small = np.arange(256, dtype="u1")
    small[65:91] += 32
    inside = letter[body]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = np.r_[0, ends[:-1]]
    heads = heads[heads < len(body)]
    opens[heads] = inside[heads]  # a term doesn't go on in the next text
    doc = np.searchsorted(ends, np.flatnonzero(opens), "right")
    offsets = np.r_[np.flatnonzero(opens[inside]), np.count_nonzero(inside)].astype("i4")
    terms = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(small[body[inside]])])
    named = terms.dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False).astype("i8")
    wide, many = int(groups.max(initial=0)) + 1, len(ends)
    key = (code * wide + groups[doc]) * many + doc
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])  # a run for each term and document
    times, pair = np.diff(np.r_[first, len(key)]), key[first] // many
    run = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    docs = np.diff(np.r_[run, len(pair)])
    return named.dictionary, pair[run] // wide, pair[run] % wide, docs, np.add.reduceat(times, run) if len(run) else times


def _document_runs(batches: Iterator, size: int, salts: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    stretch = TaskContext.get().partitionId()
    for b in batches:
        lang, source, body = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode(), b.column("body").cast(pa.binary())
        wide = len(source.dictionary)
        group = lang.indices.to_numpy(zero_copy_only=False).astype("i8") * wide + source.indices.to_numpy(zero_copy_only=False)
        at = np.frombuffer(body.buffers()[1], "i4")[body.offset : body.offset + len(body) + 1].astype("i8")
        data = np.frombuffer(body.buffers()[2] or b"", "u1")
        lo = 0
        while lo < len(body):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            terms, term, g, docs, n = term_runs(data[at[lo] : at[hi]], at[lo + 1 : hi + 1] - at[lo], group[lo:hi])
            salt = pa.array(np.full(len(term), stretch % salts, "i4"))
            cols = [lang.dictionary.take(pa.array(g // wide)), source.dictionary.take(pa.array(g % wide)), terms.take(pa.array(term)).cast(pa.string()), salt, pa.array(docs), pa.array(n)]
            out = pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "salt", "docs", "n"])
            for k in range(0, len(out), 50_000):
                yield out.slice(k, 50_000)
            lo, stretch = hi, stretch + 1


def run_lengths(batches: Iterator, keys: tuple[str, ...], sums: tuple[str, ...]) -> Iterator:
    """A sorted stream with each run of equal keys as one row that holds its sums. The last run of a batch waits for the next."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names, held = [*keys, *sums], None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(c) for c in names]
        if held is not None:
            cols = [pa.concat_arrays([h, c]) for h, c in zip(held, cols, strict=True)]
        opens = np.ones(len(cols[0]), bool)
        opens[1:] = False
        for c in cols[: len(keys)]:
            opens[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(opens)
        done = [c.take(pa.array(first)) for c in cols[: len(keys)]] + [pa.array(np.add.reduceat(c.to_numpy(zero_copy_only=False), first)) for c in cols[len(keys) :]]
        held = [c[-1:] for c in done]
        yield pa.RecordBatch.from_arrays([c[:-1] for c in done], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays(held, names)


def _kept_terms(batches: Iterator, least: int) -> Iterator:
    """Rows (lang, term, source, docs, n), sorted, to one row for each term of at least `least` documents."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for b in batches:
        if held is not None:
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([held.column(k), b.column(k)]) for k in range(5)], b.schema.names)
        if not len(b):
            continue
        lang, term = b.column("lang"), b.column("term")
        opens = np.ones(len(b), bool)
        opens[1:] = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(opens)
        held = b.slice(first[-1])
        yield _lists(b.slice(0, first[-1]), first[:-1], least)
    if held is not None:
        yield _lists(held, np.zeros(1, "i8"), least)


def _lists(b, first, least: int):
    import numpy as np
    import pyarrow as pa

    ends = np.r_[first[1:], len(b)] if len(first) else first
    docs = np.add.reduceat(b.column("docs").to_numpy(zero_copy_only=False), first) if len(first) else first
    stay = docs >= least
    rows = np.repeat(stay, ends - first)
    inner, size = b.filter(pa.array(rows)), (ends - first)[stay]
    offsets = pa.array(np.r_[0, np.cumsum(size)].astype("i4"))
    at = pa.array(first[stay])
    lists = [pa.ListArray.from_arrays(offsets, inner.column(c)) for c in ("source", "n")]
    return pa.RecordBatch.from_arrays([b.column("lang").take(at), b.column("term").take(at), pa.array(docs[stay]), *lists], ["lang", "term", "docs", "sources", "counts"])


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, stretch: int = STRETCH, salts: int = SALTS) -> DataFrame:
    """lang, term, docs, sources, counts of the terms that stand in at least `least` documents of their language."""
    keys, sums = ("lang", "term", "source"), ("docs", "n")
    runs = docs.select(_blank("lang"), _blank("source"), text_bytes()).mapInArrow(lambda b: _document_runs(b, stretch, salts), RUNS)
    runs = runs.repartition("lang", "term", "salt").sortWithinPartitions(*keys)
    runs = runs.mapInArrow(lambda b: run_lengths(b, keys, sums), "lang string, term string, source string, docs long, n long")
    runs = runs.repartition("lang", "term").sortWithinPartitions(*keys)
    return runs.mapInArrow(lambda b: _kept_terms(run_lengths(b, keys, sums), least), KEPT)


def _blank(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def shares(counts, n, terms: int):
    """1 + floor(SCALE * (count + 2) / (n + 2 * terms)), as integers; n broadcasts against counts."""
    import numpy as np

    if max(counts.max(initial=0), np.max(n, initial=0)) >= 2**62 // SCALE:  # beyond 64 bits: Python's integers
        counts, n = counts.astype(object), np.asarray(n).astype(object)
    return (1 + SCALE * (counts + 2) // (n + 2 * terms)).astype("i8")


def divergence(p, q):
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits in 64 bits."""
    return (p - q) ** 2 // (p + q)


def _scan(batches: Iterator, top: int) -> Iterator[pd.DataFrame]:
    """Kept terms with their language's sources to partial sums of pairs, and each group's best terms of this task."""
    import numpy as np

    sums: dict[str, tuple] = {}  # lang -> its sources, and the sum of each pair of them
    best = pd.DataFrame({"lang": [], "source": [], "item": [], "value": []}).astype({"value": "i8"})
    for b in batches:
        fresh = [best]
        for lang, rows in b.groupby("lang", sort=False):
            names, sizes, terms = list(rows["names"].iloc[0]), np.array(rows["sizes"].iloc[0], "i8"), int(rows["terms"].iloc[0])
            place = {s: k for k, s in enumerate(names)}
            if lang not in sums:
                sums[lang] = (names, np.zeros((len(names), len(names)), "i8"))
            total = sums[lang][1]
            step = max(1, (1 << 20) // len(names))
            for lo in range(0, len(rows), step):
                part = rows.iloc[lo : lo + step]
                counts = np.zeros((len(part), len(names)), "i8")
                for k, (s, c) in enumerate(zip(part.sources, part.counts, strict=True)):
                    counts[k, [place[x] for x in s]] = c
                p, q = shares(counts, sizes, terms), shares(counts.sum(axis=1), sizes.sum(), terms)[:, None]
                for k in range(len(names) - 1):
                    total[k, k + 1 :] += divergence(p[:, k : k + 1], p[:, k + 1 :]).sum(axis=0)
                value = np.where((counts > 0) & (p > q), divergence(p, q), -1)
                i, j = np.nonzero(value >= 0)
                fresh.append(pd.DataFrame({"lang": lang, "source": np.array(names, object)[j], "item": part.term.to_numpy()[i], "value": value[i, j]}))
        best = pd.concat(fresh)
        best = best.sort_values(["lang", "source", "value", "item"], ascending=[True, True, False, True])
        best = best[best.groupby(["lang", "source"]).cumcount() < top]
    yield best.assign(part="term")[["lang", "source", "part", "item", "value"]]
    for lang, (names, total) in sums.items():
        for k in range(len(names) - 1):  # both directions of a pair have one value
            other = pd.DataFrame({"lang": lang, "source": names[k], "part": "pair", "item": names[k + 1 :], "value": total[k, k + 1 :]})
            yield pd.concat([other, other.rename(columns={"source": "item", "item": "source"})[other.columns]])


def audit(docs: DataFrame, *, least: int = LEAST_DOCS, top: int = TOP, stretch: int = STRETCH, salts: int = SALTS) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others of its language, and its most telling terms."""
    kept = materialise(kept_terms(docs, least, stretch, salts))
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = docs.select(_blank("lang"), _blank("source")).distinct().join(counted, ["lang", "source"], "left")
    groups = materialise(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    many = groups.count()
    listed = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("l")).select("lang", F.col("l.source").alias("names"), F.col("l.n").alias("sizes"))
    listed = listed.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang")
    parts = kept.select("lang", "term", "sources", "counts").join(bounded(listed, many, BROADCAST_GROUPS), "lang").mapInPandas(lambda b: _scan(b, top), PARTS)
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    # languages that keep no terms still have their pairs
    empty = groups.join(kept.select("lang").distinct(), "lang", "left_anti").select("lang", "source")
    others = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    parts = parts.unionByName(others)
    order = "row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)"
    return parts.withColumn("rank", F.expr(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence between the sources of each language over all documents."""
    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_source_audit": op13_source_audit}
ORACLES = {
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT lang, source, r, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
cn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
        1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2)::HUGEINT // (coalesce(total, 0) + 2 * v)::HUGEINT AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN cn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // ((SELECT sum(total) FROM cn WHERE cn.lang = f.lang) + 2 * (SELECT v FROM v WHERE v.lang = f.lang))::HUGEINT AS q FROM f GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
            ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM f JOIN l USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
}
