"""Mixing sources to target weights (operator 9): a multivariate-hypergeometric splitting tree.

A source's documents, in an order given by a hash, form one stream of words, cut into blocks of BLOCK_WORDS words. The mix
takes target words of a source as whole epochs of its blocks plus a part of one more; each epoch has its own keyed
permutation of the blocks (a Feistel network, so a block's rank is computed, not sorted for), and the last block taken is
cut at the exact word. The drawn blocks are the source's quota. A tree splits all quotas among output shards: each node
deals its blocks to its two halves by a multivariate hypergeometric draw, so quotas stay exact at every level and the
leaves get disjoint runs of the permuted blocks. A shard draws the blocks of its leaf, and nothing else is drawn; within it a
hash of block and document shuffles.

Sources may be many: they stay a table. The tree splits the quotas of BUCKET sources at a time on the driver (a row for each
bucket), and each bucket's shares among its sources in a task; by the grouping property that is the same distribution.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...; they share all words, a target stops at
MOST times its source's words, and the excess is shared by weight among the others until none is above.

Streams need running sums over documents; these go over two levels of hashed buckets, so no task sees a whole source.

Defined cases: null text has size 0 and is never taken; null is a source of its own; rows that repeat a doc_id, and rows
whose doc_id is null, count as documents of their own (one result row each), ordered by their texts; an empty table gives no
rows; a source without words has target 0; other columns are ignored by draws() and kept by mixed().
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, table

WEIGHTS, MOST, BLOCK_WORDS, SHARDS, SEED = (5.0, 2.0, 1.0), 3, 8192, 16, 20_240_501
BUCKETS, GROUP = 1 << 18, 1 << 9
#: Sources whose quotas one task splits, and how many sources a broadcast may hold.
BUCKET, BROADCAST_SOURCES = 4096, 100_000
#: numpy draws from fewer items than this; larger draws use the rejection below.
MOST_ITEMS = 10**9
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (skey, words, place) with their target by the rule above: most times the words, or weight times the share that is left for a unit of weight."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    share, capped = None, F.lit(False)
    while True:
        t = rows.agg(F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum("words").alias("all"), F.sum(F.when(capped, F.col("words"))).alias("full")).head()
        left = float((t["all"] or 0) - most * (t["full"] or 0))
        now = max(left, 0.0) / t.w if t.w else 0.0
        if now == share:
            break
        share = now  # it only rises, so a source that is above once stays so
        capped = F.lit(share) * F.col("weight") > most * F.col("words")
    return rows.withColumn("target", F.when(capped, (most * F.col("words")).cast("double")).otherwise(F.lit(share) * F.col("weight"))).drop("weight")


def _rise(a: float, d: float) -> float:
    """log((a + d)!) - log(a!) for a + d >= 0, without the loss of digits that two large terms would bring."""
    if min(a, a + d) < 1e6:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    x, y = a + 1, a + d + 1
    return (x - 0.5) * math.log1p(d / x) + d * (math.log(y) - 1) + (1 / y - 1 / x) / 12


def hypergeometric(rng, good: int, bad: int, draw: int) -> int:
    """How many of `draw` items taken from good and bad ones are good: exact at any size (ratio of uniforms, by Stadlober)."""
    if good + bad < MOST_ITEMS:
        return int(rng.hypergeometric(good, bad, draw))
    least, most_, total = max(0, draw - bad), min(draw, good), good + bad
    if least == most_:
        return least
    mean = draw * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - draw) / max(total - 1, 1)) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    mode = min(max((draw + 1) * (good + 1) // (total + 2), least), most_)
    while True:
        u = 1.0 - rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if least <= k <= most_:
            d = k - mode
            gain = -_rise(mode, d) - _rise(good - mode, -d) - _rise(draw - mode, -d) - _rise(bad - draw + mode, d)
            if 2 * math.log(u) <= gain:
                return k


def split_quotas(quotas, shards: int, seed: int = SEED, sums=None):
    """Blocks of each source in each shard: array (shards, sources) whose columns sum to the quotas.

    A shard's row sums to its part of the whole, even to one block, or to sums[shard] where those are given.
    """
    import numpy as np

    out = np.zeros((shards, len(quotas)), "i8")

    def deal(have, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        take = total * (mid - lo) // (hi - lo) if sums is None else int(sum(sums[lo:mid]))
        rng = np.random.default_rng([seed, lo, hi])
        if total < MOST_ITEMS:
            left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        else:  # source by source: the draw of one, given those before it
            left, rest, wanted = np.zeros_like(have), total, take
            for k, n in enumerate(have.tolist()):
                rest -= n
                left[k] = hypergeometric(rng, n, rest, wanted)
                wanted -= int(left[k])
        deal(left, lo, mid)
        deal(have - left, mid, hi)

    deal(np.asarray(quotas, "i8"), 0, shards)
    return out


def _mix(x):
    """64-bit finaliser on a NumPy array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rank_of(block, n: int, key: int):
    """Place of each block in a keyed permutation of range(n): four Feistel rounds, walked until inside the range."""
    import numpy as np

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), np.asarray(block).astype("u8")
    keys = _mix(np.arange(4, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = x >= n
    return x.astype("i8")


def _source_key(source: Column) -> Column:
    """Sources as text that tells null from the empty string; code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _in_order(sources: DataFrame) -> DataFrame:
    """sources with their place in the order of skey. The driver sees one count for each sorted partition."""
    part = F.shiftright("at", 33)
    rows = materialise(sources.repartitionByRange("skey").sortWithinPartitions("skey").withColumn("at", F.monotonically_increasing_id()))
    before, starts = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").toLocalIterator():
        starts.append((r.part, before - (r.part << 33)))
        before += r.n
    shifts = rows.sparkSession.createDataFrame(starts, "part long, shift long")
    return rows.withColumn("part", part).join(bounded(shifts, len(starts)), "part").select("skey", "words", (F.col("at") + F.col("shift")).alias("place"))


def plan_sources(words: DataFrame, *, shards: int = SHARDS, block_words: int = BLOCK_WORDS, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """A row per source (skey, words): target, blocks, epochs, rest, key, and upto: the drawn blocks up to each shard's end, from the tree."""
    import numpy as np

    spark = words.sparkSession
    sources = targets(materialise(_in_order(words)), weights, most)

    def with_quota(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for skey, total, place, t in b[["skey", "words", "place", "target"]].itertuples(index=False):
                n, take = -(-total // block_words), min(round(t), most * total)
                epochs, rest = divmod(take, total) if total else (0, 0)
                key = int.from_bytes(hashlib.sha256(f"{seed}:{skey}".encode()).digest()[:7], "little")
                last = -(-rest // block_words)  # blocks of the part epoch; one more where the short block is among them and leaves words over
                if last and last * block_words - (n * block_words - total) * (int(rank_of(np.array([n - 1]), n, key + epochs)[0]) < last) < rest:
                    last += 1
                out.append((skey, total, place, t, n, epochs, rest, key, epochs * n + last))
            yield pd.DataFrame(out, columns=["skey", "words", "place", "target", "n", "epochs", "rest", "key", "quota"])

    plan = "skey string, words long, place long, target double, n long, epochs long, rest long, key long, quota long"
    planned = materialise(sources.mapInPandas(with_quota, plan).withColumn("bucket", F.floor(F.col("place") / BUCKET)))
    by_bucket = [(r.bucket, r.q) for r in planned.groupBy("bucket").agg(F.sum("quota").alias("q")).orderBy("bucket").toLocalIterator()]  # a row for every BUCKET sources
    split = split_quotas([q for _, q in by_bucket], shards, seed) if by_bucket else np.zeros((shards, 0), "i8")
    sums = spark.createDataFrame([(k, split[:, j].tolist()) for j, (k, _) in enumerate(by_bucket)], "bucket long, sums array<long>")

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        leaves = split_quotas(g.quota.to_numpy(), shards, seed ^ int(g.bucket.iloc[0]) + 1, list(g.sums.iloc[0]))
        return g.drop(columns=["sums", "bucket", "quota"]).assign(upto=list(np.cumsum(leaves, axis=0).T))

    joined = planned.join(bounded(sums, len(by_bucket)), "bucket")
    return joined.groupBy("bucket").applyInPandas(within, plan.replace(", quota long", ", upto array<long>"))


def draws(docs: DataFrame, *, row: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, draws). documents: row, doc_id, skey, size, source_size, target, start. draws: row, epoch, shard, word_from, word_to, place; words of the document from 0."""
    import numpy as np

    block_words, seed = options.get("block_words", BLOCK_WORDS), options.get("seed", SEED)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _source_key(F.col("source")).alias("skey"), size.alias("size"), F.xxhash64("text").alias("mark"))
    sized = materialise(sized.withColumn("b1", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(BUCKETS)).cast("int")))

    bucket = sized.groupBy("skey", "b1").agg(F.sum("size").alias("words")).withColumn("b2", (F.col("b1") / GROUP).cast("int"))
    inner = Window.partitionBy("skey", "b2").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    bucket = materialise(bucket.withColumn("before", F.coalesce(F.sum("words").over(inner), F.lit(0))))
    groups = bucket.groupBy("skey", "b2").agg(F.sum("words").alias("words"))
    outer = Window.partitionBy("skey").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("words").over(outer), F.lit(0))).select("skey", "b2", "base")
    offsets = bucket.join(groups, ["skey", "b2"]).select("skey", "b1", (F.col("base") + F.col("before")).alias("bucket_start"))
    within = Window.partitionBy("skey", "b1").orderBy("doc_id", "mark", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["skey", "b1"])
    placed = placed.select("row", "doc_id", "skey", "size", (F.col("bucket_start") + F.col("inside")).alias("start"))

    plan = materialise(plan_sources(bucket.groupBy("skey").agg(F.sum("words").alias("words")), **options))
    many = plan.count()
    info = plan.select("skey", F.col("words").alias("source_size"), "target")
    placed = materialise(placed.join(bounded(info, many, BROADCAST_SOURCES), "skey"))

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"row": "i8", "epoch": "i4", "shard": "i4", "word_from": "i8", "word_to": "i8", "place": "i8"}
        for b in batches:
            out = []
            for _, g in b.groupby("skey", sort=False):
                words, n, epochs, rest, key = (int(g[c].iloc[0]) for c in ("words", "n", "epochs", "rest", "key"))
                upto = g["upto"].iloc[0]
                start, size_, row = (g[c].to_numpy("i8") for c in ("start", "size", "row"))
                first, last = start // block_words, (start + size_ - 1) // block_words
                k = np.repeat(np.arange(len(g)), last - first + 1)
                block = np.arange(len(k)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[k]
                lo, hi = np.maximum(block * block_words, start[k]), np.minimum((block + 1) * block_words, (start + size_)[k])
                short = n * block_words - words  # words that the last block lacks
                for e in range(epochs + (rest > 0)):
                    rank = rank_of(block, n, key + e)
                    tail = int(rank_of(np.array([n - 1]), n, key + e)[0])
                    begins = rank * block_words - short * (rank > tail)  # words of this epoch before the block
                    end = hi if e < epochs else np.minimum(hi, block * block_words + np.maximum(rest - begins, 0))
                    number = e * n + rank
                    shard = np.searchsorted(upto, number, "right")
                    keep = (end > lo) & (shard < len(upto))  # a leaf of the tree draws it
                    place = _mix(row[k[keep]].astype("u8") ^ _mix(number[keep].astype("u8") + np.uint64(key)))
                    out.append(pd.DataFrame({"row": row[k[keep]], "epoch": e, "shard": shard[keep], "word_from": (lo - start[k])[keep], "word_to": (end - start[k])[keep], "place": (place >> np.uint64(1)).astype("i8")}))
            yield pd.concat(out).astype(kinds) if out else pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})

    each = placed.where("size > 0").select("row", "skey", "size", "start").join(bounded(plan.select("skey", "words", "n", "epochs", "rest", "key", "upto"), many, BROADCAST_SOURCES), "skey")
    return placed, each.mapInPandas(drawn, "row long, epoch int, shard int, word_from long, word_to long, place long")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: docs' columns, a row for each document, shard and epoch that draws it, shard by shard, in random order within each.

    text holds the taken words; a document taken whole keeps its text unchanged. n_chars, where present, follows the text.
    """
    # monotonically_increasing_id numbers the rows of the same scan alike, so the text meets its draws without another key.
    base = materialise(docs.select(*docs.columns, F.monotonically_increasing_id().alias("_mix_row")))
    placed, taken = draws(base, row="_mix_row", **options)
    spans = taken.groupBy(F.col("row").alias("_mix_row"), "epoch", F.col("shard").alias("_mix_shard")).agg(F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("_mix_spans"), F.min("place").alias("_mix_place"), F.sum(F.col("word_to") - F.col("word_from")).alias("_mix_words")).drop("epoch")
    joined = base.join(spans, "_mix_row").join(placed.select(F.col("row").alias("_mix_row"), F.col("size").alias("_mix_size")), "_mix_row")
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("_mix_spans", lambda x: F.slice(words, x["word_from"].cast("int") + 1, (x["word_to"] - x["word_from"]).cast("int")))), "")
    out = joined.withColumn("text", F.when(F.col("_mix_words") == F.col("_mix_size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.repartitionByRange("_mix_shard", "_mix_place").sortWithinPartitions("_mix_shard", "_mix_place").select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, over the blocks that the shards draw; and the first of those shards."""
    placed, taken = draws(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sums = taken.groupBy("row").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"), F.min("shard").alias("first_shard"), F.countDistinct("shard").alias("n_shards"))
    return placed.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", F.coalesce("n_shards", F.lit(0)).alias("n_shards"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
