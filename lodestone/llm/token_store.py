"""Token-ID / binary output (operator 1).

File format ("frames"): a Parquet container whose rows are blocks of documents in ascending doc_id order. A block has

* ``payload``: one zstandard frame per document, compressed on its own with the shared dictionary,
* ``doc_ids``, ``ends``, ``counts``: little-endian int64 arrays, one entry per document, and ``missing``, a byte for each
  that is 1 where the doc_id is null (its entry is 0 then); a document's frame is
  ``payload[ends[k-1]:ends[k]]``, so a short document is opened by reading one block's index and one frame,
* ``first_doc``, ``last_doc``: bounds of the ids that aren't null, which Parquet statistics prune by,
* ``shard``, ``block``, ``shard_start``: place in the corpus, and ids of the shard before this block,
* ``dict_sha256``, ``width``: the dictionary's hash, and the bytes of a serialized id (2 or 4, little-endian).

The dictionary lies beside the blocks as a one-row table. It is trained on at most DICT_DOCS documents (lowest
xxhash64(doc_id)), each cut to DICT_BYTES serialized bytes: a bounded model fit that affects size, never content.

Defined cases: null text counts as empty; an empty document has the end id alone; repeated doc_ids are kept, ordered
by their frames; rows whose doc_id is null come last, ordered likewise; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded, materialise, table, text_bytes, tokenizer_path, word_ids, work_dir

DICT_DOCS, DICT_BYTES, DICT_SIZE, LEVEL, BLOCK_BYTES = 2000, 4096, 64 * 1024, 3, 4 << 20

BLOCKS = (
    "shard long, block long, first_doc long, last_doc long, n_docs long, shard_start long, n_tokens long, width int, "
    "dict_sha256 string, doc_ids binary, missing binary, ends binary, counts binary, payload binary"
)


def _narrow(ids: bytes, width: int) -> bytes:
    import numpy as np

    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """Shared zstandard dictionary; empty when the sample is too small to train on."""
    import zstandard

    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICT_DOCS).collect()]
    if not chosen:
        return b""

    def serialized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "s": [_narrow(words.batch([x[: 4 * DICT_BYTES]])[0].tobytes(), width)[:DICT_BYTES] for x in b.body]})

    rows = docs.where(F.col("doc_id").isin(chosen)).select("doc_id", text_bytes()).mapInPandas(serialized, "doc_id long, s binary").collect()
    samples = [bytes(r.s) + end_id.to_bytes(width, "little") for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.s)))]
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


def write_store(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 1) -> None:
    """Encode every document and write the store at path."""
    import json

    tokenizer, spark = tokenizer or tokenizer_path(), docs.sparkSession
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shared = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(shared).hexdigest()
    meta = json.dumps({"tokenizer": tokenizer.rsplit("/", 1)[-1], "end_id": end_id, "width": width})
    spark.createDataFrame([(digest, bytearray(shared), meta)], "dict_sha256 string, dictionary binary, meta string").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(shared)

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        words, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
        d = zstandard.ZstdCompressionDict(held.value) if held.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=True)
        for b in batches:
            for lo, hi, ids, bounds, _ in words.stream(b.column("body").to_pylist()):
                parts = [x.astype("<u4").tobytes() + end for x in np.split(ids, bounds[:-1])]
                frames = [press.compress(_narrow(x, width)) for x in parts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    def blocks(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCKS.split(", ")])

        at, start, rows, size = 0, 0, [], 0

        def out():
            nonlocal at, start, rows, size
            part, n = rows[0][0], [r[2] for r in rows]
            le = lambda x: np.asarray(x, "<i8").tobytes()
            known = [r[1] for r in rows if r[1] is not None]
            row = (part, at, known[0] if known else None, known[-1] if known else None, len(rows), start, sum(n), width, digest, le([r[1] or 0 for r in rows]), bytes(r[1] is None for r in rows), le(np.cumsum([len(r[3]) for r in rows])), le(n), b"".join(r[3] for r in rows))
            at, start, rows, size = at + 1, start + sum(n), [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k.type) for x, k in zip(row, kinds, strict=True)], schema=kinds)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "n", "frame")), strict=True):
                rows.append(r)
                size += len(r[3])
                if size >= BLOCK_BYTES:
                    yield out()
        if rows:
            yield out()

    # Written first: finding the range bounds reads the rows once more, and would encode every text again.
    frames = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(encode, "doc_id long, n long, frame binary"))
    (
        frames.repartitionByRange(F.asc_nulls_last("doc_id"), F.xxhash64("frame")).sortWithinPartitions(F.asc_nulls_last("doc_id"), F.xxhash64("frame"), "frame")
        .select(F.spark_partition_id().cast("long").alias("shard"), "doc_id", "n", "frame")
        .mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    )


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from the files; doc_ids opens those documents' frames only."""
    blocks = spark.read.parquet(f"{path}/blocks")
    first = spark.read.parquet(f"{path}/dictionary").head()
    held, width_of = spark.sparkContext.broadcast((bytes(first.dictionary), first.dict_sha256)), {2: "<u2", 4: "<u4"}
    # One number per shard; shards are output files, so this stays a small table.
    total, base = 0, []
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").toLocalIterator():
        base.append((r.shard, total))
        total += r.n
    starts = spark.createDataFrame(base, "shard long, base long")
    if doc_ids is not None:
        want = set(doc_ids)
        blocks = blocks.where((F.col("last_doc") >= min(want, default=0)) & (F.col("first_doc") <= max(want, default=-1)))
    else:
        want = None

    def opened(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        raw, digest = held.value
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        for b in batches:
            for r in b.to_pylist():
                if r["dict_sha256"] != digest:
                    raise ValueError(f"block {r['shard']}/{r['block']} was written with another dictionary")
                ids, ends, counts = (np.frombuffer(r[c], "<i8") for c in ("doc_ids", "ends", "counts"))
                missing, payload, kind = np.frombuffer(r["missing"], "u1").astype(bool), r["payload"], width_of[r["width"]]
                starts_, begins = r["base"] + r["shard_start"] + np.cumsum(counts) - counts, np.r_[0, ends[:-1]]
                pick = range(len(ids)) if want is None else [k for k, x in enumerate(ids.tolist()) if x in want and not missing[k]]
                for lo in range(0, len(pick), 512):
                    ks = list(pick[lo : lo + 512])
                    texts = [np.frombuffer(open_.decompress(payload[begins[k] : ends[k]]), kind).astype("<u4").tobytes() for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[ks], mask=missing[ks]), pa.array(starts_[ks]), pa.array(counts[ks]), pa.array(texts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(bounded(starts, len(base)), "shard").mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the store for all documents, read it back, and give each document's place, length and checksum."""
    path = work_dir(spark)
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_token_store": op1_token_store}
ORACLES: dict[str, str] = {}
