"""Order-preserving packing (operator 5).

Each input partition is a stream of ids in row order. A window is a run of the stream of at most `window` ids. Cuts may
fall between documents (free), after a sentence (SENTENCE penalty) or, inside long unbroken runs, every HARD_STEP ids
(HARD penalty). A window costs its padding, ``window - length``, or nothing where its length is a power of two, plus
the penalty of the cut that ends it. With p the place of a cut and f its least total,

    f(j) = penalty(j) + min( min over i with p(j) - p(i) <= window of f(i) + p(i), plus window - p(j);
                             f(i) for p(i) = p(j) - 2^k )

The inner minimum slides forward, so a monotone queue holds it and every cut enters and leaves the queue once.
Partitions pack on their own: no shuffle, and one short tail each, which is itself cut by the same rule.

Defined cases: null text counts as empty, a document then has the end id alone; documents longer than a window span
several; rows that repeat a doc_id, and rows whose doc_id is null, are documents of their own, packed as they come; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, text_bytes, tokenizer_path, trim, trim_sometimes, word_ids

WINDOW, SENTENCE, HARD, HARD_STEP = 4096, 8, 64, 256
#: Ids of a partition that are packed at a time; its last, unfinished window is carried into the next stretch.
STRETCH = 500_000
#: Rows of an Arrow batch that are taken out of it at a time.
ROWS = 1000
#: Words and units that a worker's caches hold here, where windows need memory too.
CACHED = (20_000, 300_000)

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Ends of the windows of least total cost.

    places: ascending cuts above 0, none more than `window` after the one before; the last ends the stream.
    """
    import numpy as np

    spots = np.r_[0, np.asarray(places, "i8")]
    many = len(spots)
    index = np.full(int(spots[-1]) + 1, -1, "i8")
    index[spots] = np.arange(many)
    # Cuts a power of two before each cut, in one go: most powers have none, and the loop below sees the others only.
    found = []
    for d in (1 << k for k in range(window.bit_length()) if 1 << k < window):
        j = np.arange(np.searchsorted(spots, d), many)
        i = index[spots[j] - d]
        found.append(np.column_stack([j, i])[i >= 0])
    hits = np.concatenate(found) if found else np.zeros((0, 2), "i8")
    hits = hits[np.argsort(hits[:, 0], kind="stable")]
    upto = np.searchsorted(hits[:, 0], np.arange(many), "right").tolist()
    before, at = hits[:, 1].tolist(), spots.tolist()

    cost, came = [0] * many, [0] * many
    value, where, head, used = [0], [0], 0, 0  # the queue: f + p, rising, and the cut; it begins at head
    for j in range(1, many):
        p = at[j]
        low = p - window
        while at[where[head]] < low:
            head += 1
        best, back = value[head] + window - p, where[head]
        stop = upto[j]
        while used < stop:
            i = before[used]
            used += 1
            if cost[i] < best:
                best, back = cost[i], i
        best += penalties[j - 1]
        cost[j], came[j] = best, back
        best += p
        while len(value) > head and value[-1] >= best:
            value.pop()
            where.pop()
        value.append(best)
        where.append(j)
    ends, j = [], many - 1
    while j:
        ends.append(at[j])
        j = came[j]
    return ends[::-1]


def _cuts(segments: list[tuple], window: int) -> tuple[list[int], list[int]]:
    """Places and penalties of the cuts that the segments' boundaries, sentences and long runs allow."""
    import numpy as np

    places, penalties, base = [], [], 0
    step = min(HARD_STEP, window)
    for _, start, total, ids, ends in segments:
        n = len(ids) // 4
        inner = ends[(ends > start) & (ends < start + n)] - start
        marks = np.r_[0, inner, n]
        gaps = np.diff(marks)
        hard = [np.arange(a + step, b, step) for a, b in zip(marks[:-1][gaps > step], marks[1:][gaps > step], strict=True)]
        hard = np.concatenate(hard) if hard else np.empty(0, "i8")
        own = np.r_[inner, hard, n].astype("i8")
        cost = np.r_[np.full(len(inner), SENTENCE), np.full(len(hard), HARD), 0 if start + n == total else HARD]
        order = np.argsort(own, kind="stable")
        places += (own[order] + base).tolist()
        penalties += cost[order].tolist()
        base += n
    return places, penalties


def _windows(segments: list[tuple], final: bool, window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows as lists of pieces (doc_id, start, doc_tokens, ids), and the segments left for the next stretch."""
    ends = best_cuts(*_cuts(segments, window), window)
    if not final:
        ends.pop()
    out, k, used = [], 0, 0  # segment k, ids of it that are used
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        need, pieces = b - a, []
        while need:
            doc, start, total, ids, _ = segments[k]
            take = min(need, len(ids) // 4 - used)
            pieces.append((doc, start + used, total, ids[4 * used : 4 * (used + take)]))
            need, used = need - take, used + take
            if used == len(ids) // 4:
                k, used = k + 1, 0
        out.append(pieces)
    rest = segments[k:]
    if rest and used:
        doc, start, total, ids, ends_ = rest[0]
        rest[0] = (doc, start + used, total, ids[4 * used :], ends_)
    return out, rest


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """Pieces of packed sequences with their ids. sequence_id is partition * 2^36 + the window's number there."""
    tokenizer = tokenizer or tokenizer_path()

    def packed(batches: Iterator) -> Iterator:
        import re

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words, end = word_ids(tokenizer), end_id.to_bytes(4, "little")
        words.most, words.most_known = CACHED
        vocab = words.tokenizer.get_vocab()
        closing = np.zeros(max(vocab.values()) + 2, bool)
        closing[[i for t, i in vocab.items() if re.fullmatch(r"""[.!?]+["')\]]*(</w>)?""", t)]] = True
        del vocab
        first, made = TaskContext.get().partitionId() << 36, 0
        segments, size = [], 0

        kinds = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECES.split(", ")])

        def rows(final: bool) -> Iterator:
            nonlocal segments, size, made
            windows, segments = _windows(segments, final, window)
            size = sum(len(s[3]) // 4 for s in segments)
            for lo in range(0, len(windows), 200):
                out = []
                for pieces in windows[lo : lo + 200]:
                    offset = 0
                    for doc, start, total, ids in pieces:
                        out.append((doc, start, len(ids) // 4, total, first + made, offset, ids))
                        offset += len(ids) // 4
                    made += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        trim()  # what an earlier stage left in this worker
        for b in (whole.slice(k, ROWS) for whole in batches for k in range(0, len(whole), ROWS)):
            doc_ids = b.column("doc_id").to_pylist()
            for lo, hi, all_ids, bounds, word_ends in words.stream(b.column("body").to_pylist(), 250_000):
                word_ends = word_ends[np.diff(word_ends, prepend=0) > 0]  # a unit may have no ids
                all_stops = word_ends[closing[np.minimum(all_ids[word_ends - 1], len(closing) - 1)]]
                cut = np.searchsorted(all_stops, bounds, "right")
                at = k = 0
                for doc, to, stop in zip(doc_ids[lo:hi], bounds.tolist(), cut.tolist(), strict=True):
                    ids = all_ids[at:to].astype("<u4").tobytes() + end
                    segments.append((doc, 0, len(ids) // 4, ids, all_stops[k:stop] - at))
                    size += len(ids) // 4
                    at, k = to, stop
                    if size >= STRETCH:
                        yield from rows(False)
                        trim_sometimes(4)
        if segments:
            yield from rows(True)
        segments = None
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(packed, PIECES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents; one row per piece, with the checksum of its ids."""
    return digest(pack(table(spark, sf_dir, "documents")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
