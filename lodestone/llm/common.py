"""Helpers shared by the training-data operators: tables, shared working folder, tokenizer cache."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast built from a counted table may have; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, always through Spark's reader (the path may be in a store that only Spark opens)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and Spark runs in one process (tests) a temporary folder is made for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


#: Rows of a batch between Spark and Python while a table is written; texts may be long, so batches are short.
BATCH_ROWS = 1000


def materialise(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    path, conf, key = work_dir(df.sparkSession), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows stay within the limit; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def text_bytes(text: str = "text"):
    """The text column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")


def finish(x):
    """64-bit finaliser on a NumPy array: a bijection."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a word that two integers hold; longer words are hashed by BLAKE2b.
HEAD = 16
_tables: list = []


def word_edges(body: bytes):
    """Starts and ends of the words between ASCII white space."""
    import numpy as np

    if not _tables:
        word = np.ones(256, bool)
        word[[32, 9, 10, 11, 12, 13]] = False
        _tables.extend((word, np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")))
    edges = np.flatnonzero(np.diff(_tables[0][np.frombuffer(body, "u1")], prepend=False, append=False))
    return edges[::2], edges[1::2]


def word_heads(body: bytes, starts, ends):
    """The first HEAD bytes of each word as two little-endian integers, zero beyond its end: with the length they are a short word's identity."""
    import numpy as np

    view = np.ndarray((len(body) + 9,), "<u8", body + bytes(HEAD), 0, (1,))
    size, mask = ends - starts, _tables[1]
    low, high = view[starts] & mask[np.minimum(size, 8)], np.zeros(len(starts), "u8")
    more = np.flatnonzero(size > 8)
    high[more] = view[starts[more] + 8] & mask[np.minimum(size[more] - 8, 8)]
    return low, high


def word_hashes(body: bytes, starts, ends, low, high):
    """64-bit hashes of words. Words of one length up to 8 never share one; those above HEAD bytes go through BLAKE2b."""
    import numpy as np

    size = (ends - starts).astype("u8")
    h = finish(low ^ size * np.uint64(0xD6E8FEB86659FD93))
    more = np.flatnonzero(size > 8)
    h[more] = finish(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ finish(high[more] + np.uint64(0xC2B2AE3D27D4EB4F)))
    long = np.flatnonzero(size > HEAD)
    h[long] = [int.from_bytes(hashlib.blake2b(body[i:j], digest_size=8).digest(), "little") for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def split_words(body: bytes):
    """Starts, ends and 64-bit hashes of the words between ASCII white space."""
    starts, ends = word_edges(body)
    return starts, ends, word_hashes(body, starts, ends, *word_heads(body, starts, ends))


_PROBES = ("Hello,", "straße", "ÉLAN.", "thereou", "Ünï", "WORLD?!", "año:", "a×b", "x÷", "...")
_MARKS = b".,;:!?"
_SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the UTF-8 bytes of the Latin letters that lie beyond ASCII."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(names[x] for x in chr(c).encode()) for c in range(0xC0, 0x100)}


def split_units(body: bytes):
    """Units of the words of a UTF-8 text: (small letters, starts, ends, plain).

    A word of Latin letters, with or without closing marks after them, gives a unit of its letters and one of its marks;
    both are plain, and are spelt in small letters. Any other word is one unit, spelt as it is.
    """
    import numpy as np

    if len(_tables) < 3:
        word_edges(b"")
        kind = np.full(256, 3, "u1")
        kind[[32, 9, 10, 11, 12, 13]] = 0
        kind[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
        kind[list(_MARKS)] = 2
        _tables.append(kind)
    raw = np.frombuffer(body, "u1")
    small = np.frombuffer(body.translate(_SMALL), "u1").copy()
    kind = _tables[2][raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    kind[lead[(after == 0x97) | (after == 0xB7)]] = 3  # the signs among the letters
    small[lead[(after <= 0x9E) & (after != 0x97)] + 1] += 0x20
    cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    begin = np.r_[0, cut] if len(raw) else cut
    end = np.r_[cut, len(raw)] if len(raw) else cut
    of = np.r_[kind[begin], np.zeros(3, "u1")]  # kind of each run
    gap = np.flatnonzero(of == 0)
    first = np.flatnonzero((of[:-3] != 0) & (np.r_[0, of[:-4]] == 0)) if len(begin) else cut
    letters = of[first] == 1
    marked = letters & (of[first + 1] == 2) & (of[first + 2] == 0)
    plain = marked | letters & (of[first + 1] == 0)
    last = gap[np.searchsorted(gap, first)] - 1  # the last run of the word
    place = np.cumsum(1 + marked) - (1 + marked)
    many = len(first) + int(marked.sum())
    starts, ends, is_plain = np.zeros(many, "i8"), np.zeros(many, "i8"), np.zeros(many, bool)
    starts[place], ends[place], is_plain[place] = begin[first], np.where(marked, end[first], end[last]), plain
    two = place[marked] + 1
    starts[two], ends[two], is_plain[two] = begin[first[marked] + 1], end[first[marked] + 1], True
    return small.tobytes(), starts, ends, is_plain


class WordIds(dict):
    """word (bytes between ASCII white space) -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer collapses white space and never merges across it, so the ids of a text are those of its words
    in a row. A distinct word is encoded once per worker process by the tokenizers library. Plain words skip what cannot
    change them: lower-cased Latin letters go to the library's model directly, closing marks are words of their own;
    probes at the start show whether the tokenizer at hand allows that. Batches look units up by verified hash in sorted arrays
    of at most `most_known` units; this dictionary holds two generations of `most` words. Both bounds never change a result.
    """

    def __init__(self, path: str, most: int = 60_000, most_known: int = 1_000_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path, self.most, self.older, self.tokenizer = path, most, {}, Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.most_known = most_known
        self._forget()
        self.plain = True
        self.plain = all(self.batch([w.encode()])[0].tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES)
        self._forget()

    def __missing__(self, word: bytes) -> list[int]:
        out = self.older.get(word)
        if out is None:
            out = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def _letters(self, word: bytes) -> list[int]:
        """Ids of a plain unit that is not known yet."""
        if word[0] in _MARKS:
            return self[word]
        core = word.decode("utf-8", "replace")
        return [t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.letters))]

    def _forget(self) -> None:
        import numpy as np

        self.known, self.low, self.high = (np.zeros(0, "u8") for _ in range(3))
        self.bytes, self.begin, self.size = (np.zeros(0, "i8") for _ in range(3))
        self.long: dict[int, bytes] = {}  # hash -> unit, of known units above HEAD bytes
        self.flat, self.used = np.zeros(1 << 16, "u4"), 0

    def batch(self, bodies: list[bytes]):
        """Ids of all texts in a row (uint32), where each text ends among them, and where each unit (a word or a part of one) ends.

        Units are looked up by hash, once per distinct one, and equal hashes are verified: short units by their bytes and
        length, long ones by their bytes. A unit whose hash belongs to another one is encoded by its bytes alone.
        """
        import numpy as np

        joined = b"\n".join(bodies)
        if self.plain:
            small, starts, ends, plain = split_units(joined)
        else:
            small, (starts, ends) = joined, word_edges(joined)
            plain = np.zeros(len(starts), bool)
        size = ends - starts
        low, high = word_heads(small, starts, ends)
        odd_case = np.flatnonzero(~plain)
        low[odd_case], high[odd_case] = word_heads(joined, starts[odd_case], ends[odd_case])
        h = word_hashes(small, starts, ends, low, high)
        # the two spellings of one string are told apart, as a unit's ids may depend on its kind
        h[odd_case] = finish(h[odd_case] + np.uint64(1))
        spelled = lambda k: (small if plain[k] else joined)[starts[k] : ends[k]]
        encoded = lambda k: self._letters(spelled(k)) if plain[k] else self[spelled(k)]
        kind = size * 2 + plain
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        own = first[inverse]
        odd = (low != low[own]) | (high != high[own]) | (kind != kind[own])
        for k in np.flatnonzero(size > HEAD).tolist():
            odd[k] |= spelled(k) != spelled(own[k])

        at = np.searchsorted(self.known, distinct)
        is_known = self.known[np.minimum(at, len(self.known) - 1)] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        if len(self.known) + np.count_nonzero(~is_known) > self.most_known:
            self._forget()
            at, is_known = np.zeros(len(distinct), "i8"), np.zeros(len(distinct), bool)
        seen, slot = np.flatnonzero(is_known), at[is_known]
        clash = (self.low[slot] != low[first[seen]]) | (self.high[slot] != high[first[seen]]) | (self.bytes[slot] != kind[first[seen]])
        for k in np.flatnonzero(size[first[seen]] > HEAD).tolist():
            clash[k] |= self.long.get(int(distinct[seen[k]])) != spelled(first[seen[k]])
        if clash.any():
            taken = np.zeros(len(distinct), bool)
            taken[seen[clash]] = True
            odd |= taken[inverse]

        new = np.flatnonzero(~is_known)
        if len(new):
            where, into = first[new], at[new]
            found = list(map(encoded, where.tolist()))
            self.long.update((x, spelled(k)) for x, k in zip(distinct[new].tolist(), where.tolist(), strict=True) if size[k] > HEAD)
            n = np.fromiter(map(len, found), "i8", len(found))
            self.begin = np.insert(self.begin, into, self._store(found) + np.cumsum(n) - n)
            self.size, self.bytes = np.insert(self.size, into, n), np.insert(self.bytes, into, kind[where])
            self.low, self.high = np.insert(self.low, into, low[where]), np.insert(self.high, into, high[where])
            self.known = np.insert(self.known, into, distinct[new])
            at = np.searchsorted(self.known, distinct)
        begin, n = self.begin[at][inverse], self.size[at][inverse]
        if odd.any():  # another unit's hash: practically never
            k = np.flatnonzero(odd)
            found = list(map(encoded, k.tolist()))
            n[k] = np.fromiter(map(len, found), "i8", len(found))
            begin[k] = self._store(found) + np.cumsum(n[k]) - n[k]
        unit_ends = np.cumsum(n)
        total = int(unit_ends[-1]) if len(n) else 0
        ids = self.flat[np.repeat(begin - (unit_ends - n), n) + np.arange(total)]
        text_ends = np.cumsum([len(b) + 1 for b in bodies])
        units_before = np.searchsorted(starts, text_ends)
        return ids, np.r_[0, unit_ends][units_before], unit_ends

    def _store(self, found: list[list[int]]) -> int:
        """Appends ids to the flat array; where they begin."""
        from itertools import chain

        import numpy as np

        flat, at = np.fromiter(chain.from_iterable(found), "u4"), self.used
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(max(len(self.flat), len(flat)), "u4")]
        self.flat[at : at + len(flat)] = flat
        self.used += len(flat)
        return at

    def stream(self, bodies: list[bytes], most: int = 1_000_000):
        """batch() over runs of texts of about `most` bytes: (from, to, ids, text ends, unit ends)."""
        lo, size = 0, 0
        for k, b in enumerate(bodies):
            size += len(b)
            if size >= most or k + 1 == len(bodies):
                yield lo, k + 1, *self.batch(bodies[lo : k + 1])
                lo, size = k + 1, 0


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The cache of this worker process for a tokenizer file."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def trim() -> None:
    """Gives memory that this worker process has freed back to the system; workers are kept, and idle ones count as well."""
    import ctypes

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_calls = 0


def trim_sometimes(every: int = 100) -> None:
    global _calls
    _calls += 1
    if _calls % every == 0:
        trim()


def release_words() -> None:
    """Drops the caches that an earlier stage left in this worker process."""
    _words.clear()
    trim()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
