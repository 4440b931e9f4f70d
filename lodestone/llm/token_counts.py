"""Token counts by a map-side two-tier lookup (operator 12).

A byte-level vocabulary cuts a text into pre-tokens first, and the ids of a text are those of its pre-tokens in a row; so
its length is a sum of lengths. The first tier is a compact table of frequent pre-tokens and their lengths, broadcast as one
string and one array; it holds at most TERMS entries. What isn't in it goes to a cache of the worker process, which the
tokenizers library fills. No pre-token is shuffled, and the texts stay where they are read.

The table comes from a random sample of about SEED_DOCS documents over the whole corpus, the first SEED_CHARS characters of
each. What stands in it, and what the caches hold, changes how long a count takes and never the count.

Texts of code points below LATIN are cut by a regular expression whose classes are read off the library's own
pre-tokenizer, a probe for each code point; other texts are cut by the pre-tokenizer itself. A text that holds a special
string is encoded whole, as the library treats those strings before it cuts. Texts above STRETCH characters are cut in
stretches, which end where a pre-token must end: between a character that is no white space and one that is.

Defined cases: null text counts as empty and has no tokens; rows that repeat a doc_id, and rows without one, are counted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, tokenizer_path

SEED_DOCS, SEED_CHARS, TERMS = 2000, 4096, 200_000
#: Code points that are probed; Latin letters end below.
LATIN = 0x250
STRETCH, LIMIT = 1_000_000, 1024


def _regex(pre) -> tuple[re.Pattern, re.Pattern]:
    """The pre-tokenizer's cuts for code points below LATIN, and the place between no white space and white space."""
    alone = lambda s: len(pre.pre_tokenize_str(s)) == 1
    kinds: dict[str, list[str]] = {"letter": [], "digit": [], "space": []}
    for c in map(chr, range(LATIN)):
        kind = "letter" if alone("a" + c) else "digit" if alone("1" + c) else None if alone("." + c) else "space"
        if kind:
            kinds[kind].append(re.escape(c))
    letter, digit, space = ("".join(kinds[k]) for k in ("letter", "digit", "space"))
    cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")
    return cut, re.compile(rf"[^{space}][{space}]")


class Misses(dict):
    """pre-token -> its number of tokens, by the library; two generations of `most` entries, without long ones."""

    def __init__(self, tokenizer, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.tokenizer, self.most, self.longest, self.older = tokenizer, most, longest, {}

    def __missing__(self, pre: str) -> int:
        n = self.older.get(pre)
        if n is None:
            n = len(self.tokenizer.encode(pre, add_special_tokens=False).ids)
        if len(pre) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[pre] = n
        return n


class Lengths(dict):
    """The frequent pre-tokens; others are asked of the worker's cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.misses = Misses(self.tokenizer)
        self.cut, self.edge = _regex(self.tokenizer.pre_tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.beyond = re.compile(rf"[^\x00-{chr(LATIN - 1)}]")

    def __missing__(self, pre: str) -> int:
        return self.misses[pre]

    def pre_tokens(self, text: str) -> list[str]:
        if self.beyond.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.cut.findall(text)

    def count(self, text: str, stretch: int = STRETCH) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, at = 0, 0
        while at < len(text):
            edge = self.edge.search(text, at + stretch - 1) if len(text) - at > stretch else None
            to = edge.start() + 1 if edge else len(text)
            total += sum(map(self.__getitem__, self.pre_tokens(text[at:to])))
            at = to
        return total


_held: dict[str, Lengths] = {}


def lengths_of(path: str) -> Lengths:
    """The tokenizer's lengths without a first tier; once per worker process."""
    if path not in _held:
        _held[path] = Lengths(path)
    return _held[path]


def frequent(docs: DataFrame, path: str) -> list[tuple[str, int]]:
    """The most frequent pre-tokens of the seed documents, at most TERMS, with their lengths in tokens."""
    share = min(1.0, SEED_DOCS / max(1, docs.count()))
    seed = docs.select("text").sample(share, seed=12).where("text is not null").select(F.substring("text", 1, SEED_CHARS).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.text:
                seen.update(lengths_of(path).pre_tokens(text))
        top = seen.most_common(TERMS)
        yield pd.DataFrame({"pre": [t for t, _ in top], "times": [n for _, n in top], "n": [lengths_of(path)[t] for t, _ in top]}).astype({"pre": str, "times": "i8", "n": "i8"})

    terms = seed.mapInPandas(counted, "pre string, times long, n long").groupBy("pre", "n").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "pre").limit(TERMS)
    return [(r.pre, r.n) for r in terms.collect()]  # at most TERMS


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    terms, ends = frequent(docs, path), [0]
    for t, _ in terms:
        ends.append(ends[-1] + len(t))
    joined, sizes = "".join(t for t, _ in terms), [n for _, n in terms]
    name = hashlib.sha256(repr((path, joined, ends)).encode("utf-8", "surrogatepass")).hexdigest()
    held = docs.sparkSession.sparkContext.broadcast((joined, ends, sizes))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _held:  # once per worker process
            base, (text, at, n) = lengths_of(path), held.value
            lengths = copy.copy(base)
            lengths.update(zip((text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), n, strict=True))
            _held.clear()
            _held.update({path: base, name: lengths})
        lengths = _held[name]
        for texts in batches:
            yield pd.Series([lengths.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_token_counts": op12_token_counts}
ORACLES: dict[str, str] = {}
