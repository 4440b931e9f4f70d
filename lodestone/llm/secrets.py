"""Secret scans (operator 8): three base patterns, and a token-efficiency test for random strings.

The test looks at runs of [A-Za-z0-9+/_.=-] of at least LEAST_CHARS characters that hold a digit and a letter. A run that
compresses badly under a byte-level BPE vocabulary of natural text, that is has fewer than RATIO characters per token, is
random. Excluded before it: digests (hex runs of the lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512),
UUIDs, runs that stand in an address or URL (an @ or :// beside them, or a dotted host name), dates and versions, and runs
inside a base span.

Defined cases: null text counts as empty and has no spans; spans of one kind never overlap; places are code points, end
exclusive; rows may repeat, and a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, tokenizer_path

LEAST_CHARS, RATIO = 16, 2.0
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as the leftmost greedy match of one or more is
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CHARS)
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_ALL_HEX = re.compile(r"[0-9A-Fa-f]+\Z")
_HOST = re.compile(r"([a-z0-9-]+\.)+[a-z]{2,}([/.].*)?\Z", re.IGNORECASE)
_PLAIN = re.compile(r"[0-9.:/_=+-]+\Z|v?[0-9]+(\.[0-9A-Za-z-]+)+\Z")
_KEYWORDS = ("password", "passwd", "secret", "token", "api")

_vocabularies: dict[str, object] = {}


def vocabulary(path: str):
    """tiktoken encoding of a rank file, once per process."""
    if path not in _vocabularies:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low, out = text.lower(), []
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def random_spans(text: str, base: list[tuple[str, int, int]], encoding) -> list[tuple[str, int, int]]:
    """Runs that the token-efficiency test exposes."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in ".=-_/+":
            a += 1
        while b > a and text[b - 1] in ".-_/":
            b -= 1
        s = text[a:b]
        if len(s) < LEAST_CHARS or not any("0" <= c <= "9" for c in s) or not any(c.isalpha() for c in s):
            continue
        if _ALL_HEX.match(s) and len(s) in DIGEST_CHARS or _UUID.match(s) or _PLAIN.match(s) or _HOST.match(s):
            continue
        if text[b : b + 1] == "@" or text[max(a - 1, 0) : a] == "@" or text[max(a - 1, 0) : a] == ":" and s.startswith("//") or text[b : b + 3] == "://" or text[max(a - 3, 0) : a] == "://" or m[0].startswith("//") and text[max(m.start() - 1, 0) : m.start()] == ":":
            continue
        if any(x < b and a < y for _, x, y in base):
            continue
        if len(s) < RATIO * len(encoding.encode_ordinary(s)):
            out.append(("random", a, b))
    return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, counts of base spans, digest of their list, and the list of all spans as kind:start:end."""
    path = vocabulary_path or tokenizer_path("byte_bpe_50k.tiktoken")

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoding = vocabulary(path)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base = base_spans(text)
                spans = base + random_spans(text, base, encoding)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_secrets": op8_secrets}
ORACLES: dict[str, str] = {}
