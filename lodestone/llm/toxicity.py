"""Toxicity scores (operator 4): gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed insult lexicon and of a lexicon induced from training labels (words and word
stems much commoner in toxic texts), second-person words near lexicon hits, capitals, punctuation and obfuscation
(letters swapped for digits or signs, marks between letters). Labels are learnt from at most TRAIN_ROWS rows of the
training part only (crc32 of the id as text, mod 3, is not 1; lowest xxhash64 first), in three parts by another hash: the
lexicon (of at most MOST_TERMS terms) from one, the trees from the next, the calibration from the last. Of rows that share
a labelled id, the one with the least text teaches. lang, source and doc_id are never inputs.

Defined cases: null text counts as empty; an empty text gets the score that its (all zero) features earn; without
training labels of both kinds the fixed lexicon alone decides (0.9 with a hit, else 0.05); where a part lacks a kind, all
parts serve each step; texts of equal features get equal scores; rows may repeat, and a null doc_id is kept; an empty table
gives no rows; score() keeps other columns, and replaces tox_score and tox_predicted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.boosting import Boosted, Isotonic
from lodestone.llm.common import table, trim_sometimes

TRAIN_ROWS, THRESHOLD, NEAR = 9000, 0.7, 4
#: Stems a word counts for, by length, besides itself; the least toxic texts a term must occur in; the least log-odds.
STEMS, LEAST_TEXTS, LEAST_ODDS, MOST_TERMS = (4, 5, 6), 4, 2.3, 5000

INSULTS = frozenset("idiot idiots moron morons stupid trash scum loser losers worthless pathetic disgusting clown clowns dumb imbecile jerk filth filthy vermin garbage bastard fool creep hate kill ugly".split())
SECOND_PERSON = frozenset("you your yours yourself you're youre u ur du dein deine dich dir ihr tu toi ton ta te vous votre vos usted ustedes tus eres".split())
_LEET = str.maketrans("013457@$!|", "oleastasii")
_MARKS = re.compile(r"[\W_]+")

NAMES = "insults density log_hits obfuscated induced_density induced_log induced_best induced_sum second_person near caps_words caps_letters marks excited digits mixed log_words".split()


def terms(word: str) -> set[str]:
    return {word} | {word[:k] + "*" for k in STEMS if len(word) > k}


class _Words(dict):
    """raw word -> flags and the strength of its induced terms (tenths of log-odds, from bit 8 up)."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, raw: str) -> int:
        if len(self) > 200_000:
            self.clear()
        word = _MARKS.sub("", raw).lower()
        core = raw.strip(".,;:!?\"'()[]")
        hidden = _MARKS.sub("", core.lower().translate(_LEET))
        plain = core.lower() in INSULTS
        code = plain | 2 * (not plain and hidden in INSULTS) | 4 * (word in SECOND_PERSON or core.lower() in SECOND_PERSON)
        code |= 8 * (len(word) > 2 and core.isupper()) | 16 * (any(c.isdigit() for c in core) and any(c.isalpha() for c in core))
        best = max((self.odds.get(t, 0.0) for t in terms(word)), default=0.0) if word and self.odds else 0.0
        self[raw] = code | int(best * 10) << 8
        return self[raw]


def features(texts: list[str], words: _Words):
    """One row of NAMES for each text, over the whole of it."""
    import numpy as np

    out = np.zeros((len(texts), len(NAMES)))
    for k, text in enumerate(texts):
        raw = text.split()
        n = len(raw)
        if not n:
            continue
        code = np.fromiter(map(words.__getitem__, raw), "i4", n)
        hit, odd, strength = (code & 3) > 0, (code & 2) > 0, (code >> 8) / 10
        you = np.flatnonzero(code & 4)
        bad = np.flatnonzero(hit | (strength > 0))
        near = 0
        if len(you) and len(bad):
            at = np.searchsorted(you, bad)
            near = int(((bad - you[np.maximum(at - 1, 0)] <= NEAR) & (at > 0) | (at < len(you)) & (you[np.minimum(at, len(you) - 1)] - bad <= NEAR)).sum())
        count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
        chars, upper, digits = len(text), count[65:91].sum(), count[48:58].sum()
        letters = upper + count[97:123].sum()
        signs = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
        out[k] = (
            hit.sum(), hit.sum() / n, math.log1p(hit.sum()), odd.sum() / n, (strength > 0).sum() / n, math.log1p((strength > 0).sum()), strength.max(), math.log1p(strength.sum()), len(you) / n,
            near / n, ((code & 8) > 0).sum() / n, upper / max(letters, 1), signs / chars, (count[33] + count[63]) / chars, digits / chars, ((code & 16) > 0).sum() / n, math.log1p(n),
        )
    return out


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    trees: Boosted | None = None
    iso: Isotonic | None = None
    _words: _Words | None = None

    def __getstate__(self):
        return {"odds": self.odds, "trees": self.trees, "iso": self.iso, "_words": None}

    def score(self, texts: list[str]):
        import numpy as np

        self._words = self._words or _Words(self.odds)
        x = features(texts, self._words)
        if self.trees is None:
            return np.where(x[:, 0] > 0, 0.9, 0.05)
        p = self.trees.probability(x)
        # The calibrated score has steps; a sliver of the raw one keeps the order within a step.
        return 0.998 * self.iso(p) + 0.002 * p


def _part(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of training rows."""
    import numpy as np

    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(_part() != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3))).collect()
    if len({int(r.toxic > 0) for r in rows}) < 2:
        return Model()
    chosen = spark.createDataFrame([(r.doc_id, int(r.toxic > 0), int(r.part)) for r in rows], "id long, y int, part int")
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = sample.groupBy("id", "y", "part").agg(F.min("text").alias("text"))  # a label counts once, however many rows have its id

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.text, b.y, strict=True):
                found = {w for raw in set(text.split()) if (w := _MARKS.sub("", raw).lower())}
                seen[y].update(set().union(*map(terms, found)))
        keep = [(t, seen[0][t], n) for t, n in seen[1].items()]
        yield pd.DataFrame(keep, columns=["term", "clean", "toxic"])

    counts = sample.where("part = 0").mapInPandas(counted, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n1, n0 = (sum(r.part == 0 and int(r.toxic > 0) == y for r in rows) for y in (1, 0))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    lexicon = counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "term").limit(MOST_TERMS).collect()
    model = Model(odds={r.term: r.odds for r in lexicon})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words(model.odds)
        for b in batches:
            yield pd.DataFrame({"id": b.id, "y": b.y, "part": b.part, "x": list(features(list(b.text), words))})

    got = sorted(sample.mapInPandas(measured, "id long, y int, part int, x array<double>").collect())
    x, y, part = np.array([r.x for r in got]), np.array([r.y for r in got]), np.array([r.part for r in got])
    if not all(0 < y[part == k].sum() < (part == k).sum() for k in (1, 2)):  # few labels: all of them fit the trees and the calibration
        x, y, part = np.concatenate([x, x]), np.concatenate([y, y]), np.repeat([1, 2], len(y))
        if not 0 < y.sum() < len(y):
            return Model(odds=model.odds)
    model.trees = Boosted(trees=50, depth=3).fit(x[part == 1], y[part == 1])
    model.iso = Isotonic().fit(model.trees.probability(x[part == 2]), y[part == 2])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns tox_score and tox_predicted appended."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        trim_sometimes(8)
        return pd.Series(held.value.score([t or "" for t in texts]), dtype="float64")

    return docs.withColumn("tox_score", scored(F.coalesce("text", F.lit("")))).withColumn("tox_predicted", (F.col("tox_score") >= THRESHOLD).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the training labels, then score every document."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_part() == 1, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
