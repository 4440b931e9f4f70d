"""Claims of an answer and their support in retrieved text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

#: Openings of sentences that state nothing.
FILLERS = ("hello", "certainly", "here is", "in summary")
MOST_CLAIMS = 12


def claim_list(answer: Column) -> Column:
    """Array of claims: sentences of over 20 characters without filler, cut at coordinators, clauses of over 15; at most 12."""
    plain = tx.plain_markdown(F.coalesce(answer, F.lit("")))
    told = F.filter(F.transform(tx.sentences(plain), lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & ~tx.starts_any(F.lower(s), FILLERS))
    clauses = F.flatten(F.transform(told, lambda s: F.split(s, r",\s*(?:and|but|while|whereas|because)\s+")))
    return F.slice(F.filter(F.transform(clauses, lambda c: F.trim(c)), lambda c: F.length(c) > 15), 1, MOST_CLAIMS)


def claims(answers: DataFrame, key: str | list[str], answer: str) -> DataFrame:
    """(key, claim_no, claim) from 0."""
    keys = [key] if isinstance(key, str) else key
    return answers.select(*keys, F.posexplode(claim_list(F.col(answer))).alias("claim_no", "claim"))


def verified_claims(claims_: DataFrame, context: str) -> DataFrame:
    """Adds ratio, is_entailed and prob: the share of a claim's longer words and numbers that the lower-cased context column holds. Claims without such words are left out."""
    toks = F.filter(tx.tokens(F.col("claim")), lambda w: (F.length(w) > 3) | w.rlike("^[0-9]+$"))
    c = claims_.withColumns({"_n": F.size(toks), "_m": tx.overlap(toks, F.col(context))}).where("_n > 0")
    ratio = F.col("_m") / F.col("_n")
    return c.withColumns({"ratio": F.round(ratio, 6), "is_entailed": ratio >= 0.60, "prob": F.round(F.least(F.lit(1.0), ratio * 1.15), 6)}).drop("_n", "_m")


def faithfulness(verified: DataFrame, answers: DataFrame, key: str | list[str]) -> DataFrame:
    """Per answer: total_claims, supported_claims and their ratio (1.0 without claims)."""
    keys = [key] if isinstance(key, str) else key
    agg = verified.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_claims"), F.sum(F.col("is_entailed").cast("long")).alias("supported_claims"))
    out = answers.select(*keys).join(agg, keys, "left")
    n, s = F.coalesce("total_claims", F.lit(0)), F.coalesce("supported_claims", F.lit(0))
    return out.select(*keys, n.alias("total_claims"), s.alias("supported_claims"), F.round(F.when(n > 0, s / n).otherwise(1.0), 3).alias("faithfulness"))
