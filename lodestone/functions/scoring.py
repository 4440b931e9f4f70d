"""Score arithmetic of the retrieval pipelines as Column expressions. Constants are parameters with the operators' defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLDS = {"strict": 0.42, "creative": 0.22, "balanced": 0.35}


def threshold(strictness: str = "balanced", explicit: float | None = None) -> float:
    return explicit if explicit is not None else THRESHOLDS.get(strictness.lower().strip(), THRESHOLDS["balanced"])


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def from_distance(distance: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - distance), 4)


def calibrate(raw: Column, lexical: Column) -> Column:
    """Confidence of a raw similarity: nothing below the noise floor, linear above it, a bonus for a lexical match."""
    line = clamp((raw - 0.38) / 0.47, 0.0, 1.0)
    return F.round(F.when((raw < 0.38) & ~lexical, 0.0).when(lexical, F.least(F.lit(1.0), line + 0.15)).otherwise(line), 4)


def attention(score: Column, overlap: Column, history: Column, has_figure: Column, image_query: bool = False) -> Column:
    """Composite of similarity, query overlap, history overlap and figure; history is not looked at for image queries."""
    past = F.lit(0.0) if image_query else F.least(history * 0.04, F.lit(0.10))
    return score * 0.65 + F.least(overlap * 0.08, F.lit(0.25)) + past + F.when(has_figure, 0.12 if image_query else 0.05).otherwise(0.0)


def standalone_attention(score: Column, overlap: Column, n_query: Column, history: Column, n_history: Column, tagged: Column) -> Column:
    q = F.least(F.lit(0.35), overlap / F.greatest(F.lit(1), n_query) * 0.35)
    h = F.when(n_history > 0, F.least(F.lit(0.15), history / F.greatest(F.lit(1), n_history) * 0.15)).otherwise(0.0)
    return score + q + h + F.when(tagged, 0.05).otherwise(0.0)


def fallback_logit(distance: Column) -> Column:
    return 1.5 * (1.0 - distance)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(logit, -15.0, 15.0)))


def z_score(prob: Column, mean: Column, std: Column) -> Column:
    return ((F.log(prob / (1.0 - prob)) + 15.0) / 30.0 - mean) / std


def entailment(coverage_words: Column, matched: Column) -> Column:
    """Lexical stand-in for entailment: coverage stretched and clamped; 0.85 where nothing can be matched."""
    return F.when(coverage_words == 0, 0.85).otherwise(clamp(matched / coverage_words * 1.25, 0.05, 1.0))


def gate(prob: Column, nli: Column, least_prob: float = 0.50, least_nli: float = 0.15) -> Column:
    """Refusal reason, or null where all gates pass. prob is null where nothing was retrieved."""
    return F.when(prob.isNull(), "NO_CANDIDATES_RETRIEVED").when(prob < least_prob, "CROSS_ENCODER_CONFIDENCE_LOW").when(nli < least_nli, "NLI_CONTRADICTION_OR_NEUTRAL")


def hardware_tier(vram: Column) -> Column:
    return F.when(vram >= 12.0, "ultra").when(vram >= 6.0, "high").when(vram >= 3.5, "recommended_4gb").otherwise("cpu_entry")


def compatibility(vram: Column, ram: Column, required: Column) -> Column:
    return F.when(vram >= required, "recommended").when(vram + 2.0 >= required, "compatible").when(ram >= required * 1.5, "heavy").otherwise("unsupported")


def progress_percent(current: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.round(F.lit(100.0) * current / F.greatest(F.lit(1), total), 1))


def image_relevance(score: Column, overlap: Column) -> Column:
    return F.least(F.lit(100.0), F.round(F.greatest(F.lit(40.0), calibrate(score, overlap > 0) * 100.0 + overlap * 8), 1))
