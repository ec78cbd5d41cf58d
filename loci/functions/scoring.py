"""Scoring formulas as Columns; constants are fixed values of the ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WEIGHT_KEYWORD, WEIGHT_VECTOR, WEIGHT_ENTITY = 0.45, 0.40, 0.15
COVERAGE, RRF_K = 0.25, 60
RANK_PER_TERM, MIDPOINT, STEEPNESS = 0.1, 0.4, 2.3
SEMANTIC_GATE = 0.15
SCORE_RELEVANCE, SCORE_RECENCY, SCORE_FREQUENCY, SCORE_TYPE = 0.75, 0.10, 0.10, 0.05
SUPERSEDED_FACTOR, FREQUENCY_SATURATION, RECENCY_DAYS, LN2 = 0.6, 10, 90, 0.693
DECAY_DAYS, STALE, STALE_DAYS = 30, 0.1, 30
TYPE_PRIORITY = {"semantic": 1.0, "procedural": 0.95, "episodic": 0.90}


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null, NaN and negatives become 0."""
    return F.when(x.isNull() | F.isnan(x) | (x < 0), 0.0).when(x > 1, 1.0).otherwise(x)


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def full_match(idf_sum: Column) -> Column:
    """The rank of a text that holds every term once."""
    return F.when(idf_sum.isNull() | F.isnan(idf_sum) | (idf_sum <= 0), 0.0).otherwise(RANK_PER_TERM * idf_sum)


def rank_normal(raw: Column, terms: Column) -> Column:
    """Logistic of a raw rank around two fifths of the rank of ``terms`` single matches."""
    middle = F.lit(RANK_PER_TERM * MIDPOINT) * F.greatest(terms, F.lit(1))
    return F.when(raw.isNull() | (raw <= 0), 0.0).otherwise(1 / (1 + F.exp(-(STEEPNESS / middle) * (raw - middle))))


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high <= low, 1.0).otherwise((value - low) / (high - low))


def keyword_scale(top: Column, full: Column, coverage: float = COVERAGE) -> Column:
    """Divisor of keyword ranks: the best rank, drawn towards a full match."""
    drawn = F.pow(top, F.lit(1 - coverage)) * F.pow(full, F.lit(coverage))
    return F.when((top > 0) & (full > 0) & F.lit(coverage > 0), drawn).otherwise(top)


def fused(keyword: Column, vector: Column, entity: Column, wk=WEIGHT_KEYWORD, ws=WEIGHT_VECTOR, we=WEIGHT_ENTITY) -> Column:
    total = wk + ws + we
    return (wk * clamp01(keyword) + ws * clamp01(vector) + we * clamp01(entity)) / F.lit(float(total))


def rrf(weight: float, rank: Column, k: int = RRF_K) -> Column:
    return F.when(rank.isNull() | (rank <= 0), 0.0).otherwise(weight / (k + rank))


def fused_rrf(kw_rank: Column, vec_rank: Column, overlap: Column, wk=WEIGHT_KEYWORD, ws=WEIGHT_VECTOR, we=WEIGHT_ENTITY, k: int = RRF_K) -> Column:
    """Reciprocal ranks, scaled so that first in everything is 1; the entity signal is first rank times overlap."""
    best = (wk + ws + we) / (k + 1)
    return (rrf(wk, kw_rank, k) + rrf(ws, vec_rank, k) + F.lit(we / (k + 1)) * clamp01(overlap)) / F.lit(best)


def age_hours(now: Column, created: Column) -> Column:
    hours = (F.unix_micros(now) - F.unix_micros(created)) / 3.6e9
    return F.greatest(hours, F.lit(0.0))


def recency(now: Column, created: Column) -> Column:
    return F.exp(-LN2 * age_hours(now, created) / (RECENCY_DAYS * 24))


def frequency(count: Column) -> Column:
    return F.when(count.isNull() | (count <= 0), 0.0).otherwise(F.log1p(count) / F.log1p(count + FREQUENCY_SATURATION))


def type_priority(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, value in TYPE_PRIORITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def final_score(relevance: Column, now: Column, created: Column, count: Column, kind: Column, superseded: Column) -> Column:
    raw = (
        SCORE_RELEVANCE * clamp01(relevance) + SCORE_RECENCY * clamp01(recency(now, created)) + SCORE_FREQUENCY * clamp01(frequency(count)) + SCORE_TYPE * type_priority(kind)
    )
    return raw * F.when(F.coalesce(superseded, F.lit(False)), SUPERSEDED_FACTOR).otherwise(1.0)


def decayed(now: Column, created: Column, count: Column, half_life_days: float = DECAY_DAYS) -> Column:
    kept = F.exp(-LN2 * age_hours(now, created) / (half_life_days * 24))
    reads = F.least(F.lit(1.0), F.log1p(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))) / 5)
    return F.least(F.lit(1.0), kept * (1 + reads))


def gate(other_evidence: Column, cosine: Column, least: float = SEMANTIC_GATE) -> Column:
    """Vector-only candidates need the least cosine; unscored ones and those with other evidence stay."""
    return other_evidence | cosine.isNull() | (cosine >= least)


def reciprocal_rank(rank: Column, depth: int = 10) -> Column:
    return F.when(rank.isNotNull() & (rank <= depth), 1 / rank).otherwise(0.0)


def combined_legacy(strong: Column, weak: Column) -> Column:
    hi, lo = F.greatest(strong, weak), F.least(strong, weak)
    return hi + 0.25 * lo * (1 - hi)


def tiered_legacy(lexical: Column, cosine: Column) -> Column:
    """Lexical matches lie in the upper half, vector-only ones below it."""
    return F.when(lexical > 0, 0.5 + 0.5 * combined_legacy(lexical, clamp01(cosine))).otherwise(0.499 * clamp01(cosine))


def entity_boosted_legacy(relevance: Column, overlap: Column) -> Column:
    return clamp01(relevance + 0.05 * overlap)
