"""Confidence, recency and fusion of ranking signals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rules


def confidence(base: Column, days: Column, accesses: Column, pinned: Column, stability: float = rules.STABILITY_DAYS) -> Column:
    """Stored confidence on a power-law forgetting curve; accesses stretch it, pinned rows and the present are exempt."""
    reach = F.lit(stability) * (1 + 0.5 * F.log1p(accesses.cast("double")))
    kept = base * F.pow(1 + F.lit(rules.FORGETTING_FACTOR) * days / reach, F.lit(-rules.FORGETTING_POWER))
    return F.when(pinned | (days <= 0), base).otherwise(kept)


def recency(age: Column, tau: float = rules.RECENCY_DAYS) -> Column:
    return 1 / (1 + F.greatest(age, F.lit(0.0)) / tau)


def recency_intent(query: str) -> bool:
    return not set(query.lower().split()).isdisjoint(rules.RECENCY_WORDS)


def _all(partition: list[str]):
    return W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))


def fusion(fts: Column, age: Column, trust: Column, pinned: Column, *, partition: list[str] | None = None, intent: bool = False, tau: float = rules.RECENCY_DAYS, weights=(rules.LEXICAL_WEIGHT, rules.RECENCY_WEIGHT, rules.CONFIDENCE_WEIGHT)) -> Column:
    """struct(lexical, recency, confidence, tier, score) of candidates, relative to those of their partition.

    A partition is one query's candidate window (at most ``rules.DEEP_WINDOW`` rows), so its window fits one task.
    """
    group = _all(partition or [])
    lex_w, rec_w, conf_w = weights
    tau = tau / 2 if intent else tau
    age = F.greatest(age, F.lit(0.0))
    best = F.max(fts).over(group)
    place = F.rank().over(group.orderBy(F.desc(fts)))
    lexical = F.when(best > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), fts / best))).otherwise(61.0 / (60.0 + place))
    low = F.min(age).over(group)
    span = F.max(age).over(group) - low
    share = span / (span + tau)
    spread = F.when(span > 0, (1 - (age - low) / span) * share + (1 - share) * recency(age, tau)).otherwise(recency(age, tau))
    tier = F.when(pinned, lex_w + rec_w + conf_w).otherwise(0.0)
    parts = [(lex_w * lexical).alias("lexical"), (rec_w * spread).alias("recency"), (conf_w * trust).alias("confidence"), tier.alias("tier")]
    return F.struct(*parts, (lex_w * lexical + rec_w * spread + conf_w * trust + tier).alias("score"))


def recomputed(parts: Column) -> Column:
    """The score that the parts of an explanation add up to."""
    return parts["lexical"] + parts["recency"] + parts["confidence"] + parts["tier"]


def legacy(fts: Column, age: Column, trust: Column, pinned: Column, *, partition: list[str] | None = None, halflife: float = rules.RECENCY_DAYS, intent: bool = False) -> Column:
    """Relevance halved every ``halflife`` days, ten times for pinned rows; rows near the top gain for being fresh."""
    group = _all(partition or [])
    score = fts * F.pow(F.lit(0.5), age / (halflife / 2 if intent else halflife)) * F.when(pinned, 10.0).otherwise(1.0) * trust
    near = (score > 0.7 * F.max(score).over(group)) & (F.count("*").over(group) >= 2)
    return F.when(near, score * (1 + 0.3 * F.pow(F.lit(0.5), age))).otherwise(score)


def significant(value: Column, digits: int = 6) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, value).otherwise(F.round(value * scale) / scale)
