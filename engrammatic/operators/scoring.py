"""Scores as Column expressions: nothing here leaves whole-stage code generation.

A null input takes the documented default; scores are clamped to 0..1 where that is said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engrammatic.dims import ACTIVATION_WEIGHTS, DEFINITE, EGO_WEIGHTS, HALF_LIFE_DAYS, HEDGES, IMPORTANCE, IMPORTANCE_WORDS, LABEL_IMPORTANCE, SPACING_HOURS, TIER_POLICIES
from engrammatic.operators.relations import text_map
from engrammatic.tables import DAY

LN2 = 0.6931471805599453


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, places: int) -> Column:
    """A double times 10^places, halves away from zero, and back, as DuckDB rounds; F.round goes by the decimal spelling, in which 0.575 is a half."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**places) / 10.0**places


def total(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def recency_decay(tier: Column, age_days: Column) -> Column:
    """exp(-ln 2 age / half-life); an unknown tier decays like tier 2. Null ages give null."""
    half = reduce(lambda w, p: w.when(tier == p[0], F.lit(p[1])), list(HALF_LIFE_DAYS.items())[1:], F.when(tier == 1, F.lit(HALF_LIFE_DAYS[1]))).otherwise(HALF_LIFE_DAYS[2])
    return clamp(F.exp(-LN2 / half * age_days))


def ego_components(explicit, recency, frequency, sentiment, response_length, followups, references, confidence=None, source=None, novelty=None) -> dict[str, Column]:
    """The nine components, each 0..1, from raw measurements."""
    one = F.lit(1.0)
    return {
        "explicit": F.coalesce(explicit, F.lit(0.0)),
        "recency": F.coalesce(recency, F.lit(0.0)),
        "frequency": F.least(one, F.coalesce(frequency, F.lit(0)) / 10.0),
        "sentiment": F.least(one, F.abs(F.coalesce(sentiment, F.lit(0.0)))),
        "engagement": F.least(one, F.coalesce(response_length, F.lit(0)) / 100.0 + 0.2 * F.coalesce(followups, F.lit(0))),
        "references": F.least(one, F.coalesce(references, F.lit(0)) / 5.0),
        "confidence": F.coalesce(confidence, F.lit(0.5)) if confidence is not None else F.lit(0.5),
        "source": F.coalesce(source, F.lit(0.7)) if source is not None else F.lit(0.7),
        "novelty": F.coalesce(novelty, F.lit(0.5)) if novelty is not None else F.lit(0.5),
    }


def ego_score(components: dict[str, Column]) -> Column:
    return clamp(total(EGO_WEIGHTS[k] * c for k, c in components.items()))


def ego_explain(components: dict[str, Column]) -> Column:
    """'name=contribution' of every component, four digits each."""
    return F.concat_ws(" ", *(F.format_string(f"{k}=%.4f", EGO_WEIGHTS[k] * c) for k, c in components.items()))


def tier_of(score: Column, policy: str = "ml") -> Column:
    """The tier by a named policy; null where the policy forgets."""
    cuts, below = TIER_POLICIES[policy]
    out = F.when(score >= cuts[0][0], F.lit(cuts[0][1]))
    for least, tier in cuts[1:]:
        out = out.when(score >= least, F.lit(tier))
    return (out.otherwise(below) if below else out).cast("int")


def worker_tier(score: Column, confidence: Column) -> Column:
    """The worker's policy: 0.5 is the shadow tier, of memories that score high but are unsure; null is forgotten."""
    return F.when((score >= 0.75) & (confidence >= 0.85), 1.0).when(score >= 0.75, 0.5).when(score >= 0.45, 2.0).when(score >= 0.25, 3.0)


def explicit_importance(label: Column) -> Column:
    """That of the whole label, else of what is before ':', else 0.5."""
    m, low = text_map(LABEL_IMPORTANCE), F.lower(F.coalesce(label, F.lit("unknown")))
    return F.coalesce(F.try_element_at(m, low), F.try_element_at(m, F.split(low, ":")[0]), F.lit(0.5))


def engagement(response_length: Column, followups: Column, elaboration: Column, explicit: Column) -> Column:
    """Important facts start from 0.5 and their length matters half."""
    high = explicit >= 0.7
    return clamp(F.when(high, 0.5).otherwise(0.0) + 0.4 * F.least(F.lit(1.0), response_length / 200.0) * F.when(high, 0.5).otherwise(1.0) + 0.3 * F.least(F.lit(1.0), followups / 5.0) + 0.3 * elaboration)


def fallback_score(novelty, frequency, sentiment, explicit, engaged) -> Column:
    return clamp(0.2 * novelty + 0.1 * frequency + 0.1 * sentiment + 0.4 * explicit + 0.2 * engaged)


def capped(score: Column, explicit: Column) -> Column:
    """A learned score of what isn't explicitly important stays below tier 1."""
    return F.when(explicit < 0.6, F.least(score, F.lit(0.74))).otherwise(score)


def llm_confidence(text: Column) -> Column:
    """From hedging and definite phrases (as substrings) and length; clamped to 0.3..1. A null text counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: total(F.when(low.contains(w), 1).otherwise(0) for w in words)
    n = F.length(low)
    return clamp(0.8 - 0.05 * count(HEDGES) + 0.03 * count(DEFINITE) + F.when(n < 50, -0.1).when(n > 200, 0.05).otherwise(0.0), 0.3)


def combined_confidence(extraction, llm, consistency, has_pii, inconsistent) -> Column:
    return clamp(0.5 * extraction + 0.3 * llm + 0.2 * consistency - F.when(has_pii, 0.3).otherwise(0.0) - F.when(inconsistent, 0.2).otherwise(0.0))


def routing(confidence: Column, ego: Column) -> Column:
    return F.when(ego < 0.20, "discard").when((confidence >= 0.85) & (ego >= 0.75), "auto_store").when(confidence >= 0.6, "active_learning").otherwise("discard")


def label_routing(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "auto_accept").when(confidence >= 0.60, "semantic_check").otherwise("force_fallback")


def activation_features(c: dict[str, Column], as_of: int) -> dict[str, Column]:
    """The twelve features of a candidate edge. c: ego_max, ego_avg, evidence, sessions, first_seen, last_fired,
    sentiment, predicate, contradictions, promotes, demotes, proximity and novelty."""
    cap = lambda x: F.least(F.lit(1.0), x)
    days = F.greatest(F.lit(1.0), (F.lit(as_of) - c["first_seen"]) / float(DAY) / 7.0)
    return {
        "ego": F.coalesce(0.7 * c["ego_max"] + 0.3 * c["ego_avg"], F.lit(0.5)),
        "evidence": cap(c["evidence"] / 5.0),
        "recency": F.exp(-1.2e-5 * ((F.lit(as_of) - c["last_fired"]) / 3.6e9)),
        "rate": cap(c["evidence"] / days / 5.0),
        "diversity": cap(c["sessions"] / 5.0),
        "sentiment": 0.3 + 0.7 * 2 * F.abs(c["sentiment"] - 0.5),
        "importance": relation_importance(c["predicate"]),
        "contradiction": cap(c["contradictions"] / 3.0),
        "proximity": c["proximity"],
        "promoted": cap(c["promotes"] / 3.0),
        "demoted": cap(c["demotes"] / 3.0),
        "novelty": c["novelty"],
    }


def activation(features: dict[str, Column]) -> Column:
    return clamp(total(w * features[k] for k, w in ACTIVATION_WEIGHTS.items()))


def activation_decision(score: Column) -> Column:
    return F.when(score >= 0.7, "promote").when(score <= 0.3, "demote").otherwise("keep")


def activation_confidence(score: Column, features: list[Column]) -> Column:
    """Sure when the score is far from both thresholds and the features agree."""
    mean = total(features) / len(features)
    variance = total((f - mean) * (f - mean) for f in features) / len(features)
    far = F.least(F.abs(score - 0.7), F.abs(score - 0.3))
    return 0.6 * F.least(F.lit(1.0), 5 * far) + 0.4 * (1 - F.least(F.lit(1.0), 4 * variance))


def relation_importance(predicate: Column) -> Column:
    return F.coalesce(F.try_element_at(text_map(IMPORTANCE), F.lower(F.trim(predicate))), F.lit(0.5))


def importance_by_word(predicate: Column) -> Column:
    """By words inside the predicate, where the map doesn't have it."""
    low, out = F.lower(predicate), F.lit(0.5)
    for value, words in reversed(IMPORTANCE_WORDS):
        out = F.when(low.rlike(words.replace(" ", "|")), value).otherwise(out)
    return out


def relation_confidence(pattern, entity_mean, normalisation, modality) -> Column:
    return F.round(0.4 * pattern + 0.3 * entity_mean + 0.2 * normalisation + 0.1 * modality, 3)


def triple_confidence(base, negated, modality, possessive, depth) -> Column:
    return (base - F.when(negated, 0.15).otherwise(0.0)) * modality * F.when(possessive, 1.05).otherwise(1.0) * F.pow(F.lit(0.96), depth)


def entity_confidence(model, type_certainty, proper_share, clean_share) -> Column:
    return F.round(clamp(0.4 * model + 0.3 * type_certainty + 0.2 * proper_share + 0.1 * clean_share), 3)


def confidence_anomaly(scores: Column) -> Column:
    """What is odd about an array of label scores, or null."""
    n = lambda p: F.size(F.filter(scores, p))
    mid = F.filter(scores, lambda s: (s >= 0.5) & (s <= 0.7))
    many = n(lambda s: s >= 0.5) > 5
    flat = (F.size(mid) >= 3) & (F.array_max(mid) - F.array_min(mid) < 0.15)
    split = (F.size(scores) >= 3) & (F.array_max(scores) > 0.85) & (F.array_min(scores) < 0.6)
    return F.when(many, "too_many_labels").when(flat, "flat_scores").when(split, "mixed_scores")


def spacing_trigger(age_hours: Column) -> Column:
    """The first review window (in hours) that an age falls into, or null."""
    out = F.when(F.abs(age_hours - SPACING_HOURS[0][0]) <= SPACING_HOURS[0][1], SPACING_HOURS[0][0])
    for at, slack in SPACING_HOURS[1:]:
        out = out.when(F.abs(age_hours - at) <= slack, at)
    return out.cast("long")


def time_bucket(micros: Column) -> Column:
    """Night, morning, afternoon or evening of the day in UTC."""
    h = F.floor(F.pmod(micros, F.lit(DAY)) / 3.6e9)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")
