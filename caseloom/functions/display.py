"""Column expressions behind the dashboard's result view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import blank_to_null, col_of, strip


def confidence_level(score: Column | str) -> Column:
    score = col_of(score)
    level = F.lit(fixed.LOWEST_CONFIDENCE_LEVEL)
    for floor, name in reversed(fixed.CONFIDENCE_LEVELS):
        level = F.when(score >= floor, F.lit(name)).otherwise(level)
    return level


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def rescale_confidence(score: Column | str) -> Column:
    """Scores given in percent come down to 0..1; anything not finite becomes 0."""
    score = col_of(score).cast("double")
    scaled = F.when(score > 1, F.least(F.lit(1.0), score / 100)).otherwise(score)
    # Spark ranks NaN above every number, so it has to be ruled out before the comparison.
    return F.when(score.isNull() | F.isnan(score), F.lit(0.0)).when(
        _finite(scaled), scaled
    ).otherwise(F.lit(0.0))


def evidence_similarity(distance: Column | str, adjusted: Column | str) -> Column:
    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c)

    def closeness(c: Column) -> Column:
        # 1 / (1 + d) with the limits of IEEE division at d = -1 kept.
        ratio = F.when(c == -1, F.lit(float("inf"))).otherwise(F.lit(1.0) / (c + 1))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))

    d, a = col_of(distance).cast("double"), col_of(adjusted).cast("double")
    return (
        F.when(usable(d), closeness(d)).when(usable(a), closeness(F.abs(a))).otherwise(F.lit(0.0))
    )


def evidence_defaults(evidence: Column | str) -> Column:
    """Evidence entries as similar incidents, with a stand-in for every missing field."""
    dash = F.lit("—")

    def entry(e: Column, i: Column) -> Column:
        stand_in = F.concat(F.lit("evidence-"), (i + 1).cast("string"))
        return F.struct(
            F.coalesce(blank_to_null(e["doc_id"]), stand_in).alias("id"),
            F.coalesce(e["queue"], dash).alias("queue"),
            F.coalesce(e["priority"], dash).alias("priority"),
            evidence_similarity(e["distance"], e["adjusted_score"]).alias("similarity_score"),
            F.coalesce(e["issue_description"], F.lit("")).alias("issue_description"),
            F.coalesce(e["resolution"], F.lit("")).alias("resolution"),
        )

    return F.transform(col_of(evidence), entry)


def escalation_text(escalation: Column | str) -> Column:
    """Raw escalation text, or the parts that are not blank joined by a dash."""
    e = col_of(escalation)
    parts = F.filter(
        F.array(e["decision"], e["team"], e["reason"]), lambda p: blank_to_null(p).isNotNull()
    )
    return F.coalesce(blank_to_null(e["raw"]), F.array_join(parts, " — "), F.lit(""))


def confidence_percent(score: Column | str) -> Column:
    return F.concat(F.floor(col_of(score) * 100 + 0.5).cast("string"), F.lit("%"))


def _level(word: Column, high: tuple[str, ...]) -> Column:
    return (
        F.when(word.isin(*high), F.lit("HIGH"))
        .when(word.isin(*fixed.MEDIUM_WORDS), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def priority_level(value: Column | str) -> Column:
    return _level(F.upper(strip(value)), fixed.HIGH_WORDS)


def incident_priority_level(value: Column | str) -> Column:
    """Variant of the incident list: no trimming, and SEVERE is not a HIGH word."""
    return _level(F.upper(col_of(value)), fixed.HIGH_WORDS_IN_LIST)


def escalation_severity(value: Column | str) -> Column:
    text = F.lower(col_of(value))
    return (
        F.when(text.contains("declare") | text.contains("immediate"), F.lit("critical"))
        .when(text.contains("escalate"), F.lit("elevated"))
        .otherwise(F.lit("normal"))
    )


def status_class(status: Column | str) -> Column:
    text = F.lower(col_of(status))
    return reduce(
        lambda rest, word: F.when(text.contains(word), F.lit(word)).otherwise(rest),
        reversed(fixed.STATUS_CLASSES),
        F.lit("other"),
    )


def map_ticket_type(ticket_type: Column | str) -> Column:
    is_problem = F.lower(strip(ticket_type)) == "problem"
    return F.when(is_problem, F.lit("PROBLEM")).otherwise(F.lit("INCIDENT"))
