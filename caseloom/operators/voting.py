"""What the chosen evidence says: vote, confidence, recommendation, summary.

Evidence is an array of incident structs in order of choice, at most a handful long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import col_of, fill_slots


def _priorities(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.coalesce(e["priority"], F.lit("UNKNOWN")))


def _tally(evidence: Column) -> Column:
    """(count, -place of first sight, priority), in order of first sight."""
    seen = _priorities(evidence)
    return F.transform(
        F.array_distinct(seen),
        lambda p, at: F.struct(
            F.size(F.filter(seen, lambda s: s == p)).alias("count"),
            (-at).alias("earliness"),
            p.alias("priority"),
        ),
    )


def evidence_stats(evidence: Column | str, queue: Column | str) -> Column:
    """Everything the rules below need, computed once per ticket."""
    evidence, queue = col_of(evidence), col_of(queue)
    n = F.size(evidence)
    tally = _tally(evidence)
    majority = F.array_max(tally)
    total = F.aggregate(
        evidence, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["distance"], F.lit(1.0))
    )
    stated = F.aggregate(
        evidence, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["distance"], F.lit(0.0))
    )
    strong_high = F.exists(
        evidence,
        lambda e: (e["priority"] == "HIGH")
        & (F.coalesce(e["distance"], F.lit(1.0)) <= fixed.STRONG_HIGH_DISTANCE),
    )
    return F.struct(
        n.alias("count"),
        majority["priority"].alias("majority_priority"),
        majority["count"].alias("majority_count"),
        F.size(F.filter(evidence, lambda e: e["queue"] == queue)).alias("same_queue_count"),
        # Votes count a missing distance as far, the summary as none.
        F.when(n > 0, total / n).alias("avg_distance"),
        F.when(n > 0, stated / n).alias("stated_distance"),
        strong_high.alias("strong_high"),
        F.array_join(
            F.transform(
                tally, lambda t: F.concat(t["priority"], F.lit("="), t["count"].cast("string"))
            ),
            ", ",
        ).alias("priority_counts"),
    )


def confidence_score(stats: Column | str, predicted: Column | str) -> Column:
    s, predicted = col_of(stats), col_of(predicted)

    def points(condition: Column, amount: float, otherwise: Column | None = None) -> Column:
        rest = F.lit(0.0) if otherwise is None else otherwise
        return F.when(condition, F.lit(amount)).otherwise(rest)

    by_distance = F.lit(0.0)
    for limit, amount in reversed(fixed.DISTANCE_POINTS):
        by_distance = points(s["avg_distance"] < limit, amount, by_distance)
    total = (
        points(s["majority_priority"] == predicted, fixed.MAJORITY_AGREES_POINTS)
        + points(s["majority_count"] >= 2, fixed.REPEATED_MAJORITY_POINTS)
        + points(
            s["same_queue_count"] >= 2,
            fixed.SAME_QUEUE_POINTS,
            points(s["same_queue_count"] == 1, fixed.ONE_SAME_QUEUE_POINTS),
        )
        + by_distance
    )
    return F.when(s["count"] == 0, F.lit(fixed.CONFIDENCE_WITHOUT_EVIDENCE)).otherwise(
        F.round(F.least(total, F.lit(1.0)), 2)
    )


def recommend_priority(
    stats: Column | str, predicted: Column | str, guardrail: bool = True
) -> Column:
    """Majority of at least two, else the prediction; the guardrail softens HIGH against LOW."""
    s, predicted = col_of(stats), col_of(predicted)
    repeated = (s["majority_count"] >= 2) & (s["majority_priority"] != "UNKNOWN")
    by_vote = F.when(s["count"] == 0, predicted)
    if guardrail:
        softened = (predicted == "HIGH") & (s["majority_priority"] == "LOW") & s["strong_high"]
        by_vote = by_vote.when(softened, F.lit("MEDIUM"))
    return by_vote.when(repeated, s["majority_priority"]).otherwise(predicted)


def evidence_summary(stats: Column | str, predicted: Column | str) -> Column:
    s = col_of(stats)
    distance = F.format_string("%.4f", s["stated_distance"])
    return fill_slots(
        fixed.EVIDENCE_SUMMARY_FORMAT,
        predicted=col_of(predicted),
        count=s["count"],
        matches=s["same_queue_count"],
        priorities=F.when(s["count"] == 0, F.lit("none")).otherwise(s["priority_counts"]),
        distance=F.when(s["count"] == 0, F.lit("N/A")).otherwise(distance),
    )
