"""Batch evaluation of triage cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.sections import extract_escalation, extract_recommended_priority
from caseloom.functions.text import build_query
from caseloom.plans.triage import assess, select_evidence


def evaluate_cases(
    cases: DataFrame,
    candidates: DataFrame | None,
    top_k: int = fixed.EVIDENCE_LIMIT,
    decision_text: str | None = None,
) -> DataFrame:
    """The evaluation columns per case, by the rule without the guardrail.

    ``cases`` are tickets with a ``name``; ``decision_text`` names a column with generated text.
    """
    decision = F.col(decision_text) if decision_text else F.lit(fixed.NO_TEXT_REPORT)
    assessed = assess(select_evidence(cases, candidates, top_k), guardrail=False)
    matched, found = F.col("stats.same_queue_count"), F.col("stats.count")
    query = F.lit("") if candidates is None else build_query("issue", "type", "queue")
    return assessed.select(
        "name",
        "issue",
        "type",
        "queue",
        "ml_priority",
        F.col("recommended_priority").alias("recommended_priority_rule"),
        extract_recommended_priority(decision).alias("llm_priority"),
        "confidence_score",
        "confidence_level",
        matched.alias("same_queue_count"),
        found.alias("num_incidents"),
        F.round(matched / F.greatest(found, F.lit(1)), 2).alias("same_queue_ratio"),
        extract_escalation(decision).alias("escalation"),
        query.alias("retrieval_query"),
    )
