"""The triage job: tickets in, one decision row per ticket out.

Shape of the plan: nearest incidents once per distinct query, their texts attached and compared
once, then a left join to the tickets by query key.  From there on every rule is a narrow
expression on the ticket's own row, so a query shared by a third of all tickets costs a skewed
join at most, which adaptive execution splits.  Tickets without candidates keep a row.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.display import (
    confidence_level,
    escalation_text,
    evidence_defaults,
    rescale_confidence,
)
from caseloom.functions.render import build_prompt, fallback_decision, format_incidents
from caseloom.functions.sections import parse_decision_output
from caseloom.functions.text import build_query
from caseloom.operators.clean import strip_upper
from caseloom.operators.ranking import (
    PAYLOAD,
    TEXTS,
    candidates_per_query,
    rerank,
    select_from,
    serialize_incident,
    with_texts,
)
from caseloom.operators.retrieval import knn_topk, overfetch_k, retrieved_incidents
from caseloom.operators.voting import (
    confidence_score,
    evidence_stats,
    evidence_summary,
    recommend_priority,
)

RESPONSE_COLUMNS = (
    "input_issue",
    "input_type",
    "input_queue",
    "recommended_priority",
    "ml_predicted_priority",
    "rag_signal_priority",
    "confidence_score",
    "confidence_level",
    "root_cause",
    "action_plan",
    "next_diagnostics",
    "escalation_recommendation",
    "evidence_from_similar_incidents",
    "evidence",
    "assessment_summary",
    "raw_decision",
)
DEBUG_COLUMNS = (
    "raw_retrieved_incidents",
    "reranked_incidents",
    "deduplicated_incidents",
    "evidence_summary",
    "prompt",
)
_NO_REPEATS = "array<array<int>>"


def normalize_requests(tickets: DataFrame) -> DataFrame:
    """Type and queue as training and the knowledge base write them."""
    return tickets.withColumns({"type": strip_upper("type"), "queue": strip_upper("queue")})


def retrieve_candidates(
    query_vectors: DataFrame,
    kb: DataFrame,
    top_k: int = fixed.EVIDENCE_LIMIT,
    threshold: float | None = fixed.NEAR_DUPLICATE_RATIO,
    hits: DataFrame | None = None,
    **knn_options,
) -> DataFrame:
    """Candidates per distinct query: (query_id, candidates, repeats).

    ``hits`` replaces the search by ready (query_id, doc_id, distance, rank) rows.
    """
    if hits is None:
        hits = knn_topk(query_vectors, kb, overfetch_k(top_k), **knn_options)
    equal_only = threshold is not None and threshold >= 1.0
    return candidates_per_query(retrieved_incidents(hits, kb, digests=equal_only), threshold)


def attach_candidates(tickets: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """Tickets with their candidates; empty arrays where there are none."""
    if candidates is None:
        texts = ", ".join(
            f"{c}: array<string>" if c == "tags" else f"{c}: string" for c in PAYLOAD
        )
        nothing = F.array().cast(f"array<struct<rank: int, distance: double, {texts}>>")
        return tickets.withColumns(
            {"candidates": nothing, "repeats": F.array().cast(_NO_REPEATS)}
        )
    kind = candidates.schema["candidates"].dataType
    joined = tickets.join(
        candidates.withColumnRenamed("query_id", "query_key"), "query_key", "left"
    )
    return joined.withColumns(
        {
            "candidates": F.coalesce("candidates", F.array().cast(kind)),
            "repeats": F.coalesce("repeats", F.array().cast(_NO_REPEATS)),
        }
    )


def select_evidence(
    tickets: DataFrame, candidates: DataFrame | None, top_k: int = fixed.EVIDENCE_LIMIT, texts: bool = True
) -> DataFrame:
    """Tickets with ``reranked`` candidates, without their texts, and the chosen ``evidence``, with them if wanted."""
    with_candidates = attach_candidates(tickets, candidates)
    fields = with_candidates.schema["candidates"].dataType.elementType.names
    payload = [c for c in PAYLOAD if c in fields and c not in TEXTS]
    chosen = with_candidates.withColumn(
        "reranked", rerank("candidates", "repeats", "queue", "type", "ml_priority", payload)
    ).withColumn("evidence", select_from("reranked", "queue", max_results=top_k))
    return chosen.withColumn("evidence", with_texts("evidence", "candidates", fields)) if texts else chosen


def assess(selected: DataFrame, guardrail: bool = True) -> DataFrame:
    """Add the vote, the recommendation and the confidence."""
    return (
        selected.withColumn("stats", evidence_stats("evidence", "queue"))
        .withColumns(
            {
                "recommended_priority": recommend_priority("stats", "ml_priority", guardrail),
                "confidence_score": confidence_score("stats", "ml_priority"),
            }
        )
        .withColumn("confidence_level", confidence_level("confidence_score"))
    )


def triage_core(
    tickets: DataFrame,
    candidates: DataFrame | None,
    top_k: int = fixed.EVIDENCE_LIMIT,
    guardrail: bool = True,
) -> DataFrame:
    """Priority, confidence and evidence ids per ticket, without any text."""
    assessed = assess(select_evidence(tickets, candidates, top_k, texts=False), guardrail)
    return assessed.select(
        "ticket_id",
        "type",
        "queue",
        "ml_priority",
        "recommended_priority",
        "confidence_score",
        "confidence_level",
        F.col("stats.count").alias("evidence_count"),
        F.col("stats.same_queue_count").alias("same_queue_count"),
        F.col("stats.majority_priority").alias("majority_priority"),
        F.col("stats.avg_distance").alias("avg_distance"),
        F.transform("evidence", lambda e: e["doc_id"]).alias("evidence_ids"),
    )


def _serialized(incidents: str | Column) -> Column:
    return F.transform(incidents, serialize_incident)


def _serialized_raw(candidates: str) -> Column:
    def entry(c: Column) -> Column:
        return serialize_incident(
            F.struct(
                F.lit(None).cast("double").alias("adjusted_score"),
                c["distance"].alias("distance"),
                c["rank"].alias("rank"),
                *[c[f].alias(f) for f in PAYLOAD],
            )
        )

    return F.transform(candidates, entry)


def triage(
    tickets: DataFrame,
    candidates: DataFrame | None,
    top_k: int = fixed.EVIDENCE_LIMIT,
    guardrail: bool = True,
    debug: bool = False,
    decision_text: str | None = None,
    model: PipelineModel | None = None,
) -> DataFrame:
    """The full response per ticket.

    ``tickets`` has (ticket_id, issue, type, queue, query_key) and ``ml_priority``, unless a ``model`` is
    given, which then predicts it from the normalised request; ``candidates`` comes
    from ``retrieve_candidates``, or is None to work without retrieval.  ``decision_text`` names a
    ticket column with generated text; tickets without one get the fallback document.
    """
    row = assess(select_evidence(predicted(tickets, model), candidates, top_k, texts=False), guardrail)
    fallback = fallback_decision(
        "recommended_priority", "ml_priority", "confidence_score", "confidence_level"
    )
    text = F.coalesce(F.col(decision_text), fallback) if decision_text else fallback
    row = row.withColumn("document", text).withColumn("parsed", parse_decision_output("document"))
    row = row.withColumn("evidence", with_texts("evidence", "candidates", PAYLOAD))
    outputs = {
        "input_issue": F.col("issue"),
        "input_type": F.col("type"),
        "input_queue": F.col("queue"),
        "ml_predicted_priority": F.col("ml_priority"),
        "rag_signal_priority": F.col("recommended_priority"),
        "evidence": _serialized("evidence"),
    }
    parsed = row.schema["parsed"].dataType.names
    columns = [
        (outputs.get(c) if c in outputs else F.col(f"parsed.{c}" if c in parsed else c)).alias(c)
        for c in RESPONSE_COLUMNS
    ]
    if debug:
        summary = evidence_summary("stats", "ml_priority")
        prompt = build_prompt(
            "issue",
            "type",
            "queue",
            "ml_priority",
            "recommended_priority",
            "confidence_score",
            "confidence_level",
            summary,
            format_incidents("evidence"),
        )
        columns += [
            _serialized_raw("candidates").alias("raw_retrieved_incidents"),
            _serialized(with_texts("reranked", "candidates", PAYLOAD)).alias("reranked_incidents"),
            _serialized("evidence").alias("deduplicated_incidents"),
            summary.alias("evidence_summary"),
            prompt.alias("prompt"),
        ]
    return row.select("ticket_id", *columns)


def triage_report_text(
    tickets: DataFrame,
    candidates: DataFrame | None,
    top_k: int = fixed.EVIDENCE_LIMIT,
    decision_text: str | None = None,
) -> DataFrame:
    """The decision text alone, under the older rule without the guardrail."""
    if decision_text is None:
        return tickets.select("ticket_id", F.lit(fixed.NO_TEXT_REPORT).alias("decision"))
    return triage(tickets, candidates, top_k, guardrail=False, decision_text=decision_text).select(
        "ticket_id", F.col("raw_decision").alias("decision")
    )


def predicted(tickets: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Normalised tickets with the ``ml_priority`` a model gives them; as they are without a model."""
    if model is None:
        return tickets
    from caseloom.plans.training import predict_priority

    return predict_priority(model, normalize_requests(tickets.drop("ml_priority")))


def predict_and_retrieve(
    tickets: DataFrame, candidates: DataFrame | None, model: PipelineModel | None = None
) -> DataFrame:
    """Predicted priority, query text and retrieved incidents of each ticket."""
    tickets = predicted(tickets, model)
    query = (
        F.lit("") if candidates is None else build_query("issue", "type", "queue")
    )
    return attach_candidates(tickets, candidates).select(
        "ticket_id",
        F.col("issue").alias("issue_description"),
        "type",
        "queue",
        F.col("ml_priority").alias("predicted_priority"),
        _serialized_raw("candidates").alias("retrieved_incidents"),
        query.alias("retrieval_query"),
    )


def to_analysis_result(responses: DataFrame, debug: bool = False) -> DataFrame:
    """Responses as the dashboard reads them."""
    score = rescale_confidence("confidence_score")
    empty = F.array().cast("array<string>")
    columns = [
        F.col("ml_predicted_priority").alias("ml_priority"),
        F.col("recommended_priority"),
        score.alias("confidence_score"),
        confidence_level(score).alias("confidence_label"),
        escalation_text("escalation_recommendation").alias("escalation_decision"),
        F.coalesce("root_cause", F.lit("")).alias("root_cause"),
        F.coalesce("assessment_summary", F.lit("")).alias("priority_reasoning"),
        F.coalesce("action_plan", empty).alias("action_plan"),
        F.coalesce("next_diagnostics", empty).alias("diagnostic_steps"),
        evidence_defaults("evidence").alias("similar_incidents"),
    ]
    if debug:
        trace = F.struct(
            F.col("raw_retrieved_incidents").alias("raw_retrieval"),
            F.col("reranked_incidents").alias("reranked_results"),
            F.col("deduplicated_incidents").alias("deduplicated_results"),
            F.coalesce("prompt", F.lit("")).alias("prompt"),
            F.coalesce("raw_decision", F.lit("")).alias("raw_llm_output"),
        )
    else:
        nothing = F.array().cast(responses.schema["evidence"].dataType)
        trace = F.struct(
            nothing.alias("raw_retrieval"),
            nothing.alias("reranked_results"),
            nothing.alias("deduplicated_results"),
            F.lit("").alias("prompt"),
            F.lit("").alias("raw_llm_output"),
        )
    return responses.select("ticket_id", *columns, trace.alias("debug_trace"))
