"""Text columns made from triage results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import col_of, fill_slots, strip_end


def format_incidents(incidents: Column | str) -> Column:
    """Numbered text blocks of an evidence array."""

    def number(value: Column) -> Column:
        return F.format_string("%.4f", F.coalesce(value, F.lit(0.0)))

    def block(c: Column, at: Column) -> Column:
        def shown(field: str) -> Column:
            return F.coalesce(c[field], F.lit("N/A"))

        tags = F.array_join(F.coalesce(c["tags"], F.array().cast("array<string>")), ", ")
        filled = fill_slots(
            fixed.INCIDENT_FORMAT,
            position=at + 1,
            type=shown("type"),
            queue=shown("queue"),
            priority=shown("priority"),
            distance=number(c["distance"]),
            adjusted_score=number(F.coalesce(c["adjusted_score"], c["distance"])),
            tags=F.coalesce(F.nullif(tags, F.lit("")), F.lit("N/A")),
            issue_description=shown("issue_description"),
        )
        return strip_end(filled)

    return F.array_join(F.transform(col_of(incidents), block), fixed.INCIDENT_SEPARATOR)


def build_prompt(
    issue: Column | str,
    ticket_type: Column | str,
    queue: Column | str,
    predicted: Column | str,
    recommended: Column | str,
    score: Column | str,
    level: Column | str,
    summary: Column | str,
    incidents_text: Column | str,
) -> Column:
    """Prompt for offline generation of decision documents."""
    return fill_slots(
        fixed.PROMPT_FORMAT,
        issue=col_of(issue),
        type=col_of(ticket_type),
        queue=col_of(queue),
        predicted=col_of(predicted),
        recommended=col_of(recommended),
        score=col_of(score),
        level=col_of(level),
        summary=col_of(summary),
        incidents=col_of(incidents_text),
    )


def fallback_decision(
    recommended: Column | str,
    predicted: Column | str,
    score: Column | str,
    level: Column | str,
    reason: Column | None = None,
) -> Column:
    """Decision document for tickets without generated text."""
    return fill_slots(
        fixed.FALLBACK_DECISION_FORMAT,
        recommended=col_of(recommended),
        predicted=col_of(predicted),
        score=col_of(score),
        level=col_of(level),
        reason=F.lit(fixed.NO_TEXT_REASON) if reason is None else reason,
    )
