"""Column expressions that take decision documents apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import col_of, strip


def parse_section(text: Column | str, header: str, next_headers: tuple[str, ...]) -> Column:
    """Stripped text between a header and the next line starting with a later header.

    An empty section stays empty, and a section without later headers runs to the end of the text.
    """
    later = "|".join(re.escape(h) for h in next_headers)
    stop = rf"(?=\n(?:{later})|\z)" if next_headers else r"\z"
    found = F.regexp_extract(col_of(text), rf"(?s){re.escape(header)}(.*?){stop}", 1)
    return strip(F.coalesce(found, F.lit("")))


def parse_named_section(text: Column | str, header: str) -> Column:
    at = fixed.SECTION_HEADERS.index(header)
    return parse_section(text, header, fixed.SECTION_HEADERS[at + 1 :])


def parse_bullets(section: Column | str) -> Column:
    """Lines that start with a dash, without the dash."""
    lines = F.transform(F.split(col_of(section), fixed.LINE_BREAK), strip)
    return F.transform(
        F.filter(lines, lambda line: line.startswith("-")),
        lambda line: strip(F.substr(line, F.lit(2))),
    )


def _bullet(bullets: Column, position: int, label: str = "") -> Column:
    line = F.coalesce(F.get(bullets, F.lit(position)), F.lit(""))
    return strip(F.replace(line, F.lit(label), F.lit(""))) if label else line


def escalation_struct(section: Column) -> Column:
    bullets = parse_bullets(section)
    return F.struct(
        _bullet(bullets, 0).alias("decision"),
        _bullet(bullets, 1, "Team:").alias("team"),
        _bullet(bullets, 2, "Reason:").alias("reason"),
        section.alias("raw"),
    )


def parse_decision_output(text: Column | str) -> Column:
    """All parts of a decision document as one struct."""
    text = F.coalesce(col_of(text), F.lit(""))
    summary, cause, evidence, actions, checks, escalation = [
        parse_named_section(text, h) for h in fixed.SECTION_HEADERS
    ]
    return F.struct(
        summary.alias("assessment_summary"),
        cause.alias("root_cause"),
        parse_bullets(evidence).alias("evidence_from_similar_incidents"),
        parse_bullets(actions).alias("action_plan"),
        parse_bullets(checks).alias("next_diagnostics"),
        escalation_struct(escalation).alias("escalation_recommendation"),
        text.alias("raw_decision"),
    )


def extract_escalation(text: Column | str) -> Column:
    """``Yes``, ``No`` or ``Unknown``."""
    found = F.regexp_extract(
        col_of(text), r"(?i)Escalation Recommendation:\s*-\s*(Yes|No)", 1
    )
    return F.coalesce(F.initcap(F.nullif(found, F.lit(""))), F.lit("Unknown"))


def extract_recommended_priority(text: Column | str) -> Column:
    found = F.regexp_extract(
        col_of(text),
        r"(?i)Assessment Summary:\s*- Recommended Priority:\s*(LOW|MEDIUM|HIGH|CRITICAL)",
        1,
    )
    return F.coalesce(F.upper(F.nullif(found, F.lit(""))), F.lit("UNKNOWN"))
