"""Column expressions over ticket and incident text.

All of them are built from native expressions, so they stay inside the JVM and fuse into whatever
scan or projection they are used in.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed


# All but "a-z 0-9" and blanks.  Java takes some thirty times as long for the same class written as [^a-z0-9 ].
_DROPPED = r"[\x00-\x1f!-/:-`{-\x{10FFFF}]"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(col_of(value), F.lit(fixed.WHITESPACE))


def strip_end(value: Column | str) -> Column:
    return F.rtrim(col_of(value), F.lit(fixed.WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def fill_slots(template: str, **slots: Column) -> Column:
    """Concatenate a text format with its ``{slot}`` columns; null slots read as empty text."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2:
            parts.append(F.coalesce(slots[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def normalize_issue_text(text: Column | str) -> Column:
    """Lower-case, strip, and reduce each white space run to one blank."""
    return F.regexp_replace(strip(F.lower(col_of(text))), fixed.WHITESPACE_RUN, " ")


def normalize_text(text: Column | str) -> Column:
    """``normalize_issue_text`` and then only ``a-z 0-9`` and blanks; null becomes empty."""
    kept = F.regexp_replace(normalize_issue_text(text), _DROPPED, "")
    return F.coalesce(kept, F.lit(""))


def distinct_in_order(values: Column | str) -> Column:
    return F.array_distinct(col_of(values))


def extract_issue_signals(text: Column | str) -> Column:
    """Signals of every rule with a term in the text, in rule order, each once."""
    normal = normalize_issue_text(F.coalesce(col_of(text), F.lit("")))
    return signals_of_normalized(normal)


def signals_of_normalized(normal: Column) -> Column:
    nothing = F.array().cast("array<string>")

    def rule(terms: tuple[str, ...], signals: tuple[str, ...]) -> Column:
        hit = reduce(lambda a, b: a | b, [F.contains(normal, F.lit(t)) for t in terms])
        return F.when(hit, F.array(*map(F.lit, signals))).otherwise(nothing)

    return distinct_in_order(F.concat(*[rule(t, s) for t, s in fixed.SIGNAL_RULES]))


def build_query(issue: Column | str, ticket_type: Column | str, queue: Column | str) -> Column:
    """The four-line retrieval text of a ticket."""
    signals = F.array_join(extract_issue_signals(issue), ", ")
    return fill_slots(
        fixed.QUERY_FORMAT,
        issue=col_of(issue),
        type=col_of(ticket_type),
        queue=col_of(queue),
        signals=F.coalesce(F.nullif(signals, F.lit("")), F.lit("none")),
    )


def normalize_tag_list(tags: Column | str) -> Column:
    """Trimmed, non-empty tags of an array column; null becomes an empty array."""
    cleaned = F.filter(F.transform(col_of(tags), strip), lambda t: t != "")
    return F.coalesce(cleaned, F.array().cast("array<string>"))


def normalize_tags(tags: Column | str) -> Column:
    """Trimmed, non-empty tags of a comma-separated text column."""
    return normalize_tag_list(F.split(col_of(tags), ","))


def manual_ticket_title(ticket_type: Column | str, issue: Column | str) -> Column:
    issue = col_of(issue)
    n = fixed.MANUAL_TITLE_CHARS
    dots = F.when(F.length(issue) > n, F.lit("...")).otherwise(F.lit(""))
    return F.concat(col_of(ticket_type), F.lit(": "), F.substring(issue, 1, n), dots)
