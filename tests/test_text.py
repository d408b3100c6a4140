import re

import pytest
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions import display, render, sections, text

TEXTS = [
    "  Émile\ta - b\n\n c ",
    "\x1c\x85 odd spaces 　",
    "",
    None,
    "Ünïcode ÀÉÎ only é",
    "UPPER_case 42!",
    "日本語",
]


def plain_issue(t):
    return re.sub(r"\s+", " ", t.lower().strip())


def plain_text(t):
    return re.sub(r"[^a-z0-9\s]", "", plain_issue(t)) if t else ""


def test_normalizing_matches_plain_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select(
        "i",
        "t",
        text.normalize_issue_text("t").alias("issue"),
        text.normalize_text("t").alias("norm"),
        text.strip("t").alias("stripped"),
    )
    for r in rows.collect():
        assert r.norm == plain_text(r.t)
        if r.t is not None:
            assert r.issue == plain_issue(r.t)
            assert r.stripped == r.t.strip()


@pytest.mark.parametrize(
    "issue, expected",
    [
        ("Cannot LOG IN", ["login issue", "authentication issue"]),
        (
            "Account lockout",
            ["account lockout", "failed login attempts", "authentication policy"],
        ),
        ("billing", ["payment processing", "billing issue", "payment gateway"]),
        ("slow page", ["performance issue", "timeout", "response delay"]),
        ("rapid", ["api issue", "api performance"]),
        ("feedback", ["database issue", "database load", "connection issue"]),
        ("update", ["deployment regression", "recent change impact", "configuration change"]),
        ("download", ["service outage", "application failure"]),
        ("printer noise", []),
        (None, []),
        (
            "API outage after failed   login",
            [
                "login issue",
                "authentication issue",
                "account lockout",
                "failed login attempts",
                "authentication policy",
                "api issue",
                "api performance",
                "service outage",
                "application failure",
            ],
        ),
    ],
)
def test_signals(spark, issue, expected):
    row = spark.createDataFrame([(issue,)], "t string").select(
        text.extract_issue_signals("t").alias("s")
    )
    assert row.first().s == expected


def test_query_text(spark):
    df = spark.createDataFrame([("No signal", "INCIDENT", "Q"), ("slow", "PROBLEM", "R")], "i string, t string, q string")
    got = [r[0] for r in df.select(text.build_query("i", "t", "q")).collect()]
    assert got[0] == "Issue: No signal\nType: INCIDENT\nQueue: Q\nSignals: none"
    assert got[1].endswith("Signals: performance issue, timeout, response delay")


def test_tags(spark):
    df = spark.createDataFrame([(" a, ,b ,", [" x ", "", "y"]), (None, None)], "s string, l array<string>")
    rows = df.select(text.normalize_tags("s").alias("s"), text.normalize_tag_list("l").alias("l")).collect()
    assert rows[0].s == ["a", "b"] and rows[0].l == ["x", "y"]
    assert rows[1].s == [] and rows[1].l == []


DOCUMENT = """Assessment Summary:
- Recommended Priority: low
- Why: queue agrees

Likely Root Cause:
Sessions break after a change.

Evidence from Similar Incidents:
- first
  - second
not a bullet

Immediate Actions:
Next Diagnostic Checks:
- look

Escalation Recommendation:
- Yes
- Team: Access Team
- Reason: repeats
"""


def test_decision_document(spark):
    df = spark.createDataFrame([(DOCUMENT,), ("nothing here",), (None,)], "t string")
    whole, without, null = [
        r.p for r in df.select(sections.parse_decision_output("t").alias("p")).collect()
    ]
    assert whole.assessment_summary == "- Recommended Priority: low\n- Why: queue agrees"
    assert whole.root_cause == "Sessions break after a change."
    assert whole.evidence_from_similar_incidents == ["first", "second"]
    assert whole.action_plan == [] and whole.next_diagnostics == ["look"]
    assert tuple(whole.escalation_recommendation)[:3] == ("Yes", "Access Team", "repeats")
    assert without.root_cause == "" and null.raw_decision == ""
    assert without.escalation_recommendation.decision == ""


def test_extracting_from_decisions(spark):
    texts = [DOCUMENT, "Escalation Recommendation: - NOTHING", "no match"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        sections.extract_escalation("t").alias("e"),
        sections.extract_recommended_priority("t").alias("p"),
    )
    assert [tuple(r) for r in df.collect()] == [("Yes", "LOW"), ("No", "UNKNOWN"), ("Unknown", "UNKNOWN")]


def test_fallback_parses_back(spark):
    row = spark.range(1).select(
        sections.parse_decision_output(
            render.fallback_decision(F.lit("MEDIUM"), F.lit("HIGH"), F.lit(0.7), F.lit("Medium"))
        ).alias("p")
    ).first().p
    assert row.root_cause == fixed.NO_TEXT_REASON
    assert len(row.action_plan) == 3 and "(HIGH)" in row.action_plan[0]
    assert row.escalation_recommendation.decision == "No"
    assert row.escalation_recommendation.team == ""
    assert "- Confidence Score: 0.7\n" in row.assessment_summary


def test_incident_blocks(spark):
    df = spark.sql(
        """SELECT array(
          named_struct('type', 'INCIDENT', 'queue', 'Q', 'priority', 'LOW', 'distance', 0.5D,
            'adjusted_score', 0.25D, 'tags', array('a', 'b'), 'issue_description', 'text '),
          named_struct('type', null, 'queue', 'Q', 'priority', 'LOW', 'distance', 0.5D,
            'adjusted_score', null, 'tags', array(), 'issue_description', '')) AS c"""
    )
    blocks = df.select(render.format_incidents("c")).first()[0].split("\n\n---\n\n")
    assert blocks[0] == (
        "Incident #1\nType: INCIDENT\nQueue: Q\nPriority: LOW\nDistance: 0.5000\n"
        "Adjusted Score: 0.2500\nTags: a, b\n\nIssue:\ntext"
    )
    assert "Type: N/A" in blocks[1] and "Tags: N/A" in blocks[1]
    assert "Adjusted Score: 0.5000" in blocks[1] and blocks[1].endswith("Issue:")


def test_display(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(85.0,), (0.45,), (nan,), (inf,), (-inf,), (None,)], "s double")
    got = df.select(display.rescale_confidence("s").alias("s")).collect()
    assert [r.s for r in got] == [0.85, 0.45, 0.0, 1.0, 0.0, 0.0]
    pairs = [(0.0, None), (nan, -1.0), (None, None), (-1.0, None), (-3.0, None), (inf, 0.5)]
    df = spark.createDataFrame(pairs, "d double, a double")
    got = df.select(display.evidence_similarity("d", "a").alias("s")).collect()
    assert [r.s for r in got] == [1.0, 0.5, 0.0, 1.0, 0.0, 0.0]
    words = spark.createDataFrame([(" severe ",), ("SEVERE",), ("p1",), ("moderate",), ("x",)], "w string")
    got = words.select(display.priority_level("w"), display.incident_priority_level("w")).collect()
    assert [tuple(r) for r in got] == [
        ("HIGH", "LOW"), ("HIGH", "LOW"), ("HIGH", "HIGH"), ("MEDIUM", "MEDIUM"), ("LOW", "LOW"),
    ]
    assert spark.range(1).select(display.confidence_percent(F.lit(0.705))).first()[0] in ("71%", "70%")


def test_comparing_long_texts_takes_little_memory():
    """The chunks of nine long texts: all substrings of each, for several lengths, would take gigabytes."""
    import random
    import tracemalloc

    from caseloom.functions.similarity import _Comparer

    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(40, 14, -1), k=6)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=4000)) + " 0123456789" * i for i in range(9)]
    texts.append(texts[0][:-20] + " and more")
    comparer = _Comparer(0.88)
    comparer.repeats(["once", "twice"])
    tracemalloc.start()
    repeats = comparer.repeats(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert repeats[0] == [10] and repeats[9] == [1] and not any(repeats[1:9])
    assert peak < 300 * sum(map(len, texts))  # substrings took 10,000 bytes a letter
