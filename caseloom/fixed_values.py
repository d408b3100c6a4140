"""Values fixed by the triage rules.

Everything here has to be exactly as it stands for results to be right: scoring constants, label
sets, signal terms, section headers and text formats.  Nothing else in the package repeats them.
"""

# Boosts taken off the distance when a candidate agrees with the ticket.
QUEUE_BOOST = 0.15
TYPE_BOOST = 0.05
PRIORITY_BOOST = 0.03

# Evidence selection.
OVERFETCH_FACTOR = 3
OVERFETCH_FLOOR = 8
EVIDENCE_LIMIT = 3
SAME_QUEUE_QUOTA = 2
NEAR_DUPLICATE_RATIO = 0.88

# A HIGH candidate at or under this distance stops a HIGH -> LOW downgrade.
STRONG_HIGH_DISTANCE = 0.65

# Confidence points.
CONFIDENCE_WITHOUT_EVIDENCE = 0.20
MAJORITY_AGREES_POINTS = 0.30
REPEATED_MAJORITY_POINTS = 0.25
SAME_QUEUE_POINTS = 0.25
ONE_SAME_QUEUE_POINTS = 0.10
DISTANCE_POINTS = ((0.65, 0.20), (0.73, 0.15), (0.80, 0.10))
CONFIDENCE_LEVELS = ((0.75, "High"), (0.45, "Medium"))
LOWEST_CONFIDENCE_LEVEL = "Low"

# Request rules.
TICKET_TYPES = ("INCIDENT", "PROBLEM")
MIN_ISSUE_CHARS = 5
MIN_QUEUE_CHARS = 2

# Training columns.
TEXT_COLUMN = "issue_description"
LABEL_COLUMN = "priority"
CATEGORY_COLUMNS = ("type", "queue")
NUMERIC_COLUMNS = (
    "text_length",
    "word_count",
    "has_error_keyword",
    "has_failure_keyword",
    "has_urgent_keyword",
    "has_access_keyword",
    "has_payment_keyword",
)

# Signal rules in output order: terms looked for as plain substrings, signals they add.
SIGNAL_RULES = (
    (
        ("login", "log in", "password", "auth", "authentication", "signin", "sign in"),
        ("login issue", "authentication issue"),
    ),
    (
        ("locked", "lockout", "failed login", "failed attempts"),
        ("account lockout", "failed login attempts", "authentication policy"),
    ),
    (
        ("payment", "billing", "transaction", "gateway", "subscription"),
        ("payment processing", "billing issue", "payment gateway"),
    ),
    (
        ("timeout", "timed out", "latency", "slow", "delay", "response time"),
        ("performance issue", "timeout", "response delay"),
    ),
    (("api",), ("api issue", "api performance")),
    (
        ("database", "db", "sql", "query", "connection pool"),
        ("database issue", "database load", "connection issue"),
    ),
    (
        ("deployment", "deploy", "release", "update", "code change", "recent change"),
        ("deployment regression", "recent change impact", "configuration change"),
    ),
    (
        ("crash", "down", "outage", "unavailable", "service interruption"),
        ("service outage", "application failure"),
    ),
)

# Section headers of a decision document, in document order.
SECTION_HEADERS = (
    "Assessment Summary:",
    "Likely Root Cause:",
    "Evidence from Similar Incidents:",
    "Immediate Actions:",
    "Next Diagnostic Checks:",
    "Escalation Recommendation:",
)

# Display classes of the dashboard.
HIGH_WORDS = ("P0", "P1", "HIGH", "CRITICAL", "SEVERE")
HIGH_WORDS_IN_LIST = ("P0", "P1", "HIGH", "CRITICAL")
MEDIUM_WORDS = ("P2", "MEDIUM", "MODERATE")
STATUS_CLASSES = ("escalated", "investigating", "mitigating", "open")
MANUAL_TITLE_CHARS = 52

# Columns of the evaluation file, in file order.
EVALUATION_COLUMNS = (
    "name",
    "issue",
    "type",
    "queue",
    "ml_priority",
    "recommended_priority_rule",
    "llm_priority",
    "confidence_score",
    "confidence_level",
    "same_queue_count",
    "num_incidents",
    "same_queue_ratio",
    "escalation",
    "retrieval_query",
)

# Text formats.  {names} are slots.
QUERY_FORMAT = "Issue: {issue}\nType: {type}\nQueue: {queue}\nSignals: {signals}"

EVIDENCE_SUMMARY_FORMAT = (
    "ML Predicted Priority: {predicted}\n"
    "Retrieved Incidents: {count}\n"
    "Queue Match: {matches}/{count}\n"
    "Retrieved Priorities: {priorities}\n"
    "Average Distance: {distance}"
)

INCIDENT_FORMAT = (
    "Incident #{position}\n"
    "Type: {type}\n"
    "Queue: {queue}\n"
    "Priority: {priority}\n"
    "Distance: {distance}\n"
    "Adjusted Score: {adjusted_score}\n"
    "Tags: {tags}\n"
    "\n"
    "Issue:\n"
    "{issue_description}"
)
INCIDENT_SEPARATOR = "\n\n---\n\n"

NO_TEXT_REASON = (
    "OPENAI_API_KEY is not set. ML predicted priority and RAG retrieval are still available; "
    "configure the API key for full LLM-generated triage."
)

FALLBACK_DECISION_FORMAT = """Assessment Summary:
- Recommended Priority: {recommended}
- Confidence Score: {score}
- Confidence Level: {level}
- Why: {reason}

Likely Root Cause:
{reason}

Evidence from Similar Incidents:
- Use the structured evidence list returned by this API (ML + RAG) for similar past incidents.

Immediate Actions:
- Treat ML predicted priority ({predicted}) and recommended priority ({recommended}) as operational signals.
- Review retrieved incident evidence and apply your standard runbooks.
- Set OPENAI_API_KEY (and optionally OPENAI_MODEL) to enable full LLM-generated guidance.

Next Diagnostic Checks:
- Follow queue-specific diagnostics; correlate with recent changes, dependencies, and observability data.

Escalation Recommendation:
- No
- Team:
- Reason: Automated escalation text requires LLM generation; configure OpenAI when ready."""

NO_TEXT_REPORT = (
    "OPENAI_API_KEY is not set; LLM output unavailable. "
    "Set OPENAI_API_KEY (and optionally OPENAI_MODEL) for full generated text."
)

PROMPT_FORMAT = """You are an expert AI operations decision assistant helping an ops team triage and respond to incidents.

A new issue has been reported.

INPUT ISSUE
Issue: {issue}
Type: {type}
Queue: {queue}

SYSTEM ASSESSMENT
ML Predicted Priority: {predicted}
Recommended Priority: {recommended}
Confidence Score: {score}
Confidence Level: {level}

RETRIEVAL EVIDENCE SUMMARY
{summary}

SIMILAR PAST INCIDENTS
{incidents}

Definitions:
- Priority = urgency / severity of the incident
- Confidence = how strongly the system believes its assessment based on evidence quality and signal alignment

Your job:
1. Compare the ML-predicted priority with the retrieved incident patterns.
2. Decide whether the recommended priority is appropriate.
3. Identify the most likely root cause based on repeated evidence.
4. Separate immediate containment steps from deeper diagnostic checks.
5. Recommend escalation only if justified by severity, likely ownership, or repeated historical patterns.

Important rules:
- Do NOT copy or reuse customer-support wording from past tickets.
- Treat past incident "resolutions" as weak evidence unless strongly supported by repeated patterns.
- Focus more on technical patterns in issue descriptions, priorities, queues, and repeated themes.
- If ML prediction and retrieved priorities conflict, explicitly mention that conflict and resolve it.
- Be concise, operational, and actionable.
- Prefer concrete checks like logs, metrics, connection pools, recent deployments, rate limits, query performance, config drift, rollback checks, dependency health, auth policy, lockout thresholds, and session issues when relevant.
- Do not invent teams that do not make sense. Use realistic ownership such as Database Team, Backend Engineering, Platform Engineering, API Team, Authentication Team, Payments Team, Technical Support, etc.
- Use the provided confidence score and confidence level as guidance, but explain them in plain language.

Return your answer in exactly this format:

Assessment Summary:
- Recommended Priority:
- Confidence Score:
- Confidence Level:
- Why:

Likely Root Cause:
...

Evidence from Similar Incidents:
- ...
- ...
- ...

Immediate Actions:
- ...
- ...
- ...

Next Diagnostic Checks:
- ...
- ...
- ...

Escalation Recommendation:
- Yes/No
- Team:
- Reason:"""

# Characters the text rules treat as white space, and the same as Java patterns.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"

# A word: two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
