"""The same views and rules as SQL text, written for DuckDB."""

from __future__ import annotations

from caseloom import fixed_values as fixed
from workload import views


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.WHITESPACE)})"


_RUN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in fixed.WHITESPACE) + "]+"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, {lit(_RUN)}, ' ', 'g')"


def norm_issue(x: str) -> str:
    return collapse(strip(f"lower({x})"))


def norm(x: str) -> str:
    return f"coalesce(regexp_replace({norm_issue(x)}, '[^a-z0-9 ]', '', 'g'), '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(fixed.WORD_PATTERN)})"


def signals(x: str) -> str:
    t = norm_issue(x)
    cases = []
    for terms, adds in fixed.SIGNAL_RULES:
        hit = " OR ".join(f"contains({t}, {lit(term)})" for term in terms)
        cases.append(f"CASE WHEN {hit} THEN {lit(', '.join(adds))} END")
    return f"concat_ws(', ', {', '.join(cases)})"


def fill(template: str, **slots: str) -> str:
    import re

    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(f"coalesce(CAST({slots[piece]} AS VARCHAR), '')")
        elif piece:
            parts.append(lit(piece))
    return "(" + " || ".join(parts) + ")"


def section(x: str, header: str) -> str:
    """Text between a header and the next later header at the start of a line."""
    later = fixed.SECTION_HEADERS[fixed.SECTION_HEADERS.index(header) + 1 :]
    rest = f"substr({x}, strpos({x}, {lit(header)}) + {len(header)})"
    if later:
        stops = ", ".join(f"nullif(strpos({rest}, chr(10) || {lit(h)}), 0)" for h in later)
        rest = f"substr({rest}, 1, coalesce(least({stops}) - 1, length({rest})))"
    return f"CASE WHEN strpos({x}, {lit(header)}) = 0 THEN '' ELSE {strip(rest)} END"


def bullets(x: str) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {strip('l')})"
    return (
        f"list_transform(list_filter({lines}, lambda l: starts_with(l, '-')), "
        f"lambda l: {strip('substr(l, 2)')})"
    )


_QUEUE_CASE = " ".join(f"WHEN {lit(e)} THEN {lit(q)}" for e, q in views.QUEUE_OF_EVENT.items())

CTES = {
    "tickets": (
        (),
        f"""SELECT event_id AS ticket_id,
  {text_list(views.ISSUES)}[event_id % 12 + 1] || ' - account ' || user_id AS issue,
  CASE WHEN event_id % 3 = 0 THEN 'PROBLEM' ELSE 'INCIDENT' END AS type,
  CASE event_type {_QUEUE_CASE} ELSE {lit(views.OTHER_QUEUE)} END AS queue,
  ts AS "timestamp",
  CASE WHEN event_id % 7 <= 1 THEN 'HIGH' WHEN event_id % 7 <= 4 THEN 'MEDIUM' ELSE 'LOW' END
    AS ml_priority,
  event_id % (SELECT count(*) FROM embeddings) AS query_key
FROM events""",
    ),
    "raw_tickets": (
        ("tickets",),
        """SELECT ticket_id,
  CASE WHEN ticket_id % 41 = 0 THEN 'bad ' WHEN ticket_id % 47 = 0 THEN '  oh  ' ELSE issue END
    AS issue,
  CASE WHEN ticket_id % 37 = 0 THEN 'QUESTION' WHEN ticket_id % 43 = 0 THEN NULL ELSE type END
    AS type,
  CASE WHEN ticket_id % 53 = 0 THEN 'X' ELSE queue END AS queue
FROM tickets""",
    ),
    "ui_tickets": (
        ("tickets",),
        """SELECT 'INC-' || ticket_id AS id, 'Ticket ' || ticket_id AS title,
  issue AS issue_description,
  ['Incident', ' Problem ', 'Security Incident', 'PROBLEM', 'Service Request'][ticket_id % 5 + 1]
    AS type,
  queue, "timestamp",
  ['Open', 'Investigating', 'Mitigating', 'Escalated to vendor', 'Closed'][ticket_id % 5 + 1]
    AS status,
  lower(queue) AS category
FROM tickets""",
    ),
    "kb": (
        ("kb_all",),
        f"""SELECT doc_id || mark AS doc_id, retrieval_text || more AS retrieval_text, source,
  issue_description || more AS issue_description, resolution, type, queue, priority, tags, embedding
FROM kb_all, (VALUES (0, '', ''), (1, '-copy', ''), (2, '-near', {lit(views.NEAR_WORDS)})) c(n, mark, more)
WHERE embedding IS NOT NULL
  AND (n = 0 OR (n = 1 AND CAST(doc_id AS BIGINT) % 4 = 0) OR (n = 2 AND CAST(doc_id AS BIGINT) % 5 = 1))""",
    ),
    "kb_all": (
        (),
        f"""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.text AS retrieval_text, d.source,
  d.text AS issue_description,
  'Follow the ' || d.source || ' runbook in ' || d.lang AS resolution,
  CASE WHEN e.label % 2 = 0 THEN 'INCIDENT' ELSE 'PROBLEM' END AS type,
  {text_list(views.QUEUES)}[e.label % 4 + 1] AS queue,
  ['HIGH', 'MEDIUM', 'LOW'][d.doc_id % 3 + 1] AS priority,
  [d.lang, d.source] AS tags, e.embedding
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    ),
    "cos_hits": (
        ("kb",),
        """SELECT * FROM (
  SELECT query_id, doc_id, distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
  FROM (SELECT q.vec_id AS query_id, k.doc_id,
      1.0 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))
        / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))
         * sqrt(list_inner_product(CAST(k.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))))
        AS distance
    FROM embeddings q JOIN kb k ON string_split(k.doc_id, '-')[1] <> CAST(q.vec_id AS VARCHAR))
) WHERE rank <= 9""",
    ),
    "l2_hits": (
        ("kb",),
        """SELECT * FROM (
  SELECT query_id, doc_id, distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
  FROM (SELECT q.vec_id AS query_id, k.doc_id,
      power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), 2)
        AS distance
    FROM embeddings q JOIN kb k ON string_split(k.doc_id, '-')[1] <> CAST(q.vec_id AS VARCHAR))
) WHERE rank <= 9""",
    ),
    # Reranked candidates of each ticket, with a key per distinct normalised text.
    "ranked": (
        ("tickets", "kb", "cos_hits", "kb_keys"),
        f"""SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY adjusted_score, distance, rank)
    AS pos
FROM (SELECT t.ticket_id, t.queue AS t_queue, t.ml_priority, h.rank, h.distance,
    h.doc_id, k.queue, k.type, k.priority, k.text_key,
    h.distance
      - CASE WHEN k.queue = t.queue THEN {fixed.QUEUE_BOOST} ELSE 0.0 END::DOUBLE
      - CASE WHEN k.type = t.type THEN {fixed.TYPE_BOOST} ELSE 0.0 END::DOUBLE
      - CASE WHEN k.priority = t.ml_priority THEN {fixed.PRIORITY_BOOST} ELSE 0.0 END::DOUBLE
      AS adjusted_score
  FROM tickets t JOIN cos_hits h ON h.query_id = t.query_key JOIN kb_keys k ON k.doc_id = h.doc_id)""",
    ),
    "kb_keys": (
        ("kb",),
        f"""SELECT doc_id, queue, type, priority,
  CASE WHEN n = '' THEN '#' || doc_id ELSE md5(n) END AS text_key
FROM (SELECT *, {norm("issue_description")} AS n FROM kb)""",
    ),
    # Greedy choice when only equal texts repeat each other: first of each text in the same
    # queue up to the quota, then first of each remaining text up to the limit.
    "first_pass": (
        ("ranked",),
        """SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY pos) AS turn
FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id, text_key ORDER BY pos) AS copy
  FROM ranked WHERE queue = t_queue) WHERE copy = 1
QUALIFY turn <= 2""",
    ),
    "second_pass": (
        ("ranked", "first_pass"),
        """SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY pos) AS turn
FROM (SELECT r.*, row_number() OVER (PARTITION BY r.ticket_id, r.text_key ORDER BY r.pos) AS copy
  FROM ranked r ANTI JOIN first_pass f ON f.ticket_id = r.ticket_id AND f.text_key = r.text_key)
WHERE copy = 1""",
    ),
    "evidence": (
        ("first_pass", "second_pass"),
        """SELECT ticket_id, doc_id, queue, priority, distance, adjusted_score, t_queue, ml_priority,
  turn AS place FROM first_pass
UNION ALL
SELECT s.ticket_id, s.doc_id, s.queue, s.priority, s.distance, s.adjusted_score, s.t_queue,
  s.ml_priority, s.turn + coalesce(f.n, 0) AS place
FROM second_pass s
LEFT JOIN (SELECT ticket_id, count(*) AS n FROM first_pass GROUP BY 1) f USING (ticket_id)
WHERE s.turn + coalesce(f.n, 0) <= 3""",
    ),
    "votes": (
        ("evidence",),
        """SELECT ticket_id, arg_max(priority, n * 100 - first_place) AS majority_priority,
  CAST(max(n) AS BIGINT) AS majority_count,
  string_agg(priority || '=' || n, ', ' ORDER BY first_place) AS priority_counts
FROM (SELECT ticket_id, priority, count(*) AS n, min(place) AS first_place
  FROM evidence GROUP BY 1, 2) GROUP BY 1""",
    ),
    "stats": (
        ("evidence", "votes", "tickets"),
        """SELECT t.ticket_id, t.issue, t.type, t.queue, t.ml_priority, e.n AS evidence_count,
  e.same AS same_queue_count, e.avg_distance, e.strong_high, e.evidence_ids,
  v.majority_priority, v.majority_count, v.priority_counts
FROM tickets t
JOIN (SELECT ticket_id, count(*) AS n, count(*) FILTER (WHERE queue = t_queue) AS same,
    avg(distance) AS avg_distance,
    coalesce(bool_or(priority = 'HIGH' AND distance <= 0.65), false) AS strong_high,
    string_agg(doc_id, ',' ORDER BY place) AS evidence_ids
  FROM evidence GROUP BY 1) e USING (ticket_id)
JOIN votes v USING (ticket_id)""",
    ),
    "assessed": (
        ("stats",),
        """SELECT *, CASE WHEN confidence_score >= 0.75 THEN 'High' WHEN confidence_score >= 0.45
    THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM (SELECT *,
  CASE WHEN ml_priority = 'HIGH' AND majority_priority = 'LOW' AND strong_high THEN 'MEDIUM'
    WHEN majority_count >= 2 AND majority_priority <> 'UNKNOWN' THEN majority_priority
    ELSE ml_priority END AS recommended_priority,
  CASE WHEN majority_count >= 2 AND majority_priority <> 'UNKNOWN' THEN majority_priority
    ELSE ml_priority END AS simple_priority,
  CAST(round(least(1.0,
    CASE WHEN majority_priority = ml_priority THEN 0.30 ELSE 0 END
    + CASE WHEN majority_count >= 2 THEN 0.25 ELSE 0 END
    + CASE WHEN same_queue_count >= 2 THEN 0.25 WHEN same_queue_count = 1 THEN 0.10 ELSE 0 END
    + CASE WHEN avg_distance < 0.65 THEN 0.20 WHEN avg_distance < 0.73 THEN 0.15
        WHEN avg_distance < 0.80 THEN 0.10 ELSE 0 END), 2) AS DOUBLE) AS confidence_score
FROM stats)""",
    ),
    "training_rows": (
        (),
        f"""SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN ' ' || chr(9) || ' '
    ELSE chr(9) || {text_list(views.ISSUES)}[
      CASE WHEN o_orderkey % 3 = 0 THEN level * 4 + o_orderkey % 4 ELSE o_orderkey % 12 END + 1]
      || ' for ' || c_name || ' ' || chr(10) END AS issue_description,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE lower(o_orderstatus) END AS type,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE ' ' || lower(c_mktsegment) END AS queue,
  CASE WHEN o_orderkey % 83 = 0 THEN NULL
    WHEN o_orderkey % 5 = 0 THEN lower(['HIGH', 'MEDIUM', 'LOW'][level + 1]) || ' '
    ELSE ['HIGH', 'MEDIUM', 'LOW'][level + 1] END AS priority,
  CASE WHEN o_orderkey % 53 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 200 AS VARCHAR) END AS text_length,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS VARCHAR) END AS word_count,
  CAST(o_orderkey % 2 AS VARCHAR) AS has_error_keyword,
  CASE WHEN o_orderkey % 61 = 0 THEN 'NaN' ELSE CAST(o_orderkey % 3 % 2 AS VARCHAR) END
    AS has_failure_keyword,
  '0' AS has_urgent_keyword,
  CAST(o_orderkey % 5 % 2 AS VARCHAR) AS has_access_keyword,
  CAST(o_orderkey % 7 % 2 AS VARCHAR) AS has_payment_keyword
FROM (SELECT *, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 0 WHEN o_orderpriority[1] = '3' THEN 1
    ELSE 2 END AS level
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    ),
    "cleaned": (
        ("training_rows",),
        f"""SELECT * FROM (
  SELECT row_id, {strip("issue_description")} AS issue_description,
    upper({strip("coalesce(type, 'UNKNOWN')")}) AS type,
    upper({strip("coalesce(queue, 'UNKNOWN')")}) AS queue,
    upper({strip("priority")}) AS priority,
    {", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in fixed.NUMERIC_COLUMNS)}
  FROM training_rows WHERE issue_description IS NOT NULL AND priority IS NOT NULL)
WHERE issue_description <> ''""",
    ),
    "cleaned_numbers": (
        ("cleaned",),
        "SELECT * FROM cleaned WHERE "
        + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in fixed.NUMERIC_COLUMNS),
    ),
    "predictions": (
        ("cleaned",),
        """SELECT row_id, issue_description, type, queue, priority AS actual_priority,
  CASE WHEN row_id % 4 <> 0 THEN priority WHEN priority = 'HIGH' THEN 'MEDIUM'
    WHEN priority = 'MEDIUM' THEN 'LOW' ELSE 'HIGH' END AS predicted_priority
FROM cleaned""",
    ),
    "class_scores": (
        ("predictions",),
        """SELECT label, hits, support,
  CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS "precision",
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0.0 END AS f1_score
FROM (SELECT label, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(a) AS BIGINT) AS support,
    CAST(sum(p) AS BIGINT) AS predicted
  FROM (SELECT actual_priority AS label,
      CASE WHEN actual_priority = predicted_priority THEN 1 ELSE 0 END AS hit, 1 AS a, 0 AS p
    FROM predictions
    UNION ALL SELECT predicted_priority, 0, 0, 1 FROM predictions) GROUP BY 1)""",
    ),
    "documents_text": (
        (),
        """SELECT ticket_id, 'Assessment Summary:' || chr(10) || '- Recommended Priority: '
  || lower(ml_priority) || chr(10) || '- Confidence Level: Medium' || chr(10) || chr(10)
  || CASE WHEN ticket_id % 5 = 0 THEN '' ELSE 'Likely Root Cause:' || chr(10) END
  || CASE WHEN ticket_id % 4 = 0 THEN '' ELSE 'A change in configuration.' || chr(10) || 'See logs.'
       || chr(10) END
  || chr(10) || 'Evidence from Similar Incidents:' || chr(10) || '- one case' || chr(10)
  || '  - another case' || chr(10) || 'no bullet' || chr(10)
  || 'Immediate Actions:' || chr(10) || '- check case ' || ticket_id || chr(10) || '-   restart'
  || chr(10) || chr(10) || 'Next Diagnostic Checks:' || chr(10)
  || CASE WHEN ticket_id % 3 = 0 THEN '' ELSE '- compare tenants' || chr(10) || '- trace sessions'
       || chr(10) END
  || chr(10) || 'Escalation Recommendation:' || chr(10) || '- '
  || CASE WHEN ticket_id % 2 = 0 THEN 'Yes' WHEN ticket_id % 7 = 0 THEN 'not now' ELSE 'no' END
  || chr(10) || '- Team: Platform Team' || chr(10) || '- Reason: Repeated pattern' || chr(10) AS text
FROM tickets""",
    ),
    "doc_terms": (
        (),
        f"""SELECT doc_id, kept || list_transform(generate_series(1, len(kept) - 1),
    lambda i: kept[i] || ' ' || kept[i + 1]) AS terms
FROM (SELECT doc_id, list_filter({tokens("text")}, lambda t: t NOT IN {in_list(views.STOP_WORDS)}) AS kept
  FROM documents)""",
    ),
    "vocabulary": (
        ("doc_terms",),
        """SELECT term, tf, df FROM (
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df
  FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY 1)
WHERE df >= 2 ORDER BY tf DESC, term LIMIT 20000""",
    ),
}
CTES["documents_text"] = (("tickets",), CTES["documents_text"][1])


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the named views and whatever they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        needs, _ = CTES[name]
        for need in needs:
            add(need)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"
