"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions import display, text
from caseloom.operators import clean, ranking, requests
from caseloom.operators.retrieval import matching_incidents, retrieved_incidents
from caseloom.sources.knowledge_base import flatten_kb_metadata
from workload import sql as S
from workload import views as V
from workload.registry import query
from workload.source_queries import KB_FIELDS, KB_SQL

NUMBERS = ", ".join(fixed.NUMERIC_COLUMNS)


@query(
    "b1_project_columns",
    "SELECT row_id, issue_description, type, queue, priority FROM training_rows",
    ("training_rows",),
)
def project_columns(spark, sf_dir):
    rows = V.training_rows(spark, sf_dir)
    return clean.project_columns(rows, ["row_id", *clean.STAGE_COLUMNS["stage3"]])


@query(
    "b2_drop_missing",
    """SELECT row_id, issue_description, priority FROM training_rows
WHERE issue_description IS NOT NULL AND priority IS NOT NULL""",
    ("training_rows",),
)
def drop_missing(spark, sf_dir):
    rows = clean.drop_missing(V.training_rows(spark, sf_dir))
    return rows.select("row_id", "issue_description", "priority")


@query(
    "b3_strip_upper",
    f"""SELECT row_id, {S.strip("issue_description")} AS issue_description,
  upper({S.strip("priority")}) AS priority, upper({S.strip("queue")}) AS queue FROM training_rows""",
    ("training_rows",),
)
def strip_upper(spark, sf_dir):
    return V.training_rows(spark, sf_dir).select(
        "row_id",
        text.strip("issue_description").alias("issue_description"),
        clean.strip_upper("priority").alias("priority"),
        clean.strip_upper("queue").alias("queue"),
    )


@query(
    "b4_fill_unknown",
    """SELECT row_id, coalesce(type, 'UNKNOWN') AS type, coalesce(queue, 'UNKNOWN') AS queue
FROM training_rows""",
    ("training_rows",),
)
def fill_unknown(spark, sf_dir):
    return V.training_rows(spark, sf_dir).select(
        "row_id",
        clean.fill_unknown("type").alias("type"),
        clean.fill_unknown("queue").alias("queue"),
    )


@query(
    "b5_drop_empty_text",
    f"""SELECT row_id, {S.strip("issue_description")} AS issue_description FROM training_rows
WHERE {S.strip("issue_description")} <> ''""",
    ("training_rows",),
)
def drop_empty_text(spark, sf_dir):
    rows = V.training_rows(spark, sf_dir).select(
        "row_id", text.strip("issue_description").alias("issue_description")
    )
    return clean.drop_empty_text(rows)


@query(
    "b6_coerce_numeric",
    f"""SELECT row_id, {NUMBERS} FROM (
  SELECT row_id, {", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in fixed.NUMERIC_COLUMNS)}
  FROM training_rows)
WHERE {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in fixed.NUMERIC_COLUMNS)}""",
    ("training_rows",),
)
def coerce_numeric(spark, sf_dir):
    rows = clean.coerce_numeric(V.training_rows(spark, sf_dir))
    return rows.select("row_id", *fixed.NUMERIC_COLUMNS)


def _clean_query(stage: str, columns: str, view: str):
    @query(f"b7_clean_tickets_{stage}", f"SELECT row_id, {columns} FROM {view}", (view,))
    def run(spark, sf_dir):
        return clean.clean_tickets(V.training_rows(spark, sf_dir), stage, keep=["row_id"])

    return run


_clean_query("baseline", "issue_description, priority", "cleaned")
_clean_query("stage2", "issue_description, priority", "cleaned")
_clean_query("stage3", "issue_description, type, queue, priority", "cleaned")
_clean_query("stage4", f"issue_description, type, queue, {NUMBERS}, priority", "cleaned_numbers")
_clean_query("stage5", "issue_description, type, queue, priority", "cleaned")


@query("b8_flatten_kb_metadata", KB_SQL, ("kb_all",))
def flatten_metadata(spark, sf_dir):
    return flatten_kb_metadata(V.all_incidents(spark, sf_dir)).select(*KB_FIELDS)


@query(
    "b9_filter_metadata",
    """SELECT t.ticket_id, (SELECT count(*) FROM kb_all k
    WHERE (t.ticket_id % 3 = 0 OR k.queue = t.queue) AND (t.ticket_id % 4 = 0 OR k.type = t.type)) AS incidents
FROM tickets t""",
    ("tickets", "kb_all"),
)
def filter_metadata(spark, sf_dir):
    """Incidents a ticket's queue and type filters leave to search in; some tickets leave one open."""
    key = F.col("ticket_id")
    tickets = V.tickets(spark, sf_dir).select(
        "ticket_id",
        F.when(key % 3 != 0, F.col("queue")).alias("queue"),
        F.when(key % 4 != 0, F.col("type")).otherwise("").alias("type"),
    )
    found = matching_incidents(tickets, V.all_incidents(spark, sf_dir), ["queue", "type"])
    return found.select("ticket_id", "incidents")


REJECT_SQL = f"""SELECT ticket_id, issue, type, queue,
  CASE WHEN issue IS NULL OR length(issue) < 5 THEN 'issue too short'
    WHEN type IS NULL OR type NOT IN ('INCIDENT', 'PROBLEM') THEN 'unknown type'
    WHEN queue IS NULL OR length(queue) < 2 THEN 'queue too short' END AS reject_reason
FROM raw_tickets"""
TRIMMED_SQL = REJECT_SQL.replace("length(issue)", f"length({S.strip('issue')})")


@query(
    "b10_validate_tickets",
    f"SELECT ticket_id, issue, type, queue FROM ({REJECT_SQL}) WHERE reject_reason IS NULL",
    ("raw_tickets",),
)
def validate_tickets(spark, sf_dir):
    return requests.valid_tickets(V.raw_tickets(spark, sf_dir))


@query(
    "b10_rejected_tickets",
    f"SELECT * FROM ({REJECT_SQL}) WHERE reject_reason IS NOT NULL",
    ("raw_tickets",),
)
def rejected_tickets(spark, sf_dir):
    return requests.rejected_tickets(V.raw_tickets(spark, sf_dir))


@query(
    "b10_rejected_form_entries",
    f"SELECT * FROM ({TRIMMED_SQL}) WHERE reject_reason IS NOT NULL",
    ("raw_tickets",),
)
def rejected_form_entries(spark, sf_dir):
    return requests.rejected_tickets(V.raw_tickets(spark, sf_dir), trimmed=True)


TYPE_SQL = (
    f"CASE WHEN lower({S.strip('type')}) = 'problem' THEN 'PROBLEM' ELSE 'INCIDENT' END AS type"
)


@query("b11_map_ticket_type", f"SELECT id, {TYPE_SQL} FROM ui_tickets", ("ui_tickets",))
def map_ticket_type(spark, sf_dir):
    return V.ui_tickets(spark, sf_dir).select("id", display.map_ticket_type("type").alias("type"))


@query(
    "b12_ticket_to_request",
    f"SELECT id AS ticket_id, issue_description AS issue, {TYPE_SQL}, queue FROM ui_tickets",
    ("ui_tickets",),
)
def ticket_to_request(spark, sf_dir):
    return requests.ticket_to_request(V.ui_tickets(spark, sf_dir))


@query(
    "b13_serialize_incident",
    """SELECT h.query_id, h.doc_id, k.type, k.queue, k.priority, round(h.distance, 6) AS distance,
  round(h.distance, 6) AS adjusted_score, array_to_string(k.tags, '|') AS tags,
  k.issue_description, k.resolution, CAST(h.rank AS INTEGER) AS rank
FROM cos_hits h JOIN kb k USING (doc_id) WHERE h.rank <= 3""",
    ("cos_hits",),
)
def serialize_incident(spark, sf_dir):
    hits = V.hits(spark, sf_dir, 3)
    found = retrieved_incidents(hits, V.knowledge_base(spark, sf_dir)).select(
        "query_id",
        F.struct("*", F.lit(None).cast("double").alias("adjusted_score")).alias("incident"),
    )
    return (
        found.select("query_id", ranking.serialize_incident(F.col("incident")).alias("s"))
        .select("query_id", "s.*")
        .drop("retrieval_text")
        .withColumns(
            {
                "distance": F.round("distance", 6),
                "adjusted_score": F.round("adjusted_score", 6),
                "tags": F.array_join("tags", "|"),
            }
        )
    )
