"""Scans and sinks.  Sinks are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators.metrics import LABELS
from caseloom.session import fresh_path
from caseloom.sources import knowledge_base, reports, tickets
from workload import sql as S
from workload import views as V
from workload.registry import query

TEXTS = "issue_description, type, queue"


def _read_csv(spark, path):
    return spark.read.options(**tickets.CSV_OPTIONS).option("multiLine", True).csv(path)


@query(
    "a1_scan_tickets_csv",
    "SELECT row_id, issue_description, type, queue, priority FROM training_rows",
    ("training_rows",),
)
def scan_tickets_csv(spark, sf_dir):
    path = fresh_path(spark, "tickets-csv")
    tickets.write_csv(V.training_rows(spark, sf_dir), path)
    scanned = tickets.read_tickets_csv(spark, path)
    return scanned.select(
        F.col("row_id").cast("bigint"), "issue_description", "type", "queue", "priority"
    )


@query(
    "a1_ticket_table_shape",
    """SELECT count(*) AS n_rows, 4 AS n_columns,
  'issue_description, type, queue, priority' AS column_names FROM training_rows""",
    ("training_rows",),
)
def ticket_table_shape(spark, sf_dir):
    path = fresh_path(spark, "tickets-csv")
    tickets.write_csv(V.training_rows(spark, sf_dir), path)
    return tickets.table_shape(tickets.read_tickets_csv(spark, path, "stage3"))


KB_SQL = """SELECT doc_id, source, issue_description, resolution, type, coalesce(queue, '') AS queue, priority,
  array_to_string(tags, ', ') AS tags FROM kb_all"""
KB_FIELDS = (
    "doc_id", "source", "issue_description", "resolution", "type", "queue", "priority", "tags",
)


@query("a2_scan_kb_jsonl", KB_SQL, ("kb_all",))
def scan_kb_jsonl(spark, sf_dir):
    path = fresh_path(spark, "kb-jsonl")
    V.all_incidents(spark, sf_dir).drop("embedding").write.json(path)
    records = knowledge_base.read_kb_jsonl(spark, path)
    return knowledge_base.flatten_kb_metadata(records).select(*KB_FIELDS)


def _written_memory(spark, sf_dir):
    path = fresh_path(spark, "incident-memory")
    flat = knowledge_base.flatten_kb_metadata(V.all_incidents(spark, sf_dir))
    knowledge_base.write_incident_memory(flat, path)
    return path


@query(
    "a3_scan_incident_memory",
    """SELECT coalesce(queue, '') AS queue, type, count(*) AS incidents, CAST(sum(len(tags)) AS BIGINT) AS tags
FROM kb_all GROUP BY 1, 2""",
    ("kb_all",),
)
def scan_incident_memory(spark, sf_dir):
    memory = knowledge_base.open_incident_memory(spark, _written_memory(spark, sf_dir))
    return memory.groupBy("queue", "type").agg(
        F.count(F.lit(1)).alias("incidents"), F.sum(F.size("tags")).alias("tags")
    )


@query(
    "a4_verify_incident_memory",
    """SELECT true AS table_exists, count(*) AS n_rows,
  count(*) FILTER (WHERE embedding IS NULL) AS n_null_vectors,
  CAST(min(len(embedding)) AS INTEGER) AS dim_min, CAST(max(len(embedding)) AS INTEGER) AS dim_max,
  least(count(embedding), 1) AS probe_hits FROM kb_all""",
    ("kb_all",),
)
def verify_incident_memory(spark, sf_dir):
    memory = knowledge_base.open_incident_memory(spark, _written_memory(spark, sf_dir))
    return knowledge_base.verify_incident_memory(memory)


@query(
    "a4_check_incident_memory",
    """SELECT * FROM (VALUES ('missing', false, 'no incident table'), ('empty', false, 'no incidents'),
  ('present', true, 'ok')) c(name, valid, reason) WHERE (SELECT count(embedding) FROM kb_all) > 0""",
    ("kb_all",),
)
def check_incident_memory(spark, sf_dir):
    """The answer for a table that is there, one without rows and one that is missing."""
    path = _written_memory(spark, sf_dir)
    empty = fresh_path(spark, "incident-memory-empty")
    spark.read.parquet(path).limit(0).write.parquet(empty)
    places = {"present": path, "empty": empty, "missing": fresh_path(spark, "no-incident-memory")}
    rows = [knowledge_base.check_incident_memory(spark, p).withColumn("name", F.lit(n)) for n, p in places.items()]
    return rows[0].union(rows[1]).union(rows[2]).select("name", "valid", "reason")


@query("a5_write_incident_memory", KB_SQL, ("kb_all",))
def write_incident_memory(spark, sf_dir):
    return spark.read.parquet(_written_memory(spark, sf_dir)).select(*KB_FIELDS)


@query("a5_publish_incident_memory", KB_SQL, ("kb_all",))
def publish_incident_memory(spark, sf_dir):
    """Published twice, the second time with everything; in between a version without vectors is refused."""
    rows, path = spark.read.parquet(_written_memory(spark, sf_dir)), fresh_path(spark, "published-memory")
    knowledge_base.publish_incident_memory(rows.filter("embedding IS NOT NULL"), path)
    try:
        knowledge_base.publish_incident_memory(rows.filter("embedding IS NULL"), path)
    except ValueError:
        knowledge_base.publish_incident_memory(rows, path)
    memory = knowledge_base.open_incident_memory(spark, path)
    return memory.withColumn("tags", F.array_join("tags", ", ")).select(*KB_FIELDS)


METRICS_SQL = """SELECT round(sum(hits) / sum(support), 4) AS accuracy,
  round(avg(f1_score), 4) AS macro_f1,
  round(sum(f1_score * support) / sum(support), 4) AS weighted_f1,
  CAST(sum(support) AS BIGINT) AS test_size,
  string_agg(label, ', ' ORDER BY label) FILTER (WHERE support > 0) AS labels{model}
FROM class_scores"""


@query(
    "a6_write_metrics_json",
    METRICS_SQL.format(model=", 'LinearSVC' AS model"),
    ("class_scores",),
)
def write_metrics_json(spark, sf_dir):
    path = fresh_path(spark, "metrics")
    reports.write_metrics_json(V.predictions(spark, sf_dir), path, "LinearSVC")
    kinds = (
        "accuracy double, macro_f1 double, weighted_f1 double, test_size bigint, "
        "labels array<string>, model string"
    )
    return spark.read.schema(kinds).json(path).withColumn("labels", F.array_join("labels", ", "))


REPORT_SQL = """SELECT section, label, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM (
  SELECT 0 AS section, label, "precision", recall, f1_score, support FROM class_scores
  UNION ALL SELECT 1, 'accuracy', NULL, NULL, sum(hits) / sum(support),
    CAST(sum(support) AS BIGINT) FROM class_scores
  UNION ALL SELECT 2, 'macro avg', avg("precision"), avg(recall), avg(f1_score),
    CAST(sum(support) AS BIGINT) FROM class_scores
  UNION ALL SELECT 3, 'weighted avg', sum("precision" * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
    CAST(sum(support) AS BIGINT) FROM class_scores)"""


def rounded_report(report):
    return report.select(
        "section",
        "label",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
        "support",
    )


@query("a7_write_classification_report", REPORT_SQL, ("class_scores",))
def write_classification_report(spark, sf_dir):
    path = fresh_path(spark, "report")
    reports.write_classification_report(V.predictions(spark, sf_dir), path)
    kinds = (
        "section int, label string, precision double, recall double, f1_score double, support bigint"
    )
    return rounded_report(spark.read.schema(kinds).json(f"{path}_json"))


CONFUSION_SQL = "SELECT actual_priority, " + ", ".join(
    f"count(*) FILTER (WHERE predicted_priority = '{p}') AS \"{p}\"" for p in sorted(LABELS)
) + " FROM predictions GROUP BY actual_priority"


@query("a8_write_confusion_csv", CONFUSION_SQL, ("predictions",))
def write_confusion_csv(spark, sf_dir):
    path = fresh_path(spark, "confusion")
    reports.write_confusion_csv(V.predictions(spark, sf_dir), path)
    kinds = "actual_priority string, " + ", ".join(f"{p} bigint" for p in sorted(LABELS))
    return spark.read.schema(kinds).option("header", True).csv(path)


@query(
    "a9_write_predictions_csv",
    f"""SELECT {TEXTS}, actual_priority, predicted_priority,
  actual_priority = predicted_priority AS correct FROM predictions""",
    ("predictions",),
)
def write_predictions_csv(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    reports.write_predictions_csv(V.predictions(spark, sf_dir), path)
    return _read_csv(spark, path).withColumn("correct", F.col("correct").cast("boolean"))


@query(
    "a9_write_predictions_csv_text_only",
    """SELECT issue_description, actual_priority, predicted_priority,
  actual_priority = predicted_priority AS correct FROM predictions""",
    ("predictions",),
)
def write_predictions_csv_text_only(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    reports.write_predictions_csv(V.predictions(spark, sf_dir), path, "baseline")
    return _read_csv(spark, path).withColumn("correct", F.col("correct").cast("boolean"))


@query(
    "a10_write_misclassified_csv",
    f"""SELECT {TEXTS}, actual_priority, predicted_priority, false AS correct
FROM predictions WHERE actual_priority <> predicted_priority""",
    ("predictions",),
)
def write_misclassified_csv(spark, sf_dir):
    path = fresh_path(spark, "misclassified")
    reports.write_misclassified_csv(V.predictions(spark, sf_dir), path)
    return _read_csv(spark, path).withColumn("correct", F.col("correct").cast("boolean"))


def evaluation_sql(query_text: str) -> str:
    return f"""SELECT 'case ' || ticket_id AS name, issue, type, queue, ml_priority,
  simple_priority AS recommended_priority_rule, upper(ml_priority) AS llm_priority,
  confidence_score, confidence_level, CAST(same_queue_count AS INTEGER) AS same_queue_count,
  CAST(evidence_count AS INTEGER) AS num_incidents,
  round(same_queue_count / greatest(evidence_count, 1), 2) AS same_queue_ratio,
  CASE WHEN ticket_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS escalation,
  {query_text} AS retrieval_query
FROM assessed"""


def query_text_sql() -> str:
    return S.fill(
        fixed.QUERY_FORMAT,
        issue="issue",
        type="type",
        queue="queue",
        signals=f"coalesce(nullif({S.signals('issue')}, ''), 'none')",
    )


@query("a12_write_evaluation_csv", evaluation_sql(query_text_sql()), ("assessed",))
def write_evaluation_csv(spark, sf_dir):
    from workload.decision_queries import evaluated_cases

    path = fresh_path(spark, "evaluation")
    reports.write_evaluation_csv(evaluated_cases(spark, sf_dir, threshold=1.0), path)
    kinds = {
        "confidence_score": "double",
        "same_queue_count": "int",
        "num_incidents": "int",
        "same_queue_ratio": "double",
    }
    rows = _read_csv(spark, path)
    return rows.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
