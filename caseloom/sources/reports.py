"""Evaluation outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators.clean import STAGE_COLUMNS
from caseloom.operators.metrics import (
    LABELS,
    classification_report,
    confusion_matrix,
    metrics_record,
    report_text,
    score_predictions,
)
from caseloom.sources.tickets import write_csv


def write_metrics_json(predictions: DataFrame, path: str, model: str | None = None) -> None:
    metrics_record(predictions, model).write.mode("overwrite").json(path)


def write_classification_report(predictions: DataFrame, path: str) -> None:
    """``<path>_json`` with one record per line of the report and ``<path>_txt`` with its text."""
    report = classification_report(predictions)
    report.write.mode("overwrite").json(f"{path}_json")
    report_text(report).write.mode("overwrite").text(f"{path}_txt")


def write_confusion_csv(predictions: DataFrame, path: str, labels=LABELS) -> None:
    write_csv(confusion_matrix(predictions, labels), path)


def prediction_rows(predictions: DataFrame, stage: str = "stage5") -> DataFrame:
    """Features, actual, predicted, correct; the text-only stages keep the text alone."""
    results = ("actual_priority", "predicted_priority", "correct")
    if stage in ("baseline", "stage2"):
        features = [fixed.TEXT_COLUMN]
    else:
        features = [c for c in STAGE_COLUMNS[stage] if c != fixed.LABEL_COLUMN]
    return score_predictions(predictions).select(*features, *results)


def write_predictions_csv(predictions: DataFrame, path: str, stage: str = "stage5") -> None:
    write_csv(prediction_rows(predictions, stage), path)


def misclassified(predictions: DataFrame, stage: str = "stage5") -> DataFrame:
    return prediction_rows(predictions, stage).filter(~F.col("correct"))


def write_misclassified_csv(predictions: DataFrame, path: str, stage: str = "stage5") -> None:
    write_csv(misclassified(predictions, stage), path)


def write_evaluation_csv(cases: DataFrame, path: str) -> bool:
    """Write the evaluated cases; without any, nothing is written and the answer is False."""
    rows = cases.select(*fixed.EVALUATION_COLUMNS)
    if rows.isEmpty():
        return False
    write_csv(rows, path)
    return True
