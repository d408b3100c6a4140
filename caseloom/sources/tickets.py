"""Ticket files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.clean import STAGE_COLUMNS, project_columns

# Texts a ticket file uses for a missing value.
MISSING_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_tickets_csv(
    spark: SparkSession, path: str, stage: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Tickets of a CSV file or folder, all columns as text, missing values as null.

    A ``stage`` narrows to its columns and fails on a missing one.  Quoted line breaks need
    ``multi_line``, which reads each file in one task: keep large tables in many files, or turn it
    off when no text holds a line break.
    """
    raw = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).csv(path)
    if stage is not None:
        raw = project_columns(raw, STAGE_COLUMNS[stage])
    return raw.select(
        *[F.when(~F.col(c).isin(*MISSING_VALUES), F.col(c)).alias(c) for c in raw.columns]
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and column names."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write flat rows as CSV; arrays become comma-separated text."""
    arrays = {c for c, kind in df.dtypes if kind.startswith("array")}
    flat = df.select(*[F.array_join(c, ", ").alias(c) if c in arrays else c for c in df.columns])
    flat.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
