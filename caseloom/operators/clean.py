"""Cleaning of training tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import strip

STAGE_COLUMNS = {
    "baseline": (fixed.TEXT_COLUMN, fixed.LABEL_COLUMN),
    "stage2": (fixed.TEXT_COLUMN, fixed.LABEL_COLUMN),
    "stage3": (fixed.TEXT_COLUMN, *fixed.CATEGORY_COLUMNS, fixed.LABEL_COLUMN),
    "stage4": (
        fixed.TEXT_COLUMN,
        *fixed.CATEGORY_COLUMNS,
        *fixed.NUMERIC_COLUMNS,
        fixed.LABEL_COLUMN,
    ),
    "stage5": (fixed.TEXT_COLUMN, *fixed.CATEGORY_COLUMNS, fixed.LABEL_COLUMN),
}


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only ``columns``; a missing one is an analysis error."""
    return df.select(*columns)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=[fixed.TEXT_COLUMN, fixed.LABEL_COLUMN])


def strip_upper(value: Column | str) -> Column:
    return F.upper(strip(value))


def fill_unknown(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit("UNKNOWN"))


def drop_empty_text(df: DataFrame) -> DataFrame:
    return df.filter(F.col(fixed.TEXT_COLUMN) != "")


def coerce_numeric(df: DataFrame, columns: Sequence[str] = fixed.NUMERIC_COLUMNS) -> DataFrame:
    """Read ``columns`` as numbers and drop rows where one of them is not a number."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns}).na.drop(
        subset=list(columns)
    )


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip the text, strip and upper-case the label and categories, naming missing categories."""
    changed = {
        fixed.TEXT_COLUMN: strip(F.col(fixed.TEXT_COLUMN).cast("string")),
        fixed.LABEL_COLUMN: strip_upper(F.col(fixed.LABEL_COLUMN).cast("string")),
    }
    for c in fixed.CATEGORY_COLUMNS:
        if c in columns:
            changed[c] = strip_upper(fill_unknown(F.col(c).cast("string")))
    return df.withColumns(changed)


def clean_tickets(df: DataFrame, stage: str = "stage5", keep: Sequence[str] = ()) -> DataFrame:
    """Training rows of a stage, cleaned in one narrow pass; ``keep`` carries key columns along."""
    columns = STAGE_COLUMNS[stage]
    df = project_columns(df, [*keep, *columns])
    df = drop_empty_text(standardize(drop_missing(df), columns))
    return coerce_numeric(df) if stage == "stage4" else df


def cleaning_counts(df: DataFrame) -> DataFrame:
    """Rows left after each cleaning step, from a single aggregation over the raw rows."""
    present = F.col(fixed.TEXT_COLUMN).isNotNull() & F.col(fixed.LABEL_COLUMN).isNotNull()
    with_text = present & (strip(fixed.TEXT_COLUMN) != "")
    counts = [
        F.count(F.lit(1)).alias("loaded_rows"),
        F.count_if(present).alias("rows_with_text_and_label"),
        F.count_if(with_text).alias("rows_with_nonempty_text"),
    ]
    if set(fixed.NUMERIC_COLUMNS) <= set(df.columns):
        numbers = [F.col(c).try_cast("double") for c in fixed.NUMERIC_COLUMNS]
        numeric = with_text
        for n in numbers:
            numeric = numeric & n.isNotNull() & ~F.isnan(n)
        counts.append(F.count_if(numeric).alias("rows_with_valid_numbers"))
    return df.agg(*counts)


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct texts, types and queues of cleaned rows."""
    columns = [c for c in (fixed.TEXT_COLUMN, *fixed.CATEGORY_COLUMNS) if c in df.columns]
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"distinct_{c}") for c in columns])
