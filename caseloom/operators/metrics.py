"""Label statistics and classification metrics.

Predictions are counted once per (actual, predicted) pair with map-side combining; every metric is
then arithmetic on that small table, so even a single dominant label costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import fixed_values as fixed

LABELS = ("HIGH", "LOW", "MEDIUM")


def label_counts(df: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), label)
    )


def label_percent(df: DataFrame, label: str = fixed.LABEL_COLUMN) -> DataFrame:
    """Share of each label in percent.  The window runs over one row per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.select(label, F.round(F.col("count") * 100.0 / total, 2).alias("percent"))


def score_predictions(df: DataFrame) -> DataFrame:
    """Add ``correct``."""
    return df.withColumn("correct", F.col("actual_priority") == F.col("predicted_priority"))


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual_priority", "predicted_priority").agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    hit = (F.col("actual_priority") == F.col("predicted_priority")).cast("int")
    return predictions.agg(F.avg(hit).alias("accuracy"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every actual or predicted label."""
    n = F.col("n")
    hit = F.col("actual_priority") == F.col("predicted_priority")
    both_sides = F.array(
        F.struct(
            F.col("actual_priority").alias("label"),
            F.when(hit, n).otherwise(0).alias("hits"),
            n.alias("actual"),
            F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("predicted_priority").alias("label"),
            F.lit(0).cast("bigint").alias("hits"),
            F.lit(0).cast("bigint").alias("actual"),
            n.alias("predicted"),
        ),
    )
    totals = (
        prediction_counts(predictions)
        .select(F.inline(both_sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "actual", "predicted")])
    )
    return totals.select(
        "label",
        "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("actual") + F.col("predicted")).alias("f1_score"),
        F.col("actual").alias("support"),
    )


def _weighted(column: str) -> Column:
    return _ratio(F.sum(F.col(column) * F.col("support")), F.sum("support"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    return class_scores(predictions).agg(F.avg("f1_score").alias("macro_f1"))


def weighted_f1(predictions: DataFrame) -> DataFrame:
    return class_scores(predictions).agg(_weighted("f1_score").alias("weighted_f1"))


def metrics_record(predictions: DataFrame, model: str | None = None) -> DataFrame:
    """The one-row metrics summary."""
    actual = F.when(F.col("support") > 0, F.col("label"))
    record = class_scores(predictions).agg(
        F.round(_ratio(F.sum("hits"), F.sum("support")), 4).alias("accuracy"),
        F.round(F.avg("f1_score"), 4).alias("macro_f1"),
        F.round(_weighted("f1_score"), 4).alias("weighted_f1"),
        F.sum("support").alias("test_size"),
        F.array_sort(F.collect_list(actual)).alias("labels"),
    )
    return record.withColumn("model", F.lit(model)) if model else record


def confusion_counts(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """The matrix in long form, zeros included: (actual_priority, predicted_priority, n).

    Labels are those of ``labels`` and of either side, as many as there are; a label without an actual row stands on
    the actual side only if it is in ``labels``.  Nothing runs before the result is asked for.
    """
    counts = prediction_counts(predictions).filter(
        "actual_priority IS NOT NULL AND predicted_priority IS NOT NULL"
    )
    given = F.array(*map(F.lit, labels)).cast("array<string>")
    seen = counts.agg(
        F.collect_set("actual_priority").alias("down"), F.collect_set("predicted_priority").alias("across")
    )
    down = F.array_sort(F.array_union(given, F.col("down")))
    across = F.array_sort(F.array_union(F.array_union(given, F.col("down")), F.col("across")))
    lines = seen.select(across.alias("across"), F.explode(down).alias("actual_priority"))
    cells = lines.select("actual_priority", F.explode("across").alias("predicted_priority"))
    counted = cells.join(counts, ["actual_priority", "predicted_priority"], "left")
    return counted.select(
        "actual_priority", "predicted_priority", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_matrix(predictions: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Actual labels down, predicted labels across, both in sorted order.

    Down go the labels that occur, across those and what else was predicted, so no row is left out;
    ``labels`` stand on both sides, as zeros where absent.  A table needs to know its columns, so this form counts
    at once, one row per pair of labels, and gathers those; ``confusion_counts`` is the form that waits.
    """
    n = {(r[0], r[1]): r[2] for r in prediction_counts(predictions).collect()}
    down = sorted({*labels, *(a for a, _ in n if a is not None)})
    across = sorted({*down, *(p for _, p in n if p is not None)})
    rows = [(a, *(n.get((a, p), 0) for p in across)) for a in down]
    fields = [T.StructField("actual_priority", T.StringType()), *(T.StructField(p, T.LongType()) for p in across)]
    return predictions.sparkSession.createDataFrame(rows, T.StructType(fields))


def classification_report(predictions: DataFrame) -> DataFrame:
    """One row per class, then accuracy, macro and weighted averages.

    A rollup gives classes and totals from the same pass over the class scores.
    """
    per_class = class_scores(predictions)
    scores = ("precision", "recall", "f1_score")
    rolled = per_class.rollup("label").agg(
        F.grouping("label").alias("is_total"),
        F.sum("hits").alias("hits"),
        F.sum("support").alias("support"),
        *[F.avg(c).alias(c) for c in scores],
        *[_weighted(c).alias(f"weighted_{c}") for c in scores],
    )

    def line(name: Column, order: int, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(order).alias("section"),
            name.alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            F.col("support").alias("support"),
        )

    none = F.lit(None).cast("double")
    class_line = line(F.col("label"), 0, *map(F.col, scores))
    total_lines = F.array(
        line(F.lit("accuracy"), 1, none, none, _ratio(F.col("hits"), F.col("support"))),
        line(F.lit("macro avg"), 2, *map(F.col, scores)),
        line(F.lit("weighted avg"), 3, *[F.col(f"weighted_{c}") for c in scores]),
    )
    lines = F.when(F.col("is_total") == 0, F.array(class_line)).otherwise(total_lines)
    return rolled.select(F.inline(lines)).orderBy("section", "label")


def report_text(report: DataFrame) -> DataFrame:
    """The report as one text value; it has one line per class plus three."""

    def number(c: str) -> Column:
        return F.coalesce(F.format_string("%.2f", F.col(c)), F.lit(""))

    cells = [F.lpad("label", 12, " "), F.lit(" ")]
    for c in (number("precision"), number("recall"), number("f1_score"), F.col("support").cast("string")):
        cells += [F.lit(" "), F.lpad(c, 9, " ")]
    line = F.concat(*cells, F.lit("\n"))
    gap = F.when(F.col("section") == 1, F.lit("\n")).otherwise(F.lit(""))
    lines = report.select("section", "label", F.concat(gap, line).alias("line"))
    header = " " * 13 + "".join(f" {h:>9}" for h in ("precision", "recall", "f1-score", "support"))
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section", "label", "line"))), lambda r: r["line"]
        ),
        "",
    )
    return lines.agg(F.concat(F.lit(header + "\n\n"), body).alias("value"))


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Totals over evaluated cases; averages are 0 when there are none."""

    def mean(c: str) -> Column:
        return F.coalesce(F.round(F.avg(c), 2), F.lit(0.0))

    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("ml_priority") != F.col("recommended_priority_rule")).alias(
            "priority_conflicts"
        ),
        F.count_if(F.col("escalation") == "Yes").alias("cases_escalated"),
        mean("confidence_score").alias("average_confidence"),
        mean("same_queue_ratio").alias("average_same_queue_ratio"),
    )
