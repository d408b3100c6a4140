"""Label statistics, metrics, features and models."""

from __future__ import annotations


from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators import clean, features, metrics
from caseloom.plans import training
from caseloom.session import fresh_path, written
from caseloom.sources import models
from workload import sql as S
from workload import views as V
from workload.registry import query
from workload.source_queries import CONFUSION_SQL, METRICS_SQL, REPORT_SQL, rounded_report

# --- E: label statistics and metrics


def cleaned(spark, sf_dir, stage="stage3"):
    return clean.clean_tickets(V.training_rows(spark, sf_dir), stage, keep=["row_id"])


@query(
    "e1_label_counts",
    """SELECT priority, count(*) AS "count" FROM cleaned GROUP BY priority
ORDER BY "count" DESC, priority""",
    ("cleaned",),
)
def label_counts(spark, sf_dir):
    return metrics.label_counts(cleaned(spark, sf_dir))


@query(
    "e2_label_percent",
    """SELECT priority, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent
FROM cleaned GROUP BY priority""",
    ("cleaned",),
)
def label_percent(spark, sf_dir):
    return metrics.label_percent(cleaned(spark, sf_dir))


@query(
    "e3_distinct_counts",
    """SELECT count(DISTINCT issue_description) AS distinct_issue_description,
  count(DISTINCT type) AS distinct_type, count(DISTINCT queue) AS distinct_queue FROM cleaned""",
    ("cleaned",),
)
def distinct_counts(spark, sf_dir):
    return clean.distinct_counts(cleaned(spark, sf_dir))


_PRESENT = "issue_description IS NOT NULL AND priority IS NOT NULL"
_WITH_TEXT = f"{_PRESENT} AND {S.strip('issue_description')} <> ''"
_NUMERIC = " AND ".join(
    f"TRY_CAST({c} AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST({c} AS DOUBLE))"
    for c in fixed.NUMERIC_COLUMNS
)


@query(
    "e4_cleaning_counts",
    f"""SELECT count(*) AS loaded_rows,
  count(*) FILTER (WHERE {_PRESENT}) AS rows_with_text_and_label,
  count(*) FILTER (WHERE {_WITH_TEXT}) AS rows_with_nonempty_text,
  count(*) FILTER (WHERE {_WITH_TEXT} AND {_NUMERIC}) AS rows_with_valid_numbers
FROM training_rows""",
    ("training_rows",),
)
def cleaning_counts(spark, sf_dir):
    return clean.cleaning_counts(V.training_rows(spark, sf_dir))


@query(
    "e5_accuracy",
    """SELECT round(avg(CASE WHEN actual_priority = predicted_priority THEN 1.0 ELSE 0.0 END), 6)
  AS accuracy FROM predictions""",
    ("predictions",),
)
def accuracy(spark, sf_dir):
    return metrics.accuracy(V.predictions(spark, sf_dir)).select(
        F.round("accuracy", 6).alias("accuracy")
    )


@query("e6_macro_f1", "SELECT round(avg(f1_score), 6) AS macro_f1 FROM class_scores", ("class_scores",))
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(V.predictions(spark, sf_dir)).select(
        F.round("macro_f1", 6).alias("macro_f1")
    )


@query(
    "e7_weighted_f1",
    "SELECT round(sum(f1_score * support) / sum(support), 6) AS weighted_f1 FROM class_scores",
    ("class_scores",),
)
def weighted_f1(spark, sf_dir):
    return metrics.weighted_f1(V.predictions(spark, sf_dir)).select(
        F.round("weighted_f1", 6).alias("weighted_f1")
    )


@query("e8_confusion_matrix", CONFUSION_SQL, ("predictions",))
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(V.predictions(spark, sf_dir))


@query(
    "e8_confusion_counts",
    """SELECT a.actual_priority, p.predicted_priority, count(x.row_id) AS n
FROM (SELECT unnest(['HIGH', 'LOW', 'MEDIUM']) AS actual_priority) a
CROSS JOIN (SELECT unnest(['HIGH', 'LOW', 'MEDIUM']) AS predicted_priority) p
LEFT JOIN predictions x ON x.actual_priority = a.actual_priority AND x.predicted_priority = p.predicted_priority
GROUP BY 1, 2""",
    ("predictions",),
)
def confusion_counts(spark, sf_dir):
    return metrics.confusion_counts(V.predictions(spark, sf_dir))


@query("e9_classification_report", REPORT_SQL, ("class_scores",))
def classification_report(spark, sf_dir):
    return rounded_report(metrics.classification_report(V.predictions(spark, sf_dir)))


# --- F: features

SPLIT_VIEWS = f"""hashed AS MATERIALIZED (SELECT row_id, priority,
    row_number() OVER (PARTITION BY priority ORDER BY md5('42-' || row_id), row_id) AS turn,
    count(*) OVER (PARTITION BY priority) AS n, count(*) OVER () AS total FROM cleaned),
  shares AS (SELECT DISTINCT priority, n, total, n * ceil(total * 0.2::DOUBLE) / total AS share
    FROM hashed),
  quotas AS (SELECT priority, floor(share) + CASE WHEN row_number() OVER (
      ORDER BY share - floor(share) DESC, priority)
      <= ceil(total * 0.2::DOUBLE) - (SELECT sum(floor(share)) FROM shares) THEN 1 ELSE 0 END AS quota
    FROM shares)"""


def _split_sql(body: str) -> str:
    return f"SELECT * FROM (WITH {SPLIT_VIEWS} {body})"


@query(
    "f1_stratified_split",
    _split_sql("""SELECT h.row_id, h.priority, h.turn <= q.quota AS is_test
FROM hashed h JOIN quotas q USING (priority)"""),
    ("cleaned",),
)
def stratified_split(spark, sf_dir):
    split = features.stratified_split(cleaned(spark, sf_dir), "row_id")
    return split.select("row_id", "priority", "is_test")


@query(
    "f2_tokenize",
    f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS tokens FROM documents",
)
def tokenize(spark, sf_dir):
    return V.documents(spark, sf_dir).select(
        "doc_id", F.array_join(features.tokenize("text"), " ").alias("tokens")
    )


def kept_tokens(spark, sf_dir):
    return V.documents(spark, sf_dir).select(
        "doc_id", features.remove_stopwords(features.tokenize("text"), V.STOP_WORDS).alias("kept")
    )


@query(
    "f3_remove_stopwords",
    f"""SELECT doc_id, array_to_string(list_filter({S.tokens('text')},
  lambda t: t NOT IN {S.in_list(V.STOP_WORDS)}), ' ') AS tokens FROM documents""",
)
def remove_stopwords(spark, sf_dir):
    return kept_tokens(spark, sf_dir).select("doc_id", F.array_join("kept", " ").alias("tokens"))


def document_terms(spark, sf_dir, tasks=None):
    docs = V.table(spark, sf_dir, "documents")
    return features.document_terms(docs, "doc_id", "text", V.STOP_WORDS, tasks=tasks)


@query(
    "f4_ngrams_1_2",
    "SELECT doc_id, array_to_string(terms, '|') AS terms FROM doc_terms",
    ("doc_terms",),
)
def ngrams_1_2(spark, sf_dir):
    return document_terms(spark, sf_dir).select(
        "doc_id", F.array_join("terms", "|").alias("terms")
    )


@query("f5_vocabulary", "SELECT term, tf, df FROM vocabulary", ("vocabulary",))
def vocabulary(spark, sf_dir):
    return features.vocabulary(document_terms(spark, sf_dir), min_df=2, max_features=20_000)


@query(
    "f6_tfidf",
    """SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
FROM (SELECT c.doc_id, c.term,
    c.n * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + v.df)) + 1) AS w
  FROM (SELECT doc_id, term, count(*) AS n
    FROM (SELECT doc_id, unnest(terms) AS term FROM doc_terms) GROUP BY 1, 2) c
  JOIN vocabulary v USING (term))""",
    ("doc_terms", "vocabulary"),
)
def tfidf(spark, sf_dir):
    size = F.sum(F.octet_length("text"))
    n, n_bytes = V.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)), size).first()
    counts = features.term_counts(document_terms(spark, sf_dir, features.tasks_for_text(n_bytes)))
    vocab = features.vocabulary_of_counts(counts, min_df=2, max_features=20_000)
    weights = features.tfidf(counts, vocab, n, max_features=20_000)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "f8_standard_scale",
    "SELECT row_id, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
        f"ELSE stddev_pop({c}) OVER () END, 5) AS {c}"
        for c in fixed.NUMERIC_COLUMNS
    )
    + " FROM cleaned_numbers",
    ("cleaned_numbers",),
)
def standard_scale(spark, sf_dir):
    rows = cleaned(spark, sf_dir, "stage4").select("row_id", *fixed.NUMERIC_COLUMNS)
    scaled = features.standard_scale(rows)
    return scaled.select("row_id", *[F.round(c, 5).alias(c) for c in fixed.NUMERIC_COLUMNS])


@query(
    "f10_class_weights",
    """SELECT row_id, priority, round(count(*) OVER () /
  ((SELECT count(DISTINCT priority) FROM cleaned) * count(*) OVER (PARTITION BY priority)), 6)
  AS class_weight FROM cleaned""",
    ("cleaned",),
)
def class_weights(spark, sf_dir):
    return features.class_weights(cleaned(spark, sf_dir)).select(
        "row_id", "priority", F.round("class_weight", 6).alias("class_weight")
    )


def _flag_sql(name: str) -> str:
    hit = " OR ".join(f"contains(lower(text), {S.lit(t)})" for t in features.KEYWORDS[name])
    return f"CASE WHEN {hit} THEN 1.0 ELSE 0.0 END::DOUBLE AS {name}"


@query(
    "f16_engineered_features",
    f"""SELECT doc_id, CAST(length(text) AS DOUBLE) AS text_length,
  CAST(CASE WHEN {S.strip('text')} = '' THEN 0
    ELSE len(string_split({S.collapse(S.strip('text'))}, ' ')) END AS DOUBLE) AS word_count,
  {", ".join(map(_flag_sql, features.KEYWORDS))} FROM documents""",
)
def engineered_features(spark, sf_dir):
    docs = V.documents(spark, sf_dir).select("doc_id", "text")
    return features.engineered_features(docs, "text").drop("text")


# --- F: models.  Every query fits its own, on all rows.


def fitted(spark, sf_dir, stage):
    return training.train_and_score(V.training_rows(spark, sf_dir), stage, "row_id", V.STOP_WORDS)


def _scored(spark, sf_dir, stage):
    _, scored = fitted(spark, sf_dir, stage)
    return scored.select("row_id", "actual_priority", "predicted_priority")


def _one_hot_sql(column: str) -> str:
    levels = f"(SELECT list(DISTINCT {column} ORDER BY {column}) FROM cleaned)"
    flags = f"list_transform({levels}, lambda l: CASE WHEN l = {column} THEN '1.0' ELSE '0.0' END)"
    return f"array_to_string({flags}, ',') AS {column}_onehot"


@query(
    "f7_one_hot",
    f"SELECT row_id, {_one_hot_sql('type')}, {_one_hot_sql('queue')} FROM cleaned",
    ("cleaned",),
)
def one_hot(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    rows = cleaned(spark, sf_dir)
    encoded = PipelineModel(training.fit_category_features(rows)).transform(rows)
    return encoded.select(
        "row_id",
        F.array_join(vector_to_array("_type_onehot"), ",").alias("type_onehot"),
        F.array_join(vector_to_array("_queue_onehot"), ",").alias("queue_onehot"),
    )


_SCALED_SUM = " + ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)"
    for c in fixed.NUMERIC_COLUMNS
)


@query(
    "f9_assemble_features",
    f"""SELECT * FROM (WITH kept AS MATERIALIZED (
    SELECT row_id, list_filter({S.tokens('issue_description')},
      lambda t: t NOT IN {S.in_list(V.STOP_WORDS)}) AS w FROM cleaned_numbers),
  grams AS MATERIALIZED (SELECT row_id, unnest(w || list_transform(generate_series(1, len(w) - 1),
      lambda i: w[i] || ' ' || w[i + 1])) AS term FROM kept),
  counts AS MATERIALIZED (SELECT row_id, term, count(*) AS n FROM grams GROUP BY 1, 2),
  vocab AS MATERIALIZED (SELECT term, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 2
    ORDER BY sum(n) DESC, term LIMIT 20000),
  weights AS (SELECT row_id, n * (ln((1.0 + (SELECT count(*) FROM kept)) / (1.0 + df)) + 1) AS x
    FROM counts JOIN vocab USING (term)),
  texts AS (SELECT row_id, sum(x) / sqrt(sum(x * x)) AS text_sum FROM weights GROUP BY 1)
  SELECT row_id, CAST((SELECT count(*) FROM vocab) + (SELECT count(DISTINCT type) FROM cleaned_numbers)
      + (SELECT count(DISTINCT queue) FROM cleaned_numbers) + 7 AS INTEGER) AS n_features,
    round(coalesce(text_sum, 0) + 2 + {_SCALED_SUM}, 4) AS feature_sum
  FROM cleaned_numbers LEFT JOIN texts USING (row_id))""",
    ("cleaned_numbers",),
)
def assemble_features(spark, sf_dir):
    rows = cleaned(spark, sf_dir, "stage4")
    model = training.fit_features(rows, training.STAGES["stage4"], V.STOP_WORDS)
    assembled = model.transform(rows).select("row_id", F.unwrap_udt("features").alias("f"))
    # A row has some twenty values among 20,000 features; the others add nothing.
    total = F.aggregate("f.values", F.lit(0.0), lambda a, x: a + x)
    return assembled.select(
        "row_id",
        F.coalesce("f.size", F.size("f.values")).alias("n_features"),
        F.round(total, 4).alias("feature_sum"),
    )


def _training_query(name: str, stage: str):
    @query(name)
    def run(spark, sf_dir):
        return _scored(spark, sf_dir, stage)

    return run


_training_query("f11_train_baseline", "baseline")
_training_query("f12_train_stage2", "stage2")
_training_query("f13_train_stage3", "stage3")
_training_query("f14_train_stage4", "stage4")
_training_query("f15_train_stage5_svm", "stage5")


# A fit that is done has a slope far below this; one whose intercept is off by a twentieth has not.
STATIONARY = 0.001


def _check_query(name: str, stage: str):
    rows = "cleaned_numbers" if stage == "stage4" else "cleaned"
    body = f"""SELECT priority, CAST(any_value(n) - any_value(quota) AS BIGINT) AS support, true AS stationary
      FROM hashed JOIN quotas USING (priority) GROUP BY priority"""

    @query(name, _split_sql(body).replace("FROM cleaned)", f"FROM {rows})"), (rows,))
    def run(spark, sf_dir):
        cleaned_rows = cleaned(spark, sf_dir, stage)
        train = written(features.stratified_split(cleaned_rows, "row_id"), "split").filter("NOT is_test")
        model = training.train_model(train, stage, V.STOP_WORDS)
        checks = training.fit_checks(model, train, stage)
        return checks.select("priority", "support", (F.col("slope") <= STATIONARY).alias("stationary"))

    return run


_check_query("f11_check_baseline", "baseline")
_check_query("f12_check_stage2", "stage2")
_check_query("f13_check_stage3", "stage3")
_check_query("f14_check_stage4", "stage4")
_check_query("f15_check_stage5_svm", "stage5")


@query(
    "a11_saved_model_predicts_alike",
    """SELECT count(*) AS tickets, CAST(0 AS BIGINT) AS scored_otherwise, CAST(0 AS BIGINT) AS unknown_labels
FROM tickets""",
    ("tickets",),
)
def saved_model_predicts_alike(spark, sf_dir):
    """A model and what is loaded after saving it, ticket by ticket."""
    model, _ = fitted(spark, sf_dir, "stage5")
    path = fresh_path(spark, "model")
    models.save_model(model, path)
    tickets = V.tickets(spark, sf_dir).drop("ml_priority")
    one = training.predict_priority(model, tickets).select("ticket_id", "ml_priority")
    two = training.predict_priority(models.load_model(path), tickets)
    both = one.join(two.select("ticket_id", F.col("ml_priority").alias("loaded")), "ticket_id")
    return both.agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(~F.col("ml_priority").eqNullSafe(F.col("loaded"))).alias("scored_otherwise"),
        F.count_if(~F.col("ml_priority").isin("HIGH", "MEDIUM", "LOW")).alias("unknown_labels"),
    )


@query("a11_save_and_load_model")
def save_and_load_model(spark, sf_dir):
    model, _ = fitted(spark, sf_dir, "stage5")
    path = fresh_path(spark, "model")
    models.save_model(model, path)
    tickets = V.tickets(spark, sf_dir).drop("ml_priority")
    scored = training.predict_priority(models.load_model(path), tickets)
    return scored.select("ticket_id", "ml_priority")


@query("f17_predict_priority")
def predict_priority(spark, sf_dir):
    model, _ = fitted(spark, sf_dir, "stage5")
    scored = training.predict_priority(model, V.tickets(spark, sf_dir).drop("ml_priority"))
    return scored.select("ticket_id", "issue", "type", "queue", "ml_priority")


@query("f18_predict_batch")
def predict_batch(spark, sf_dir):
    model, _ = fitted(spark, sf_dir, "stage5")
    texts = V.documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias(fixed.TEXT_COLUMN)
    )
    scored = training.predict_batch(model, texts)
    return scored.select("doc_id", *fixed.CATEGORY_COLUMNS, "predicted_priority")


@query(
    "f19_evaluate_model",
    METRICS_SQL.format(model=""),
    ("class_scores",),
)
def evaluate_model(spark, sf_dir):
    path = fresh_path(spark, "evaluation")
    training.evaluate_model(V.predictions(spark, sf_dir), path, "stage3")
    kinds = (
        "accuracy double, macro_f1 double, weighted_f1 double, test_size bigint, "
        "labels array<string>"
    )
    record = spark.read.schema(kinds).json(f"{path}/metrics")
    return record.withColumn("labels", F.array_join("labels", ", "))
