"""Cleaning, metrics, features, models and their files."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators import clean, features, metrics
from caseloom.plans import training
from caseloom.sources import models, reports, tickets

RAW = [
    (1, "\tslow api \n", "incident", " billing ", " high", "12", "3"),
    (2, None, "incident", "billing", "LOW", "1", "1"),
    (3, "text", None, None, "low ", "NaN", "1"),
    (4, "   ", "incident", "billing", "LOW", "1", "1"),
    (5, "other, \"quoted\"\nline", "PROBLEM", "it", "Medium", "7", "oops"),
    (6, "fine", "PROBLEM", "it", None, "7", "1"),
]


@pytest.fixture(scope="module")
def raw(spark):
    df = spark.createDataFrame(
        RAW,
        "row_id long, issue_description string, type string, queue string, priority string, "
        "text_length string, word_count string",
    )
    zeros = {c: F.lit("0") for c in fixed.NUMERIC_COLUMNS[2:]}
    return df.withColumns(zeros)


def test_cleaning(raw):
    rows = {r.row_id: r for r in clean.clean_tickets(raw, "stage3", keep=["row_id"]).collect()}
    assert set(rows) == {1, 3, 5}
    assert (rows[1].issue_description, rows[1].queue, rows[1].priority) == ("slow api", "BILLING", "HIGH")
    assert (rows[3].type, rows[3].queue) == ("UNKNOWN", "UNKNOWN")
    assert [r.row_id for r in clean.clean_tickets(raw, "stage4", keep=["row_id"]).collect()] == [1]
    assert tuple(clean.cleaning_counts(raw).first()) == (6, 4, 3, 1)
    with pytest.raises(AnalysisException):
        clean.clean_tickets(raw.drop("queue"), "stage5").collect()


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "csv")
    tickets.write_csv(raw, path)
    back = tickets.read_tickets_csv(spark, path)
    got = sorted(back.select("row_id", "issue_description", "type", "text_length").collect(), key=str)
    want = sorted(
        [(str(r[0]), r[1], r[2], None if r[5] == "NaN" else r[5]) for r in RAW], key=str
    )
    assert [tuple(r) for r in got] == want
    with pytest.raises(AnalysisException):
        tickets.read_tickets_csv(spark, path).select("absent")


PAIRS = [("HIGH", "HIGH")] * 3 + [("HIGH", "LOW")] + [("LOW", "LOW")] * 2 + [("LOW", "ODD")]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(
        [(f"t{i}", "T", "Q", a, p) for i, (a, p) in enumerate(PAIRS)],
        "issue_description string, type string, queue string, actual_priority string, "
        "predicted_priority string",
    )


def test_metrics(predictions):
    scores = {r.label: r for r in metrics.class_scores(predictions).collect()}
    assert scores["ODD"].recall == scores["ODD"].f1_score == 0.0
    assert scores["HIGH"].precision == 1.0 and scores["HIGH"].recall == 0.75
    f1 = {"HIGH": 6 / 7, "LOW": 4 / 6, "ODD": 0.0}
    record = metrics.metrics_record(predictions, "M").first()
    assert record.accuracy == round(5 / 7, 4) and record.test_size == 7
    assert record.macro_f1 == round(sum(f1.values()) / 3, 4)
    assert record.weighted_f1 == round((4 * f1["HIGH"] + 3 * f1["LOW"]) / 7, 4)
    assert record.labels == ["HIGH", "LOW"] and record.model == "M"
    matrix = {r.actual_priority: r for r in metrics.confusion_matrix(predictions).collect()}
    assert matrix["HIGH"]["LOW"] == 1 and matrix["MEDIUM"]["MEDIUM"] == 0 and len(matrix) == 3
    report = [r.label for r in metrics.classification_report(predictions).collect()]
    assert report == ["HIGH", "LOW", "ODD", "accuracy", "macro avg", "weighted avg"]


def test_evaluation_files(spark, predictions, tmp_path):
    out = str(tmp_path / "out")
    training.evaluate_model(predictions, out, "stage5")
    metric = json.loads(spark.read.text(f"{out}/metrics").first()[0])
    assert metric["model"] == "LinearSVC" and metric["labels"] == ["HIGH", "LOW"]
    text = "\n".join(r[0] for r in spark.read.text(f"{out}/classification_report_txt").collect())
    assert "weighted avg" in text and "f1-score" in text
    wrong = spark.read.option("header", True).csv(f"{out}/misclassified_samples")
    assert wrong.count() == 2 and wrong.columns[-1] == "correct"
    cases = spark.createDataFrame(
        [], ", ".join(f"{c} string" for c in fixed.EVALUATION_COLUMNS)
    )
    assert reports.write_evaluation_csv(cases, f"{out}/none") is False


def test_summary_of_no_cases(spark):
    kinds = (
        "ml_priority string, recommended_priority_rule string, escalation string, "
        "confidence_score double, same_queue_ratio double"
    )
    assert tuple(metrics.evaluation_summary(spark.createDataFrame([], kinds)).first()) == (0, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("digits", [1, 4])
def test_split_is_exact_per_label(spark, digits):
    rows = [(i, ["HIGH", "LOW", "MEDIUM", "RARE"][min(3, int(math.log2(i + 1)) % 4)]) for i in range(777)]
    df = spark.createDataFrame(rows, "row_id long, priority string")
    split = features.stratified_split(df, "row_id", hash_digits=digits).collect()
    assert len(split) == 777
    by_label = defaultdict(list)
    for i, label in rows:
        by_label[label].append((hashlib.md5(f"42-{i}".encode()).hexdigest(), i))
    total = math.ceil(777 * 0.2)
    shares = {c: len(v) * total / 777 for c, v in by_label.items()}
    quota = {c: math.floor(s) for c, s in shares.items()}
    rest = total - sum(quota.values())
    for c in sorted(shares, key=lambda c: (-(shares[c] - quota[c]), c))[:rest]:
        quota[c] += 1
    want = {i for c, v in by_label.items() for _, i in sorted(v)[: quota[c]]}
    assert {r.row_id for r in split if r.is_test} == want and len(want) == total


DOCS = [
    (1, "The API is slow, slow API!"),
    (2, "slow café login été 42 x"),
    (3, ""),
    (4, "login login login"),
]


def plain_terms(text):
    import re

    kept = [t for t in re.findall(r"\b\w\w+\b", text.lower()) if t not in ("the", "is")]
    return kept + [" ".join(p) for p in zip(kept, kept[1:])]


def test_tfidf_matches_plain_python(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    terms = features.document_terms(docs, "doc_id", "text", ("the", "is"))
    assert {r.doc_id: r.terms for r in terms.collect()} == {d: plain_terms(t) for d, t in DOCS}
    tf, df = Counter(), Counter()
    for _, t in DOCS:
        tf.update(plain_terms(t))
        df.update(set(plain_terms(t)))
    top = sorted(tf, key=lambda t: (-tf[t], t))[:6]
    counts = features.term_counts(terms)
    for vocab in (
        features.vocabulary(terms, max_features=6),
        features.vocabulary_of_counts(counts, max_features=6),
    ):
        assert [(r.term, r.tf, r.df) for r in vocab.collect()] == [(t, tf[t], df[t]) for t in top]
    for limit in (6, None):
        got = {(r.doc_id, r.term): r.weight for r in features.tfidf(counts, vocab, 4, max_features=limit).collect()}
        want = {}
        for d, text in DOCS:
            w = {
                t: n * (math.log(5 / (1 + df[t])) + 1)
                for t, n in Counter(plain_terms(text)).items()
                if t in top
            }
            length = math.sqrt(sum(x * x for x in w.values()))
            want.update({(d, t): x / length for t, x in w.items()})
        assert got.keys() == want.keys()
        assert all(abs(got[key] - want[key]) < 1e-12 for key in want)


def test_model_features_equal_relational_ones(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, issue_description string")
    stage = training.Stage("x", bigrams=True, min_df=1, max_features=6)
    vectors = training.fit_features(docs, stage, ("the", "is")).transform(docs).collect()
    terms = features.document_terms(docs, "doc_id", "issue_description", ("the", "is"))
    vocab = features.vocabulary(terms, max_features=6)
    weights = features.tfidf(features.term_counts(terms), vocab, 4, max_features=6).collect()
    order = sorted(r.term for r in vocab.collect())
    for row in vectors:
        want = [0.0] * 6
        for w in weights:
            if w.doc_id == row.doc_id:
                want[order.index(w.term)] = w.weight
        assert all(abs(a - b) < 1e-12 for a, b in zip(row.features.toArray(), want))


def test_scaling_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0, "A"), (3.0, 5.0, "A"), (5.0, 5.0, "B")], "x double, y double, priority string")
    rows = features.standard_scale(df, ["x", "y"]).orderBy("x").collect()
    assert [round(r.x, 6) for r in rows] == [-1.224745, 0.0, 1.224745] and rows[0].y == 0.0
    weights = {r.priority: r.class_weight for r in features.class_weights(df).collect()}
    assert weights == {"A": 3 / 4, "B": 3 / 2}


@pytest.fixture(scope="module")
def training_rows(spark):
    words = {"HIGH": "outage crash urgent", "MEDIUM": "slow latency delay", "LOW": "question manual invoice"}
    rows = []
    for i in range(240):
        label = ["HIGH", "MEDIUM", "LOW"][i % 3]
        rows.append((i, f"{words[label]} case number{i % 17}", "INCIDENT" if i % 2 else "PROBLEM", f"Q{i % 4}", label))
    df = spark.createDataFrame(
        rows, "row_id long, issue_description string, type string, queue string, priority string"
    )
    return features.engineered_features(df)


@pytest.mark.parametrize("stage", list(training.STAGES))
def test_stages_learn(training_rows, stage):
    model, scored = training.train_and_score(training_rows, stage, "row_id", ("the",), max_iter=5)
    assert scored.count() == 48
    assert metrics.accuracy(scored).first()[0] > 0.95
    assert "predicted_priority" in scored.columns and "features" not in scored.columns


def test_saved_model_scores_the_same(spark, training_rows, tmp_path):
    model, _ = training.train_and_score(training_rows, "stage5", "row_id", (), max_iter=5)
    models.save_model(model, str(tmp_path / "m"))
    asked = spark.createDataFrame(
        [(1, "urgent outage", "INCIDENT", "never seen"), (2, None, None, "Q1"), (3, "slow latency", "PROBLEM", "Q2")],
        "ticket_id long, issue string, type string, queue string",
    )
    before = training.predict_priority(model, asked).orderBy("ticket_id").collect()
    after = training.predict_priority(models.load_model(str(tmp_path / "m")), asked).orderBy("ticket_id").collect()
    assert before == after and before[0].ml_priority == "HIGH" and before[2].ml_priority == "MEDIUM"
    texts = spark.createDataFrame([("outage now",)], "issue_description string")
    row = training.predict_batch(model, texts).first()
    assert (row.type, row.queue) == ("UNKNOWN", "UNKNOWN") and row.predicted_priority == "HIGH"


def test_unseen_category_is_all_zeros(spark, training_rows):
    from pyspark.ml import PipelineModel

    stages = PipelineModel(training.fit_category_features(training_rows))
    seen = training_rows.limit(1).withColumns({"type": F.lit("INCIDENT"), "queue": F.lit("Q3")})
    row = stages.transform(seen).first()
    assert sum(row["_queue_onehot"].toArray()) == 1.0 and len(row["_queue_onehot"].toArray()) == 4
    unseen = training_rows.limit(1).withColumns({"type": F.lit("OTHER"), "queue": F.lit("Z")})
    row = stages.transform(unseen).first()
    assert sum(row["_queue_onehot"].toArray()) == sum(row["_type_onehot"].toArray()) == 0.0


@pytest.mark.parametrize("stage", ["stage3", "stage5"])
def test_fit_checks_notice_a_spoilt_weight(spark, stage):
    from workload import views as V
    from workload.learning_queries import STATIONARY, cleaned

    train = cleaned(spark, "/root/testdata/sf0.001", stage)
    model = training.train_model(train, stage, V.STOP_WORDS)
    checks = training.fit_checks(model, train, stage).collect()
    assert [r.priority for r in checks] == ["HIGH", "LOW", "MEDIUM"]
    assert sum(r.support for r in checks) == train.count() and all(r.slope < STATIONARY for r in checks)
    if stage == "stage5":
        classifier = model.stages[-2]
        spoilt = [list(w) for w in classifier.getOrDefault(classifier.weights)]
        spoilt[1][-1] += 0.05
        classifier.set(classifier.weights, spoilt)
        assert training.fit_checks(model, train, stage).collect()[1].slope > STATIONARY


def test_hinge_is_still_there(spark):
    from workload import views as V
    from workload.learning_queries import cleaned

    train = cleaned(spark, "/root/testdata/sf0.001", "stage5")
    model = training.train_model(train, "stage5", V.STOP_WORDS, max_iter=20, svm_loss="hinge")
    assert training.predict(model, train).filter("predicted_priority IS NULL").isEmpty()
    with pytest.raises(ValueError):
        training.train_model(train, "stage5", svm_loss="other")
    with pytest.raises(TypeError):
        training.fit_checks(model, train, "stage5")
