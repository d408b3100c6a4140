"""Training, scoring and evaluation of the five priority models.

Feature stages are native MLlib transformers, so scoring is one narrow pass.  What has to be learned
for them (vocabulary, document frequencies, category levels, means) comes from aggregations whose
results are limited in size: the vocabulary by ``max_features``, the rest by the columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
)
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IndexToString,
    NGram,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators.clean import clean_tickets
from caseloom.operators.features import (
    class_weights,
    scale_parameters,
    stratified_split,
    vocabulary,
)
from caseloom.operators.linear_models import (
    Blocks,
    LinearScores,
    fit_squared_hinge,
    multinomial,
    objective,
    squared_hinge,
)
from caseloom.session import written
from caseloom.sources import reports


@dataclass(frozen=True)
class Stage:
    """What one of the five models is made of."""

    name: str
    bigrams: bool
    min_df: int
    max_features: int
    categories: bool = False
    numbers: bool = False
    balanced: bool = True
    svm: bool = False


STAGES = {
    s.name: s
    for s in (
        Stage("baseline", bigrams=False, min_df=1, max_features=10_000, balanced=False),
        Stage("stage2", bigrams=True, min_df=2, max_features=20_000),
        Stage("stage3", bigrams=True, min_df=2, max_features=20_000, categories=True),
        Stage("stage4", bigrams=True, min_df=2, max_features=20_000, categories=True, numbers=True),
        Stage("stage5", bigrams=True, min_df=2, max_features=20_000, categories=True, svm=True),
    )
}
MODEL_NAMES = {"stage5": "LinearSVC"}
ROWS_PER_PARTITION = 20_000
MAX_ITER = 1000
TOLERANCE = 1e-6
SVM_LOSSES = ("squared_hinge", "hinge")


def term_stages(bigrams: bool, stop_words: Sequence[str] | None) -> list:
    """Text to terms: words, stop words out, then pairs of what is left."""
    words = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords(
        "english"
    )
    stages = [
        # Null text scores like empty text.
        SQLTransformer(
            statement=f"SELECT *, coalesce({fixed.TEXT_COLUMN}, '') AS _text FROM __THIS__"
        ),
        RegexTokenizer(
            inputCol="_text", outputCol="_words", pattern=fixed.WORD_PATTERN, gaps=False
        ),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=words),
    ]
    if not bigrams:
        return [*stages, SQLTransformer(statement="SELECT *, _kept AS _terms FROM __THIS__")]
    return [
        *stages,
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]


def fit_text_features(train: DataFrame, stage: Stage, stop_words: Sequence[str] | None) -> list:
    """TF-IDF stages with smoothed idf and unit-length rows."""
    to_terms = term_stages(stage.bigrams, stop_words)
    with_terms = PipelineModel(to_terms).transform(train).select("_terms")
    terms = vocabulary(with_terms, "_terms", stage.min_df, stage.max_features).collect()
    n = train.count()
    terms = sorted(terms, key=lambda t: t["term"])
    if not terms:
        raise ValueError("no term is frequent enough to build a vocabulary")
    idf = [math.log((1.0 + n) / (1.0 + t["df"])) + 1.0 for t in terms]
    return [
        *to_terms,
        CountVectorizerModel.from_vocabulary(
            [t["term"] for t in terms], inputCol="_terms", outputCol="_counts"
        ),
        ElementwiseProduct(
            scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted"
        ),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="_text_features"),
    ]


def fit_category_features(train: DataFrame) -> list:
    """One-hot stages; a level not seen in training becomes all zeros."""
    columns = list(fixed.CATEGORY_COLUMNS)
    indexed = [f"_{c}_index" for c in columns]
    encoded = [f"_{c}_onehot" for c in columns]
    stages = Pipeline(
        stages=[
            StringIndexer(
                inputCols=columns,
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
    )
    return stages.fit(train).stages


def fit_number_features(train: DataFrame) -> list:
    """Standard scaling with the population deviation, written as a projection."""
    scaled = ", ".join(
        f"(cast({c} as double) - {mean!r}D) / {std!r}D AS _{c}_scaled"
        for c, (mean, std) in scale_parameters(train, fixed.NUMERIC_COLUMNS).items()
    )
    return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")]


def fit_features(
    train: DataFrame, stage: Stage, stop_words: Sequence[str] | None = None
) -> PipelineModel:
    """All feature stages of a model, ending in ``features``."""
    stages = fit_text_features(train, stage, stop_words)
    blocks = ["_text_features"]
    if stage.categories:
        stages += fit_category_features(train)
        blocks += [f"_{c}_onehot" for c in fixed.CATEGORY_COLUMNS]
    if stage.numbers:
        stages += fit_number_features(train)
        blocks += [f"_{c}_scaled" for c in fixed.NUMERIC_COLUMNS]
    return PipelineModel([*stages, VectorAssembler(inputCols=blocks, outputCol="features")])


def labelled_features(
    train: DataFrame, stage: Stage, features: PipelineModel
) -> tuple[StringIndexerModel, DataFrame]:
    """What a classifier is fitted on, ``features, _label, class_weight``, and the numbering of its labels."""
    labels = StringIndexer(
        inputCol=fixed.LABEL_COLUMN, outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(train)
    rows = class_weights(train) if stage.balanced else train.withColumn(
        "class_weight", F.lit(1.0)
    )
    return labels, labels.transform(features.transform(rows)).select("features", "_label", "class_weight")


def train_model(
    train: DataFrame,
    stage_name: str,
    stop_words: Sequence[str] | None = None,
    max_iter: int = MAX_ITER,
    svm_loss: str = "squared_hinge",
) -> PipelineModel:
    """Fit a stage on cleaned training rows; the model adds ``predicted_priority``.

    ``max_iter`` is the limit the five models share; fits end before it when they converge to ``TOLERANCE``.
    The last model's loss is the squared hinge; with ``svm_loss="hinge"`` it is that of Spark's class.
    """
    if svm_loss not in SVM_LOSSES:
        raise ValueError(f"svm_loss must be one of {SVM_LOSSES}")
    stage = STAGES[stage_name]
    features = fit_features(train, stage, stop_words)
    labels, ready = labelled_features(train, stage, features)
    n = train.count()
    # Regularisation of strength C = 1: the weights of a training set sum to its row count.
    strength = 1.0 / n
    back = IndexToString(
        inputCol="_predicted", outputCol="predicted_priority", labels=labels.labels
    )
    if stage.svm and svm_loss == "squared_hinge":
        # Words outside the vocabulary leave no trace, so many texts have the same features.
        with Blocks(ready, merge=True) as blocks:
            size = ready.select(F.unwrap_udt("features")["size"]).first()[0]
            fit = fit_squared_hinge(blocks, size, len(labels.labels), tolerance=TOLERANCE, max_iter=max_iter)
        scores = LinearScores(predictionCol="_predicted", weights=fit.weights.T.tolist())
        return PipelineModel([*features.stages, scores, back])
    # Every iteration visits every partition, so finished features are dealt out to few of them where
    # there are few rows; what leads up to them keeps its own partitions.
    ready = ready.repartition(max(1, -(-n // ROWS_PER_PARTITION)))
    if stage.svm:
        binary = LinearSVC(
            regParam=strength, maxIter=max_iter, tol=TOLERANCE, standardization=False
        )
        classifier = OneVsRest(classifier=binary, parallelism=3)
    else:
        classifier = LogisticRegression(
            family="multinomial",
            regParam=strength,
            maxIter=max_iter,
            tol=TOLERANCE,
            standardization=False,
        )
    classifier.setFeaturesCol("features").setLabelCol("_label").setPredictionCol("_predicted")
    classifier.setWeightCol("class_weight")
    fitted = classifier.fit(ready)
    return PipelineModel([*features.stages, fitted, back])


def predict(model: PipelineModel, rows: DataFrame, output: str = "predicted_priority") -> DataFrame:
    """``rows`` with a predicted priority; helper columns of the model are left out."""
    return model.transform(rows).select(
        *[rows[c] for c in rows.columns], F.col("predicted_priority").alias(output)
    )


def predict_priority(model: PipelineModel, tickets: DataFrame) -> DataFrame:
    """Triage tickets (issue, type, queue) with ``ml_priority`` from a model."""
    named = tickets.withColumn(fixed.TEXT_COLUMN, F.col("issue"))
    return predict(model, named, "ml_priority").drop(fixed.TEXT_COLUMN)


def predict_batch(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Score bare texts, with type and queue unknown."""
    unknown = {c: F.lit("UNKNOWN") for c in fixed.CATEGORY_COLUMNS}
    return predict(model, texts.withColumns(unknown))


def evaluate_model(
    predictions: DataFrame, output: str, stage_name: str = "stage5"
) -> None:
    """Write every evaluation output of a stage below ``output``; the rows are scored once."""
    predictions = written(predictions, "scored")
    reports.write_metrics_json(predictions, f"{output}/metrics", MODEL_NAMES.get(stage_name))
    reports.write_classification_report(predictions, f"{output}/classification_report")
    reports.write_confusion_csv(predictions, f"{output}/confusion_matrix")
    reports.write_predictions_csv(predictions, f"{output}/test_predictions", stage_name)
    reports.write_misclassified_csv(predictions, f"{output}/misclassified_samples", stage_name)


def train_and_score(
    raw: DataFrame,
    stage_name: str,
    key: str,
    stop_words: Sequence[str] | None = None,
    max_iter: int = MAX_ITER,
    svm_loss: str = "squared_hinge",
) -> tuple[PipelineModel, DataFrame]:
    """Clean, split, fit and score the test rows, which get ``actual_priority``."""
    cleaned = clean_tickets(raw, stage_name, keep=[key])
    split = written(stratified_split(cleaned, key), "split")
    model = train_model(split.filter("NOT is_test"), stage_name, stop_words, max_iter, svm_loss)
    test = split.filter("is_test").drop("is_test")
    scored = predict(model, test).withColumnRenamed(fixed.LABEL_COLUMN, "actual_priority")
    return model, scored


def fit_checks(model: PipelineModel, train: DataFrame, stage_name: str) -> DataFrame:
    """Whether a fitted model minimises its objective: ``priority, support, loss, slope``, one row per label.

    ``slope`` is the gradient's norm at the model's weights as a share of its norm at zero weights; it is
    computed from the training rows and the weights alone, without the solver.
    """
    stage, classifier = STAGES[stage_name], model.stages[-2]
    features = PipelineModel(model.stages[:-2])
    labels, ready = labelled_features(train, stage, features)
    if isinstance(classifier, LinearScores):
        weights, loss = np.array(classifier.getOrDefault(classifier.weights)).T, squared_hinge
    elif isinstance(classifier, LogisticRegressionModel):
        matrix, loss = classifier.coefficientMatrix.toArray(), multinomial
        weights = np.vstack([matrix.T, classifier.interceptVector.toArray()])
    else:
        raise TypeError(f"no objective known for {type(classifier).__name__}")
    free = loss is multinomial
    with Blocks(ready) as blocks:
        value, slope = objective(blocks, weights, loss, free_intercept=free)
        _, first = objective(blocks, 0.0 * weights, loss, free_intercept=free)
    support = {r[0]: r[1] for r in train.groupBy(fixed.LABEL_COLUMN).count().collect()}  # one row a label
    shares = np.linalg.norm(slope, axis=0) / np.linalg.norm(first, axis=0)
    rows = [(l, support[l], float(v), float(s)) for l, v, s in zip(labels.labels, value, shares)]
    return train.sparkSession.createDataFrame(rows, "priority string, support long, loss double, slope double")
