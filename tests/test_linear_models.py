"""The squared-hinge classifier and gradient checks against numpy."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from caseloom.operators import linear_models as lin


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 9)) * (rng.random((400, 9)) < 0.4)
    x[:5] = 0.0
    y = (x @ rng.normal(size=(9, 3)) + rng.normal(size=(400, 3))).argmax(1)
    c = rng.random(400) + 0.5
    rows = [
        (Vectors.dense(v) if i % 3 == 0 else Vectors.sparse(9, {int(j): float(v[j]) for j in np.flatnonzero(v)}), float(t), float(w))
        for i, (v, t, w) in enumerate(zip(x, y, c))
    ]
    df = spark.createDataFrame(rows, ["features", "_label", "class_weight"]).repartition(5)
    return df, np.hstack([x, np.ones((400, 1))]), y, c


def loss_of(x, y, c, w, strength):
    signs = np.where(y[:, None] == np.arange(w.shape[1]), 1.0, -1.0)
    missing = np.maximum(0, 1 - signs * (x @ w))
    return (strength * c[:, None] * missing**2).sum(0) + (w**2).sum(0) / 2


def solve(x, y, c, label, strength):
    """Newton steps on the dense problem."""
    s, w = np.where(y == label, 1.0, -1.0), np.zeros(x.shape[1])
    for _ in range(200):
        missing = np.maximum(0, 1 - s * (x @ w))
        g = w - 2 * strength * x.T @ (c * s * missing)
        h = np.eye(len(w)) + 2 * strength * (x * (c * (missing > 0))[:, None]).T @ x
        step, t = np.linalg.solve(h, -g), 1.0
        value = loss_of(x, s > 0, c, np.stack([0 * w, w], 1), strength)[1]
        while t > 1e-9 and loss_of(x, s > 0, c, np.stack([0 * w, w + t * step], 1), strength)[1] > value:
            t /= 2
        w = w + t * step
        if np.linalg.norm(g) < 1e-10:
            break
    return w


@pytest.mark.parametrize("strength", [0.01, 1.0, 20.0])
def test_objective_equals_numpy(data, strength, monkeypatch):
    monkeypatch.setattr(lin, "BLOCK_ENTRIES", 64)
    df, x, y, c = data
    with lin.Blocks(df) as blocks:
        fit = lin.fit_squared_hinge(blocks, 9, 3, strength)
    want = np.stack([solve(x, y, c, label, strength) for label in range(3)], 1)
    assert np.allclose(fit.loss, loss_of(x, y, c, want, strength), rtol=1e-6)
    assert np.allclose(fit.loss, loss_of(x, y, c, fit.weights, strength), rtol=1e-10)
    assert np.allclose(fit.weights, want, atol=1e-4)
    assert 0 < fit.iterations < 50 and (fit.gradient <= 1e-6 * fit.first_gradient).all()


@pytest.mark.parametrize("loss", [lin.squared_hinge, lin.multinomial])
def test_gradients_equal_differences(data, loss):
    df, x, *_ = data
    weights = np.random.default_rng(1).normal(size=(10, 3)) * 0.3
    with lin.Blocks(df) as blocks:
        assert blocks.rows == len(x)
        value, gradient = lin.objective(blocks, weights, loss)
        for i, j in ((0, 0), (4, 2), (9, 1)):
            moved = weights.copy()
            moved[i, j] += 1e-5
            more = lin.objective(blocks, moved, loss)[0].sum()
            moved[i, j] -= 2e-5
            less = lin.objective(blocks, moved, loss)[0].sum()
            assert np.isclose((more - less) / 2e-5, gradient[i, j], rtol=1e-5, atol=1e-5)


def test_spark_fit_is_stationary_and_a_spoilt_one_is_not(data):
    df, *_ = data
    model = LogisticRegression(
        labelCol="_label", weightCol="class_weight", family="multinomial", regParam=1 / 400, standardization=False, tol=1e-9, maxIter=500
    ).fit(df)
    weights = np.vstack([model.coefficientMatrix.toArray().T, model.interceptVector.toArray()])
    with lin.Blocks(df) as blocks:
        scale = 400 / sum(r.class_weight for r in df.collect())
        zero = np.linalg.norm(lin.objective(blocks, 0 * weights, lin.multinomial, scale, True)[1])
        assert np.linalg.norm(lin.objective(blocks, weights, lin.multinomial, scale, True)[1]) < 1e-4 * zero
        weights[2, 1] += 0.05
        assert np.linalg.norm(lin.objective(blocks, weights, lin.multinomial, scale, True)[1]) > 1e-3 * zero


def test_scores_are_saved_and_loaded(data, tmp_path):
    df, x, *_ = data
    weights = np.random.default_rng(2).normal(size=(3, 10))
    model = PipelineModel([lin.LinearScores(predictionCol="at", weights=weights.tolist())])
    model.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    one, two = ([r["at"] for r in m.transform(df).collect()] for m in (model, back))
    want = [float((np.append(r.features.toArray(), 1.0) @ weights.T).argmax()) for r in df.collect()]
    assert one == two == want


def test_nothing_to_fit(data):
    with lin.Blocks(data[0].limit(0)) as blocks:
        assert not lin.fit_squared_hinge(blocks, 9, 2).weights.any()


def test_words_that_most_rows_share_cost_few_passes():
    """Twelve texts with a rare word each: conjugate gradients alone take 88 passes here."""
    rng, n, rare = np.random.default_rng(8), 6000, 400
    kind = rng.integers(0, 12, n)
    words = [rng.choice(40, 6, replace=False) for _ in range(12)]
    columns = np.concatenate([[*words[k], 40 + r] for k, r in zip(kind, rng.integers(0, rare, n))])
    entries = np.tile([0.3] * 6 + [0.7], n)
    labels = np.where(rng.random(n) < 0.4, kind % 2, rng.integers(0, 2, n)).astype(float)
    block = lin._Block(np.arange(0, 7 * n + 1, 7), columns, entries, labels, np.ones(n))

    class Passes:
        rows, made = n, 0

        def total(self, of):
            self.made += 1
            return of(block)

    passes = Passes()
    fit = lin.fit_squared_hinge(passes, 40 + rare, 2)
    assert (fit.gradient <= 1e-6 * fit.first_gradient).all()
    assert passes.made < 50


def test_a_reader_holds_few_blocks(spark):
    values = array_to_vector(F.array_repeat(F.lit(1.0), lin.BLOCK_ENTRIES)).alias("features")
    rows = spark.range(0, 12, 1, 1).select(values, F.lit(0.0).alias("_label"), F.lit(1.0).alias("class_weight"))
    with lin.Blocks(rows) as blocks:
        assert blocks.rows == 12
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in blocks.table.inputFiles()]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 12 and max(groups) <= 4


def test_equal_rows_are_merged(data):
    df, x, y, c = data
    twice = df.union(df.withColumn("class_weight", F.col("class_weight") * 2)).repartition(7)
    with lin.Blocks(twice, merge=True) as blocks:
        assert blocks.rows <= 400
        fit = lin.fit_squared_hinge(blocks, 9, 3)
    assert np.allclose(fit.loss, loss_of(x, y, 3 * c, fit.weights, 1.0), rtol=1e-10)
    want = np.stack([solve(x, y, 3 * c, label, 1.0) for label in range(3)], 1)
    assert np.allclose(fit.weights, want, atol=1e-4)
