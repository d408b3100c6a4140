"""Linear classifiers by truncated Newton steps, and first-order checks of any linear fit.

The deployed model minimises, for each label against the rest,
``|w|^2 / 2 + sum(c_i * max(0, 1 - y_i * w.x_i)^2)`` with the intercept as a weight like the others.  Spark's own
class takes the hinge without the square, hence this one.  All labels are fitted at once: a pass over the rows gives the
gradients, Hessian products or losses of every label, and rows only meet matrices of features times labels.

Rows are packed into sparse blocks once and written to the shared folder.  A pass maps the blocks and adds the
results up in a tree of tasks; the driver holds a few such matrices and takes the steps: conjugate gradients inside, a
line search along the step, for which one pass gives the losses at all step lengths.

A few directions that most rows share (frequent words, categories) carry nearly all of the Hessian, and conjugate
gradients would spend a pass on each of them in every step.  One wide pass finds ``RANK`` of them at the start, by a
Nystrom approximation of the rows' weighted Gram matrix; the gradients are scaled down along these.  That changes how
many passes a fit takes, not what it converges to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import written

BLOCK_ENTRIES = 1 << 18
STEPS = 0.5 ** np.arange(12)
TOLERANCE = 1e-6
MAX_NEWTON, MAX_INNER = 100, 200
RANK = 64  # directions of the preconditioner
# A block is one row of a table.  Writers look at their memory every 100 rows unless told otherwise, and readers hold a whole
# row group: 500 MB of blocks for each task.
_SMALL_GROUPS = {"parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "4", "parquet.enable.dictionary": "false"}
_BLOCK = "n long, starts binary, columns binary, entries binary, labels binary, weights binary"


@dataclass(frozen=True)
class Fit:
    """Weights (features and last the intercept, by label), and per label what the fit came to."""

    weights: np.ndarray
    loss: np.ndarray
    gradient: np.ndarray  # norm at the end
    first_gradient: np.ndarray  # norm at zero weights
    iterations: int


class Blocks:
    """Labelled sparse rows in blocks of about ``BLOCK_ENTRIES`` entries, to be passed over many times.

    With ``merge`` rows of equal features and label become one with the sum of their weights, so that no pass sees them twice:
    the objective is the same sum.
    """

    def __init__(
        self, rows: DataFrame, features: str = "features", label: str = "_label", weight: str = "class_weight", merge: bool = False
    ):
        parts = F.unwrap_udt(F.col(features)).alias("v")
        packed = rows.select(
            parts, F.col(label).cast("double").alias("label"), F.col(weight).cast("double").alias("weight")
        ).select("v.indices", "v.values", "label", "weight")
        if merge:
            packed = packed.groupBy("indices", "values", "label").agg(F.sum("weight").alias("weight"))
        self.table = written(packed.mapInArrow(_packed, _BLOCK), "linear-blocks", **_SMALL_GROUPS)
        self.rows = self.table.agg(F.sum("n")).first()[0] or 0

    def __enter__(self) -> Blocks:
        self.rdd = self.table.rdd.map(_unpacked).persist()
        return self

    def __exit__(self, *_) -> None:
        self.rdd.unpersist()

    def total(self, of: Callable[[_Block], np.ndarray]) -> np.ndarray:
        """The sum over all blocks, added up in a tree of tasks."""
        return self.rdd.map(of).treeReduce(np.add, depth=2)


@dataclass(frozen=True)
class _Block:
    starts: np.ndarray
    columns: np.ndarray
    entries: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Rows, each with a last entry of one, times a matrix."""
        out = np.zeros((len(self.labels), matrix.shape[1]))
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            first = self.starts[filled]
            for j in range(matrix.shape[1]):  # several times as fast as all columns at once
                weights = np.ascontiguousarray(matrix[:, j])
                out[filled, j] = np.add.reduceat(weights[self.columns] * self.entries, first)
        return out + matrix[-1]

    def back(self, per_row: np.ndarray, size: int) -> np.ndarray:
        """The transposed rows times a matrix with a line per row."""
        owner = np.repeat(np.arange(len(self.labels)), np.diff(self.starts))
        out = np.empty((size, per_row.shape[1]))
        for j in range(per_row.shape[1]):
            line = np.ascontiguousarray(per_row[:, j])
            out[:, j] = np.bincount(self.columns, self.entries * line[owner], minlength=size)
        out[-1] = per_row.sum(0)
        return out

    def signs(self, n_labels: int) -> np.ndarray:
        return np.where(self.labels[:, None] == np.arange(n_labels), 1.0, -1.0)


def _packed(batches):
    for batch in batches:
        held, rows = [], 0
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for indices, values, label, weight in zip(*columns):
            values = values or []
            held.append((range(len(values)) if indices is None else indices, values, label, weight))
            rows += len(values)
            if rows >= BLOCK_ENTRIES:
                yield _block_row(held)
                held, rows = [], 0
        if held:
            yield _block_row(held)


def _block_row(held: list) -> pa.RecordBatch:
    starts = np.cumsum([0, *(len(h[1]) for h in held)])
    columns = np.array([c for h in held for c in h[0]], np.int64)
    entries = np.array([x for h in held for x in h[1]], np.float64)
    arrays = (starts, columns, entries, np.array([h[2] for h in held]), np.array([h[3] for h in held]))
    names = ["starts", "columns", "entries", "labels", "weights"]
    return pa.RecordBatch.from_pylist([{"n": len(held)} | {n: a.tobytes() for n, a in zip(names, arrays)}])


def _unpacked(row) -> _Block:
    ints, floats = (lambda b: np.frombuffer(b, np.int64)), (lambda b: np.frombuffer(b, np.float64))
    return _Block(ints(row.starts), ints(row.columns), floats(row.entries), floats(row.labels), floats(row.weights))


# What a pass computes.  Losses and gradients are of the sums over rows, without the regularisation.


def _hinge(block: _Block, weights: np.ndarray, strength: float) -> tuple[np.ndarray, ...]:
    """Signs, margins still missing, and the rows' cost factors, per label."""
    signs = block.signs(weights.shape[1])
    missing = np.maximum(0.0, 1.0 - signs * block.times(weights))
    return signs, missing, strength * block.weights[:, None]


def squared_hinge(weights: np.ndarray, strength: float) -> Callable[[_Block], np.ndarray]:
    """Gradient per label, and in one more line the loss."""

    def of(block: _Block) -> np.ndarray:
        signs, missing, cost = _hinge(block, weights, strength)
        slope = block.back(-2.0 * cost * signs * missing, len(weights))
        return np.vstack([slope, (cost * missing**2).sum(0)])

    return of


def _hessian_times(weights: np.ndarray, strength: float, direction: np.ndarray) -> Callable[[_Block], np.ndarray]:
    def of(block: _Block) -> np.ndarray:
        _, missing, cost = _hinge(block, weights, strength)
        return block.back(2.0 * cost * (missing > 0) * block.times(direction), len(weights))

    return of


def _losses_along(weights: np.ndarray, strength: float, step: np.ndarray) -> Callable[[_Block], np.ndarray]:
    """Losses per step length and label."""

    def of(block: _Block) -> np.ndarray:
        signs, cost = block.signs(weights.shape[1]), strength * block.weights[:, None]
        here, along = signs * block.times(weights), signs * block.times(step)
        return np.stack([(cost * np.maximum(0.0, 1.0 - here - t * along) ** 2).sum(0) for t in STEPS])

    return of


def _gram_times(directions: np.ndarray) -> Callable[[_Block], np.ndarray]:
    """The Hessian with all rows inside their margins, times some directions."""

    def of(block: _Block) -> np.ndarray:
        return block.back(2.0 * block.weights[:, None] * block.times(directions), len(directions))

    return of


def multinomial(weights: np.ndarray, strength: float) -> Callable[[_Block], np.ndarray]:
    """Gradient per label of the weighted cross-entropy, and in one more line its loss, a share for each label."""

    def of(block: _Block) -> np.ndarray:
        scores = block.times(weights)
        scores -= scores.max(1, keepdims=True)
        chances = np.exp(scores)
        chances /= chances.sum(1, keepdims=True)
        truth = block.labels[:, None] == np.arange(weights.shape[1])
        cost = strength * block.weights[:, None]
        slope = block.back(cost * (chances - truth), len(weights))
        return np.vstack([slope, -(cost * np.where(truth, np.log(np.maximum(chances, 1e-300)), 0.0)).sum(0)])

    return of


def objective(
    blocks: Blocks, weights: np.ndarray, loss: Callable = squared_hinge, strength: float = 1.0,
    free_intercept: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Regularised loss and gradient per label at some weights; the intercept may be free of regularisation."""
    held = weights.copy()
    if free_intercept:
        held[-1] = 0.0
    out = blocks.total(loss(weights, strength))
    return out[-1] + (held**2).sum(0) / 2.0, out[:-1] + held


def fit_squared_hinge(
    blocks: Blocks, n_features: int, n_labels: int, strength: float = 1.0, tolerance: float = TOLERANCE,
    max_iter: int = MAX_NEWTON,
) -> Fit:
    """Weights of each label against the rest.

    A label is done when its gradient's norm has fallen to ``tolerance`` of what it was at zero.
    """
    weights = np.zeros((n_features + 1, n_labels))
    if not blocks.rows:
        nothing = np.zeros(n_labels)
        return Fit(weights, nothing, nothing, nothing, 0)
    value, gradient = objective(blocks, weights, strength=strength)
    first = np.linalg.norm(gradient, axis=0)
    scaled = _preconditioner(blocks, n_features + 1, strength)
    for iteration in range(max_iter):
        open_labels = np.linalg.norm(gradient, axis=0) > tolerance * first
        if not open_labels.any():
            break
        step = _newton_step(blocks, weights, strength, gradient * open_labels, scaled)
        ahead = blocks.total(_losses_along(weights, strength, step))
        lengths = ((weights[None] + STEPS[:, None, None] * step[None]) ** 2).sum(1) / 2.0
        wanted = value + 1e-4 * STEPS[:, None] * (gradient * step).sum(0)
        good = ahead + lengths <= wanted + 1e-12 * np.abs(value)
        chosen = np.where(good.any(0), STEPS[good.argmax(0)], 0.0) * open_labels
        if not chosen.any():  # rounding leaves nothing to gain
            break
        weights = weights + chosen * step
        value, gradient = objective(blocks, weights, strength=strength)
    else:
        iteration = max_iter
    return Fit(weights, value, np.linalg.norm(gradient, axis=0), first, iteration)


def _preconditioner(blocks: Blocks, size: int, strength: float, seed: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """Scales gradients down along the ``RANK`` heaviest directions of the rows, to about the weight of the next ones."""
    rank = min(RANK, size)
    asked = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    found = strength * blocks.total(_gram_times(asked))
    shift = np.sqrt(size) * np.finfo(float).eps * np.linalg.norm(found)
    moved = found + shift * asked
    try:
        root = np.linalg.cholesky((asked.T @ moved + moved.T @ asked) / 2.0)
        heavy, weight, _ = np.linalg.svd(np.linalg.solve(root, moved.T).T, full_matrices=False)
    except np.linalg.LinAlgError:  # no weight in some direction: nothing to scale
        return lambda slope: slope
    weight = np.maximum(weight**2 - shift, 0.0)
    factor = ((weight[-1] + 1.0) / (weight + 1.0) - 1.0)[:, None]
    return lambda slope: slope + heavy @ (factor * (heavy.T @ slope))


def _newton_step(
    blocks: Blocks, weights: np.ndarray, strength: float, gradient: np.ndarray, scaled: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Newton directions of all labels by conjugate gradients, each as exact as its gradient is small."""
    step = np.zeros_like(weights)
    rest = -gradient
    left = (rest**2).sum(0)
    goal = left * np.minimum(0.1, np.sqrt(np.sqrt(left))) ** 2
    direction = scaled(rest)
    size = (rest * direction).sum(0)
    for _ in range(MAX_INNER):
        going = left > np.maximum(goal, 1e-300)
        if not going.any():
            break
        curved = direction + blocks.total(_hessian_times(weights, strength, direction))
        bend = (direction * curved).sum(0)
        rate = np.where(going & (bend > 0), size / np.where(bend > 0, bend, 1.0), 0.0)
        step += rate * direction
        rest = rest - rate * curved
        left = (rest**2).sum(0)
        ahead = scaled(rest)
        new = (rest * ahead).sum(0)
        direction = np.where(going, ahead + new / np.where(size > 0, size, 1.0) * direction, 0.0)
        size = np.where(going, new, 0.0)
        left = np.where(going, left, 0.0)
    return step


class LinearScores(
    Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Adds the number of the label with the highest score; ties go to the lowest number.

    ``weights`` holds one list per label, the intercept last.
    """

    weights = Param(Params._dummy(), "weights", "weights by label, intercept last")

    @keyword_only
    def __init__(self, *, featuresCol="features", predictionCol="prediction", weights=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        matrix = np.array(self.getOrDefault(self.weights), float).T
        shared = dataset.sparkSession.sparkContext.broadcast(matrix)

        @F.arrow_udf(T.DoubleType())
        def predict(vectors: pa.Array) -> pa.Array:
            indices, values = vectors.field("indices"), vectors.field("values")
            starts = np.asarray(values.offsets).astype(np.int64)
            entries = np.asarray(values.flatten())
            if indices.null_count:  # dense vectors among them
                columns = [
                    c for i, v in zip(indices.to_pylist(), values.to_pylist()) for c in (range(len(v)) if i is None else i)
                ]
            else:
                columns = np.asarray(indices.flatten())
            block = _Block(
                starts - starts[0], np.asarray(columns, np.int64), entries, np.zeros(len(vectors)), np.zeros(len(vectors))
            )
            return pa.array(block.times(shared.value).argmax(1).astype(np.float64))

        vectors = F.unwrap_udt(F.col(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), predict(vectors))
