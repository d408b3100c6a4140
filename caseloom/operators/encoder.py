"""Text to vector: latent semantic analysis of the corpus itself, fitted and applied as Spark jobs.

Texts become TF-IDF rows over a vocabulary of limited size.  Their leading right singular vectors are found by a
randomised range finder: a random block of ``width`` directions is multiplied by the rows' Gram matrix a few times and
made orthonormal in between.  A multiplication is one pass: each task multiplies its rows with the block, adds up
its share of the product, and hands it on in slices of the vocabulary, which are summed by slice.  Only matrices
of vocabulary times width ever meet on the driver, whatever the corpus.  The rows are built once, from terms that Spark
extracts, and written to the shared folder; every pass reads that table.

A text's vector is its TF-IDF row times the singular vectors, at length one.  Null texts, and texts without a known
word, get the vector of zeros, which has no cosine distance and is therefore nobody's neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import col_of
from caseloom.operators.features import ngrams_1_2, remove_stopwords, tokenize, vocabulary
from caseloom.session import written

DIMENSIONS = 64
OVERSAMPLING = 16
POWER_ROUNDS = 2
MAX_TERMS = 20_000
SLICE_TERMS = 512
CHUNK_TERMS = 1 << 15  # term occurrences that are multiplied at once
ROWS_SCHEMA = "terms array<int>, weights array<double>"


@dataclass(frozen=True)
class Encoder:
    """A fitted encoder: terms in order, their idf, one row of ``matrix`` per term, singular values."""

    terms: tuple[str, ...]
    idf: np.ndarray
    matrix: np.ndarray
    singular: np.ndarray
    stop_words: tuple[str, ...]
    bigrams: bool

    @property
    def dimensions(self) -> int:
        return self.matrix.shape[1]


def text_terms(text: Column | str, stop_words: Sequence[str], bigrams: bool) -> Column:
    """Terms of a text; none for null."""
    kept = remove_stopwords(tokenize(F.coalesce(col_of(text), F.lit(""))), stop_words)
    return ngrams_1_2(kept) if bigrams else kept


def _weighted(lists: pa.ListArray, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of TF-IDF weights at length one as (offsets, term numbers, weights); unknown terms are left out."""
    n = len(lists)
    number = pc.index_in(lists.flatten(), value_set=terms)
    owner = np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets)))
    known = np.asarray(number.is_valid())
    number = np.asarray(number.fill_null(0))[known].astype(np.int64)
    cells, counts = np.unique(owner[known] * len(terms) + number, return_counts=True)
    row, number = cells // max(1, len(terms)), cells % max(1, len(terms))
    weights = counts * idf[number]
    length = np.sqrt(np.bincount(row, weights**2, minlength=n))
    return np.searchsorted(row, np.arange(n + 1)), number, weights / length[row]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows with about ``CHUNK_TERMS`` entries."""
    at = 0
    while at < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[at] + CHUNK_TERMS, "right")) - 1
        stop = min(max(stop, at + 1), len(offsets) - 1)
        yield at, stop
        at = stop


def _times(offsets: np.ndarray, number: np.ndarray, weights: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense block."""
    out = np.zeros((len(offsets) - 1, block.shape[1]))
    for lo, hi in _chunks(offsets):
        a, b = offsets[lo], offsets[hi]
        filled = np.flatnonzero(np.diff(offsets[lo : hi + 1]))
        if len(filled):
            parts = block[number[a:b]] * weights[a:b, None]
            out[lo + filled] = np.add.reduceat(parts, offsets[lo + filled] - a, axis=0)
    return out


def _add_outer(total: np.ndarray, offsets: np.ndarray, number: np.ndarray, weights: np.ndarray, dense: np.ndarray) -> None:
    """Add the transposed sparse rows times their dense rows to ``total``."""
    for lo, hi in _chunks(offsets):
        a, b = offsets[lo], offsets[hi]
        if a == b:
            continue
        owner = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
        order = np.argsort(number[a:b], kind="stable")
        sorted_number = number[a:b][order]
        first = np.flatnonzero(np.diff(sorted_number, prepend=-1))
        parts = dense[owner[order]] * weights[a:b][order, None]
        total[sorted_number[first]] += np.add.reduceat(parts, first, axis=0)


def tfidf_rows(df: DataFrame, terms: Sequence[str], idf: np.ndarray, column: str) -> DataFrame:
    """TF-IDF rows of the term lists in ``column``, one per row of ``df``: ``terms, weights``."""
    shared = df.sparkSession.sparkContext.broadcast((list(terms), idf))

    def run(batches):
        known, weight = shared.value
        known = pa.array(known, pa.string())
        for batch in batches:
            offsets, number, weights = _weighted(_lists(batch.column(0)), known, weight)
            at = pa.array(offsets.astype(np.int32))
            columns = [
                pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(weights)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["terms", "weights"])

    return df.select(column).mapInArrow(run, ROWS_SCHEMA)


def _lists(column: pa.Array) -> pa.ListArray:
    """A list column whose offsets begin at its own first entry."""
    return pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), column.type)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = _lists(batch.column(0))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    weights = np.asarray(_lists(batch.column(1)).flatten())
    return offsets - offsets[0], np.asarray(lists.flatten()).astype(np.int64), weights


def gram_times(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The rows' Gram matrix (terms by terms) times ``block``, without building that matrix."""
    size, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def multiply(batches):
        total = np.zeros((size, width))
        for batch in batches:
            offsets, number, weights = _entries(batch)
            _add_outer(total, offsets, number, weights, _times(offsets, number, weights, shared.value))
        for at in range(0, size, SLICE_TERMS):
            part = total[at : at + SLICE_TERMS]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"slice": at // SLICE_TERMS, "body": part.tobytes()}])

    def add_up(batches):
        at, total = None, None
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(body).reshape(-1, width)
                if number != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"slice": at, "body": total.tobytes()}])
                    at, total = number, part.copy()
                else:
                    total += part
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"slice": at, "body": total.tobytes()}])

    kind = "slice long, body binary"
    parts = rows.mapInArrow(multiply, kind).withColumn("part", F.spark_partition_id())
    # sums in one order, so that a fit can be repeated
    sums = parts.repartition("slice").sortWithinPartitions("slice", "part").select("slice", "body")
    out = np.zeros((size, width))
    for row in sums.mapInArrow(add_up, kind).collect():  # vocabulary times width numbers
        at = row["slice"] * SLICE_TERMS
        out[at : at + SLICE_TERMS] = np.frombuffer(row["body"]).reshape(-1, width)
    shared.destroy()
    return out


def singular_vectors(
    rows: DataFrame, n_terms: int, dimensions: int = DIMENSIONS, oversampling: int = OVERSAMPLING,
    rounds: int = POWER_ROUNDS, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (as columns) and singular values of sparse rows."""
    width = min(n_terms, dimensions + oversampling)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(gram_times(rows, block))[0]
    # Rayleigh-Ritz: the Gram matrix seen from inside the range that was found
    values, turn = np.linalg.eigh(block.T @ gram_times(rows, block))
    best = np.argsort(values)[::-1][: min(dimensions, width)]
    vectors = block @ turn[:, best]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(best))])
    return vectors * np.where(signs == 0, 1.0, signs), np.sqrt(np.maximum(values[best], 0.0))


def fit_encoder(
    texts: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, min_df: int = 2,
    max_terms: int = MAX_TERMS, stop_words: Sequence[str] = (), bigrams: bool = False,
    rounds: int = POWER_ROUNDS, seed: int = 7,
) -> Encoder:
    """Learn an encoder from all ``texts``.

    The ``max_terms`` most frequent terms in at least ``min_df`` texts are its vocabulary; this and ``dimensions``
    bound what the driver and the tasks hold.  Without any such term every vector is empty.
    """
    stop = tuple(stop_words)
    with_terms = written(texts.select(text_terms(text, stop, bigrams).alias("found")), "encoder-terms")
    found = sorted(vocabulary(with_terms, "found", min_df, max_terms).collect())  # at most max_terms rows
    n = with_terms.count()
    terms = tuple(r["term"] for r in found)
    idf = np.array([math.log((1.0 + n) / (1.0 + r["df"])) + 1.0 for r in found])
    if not terms:
        return Encoder((), idf, np.zeros((0, 0)), np.zeros(0), stop, bigrams)
    rows = written(tfidf_rows(with_terms, terms, idf, "found"), "encoder-rows")
    matrix, singular = singular_vectors(rows, len(terms), dimensions, rounds=rounds, seed=seed)
    return Encoder(terms, idf, matrix, singular, stop, bigrams)


def encode(df: DataFrame, encoder: Encoder, text: str = "text", output: str = "embedding") -> DataFrame:
    """``df`` with the vectors of its texts; other columns are carried along."""
    spark, terms = df.sparkSession, "_encoder_terms"
    shared = spark.sparkContext.broadcast((list(encoder.terms), encoder.idf, encoder.matrix))
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    names = df.columns

    def run(batches):
        known, idf, matrix = shared.value
        known, width = pa.array(known, pa.string()), matrix.shape[1]
        for batch in batches:
            lists = _lists(batch.column(len(names)))
            if len(known):
                vectors = _times(*_weighted(lists, known, idf), matrix)
            else:
                vectors = np.zeros((len(lists), width))
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = (vectors / np.where(length > 0, length, 1.0)).astype(np.float32)
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * width)
            column = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), column], names=schema.fieldNames()
            )

    found = text_terms(text, encoder.stop_words, encoder.bigrams).alias(terms)
    return df.select("*", found).mapInArrow(run, schema)


def save_encoder(spark: SparkSession, encoder: Encoder, path: str) -> None:
    """Write an encoder to shared storage: a table of terms and one of the rest."""
    rows = [
        (i, t, float(w), v.tolist()) for i, (t, w, v) in enumerate(zip(encoder.terms, encoder.idf, encoder.matrix))
    ]
    terms = spark.createDataFrame(rows, "number long, term string, idf double, vector array<double>")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    rest = [(encoder.singular.tolist(), list(encoder.stop_words), encoder.bigrams, encoder.matrix.shape[1])]
    schema = "singular array<double>, stop_words array<string>, bigrams boolean, dimensions long"
    spark.createDataFrame(rest, schema).write.mode("overwrite").parquet(f"{path}/settings")


def load_encoder(spark: SparkSession, path: str) -> Encoder:
    rows = spark.read.parquet(f"{path}/terms").orderBy("number").collect()  # bounded when it was fitted
    rest = spark.read.parquet(f"{path}/settings").first()
    matrix = np.array([r["vector"] for r in rows]).reshape(len(rows), rest["dimensions"])
    return Encoder(
        tuple(r["term"] for r in rows), np.array([r["idf"] for r in rows]), matrix,
        np.array(rest["singular"]), tuple(rest["stop_words"]), rest["bigrams"],
    )
