"""Search by the text of the issue: encode the query text of each ticket and the incidents, then search.

The encoder is learned from the incidents (``operators.encoder``), the search is exact and by blocks
(``operators.metric_index``).  A vector knows the words of the vocabulary and nothing else, so query texts that differ in
other words have the same one; all of these share one search, one comparison of what is found, and as their key the
smallest of the texts.  A ticket whose text has no known word finds nothing and keeps its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.text import build_query
from caseloom.operators.encoder import Encoder, encode, fit_encoder
from caseloom.operators.metric_index import MetricIndex, build_metric_index, knn_pruned
from caseloom.operators.retrieval import overfetch_k
from caseloom.plans.triage import normalize_requests, predicted, retrieve_candidates
from caseloom.session import written


@dataclass(frozen=True)
class TextMemory:
    """Past incidents with an encoder learned from them and an index of their vectors."""

    incidents: DataFrame
    encoder: Encoder
    index: MetricIndex


def build_text_memory(incidents: DataFrame, encoder: Encoder | None = None, **encoder_options) -> TextMemory:
    """Encode and index the ``retrieval_text`` of incidents; learns the encoder if none is given.

    Incidents and vectors are written first, as encoder, index and search read them several times.
    """
    incidents = written(incidents, "incidents")
    encoder = encoder or fit_encoder(incidents, "retrieval_text", **encoder_options)
    vectors = encode(incidents.select("doc_id", "retrieval_text"), encoder, "retrieval_text")
    vectors = written(vectors.select("doc_id", "embedding"), "incident-vectors")
    return TextMemory(incidents, encoder, build_metric_index(vectors, metric="cosine"))


def with_query_text(tickets: DataFrame) -> DataFrame:
    """Tickets with their retrieval text as ``query_key``."""
    return tickets.withColumn("query_key", build_query("issue", "type", "queue"))


def share_queries(tickets: DataFrame, memory: TextMemory) -> tuple[DataFrame, DataFrame]:
    """Tickets ``with_query_text`` keyed by one text for all with an equal vector, and these texts' vectors.

    The vectors are ``query_id, embedding``, one row per different vector.
    """
    texts = tickets.select(F.col("query_key").alias("query_id")).distinct()
    vectors = written(encode(texts, memory.encoder, "query_id"), "query-vectors")
    shared = written(vectors.groupBy("embedding").agg(F.min("query_id").alias("shared_id")), "shared-vectors")
    keys = vectors.join(shared, "embedding").select(F.col("query_id").alias("query_key"), "shared_id")
    keyed = tickets.join(keys, "query_key", "left").withColumn("query_key", F.col("shared_id")).select(*tickets.columns)
    return keyed, shared.select(F.col("shared_id").alias("query_id"), "embedding")


def retrieve_by_text(
    vectors: DataFrame, memory: TextMemory, top_k: int = fixed.EVIDENCE_LIMIT,
    threshold: float | None = fixed.NEAR_DUPLICATE_RATIO,
) -> DataFrame:
    """Candidates per vector of ``share_queries``: (query_id, candidates, repeats)."""
    hits = knn_pruned(vectors, memory.index, overfetch_k(top_k))
    return retrieve_candidates(vectors, memory.incidents, top_k, threshold, hits=hits)


def requests_and_candidates(
    tickets: DataFrame, memory: TextMemory, model: PipelineModel | None = None,
    top_k: int = fixed.EVIDENCE_LIMIT, threshold: float | None = fixed.NEAR_DUPLICATE_RATIO,
) -> tuple[DataFrame, DataFrame]:
    """Normalised, predicted tickets with the key of their query text, and the candidates for them.

    What ``plans.triage`` takes: ``triage(*requests_and_candidates(tickets, memory, model))``.
    """
    asked, vectors = share_queries(with_query_text(normalize_requests(tickets)), memory)
    return predicted(asked, model), retrieve_by_text(vectors, memory, top_k, threshold)
