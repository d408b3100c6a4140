"""Retrieval, ranking, voting and the composite triage jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.operators import encoder, metric_index, ranking, retrieval, voting
from caseloom.operators.metrics import evaluation_summary
from caseloom.operators.requests import append_tickets, newest_first, manual_tickets
from caseloom.plans import triage as T
from caseloom.plans.evaluation import evaluate_cases
from caseloom.plans.text_search import build_text_memory, requests_and_candidates
from caseloom.session import fresh_path
from caseloom.streaming.triage_stream import read_stream_output, search_in, triage_stream
from workload import sql as S
from workload import views as V
from workload.cleaning_queries import REJECT_SQL
from workload.learning_queries import fitted
from workload.registry import ORACLES, query
from workload.source_queries import evaluation_sql, query_text_sql

NEAR = fixed.NEAR_DUPLICATE_RATIO
EQUAL = 1.0


def candidates(spark, sf_dir, threshold=NEAR):
    k = retrieval.overfetch_k()
    return T.retrieve_candidates(
        V.query_vectors(spark, sf_dir),
        V.knowledge_base(spark, sf_dir),
        threshold=threshold,
        hits=V.hits(spark, sf_dir, k),
    )


def light_candidates(spark, sf_dir, threshold=EQUAL):
    """Candidates for the jobs that return no incident text."""
    hits = V.hits(spark, sf_dir, retrieval.overfetch_k())
    equal_only = threshold is not None and threshold >= EQUAL
    found = retrieval.retrieved_incidents(hits, V.knowledge_base(spark, sf_dir), digests=equal_only)
    return ranking.candidates_per_query(found, threshold, with_texts=False)


def selected(spark, sf_dir, threshold=EQUAL):
    return T.select_evidence(
        V.tickets(spark, sf_dir), light_candidates(spark, sf_dir, threshold)
    )


# --- D: retrieval and ranking


@query(
    "d1_knn_topk",
    """SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM l2_hits""",
    ("l2_hits",),
)
def knn_topk(spark, sf_dir):
    hits = V.hits(spark, sf_dir, 9, metric="l2sq")
    return hits.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "d1_knn_topk_tiled",
    """SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank
FROM (SELECT query_id, doc_id, distance,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
  FROM (SELECT q.vec_id AS query_id, k.doc_id,
      power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), 2)
        AS distance
    FROM embeddings q, kb k)) WHERE rank <= 5""",
    ("kb",),
)
def knn_topk_tiled(spark, sf_dir):
    """The plan for knowledge bases too large to broadcast."""
    hits = retrieval.knn_topk(
        V.query_vectors(spark, sf_dir),
        V.knowledge_base(spark, sf_dir),
        5,
        broadcast_bytes=0,
        tile_rows=256,
    )
    return hits.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query("d1_knn_topk_pruned", ORACLES["d1_knn_topk_tiled"])
def knn_topk_pruned(spark, sf_dir):
    """The plan by pivots and the triangle inequality, for the same knowledge bases."""
    index = metric_index.build_metric_index(V.knowledge_base(spark, sf_dir), block_rows=256)
    hits = metric_index.knn_pruned(V.query_vectors(spark, sf_dir), index, 5)
    return hits.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


FILTERS = ("queue", "type")


@query(
    "d2_knn_topk_filtered",
    f"""SELECT query_id, doc_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, k.doc_id,
    power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), 2) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      list_distance(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), k.doc_id) AS rank
  FROM embeddings q JOIN kb k
    ON (q.vec_id % 3 = 0 OR k.queue = {S.text_list(V.QUEUES)}[q.vec_id % 4 + 1])
    AND (q.vec_id % 2 = 0 OR k.type = 'PROBLEM'))
WHERE rank <= 5""",
    ("kb",),
)
def knn_topk_filtered(spark, sf_dir):
    hits = retrieval.knn_topk(
        filtered_queries(spark, sf_dir), V.knowledge_base(spark, sf_dir), 5, match_on=FILTERS
    )
    return hits.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


def filtered_queries(spark, sf_dir):
    key = F.col("query_id")
    return V.query_vectors(spark, sf_dir).withColumns(
        {
            "queue_filter": F.when(key % 3 != 0, V.pick(V.QUEUES, key % 4)),
            "type_filter": F.when(key % 2 != 0, F.lit("PROBLEM")),
        }
    )


@query("d2_knn_topk_filtered_pruned", ORACLES["d2_knn_topk_filtered"])
def knn_topk_filtered_pruned(spark, sf_dir):
    """Blocks of one combination of fields: a query meets only those that can match."""
    kb = V.knowledge_base(spark, sf_dir)
    index = metric_index.build_metric_index(kb, FILTERS, block_rows=256)
    hits = metric_index.knn_pruned(filtered_queries(spark, sf_dir), index, 5)
    return hits.select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "d3_assign_rank",
    """SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.doc_id,
  round(h.distance, 6) AS distance, k.issue_description, k.resolution, k.type, k.queue, k.priority,
  array_to_string(k.tags, ', ') AS tags
FROM l2_hits h JOIN kb k USING (doc_id) WHERE h.rank <= 5""",
    ("l2_hits",),
)
def assign_rank(spark, sf_dir):
    found = retrieval.retrieved_incidents(
        V.hits(spark, sf_dir, 5, metric="l2sq"), V.knowledge_base(spark, sf_dir)
    )
    return found.drop("retrieval_text", "normalized").withColumns(
        {"distance": F.round("distance", 6), "tags": F.array_join("tags", ", ")}
    )


@query(
    "d4_overfetch_k",
    """SELECT ticket_id, greatest((1 + ticket_id % 5) * 3, 8) AS candidates,
  count(*) FILTER (WHERE h.rank <= greatest((1 + ticket_id % 5) * 3, 8)) AS fetched
FROM tickets t JOIN (SELECT query_id, row_number() OVER (PARTITION BY query_id) AS rank
  FROM (SELECT q.vec_id AS query_id FROM embeddings q JOIN kb k ON true)
  QUALIFY rank <= 15) h ON h.query_id = t.query_key GROUP BY ticket_id""",
    ("tickets", "kb"),
)
def overfetch_k(spark, sf_dir):
    """Candidates each ticket asks for at its own ``top_k``, and how many it gets."""
    wanted = F.element_at(
        F.array(*[F.lit(retrieval.overfetch_k(k)) for k in range(1, 6)]),
        (F.col("ticket_id") % 5 + 1).cast("int"),
    )
    hits = retrieval.knn_topk(
        V.query_vectors(spark, sf_dir), V.knowledge_base(spark, sf_dir), retrieval.overfetch_k(5)
    )
    fetched = hits.groupBy(F.col("query_id").alias("query_key")).agg(
        F.max("rank").cast("bigint").alias("available")
    )
    return (
        V.tickets(spark, sf_dir)
        .join(fetched, "query_key")
        .select(
            "ticket_id",
            wanted.cast("bigint").alias("candidates"),
            F.least(wanted.cast("bigint"), "available").alias("fetched"),
        )
    )


def letter_counts(texts: list[str]) -> np.ndarray:
    """Stand-in encoder for the queries and tests: letter frequencies at unit length."""
    rows = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@query(
    "d5_embed_text",
    """SELECT turn_id, 26 AS dims, round(a / nullif(sqrt(n2), 0), 4) AS first_weight FROM (
  SELECT turn_id, list_sum(list_transform(counts, lambda c: c * c)) AS n2, counts[1] AS a FROM (
    SELECT conv_id * 1000 + turn AS turn_id, list_transform(
      string_split('abcdefghijklmnopqrstuvwxyz', ''),
      lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE)) AS counts
    FROM conversations))""",
)
def embed_text(spark, sf_dir):
    texts = V.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text"
    )
    vectors = retrieval.embed_text(texts, lambda: letter_counts)
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 4)
    return vectors.select(
        "turn_id", F.size("embedding").alias("dims"), F.when(size > 0, first).alias("first_weight")
    )


TURNS_ENCODED_SQL = f"""SELECT turn_id, 64 AS dims, CAST(max(CASE WHEN known THEN 1 ELSE 0 END) AS DOUBLE) AS length
FROM (SELECT turn_id, term IS NOT NULL AND term IN (SELECT term FROM words) AS known
  FROM (SELECT conv_id * 1000 + turn AS turn_id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS term
    FROM (SELECT conv_id, turn, {S.tokens("coalesce(text, '')")} AS t FROM conversations))) GROUP BY 1"""
WORDS_SQL = f"""SELECT term FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df
  FROM (SELECT doc_id, unnest({S.tokens("text")}) AS term FROM documents) GROUP BY 1)
WHERE df >= 2 ORDER BY tf DESC, term LIMIT {encoder.MAX_TERMS}"""


@query("d5_encode_texts", f"WITH words AS MATERIALIZED ({WORDS_SQL}) {TURNS_ENCODED_SQL}")
def encode_texts(spark, sf_dir):
    """An encoder learned from all documents, applied to all turns: unit vectors where a word is known."""
    fitted_encoder = encoder.fit_encoder(V.documents(spark, sf_dir))
    turns = V.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text"
    )
    vectors = encoder.encode(turns, fitted_encoder)
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select(
        "turn_id", F.size("embedding").alias("dims"), F.round(F.sqrt(size), 4).alias("length")
    )


RANKED_SQL = """SELECT ticket_id, doc_id, CAST(rank AS INTEGER) AS rank,
  round(adjusted_score, 6) AS adjusted_score, CAST(pos AS INTEGER) AS place FROM ranked"""


@query("d6_rerank", RANKED_SQL, ("ranked",))
def rerank(spark, sf_dir):
    rows = V.unrolled(selected(spark, sf_dir), "reranked", "ticket_id")
    return rows.select(
        "ticket_id",
        "c.doc_id",
        "c.rank",
        F.round("c.adjusted_score", 6).alias("adjusted_score"),
        "place",
    )


def _evidence_rows(df):
    return V.unrolled(df, "evidence", "ticket_id").select(
        "ticket_id",
        "place",
        "c.doc_id",
        "c.queue",
        "c.priority",
        F.round("c.adjusted_score", 6).alias("adjusted_score"),
    )


EVIDENCE_SQL = """SELECT ticket_id, CAST(place AS INTEGER) AS place, doc_id, queue, priority,
  round(adjusted_score, 6) AS adjusted_score FROM evidence"""


@query("d7_dedup_incidents")
def dedup_incidents(spark, sf_dir):
    return _evidence_rows(selected(spark, sf_dir, NEAR))


@query("d7_dedup_incidents_equal_text", EVIDENCE_SQL, ("evidence",))
def dedup_incidents_equal_text(spark, sf_dir):
    return _evidence_rows(selected(spark, sf_dir))


QUOTA_SQL = """SELECT ticket_id, CAST(place AS INTEGER) AS place, doc_id, queue, priority,
  round(adjusted_score, 6) AS adjusted_score
FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY in_quota DESC, pos) AS place
  FROM (SELECT *, queue = t_queue AND row_number() OVER (
      PARTITION BY ticket_id, queue = t_queue ORDER BY pos) <= 2 AS in_quota FROM ranked))
WHERE place <= 3"""


def without_text_comparison(spark, sf_dir):
    tickets = V.tickets(spark, sf_dir)
    return T.select_evidence(tickets, light_candidates(spark, sf_dir, None))


@query("d8_same_queue_quota", QUOTA_SQL, ("ranked",))
def same_queue_quota(spark, sf_dir):
    return _evidence_rows(without_text_comparison(spark, sf_dir))


@query("d9_select_evidence")
def select_evidence(spark, sf_dir):
    chosen = T.select_evidence(V.tickets(spark, sf_dir), candidates(spark, sf_dir))
    return V.unrolled(chosen, "evidence", "ticket_id").select(
        "ticket_id", "place", "c.doc_id", "c.resolution", "c.queue"
    )


# --- E: voting


def _stats(spark, sf_dir):
    return selected(spark, sf_dir).withColumn("stats", voting.evidence_stats("evidence", "queue"))


@query(
    "e10_majority_priority",
    """SELECT ticket_id, majority_priority, CAST(majority_count AS INTEGER) AS majority_count
FROM votes""",
    ("votes",),
)
def majority_priority(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "ticket_id", "stats.majority_priority", "stats.majority_count"
    )


@query(
    "e11_queue_match",
    "SELECT ticket_id, CAST(same_queue_count AS INTEGER) AS same_queue_count FROM stats",
    ("stats",),
)
def queue_match(spark, sf_dir):
    return _stats(spark, sf_dir).select("ticket_id", "stats.same_queue_count")


@query(
    "e12_avg_distance",
    "SELECT ticket_id, round(avg_distance, 6) AS avg_distance FROM stats",
    ("stats",),
)
def avg_distance(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "ticket_id", F.round("stats.avg_distance", 6).alias("avg_distance")
    )


SUMMARY_SQL = S.fill(
    fixed.EVIDENCE_SUMMARY_FORMAT,
    predicted="ml_priority",
    count="evidence_count",
    matches="same_queue_count",
    priorities="priority_counts",
    distance="printf('%.4f', avg_distance)",
)


@query("e13_evidence_summary", f"SELECT ticket_id, {SUMMARY_SQL} AS summary FROM stats", ("stats",))
def evidence_summary(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "ticket_id", voting.evidence_summary("stats", "ml_priority").alias("summary")
    )


@query("e14_confidence_score", "SELECT ticket_id, confidence_score FROM assessed", ("assessed",))
def confidence_score(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "ticket_id", voting.confidence_score("stats", "ml_priority").alias("confidence_score")
    )


@query(
    "e15_recommend_priority", "SELECT ticket_id, recommended_priority FROM assessed", ("assessed",)
)
def recommend_priority(spark, sf_dir):
    return _stats(spark, sf_dir).select(
        "ticket_id",
        voting.recommend_priority("stats", "ml_priority").alias("recommended_priority"),
    )


@query(
    "e16_recommend_priority_simple",
    "SELECT ticket_id, simple_priority AS recommended_priority FROM assessed",
    ("assessed",),
)
def recommend_priority_simple(spark, sf_dir):
    simple = voting.recommend_priority("stats", "ml_priority", guardrail=False)
    return _stats(spark, sf_dir).select("ticket_id", simple.alias("recommended_priority"))


def evaluated_cases(spark, sf_dir, threshold=NEAR):
    key = F.col("ticket_id")
    cases = V.tickets(spark, sf_dir).withColumns(
        {
            "name": F.concat(F.lit("case "), key.cast("string")),
            "text": V.generated_text(F.col("ml_priority"), F.lit("Medium"), key),
        }
    )
    return evaluate_cases(cases, light_candidates(spark, sf_dir, threshold), decision_text="text")


@query(
    "e17_evaluation_summary",
    f"""SELECT count(*) AS total_cases,
  count(*) FILTER (WHERE ml_priority <> recommended_priority_rule) AS priority_conflicts,
  count(*) FILTER (WHERE escalation = 'Yes') AS cases_escalated,
  coalesce(round(avg(confidence_score), 2), 0.0) AS average_confidence,
  coalesce(round(avg(same_queue_ratio), 2), 0.0) AS average_same_queue_ratio
FROM ({evaluation_sql("''")})""",
    ("assessed",),
)
def evaluation_totals(spark, sf_dir):
    return evaluation_summary(evaluated_cases(spark, sf_dir, EQUAL))


def _int_counts(df):
    return df.withColumns(
        {c: F.col(c).cast("int") for c in ("same_queue_count", "num_incidents")}
    )


@query("e18_evaluate_cases")
def evaluate_all_cases(spark, sf_dir):
    return _int_counts(evaluated_cases(spark, sf_dir))


@query("e18_evaluate_cases_equal_text", evaluation_sql(query_text_sql()), ("assessed",))
def evaluate_all_cases_equal_text(spark, sf_dir):
    return _int_counts(evaluated_cases(spark, sf_dir, EQUAL))


# --- G: order, limit, append


@query(
    "g1_newest_first",
    """SELECT id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS "timestamp" FROM ui_tickets
ORDER BY "timestamp" DESC, id""",
    ("ui_tickets",),
)
def newest_tickets(spark, sf_dir):
    return newest_first(V.ui_tickets(spark, sf_dir)).select(
        "id", V.shown_time("timestamp").alias("timestamp")
    )


@query("g2_rerank_order", f"{RANKED_SQL} ORDER BY ticket_id, pos", ("ranked",))
def rerank_order(spark, sf_dir):
    return rerank(spark, sf_dir).orderBy("ticket_id", "place")


@query(
    "g3_limit_results",
    """SELECT ticket_id, string_agg(doc_id, ',' ORDER BY pos) AS doc_ids FROM ranked
WHERE pos <= 3 GROUP BY ticket_id""",
    ("ranked",),
)
def limit_results(spark, sf_dir):
    best = ranking.limit_results("reranked")
    return selected(spark, sf_dir).select(
        "ticket_id", F.array_join(F.transform(best, lambda c: c["doc_id"]), ",").alias("doc_ids")
    )


@query(
    "g4_append_tickets",
    """SELECT title, issue_description, type, queue, status, category FROM ui_tickets
UNION ALL
SELECT type || ': ' || substr(issue, 1, 52) || CASE WHEN length(issue) > 52 THEN '...' ELSE '' END,
  issue, type, queue, 'Open', 'manual' FROM tickets""",
    ("ui_tickets",),
)
def append(spark, sf_dir):
    entries = V.tickets(spark, sf_dir).withColumnRenamed("issue", "issue_description")
    feed = append_tickets(V.ui_tickets(spark, sf_dir), manual_tickets(entries))
    return feed.select("title", "issue_description", "type", "queue", "status", "category")


# --- H: composite jobs

CORE_SQL = """SELECT ticket_id, type, queue, ml_priority, recommended_priority, confidence_score,
  confidence_level, CAST(evidence_count AS INTEGER) AS evidence_count,
  CAST(same_queue_count AS INTEGER) AS same_queue_count, majority_priority,
  round(avg_distance, 6) AS avg_distance, evidence_ids FROM assessed"""


def core_rows(df):
    return df.withColumns(
        {
            "avg_distance": F.round("avg_distance", 6),
            "evidence_ids": F.array_join("evidence_ids", ","),
        }
    )


@query("h2_triage_core_equal_text", CORE_SQL, ("assessed",))
def triage_core_equal_text(spark, sf_dir):
    return core_rows(
        T.triage_core(V.tickets(spark, sf_dir), light_candidates(spark, sf_dir, EQUAL))
    )


@query("h2_triage_core")
def triage_core(spark, sf_dir):
    return core_rows(
        T.triage_core(V.tickets(spark, sf_dir), light_candidates(spark, sf_dir, NEAR))
    )


@query(
    "h1_predict_and_retrieve",
    f"""SELECT t.ticket_id, t.issue AS issue_description, t.type, t.queue,
  t.ml_priority AS predicted_priority, {query_text_sql()} AS retrieval_query, h.incidents, h.texts
FROM tickets t LEFT JOIN (SELECT query_id, string_agg(doc_id, ',' ORDER BY rank) AS incidents,
    string_agg(md5(k.issue_description || k.resolution || k.retrieval_text), ',' ORDER BY rank) AS texts
  FROM cos_hits JOIN kb k USING (doc_id) GROUP BY 1) h ON h.query_id = t.query_key""",
    ("tickets", "cos_hits"),
)
def predict_and_retrieve(spark, sf_dir):
    rows = T.predict_and_retrieve(V.tickets(spark, sf_dir), candidates(spark, sf_dir, None))
    ids = F.transform("retrieved_incidents", lambda c: c["doc_id"])
    said = ("issue_description", "resolution", "retrieval_text")
    texts = F.transform("retrieved_incidents", lambda c: F.md5(F.concat(*[c[f] for f in said])))
    return rows.withColumns(
        {"incidents": F.array_join(ids, ","), "texts": F.array_join(texts, ",")}
    ).drop("retrieved_incidents")


def asked_by_text(spark, sf_dir, threshold=NEAR):
    """Tickets whose priority the last model predicts, and incidents found by the text of their issue."""
    model, _ = fitted(spark, sf_dir, "stage5")
    memory = build_text_memory(V.past_tickets(spark, sf_dir))
    tickets = V.tickets(spark, sf_dir).drop("ml_priority", "query_key")
    return requests_and_candidates(tickets, memory, model, threshold=threshold)


@query("h1_predict_and_retrieve_by_text")
def predict_and_retrieve_by_text(spark, sf_dir):
    """The whole of it: priority from a model, query from the issue, vector from the query, incidents by the vector."""
    rows = T.predict_and_retrieve(*asked_by_text(spark, sf_dir, None))
    ids = F.transform("retrieved_incidents", lambda c: c["doc_id"])
    distances = F.transform("retrieved_incidents", lambda c: F.round(c["distance"], 4))
    return rows.withColumns(
        {"incidents": F.array_join(ids, ","), "distances": F.array_join(distances, ",")}
    ).drop("retrieved_incidents")


@query("h2_triage_by_text")
def triage_by_text(spark, sf_dir):
    return _flat(T.triage(*asked_by_text(spark, sf_dir)), "ml_predicted_priority")


@query("h2_triage_with_model")
def triage_with_model(spark, sf_dir):
    """Fit the last model, predict inside the triage of all tickets."""
    model, _ = fitted(spark, sf_dir, "stage5")
    tickets = V.tickets(spark, sf_dir).drop("ml_priority")
    return _flat(T.triage(tickets, candidates(spark, sf_dir), model=model), "ml_predicted_priority")


def _flat(responses, *more):
    """Responses with nested parts as text."""
    return responses.select(
        "ticket_id",
        "input_issue",
        "recommended_priority",
        "rag_signal_priority",
        "confidence_score",
        "confidence_level",
        "assessment_summary",
        "root_cause",
        F.array_join("action_plan", "|").alias("action_plan"),
        F.array_join("next_diagnostics", "|").alias("next_diagnostics"),
        F.array_join("evidence_from_similar_incidents", "|").alias("cited"),
        F.col("escalation_recommendation.decision").alias("escalation_decision"),
        F.col("escalation_recommendation.reason").alias("escalation_reason"),
        F.array_join(F.transform("evidence", lambda e: e["doc_id"]), ",").alias("evidence_ids"),
        F.array_join(F.transform("evidence", lambda e: F.md5(e["issue_description"])), ",").alias(
            "evidence_texts"
        ),
        F.md5("raw_decision").alias("raw_decision"),
        *more,
    )


RESPONSE_TEXT_SQL = S.fill(
    fixed.FALLBACK_DECISION_FORMAT,
    recommended="recommended_priority",
    predicted="ml_priority",
    score="confidence_score",
    level="confidence_level",
    reason=S.lit(fixed.NO_TEXT_REASON),
)
_PART = {h: f"({S.section('text', h)})" for h in fixed.SECTION_HEADERS}
_H = fixed.SECTION_HEADERS
RESPONSE_SQL = f"""SELECT ticket_id, issue AS input_issue, recommended_priority,
  recommended_priority AS rag_signal_priority, confidence_score, confidence_level,
  {_PART[_H[0]]} AS assessment_summary, {_PART[_H[1]]} AS root_cause,
  array_to_string({S.bullets(_PART[_H[3]])}, '|') AS action_plan,
  array_to_string({S.bullets(_PART[_H[4]])}, '|') AS next_diagnostics,
  array_to_string({S.bullets(_PART[_H[2]])}, '|') AS cited,
  ({S.bullets(_PART[_H[5]])})[1] AS escalation_decision,
  {S.strip(f"replace(({S.bullets(_PART[_H[5]])})[3], 'Reason:', '')")} AS escalation_reason,
  evidence_ids, evidence_texts, md5(text) AS raw_decision
FROM (SELECT a.*, x.evidence_texts, {RESPONSE_TEXT_SQL} AS text FROM assessed a
  JOIN (SELECT e.ticket_id, string_agg(k.text_md5, ',' ORDER BY e.place) AS evidence_texts
    FROM evidence e JOIN (SELECT doc_id, md5(issue_description) AS text_md5 FROM kb) k USING (doc_id)
    GROUP BY 1) x USING (ticket_id))"""


@query("h2_triage")
def triage(spark, sf_dir):
    return _flat(T.triage(V.tickets(spark, sf_dir), candidates(spark, sf_dir)))


@query("h2_triage_equal_text", RESPONSE_SQL, ("assessed",))
def triage_equal_text(spark, sf_dir):
    return _flat(T.triage(V.tickets(spark, sf_dir), candidates(spark, sf_dir, EQUAL)))


def _debug_rows(spark, sf_dir, threshold):
    rows = T.triage(V.tickets(spark, sf_dir), candidates(spark, sf_dir, threshold), debug=True)
    ids = lambda c: F.array_join(F.transform(c, lambda e: e["doc_id"]), ",").alias(c)
    arrays = [ids(c) for c in T.DEBUG_COLUMNS[:3]]
    return rows, arrays


@query("h3_triage_debug")
def triage_debug(spark, sf_dir):
    rows, arrays = _debug_rows(spark, sf_dir, NEAR)
    return _flat(rows, *arrays, "evidence_summary", F.md5("prompt").alias("prompt"))


@query(
    "h3_triage_debug_equal_text",
    f"""SELECT a.ticket_id, r.raw_ids AS raw_retrieved_incidents, r.ranked_ids AS reranked_incidents,
  a.evidence_ids AS deduplicated_incidents, {SUMMARY_SQL} AS evidence_summary
FROM assessed a JOIN (SELECT ticket_id, string_agg(doc_id, ',' ORDER BY rank) AS raw_ids,
    string_agg(doc_id, ',' ORDER BY pos) AS ranked_ids FROM ranked GROUP BY 1) r USING (ticket_id)""",
    ("assessed",),
)
def triage_debug_equal_text(spark, sf_dir):
    rows, arrays = _debug_rows(spark, sf_dir, EQUAL)
    return rows.select("ticket_id", *arrays, "evidence_summary")


@query(
    "h4_triage_no_retrieval",
    """SELECT ticket_id, type, queue, ml_priority, ml_priority AS recommended_priority,
  CAST(0.2 AS DOUBLE) AS confidence_score, 'Low' AS confidence_level, 0 AS evidence_count,
  0 AS same_queue_count, CAST(NULL AS VARCHAR) AS majority_priority,
  CAST(NULL AS DOUBLE) AS avg_distance, '' AS evidence_ids FROM tickets""",
    ("tickets",),
)
def triage_no_retrieval(spark, sf_dir):
    return core_rows(T.triage_core(V.tickets(spark, sf_dir), None))


@query(
    "h5_triage_report_text",
    "SELECT ticket_id, text AS decision FROM documents_text",
    ("documents_text",),
)
def triage_report_text(spark, sf_dir):
    tickets = V.tickets(spark, sf_dir)
    generated = V.generated_text(F.col("ml_priority"), F.lit("Medium"), F.col("ticket_id"))
    return T.triage_report_text(
        tickets.withColumn("text", generated),
        candidates(spark, sf_dir, EQUAL),
        decision_text="text",
    )


@query(
    "h6_triage_stream",
    """SELECT ticket_id, type, queue, ml_priority, recommended_priority, confidence_score,
  confidence_level, evidence_ids FROM assessed""",
    ("assessed",),
)
def stream(spark, sf_dir):
    """Events as a file stream, triaged batch by batch, then read back."""
    n_vectors = V.table(spark, sf_dir, "embeddings").count()
    schema = V.table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    output = fresh_path(spark, "triage-stream")
    kb = V.knowledge_base(spark, sf_dir)
    index = retrieval.prepare_index(kb)

    def find_candidates(vectors):
        hits = V.other_hits(vectors, index, retrieval.overfetch_k())
        return T.retrieve_candidates(vectors, kb, threshold=EQUAL, hits=hits)

    running = triage_stream(
        V.tickets_from_events(arriving, n_vectors),
        V.query_vectors(spark, sf_dir),
        find_candidates,
        output,
        fresh_path(spark, "triage-stream-state"),
        trigger={"availableNow": True},
    )
    running.awaitTermination()
    return (
        spark.read.parquet(output)
        .select(
            "ticket_id",
            F.col("input_type").alias("type"),
            F.col("input_queue").alias("queue"),
            F.col("ml_predicted_priority").alias("ml_priority"),
            "recommended_priority",
            "confidence_score",
            "confidence_level",
            F.array_join(F.transform("evidence", lambda e: e["doc_id"]), ",").alias("evidence_ids"),
        )
    )


STREAM_PARTS = 4


@query(
    "h6_triage_stream_restarted",
    f"""SELECT t.ticket_id, coalesce(r.reject_reason, 'triaged') AS outcome,
  CASE WHEN r.reject_reason IS NULL THEN t.recommended_priority END AS recommended_priority,
  CASE WHEN r.reject_reason IS NULL THEN t.evidence_ids END AS evidence_ids
FROM assessed t JOIN ({REJECT_SQL}) r USING (ticket_id)""",
    ("assessed", "raw_tickets"),
)
def restarted_stream(spark, sf_dir):
    """Spoilt tickets in several files, one a micro-batch; the stream ends when half of them are there and is
    started again from its checkpoint for the rest.  Accepted and rejected tickets are read back together."""
    events, incoming = V.table(spark, sf_dir, "events"), fresh_path(spark, "stream-in")
    outputs = {name: fresh_path(spark, f"stream-{name}") for name in ("out", "rejects", "state")}
    n_vectors = V.table(spark, sf_dir, "embeddings").count()
    kb, vectors = V.knowledge_base(spark, sf_dir), V.query_vectors(spark, sf_dir)
    index = retrieval.prepare_index(kb)

    def find_candidates(asked):
        hits = V.other_hits(asked, index, retrieval.overfetch_k())
        return T.retrieve_candidates(asked, kb, threshold=EQUAL, hits=hits)

    part = F.pmod(F.xxhash64("event_id"), F.lit(STREAM_PARTS))
    for some in (part < STREAM_PARTS // 2, part >= STREAM_PARTS // 2):
        arrived = events.filter(some).repartition(STREAM_PARTS // 2)
        arrived.write.mode("append").parquet(incoming)
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        triage_stream(
            V.spoilt(V.tickets_from_events(source, n_vectors)), vectors, find_candidates,
            outputs["out"], outputs["state"], trigger={"availableNow": True}, rejects=outputs["rejects"],
        ).awaitTermination()
    done, refused = (read_stream_output(spark, outputs[name]) for name in ("out", "rejects"))
    ids = F.array_join(F.transform("evidence", lambda e: e["doc_id"]), ",")
    nothing = F.lit(None).cast("string")
    return done.select(
        "ticket_id", F.lit("triaged").alias("outcome"), "recommended_priority", ids.alias("evidence_ids")
    ).unionAll(refused.select("ticket_id", "reject_reason", nothing, nothing))


@query("h6_triage_stream_with_model")
def stream_with_model(spark, sf_dir):
    """Tickets without a priority: the last model predicts it inside the stream."""
    events = V.table(spark, sf_dir, "events")
    model, _ = fitted(spark, sf_dir, "stage5")
    n_vectors = V.table(spark, sf_dir, "embeddings").count()
    kb, output = V.knowledge_base(spark, sf_dir), fresh_path(spark, "stream-out")
    arriving = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    triage_stream(
        V.tickets_from_events(arriving, n_vectors).drop("ml_priority"), V.query_vectors(spark, sf_dir),
        search_in(kb, metric="cosine"), output, fresh_path(spark, "stream-state"), model=model,
        trigger={"availableNow": True},
    ).awaitTermination()
    return _flat(read_stream_output(spark, output), "ml_predicted_priority")


@query("h3_triage_debug_with_model")
def triage_debug_with_model(spark, sf_dir):
    model, _ = fitted(spark, sf_dir, "stage5")
    tickets = V.tickets(spark, sf_dir).drop("ml_priority")
    rows = T.triage(tickets, candidates(spark, sf_dir, EQUAL), debug=True, model=model)
    return rows.select("ticket_id", "ml_predicted_priority", "evidence_summary", F.md5("prompt").alias("prompt"))


@query("h5_triage_report_with_model")
def triage_report_with_model(spark, sf_dir):
    """The report text for tickets whose priority the model predicts."""
    model, _ = fitted(spark, sf_dir, "stage5")
    tickets = T.predicted(V.tickets(spark, sf_dir).drop("ml_priority"), model)
    generated = V.generated_text(F.col("ml_priority"), F.lit("Medium"), F.col("ticket_id"))
    return T.triage_report_text(
        tickets.withColumn("text", generated), candidates(spark, sf_dir, EQUAL), decision_text="text"
    )


@query(
    "b14_to_analysis_result",
    f"""SELECT ticket_id, ml_priority, recommended_priority, confidence_score,
  confidence_level AS confidence_label, {S.strip(_PART[_H[5]])} AS escalation_decision,
  {_PART[_H[1]]} AS root_cause, {_PART[_H[0]]} AS priority_reasoning,
  array_to_string({S.bullets(_PART[_H[3]])}, '|') AS action_plan,
  array_to_string({S.bullets(_PART[_H[4]])}, '|') AS diagnostic_steps,
  evidence_ids AS similar_ids, similarities, 0 AS traced
FROM (SELECT a.*, x.similarities, {RESPONSE_TEXT_SQL} AS text FROM assessed a
  JOIN (SELECT ticket_id, string_agg(printf('%.4f', 1 / (1 + distance)), ',' ORDER BY place)
      AS similarities FROM evidence GROUP BY 1) x USING (ticket_id))""",
    ("assessed",),
)
def to_analysis_result(spark, sf_dir):
    responses = T.triage(V.tickets(spark, sf_dir), candidates(spark, sf_dir, EQUAL))
    result = T.to_analysis_result(responses)
    similar = "similar_incidents"
    return result.select(
        "ticket_id",
        "ml_priority",
        "recommended_priority",
        "confidence_score",
        "confidence_label",
        "escalation_decision",
        "root_cause",
        "priority_reasoning",
        F.array_join("action_plan", "|").alias("action_plan"),
        F.array_join("diagnostic_steps", "|").alias("diagnostic_steps"),
        F.array_join(F.transform(similar, lambda e: e["id"]), ",").alias("similar_ids"),
        F.array_join(
            F.transform(similar, lambda e: F.format_string("%.4f", e["similarity_score"])), ","
        ).alias("similarities"),
        F.size("debug_trace.reranked_results").alias("traced"),
    )
