"""Reranking and evidence selection inside one row.

Candidates of a ticket travel as one short array, so everything here is a narrow array expression:
no shuffle per step, and nothing that depends on how often a query or a document occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import fixed_values as fixed
from caseloom.functions.similarity import near_duplicates
from caseloom.functions.text import col_of, normalize_tag_list
from caseloom.session import bounded_batches

TEXTS = ("issue_description", "resolution", "retrieval_text")
PAYLOAD = (
    "doc_id",
    "type",
    "queue",
    "priority",
    "tags",
    "issue_description",
    "resolution",
    "retrieval_text",
)


def candidates_per_query(
    incidents: DataFrame, threshold: float | None, with_texts: bool = True
) -> DataFrame:
    """One row per query: its incidents by rank, each with the places in that list it nearly repeats.

    Near-duplicates depend on the texts alone, so they are found once per query here and not once
    per ticket.  ``threshold=None`` leaves them out.  ``with_texts=False`` leaves the incidents' texts out of
    the candidates, for jobs that return none of them.  Groups are as long as the retrieval limit.
    Comparing texts costs far more than moving them, hence the fixed number of partitions, which
    adaptive execution does not merge by size.
    """
    bounded_batches(incidents.sparkSession)
    partitions = int(incidents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ["rank", "distance", *(c for c in PAYLOAD if with_texts or c not in TEXTS)]
    if threshold is not None:
        fields.append("normalized")
    gathered = (
        incidents.repartition(partitions, "query_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("gathered"))
    )
    if threshold is None:
        repeats = F.transform("gathered", lambda c: F.array().cast("array<int>"))
    else:
        repeats = near_duplicates(F.transform("gathered", lambda c: c["normalized"]), threshold)
    candidates = F.col("gathered")
    if threshold is not None:
        candidates = F.transform(candidates, lambda c: c.dropFields("normalized"))
    return gathered.select("query_id", candidates.alias("candidates"), repeats.alias("repeats"))


def rerank(
    candidates: Column | str,
    repeats: Column | str,
    queue: Column | str,
    ticket_type: Column | str,
    predicted: Column | str,
    payload: Sequence[str] = PAYLOAD,
) -> Column:
    """Candidates with ``adjusted_score``, best first; equal scores go by distance, then rank."""
    queue, ticket_type, predicted = col_of(queue), col_of(ticket_type), col_of(predicted)

    def boost(field: Column, wanted: Column, amount: float) -> Column:
        same = F.coalesce(field, F.lit("")) == F.coalesce(wanted, F.lit(""))
        return F.when(same, F.lit(amount)).otherwise(F.lit(0.0))

    def scored(c: Column, at: Column) -> Column:
        distance = F.coalesce(c["distance"], F.lit(1.0))
        adjusted = (
            distance
            - boost(c["queue"], queue, fixed.QUEUE_BOOST)
            - boost(c["type"], ticket_type, fixed.TYPE_BOOST)
            - boost(c["priority"], predicted, fixed.PRIORITY_BOOST)
        )
        return F.struct(
            adjusted.alias("adjusted_score"),
            distance.alias("sort_distance"),
            c["rank"].alias("rank"),
            c["distance"].alias("distance"),
            (at + 1).alias("place"),
            F.get(repeats, at).alias("repeats"),
            *[c[f].alias(f) for f in payload],
        )

    repeats = col_of(repeats)
    return F.array_sort(F.transform(col_of(candidates), scored))


def select_from(
    reranked: Column | str,
    preferred_queue: Column | str,
    max_results: int = fixed.EVIDENCE_LIMIT,
    min_same_queue: int = fixed.SAME_QUEUE_QUOTA,
) -> Column:
    """Greedy choice: same-queue candidates up to the quota first, then any up to the limit.

    A candidate is passed over when it nearly repeats a chosen one.  The result keeps the order of
    choice.  Each candidate is chosen at most once, also when its text is empty.
    """
    reranked, preferred = col_of(reranked), col_of(preferred_queue)
    with_queue = F.coalesce(preferred, F.lit("")) != ""
    first_limit = min(max_results, min_same_queue)

    def visit(first_pass: bool):
        return lambda c: F.struct(
            F.lit(first_pass).alias("first_pass"),
            c["place"].alias("place"),
            c["repeats"].alias("repeats"),
        )

    same_queue = F.filter(reranked, lambda c: with_queue & (c["queue"] == preferred))
    visits = F.concat(
        F.transform(same_queue, visit(True)), F.transform(reranked, visit(False))
    )
    start = F.struct(
        F.array().cast("array<int>").alias("chosen"),
        F.lit(False).alias("first_done"),
        F.lit(False).alias("done"),
    )

    def step(state: Column, c: Column) -> Column:
        chosen = state["chosen"]
        stopped = F.when(c["first_pass"], state["first_done"]).otherwise(state["done"])
        repeated = F.array_contains(chosen, c["place"]) | F.arrays_overlap(chosen, c["repeats"])
        after = F.when(stopped | repeated, chosen).otherwise(F.array_append(chosen, c["place"]))
        return F.struct(
            after.alias("chosen"),
            F.when(c["first_pass"], F.size(after) >= first_limit)
            .otherwise(state["first_done"])
            .alias("first_done"),
            F.when(c["first_pass"], state["done"])
            .otherwise(F.size(after) >= max_results)
            .alias("done"),
        )

    chosen = F.aggregate(visits, start, step, lambda state: state["chosen"])
    return F.transform(chosen, lambda r: F.get(F.filter(reranked, lambda c: c["place"] == r), F.lit(0)))


def with_texts(incidents: Column | str, candidates: Column | str, fields: Sequence[str]) -> Column:
    """Reranked incidents with the texts of the candidates they came from.

    Reranking and choice pass candidates from array to array, and each time copy what these hold; so they work on
    the short fields, and texts join only what is left.
    """
    candidates = col_of(candidates)
    texts = [c for c in TEXTS if c in fields]

    def joined(c: Column) -> Column:
        own = F.get(candidates, c["place"] - 1)
        for text in texts:
            c = c.withField(text, own[text])
        return c

    return F.transform(col_of(incidents), joined) if texts else col_of(incidents)


def serialize_incident(c: Column) -> Column:
    """Output form of an incident struct."""
    distance = F.coalesce(c["distance"].cast("double"), F.lit(0.0))
    return F.struct(
        c["doc_id"].alias("doc_id"),
        c["type"].alias("type"),
        c["queue"].alias("queue"),
        c["priority"].alias("priority"),
        distance.alias("distance"),
        F.coalesce(c["adjusted_score"].cast("double"), distance).alias("adjusted_score"),
        normalize_tag_list(c["tags"]).alias("tags"),
        c["issue_description"].alias("issue_description"),
        c["resolution"].alias("resolution"),
        c["rank"].alias("rank"),
        c["retrieval_text"].alias("retrieval_text"),
    )


def limit_results(evidence: Column | str, top_k: int = fixed.EVIDENCE_LIMIT) -> Column:
    return F.slice(col_of(evidence), 1, top_k)
