"""Ticket, knowledge-base and training views of the test tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.retrieval import Index, knn_topk
from caseloom.session import spread

ISSUES = (
    "Users cannot login after password reset",
    "Account locked after failed attempts to sign in",
    "Payment gateway rejects every transaction",
    "Pages are slow and requests hit a timeout",
    "API returns errors for enterprise customers",
    "Database connection pool is exhausted",
    "Deployment of the latest release changed settings",
    "Service outage and application crash on start",
    "Feedback about the colour of the dashboard",
    "Rapid growth of the mailbox",
    "Please download the manual for me",
    "Printer makes a strange noise",
)
QUEUES = ("TECHNICAL SUPPORT", "CUSTOMER SERVICE", "PRODUCT SUPPORT", "BILLING AND PAYMENTS")
STOP_WORDS = (
    "about", "after", "and", "are", "at", "by", "de", "der", "die", "el", "en", "every", "for",
    "from", "in", "is", "la", "le", "me", "of", "on", "or", "that", "the", "this", "to", "und",
    "with",
)
QUEUE_OF_EVENT = {
    "error": "TECHNICAL SUPPORT",
    "purchase": "BILLING AND PAYMENTS",
    "signup": "CUSTOMER SERVICE",
}
OTHER_QUEUE = "PRODUCT SUPPORT"
NEAR_WORDS = " once more"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def unrolled(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """One row per array entry: ``keep``, ``place`` from 1, and the entry as ``c``.

    The outer form keeps Spark from computing the array twice to filter on its size.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("at", "c"))
    return rows.filter(F.col("at").isNotNull()).select(
        *keep, (F.col("at") + 1).alias("place"), "c"
    )


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The value at an index from 0; null for a null index."""
    value = F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))
    return F.when(index.isNotNull(), value)


def shown_time(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_vectors = table(spark, sf_dir, "embeddings").count()
    return tickets_from_events(spread(table(spark, sf_dir, "events")), n_vectors)


def tickets_from_events(events: DataFrame, n_vectors: int) -> DataFrame:
    """Triage requests from events, with a fixed prediction and the key of a query vector."""
    key = F.col("event_id")
    queue = F.lit(OTHER_QUEUE)
    for event, name in QUEUE_OF_EVENT.items():
        queue = F.when(F.col("event_type") == event, F.lit(name)).otherwise(queue)
    return events.select(
        key.alias("ticket_id"),
        F.concat(
            pick(ISSUES, key % len(ISSUES)), F.lit(" - account "), F.col("user_id").cast("string")
        ).alias("issue"),
        F.when(key % 3 == 0, "PROBLEM").otherwise("INCIDENT").alias("type"),
        queue.alias("queue"),
        F.col("ts").alias("timestamp"),
        F.when(key % 7 <= 1, "HIGH").when(key % 7 <= 4, "MEDIUM").otherwise("LOW").alias(
            "ml_priority"
        ),
        (key % n_vectors).alias("query_key"),
    )


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they arrive, some of them breaking a rule."""
    return spoilt(tickets(spark, sf_dir)).select("ticket_id", "issue", "type", "queue")


def spoilt(rows: DataFrame) -> DataFrame:
    """Tickets some of which break a rule."""
    key = F.col("ticket_id")
    return rows.withColumns(
        {
            "issue": F.when(key % 41 == 0, "bad ").when(key % 47 == 0, "  oh  ").otherwise(F.col("issue")),
            "type": F.when(key % 37 == 0, "QUESTION").when(key % 43 == 0, F.lit(None)).otherwise(F.col("type")),
            "queue": F.when(key % 53 == 0, "X").otherwise(F.col("queue")),
        }
    )


def ui_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard tickets, with the dashboard's own way of writing types and states."""
    key = F.col("ticket_id")
    kinds = ("Incident", " Problem ", "Security Incident", "PROBLEM", "Service Request")
    states = ("Open", "Investigating", "Mitigating", "Escalated to vendor", "Closed")
    return tickets(spark, sf_dir).select(
        F.concat(F.lit("INC-"), key.cast("string")).alias("id"),
        F.concat(F.lit("Ticket "), key.cast("string")).alias("title"),
        F.col("issue").alias("issue_description"),
        pick(kinds, key % len(kinds)).alias("type"),
        "queue",
        "timestamp",
        pick(states, key % len(states)).alias("status"),
        F.lower("queue").alias("category"),
    )


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents that have a vector; every fourth once more in the same words, every fifth once
    more with a few words added, so that near-duplicates meet in most searches."""
    found = all_incidents(spark, sf_dir).filter(F.col("embedding").isNotNull())
    key = F.col("doc_id").cast("bigint")
    copies = F.array(
        F.struct(F.lit("").alias("mark"), F.lit("").alias("more")),
        F.when(key % 4 == 0, F.struct(F.lit("-copy").alias("mark"), F.lit("").alias("more"))),
        F.when(key % 5 == 1, F.struct(F.lit("-near").alias("mark"), F.lit(NEAR_WORDS).alias("more"))),
    )
    rows = found.withColumn("copy", F.explode(F.array_compact(copies)))
    said = F.concat("issue_description", "copy.more")
    return rows.withColumns(
        {
            "doc_id": F.concat("doc_id", "copy.mark"),
            "retrieval_text": said,
            "issue_description": said,
        }
    ).drop("copy")


def all_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents from all documents, with the vectors of those that have one."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    joined = spread(docs.join(vectors, docs.doc_id == vectors.vec_id, "left"), scan=docs)
    return joined.select(
        docs.doc_id.cast("string").alias("doc_id"),
        F.col("text").alias("retrieval_text"),
        "source",
        F.col("text").alias("issue_description"),
        F.concat(F.lit("Follow the "), "source", F.lit(" runbook in "), "lang").alias("resolution"),
        F.when(F.col("label") % 2 == 0, "INCIDENT").otherwise("PROBLEM").alias("type"),
        pick(QUEUES, F.col("label") % 4).alias("queue"),
        pick(("HIGH", "MEDIUM", "LOW"), docs.doc_id % 3).alias("priority"),
        F.array("lang", "source").alias("tags"),
        "embedding",
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def other_hits(
    vectors: DataFrame, kb: DataFrame | Index, k: int, metric: str = "cosine"
) -> DataFrame:
    """Nearest incidents of each query vector, leaving out the incident it came from and its copies."""
    found = knn_topk(vectors, kb, k + 3, metric=metric).filter(
        F.substring_index("doc_id", "-", 1) != F.col("query_id").cast("string")
    )
    nearest = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def hits(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine") -> DataFrame:
    return other_hits(query_vectors(spark, sf_dir), knowledge_base(spark, sf_dir), k, metric)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training tickets from orders and customers, with gaps and noise for the cleaning rules."""
    orders, customer = spread(table(spark, sf_dir, "orders")), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    key = F.col("o_orderkey")
    level = (
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), 0)
        .when(F.substring("o_orderpriority", 1, 1) == "3", 1)
        .otherwise(2)
    )
    template = F.when(key % 3 == 0, level * 4 + key % 4).otherwise(key % len(ISSUES))
    text = F.concat(F.lit("\t"), pick(ISSUES, template), F.lit(" for "), F.col("c_name"), F.lit(" \n"))
    label = pick(("HIGH", "MEDIUM", "LOW"), level)
    nothing = F.lit(None)
    return joined.select(
        key.alias("row_id"),
        F.when(key % 97 == 0, nothing).when(key % 89 == 0, F.lit(" \t ")).otherwise(text).alias(
            "issue_description"
        ),
        F.when(key % 29 == 0, nothing).otherwise(F.lower("o_orderstatus")).alias("type"),
        F.when(key % 31 == 0, nothing)
        .otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
        .alias("queue"),
        F.when(key % 83 == 0, nothing)
        .when(key % 5 == 0, F.concat(F.lower(label), F.lit(" ")))
        .otherwise(label)
        .alias("priority"),
        F.when(key % 53 == 0, F.lit("n/a")).otherwise((key % 200).cast("string")).alias("text_length"),
        F.when(key % 59 == 0, nothing).otherwise((key % 40).cast("string")).alias("word_count"),
        (key % 2).cast("string").alias("has_error_keyword"),
        F.when(key % 61 == 0, F.lit("NaN")).otherwise((key % 3 % 2).cast("string")).alias(
            "has_failure_keyword"
        ),
        F.lit("0").alias("has_urgent_keyword"),
        (key % 5 % 2).cast("string").alias("has_access_keyword"),
        (key % 7 % 2).cast("string").alias("has_payment_keyword"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled training rows with a prediction that is one label off on every fourth row."""
    from caseloom.operators.clean import clean_tickets

    rows = clean_tickets(training_rows(spark, sf_dir), "stage3", keep=["row_id"])
    turned = (
        F.when(F.col("priority") == "HIGH", "MEDIUM")
        .when(F.col("priority") == "MEDIUM", "LOW")
        .otherwise("HIGH")
    )
    return rows.select(
        "row_id",
        *[c for c in rows.columns if c not in ("row_id", "priority")],
        F.col("priority").alias("actual_priority"),
        F.when(F.col("row_id") % 4 == 0, turned)
        .otherwise(F.col("priority"))
        .alias("predicted_priority"),
    )


def generated_text(recommended: Column, level: Column, key: Column) -> Column:
    """Decision documents in the shape a text generator returns, with missing and empty parts."""
    lines = F.concat(
        F.lit("Assessment Summary:\n- Recommended Priority: "),
        F.lower(recommended),
        F.lit("\n- Confidence Level: "),
        level,
        F.lit("\n\n"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("Likely Root Cause:\n")),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.lit("A change in configuration.\nSee logs.\n")),
        F.lit("\nEvidence from Similar Incidents:\n- one case\n  - another case\nno bullet\n"),
        F.lit("Immediate Actions:\n- check case "),
        key.cast("string"),
        F.lit("\n-   restart\n\nNext Diagnostic Checks:\n"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.lit("- compare tenants\n- trace sessions\n")),
        F.lit("\nEscalation Recommendation:\n- "),
        F.when(key % 2 == 0, F.lit("Yes")).when(key % 7 == 0, F.lit("not now")).otherwise(F.lit("no")),
        F.lit("\n- Team: Platform Team\n- Reason: Repeated pattern\n"),
    )
    return lines


def decision_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).select(
        "ticket_id",
        generated_text(F.col("ml_priority"), F.lit("Medium"), F.col("ticket_id")).alias("text"),
    )


def past_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents from all training tickets; what was asked is the text they are found by."""
    from caseloom.functions.text import build_query
    from caseloom.operators.clean import clean_tickets

    rows = clean_tickets(training_rows(spark, sf_dir), "stage3", keep=["row_id"])
    return rows.select(
        F.concat(F.lit("T"), F.col("row_id").cast("string")).alias("doc_id"),
        build_query("issue_description", "type", "queue").alias("retrieval_text"),
        F.lit("tickets").alias("source"),
        "issue_description",
        F.concat(F.lit("Handled by "), F.lower("queue")).alias("resolution"),
        "type",
        "queue",
        "priority",
        F.array(F.lower("queue")).alias("tags"),
    )
