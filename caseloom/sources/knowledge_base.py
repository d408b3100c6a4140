"""The knowledge base: JSON lines in, a Parquet table of incidents with vectors out.

A published memory is a folder with ``versions`` and ``pointers``.  A rebuild writes a version of its own, searches in it, and
only then adds a line to the pointers; a reader takes the last line once and stays with that version.  So nobody
ever sees half a table, and a rebuild that fails, at whatever point, changes nothing for readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.encoder import Encoder, encode
from caseloom.operators.retrieval import embed_text, knn_topk

TEXT_FIELDS = (
    "doc_id",
    "retrieval_text",
    "source",
    "issue_description",
    "resolution",
    "type",
    "queue",
    "priority",
)
# Tags may be a list or a text.  Read as text, a list arrives as its JSON.
POINTER_SCHEMA = "sequence long, folder string"
KB_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in (*TEXT_FIELDS, "tags")])


def read_kb_jsonl(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """One record per line; blank lines are skipped, malformed ones fail the job."""
    raw = spark.read.schema(KB_SCHEMA).option("mode", "FAILFAST").json(path)
    as_list = F.from_json("tags", "array<string>")
    tags = F.when(F.startswith(F.ltrim("tags"), F.lit("[")), as_list).otherwise(
        F.when(F.col("tags").isNotNull(), F.array("tags"))
    )
    records = raw.withColumn("tags", tags)
    if require_rows and records.isEmpty():
        raise ValueError(f"no knowledge-base records in {path}")
    return records


def flatten_kb_metadata(records: DataFrame) -> DataFrame:
    """Flat rows with text ids, empty text for missing fields, and tags joined to one text."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEXT_FIELDS[2:]]
    return records.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "retrieval_text",
        *fields,
        F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"),
        *[c for c in ("embedding",) if c in records.columns],
    )


def write_incident_memory(rows: DataFrame, path: str) -> None:
    """Replace the incident table at ``path``."""
    rows.write.mode("overwrite").parquet(path)


def rebuild_incident_memory(
    spark: SparkSession, kb_path: str, path: str, encoder: Callable | Encoder
) -> str:
    """JSON lines to a newly published version below ``path``, whose folder is returned.

    ``encoder`` is what ``embed_text`` takes, or a fitted ``Encoder``.
    """
    flat = flatten_kb_metadata(read_kb_jsonl(spark, kb_path))
    if isinstance(encoder, Encoder):
        return publish_incident_memory(encode(flat, encoder, "retrieval_text"), path)
    return publish_incident_memory(embed_text(flat, encoder, text="retrieval_text"), path)


def publish_incident_memory(rows: DataFrame, path: str) -> str:
    """Write ``rows`` as a version below ``path``, check that a search finds something, and point readers to it.

    The pointer is one row of a table that is only appended to; Spark shows an appended file when its job is
    committed, not before.  Of publishers at the same time the one with the larger folder name wins.
    """
    spark, last = rows.sparkSession, _last_pointer(rows.sparkSession, path)
    folder = f"{path}/versions/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    answer = check_incident_memory(spark, folder).first()
    if not answer["valid"]:
        raise ValueError(f"not published: {answer['reason']}")
    line = [((last["sequence"] if last else 0) + 1, folder.removeprefix(f"{path}/"))]
    pointer = spark.createDataFrame(line, POINTER_SCHEMA).coalesce(1)
    pointer.write.mode("append").json(f"{path}/pointers")
    return folder


def _last_pointer(spark: SparkSession, path: str):
    try:
        pointers = spark.read.schema(POINTER_SCHEMA).json(f"{path}/pointers")
        return pointers.orderBy(F.desc("sequence"), F.desc("folder")).first()
    except AnalysisException:  # nothing was published there
        return None


def open_incident_memory(spark: SparkSession, path: str) -> DataFrame:
    """The incident table at a path, published there or of a catalog name, with tags as a list.

    A published one is the version that was last when it is opened, however long it is read.
    """
    if "/" not in path and spark.catalog.tableExists(path):
        memory = spark.table(path)
    else:
        pointer = _last_pointer(spark, path)
        try:
            memory = spark.read.parquet(f"{path}/{pointer['folder']}" if pointer else path)
        except AnalysisException as missing:
            raise FileNotFoundError(f"no incident table at {path}") from missing
    if dict(memory.dtypes).get("tags") == "string":
        memory = memory.withColumn("tags", F.filter(F.split("tags", ", *"), lambda t: t != ""))
    return memory


def verify_incident_memory(memory: DataFrame) -> DataFrame:
    """One row on the state of an incident table; the probe measures against the zero vector."""
    probe = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return memory.agg(
        F.lit(True).alias("table_exists"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("embedding").isNull()).alias("n_null_vectors"),
        F.min(dims).alias("dim_min"),
        F.max(dims).alias("dim_max"),
        F.least(F.count(probe), F.lit(1)).alias("probe_hits"),
    )


def check_incident_memory(spark: SparkSession, path: str) -> DataFrame:
    """One row ``valid, reason``: whether a search in the table at ``path`` finds anything.

    The probe is a real search, with the vector of one of the table's own rows.
    """

    def answer(reason: str | None) -> DataFrame:
        row = [(reason is None, reason or "ok")]
        return spark.createDataFrame(row, "valid boolean, reason string")

    try:
        memory = open_incident_memory(spark, path)
    except FileNotFoundError:
        return answer("no incident table")
    if "embedding" not in memory.columns:
        return answer("no vectors")
    if memory.isEmpty():
        return answer("no incidents")
    probe = memory.filter("embedding is not null").limit(1).select(F.lit(0).alias("query_id"), "embedding")
    if probe.isEmpty():
        return answer("no vectors")
    return answer(None if not knn_topk(probe, memory, 1).isEmpty() else "the search finds nothing")
