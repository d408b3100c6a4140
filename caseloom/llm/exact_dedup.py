"""Exact dedup by composable polynomial fingerprints.

A text is normalised (ASCII capitals become small letters, null is the empty text), cut into chunks
of bytes, and each chunk gets a polynomial hash.  Hashes of neighbouring chunks combine without their
bytes: ``hash(a + b) = hash(a) * base ** len(b) + hash(b)``.  So the parts of a huge document can be
hashed by different tasks (``combine_parts``); a document that lies in one row is hashed where it lies.

Equal fingerprints only make candidates.  Every candidate is compared with the leader of its group,
chunk by chunk, in a join on the chunk number; rows that turn out different form new groups and are
compared again, until none is left.  A collision therefore costs time and never a row.

Edge cases: null and empty texts equal each other; null ids are the smallest; of repeated rows (same
id, same text) exactly one stays; an empty table gives an empty table; other columns are carried along
whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import free_name, keep, read_table, text_bytes, with_fields
from caseloom.llm.registry import query

CHUNK = 1 << 16
# Two primes below 2**31 and a base for each: products stay below 2**62, sums of a chunk below 2**55.
MODULI = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)


@functools.cache
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """``base ** (n - 1), ..., base, 1``, all modulo ``modulus``."""
    out, x = np.empty(n, np.uint64), 1
    for i in range(n - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def chunk_hash(chunk: bytes, moduli=MODULI) -> tuple[int, int]:
    """Polynomial hash of at most ``CHUNK`` bytes under both moduli."""
    values = np.frombuffer(chunk, np.uint8).astype(np.uint64)
    return tuple(
        int(values @ _powers(base, modulus, CHUNK)[CHUNK - len(values) :] % np.uint64(modulus))
        for base, modulus in zip(BASES, moduli)
    )


def combine(parts: Iterable[tuple[int, int, int]], moduli=MODULI) -> tuple[int, int, int]:
    """(length, hash, hash) of a text from those of its parts, in order."""
    n, h = 0, [0, 0]
    for length, *hashes in parts:
        for i, (base, modulus) in enumerate(zip(BASES, moduli)):
            h[i] = (h[i] * pow(base, length, modulus) + hashes[i]) % modulus
        n += length
    return n, h[0], h[1]


def fingerprint(text: bytes, moduli=MODULI) -> tuple[int, int, int]:
    if len(text) <= CHUNK:
        return len(text), *chunk_hash(text, moduli)
    starts = range(0, len(text), CHUNK)
    pieces = (text[i : i + CHUNK] for i in starts)
    return combine(((len(p), *chunk_hash(p, moduli)) for p in pieces), moduli)


def combine_parts(parts: DataFrame, key: str, position: str = "part_no") -> DataFrame:
    """Fingerprints of documents from hashed parts (``key, position, n_bytes, h1, h2``).

    For documents so large that their parts are rows of their own, hashed by any task.  Each part is
    shifted by the bytes that follow it and the shifted hashes are added, so partial sums combine
    before the shuffle; only the sizes of a document's parts, not their texts, meet in one task.
    """
    from pyspark.sql import Window

    later = Window.partitionBy(key).orderBy(F.col(position).desc())
    after = F.coalesce(F.sum("n_bytes").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = parts.withColumn("after", after)

    @F.pandas_udf("long")
    def shift1(h, n):
        return h.combine(n, lambda a, b: a * pow(BASES[0], int(b), MODULI[0]) % MODULI[0])

    @F.pandas_udf("long")
    def shift2(h, n):
        return h.combine(n, lambda a, b: a * pow(BASES[1], int(b), MODULI[1]) % MODULI[1])

    return (
        shifted.select(key, "n_bytes", shift1("h1", "after").alias("s1"), shift2("h2", "after").alias("s2"))
        .groupBy(key)
        .agg(
            F.sum("n_bytes").alias("n_bytes"),
            (F.sum("s1") % MODULI[0]).alias("h1"),
            (F.sum("s2") % MODULI[1]).alias("h2"),
        )
    )


FINGERPRINT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("h1", T.LongType()),
        T.StructField("h2", T.LongType()),
    ]
)


def with_fingerprints(
    df: DataFrame, text: str = "text", name: str = "fingerprint", sha256: str | None = None,
    without: tuple[str, ...] = (), moduli=MODULI,
) -> DataFrame:
    """``df`` with the fingerprint of its normalised texts, and their SHA-256 if ``sha256`` names a column.

    Columns in ``without`` are not carried along.
    """
    kept = [f for f in df.schema.fields if f.name not in without]
    added = [(name, FINGERPRINT)] + ([(sha256, T.StringType())] if sha256 else [])
    names, place = [f.name for f in kept], df.columns.index(text)
    places = [df.columns.index(n) for n in names]
    kind = pa.struct([("n_bytes", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for batch in batches:
            rows, digests = [], []
            for raw in text_bytes(batch.column(place)):
                raw = (raw or b"").lower()
                rows.append(fingerprint(raw, moduli))
                if sha256:
                    digests.append(hashlib.sha256(raw).hexdigest())
            n, h1, h2 = zip(*rows) if rows else ((), (), ())
            marks = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (n, h1, h2)], fields=list(kind)
            )
            more = [pa.array(digests, pa.string())] if sha256 else []
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), marks, *more], names=[*names, *(a[0] for a in added)]
            )

    return df.mapInArrow(run, with_fields(T.StructType(kept), *added))


def _chunks(df: DataFrame) -> DataFrame:
    """``row_id, fp, text`` as one row per chunk of the normalised text."""
    schema = "row_id long, fp struct<n_bytes:long,h1:long,h2:long>, chunk_no long, body binary"

    def run(batches):
        for batch in batches:
            at, numbers, bodies = [], [], []
            for i, raw in enumerate(text_bytes(batch.column(2))):
                raw = (raw or b"").lower()
                for k, start in enumerate(range(0, max(len(raw), 1), CHUNK)):
                    at.append(i)
                    numbers.append(k)
                    bodies.append(raw[start : start + CHUNK])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(numbers, pa.int64()),
                    pa.array(bodies, pa.binary()),
                ],
                names=["row_id", "fp", "chunk_no", "body"],
            )

    return df.select("row_id", "fp", "text").mapInArrow(run, schema)


def compared_groups(rows: DataFrame) -> DataFrame:
    """Classes of equal texts among candidates ``row_id, doc_id, fp, text``, which share fingerprints.

    Returns ``row_id, fp, round, leader``.  In each round the row with the largest id leads a
    fingerprint's rows; those equal to it, chunk by chunk, are settled.  A second round only runs where
    fingerprints collided.
    """
    settled, pending, round_no = None, rows.select("row_id", "doc_id", "fp"), 0
    chunks = _chunks(rows)
    while True:
        leaders = pending.groupBy("fp").agg(F.max(F.struct("doc_id", "row_id")).alias("lead"))
        leaders = leaders.select(F.col("lead.row_id").alias("row_id"), F.col("fp").alias("of"))
        lead_chunks = chunks.join(leaders, "row_id").select(
            F.col("row_id").alias("leader"), "of", F.col("chunk_no").alias("at"), F.col("body").alias("said")
        )
        mine = chunks if round_no == 0 else chunks.join(pending.select("row_id"), "row_id", "left_semi")
        pairs = mine.join(
            lead_chunks, (mine.fp == lead_chunks.of) & (mine.chunk_no == lead_chunks["at"])
        )
        verdict = keep(
            pairs.select("row_id", "fp", "leader", (F.col("body") == F.col("said")).alias("same"))
            .groupBy("row_id")
            .agg(
                F.first("fp").alias("fp"), F.first("leader").alias("leader"), F.bool_and("same").alias("same")
            ),
            "exact-compared",
        )
        same = verdict.filter("same").select("row_id", "fp", F.lit(round_no).alias("round"), "leader")
        settled = same if settled is None else settled.unionByName(same)
        other = verdict.filter("not same").select("row_id")
        if other.isEmpty():
            return settled
        pending = keep(rows.select("row_id", "doc_id", "fp").join(other, "row_id", "left_semi"), "exact-rest")
        round_no += 1


def _candidates(df: DataFrame, fps: DataFrame, mark: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints that occur more than once, and the rows of ``df`` that have one, numbered."""
    shared = keep(
        fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"), "exact-shared"
    )
    rows = df.join(shared, df[mark] == shared.fp, "left_semi")
    numbered = rows.withColumn(free_name(df, "row_id"), F.monotonically_increasing_id())
    return shared, keep(numbered, "exact-rows")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", moduli=MODULI) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    slim = keep(
        with_fingerprints(docs, "text", "fp", "text_sha256", without=("text",), moduli=moduli), "exact-fp"
    )
    marked = with_fingerprints(docs, "text", "fp", moduli=moduli)
    shared, rows = _candidates(marked, slim, "fp")
    classes = compared_groups(rows)
    sizes = classes.groupBy("leader").agg(F.count(F.lit(1)).alias("group_size"))
    leaders = classes.join(sizes, "leader").select("row_id", "leader", "group_size")
    ids = rows.select(F.col("row_id").alias("leader"), F.col("doc_id").alias("keep_id"))
    normal = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    own = rows.select("row_id", "doc_id", F.sha2(normal, 256).alias("text_sha256"))
    several = (
        own.join(leaders, "row_id")
        .join(ids, "leader")
        .select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("leader")).alias("kept"), "text_sha256")
    )
    single = slim.join(shared, "fp", "left_anti").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return single.unionByName(several)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def drop_exact_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns: of equal texts the one with the largest id."""
    mark = free_name(df, "fingerprint")
    marked = with_fingerprints(df, text, mark)
    slim = keep(with_fingerprints(df.select(text), text, "fp", without=(text,)), "exact-fp")
    shared, rows = _candidates(marked, slim, mark)
    number = next(c for c in rows.columns if c not in marked.columns)
    classes = compared_groups(
        rows.select(F.col(number).alias("row_id"), F.col(key).alias("doc_id"), F.col(mark).alias("fp"), F.col(text).alias("text"))
    )
    leaders = classes.select(F.col("leader").alias("lead_row")).distinct()
    stay = rows.join(leaders, rows[number] == leaders.lead_row, "left_semi").select(*df.columns)
    single = marked.join(shared, marked[mark] == shared.fp, "left_anti").select(*df.columns)
    return single.unionByName(stay)


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


@query("op9_exact_dedup", SQL)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` repeat another, and which row of each group stays."""
    return exact_groups(read_table(spark, sf_dir, "documents"))
