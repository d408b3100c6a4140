"""Packing by cutting-stock column generation.

Documents become token ids with an end id and are cut every ``capacity`` ids; only what is left of a
document shares a sequence with others.  The histogram of piece lengths, in ``UNITS`` classes, goes to the driver, where
``cutting_stock.plan`` solves the linear program over patterns, priced by a knapsack, and rounds it.  The
plan's size depends on the number of classes alone.  Pieces are then ranked inside their class and take
the plan's slots by rank, in every task at once; nothing is packed by a loop over documents.

Ranks: a class with ``n`` pieces is split into about ``sqrt(n)`` hash buckets, so neither a bucket nor the list of a
class's bucket offsets grows faster than that, even when one class holds a third of all pieces.

Ids are those of the tokenizers library for the vocabulary file; they are computed by tiktoken from the
same vocabulary, which is four times as fast and gives equal ids (compared in the tests).

Edge cases: a null or empty text is the end id alone; repeated rows and null ids are packed like any
other row; long texts are cut into as many pieces as they need, also where white space runs for millions of
characters; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import cutting_stock
from caseloom.llm.common import keep, read_table, text_bytes
from caseloom.llm.registry import query

CAPACITY = 1024
UNITS = 128
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = ("<|endoftext|>", 50256)
LONG_BLANK = 100_000
_LONG_BLANK = regex.compile(r"\p{White_Space}{%d,}" % LONG_BLANK)


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens=dict([END_OF_TEXT])
    )


@functools.cache
def _blank_encoder(path: str) -> tiktoken.Encoding:
    """An encoder for which a run of white space is one piece; its pattern needs no look-ahead."""
    return tiktoken.Encoding("blanks", pat_str=r"\s+", mergeable_ranks=_ranks(path), special_tokens={})


def encode(said: str, path: str) -> list[int]:
    """Ids of a text.

    The library gives up on white space of about a million characters.  Such runs are cut out where its pattern
    ends a piece: a run is one piece, but for its last character where more text follows that is not the special token.
    """
    known, ids, at = encoder(path), [], 0
    for run in _LONG_BLANK.finditer(said) if len(said) >= LONG_BLANK else ():
        last = run.end() == len(said) or said.startswith(END_OF_TEXT[0], run.end())
        stop = run.end() if last else run.end() - 1
        ids += known.encode(said[at : run.start()], allowed_special="all", disallowed_special=())
        ids += _blank_encoder(path).encode_ordinary(said[run.start() : stop])
        at = stop
    return ids + known.encode(said[at:], allowed_special="all", disallowed_special=())


def token_ids(text: bytes | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """A document's ids and the end id, as little-endian unsigned 32-bit numbers."""
    ids = encode((text or b"").decode("utf-8", "replace"), path)
    ids.append(end_id)
    return np.array(ids, "<u4")


def pieces(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Documents cut every ``capacity`` ids: ``doc_id, start, length, ids_crc32, doc_tokens[, ids]``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = df.schema[key].dataType
    fields = [(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    fields += [("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        for batch in batches:
            at, starts, lengths, sums, totals, bodies = [], [], [], [], [], []
            for i, raw in enumerate(text_bytes(batch.column(1))):
                ids = token_ids(raw, path)
                for start in range(0, len(ids), capacity):
                    body = ids[start : start + capacity].tobytes()
                    at.append(i)
                    starts.append(start)
                    lengths.append(len(body) // 4)
                    sums.append(zlib.crc32(body))
                    totals.append(len(ids))
                    if with_ids:
                        bodies.append(body)
            columns = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            columns += [pa.array(bodies, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *columns], names=schema.fieldNames()
            )

    return df.select(key, text).mapInArrow(run, schema)


def _ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``cut`` with ``rank``, 0, 1, ... among the pieces of its ``size``."""
    spark = cut.sparkSession
    rows = [(size, int(np.ceil(np.sqrt(n)))) for size, n in counts.items()]
    split = F.broadcast(spark.createDataFrame(rows, "size long, buckets long"))  # at most UNITS rows
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets"))
    placed = cut.join(split, "size").withColumn("bucket", bucket).drop("buckets")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("size", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    numbered = placed.withColumn("inside", F.row_number().over(inside))
    return numbered.join(offsets, ["size", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("inside") - 1
    )


def pack(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, with_ids: bool = False, units: int = UNITS,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``, gapless from 0 in every sequence."""
    unit = max(1, capacity // units)
    size = F.ceil(F.col("length") / unit).cast("long")
    cut = keep(pieces(df, key, text, capacity, vocabulary, with_ids), "pack-pieces").withColumn("size", size)
    counts = {r["size"]: r["count"] for r in cut.groupBy("size").count().collect()}  # at most ``units`` rows
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    if not counts:
        return cut.select(*out, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = cutting_stock.slots(cutting_stock.plan(counts, capacity // unit))
    ranked = _ranked(cut, counts).select(*out, "size", "rank")
    schema = T.StructType(
        [*(f for f in ranked.schema.fields if f.name in out)]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            sizes, ranks = (np.asarray(batch.column(c)) for c in ("size", "rank"))
            places = [pa.array(x) for x in cutting_stock.place(sizes, ranks, plan)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in out), *places], names=schema.fieldNames()
            )

    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0).cast("long"))
    return ranked.mapInArrow(run, schema).withColumn("offset", offset).select(*out, "sequence_id", "offset")


@query("op1_pack")
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` packed into sequences of 1024 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))
