"""What several operators share: scratch tables, code for the workers, texts of Arrow columns."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caseloom.session import fresh_path

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


# Documents are long rows; Spark's 10,000 of them in a batch are what a Python worker's memory goes to.
BATCH_ROWS = "1000"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers of this application the package and the pipeline, once, and small batches.

    A batch size that the session sets itself stays.
    """
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="caseloom-llm-")) / "caseloom_llm.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted([*(ROOT / "caseloom").rglob("*.py"), ROOT / "corpus_pipeline.py"]):
            if source.exists():
                out.write(source, source.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so a lost executor costs no more than the reading task, and makes what is not
    repeatable (row numbers given while writing) the same for every later reader.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow string column, ``None`` for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].tolist()
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    view = memoryview(data) if data is not None else memoryview(b"")
    for i in range(len(column)):
        yield None if nulls is not None and nulls[i] else bytes(view[ends[i] : ends[i + 1]])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
