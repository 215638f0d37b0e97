"""Helpers of the training-data operators: shared folders, tables that cut lineage, batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of a Python operator holds at a time.
STEP_CHARS = 4_000_000
#: The same for operators whose arrays have several numbers for each character.
WIDE_STEP_CHARS = 1_000_000


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path that the driver and all executors reach, below spark.checkpoint.dir. Where that setting is unset, a
    temporary folder of this machine if Spark runs on it alone (local tests); on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: what follows doesn't compute
    them again, and a lost executor takes none of them away."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, so that further columns of any name do no harm."""
    kinds = dict(docs.dtypes)
    return docs.select(*[c if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Each batch in parts of about ``most`` bytes of text; a row stays whole. A part is a copy without an offset into the
    batch: some of Arrow's text functions give wrong texts for arrays with one."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.take(pa.array(np.arange(start, stop))) if stop - start < batch.num_rows else batch
            start = stop


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """As slices, with the texts as strings (null: empty)."""
    for part in slices(batches, column, most):
        yield part, [x or "" for x in part.column(column).to_pylist()]
