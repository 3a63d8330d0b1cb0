"""Shared scratch space of a job: tables and archives that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_column(name: str) -> Column:
    """A column by its name alone, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def slices(batch: pa.RecordBatch, text_at: int, rows: int = 1024, room: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and, but for single longer texts, bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room, "right"))
        to = min(max(at + 1, to), at + rows)
        yield batch.slice(at, to - at)
        at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pulsegrid-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_files(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and no later step reads."""
    if files := df.inputFiles():
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
