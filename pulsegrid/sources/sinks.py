"""Writers of the stages' outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.schema import MANIFEST, RESULT
from pulsegrid.sources.readers import NO_KEY


def table(df: DataFrame, path: str, *, by: str = "clip", overwrite: bool = False) -> DataFrame:
    """Parquet partitioned by clip. Without ``overwrite``, clips that are there already are skipped; returns what was written."""
    spark = df.sparkSession
    if not overwrite:
        try:
            done = spark.read.parquet(path).select(by).distinct()
        except Exception as e:  # nothing there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            df = df.join(done, by, "left_anti")
    df.write.partitionBy(by).mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").parquet(path)
    return df


def _csv(df: DataFrame, path: str, schema: str, order: list[str]) -> None:
    names = [f.split()[0] for f in schema.split(", ")]
    out = df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])
    out.orderBy(*order).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def manifest(df: DataFrame, path: str) -> None:
    """The manifest's 14 columns in order of clip and index; missing values are empty."""
    _csv(df, path, MANIFEST, ["clip", "index"])


def results(df: DataFrame, path: str) -> None:
    """The results' 15 columns in string order of segments."""
    _csv(df, path, RESULT, ["segment"])


def bundles(df: DataFrame, path: str, order: list[str]) -> None:
    """Lines (subject, state, line) of recordings as text files of many recordings: each line is led by subject and state, encoded as in a URL.

    A recording's lines follow one another in one file, in ``order``; ``readers.bundle_lines`` reads them. A task writes one file, so
    small recordings don't cost a file and a folder each. A line break inside a line is an error.
    """
    line = F.when(F.contains("line", F.lit("\n")), F.raise_error(F.lit("a line of a recording holds a line break"))).otherwise(F.col("line"))
    keys = [F.coalesce(F.url_encode(c), F.lit(NO_KEY)) for c in ("subject", "state")]
    df.repartition("subject", "state").sortWithinPartitions("subject", "state", *order).select(F.concat_ws("\t", *keys, line)).write.text(path)


def lines(spark: SparkSession, rows: list[str], path: str) -> None:
    """A small report as text through Spark's own writer."""
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(path)


def history(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Training history as CSV lines."""
    keys = list(rows[0]) if rows else []
    lines(spark, [",".join(keys), *(",".join("" if r[k] is None else str(r[k]) for k in keys) for r in rows)], path)


def metrics(spark: SparkSession, values: dict, path: str) -> None:
    lines(spark, [json.dumps(values, sort_keys=True)], path)
