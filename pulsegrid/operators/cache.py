"""A cache of computed columns: a table addressed by the content of the inputs and the settings.

A row's key is the sha256 of its inputs and of the settings. What a key has is never computed again; other inputs or other
settings have other keys, so that nothing stale is read and older versions stay apart. New rows are appended by one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_key(inputs: list[str], settings: dict) -> Column:
    """sha256 over settings and inputs; equal values give equal keys, whatever row they are in."""
    return F.sha2(F.concat(F.lit(json.dumps(settings, sort_keys=True)), F.lit("\n"), F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})), 256)


def _version(settings: dict, name: str) -> str:
    import hashlib

    return hashlib.sha256(f"{name}\n{json.dumps(settings, sort_keys=True)}".encode()).hexdigest()[:16]


def cached(df: DataFrame, inputs: list[str], compute: Callable[[DataFrame], DataFrame], name: str, path: str, settings: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the column ``name``, the rows that were computed by this call).

    ``compute`` adds ``name`` to rows that have the inputs. The cache's folder has one part for each version (settings and name); other
    versions aren't read. Equal inputs in many rows are computed once. A failed run leaves what was committed before it; where two runs
    append the same key, both hold the same value and one is read.
    """
    settings, spark = settings or {}, df.sparkSession
    at = f"{path}/version={_version(settings, name)}"
    keyed = df.withColumn("_key", content_key(inputs, settings))
    try:
        known = spark.read.parquet(at)
    except Exception as e:  # no row of this version yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    wanted = keyed.select("_key", *inputs).dropDuplicates(["_key"])
    new = compute(wanted if known is None else wanted.join(known.select("_key"), "_key", "left_anti")).select("_key", name)
    before = set() if known is None else set(known.inputFiles())
    new.write.mode("append").parquet(at)
    held = spark.read.schema(new.schema).parquet(at)
    # what this call added: the files that weren't there before
    fresh = sorted(set(held.inputFiles()) - before)
    computed = spark.read.schema(new.schema).parquet(*fresh) if fresh else held.limit(0)
    return keyed.join(held.dropDuplicates(["_key"]), "_key", "left").drop("_key"), computed
