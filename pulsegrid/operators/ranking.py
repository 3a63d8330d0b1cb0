"""Global ranks, and splits of exact sizes by rank in a keyed permutation, without gathering what is ranked.

Rows are dealt to ranges of the order and sorted there; a row's rank is its place in its range and the number of rows in
the ranges before. The driver sees one count for each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.learning import split_sizes
from pulsegrid.scratch import written

#: Row numbers within a range take the lower bits of the id that Spark gives them.
_LOW = (1 << 33) - 1


def ranked(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of the columns (NULL first).

    Equal rows get different places. The table is written once: ranges that a repeated run would deal otherwise can't mix.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    counts = {r.part: r.n for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    before = [0, *accumulate(counts[p] for p in parts)]
    offsets = df.sparkSession.createDataFrame(list(zip(parts, before[:-1], strict=True)), "_part long, _before long")
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")  # a row for each range
    return out.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND(_LOW)).alias(rank))


def split_by_rank(df: DataFrame, subject: str, *, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(subject, part): subjects in the order of md5(seed:subject), the first to test, then to validation, the rest to training.

    Sizes are exact (``split_sizes``); the order depends on seed and ids alone. A NULL subject is one subject (its key is of ``seed:``). Fewer
    than three subjects raise ValueError.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(subject).cast("string"), F.lit(""))))
    ids = ranked(df.select(subject).distinct().withColumn("_key", key), ["_key", subject], "_rank")
    _, n_val, n_test = split_sizes(ids.count(), val, test)
    part = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return ids.select(subject, part.alias("part"))
