"""Lookups that don't lose a row silently: every row looks its key up, absent keys are counted and named by the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Absent keys that are named: one for each slot of their hash, so that what is observed has a bound.
NAMED = 16


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], values: list[str], *, strict: bool = True) -> tuple[DataFrame, Observation]:
    """``df`` with the table's values by key, and an observation of absent keys.

    A key is absent where the table has no row for it or any of its values is NULL there. ``strict``: the first absent key that a task meets
    ends the query with an error that names it; otherwise values stay NULL, and ``require`` tells after any action on
    the result. The table must have one row for each key (``labels.last_per_key`` gives that); no job of its own is run.
    """
    right = table.select(*keys, *values, F.lit(True).alias("_there"))
    joined = df.join(right, keys, "left")
    absent = F.col("_there").isNull()
    for v in values:
        absent |= F.col(v).isNull()
    told = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    seen = Observation()
    slots = [F.min(F.when(absent & (F.pmod(F.xxhash64(told), F.lit(NAMED)) == i), told)).alias(f"k{i}") for i in range(NAMED)]
    joined = joined.observe(seen, F.count("*").alias("rows"), F.count_if(absent).alias("absent"), *slots)
    if strict:
        loud = lambda v: F.when(absent, F.raise_error(F.concat(F.lit(f"no {v} for {', '.join(keys)} = "), told)).cast(dict(joined.dtypes)[v])).otherwise(F.col(v))
        joined = joined.select(*[loud(c).alias(c) if c in values else F.col(c) for c in joined.columns])
    return joined.drop("_there"), seen


def absent_keys(seen: Observation) -> tuple[int, list[str]]:
    """Rows without a value, and names of absent keys (all of them where they are few, at most ``NAMED``)."""
    found = seen.get
    return found["absent"], sorted(v for k, v in found.items() if k.startswith("k") and v is not None)


def require(seen: Observation) -> None:
    """Raise LookupError with count and names where an action on the result met absent keys."""
    n, names = absent_keys(seen)
    if n:
        raise LookupError(f"{n} of {seen.get['rows']} rows have no value, among them: {'; '.join(names)}")
