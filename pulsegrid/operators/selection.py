"""Exact order statistics of groups of any size.

An aggregate that keeps a group's values needs memory for all of them in one task. Here a group with more than ``held``
values is narrowed down first: two pivots around the wanted rank come from a mergeable quantile sketch of bounded size, then
one pass counts exactly what lies below, at and between them, and the search goes on in the part that holds the
rank. Sketches only choose pivots; counts decide, so results are exact whatever a sketch says. Pivots are values of the
group and leave the search with each pass, so that it ends; with sketches as good as stated a pass leaves about a
thousandth of a group. What is left, at most ``held`` values of each group, is sorted by an ordinary aggregate.

Passes count with map-side combine: a group that holds a third of all rows, or all of them, costs each task its own
rows. The state of the search has one row for each large group, of which there are at most rows / ``held``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.scratch import drop, written

#: Values of one group that an aggregate may hold, and groups up to which a search's state is sent to every task.
HELD, SENT = 100_000, 10_000
ACCURACY = 10_000


#: Places of the sketch's quantiles between which pivots are taken.
GRID = 2_000


def _join(rows: DataFrame, state: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """Rows beside their group's state; NULL is a group like others. A small state is sent to the rows, a large one shuffled (skewed keys split by Spark)."""
    names = [f"_s{i}" for i in range(len(keys))]
    right = state.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    same = F.lit(True)
    for k, s in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(s))
    return rows.join(F.broadcast(right) if n <= SENT else right, same, how).drop(*names)


def _in_range() -> Column:
    return (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], n: int) -> DataFrame:
    """One pass: the state after two pivots. State: keys, k (rank within the open range low..high), m (values in it), low, high, found."""
    near = 2.0 / ACCURACY
    inside = _join(rows, state.filter("found IS NULL"), keys, n).filter(_in_range())
    # the sketch's quantiles on a grid, read where each group's rank lies
    grid = F.percentile_approx("v", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
    quantiles = inside.groupBy(*keys).agg(grid.alias("grid"), *[F.first(c).alias(c) for c in ("k", "m", "low", "high")])
    share = (F.col("k") - 0.5) / F.col("m")
    below, above = F.floor(F.greatest(F.lit(0.0), share - near) * GRID), F.ceil(F.least(F.lit(1.0), share + near) * GRID)
    pivots = written(quantiles.select(*keys, "k", "m", "low", "high", *[F.element_at("grid", (at + 1).cast("int")).alias(c) for at, c in ((below, "p"), (above, "q"))]), "selection-pivots")
    v, p, q = F.col("v"), F.col("p"), F.col("q")
    told = _join(rows, pivots, keys, n).filter(_in_range()).groupBy(*keys).agg(
        F.count_if(v < p).alias("under"), F.count_if(v == p).alias("at_p"), F.count_if((v > p) & (v < q)).alias("between"), F.count_if((v == q) & (q > p)).alias("at_q"),
        *[F.first(c).alias(c) for c in ("k", "m", "low", "high", "p", "q")],
    )
    k, a = F.col("k"), F.col("under")
    b = a + F.col("at_p")
    c = b + F.col("between")
    d = c + F.col("at_q")
    pick = lambda *five: F.when(k <= a, five[0]).when(k <= b, five[1]).when(k <= c, five[2]).when(k <= d, five[3]).otherwise(five[4])
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("long")
    out = told.select(
        *keys, pick(k, k, k - b, k, k - d).alias("k"), pick(a, zero, F.col("between"), zero, F.col("m") - d).alias("m"),
        pick(F.col("low"), none, p, none, q).alias("low"), pick(p, none, q, none, F.col("high")).alias("high"), pick(none, p, none, q, none).alias("found"),
    )
    after = written(out.unionByName(state.filter("found IS NOT NULL")), "selection-state")
    drop(pivots)
    drop(state)
    return after


def _sorted_middle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lower, upper, n) of groups that an aggregate may hold."""
    few = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.count("*").alias("n"))
    return few.select(*keys, F.expr("vs[int((n + 1) div 2 - 1)]").alias("lower"), F.expr("vs[int(n div 2)]").alias("upper"), "n")


def middle(df: DataFrame, by: list[str], value: str, *, held: int = HELD) -> DataFrame:
    """(by..., lower, upper, n): the middle two of each group's values (one value, twice, for an odd number), NULL and NaN aside.

    Groups without a value are left out; without ``by`` all rows are one group (one row, or none without values).
    """
    keys = by or ["_all"]
    v = F.col(value).cast("double")
    rows = (df if by else df.withColumn("_all", F.lit(0))).select(*keys, v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    rows = rows.withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))  # one zero
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "selection-sizes")
    large = sizes.filter(F.col("n") > held)
    n = large.count()
    if not n:
        drop(sizes)
        return _sorted_middle(rows, keys).select(*by, "lower", "upper", "n")
    rows = written(rows, "selection-values")  # passes read values alone
    state = written(large.select(*keys, F.expr("(n + 1) div 2").alias("k"), F.col("n").alias("m"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high", "found")]), "selection-state")
    while state.filter(F.col("found").isNull() & (F.col("m") > held)).count():
        state = _narrowed(rows, state, keys, n)
    left = _join(rows, state.filter("found IS NULL"), keys, n).filter(_in_range()).groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("k").alias("k"))
    lower = written(left.select(*keys, F.expr("vs[int(k - 1)]").alias("lower")).unionByName(state.select(*keys, F.col("found").alias("lower")).filter("lower IS NOT NULL")), "selection-lower")
    # the upper one is the same value where enough rows reach it, else the next above
    above = _join(rows, lower, keys, n).groupBy(*keys).agg(F.first("lower").alias("lower"), F.count_if(F.col("v") <= F.col("lower")).alias("reach"), F.min(F.when(F.col("v") > F.col("lower"), F.col("v"))).alias("next"), F.count("*").alias("n"))
    found = above.select(*keys, "lower", F.expr("if(reach > n div 2, lower, next)").alias("upper"), "n")
    out = written(found.unionByName(_sorted_middle(_join(rows, large, keys, n, "left_anti"), keys)), "selection-middle")
    for table in (rows, state, lower, sizes):
        drop(table)
    return out.select(*by, "lower", "upper", "n")


def median(df: DataFrame, by: list[str], value: str, *, held: int = HELD) -> DataFrame:
    """(by..., median, n): the mean of the middle two."""
    return middle(df, by, value, held=held).select(*by, ((F.col("lower") + F.col("upper")) / 2).alias("median"), "n")


def beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Every row with its group's columns; ``groups`` has one row for each group, and one in all without ``by``."""
    few = groups.limit(SENT + 1).count()
    if by:
        return _join(rows, groups, by, few)
    return _join(rows.withColumn("_all", F.lit(0)), groups.withColumn("_all", F.lit(0)), ["_all"], few).drop("_all")
