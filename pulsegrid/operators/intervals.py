"""Range joins with an equality to shuffle on: time is cut into cells of one width.

A window is repeated for every cell that it reaches, a sample lies in one cell, and both sides are joined on their
keys and the cell. A sample then meets the windows near it alone, however long its clip is, and the cells of one
clip are spread over tasks. Two ranges that share several cells meet once: in the first cell that both reach.
Cells only choose who meets; the ranges themselves decide.

Bounds and times must be finite; rows with a NULL among keys, bounds or times match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: str | Column, width: float) -> Column:
    # floor never decreases with its argument, so whatever lies between two bounds is between their cells
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(width)).cast("long")


def reached(ranges: DataFrame, start: str, end: str, width: float, cell: str = "_cell") -> DataFrame:
    """Each range once for every cell from its start's to its end's."""
    fine = ranges.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    return fine.withColumn(cell, F.explode(F.sequence(_cell(start, width), _cell(end, width))))


def points_inside(ranges: DataFrame, points: DataFrame, keys: list[str], *, start: str, end: str, at: str, width: float, closed: bool = True) -> DataFrame:
    """Every range beside each of its keys' points with start <= at <= end, or < end where not ``closed``.

    ``width`` should be about the distance between starts of neighbouring ranges. The sides share no columns but the keys.
    """
    joined = reached(ranges, start, end, width).join(points.filter(F.col(at).isNotNull()).withColumn("_cell", _cell(at, width)), [*keys, "_cell"])
    before_end = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return joined.filter((F.col(at) >= F.col(start)) & before_end).drop("_cell")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], *, left_range: tuple[str, str], right_range: tuple[str, str], width: float) -> DataFrame:
    """Pairs of ranges with equal keys and a common stretch of positive length; the sides share no columns but the keys."""
    (a0, a1), (b0, b1) = left_range, right_range
    a = reached(left, a0, a1, width).withColumn("_a", _cell(a0, width))
    b = reached(right, b0, b1, width).withColumn("_b", _cell(b0, width))
    once = F.col("_cell") == F.greatest("_a", "_b")
    positive = F.least(a1, b1) > F.greatest(a0, b0)
    return a.join(b, [*keys, "_cell"]).filter(once & positive).drop("_cell", "_a", "_b")
