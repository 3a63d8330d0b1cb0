"""Augmentation of signals for training, drawn from counters.

A draw is a hash of (seed, epoch, row key, use, place): it doesn't depend on the partition, the task or how often a
row is computed, so a retried or moved task gives the same rows, and another epoch others. Few draws for each row come
from md5, which other engines have as well; those for each channel and value from a faster 64-bit hash.

The transforms keep the heart rate: amplitudes of channels vary, noise is added, the signal is shifted around in time,
and now and then one region's channels are zero.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config

# Spread of amplitudes and of noise, largest shift, share of rows that lose a region, channels of a region.
AMPLITUDE, NOISE, SHIFT, LOSS, REGION_CHANNELS = 0.1, 0.05, 15, 0.3, 4


def draw(seed: int, epoch: Column, key: Column, use: str) -> Column:
    """A number from 0 to under 1: the first 52 bits of md5(seed:epoch:key:use)."""
    told = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), F.lit(use))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, epoch: Column, key: Column, use: str, *place: Column) -> Column:
    """A standard normal number for a place, from two 64-bit hashes (Box and Muller, 1958)."""
    uniform = lambda half: (F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), key.cast("string"), F.lit(use), *place, F.lit(half)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * pi * uniform(1))


def shifted(x: Column, by: Column) -> Column:
    """An array rolled towards its end by a number of places (towards its start where negative)."""
    n = F.size(x)
    cut = F.pmod(by, n)
    return F.when(n == 0, x).otherwise(F.concat(F.slice(x, n - cut + 1, cut), F.slice(x, F.lit(1), n - cut)))


def augmented(
    df: DataFrame, key: str, signal: str, *, seed: int = 42, epoch: int | str = 0, amplitude: float = AMPLITUDE, noise: float = NOISE, shift: int = SHIFT, loss: float = LOSS, group: int = REGION_CHANNELS,
) -> DataFrame:
    """``df`` with ``signal`` (ARRAY<ARRAY<DOUBLE>>: channels of values) augmented, and what was drawn: shift, lost_region (NULL: none).

    ``epoch``: a number or a column's name. ``key`` must tell rows apart: rows with one key get one set of draws. Missing values stay missing, a NULL or
    empty signal stays so; a region is lost only where there are at least ``group`` channels.
    """
    e, k = F.col(epoch) if isinstance(epoch, str) else F.lit(epoch), F.col(key)
    channels = F.size(signal)
    by = (F.floor(draw(seed, e, k, "shift") * (2 * shift + 1)) - shift).cast("int")
    regions = F.floor(channels / group)
    lost = F.when((channels >= group) & (draw(seed, e, k, "loss") < loss), F.floor(draw(seed, e, k, "region") * regions)).cast("int")
    out = df.withColumn("shift", by).withColumn("lost_region", lost)

    def channel(x: Column, c: Column) -> Column:
        louder = x
        if amplitude:
            factor = 1 + amplitude * normal(seed, e, k, "amplitude", c)
            louder = F.transform(louder, lambda v: v * factor)
        if noise:
            louder = F.transform(louder, lambda v, i: v + noise * normal(seed, e, k, "noise", c, i))
        moved = shifted(louder, F.col("shift"))
        gone = F.coalesce(F.floor(c / group) == F.col("lost_region"), F.lit(False))
        return F.when(gone, F.transform(moved, lambda v: F.lit(0.0))).otherwise(moved)

    return out.withColumn(signal, F.transform(F.col(signal), channel))


def network_channels(regions: str = "regions", config: Config = DEFAULT) -> Column:
    """The networks' input of packed samples as ARRAY<ARRAY<DOUBLE>>: for each region r, g, b and the count, z-scored; missing colours are 0."""
    zero = F.transform(F.sequence(F.lit(1), F.lit(config.samples)), lambda _: F.lit(0.0))
    known = lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v.cast("double"))

    def scored(x: Column) -> Column:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        mean = total(x) / F.size(x)
        spread = F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x)) + 1e-6
        return F.transform(x, lambda v: (v - mean) / spread)

    channels = []
    for name in map(F.lit, config.regions):
        own = F.get(F.filter(regions, lambda x: x["name"] == name), F.lit(0))  # noqa: B023
        channels += [F.coalesce(F.transform(own[c], known), zero) for c in ("r", "g", "b", "px")]
    return F.transform(F.array(*channels), scored)
