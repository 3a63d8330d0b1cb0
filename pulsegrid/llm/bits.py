"""Bit tables of fixed size: which keys a set surely doesn't hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table: 1 MB, whatever the number of keys. A fuller table lets more keys through, never fewer.
TABLE = 1 << 23


def spot(key: str) -> F.Column:
    """A key's bit."""
    return F.pmod(F.xxhash64(key), F.lit(TABLE)).alias("spot")


def bit_table(keys: DataFrame, key: str) -> np.ndarray:
    """The packed table of a column's keys; the driver gets set bits, at most one for each bit of the table."""
    rows = keys.select(spot(key)).distinct().groupBy(F.expr("spot div 65536").alias("block")).agg(F.collect_list((F.col("spot") % 65536).cast("int")).alias("at")).collect()
    table = np.zeros(TABLE, bool)
    for r in rows:
        table[r.block * 65536 + np.array(r["at"], np.int64)] = True
    return np.packbits(table)


def unpacked(table: np.ndarray) -> np.ndarray:
    return np.unpackbits(table).view(bool)
