"""How quality filters interact, in every order of application (operator 11).

A document's failures are one bit mask; all that any order of the filters does follows from
how many documents of a part carry each mask. Those cells (2^filters for each part) are
counted by Spark. The orders are then visited by single swaps of neighbours
(Steinhaus, Johnson and Trotter): a swap leaves every step but the two swapped ones as it
was, so only these are counted anew from the cells, and each filter's Shapley sum grows by
what it removes at every order on the way.

Filters: A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * ``[A-Z]`` characters
> 5 * code points; D: holds any of ``#$%&*|``; E: the text is that of a smaller doc_id, anywhere
in the table. Words are maximal runs of characters other than 0x20 and 0x09-0x0D, case matters.

First holders of a text come from an aggregate with map-side combine and go back to the rows
by an equi-join on text hash and doc_id, so that a text that a third of all rows share is
spread by doc_id; no group of copies meets in a task.

Defined cases: a null text is the empty text (no words, fails A alone, and E where another
empty text has a smaller doc_id); a null or empty source is the part ``''``; repeated rows count each,
and don't fail E for one another; a null doc_id has no labels, fails E never and makes no other row
fail it; labels other than 1 count as not 1, of several labels for one document the highest counts; a
text of any length is read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.storage import drop_files, materialise

#: Filters by the order of their bits; E isn't a condition on a row alone, its bit is set by ``masks``.
FILTERS = "ABCDE"
ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def row_conditions(text: Column) -> list[Column]:
    """The failure conditions A to D."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row as (part, mask, good, toxic), and the narrow scratch table that this reads."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(row_conditions(text))), F.lit(0))
    id_ = F.col("doc_id").cast("long")
    # a null id gets a key of its own, of its text: many of them don't meet in one task
    key = F.coalesce(id_.cast("string"), F.concat(F.lit("-:"), F.xxhash64(text).cast("string"), F.lit(":"), F.rand(11).cast("string")))
    rows = docs.select(id_.alias("id"), F.coalesce("source", F.lit("")).cast("string").alias("part"), F.unhex(F.sha2(text, 256)).alias("text_hash"), bits.cast("int").alias("bits"), key.alias("key"))
    rows = materialise(rows, "audit-rows")
    first = rows.filter("id IS NOT NULL").groupBy("text_hash").agg(F.min("id").alias("id")).select("text_hash", F.col("id").cast("string").alias("key"), F.lit(True).alias("is_first"))
    told = labels.select(F.col("doc_id").cast("string").alias("key"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    told = told.filter("key IS NOT NULL").groupBy("key").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    both = rows.join(first, ["text_hash", "key"], "left").join(told, "key", "left")
    copied = F.col("is_first").isNull() & F.col("id").isNotNull()
    mask = F.col("bits") + F.when(copied, 1 << 4).otherwise(0)
    return both.select("part", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), rows


def count_cells(masked: DataFrame) -> DataFrame:
    """(part, cells): for each part at most one cell (mask, n, good, toxic) for each mask."""
    each = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    return each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def swaps(n: int) -> Iterator[int]:
    """The places i to swap with i + 1, so that all n! orders come by once, from the first one on."""
    if n < 2:
        return
    last, down = n - 1, True
    for inner in [*swaps(last), None]:
        yield from range(last - 1, -1, -1) if down else range(last)
        if inner is None:
            return
        # the last filter stands at one end now; the others swap beside it
        yield inner + 1 if down else inner
        down = not down


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of n filters; for each (order, step) the counts [removed, good lost, toxic lost] of every part; Shapley sums.

    ``cells``: (parts, 2^n, 3) counts by mask. Results: (orders, n, parts, 3) and (n, parts).
    """
    mask = np.arange(1 << n)
    order, orders = list(range(n)), []
    now = np.zeros((n, cells.shape[0], 3), np.int64)
    out, shapley = [], np.zeros((n, cells.shape[0]), np.int64)

    def step(k: int) -> None:
        before = sum(1 << f for f in order[:k])
        now[k] = cells[:, (mask >> order[k] & 1 == 1) & (mask & before == 0)].sum(1)

    def arrive() -> None:
        orders.append(tuple(order))
        out.append(now.copy())
        shapley[order] += now[:, :, 0]

    for k in range(n):
        step(k)
    arrive()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        step(i)
        step(i + 1)
        arrive()
    return orders, np.stack(out), shapley


def report(cells: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, of ``count_cells``' cells."""
    n, fields = len(names), [f.split()[0] for f in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                parts, table = part.column(0).to_pylist(), np.zeros((part.num_rows, 1 << n, 3), np.int64)
                for i, own in enumerate(part.column(1).to_pylist()):
                    for c in own:
                        table[i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                orders, counts, shapley = walk(table, n)
                total, mask = table[:, :, 0].sum(1), np.arange(1 << n)
                fails = np.stack([table[:, mask >> f & 1 == 1, 0].sum(1) for f in range(n)])
                alone = table[:, [1 << f for f in range(n)], 0].T
                which = np.array(orders)  # (orders, n): the filter of a step
                removed = counts[..., 0]
                kept = total - removed.cumsum(1)
                # (orders, n, parts) to rows by part, order, step
                flat = lambda x: pa.array(np.moveaxis(x, 2, 0).ravel(), pa.int64())
                told = ["".join(names[f] for f in o) for o in orders]
                columns = [
                    pa.array(np.repeat(np.array(parts, object), len(orders) * n), pa.string()), pa.array([o for o in told for _ in range(n)] * len(parts), pa.string()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders) * len(parts))),
                    flat(kept), flat(removed), flat(fails[which] - removed), flat(alone[which]), flat(counts[..., 1]), flat(counts[..., 2]), flat(shapley[which]),
                ]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return cells.select("part", "cells").mapInArrow(run, ROW)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over (doc_id, text, source) with (doc_id, quality, toxic): see the module's text."""
    masked, scratch = masks(docs, labels)
    cells = materialise(count_cells(masked), "audit-cells")
    drop_files(scratch)
    return report(cells)
