"""Removal of repeated passages by sliding sentence spans (operator 5).

A text is cut into sentences: after a full stop, exclamation or question mark, at line
ends, and inside long sentences after each word that has the least hash of ``LONGEST`` words in a row
without such an end. So no sentence is longer, and whether there is a cut after a word depends
on the ``LONGEST - 1`` words on both sides only, not on where a passage begins. A span is the
shortest run of at least ``SENTENCES`` consecutive sentences with at least ``LEAST_WORDS`` words. Every
span of every text is hashed; spans of equal hash are ordered by document and place, and
the sentences that any but the first covers are removed. Any passage of 50 words that two
places share word for word, with the same line ends, holds a whole span of both, and so is found: cuts after its
8th to 42nd word are the same in both places, one of them comes after the 15th at the latest, and a span
from there has ended 3 * 8 words later. Some of the passage's first and last words may stay.

Before the shuffle each batch keeps one row for equal spans; the others can't be the first
and travel under keys of their own, so a very common passage meets no single task.

Defined cases: null texts stay null, texts without a whole span stay as they are, and texts of
which nothing is left become empty; case and white space between words don't count;
rows that repeat id and text count as one place and stay alike; a null doc_id is ordered by
its text; ties of equal spans within one text go to the earlier place; texts of any length are cut by whole-text passes whose memory
is in proportion to the text; an empty table gives no rows; columns other than text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shingles import mix, words_in
from pulsegrid.llm.storage import plain_column

SENTENCES, LEAST_WORDS, LONGEST = 3, 12, 8
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_B = 0xC2B2AE3D27D4EB4F | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_SIZE = 1 << 19
_POW, _INV = _powers(_B, _SIZE + 1), _powers(pow(_B, -1, 1 << 64), _SIZE + 1)


def sentences(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indices of the first word of each sentence."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64)
    cut = _ENDS[data[starts + lengths - 1]]  # after word i
    lines = np.flatnonzero(data == 10)
    if len(lines):
        before = np.searchsorted(starts, lines) - 1
        cut[before[before >= 0]] = True
    if n >= LONGEST:
        # ends have the least value, so windows that hold one have no further cut
        value = np.where(cut, np.uint64(0), hashes)
        least = sliding_window_view(value, LONGEST).min(1)
        most = sliding_window_view(np.pad(least, LONGEST - 1), LONGEST).max(1)
        cut |= value == most  # the least word of some window
    first = np.ones(n, bool)
    first[1:] = cut[:-1]
    return np.flatnonzero(first)


def spans(heads: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span in order of its first sentence: one past its last sentence, and its hash."""
    n, words = len(heads), len(hashes)
    bounds = np.append(heads, words)
    ends = np.maximum(np.searchsorted(bounds, heads + LEAST_WORDS), np.arange(n) + SENTENCES)
    ends = ends[ends <= n]  # ends never decrease
    a, b = heads[: len(ends)], bounds[ends]
    out = np.zeros(len(ends), np.uint64)
    step = _SIZE - 4096  # a span has fewer words than that, so each lies in one stretch
    for lo in range(0, words, step):
        pick = (a >= lo) & (a < lo + step)
        if pick.any():
            part = hashes[lo : lo + _SIZE]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _POW[: len(part)], out=total[1:])
            out[pick] = (total[b[pick] - lo] - total[a[pick] - lo]) * _INV[a[pick] - lo]
    return ends, mix(out + (b - a).astype(np.uint64))


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds ``doc`` (the order of documents) and ``tag`` (31 bits that tell rows of one id with other texts apart)."""
    h = F.xxhash64("text")
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(h, 1))).withColumn("tag", F.pmod(h, F.lit(1 << 31)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, spot, later) of every span; ``later``: another of this batch comes before it."""
    for batch in batches:
        keys, docs, spots = [], [], []
        for doc, tag, (data, starts, lengths, hashes) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words_in(batch.column(2)), strict=True):
            _, own = spans(sentences(data, starts, lengths, hashes), hashes)
            keys.append(own)
            docs.append(np.full(len(own), doc, np.int64))
            spots.append((tag << 32) + np.arange(len(own), dtype=np.int64))
        if not keys or not (n := sum(map(len, keys))):
            continue
        key, doc, spot = np.concatenate(keys), np.concatenate(docs), np.concatenate(spots)
        order = np.lexsort((spot, doc, key))
        key, doc, spot = key[order], doc[order], spot[order]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        first = np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), n)))
        later = (doc != doc[first]) | (spot != spot[first])
        key = np.where(later, mix(doc.view(np.uint64) * np.uint64(_B) + spot.view(np.uint64)), key)
        for at in range(0, n, 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536]) for x in (key.view(np.int64), doc, spot, later)], ["key", "doc", "spot", "later"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, spot) of every span that isn't the first of its kind; ``docs`` has doc, tag and text."""
    found = docs.select("doc", "tag", "text").mapInArrow(_rows, "key long, doc long, spot long, later boolean")
    # the first of each batch only: a key has no more rows than there are batches
    place = F.rank().over(Window.partitionBy("key").orderBy("doc", "spot"))
    return found.withColumn("place", place).filter("later OR place > 1").select("doc", "spot")


def _without(text: str, drop: list[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the sentences that the spans at ``drop`` cover, and the removed ranges of bytes."""
    data, starts, lengths, hashes = next(words_in(pa.array([text])))
    heads = sentences(data, starts, lengths, hashes)
    ends, _ = spans(heads, hashes)
    gone = np.zeros(len(heads) + 1, np.int64)
    at = np.unique(np.array(drop, np.int64))
    at = at[at < len(ends)]  # whatever the tag let through
    np.add.at(gone, at, 1)
    np.add.at(gone, ends[at], -1)
    gone = np.append(np.cumsum(gone)[:-1] > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
    places = np.append(starts[heads], len(data))
    ranges = [(int(places[i]), int(places[j])) for i, j in zip(edges[::2], edges[1::2], strict=True)]
    raw, kept, last = data.tobytes(), [], 0
    for i, j in ranges:
        kept.append(raw[last:i])
        last = j
    kept.append(raw[last:])
    return b"".join(kept).decode().rstrip() if ranges else text, ranges


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` and ``n_chars`` after removal, and ``_removed`` (ranges of UTF-8 bytes of the old text).

    An input column of the name ``_removed`` is replaced; all others may have any names.
    """
    names = [n for n in docs.columns if n.lower() != "_removed"]
    at, by, chars = ({n.lower(): k for k, n in enumerate(names)}.get(x) for x in ("text", "doc_id", "n_chars"))
    own = docs.select(*[plain_column(n).alias(f"c{k}") for k, n in enumerate(names)])  # no name can clash with ours
    columns_in = own.columns
    base = _keyed(own.withColumns({"text": F.col(f"c{at}"), "doc_id": F.col(f"c{by}")})).drop("text", "doc_id")
    found = repeated_spans(base.withColumn("text", F.col(f"c{at}"))).groupBy("doc", F.shiftright("spot", 32).alias("tag")).agg(F.collect_list((F.col("spot") % (1 << 32)).cast("int")).alias("spots"))
    joined = base.join(found, ["doc", "tag"], "left").select(*columns_in, "spots")
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "spots"]
    removed = "array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts, gone = [], []
                for text, drop in zip(part.column(at).to_pylist(), part.column(len(names)), strict=True):
                    new, ranges = (text, []) if text is None or not drop.is_valid else _without(text, drop.as_py())
                    texts.append(new)
                    gone.append([{"start": i, "end": j} for i, j in ranges])
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                columns[-1] = pa.array(gone, ranges_type)
                yield pa.RecordBatch.from_arrays(columns, [*columns_in, "removed"])

    out = joined.mapInArrow(run, ", ".join([*fields, f"removed {removed}"]))
    if chars is not None:
        out = out.withColumn(f"c{chars}", F.when(F.size("removed") > 0, F.char_length(f"c{at}").cast("long")).otherwise(F.col(f"c{chars}")))
    return out.toDF(*names, "_removed")
