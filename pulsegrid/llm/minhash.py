"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits (operator 3).

Every shingle of a whole text is hashed once; the hash's high part names one of ``bins``
bins and the lowest remaining hash in a bin is the bin's value. An empty bin takes the
value of a full one that a universal hash of (bin, attempt) picks, trying on until it hits
(optimal densification). A fingerprint stores the lowest ``bits`` of each bin's value, packed
in hexadecimal. Two unrelated bins agree by chance in 1 of 2^bits cases; ``likeness``
corrects for that: (agreeing share - 2^-bits) / (1 - 2^-bits), at least 0.

Defined cases: a null text is the empty text, whose fingerprint has all bins empty and is
written as "-", with likeness 1 to another empty text and 0 to any other; rows are
ordered by doc_id (null first), ties by a fixed order of the texts; repeated rows follow each other; the last row's
next row is the first; texts of any length are hashed whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shingles import mix, shingle_hashes, word_hashes

BINS, BITS, SHINGLE = 1024, 2, 5


@lru_cache(maxsize=64)
def _picks(bins: int, first: int, some: int) -> np.ndarray:
    """The bins that attempts first, first + 1, ... pick for each empty bin; the same for every document."""
    attempts = np.array([(a + 1) * 0x85EBCA77C2B2AE63 % (1 << 64) for a in range(first, first + some)], np.uint64)
    spots = mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B1) + attempts[:, None])
    return (spots >> np.uint64(64 - int(bins).bit_length() + 1)).astype(np.int64)


def _bin_values(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The lowest hash of each bin, empty bins filled by densification; ``hashes`` must not be empty."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    spots = (hashes >> shift).astype(np.int64)
    values = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(values, spots, mix(hashes))
    full = np.zeros(bins, bool)
    full[spots] = True
    empty, attempt, some = np.flatnonzero(~full), 0, 4
    while len(empty):
        hits = full[picks := _picks(bins, attempt, some).take(empty, 1)]
        found = hits.any(0)
        values[empty[found]] = values[picks[hits.argmax(0), np.arange(len(empty))][found]]
        empty, attempt, some = empty[~found], attempt + some, min(2 * some, 256)
    # each bin scrambles its value in its own way: two texts of few shingles don't agree in all low bits by one chance
    return mix(values + np.arange(bins, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def fingerprint(words: np.ndarray, *, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> np.ndarray | None:
    """Low-order bits of each bin (uint8), or None for a text without words."""
    hashes = shingle_hashes(words, k)
    return None if len(hashes) == 0 else (_bin_values(hashes, bins) & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None, *, bins: int = BINS, bits: int = BITS) -> str:
    """Hexadecimal form, ``bits`` bits a bin."""
    if values is None:
        return "-"
    planes = ((values[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, *, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints' texts, corrected for chance agreement."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1.0 / (1 << bits)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first characters of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the last column: whole texts are what the shuffle carries."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([z.compress(v.as_buffer()) for v in part.column(3)], pa.binary())], part.schema.names)


def in_order_with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (slot, tail, doc_id, compressed text) dealt by ranges of doc_id, each slot closed by the next slot's first row.

    Range bounds are approximate quantiles; the first id of each non-empty range is looked up exactly, and rows
    with that id also go to the range before, marked ``tail``. Only bounds and first ids reach the driver,
    one of each per range.
    """
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / partitions for i in range(1, partitions)], 0.25 / partitions))) if partitions > 1 else []
    edges = [int(b) for b in bounds]
    slot = F.lit(0)
    if edges:
        slot = F.when(F.col("doc_id").isNull(), 0).otherwise(F.array_size(F.filter(F.lit(edges).cast("array<bigint>"), lambda e: e <= F.col("doc_id"))))
    placed = docs.withColumn("slot", slot.cast("int"))
    firsts = sorted((r.slot, r.least_id, r.has_null) for r in placed.groupBy("slot").agg(F.min("doc_id").alias("least_id"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect())
    slots = [s for s, *_ in firsts]
    heads = [(None if null else least, slots[k - 1]) for k, (_, least, null) in enumerate(firsts)]  # the first slot's head closes the last slot
    table = F.array(*[F.struct(F.lit(h).cast("long").alias("head"), F.lit(s).cast("int").alias("slot")) for h, s in heads]) if heads else None
    if table is None:
        return placed.withColumn("tail", F.lit(False)).select("slot", "tail", "doc_id", F.col("text").cast("binary").alias("text"))
    also = F.transform(F.filter(table, lambda x: x["head"].eqNullSafe(F.col("doc_id"))), lambda x: F.struct(x["slot"].alias("slot"), F.lit(True).alias("tail")))
    own = F.array(F.struct(F.col("slot").alias("slot"), F.lit(False).alias("tail")))
    spread = placed.select("doc_id", "text", F.explode(F.concat(own, also)).alias("at")).select("at.slot", "at.tail", "doc_id", "text")
    spread = spread.mapInArrow(_compressed, "slot int, tail boolean, doc_id long, text binary")
    return spread.repartitionById(max(partitions, 1), F.col("slot")).sortWithinPartitions("slot", "tail", "doc_id", "text")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, with likeness to that form and to the next row."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    opts = {"bins": bins, "bits": bits}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        z = zstandard.ZstdDecompressor()
        held = None  # (slot, doc_id, text, fingerprint) that waits for its next row
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([z.decompress(v.as_buffer()) for v in part.column(3)], pa.binary()).cast(pa.string())
                marks = [fingerprint(w, k=k, **opts) for w in word_hashes(texts)]
                waiting, changed = [], []
                for slot, tail, doc, text, mark in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), texts.to_pylist(), marks, strict=True):
                    if held is not None and held[0] == slot:
                        waiting.append((held, mark))
                        changed.append(edited(held[2], text))
                    held = None if tail else (slot, doc, text, mark)
                rows = []
                for ((_, doc, text, mark), following), new, words in zip(waiting, changed, word_hashes(pa.array(changed, pa.string())), strict=True):
                    other = mark if new == text else fingerprint(words, k=k, **opts)
                    rows.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), packed(mark, **opts), packed(other, **opts), likeness(mark, other, bits=bits), likeness(mark, following, bits=bits)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order_with_next(base, n).mapInArrow(run, schema)
