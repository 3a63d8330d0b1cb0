"""A quality classifier on hashed word n-grams, trained with follow-the-regularised-leader updates (operator 12).

A text's words are seen in three views: as they are (A-Z folded), by shape (where capitals, small letters and
digits stand, and which ASCII marks occur), and by repetition (whether a word is that one, two or three
places before). N-grams of one and two words, and of up to three shapes or repetitions, are hashed to ``BUCKETS``
weights. A view's counts become square roots of shares, so that texts of all lengths weigh alike.

FTRL-Proximal (McMahan and others, 2013) learns from one row after the other: each weight has its own rate, and
weights whose gradients don't reach ``L1`` stay exactly 0. The rows are labelled ones without the held-out
rows, at most ``max_rows`` (a documented bound: those with the lowest hash of doc_id). Their features are
computed where the texts are and written; every pass reads them in one fixed order through one task that holds
the weights alone. A score is a sparse dot product of a text's features and the weights, sent to executors (4 MB).

Neither labels nor lang, source or doc_id enter a score.

Defined cases: a null text is the empty text; texts without words score by the bias alone; labels other than 0 and
1 are ignored, of several labels for one document the highest counts; a null doc_id counts as the empty string for the
fold and has no label; with labels of one kind alone all scores are that label's share, without labels 1 (nothing
says that a document is bad); repeated rows give repeated rows; an empty table gives no rows; a text of any length is
read whole, in time linear in its length; other columns are kept by ``score``, but for ``score`` and ``predicted``, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.llm.shingles import BLOCK, mix, words_in
from pulsegrid.llm.storage import drop_files, materialise, plain_column, slices

FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 19
#: Words hashed at once, however long a text.
CHUNK = 1 << 17
#: Rates and penalties of the updates.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.05, 0.01, 3
_SALT = np.random.default_rng(12).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
# what bytes tell about a word's shape: a bit for capitals, small letters (and bytes of other scripts), digits, and one for each ASCII mark
_SHAPE = np.zeros(256, np.uint64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 1, 2, 2, 4
for _i, _b in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
    _SHAPE[_b] = np.uint64(8) << np.uint64(_i)


def _grams(tokens: np.ndarray, largest: int, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of 1 to ``largest`` tokens and the square roots of their shares, so that each view weighs 1."""
    found, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for at in range(0, len(tokens), CHUNK):
        every = []
        for n in range(1, largest + 1):
            to = min(at + CHUNK, len(tokens) - n + 1)
            if to <= at:
                break
            h = tokens[at:to] * _SALT[0]
            for j in range(1, n):
                h = h + tokens[at + j : to + j] * _SALT[j]
            every.append((mix(h + np.uint64(16 * view + n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        new, more = np.unique(np.concatenate(every), return_counts=True)
        if len(found):
            new, place = np.unique(np.concatenate([found, new]), return_inverse=True)
            more = np.bincount(place, np.concatenate([counts, more])).astype(np.int64)
        found, counts = new, more
    return found, np.sqrt(counts / counts.sum())


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's shape: what bytes it holds, whether the first is a capital and the last a mark; a block of bytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        kinds = _SHAPE[data[starts[at] : ends[to - 1]]]
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        # reduceat takes places inside: the last word ends at the block's end
        held = np.bitwise_or.reduceat(kinds, np.stack([s, np.minimum(e, len(kinds) - 1)], 1).ravel())[::2]
        held[-1] = np.bitwise_or.reduce(kinds[s[-1] :])
        out[at:to] = held * np.uint64(4) + (kinds[s] & np.uint64(1)) * np.uint64(2) + (kinds[e - 1] > 4)
        at = to
    return mix(out)


def _features(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, ascending, and their values for one text as ``words_in`` gives it."""
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    again = np.zeros(len(words), np.uint64)
    for back in (3, 2, 1):
        again[back:][words[back:] == words[:-back]] = back
    views = [_grams(words, 2, 0), _grams(_shapes(data, starts, starts + lengths), 3, 1), _grams(again, 3, 2)]
    at, place = np.unique(np.concatenate([v[0] for v in views]), return_inverse=True)
    return at, np.bincount(place, np.concatenate([v[1] for v in views])).astype(np.float32)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text, null as empty."""
    for found in words_in(texts):
        yield _features(*found)


@dataclass
class Model:
    """Weights of the buckets and the bias; of fixed size."""

    weights: np.ndarray
    bias: float = 0.0

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ values + self.bias, -30, 30))))


class Leader:
    """State of the FTRL-Proximal updates; the last place is the bias, which isn't penalised."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS + 1) if z is None else z
        self.n = np.zeros(BUCKETS + 1) if n is None else n

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return float(-self.z[-1] * ALPHA / (BETA + np.sqrt(self.n[-1])))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w @ values + b, -30, 30)))
        for place, x, old in ((at, values.astype(float), w), (np.array([BUCKETS]), np.ones(1), np.array([b]))):
            g = (p - label) * x
            n = self.n[place]
            self.z[place] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * old
            self.n[place] = n + g * g


def fold(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(place, label, buckets, values) of at most ``max_rows`` labelled rows outside of the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(fold() != HELD_OUT)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.desc("label")).limit(max_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id").select(F.xxhash64("doc_id").alias("place"), "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = list(features(part.column(2)))
                arrays = [pa.array([x[i] for x in found], pa.list_(t)) for i, t in ((0, pa.int32()), (1, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["place", "label", "buckets", "values"])

    return chosen.mapInArrow(run, "place long, label int, buckets array<int>, values array<float>")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000) -> Model:
    """Learns from a bounded sample; the driver sees label counts and, after each pass, the state (fixed size)."""
    sample = materialise(_sample(docs, labels, max_rows), "quality-sample")
    spark = sample.sparkSession
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n, good = sum(counts.values()), counts.get(1, 0)
    if len(counts) < 2:
        drop_files(sample)
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if good == n else -30.0)
    state = (None, None)
    for _ in range(PASSES):
        shared = spark.sparkContext.broadcast(state)

        def one_pass(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leader = Leader(*(None if x is None else np.frombuffer(x).copy() for x in shared.value))
            for batch in batches:
                for label, at, values in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    leader.learn(at.values.to_numpy(), values.values.to_numpy(), label)
            yield pa.RecordBatch.from_arrays([pa.array([leader.z.tobytes()], pa.binary()), pa.array([leader.n.tobytes()], pa.binary())], ["z", "n"])

        # in one order through one task: the updates follow each other
        ordered = sample.repartition(1).sortWithinPartitions("place", "label", F.xxhash64("buckets", "values"))
        row = ordered.mapInArrow(one_pass, "z binary, n binary").first()
        state = bytes(row.z), bytes(row.n)
        shared.unpersist()
    drop_files(sample)
    leader = Leader(*(np.frombuffer(x) for x in state))
    return Model(leader.weights(slice(0, BUCKETS)).astype(np.float32), leader.bias())


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted``; a task scores a few megabytes of text at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    at, plain = columns.index(text), [f"c{i}" for i in range(len(columns))]
    base = docs.select(*map(plain_column, columns)).toDF(*plain)  # workers get columns by place, whatever their names
    schema = StructType([*base.schema.fields, *StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                p = np.array([shared.value.score(*x) for x in features(part.column(at))], float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*plain, "score", "predicted"])

    return base.mapInArrow(run, schema).toDF(*columns, "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame, **fitting: int) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(base, train(base, labels, **fitting)).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")
