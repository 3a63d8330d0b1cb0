"""Splits, inference and training of the networks over DataFrames of packed samples.

Training is data-parallel: each round sends the weights to all partitions, every partition runs an epoch
over its own rows, and the driver averages what comes back (one set of weights per partition). Rows
never leave their executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT, Config
from pulsegrid.functions import dsp, nets
from pulsegrid.scratch import drop, written

#: Batches that a partition of training rows holds on average, at least.
LOCAL = 4
#: Rows that networks take at a time, as a layer of width 96 holds every row's values, and that features take (a call of the filters costs 0.4 s whatever its rows).
FEW, SLICE = 32, 1024


def split_sizes(n: int, val: float = 0.1, test: float = 0.1) -> tuple[int, int, int]:
    """Subjects for training, validation and test: at least one each."""
    if n < 3:
        raise ValueError("three subjects are needed")
    n_val, n_test = max(1, round(n * val)), max(1, round(n * test))
    if n_val + n_test >= n:
        n_val = n_test = 1
    return n - n_val - n_test, n_val, n_test


def split_subjects(df: DataFrame, subject: str, *, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(subject, part) with the reference order: sorted distinct ids, shuffled with NumPy's generator, test first, then validation.

    The distinct ids go through the driver; use ``split_by_hash`` where they don't fit.
    """
    ids = [r[0] for r in df.select(subject).distinct().orderBy(subject).collect()]
    order = np.array(ids, dtype=object)
    np.random.default_rng(seed).shuffle(order)
    _, n_val, n_test = split_sizes(len(ids), val, test)
    rows = [(s, "test" if i < n_test else "val" if i < n_test + n_val else "train") for i, s in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, df.select(subject, F.lit("").alias("part")).schema)


def split_by_hash(df: DataFrame, subject: str, *, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """(subject, part) by a hash of seed and id: no driver, stable when subjects come and go, shares in expectation."""
    return df.select(subject).distinct().withColumn("part", part_by_hash(subject, seed=seed, val=val, test=test))


def part_by_hash(subject: str, *, seed: int = 42, val: float = 0.1, test: float = 0.1) -> Column:
    """The part of a row's subject, as ``split_by_hash`` has it; rows need no join."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(subject).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.when(share < test, "test").when(share < test + val, "val").otherwise("train")


def sample_arrays(regions: pd.Series, config: Config = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """Packed samples as (B, R, T, 3) with NaN for missing colours and (B, R, T) counts, regions in the config's order."""
    n, t = len(regions), config.samples
    colours, counts = np.full((n, len(config.regions), t, 3), np.nan), np.zeros((n, len(config.regions), t))
    for i, row in enumerate(regions):
        for r in row:
            k = config.regions.index(r["name"])
            counts[i, k] = r["px"]
            if r["r"] is not None:
                colours[i, k] = np.stack([r["r"], r["g"], r["b"]], -1)
    return colours, counts


def feature_names(config: Config = DEFAULT) -> list[str]:
    """Names of the hemoglobin features, in order."""
    out = []
    for r in config.regions:
        out += [f"{r}_{c}_{k}" for c in "RGB" for k in ("dc", "ac", "acdc")]
        out += [f"{r}_{kind}_{a}_over_{b}" for kind, pairs in (("acdc", ("GR", "RB", "GB")), ("dc", ("RG", "RB", "GB"))) for a, b in pairs]
        out += [f"{r}_pixels_{k}" for k in ("mean", "std", "median", "detection_fraction", "normalized_mean")]
    return out


def hb_features(colours: np.ndarray, counts: np.ndarray, config: Config = DEFAULT) -> np.ndarray:
    """(B, 20 R) float32 features of (B, R, T, 3) colours and (B, R, T) counts."""
    blocks = []
    for k in range(colours.shape[1]):
        level, swing, ratio = {}, {}, {}
        for c, name in enumerate("RGB"):
            level[name], swing[name] = dsp.ac_dc(colours[:, k, :, c], config.fps, config)
            ratio[name] = dsp.safe_ratio(swing[name], level[name])
            blocks += [level[name], swing[name], ratio[name]]
        blocks += [dsp.safe_ratio(ratio[a], ratio[b]) for a, b in ("GR", "RB", "GB")]
        blocks += [dsp.safe_ratio(level[a], level[b]) for a, b in ("RG", "RB", "GB")]
        n = counts[:, k]
        blocks += [n.mean(1), n.std(1), np.median(n, 1), (n > 0).mean(1), dsp.safe_ratio(n.mean(1), n.max(1))]
    return np.stack(blocks, 1).astype(np.float32)


def features_column(regions: str = "regions", config: Config = DEFAULT) -> Column:
    """Hemoglobin features of packed samples as ARRAY<FLOAT>."""

    @F.arrow_udf("array<float>")
    def run(s: pa.Array) -> pa.Array:
        return features_of(s, config)

    return run(regions)


def features_of(column: pa.Array, config: Config = DEFAULT) -> pa.Array:
    """Features of a batch of packed samples."""
    return pa.array([f for few in few_rows(column, SLICE) for f in hb_features(*sample_arrays(few, config), config)], pa.list_(pa.float32()))


def few_rows(column: pa.Array, n: int) -> Iterator[pd.Series]:
    """A batch of packed samples, ``n`` rows at a time: whole batches (10,000 rows of some 30 KB) are never Python objects or float64 arrays at once."""
    for at in range(0, len(column), n):
        # taken, as Arrow converts all that lies below a slice
        yield column.take(pa.array(np.arange(at, min(at + n, len(column))))).to_pandas()


@dataclass
class Model:
    """What scoring needs; saved as weights (.npz bytes) and a JSON description."""

    kind: str  # hr, hb or both
    weights: bytes
    options: dict = field(default_factory=dict)
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    def net(self, config: Config = DEFAULT) -> nets.Stack:
        made = nets.HbNet(**self.options) if self.kind == "hb" else nets.PulseNet(config=config, **self.options)
        return nets.load(made, self.weights) if self.weights else made

    def describe(self) -> str:
        return json.dumps({"kind": self.kind, "options": self.options, "feature_mean": self.mean, "feature_std": self.std})


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """A model as a table of one row (description as JSON, weights), wherever Spark can write; an older one there is replaced."""
    row = (model.describe(), bytearray(model.weights))
    spark.createDataFrame([row], "description string, weights binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> Model:
    """What ``write_model`` wrote, to score or to go on training with."""
    row = spark.read.parquet(path).first()
    if row is None:
        raise ValueError(f"no model in {path}")
    told = json.loads(row.description)
    return Model(told["kind"], bytes(row.weights), told["options"], told["feature_mean"], told["feature_std"])


def _inputs(kind: str, regions: pd.Series | None, model: Model, config: Config, features: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Signals and normalised features as a network takes them; features that are there aren't computed from the regions."""
    colours, counts = (None, None) if kind == "hb" and features is not None else sample_arrays(regions, config)
    x = None if kind == "hb" else nets.network_input(colours, counts)
    f = None if kind == "hr" else (hb_features(colours, counts, config) if features is None else features).astype(float)
    if f is not None and model.mean:
        f = (f - np.array(model.mean)) / np.array(model.std)
    return x, f


def predict(samples: DataFrame, model: Model, config: Config = DEFAULT) -> DataFrame:
    """Adds hr_pred, hr_pred_conf and hb_pred (NULL where the model has none); a task loads the model once."""
    shared = samples.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("hr_pred double, hr_pred_conf double, hb_pred double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        net = m.net(config)
        kinds = pa.schema([(c, pa.float64()) for c in ("hr_pred", "hr_pred_conf", "hb_pred")])
        for s in batches:
            out = [pa.RecordBatch.from_pandas(_scored(net, m, *_inputs(m.kind, few, m, config)), kinds, preserve_index=False).to_struct_array() for few in few_rows(s, FEW)]
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct(list(kinds)))

    return samples.withColumn("_p", run("regions")).select(*samples.columns, "_p.*")


def _scored(net: nets.Stack, model: Model, x: np.ndarray | None, f: np.ndarray | None) -> pd.DataFrame:
    """hr_pred, hr_pred_conf and hb_pred of some rows' inputs."""
    out = pd.DataFrame({c: [None] * len(f if x is None else x) for c in ("hr_pred", "hr_pred_conf", "hb_pred")}, dtype=float)
    if model.kind == "hb":
        out["hb_pred"] = net.predict(f)
    else:
        bpm, _, p, hb = net.forward(x, features=f)
        out["hr_pred"], out["hr_pred_conf"] = bpm, nets.confidence(p, net.bpm, bpm)
        if hb is not None:
            out["hb_pred"] = hb
    return out


def _scored_rows(held: DataFrame, model: Model, truth: str, config: Config) -> DataFrame:
    """(truth, guess) of rows as ``_held`` wrote them."""
    shared, guess = held.sparkSession.sparkContext.broadcast(model), "hr_pred" if model.kind == "hr" else "hb_pred"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        net = m.net(config)
        for rows in batches:
            for at in range(0, len(rows), FEW):
                own = rows.iloc[at : at + FEW]
                yield pd.DataFrame({"truth": own[truth].to_numpy(float), "guess": _scored(net, m, *_given(m, own, config))[guess].to_numpy(float)})

    return held.mapInPandas(run, "truth double, guess double")


def _held(rows: DataFrame, kind: str, need: list[str], config: Config) -> DataFrame:
    """What all rounds read of some rows, written once: labels, features (where the network has them) and regions (where it takes signals)."""
    features = [] if kind == "hr" else [features_column(config=config).alias("features")]
    return written(rows.select(*[] if kind == "hb" else ["regions"], *features, *[F.col(c).cast("double").alias(c) for c in need]), "training-rows")


def _given(model: Model, rows: pd.DataFrame, config: Config) -> tuple[np.ndarray | None, np.ndarray | None]:
    return _inputs(model.kind, rows.get("regions"), model, config, np.stack(rows["features"]) if "features" in rows else None)


def _epoch(net: nets.Stack, adam: nets.Adam, kind: str, x, f, hr, hb, batch: int, rng, hb_weight: float, cap_k: float | None) -> float:
    """One pass over some rows of a partition."""
    total, n = 0.0, len(f if kind == "hb" else x)
    order = rng.permutation(n)
    for at in range(0, n, batch):
        own = order[at : at + batch]
        if len(own) < 2:  # batch statistics need two rows
            continue
        if kind == "hb":
            value, d = net.loss(net.predict(f[own], True), hb[own])
            net.backward(d[:, None])
        else:
            out = net.forward(x[own], True, None if f is None else f[own])
            value, d, d_hb = net.loss(hr[own], out, hb=None if kind == "hr" else hb[own], hb_weight=hb_weight, cap_k=cap_k)
            net.backward(d, d_hb)
        adam.step()
        total += value * len(own)
    return total / max(n, 1)


def train(
    train_rows: DataFrame, val_rows: DataFrame, kind: str, *, options: dict | None = None, rounds: int = 80, patience: int = 15, rate: float = 1e-3, batch: int = 128,
    hb_weight: float = 0.1, cap_k: float | None = None, seed: int = 42, start: Model | None = None, keep: str | None = None, config: Config = DEFAULT,
) -> tuple[Model, list[dict]]:
    """Trains on samples (regions, and hr and/or hb) by rounds of local epochs and averaged weights.

    The rate halves after five rounds without a better validation value; ``patience`` rounds without one end it. Returns the
    best model and the history. Partitions with fewer than two rows take no part. ``start`` is a model to go on with (its
    normalisation is kept); ``keep`` a folder where the last and the best model so far are written after each round.

    Rows and their features are computed once and written to the scratch folder; rounds read them from there. Partitions hold
    ``LOCAL`` batches on average at least, so that few rows make one partition.
    """
    need = {"hr": ["hr"], "hb": ["hb"], "both": ["hr", "hb"]}[kind]
    if start is not None and start.kind != kind:
        raise ValueError(f"a model of kind {start.kind} can't go on as {kind}")
    model = start or Model(kind, b"", dict(options or {}))
    spark = train_rows.sparkSession
    train_held, val_held = _held(train_rows, kind, need, config), _held(val_rows, kind, need, config)
    try:
        return _rounds(spark, train_held, val_held, model, rounds, patience, rate, batch, hb_weight, cap_k, seed, keep, config)
    finally:
        drop(train_held)
        drop(val_held)


def _rounds(
    spark: SparkSession, train_rows: DataFrame, val_rows: DataFrame, model: Model, rounds: int, patience: int, rate: float, batch: int, hb_weight: float, cap_k: float | None, seed: int,
    keep: str | None, config: Config,
) -> tuple[Model, list[dict]]:
    """The rounds of ``train`` over rows that ``_held`` wrote."""
    kind = model.kind
    if kind != "hr" and not model.mean:
        norm = train_rows.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
        model.mean, model.std = [r.m for r in norm], [1.0 if r.s < 1e-8 else r.s for r in norm]
    train_rows = train_rows.coalesce(max(1, train_rows.count() // (LOCAL * batch)))
    model = Model(kind, nets.save(model.net(config)), model.options, model.mean, model.std)
    history, best, best_model, stale = [], None, model, 0
    for epoch in range(1, rounds + 1):
        shared, now = spark.sparkContext.broadcast(model), rate

        def local(batches: Iterator[pd.DataFrame], epoch=epoch, shared=shared, now=now) -> Iterator[pd.DataFrame]:
            m = shared.value
            net = m.net(config)
            adam, rng = nets.Adam(net, now), np.random.default_rng(seed + epoch)  # moments build up over a partition's whole pass
            loss, n = 0.0, 0
            for rows in batches:
                if len(rows) > 1:
                    x, f = _given(m, rows, config)
                    own = _epoch(net, adam, kind, x, f, *(rows[c].to_numpy(float) if c in rows else None for c in ("hr", "hb")), batch, rng, hb_weight, cap_k)
                    loss, n = loss + own * len(rows), n + len(rows)
            if n:
                yield pd.DataFrame({"weights": [nets.save(net)], "loss": [loss / n], "n": [n]})

        back = train_rows.mapInPandas(local, "weights binary, loss double, n long").collect()
        shared.unpersist()
        if not back:
            raise ValueError("no partition has two training rows")
        net, total = model.net(config), sum(r.n for r in back)
        parts = [nets.load(model.net(config), bytes(r.weights)) for r in back]
        for i, leaf in enumerate(net.leaves()):
            for kind_of in ("p", "s"):
                for k in getattr(leaf, kind_of):
                    getattr(leaf, kind_of)[k] = sum(getattr(list(p.leaves())[i], kind_of)[k] * r.n for p, r in zip(parts, back, strict=True)) / total
        model = Model(kind, nets.save(net), model.options, model.mean, model.std)
        pred, e = _scored_rows(val_rows, model, "hr" if kind == "hr" else "hb", config), F.col("guess") - F.col("truth")
        m = pred.agg(F.avg(F.abs(e)).alias("mae"), F.sum(F.pow(e, 2)).alias("res"), F.var_pop("truth").alias("var"), F.count("truth").alias("n")).first()
        r2 = 1 - m.res / (m.var * m.n) if m.n and m.var and m.var * m.n > 1e-12 else None
        score = m.mae if kind == "hr" or r2 is None else -r2
        history.append({"epoch": epoch, "train_loss": sum(r.loss * r.n for r in back) / total, "val_mae": m.mae, "val_r2": r2, "lr": rate})
        if keep:
            write_model(spark, model, f"{keep}/last")
        if best is None or score < best:
            best, best_model, stale = score, model, 0
            if keep:
                write_model(spark, model, f"{keep}/best")
        else:
            stale += 1
            rate *= 0.5 if stale % 5 == 0 else 1
            if stale >= patience:
                break
    return best_model, history
