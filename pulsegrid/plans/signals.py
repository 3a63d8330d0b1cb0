"""Registered queries on signal kernels, features and networks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import nets
from pulsegrid.operators import augment, cache, learning, scoring, waveforms
from pulsegrid.plans import signal_sql
from pulsegrid.plans.adapters import table
from pulsegrid.scratch import shared_dir

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SPECTRUM = """
v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS y FROM v),
b AS (SELECT k FROM (SELECT unnest(range(129)) AS k) WHERE k * 30 / 256.0::DOUBLE BETWEEN 0.9 AND 2.8),
p AS (SELECT vec_id, k, pow(sum(y * cos(2 * pi() * k * i / 256)), 2) + pow(sum(y * sin(2 * pi() * k * i / 256)), 2) AS power FROM c, b GROUP BY vec_id, k),
m AS (SELECT vec_id, max(power) AS top, median(power) AS mid FROM p GROUP BY vec_id)
SELECT p.vec_id, round(min(k) * 30 / 256.0::DOUBLE * 60, 4) AS hr, round(any_value(top / (mid + 1e-12)), 3) AS conf FROM p JOIN m USING (vec_id) WHERE power = top GROUP BY p.vec_id"""


@query(f"WITH {_SPECTRUM}")
def m3_o4_spectral_sql(spark, sf_dir):
    """Heart rate from a DFT in DataFrame expressions."""
    power = waveforms.spectrum(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 30.0, 256)
    return waveforms.peaks(power, "vec_id").select("vec_id", F.round("hr", 4).alias("hr"), F.round("conf", 3).alias("conf"))


@query(f"WITH {_SPECTRUM}")
def m3_spectral_kernel(spark, sf_dir):
    """The same from the batch kernel."""
    out = table(spark, sf_dir, "embeddings").select("vec_id", waveforms.heart_rate("embedding").alias("x"))
    return out.select("vec_id", F.round("x.hr", 4).alias("hr"), F.round("x.conf", 3).alias("conf"))


def _total(c):
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x)), 4)


_VECTORS = "v AS (SELECT vec_id AS key, CAST(unnest(range(64)) AS INT) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_SUMS = "SELECT key AS vec_id, CAST(count(*) AS INT) AS n, round(sum(abs(x)), 4) AS sum_abs FROM y GROUP BY key"


@query(f"WITH RECURSIVE {_VECTORS}, {signal_sql.detrended('v', 'y', 64)} {_SUMS}")
def m1_detrended(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", waveforms.detrended("embedding").alias("y")).select("vec_id", F.size("y").alias("n"), _total("y").alias("sum_abs"))


@query(f"WITH RECURSIVE {_VECTORS}, {signal_sql.bandpassed('v', 'y', 64)} {_SUMS}")
def m2_bandpassed(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", waveforms.bandpassed("embedding").alias("y")).select("vec_id", F.size("y").alias("n"), _total("y").alias("sum_abs"))


@query("WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, count(*) AS n, round(max((x - m) / (s + 1e-9)), 4) AS top FROM v JOIN (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY vec_id) USING (vec_id) GROUP BY vec_id")
def m15_z_normalised(spark, sf_dir):
    z = table(spark, sf_dir, "embeddings").select("vec_id", waveforms.z_normalised("embedding").alias("z"))
    return z.select("vec_id", F.size("z").cast("long").alias("n"), F.round(F.array_max("z"), 4).alias("top"))


BLOCK = 4096


def _colours(spark, sf_dir):
    """Three neighbouring vectors of a label as one colour series; positive values.

    Vectors are numbered within a label and a block of ``BLOCK`` ids; a block's last series repeats its last vector where one or two are missing.
    """
    block = F.floor(F.col("vec_id") / BLOCK)
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double") + 10).alias("x")).withColumn("block", block)
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("label", "block").orderBy("vec_id")) - 1)
    rows = rows.groupBy("label", "block", F.floor(F.col("at") / 3).alias("trio")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("xs"))
    return rows.select(F.concat_ws("_", "label", "block", "trio").alias("segment"), *[F.col("xs")[F.least(F.lit(i), F.size("xs") - 1)]["x"].alias(c) for i, c in enumerate("rgb")])


# the colour series, and what the three methods make of them
_COLOURS = f"""
nb AS (SELECT label, vec_id // {BLOCK} AS block, vec_id, embedding, row_number() OVER (PARTITION BY label, vec_id // {BLOCK} ORDER BY vec_id) - 1 AS place FROM embeddings),
tr AS (SELECT label || '_' || block || '_' || place // 3 AS segment, list(embedding ORDER BY vec_id) AS xs FROM nb GROUP BY label, block, place // 3),
co AS (SELECT segment, c, CAST(unnest(range(64)) AS INT) AS i, unnest(xs[least(c, len(xs))])::DOUBLE + 10 AS x FROM tr, (SELECT unnest([1, 2, 3]) AS c))"""
_METHODS = f"""
sc AS (SELECT segment, i, max(s) FILTER (c = 1) AS r, max(s) FILTER (c = 2) AS g, max(s) FILTER (c = 3) AS b, max(x) FILTER (c = 2) AS green FROM (SELECT *, x / (avg(x) OVER (PARTITION BY segment, c) + 1e-9) AS s FROM co) GROUP BY segment, i),
pw AS (SELECT segment, a, i, c, x / (avg(x) OVER (PARTITION BY segment, a, c) + 1e-9) AS s FROM co, (SELECT unnest(range(17)) AS a) WHERE i BETWEEN a AND a + 47),
ps AS (SELECT segment, a, i, max(s) FILTER (c = 2) - max(s) FILTER (c = 3) AS s1, max(s) FILTER (c = 2) + max(s) FILTER (c = 3) - 2 * max(s) FILTER (c = 1) AS s2 FROM pw GROUP BY segment, a, i),
ph AS (SELECT segment, a, i, s1 + stddev_pop(s1) OVER w / (stddev_pop(s2) OVER w + 1e-9) * s2 AS h FROM ps WINDOW w AS (PARTITION BY segment, a)),
raw AS (
  SELECT segment || '|green' AS key, i, green AS x FROM sc UNION ALL SELECT segment || '|x', i, 3 * r - 2 * g FROM sc UNION ALL SELECT segment || '|y', i, 1.5 * r + g - 1.5 * b FROM sc
  UNION ALL SELECT segment || '|pos', i, sum(h - m) FROM (SELECT *, avg(h) OVER (PARTITION BY segment, a) AS m FROM ph) GROUP BY segment, i),
{signal_sql.bandpassed("raw", "bp", 64)},
sp AS (SELECT split_part(key, '|', 1) AS segment, split_part(key, '|', 2) AS kind, i, x, stddev_pop(x) OVER (PARTITION BY key) AS sd FROM bp),
wv AS (
  SELECT segment || '|' || kind AS key, i, x FROM sp WHERE kind IN ('pos', 'green')
  UNION ALL SELECT a.segment || '|chrom', a.i, a.x - a.sd / (b.sd + 1e-9) * b.x FROM sp a JOIN sp b ON a.segment = b.segment AND a.i = b.i AND a.kind = 'x' AND b.kind = 'y'),
{signal_sql.heart_rates("wv", "hr", 64, 256)}"""


@query(
    f"""WITH RECURSIVE {_COLOURS}, {_METHODS} SELECT split_part(key, '|', 1) AS segment, {", ".join(f"round(max({k}) FILTER (split_part(key, '|', 2) = '{m}'), 4) AS {k.replace('hr.', '')}_{m}" for m in ("pos", "chrom", "green") for k in ("hr.hr", "conf"))} FROM hr GROUP BY 1"""
)
def m4_m7_method_rates(spark, sf_dir):
    """POS, CHROM and green on colour series."""
    out = _colours(spark, sf_dir).select("segment", waveforms.method_waveforms("r", "g", "b").alias("w"))
    cols = [F.round(f"w.{m}.{k}", 4).alias(f"{k}_{m}") for m in ("pos", "chrom", "green") for k in ("hr", "conf")]
    return out.select("segment", *cols)


def _samples(spark, sf_dir):
    """Packed samples of three regions (600 values each, the 64 repeated) with labels."""
    rows = _colours(spark, sf_dir)
    long = lambda c: F.slice(F.flatten(F.array_repeat(F.col(c), 10)), 1, 600).cast("array<float>")
    px = F.transform(long("g"), lambda x: (x * 10).cast("float"))
    region = lambda name, ok: F.struct(F.lit(name).alias("name"), F.lit(ok).alias("valid"), *[(long(c) if ok else F.lit(None).cast("array<float>")).alias(c) for c in "rgb"], (px if ok else F.array_repeat(F.lit(0.0).cast("float"), 600)).alias("px"))
    out = rows.select("segment", F.array(region("forehead", True), region("lcheek", True), region("rcheek", False)).alias("regions"), F.col("r")[0].alias("x"))
    return out.withColumn("hr", 70 + F.col("x")).withColumn("hb", F.col("x"))


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) >= 1e-9 THEN ({a}) / ({b}) ELSE 0 END"


_LEVELS = [(f"{c}_{k}", f"{k}{c}") for c in "RGB" for k in ("dc", "ac", "acdc")]
_PAIRS = [(f"{k}_{a}_over_{b}", _safe(f"{k}{a}", f"{k}{b}")) for k, pairs in (("acdc", ("GR", "RB", "GB")), ("dc", ("RG", "RB", "GB"))) for a, b in pairs]
_PIXELS = [("pixels_mean", "pm"), ("pixels_std", "pd"), ("pixels_median", "pq"), ("pixels_detection_fraction", "pf"), ("pixels_normalized_mean", _safe("pm", "px"))]


@query(
    f"""WITH RECURSIVE {_COLOURS},
lo AS (SELECT segment || '|' || c AS key, CAST(i + 64 * rep AS INT) AS i, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x FROM co, (SELECT unnest(range(10)) AS rep) WHERE i + 64 * rep < 600),
{signal_sql.bandpassed("lo", "bp", 600)},
st AS (SELECT key, avg(x) AS dc, CASE WHEN stddev_pop(x) >= 1e-9 THEN sd ELSE 0 END AS ac FROM lo JOIN (SELECT key, stddev_pop(x) AS sd FROM bp GROUP BY key) USING (key) GROUP BY key, sd),
ra AS (SELECT split_part(key, '|', 1) AS segment, split_part(key, '|', 2) AS c, dc, ac, {_safe("ac", "dc")} AS acdc FROM st),
wi AS (SELECT segment, {", ".join(f"max({k}) FILTER (c = '{i}') AS {k}{c}" for i, c in enumerate("RGB", 1) for k in ("dc", "ac", "acdc"))} FROM ra GROUP BY segment),
pi AS (SELECT split_part(key, '|', 1) AS segment, avg(p) AS pm, stddev_pop(p) AS pd, median(p) AS pq, avg((p > 0)::INT) AS pf, max(p) AS px FROM (SELECT key, CAST(CAST(CAST(x AS FLOAT) * 10 AS FLOAT) AS DOUBLE) AS p FROM lo WHERE split_part(key, '|', 2) = '2') GROUP BY 1),
al AS (SELECT * FROM wi JOIN pi USING (segment)),
ft AS ({" UNION ALL ".join(f"SELECT segment, '{name}' AS feature, CAST({value} AS DOUBLE) AS value FROM al" for name, value in _LEVELS + _PAIRS + _PIXELS)})
SELECT segment, region || '_' || feature AS feature, round(CAST(CAST(CASE WHEN region = 'rcheek' THEN 0 ELSE value END AS FLOAT) AS DOUBLE), 4) AS value FROM ft, (VALUES ('forehead'), ('lcheek'), ('rcheek')) AS k(region)"""
)
def m9_g15_g16_features(spark, sf_dir):
    """The 60 hemoglobin features, as named rows."""
    names = F.array(*[F.lit(n) for n in learning.feature_names()])
    out = _samples(spark, sf_dir).select("segment", F.posexplode(learning.features_column()).alias("i", "value")).withColumn("feature", F.element_at(names, F.col("i") + 1))
    return out.select("segment", "feature", F.round(F.col("value").cast("double"), 4).alias("value"))


@query()
def n1_n11_hr_inference(spark, sf_dir):
    """Heart rates of an untrained network of fixed seed: the scoring path."""
    options = {"width": 96, "seed": 7}
    out = learning.predict(_samples(spark, sf_dir).select("segment", "regions"), learning.Model("hr", nets.save(nets.PulseNet(**options)), options))
    return out.select("segment", F.round("hr_pred", 3).alias("hr_pred"), F.round("hr_pred_conf", 4).alias("hr_pred_conf"))


@query()
def n4_hb_inference(spark, sf_dir):
    options = {"seed": 7}
    out = learning.predict(_samples(spark, sf_dir).select("segment", "regions"), learning.Model("hb", nets.save(nets.HbNet(**options)), options))
    return out.select("segment", F.round("hb_pred", 3).alias("hb_pred"))


@query()
def n6_multi_task_inference(spark, sf_dir):
    options = {"width": 96, "n_features": 60, "seed": 7}
    out = learning.predict(_samples(spark, sf_dir).select("segment", "regions"), learning.Model("both", nets.save(nets.PulseNet(**options)), options))
    return out.select("segment", F.round("hr_pred", 3).alias("hr_pred"), F.round("hb_pred", 3).alias("hb_pred"))


def _channels(spark, sf_dir):
    """Vectors as signals of eight channels with eight values each, two regions of four channels."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice(x, c * 8 + 1, F.lit(8))).alias("signal"))


def _drawn(use: str) -> str:
    return f"('0x' || substr(md5('42:' || label || ':' || vec_id || ':{use}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    f"""WITH d AS (SELECT vec_id, embedding, CAST(floor(({_drawn("shift")}) * 31) AS INT) - 15 AS shift, CASE WHEN {_drawn("loss")} < 0.3 THEN CAST(floor(({_drawn("region")}) * 2) AS INT) END AS lost_region FROM embeddings),
v AS (SELECT vec_id, shift, lost_region, c, i, CAST(embedding[c * 8 + (((i - shift) % 8) + 8) % 8 + 1] AS DOUBLE) AS x FROM d, (SELECT unnest(range(8)) AS c), (SELECT unnest(range(8)) AS i))
SELECT vec_id, shift, lost_region, CAST(c AS INT) AS channel, CAST(i AS INT) AS i, round(CASE WHEN c // 4 = lost_region THEN 0 ELSE x END, 6) AS value FROM v"""
)
def f5_shift_and_loss(spark, sf_dir):
    """Signals shifted in time, some without a region; the label stands for the epoch."""
    out = augment.augmented(_channels(spark, sf_dir), "vec_id", "signal", epoch="label", amplitude=0.0, noise=0.0)
    rows = out.select("vec_id", "shift", "lost_region", F.posexplode("signal").alias("channel", "x")).select("vec_id", "shift", "lost_region", "channel", F.posexplode("x").alias("i", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query()
def f5_augmented(spark, sf_dir):
    """All transforms, noise and amplitudes as well, summed up by channel."""
    out = augment.augmented(_channels(spark, sf_dir), "vec_id", "signal", epoch=1)
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return out.select("vec_id", "shift", "lost_region", F.posexplode("signal").alias("channel", "x")).select("vec_id", "shift", "lost_region", "channel", F.round(total, 6).alias("total"))


@query()
def n13_results(spark, sf_dir):
    """Samples and manifest to the 15 columns of the result rows, with an untrained hemoglobin network of fixed seed."""
    rows = _samples(spark, sf_dir)
    manifest = rows.select("segment", F.substring_index("segment", "_", 1).alias("clip"), F.lit(0.0).alias("t_start"), F.lit(20.0).alias("t_end"), F.when(F.col("x") > 10, F.col("hr").cast("string")).otherwise("").alias("ppg_hr"), F.lit("72").alias("pulse"), F.col("hb").alias("hemoglobin"))
    model = learning.Model("hb", nets.save(nets.HbNet(seed=7)), {"seed": 7})
    out = scoring.results(rows.select("segment", "regions"), manifest, hb_model=model)
    return out.select(*[F.round(c, 3).alias(c) if t == "double" else c for c, t in out.dtypes])


_SEGMENTS = "SELECT CAST(sum((n + 2) // 3) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label, vec_id // 4096)"


@query(f"SELECT 'first' AS run, ({_SEGMENTS}) AS computed, ({_SEGMENTS}) AS rows UNION ALL SELECT 'second', 0, ({_SEGMENTS}) UNION ALL SELECT 'other settings', ({_SEGMENTS}), ({_SEGMENTS})")
def k11_cached_features(spark, sf_dir):
    """Features through a cache in the shared folder: all rows are computed once, none again, all for other settings."""
    rows, path = _samples(spark, sf_dir).select("segment", "regions"), f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    made = lambda df: df.withColumn("features", learning.features_column())
    each = []
    for run, settings in (("first", {"fps": 30}), ("second", {"fps": 30}), ("other settings", {"fps": 25})):
        out, computed = cache.cached(rows, ["segment", "regions"], made, "features", path, settings)
        each.append(computed.agg(F.count("*").alias("computed")).select(F.lit(run).alias("run"), "computed", F.lit(out.filter("size(features) = 60").count()).cast("long").alias("rows")))
    return each[0].union(each[1]).union(each[2])


@query()
def n8_training_history(spark, sf_dir):
    """Data-parallel training of the hemoglobin network, with the operator's own rounds and patience."""
    part = _samples(spark, sf_dir).select("regions", "hb", learning.part_by_hash("segment").alias("part"))
    _, history = learning.train(part.filter("part = 'train'").drop("part"), part.filter("part <> 'train'").drop("part"), "hb")
    return spark.createDataFrame([(h["epoch"], round(h["train_loss"], 6), None if h["val_mae"] is None else round(h["val_mae"], 6), h["lr"]) for h in history], "epoch int, train_loss double, val_mae double, lr double")
