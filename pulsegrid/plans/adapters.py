"""Views that show the plain tables as clips, regions, windows and labelled predictions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.config import DEFAULT
from pulsegrid.session import ship

#: One time unit of the event table's clips, in seconds.
UNIT = 21_600.0
EVENTS = replace(DEFAULT, window_s=20 * UNIT, step_s=15 * UNIT, max_gap_s=4 * UNIT, max_total_gap_s=8 * UNIT)
#: The event type that makes a region invalid.
BAD = {"forehead": "error", "lcheek": "signup", "rcheek": "view"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: clip, event_id, event_type, value, n_props, t (seconds from the clip's first), frame_idx."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip"), "event_id", "event_type", F.col("value").cast("double").alias("value"), F.length("props").alias("n_props"), us.alias("us"))
    rows = rows.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("clip"))) / F.lit(1e6))
    return rows.withColumn("frame_idx", F.row_number().over(Window.partitionBy("clip").orderBy("t", "event_id")) - 1)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event and region: colours are missing where the event's type says so."""
    kinds = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(b).alias("bad"), F.lit(10 * i).alias("more")) for i, (r, b) in enumerate(BAD.items())])
    rows = timeline(spark, sf_dir).withColumn("k", F.explode(kinds)).select("*", "k.*").drop("k")
    ok = F.col("event_type") != F.col("bad")
    rows = rows.withColumn("valid", ok).withColumn("pixel_count", F.col("n_props") + F.col("more"))
    return rows.withColumns({"r": F.when(ok, F.col("value")), "g": F.when(ok, F.col("value") * 0.5 + 1), "b": F.when(ok, F.col("value") * 0.25 + 2)})


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate windows at every step that end within the clip: clip, w_start, w_end."""
    last = timeline(spark, sf_dir).groupBy("clip").agg(F.max("t").alias("last_t")).filter(F.col("last_t") >= EVENTS.window_s)
    n = F.floor((F.col("last_t") - EVENTS.window_s) / EVENTS.step_s).cast("int")
    rows = last.select("clip", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return rows.select("clip", (F.col("k") * EVENTS.step_s).alias("w_start"), (F.col("k") * EVENTS.step_s + EVENTS.window_s).alias("w_end"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled predictions: grp, subject, row_at, truth, pred, conf."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    rows = items.join(parts, items.l_partkey == parts.p_partkey)
    return rows.select(
        F.col("l_returnflag").alias("grp"), F.col("l_suppkey").cast("string").alias("subject"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_at"),
        (F.col("l_extendedprice") / 1000).alias("truth"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("pred"), (F.col("l_discount") + F.col("p_size") / 100).alias("conf"),
    )


# The same views for the checking engine.
SQL_TIMELINE = """
ev0 AS (SELECT CAST(user_id AS VARCHAR) AS clip, event_id, event_type, CAST(value AS DOUBLE) AS value, length(props) AS n_props, epoch_us(ts) AS us FROM events),
ev AS (SELECT *, CAST(us - min(us) OVER (PARTITION BY clip) AS DOUBLE) / 1e6 AS t FROM ev0),
fr AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t, event_id) - 1 AS frame_idx FROM ev)"""
SQL_REGIONS = SQL_TIMELINE + """,
rg AS (SELECT fr.*, region, bad, more, event_type <> bad AS valid, n_props + more AS pixel_count,
  CASE WHEN event_type <> bad THEN value END AS r, CASE WHEN event_type <> bad THEN value * 0.5 + 1 END AS g, CASE WHEN event_type <> bad THEN value * 0.25 + 2 END AS b
  FROM fr, (VALUES ('forehead', 'error', 0), ('lcheek', 'signup', 10), ('rcheek', 'view', 20)) AS k(region, bad, more))"""
SQL_WINDOWS = """
lst AS (SELECT clip, max(t) AS last_t FROM ev GROUP BY clip HAVING max(t) >= 432000),
win AS (SELECT clip, k * 324000.0::DOUBLE AS w_start, k * 324000.0::DOUBLE + 432000.0::DOUBLE AS w_end
  FROM (SELECT clip, unnest(range(0, CAST(floor((last_t - 432000) / 324000) AS INT) + 1)) AS k FROM lst))"""
SQL_INTERVALS = """
st AS (SELECT clip, region, t, valid, lag(t) OVER o AS prev, coalesce(sum(valid::INT) OVER (PARTITION BY clip, region ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp,
  max(t) OVER (PARTITION BY clip, region) AS last_t, count(*) OVER (PARTITION BY clip, region) AS n FROM rg WINDOW o AS (PARTITION BY clip, region ORDER BY t)),
md AS (SELECT clip, region, median(t - prev) AS median_dt FROM st GROUP BY clip, region),
gr AS (SELECT clip, region, grp, min(CASE WHEN NOT valid THEN t END) AS first_bad, max(CASE WHEN valid THEN t END) AS closing, max(CASE WHEN valid THEN prev END) AS prev, any_value(last_t) AS last_t
  FROM st WHERE n >= 2 GROUP BY clip, region, grp),
iv AS (SELECT clip, region, CASE WHEN first_bad IS NOT NULL THEN first_bad ELSE prev + median_dt END AS start_t, coalesce(closing, last_t) AS end_t
  FROM gr JOIN md USING (clip, region) WHERE first_bad IS NOT NULL OR closing - prev > 2.0 * median_dt)"""
SQL_PREDICTIONS = """
pr AS (SELECT l_returnflag AS grp, CAST(l_suppkey AS VARCHAR) AS subject, l_orderkey * 10 + l_linenumber AS row_at, l_extendedprice / 1000 AS truth,
  l_quantity * p_retailprice / 1000 AS pred, l_discount + p_size / 100 AS conf FROM lineitem JOIN part ON l_partkey = p_partkey)"""
