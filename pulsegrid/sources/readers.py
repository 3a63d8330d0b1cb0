"""Readers of the stages' file formats as DataFrames."""

from __future__ import annotations

import io
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators.labels import base_name, last_per_key
from pulsegrid.schema import GROUND_TRUTH, MANIFEST, RESULT
from pulsegrid.session import ship

# Video file extensions, a later one wins over an earlier for one clip.
VIDEO_EXTENSIONS = ("mp4", "avi", "mov", "mkv")
# Stands for a NULL subject or state in a bundle; no encoded text holds a backslash.
NO_KEY = "\\N"


def listing(spark: SparkSession, folder: str, extensions: tuple[str, ...] = VIDEO_EXTENSIONS) -> DataFrame:
    """(clip, path) of files with one of the extensions, letter case aside; sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    at = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    rows = files.withColumn("at", at).filter("at > 0").withColumn("clip", base_name("path"))
    return last_per_key(rows, ["clip"], "at").select("clip", "path").orderBy("path")


def named_by_suffix(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(name, path) of archives: file names without the suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.withColumn("name", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), f"{suffix}$", ""))


def npz(spark: SparkSession, path: str, keys: list[str], suffix: str = ".npz") -> DataFrame:
    """(name, key, shape, dtype, values as double) of the wanted arrays of NumPy archives, one row per array."""
    schema = "name string, key string, dtype string, shape array<int>, values array<double>"
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False)
                rows = [(p.rsplit("/", 1)[-1].removesuffix(suffix), k, str(held[k].dtype), list(held[k].shape), held[k].astype(float).ravel()) for k in keys if k in held]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["name", "key", "dtype", "shape", "values"])

    return files.mapInArrow(run, schema)


def pulse_lines(texts: DataFrame) -> DataFrame:
    """Lines 'value date time' of recordings (subject, state, content as text): seq, line, value, ts, error.

    Blank lines are skipped; a bad value is an error, a bad or missing time only makes ts NULL (with an error).
    """
    rows = texts.select("subject", "state", F.posexplode(F.split("content", "\r?\n")).alias("line_number", "line"))
    return parsed(rows.withColumn("line_number", (F.col("line_number") + 1).cast("long")))


def parsed(lines: DataFrame) -> DataFrame:
    """Numbered lines of recordings with value, ts and error; blank ones are skipped."""
    rows = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    parts = F.split("line", r"\s+")
    rows = rows.withColumn("value", F.expr(r"try_cast(get(split(line, '\\s+'), 0) as double)"))
    rows = rows.withColumn("ts", F.try_to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))))
    error = F.when(F.col("value").isNull(), "bad value").when(F.col("ts").isNull(), "bad time")
    return rows.withColumn("error", error)


def _within(values: list[str] | None) -> str:
    """A folder pattern of some names, or of all."""
    if values is None:
        return "*"
    plain = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", v) for v in values]
    return plain[0] if len(plain) == 1 else "{" + ",".join(plain) + "}"


def recording_lines(spark: SparkSession, path: str, *, subjects: list[str] | None = None, states: list[str] | None = None, pattern: str = "*.PW") -> DataFrame:
    """Lines of recordings <path>/<subject>/<state>/<file>: subject, state, file, line_number (from 1 in a file), line.

    Files are read in ranges of bytes that end at line ends (``spark.sql.files.maxPartitionBytes``), so that a recording of any length is
    many tasks'; only folders of the wanted subjects and states are listed. A line's number is its place in its range and the
    lines of the file's ranges before: those are counted by a first pass, a row for each range.
    """
    for wanted in (subjects, states):
        if wanted is not None and not wanted:
            return spark.createDataFrame([], "subject string, state string, file string, line_number long, line string")
    raw = spark.read.option("lineSep", "\n").text(f"{path.rstrip('/')}/{_within(subjects)}/{_within(states)}/{pattern}")
    out = _numbered(raw, F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    part = lambda i: F.url_decode(F.replace(F.element_at(F.split("file", "/"), i), F.lit("+"), F.lit("%2B")))
    return out.select(part(-3).alias("subject"), part(-2).alias("state"), "file", "line_number", F.regexp_replace("line", "\r$", "").alias("line"))


def _numbered(raw: DataFrame, line: Column, **keys: Column) -> DataFrame:
    """Rows of text files with file, line and line_number: from 1 in a file, or in a file's lines with the same keys, which follow one another."""
    at = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), **keys}
    rows = raw.select(*[c.alias(n) for n, c in at.items()], F.monotonically_increasing_id().alias("at"), line.alias("line"))
    ranges = rows.groupBy(*at).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", *keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(ranges.select(*at, (before - F.col("first") + 1).alias("shift")), [*at])
    return out.select("file", *keys, (F.col("at") + F.col("shift")).alias("line_number"), "line")


def bundle_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of recordings in the bundles of ``sinks.bundles``: subject, state, file, line_number (from 1 in a recording), line.

    Files are read in ranges of bytes as those of ``recording_lines``; what is listed and opened grows with the bytes, not with the recordings.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    key = lambda i: F.split_part("value", F.lit("\t"), F.lit(i))
    out = _numbered(raw, F.regexp_extract("value", r"(?s)^[^\t]*\t[^\t]*\t(.*?)\r?\z", 1), subject=key(1), state=key(2))
    plain = lambda c: F.when(F.col(c) != NO_KEY, F.url_decode(c)).alias(c)
    return out.select(plain("subject"), plain("state"), "file", "line_number", "line")


def pulse(spark: SparkSession, path: str, *, subjects: list[str] | None = None, states: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Recordings *.PW below <subject>/<state>: samples (subject, state, seq, value, ts) and bad rows (line_number, line, error)."""
    lines = parsed(recording_lines(spark, path, subjects=subjects, states=states))
    good = lines.filter("value IS NOT NULL").select("subject", "state", F.col("line_number").alias("seq"), "value", "ts")
    return good, lines.filter("error IS NOT NULL").select("subject", "state", "line_number", "line", "error")


def pulse_rate(samples: DataFrame, keys: list[str], fallback: float = 100.0) -> DataFrame:
    """Sampling frequency and start per recording: (timed samples - 1) over the time from the first to the last, else the fallback."""
    timed = samples.filter("ts IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("ts", "seq").alias("start"), F.max_by("ts", "seq").alias("stop"))
    span = (F.unix_micros("stop") - F.unix_micros("start")) / 1e6
    rate = F.when((span > 0) & (F.col("n") > 1), (F.col("n") - 1) / span).otherwise(fallback)
    every = samples.select(*keys).distinct().join(timed, keys, "left")
    return every.select(*keys, F.coalesce(rate, F.lit(fallback)).alias("sampling_frequency"), "start")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(clip, patient_id, pulse, hemoglobin): rows without patient are dropped, of a clip's rows the last holds; blanks are NULL."""
    rows = spark.read.option("header", True).schema(GROUND_TRUTH).csv(path).withColumn("at", F.monotonically_increasing_id())
    rows = rows.withColumn("clip", base_name("video")).withColumn("patient_id", F.trim("patient_id")).filter("coalesce(patient_id, '') <> ''")
    return last_per_key(rows, ["clip"], "at").select("clip", "patient_id", "pulse", "hemoglobin")


def manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("segment", "clip")) -> DataFrame:
    """The window manifest; an error names missing columns."""
    raw = spark.read.option("header", True).csv(path)
    if gone := [c for c in required if c not in raw.columns]:
        raise ValueError(f"manifest lacks {gone}")
    kinds = dict(f.split() for f in MANIFEST.split(", "))
    return raw.select(*[F.expr(f"try_cast(`{c}` as {kinds.get(c, 'string')})").alias(c) for c in raw.columns])


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(RESULT).csv(path)


def frame_times(lines: DataFrame, value: str = "value") -> DataFrame:
    """Frame times from a dump of one number per line (clip, line_number, value); other lines are skipped, clips with under two have none."""
    rows = lines.withColumn("t", F.expr(f"try_cast(trim(`{value}`) as double)")).filter("t IS NOT NULL AND NOT isnan(t)")
    enough = rows.groupBy("clip").agg(F.count("*").alias("n"), (F.max_by("t", "line_number") - F.min_by("t", "line_number")).alias("duration")).filter("n > 1")
    return rows.join(enough, "clip").select("clip", "line_number", "t", "n", "duration")


def frame_counts(frames: DataFrame) -> DataFrame:
    """Frames of each clip; clips without a frame (a row whose frame_idx is NULL) have 0."""
    return frames.groupBy("clip").agg(F.count("frame_idx").alias("frames"))
