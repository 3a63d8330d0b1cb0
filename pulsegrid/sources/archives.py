"""One NumPy archive for each clip, written by tasks and published by the driver: masks, landmarks, signals and samples.

A task streams its clips in order of frames into files of a staging folder; a clip's frames aren't gathered (signals, some hundred
bytes a frame, are). Only when all tasks have succeeded are files moved to their names, and of a task that ran twice only the
attempt that counts; when the job fails the staging folder goes, and nothing has changed.

Files are written through Arrow's file systems (local, HDFS, S3, GCS), so the path must be one of theirs.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pulsegrid.config import DEFAULT, Config
from pulsegrid.session import ship
from pulsegrid.sources.readers import named_by_suffix

# Suffixes of the stages' files, points of a face.
SUFFIXES = {"masks": "_seg.npz", "landmarks": "_landmarks.npz", "signals": "_signals.npz", "samples": "_sample.npz"}
POINTS = 478
# Frames of signals that a task sorts and writes, clips being whole: about 1 KB each in its memory.
FRAMES = 50_000
# Bytes of a batch that are Python objects at a time.
SLICE = 1 << 18


class _Archive:
    """An archive being written, member by member."""

    def __init__(self, out: Any):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.member = None

    def begin(self, name: str, shape: tuple[int, ...], dtype: type) -> None:
        self.dtype = np.dtype(dtype)
        self.member = self.zip.open(f"{name}.npy", "w", force_zip64=True)
        np.lib.format.write_array_header_2_0(self.member, {"descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False, "shape": shape})

    def add(self, values: np.ndarray) -> None:
        self.member.write(np.ascontiguousarray(values, self.dtype).tobytes())

    def end(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def whole(self, name: str, values: np.ndarray) -> None:
        self.begin(name, values.shape, values.dtype)
        self.add(values)
        self.end()

    def close(self) -> None:
        self.end()
        self.zip.close()


def _masks(out: _Archive, rows: Iterator[dict]) -> None:
    for i, r in enumerate(rows):
        if i == 0:
            out.begin("masks", (r["n"], r["h"], r["w"]) if r["n"] else (0, 0, 0), np.uint8)
            shape = r["h"], r["w"]
        if r["n"]:
            out.add(np.frombuffer(r["cls"], np.uint8).reshape(shape))


def _landmarks(out: _Archive, rows: Iterator[dict]) -> None:
    for i, r in enumerate(rows):
        if i == 0:
            out.begin("landmarks", (r["n"], POINTS, 3), np.float32)
        if r["n"]:
            out.add(np.full((POINTS, 3), np.nan) if r["pts"] is None else np.array(r["pts"], np.float32).reshape(POINTS, 3))


def _signals(out: _Archive, rows: Iterator[dict]) -> None:
    colours, counts, times, regions = [], [], [], 0
    for r in rows:
        regions = r["regions"]
        if r["n"]:
            colours.append([np.nan if v is None else v for v in r["colours"]])
            counts.append([v or 0 for v in r["counts"]])
            times.append(r["t"])
    out.whole("signals", np.array(colours, np.float64).reshape(-1, regions, 3))
    out.whole("timestamps", np.array(times, np.float64))
    out.whole("pixel_counts", np.array(counts, np.int32).reshape(-1, regions))


def _samples(out: _Archive, rows: Iterator[dict]) -> None:
    for r in rows:
        by = {x["name"]: x for x in r["packed"]}
        own = [by[n] for n in r["names"]]
        size = len(own[0]["px"])
        colours = [np.stack([np.full(size, np.nan) if x[c] is None else np.array(x[c], float) for c in "rgb"], -1) for x in own]
        out.whole("signals", np.stack(colours, 1).astype(np.float32))
        out.whole("pixel_counts", np.stack([x["px"] for x in own], 1).astype(np.float32))
        out.whole("region_mask", np.array([x["valid"] for x in own], bool))
        out.whole("fps", np.array(r["fps"], np.float32))


_WRITERS = {"masks": _masks, "landmarks": _landmarks, "signals": _signals, "samples": _samples}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``SLICE`` bytes, one row at least."""
    step = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ClipWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind, self.suffix = options["path"], options["kind"], options["suffix"]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        system, root = _file_system(self.path)
        folder, files = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        rows = (r for batch in iterator for part in _slices(batch) for r in part.to_pylist())
        row = next(rows, None)
        while row is not None:
            clip, after = row["clip"], []

            def own(row=row, clip=clip, after=after) -> Iterator[dict]:
                yield row
                for r in rows:
                    if r["clip"] != clip:
                        after.append(r)
                        return
                    yield r

            name = f"{clip}{self.suffix}"
            with system.open_output_stream(f"{folder}/{len(files)}") as stream:
                archive, frames = _Archive(stream), own()
                _WRITERS[self.kind](archive, frames)
                archive.close()
            files.append((f"{folder}/{len(files)}", f"{root}/{name}"))
            row = after[0] if after else None
        return _Staged(files)

    def commit(self, messages: list[_Staged | None]) -> None:
        system, root = _file_system(self.path)
        for m in messages:
            for staged, final in m.files if m else []:
                system.move(staged, final)
        self._clear(system, root)

    def abort(self, messages: list[_Staged | None]) -> None:
        self._clear(*_file_system(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class ClipArchives(DataSource):
    """``df.write.format("clip_archive")`` with the options kind and suffix."""

    @classmethod
    def name(cls) -> str:
        return "clip_archive"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ClipWriter(dict(self.options))


def _prepared(df: DataFrame, kind: str, config: Config) -> DataFrame:
    """Rows (clip, frame_idx, ...) as the writer of a kind takes them; frame_idx is NULL where a clip has no frames."""
    if kind == "masks":
        return df.select("clip", "frame_idx", "h", "w", "cls")
    if kind == "landmarks":
        flat = F.flatten(F.transform("pts", lambda p: F.array(*[p[c].cast("float") for c in "xyz"])))
        return df.select("clip", "frame_idx", flat.alias("pts"))
    if kind == "samples":
        return df.select(F.col("segment").alias("clip"), F.lit(0).alias("frame_idx"), F.col("fps").cast("float").alias("fps"), F.col("regions").alias("packed"), F.array(*map(F.lit, config.regions)).alias("names"))
    one = [F.struct(*[F.max(F.when(F.col("region") == r, F.col(c))).alias(c) for c in ("r", "g", "b", "pixel_count")]).alias(f"_{i}") for i, r in enumerate(config.regions)]
    frames = df.groupBy("clip", "frame_idx").agg(F.first("t").alias("t"), *one)
    n = len(config.regions)
    return frames.select("clip", "frame_idx", "t", F.array(*[F.col(f"_{i}.{c}").cast("double") for i in range(n) for c in "rgb"]).alias("colours"), F.array(*[F.col(f"_{i}.pixel_count") for i in range(n)]).alias("counts"), F.lit(n).alias("regions"))


def write(df: DataFrame, path: str, kind: str, *, clips: DataFrame | None = None, overwrite: bool = False, suffix: str | None = None, config: Config = DEFAULT) -> None:
    """One archive ``<clip><suffix>`` for each clip of masks, landmarks, signals (frames) or samples (packed windows).

    ``clips`` (clip) names clips that get an archive though they have no frames: masks of shape (0, 0, 0), landmarks (0, 478, 3), signals (0, regions, 3).
    Without ``overwrite`` clips that have an archive are left alone. A frame without a face is NaN.
    """
    spark, ending = ship(df.sparkSession), suffix or SUFFIXES[kind]
    spark.dataSource.register(ClipArchives)
    tasks = []
    if kind == "signals":  # tasks by the number of frames: Spark's own number would let a task's frames grow with the table
        tasks = [-(-df.count() // (FRAMES * max(1, len(config.regions)))) or 1]
        df = df.repartition(*tasks, "clip")
    rows = _prepared(df, kind, config)
    if clips is not None:
        rows = clips.select("clip").distinct().join(rows, "clip", "left")
        if kind == "signals":
            rows = rows.withColumn("regions", F.lit(len(config.regions)))
    if kind in ("masks", "landmarks"):  # a header with the number of frames comes first
        rows = rows.join(rows.groupBy("clip").agg(F.count("frame_idx").cast("int").alias("n")), "clip")
    else:
        rows = rows.filter("clip IS NOT NULL").withColumn("n", F.col("frame_idx").isNotNull().cast("int"))
    if not overwrite:
        try:
            rows = rows.join(named_by_suffix(spark, path, ending).select(F.col("name").alias("clip")), "clip", "left_anti")
        except Exception as e:  # no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    rows.repartition(*tasks, "clip").sortWithinPartitions("clip", "frame_idx").write.format("clip_archive").option("kind", kind).option("suffix", ending).mode("append").save(path)
