"""Detections of a video as ragged arrays in one binary file, and a Spark data source over folders of them.

A file holds, little-endian: a magic of 8 bytes, frames n and boxes m (64-bit), n frame numbers and n + 1 offsets (64-bit), then
of all boxes the corners (4 x 32-bit float each), the scores (32-bit float) and the labels (32-bit). Boxes of frame i are those from offset i to
offset i + 1. Rows come out as Arrow lists over these arrays as they lie in the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

_MAGIC = b"RAGGED01"
SCHEMA = "video string, frame long, boxes array<array<float>>, scores array<float>, labels array<int>"
#: Bytes of files that a task reads, unless a single file has more; frames of a batch.
TASK_BYTES = 64 << 20
FRAMES = 8192


def pack(frames: np.ndarray, offsets: np.ndarray, boxes: np.ndarray, scores: np.ndarray, labels: np.ndarray) -> bytes:
    if len(offsets) != len(frames) + 1 or offsets[0] or offsets[-1] != len(boxes) or (np.diff(offsets) < 0).any() or (np.diff(frames) <= 0).any() or not len(boxes) == len(scores) == len(labels):
        raise ValueError("offsets must rise from 0 to the number of boxes, frames must rise, and each box needs a score and a label")
    parts = [frames.astype("<i8"), offsets.astype("<i8"), boxes.astype("<f4"), scores.astype("<f4"), labels.astype("<i4")]
    return _MAGIC + struct.pack("<qq", len(frames), len(boxes)) + b"".join(p.tobytes() for p in parts)


class Ragged:
    """The arrays of one file, without copies."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC or len(data) < 24:
            raise ValueError("not a file of ragged arrays")
        n, m = struct.unpack_from("<qq", data, 8)
        if len(data) != 24 + 8 * n + 8 * (n + 1) + 24 * m:
            raise ValueError("a file of ragged arrays is cut short")
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.frames, self.offsets = take("<i8", n), take("<i8", n + 1)
        self.boxes, self.scores, self.labels = take("<f4", 4 * m), take("<f4", m), take("<i4", m)

    def batches(self, video: str, low: int | None = None, high: int | None = None) -> Iterator[pa.RecordBatch]:
        """Rows of the frames from ``low`` to ``high``: lists are views between two offsets."""
        first = int(np.searchsorted(self.frames, low)) if low is not None else 0
        last = int(np.searchsorted(self.frames, high, "right")) if high is not None else len(self.frames)
        corners = pa.FixedSizeListArray.from_arrays(pa.array(self.boxes), 4)
        for a in range(first, last, FRAMES):
            b = min(a + FRAMES, last)
            offsets = pa.array(self.offsets[a : b + 1].astype(np.int32))
            boxes = pa.ListArray.from_arrays(offsets, corners.cast(pa.list_(pa.float32())))
            columns = [pa.array([video] * (b - a)), pa.array(self.frames[a:b]), boxes, pa.ListArray.from_arrays(offsets, pa.array(self.scores)), pa.ListArray.from_arrays(offsets, pa.array(self.labels))]
            yield pa.RecordBatch.from_arrays(columns, ["video", "frame", "boxes", "scores", "labels"])


def _place(path: str):
    """The file system of a path or address, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RaggedReader(DataSourceReader):
    """Files dealt out by size. Filters on ``video`` choose files before any is opened; a range of ``frame`` chooses rows before they are made."""

    def __init__(self, path: str):
        self.path = path
        self.videos: set[str] | None = None
        self.low: int | None = None
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("video",):
                found = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = found if self.videos is None else self.videos & found
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("frame",):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("frame",):
                self.high = f.value if self.high is None else min(self.high, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _place(self.path)
        found = [x for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".ragged")]
        if self.videos is not None:
            found = [x for x in found if _video(x.path) in self.videos]
        out: list[list[str]] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if not out or x.size > room:
                out.append([])
                room = TASK_BYTES
            out[-1].append(x.path)
            room -= x.size
        return [_Files(p) for p in out] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = _place(self.path)
        for path in partition.paths:
            with files.open_input_stream(path) as stream:
                data = Ragged(stream.read())
            yield from data.batches(_video(path), self.low, self.high)


def _video(path: str) -> str:
    return unquote(path.rpartition("/")[2].removesuffix(".ragged"))


class RaggedSource(DataSource):
    """`spark.read.format("ragged").load(folder)`, after `spark.dataSource.register(RaggedSource)`; filters reach it with spark.sql.python.filterPushdown.enabled."""

    @classmethod
    def name(cls) -> str:
        return "ragged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RaggedReader(self.options["path"])


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder of ragged files, with filters pushed to the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RaggedSource)
    return spark.read.format("ragged").load(path)


def save_ragged(df: DataFrame, path: str) -> None:
    """Writes rows (video, frame, boxes, scores, labels), a file for each video, which must fit a task. A file is there whole or not at all."""
    columns = ["frame", "boxes", "scores", "labels"]
    packed = df.groupBy("video").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        files, root = _place(path)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for video, rows in zip(batch.column("video"), batch.column("rows"), strict=True):
                items = rows.values
                frames, boxes = items.field("frame").to_numpy(zero_copy_only=False), items.field("boxes")
                offsets = np.concatenate(([0], np.cumsum(boxes.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                flat = [boxes.flatten().flatten(), items.field("scores").flatten(), items.field("labels").flatten()]
                data = pack(frames, offsets, flat[0].to_numpy(zero_copy_only=False).reshape(-1, 4), *[x.to_numpy(zero_copy_only=False) for x in flat[1:]])
                place = f"{root}/{quote(video.as_py(), safe='')}.ragged"
                with files.open_output_stream(beside := f"{place}.{uuid.uuid4().hex}") as stream:
                    stream.write(data)
                files.move(beside, place)  # the same bytes from a task that runs twice
            yield pa.RecordBatch.from_arrays([batch.column("video")], ["video"])

    packed.mapInArrow(write, "video string").write.format("noop").mode("overwrite").save()
