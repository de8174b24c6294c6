"""TIFF stacks as a Spark data source.

A frame is a row: ``file``, ``frame``, ``height``, ``width``, ``pixels``.  A
file's directories are walked once to plan ranges of frames, which tasks then
read by themselves.  Uncompressed grey images of 8, 16 and 32 bits.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenframe.operators.image import FRAME

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}


@dataclass(frozen=True)
class Page:
    height: int
    width: int
    bits: int
    kind: int
    strips: tuple[tuple[int, int], ...]
    big_endian: bool


def pages(path: str) -> Iterator[Page]:
    """Image directories of a file in order."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is no TIFF file")
        at = struct.unpack(order + "I", head[4:])[0]
        while at:
            f.seek(at)
            n = struct.unpack(order + "H", f.read(2))[0]
            raw = f.read(12 * n + 4)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack(order + "HHI", raw[12 * i : 12 * i + 8])
                size = _SIZES.get(kind, 1) * count
                data = raw[12 * i + 8 : 12 * i + 12]
                if size > 4:
                    f.seek(struct.unpack(order + "I", data)[0])
                    data = f.read(size)
                code = {1: "B", 3: "H", 4: "I"}.get(kind)
                if code:
                    tags[tag] = struct.unpack(order + code * count, data[:size])
            if tags.get(259, (1,))[0] != 1:
                raise ValueError(f"{path} is compressed")
            yield Page(tags[257][0], tags[256][0], tags.get(258, (8,))[0], tags.get(339, (1,))[0], tuple(zip(tags[273], tags[279])), order == ">")
            at = struct.unpack(order + "I", raw[12 * n :])[0]


def read_page(path: str, page: Page) -> np.ndarray:
    dtype = np.dtype({(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (16, 2): "i2"}[page.bits, page.kind]).newbyteorder(">" if page.big_endian else "<")
    with open(path, "rb") as f:
        parts = []
        for offset, size in page.strips:
            f.seek(offset)
            parts.append(f.read(size))
    return np.frombuffer(b"".join(parts), dtype=dtype, count=page.height * page.width).reshape(page.height, page.width)


def count_pages(path: str) -> int:
    return sum(1 for _ in pages(path))


def write_stack(path: str, frames: Sequence[np.ndarray], bits: int = 16) -> None:
    """A little-endian uncompressed stack, one strip a frame."""
    dtype = {8: "u1", 16: "<u2", 32: "<f4"}[bits]
    kind = 3 if bits == 32 else 1
    with open(path, "wb") as f:
        f.write(b"II*\x00" + struct.pack("<I", 8 if len(frames) else 0))
        at = 8
        for i, image in enumerate(frames):
            data = np.ascontiguousarray(image.astype(dtype)).tobytes()
            tags = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, at + 2 + 12 * 10 + 4), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, len(data)), (339, 3, kind)]
            body = at + 2 + 12 * len(tags) + 4
            following = body + len(data) + (len(data) & 1)
            f.write(struct.pack("<H", len(tags)))
            for tag, t, v in tags:
                f.write(struct.pack("<HHI", tag, t, 1) + (struct.pack("<HH", v, 0) if t == 3 else struct.pack("<I", v)))
            f.write(struct.pack("<I", following if i + 1 < len(frames) else 0) + data + b"\x00" * (len(data) & 1))
            at = following


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    stop: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for part in options["path"].split(",") for p in (glob.glob(os.path.join(part, "**", "*.tif*"), recursive=True) if os.path.isdir(part) else glob.glob(part)))
        self.chunk = int(options.get("frames_per_task", 1000))
        self.wanted = {int(x) for x in options["frames"].split(",")} if options.get("frames") else None
        self.robust = options.get("robust", "true").lower() == "true"

    def partitions(self) -> list[FrameRange]:
        return [FrameRange(p, a, min(a + self.chunk, n)) for p in self.paths for n in [count_pages(p)] for a in range(0, n, self.chunk)]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        for i, page in enumerate(pages(partition.path)):
            if i >= partition.stop:
                return
            if i < partition.first or (self.wanted is not None and i not in self.wanted):
                continue
            try:
                image = read_page(partition.path, page)
            except (ValueError, KeyError, OSError):
                if not self.robust:
                    raise
                continue  # a damaged frame
            yield (partition.path, i, image.shape[0], image.shape[1], image.ravel().astype(float).tolist())


class TiffSource(DataSource):
    """``spark.read.format("tiff_stack").load(path)``; options ``frames``, ``frames_per_task``, ``robust``."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, frames: Sequence[int] | None = None, **options) -> DataFrame:
    """Frames of all stacks at a path; a list of frames is read alone."""
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("tiff_stack").option("path", path)
    if frames is not None:
        reader = reader.option("frames", ",".join(map(str, frames)))
    for k, v in options.items():
        reader = reader.option(k, str(v).lower())
    return reader.load()


def read_hyperstack(spark: SparkSession, path: str, slices: int, channels: int, **options) -> DataFrame:
    """Frames of a time, depth, channel stack with their indices."""
    i = F.col("frame")
    return read_tiff(spark, path, **options).withColumns({"t": F.floor(i / (slices * channels)).cast("int"), "z": F.floor(i / channels).cast("int") % slices, "c": i % channels})


def frame_counts(spark: SparkSession, path: str) -> DataFrame:
    """Frames of each file, from the directories alone."""
    paths = sorted(glob.glob(os.path.join(path, "**", "*.tif*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    table = spark.createDataFrame([(p,) for p in paths], "path string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(n_frames=[count_pages(x) for x in p["path"]])

    return table.mapInPandas(run, "path string, n_frames int")


def write_tiff(frames: DataFrame, folder: str, bits: int = 16) -> DataFrame:
    """One stack for each file name of the frames, in a folder that tasks can reach; returns the paths."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("frame")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, os.path.basename(str(part["file"].iloc[0])).split(".")[0] + ".tif")
        write_stack(path, [np.asarray(p).reshape(h, w) for p, h, w in zip(part["pixels"], part["height"], part["width"])], bits)
        return pd.DataFrame([(path, len(part))], columns=["path", "n_frames"])

    return frames.groupBy("file").applyInPandas(run, "path string, n_frames int")
