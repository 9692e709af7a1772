"""Binary point clouds, one for each guild: written in blocks by many tasks, read back and checked.

Little-endian: magic, version, number of points and a zero (16 bytes), then x, y, z as 32-bit floats for
each point, all chunk ids and all channel ids as 64-bit integers.

A guild may have any number of points that the format can count. Points are numbered in the order of guild and
chunk, and each block of ``BLOCK_POINTS`` is packed by a task of its own. The number of points before a block
tells where its three runs of bytes stand in the guild's file, so tasks write their runs side by side. Points
without a guild have no file and are left out.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.segments import numbered

MAGIC, VERSION, HEADER = b"GLXY", 1, 16  # fixed values of the format
BLOCK_POINTS = 1 << 16
#: Points that a task reads of a file.
READ_POINTS = 1 << 20

BLOCKS = "guild_id bigint, n bigint, start bigint, points bigint, xyz binary, chunk_ids binary, channel_ids binary"
POINTS = "guild_id bigint, chunk_id bigint, channel_id bigint, x float, y float, z float"


def header(n: int) -> bytes:
    return MAGIC + struct.pack("<III", VERSION, n, 0)


def runs(n: int, start: int) -> tuple[int, int, int]:
    """Where the coordinates, chunk ids and channel ids of the points from ``start`` on stand in a file of ``n`` points."""
    return HEADER + 12 * start, HEADER + 12 * n + 8 * start, HEADER + 20 * n + 8 * start


def checked(head: bytes, size: int) -> int:
    """The number of points of a file with this header and size; a wrong magic, version or length is an error."""
    if head[:4] != MAGIC:
        raise ValueError("not a point cloud")
    version, n, _ = struct.unpack("<III", head[4:HEADER])
    if version != VERSION:
        raise ValueError(f"version {version} of the format is unknown")
    if size != HEADER + 28 * n:
        raise ValueError(f"{size} bytes for {n} points")
    return n


def pack(xyz: np.ndarray, chunk_ids: np.ndarray, channel_ids: np.ndarray) -> bytes:
    return header(len(chunk_ids)) + xyz.astype("<f4").tobytes() + chunk_ids.astype("<i8").tobytes() + channel_ids.astype("<i8").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """xyz, chunk ids, channel ids of a whole file."""
    n = checked(data[:HEADER], len(data))
    at = runs(n, 0)
    return np.frombuffer(data, "<f4", 3 * n, at[0]).reshape(n, 3), np.frombuffer(data, "<i8", n, at[1]), np.frombuffer(data, "<i8", n, at[2])


def encode(points: DataFrame) -> DataFrame:
    """Blocks of ``points(guild_id, chunk_id, channel_id, x, y, z)``: the guild's number of points, how many stand before
    the block, and the block's three runs of bytes."""
    order = ["guild_id", "chunk_id", "channel_id", "x", "y", "z"]
    rows = numbered(points.where("guild_id is not null").select(*order), order)
    sizes = rows.groupBy("guild_id").agg(F.count("*").alias("n"), F.min("number").alias("first"))
    placed = rows.join(sizes, "guild_id").withColumn("at", F.col("number") - F.col("first")).withColumn("block", F.floor(F.col("at") / BLOCK_POINTS))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        packed = {"xyz": pdf[["x", "y", "z"]].to_numpy().astype("<f4"), "chunk_ids": pdf["chunk_id"].to_numpy().astype("<i8"), "channel_ids": pdf["channel_id"].to_numpy().astype("<i8")}
        told = {c: pdf[c].iloc[0] for c in ("guild_id", "n")} | {"start": pdf["at"].iloc[0], "points": len(pdf)}
        return pd.DataFrame([told | {c: x.tobytes() for c, x in packed.items()}])

    return placed.groupBy("guild_id", "block").applyInPandas(one, BLOCKS)


def decode(blocks: DataFrame) -> DataFrame:
    """The points of blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for guild, xyz, chunks, channels in zip(pdf["guild_id"], pdf["xyz"], pdf["chunk_ids"], pdf["channel_ids"], strict=True):
                yield _points(guild, bytes(xyz), bytes(chunks), bytes(channels)).to_pandas()

    return blocks.select("guild_id", "xyz", "chunk_ids", "channel_ids").mapInPandas(rows, POINTS)


def _points(guild: int, xyz: bytes, chunks: bytes, channels: bytes) -> pa.RecordBatch:
    at = np.frombuffer(xyz, "<f4").reshape(-1, 3)
    columns = [np.full(len(at), guild, np.int64), np.frombuffer(chunks, "<i8"), np.frombuffer(channels, "<i8"), *at.T]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["guild_id", "chunk_id", "channel_id", "x", "y", "z"])


def write(points: DataFrame, path: str) -> None:
    """A table of blocks under ``path``, a folder for each guild; on any file system."""
    encode(points).write.mode("overwrite").partitionBy("guild_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.schema(BLOCKS).parquet(path))


def _folder(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: files of clouds need a folder that driver and executors have mounted; write() takes any path")
    return parts.path


@dataclass
class _Written(WriterCommitMessage):
    """Points written for each guild, and how many it has."""

    points: dict[int, int]
    sizes: dict[int, int]


class _Writer(DataSourceWriter):
    """Tasks write their blocks' runs at their places in files of a hidden folder; a task that runs twice writes the
    same bytes again. The commit checks that all points came and puts the files in place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _folder(path), overwrite
        self.hidden = f"{self.path}/.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        told = _Written({}, {})
        os.makedirs(self.hidden, exist_ok=True)
        for r in iterator:
            fd = os.open(f"{self.hidden}/{r['guild_id']}.bin", os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                if r["start"] == 0:
                    _put(fd, header(r["n"]), 0)
                for column, at in zip(("xyz", "chunk_ids", "channel_ids"), runs(r["n"], r["start"]), strict=True):
                    _put(fd, bytes(r[column]), at)
                os.fsync(fd)
            finally:
                os.close(fd)
            told.points[r["guild_id"]] = told.points.get(r["guild_id"], 0) + r["points"]
            told.sizes[r["guild_id"]] = r["n"]
        return told

    def commit(self, messages: list[_Written | None]) -> None:
        points: dict[int, int] = {}
        sizes: dict[int, int] = {}
        for m in filter(None, messages):
            sizes |= m.sizes
            for guild, n in m.points.items():
                points[guild] = points.get(guild, 0) + n
        if points != sizes:
            raise ValueError("blocks of a guild are missing or came twice")
        os.makedirs(self.path, exist_ok=True)
        for guild in sizes:
            os.replace(f"{self.hidden}/{guild}.bin", f"{self.path}/{guild}.bin")
        if self.overwrite:
            for old in Path(self.path).glob("*.bin"):
                if int(old.stem) not in sizes:
                    old.unlink()
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


def _put(fd: int, data: bytes, at: int) -> None:
    while data:
        n = os.pwrite(fd, data, at)
        data, at = data[n:], at + n


@dataclass
class _Range(InputPartition):
    file: str
    n: int
    start: int
    stop: int


class _Reader(DataSourceReader):
    """A task reads a range of the points of a file; the driver looks at headers and sizes only."""

    def __init__(self, path: str, guild: str | None, step: int):
        self.path, self.guild, self.step = _folder(path), guild, step

    def partitions(self) -> list[_Range]:
        files = [Path(self.path, f"{self.guild}.bin")] if self.guild else sorted(Path(self.path).glob("*.bin"))
        found = []
        for file in files:
            with open(file, "rb") as f:
                n = checked(f.read(HEADER), file.stat().st_size)
            found += [_Range(str(file), n, lo, min(n, lo + self.step)) for lo in range(0, max(n, 1), self.step)]
        return found or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for lo in range(partition.start, partition.stop, BLOCK_POINTS):
            many = min(partition.stop, lo + BLOCK_POINTS) - lo
            with open(partition.file, "rb") as f:
                got = []
                for at, size in zip(runs(partition.n, lo), (12, 8, 8), strict=True):
                    f.seek(at)
                    got.append(f.read(size * many))
            yield _points(int(Path(partition.file).stem), *got)


class PointClouds(DataSource):
    """format("point_clouds"): writes blocks of ``encode`` as <guild>.bin under a mounted folder and reads their points.

    Options: path; for reading guild (one guild's points, an error where it has no file) and points (of a task).
    ``append`` replaces the files of the guilds that are written, ``overwrite`` removes those of other guilds too.
    """

    @classmethod
    def name(cls):
        return "point_clouds"

    def schema(self):
        return POINTS

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("guild"), int(self.options.get("points", READ_POINTS)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def write_files(points: DataFrame, folder: str, mode: str = "append") -> None:
    points.sparkSession.dataSource.register(PointClouds)
    encode(points).write.format("point_clouds").mode(mode).save(folder)


def read_files(spark: SparkSession, folder: str, guild_id: int | None = None) -> DataFrame:
    spark.dataSource.register(PointClouds)
    reader = spark.read.format("point_clouds")
    return (reader if guild_id is None else reader.option("guild", str(guild_id))).load(folder)
