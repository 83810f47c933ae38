"""Videos as a Spark data source: folders of raw clips that are read frame by frame, in batch and as a stream, and written whole or not at all.

A clip is a sequence of binary portable pixmaps (``P6``: width, height, 255, then the pixels) in one file, one frame after the other; the file's name is
its video's name.  ``spark.read.format("frames").option("fps", "2").load(folder)`` plans one partition for each piece of ``frames_per_task``
frames of a clip, so a long clip is read by many tasks; frames of a clip have one size, so a piece is found by arithmetic.

The folder must be one that all executors can open as files.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "video string, n long, t double, height int, width int, channels int, data binary"
_HEAD = re.compile(rb"P6\s+(\d+)\s+(\d+)\s+255\s")


@dataclass
class Piece(InputPartition):
    """Frames ``first`` to ``last`` (not included) of a clip; each takes ``step`` bytes, of which ``head`` are no pixels."""

    path: str
    first: int
    last: int
    step: int
    head: int
    width: int
    height: int


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its file, and video, number, place and length of each frame in it."""

    path: str
    index: list[tuple[str, int, int, int]]


def folder_of(options: dict) -> Path:
    if "path" not in options:
        raise ValueError("name the folder of the clips")
    return Path(re.sub(r"^file:(//)?", "", options["path"]))


def pieces(path: Path, frames_per_task: int) -> Iterator[Piece]:
    """The pieces of a clip.  A clip whose frames are not of one size, or whose last one is cut off, is refused."""
    size = path.stat().st_size
    with path.open("rb") as f:
        m = _HEAD.match(f.read(64))
    if not m:
        raise ValueError(f"{path} is no clip")
    width, height, head = int(m[1]), int(m[2]), m.end()
    step = head + 3 * width * height
    if not width or not height or size % step:
        raise ValueError(f"{path} ends within a frame")
    for first in range(0, size // step, frames_per_task):
        yield Piece(str(path), first, min(first + frames_per_task, size // step), step, head, width, height)


def frames_of(piece: Piece, fps: float) -> Iterator[tuple]:
    with open(piece.path, "rb") as f:
        f.seek(piece.first * piece.step)
        for n in range(piece.first, piece.last):
            frame = f.read(piece.step)
            m = _HEAD.match(frame[:64])
            if not m or (int(m[1]), int(m[2]), m.end()) != (piece.width, piece.height, piece.head):
                raise ValueError(f"frame {n} of {piece.path} is not like the first")
            yield Path(piece.path).stem, n, n / fps, piece.height, piece.width, 3, frame[piece.head :]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.fps, self.per_task = folder_of(options), float(options.get("fps", 2)), int(options.get("framespertask", options.get("frames_per_task", 64)))

    def partitions(self) -> list[Piece]:
        return [p for path in sorted(self.folder.glob("*.ppm")) for p in pieces(path, self.per_task)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from frames_of(partition, self.fps)


class FrameStream(FrameReader, DataSourceStreamReader):
    """New clips in order of their names: an offset is the name of the last one taken, so a clip must be put in place whole and under a later name."""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((p.name for p in self.folder.glob("*.ppm")), default="")}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [p for path in sorted(self.folder.glob("*.ppm")) if start["after"] < path.name <= end["after"] for p in pieces(path, self.per_task)]

    def commit(self, end: dict) -> None:
        pass


class FrameWriter(DataSourceWriter):
    """Each task writes its frames to files of its own beside the clips; commit puts them together and gives them their names, abort deletes them."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.run = folder_of(options), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        self.folder.mkdir(parents=True, exist_ok=True)
        path = self.folder / f".{self.run}-{context.partitionId()}-{context.taskAttemptId()}"
        parts: list[tuple[str, int, int, int]] = []
        with path.open("wb") as f:
            for r in rows:
                if r["channels"] != 3 or len(r["data"]) != 3 * r["width"] * r["height"]:
                    raise ValueError(f"frame {r['n']} of {r['video']} holds other than {r['width']} x {r['height']} pixels of three channels")
                at = f.tell()
                f.write(b"P6 %d %d 255\n" % (r["width"], r["height"]) + bytes(r["data"]))
                parts.append((r["video"], r["n"], at, f.tell() - at))
        return Part(str(path), parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = [m for m in messages if m is not None]
        frames = sorted((video, n, m.path, at, size) for m in done for video, n, at, size in m.index)
        videos = list(dict.fromkeys(f[0] for f in frames))
        try:
            if not frames:
                raise ValueError("no frame to write")
            if len({f[:2] for f in frames}) < len(frames):
                raise ValueError("a frame comes twice")
            if not self.overwrite and (there := [v for v in videos if (self.folder / f"{v}.ppm").exists()]):
                raise FileExistsError(f"clips are there already: {there[:3]}")
            for video in videos:
                with (self.folder / f".{self.run}-{video}.whole").open("wb") as out:
                    for _, _, path, at, size in (f for f in frames if f[0] == video):
                        with open(path, "rb") as f:
                            f.seek(at)
                            out.write(f.read(size))
            for video in videos:
                os.replace(self.folder / f".{self.run}-{video}.whole", self.folder / f"{video}.ppm")
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for path in self.folder.glob(f".{self.run}-*"):
            path.unlink(missing_ok=True)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(FrameSource)
