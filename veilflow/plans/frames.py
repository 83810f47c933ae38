"""Frames with their findings covered, written whole or not at all; what is known of a video; progress and cancelling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from veilflow.operators.images import mosaic


def video_metadata(declared: DataFrame, frames: DataFrame) -> DataFrame:
    """video, duration, has_audio and ``reason`` (null for a video that can be read) from declared (video, has_video, duration, has_audio).

    A duration that is missing, not positive or not finite is that of the last frame; a video whose audio is unknown counts as having it.
    """
    last = frames.groupBy("video").agg(F.max("t").alias("last_t"))
    given = F.when((F.col("duration") > 0) & (F.col("duration") < float("inf")), F.col("duration"))
    rows = declared.join(last, "video", "left").select("video", "has_video", F.coalesce(given, "last_t").alias("duration"), F.coalesce("has_audio", F.lit(True)).alias("has_audio"))
    reason = F.when(~F.coalesce("has_video", F.lit(False)), "no video track").when(F.col("duration").isNull(), "no duration")
    return rows.select("video", "duration", "has_audio", reason.alias("reason"))


def key_frame(index: Column, fps: int, every: int = 2) -> Column:
    """Whether the frame of an index (from 0) is a key frame: one every ``every`` seconds."""
    return F.pmod(index, F.lit(every * fps)) == 0


def covered_frames(frames: DataFrame, boxes: DataFrame, cells: int = 6) -> DataFrame:
    """``frames`` (video, t, height, width, channels, data), each presentation time once, with the ``boxes`` (video, t, x, y, w, h) of that time as mosaics.

    Boxes are gathered per frame before they meet the images, so an image moves once at most; boxes below two pixels cover nothing.
    """
    per_frame = boxes.groupBy("video", "t").agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h"))).alias("boxes"))
    once = frames.dropDuplicates(["video", "t"]).join(per_frame, ["video", "t"], "left").select(*frames.columns, "boxes")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data = []
            for r in pdf.itertuples(index=False):
                if r.boxes is None or not len(r.boxes):
                    data.append(r.data)
                    continue
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                for b in r.boxes:
                    image = mosaic(image, (math.floor(b["x"]), math.floor(b["y"]), math.ceil(b["w"]), math.ceil(b["h"])), cells)
                data.append(image.tobytes())
            yield pdf.drop(columns="boxes").assign(data=data)

    return once.mapInPandas(work, frames.schema)


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``df``, and an observation that gives the number of its rows once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry ``tag``; ``spark.sparkContext.cancelJobsWithTag(tag)`` ends them from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def write_whole(frames: DataFrame, path: str) -> int:
    """Write ``frames`` to a new folder and return their number; an error, or no frame at all, leaves nothing behind.

    The rows go to a folder beside ``path`` that takes its name once all of them are written.
    """
    spark = frames.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, part = hadoop.Path(path), hadoop.Path(path.rstrip("/") + ".part")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(path)
    rows, seen = observed(frames, "written")
    try:
        rows.write.mode("overwrite").parquet(str(part.toString()))
        n = seen.get["rows"]
        if not n:
            raise ValueError("no frame to write")
        if not fs.rename(part, final):
            raise OSError(f"{path} could not be put in place")
    except BaseException:
        fs.delete(part, True)
        raise
    return n
