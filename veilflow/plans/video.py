"""The whole scan: frames to samples, the gate, recognisers, hits, findings, and frames with their findings covered.

Images are read where they lie and never shuffled but once, where covered frames meet their boxes; signatures, words and boxes travel instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilflow.detect.rules import CATEGORIES
from veilflow.operators import assembly, folds
from veilflow.operators import geometry as G
from veilflow.operators.images import luma_signature
from veilflow.plans import frames as covering
from veilflow.plans import sightings
from veilflow.sources import recognisers as R
from veilflow.sources.kept import Kept

Load = Callable[[], Callable | None]


@dataclass(frozen=True)
class Readers:
    """Plug-ins, each a function that loads a reader; what is not wanted is never called."""

    text: Load | None = None
    codes: Load | None = None
    faces: Load | None = None


@dataclass(frozen=True)
class Categories:
    """An ordered set of categories, never empty when a scan begins."""

    names: tuple[str, ...] = CATEGORIES

    def toggled(self, name: str) -> Categories:
        """With ``name`` if it was not in, without it if it was."""
        if name not in CATEGORIES:
            raise ValueError(f"no category {name!r}")
        return Categories(tuple(n for n in CATEGORIES if (n in self.names) != (n == name)))

    def checked(self) -> Categories:
        if not self.names:
            raise ValueError("select at least one category")
        return self


def samples_of(frames: DataFrame, interval: float = 0.5) -> DataFrame:
    """``frames`` that samples at ``interval`` fall on, with i, the number of the (first) sample, and t, the time of the frame."""
    times = sightings.nearest_of(frames.select("video", "t"), sightings.grid(frames.select("video", "t"), interval), interval)
    first = times.groupBy("video", F.col("frame_t").alias("t")).agg(F.min("i").alias("i"))
    return frames.join(first, ["video", "t"])


def signatures(samples: DataFrame) -> DataFrame:
    """video, i, t and cells: luma on a small grid."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cells = [luma_signature(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)[..., 2::-1]).ravel().astype(np.int32) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"video": pdf["video"], "i": pdf["i"], "t": pdf["t"], "cells": cells})

    return samples.mapInPandas(work, "video long, i long, t double, cells array<int>")


def gated(samples: DataFrame, codes: Load | None, cut: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """What the gate says of each sample (video, i, t, changed), and the codes that stand in those it lets pass.

    A weak code asks for another look at the next sample, which only is known once its own has been read.  So codes are read in what the gate lets pass,
    the gate is asked again with what they say, and so on until all that it lets pass has been read; every sample is read once at most.
    """
    prints = cut(signatures(samples), "prints")
    gate = cut(folds.change_gate(prints), "gate")
    if codes is None:
        return gate, None
    read, known = gate.where("false").select("video", "i"), None
    while True:
        new = cut(gate.where("changed").select("video", "i").join(read, ["video", "i"], "left_anti"), "new")
        if not new.limit(1).count():
            return gate, known
        found = cut(R.recognise(samples.join(new, ["video", "i"], "left_semi"), codes, R.strong_codes_in, ("video", "i", "t"), R.CODE), "codes")
        known = found if known is None else known.unionByName(found)
        read = read.unionByName(new)
        gate = cut(folds.change_gate(folds.with_verdicts(prints, known)), "gate")


def scan(frames: DataFrame, readers: Readers, categories: Categories = Categories(), interval: float = 0.5, cut: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (as of ``folds.findings``) of ``frames`` (video, t, height, width, channels, data), and what the gate said of their samples.

    ``cut(df, name)`` keeps a table that is used more than once; by default it is written to the folder that executors share.  A reader that is wanted and can't be loaded, or fails, fails the scan.
    """
    names = categories.checked().names
    cut = cut or Kept(frames.sparkSession)
    samples = samples_of(frames, interval)
    visual, text = "visual" in names, [n for n in names if n != "visual"]
    gate, codes = gated(samples, readers.codes if visual else None, cut)
    passed = gate.where("changed").select("video", "i")
    analysed = samples.join(passed, ["video", "i"], "left_semi")
    hits: dict[str, DataFrame] = {}
    box = ["x", "y", "w", "h"]
    if text and readers.text:
        words = R.recognise(analysed, readers.text, R.words_in, ("video", "t"), R.WORD)
        found = assembly.hits_of_lines(assembly.lines_of_words(words, ["video", "t", "line_no"]), text)
        hits["ocr"] = found.select("video", "t", "key", "detector_id", "severity", "value", "confidence", *box, F.lit(False).alias("strong"))
    named = lambda rows, name, severity, value: rows.select("video", "t", "key", F.lit(name).alias("detector_id"), F.lit(severity).alias("severity"), value.alias("value"), "confidence", *box, "strong")
    if codes is not None:
        hits["qr"] = named(codes.join(passed, ["video", "i"], "left_semi"), "qr", "high", F.col("key"))
    if visual and readers.faces:
        hits["face"] = named(R.recognise(analysed, readers.faces, R.faces_in).withColumn("strong", F.lit(True)), "face", "medium", F.lit("face"))
    # Every sample has a row of its own: one that was skipped carries tracks on, one that showed nothing ends them.
    every = gate.select("video", "t", F.col("changed").alias("analysed"))
    out = None
    for source, rows in hits.items():
        rows = rows.withColumn("event_id", F.xxhash64("key", *box)).withColumn("analysed", F.lit(True)).unionByName(every, allowMissingColumns=True)
        found = folds.findings(rows, source, interval)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no reader serves the selected categories")
    return cut(out, "findings"), gate  # written once, so that no reader runs again with each use


def cover(frames: DataFrame, findings: DataFrame, cells: int = 6) -> DataFrame:
    """``frames`` with all findings whose ``redact`` holds covered, from the time they begin to the time they end."""
    shown = findings.where("redact").select("video", F.col("track_id").alias("k"), F.lit(0).alias("s"), F.col("first_t").alias("start_t"), F.col("last_t").alias("end_t"), F.posexplode("occurrences").alias("event_id", "o"))
    observed = shown.select("video", "k", "s", "event_id", "start_t", "end_t", "o.*")
    boxes = sightings.boxes_at_times(observed, frames.select("video", "t", "width", "height").dropDuplicates(["video", "t"]))
    padded = boxes.alias("f").selectExpr("video", "t", *sightings._split(G.dilated("f", "width", "height")))
    return covering.covered_frames(frames, padded, cells)

