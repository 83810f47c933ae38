"""Streams give what the batch folds give."""

import datetime
import random

import pytest

from veilflow.operators import folds
from veilflow.sources.adapters import signatures
from veilflow.streaming.processors import change_gate_stream, timed_tracks_stream

from .conftest import SMALL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(frame, folder):
    query = frame.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)


def test_gate_stream_equals_batch(spark, tmp_path):
    samples = signatures(spark.read.parquet(f"{SMALL}/embeddings.parquet")).selectExpr("cast(video AS BIGINT) AS video", "cast(i AS BIGINT) AS i", "cast(t AS DOUBLE) AS t", "cells")
    want = sorted(map(tuple, folds.change_gate(samples).collect()))
    # Two files, one per micro-batch: early samples, then late ones.
    first = samples.where("t < 3").coalesce(1)
    first.write.mode("overwrite").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream = lambda: change_gate_stream(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
    drain(stream(), tmp_path)
    samples.where("t >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    drain(stream(), tmp_path)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


@pytest.mark.parametrize("source", ["face", "qr"])
def test_timed_tracks_come_out_whole_though_late_and_unfollowed(spark, tmp_path, source):
    rng = random.Random(3)
    zero = datetime.datetime(2024, 1, 1)
    rows = []
    for video, start in ((1, 0.0), (2, 7.0)):
        for k in range(40):
            if 12 <= k % 20 <= 16:  # a gap that ends tracks
                continue
            for key in ("a", "b"):
                t = k * 0.5
                rows.append((video, len(rows), t, zero + datetime.timedelta(seconds=start + t), key, 10.0 * (key == "b") + k, 5.0 + 200 * (key == "b"), 40.0, 20.0, rng.choice([0.75, 0.8, 0.9]), rng.random() < 0.3))
    schema = "video long, event_id long, t double, at timestamp, key string, x double, y double, w double, h double, confidence double, strong boolean"
    want = []
    for video in (1, 2):
        pdf = spark.createDataFrame([r for r in rows if r[0] == video], schema).toPandas()
        samples = folds._samples(pdf, source)
        tracker = folds.Tracker(0.5)
        for t, hits in folds.corroborated(samples) if source == "qr" else samples:
            tracker.sample(t, hits)
        want += [(video, folds.track_id(video, t), t.key, t.first_t, t.last_t, t.confidence, len(t.occurrences)) for t in folds.findings_of(tracker.tracks, float("inf"), 0.5)]
    assert len(want) >= 8
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # Four deliveries, each late by up to some seconds; then rows of another video alone, whose times move the stream on.
    order = sorted(rows, key=lambda r: (r[3], rng.random()))
    late = [sorted(order, key=lambda r: r[3] + datetime.timedelta(seconds=rng.random() * 6))[n::1][:k] for n, k in ((0, 30), (30, 30), (60, 30), (90, None))]
    seen: set[int] = set()
    later = [(9, 10_000 + k, k * 60.0, zero + datetime.timedelta(seconds=60 + 60 * k), "z", 0.0, 0.0, 40.0, 20.0, 0.9, True) for k in range(3)]
    parts = []
    for part in late[:3]:
        parts.append([r for r in part if r[1] not in seen])
        seen |= {r[1] for r in parts[-1]}
    parts.append([r for r in rows if r[1] not in seen])
    for part in [*parts, *([r] for r in later)]:
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(timed_tracks_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), source, delay="30 seconds"), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("video < 9").collect())
    assert got == sorted(want)
