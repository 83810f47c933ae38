"""Clips through the data source, in batch and as a stream; writing whole or not at all; counts of a stream against the batch."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.operators import folds
from veilflow.sources import adapters, frame_source
from veilflow.streaming import processors, progress

from .conftest import SMALL
from .test_streaming import ROCKS, drain


def clip(spark, video, n, width=16, height=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(video, k, k / 2, height, width, 3, rng.integers(0, 255, height * width * 3).astype(np.uint8).tobytes()) for k in range(n)]
    return spark.createDataFrame(rows, frame_source.SCHEMA)


def test_clips_are_written_and_read_in_pieces(spark, tmp_path):
    frame_source.register(spark)
    out = str(tmp_path / "clips")
    clips = clip(spark, "a", 23, seed=1).unionByName(clip(spark, "b", 5, 8, 8, seed=2))
    clips.repartition(4).write.format("frames").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "clips").iterdir()) == ["a.ppm", "b.ppm"]
    back = spark.read.format("frames").option("fps", "2").option("framesPerTask", "5").load(out)
    assert back.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clips.collect()))
    with pytest.raises(Exception, match="already"):
        clips.write.format("frames").mode("append").save(out)
    clip(spark, "a", 2, seed=3).write.format("frames").mode("overwrite").save(out)
    assert spark.read.format("frames").load(out).where("video = 'a'").count() == 2


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    frame_source.register(spark)
    out = tmp_path / "bad"
    broken = clip(spark, "a", 9).withColumn("channels", F.when(F.col("n") == 7, 4).otherwise(3)).repartition(3, "n")
    with pytest.raises(Exception):
        broken.write.format("frames").mode("append").save(str(out))
    assert not out.exists() or not list(out.iterdir())
    with pytest.raises(Exception, match="no frame"):
        clip(spark, "a", 3).where("n > 9").write.format("frames").mode("append").save(str(out))
    with pytest.raises(Exception, match="twice"):
        clip(spark, "a", 3).unionByName(clip(spark, "a", 1)).write.format("frames").mode("append").save(str(out))
    assert not out.exists() or not list(out.iterdir())
    out.mkdir(exist_ok=True)
    (out / "cut.ppm").write_bytes(b"P6 4 4 255\n" + bytes(50))
    with pytest.raises(Exception, match="within a frame"):
        spark.read.format("frames").load(str(out)).count()


def test_a_stream_takes_each_clip_once(spark, tmp_path):
    frame_source.register(spark)
    folder = tmp_path / "clips"
    for name, n in (("c1", 4), ("c2", 7), ("c3", 3)):
        clip(spark, name, n).write.format("frames").mode("append").save(str(folder))
        query = spark.readStream.format("frames").load(str(folder)).drop("data").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {r["video"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("video").agg(F.count("*").alias("n")).collect()}
    assert got == {"c1": 4, "c2": 7, "c3": 3}


def waited(listener, name, n):
    for _ in range(100):
        if listener.totals[name] >= n:
            break
        time.sleep(0.1)
    return listener.totals


def test_counts_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    samples = adapters.signatures(spark.read.parquet(f"{SMALL}/embeddings.parquet")).selectExpr("cast(video AS BIGINT) AS video", "cast(i AS BIGINT) AS i", "cast(t AS DOUBLE) AS t", "cells", "vec_id % 11 = 0 AS weak")
    want = folds.scan_statistics(folds.change_gate(samples)).agg(F.sum("sampled"), F.sum("analysed"), F.sum("skipped")).first()
    published = []
    listener = progress.listen(spark, published.append)
    try:
        for part in ("t < 4", "t >= 4"):
            samples.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            gate = processors.change_gate_stream(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
            drain(progress.counted_samples(gate), tmp_path)
        totals = waited(listener, "sampled", want[0])
        assert tuple(totals[k] for k in progress.COUNTS) == tuple(want) and published[-1]["sampled"] == want[0]
        assert listener.skip_percent == int(100 * want[2] / want[0] + 0.5)
    finally:
        spark.streams.removeListener(listener)


def test_distinct_findings_of_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    zero = datetime.datetime(2024, 1, 1)
    rows = [(k % 2, f"key{k % 5}", zero + datetime.timedelta(seconds=k / 10)) for k in range(60)]
    schema = "video long, key string, at timestamp"
    listener = progress.listen(spark)
    try:
        for part in (rows[:25], rows[25:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            drain(progress.distinct_findings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delay="60 seconds"), tmp_path)
        n = len({r[:2] for r in rows})
        assert spark.read.parquet(str(tmp_path / "out")).count() == n and waited(listener, "keys", n)["keys"] == n
    finally:
        spark.streams.removeListener(listener)
