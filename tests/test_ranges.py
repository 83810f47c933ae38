"""Joins by bins, looks along time by slices, and folds by segments, against plain loops over all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.operators import folds, ranges
from veilflow.plans import sightings


def points(n, seed, videos=3, span=60.0):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.03 else rng.randrange(videos), None if rng.random() < 0.03 else round(rng.choice([rng.random() * span, rng.randrange(int(span)) * 1.0]), 3)) for i in range(n)]


@pytest.mark.parametrize("hot", [5, 20_000])
@pytest.mark.parametrize("reach", [0.4, 4.0])
def test_pairs_within(spark, hot, reach):
    left, right = points(250, 1), points(250, 2)
    frame = lambda rows: spark.createDataFrame(rows, "id long, video long, t double").repartition(3)
    close = lambda a, b: None not in (a[1], a[2], b[1], b[2]) and a[1] == b[1] and abs(a[2] - b[2]) <= reach
    want = sorted((a[0], b[0]) for a in left for b in right if close(a, b))
    got = ranges.pairs_within(frame(left), frame(right), ["video"], "t", reach, hot=hot).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted(map(tuple, got)) == want and want
    some = ranges.pairs_within(frame(left), frame(right), ["video"], "t", reach, "b.id % 9 = 0", "left_semi", hot=hot).select("a.id").collect()
    assert sorted(r[0] for r in some) == sorted({a[0] for a in left if any(close(a, b) and b[0] % 9 == 0 for b in right)})
    assert len(some) == len({r[0] for r in some})


@pytest.mark.parametrize("hot", [4, 20_000])
def test_intervals_that_meet_are_found_once(spark, hot):
    rng = random.Random(5)
    spans = lambda n: [(i, rng.randrange(2), t := rng.random() * 50, t + rng.choice([0.0, 0.5, 9.0, 40.0])) for i in range(n)]
    left, right = spans(120), [*spans(120), (999, 0, 7.0, 3.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, video long, lo double, hi double")
    want = sorted((a[0], b[0]) for a in left for b in right[:-1] if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    got = ranges.interval_join(frame(left), frame(right), ["video"], ("lo", "hi"), ("lo", "hi"), 5.0, hot=hot).select("a.id", F.col("b.id").alias("other")).collect()
    assert sorted(map(tuple, got)) == want
    with pytest.raises(ValueError):
        ranges.interval_join(frame(left), frame(right), ["video"], ("lo", "hi"), ("lo", "hi"), 5.0, how="left_semi")


@pytest.mark.parametrize("width", [0.7, 5.0, 1000.0])
def test_carried_values(spark, width):
    rows = [(i, v, t, t if i % 4 == 0 else None) for i, v, t in points(200, 7) if v is not None and t is not None]
    frame = spark.createDataFrame(rows, "id long, video long, t double, f double").repartition(4)
    for forward in (True, False):
        for inclusive in (True, False):
            got = {r["id"]: r["carried"] for r in ranges.carried(frame, ["video"], "t", "f", width, forward, inclusive).collect()}
            for i, v, t, _ in rows:
                seen = [f for _, w, u, f in rows if w == v and f is not None and ((u < t if forward else u > t) or (inclusive and u == t))]
                assert got[i] == ((max if forward else min)(seen) if seen else None)


def test_nearest_frames_over_many_slices(spark):
    frames = [(v, t) for _, v, t in points(60, 8) if v is not None and t is not None]
    times = [(i, v, t) for i, v, t in points(150, 9, videos=4) if v is not None and t is not None]
    got = sightings.nearest_of(spark.createDataFrame(frames, "video long, t double"), spark.createDataFrame(times, "i long, video long, t double"), 0.05, width=3.0)
    got = {r["i"]: (r["frame_t"], r["ok"]) for r in got.collect()}
    for i, v, t in times:
        near = min((f for w, f in frames if w == v), key=lambda f: (abs(f - t), f), default=None)
        assert (got[i][0] is None) == (near is None) and got[i][1] == (near is not None and abs(near - t) <= 0.05)
        assert near is None or abs(got[i][0] - t) == abs(near - t)


def sighted(seed, skips):
    rng = random.Random(seed)
    rows, n = [], 0
    for video in (1, 2):
        t = 0.0
        while t < 120:
            n += 1
            if rng.random() < 0.08:
                t += rng.choice([1.5, 2.0, 4.5, 9.0])  # nothing is known of this time
            kind = rng.random()
            if skips and kind < 0.4:
                rows.append((video, None, t, None, None, None, None, None, None, None, False))
            elif skips and kind < 0.55:
                rows.append((video, n, t, None, None, None, None, None, None, None, True))
            else:
                for key in rng.sample(["secretaa11", "secretaa11bb22cc", "face"], rng.randrange(1, 3)):
                    n += 1
                    rows.append((video, n, t, key, round(rng.uniform(0.4, 1.0), 2), rng.choice([0.0, 30.0, 400.0]), 10.0, 60.0, 30.0, rng.random() < 0.4, True))
            t += 0.5
    return rows


SCHEMA = "video long, event_id long, t double, key string, confidence double, x double, y double, w double, h double, strong boolean, analysed boolean"


@pytest.mark.parametrize("source", ["ocr", "face", "qr"])
@pytest.mark.parametrize("skips", [False, True])
@pytest.mark.parametrize("width", [6.0, 600.0])
def test_folds_by_segments_are_those_of_whole_videos(spark, source, skips, width):
    hits = spark.createDataFrame(sighted(3, skips), SCHEMA).repartition(3)
    want, want_found = [], []
    for video in (1, 2):
        samples = folds._samples(hits.where(F.col("video") == video).toPandas(), source)
        for out, finish in ((want, False), (want_found, True)):
            tracker = folds.Tracker(0.5)
            for t, found in folds.corroborated(samples) if source == "qr" else samples:
                tracker.sample(t, found)
            for t in folds.findings_of(tracker.tracks, samples[-1][0], 0.5) if finish else tracker.tracks:
                out.append((video, folds.track_id(video, t), t.key, t.first_t, t.last_t, t.confidence, len(t.occurrences)))
    assert sorted(map(tuple, folds.tracks(hits, source, slice_width=width).collect())) == sorted(want)
    found = folds.tracks(hits, source, finish=True, slice_width=width).collect()
    assert sorted(tuple(r)[:7] for r in found) == sorted(want_found)
    assert all(r["redact"] and r["key"] not in r["masked"] for r in found)
    cut = ranges.segments(hits, ["video"], "t", folds.reach_of(source), width, "analysed")
    assert cut.select("video", "segment").distinct().count() > 6 and cut.count() == hits.count()


@pytest.mark.parametrize("source", ["ocr", "face", "qr"])
def test_a_task_passes_over_segments_without_a_group_each(spark, source, monkeypatch):
    hits = spark.createDataFrame(sighted(4, True), SCHEMA).repartition(3)
    want = sorted(map(tuple, folds.findings(hits, source).collect()), key=repr)
    monkeypatch.setattr(folds, "BATCH", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a segment comes in several batches
    try:
        found, tracked = folds.findings(hits, source), folds.tracks(hits, source)
        assert sorted(map(tuple, found.collect()), key=repr) == want and want
        for rows in (found, tracked):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folds.tracks(hits.where("false"), source).count() == 0
    bare = hits.select("video", "event_id", "t", "key", F.lit(None).cast("double").alias("confidence"), "x", "y", "w", "h", F.lit(None).cast("boolean").alias("strong")).where("key is not null")
    assert folds.findings(bare, "ocr").count() > 0


def test_a_weak_code_makes_the_next_sample_analysed(spark):
    flat = [10] * 64
    rows = [(1, i, i * 0.5, flat, i in (3, 4, 20)) for i in range(24)]
    got = {r["i"]: r["changed"] for r in folds.change_gate(spark.createDataFrame(rows, "video long, i long, t double, cells array<int>, weak boolean")).collect()}
    assert [i for i in got if got[i]] == [0, 10, 20, 21]  # a weak code in a sample that is skipped is not seen
    codes = spark.createDataFrame([(1, 10, False), (1, 10, True), (1, 11, True)], "video long, i long, strong boolean")
    samples = spark.createDataFrame([r[:4] for r in rows], "video long, i long, t double, cells array<int>")
    gated = folds.change_gate(folds.with_verdicts(samples, codes))
    assert sorted(r["i"] for r in gated.where("changed").collect()) == [0, 10, 11, 21]
    stats = folds.scan_statistics(gated).first()
    assert (stats["sampled"], stats["analysed"], stats["skipped"], stats["skip_percent"]) == (24, 4, 20, 83)


def test_gate_compares_signatures_of_one_length():
    gate = folds.Gate()
    assert gate.changed(0.0, np.zeros(8))
    with pytest.raises(ValueError):
        gate.changed(0.5, np.zeros(9))


def test_greedy_merges_follow_the_box_that_grows(spark):
    boxes = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 2, 5.0, 0.0, 10.0, 10.0, 0.9), (1, 3, 9.0, 0.0, 10.0, 10.0, 0.7), (1, 4, 100.0, 0.0, 5.0, 5.0, 0.6), (2, 5, 0.0, 0.0, 10.0, 10.0, 0.6)]
    frame = spark.createDataFrame(boxes, "image long, id long, x double, y double, w double, h double, conf double")
    got = {(r["image"], r["place"]): (r["x"], r["w"], r["conf"], r["n"]) for r in sightings.merged_boxes(frame, ["image"], "id").collect()}
    assert got == {(1, 1): (0.0, 19.0, 0.9, 3), (1, 2): (100.0, 5.0, 0.6, 1), (2, 1): (0.0, 10.0, 0.6, 1)}
    chain = spark.createDataFrame([(1, "p", i, 8.0 * i, 0.0, 10.0, 10.0) for i in range(3)] + [(1, "q", 9, 0.0, 0.0, 10.0, 10.0)], "image long, k string, id long, x double, y double, w double, h double")
    assert sorted(r["id"] for r in sightings.deduplicated_codes(chain, ["image", "k"], "id").collect()) == [0, 2, 9]  # the third overlaps only one that went


def test_sessions_are_dealt_out_by_the_size_of_what_is_read(spark, monkeypatch):
    hits = sightings.seen(spark, "/root/testdata/sf0.001")
    want = sorted((r["event_id"], r["s"]) for r in sightings.sessions(hits).collect())
    monkeypatch.setattr(ranges, "DEALT", 1_000)
    rows = sightings.sessions(hits)
    assert sorted((r["event_id"], r["s"]) for r in rows.collect()) == want
    assert rows.rdd.getNumPartitions() >= 20  # 26 KB of events; before, as many as the session sets
    assert ranges.dealt(spark.createDataFrame([(1, 2)], "video long, k long"), ["video"]).rdd.getNumPartitions() == 4


def test_rows_are_numbered_over_all_ranges(spark):
    rows = [(i % 3, 10**15 if i == 7 else i // 2, i) for i in range(400)]  # one id far from all others, and ties
    frame = spark.createDataFrame(rows, "rank int, id long, n long").repartition(5)
    got = {r["place"]: (r["rank"], r["id"], r["n"]) for r in ranges.numbered(frame, ["rank", "id", "n"], "place").collect()}
    assert [got[k + 1] for k in range(len(rows))] == sorted(rows)
    assert ranges.numbered(frame.where("false"), ["rank"], "place").count() == 0
