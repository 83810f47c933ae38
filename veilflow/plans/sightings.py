"""Sightings in time as Spark joins: pairs by bins, boxes of findings at the times of frames, frames next to times, greedy merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilflow.functions.dialect import SPARK
from veilflow.operators import geometry as G
from veilflow.operators import ranges
from veilflow.sources import adapters

#: Seconds: bins of time for intervals, slices for looks along time.
BIN, SLICE = 8.0, 600.0
CLOSE = "sqrt((a.x + a.w / 2 - b.x - b.w / 2) * (a.x + a.w / 2 - b.x - b.w / 2) + (a.y + a.h / 2 - b.y - b.h / 2) * (a.y + a.h / 2 - b.y - b.h / 2))"
KEY = ["video", "k", "s"]


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.sightings(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumnsRenamed({"key": "k", "confidence": "conf"})


def corroborated(hits: DataFrame) -> DataFrame:
    """Strong codes, and weak ones of which another sighting stands near at another time within four seconds; weak ones confirm each other."""
    near = f"b.t <> a.t AND {CLOSE} <= 3 * greatest(a.w, a.h) + 40"
    weak = ranges.pairs_within(hits.where("NOT strong"), hits, ["video", "k"], "t", 4.0, near, "left_semi")
    return hits.where("strong").unionByName(weak.select(*hits.columns))


def qr_corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corroborated(seen(spark, sf_dir)).select("event_id", "video", "k", "t")


def _pairs(hits: DataFrame, on: list[str], reach: float, condition: str = "true") -> DataFrame:
    return ranges.pairs_within(hits, hits, on, "t", reach, f"a.event_id < b.event_id AND {condition}")


def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of one key that a track could join: within its gap, and whether they are in reach."""
    pairs = _pairs(seen(spark, sf_dir), ["video", "k"], 1.25)
    return pairs.selectExpr("a.event_id AS a_id", "b.event_id AS b_id", f"{CLOSE} <= 3 * greatest(a.w, a.h, b.w, b.h) + 40 AS near", f"{CLOSE} AS dist")


def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(seen(spark, sf_dir), ["video"], 1.5, f"{G.overlap('a', 'b')} > 0.3 AND {SPARK.same_secret('a.k', 'b.k')}").selectExpr("a.event_id AS a_id", "b.event_id AS b_id")


def box_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(seen(spark, sf_dir), ["video"], 1.25)
    return pairs.selectExpr("a.event_id AS a_id", "b.event_id AS b_id", f"round({CLOSE}, 6) AS dist", f"round({G.overlap('a', 'b')}, 6) AS ratio", f"round({G.iou('a', 'b')}, 6) AS iou", f"{G.moved('a', 'b')} AS moved")


def face_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = G.face_match("a.x", "a.y", "a.w", "a.h", "b.x", "b.y", "b.w", "b.h").replace("0.75", "0.75D").replace("1.1 ", "1.1D ")
    return _pairs(seen(spark, sf_dir), ["video"], 1.25).selectExpr("a.event_id AS a_id", "b.event_id AS b_id", f"{match} AS result")


# ------------------------------------------------------------------ findings at the times of frames

def sessions(hits: DataFrame) -> DataFrame:
    """Sightings with ``s``, the number of their session: one ends once its key is out of sight for 1.25 s."""
    along = Window.partitionBy("video", "k").orderBy("t", "event_id")
    fresh = F.when(F.col("t") - F.lag("t").over(along) <= 1.25, 0).otherwise(1)
    return ranges.dealt(hits, ["video", "k"]).withColumn("fresh", fresh).withColumn("s", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def spells(observed: DataFrame, pad: float = 0.5) -> DataFrame:
    """For each finding and each two observations that follow each other: lo, hi and the boxes at both; before the first and behind the last, padded, one stands alone.

    ``observed``: video, k, s, event_id, t and a box, and where the finding's own bounds are known start_t and end_t.  A spell holds its lower end; the last
    one holds both.
    """
    box = F.struct("event_id", *(F.col(c) for c in "xywh"))
    own = "start_t" in observed.columns
    bounds = [F.min("start_t").alias("start_t"), F.max("end_t").alias("end_t")] if own else []
    times = observed.groupBy(*KEY, "t").agg(F.array_sort(F.collect_list(box)).alias("boxes"), *bounds)  # boxes of one instant
    if not own:
        times = times.withColumns({"start_t": F.greatest(F.lit(0.0), F.col("t") - pad), "end_t": F.col("t") + pad})
    along = Window.partitionBy(*KEY).orderBy("t")
    rows = times.select("*", F.lead("t").over(along).alias("next_t"), F.lead("boxes").over(along).alias("next_boxes"), F.lag("t").over(along).isNull().alias("first"))
    # Between two observations, and from the last one on.
    after = rows.select(*KEY, F.col("t").alias("lo"), F.coalesce("next_t", "end_t").alias("hi"), "boxes", F.coalesce("next_boxes", "boxes").alias("more"), F.col("next_t").isNull().alias("closed"))
    before = rows.where("first").select(*KEY, F.col("start_t").alias("lo"), F.col("t").alias("hi"), "boxes", F.col("boxes").alias("more"), F.lit(False).alias("closed"))
    return after.unionByName(before)


_FAR = "sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))"
_COVERS = "{0}.x <= {1}.x AND {0}.y <= {1}.y AND {0}.x + {0}.w >= {1}.x + {1}.w AND {0}.y + {0}.h >= {1}.y + {1}.h"
_UNION = "named_struct('event_id', p.event_id, 'x', least(p.x, q.x), 'y', least(p.y, q.y), 'w', greatest(p.x + p.w, q.x + q.w) - least(p.x, q.x), 'h', greatest(p.y + p.h, q.y + q.h) - least(p.y, q.y))"
_NEAREST = f"array_min(transform(more, q -> named_struct('far', {_FAR}, 'event_id', q.event_id, 'x', q.x, 'y', q.y, 'w', q.w, 'h', q.h)))"
_PAIRED = f"transform(boxes, p -> transform(array({_NEAREST}), q -> CASE WHEN q.far > 4 * greatest(p.w, p.h) + 60 THEN p ELSE {_UNION} END)[0])"
_ALONE = f"filter(more, (q, i) -> NOT exists(paired, p -> {_COVERS.format('p', 'q')}) AND NOT exists(slice(more, 1, i), p -> {_COVERS.format('p', 'q')}))"


def boxes_at_times(observed: DataFrame, frames: DataFrame, pad: float = 0.5) -> DataFrame:
    """Boxes of each finding at the time ``t`` of each frame (video, t, and any other columns): those of the observations around it, each joined with the
    nearest of the later ones if that is in reach; later ones that nothing covers are added."""
    keep = [c for c in frames.columns if c not in ("video", "t")]
    met = ranges.interval_join(frames, spells(observed, pad), ["video"], ("t", "t"), ("lo", "hi"), BIN, "a.t < b.hi OR b.closed")
    rows = met.select("a.video", *(F.col(f"a.{c}") for c in keep), F.col("a.t").alias("t"), "b.k", "b.s", "b.lo", "b.boxes", "b.more")
    same = F.col("t") == F.col("lo")
    rows = rows.withColumn("still", same | (F.col("boxes") == F.col("more"))).withColumn("paired", F.expr(f"CASE WHEN still THEN boxes ELSE {_PAIRED} END"))
    rows = rows.withColumn("b", F.explode(F.expr(f"CASE WHEN still THEN paired ELSE concat(paired, {_ALONE}) END")))
    return rows.select("video", *keep, "t", "k", "s", "b.event_id", "b.x", "b.y", "b.w", "b.h")


def grid(hits: DataFrame, interval: float = 0.5) -> DataFrame:
    """Samples of each video that lasts: i and t, the last one just inside its end."""
    videos = hits.groupBy("video").agg(F.max("t").alias("dur")).where("dur > 0")
    rows = videos.select("video", "dur", F.explode(F.expr(f"sequence(0L, cast(greatest(1, floor(dur / {interval}D)) AS BIGINT))")).alias("i"))
    return rows.select("video", "i", F.least(F.col("dur") - 0.001, F.col("i") * interval).alias("t"))


def boxes_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = seen(spark, sf_dir)
    return boxes_at_times(sessions(hits), grid(hits)).drop("t")


def active_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("video")).agg((F.min("toxic") == 0).alias("redact"))
    rows = boxes_at(spark, sf_dir).join(kept, "video", "left").where("coalesce(redact, true)").alias("f")
    return rows.selectExpr("video", "i", "k", "s", "event_id", *_split(G.dilated("f", 640, 360)))


def _split(columns: str) -> list[str]:
    """Columns of a select list, with numbers with a point as doubles."""
    import re

    parts = re.split(r",\s*(?=round\()", re.sub(r"(?<![\w.])([0-9]+[.][0-9]+)(?![\w.])", r"\1D", columns))
    return parts


def active_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = seen(spark, sf_dir)
    spans = sessions(hits).groupBy(*KEY).agg(F.greatest(F.lit(0.0), F.min("t") - 0.5).alias("start_t"), (F.max("t") + 0.5).alias("end_t"))
    met = ranges.interval_join(grid(hits), spans, ["video"], ("t", "t"), ("start_t", "end_t"), BIN)
    return met.groupBy("a.video", "a.i").agg(F.count("*").alias("n"))


def nearest_of(frames: DataFrame, times: DataFrame, tolerance: float = 0.05, width: float = SLICE) -> DataFrame:
    """``times`` (video, t, and any other columns) with frame_t, the time of the nearest of ``frames`` (of two as near the earlier one), and whether it is near enough."""
    keep = [c for c in times.columns if c not in ("video", "t")]
    both = times.select("*", F.lit(None).cast("double").alias("f")).unionByName(frames.select("video", "t", F.col("t").alias("f")), allowMissingColumns=True).withColumn("asked", F.col("f").isNull())
    rows = ranges.carried(both, ["video"], "t", "f", width).withColumnRenamed("carried", "before_t")
    rows = ranges.carried(rows, ["video"], "t", "f", width, forward=False).withColumnRenamed("carried", "after_t").where("asked")
    frame = F.when(F.col("before_t").isNull() | (F.col("after_t") - F.col("t") < F.col("t") - F.col("before_t")), F.col("after_t")).otherwise(F.col("before_t"))
    return rows.select("video", *keep, "t", frame.alias("frame_t")).withColumn("ok", F.coalesce(F.abs(F.col("frame_t") - F.col("t")) <= tolerance, F.lit(False)))


def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = seen(spark, sf_dir)
    return nearest_of(hits, grid(hits)).withColumn("t", F.round("t", 6))


# ------------------------------------------------------------------ greedy folds over the boxes of one image

_BOX = "named_struct('x', {0}.x, 'y', {0}.y, 'w', {0}.w, 'h', {0}.h, 'conf', {0}.conf, 'n', {1})"
_GROWN = "named_struct('x', least(k.x, b.x), 'y', least(k.y, b.y), 'w', greatest(k.x + k.w, b.x + b.w) - least(k.x, b.x), 'h', greatest(k.y + k.h, b.y + b.h) - least(k.y, b.y), 'conf', greatest(k.conf, b.conf), 'n', k.n + 1)"


def merged_boxes(boxes: DataFrame, on: list[str], order: str, least: float = 0.3) -> DataFrame:
    """Boxes of one image (columns ``on``) that show one thing: in order, each joins the first box kept so far that it overlaps (IoU above ``least``), which grows
    over both; columns x, y, w, h, conf, n (how many) and place (from 1)."""
    rows = boxes.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "x", "y", "w", "h", "conf"))).alias("bs"))
    host = f"array_position(transform(kept, k -> {G.iou('k', 'b')} > {least}), true)"
    step = f"CASE WHEN {host} = 0 THEN concat(kept, array({_BOX.format('b', '1L')})) ELSE transform(kept, (k, i) -> CASE WHEN i + 1 = {host} THEN {_GROWN} ELSE k END) END"
    fold = f"aggregate(bs, cast(array() AS array<struct<x:double,y:double,w:double,h:double,conf:double,n:bigint>>), (kept, b) -> {step})"
    return rows.select(*on, F.posexplode(F.expr(fold)).alias("place", "b")).select(*on, (F.col("place") + 1).alias("place"), "b.*")


def deduplicated_codes(codes: DataFrame, on: list[str], order: str) -> DataFrame:
    """Codes of one image and payload (columns ``on``) that overlap no code kept before them, in order; all columns of ``codes``."""
    own = [c for c in codes.columns if c not in on]
    rows = codes.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o_"), *own))).alias("cs"))
    apart = f"NOT exists(kept, k -> {G._inter('k', 'c')} > 0)"
    fold = f"aggregate(slice(cs, 2, size(cs)), slice(cs, 1, 1), (kept, c) -> CASE WHEN {apart} THEN concat(kept, array(c)) ELSE kept END)"
    return rows.select(*on, F.explode(F.expr(fold)).alias("c")).select(*on, *(f"c.{x}" for x in own)).select(*codes.columns)


def merge_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged_boxes(seen(spark, sf_dir).withColumn("half", F.floor(F.col("t") * 2)), ["video", "half"], "event_id")
    return rows.select("video", "half", "place", "x", "y", "w", "h", "conf", "n")


def qr_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_codes(seen(spark, sf_dir).withColumn("half", F.floor(F.col("t") * 2)), ["video", "half", "k"], "event_id").select("event_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (qr_corroborate, reach, dup_pairs, box_math, face_match, boxes_at, active_boxes, active_at, nearest_frame, merge_faces, qr_dedupe)
}

_HITS_SQL = """h AS (
  SELECT event_id, user_id AS video, event_type AS k, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0, 6) AS t,
    (event_id % 7 * 40)::DOUBLE AS x, (event_id % 5 * 30)::DOUBLE AS y, (60 + event_id % 3 * 10)::DOUBLE AS w, (20 + event_id % 2 * 8)::DOUBLE AS h, round(0.45 + (event_id % 50) / 100.0, 2) AS conf FROM events
)"""
#: By recursion: one box after another of an image, and a list of what is kept so far.
MERGE_FACES_SQL = f"""
WITH RECURSIVE {_HITS_SQL}, o AS (
  SELECT video, floor(t * 2)::BIGINT AS half, x, y, w, h, conf, row_number() OVER (PARTITION BY video, floor(t * 2) ORDER BY event_id) AS r FROM h
), g AS (
  SELECT video, half, r, [struct_pack(x := x, y := y, w := w, h := h, conf := conf, n := 1::BIGINT)] AS kept FROM o WHERE r = 1
  UNION ALL
  SELECT video, half, r, CASE WHEN host IS NULL THEN list_append(kept, struct_pack(x := x, y := y, w := w, h := h, conf := conf, n := 1::BIGINT))
    ELSE list_transform(kept, lambda k, i: CASE WHEN i = host THEN struct_pack(x := least(k.x, x), y := least(k.y, y), w := greatest(k.x + k.w, x + w) - least(k.x, x), h := greatest(k.y + k.h, y + h) - least(k.y, y), conf := greatest(k.conf, conf), n := k.n + 1) ELSE k END) END
  FROM (
    SELECT o.*, g.kept, (SELECT min(i) FROM unnest(range(1, len(g.kept) + 1)) AS u(i), (SELECT g.kept[i] AS k) s,
      (SELECT greatest(0.0, least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * greatest(0.0, least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y)) AS both_) c
      WHERE both_ / (k.w * k.h + o.w * o.h - both_) > 0.3) AS host
    FROM g JOIN o ON o.video = g.video AND o.half = g.half AND o.r = g.r + 1
  ) q
)
SELECT video, half, place::INT AS place, kept[place].x AS x, kept[place].y AS y, kept[place].w AS w, kept[place].h AS h, kept[place].conf AS conf, kept[place].n AS n
FROM (SELECT video, half, arg_max(kept, r) AS kept FROM g GROUP BY video, half) z, unnest(range(1, len(kept) + 1)) AS u(place)
"""
QR_DEDUPE_SQL = f"""
WITH RECURSIVE {_HITS_SQL}, o AS (
  SELECT *, floor(t * 2)::BIGINT AS half, row_number() OVER (PARTITION BY video, k, floor(t * 2) ORDER BY event_id) AS r FROM h
), g AS (
  SELECT video, half, k, r, [event_id] AS ids FROM o WHERE r = 1
  UNION ALL
  SELECT o.video, o.half, o.k, o.r, CASE WHEN EXISTS (SELECT 1 FROM o p WHERE p.video = o.video AND p.half = o.half AND p.k = o.k AND list_contains(g.ids, p.event_id)
    AND greatest(0.0, least(p.x + p.w, o.x + o.w) - greatest(p.x, o.x)) * greatest(0.0, least(p.y + p.h, o.y + o.h) - greatest(p.y, o.y)) > 0) THEN g.ids ELSE list_append(g.ids, o.event_id) END
  FROM g JOIN o ON o.video = g.video AND o.half = g.half AND o.k = g.k AND o.r = g.r + 1
)
SELECT unnest(ids) AS event_id FROM (SELECT arg_max(ids, r) AS ids FROM g GROUP BY video, half, k) z
"""
ORACLES = {"merge_faces": MERGE_FACES_SQL, "qr_dedupe": QR_DEDUPE_SQL}
