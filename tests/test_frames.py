"""Plug-ins, covered frames, the sink that writes all or nothing, and the functions that SQL can call."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilflow.detect.scan import scan_line
from veilflow.detect.rules import DetectorRegistry
from veilflow.functions import surface
from veilflow.operators.images import mosaic, tile_places
from veilflow.plans import frames as plans
from veilflow.sources import recognisers as R

SCHEMA = "video long, t double, height int, width int, channels int, data binary"


def image(h=96, w=128, value=200):
    out = np.full((h, w, 3), value, np.uint8)
    out[..., 0] = np.arange(w) % 251
    return out


def table(spark, rows):
    return spark.createDataFrame([(v, t, *x.shape, x.tobytes()) for v, t, x in rows], SCHEMA)


def test_text_is_read_inverted_from_dark_images():
    read = lambda x, mode: [(mode, int(x.mean()), (1, 2, 3, 4))]
    assert R.text_in(read, np.full((4, 4, 3), 20, np.uint8), "sparse") == [("sparse", 235.0, 1.0, 2.0, 3.0, 4.0)]
    assert R.text_in(read, np.full((4, 4, 3), 110, np.uint8))[0][1] == 110
    with pytest.raises(ValueError):
        R.text_in(read, image(), "page")


def test_faces_join_and_are_padded_within_the_image():
    detect = lambda x: [(0.5, (0, 0, 40, 50)), (0.9, (4, 0, 40, 50)), (0.44, (60, 60, 20, 20)), (0.6, (100, 70, 28, 26)), (0.7, (9, 9, 0, 5))]
    got = R.faces_in(detect, image())
    assert [round(v, 2) for v in got[0][1:]] == [0.9, 0, 0, 44 + 2 * 44 * 0.18, 50 + 2 * 50 * 0.24]
    assert got[1][1] == 0.6 and got[1][2] + got[1][4] == 128 and got[1][3] + got[1][5] == 96 and len(got) == 2


def codes(x):
    """A toy decoder: the first spot of 255 in the last channel is a code of 30 pixels named by the channel before."""
    at = np.argwhere(x[..., 2] == 255)
    if not len(at):
        return None
    y, left = at[0].tolist()
    return f" c{x[y, left, 1]} ", 1, [(left, y), (left + 30, y), (left + 30, y + 30), (left, y + 30)]


def test_codes_are_found_one_behind_the_other():
    x = image(100, 300)
    for k, (left, y) in enumerate([(10, 10), (60, 10), (120, 10), (180, 10), (250, 10)]):
        x[y, left] = (0, k, 255)
    got = R.codes_in(codes, x, tiles=False)
    assert [g[0] for g in got] == ["c0", "c1", "c2", "c3"]  # four in one image
    assert sorted(g[0] for g in R.codes_in(codes, x)) == ["c0", "c1", "c2", "c3", "c4"]  # tiles find the fifth, and none twice
    assert R.codes_in(codes, x, accept=lambda data, version, corners: "3" in data, tiles=False)[0][0] == "c3"
    assert {s for _, _, s in tile_places(128, 128, 64)} == {64}


def test_recognisers_fail_closed(spark):
    x = image()
    x[30, 30] = (0, 7, 255)
    df = table(spark, [(1, 0.0, x), (1, 0.5, image())])
    rows = R.recognise(df, lambda: codes, R.codes_in).collect()
    assert [(r["video"], r["t"], r["key"]) for r in rows] == [(1, 0.0, "c7")]
    with pytest.raises(Exception, match="could not be loaded"):
        R.recognise(df, lambda: None, R.codes_in).collect()


def test_frames_are_covered_and_written_whole(spark, tmp_path):
    a, b = image(value=10), image(value=90)
    df = table(spark, [(1, 0.0, a), (1, 0.0, a), (1, 0.5, b)])
    boxes = spark.createDataFrame([(1, 0.0, 10.2, 20.0, 30.0, 12.0), (1, 0.0, 90.0, 0.0, 1.0, 1.0)], "video long, t double, x double, y double, w double, h double")
    got = {r["t"]: np.frombuffer(bytes(r["data"]), np.uint8).reshape(a.shape) for r in plans.covered_frames(df, boxes).collect()}
    assert len(got) == 2 and (got[0.5] == b).all() and (got[0.0] == mosaic(a, (10, 20, 30, 12))).all() and (got[0.0] != a).any()
    out = str(tmp_path / "out")
    assert plans.write_whole(plans.covered_frames(df, boxes), out) == 2 and spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError):
        plans.write_whole(df.where("t > 9"), str(tmp_path / "none"))
    with pytest.raises(Exception):
        plans.write_whole(df.selectExpr("*", "raise_error('broken') AS e"), str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["out"]
    assert [r[0] for r in spark.range(70).where(plans.key_frame(F.col("id"), 30)).collect()] == [0, 60]


def test_metadata(spark):
    declared = spark.createDataFrame([(1, True, 9.0, False), (2, True, float("inf"), None), (3, True, None, True), (4, False, 5.0, True)], "video long, has_video boolean, duration double, has_audio boolean")
    seen = spark.createDataFrame([(2, 1.5), (2, 3.5)], "video long, t double")
    got = {r[0]: tuple(r)[1:] for r in plans.video_metadata(declared, seen).collect()}
    assert got == {1: (9.0, False, None), 2: (3.5, True, None), 3: (None, True, "no duration"), 4: (5.0, True, "no video track")}


def test_functions_in_sql(spark):
    names = surface.register(spark)
    assert "scan_text" in names and len(names) == 14
    line = "mail me at jane.roe@corp.io or call 192.168.4.7"
    want = [(r.id, s, e) for r, _, s, e in scan_line(line, [(r, r.compiled()) for r in DetectorRegistry().select()])]
    spark.createDataFrame([(1, line), (2, None)], "id int, line string").createOrReplaceTempView("surface_lines")
    got = spark.sql("SELECT f.detector_id, f.start, f.end FROM surface_lines, LATERAL scan_text(line, cast(NULL AS ARRAY<STRING>)) f").collect()
    assert want and [tuple(r) for r in got] == want
    assert spark.sql("SELECT f.* FROM surface_lines, LATERAL scan_text(line, array('financial')) f").count() == 0
    row = spark.sql("SELECT luhn('4111111111111111') a, round(shannon_entropy('aabb'), 6) b, mask_value('private-ipv4', '10.0.0.1') c, same_secret('abcd-ef12', 'xABCDEF12y') d, is_private_ipv4('10.1.2.3') e, mask_value('jwt', 'x') f").first()
    registry = DetectorRegistry()
    assert (row.a, row.b, row.c, row.d, row.e) == (True, 1.0, "10.0.0.1", True, True) and row.f == registry.mask("jwt", "x")
