"""Queries against the independent engine, on the small tables."""

import math
import os
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from veilflow import catalog
from veilflow.detect import native, scan
from veilflow.sources.adapters import TABLES

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


#: One of each kind; the driver runs them all.
NAMES = ["det_credit_card", "det_labeled_secret", "det_jwt", "det_openai_key", "looks_random", "mask_url", "same_secret", "despace", "variants", "fold_confusables", "dedupe", "resolve_overlaps", "findings", "findings_in_pages", "extend", "hits", "match_boxes", "by_category", "sessions", "boxes_at", "qr_corroborate", "tile_rects", "judge_qr", "change_gate"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SMALL)
    names = sorted(ours.columns)
    left = sorted((plain(tuple(r)) for r in ours.select(*names).collect()), key=repr)
    right = sorted((plain(r) for r in duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLES[name]})").fetchall()), key=repr)
    assert left == right and left


def test_findings_of_every_rule_arrive(spark):
    assert {r["detector_id"] for r in catalog.QUERIES["detector_dim"](spark, SMALL).collect()} == {r.id for r in catalog.RULES}


def test_sightings_pair_by_time_and_no_sample_is_lost(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [(1, day(0), 7, "a"), (1000, day(0), 7, "b"), (2, day(40), 7, "a")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    for name in ("box_math", "face_match"):
        assert [(r["a_id"], r["b_id"]) for r in run(name)] == [(1, 1000)]
    assert sorted((r["start_t"], r["end_t"]) for r in run("findings_time")) == [(0.0, 0.5), (0.0, 0.5), (39.5, 40.0)]
    frames = {r["i"]: (r["frame_t"], r["ok"]) for r in run("nearest_frame")}
    assert len(frames) == len(run("sample_grid")) and frames[0] == (0.0, True) and frames[30] == (0.0, False) and frames[50] == (40.0, False)


def test_despace_takes_the_inline_lines_too(spark, duck):
    inline = {(doc, n): line for doc, n, line in catalog.FIXTURE_LINES}
    ours = {(r["doc_id"], r["line_no"]): r["result"] for r in catalog.QUERIES["despace"](spark, SMALL).where("doc_id < 0").collect()}
    theirs = {(doc, n): text for doc, n, text in duck.execute(f"SELECT doc_id, line_no, result FROM ({catalog.ORACLES['despace']}) q WHERE doc_id < 0").fetchall()}
    assert ours == theirs and ours.keys() == inline.keys()
    assert all(scan.despace(line) == (None if ours[at] == line else (ours[at], scan.despace(line)[1])) for at, line in inline.items())
    n = sum(len([s for s in r["text"].split("\n") if s.strip(" ")]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").collect())
    assert catalog.QUERIES["despace"](spark, SMALL).count() == n + len(inline)


def test_words_of_long_lines(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").collect()
    lines = [(r["doc_id"], n, s) for r in docs for n, s in enumerate(r["text"].split("\n"), 1) if s.strip(" ")] + list(catalog.FIXTURE_LINES)
    assert any(len(s) >= 400 for _, _, s in lines)
    want, built = set(), {}
    for doc, n, s in lines:
        at = 0
        for i, w in enumerate(s.split(" "), 1):
            if w:
                want.add((doc, n, i, w, 8.0 * at))
            at += len(w) + 1
        kept = [w for w in s.split(" ") if w]
        built[doc, n] = (" ".join(kept), [sum(map(len, kept[:i])) + i for i in range(len(kept))])
    got = [tuple(r) for r in catalog.QUERIES["ocr_words"](spark, SMALL).select("doc_id", "line_no", "idx", "text", "x").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(r["doc_id"], r["line_no"]): (r["line"], r["word_starts"]) for r in catalog.QUERIES["build_line"](spark, SMALL).collect()} == built


def test_covered_lines_have_no_findings_left(spark):
    rows = catalog.QUERIES["redacted_rescan"](spark, SMALL).collect()
    assert rows and all(r["n_before"] > 0 and r["n_after"] == 0 for r in rows)


@pytest.mark.parametrize(("name", "exchanges"), [("hits", 1), ("resolve_overlaps", 2), ("redacted_rescan", 2)])
def test_scans_read_and_scan_lines_once(spark, name, exchanges):
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") <= exchanges and "collect_list" not in plan and "Join" not in plan


def test_a_rescan_counts_what_covering_leaves(spark):
    lines = spark.createDataFrame([(1, 1, "mail jane.doe@mail.org now"), (1, 2, "nothing here"), (2, 1, "8.8.4.4 and jane.doe@mail.org"), (2, 2, " ")], "doc_id long, line_no int, line string")
    left = native.covered(lines)
    assert {(r["doc_id"], r["line_no"]): (r["line"], len(r["rules_"])) for r in left.collect()} == {(1, 1): ("mail ;;;;;;;;;;;;;;;;; now", 1), (2, 1): ("0 and 1".replace("0", ";" * 7).replace("1", ";" * 17), 2)}
    again, _ = native.scanned(left.withColumn("line", F.expr("CASE WHEN doc_id = 1 THEN 'left jane.doe@mail.org' ELSE line END")), every=True)
    assert sorted((r["doc_id"], len(r["rules_"]), len(r["hits_"])) for r in again.collect()) == [(1, 1, 1), (2, 2, 0)]  # a line that holds nothing any more still counts


def test_no_query_shows_the_values_of_findings(spark):
    assert "value" not in catalog.QUERIES["findings"](spark, SMALL).columns


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["severity_tally"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(text)" in plan and "n_chars" not in plan


def test_codes_are_judged_by_hand(spark):
    got = {r["note"]: (r["reject"], r["strength"]) for r in catalog.QUERIES["judge_qr"](spark, SMALL).collect()}
    assert got["good"] == (None, "strong") and got["short"] == (None, "weak") and got["empty"] == ("empty payload", None)
    assert got["thin"] == ("not square", None) and got["small"] == ("too small", None) and got["dense"] == ("too few pixels for its module count", None)
    assert got["unnumbered"] == (None, "strong")  # letters of any script are text, and a code without a version has 21 modules
    assert got["folded"] == ("too small", None) and got["tilted"][0] == "corners are not a quadrilateral"  # 54.5 degrees, not 55


def test_formats(spark):
    from veilflow.functions.dialect import SPARK
    from veilflow.operators import geometry as G

    q = f"SELECT {G.fmt_time(SPARK, 't')} a, {G.fmt_timecode(SPARK, 't')} b, {G.fmt_range(SPARK, 't', 't + 1')} c, {G.fmt_bytes(SPARK, 'n')} d FROM VALUES (64.36D, 1023L), (-1D, 1600L), (59.97D, 1572864L) v(t, n)"
    assert [tuple(r) for r in spark.sql(q).collect()] == [("1:04", "1:04.4", "1:04.4–1:05.4", "1023 B"), ("0:00", "0:00.0", "0:00.0", "2 KB"), ("0:59", "0:60.0", "0:60.0–1:01.0", "1.5 MB")]
