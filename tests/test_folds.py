"""Hand-worked cases of the order-dependent operators, and of boxes and images."""

import numpy as np
import pytest

from veilflow.operators import folds as O
from veilflow.operators import images as I

BOX = (100.0, 100.0, 80.0, 20.0)


def hit(key="secret99", box=BOX, confidence=0.9, source="ocr", strong=False):
    return {"key": key, "value": key, "source": source, "confidence": confidence, "box": box, "strong": strong}


def run(samples, duration=10.0):
    tracker = O.Tracker(0.5)
    for t, hits in samples:
        tracker.sample(t, hits)
    return [(f.first_t, f.last_t, len(f.occurrences)) for f in O.findings_of(tracker.tracks, duration, 0.5)]


def test_samples_that_were_not_analysed_carry_a_track():
    assert run([(0.0, [hit()]), (0.5, []), *((t / 2, None) for t in range(2, 11)), (5.5, [hit()])]) == [(0, 6.0, 1)]


def test_duplicates_merge_within_one_and_a_half_seconds():
    assert run([(0.0, [hit()]), (0.5, []), (1.0, []), (1.5, [hit()])]) == [(0, 2.0, 2)]
    assert run([(0.0, [hit()]), (0.5, []), (1.0, []), (1.5, []), (2.0, [hit()])]) == [(0, 0.5, 1), (1.5, 2.5, 1)]
    assert len(run([(0.0, [hit("abc")]), (0.5, []), (1.0, []), (1.5, [hit("abc")])])) == 2


def test_one_hit_for_a_track_at_a_time_and_drift_from_the_recorded_box():
    assert len(run([(0.0, [hit("abc"), hit("abc", (190.0, 100.0, 80.0, 20.0))])])) == 2
    moved = [(t, [hit(box=(x, 100.0, 80.0, 20.0))]) for t, x in ((0.0, 100.0), (0.5, 102.0), (1.0, 103.0))]
    assert run(moved)[0][2] == 2


@pytest.mark.parametrize(("other", "kept"), [(5.0, 2), (5.5, 0)])
def test_weak_codes_need_a_second_sighting(other, kept):
    samples = [(1.0, [hit(source="qr")]), (other, [hit(source="qr")])]
    assert sum(len(h) for _, h in O.corroborated(samples)) == kept


def test_strong_codes_stand_alone_and_confirm_weak_ones():
    assert len(O.corroborated([(1.0, [hit(source="qr", strong=True)])])[0][1]) == 1
    assert sum(len(h) for _, h in O.corroborated([(1.0, [hit(source="qr")]), (3.0, [hit(source="qr", strong=True)])])) == 2


def test_gate_reads_again_after_five_seconds_and_on_change():
    gate, flat = O.Gate(), [10] * 64
    assert [gate.changed(t, flat) for t in (0.0, 0.5, 4.5, 5.0)] == [True, False, False, True]
    assert gate.changed(5.5, [40] * 8 + [10] * 56)
    gate.recheck = True
    assert gate.changed(6.0, [40] * 8 + [10] * 56)


def test_faces_stitch_only_after_a_gap_and_near():
    face = lambda a, b, c=0.9, x=100.0: O.Track("face", "face", "face", "medium", "face", c, a, b, (x, 100.0, 80.0, 80.0), [(a, (x, 100.0, 80.0, 80.0))])
    assert len(O.stitch_faces([face(9, 11), face(11.5, 12)])) == 1
    assert len(O.stitch_faces([face(9, 11), face(11, 12)])) == 2
    assert len(O.stitch_faces([face(9, 11), face(11.5, 12, x=520.0)])) == 2
    assert len(O.stitch_faces([face(9, 11, 0.66)])) == 0


def test_mosaic_holds_few_cells_and_ladder_sides():
    assert [I.mosaic_grid(*x) for x in ((300, 30), (60, 24), (120, 120), (20, 10))] == [(6, 1), (6, 2), (6, 6), (3, 2)]
    assert [I.mosaic_grid(480, 480, c) for c in (3, 15, 1, 999)] == [(3, 3), (15, 15), (3, 3), (15, 15)]
    image = np.random.default_rng(1).integers(0, 255, (100, 120, 3)).astype(np.uint8)
    out = I.mosaic(image, (10, 10, 60, 60))
    assert len(np.unique(out[10:70, 10:70].reshape(-1, 3), axis=0)) <= 36 and (out[:10] == image[:10]).all()
    assert I.tile_ladder(1280, 720) == [372] and I.tile_ladder(3840, 2160) == [372, 931] and I.tile_ladder(1280, 720, 400) == []
    assert I.tile_ladder(1620, 1080) == [372] and I.tile_ladder(1920, 1080) == [372] and I.tile_ladder(4000, 700) == [372, 700]
    with pytest.raises(ValueError):
        I.tile_ladder(10, 10, float("nan"))


def test_layout_measures_find_rows_and_skew():
    page = np.full((240, 480), 255.0)
    for y in range(10, 230, 20):
        page[y : y + 8, 40:440:4] = 0
    density, mask = I.text_density(page)
    assert density > 0.02 and mask.any()
    assert abs(I.shear_angle(page)) < 1.0
    assert I.line_pitch(np.abs(np.diff(page, axis=1)).sum(axis=1)) in (19.0, 20.0, 21.0)
