"""Text layout and rebuilt views, on pages drawn here at a known angle."""

import math

import numpy as np
import pytest

from veilflow.operators import layout as L
from veilflow.sources import recognisers as R


def page(angle=0.0, pitch=20, dark=False, height=400, width=480):
    """Rows of strokes that descend to the right by ``angle`` degrees, in the middle of an even page."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    turn = math.radians(angle)
    down, across = (y - height / 2) * math.cos(turn) - (x - width / 2) * math.sin(turn), (x - width / 2) * math.cos(turn) + (y - height / 2) * math.sin(turn)
    tall = 1.5 + np.mod(np.floor(across / 6), 4) * 1.5  # strokes of different heights about the middle of their row
    ink = (np.abs(np.mod(down, pitch) - pitch / 2) < tall) & (np.mod(across, 6) < 3) & (np.abs(down) < 120) & (np.abs(across) < 160)
    image = np.where(ink, 20, 230).astype(np.uint8)
    return np.repeat((255 - image if dark else image)[..., None], 3, axis=2)


@pytest.mark.parametrize("angle", [0.0, 4.0, -6.0])
def test_layout_measures_angle_pitch_and_block(angle):
    found = L.text_layout(page(angle))
    assert abs(found.skew - angle) < 0.5 and abs(found.pitch - 20) <= 1 and not found.dark and L.text_layout(page(angle, dark=True)).dark
    assert found.rebuild == (angle != 0)
    x, y, w, h = found.region
    assert x <= 85 and y <= 85 and x + w >= 395 and y + h >= 315


def test_large_images_are_measured_small_and_answered_in_source_pixels():
    found = L.text_layout(np.kron(page(4.0), np.ones((3, 3, 1), np.uint8)))
    assert abs(found.skew - 4) < 0.5 and abs(found.pitch - 60) <= 3 and found.region[2] > 900


def test_even_and_tiny_images_have_no_block():
    for image in (np.full((200, 300, 3), 90, np.uint8), np.zeros((5, 5, 3), np.uint8)):
        found = L.text_layout(image)
        assert found.region is None and not found.rebuild and L.upright(image, found) is None
    assert L.upright(page(), L.Layout(0.5, (0.0, 0.0, 15.0, 200.0), 3.0)) is None


def test_views_are_level_dark_on_light_and_lead_back():
    image = page(5.0, dark=True)
    found = L.text_layout(image)
    view = L.upright(image, found)
    again = L.text_layout(view.image)
    assert abs(again.skew) < 0.6 and view.image.shape[0] * view.image.shape[1] <= L.PIXELS * 1.01
    # The middle of the view is the middle of the block; a point goes where the turn takes it.
    rows, cols = view.image.shape[:2]
    x, y, w, h = found.region
    at = view.to_source((cols / 2, rows / 2, 0.0, 0.0))
    assert at == pytest.approx((x + w / 2, y + h / 2, 0, 0))
    by, turn = L.reading_scale(found.pitch), math.radians(found.skew)
    right = view.to_source((cols / 2 + 10 * by, rows / 2, 0.0, 0.0))
    assert right[:2] == pytest.approx((at[0] + 10 * math.cos(turn), at[1] + 10 * math.sin(turn)))
    box = view.to_source((cols / 2, rows / 2, 10 * by, 4 * by))
    assert box[2] == pytest.approx(10 * math.cos(turn) + 4 * math.sin(turn)) and box[3] == pytest.approx(10 * math.sin(turn) + 4 * math.cos(turn))


def test_a_level_view_of_scale_one_is_the_image():
    image = page()
    view = L.upright(image, L.Layout(0.5, (0.0, 0.0, 480.0, 400.0)), scale=1.0)
    assert (view.image == image).all() and view.to_source((3.0, 4.0, 5.0, 6.0)) == pytest.approx((3, 4, 5, 6))
    assert L.upright(image, L.Layout(0.5, (0.0, 0.0, 480.0, 400.0)), budget=1e3, scale=6.0).image.shape == image.shape  # never made smaller


@pytest.mark.parametrize(("pitch", "scale"), [(0.0, 2.0), (200.0, 1.0), (1.0, 6.0), (26.0, 26 / (26 * 0.48))])
def test_reading_scale(pitch, scale):
    assert L.reading_scale(pitch) == pytest.approx(scale)


def test_tilted_pages_are_read_twice_and_words_placed_in_the_image():
    modes = []

    def read(image, mode):
        modes.append(mode)
        return [(f"w{len(modes)}", 0.9, (image.shape[1] / 2, image.shape[0] / 2, 0.0, 0.0))]

    assert [w[0] for w in R.page_text_in(read, page())] == ["w1"] and modes == ["auto"]
    image = page(5.0)
    words = R.page_text_in(read, image)
    x, y, w, h = L.text_layout(image).region
    assert modes == ["auto", "auto", "block"] and words[1][2:4] == pytest.approx((x + w / 2, y + h / 2))


def test_layouts_of_frames(spark):
    images = [page(), page(5.0), np.full((40, 60, 3), 7, np.uint8)]
    rows = [(1, k / 2, *x.shape, bytearray(x.tobytes())) for k, x in enumerate(images)]
    frames = spark.createDataFrame(rows, "video long, t double, height int, width int, channels int, data binary")
    got = {r["t"]: r for r in L.layouts(frames).collect()}
    assert [got[t]["rebuild"] for t in (0.0, 0.5, 1.0)] == [False, True, False]
    assert got[1.0]["x"] is None and abs(got[0.5]["skew"] - 5) < 0.5
    assert L.layouts(frames.where("t > 9")).count() == 0
