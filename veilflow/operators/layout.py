"""Where an image holds its text and how that text lies; the text block upright and at reading size, with the way back to the image.

Images have their channels in the order blue, green, red, as Spark's image source gives them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veilflow.operators.images import Rect, line_pitch, shear_angle, text_density

#: The longest side that is analysed, the side of a cell, the weights of blue, green and red, and the mean below which a block is dark.
LONG_EDGE, CELL, LUMA, DARK = 480, 8, (0.114, 0.587, 0.299), 110
#: The least share of busy cells and the least skew in degrees of a page that a camera took.
LEAST_DENSITY, LEAST_SKEW = 0.02, 1.0
#: The least side of a block, the most pixels of a view, the height of capitals that a reader wants, and their share of a row.
LEAST_SIDE, PIXELS, CAPITALS, CAPITAL_SHARE = 16, 4.2e6, 26, 0.48
#: Gradients below this say nothing about rows; rows of a view that are sampled at once.
_FLAT, _BAND = 8, 256
LAYOUT = "density double, x double, y double, w double, h double, skew double, pitch double, dark boolean, rebuild boolean"


@dataclass(frozen=True)
class Layout:
    """Share of busy cells, the text block, degrees by which its rows descend to the right, their distance (0 if unknown), and whether it is dark."""

    density: float
    region: Rect | None = None
    skew: float = 0.0
    pitch: float = 0.0
    dark: bool = False

    @property
    def rebuild(self) -> bool:
        """Whether this is a page of text whose rows aren't level, so that no screen recording can show it."""
        return self.region is not None and self.density >= LEAST_DENSITY and abs(self.skew) >= LEAST_SKEW


@dataclass(frozen=True)
class View:
    """A rebuilt image, and (a, b, c, d, e, f) by which its point (X, Y) is (a X + b Y + c, d X + e Y + f) of the source."""

    image: np.ndarray
    back: tuple[float, float, float, float, float, float]

    def to_source(self, rect: Rect) -> Rect:
        """The level rectangle of the source around ``rect`` of the view: never less than what the view showed."""
        x, y, w, h = rect
        a, b, c, d, e, f = self.back
        corners = np.array([(x, y), (x + w, y), (x, y + h), (x + w, y + h)])
        xs, ys = corners @ (a, b) + c, corners @ (d, e) + f
        return float(xs.min()), float(ys.min()), float(np.ptp(xs)), float(np.ptp(ys))


def shrunk_luma(image: np.ndarray, edge: int = LONG_EDGE) -> tuple[np.ndarray, float]:
    """Luma as means over areas, at most ``edge`` on its longer side, and how many source pixels one of its pixels stands for."""
    h, w = image.shape[:2]
    scale = max(1.0, max(h, w) / edge)
    rows, cols = (max(1, math.floor(side / scale + 0.5)) for side in (h, w))
    luma = image[..., :3] @ np.array(LUMA) if image.ndim == 3 and image.shape[2] >= 3 else image.reshape(h, w, -1)[..., 0].astype(float)
    ys, xs = np.arange(rows) * h // rows, np.arange(cols) * w // cols
    sums = np.add.reduceat(np.add.reduceat(luma, ys, axis=0), xs, axis=1)
    return sums / (np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))), scale


def row_profile(luma: np.ndarray, slope: float) -> np.ndarray:
    """Gradients summed along rows that descend by ``slope``."""
    gradient = np.abs(luma[:, 2:] - luma[:, :-2])
    ys, xs = np.nonzero(gradient >= _FLAT)
    if not len(ys):
        return np.zeros(0)
    rows = np.floor(ys - slope * xs + 0.5).astype(int)
    return np.bincount(rows - rows.min(), gradient[ys, xs])


def text_layout(image: np.ndarray) -> Layout:
    """The layout of the largest connected part of busy cells; an image without one, or too small for a cell, has no region."""
    luma, scale = shrunk_luma(image)
    if luma.shape[0] < CELL or luma.shape[1] < CELL + 2:
        return Layout(0.0)
    density, part = text_density(luma)
    if not part.any():
        return Layout(density)
    (top, bottom), (left, right) = (
        (max(0, int(at[0]) - 1) * CELL, min(side, (int(at[-1]) + 2) * CELL)) for at, side in ((np.flatnonzero(part.any(axis=1)), luma.shape[0]), (np.flatnonzero(part.any(axis=0)), luma.shape[1]))
    )
    block = luma[top:bottom, left:right]
    skew = shear_angle(block)
    pitch = line_pitch(row_profile(block, math.tan(math.radians(skew)))) or 0.0
    region = left * scale, top * scale, (right - left) * scale, (bottom - top) * scale
    return Layout(density, region, skew, pitch * scale, bool(block.mean() < DARK))


def reading_scale(pitch: float) -> float:
    """How far rows of that pitch are enlarged for a reader; by 2 where the pitch is unknown."""
    return min(6.0, max(1.0, CAPITALS / max(1.0, pitch * CAPITAL_SHARE))) if pitch > 0 else 2.0


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at points between pixel centres by their four neighbours; black outside."""
    h, w = image.shape[:2]
    outside = (x < -0.5) | (x >= w - 0.5) | (y < -0.5) | (y >= h - 0.5)
    left, top = np.floor(x).astype(int), np.floor(y).astype(int)
    shape = x.shape + (1,) * (image.ndim - 2)
    p, q = (x - left).reshape(shape), (y - top).reshape(shape)
    at = lambda dy, dx: image[np.clip(top + dy, 0, h - 1), np.clip(left + dx, 0, w - 1)]
    out = (at(0, 0) * (1 - p) + at(0, 1) * p) * (1 - q) + (at(1, 0) * (1 - p) + at(1, 1) * p) * q
    out[outside] = 0
    return np.floor(out + 0.5).astype(np.uint8)


def upright(image: np.ndarray, layout: Layout, budget: float = PIXELS, scale: float | None = None) -> View | None:
    """The text block turned level about its centre and enlarged as far as ``budget`` allows, light on dark made dark on light.

    None where there is no block or one of less than 16 pixels.
    """
    if layout.region is None or min(layout.region[2:]) < LEAST_SIDE:
        return None
    x, y, w, h = layout.region
    cos, sin = math.cos(math.radians(layout.skew)), math.sin(math.radians(layout.skew))
    wide, high = w * abs(cos) + h * abs(sin), w * abs(sin) + h * abs(cos)
    by = max(1.0, min(reading_scale(layout.pitch) if scale is None else scale, math.sqrt(budget / max(1.0, wide * high))))
    cols, rows = max(1, math.floor(wide * by + 0.5)), max(1, math.floor(high * by + 0.5))
    a, d = cos / by, sin / by
    c, f = x + w / 2 - (a * cols - d * rows) / 2, y + h / 2 - (d * cols + a * rows) / 2
    source = 255 - image if layout.dark else image
    out = np.zeros((rows, cols, *image.shape[2:]), np.uint8)
    across = np.arange(cols) + 0.5
    for top in range(0, rows, _BAND):
        down = np.arange(top, min(top + _BAND, rows))[:, None] + 0.5
        out[top : top + len(down)] = _sampled(source, a * across - d * down + c - 0.5, d * across + a * down + f - 0.5)
    return View(out, (a, -d, c, d, a, f))


def layouts(frames: DataFrame, keys: tuple[str, ...] = ("video", "t")) -> DataFrame:
    """``keys`` of ``frames`` (with height, width, channels, data) and LAYOUT: the layout of each, with a null block where there is none.

    Images stay where they are; only numbers go on.
    """
    types = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in LAYOUT.split(", "))]

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                found = text_layout(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
                rows.append((*r[: len(keys)], found.density, *(found.region or (None,) * 4), found.skew, found.pitch, found.dark, found.rebuild))
            yield pd.DataFrame(rows, columns=names)

    return frames.select(*keys, "height", "width", "channels", "data").mapInPandas(work, f"{types}, {LAYOUT}")
