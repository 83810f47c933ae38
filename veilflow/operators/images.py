"""Image operators on arrays: signatures, text layout, mosaics.  Recognisers (text, faces, codes) are plug-ins; these are not."""

from __future__ import annotations

import math

import numpy as np


def luma_signature(rgb: np.ndarray, width: int = 160, height: int = 90) -> np.ndarray:
    """Rec. 601 luma of the nearest pixels on a small grid."""
    h, w = rgb.shape[:2]
    ys, xs = (np.arange(height) * h) // height, (np.arange(width) * w) // width
    small = rgb[ys][:, xs].astype(np.int64)
    return ((77 * small[..., 0] + 150 * small[..., 1] + 29 * small[..., 2]) >> 8).astype(np.uint8)


def mosaic_grid(w: float, h: float, cells: float = 6) -> tuple[int, int]:
    cells = 6 if cells is None or math.isnan(cells) else min(15, max(3, math.floor(cells + 0.5)))
    block = max(6.0, max(w, h) / cells)
    return max(1, math.floor(w / block + 0.5)), max(1, math.floor(h / block + 0.5))


def mosaic(image: np.ndarray, box: tuple[int, int, int, int], cells: float = 6) -> np.ndarray:
    """A copy whose box holds nothing but the means of a coarse grid."""
    x, y, w, h = box
    out = image.copy()
    x2, y2 = min(image.shape[1], x + w), min(image.shape[0], y + h)
    x, y = max(0, x), max(0, y)
    if x2 - x < 2 or y2 - y < 2:
        return out
    sw, sh = mosaic_grid(x2 - x, y2 - y, cells)
    xs, ys = np.linspace(x, x2, sw + 1).round().astype(int), np.linspace(y, y2, sh + 1).round().astype(int)
    for a, b in zip(xs, xs[1:], strict=False):
        for c, d in zip(ys, ys[1:], strict=False):
            if b > a and d > c:
                out[c:d, a:b] = image[c:d, a:b].reshape(-1, *image.shape[2:]).mean(axis=0).round()
    return out


def tile_ladder(width: int, height: int, min_face: float = 64) -> list[int]:
    """Tile sides, each 2.5 times the one before, from the one that brings a face of ``min_face`` pixels to 22 of the 128 that a detector sees up to
    the first that meets what the whole frame shows, or the frame's shorter side; none where the whole frame does or the first would not fit."""
    if not min_face > 0:
        raise ValueError("the least face must be a positive number")
    shortest, floor, side = min(width, height), 22 * max(width, height) / 128, min_face * 128 / 22
    if min_face >= floor or side >= shortest:
        return []
    enough, sides = min(floor, shortest), [math.floor(side + 0.5)]
    while side < enough:
        side = min(2.5 * side, shortest)
        sides.append(math.floor(side + 0.5))
    return sides


def cell_means(grid: np.ndarray, side: int = 8) -> np.ndarray:
    h, w = (grid.shape[0] // side) * side, (grid.shape[1] // side) * side
    return grid[:h, :w].reshape(h // side, side, w // side, side).mean(axis=(1, 3))


def index_percentile(values: np.ndarray, p: float) -> float:
    """The value at index round((n - 1) p) of the sorted values, without interpolation."""
    return float(np.sort(values.ravel())[math.floor((values.size - 1) * p + 0.5)]) if values.size else 0.0


def text_density(luma: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of 8-pixel cells with strong horizontal gradients, and the mask of its largest 4-connected part after one dilation."""
    gradient = np.abs(luma[:, 2:].astype(float) - luma[:, :-2].astype(float))
    cells = cell_means(gradient)
    strong = cells >= max(4.0, 0.3 * index_percentile(cells, 0.95))
    padded = np.pad(strong, 1)
    wide = np.zeros_like(strong)
    for dy in range(3):
        for dx in range(3):
            wide |= padded[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
    best, seen = np.zeros_like(strong), np.zeros_like(strong)
    for y, x in np.argwhere(wide):
        if seen[y, x]:
            continue
        part, stack = [], [(int(y), int(x))]
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            part.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < wide.shape[0] and 0 <= d < wide.shape[1] and wide[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    stack.append((c, d))
        if len(part) > best.sum():
            best = np.zeros_like(strong)
            best[tuple(zip(*part, strict=True))] = True
    return float(strong.mean()), best


def shear_angle(luma: np.ndarray, most: float = 14.0) -> float:
    """The shear in degrees that makes the row profile of gradients sharpest: coarse steps of 0.008, then fine ones of 0.0015."""
    gradient = np.abs(luma[:, 2:].astype(float) - luma[:, :-2].astype(float))
    ys, xs = np.nonzero(gradient > max(4.0, 0.3 * index_percentile(gradient, 0.95)))
    if not len(ys):
        return 0.0

    def sharpness(slope: float) -> float:
        rows = np.floor(ys - slope * xs + 0.5).astype(int)
        v = np.bincount(rows - rows.min(), gradient[ys, xs])
        return float((v * v).sum() / v.sum() ** 2)

    limit = math.tan(math.radians(most))
    coarse = max(np.arange(-limit, limit, 0.008), key=sharpness)
    fine = max([float(coarse), *np.arange(coarse - 0.008, coarse + 0.008, 0.0015)], key=sharpness)
    return math.degrees(math.atan(fine))


def line_pitch(profile: np.ndarray) -> float | None:
    """The usual distance of text rows: upper median of gaps between peaks above mean + 0.4 deviations, if there are five peaks and 60 % of the
    gaps are within 35 % of it.  Peaks less than 3 apart are one row at the highest of them; fewer than 24 values say nothing."""
    if len(profile) < 24:
        return None
    wide = np.pad(np.asarray(profile, float), 1, "edge")
    smooth = (wide[:-2] + 2 * wide[1:-1] + wide[2:]) / 4
    inner = smooth[1:-1]
    tops = 1 + np.flatnonzero((inner >= smooth.mean() + 0.4 * smooth.std()) & (inner >= smooth[:-2]) & (inner > smooth[2:]))
    peaks: list[int] = []
    for i in tops.tolist():
        if not peaks or i - peaks[-1] >= 3:
            peaks.append(i)
        elif smooth[i] > smooth[peaks[-1]]:
            peaks[-1] = i
    if len(peaks) < 5:
        return None
    gaps = np.diff(peaks)
    pitch = float(np.sort(gaps)[len(gaps) >> 1])
    return pitch if (np.abs(gaps - pitch) <= max(1.0, 0.35 * pitch)).mean() >= 0.6 else None


Rect = tuple[float, float, float, float]


def iou(a: Rect, b: Rect) -> float:
    """Shared area of two rectangles (x, y, w, h) over the area of both."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    both = a[2] * a[3] + b[2] * b[3] - shared
    return shared / both if both > 0 else 0.0


def tile_places(width: int, height: int, side: int) -> list[tuple[int, int, int]]:
    """x, y and side of square tiles (64 at least, the shorter side at most) that overlap by a third; the last one ends with the image."""
    side = max(64, min(side, width, height))

    def along(length: int) -> list[int]:
        n = 1 if length <= side else 1 + math.ceil((length - side) / (side * 2 / 3))
        return [math.floor(k * (length - side) / (n - 1) + 0.5) if n > 1 else 0 for k in range(n)]

    return [(x, y, side) for x in along(width) for y in along(height)]
