"""Recognisers as plug-ins: what reads text, faces or codes in one image is handed in, what surrounds it is here.

A plug-in is a function without arguments that loads a model and returns a reader; every task loads it once.  If it returns None, or if
reading fails, the query fails: an image that could not be read must never pass for one that shows nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from veilflow.operators.images import Rect, iou, tile_ladder, tile_places
from veilflow.operators.layout import text_layout, upright

SEEN = "key string, confidence double, x double, y double, w double, h double"
#: How a text reader takes the page.
MODES = ("auto", "sparse", "block")
#: The mean luma below which an image is dark; the least face score and width; the overlap of one face seen twice; its padding.
DARK, FACE_SCORE, FACE_PIXELS, FACE_OVERLAP, FACE_PAD = 110, 0.45, 64, 0.3, (0.18, 0.24)
#: Codes looked for in one image, their least side, their padding, and the margin that is painted out around them.
CODES, CODE_SIDE, CODE_PAD, CODE_MARGIN = 4, 12, 0.08, 0.12


def text_in(read: Callable, image: np.ndarray, mode: str = "auto") -> list[tuple]:
    """Words by ``read(image, mode)``, which gives (text, confidence, rectangle); a dark image is inverted first."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    luma = image[..., :3] @ np.array([29, 150, 77]) / 256 if image.ndim == 3 else image
    return [(text, float(score), *map(float, rect)) for text, score, rect in read(255 - image if luma.mean() < DARK else image, mode)]


def page_text_in(read: Callable, image: np.ndarray, mode: str = "auto") -> list[tuple]:
    """As text_in(); a page that lies at a tilt is read once more as one upright block, and those words are placed where they stand in the image."""
    words = text_in(read, image, mode)
    layout = text_layout(image)
    view = upright(image, layout) if layout.rebuild else None
    return words if view is None else words + [(text, float(score), *view.to_source(rect)) for text, score, rect in read(view.image, "block")]


def joined(faces: list[tuple[float, Rect]], least: float = FACE_OVERLAP) -> list[tuple[float, Rect]]:
    """Each face goes to the first earlier one that it overlaps, which grows to hold both and takes the better score."""
    out: list[tuple[float, Rect]] = []
    for score, r in faces:
        at = next((k for k, (_, other) in enumerate(out) if iou(other, r) > least), None)
        if at is None:
            out.append((score, r))
            continue
        best, o = out[at]
        x, y = min(o[0], r[0]), min(o[1], r[1])
        out[at] = max(best, score), (x, y, max(o[0] + o[2], r[0] + r[2]) - x, max(o[1] + o[3], r[1] + r[3]) - y)
    return out


def faces_in(detect: Callable, image: np.ndarray, floor: float = FACE_SCORE, least: float = FACE_PIXELS) -> list[tuple]:
    """Faces by ``detect(image)``, which gives (confidence, rectangle), in the whole image and in its tiles; padded, within the image."""
    height, width = image.shape[:2]
    places = [(0, 0, width, height)] + [(x, y, s, s) for side in tile_ladder(width, height, least) for x, y, s in tile_places(width, height, side)]
    seen = [(float(score), (r[0] + x, r[1] + y, r[2], r[3])) for x, y, w, h in places for score, r in detect(image[y : y + h, x : x + w]) if score >= floor and min(r[2:]) > 0]
    out = []
    for score, (x, y, w, h) in joined(seen):
        px, py = w * FACE_PAD[0], h * FACE_PAD[1]
        left, top = max(0.0, x - px), max(0.0, y - py)
        wide, high = min(width - left, w + 2 * px), min(height - top, h + 2 * py)
        if wide > 1 and high > 1:
            out.append(("face", score, left, top, wide, high))
    return out


def _sweep(decode: Callable, image: np.ndarray, accept: Callable) -> Iterator[tuple[str, Rect]]:
    """Codes of one image, each painted grey once it is read, so that the next one is found."""
    left = image.copy()
    for _ in range(CODES):
        code = decode(left)
        if code is None:
            return
        data, version, corners = code
        (x, y), (x2, y2) = np.min(corners, axis=0), np.max(corners, axis=0)
        side = max(x2 - x, y2 - y)
        if min(x2 - x, y2 - y) >= CODE_SIDE and accept(data, version, corners):
            pad = side * CODE_PAD
            yield data.strip(), (max(0.0, x - pad), max(0.0, y - pad), x2 - x + 2 * pad, y2 - y + 2 * pad)
        margin = max(4, side * CODE_MARGIN)
        left[max(0, math.floor(y - margin)) : max(0, math.ceil(y2 + margin)), max(0, math.floor(x - margin)) : max(0, math.ceil(x2 + margin))] = 128


def judged(data: str, version: int, corners: list[tuple[float, float]]) -> str | None:
    """How far a decoded code can be believed: ``strong``, ``weak``, or None if it is no code; corners from the top left, clockwise."""
    points = np.array(corners, float)
    text = data.strip()
    if points.shape != (4, 2) or not np.isfinite(points).all() or not text:
        return None
    after = np.roll(points, -1, axis=0) - points
    sides = np.hypot(after[:, 0], after[:, 1])
    plain = sum(not (ord(c) < 9 or ord(c) in (11, 12) or 14 <= ord(c) < 32 or 127 <= ord(c) < 160) for c in text) / len(text)
    if plain < 0.75 or sides.min() < 16:
        return None
    before = -np.roll(after, 1, axis=0)
    cosines = (before * after).sum(axis=1) / (np.roll(sides, 1) * sides)
    angles = np.floor(np.degrees(np.arccos(np.clip(cosines, -1, 1))) * 10 + 0.5) / 10
    ratio = math.floor(sides.max() / sides.min() * 100 + 0.5) / 100
    pixels = math.floor((sides[0] + sides[2]) / 2 / (version * 4 + 17 if version > 0 else 21) * 100 + 0.5) / 100
    if ratio > 2 or angles.min() < 55 or angles.max() > 125 or pixels < 1:
        return None
    sure = pixels >= 3 and ratio <= 1.35 and angles.min() >= 75 and angles.max() <= 105 and len(text) >= 8 and plain == 1
    return "strong" if sure else "weak"


def believed(data: str, version: int, corners: list[tuple[float, float]]) -> bool:
    return judged(data, version, corners) is not None


def codes_in(decode: Callable, image: np.ndarray, accept: Callable = believed, tiles: bool = True) -> list[tuple]:
    """Codes by ``decode(image)``, which gives (data, version, four corners) or None, in the whole image and in tiles; those that ``accept`` refuses are none.

    Tiles have the shorter side, or half of it if the image is square; a code that meets an earlier one of the same data is that one.
    """
    height, width = image.shape[:2]
    short = min(width, height)
    places = [(0, 0, width, height)]
    if tiles and short >= 64:
        places += [(x, y, s, s) for x, y, s in tile_places(width, height, max(64, short // 2) if width == height else short)]
    kept: list[tuple[str, Rect]] = []
    for x, y, w, h in places:
        for data, r in _sweep(decode, image[y : y + h, x : x + w], accept):
            r = (r[0] + x, r[1] + y, r[2], r[3])
            if not any(d == data and iou(r, o) > 0 for d, o in kept):
                kept.append((data, r))
    return [(data, 1.0, *map(float, r)) for data, r in kept]


def recognise(frames: DataFrame, load: Callable[[], Callable | None], see: Callable[..., list[tuple]], keys: tuple[str, ...] = ("video", "t"), seen: str = SEEN, **options) -> DataFrame:
    """``keys`` of ``frames`` (with height, width, channels, data) and ``seen``, a row for everything that ``see(reader, image)`` finds.

    Images stay where they are: nothing is shuffled.
    """
    wanted = frames.select(*keys, "height", "width", "channels", "data")
    types = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = load()
        if reader is None:
            raise RuntimeError("the recogniser could not be loaded")
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                rows += [(*r[: len(keys)], *found) for found in see(reader, image, **options)]
            yield pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in seen.split(", "))])

    return wanted.mapInPandas(work, f"{types}, {seen}")


WORD = "line_no int, idx int, text string, confidence double, x double, y double, w double, h double"
CODE = "key string, strong boolean, confidence double, x double, y double, w double, h double"


def in_lines(words: list[tuple]) -> list[tuple]:
    """(line, idx, text, confidence, x, y, w, h) of words (text, confidence, x, y, w, h): one belongs to the line whose last word's height holds its middle."""
    lines: list[list[tuple]] = []
    for word in sorted(words, key=lambda w: (w[2], w[3])):  # from left to right, as a line is read
        middle = word[3] + word[5] / 2
        line = next((x for x in lines if x[-1][3] <= middle <= x[-1][3] + x[-1][5]), None)
        if line is None:
            lines.append([word])
        else:
            line.append(word)
    lines.sort(key=lambda x: (x[0][3], x[0][2]))
    return [(n, i, *word) for n, line in enumerate(lines) for i, word in enumerate(line)]


def words_in(read: Callable, image: np.ndarray, mode: str = "auto") -> list[tuple]:
    """Words in lines; what a second, upright reading gives are lines of their own."""
    flat = text_in(read, image, mode)
    out = in_lines(flat)
    more = in_lines(page_text_in(read, image, mode)[len(flat) :])
    return out + [(n + 1_000_000, *rest) for n, *rest in more]


def strong_codes_in(decode: Callable, image: np.ndarray) -> list[tuple]:
    """Codes that can be believed, with whether they are strong."""
    known: dict[str, bool] = {}

    def accept(data: str, version: int, corners: list) -> bool:
        verdict = judged(data, version, corners)
        known[data.strip()] = known.get(data.strip(), False) or verdict == "strong"
        return verdict is not None

    return [(data, known[data], *rest) for data, *rest in codes_in(decode, image, accept)]
