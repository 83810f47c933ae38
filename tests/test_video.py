"""The whole scan with toy readers: marks in an image stand for words, codes and faces; nothing is found again once it is covered."""

import numpy as np
import pytest

from veilflow import catalog
from veilflow.plans import video as V
from veilflow.sources import recognisers as R
from veilflow.sources.kept import Kept

SCHEMA = "video long, t double, height int, width int, channels int, data binary"
WORDS = {1: "mail", 2: "jane.doe@corp.org", 3: "hello", 4: "4111 1111 1111 1111", 5: "host", 6: "db-7.internal"}


def frame(marks, shade=0):
    """Marks (kind, number, x, y): a pixel (kind, number, 255) on a grey ground."""
    out = np.full((120, 200, 3), 150 + shade, np.uint8)
    for kind, number, x, y in marks:
        out[y, x] = (kind, number, 255)
    return out


def spots(image, kind):
    return [(int(image[y, x, 1]), int(x), int(y)) for y, x in np.argwhere((image[..., 2] == 255) & (image[..., 0] == kind))]


def text():
    return lambda image, mode: [(WORDS[n], 0.9, (x, y, 40, 12)) for n, x, y in spots(image, 1) if n in WORDS]


def codes():
    def decode(image):
        found = spots(image, 2)
        if not found:
            return None
        n, x, y = found[0]
        side = 70 if n < 100 else 30  # small codes are weak
        return f"https://a.example/{n}", 1, [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]

    return decode


def faces():
    return lambda image: [(0.9, (x, y, 30, 30)) for n, x, y in spots(image, 3)]


def video():
    still = [(1, 1, 10, 10), (1, 2, 60, 11), (1, 3, 10, 60)]
    shown = {0: still, 1: still, 2: still, 3: [*still, (2, 7, 110, 30)], 4: [*still, (2, 7, 110, 30)], 5: [(3, 9, 20, 40)], 6: [(3, 9, 26, 44)], 7: [], 8: [], 9: [], 10: [], 11: [(2, 200, 20, 20)], 12: [(2, 200, 20, 20)], 13: [(2, 200, 20, 20)]}
    rows = [(1, k * 0.5, frame(m, 3 * (k >= 5) + 4 * (k >= 7) + 5 * (k >= 11))) for k, m in shown.items()]
    return rows + [(2, k * 0.5, frame([(1, 5, 10, 10), (1, 6, 70, 12)] if k < 3 else [(2, 201, 20, 20)] if k == 3 else [], 2 * (k >= 3) + 2 * (k > 3))) for k in range(6)]


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(v, t, *x.shape, x.tobytes()) for v, t, x in video()], SCHEMA).repartition(3)


def test_frames_are_scanned_covered_and_scanned_again(spark, frames):
    readers = V.Readers(text, codes, faces)
    found, gate = V.scan(frames, readers)
    rows = {(r["video"], r["detector_id"], r["key"]): r for r in found.collect()}
    assert {(v, d) for v, d, _ in rows} == {(1, "email"), (1, "qr"), (1, "face"), (2, "internal-hostname")}
    assert (1, "qr", "https://a.example/200") in rows  # weak twice over, so each confirms the other
    assert not any("201" in k for _, _, k in rows)  # weak and seen once
    email = rows[1, "email", "email|jane.doe@corp.org"]
    assert (email["first_t"], email["source"], email["severity"], email["redact"]) == (0.0, "ocr", "medium", True) and "jane.doe" not in email["masked"]
    changed = sorted(r["i"] for r in gate.where("video = 1 AND changed").collect())
    assert 12 in changed and 2 not in changed  # the look after a weak code, though nothing has moved
    covered = Kept(spark)(V.cover(frames, found), "covered")
    assert covered.count() == frames.count()
    again, _ = V.scan(covered, readers)
    assert again.count() == 0


def test_only_what_is_wanted_is_read(spark, frames):
    def broken():
        raise AssertionError("not wanted")

    found, _ = V.scan(frames, V.Readers(text, broken, broken), V.Categories(("personal",)))
    assert {r["detector_id"] for r in found.collect()} == {"email"}
    found, _ = V.scan(frames, V.Readers(broken, codes, faces), V.Categories(("visual",)))
    assert {r["detector_id"] for r in found.collect()} == {"qr", "face"}
    with pytest.raises(ValueError):
        V.scan(frames, V.Readers(text), V.Categories(()))
    with pytest.raises(ValueError):
        V.scan(frames, V.Readers(text), V.Categories(("visual",)))
    with pytest.raises(Exception, match="could not be loaded"):
        V.scan(frames, V.Readers(lambda: None), V.Categories(("personal",)))[0].collect()


def test_category_sets():
    every = V.Categories()
    assert every.toggled("visual").names == tuple(n for n in every.names if n != "visual") and every.toggled("network").toggled("network") == every
    with pytest.raises(ValueError):
        every.toggled("other")


def test_words_come_in_lines():
    words = [("b", 0.9, 50.0, 12.0, 20.0, 10.0), ("a", 0.8, 10.0, 10.0, 20.0, 10.0), ("d", 0.9, 40.0, 41.0, 9.0, 9.0), ("c", 0.9, 10.0, 40.0, 20.0, 10.0)]
    assert [(w[0], w[1], w[2]) for w in R.in_lines(words)] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")]


def test_codes_are_judged_as_in_sql(spark):
    for note, data, version, *c in catalog._CORNERS:
        corners = list(zip(c[::2], c[1::2], strict=True))
        sql = f"SELECT * FROM (VALUES ('{note}', '{data}', {version}, {', '.join(f'cast({x} AS DOUBLE)' for x in c)})) AS t(note, data, version, tlx, tly, trx, try_, brx, bry, blx, bly)"
        want = spark.sql(catalog.G.judge_qr(catalog.SPARK, f"({sql})").replace("1.35", "1.35D")).first()
        assert R.judged(data, version, corners) == want["strength"], note
    assert R.judged("x" * 9, 1, [(0, 0), (float("nan"), 0), (90, 90), (0, 90)]) is None and R.judged("\x01\x02\x03ab", 1, [(0, 0), (90, 0), (90, 90), (0, 90)]) is None
