"""Streaming forms of the change gate and the tracker, and a windowed count of findings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veilflow.operators.folds import MERGE_S, QR_S, Gate, Track, Tracker, corroborated, findings_of, gap_of, track_id

GATE = "video long, i long, t double, changed boolean"
FINDING = "video long, track_id string, key string, first_t double, last_t double, confidence double, n_occurrences long"


class _Folding(StatefulProcessor):
    """One JSON value of state per video."""

    def init(self, handle) -> None:
        self.value = handle.getValueState("fold", "state string")

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        return json.loads(self.value.get()[0]) if self.value.exists() else {}

    def _store(self, state: dict) -> None:
        self.value.update((json.dumps(state),))


class GateProcessor(_Folding):
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values("t")
        gate = Gate(**self._load())
        weak = pdf["weak"].fillna(False) if "weak" in pdf else [False] * len(pdf)
        pdf["changed"] = [gate.changed(float(t), c, bool(w)) for t, c, w in zip(pdf["t"], pdf["cells"], weak, strict=True)]
        self._store({"cells": gate.cells.tolist(), "last_t": gate.last_t, "recheck": gate.recheck})
        yield pdf[["video", "i", "t", "changed"]]


def _apart(tracks: list[Track], reach: float) -> Iterator[list[Track]]:
    """Tracks by first sighting, in runs between which no two can become one: the next begins more than ``reach`` after all before have ended."""
    run: list[Track] = []
    for t in sorted(tracks, key=lambda t: t.first_t):
        if run and t.first_t > max(x.last_t for x in run) + reach:
            yield run
            run = []
        run.append(t)
    if run:
        yield run


class TimedTrackProcessor(_Folding):
    """Tracks in event time.  Rows wait until the watermark has passed them, so what comes late, but within its delay, is folded in its place;
    weak codes wait for what may confirm them.  A finding is emitted once nothing can change it: by a later row, or by a timer if none comes.

    State holds the waiting rows, the last QR_S seconds of sightings of codes, and the tracks not yet emitted.
    """

    def __init__(self, source: str, interval: float, time_col: str):
        self.source, self.interval, self.time_col = source, interval, time_col
        self.wait = QR_S if source == "qr" else 0.0
        self.reach = max(MERGE_S, gap_of(interval))

    def init(self, handle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = self._load()
        for pdf in rows:
            at = pdf[self.time_col].astype("datetime64[ns]").astype("int64") / 1e9
            state.setdefault("origin", float(at.iloc[0] - pdf["t"].iloc[0]))
            columns = zip(*(pdf[c] for c in ("t", "event_id", "key", "confidence", "x", "y", "w", "h", "strong")), strict=True)
            state.setdefault("waiting", []).extend([float(t), int(n), k, float(c), float(x), float(y), float(w), float(h), bool(s)] for t, n, k, c, x, y, w, h, s in columns)
        yield from self._forward(key, state, timers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._forward(key, self._load(), timerValues)

    def _forward(self, key, state: dict, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() / 1000 - state.get("origin", 0.0)
        rows = sorted(state.get("waiting", []))
        recent = state.get("recent", [])
        samples: list[tuple[float, list[dict]]] = []
        for t, _, k, c, x, y, w, h, s in sorted([*recent, *rows]):
            if not samples or samples[-1][0] != t:
                samples.append((t, []))
            samples[-1][1].append({"key": k, "source": self.source, "confidence": c, "box": (x, y, w, h), "strong": s})
        until = now - self.wait
        tracker = Tracker(self.interval, [{**t, "box": tuple(t["box"]), "occurrences": [(o[0], tuple(o[1])) for o in t["occurrences"]]} for t in state.get("tracks", [])])
        done = state.get("done", float("-inf"))
        for t, hits in corroborated(samples) if self.source == "qr" else samples:
            if done < t < until:
                tracker.sample(t, hits)
        folded = [r for r in rows if r[0] < until]
        waiting = [r for r in rows if r[0] >= until]
        out: list[Track] = []
        settled = QR_S + MERGE_S
        for run in _apart(tracker.tracks, self.reach):
            if all(t.last_t + settled < until for t in run):
                out += findings_of(run, float("inf"), self.interval)
                tracker.tracks = [t for t in tracker.tracks if not any(t is x for x in run)]
            else:
                break  # later ones are emitted after it, in order
        if waiting or tracker.tracks:
            at = min([r[0] for r in waiting] + [t.last_t + settled for t in tracker.tracks if t.last_t + settled >= until]) + self.wait
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple) else int(old))
            self.handle.registerTimer(int((at + state.get("origin", 0.0)) * 1000) + 2)
        recent = [r for r in [*recent, *folded] if self.source == "qr" and r[0] >= until - QR_S]
        self._store({"origin": state.get("origin", 0.0), "waiting": waiting, "recent": recent, "done": max([done, *(r[0] for r in folded)]) if folded or done > float("-inf") else -1e300, "tracks": tracker.state()})
        yield pd.DataFrame([(int(key[0]), track_id(key[0], t), t.key, t.first_t, t.last_t, t.confidence, len(t.occurrences)) for t in out], columns=[c.split()[0] for c in FINDING.split(", ")])


def timed_tracks_stream(hits: DataFrame, source: str = "face", interval: float = 0.5, time_col: str = "at", delay: str = "10 seconds") -> DataFrame:
    """Findings of ``hits``, which have ``t`` within their video and a timestamp ``time_col`` that runs along with it.

    Rows may come in any order within ``delay`` of the latest; those that come later are dropped.  The last findings of a video come
    out once the event time of the stream, moved on by any video, is QR_S + MERGE_S seconds (for codes QR_S more) and ``delay`` past them.
    """
    timed = hits.withWatermark(time_col, delay)
    return timed.groupBy("video").transformWithStateInPandas(TimedTrackProcessor(source, interval, time_col), FINDING, "Append", "EventTime")


def change_gate_stream(samples: DataFrame) -> DataFrame:
    """``samples`` (video, i, t, cells and, where verdicts on codes are known, weak), in time order per video from batch to batch."""
    return samples.groupBy("video").transformWithStateInPandas(GateProcessor(), GATE, "Append", "None")


def finding_counts(findings: DataFrame, ts_col: str = "ts", window: str = "10 seconds", lateness: str = "30 seconds") -> DataFrame:
    """Findings per category and window; rows later than ``lateness`` are dropped."""
    return findings.withWatermark(ts_col, lateness).groupBy(F.window(ts_col, window), "category").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("n_keys"))
