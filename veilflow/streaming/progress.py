"""What a running scan tells: samples taken, analysed and skipped, and how many different findings there have been so far."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = ("sampled", "analysed", "skipped")


def counted_samples(gated: DataFrame, name: str = "samples") -> DataFrame:
    """``gated`` (with ``changed``), which tells its counts with every batch."""
    return gated.observe(name, F.count(F.lit(1)).alias("sampled"), F.count_if("changed").alias("analysed"), F.count_if(~F.col("changed")).alias("skipped"))


def distinct_findings(hits: DataFrame, time_col: str = "at", delay: str = "10 seconds", name: str = "findings") -> DataFrame:
    """The first row of each video and key within the watermark's reach, and with every batch how many came.

    State is forgotten once the watermark has passed a key's first row, so a key that comes back after ``delay`` or more counts again.
    """
    first = hits.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["video", "key"])
    return first.observe(name, F.count(F.lit(1)).alias("keys"))


@dataclass
class ScanProgress(StreamingQueryListener):
    """Totals of observed counts over all batches of all queries that it listens to; ``publish`` gets them after each batch that has any."""

    publish: Callable[[dict[str, int]], None] | None = None
    totals: Counter = field(default_factory=Counter)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _seen: set = field(default_factory=set)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics
        if not metrics:
            return
        with self._lock:
            if (batch := (str(progress.runId), progress.batchId)) in self._seen:  # a batch tells once
                return
            self._seen.add(batch)
            for row in metrics.values():
                self.totals.update({k: int(v or 0) for k, v in row.asDict().items()})
            now = dict(self.totals)
        if self.publish:
            self.publish(now)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def skip_percent(self) -> int | None:
        n = self.totals["sampled"]
        return int(100 * self.totals["skipped"] / n + 0.5) if n else None


def listen(spark: SparkSession, publish: Callable[[dict[str, int]], None] | None = None) -> ScanProgress:
    listener = ScanProgress(publish)
    spark.streams.addListener(listener)
    return listener
