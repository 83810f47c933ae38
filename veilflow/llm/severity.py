"""Toxicity as ordered grades: a cumulative-link (proportional odds) regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector ``w`` for all thresholds theta_0 < theta_1 < ...; the severity of a
document is its expected grade.  Features are log(1 + count) of lower-cased words and of their beginnings (3 to 7 letters, written
with a ``*``), since insults in inflected languages are stems.  The fit uses a bounded sample of labelled rows (``max_rows``,
documented and constant whatever the corpus holds): executors count features, those that stand in toxic rows far above chance stay,
an L1-penalised pass by accelerated proximal gradient selects among them, and a second pass without shrinkage fits the selected ones,
again without those whose weight turns out not to be positive, until all are.
Scoring touches every document with the few weights that remain, so what is sent to tasks is bounded by the sample.

Defined results: null and empty texts have no features and get the base rate; texts are read whole whatever their length; rows are
scored one by one, so repeated rows get equal scores; an empty table gives an empty result; without labelled rows every document has
severity 0; labels without a document, or null labels, are ignored; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.scratch import Scratch, small_batches, tidied

_find_words = re.compile(r"[^\W_]+").findall
_STEMS = (3, 4, 5, 6, 7)
_KNOWN_WORDS = 100_000


def features_of(word: str) -> list[str]:
    """The word itself and its proper beginnings."""
    return [word, *(word[:k] + "*" for k in _STEMS if len(word) > k)]


def feature_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for word, c in Counter(_find_words((text or "").lower())).items():
        for f in features_of(word):
            counts[f] += c
    return counts


class _Known(dict):
    """Word -> the features of it that have a weight; filled as words come."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = found = tuple(f for f in features_of(word) if f in self.weights)
        return found


#: A toxic row is graded by its number of words that mark toxic rows: fewer than 2, fewer than 5, or more.
GRADE_STEPS = (2, 5)


@dataclass
class SeverityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (float("inf"),)

    def __post_init__(self):
        self.known = _Known(self.weights)

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds}

    def __setstate__(self, state):
        self.__init__(**state)

    def score(self, text: str | None) -> tuple[float, list[float]]:
        """Expected grade, and P(grade >= k) for k = 1, 2, ..."""
        counts = Counter(f for found in map(self.known.__getitem__, _find_words((text or "").lower())) if found for f in found)
        z = sum(self.weights[f] * float(np.log1p(c)) for f, c in sorted(counts.items()))
        above = [0.0 if t == float("inf") else 1.0 / (1.0 + float(np.exp(np.clip(t - z, -50, 50)))) for t in self.thresholds]
        return sum(above), above


def _loss_gradient(z: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean negative log likelihood by z and by theta."""
    k = len(theta)
    edge = np.concatenate([[-np.inf], theta, [np.inf]])
    hi, lo = 1 / (1 + np.exp(np.clip(z - edge[y + 1], -60, 60))), 1 / (1 + np.exp(np.clip(z - edge[y], -60, 60)))
    p = np.maximum(hi - lo, 1e-12)
    dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
    n = len(z)
    by_theta = np.zeros(k)
    for j in range(k):
        by_theta[j] = (dl[y == j + 1].sum() - dh[y == j].sum()) / n
    return (dh - dl) / n, by_theta


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, l1: float, l2: float, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient over a sparse matrix in coordinates; returns weights and increasing thresholds."""
    n, grades = len(y), int(y.max()) + 1
    share = np.array([(y <= k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log(share / (1 - share))
    scale = np.sqrt(np.bincount(cols, values**2, n_features) / n).clip(1e-9)
    v = values / scale[cols]
    w = np.zeros(n_features)
    u = np.ones(n_features)
    for _ in range(15):  # the largest eigenvalue bounds the curvature
        u = np.bincount(cols, v * np.bincount(rows, v * u[cols], n)[rows], n_features) / n
        norm = float(np.linalg.norm(u)) or 1.0
        u /= norm
    step = 1.0 / (0.3 * norm + l2 + 1.0)
    old, at, t = w.copy(), w.copy(), 1.0
    old_theta, at_theta = theta.copy(), theta.copy()
    for _ in range(steps):
        by_z, by_theta = _loss_gradient(np.bincount(rows, v * at[cols], n), y, at_theta)
        g = np.bincount(cols, v * by_z[rows], n_features) + l2 * at
        w = at - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(at_theta - step * by_theta + 1e-6 * np.arange(grades - 1))
        if float((at - w) @ (w - old)) > 0:  # momentum against the gradient: start it anew
            t = 1.0
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, at_theta = w + (t - 1) / new_t * (w - old), theta + (t - 1) / new_t * (theta - old_theta)
        at_theta = np.maximum.accumulate(at_theta)
        old, old_theta, t = w, theta, new_t
    return w / scale, theta


def _document_counts(sample: DataFrame, min_df: int, least_z: float) -> tuple[int, int, set[str]]:
    """Rows, toxic rows, and the features that stand in at least ``min_df`` toxic rows and in 1 % of them, ``least_z`` deviations above chance."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, toxic = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = feature_counts(text).keys()
                every.update(found)
                if label > 0:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], names=["feature", "df", "df_toxic"])

    total = sample.agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("toxic")).first()
    n, n_toxic = total["n"], total["toxic"]
    if not 0 < n_toxic < n:
        return n, n_toxic, set()
    rate = n_toxic / n
    z = (F.col("df_toxic") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))
    counts = sample.mapInArrow(tidied(work), "feature string, df long, df_toxic long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("df_toxic").alias("df_toxic"))
    kept = counts.where((F.col("df_toxic") >= max(min_df, n_toxic // 100)) & (z >= least_z)).select("feature").collect()  # of the bounded sample
    return n, n_toxic, {r["feature"] for r in kept}


def _rows(sample: DataFrame, kept: set[str]) -> list[tuple[int, list[str], list[int], int]]:
    """(label, features, counts, number of words with a kept feature) of each row of the bounded sample, for the kept features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{f: c for f, c in feature_counts(t).items() if f in kept} for t in batch.column(1).to_pylist()]
            marked = [sum(any(f in kept for f in features_of(w)) for w in _find_words((t or "").lower())) for t in batch.column(1).to_pylist()]
            texts = pa.array([xxhash.xxh64_intdigest(t or "") >> 1 for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([" ".join(x) for x in out], pa.string()), pa.array([" ".join(map(str, x.values())) for x in out], pa.string()), pa.array(marked, pa.int64())], names=["label", "text_hash", "features", "counts", "marked"])

    rows = sample.mapInArrow(tidied(work), "label int, text_hash long, features string, counts string, marked long").collect()
    return [(r["label"], r["features"].split(), [int(c) for c in r["counts"].split()], r["marked"]) for r in sorted(rows, key=lambda r: (r["text_hash"], r["label"]))]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, seed: int = 11) -> DataFrame:
    """``label`` and ``text`` of at most ``max_rows`` labelled documents, drawn by a hash of their id; the drawn ids are few enough to broadcast."""
    drawn = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "_id").select("label", "text")


def _most_specific(rows: list[tuple[int, list[str], list[int], int]], kept: set[str]) -> list[str]:
    """Of features that stand in exactly the same rows, as a word and its beginnings often do, the longest alone."""
    at: dict[str, list[int]] = {f: [] for f in kept}
    for i, (_, found, _, _) in enumerate(rows):
        for f in found:
            at[f].append(i)
    best: dict[tuple[int, ...], str] = {}
    for f in sorted(kept, key=lambda f: (len(f.rstrip("*")), f)):
        best[tuple(at[f])] = f
    return sorted(best.values())


def fit_severity(sample: DataFrame, graded: bool = False, min_df: int = 5, least_z: float = 6.0) -> SeverityModel:
    """Fit on ``label`` and ``text``; equal texts count once, with their highest label.

    ``graded``: labels are grades 0, 1, 2, ...  Otherwise they are 0 and 1, and rows with 1 are graded by GRADE_STEPS: by how many
    of their words have a feature that the screening kept.
    """
    small_batches(sample.sparkSession)
    scratch = Scratch(sample.sparkSession)
    sample = scratch.cut(sample.groupBy("text").agg(F.max("label").cast("int").alias("label")).select("label", "text"), "sample")
    try:
        n, n_toxic, kept = _document_counts(sample, min_df, least_z)
        if not kept:
            return SeverityModel()
        rows = _rows(sample, kept)
    finally:
        scratch.drop("sample")
    if graded:
        y = np.array([max(r[0], 0) for r in rows])
    else:
        steps = np.array(GRADE_STEPS)
        y = np.array([0 if r[0] <= 0 else 1 + int(np.searchsorted(steps, r[3], side="right")) for r in rows])
    y = np.unique(y, return_inverse=True)[1]
    vocabulary = _most_specific(rows, kept)
    index = {w: i for i, w in enumerate(vocabulary)}
    cells = [(i, index[f], c) for i, r in enumerate(rows) for f, c in zip(r[1], r[2], strict=True) if f in index]
    where, cols = (np.array([c[k] for c in cells], dtype=np.int64) for k in (0, 1))
    values = np.log1p(np.array([c[2] for c in cells], dtype=float))
    rate = n_toxic / n
    # The gradient that chance alone gives the best of so many features, halved: screening has already asked for more than chance.
    l1 = 0.5 * (2 * np.log(max(len(vocabulary), 2)) * rate * (1 - rate) / n) ** 0.5
    w, _ = fit_ordinal(where, cols, values, y, len(vocabulary), l1, 0.0, 400)
    chosen = np.flatnonzero(w > 1e-3)
    while len(chosen):
        renumber = np.full(len(vocabulary), -1)
        renumber[chosen] = np.arange(len(chosen))
        use = renumber[cols] >= 0
        w, theta = fit_ordinal(where[use], renumber[cols[use]], values[use], y, len(chosen), 0.0, 1e-5, 3000)
        if (w > 0).all():
            return SeverityModel({vocabulary[k]: round(float(x), 6) for k, x in zip(chosen, w, strict=True)}, tuple(round(float(t), 6) for t in theta))
        chosen = chosen[w > 0]  # weights and thresholds of what stays are fitted together
    return SeverityModel()


def score_severity(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Per row: id, expected ``severity``, ``p_toxic`` = P(grade >= 1), the most likely ``grade``, and ``toxic`` (p_toxic >= reject_at)."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([base.schema["doc_id"], *(T.StructField(n, k) for n, k in (("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                severity, above = model.score(text)
                edges = [1.0, *above, 0.0]
                rows.append((severity, above[0], int(np.argmax([a - b for a, b in zip(edges, edges[1:], strict=False)])), above[0] >= reject_at))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return base.mapInArrow(tidied(work), schema)


def drop_toxic(docs: DataFrame, model: SeverityModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns, all others rows as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t)[1][0] < reject_at for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(work), docs.schema)
