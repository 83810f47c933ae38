"""From recognised words to sightings: words become lines, lines are scanned, findings get the box of what must be covered.

A line is one row with an array of its words, so that boxes are found by a fold over that array; no finding is joined back to its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilflow.detect import native


def lines_of_words(words: DataFrame, line_keys: list[str], order: str = "idx") -> DataFrame:
    """One row per line: its keys, ``line`` (words joined by single spaces) and ``words``, an array of text, start, x, y, w, h, confidence.

    ``words``: one row each, with text, x, y, w, h, confidence and a column to order by; blank words go, and lines without any other.
    """
    kept = words.withColumn("text", F.trim("text")).where("text <> ''")
    fields = ["text", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "confidence"))]
    rows = kept.groupBy(*line_keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *fields))).alias("ws"))
    return placed(rows.withColumn("line", F.expr("array_join(ws.text, ' ')"))).select(*line_keys, "line", "words")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``words``, as of ``lines_of_words``, in place of ``ws``: the words of a line in order, none of them blank."""
    step = "(a, w) -> named_struct('at', a.at + length(w.text) + 1, 'out', concat(a.out, array(named_struct('text', w.text, 'start', a.at, 'x', w.x, 'y', w.y, 'w', w.w, 'h', w.h, 'confidence', w.confidence))))"
    kind = "array<struct<text:string,start:int,x:double,y:double,w:double,h:double,confidence:double>>"
    words = f"aggregate(ws, named_struct('at', 0, 'out', cast(array() AS {kind})), {step}, a -> a.out)"
    return rows.withColumn("words", F.explode(F.array(F.expr(words)))).drop("ws")  # by a generator: filters on lines go below it


def hits_of_lines(lines: DataFrame, categories: list[str] | None = None, words: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per finding of ``lines`` (line, words, any keys) that has a box: keys, key (rule and value), detector_id, label, category, severity, value, source,
    start, end, cover_end, box x, y, w, h of all words from start to cover_end, and confidence, the mean over all words of the line.

    ``words`` adds that column to rows that hold a finding, where lines come without it; what it makes it from is called ``raw``.
    """
    keys = [c for c in lines.columns if c not in ("line", "words", "raw")]
    rows, rules = native.scanned(lines, categories)
    rows = rows.select(*lines.columns, F.explode_outer("hits_").alias("hit_")).where("hit_ is not null")
    rows = rows if words is None else words(rows)
    mean = "aggregate(words, 0D, (a, w) -> a + w.confidence) / size(words)"
    each = rows.select(*keys, "words", F.expr(mean).alias("confidence"), "hit_")
    each = each.withColumn("cover_end", F.expr(native.extended("words", "hit_.s", "hit_.e")))
    each = each.withColumn("touched", F.expr("filter(words, w -> hit_.s < w.start + length(w.text) AND w.start < cover_end)")).where("size(touched) > 0")
    box = {"x": "array_min(touched.x)", "y": "array_min(touched.y)", "w": "array_max(transform(touched, t -> t.x + t.w)) - array_min(touched.x)", "h": "array_max(transform(touched, t -> t.y + t.h)) - array_min(touched.y)"}
    told = {k: e for k, e in native.described(rules, "hit_").items() if k != "masked"}
    key = f"concat({told['detector_id']}, '|', lower(hit_.value))"
    return each.select(
        *keys, F.expr(key).alias("key"), *(F.expr(e).alias(k) for k, e in told.items()), F.lit("ocr").alias("source"), "cover_end", *(F.expr(e).alias(k) for k, e in box.items()), "confidence"
    )
