"""Joins of intervals by bins, and looks backward and forward along time by slices: no key, however hot, meets in one task for either.

An interval is put into every bin of a fixed width that it touches, so that key and bin are a plain equi-join; a pair that shares several
bins counts in the first of them.  Bins that hold more than ``hot`` rows of the left side are cut into salted parts, and the right side's rows of
those bins go to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilflow.sources.kept import Kept

Span = tuple[str, str]
#: Bins reach this much further than the interval, as sums and differences of times are rounded; the exact condition decides.
SLACK = 1e-6
#: Bytes of the largest table read for which ``dealt`` makes a partition: some ten thousand sightings.
DEALT = 1 << 20


def dealt(rows: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` dealt out by ``on`` into partitions whose number grows with the tables read, so that what a task sorts does not grow with them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    largest = max((int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())), default=0)
    # Rows of an RDD have no size that is known.
    known = largest // DEALT if largest < 1 << 50 else 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, known), *on)


def _bin(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def _binned(rows: DataFrame, span: Span, width: float, slack: float) -> DataFrame:
    lo, hi = F.expr(span[0]) - slack, F.expr(span[1]) + slack
    rows = rows.withColumn("_lo", _bin(lo, width)).where(F.expr(span[0]) <= F.expr(span[1]))
    if span[0] == span[1] and not slack:
        return rows.withColumn("_bin", F.col("_lo"))
    return rows.withColumn("_bin", F.explode(F.sequence("_lo", _bin(hi, width))))


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: Span, right_span: Span, width: float, condition: str = "true", how: str = "inner", hot: int = 20_000) -> DataFrame:
    """Pairs of rows with equal ``on`` whose intervals meet and for which ``condition`` holds; sides are called ``a`` and ``b`` in it and in the result.

    Spans are pairs of expressions, both ends included; a span of one expression twice is a point.  ``how``: inner, or, if the left side are points,
    left, left_semi or left_anti.  Rows whose key or span is null meet nothing.
    """
    point = left_span[0] == left_span[1]
    if how != "inner" and not point:
        raise ValueError(f"a {how} join takes points on the left")
    a, b = _binned(left, left_span, width, 0.0), _binned(right, right_span, width, SLACK)
    many = a.groupBy(*on, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*on, "_bin", F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    a = a.join(many, [*on, "_bin"], "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    b = b.join(many, [*on, "_bin"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    equal = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*on, "_bin", "_part"]]
    side = lambda s, which: F.expr(_named(s, which))
    meet = (side(left_span[0], "a") <= side(right_span[1], "b")) & (side(right_span[0], "b") <= side(left_span[1], "a"))
    first = F.lit(True) if point else F.greatest(F.col("a._lo"), F.col("b._lo")) == F.col("a._bin")
    where = meet & first & F.expr(condition)
    for e in equal:
        where = e & where
    return a.alias("a").join(b.alias("b"), where, how)


def _named(expression: str, side: str) -> str:
    """Plain column names of an expression, as columns of a side."""
    import re

    return re.sub(r"(?<![\w.'])([A-Za-z_]\w*)(?![\w(])", lambda m: f"{side}.{m[1]}", expression)


def pairs_within(left: DataFrame, right: DataFrame, on: list[str], at: str, reach: float, condition: str = "true", how: str = "inner", hot: int = 20_000) -> DataFrame:
    """Pairs whose times ``at`` are at most ``reach`` apart; exact differences decide, so ``reach`` itself is within."""
    spans = (at, at), (f"{at} - {reach + SLACK}", f"{at} + {reach + SLACK}")
    return interval_join(left, right, on, *spans, width=reach, condition=f"abs(a.{at} - b.{at}) <= {reach} AND {condition}", how=how, hot=hot)


def carried(rows: DataFrame, on: list[str], at: str, value: str, width: float, forward: bool = True, inclusive: bool = True) -> DataFrame:
    """``rows`` with ``carried``: the largest ``value`` (a non-decreasing function of time, null where a row has none) at or before each row;
    with ``forward`` false the least at or after it.  ``inclusive`` false leaves out rows of the same time.

    Time is cut into slices of ``width``; windows stay within a slice, and only one number a slice is carried over its neighbours.
    """
    best = F.max if forward else F.min
    order = F.col(at).asc() if forward else F.col(at).desc()
    sliced = rows.withColumn("_slice", _bin(F.col(at), width))
    inside = Window.partitionBy(*on, "_slice").orderBy(order)
    # Rows of one time see each other in a RANGE frame; what came strictly before is what the first of them sees without its own.
    if inclusive:
        near = best(value).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        own = best(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        tied = Window.partitionBy(*on, "_slice", at)
        near = F.when(F.count(F.lit(1)).over(tied) == 1, own).otherwise((F.min if forward else F.max)(F.coalesce(own, F.lit(float("-inf") if forward else float("inf")))).over(tied))
        near = F.nullif(near, F.lit(float("-inf") if forward else float("inf")))
    sums = sliced.groupBy(*on, "_slice").agg(best(value).alias("_best"))
    beyond = Window.partitionBy(*on).orderBy("_slice" if forward else F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*on, "_slice", best("_best").over(beyond).alias("_far"))  # rows: slices, not samples
    both = F.coalesce("_near", "_far")
    return sliced.withColumn("_near", near).join(sums, [*on, "_slice"]).withColumn("carried", both).drop("_slice", "_near", "_far")


def segments(rows: DataFrame, on: list[str], at: str, reach: float, width: float, starts: str = "true") -> DataFrame:
    """``rows`` with ``segment``, the time at which their segment begins: a row for which ``starts`` holds begins one if none came within ``reach`` before it."""
    times = rows.groupBy(*on, at).agg(F.max(F.expr(starts).cast("int")).alias("_may"))
    before = carried(times.withColumn("_t", F.col(at)), on, at, "_t", width, inclusive=False).drop("_t").withColumnRenamed("carried", "_before")
    cut = F.when(F.col("_before").isNull() | ((F.col(at) - F.col("_before") > reach) & (F.col("_may") == 1)), F.col(at))
    marked = carried(before.withColumn("_cut", cut), on, at, "_cut", width).select(*on, at, F.col("carried").alias("segment"))
    return rows.join(marked, [*on, at])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number (from 1) in the order of all of them.

    Sampled ranges of the order are sorted apart, after a written table has fixed them; only their sizes meet in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = Kept(rows.sparkSession)(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, place.cast("long")).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
