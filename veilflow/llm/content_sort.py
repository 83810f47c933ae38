"""Exact duplicates by a content sort.

1. Each row becomes (first bytes, digest, bytes, id) of its normalised text.  Spark samples the first three of its sort key but the
   bytes - so no long text is ever sampled to the driver - and deals rows by the splitters it finds.  The id is the last part of the
   key: copies of one text, however many, are cut into several partitions in order of their ids.
2. Every partition is sorted (externally, by Spark) by the whole key, so equal texts are neighbours; one pass over Arrow batches
   compares neighbours byte by byte.  A run of equal texts ends in the row that stays.
3. Only the first and last run of a partition can go on next door.  Their texts are compared along the borders by a join of each
   partition with the next one; the rest is arithmetic on at most two rows of numbers a partition.

Defined results: a null text counts as empty.  Null ids come before all others; of rows that repeat id and text one stays.  With no
rows the result is empty.  Other columns are ignored, whatever their names.  Rows that repeat both id and text aren't cut apart: they
meet in one sorted partition, which spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.scratch import Scratch, small_batches, tidied

#: Bytes of a text that take part in splitters.
HEAD = 48


def sorted_by_content(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column], keep: str, partitions: int | None) -> DataFrame:
    """id, digest and bytes of every row, equal texts next to each other in partitions that follow one another; the row that stays is the last of its kind."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.coalesce(normalise(F.col(text_col)), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), v.alias("v")).select("id", F.substring("v", 1, HEAD).alias("head"), F.unhex(F.sha2("v", 256)).alias("sha"), "v")
    order = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    return rows.repartitionByRange(n, "head", "sha", order).sortWithinPartitions("head", "sha", "v", order).select("id", "sha", "v")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with size and last id of their run, and after them the borders: text, size and last id of the first and last run."""
    pid = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []  # rows (id, sha) of the run that is still open
    text: pa.Scalar | None = None
    n_runs, names = 0, ["pid", "kind", "edge", "id", "keep_id", "n", "last", "sha", "border"]

    def close(ids: pa.Array, sha: pa.Array, sizes: np.ndarray, edge: int) -> pa.RecordBatch:
        """Rows of whole runs of these sizes."""
        ends = np.cumsum(sizes) - 1
        last = np.zeros(len(ids), bool)
        last[ends] = True
        keep = ids.take(pa.array(np.repeat(ends, sizes)))
        const = lambda x, t: pa.array(np.full(len(ids), x), t)
        return pa.RecordBatch.from_arrays(
            [const(pid, pa.int32()), const(0, pa.int32()), const(edge, pa.int32()), ids, keep, pa.array(np.repeat(sizes, sizes), pa.int64()), pa.array(last), sha, pa.nulls(len(ids), pa.binary())], names=names
        )

    def close_held(edge: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([b.column(0) for b in held])
        sha = pa.concat_arrays([b.column(1) for b in held])
        yield close(ids, sha, np.array([len(ids)]), edge)
        if edge:
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays(
                [one(pid, pa.int32()), one(1, pa.int32()), one(edge, pa.int32()), pa.nulls(1, ids.type), ids.slice(len(ids) - 1), one(len(ids), pa.int64()), one(True, pa.bool_()), pa.nulls(1, pa.binary()), one(text.as_py(), pa.binary())], names=names
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        v, n = batch.column(2), batch.num_rows
        fresh = np.ones(n, bool)
        fresh[1:] = ~pc.equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        fresh[0] = text is None or v[0] != text
        starts = np.flatnonzero(fresh)
        first = int(starts[0]) if len(starts) else n
        if first:
            held.append(batch.slice(0, first).select([0, 1]))
        if not len(starts):
            continue
        if held:
            yield from close_held(1 if n_runs == 1 else 0)
        if len(starts) > 1:
            whole, sizes = batch.slice(first, int(starts[-1]) - first), np.diff(starts)
            if not n_runs:  # the first run of the partition has borders of its own
                held, text = [whole.slice(0, int(sizes[0])).select([0, 1])], v[first]
                yield from close_held(1)
                whole, sizes = whole.slice(int(sizes[0])), sizes[1:]
            if len(sizes):
                yield close(whole.column(0), whole.column(1), sizes, 0)
        n_runs += len(starts)
        held, text = [batch.slice(int(starts[-1])).select([0, 1])], pa.scalar(v[n - 1].as_py(), v.type)  # a copy: the batch itself can go
    if held:
        yield from close_held(3 if n_runs == 1 else 2)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c, keep: str = "smallest", partitions: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (of the row that stays: smallest or largest id), group_size, kept, text_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep the smallest or the largest id, not {keep!r}")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    ordered = sorted_by_content(docs, id_col, text_col, normalise, keep, partitions)
    kind = ordered.schema["id"].dataType
    schema = T.StructType([
        T.StructField("pid", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("id", kind), T.StructField("keep_id", kind),
        T.StructField("n", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("sha", T.BinaryType()), T.StructField("border", T.BinaryType()),
    ])
    rows = scratch.cut(ordered.mapInArrow(tidied(_runs), schema), "runs")
    edges = scratch.cut(_edges(rows), "edges")  # at most two rows a partition
    own = rows.where("kind = 0").select("pid", "edge", "id", "keep_id", "n", "last", "sha")
    found = own.join(F.broadcast(edges), ["pid", "edge"], "left")
    inner = F.col("edge") == 0
    return scratch.last(
        found.select(
            F.col("id").alias("doc_id"), F.when(inner, F.col("keep_id")).otherwise(F.col("group_keep")).alias("keep_id"), F.when(inner, F.col("n")).otherwise(F.col("group_n")).alias("group_size"),
            (F.col("last") & (inner | F.col("ends"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def _edges(rows: DataFrame) -> DataFrame:
    """For the first and last run of each partition: size and last id of the group that they belong to over all partitions, and whether it ends there."""
    borders = rows.where("kind = 1").select("pid", "edge", "n", "keep_id", "border")
    place = borders.groupBy("pid").agg(F.count("*").alias("c")).select("pid", F.row_number().over(Window.orderBy("pid")).alias("i"))
    placed = borders.join(place, "pid")
    before = placed.where("edge <> 1").select((F.col("i") + 1).alias("i"), F.col("border").alias("other"))
    # Texts are shuffled, never broadcast: there are few of them, but nothing bounds their length.
    joined = placed.where("edge <> 2").select("i", "border").join(before.hint("merge"), "i").where(F.col("border") == F.col("other")).select("i", F.lit(True).alias("goes_on"))
    runs = placed.select("pid", "edge", "i", "n", "keep_id").join(joined, "i", "left")
    along = Window.orderBy("i", "edge")
    begins = F.when((F.col("edge") != 2) & F.col("goes_on").isNotNull(), 0).otherwise(1)
    groups = runs.withColumn("g", F.sum(begins).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("g").agg(F.sum("n").alias("group_n"), F.max(F.struct("i", "edge", "keep_id")).alias("end"))
    ends = (F.col("i") == F.col("end.i")) & (F.col("edge") == F.col("end.edge"))
    return groups.join(whole, "g").select("pid", "edge", "group_n", F.col("end.keep_id").alias("group_keep"), ends.alias("ends"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; ids and digests alone are joined.  Rows that repeat both id and text stay together."""
    normalise = how.get("normalise", lambda c: c)
    kept = exact_duplicates(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.sha2(F.coalesce(normalise(F.col(text_col)), F.lit("")).cast("binary"), 256) == F.col("_kept_sha"))
    return docs.join(kept, same, "left_semi")
