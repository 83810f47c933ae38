"""Connected components of a table of links, by contraction, without ever holding the links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilflow.llm.scratch import Scratch, drop_frame, tidied

#: Links that a task contracts at a time.
BLOCK = 65_536


def _forest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """``u`` and ``v``, the least id reachable over these links, for each id but those least ones."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    ends = [(c, root(c)) for c in list(parent)]
    ends = [x for x in ends if x[0] != x[1]]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ends], pa.int64()), pa.array([x[1] for x in ends], pa.int64())], names=["u", "v"])


def _forests(links: DataFrame, block: int) -> DataFrame:
    """Stars in place of links, each made of ``block`` links at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if n + part.num_rows > block:
                    yield _forest(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        yield _forest(held)

    return links.mapInArrow(tidied(work), "u long, v long")


def _is_stars(edges: DataFrame) -> bool:
    """Whether each upper end (``u``) has one edge and is no lower end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)").limit(1).count()


def components(links: DataFrame, scratch: Scratch, name: str = "links", most: int | None = None, block: int = BLOCK) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for every id in ``links`` (columns ``a``, ``b``) but those smallest ones.

    Tasks first put stars in place of blocks of links.  ``most``, if known, is a number that the links do not exceed: if one block holds
    them, its stars are the components.  Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the smallest node that it sees.  Paths shrink
    by a constant factor a round, until each component is one star about its least id; a hub with very many neighbours is only ever
    grouped by, and a minimum is combined before shuffling.
    """
    links = links.select("a", "b").where("a <> b")
    if most is not None and most <= block:
        return scratch.step(_forests(links.repartition(1), block), name).select(F.col("u").alias("id"), F.col("v").alias("component"))
    edges = scratch.step(_forests(links, block).distinct(), name)
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above the node meet its minimum
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its neighbours below it meet the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.step(small, name)
        drop_frame(scratch, edges)
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
