"""Near-duplicate documents by a Chosen Path set similarity join.

A document is the set of its word shingles.  Documents with equal sets are one point.  Each of ``trees`` independent trees starts with
all points in one node; a node chooses two of 128 min-wise coordinates, and each point goes to the child named by its own min-wise
value there, so a child gathers points that share a chosen token.  Nodes of at most ``leaf`` points are compared exhaustively, first by
the likeliest pairs that would join all of their points, then, on full sets, the points that are still in doubt.  Larger
nodes branch again, each with coordinates of its own: unlike points part company within a level or two.

Points that stay together are alike, and only what they are linked to matters, not every pair of them: a large node first ties its
points to a few pivots drawn by hash; links found join components; a node whose points are one component is done; a node with at most
MOST_PIVOTS points outside its largest component compares those with all others and is done too.  A node whose points are so alike that
two children would hold more of them than the node itself (mean similarity of one half or more) would not shrink by branching.  It is
tied once more, to the points that are most like the others, and what then stands outside its largest component is compared with all
of its points, in cells of two blocks and on full sets; so are nodes that fit into one cell from the second level on, and what still
stands after ``max_level`` levels, or any level if its cells hold no more rows than half the table.  No pair is lost to a cap,
and a task emits links that join components, never all pairs.

A pair of similarity s survives a level with probability 1 - (1 - s p)**2, p being its chance below; for s = 0.8 that tends to 0.94,
for s = 0.85 to 0.97, so four trees miss about one such pair in 80,000, or in a million, by this estimate.  Sketches of 128 bytes pick
pairs within six standard deviations of the threshold.  Every link is decided on full shingle sets, in whole numbers.  The sets are
written once, in buckets by id, so that a decision shuffles the sets of its pairs only; the set of a pivot goes to several places.

Defined results: a null text, an empty one or one without words has no shingles and is linked with nothing; a text with fewer words
than a shingle is one shingle; rows that repeat an id and text are one row; an id that comes with several texts is one document that
is linked through any of them, with a row for each; a row without an id takes no part and has no component; ties cannot arise, as the
least id names a group; an empty table gives an empty result; texts of any length are read whole; other columns are kept or ignored,
whatever their names (those that begin with ``_`` are reserved).  Ids that are no whole numbers are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.components import components
from veilflow.llm.scratch import Scratch, give_back, small_batches, tidied
from veilflow.llm.words import LOWER, mix, pieces, text_buffers, window_hashes, word_bounds, word_hashes

COORDS = 128
#: A large node with so few points outside its largest component holds all points against each of these.
MOST_PIVOTS = 24
#: Tables between steps are written by no more tasks than one for so many documents, as a task takes longer to begin than to handle few.
TASK_ROWS = 4000
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = text_buffers(column)
    starts, ends, words = word_bounds(data, offsets)
    hashes = word_hashes(LOWER[data], starts, ends)
    grams = window_hashes(hashes, k)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sketch(docs: DataFrame, k: int, trees: int) -> DataFrame:
    """doc_id, size of the set, two sums that name it, a sketch of COORDS bytes, and the nodes of the first level in all trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column(1), k)
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            sums, mixed = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            minima = np.zeros((len(full), COORDS), np.uint32)
            if len(full):
                joined = np.concatenate([sets[i] for i in full])
                begin = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                sums[full] = np.add.reduceat(joined, begin)
                mixed[full] = np.add.reduceat(mix(joined), begin)
                for c in range(COORDS):
                    minima[:, c] = np.minimum.reduceat((((joined ^ _SEEDS[c]) * (_SEEDS[c + COORDS] | _U(1))) >> _U(32)).astype(np.uint32), begin)
            roots = np.empty((len(full), 2 * trees), np.uint64)
            for j in range(2 * trees):
                roots[:, j] = mix(minima[:, j].astype(np.uint64) * _U(2 * trees) + _U(j))
            sketch, nodes = [b""] * len(n), [[]] * len(n)
            small = (minima & 0xFF).astype(np.uint8)
            for row, i in enumerate(full.tolist()):
                sketch[i] = small[row].tobytes()
                nodes[i] = roots[row].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(sums.view(np.int64)), pa.array(mixed.view(np.int64)), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "sketch", "roots"],
            )

    return docs.mapInArrow(tidied(work), "doc_id long, n long, s1 long, s2 long, sketch binary, roots array<long>")


def _likeliest(left: np.ndarray, right: np.ndarray, near: np.ndarray, comp: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of each list, taken by similarity, those that join components not yet joined in that list."""
    group = np.searchsorted(begin, left, side="right")
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def root(c: tuple[int, int]) -> tuple[int, int]:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    kept = []
    for k in np.lexsort((right, left, -near)).tolist():
        g = int(group[k])
        u, v = root((g, int(comp[left[k]]))), root((g, int(comp[right[k]])))
        if u != v:
            parent[u] = v
            kept.append(k)
    return left[kept], right[kept]


def _struct_list(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """List sizes and the flattened fields of a column of lists of (id, comp, n, sketch)."""
    flat = column.flatten()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    fields = {name: flat.field(name) for name in ("id", "comp", "n")}
    out = {name: x.to_numpy(zero_copy_only=False) for name, x in fields.items()}
    out["sketch"] = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
    return sizes, out


def _within(groups: DataFrame, num: int, den: int, least: float, points: bool = False) -> DataFrame:
    """What small nodes hold (``points``: a list of structs), by sketches: ``a`` (the node) and ``b`` for all points with a likely partner in
    another component; and, but for ``points``, with ``pair`` the likeliest pairs that join the components of a node, one less than there are
    components at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            sizes, x = _struct_list(batch.column(1))
            begin = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 1]).tolist():
                i, j = np.triu_indices(size, 1)
                at_once = max(1, 100_000 // len(i))
                same = np.flatnonzero(sizes == size)
                for g in range(0, len(same), at_once):
                    base = begin[same[g : g + at_once], None]
                    left, right = (base + i).ravel(), (base + j).ravel()
                    low, high = np.minimum(x["n"][left], x["n"][right]), np.maximum(x["n"][left], x["n"][right])
                    ok = (x["comp"][left] != x["comp"][right]) & (low * den >= high * num)
                    left, right = left[ok], right[ok]
                    near = (x["sketch"][left] == x["sketch"][right]).mean(axis=1)
                    left, right, near = left[near >= least], right[near >= least], near[near >= least]
                    at = np.unique(np.concatenate([left, right]))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[np.searchsorted(begin, at, side="right") - 1]), pa.array(x["id"][at]), pa.array(np.zeros(len(at), bool))], names=["a", "b", "pair"])
                    if points:
                        continue
                    left, right = _likeliest(left, right, near, x["comp"], begin)
                    u, v = x["id"][left], x["id"][right]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(np.ones(len(u), bool))], names=["a", "b", "pair"])

    return groups.select("node", "points").mapInArrow(tidied(work), "a long, b long, pair boolean")


def _against_pivots(rows: DataFrame, num: int, den: int, least: float) -> DataFrame:
    """For each row of a large node, ``a`` (the row) and ``b`` (a pivot) for its pivots of other components: all that may reach the threshold
    where ``every`` says so, else the most alike; and one row with ``near``, its mean similarity to the pivots."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, ids, comps, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, COORDS)
            every = batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
            salts = batch.column(6).to_numpy(zero_copy_only=False)
            sizes, x = _struct_list(batch.column(7))
            row = np.repeat(np.arange(len(ids)), sizes)
            near = (sketch[row] == x["sketch"]).mean(axis=1)
            low, high = np.minimum(n[row], x["n"]), np.maximum(n[row], x["n"])
            at = np.flatnonzero((comps[row] != x["comp"]) & (low * den >= high * num) & (near >= least))
            at = at[np.lexsort((x["id"][at], -near[at], row[at]))]
            at = at[(np.diff(row[at], prepend=-1) != 0) | every[row[at]]]
            other = np.bincount(row, near * (ids[row] != x["id"]), len(ids)) / np.maximum(np.bincount(row, ids[row] != x["id"], len(ids)), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([node[row[at]], node])),
                    pa.array(np.concatenate([ids[row[at]], ids])),
                    pa.array(np.concatenate([x["id"][at], np.full(len(ids), -1, np.int64)])),
                    pa.array(np.concatenate([salts[row[at]], np.ones(len(ids), np.int64)])),
                    pa.array(np.concatenate([np.ones(len(at)), other])),
                    pa.array(np.concatenate([np.ones(len(at), bool), np.zeros(len(ids), bool)])),
                ],
                names=["node", "a", "b", "salts", "near", "pair"],
            )

    return rows.select("node", "id", "comp", "n", "sketch", "every", "salts", "pivots").mapInArrow(tidied(work), "node long, a long, b long, salts long, near double, pair boolean")


def _cell_links(ids: np.ndarray, comps: np.ndarray, rest: np.ndarray, n: np.ndarray, tokens: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join the components of one cell: between a point of its block of ``rest`` and one of the other.

    A link shares ``num / den`` of each of its sets at least, and only tokens that stand in both blocks and in several components can be
    shared by one.  Points that have too few of them are left out, with their tokens, until none is; the others are counted pair by pair.
    """
    point = np.repeat(np.arange(len(n), dtype=np.int32), n)
    comp = np.unique(comps, return_inverse=True)[1].astype(np.int32)
    order = np.argsort(tokens, kind="stable")
    tokens, point = tokens[order], point[order]
    del order
    left = 0
    while len(tokens):
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        of_comp, of_rest = comp[point], rest[point]
        useful = (np.minimum.reduceat(of_comp, starts) < np.maximum.reduceat(of_comp, starts)) & np.logical_or.reduceat(of_rest, starts) & ~np.logical_and.reduceat(of_rest, starts)
        keep = np.repeat(useful, np.diff(starts, append=len(tokens)))
        held = np.bincount(point[keep], minlength=len(n))
        alive = (held * den >= num * n) & (n > 0)
        keep &= alive[point]
        tokens, point = tokens[keep], point[keep]
        if int(alive.sum()) == left:
            break
        left = int(alive.sum())
    if not len(tokens):
        return []
    row = np.unique(point)
    a, b = row[rest[row]], row[~rest[row]]
    place = np.zeros(len(n), np.int32)
    place[row] = np.arange(len(row))
    number = np.cumsum(np.concatenate([[0], tokens[1:] != tokens[:-1]]))
    at_a, at_b = place[a], place[b]
    both = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(number[-1]) + 1, 1024):
        lo, hi = np.searchsorted(number, [first, first + 1024])
        dense = np.zeros((len(row), min(1024, int(number[-1]) + 1 - first)), np.float32)
        dense[place[point[lo:hi]], number[lo:hi] - first] = 1
        both += dense[at_a] @ dense[at_b].T
    label, out = np.arange(int(comp.max()) + 1), []
    for i in range(len(a)):
        linked = np.flatnonzero((den + num) * both[i].astype(np.int64) >= num * (n[a[i]] + n[b]))
        of, first = np.unique(label[comp[b[linked]]], return_index=True)
        mine = label[comp[a[i]]]
        for c, j in zip(of.tolist(), linked[first].tolist(), strict=True):
            if c != mine:
                label[label == c] = mine
                out.append((int(ids[a[i]]), int(ids[b[j]])))
    return out


def _links_in_cells(cells: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """``a``, ``b``: links between components, of each cell as many as it takes to join them, decided on full sets.

    A cell holds one block of the points outside the largest component of a node (``rest``) and one block of all its points.  Cells are
    dealt out by their number, not by bytes, and a task takes its cells one after another.
    """

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        ids, comps, rest = (table.column(c).to_numpy() for c in ("id", "comp", "rest"))
        column = table.column("set").combine_chunks()
        n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = _cell_links(ids, comps, rest, n, column.flatten().to_numpy(), num, den) if rest.any() and not rest.all() else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("node", "i", "j")])
            starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and tuple(key[:, begin]) != last:
                    yield links(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = tuple(key[:, begin])
        if held:
            yield links(held)

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.few(cells).select("node", "i", "j", "id", "comp", "rest", "set")  # without the select Spark drops the few before a repartition
    return scratch.few(rows.repartition(n, "node", "i", "j")).sortWithinPartitions("node", "i", "j").mapInArrow(tidied(work), "a long, b long")


class _Join:
    """One run: the points' sketches and full sets as tables, and the components that links have made so far."""

    def __init__(self, scratch: Scratch, sketch: DataFrame, sets: DataFrame, num: int, den: int):
        self.scratch, self.sketch, self.sets, self.num, self.den = scratch, sketch, sets, num, den
        self.comps: DataFrame | None = None

    def with_components(self, rows: DataFrame) -> DataFrame:
        if self.comps is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(self.comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows (node, id, comp) of the nodes that hold several components, with the size of the node."""
        rows = self.scratch.few(self.with_components(rows))
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return rows.join(self.scratch.few(sizes.select("node", "size")), "node")

    def listed(self, rows: DataFrame) -> DataFrame:
        """The ``points`` of each small node of rows (node, id, comp) that holds several components."""
        point = F.struct("id", "comp", "n", "sketch")
        lists = self.scratch.few(rows.join(self.sketch, "id")).groupBy("node").agg(F.collect_list(point).alias("points"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return self.scratch.few(lists.where("lo < hi").select("node", "points"))

    def confirm(self, pairs: DataFrame) -> None:
        """Add the pairs (``a``, ``b``, ``salts``) whose full sets reach the threshold.

        The set of ``b``, which may stand in very many pairs, is handed to ``salts`` places; the sets themselves lie in buckets by id, so
        that only those of pairs are shuffled, and each pair is decided in the JVM.
        """
        if not pairs.limit(1).count():
            return
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
        few = self.scratch.few
        left = pairs.select("a", "b", "salt").join(self.sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
        hubs = few(pairs.groupBy("b").agg(F.collect_set("salt").alias("salt"))).join(self.sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").withColumn("salt", F.explode("salt"))
        reaches = (self.den + self.num) * F.size(F.array_intersect("x", "y")) >= self.num * (F.size("x") + F.size("y"))
        self.add(few(left).join(few(hubs), ["b", "salt"]).where(reaches).select("a", "b"))

    def add(self, found: DataFrame) -> None:
        """Join the components that new links connect; only links between components are looked at."""
        scratch = self.scratch
        found = scratch.step(found, "links")
        most = found.count()
        if not most:
            return
        if self.comps is None:
            self.comps = scratch.step(components(found, scratch, most=most), "comps")
            return
        comps = self.comps
        of_a = found.join(comps.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
        of_b = of_a.join(comps.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        merged = components(of_b.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), scratch, most=most)
        moved = comps.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
        self.comps = scratch.step(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(merged), "comps")

    def against(self, large: DataFrame, pivots: DataFrame, least: float) -> DataFrame:
        """Rows of large nodes (node, id, comp, every, salts) held against the pivots (node, id, comp) of their nodes."""
        few = self.scratch.few
        lists = few(few(pivots.join(self.sketch, "id")).groupBy("node").agg(F.collect_list(F.struct("id", "comp", "n", "sketch")).alias("pivots")))
        return self.scratch.step(_against_pivots(few(few(large.join(self.sketch, "id")).join(lists, "node")), self.num, self.den, least), "near")


def _pairs_of(near: DataFrame) -> DataFrame:
    return near.where("pair").groupBy("a", "b").agg(F.max("salts").alias("salts"))


def _sized(rows: DataFrame, leaf: int, scratch: Scratch) -> DataFrame:
    """Rows (node, id, comp) of the nodes that hold several components, with the ``size`` of the node and, if that is above ``leaf``, its
    largest component ``top`` and the number of its points (``most``)."""
    sizes = scratch.few(rows.groupBy("node", "comp").agg(F.count("*").alias("c"))).groupBy("node")
    sizes = sizes.agg(F.count("*").alias("several"), F.sum("c").alias("size"), F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("most")).where("several > 1")
    large = lambda c: F.when(F.col("size") > leaf, F.col(c)).alias(c)
    return rows.join(scratch.few(sizes.select("node", "size", large("top"), large("most"))), "node")


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    num: int = 80,
    den: int = 100,
    trees: int = 4,
    leaf: int = 256,
    max_level: int = 8,
    block_points: int = 2048,
    block_shingles: int = 1_500_000,
    bucket_shingles: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable over links of at least ``num / den``) of every document."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be whole numbers")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spread = (num / den * (1 - num / den) / COORDS) ** 0.5
    least = num / den - 6 * spread

    sketches = scratch.cut(_sketch(base, k, trees), "sketches")
    count = sketches.count()
    scratch.tasks = max(2 * spark.sparkContext.defaultParallelism, count // TASK_ROWS)
    named = sketches.where("n > 0 and doc_id is not null")
    members = named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("roots").alias("roots"))
    points = scratch.cut(members.select("id", "n", "s1", "s2", "sketch", "roots"), "points")

    # Each point is a component of its own yet.
    frontier = points.select(F.explode("roots").alias("node"), "id", F.col("id").alias("comp"))
    shared = frontier.groupBy("node").agg(F.count("*").alias("size"), F.max("id").alias("top")).where("size > 1")
    above = F.col("size") > leaf
    shared = shared.select("node", "size", F.when(above, F.col("top")).alias("top"), F.when(above, F.lit(1).cast("long")).alias("most"))
    rows = scratch.step(frontier.join(shared, "node"), "open")
    sketch = scratch.cut(points.select("id", "n", "sketch").join(rows.select("id"), "id", "left_semi"), "live")
    live = sketch.select("id")
    of_point = points.select("id", "n", "s1", "s2")

    def to_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(np.concatenate(sets)))], names=["id", "set"])

    total = sketch.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_shingles + 1)
    mine = base.repartition(buckets, "doc_id").join(live.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    sets = scratch.bucketed(scratch.few(mine).mapInArrow(tidied(to_set), "id long, set array<long>"), "sets", buckets, "id")
    scratch.release()
    run = _Join(scratch, sketch, sets, num, den)
    level = 0
    while True:
        small = scratch.step(_within(run.listed(rows.where(F.col("size") <= leaf)), num, den, least), "small")
        large = rows.where(F.col("size") > leaf).withColumn("every", F.col("size") - F.col("most") <= MOST_PIVOTS).withColumn("salts", F.ceil(F.col("size") / 256))
        likely, near = small.select("a", "b", "pair", F.lit(1).cast("long").alias("salts")), None
        if large.limit(1).count():
            outside = large.where("every and comp <> top").select("node", "id", "comp")
            seeds = [F.min(F.struct(F.xxhash64(F.lit(s), F.col("id")).alias("h"), F.col("id").alias("id"), F.col("comp").alias("comp"))).alias(f"p{s}") for s in range(4)]
            drawn = large.where("not every").groupBy("node").agg(*seeds).select("node", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"p{s}.id").alias("id"), F.col(f"p{s}.comp").alias("comp")) for s in range(4)]))).alias("p"))
            near = run.against(large, outside.unionByName(scratch.few(drawn.select("node", "p.id", "p.comp"))), least)
            likely = likely.unionByName(near.select("a", "b", "pair", "salts"))
        run.confirm(scratch.step(_pairs_of(likely), "pairs"))
        # What the likeliest pairs of small nodes have not joined is decided on full sets, if a sketch leaves it open at all.
        doubtful = run.with_components(small.where("not pair").select(F.col("a").alias("node"), F.col("b").alias("id")))
        doubtful = _within(run.listed(doubtful), num, den, least, points=True).select(F.col("a").alias("node"), F.col("b").alias("id"))
        sparse = None
        if near is not None:
            # A node of mean similarity of one half or more would not shrink by branching; neither would what is still there after the last
            # level; and from the second level on, one cell holds the node.
            dense = near.where("not pair").groupBy("node").agg(((F.avg("near") >= 0.5) | F.lit(level >= max_level) | ((F.count("*") <= block_points) & F.lit(level > 0))).alias("dense"))
            left = scratch.step(run.open(large.where("not every").select("node", "id")).join(scratch.few(dense), "node"), "left")
            sparse = left.where("not dense").select("node", "id")
            heavy = left.where("dense")
            # A level costs the same for few rows as for many: sparse nodes whose cells would hold few rows beside the table are done at once.
            blocks = 2 * F.ceil(F.col("size") / block_points)
            if 0 < (left.where("not dense").agg(F.sum(blocks)).first()[0] or 0) <= count // 2:
                sparse, doubtful = None, doubtful.unionByName(left.select("node", "id"))
            else:
                doubtful = doubtful.unionByName(heavy.select("node", "id"))
            heavy = heavy.where(F.col("size") > block_points)
            if heavy.limit(1).count():
                # The points that are most like others are those that others are linked to: as pivots they join nearly all that can be joined.
                seen = near.where("not pair").select("node", F.struct("near", F.col("a").alias("id")).alias("c"))
                quarter = F.pmod(F.xxhash64(F.lit(5), F.col("c.id")), F.lit(4))
                best = seen.groupBy("node").agg(F.array_compact(F.array(*[F.max(F.when(quarter == q, F.col("c"))) for q in range(4)])).alias("best"))
                pivots = heavy.select("node", "id", "comp").join(scratch.few(best.select("node", F.explode("best.id").alias("id"))), ["node", "id"], "left_semi")
                again = heavy.select("node", "id", "comp", F.lit(True).alias("every"), F.ceil(F.col("size") / 256).alias("salts"))
                run.confirm(scratch.step(_pairs_of(run.against(again, pivots, least)), "pairs"))
        doubtful = scratch.step(doubtful, "doubtful")
        waves = 2 if level == 0 else 1  # the same points share several nodes at first: what one gives spares the others work
        for wave in range(waves):
            mine = doubtful.where(F.pmod(F.xxhash64(F.lit(7), F.col("node")), F.lit(waves)) == wave)
            cells = scratch.step(_blocks(scratch.few(run.with_components(mine).join(sketch.select("id", "n"), "id")), block_points, block_shingles, scratch), "cells")
            if cells.limit(1).count():
                run.add(_links_in_cells(_cells(cells).join(sets, "id"), num, den, scratch))
        scratch.release()
        if sparse is None or not sparse.limit(1).count():
            break
        byte = lambda c: F.substring("sketch", c + 1, 1)
        first = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.lit(COORDS)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.lit(COORDS - 1)).cast("int"), F.lit(COORDS))
        child = F.explode(F.array(*[F.xxhash64("node", c, byte(c)) for c in (first, second)]))
        children = run.with_components(sparse).join(sketch, "id").select(child.alias("node"), "id", "comp")
        frontier = scratch.step(children, "frontier")
        scratch.sweep(frontier, run.comps)
        rows = scratch.step(_sized(frontier, leaf, scratch), "open")
        level += 1

    if run.comps is not None:
        of_point = of_point.join(run.comps, "id", "left").select("n", "s1", "s2", F.coalesce("component", "id").alias("component"))
    else:
        of_point = of_point.select("n", "s1", "s2", F.col("id").alias("component"))
    out = sketches.select("doc_id", "n", "s1", "s2").distinct().join(of_point, ["n", "s1", "s2"], "left")
    out = scratch.cut(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")), "groups")
    # An id with several texts ties the groups that its texts are in.
    lows = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").select("doc_id", "lo")
    lows = scratch.step(lows, "lows")
    if lows.limit(1).count():
        tied = components(out.join(lows, "doc_id").select(F.col("component_id").alias("a"), F.col("lo").alias("b")).distinct(), scratch)
        out = out.join(tied.select(F.col("id").alias("component_id"), "component"), "component_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))
    return scratch.last(out)


def _blocks(rows: DataFrame, block_points: int, block_shingles: int, scratch: Scratch) -> DataFrame:
    """Rows (node, id, comp) of the nodes that hold several components, with the largest one (``top``) and the numbers of blocks: ``ni`` of
    the points outside it, ``nj`` of all points."""
    top = scratch.few(rows.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))).groupBy("node")
    top = top.agg(F.count("*").alias("several"), F.max_by("comp", F.struct("c", "comp")).alias("top"), (F.sum("c") - F.max("c")).alias("c"), F.sum("c").alias("all_c"), (F.sum("s") - F.max_by("s", F.struct("c", "comp"))).alias("s"), F.sum("s").alias("all_s"))
    blocks = lambda c, s: F.ceil(F.greatest(F.col(c) / block_points, F.col(s) / block_shingles)).cast("int")
    top = top.where("several > 1").select("node", "top", blocks("c", "s").alias("ni"), blocks("all_c", "all_s").alias("nj"))
    return rows.select("node", "id", "comp").join(scratch.few(top), "node")


def _cells(each: DataFrame) -> DataFrame:
    """node, i, j, id, comp, rest: each block of the points outside a node's largest component beside each block of all its points."""
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.col(n)).cast("int")
    every = each.select("node", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), block(9, "nj").alias("j"), "id", "comp", F.lit(False).alias("rest"))
    rest = each.where("comp <> top").select("node", block(10, "ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "id", "comp", F.lit(True).alias("rest"))
    return every.unionByName(rest)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id; documents without an id stay."""
    groups = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, **options)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
