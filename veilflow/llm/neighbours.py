"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Start: a few rounds deal the vectors into cells by random projections, each cell halved about its own median, so that dense clusters
are divided as finely as they are full; inside a cell every vector keeps its best ``degree`` others.  Only what medians cannot divide
(more than two cells of vectors equal in 32 bits, or what a bounded sample misses) is split by a hash of the id.  Descent: for each
vertex its neighbours, and as many vertices that name it, meet in one row by Spark joins and are compared with each other; a pair
becomes a candidate where it beats the worst neighbour that a vertex has; this is repeated until fewer than a share ``delta`` of all
edges are new.  Search: a query walks from its own vertex, expands the best unexpanded vertices, scores their neighbours, and keeps the
best, until none of the best is unexpanded; the last list is scored in double precision on the original vectors.

Equal vectors are one vertex with its ``k + 1`` least ids, which is all that any answer can name.  Nothing is broadcast but the random
projections and their medians (from a bounded sample).  Sizes of joined rows are bounded by ``degree``; vectors travel as 32-bit
floats, divided by one power of two that brings the largest component of all to 1 at most, until the final scores; so lengths of vectors
may differ by a factor of about 10^18 before the shorter ones' products with each other vanish.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as candidates or as queries;
vectors of another dimension than the most frequent one (of ties, the least) are left out; ties go to the smaller id; rows that repeat an
id and vector are one; an id with two vectors asks with both and is not its own neighbour; other columns are ignored, whatever their names; with fewer candidates than ``k`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilflow.llm.scratch import Scratch, drop_frame

GRAPH = "id long, ids binary, scores binary"


def usable(vector: Column) -> Column:
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(values, lambda x: x != 0)


def _unpack(column: pa.ChunkedArray, kind: type, width: int | None = None) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat if width is None else flat.reshape(-1, width)


def _top(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` different others of each owner, owners in order, best first."""
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    # The same pair may come with scores that differ in the last bit: keep its first place.
    pair = np.lexsort((np.arange(len(owner)), other, owner))
    same = (np.diff(owner[pair], prepend=-1) == 0) & (np.diff(other[pair], prepend=-1) == 0) & (np.arange(len(pair)) > 0)
    keep = np.ones(len(owner), bool)
    keep[pair[same]] = False
    owner, other, score = owner[keep], other[keep], score[keep]
    first = np.flatnonzero(np.diff(owner, prepend=-1 if not len(owner) else owner[0] - 1))
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    keep = place < k
    return owner[keep], other[keep], score[keep]


def _lists(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.Table:
    first = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(owner))
    score = score.astype(np.float32)
    return pa.table(
        {
            "id": pa.array(owner[first], pa.int64()),
            "ids": pa.array([other[a:b].astype(np.int64).tobytes() for a, b in zip(first, ends[: len(first)], strict=True)], pa.binary()),
            "scores": pa.array([score[a:b].tobytes() for a, b in zip(first, ends[: len(first)], strict=True)], pa.binary()),
        }
    )


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
    owner = np.repeat(table.column("id").to_numpy(), [len(x) for x in ids])
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return owner, np.concatenate(ids), _unpack(table.column("scores"), np.float32)


def _bucketed(df: DataFrame, key: str, n: int, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Groups of rows by a hash of ``key``, ``n`` of them, so that one call handles many keys."""
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).groupBy("_bucket").applyInArrow(lambda t: work(t.drop_columns(["_bucket"])), schema)


def _halvings(total: int, cell: int) -> int:
    return max(0, int(np.ceil(np.log2(max(total / cell, 1)))))


def _leaves(heights: np.ndarray, medians: list[np.ndarray]) -> np.ndarray:
    """The leaf that each row of ``heights`` (one column for each level) falls to, if every node is halved about its own median."""
    leaf = np.zeros(len(heights), np.int64)
    for level, cuts in enumerate(medians):
        leaf = 2 * leaf + (heights[:, level] > cuts[leaf])
    return leaf


def _medians(heights: np.ndarray) -> list[np.ndarray]:
    """For each level the medians of its nodes, by node; an empty node has that of all rows."""
    medians: list[np.ndarray] = []
    for level in range(heights.shape[1]):
        leaf, at = _leaves(heights, medians), heights[:, level]
        cuts = np.full(1 << level, np.median(at), np.float32)
        order = np.argsort(leaf, kind="stable")
        nodes, first = np.unique(leaf[order], return_index=True)
        for node, rows in zip(nodes, np.split(order, first[1:]), strict=True):
            cuts[node] = np.median(at[rows])
        medians.append(cuts)
    return medians


def _merged(lists: DataFrame, n: int, k: int) -> DataFrame:
    return _bucketed(lists, "id", n, lambda t: _lists(*_top(*_flat(t), k)), GRAPH)


def _merged_anew(old: DataFrame, found: DataFrame, n: int, k: int) -> DataFrame:
    """As _merged(), with the number of each list's entries that ``old`` does not have."""

    def work(table: pa.Table) -> pa.Table:
        known = table.filter(table.column("known"))
        owner, other, score = _top(*_flat(table), k)
        before, named, _ = _flat(known)
        a, b, late = np.concatenate([before, owner]), np.concatenate([named, other]), np.repeat([0, 1], [len(before), len(owner)])
        order = np.lexsort((late, b, a))
        again = (np.diff(a[order], prepend=-1) == 0) & (np.diff(b[order], prepend=-1) == 0) & (np.arange(len(order)) > 0)
        ids, at = np.unique(a[order[(late[order] == 1) & ~again]], return_counts=True)
        lists = _lists(owner, other, score)
        counts = dict(zip(ids.tolist(), at.tolist(), strict=True))
        return lists.append_column("fresh", pa.array([counts.get(i, 0) for i in lists.column("id").to_pylist()], pa.int64()))

    both = old.withColumn("known", F.lit(True)).unionByName(found.withColumn("known", F.lit(False)))
    return _bucketed(both, "id", n, work, GRAPH + ", fresh long")


def build_graph(vertices: DataFrame, scratch: Scratch, degree: int = 24, rounds: int = 12, delta: float = 0.001, cell: int = 5000, seed: int = 3) -> DataFrame:
    """``id``, its best ``degree`` others (packed longs, best first) and their scores (packed 32-bit floats).

    ``vertices``: unique ``id`` and ``v``, a vector of 32-bit floats as bytes.
    """
    total = vertices.count()
    first = vertices.select("v").first()
    if first is None or total < 2:
        return scratch.spark.createDataFrame([], GRAPH)
    dim = len(first["v"]) // 4
    bits = _halvings(total, cell)
    rounds = rounds if bits else 1  # one cell is the same in every round
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((rounds, bits, dim)).astype(np.float32)
    room = min(max(4000, 32 << bits), max(4000, (64 << 20) // (4 * dim)))  # a few vectors of each last cell, 64 MB at most
    sample = [np.frombuffer(r["v"], np.float32) for r in vertices.orderBy(F.xxhash64(F.lit(seed), "id")).limit(room).select("v").collect()]
    sample = np.stack(sample)
    medians = [_medians(sample @ planes[r].T) for r in range(rounds)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim)
            for r in range(rounds):
                leaf = _leaves(x @ planes[r].T, medians[r])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf * rounds + r), batch.column(1)], names=["id", "cell", "v"])

    dealt = vertices.select("id", "v").mapInArrow(code, "id long, cell long, v binary")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / (2 * cell)).cast("int").alias("parts"))  # a cell for each few thousand vectors and round
    dealt = dealt.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("cell", "id"), F.col("parts")).cast("int"))

    def best_in_cell(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        x = _unpack(table.column("v"), np.float32, dim)
        k = min(degree, len(ids) - 1)
        out = []
        for a in range(0, len(ids) if k > 0 else 0, 512):
            s = x[a : a + 512] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(ids[a : a + 512], k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel()))
        if not out:
            return _lists(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        owner, other, score = (np.concatenate([o[i] for o in out]) for i in range(3))
        return _lists(*_top(owner, other, score, k))

    n = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), total // 2000 + 1)
    lists = dealt.select("id", "cell", "part", "v").groupBy("cell", "part").applyInArrow(best_in_cell, GRAPH)
    graph = scratch.step(_merged(lists, n, degree), "graph")

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, other, score = _flat(pa.Table.from_batches([batch]))
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(other), pa.array(score.astype(np.float64))], names=["a", "b", "s"])

    def nearest_namers(table: pa.Table) -> pa.Table:
        """Of the vertices that name a vertex, the ``degree`` nearest."""
        owner, other, _ = _top(*(table.column(c).to_numpy() for c in ("b", "a", "s")), degree)
        return pa.table({"v": pa.array(owner, pa.int64()), "u": pa.array(other, pa.int64())})

    def local_join(table: pa.Table) -> pa.Table:
        at, ids = table.column("at").to_numpy(), table.column("id").to_numpy()
        worst = table.column("worst").to_numpy()
        x = _unpack(table.column("v"), np.float32, dim)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        out = []
        for rows in np.split(order, cuts[1:]):
            if len(rows) > 1:
                s = x[rows] @ x[rows].T
                i, j = np.nonzero((s > worst[rows][:, None]) & (ids[rows][:, None] != ids[rows][None, :]))
                out.append((ids[rows[i]], ids[rows[j]], s[i, j]))
        if not out:
            return _lists(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        owner, other, score = (np.concatenate([o[i] for o in out]) for i in range(3))
        return _lists(*_top(owner, other, score, degree))

    fresh, edges = 1, 0
    while fresh > delta * edges:  # lists only get better, so that this ends
        named = graph.mapInArrow(edges_of, "a long, b long, s double")
        forward = named.select(F.col("a").alias("v"), F.col("b").alias("u"))
        # A vertex that very many name is cut to its nearest namers in two steps, so that no task gets them all.
        partly = named.withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(16)).cast("int")).withColumn("_bucket", F.pmod(F.xxhash64("b", "_salt"), F.lit(n)).cast("int"))
        partly = partly.select("a", "b", "s", "_bucket", "_salt").groupBy("_bucket", "_salt").applyInArrow(lambda t: _scored_namers(t, degree), "a long, b long, s double")
        backward = _bucketed(partly, "b", n, nearest_namers, "v long, u long")
        near = forward.unionByName(backward).distinct().select(F.col("v").alias("at"), F.col("u").alias("id"))
        own = graph.mapInArrow(_worst(degree), "id long, worst float")
        loaded = vertices.select("id", "v").join(own, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
        found = _bucketed(near.join(loaded, "id").select("at", "id", "worst", "v"), "at", 4 * n, local_join, GRAPH)
        better = scratch.step(_merged_anew(graph, found, n, degree), "graph")
        fresh, edges = better.agg(F.coalesce(F.sum("fresh"), F.lit(0)), F.coalesce(F.sum(F.length("scores") / 4), F.lit(0))).first()
        drop_frame(scratch, graph)
        graph = better.select("id", "ids", "scores")
        scratch.release()
    return graph


def _scored_namers(table: pa.Table, degree: int) -> pa.Table:
    owner, other, score = _top(*(table.column(c).to_numpy() for c in ("b", "a", "s")), degree)
    return pa.table({"a": pa.array(other, pa.int64()), "b": pa.array(owner, pa.int64()), "s": pa.array(score, pa.float64())})


def _worst(degree: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x[-1]) if len(x) >= degree else float("-inf") for x in scores], pa.float32())], names=["id", "worst"])

    return work


def search(vectors: DataFrame, is_query: Column, k: int = 20, degree: int = 24, rounds: int = 12, delta: float = 0.001, width: int = 48, id_col: str = "vec_id", vector_col: str = "embedding", cell: int = 5000) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found among all other rows for each row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("asks"))
    dims = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = scratch.cut(rows.where(F.size("x") == dims["d"]).distinct(), "rows")
    # Equal vectors: in two steps, so that a vector that a third of all rows share is no row of its own size.
    parts = rows.groupBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(1024)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("some"))
    same = parts.groupBy("x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some"))), 1, k + 1).alias("members"))
    vertices = same.select(F.element_at("members", 1).alias("id"), "members", "x")

    largest = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c))))).first()[0]
    down = -int(np.frexp(largest or 1.0)[1])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims["d"])
            x = np.ldexp(x, down).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "members", "x", "v"])

    vertices = scratch.cut(vertices.mapInArrow(packed, "id long, members array<long>, x array<double>, v binary"), "vertices")
    graph = build_graph(vertices, scratch, degree, rounds, delta, cell)
    width += 16 * _halvings(vertices.count(), cell)  # the more vectors, the more lists a query has to walk through

    asks = rows.where("asks").select("vec_id", "x").join(vertices.select("x", "id"), "x").select(F.col("vec_id").alias("q"), "id").distinct()
    homes = scratch.cut(asks.select("id").distinct().join(vertices.select("id", F.col("v").alias("qv")), "id"), "homes")
    dim = dims["d"]

    def explode_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64), pa.int64())], names=["h", "id"])

    def expand(frontier: DataFrame) -> DataFrame:
        """(h, id): neighbours of the vertices that a home expands."""
        met = frontier.join(graph.select("id", "ids"), "id").select("h", "ids")
        return met.mapInArrow(explode_lists, "h long, id long").where("h <> id").distinct()

    def score(pairs: DataFrame) -> DataFrame:
        with_vectors = pairs.join(vertices.select("id", "v"), "id").join(homes.select(F.col("id").alias("h"), "qv"), "h").select("h", "id", "v", "qv")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.float32).reshape(-1, dim) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(1).astype(np.float64))], names=["h", "id", "s"])

        return with_vectors.mapInArrow(work, "h long, id long, s double")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keep_best(table: pa.Table) -> pa.Table:
        """The best ``width`` of each home; a vertex that was expanded once stays so."""
        h, i, s, done = (table.column(c).to_numpy(zero_copy_only=False) for c in ("h", "id", "s", "done"))
        seen = {(int(a), int(b)) for a, b, d in zip(h, i, done, strict=True) if d}
        h, i, s = _top(h, i, s, width)
        return pa.table({"h": pa.array(h, pa.int64()), "id": pa.array(i, pa.int64()), "s": pa.array(s, pa.float64()), "done": pa.array([(int(a), int(b)) in seen for a, b in zip(h, i, strict=True)], pa.bool_())})

    frontier = homes.select(F.col("id").alias("h"), "id")
    found = None
    while not frontier.isEmpty():  # the worst of the best never falls, so that no vertex is expanded twice
        new = score(expand(frontier)).withColumn("done", F.lit(False))
        pool = new if found is None else found.withColumn("done", F.lit(True)).unionByName(new)
        last, found = found, scratch.step(_bucketed(pool.select("h", "id", "s", "done"), "h", n, keep_best, "h long, id long, s double, done boolean"), "found")
        if last is not None:
            drop_frame(scratch, last)
        frontier = found.where("not done").select("h", "id")
    if found is None:
        return scratch.last(spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"))
    final = found.select("h", "id").unionByName(homes.select(F.col("id").alias("h"), "id"))
    scored = final.join(vertices.select("id", "members", "x"), "id").join(vertices.select(F.col("id").alias("h"), F.col("x").alias("qx")), "h")
    dot = F.aggregate(F.zip_with("x", "qx", lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
    scored = scored.select("h", "members", dot.alias("score"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every = sorted({(-h["score"], m) for h in hits for m in h["members"] if m != q})[:k]
                out.extend((q, r, m, -s) for r, (s, m) in enumerate(every, 1))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    hits = scored.groupBy("h").agg(F.collect_list(F.struct("members", "score")).alias("hits"))  # width + 1 at most
    answers = asks.select("q", F.col("id").alias("h")).join(hits, "h").select("q", "hits").mapInArrow(ranked, "query_id long, rank int, vec_id long, score double")
    return scratch.last(answers)
