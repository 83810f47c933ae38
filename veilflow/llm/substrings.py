"""Removal of word sequences that stand more than once in a corpus, by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document.  Every window whose words also start anywhere else is repeated; all words
that a repeated window covers go.

Three passes, none of which holds more than a bounded piece of the corpus in one task:

1. Anchors.  In each window the k-word run with the least hash (the leftmost of equals) is its anchor: a part of the window's own
   prefix, at a variable distance from its start, and the same wherever the window stands.  Tasks count anchors in batches; anchors
   that stand once in the corpus cannot lie in a repeated window.  The others set bits in a filter of fixed size, which is the only
   thing broadcast; if it fills up, more suffixes travel and the result stays the same.
2. Suffixes.  Suffixes that start at windows with a marked anchor are dealt into groups by that anchor, as runs of 32-bit words, and
   the number of groups follows from the counted suffixes, so that a group fits in memory.  An anchor that begins more than
   ``hot_windows`` suffixes (counted in pass 1, kept in a second filter of fixed size) is too short a prefix to deal by: its suffixes go
   by all their ``length`` words, so that a phrase in very many contexts is spread over the groups.  Within a batch equal windows are found
   at once and sent once, so a window that a third of the corpus shares adds one suffix per batch to its group, not one per copy.
3. Subtrees.  Each group orders its suffixes by doubling ranks (1, 2, 4, ... words), which is its suffix tree level by level down to
   ``length`` words; inner nodes that deep are the repeats.  Their leaves go back to the documents.

Defined results: a null text has no words and stays null; a text with fewer words than a window keeps them all; rows with equal texts
repeat each other, equal ids or not, and a null id is an id; an empty table gives an empty result; other columns are ignored or kept,
whatever their names (those that begin with an underscore are reserved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.scratch import Scratch, give_back, small_batches, tidied
from veilflow.llm.words import pieces, text_buffers, window_hashes, word_bounds, word_hashes

#: Words of an anchor, bits of the anchor filter and of that of hot anchors, bytes of text that a task works on at once, suffixes of a
#: group, and suffixes beyond which an anchor is hot.
ANCHOR_WORDS = 8
FILTER_BITS = 27
HOT_BITS = 22
BATCH_BYTES = 4 << 20
GROUP_SUFFIXES = 400_000
HOT_WINDOWS = GROUP_SUFFIXES // 4
_EMPTY = np.empty(0, np.int64)


def _batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of about BATCH_BYTES of text with the hashes of their words, the rows' word offsets and the rows' columns."""
    held, size = [], 0
    for piece in pieces(batches, text):
        column = piece.column(piece.schema.get_field_index(text))
        data, offsets = text_buffers(column)
        starts, ends, words = word_bounds(data, offsets)
        held.append((piece.drop_columns([text]), word_hashes(data, starts, ends), np.diff(words)))
        size += len(data)
        if size >= BATCH_BYTES:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    counts = np.concatenate([x[2] for x in held])
    return pa.Table.from_batches([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _window_anchors(hashes: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the document of each, and the start of each window's anchor."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    if not len(docs):
        return _EMPTY, _EMPTY, _EMPTY
    first = np.cumsum(counts) - counts
    starts = np.arange(len(docs)) - first[docs] + offsets[:-1][docs]
    grams = window_hashes(hashes, k)
    # Sliding minimum over length - k + 1 runs by doubling, the position packed below the hash so that the leftmost of equals wins.
    span = length - k + 1
    order = (grams >> np.uint64(1)).astype(np.int64)
    at = np.arange(len(order))
    best, width = at, 1
    while width * 2 <= span:
        a, b = best[:-width], best[width:]
        best = np.where(order[b] < order[a], b, a)
        width *= 2
    rest = span - width
    a = best[: len(best) - rest] if rest else best
    if rest:
        b = best[rest:]
        best = np.where(order[b] < order[a], b, a)
    return starts, docs, best[starts]


def _filter_slots(grams: np.ndarray, size: int = FILTER_BITS) -> np.ndarray:
    return (grams >> np.uint64(64 - size)).astype(np.int64)


def _marked(bits: np.ndarray, grams: np.ndarray, size: int = FILTER_BITS) -> np.ndarray:
    slots = _filter_slots(grams, size)
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def _anchor_filter(docs: DataFrame, length: int, k: int, n_parts: int, hot_windows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A bit for each anchor that stands twice or more (and for some others, where slots collide), a bit for each that begins more than
    ``hot_windows`` suffixes, and how many suffixes the repeated ones begin."""
    part_bits = (n_parts - 1).bit_length()
    low_bits, hot_bits = FILTER_BITS - part_bits, HOT_BITS - part_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, offsets in _batches(batches, "text"):
            _, _, anchor = _window_anchors(hashes, offsets, length, k)
            if not len(anchor):
                continue
            # An anchor counts once where it stands, however many windows share it; the number of its windows travels along.
            places, windows = np.unique(anchor, return_counts=True)
            grams, index, n = np.unique(window_hashes(hashes, k)[places], return_inverse=True, return_counts=True)
            total = np.bincount(index, windows, len(grams)).astype(np.int64)
            part = _filter_slots(grams) >> low_bits
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(grams))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts], pa.int32()),
                    pa.array([grams[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    pa.array([np.minimum(n[a:b], 2).astype(np.uint8).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                    pa.array([total[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                ],
                names=["part", "grams", "seen", "windows"],
            )

    def merge(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        grams, index = np.unique(join("grams", np.uint64), return_inverse=True)
        repeated = np.bincount(index, join("seen", np.uint8), len(grams)) >= 2
        windows = np.bincount(index, join("windows", np.int32), len(grams))
        part = table.column("part")[0].as_py()
        bits, hot = np.zeros(1 << low_bits, np.uint8), np.zeros(1 << hot_bits, np.uint8)
        bits[_filter_slots(grams[repeated]) - (part << low_bits)] = 1
        hot[_filter_slots(grams[windows > hot_windows], HOT_BITS) - (part << hot_bits)] = 1
        packed = [pa.array([np.packbits(x).tobytes()], pa.binary()) for x in (bits, hot)]
        return pa.table({"part": pa.array([part], pa.int32()), "bits": packed[0], "hot": packed[1], "windows": pa.array([int(windows[repeated].sum())], pa.int64())})

    counted = docs.mapInArrow(tidied(count), "part int, grams binary, seen binary, windows binary")
    # 2 ** FILTER_BITS and 2 ** HOT_BITS bits in all.
    rows = counted.groupBy("part").applyInArrow(merge, "part int, bits binary, hot binary, windows long").collect()
    bits, hot = np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.zeros(1 << (HOT_BITS - 3), np.uint8)
    for r in rows:
        for whole, size, piece in ((bits, 1 << (low_bits - 3), r["bits"]), (hot, 1 << (hot_bits - 3), r["hot"])):
            whole[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(piece, np.uint8)
    return bits, hot, sum(r["windows"] for r in rows)


def subtree_repeats(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of ``words`` that begins at ``starts``, the node at depth ``length`` that it passes, numbered in lexicographic order.

    Ranks of runs of 1, 2, 4, ... words refine each other: level by level the suffix tree of these suffixes, cut at ``length``.
    """
    ranks = np.unique(words, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size * 2 <= length:
        ranks = np.unique(ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:], return_inverse=True)[1]
        size *= 2
    node = ranks[starts]
    if size < length:
        node = np.unique(node * (int(ranks.max()) + 1) + ranks[starts + length - size], return_inverse=True)[1]
    return node


def repeated_starts(docs: DataFrame, length: int, key: str = "row", k: int = ANCHOR_WORDS, hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """``key`` and ``starts`` (32-bit word positions, packed): the starts of repeated windows, in one or more rows per document.

    ``docs`` has a long ``key``, the same only for rows with the same text, and ``text``.
    """
    if not 2 <= k <= length:
        raise ValueError("anchors must be shorter than windows")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).alias("key"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_parts = 1 << max(4, min(12, (2 * parts).bit_length()))
    bits, hot, suffixes = _anchor_filter(docs, length, k, n_parts, hot_windows)
    shared = spark.sparkContext.broadcast((bits, hot))
    n_groups = max(2 * parts, suffixes // GROUP_SUFFIXES + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = shared.value
        for rows, hashes, offsets in _batches(batches, "text"):
            keys = rows.column("key").to_numpy()
            starts, doc, anchor = _window_anchors(hashes, offsets, length, k)
            if not len(starts):
                continue
            grams = window_hashes(hashes, k)
            use = _marked(bits, grams[anchor])
            starts, doc, anchor = starts[use], doc[use], anchor[use]
            if not len(starts):
                continue
            whole = window_hashes(hashes, length)[starts]
            _, first, index, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
            again = n[index] > 1
            out = _by_document(keys, doc[again], starts[again] - offsets[doc[again]])
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(out[0]), pa.int32()), out[0], out[1]], names=["part", "key", "data"])
            one = np.sort(first)  # one suffix for each window of this batch, in order of place
            prefix = grams[anchor[one]]
            prefix = np.where(_marked(hot, prefix, HOT_BITS), whole[one], prefix)
            starts, doc, group, twice = starts[one], doc[one], (prefix % np.uint64(n_groups)).astype(np.int64), n[index[one]] > 1
            cut = np.flatnonzero(np.diff(starts, prepend=-9) != 1)
            cut = np.union1d(cut, np.flatnonzero(np.diff(group, prepend=-1)))
            cut = np.union1d(cut, np.flatnonzero(np.diff(doc, prepend=-1)))
            # Words of a run: its windows' starts and length - 1 words behind the last; header: key, first start, windows, then a flag for each.
            bounds = np.append(cut, len(starts))
            small = (hashes >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(group[cut], kind="stable")
            sent: dict[int, list[bytes]] = {}
            for j in order.tolist():
                a, b = int(bounds[j]), int(bounds[j + 1])
                s, d = int(starts[a]), int(doc[a])
                head = np.array([keys[d], s - offsets[d], b - a], dtype=np.int64).tobytes()
                sent.setdefault(int(group[a]), []).append(head + small[s : s + (b - a) + length - 1].tobytes() + twice[a:b].astype(np.uint8).tobytes())
            names = list(sent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([0] * len(names), pa.int64()), pa.array([b"".join(sent[g]) for g in names], pa.binary())], names=["part", "key", "data"]
            )

    def grow(table: pa.Table) -> pa.Table:
        raw = b"".join(table.column("data").to_pylist())
        keys, firsts, counts, words, flags, p = [], [], [], [], [], 0
        while p < len(raw):
            key, first, n = np.frombuffer(raw, np.int64, 3, p).tolist()
            p += 24
            words.append(np.frombuffer(raw, np.uint32, n + length - 1, p))
            p += 4 * (n + length - 1)
            flags.append(np.frombuffer(raw, np.uint8, n, p))
            p += n
            keys.append(key)
            firsts.append(first)
            counts.append(n)
        del raw
        keys, firsts, counts = (np.array(x, np.int64) for x in (keys, firsts, counts))
        run = np.repeat(np.arange(len(counts)), counts)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = inside + np.repeat(np.cumsum(counts + length - 1) - (counts + length - 1), counts)
        node = subtree_repeats(np.concatenate(words), starts, length)
        flags = np.concatenate(flags)
        deep = np.bincount(node, 1.0 + flags)[node] >= 2
        deep &= flags == 0  # the others were found where they stand
        order = np.argsort(keys[run[deep]], kind="stable")
        at, place = run[deep][order], (firsts[run] + inside)[deep][order]
        data = _by_document(keys, at, place, sort=False)
        del words, flags, run, inside, starts, node, deep
        give_back()
        return pa.table({"key": data[0], "data": data[1]})

    scratch = Scratch(spark)
    dealt = scratch.cut(docs.mapInArrow(tidied(deal), "part int, key long, data binary"), "suffixes")
    here = dealt.where("part < 0").select("key", "data")
    there = dealt.where("part >= 0").groupBy("part").applyInArrow(grow, "key long, data binary")
    out = scratch.last(here.unionByName(there))
    return out.select(F.col("key").alias(key), F.col("data").alias("starts"))


def _by_document(keys: np.ndarray, index: np.ndarray, places: np.ndarray, sort: bool = True) -> tuple[pa.Array, pa.Array]:
    """Places packed as 32-bit integers, one row per document."""
    named = keys[index]
    if sort:
        order = np.argsort(named, kind="stable")
        named, places = named[order], places[order]
    if not len(named):
        return pa.array([], pa.int64()), pa.array([], pa.binary())
    cuts = np.flatnonzero(np.diff(named, prepend=named[0] - 1))
    ends = np.append(cuts[1:], len(named))
    packed = places.astype(np.int32)
    return pa.array(named[cuts], pa.int64()), pa.array([packed[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())


def _covered(n: int, packed: list[bytes] | None, length: int) -> np.ndarray:
    """Which of ``n`` words a window from these starts covers."""
    change = np.zeros(n + 1, np.int32)
    for one in packed or ():
        starts = np.unique(np.frombuffer(one, np.int32))
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0


def _with_starts(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_starts``: an array of packed starts, null where nothing repeats."""
    keyed = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(text_col)))
    starts = repeated_starts(keyed.select("_key", F.col(text_col).cast("string").alias("text")), length, key="_key")
    return keyed.join(starts.groupBy("_key").agg(F.collect_list("starts").alias("_starts")), "_key", "left").drop("_key")


def removal_digests(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_words``, ``n_removed`` and the SHA-256 of the kept words joined by single spaces."""
    joined = _with_starts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), length, "doc_id", "text").select("doc_id", "text", "_starts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if packed:
                    gone = _covered(len(words), packed, length)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())))])
    schema.fields[0] = T.StructField("doc_id", docs.schema[id_col].dataType)
    return joined.mapInArrow(tidied(work), schema)


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated words, each cut with the white space behind it; documents of which nothing is left go.

    Texts without repeats stay as they are, byte for byte.  ``n_chars`` follows the text if there is such a column.
    """
    names = docs.columns
    joined = _with_starts(docs, length, id_col, text_col).select(*names, "_starts")
    at, chars = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, packed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if packed:
                    data = np.frombuffer(text.encode(), np.uint8)
                    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                    gone = _covered(len(starts), packed, length)
                    edge = np.append(starts, len(data))
                    mask = np.ones(len(data), bool)
                    for i in np.flatnonzero(gone).tolist():
                        mask[edge[i] : edge[i + 1]] = False
                    text = data[mask].tobytes().decode()
                    keep.append(bool((~gone).any()))
                else:
                    keep.append(True)
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                lengths = [None if t is None else len(t) for t in texts]
                old = columns[chars].to_pylist()
                columns[chars] = pa.array([n if p else o for n, o, p in zip(lengths, old, batch.column(len(names)).to_pylist(), strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(tidied(work), docs.schema)
