"""Grouping of spelling variants: words one insertion, deletion or replacement apart, and the far more frequent word that each stands for.

1. Occurrences are counted in the JVM; a hot word is added up in every task before it is shuffled.
2. A word of L characters has the L keys of what is left when one character is deleted, and its own.  Prefix and suffix polynomial hashes
   of all words of a batch are NumPy arrays, so every deletion key is a few integer operations and no deleted string is built.
3. Keys are dealt by their leading bits (a radix partition) and sorted.  Words that share a key at the same deleted place differ by a
   replacement there; a word that equals what another leaves differs by a deletion.  As a key stands for one string, its group holds at most
   (letters x places) words, however frequent they are, and each word needs only the number of the others and the best of them: no pairs
   are sent.
4. Wherever words share a key, the strings that are left are built and compared, so words that a hash alone joins are parted.
5. Forms are followed by pointer doubling; each step at least multiplies the count by ten, so few rounds end it.

Defined results: a null text holds no words, a null id counts as an empty one, repeated rows count twice, an empty table gives no rows, other columns
are ignored whatever their names.  A word that is reached by several deletions of one longer word is near it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilflow.llm.scratch import Scratch, tidied

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base of the polynomial; arithmetic is modulo 2^64.  Letters are scattered first, as plain codes would collide in such a ring.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
RADIX_BITS = 16
ROWS = 20_000


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, drop_one_in: int = 31) -> DataFrame:
    """word and n: maximal runs of letters, lower-cased where ASCII; one in ``drop_one_in``, chosen by checksum, loses a character."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})"), F.lit(1))  # a deletion never lengthens a run
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = each.select(F.when(h % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every word its own key (place -1) and those of what each deletion leaves: number of the word, place, key.

    Of a run of equal letters, which leave the same, each place has its key.
    """
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    own = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(codes)) - starts[own]
    letters = _scatter(codes)
    most = int(lengths.max(initial=0))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, BASE)]))
        # sums of letter x base^place: the prefix before a place, and the suffix behind it moved down by one
        up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[place])])
        down = np.zeros(len(codes) + 1, np.uint64)
        lowered_powers = powers[np.maximum(place - 1, 0)]
        lowered_powers[place == 0] = 0
        down[1:] = np.cumsum(letters * lowered_powers)
        at = np.arange(len(codes))
        prefix = up[at] - up[starts[own]]
        suffix = down[ends[own]] - down[at + 1]
        left = prefix + suffix
        whole = up[ends] - up[starts]
        keys = np.concatenate([_scatter(whole ^ lengths.astype(np.uint64)), _scatter(left ^ (lengths[own] - 1).astype(np.uint64))])
    return np.concatenate([np.arange(len(lengths)), own]), np.concatenate([np.full(len(lengths), -1), place]), keys


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in _slices(batch.column(0)):
            word, n = batch.column(0).slice(*at), batch.column(1).slice(*at)
            which, place, key = deletion_keys(word)
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> np.uint64(64 - RADIX_BITS)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), word.take(take), n.take(take)], names=["radix", "key", "place", "word", "n"]
            )


def _slices(words: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices whose keys, each with its word, stay within some 16 MB; a long word may stand alone."""
    size = np.cumsum((pc.utf8_length(words).to_numpy().astype(np.int64) + 1) * (pc.binary_length(words).to_numpy() + 24))
    begin, done = 0, 0
    while begin < len(words):
        end = max(begin + 1, int(np.searchsorted(size, done + 16_000_000)))
        yield begin, end - begin
        begin, done = end, int(size[end - 1])


def _parted(key: np.ndarray, place: np.ndarray, words: list[str], rows: np.ndarray) -> np.ndarray:
    """Group numbers of ``rows``, sorted by key: rows whose key is equal but whose left-over strings differ get groups of their own."""
    left = [words[r] if place[r] < 0 else words[r][: place[r]] + words[r][place[r] + 1 :] for r in rows]
    same = key[rows]
    new = np.ones(len(rows), bool)
    new[1:] = same[1:] != same[:-1]
    group = np.cumsum(new)
    odd = [i for i in range(1, len(rows)) if not new[i] and left[i] != left[i - 1]]
    if odd:  # a collision: number the strings of each such key
        names: dict[tuple[int, str], int] = {}
        bad = set(group[odd].tolist())
        for i, g in enumerate(group.tolist()):
            if g in bad:
                group[i] = -1 - names.setdefault((g, left[i]), len(names))
    return group


def _near(table: pa.Table) -> pa.RecordBatch:
    """Of whole groups of keys: for each word, how many words are near it there, and the count and spelling of the best of them."""
    key, place = table.column("key").to_numpy(), table.column("place").to_numpy()
    shared = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    shared[1:] |= equal
    shared[:-1] |= equal
    rows = np.flatnonzero(shared)
    order = np.empty(len(key), np.int64)
    order[pc.sort_indices(table.select(["n", "word"]), sort_keys=[("n", "descending"), ("word", "ascending")]).to_numpy()] = np.arange(len(key))
    words = table.column("word").to_pylist()
    group = _parted(key, place, words, rows)
    at, rank = place[rows], order[rows]
    out_row, out_count, out_best = [], [], []

    # Replacements: words with one left-over string at one place, the best first.
    line = np.lexsort((rank, at, group))
    g, p, r = group[line], at[line], rows[line]
    new = np.ones(len(line), bool)
    new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(line)))
    many = np.repeat((size > 1), size) & (p >= 0)
    head = np.repeat(first, size)
    best = np.where(np.arange(len(line)) == head, np.minimum(head + 1, len(line) - 1), head)
    out_row.append(r[many])
    out_count.append(np.repeat(size, size)[many] - 1)
    out_best.append(r[best[many]] if len(line) else r[many])

    # Deletions: a word that is itself what others leave; of places that leave the same the first counts.
    owner = {int(k): int(x) for k, x in zip(g[p < 0], r[p < 0], strict=True)}
    inside = np.flatnonzero(p >= 0)
    inside = inside[np.array([int(g[i]) in owner and (p[i] == 0 or words[r[i]][p[i]] != words[r[i]][p[i] - 1]) for i in inside], bool)] if owner else inside[:0]
    host = np.array([owner[int(g[i])] for i in inside], np.int64)
    out_row += [r[inside], host]
    out_count += [np.ones(len(inside), np.int64)] * 2
    out_best += [host, r[inside]]
    row, best_row = np.concatenate(out_row).astype(np.int64), np.concatenate(out_best).astype(np.int64)
    took, better = table.take(pa.array(row)), table.take(pa.array(best_row))
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_arrays([flat(took.column("word")), pa.array(np.concatenate(out_count), pa.int64()), flat(better.column("n")), flat(better.column("word"))], names=["word", "n_near", "best_n", "best"])


def _near_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, in batches; a group that is cut by the end of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut and n + cut >= ROWS:
            yield _near(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held, n = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield _near(pa.Table.from_batches(held))


def near_words(words: DataFrame, partitions: int | None = None) -> DataFrame:
    """word, n_near, best_n and best (near word of the largest count, of ties the least) of every word that has near ones; ``words``: word and n, words distinct."""
    parts = partitions or int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.select("word", "n").mapInArrow(tidied(_keyed), "radix int, key long, place int, word string, n long")
    ordered = keyed.repartition(parts, "radix").sortWithinPartitions("key").select("key", "place", "word", "n")
    found = ordered.mapInArrow(tidied(_near_in_order), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10, least_length: int = 7, least_count: int = 2, drop_one_in: int = 31) -> DataFrame:
    """One row per word: word, form (its near word of the largest count, if ``times`` its own), root (where forms lead), n, n_near, form_n."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.cut(word_counts(docs, id_col, text_col, least_length, least_count, drop_one_in), "words")
    near = near_words(words)
    has = F.col("best_n") >= times * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
    )
    known = scratch.cut(known, "known")
    # Pointer doubling over the words that have a form: where a root has a root of its own, that one holds.
    leads = scratch.step(known.where("form is not null").select("word", F.col("form").alias("root")), "leads")
    while True:
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("far"))
        ahead = scratch.step(leads.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "leads")
        if not ahead.where("moved").limit(1).count():
            break
        leads = ahead.drop("moved")
    roots = ahead.select("word", "root")
    return scratch.last(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
