"""Benchmark decontamination with a hash set of test windows, in DataFrame functions only.

Both sides are lower-cased (A-Z) and cut into words.  The windows of the test items (ten words; a shorter item is one window) become a
set of 64-bit hashes that every task holds.  A document's windows are hashed in place, so no row is made for a window that is in no
item; those that are in the set are emitted with their words and joined to the items on the words themselves, which verifies them.

What is broadcast has a proven bound: distinct windows and their items are counted first.  Beyond ``max_broadcast_windows`` distinct
windows, document windows are matched by a shuffled join on their hashes instead, and beyond as many items of windows these are joined
by a shuffle, with the same rows.  Items come in after a document's windows have become a set, so a window of many items is not
multiplied by its hits.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; equal items all count; rows
that repeat both ``doc_id`` and text are one document with one row, a ``doc_id`` with two texts is two documents; an empty table on
either side gives no hits; other columns are ignored, whatever their names, but remove_spans() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of a-z, 0-9 and characters beyond ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_WORD, _BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)


def plain_words(text: Column) -> Column:
    """The words of a text; an empty array if it has none."""
    return F.filter(F.split(lower_ascii(text), WORD_BREAK), lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id``, ``window`` (array of words), ``length`` and ``h``: each window of each item once."""
    items = benchmark.select(F.col(id_col).alias("item_id"), plain_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    return (
        items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.slice("w", i, length))).alias("window"))
        .distinct()
        .select("item_id", "window", F.size("window").alias("length"), F.xxhash64("window").alias("h"))
    )


_HITS = "array<struct<start:int,window:array<string>>>"


def window_sets(windows: DataFrame, most: int) -> dict[int, tuple[list[int], list[str]]] | None:
    """By length: hashes of the distinct windows, and the windows themselves as text; None beyond ``most`` windows."""
    distinct = windows.select("length", "h", F.array_join("window", " ").alias("text")).distinct()
    rows = distinct.limit(most + 1).collect()
    if len(rows) > most:
        return None
    sets: dict[int, tuple[list[int], list[str]]] = {}
    for row in sorted(rows, key=lambda r: (r["length"], r["text"])):
        hashes, texts = sets.setdefault(row["length"], ([], []))
        hashes.append(row["h"])
        texts.append(row["text"])
    return sets


def _starts(words: Column, length: int, test) -> Column:
    """Starts (from 1) of the windows that pass ``test``."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - (length - 1)))
    return F.filter(F.coalesce(starts, F.array().cast("array<int>")), test)


def _hashed_in(words: str, length: int, hashes: list[int]):
    return lambda i: F.xxhash64(F.slice(words, i, length)).isin(hashes)


def document_hits(docs: DataFrame, windows: DataFrame, max_broadcast_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and verified hit, and one for each document without any: doc_id, t (hash of the text), n_words, window, start (from 1), length."""
    sets = window_sets(windows, max_broadcast_windows)
    words = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), plain_words(F.col(text_col)).alias("w"))
    none = F.array().cast(_HITS)
    known = windows.select("window", "length").distinct()

    def emitted(rows: DataFrame, found: list[Column]) -> DataFrame:
        hits = rows.select("doc_id", "t", F.size("w").alias("n_words"), F.explode_outer(F.concat(*found) if found else none).alias("hit"))
        return hits.select("doc_id", "t", "n_words", F.col("hit.start").alias("start"), F.col("hit.window").alias("window"))

    def cut(starts: Column, length: Column | int) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice("w", i, length).alias("window"))).cast(_HITS)

    if sets is not None:
        hits = emitted(words, [cut(_starts(F.col("w"), k, _hashed_in("w", k, sets[k][0])), k) for k in sets])
        return hits.join(F.broadcast(known), "window", "left")
    # Only hashes of document windows are shuffled; the words of those that match are cut out of their texts afterwards.
    lengths = sorted(row["length"] for row in windows.select("length").distinct().collect())  # at most the window length
    of_text = lambda k: F.transform(_starts(F.col("w"), k, lambda i: F.lit(True)), lambda i: F.struct(i.alias("start"), F.lit(k).alias("length"), F.xxhash64(F.slice("w", i, k)).alias("h")))
    every = words.select("doc_id", "t", F.explode(F.concat(*map(of_text, lengths))).alias("x")).select("doc_id", "t", "x.*")
    matched = every.join(windows.select("h").distinct(), "h", "left_semi")
    found = matched.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("start", "length")).alias("at"))
    rows = words.join(found, words["doc_id"].eqNullSafe(found["_id"]) & (words["t"] == found["_t"]), "left")
    at = F.transform(F.coalesce("at", F.array().cast("array<struct<start:int,length:int>>")), lambda x: F.struct(x["start"].alias("start"), F.slice("w", x["start"], x["length"]).alias("window")))
    return emitted(rows, [at.cast(_HITS)]).join(known, "window", "left")


def merge_spans(hits: Column) -> Column:
    """Sorted structs of s and e (exclusive) joined where they meet."""
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def joined(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(hits.cast("array<struct<s:int,e:int>>"), empty, lambda acc, x: joined(acc, x).cast("array<struct<s:int,e:int>>"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their ids, hit spans (s from 0, e exclusive), ``contaminated``."""
    windows = item_windows(benchmark, n)
    hits = document_hits(docs, windows, max_broadcast_windows, id_col, text_col)
    start, hit = F.col("start") - 1, F.col("length").isNotNull()
    per_doc = hits.groupBy("doc_id", "t", "n_words").agg(
        F.array_sort(F.collect_set(F.when(hit, F.struct(start.alias("s"), (start + F.col("length")).alias("e"))))).alias("hits"),
        F.collect_set(F.when(hit, F.col("window"))).alias("windows"),
    )
    items = windows.select("item_id", "window")
    if items.limit(max_broadcast_windows + 1).count() <= max_broadcast_windows:
        items = F.broadcast(items)
    per_window = per_doc.select("doc_id", "t", "n_words", "hits", F.explode_outer("windows").alias("window")).join(items, "window", "left")
    per_doc = per_window.groupBy("doc_id", "t", "n_words").agg(F.first("hits").alias("hits"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return per_doc.select("doc_id", "t", "n_words", "items", merge_spans(F.col("hits")).alias("spans")).select(
        "doc_id",
        "t",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"])).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        (F.size("spans") > 0).alias("contaminated"),
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that no rule of the optimiser copies into the expressions that use it, lambdas above all."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.8, max_broadcast_windows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words, each with what follows it up to the next word, cut out; documents with ``drop_share`` of their words hit go.

    A text without hits stays as it is.  Within the bound of the hash set everything happens inside the row, so no text is shuffled.
    """
    windows = item_windows(benchmark, n)
    sets = window_sets(windows, max_broadcast_windows)
    none = F.array().cast("array<struct<s:int,e:int>>")
    if sets is None:
        found = contamination(docs, benchmark, n, max_broadcast_windows, id_col, text_col).where("contaminated")
        marked = docs.withColumn("_t", F.xxhash64(F.col(text_col))).join(found.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), F.col("spans").alias("_spans")).withColumnRenamed("_id", id_col), [id_col, "_t"], "left")
        marked = marked.withColumn("_spans", F.coalesce("_spans", none)).withColumn("_w", plain_words(F.col(text_col)))
    else:
        marked = _once(docs, "_w", plain_words(F.col(text_col)))

        def hit(k: int) -> Column:
            at = _starts(F.col("_w"), k, lambda i: F.xxhash64(F.slice("_w", i, k)).isin(sets[k][0]) & F.array_join(F.slice("_w", i, k), " ").isin(sets[k][1]))
            return F.transform(at, lambda i: F.struct((i - 1).alias("s"), (i - 1 + k).alias("e"))).cast("array<struct<s:int,e:int>>")

        hits = F.array_sort(F.concat(*[hit(k) for k in sets])) if sets else none
        marked = _once(_once(marked, "_hits", hits), "_spans", merge_spans(F.col("_hits"))).drop("_hits")
    inside = F.aggregate("_spans", F.lit(0), lambda acc, x: acc + (x["e"] - x["s"]))
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"({_ANY_WORD}{_BETWEEN}*)"), 1)
    kept = F.filter(parts, lambda part, i: ~F.exists("_spans", lambda x: (x["s"] <= i) & (i < x["e"])))
    lead = F.regexp_extract(F.col(text_col), f"^{_BETWEEN}*", 0)
    clean = F.when(F.size("_spans") > 0, F.concat(lead, F.array_join(kept, ""))).otherwise(F.col(text_col))
    out = marked.where((F.size("_spans") == 0) | (inside < drop_share * F.size("_w"))).withColumn(text_col, clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
