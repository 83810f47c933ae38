"""Shards of equal row counts whose mixture of sources is the mixture of the whole table.

Proportional stratified interleaving: rows are shuffled by a seeded hash and ranked within their source; row ``r`` of ``n`` has the
fractional rank ``(r - u) / n``, ``u`` being a number in [0, 1) that a hash of the source gives; all rows sorted by it are cut into
equal runs.  The rows of a source lie ``1 / n`` apart, so any stretch of fractional ranks holds each source in its share, give or take
one row; the start ``u`` keeps sources of one row, of which there may be very many, from meeting at one rank.

Both rankings are global but no task sees a whole source or the whole table: the hash (fractional rank) deals rows evenly into
buckets, a small table of bucket counts gives each bucket's first rank, and a window ranks rows inside a bucket only.  The hash is
of the id and the text's checksum, so rows without an id, or with one id, part too.  Text never moves; its size and checksum do.

Defined results: a null source is a source of its own; a null text has no bytes and the checksum of an empty one; a long text counts
with all its bytes; a null id is an id like any other; equal fractional ranks stand in the order of their sources' hashes, then names;
rows that repeat in every column are placed one after the other; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shuffle hashes have so many bits; both bucket counts are powers of two below that.
HASH_BITS = 60


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A hash of 60 bits that any SQL engine with MD5 can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard_interleaved(
    docs: DataFrame,
    n_shards: int = 24,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_bits: int = 10,
) -> DataFrame:
    """One row per input row: id, ``source``, ``size``, ``text_crc32``, ``source_rank``, ``fraction``, ``shard`` and ``slot``.

    ``bucket_bits`` sets how finely a source and the whole order are split: a window task sees about 1 / 2**bucket_bits of either.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    buckets = 1 << bucket_bits
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("stratum"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("h", seeded_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string")))
    rows = rows.withColumn("bucket", F.shiftright("h", HASH_BITS - bucket_bits).cast("int"))

    per_bucket = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    of_stratum = Window.partitionBy("stratum")
    per_bucket = per_bucket.select(
        "stratum",
        "bucket",
        (F.sum("n").over(of_stratum.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(of_stratum).alias("n_source"),
    )
    in_bucket = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "bytes")
    ranked = (
        rows.join(per_bucket, ["stratum", "bucket"])
        .withColumn("source_rank", F.col("before") + F.row_number().over(in_bucket))
        .withColumn("tie", seeded_hash(seed, F.col("stratum")))
        .withColumn("fraction", (F.col("source_rank") - F.col("tie") / float(1 << HASH_BITS)) / F.col("n_source"))
        .withColumn("place", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int"))
    )

    # 2**bucket_bits rows at most, whatever the input: the only table that one task sees whole, and small enough to broadcast.
    in_order = Window.orderBy("place")
    per_place = (
        ranked.groupBy("place")
        .agg(F.count("*").alias("n"))
        .select(
            "place",
            (F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"),
            F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
        )
    )
    in_place = Window.partitionBy("place").orderBy("fraction", "tie", "stratum", "source_rank")
    return (
        ranked.join(F.broadcast(per_place), "place")
        .withColumn("position", F.col("first") + F.row_number().over(in_place) - 1)
        .withColumn("shard", F.expr(f"(position * {n_shards}) div n_rows"))
        .select(
            "doc_id",
            "source",
            (F.col("bytes") + 8).alias("size"),
            "text_crc32",
            "source_rank",
            "fraction",
            F.col("shard").cast("int").alias("shard"),
            F.expr(f"position - (shard * n_rows + {n_shards - 1}) div {n_shards}").alias("slot"),
        )
    )
