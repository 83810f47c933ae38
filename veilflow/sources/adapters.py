"""Sources: the tables of a folder, lines of texts, sightings, signatures, and decoded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spread(table: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than there are cores (a single row group, say) is dealt out; a large one is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores or _few_row_groups(table, cores) else table


def _few_row_groups(table: DataFrame, cores: int) -> bool:
    """Whether the input is so small that its row groups may be fewer than its splits."""
    limit = int(table.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * limit


def lines_of(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 1) and line of every line that isn't blank."""
    rows = texts.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "").withColumn("line_no", F.col("line_no") + 1)


def read_lines_of(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines as a recogniser reports them: id, line_no, ``line`` (words joined by single spaces) and ``raw``, from which ``with_words`` makes the words."""
    joined = F.expr("array_join(filter(split(line, ' '), w -> w <> ''), ' ')").alias("line")
    return lines_of(texts, id_col, text_col).select(id_col, "line_no", joined, F.col("line").alias("raw"))


def with_words(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``read_lines_of`` with ``ws``, an array of words with idx, text, x, y, w, h, confidence, in place of ``raw``.

    The tables hold no recognised text, so boxes follow from places and confidences from ids.
    """
    rows = rows.withColumns({"_n": F.expr("transform(split(raw, ' '), w -> length(w) + 1)"), "_ws": F.split("raw", " ")})
    step = "(a, i) -> named_struct('at', a.at + _n[i], 'out', CASE WHEN _ws[i] = '' THEN a.out ELSE concat(a.out, array(named_struct('idx', i + 1, 'text', _ws[i], 'start', a.at))) END)"
    words = f"aggregate(sequence(0, size(_ws) - 1), named_struct('at', 0, 'out', cast(array() AS array<struct<idx:int,text:string,start:int>>)), {step}, a -> a.out)"
    fields = {
        "idx": "cast(w.idx AS bigint)", "text": "w.text", "x": "cast(8 * w.start AS double)", "y": "cast(18 * line_no AS double)", "w": "cast(8 * length(w.text) AS double)", "h": "16D",
        "confidence": f"cast(round((abs({id_col} * 31 + w.idx) % 50 + 50) / 100.0, 2) AS double)",
    }
    each = F.expr(f"transform({words}, w -> named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {e}' for k, e in fields.items())}))")
    # By a generator, so that no expression above makes the words again.
    return rows.withColumn("ws", F.explode(F.array(each))).drop("raw", "_n", "_ws")


def words_of(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of lines, one row each: id, line_no, idx, text, x, y, w, h, confidence."""
    return with_words(read_lines_of(texts, id_col, text_col), id_col).select(id_col, "line_no", F.explode("ws").alias("w")).select(id_col, "line_no", "w.*")


def sightings(events: DataFrame) -> DataFrame:
    """Events as sightings: a user is a video, an event type is a key, one day lasts one second."""
    first = events.groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = events.join(first, "user_id").withColumn("t", F.round((micros("ts") - micros("first_ts")) / 86_400_000_000.0, 6))
    e = F.col("event_id")
    box = [(e % 7 * 40).alias("x"), (e % 5 * 30).alias("y"), (60 + e % 3 * 10).alias("w"), (20 + e % 2 * 8).alias("h")]
    return rows.select(
        "event_id", F.col("user_id").alias("video"), F.col("event_type").alias("key"), "t", *(c.cast("double") for c in box),
        F.round(0.45 + (e % 50) / 100.0, 2).alias("confidence"), (e % 3 == 0).alias("strong"),
    ).toDF("event_id", "video", "key", "t", "x", "y", "w", "h", "confidence", "strong")


def signatures(vectors: DataFrame, scale: int = 255) -> DataFrame:
    """Vectors as luma signatures: a label is a video; each stands for 1 to 12 samples at 2 a second, in order of id."""
    from pyspark.sql import Window

    cells = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * scale)).cast("int"))
    rows = vectors.select(F.col("label").alias("video"), "vec_id", cells.alias("cells"), (1 + F.col("vec_id") % 12).alias("n"))
    before = F.sum("n").over(Window.partitionBy("video").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.coalesce(before, F.lit(0)))
    return rows.select("video", "vec_id", "cells", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i")).withColumn("t", F.col("i") * 0.5)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded frames in a folder of images (origin, height, width, channels, mode, data as BGR)."""
    return spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")


def video_files(spark: SparkSession, folder: str) -> DataFrame:
    """Container files as bytes; decoding is a plug-in, since no decoder ships with Spark."""
    return spark.read.format("binaryFile").load(folder)
