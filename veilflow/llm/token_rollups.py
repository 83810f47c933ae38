"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change is one row: (op, doc_id, source, lang, tokenizer, n_tokens), op being ``insert``, ``delete`` or ``revise``.  A revision
replaces the count that stands for the same document and tokenizer, so it is the difference that moves the totals; a delete takes the
standing count away.  Totals are a table of their own, one row for each group: a batch adds its signed sums to it, and a reader only
reads it, however many batches there were.

State is a folder that all executors share.

* ``standing-*/bucket=*``: what stands for each document and tokenizer, dealt into buckets by their hash.  A batch rewrites the buckets
  that it touches and no others; the rewritten rows carry what stood before them, from which the signed sums come without another join.
* ``totals-*``: the totals, rewritten by each batch.
* ``manifest-<number>``: the tables that hold and the id of the batch that made them so; the greatest number holds.  Its size depends on
  the number of buckets alone.  Batch ids are those of all manifests; every ``fold_after`` commits they are put into a table (``ids-*``)
  and the old manifests go, so the number of manifests is bounded too.  Ids are looked up by Spark and never brought to the driver.

A batch is committed by writing its tables and then, by one atomic rename, the next manifest; a batch id that was committed is not taken
again, so delivery may repeat, also after ids were folded.  A crash leaves the last manifest standing, and tables that none names, which
compact() removes.  Tables that a commit replaced are deleted by the commit after it, so a reader may be one commit behind.

Defined results: a null source, language, tokenizer or id is a value of its own; a null or empty text has 0 tokens and counts as a
document; a null count is 0; of rows that repeat a document in one batch the last by ``seq`` holds (of equals the largest count, then
deletes before inserts before revisions); deletes of what isn't there change nothing, revisions of it insert; an empty batch is committed
and changes nothing; an op of another name is an error; other columns are ignored.  Ids keep their type (integers become longs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm import sentencepiece_bpe
from veilflow.llm.scratch import small_batches, tidied

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: What stands, and what stood before the batch that wrote the row (``changed``: by that batch).
STANDING = "tokenizer string, source string, lang string, tokens long, live boolean, was_source string, was_lang string, was_tokens long, was boolean, changed boolean"


def _id_type(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    return "bigint" if isinstance(kind, T.IntegralType) else kind.simpleString()


def count_tokens(docs: DataFrame, tokenizer: str = "piece_bpe_32k", model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", revised: Column | None = None) -> DataFrame:
    """doc_id, source, lang, ``tokenizer`` and ``n_tokens`` (begin and end ids not counted) of each whole text.

    ``revised``: another text of the same row, counted in the same pass as ``n_revised`` (once, where both texts are equal).
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    other = text if revised is None else revised
    base = docs.select(F.col(id_col).cast(_id_type(docs, id_col)).alias("doc_id"), "source", "lang", text.alias("text"), F.when(~other.eqNullSafe(text), F.coalesce(other, F.lit(""))).alias("other"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sentencepiece_bpe.task_codec(model_file, keep=True) as own:
            for batch in batches:
                n = [own.count(t or "") for t in batch.column(3).to_pylist()]
                again = [x if t is None else own.count(t) for x, t in zip(n, batch.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(again, pa.int64())], names=["doc_id", "source", "lang", "n_tokens", "n_revised"])

    counted = base.mapInArrow(tidied(work), f"doc_id {_id_type(docs, id_col)}, source string, lang string, n_tokens long, n_revised long")
    return counted.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "n_tokens", *([] if revised is None else ["n_revised"]))


class Rollups:
    """Totals and standing counts under one folder that all executors share.

    ``n_buckets``: of a folder that has none yet; the shuffle partitions of the session unless given.
    """

    def __init__(self, spark: SparkSession, folder: str, n_buckets: int | None = None, fold_after: int = 64):
        self.spark, self.folder, self.fold_after = spark, folder.rstrip("/"), fold_after
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self) -> list[str]:
        path, fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path(self.folder))] if fs.exists(path(self.folder)) else []

    def _state(self) -> dict:
        """The manifest that holds."""
        version = max((int(n.removeprefix("manifest-")) for n in self._names() if n.startswith("manifest-")), default=0)
        if not version:
            return {"version": 0, "batch": None, "totals": None, "standing": [None] * self.n_buckets, "ids": None, "id_type": None, "replaced": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest-{version}", wholetext=True).first()[0])

    def _swap(self, state: dict) -> None:
        """Make ``state`` hold as the next manifest; an error, and no change, if another writer was first."""
        path, fs = self._fs()
        staged, final = path(f"{self.folder}/_staged-{uuid.uuid4().hex}"), path(f"{self.folder}/manifest-{state['version']}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, True)
            raise OSError(f"version {state['version']} was committed by another writer")

    def _delete(self, names: list[str]) -> None:
        path, fs = self._fs()
        for name in names:
            fs.delete(path(f"{self.folder}/{name}"), True)

    def _write(self, df: DataFrame, kind: str, *by: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.folder}/{name}") if by else df.write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def _ids(self, state: dict) -> DataFrame:
        if not state["version"]:
            return self.spark.createDataFrame([], "batch string")
        named = self.spark.read.schema("batch string").json(f"{self.folder}/manifest-*").where("batch is not null")
        return named.unionByName(self._read("batch string", [state["ids"]])).distinct() if state["ids"] else named.distinct()

    def batches(self) -> DataFrame:
        """``batch``: every batch id that was ever committed."""
        return self._ids(self._state())

    def standing(self) -> DataFrame:
        """doc_id, source, lang, tokenizer and tokens of what stands for each document and tokenizer."""
        state = self._state()
        return self._read(f"doc_id {state['id_type'] or 'bigint'}, {STANDING}", [n for n in state["standing"] if n]).where("live").select("doc_id", *KEYS, "tokens")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens, as the last commit left them."""
        state = self._state()
        return self._read(TOTALS, [state["totals"]] if state["totals"] else [])

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Fold in one batch (columns op, doc_id, source, lang, tokenizer, n_tokens and, if there is one, seq); False if it is there already."""
        state = self._state()
        if not self._ids(state).where(F.col("batch") == batch_id).isEmpty():
            return False
        id_type, buckets = state["id_type"] or _id_type(changes, "doc_id"), len(state["standing"])
        schema = f"doc_id {id_type}, {STANDING}"
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        rank = F.when(F.col("op") == "delete", 2).when(F.col("op") == "insert", 1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))).cast("int"))
        texts = [F.col(k).cast("string").alias(k) for k in KEYS]
        given = changes.select(F.col("doc_id").cast(id_type).alias("doc_id"), *texts, F.col("n_tokens").cast("long").alias("tokens"), rank.alias("rank"), seq.alias("seq"))
        bucket = F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(buckets)).cast("int").alias("bucket")
        arrived_name = self._write(given.select("*", bucket), "_arrived")
        arrived = self.spark.read.parquet(f"{self.folder}/{arrived_name}")
        touched = sorted(r["bucket"] for r in arrived.select("bucket").distinct().collect())  # at most the number of buckets
        after = state | {"version": state["version"] + 1, "batch": batch_id, "id_type": id_type, "replaced": []}
        if touched:
            old = self._read(schema, [state["standing"][b] for b in touched if state["standing"][b]]).where("live")
            stood = old.select("doc_id", "tokenizer", bucket, F.struct("source", "lang", "tokens").alias("old"))
            comes = arrived.select("doc_id", "tokenizer", "bucket", F.struct("seq", "tokens", "rank", "source", "lang").alias("new"))
            # One shuffle: rows of a bucket come together, are merged by document there and written as its file.
            both = stood.unionByName(comes, allowMissingColumns=True).repartition("bucket").groupBy("bucket", "doc_id", "tokenizer").agg(F.max("old").alias("old"), F.max("new").alias("new"))
            changed, delete = F.col("new").isNotNull(), F.col("new.rank") == 2
            now = lambda c: F.when(changed, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
            merged = both.select(
                "bucket", "doc_id", "tokenizer", now("source").alias("source"), now("lang").alias("lang"), F.coalesce(now("tokens"), F.lit(0)).alias("tokens"), (~F.coalesce(delete, F.lit(False))).alias("live"),
                F.col("old.source").alias("was_source"), F.col("old.lang").alias("was_lang"), F.col("old.tokens").alias("was_tokens"), F.col("old").isNotNull().alias("was"), changed.alias("changed"),
            )
            table = self._write(merged, "standing", "bucket")
            rows = self._read(schema, [f"{table}/bucket={b}" for b in touched]).where("changed")
            gone = rows.where("was").select(F.col("was_source").alias("source"), F.col("was_lang").alias("lang"), "tokenizer", F.lit(-1).cast("long").alias("n_docs"), (-F.col("was_tokens")).alias("n_tokens"))
            come = rows.where("live").select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))
            held = self._read(TOTALS, [state["totals"]] if state["totals"] else [])
            sums = held.unionByName(gone).unionByName(come).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
            after["totals"] = self._write(sums, "totals")
            after["standing"] = [f"{table}/bucket={b}" if b in set(touched) else n for b, n in enumerate(state["standing"])]
            after["replaced"] = [n for n in [state["totals"], *(state["standing"][b] for b in touched)] if n]
        folded = self._fold(state, after)
        self._swap(after)
        self._delete([arrived_name, *state["replaced"], *folded])
        return True

    def _fold(self, state: dict, after: dict, always: bool = False) -> list[str]:
        """Put the ids of manifests into a table once there are many; what may be deleted when ``after`` holds."""
        old = [n for n in self._names() if n.startswith("manifest-")]
        if not old or (len(old) < self.fold_after and not always):
            return []
        after["ids"] = self._write(self._ids(state).coalesce(1), "ids")
        return [*old, *([state["ids"]] if state["ids"] else [])]

    def compact(self) -> None:
        """Fold all batch ids, and remove every table that doesn't count; not to be run beside a commit or a reader."""
        state = self._state()
        after = state | {"version": state["version"] + 1, "batch": None, "replaced": []}
        folded = self._fold(state, after, always=True)
        if not folded:
            return
        self._swap(after)
        named = {n for n in [after["totals"], after["ids"], f"manifest-{after['version']}", *after["standing"]] if n}
        tops = {n.split("/")[0] for n in named}
        self._delete([n for n in self._names() if n not in tops])
        path, fs = self._fs()
        for top in tops:
            if top.startswith("standing-"):
                parts = [f"{top}/{s.getPath().getName()}" for s in fs.listStatus(path(f"{self.folder}/{top}"))]
                self._delete([n for n in parts if "/bucket=" in n and n not in named])
