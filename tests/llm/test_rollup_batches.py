"""Rollups held against a plain dictionary over many batches, and their query against the library over the given tables."""

import random
from collections import defaultdict

import pytest
import sentencepiece

from veilflow.llm import queries, sentencepiece_bpe, token_rollups
from veilflow.llm.scratch import Scratch

CHANGE = "op string, doc_id {}, source string, lang string, tokenizer string, n_tokens long, seq int, bucket string"


def sums(standing):
    out = defaultdict(lambda: [0, 0])
    for (_, tokenizer), (source, lang, n) in standing.items():
        out[source, lang, tokenizer][0] += 1
        out[source, lang, tokenizer][1] += n
    return {k: tuple(v) for k, v in out.items()}


def read(rollups):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollups.totals().collect()}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_batches_with_repeats_nulls_and_text_ids(spark, kind):
    rng, standing, made = random.Random(5), {}, []
    rollups = token_rollups.Rollups(spark, Scratch(spark).path("r"), n_buckets=3, fold_after=3)
    assert rollups.totals().count() == 0 and rollups.batches().count() == 0 and rollups.standing().count() == 0
    name = (lambda i: i) if kind == "long" else (lambda i: i if i is None else f"doc {i}")
    for b in range(7):
        rows = [
            (rng.choice(["insert", "revise", "revise", "delete"]), name(rng.choice([None, *range(25)])), rng.choice(["hot", "hot", "a", None]), rng.choice(["en", None]), rng.choice(["t1", "t1", "t2", None]), rng.choice([None, 0, 3, 10**12]), k, "clash")
            for k in range(0 if b == 3 else 40)
        ]
        last = {(r[1], r[4]): r for r in rows}  # seq rises with the place
        for key, r in last.items():
            if r[0] == "delete":
                standing.pop(key, None)
            else:
                standing[key] = (r[2], r[3], r[5] or 0)
        made.append(spark.createDataFrame(rng.sample(rows, len(rows)), CHANGE.format(kind)))
        assert rollups.commit(f"b{b}", made[-1]) and read(rollups) == sums(standing)
        again = rng.randrange(b + 1)
        assert not rollups.commit(f"b{again}", made[again]) and read(rollups) == sums(standing)
    assert sorted(r["batch"] for r in rollups.batches().collect()) == [f"b{b}" for b in range(7)]
    assert sum(n.startswith("manifest-") for n in rollups._names()) <= 3  # ids were folded on the way
    rollups.compact()
    assert read(rollups) == sums(standing) and not rollups.commit("b0", made[0])
    got = {(r["doc_id"], r["tokenizer"]): (r["source"], r["lang"], r["tokens"]) for r in rollups.standing().collect()}
    assert got == standing


def test_untouched_buckets_stay_and_a_crash_changes_nothing(spark):
    rollups = token_rollups.Rollups(spark, Scratch(spark).path("r"), n_buckets=16)
    rollups.commit("1", spark.range(400).selectExpr("'insert' as op", "id as doc_id", "'s' as source", "'en' as lang", "'t' as tokenizer", "id as n_tokens"))
    before = rollups._state()
    one = spark.createDataFrame([("revise", 7, "s", "en", "t", 107, 0, "x")], CHANGE.format("long"))
    swap, rollups._swap = rollups._swap, lambda state: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        rollups.commit("2", one)
    rollups._swap = swap
    assert rollups._state() == before and rollups.commit("2", one)
    after = rollups._state()
    assert sum(a != b for a, b in zip(before["standing"], after["standing"], strict=True)) == 1
    assert read(rollups) == {("s", "en", "t"): (400, sum(range(400)) + 100)}
    rollups.compact()
    assert read(rollups) == {("s", "en", "t"): (400, sum(range(400)) + 100)} and rollups.standing().count() == 400
    with pytest.raises(Exception, match="no such op"):
        rollups.commit("3", one.selectExpr("'upsert' as op", "doc_id", "source", "lang", "tokenizer", "n_tokens"))


def test_counts_of_awkward_texts(spark):
    rows = [("a", None, "s", "en", 1), ("b", "", None, None, 1), ("b", "", None, None, 1), ("c", "word " * 30_000, "s", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    got = sorted((r["doc_id"], r["n_tokens"]) for r in token_rollups.count_tokens(docs).collect())
    assert got == [("a", 0), ("b", 0), ("b", 0), ("c", len(library.encode(rows[3][1])))]
    assert token_rollups.count_tokens(docs.where("false")).count() == 0


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        labels[r["doc_id"]].append((r["toxic"], r["quality"]))
    standing = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text, marks = r["text"] or "", labels.get(r["doc_id"], [])
        if any(t == 1 for t, _ in marks):
            continue
        if marks and min(q for _, q in marks) == 0 and max(t for t, _ in marks) == 0:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        standing[r["doc_id"], "piece_bpe_32k"] = (r["source"], r["lang"], len(library.encode(text)))
    rows = queries.op9_token_rollups(spark, folder).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rows} == sums(standing)


def test_the_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "_TASK_CACHE", 7)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    codec, rng = sentencepiece_bpe.PieceCodec(sentencepiece_bpe.default_model()), random.Random(3)
    for _ in range(300):
        text = " ".join(rng.choice(["the", "of", "running", "é漢字", "x" * 90, "\n", "12,5", f"w{rng.randrange(500)}"]) for _ in range(30))
        assert codec.encode(text) == library.encode(text) and codec.count(text) == len(library.encode(text))
        assert len(codec.runs) + len(codec.runs.old) <= 14 and len(codec.counts) + len(codec.counts.old) <= 14
