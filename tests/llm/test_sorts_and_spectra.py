"""Content sort, whitening and spelling variants against brute force, on awkward rows and beyond one partition."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_small_cases import awkward, empty
from veilflow.llm import content_sort, spelling, whitening


def brute_groups(rows, largest):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i), reverse=False)):
            out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
            del k
    return Counter(out)


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(spark, keep, partitions):
    head = "same beginning " * 5
    rows = [(i, "hot text") for i in range(150)] + [(200 + i, f"{head}{i % 40}") for i in range(90)] + [(400, None), (401, ""), (None, "hot text"), (None, None), (402, "x" * 50_000), (403, "x" * 50_000), (403, "x" * 50_000), (404, "x" * 49_999 + "y")]
    docs = spark.createDataFrame([(*r, "clash", 1, "z") for r in rows], "doc_id long, text string, id string, v int, sha string").repartition(5)
    got = content_sort.exact_duplicates(docs, keep=keep, partitions=partitions).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_groups(rows, keep == "largest")
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = content_sort.drop_exact_duplicates(docs, keep=keep, partitions=partitions)
    assert left.columns == docs.columns and len({r["text"] or "" for r in left.collect()}) == len(kept)


def test_exact_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = content_sort.exact_duplicates(docs, keep="largest").collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_groups(rows, True)
    assert content_sort.exact_duplicates(empty(spark)).count() == 0
    one = content_sort.exact_duplicates(docs, normalise=lambda c: F.lit("a"), partitions=6).collect()
    assert {(r["keep_id"], r["group_size"]) for r in one} == {(0, len(rows))} and sum(r["kept"] for r in one) == 1
    with pytest.raises(ValueError):
        content_sort.exact_duplicates(docs, keep="any")


def brute_whitening(rows, k=4):
    """vec_id -> (x, deviation, whitened) and shares, from a full eigendecomposition."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    shares = values / np.trace(y.T @ y / n)
    return n, {i: (sum((n * c - b) ** 2 for c, b in zip(x, s, strict=True)), (np.array(x) - np.array(s) / n) @ vectors / np.sqrt(values)) for i, x in good}, shares


def held(rows, got, k=4):
    n, each, shares = brute_whitening(rows, k)
    k = min(k, len(shares))
    assert len(got) == len(each) * k and {r["n"] for r in got} == {n}
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(1, k + 1):
        sign = 1 if sum(table[i, c]["whitened"] * w[c - 1] for i, (_, w) in each.items()) > 0 else -1
        for i, (deviation, w) in each.items():
            r = table[i, c]
            assert r["deviation"] == deviation and abs(r["whitened"] * sign - w[c - 1]) < 1e-7 and abs(r["explained"] / shares[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((300, 24)) @ np.diag(np.linspace(3, 0.2, 24)) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0].tolist()) for i in range(150)]  # a hot vector
    bad = [(2000, None), (2001, []), (2002, [None] * 24), (2003, [float("nan")] * 24), (2004, [float("inf")] * 24), (2005, [1.0, 2.0]), (2006, [1e300] * 24)]
    frame = spark.createDataFrame([(i, v, "clash", [1], 3) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, wide array<int>, n int").repartition(7)
    held(rows, whitening.whiten(frame).collect())
    assert whitening.whiten(frame.where("false")).count() == 0
    assert whitening.whiten(frame.where("vec_id >= 1000")).count() == 0  # one distinct vector has no directions
    flat = [(0, [1.0, -0.5]), (1, [3.0, -0.5]), (2, [4.5, -0.5]), (2, [4.5, -0.5])]
    got = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_whitening_of_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    from veilflow.llm import queries

    held(rows, queries.op12_embedding_whitening(spark, "/root/testdata/sf0.01").collect())


def test_deviations_beyond_64_bits():
    big = np.array([[2**51, -(2**51)], [0, 1]], np.int64)
    assert whitening._deviations(big, 3, [5, 7]) == [(3 * 2**51 - 5) ** 2 + (3 * 2**51 + 7) ** 2, 25 + 16]


@pytest.mark.parametrize("d, block, most, kind", [(60, 4, 20, "decay"), (40, 3, 14, "equal"), (30, 8, 160, "low rank"), (90, 2, 10, "clusters"), (3, 8, 160, "decay")])
def test_block_lanczos_restarts_and_breakdowns(d, block, most, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"decay": 0.8 ** np.arange(d), "equal": np.r_[np.full(6, 2.0), np.full(d - 6, 1.0)] if d > 6 else None, "low rank": np.r_[[5.0, 4.0], np.zeros(max(0, d - 2))], "clusters": np.r_[[9, 9, 9, 9 - 1e-9], np.linspace(5, 1, max(4, d) - 4)]}[kind]
    v = q @ np.diag(e) @ q.T
    values, vectors = whitening.block_lanczos(lambda b: v @ b, d, 4, block=block, most=most, tol=1e-11)
    k = min(4, d)
    assert np.allclose(values, np.sort(e)[::-1][:k], atol=1e-8) and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9) and np.abs(v @ vectors - vectors * values).max() < 1e-8


def brute_spelling(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, forms = {}, {}
    for w, n in words.items():
        others = [x for k in (-1, 0, 1) for x in by.get(len(w) + k, []) if x != w and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def spelled(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_spelling_groups(spark):
    rng = np.random.default_rng(4)
    base = ["committee", "commitee", "comittee", "aaaaaaaa", "aaaaaaa", "aaaaaaab", "Überraschung", "überraschung", "ÜBERRASCHUNG", "abcdefg", "abcdefh", "bacdefg", "straße×÷ÿ", "z" * 300, "z" * 301, "z" * 299 + "y"]
    rows = [(i, " ".join(base[int(k)] for k in np.minimum(rng.zipf(1.4, 60) - 1, len(base) - 1))) for i in range(120)]
    rows += [(None, "committee's commitee,committee"), (None, None), (500, ""), (501, "short run"), (501, "committee committee"), (501, "committee committee"), (502, "q" * 30_000), (503, "q" * 30_000)]
    # chains of forms: each word ten times as frequent as the one before it
    rows += [(600 + i, t) for i, t in enumerate(["lettera " * 2, "letters " * 30, "fetters " * 400])]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    got = spelled(spelling.spelling_groups(docs))
    assert got == brute_spelling(rows)
    assert got["lettera"][1] == "fetters" and got["aaaaaaaa"][3] >= 2
    assert spelling.spelling_groups(docs.where("false")).count() == 0


def test_spelling_of_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from veilflow.llm import queries

    assert spelled(queries.op13_spelling_variants(spark, "/root/testdata/sf0.001")) == brute_spelling([(r["doc_id"], r["text"]) for r in frame.collect()])


def test_words_that_only_a_hash_joins_are_parted(spark, monkeypatch):
    words = ["committee", "commitzee", "bommittee", "commttee", "entirely", "entirelys", "different"]
    frame = spark.createDataFrame([(w, 2 + i) for i, w in enumerate(words)], "word string, n long")
    want = {(r["word"], r["n_near"], r["best"]) for r in spelling.near_words(frame).collect()}
    import pyarrow as pa

    word = pa.array(words)
    which, place, key = spelling.deletion_keys(word)
    key = (key % np.uint64(3)).view(np.int64)  # nearly everything collides
    order = np.argsort(key, kind="stable")
    take = pa.array(which[order])
    table = pa.table({"key": key[order], "place": place[order].astype(np.int32), "word": word.take(take), "n": pa.array([2 + i for i in range(len(words))], pa.int64()).take(take)})
    got = {}
    for r in spelling._near(table).to_pylist():
        n, best = got.get(r["word"], (0, None))
        got[r["word"]] = (n + r["n_near"], min(filter(None, (best, (-r["best_n"], r["best"])))))
    assert {(w, n, b[1]) for w, (n, b) in got.items()} == want and len(want) == 6
