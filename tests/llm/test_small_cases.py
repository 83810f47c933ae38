"""Each operator against brute force and on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from veilflow.llm import decontamination, licenses, near_dedup, neighbours, sentencepiece_bpe, severity, sharding, substrings, token_rollups, warc
from veilflow.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket int, ids string, node string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def awkward(spark):
    texts = [
        None, "", "   ", "one", "one two", "one two three", "The quick brown fox jumps over the lazy dog again and again", "The quick brown fox jumps over the lazy dog again and again",
        "x" * 70_000, " ".join(f"w{i % 977}" for i in range(20_000)), PASSAGE, f"lead words {PASSAGE} and a tail", f"{PASSAGE} then {PASSAGE}", "é ß 漢字 😀\tb\x0bc\nd", "a " * 400, "a " * 300, "b " * 100 + PASSAGE,
    ]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 2}", None if t is None else len(t), "clash", 7, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark):
    docs = awkward(spark)
    rows = sharding.shard_interleaved(docs, 4).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    assert sharding.shard_interleaved(empty(spark), 4).count() == 0


def test_shards_hold_the_mixture(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source")
    total = Counter(r["source"] for r in docs.collect())
    for shard in range(8):
        got = Counter(r["source"] for r in sharding.shard_interleaved(docs, 8).where(F.col("shard") == shard).collect())
        assert all(abs(got[s] - n / 8) <= 1.5 for s, n in total.items())


def test_sentencepiece(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    docs = awkward(spark)
    for r in sentencepiece_bpe.decode_ids(sentencepiece_bpe.encode_texts(docs)).collect():
        want = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert list(r["ids"]) == want and r["decoded"] == lib.decode(want)
    codec = sentencepiece_bpe.codec(sentencepiece_bpe.default_model())
    rng = np.random.default_rng(3)
    for _ in range(500):
        ids = rng.integers(0, 300, rng.integers(0, 9)).tolist()
        assert codec.decode(ids) == lib.decode(ids)
    assert sentencepiece_bpe.round_trip_digests(empty(spark)).count() == 0


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination(spark, bound):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (5, "b b b b b b b b b b b")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.contamination(docs, items, 10, bound).collect()}
    windows = defaultdict(set)
    for r in items.collect():
        w = words(r["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(r["item_id"])
    for r in docs.collect():
        w = words(r["text"])
        hit, found = set(), set()
        for win, ids in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items"]) == (len(w), len(hit), len(found), sorted(map(str, found)))
    clean = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, items, 10, drop_share=0.95, max_broadcast_windows=bound).collect()}
    assert clean[11] == "lead words and a tail" and 10 not in clean and clean[6] == docs.where("doc_id = 6").first()["text"] and clean[0] is None
    assert decontamination.contamination(empty(spark), items).count() == 0
    assert decontamination.contamination(docs, items.where("false")).where("contaminated").count() == 0


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=3, num=85, den=100).collect()}
    assert got == brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, 3, 85, 100)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_large_alike_groups(spark):
    """A chain of edits around the threshold: leaves, pivots, blocks and several components in one node."""
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 9), replace=False):
            w[p] = f"n{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=3, num=85, den=100, leaf=8, block_points=32).collect()}
    assert got == brute_components(dict(rows), 3, 85, 100)


def test_substrings(spark):
    docs = awkward(spark)
    length = 35
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    seen = Counter(tuple(w[i : i + length]) for w in texts.values() for i in range(len(w) - length + 1))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removal_digests(docs, length).collect()}
    for i, w in texts.items():
        gone = {p for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for p in range(s, s + length)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    cut = {r["doc_id"]: r for r in substrings.remove_repeats(docs, length).collect()}
    assert cut[11]["text"] == "lead words and a tail" and cut[11]["n_chars"] == len(cut[11]["text"]) and 10 not in cut and cut[0]["text"] is None
    assert cut[11]["h"] == "clash" and substrings.removal_digests(empty(spark), length).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[3].tolist()) for i in range(40)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    known = dict(rows)
    hits = 0
    assert set(got) == {i for i in known if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-float(np.dot(known[q], v)), i) for i, v in known.items() if i != q)[:5]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s - np.dot(known[q], known[i])) < 1e-9 for _, i, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert neighbours.search(table.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e6, 1e150])
def test_neighbours_at_any_scale_with_odd_rows(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16)) * scale
    rows = [(i, v.tolist(), "clash", [1.0]) for i, v in enumerate(x)] + [(700, x[0].tolist(), "clash", [1.0]), (0, x[0].tolist(), "clash", [1.0]), (800, [1.0, 2.0], "c", [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v array<double>")
    got = defaultdict(set)
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k=10).collect():
        got[r["query_id"]].add(r["vec_id"])
    known = {i: np.array(v) / scale for i, v, *_ in rows if len(v) == 16}
    hits = sum(len(got[q] & {i for _, i in sorted((-float(known[q] @ v), i) for i, v in known.items() if i != q)[:10]}) for q in got)
    assert set(got) == {i for i in known if i % 20 == 0} and hits >= 0.97 * 10 * len(got)


def test_neighbours_of_a_dense_cluster_in_many_cells(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([5 + 0.2 * rng.standard_normal((1600, 24)), rng.standard_normal((200, 24))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vertices = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, v binary").cache()
    graph = neighbours.build_graph(vertices, Scratch(spark), degree=20, rounds=2, cell=40).collect()
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    worst = np.sort(scores, axis=1)[:, -20]
    hits = sum((scores[r["id"]][np.frombuffer(r["ids"], np.int64)] >= worst[r["id"]] - 1e-6).sum() for r in graph)
    assert hits >= 0.9 * 20 * len(x)


def test_severity(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        w = [f"word{rng.integers(0, 300)}" for _ in range(40)]
        toxic = i % 5 == 0
        for p in rng.choice(40, rng.integers(1, 7), replace=False) if toxic else ():
            w[p] = str(rng.choice(["vilebad", "nastier", "grimstem" + str(rng.integers(0, 99))]))
        rows.append((i, " ".join(w), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train, held = table.where("doc_id < 450"), table.where("doc_id >= 450")
    model = severity.fit_severity(severity.labelled_sample(train, train.select("doc_id", "toxic")))
    scored = {r["doc_id"]: r for r in severity.score_severity(held, model).collect()}
    right = sum(scored[i]["toxic"] == bool(t) for i, _, t in rows if i >= 450)
    assert right >= 0.97 * 150 and list(model.thresholds) == sorted(model.thresholds)
    assert severity.score_severity(awkward(spark), model).where("toxic").count() == 0
    assert not severity.fit_severity(severity.labelled_sample(train, train.select("doc_id", "toxic").where("false"))).weights
    assert severity.drop_toxic(held, model).columns == held.columns


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    docs = spark.createDataFrame([(1, f"before {mit} after"), (2, mit.replace("merge, publish,", "")), (3, "Released under the MIT License. Released under the MIT license"), (4, None), (5, "nothing here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"], r["coverage"], r["start_word"]) for r in licenses.scan_licenses(docs).collect())
    assert [g[:3] for g in got if g[0] == 1] == [(1, "MIT", 1.0)] and got[0][3] == 1
    assert [g[1] for g in got if g[0] == 2] == ["MIT"] and 0.9 < [g[2] for g in got if g[0] == 2][0] < 1
    assert [g[1:] for g in got if g[0] == 3] == [("MIT-notice", 1.0, 0), ("MIT-notice", 1.0, 5)]
    assert not [g for g in got if g[0] > 3]


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "response", "http://www.a.org/x/index.html#f", 1.0, h(etag='"1"', content_type="text/html", age="0"), "d1", 200), (2, "response", "https://a.org/x", 2.0, h(etag='"2"'), "d2", 200),
        (3, "revisit", "https://a.org/x?utm_source=z", 3.0, h(etag='W/"1"', age="9", content_length="0"), "d1", 304), (4, "revisit", "https://a.org/x", 3.0, {}, "d2", 304),
        (8, "response", "https://a.org/y", 1.0, h(last_modified="m1"), "dy", 200), (9, "revisit", "https://a.org/y", 2.0, h(etag='"7"', last_modified="m1"), "other", 304),
        (10, "response", "https://a.org/z", 1.0, None, "dz", 200), (11, "revisit", "https://a.org/z", 1.0, h(etag='"7"'), "dz", 304), (12, "revisit", "https://a.org/z", 1.0, None, "dz", 304), (12, "revisit", "https://a.org/z", 1.0, None, "dz", 304),
        (5, "revisit", "https://a.org/x", 0.5, h(etag='"1"'), "d1", 304), (6, "revisit", None, 3.0, {}, "d1", 304), (7, "revisit", "https://a.org/x", 3.0, h(etag='"9"'), "d9", 304),
    ]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, date double, headers map<string,string>, digest string, status int")
    got = {r["record_id"]: r for r in warc.resolve_revisits(records, slices=3).collect()}
    assert {i: r["refers_to"] for i, r in got.items()} == {3: 1, 4: 2, 5: None, 6: None, 7: None, 9: 8, 11: 10, 12: 10}
    assert warc.resolve_revisits(records, slices=3).where("record_id = 12").count() == 2
    assert got[3]["headers"] == {"content-type": "text/html", "etag": 'W/"1"', "age": "9"}
    assert warc.resolve_revisits(records.where("false")).count() == 0


def test_canonical_addresses_and_bursts(spark):
    pairs = [
        ("HTTP://www.A.org:80/x/index.html?b=2&a=1&utm_source=q#top", "https://a.org/x?a=1&b=2"), ("https://a.org:443/", "https://a.org"), ("https://a.org:80/", "https://a.org:80"), ("http://a.org:443/x", "https://a.org:443/x"),
        ("https://a.org/about.html", "https://a.org/about.html"), ("https://a.org/about", "https://a.org/about"), ("https://a.org/xindex.html", "https://a.org/xindex.html"), ("https://a.org/?ref=main", "https://a.org?ref=main"),
        ("https://a.org/?ref=dev", "https://a.org?ref=dev"), ("ftp://a.org/x/", "ftp://a.org/x"), ("https://a.org/d/index.htm", "https://a.org/d"), ("no address", None), (None, None),
    ]
    got = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(pairs)], "k int, u string").select("k", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in got} == {k: c for k, (_, c) in enumerate(pairs)}
    # A burst: most captures of one address within one second of a long log, each answer meant for the body before it.
    rows = [(2 * i, "response", "https://a.org/x", 1e6 + i / 1000, {"etag": f'"{i // 3}"'}, "d", 200, "clash") for i in range(400)] + [(2 * i + 1, "revisit", "https://a.org/x", 1e6 + i / 1000, {"etag": f'"{i // 3}"'}, "d", 304, "clash") for i in range(400)]
    rows += [(9000 + i, "response", "https://a.org/y", i * 1e5, {}, "e", 200, "clash") for i in range(30)]
    records = spark.createDataFrame(rows, "record_id long, kind string, url string, date double, headers map<string,string>, digest string, status int, slice string")
    assert all(r["refers_to"] == r["record_id"] - 1 for r in warc.resolve_revisits(records, slices=16).collect())


def test_rollups(spark):
    change = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    rollups = token_rollups.Rollups(spark, Scratch(spark).path("r"))
    first = spark.createDataFrame([("insert", 1, "a", "en", "t", 10), ("insert", 2, "a", "en", "t", 5), ("insert", 3, None, "en", "t", 7)], change)
    assert rollups.commit("1", first) and not rollups.commit("1", first)
    second = spark.createDataFrame([("delete", 1, "a", "en", "t", None), ("revise", 2, "b", "en", "t", 6), ("delete", 9, "z", "en", "t", None), ("revise", 4, "a", "en", "t", 1)], change)
    assert rollups.commit("2", second) and not rollups.commit("2", second)
    assert rollups.commit("3", first.where("false"))
    want = {(None, 1, 7), ("b", 1, 6), ("a", 1, 1)}
    assert {(r["source"], r["n_docs"], r["n_tokens"]) for r in rollups.totals().collect()} == want
    rollups.compact()
    read = lambda: {(r["source"], r["n_docs"], r["n_tokens"]) for r in rollups.totals().collect()}
    assert read() == want and sorted(r["batch"] for r in rollups.batches().collect()) == ["1", "2", "3"]
    assert not rollups.commit("1", first) and read() == want  # delivered again after compaction
    assert rollups.commit("4", spark.createDataFrame([("insert", 8, "a", "en", "t", 2)], change)) and ("a", 2, 3) in read()
    tied = spark.createDataFrame([("revise", 8, "a", "en", "t", 4, 1), ("revise", 8, "a", "en", "t", 9, 2), ("revise", 8, "a", "en", "t", 5, 2), ("insert", 5, None, None, "t", None, 1)], change + ", seq int")
    assert rollups.commit("5", tied) and ("a", 2, 10) in read()  # the last by seq, the largest of equals


def test_pipeline_keeps_what_is_clean(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) <= set(docs) and len(out) > 0.6 * len(docs) and all(r["round_trip"] for r in out.values())
    groups = brute_components(docs, 5, 80, 100)
    assert all(groups[i][1] == i or groups[i][1] not in out for i in out)


def test_sources_of_one_row_and_rows_without_ids_part(spark):
    docs = spark.range(4000).selectExpr("CASE WHEN id < 1000 THEN NULL ELSE id END AS doc_id", "concat('t', id) AS text", "CASE WHEN id < 1000 THEN 'hot' ELSE concat('s', id) END AS source")
    rows = sharding.shard_interleaved(docs, 8).collect()
    assert max(Counter(int(r["fraction"] * 1024) for r in rows).values()) < 40  # a place of the 1,024: no task sees many
    hot = Counter(r["shard"] for r in rows if r["source"] == "hot")
    assert sorted(Counter(r["shard"] for r in rows).values()) == [500] * 8 and all(abs(hot[s] - 125) <= 40 for s in range(8))
    same = spark.createDataFrame([(1, "a", "s")] * 5 + [(None, None, None)] * 3, "doc_id long, text string, source string")
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard_interleaved(same, 4).collect()) == [(s, k) for s in range(4) for k in range(2)]


@pytest.mark.parametrize("bound", [0, 3, 200_000])
def test_decontamination_with_equal_items_and_repeated_rows(spark, bound):
    phrase = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(i, phrase if i < 6 else f"{phrase} own{i}") for i in range(9)] + [(9, None), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {phrase} b"), (1, f"a {phrase} b"), (1, "clean"), (None, f"{phrase} own7"), (None, None), (2, f"{phrase} {phrase}".upper())], "doc_id long, text string")
    rows = decontamination.contamination(docs, items, 10, bound).select("doc_id", "n_words", "n_hit", "items").collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in rows)
    every = [str(i) for i in range(9)]
    assert got == [(0, 0, 0, []), (0, 13, 13, every), (1, 1, 0, []), (1, 14, 12, every), (2, 24, 24, every)]
