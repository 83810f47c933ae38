"""Cases that the other tests leave out: repeated rows, rows without ids, hot prefixes, odd labels, and the pipeline stage by stage."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_small_cases import awkward, brute_components, empty, words
from veilflow.llm import licenses, near_dedup, sentencepiece_bpe, severity, substrings
from veilflow.llm.components import components
from veilflow.llm.scratch import Scratch

FOLDER = "/root/testdata/sf0.001"


def repeated_words(texts, length):
    """For each text, its words and the places of those that a repeated window covers."""
    texts = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    return [(w, {p for s in range(len(w) - length + 1) if seen[tuple(w[s : s + length])] > 1 for p in range(s, s + length)}) for w in texts]


@pytest.mark.parametrize("hot", [0, 40, 10**9])
def test_hot_anchors_are_dealt_by_whole_windows(spark, hot):
    """One phrase in many contexts, some of them twice: the starts are the same however its windows are dealt."""
    rng = np.random.default_rng(7)
    phrase, contexts = [f"p{i}" for i in range(12)], [[f"c{x}" for x in rng.integers(0, 9, 40)] for _ in range(60)]
    texts = [" ".join(c[:20] + phrase + c[20:]) for c in contexts] + [" ".join(contexts[i][5:20] + phrase + contexts[i][20:] + ["z"]) for i in range(0, 60, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(7)
    found = {}
    for r in substrings.repeated_starts(docs, 20, hot_windows=hot).collect():
        found.setdefault(r["row"], set()).update(np.frombuffer(r["starts"], np.int32).tolist())
    every = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 20]) for w in every for i in range(len(w) - 19))
    want = {k: {i for i in range(len(w) - 19) if seen[tuple(w[i : i + 20])] > 1} for k, w in enumerate(every)}
    assert found == {k: v for k, v in want.items() if v} and any(want.values()) and not all(want.values())


def test_substrings_of_repeated_rows_and_rows_without_ids(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, text), (None, "alone"), (2, None), (3, text + " more"), (3, "other")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect())
    assert got == sorted((i or 0, len(w), len(g)) for (i, _), (w, g) in zip(rows, repeated_words([t for _, t in rows], 35), strict=True))


def test_near_duplicates_of_repeated_rows_and_rows_without_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, a), (None, a), (7, a + " x"), (3, b), (5, b), (9, None), (9, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (0, None) in got and set(got) - {(0, None)} == {(3, 3), (5, 3), (7, 3), (9, 9)}
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {None, 3, 9}
    with pytest.raises(TypeError):
        near_dedup.near_duplicates(spark.createDataFrame([("x", a)], "doc_id string, text string"))


@pytest.mark.parametrize("block,most", [(7, None), (10**6, None), (10**6, 10**6), (7, 10**6)])
def test_components_of_blocks_of_links(spark, block, most):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, x)) for x in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2030)] + [(5, 5), (2001, 2000)]
    parent = {}

    def root(x):
        return x if parent.setdefault(x, x) == x else root(parent[x])

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(parent) if root(x) != x}
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3), Scratch(spark), most=most, block=block).collect()
    assert len(got) == len(want) and {r["id"]: r["component"] for r in got} == want


def test_near_duplicates_over_many_partitions(spark):
    """Few documents dealt over many partitions: a step has few tasks, and the groups are the same."""
    rng = np.random.default_rng(5)
    base, rows = [f"v{i}" for i in range(120)], []
    for i in range(60):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 9), replace=False):
            w[p] = f"n{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c) for c in conf}
    sc = spark.sparkContext
    sc.setJobGroup("many", "")
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85, den=100, leaf=8).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for c, v in was.items():
            spark.conf.set(c, v)
    assert got == brute_components(dict(rows), 3, 85, 100)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("many") for s in track.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))
    assert 0 < tasks < 1600  # 900 or so; 2784 when each step had all partitions


def test_near_duplicates_of_sparse_groups_over_many_partitions(spark):
    """Documents that share a passage but are less than half alike: few levels, and the groups are the same."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"o{i}-{j}" for j in range(30 + i % 5))])) for i in range(60)]
    rows += [(100 + i, rows[i][1] + f" last{i}") for i in range(0, 60, 7)]
    lone = [(1000 + i, " ".join(f"x{i}-{j}" for j in range(4))) for i in range(6000)]
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c) for c in conf}
    sc = spark.sparkContext
    sc.setJobGroup("sparse", "")
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        docs = spark.createDataFrame([(*row,) for row in [*rows, *lone]], "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k=3, num=85, den=100, leaf=4, block_points=8).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for c, v in was.items():
            spark.conf.set(c, v)
    assert got == brute_components(dict(rows), 3, 85, 100) | {i: (2, i) for i, _ in lone}
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("sparse") for s in track.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))
    assert 0 < tasks < 850  # 567; 1131 when each inner step had all partitions and sparse groups were branched


@pytest.mark.parametrize("seed", range(6))
def test_links_of_one_cell(seed):
    """The links of a cell join what all its pairs at the threshold join."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 400, 60) for _ in range(4)]
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.03, 0.1, 0.5]), rng.integers(0, 3000, 60), base[i % 4])) for i in range(90)] + [np.empty(0, np.int64)]
    comps = rng.integers(0, 40, len(sets)) * 3
    where = [(i, True) for i in range(len(sets)) if comps[i] > 30] + [(i, False) for i in range(len(sets))]
    at, rest = np.array([i for i, _ in where]), np.array([r for _, r in where])

    def joined(links):
        label = {int(c): int(c) for c in comps}
        for i, j in links:
            a, b = label[int(comps[i])], label[int(comps[j])]
            label = {k: a if v == b else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    alike = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) > 0
    want = [(i, j) for i in at[rest] for j in range(len(sets)) if comps[i] != comps[j] and alike(i, j)]
    got = near_dedup._cell_links(at, comps[at], rest, np.array([len(sets[i]) for i in at]), np.concatenate([sets[i] for i in at]), 85, 100)
    assert want and all(alike(i, j) for i, j in got)
    assert joined(got) == joined(want) and len(got) == len(joined([])) - len(joined(want))


def test_severity_of_odd_labels_and_without_any(spark):
    rows = [(i, f"n{i} word{i % 7} plain text " + ("vilebad " * (1 + i % 3) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd = [(0, 0), (0, 1), (4, None), (None, 1), (10**6, 1)]  # one document with both labels, labels without a value, an id or a document
    labels = table.select("doc_id", "toxic").unionByName(spark.createDataFrame(odd, "doc_id long, toxic int"))
    sample = severity.labelled_sample(table, labels)
    assert sample.count() == 200 and sample.where("label = 1").count() == 50
    model = severity.fit_severity(sample)
    again = severity.fit_severity(severity.labelled_sample(table.unionByName(table), labels))  # equal texts count once
    assert model == again and model.weights and min(model.weights.values()) > 0
    assert {r["doc_id"] for r in severity.score_severity(table, model).where("toxic").collect()} == {i for i, _, t in rows if t}
    none = severity.fit_severity(severity.labelled_sample(table, labels.where("false")))
    scored = severity.score_severity(awkward(spark), none).collect()
    assert {(r["severity"], r["p_toxic"], r["grade"], r["toxic"]) for r in scored} == {(0.0, 0.0, 0, False)}
    assert severity.score_severity(empty(spark), model).count() == 0 and severity.fit_severity(severity.labelled_sample(empty(spark), labels)) == none


def test_weights_are_fitted_again_without_those_that_are_not_positive(monkeypatch, spark):
    fits, fit = [], severity.fit_ordinal

    def watched(rows, cols, values, y, n, *rest):
        w, theta = fit(rows, cols, values, y, n, *rest)
        fits.append(n)
        if len(fits) == 2 and n > 1:
            w[0] = -1.0
        return w, theta

    monkeypatch.setattr(severity, "fit_ordinal", watched)
    rows = [(i, f"n{i} word{i % 7} text " + ("vilebad " if i % 4 == 0 else "") + ("grimnasty" if i % 8 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = severity.fit_severity(severity.labelled_sample(*[spark.createDataFrame(rows, "doc_id long, text string, toxic int")] * 2))
    assert len(fits) == (3 if fits[1] > 1 else 2) and fits[-1] == len(model.weights)


def test_licenses_of_awkward_texts(spark):
    mit = licenses.TEMPLATES["MIT"]
    far = "filler " * 200_000
    rows = [(1, far + mit + " " + far, "c"), (2, "", "c"), (2, mit, "c"), (2, mit, "c"), (None, mit, "c"), (4, f"{mit} {mit}", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r["doc_id"] or 0, r["start_word"], r["coverage"]) for r in licenses.scan_licenses(docs).where("license = 'MIT'").collect())
    size = len(licenses.plain_hashes(pa.array([mit]))[0])
    assert got == [(0, 0, 1.0), (1, 200_000, 1.0), (2, 0, 1.0), (2, 0, 1.0), (4, 0, 1.0), (4, size, 1.0)]
    assert licenses.scan_licenses(empty(spark)).count() == 0 and licenses.scan_licenses(awkward(spark)).count() == 0


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before kept, as run() does."""
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    held = lambda frame: {r["doc_id"]: r["text"] for r in frame.collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    clean = stages["toxicity"](spark, docs, FOLDER).cache()
    before, kept = held(docs), held(clean)
    wrong = len((set(before) - set(kept)) ^ (toxic & set(before)))
    assert wrong <= 0.1 * len(before) and all(kept[i] == before[i] for i in kept)

    unlike = stages["near_duplicates"](spark, clean, FOLDER).cache()
    groups = brute_components(kept, 5, 80, 100)
    assert held(unlike) == {i: t for i, t in kept.items() if groups[i][1] == i}

    cut = stages["substring_dedup"](spark, unlike, FOLDER).cache()
    texts = list(held(unlike).items())
    want = {i: [x for p, x in enumerate(w) if p not in gone] for (i, t), (w, gone) in zip(texts, repeated_words([t for _, t in texts], 50), strict=True) if not gone or len(gone) < len(w)}
    assert {i: (t or "").encode().split() for i, t in held(cut).items()} == want

    bare = stages["decontamination"](spark, cut, FOLDER).cache()
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = sorted({len(w) for w in windows})
    want = {}
    for i, text in held(cut).items():
        w = words(text)
        gone = {p for n in sizes for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        if not gone or len(gone) < 0.8 * len(w):
            want[i] = [x for p, x in enumerate(w) if p not in gone]
    assert {i: words(t) for i, t in held(bare).items()} == want

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    out = stages["sentencepiece"](spark, bare, FOLDER).collect()
    assert {r["doc_id"] for r in out} == set(want)
    for r in out:
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["round_trip"] == (lib.decode(ids) == (r["text"] or ""))


def test_digests_of_given_texts_against_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r for r in sentencepiece_bpe.round_trip_digests(docs).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want
