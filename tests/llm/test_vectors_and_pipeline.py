"""Nearest neighbours against all pairs, components against union-find, the pipeline's stages on planted rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumtext.llm import graph, mih
from quorumtext.llm.common import prefix_sums
from quorumtext.llm.graph import components


def exact(ids, x, query, k):
    norm = np.sqrt((x * x).sum(1))
    i = int(np.flatnonzero(ids == query)[0])
    score = (x * x[i]).sum(1) / (norm * norm[i])
    score[ids == query] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]].tolist()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 24))
    x[200:260] = x[200]  # equal vectors: ties go to smaller ids
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(x)]
    bad = [(5000, None, 0.0), (5001, [0.0] * 24, 0.0), (5002, [float("nan")] + [1.0] * 23, 0.0), (5003, [None] + [1.0] * 23, 0.0), (5004, [1e308 * 10] + [1.0] * 23, 0.0)]
    df = spark.createDataFrame(rows + bad + [(6000, [1.0, 2.0], 0.0), (6050, [2.0, 4.1], 0.0)], "vec_id long, embedding array<double>, score double")
    base = mih.clean_vectors(df)
    rotation = mih.fit_rotation(base, sample=500)
    got = mih.nearest(base.where("vec_id % 50 = 0"), base, rotation, least=80, block=300, query_block=5).orderBy("query_id", "rank").collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r.query_id].append(r.vec_id)
    ids = np.arange(900)
    want = {q: exact(ids, x, q, 5) for q in range(0, 900, 50)}
    assert set(found) == {*want, 6000, 6050} and found[6000] == [6050] and found[6050] == [6000]
    assert sum(len(set(found[q]) & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert found[200] == [201, 202, 203, 204, 205] and [r.rank for r in got[:5]] == [1, 2, 3, 4, 5]
    none = base.limit(0)
    assert not mih.nearest(none, none, mih.fit_rotation(none)).collect()


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    index = mih.Index(codes)
    for q in rng.integers(0, 256, (20, 8), dtype=np.uint8):
        bits = np.unpackbits(codes ^ q, axis=1).sum(1)
        radius = np.sort(bits)[149]
        assert index.within(q, 150).tolist() == np.flatnonzero(bits <= radius).tolist()


@pytest.mark.parametrize("part", [500_000, 20])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)] + [(7, 7)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(30)).collect()}
    assert got == {x: find(x) for x in up}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_prefix_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40), i) for i in range(500)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, v long, i long"), [F.col("g"), F.col("i")], "v", "test").collect()
    total, want = 0, {}
    for g, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        want[i] = total
        total += v
    assert {r.i: r.before for r in got} == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "was", "ter"], "de": ["sch", "ung", "ein", "keit"]}
    word = lambda x: "".join(rng.choices(parts[x], k=rng.randint(1, 4)))
    prose = lambda x, n: " ".join(word(x) for _ in range(n))
    rows, item = [], prose("en", 40)
    for i in range(80):
        x = rng.choice(["en", "de"])
        rows.append([i, prose(x, 120), x, rng.choice(["a", "b", None])])
    for i in range(12):
        rows[i][1] += "\nAll rights reserved here"
    rows += [[100, rows[20][1], "en", "a"], [101, rows[20][1] + " end", "en", "a"], [102, prose("en", 20) + " " + item + " " + prose("en", 20), "en", "b"]]
    rows += [[103, "123 456", "en", "b"], [104, None, "de", "b"], [None, rows[30][1], "de", None], [None, prose("de", 70), "de", None], [50, rows[50][1], rows[50][2], rows[50][3]]]
    # rows that share an id but not a text are judged each by its own text
    rows += [[60, prose("en", 90), "en", "a"], [61, rows[21][1], "en", "a"], [105, prose("en", 30_000), "en", "a"]]
    out = tmp_path_factory.mktemp("corpus")
    docs = [(*r, len(r[1] or ""), "extra", 1) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` string, target int"
    spark.createDataFrame(docs, schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs


def test_pipeline(spark, folder):
    sf, rows = folder
    docs, states = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "test-stage")
        states[name] = docs.collect()
        assert name == "mix" or docs.columns == columns
    ids = lambda name: collections.Counter(r.doc_id for r in states[name])
    assert ids("language") == collections.Counter(r[0] for r in rows if r[0] not in (103, 104))
    assert ids("line_dedup") == ids("language")
    assert not any("All rights" in (r.text or "") for r in states["line_dedup"]) and all(r.n_chars == len(r.text) for r in states["line_dedup"])
    near = ids("near_dup")
    assert near[20] == 1 and near[100] == near[101] == 0 and near[30] == 1 and near[50] == 1 and near[None] == 1
    assert near[60] == 2 and near[61] == near[21] == near[105] == 1
    assert ids("decontaminate") == near - collections.Counter([102])
    sizes = collections.Counter((r.doc_id, len(r.text.split())) for r in states["decontaminate"])
    assert collections.Counter((r.doc_id, r.size) for r in states["mix"]) == sizes
    assert sum(r.taken for r in states["mix"]) == pytest.approx(sum(r.size for r in states["mix"]), abs=3)
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(states["mix"])


def test_stages_on_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.count() == 0
