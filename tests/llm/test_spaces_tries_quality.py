"""Whitening against plain numpy, the prefix trie against nested Python dicts, quality rules against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quorumtext.llm import prefix_trie, quality, whitening


# ---------------------------------------------------------------- whitening

@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 40), np.r_[np.full(10, 5.0), np.full(5, 5 * (1 + 1e-9)), np.linspace(1, 2, 25)], np.r_[np.full(39, 1.0), 7.0], np.zeros(3), np.full(6, 2.0),
    np.array([4.0]), np.array([1e300, 1.0, 1e-300]),
])
def test_refined_eigenvectors(values):
    rng = np.random.default_rng(0)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0] if d > 3 else np.eye(d)
    a = (q * values) @ q.T
    a = ((a + a.T) / 2).astype(np.longdouble)
    got, x = whitening.refine(a)
    scale = max(np.abs(values).max(), 1e-300)
    assert np.abs(a @ x - x * got).max() <= 1e-15 * scale * d
    assert np.abs(x.T @ x - np.eye(d)).max() <= 1e-15
    assert np.abs(got - np.sort(values)[::-1]).max() <= 1e-14 * scale and (np.diff(got) <= 0).all()


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")


def test_whitening(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(300, 6)), axis=1)
    x[100:200] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (None, x[7].tolist())]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    clean = whitening.clean_vectors(vectors(spark, rows + bad + [(950, [1.0, 2.0]), (951, [3.0, 2.5]), (952, [0.1, 0.7])]))
    spaces = whitening.fit_spaces(clean)
    out = whitening.whiten(clean, spaces).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r.component):
        got[r.vec_id].append(r)
    assert set(got) == {*range(300), None, 950, 951, 952} and len(got[5]) == 8 and len(got[0]) == 4 and len(got[950]) == 2
    z = np.floor(256 * x).astype(np.int64)
    u = np.unique(z, axis=0)
    n, s = len(u), u.sum(0)
    v = np.cov(u.T, bias=True)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    want = (z - s / n) @ w[:, :4] / np.sqrt(e[:4])
    for i in range(300):
        for k in range(4):
            r = got[i][k * len(got[i]) // 4]
            assert (r.component, r.n, r.deviation) == (k + 1, n, int(((n * z[i] - s) ** 2).sum()))
            assert abs(r.whitened) == pytest.approx(abs(want[i, k]), rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(e[k] / e.sum()) and r.identity_error < 1e-10


def test_whitening_without_variance(spark):
    one = whitening.clean_vectors(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])]))
    out = whitening.whiten(one, whitening.fit_spaces(one)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(k, 1, 0, None, None, None) for k in (1, 2, 3)] * 2
    line = whitening.clean_vectors(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(5)]))
    out = whitening.whiten(line, whitening.fit_spaces(line)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in out) and {r.explained for r in out if r.component == 1} == {1.0}
    huge = whitening.clean_vectors(vectors(spark, [(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])]))
    out = whitening.whiten(huge, whitening.fit_spaces(huge)).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out if r.vec_id < 3)
    none = one.limit(0)
    assert not whitening.whiten(none, whitening.fit_spaces(none)).collect()


# ---------------------------------------------------------------- prefix trie

def trie_nodes(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:2])] for c, v in own.items()}
    nodes, kids, leaves, saved = {}, collections.defaultdict(list), {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), ([], []))[0].append(c)
        nodes[tuple(seq)][1].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(nodes[k][0]) - 1) * len(k[-1][1]) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]][0]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(e)) for k, (m, e) in nodes.items()
    )


CONVERSATIONS = "conv_id long, turn long, role string, text string, pa int, d string"


@pytest.mark.parametrize("light,bundle,stretch", [(100_000, 200_000, 65_536), (12, 60, 4), (1, 5, 2)])
def test_prefix_trie(spark, monkeypatch, light, bundle, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rng, rows = random.Random(light), []
    for c in [*range(-130, -95), *range(0, 40), *range(100, 160), 12345]:
        for t in range(rng.choice([1, 1, 2, 3, 7, 9])):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["u", "a", None]), rng.choice(["", None, "é b", "x" * 5])))
    rows += [(300, t, "u", "same") for t in range(70)]  # a long one
    rows += [(c, t, "u", "hot") for c in range(400, 460) for t in range(6)]  # equal ones
    rows += [(None, 1, "u", "x"), (200, None, None, None), (7000, 3, "u", "y" * 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie.prefix_nodes(df, light=light, bundle=bundle).collect())
    assert got == trie_nodes(rows)


def test_prefix_trie_of_nothing(spark):
    assert not prefix_trie.prefix_nodes(spark.createDataFrame([], CONVERSATIONS)).collect()


def test_double_array():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.choice([rng.randrange(400), 3]) for _ in range(rng.randint(1, 6))) for _ in range(700)})
    levels = []
    for d in range(6):
        who = [i for i, s in enumerate(seqs) if len(s) > d]
        levels.append((np.array(who), np.array([seqs[i][d] for i in who])))
    trie = prefix_trie.pack(levels, len(seqs))
    place = {}
    for s in seqs:
        at = np.zeros(1, np.int64)
        for d, c in enumerate(s):
            at = trie.step(at, np.array([c]))
            assert at[0] > 0 and place.setdefault(int(at[0]), s[: d + 1]) == s[: d + 1]
    assert len(place) == len({s[:d] for s in seqs for d in range(1, len(s) + 1)})
    assert trie.step(np.zeros(1, np.int64), np.array([10**6]))[0] == -1


# ---------------------------------------------------------------- quality

def test_quality(spark):
    rng = random.Random(2)
    good = [f"w{k}" for k in range(60)]
    junk = [f"zz{k}" for k in range(60)]
    prose = lambda v, n: re.sub(r"(\S+ \S+ \S+ \S+ \S+) ", r"\1\n", " ".join(rng.choices(v, k=n)))
    texts = [prose(good, rng.randint(55, 200)) for _ in range(60)] + [prose(junk, rng.randint(55, 200)) for _ in range(20)]
    texts += [prose(good, 20), "a b c " * 40, "line one\nline one\n \n\t\nline one\n" + prose(good, 80), None, "", " \n\t ", "#*$%&|<>" * 20, prose(good, 20_000), "é\u00a0x\u2003y z\x0bq"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (3, texts[3], "x", 1), (3, texts[70], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    labels = [(i, 1, 0) for i in range(40)] + [(62, 1, 0), (62, 0, 0), (63, 1, 1), (64, None, None), (None, 1, 0), (9999, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = quality.trusted_rows(docs, labels)
    ratio = quality.fit(docs, trusted, buckets=500)
    got = collections.Counter(tuple(r) for r in quality.quality(docs, ratio).collect())

    word = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    long = lambda n: n - (1 << 64) if n >> 63 else n
    h = lambda w: long(xxhash.xxh64_intdigest(w.encode(), seed=42))

    def grams(w):
        own = [h(x) for x in w]
        pairs = [long(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42))) for a, b in zip(own, own[1:])]
        return [x % 500 for x in own + pairs]

    trust = [r for r in rows if r[0] is not None and r[0] < 40]
    count = lambda rs: collections.Counter(b for r in rs for b in grams(word(r[1])))
    target, raw = count(trust), count(rows)
    shift = math.log((sum(raw.values()) + 500) / (sum(target.values()) + 500))
    weight = [round(1e6 * (math.log((target[b] + 1) / (raw[b] + 1)) + shift)) for b in range(500)]
    assert weight == ratio.weights
    score = lambda w: sum(weight[b] for b in grams(w)) // (2 * len(w) - 1)
    own = [score(word(r[1])) for r in trust]
    cut = math.floor(sum(own) / len(own) - 5 * np.std(own))
    assert abs(cut - ratio.threshold) <= 1
    want = collections.Counter()
    for i, t, *_ in rows:
        w = word(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen = collections.Counter(windows)
        again = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if word(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        s = score(w) if w else None
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), failed, s, not failed and s >= ratio.threshold] += 1
    assert got == want
    kept = {r[0] for r in got if r[8]}
    assert {*range(60)} <= kept and not kept & {*range(61, 80)}


def test_quality_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 60 + " ".join(f"b{i}" for i in range(90))), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ratio = quality.fit(docs, quality.trusted_rows(docs, labels))
    assert ratio.threshold is None and [(r.doc_id, r.kept) for r in quality.quality(docs, ratio).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    none = docs.limit(0)
    assert not quality.quality(none, quality.fit(none, none)).collect()
