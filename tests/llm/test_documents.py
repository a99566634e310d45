"""Operators on documents against plain Python, over rows with nulls, ties, repeats, long texts and clashing columns."""

import collections
import random
import re

import pytest

from quorumtext.llm import decontam, html_text, langid, lines, mixing, ngram_join, secret_scan, shingles, suffix, token_trie

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h long, node long, kept string, size string, before int"
BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().lower().split()


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeäß") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        out = [rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n)]
        return re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+ \S+) ", r"\1\n", " ".join(out))

    def edited(text, n):
        w = text.split(" ")
        for _ in range(n):
            w[rng.randrange(len(w))] = "zz" + str(rng.random())
        return " ".join(w)

    rows, common = [], "  The Common LINE é \t"
    base = prose(160)
    for k in range(70):  # a family of near copies, larger than a small bucket
        rows.append(edited(base, rng.choice([1, 1, 2, 3])))
    for k in range(12):
        rows.append(prose(40) + "\n" + common + "\n" + prose(30))
    other = prose(120)
    rows += [other, other, edited(other, 1), edited(other, 2), edited(other, 12), prose(90) + "\n" + other[:450] + "\n" + prose(60)]
    rows += [prose(3), "a", "a", "a b c", "A  b\nC", "", "   \n\t", None, "Ünicode ẞ İ \u00a0 \u2003x", "\n\n", "aaaa" * 300, prose(4000)]
    rows += [f'{prose(9)} password: "abcDEF123" {prose(5)} AKIA{"A1" * 12} {"0f" * 16} toKen=short secret =longer_one', "api-key api_key:x", "ſecret=abcdefgh"]
    docs = [(i, t, rng.choice(["x", "y", None]), rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(rows)]
    docs += [docs[5], docs[73]]  # repeated rows
    docs.append((None, rows[80], None, None, 3))
    docs.append((None, None, None, None, None))
    docs.append((10_000, rows[0], None, "s1", 0))
    rng.shuffle(docs)
    return [(*d, 1, 2, "k", "s", 3) for d in docs]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_line_dedup(docs, rows, none):
    key = lambda x: lower(x.strip(BLANK))
    where = collections.defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            where[key(x)].add(r[0])
    want = collections.Counter()
    for r in rows:
        own = (r[1] or "").split("\n")
        want[r[0], "\n".join(x for x in own if not (key(x) and len(where[key(x)]) >= 10))] += 1
    got = bag(lines.line_dedup(docs).select("doc_id", lines.kept_text("kept")))
    assert got == want
    assert any(len(where[k]) >= 10 for k in where if k)
    assert not lines.line_dedup(none).collect()


def test_mixing(docs, rows, none):
    found = mixing.mix_sources(docs, weights=(1, 5)).collect()
    assert bag(mixing.mix_sources(docs, weights=(1, 5))) == collections.Counter(tuple(r) for r in found)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    taken = collections.Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        target = r.target
        assert target <= 3 * r.source_size + 1e-6
    targets = {r.source: r.target for r in found}
    assert len(found) == len(rows) and abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    weight = {"s1": 1, "s2": 5, None: 1}
    level = max(t / weight[s] for s, t in targets.items())
    assert all(t == pytest.approx(3 * sizes[s]) or t == pytest.approx(level * weight[s]) for s, t in targets.items())
    assert not mixing.mix_sources(none).collect()


def test_mixing_without_words(spark):
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.mix_sources(empty).collect()] == [(0, 0, 0.0)] * 2


def test_secret_scan(docs, rows, none):
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    want = collections.Counter()
    for r in rows:
        found = [(m.start(), k, m.end()) for k, (_, rx, g, least) in enumerate(base) for m in rx.finditer(r[1] or "") if len(m[g]) >= least]
        want[r[0], ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in sorted(found))] += 1
    got = secret_scan.scan_secrets(docs, secret_scan.BASE)
    assert bag(got.select("doc_id", secret_scan.span_text("spans"))) == want
    assert sum(bool(k[1]) for k in want) >= 1
    assert not secret_scan.scan_secrets(none).collect()


def test_trigram_queries():
    ask = secret_scan.trigram_query
    gram = lambda s: ("gram", int.from_bytes(s.encode(), "big"))
    assert ask("[0-9a-f]+") == secret_scan.ALL and ask("(abc)?x") == secret_scan.ALL
    assert ask("ABC") == gram("abc") and ask("(abc|xyz)+") == ("or", (gram("abc"), gram("xyz")))
    assert ask(r"abcd\d*efg") == ("and", (("and", (gram("abc"), gram("bcd"))), gram("efg")))
    # every match satisfies the query of its rule
    samples = ["token = abcdef", "API_KEY:'zzzzzz", "AKIA" + "Z" * 20, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "ab+c://u:p@h"]
    for text in samples:
        for rule in secret_scan.RULES:
            if re.search(rule.pattern, text):
                asked = secret_scan._asked(ask(rule.pattern))
                import numpy as np

                table = np.zeros(1 << 24, bool)
                table[list(asked)] = True
                held = secret_scan._postings([text.encode().lower(), b"none"], table)
                assert 0 in secret_scan._candidates(ask(rule.pattern), held, 2).tolist()


def test_languages(spark, docs, none):
    rng = random.Random(5)
    alphabets = {"aa": ["ka", "lo", "mi"], "bb": ["xu", "yz", "wë"], "cc": ["pr", "st", "ng"]}
    text = lambda x, n: " ".join("".join(rng.choices(alphabets[x], k=3)) for _ in range(n))
    learnt = [(i, text(x, 60), x) for i, x in enumerate(rng.choices(list(alphabets), k=60))] + [(None, None, "aa"), (900, "zz", None)]
    model = langid.learn(spark.createDataFrame(learnt, "doc_id long, text string, lang string"))
    assert model.langs == ["aa", "bb", "cc"]
    tests = [(1, text("aa", 30)), (2, text("bb", 30)), (3, text("aa", 60) + " " + text("cc", 30)), (4, None), (5, "12 ..!"), (6, ""), (7, "k"), (7, "k")]
    got = collections.defaultdict(list)
    for r in langid.infer(spark.createDataFrame(tests, "doc_id long, text string"), model).collect():
        got[r.doc_id].append(r)
        assert 0 <= r.score <= 1
    pred = {k: v[0].lang_pred for k, v in got.items()}
    assert (pred[1], pred[2], pred[3], pred[4], pred[5], pred[6]) == ("aa", "bb", "aa", "und", "und", "und") and pred[7] in model.langs
    assert [s.lang for s in got[3][0].shares] == ["aa", "cc"] and got[3][0].score == pytest.approx(2 / 3, abs=0.07)
    assert len(got[1][0].shares) == 1 and len(got[7]) == 2
    empty = langid.learn(none)
    assert empty.langs == [] and {r.lang_pred for r in langid.infer(docs, empty).collect()} == {"und"}
    assert not langid.infer(none, model).collect()


def test_mixture_beats_plain_likelihood():
    """The proportions found are those that plain expectation-maximisation over the chosen languages gives."""
    import numpy as np

    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(30) * 0.3, 3).T + 1e-6
    p /= p.sum(0)
    n = rng.multinomial(4000, p @ [0.7, 0.0, 0.3])
    mix, fit = langid.mixtures(n, np.arange(30), np.zeros(30, int), 1, np.log(p), 3.0, 200)
    q = np.array([0.5, 0.5])
    for _ in range(500):
        share = p[:, [0, 2]] * q
        q = (n[:, None] * share / share.sum(1, keepdims=True)).sum(0) / n.sum()
    assert mix[0][1] == 0 and mix[0][[0, 2]] == pytest.approx(q, abs=0.01)


def test_token_counts(docs, rows, none):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -1.0, "abc": -4.0, "c": -2.0, "ä": -2.0, "d": -1.5, "e": -1.0, "de": -2.5}

    def brute(word):
        s = "▁" + word.decode()
        best = [(0.0, 0)]
        for at in range(1, len(s) + 1):
            size = len(s[at - 1].encode())
            options = [(best[at - 1][0] + token_trie.BYTE_SCORE * size, best[at - 1][1] + size)]
            options += [(best[a][0] + scores[s[a:at]], best[a][1] + 1) for a in range(at) if s[a:at] in scores]
            best.append(max(options, key=lambda x: (x[0], -x[1])))
        return best[-1][1]

    split = lambda t: (t or "").encode().split()
    memo = {w: brute(w) for r in rows for w in split(r[1]) if len(w) < 400}
    want = collections.Counter((r[0], len(split(r[1])), sum(memo[w] if w in memo else brute(w) for w in split(r[1]))) for r in rows)
    assert bag(token_trie.token_counts(docs, scores)) == want
    assert not token_trie.token_counts(none, scores).collect()


def test_near_copies(docs, rows, none, monkeypatch):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = collections.Counter((r[0], len(sets[i]), least[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows))
    assert bag(ngram_join.similar_sets(docs)) == want
    # the way of large buckets, of blocks and of frequent tokens
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "WINDOW", 3000)
    assert bag(ngram_join.similar_sets(docs, orders=3, min_frequent=2)) == want
    assert not ngram_join.similar_sets(none).collect()


@pytest.mark.parametrize("hot", [4000, 1])
def test_suffix_dedup(docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD", 100)
    length = 400
    raw = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    want = collections.Counter()
    for r, t in zip(rows, raw):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[r[0], len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)] += 1
    got = collections.Counter()
    for x in suffix.remove_repeats(docs, length).collect():
        got[x.doc_id, x.n_bytes, sum(s.stop - s.start for s in x.removed), len(x.removed), bytes(x.kept)] += 1
    assert got == want and any(k[2] and k[2] < k[1] for k in want)
    assert not suffix.remove_repeats(none, length).collect()


@pytest.mark.parametrize("size", [380, 420, 900])
def test_suffix_groups_are_bounded(spark, monkeypatch, size):
    """One passage amid different texts: no group of contexts is larger than HOT."""
    repeated, hot, length = suffix._repeated, 20, 400
    monkeypatch.setattr(suffix, "HOT", hot)

    def checked(group, *rest):
        import numpy as np

        assert np.unique(group, return_counts=True)[1].max() <= hot
        return repeated(group, *rest)

    monkeypatch.setattr(suffix, "_repeated", checked)
    rng = random.Random(size)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(size)
    texts = [prose(rng.randrange(500)) + (passage if i % 3 else passage[:-30]) + prose(rng.randrange(300, 500)) for i in range(90)]
    count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.kept.decode() for r in suffix.remove_repeats(df, length).collect()}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        assert got[i] == "".join(c for c, g in zip(t, gone) if not g)


def test_suffix_array():
    import numpy as np

    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_decontamination(spark, docs, rows, none):
    rng = random.Random(9)
    w = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    items = [(1, w(50)), (2, w(20)), (3, w(3)), (4, w(59))]
    near = list(items[3][1])
    near[30] = "other"
    texts = [
        (1, " ".join(w(30) + [x.upper() for x in items[0][1]] + w(9))),
        (2, " ".join(w(100))),
        (3, "\n".join(items[1][1])),
        (4, " ".join(w(7) + items[2][1] + w(7))),
        (5, " ".join(w(7) + near)),
        (6, " ".join(items[0][1][:25] + w(25))),
        (7, None),
        (8, ""),
        (9, " ".join(items[2][1])),
        (None, " ".join(items[1][1])),
        (3, "\n".join(items[1][1])),
    ]
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in items] + [(8, None, 1), (9, "", 1)], "item_id long, text string, doc_id int")
    docs2 = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, item_id int")
    got = collections.Counter((r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontam.contaminated(docs2, bench).collect())
    want = collections.Counter()
    for doc_id, text in texts:
        d = words(text)
        for i, x in items:
            x = [y.encode().lower() for y in x]
            n, k = len(x), min(5, len(x))
            grams = lambda y: collections.Counter(tuple(y[a : a + k]) for a in range(len(y) - k + 1))
            best = 0.0
            for a in range(len(d) - n + 1):
                p, q = grams(d[a : a + n]), grams(x)
                best = max(best, sum((p & q).values()) / sum((p | q).values()))
            if best >= 0.8:
                want[doc_id, i, round(best, 6)] += 1
    assert got == want and len(want) == 6
    assert not decontam.contaminated(none, bench).collect()
    assert not decontam.contaminated(docs, bench.limit(0)).collect()


PAGE = """<title>no</title><style>p{}</style><p>One <b>two</b>
 three<p hidden>gone<p>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><caption>Cap</caption><tr><th>k<th>value<tr><td>long key<td>1<br>2</table><div style="display:none">gone</div>
<pre>  keep
   this</pre>tail<script>var x="</p>"</script><br>end &amp; done"""
TEXT = """One two three

four

- a
- b
  3. x
  4. y

Cap
k        | value
long key | 1
         | 2

  keep
   this

tail
end & done"""


def test_html(spark):
    assert html_text.render(PAGE) == TEXT
    deep = "<div>" * 30_000 + "x"
    pages = [(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (3, "", "t"), (4, deep, "t"), (5, "<p", "t"), (None, "<b>a</i>b", "t")]
    got = bag(html_text.extract_text(spark.createDataFrame(pages, "page_id long, html string, text string")).select("page_id", "text"))
    assert got[1, TEXT] == 2 and got[2, None] == 1 and got[3, ""] == 1 and got[4, "x"] == 1 and got[None, "ab"] == 1
    assert html_text.render("a<td>b</table></div></p>c") and html_text.render("<table><tr><td><table><tr><td>in</table><td>out</table>") == "in | out"
    assert not html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).collect()


def test_decontamination_of_texts_shorter_than_the_item(spark, monkeypatch):
    rng = random.Random(5)
    w = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = {1: w(40), 2: w(15), 3: w(59), 4: w(6), 5: w(4)}
    texts = [x[a : len(x) - b] for x in items.values() for a, b in ((0, 1), (0, 3), (2, 1), (1, 0), (0, 8), (9, 0), (3, 30))]
    texts += [x[: len(x) - 3] + w(k) for x in items.values() for k in (1, 3, 40)] + [items[1][:17] + ["other"] + items[1][18:37], []]

    def similarity(d, x):
        k = min(5, len(x))
        grams = lambda y: collections.Counter(tuple(y[a : a + k]) for a in range(len(y) - k + 1))
        windows = [d[a : a + len(x)] for a in range(len(d) - len(x) + 1)] or [d]
        return max(sum((grams(p) & grams(x)).values()) / sum((grams(p) | grams(x)).values()) for p in windows)

    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.contaminated(docs, bench).collect()}
    want = {(k, i): s for k, t in enumerate(texts) for i, x in items.items() if (s := similarity(t, x)) >= 0.8}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(want)
    short = [k for k, i in want if len(texts[k]) < len(items[i])]
    assert len(short) >= 10 and got[1, 1] == (33 / 36, 0)
    # a piece that ends a longer text is no whole text
    hasher = shingles.Hasher()
    block = decontam.Items([(1, " ".join(items[1]))], 31)
    long = hasher.words([" ".join(w(22) + items[1][:35])])[0]
    before = decontam._found(block, long, 5, 0.8)
    assert decontam._found(block, hasher.words([" ".join(items[1][:35])])[0], 5, 0.8) == {0: (31 / 36, 0)}
    monkeypatch.setattr(decontam, "STEP", 11)
    assert decontam._found(block, long, 5, 0.8) == before == {}


def test_html_head_without_end_tag():
    assert html_text.render("<head><title>T</title>Hello <b>x</b><p>y") == "Hello x\n\ny"
    assert html_text.render("<head><title>T</title><meta charset=x> <b>Hello</b> x<p>y") == "Hello x\n\ny"
    assert html_text.render("<html><head>\n<title>a</title><style>b</style><script>c</script><noscript>d<img></noscript>\n<template>e<b>f</b></template><link>\n<a>g</a>") == "g"
    assert html_text.render("<head><title>T</title>\n</head>\n<body>x") == "x"


def test_fingerprints_find_near_copies():
    """Items whose first or last words are others, down to the least similarity: nearly all are found by their
    fingerprints, and all of them in exact mode."""
    rng = random.Random(11)
    hasher, found, exact, far = shingles.Hasher(), 0, 0, 0
    for _ in range(1500):
        n = rng.randint(15, 59)
        text = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        k = (n - 4) // 9
        new = [f"v{rng.randrange(10**6)}" for _ in range(k)]
        copy = text[: n - k] + new if rng.random() < 0.5 else new + text[k:]
        w = hasher.words([" ".join(copy)])[0]
        items = decontam.Items([(1, " ".join(text))], 31)
        score = decontam.weighted_similarity(shingles.shingles(w, 5), items.parts[0])
        votes = decontam._signs(shingles.shingles(w, 5)).sum(0, dtype="int32")
        far += int((decontam._fingerprints(votes) ^ items.prints[0]).sum()) > 31
        got = decontam._found(items, w, 5, 0.8)
        assert score >= 0.8 and got in ({}, {0: (score, 0)})
        found += bool(got)
        exact += decontam._found(decontam.Items([(1, " ".join(text))], 31, exact=True), w, 5, 0.8) == {0: (score, 0)}
    assert far > 100 and found >= 0.98 * 1500 and exact == 1500


def test_pieces_of_long_texts(monkeypatch):
    """Cutting long texts changes neither words nor windows."""
    import numpy as np

    from quorumtext.llm import shingles

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(n)) for n in (0, 1, 7, 400)] + [None, "x" * 90, " \n"]
    whole, ends = shingles.Hasher().words(texts)
    items = decontam.Items([(1, " ".join(texts[3].split()[100:130])), (2, " ".join(texts[3].split()[205:208]))], 31)
    words = whole[ends[2] : ends[3]]
    found = decontam._found(items, words, 3, 0.8)
    assert found == {0: (1.0, 100), 1: (1.0, 205)}
    grams = langid.Grams()(texts[3:4])
    monkeypatch.setattr(shingles, "PIECE", 20)
    monkeypatch.setattr(decontam, "STEP", 11)
    again = shingles.Hasher().words(texts)
    assert np.array_equal(again[0], whole) and np.array_equal(again[1], ends) and decontam._found(items, words, 3, 0.8) == found
    monkeypatch.setattr(langid, "PIECE", 50)
    assert len(langid.Grams()(["ab" * 25])[0]) == 50
    cut = langid.Grams()(texts[3:4])
    assert set(cut[1].tolist()) & set(grams[1].tolist()) and cut[2].tolist() == [True] and abs(len(cut[1]) - len(grams[1])) < len(grams[1]) // 10
