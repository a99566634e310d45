"""Goldens and brute-force checks of the other operators."""

import datetime as dt
import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from pyspark.sql import functions as F

from quorumtext.functions import arrow
from quorumtext.functions import labels as L
from quorumtext.functions import rx as R
from quorumtext.functions import text as X
from quorumtext.operators import audit, fuzzy, retrieval, safety
from quorumtext.plans import rx_queries
from quorumtext.streaming import jobs


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(fn(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "['An hip', 'x']", X.tidy_reading) == "An hip\nx"
    assert one(spark, '"one"', X.tidy_reading) == "one"
    assert one(spark, "दवा", X.key) == "दव"
    assert len(one(spark, "மருந்து காலை மாலை", X.rag_tokens)) == 3
    assert one(spark, "x【1】 y【2†L3】.", X.fix_citations) == "x[1] y[2]."
    assert one(spark, "[1] [2, 9] [2024]", X.cited_numbers) == [1, 2, 9]
    assert one(spark, "a water-wheel [unclear] -", lambda c: X.word_list(c, True)) == ["a", "water", "wheel", "<any>"]
    assert one(spark, "groq:qwen/qwen3:free", L.model_label) == "qwen3 (groq)"


def test_hash_split(spark):
    names = ["001", "002"] + [f"a{i:02d}" for i in range(1, 20)]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    test = {r.x for r in df.where(L.hash_split(F.col("x")) == "test").collect()}
    assert test == {"a01", "a07", "a08", "a10", "a11", "a15", "a19"}


def test_rx_cells(spark):
    for text, value, unit in [("650 mg", 650.0, "mg"), ("0.5g", 0.5, "g"), ("650", 650.0, None), ("none", None, None)]:
        assert one(spark, text, R.strength_value) == value and one(spark, text, R.strength_unit) == unit
    for text, n in [("1-0-1", 2), ("2-2-2-2", 8), ("½-0-½", 1), ("TDS", 3), ("SOS", None), ("", None), ("2 tabs twice daily", 4)]:
        assert one(spark, text, R.per_day) == n


def test_dose_warnings(spark):
    rows = [
        ("a", "alfa", "40 mg", "1-0-1"), ("b", "alfa", "40 mg", "2-2-2-2"), ("c", "alfa", "500 g", "1-0-0"),
        ("d", "betadine-x", "50 mg", "OD"), ("e", "gammaprol", "20 mg", "10-0-10"), ("f", "Tab. Gamaprol", "30 mg", "OD"),
    ]
    df = spark.createDataFrame(rows, "id string, drug string, strength string, frequency string").withColumn("flagged", F.lit(False))
    out = {r.id: r.warnings for r in safety.check_rows(df, rx_queries.formulary(spark), rx_queries.alias_table(spark)).collect()}
    assert out["a"] == [] and "above the usual adult maximum of 80 mg/day" in out["b"][0]
    assert out["c"] == ["500 g in one tablet is not possible: probably mg"]
    assert len(out["d"]) == 2 and out["d"][1].startswith("50000 mcg/day")
    assert len(out["e"]) == 1 and out["e"][0].startswith("Frequency '10-0-10'")
    assert out["f"] == ["30 mg is not a usual gammaprol strength (usual: 20 mg)"]


def test_validate_rows(spark):
    pages = spark.createDataFrame([("p", "Tab alfa [[500?]] mg 1-0-1")], "page_id string, marked string")
    rows = spark.createDataFrame(
        [("p", "alfa", "[[500?]] mg", "Tab", "1-0-1", ""), ("p", "alfa", "600 mg", "", "", ""), ("p", "alfa", "", "", "1-0-1", "")],
        "page_id string, drug string, strength string, form string, frequency string, duration string",
    )
    out = sorted((r.strength, r.flagged) for r in safety.validate_rows(rows, pages).collect())
    assert out == [("", False), ("500 mg", True), ("600 mg", True)]


def test_near_join_equals_brute_force(spark):
    rng = random.Random(5)
    left = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(150)})
    right = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(150)})
    a, b = spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")
    got = {(r.a, r.b) for r in fuzzy.near_join(a, b).collect()}
    want = a.crossJoin(b).where(X.near(F.col("a"), F.col("b"))).collect()
    assert got == {(r.a, r.b) for r in want}


def test_fuzzy_top_equals_close_matches(spark):
    rng = random.Random(6)
    vocab = list({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 10))) for _ in range(120)})
    words = list({"".join(rng.choice("abcde") for _ in range(rng.randint(1, 10))) for _ in range(40)})
    out = fuzzy.fuzzy_top(spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in vocab], "entry string"), 0.7, 3)
    got = {}
    for r in out.orderBy("word", "rank").collect():
        got.setdefault(r.word, []).append(r.entry)
    assert got == {w: m for w in words if (m := get_close_matches(w, vocab, n=3, cutoff=0.7))}


def test_ratio_join_moves_words_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aabcdefé日") for _ in range(rng.randint(1, 9))) for _ in range(300)}) + ["ab" * 40, "a" * 30, "zz"]
    entries = sorted({"".join(rng.choice("aabcdefé日") for _ in range(rng.randint(1, 9))) for _ in range(200)}) + ["ab" * 39, "a" * 20]
    a, b = (spark.createDataFrame([(w,) for w in m], f"{n} string") for m, n in ((words, "word"), (entries, "entry")))
    monkeypatch.setattr(fuzzy, "ENTRIES", 50)
    pairs = fuzzy.fuzzy_pairs(a, b, 0.7)
    ratios = {(w, e): SequenceMatcher(None, e, w).ratio() for w in words for e in entries}
    assert {(r.word, r.entry): r.ratio for r in pairs.collect()} == {p: r for p, r in ratios.items() if r >= 0.7}
    # no keys are made of a word in a row of its own, and no pair moves before it is judged
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan


def test_ratio_join_equals_brute_force_and_looks_at_few_pairs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aabbcdefé") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    words += ["".join(rng.choice("abcd") for _ in range(n)) for n in (25, 31, 33, 40, 70)]
    words += [w[:5] + w[6:] for w in words[-5:]]
    entries = ["".join(rng.choice("aabbcdefé") for _ in range(rng.randint(1, 9))) for _ in range(150)] + [w[:-3] + "zz" for w in words[-10:]]
    a, b = spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(w,) for w in entries], "entry string")
    for cutoff in (0.6, 0.8):
        got = {(r.word, r.entry): r.ratio for r in fuzzy.fuzzy_pairs(a, b, cutoff).collect()}
        ratios = {(w, e): SequenceMatcher(None, e, w).ratio() for w in set(words) for e in set(entries)}
        assert got == {p: r for p, r in ratios.items() if r >= cutoff}
    syllables = ["re", "ing", "tion", "th", "ou", "st", "er", "an", "ble", "ly", "ha", "ed", "wh", "sh", "nt", "or"]
    mixed = [sorted({"".join(rng.choices(syllables, k=rng.randint(2, 5))) for _ in range(300)}) for _ in range(2)]
    a, b = (spark.createDataFrame([(w,) for w in m], f"{n} string") for m, n in zip(mixed, ("word", "entry")))
    assert fuzzy.candidate_pairs(a, b, 0.7).count() < 0.05 * len(mixed[0]) * len(mixed[1])


def test_hamming_join_equals_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(63) for _ in range(60)]
    hashes = base + [h ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for h in base]
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    got = {(r.ha, r.hb) for r in audit.hamming_join(df.select(F.col("h").alias("ha")), df.select(F.col("h").alias("hb")), 2).collect()}
    assert got == {(x, y) for x in set(hashes) for y in set(hashes) if bin(x ^ y).count("1") <= 2}
    plan = audit.hamming_join(df.select(F.col("h").alias("ha")), df.select(F.col("h").alias("hb")), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == 2


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(200)) 
    df = spark.createDataFrame([("s", None, text), ("t", None, "x" * 1000 + " " + "y " * 400)], "source string, page int, text string")
    out = retrieval.chunk(df, 300).orderBy("source", "chunk_no").collect()
    assert all(len(r.text) <= 300 for r in out)
    assert all(r.text.endswith("here.") for r in out if r.source == "s")


def test_bm25_pads_with_unscored_passages(spark):
    p = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue dog", "red red hat"])], "chunk_id bigint, text string")
    q = spark.createDataFrame([(1, "red"), (2, "missing")], "query_id int, text string")
    got = sorted((r.query_id, r.rank, r.chunk_id) for r in retrieval.bm25_search(p, q, 3).collect())
    assert got == [(1, 1, 2), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 1), (2, 3, 2)]


def test_edit_trace():
    assert arrow.edit_trace(list("abc"), list("abc")) == (0, [False] * 3, [])
    assert arrow.edit_trace(list("axc"), list("abc")) == (1, [False, True, False], [])
    assert arrow.edit_trace(list("ac"), list("abc")) == (1, [False, False], [])
    assert arrow.edit_trace(["a", "q", "c"], ["a", X.WILD, "c"]) == (0, [False] * 3, [1])
    assert arrow.edit_trace(["a", "c"], ["a", X.WILD, "c"])[0] == 0
    rng = random.Random(9)
    for _ in range(300):
        h = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        r = [rng.choice(["a", "b", "c", X.WILD]) for _ in range(rng.randint(0, 9))]
        d = [[0] * (len(r) + 1) for _ in range(len(h) + 1)]
        for i in range(len(h) + 1):
            for j in range(len(r) + 1):
                free = 0 if j and r[j - 1] == X.WILD else 1
                options = [i] if j == 0 else [d[i][j - 1] + free]
                if i and j:
                    options += [d[i - 1][j] + 1, d[i - 1][j - 1] + (free and int(h[i - 1] != r[j - 1]))]
                d[i][j] = min(options)
        assert arrow.edit_trace(h, r)[0] == d[len(h)][len(r)]


def test_vote_deadline_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [
        ("all", 0, "done", "x", at(0)), ("all", 1, "done", "x", at(5)), ("all", 2, "failed", None, at(9)),
        ("late", 0, "done", "x", at(0)), ("late", 1, "done", "x", at(20)), ("late", 2, "done", "x", at(120)),
        ("alone", 0, "done", "x", at(0)), ("alone", 1, "done", "x", at(130)), ("end", 0, "done", "x", at(1000)),
    ]
    df = spark.createDataFrame(rows, "page_id string, slot int, status string, text string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = {r.page_id: r for r in jobs.run_appends(jobs.vote_ready(stream, 3), "v").collect()}
    assert out["all"].voters == "0,1" and not out["all"].by_deadline
    assert out["late"].voters == "0,1" and out["late"].timed_out == "2" and out["late"].by_deadline
    assert out["alone"].voters == "0,1" and out["alone"].timed_out == "2"


def test_bit_distance():
    from quorumtext.functions.arrow import bit_distance

    rng = random.Random(12)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for n in (0, 1, 2, 5, 63, 64, 65, 130):
        for _ in range(15):
            a = "".join(rng.choices("abcé ", k=n))
            b = "".join(c for c in a if rng.random() > 0.1) + "".join(rng.choices("abd", k=rng.randint(0, 6)))
            b = b[rng.randint(0, 2) :]
            assert bit_distance(a, b) == bit_distance(b, a) == slow(a, b)


def test_medians(spark):
    from statistics import median

    from quorumtext.operators.selection import medians

    rng, rows = random.Random(2), []
    for key, n in (("hot", 900), ("even", 8), ("one", 1), (None, 5), ("none", 0)):
        rows += [(key, rng.choice([1.5, 2.0, rng.random() * 9]), rng.randrange(5)) for _ in range(n)] + [(key, None, None), (key, float("nan"), None)]
    df = spark.createDataFrame(rows, "key string, x double, y int")
    got = {r.key: (r.x, r.y) for r in medians(df, "key", {"x": F.col("x"), "y": F.col("y")}).collect()}
    real = lambda k, i: [r[i] for r in rows if r[0] == k and r[i] is not None and r[i] == r[i]]
    assert got == {k: (pytest.approx(median(real(k, 1))), median(real(k, 2))) for k in ("hot", "even", "one", None)}
    assert not medians(df.limit(0), "key", {"x": F.col("x")}).collect()


def test_short_number_is_printf_g(spark):
    values = [0.0, 0.5, 2.5, 1000.0, 1485.25, 12345.75, 123456.25, 123456.5, 123457.5, 222750.25, 999999.5, 999999.75, 1e6, 1234565.0, 2227502.25, 1.5e11, 1e-4, 2.5e-5, -12.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i")
    assert [r.y for r in df.select(L.short_number(F.col("x")).alias("y")).collect()] == ["%g" % v for v in values]


def test_page_score_on_rows_and_long_pages(spark):
    import time

    from quorumtext.functions.arrow import bit_distance, edit_trace, long_distance

    rng = random.Random(12)
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 30)))
        b = "".join(c if rng.random() > 0.2 else rng.choice(["", "x", "ab"]) for c in a)
        exact = bit_distance(a, b)
        assert [long_distance(a, b, k) for k in (None, exact, exact + 3)] == [exact] * 3
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr("quorumtext.functions.arrow.TABLE_CELLS", 0)
            assert [long_distance(a, b, k) for k in (None, exact, exact + 3)] == [exact] * 3
    # words replaced by position: no table is filled, however long the page
    ref = [f"w{rng.randint(0, 5000)}" for _ in range(60_000)]
    hyp = [w if rng.random() > 0.1 else "[?]" for w in ref]
    start = time.perf_counter()
    edits, wrong, wild = edit_trace(hyp, ref)
    assert time.perf_counter() - start < 5
    assert edits == sum(wrong) == sum(a != b for a, b in zip(hyp, ref)) and not wild
    # a shift behind which the words agree again is found as before
    assert edit_trace(list("xabcdy"), list("abcdyz"))[0] == 2


def test_word_edits_by_line(spark):
    from quorumtext.operators import scoring

    lines = spark.createDataFrame([(1, list("abc"), list("axc")), (2, list("xabcd"), list("abcdx")), (3, list("ab"), list("abc")), (4, [], ["a"])], "i int, h array<string>, r array<string>")
    assert {r.i: r.edits for r in scoring.word_edits(lines).collect()} == {1: 1, 2: 2, 3: 1, 4: 1}
