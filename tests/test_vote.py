"""Goldens and properties of the vote."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quorumtext.functions import arrow
from quorumtext.functions import text as X
from quorumtext.operators import pipeline, repair, review, scoring, similarity
from quorumtext.operators import voting as V


def readings(spark, pages):
    rows = [(p, i, f"r{i}", t) for p, texts in pages.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id string, slot int, reader string, text string")


def vote(spark, texts, rule="two_thirds"):
    pages = V.vote_columns(V.align_sequences(V.unsplit(V.page_frame(readings(spark, {"p": texts})))))
    return [r.asDict(recursive=True) for r in V.explode_words(pages, rule).orderBy("idx").collect()]


def test_gap_words_keep_half_the_readers(spark):
    w = vote(spark, ["buy milk today", "buy two litres milk today", "buy two litres milk today", "buy milk today"])
    assert [x["text"] for x in w] == ["buy", "two", "litres", "milk", "today"]
    assert w[1]["confidence"] == 0.5 and w[1]["flagged"]
    assert [m["text"] for m in w[1]["by_model"]] == [None, "two", "two", None]


def test_numbers_must_be_unanimous(spark):
    w = vote(spark, ["pay 500 now", "pay 500 now", "pay 600 now"])
    assert w[1]["text"] == "500" and w[1]["flagged"] and w[1]["confidence"] == 0.67
    assert w[1]["alternatives"] == ["600"]
    assert w[1]["votes"] == [{"text": "500", "votes": 2}, {"text": "600", "votes": 1}]


def test_unreadable_minority_split_lone_and_lines(spark):
    w = vote(spark, ["go [?] home", "go [?] home", "go home"])
    assert w[1]["text"] == "[?]" and w[1]["confidence"] == 0.0 and w[1]["flagged"]
    assert [x["text"] for x in vote(spark, ["x y z", "x z", "x z"])] == ["x", "z"]
    w = vote(spark, ["Nid azol tab", "Nidazol tab", "Nidazol tab"])
    assert [x["text"] for x in w] == ["Nidazol", "tab"] and not any(x["flagged"] for x in w)
    w = vote(spark, ["one two"])
    assert all(x["confidence"] == 1.0 and not x["flagged"] for x in w)
    assert [x["text"] for x in vote(spark, ["one\ntwo", "one\ntwo"])] == ["one", "\n", "two"]


@pytest.mark.parametrize("rule,flagged", [("majority", True), ("two_thirds", True), ("unanimous", True)])
def test_two_of_four_is_never_trusted(spark, rule, flagged):
    w = vote(spark, ["cat", "cat", "cot", "cut"], rule)
    assert w[0]["text"] == "cat" and w[0]["flagged"] is flagged


def test_matcher_agrees_with_the_standard_library():
    rng = random.Random(7)
    for n in (0, 5, 40, 260):
        for _ in range(20):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            b = [x if rng.random() > 0.2 else rng.choice("abcdexyz") for x in a if rng.random() > 0.1]
            for junk in (True, False):
                mine, std = arrow._Matcher(None, a, b, autojunk=junk), SequenceMatcher(None, a, b, autojunk=junk)
                assert mine.get_opcodes() == std.get_opcodes()
                assert mine.ratio() == std.ratio()


def test_pivot_pruning_gives_the_plain_argmax():
    rng = random.Random(3)
    for _ in range(60):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        keys = [[x if rng.random() > 0.3 else rng.choice("xyz") for x in base if rng.random() > 0.1] for _ in range(4)]
        sums = [sum(SequenceMatcher(None, k, o).ratio() for j, o in enumerate(keys) if j != i) for i, k in enumerate(keys)]
        assert sums[arrow._pick_pivot(keys)] == pytest.approx(max(sums))


def test_translation_is_left_out(spark):
    rows = [("p", 0, "a", "दवा सुबह शाम", None), ("p", 1, "b", "दवा सुबह शाम", None), ("p", 2, "c", "medicine morning evening", None)]
    df = spark.createDataFrame(rows, "page_id string, slot int, reader string, text string, error string")
    good, out = pipeline.admitted(df)
    assert {r.slot for r in good.collect()} == {0, 1}
    assert [r.slot for r in out.collect()] == [2]


def words(spark, rows):
    schema = (
        "page_id string, idx int, text string, confidence double, flagged boolean, likely boolean, alternatives array<string>, "
        "votes array<struct<text:string,votes:int>>, readers int, by_model array<struct<reader:string,text:string>>, "
        "lookalikes array<string>, resolved_by string, evidence string, original string"
    )
    return spark.createDataFrame(rows, schema)


def row(i, text, votes, readers=4, alts=None, alike=None):
    alts = [k for k in votes if k != text] if alts is None else alts
    return ("p", i, text, 0.5, True, False, alts, list(votes.items()), readers, None, alike, None, None, None)


def test_likely_levels(spark):
    df = words(spark, [
        row(0, "river", {"river": 2, "rover": 1, "riser": 1}), row(1, "river", {"river": 2, "rover": 2}),
        row(2, "river", {"river": 1, "rover": 1, "a": 1, "b": 1}), row(3, "river", {"river": 2, "rover": 1}, 2),
        row(4, "40", {"40": 3, "46": 1}), row(5, "BD", {"BD": 3, "OD": 1}), row(6, "river", {"river": 3, "x": 1}, alts=["5mg"]),
        row(7, "river", {"river": 3, "x": 1}, alike=["rover"]),
    ])
    got = {r.idx: r.likely for r in review.mark_likely(df, F.lit("auto")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}
    legal = words(spark, [row(0, "Lee", {"Lee": 3, "Lea": 1}), row(1, "land", {"land": 3, "lend": 1})])
    assert {r.idx: r.likely for r in review.mark_likely(legal, F.lit("legal")).collect()} == {0: False, 1: True}


def test_dictionary_needs_a_strict_majority(spark):
    lex = spark.createDataFrame([("gammaprol", "Gammaprol"), ("widget", "widget")], "key string, word string")
    df = words(spark, [row(0, "gamaprol", {"gamaprol": 2, "gammaprl": 1, "xyz": 1}), row(1, "wodget", {"wodget": 1, "abc": 1, "def": 1, "ghi": 1})])
    out = {r.idx: r for r in repair.dictionary_fix(df, lex).collect()}
    assert out[0].text == "Gammaprol" and not out[0].flagged and out[0].evidence == "dictionary, 3/4 readers"
    assert out[1].text == "wodget" and out[1].flagged


def test_equal_readings_are_one_value(spark):
    df = words(spark, [row(0, "wodget", {"wodget": 1, "Widget.": 2}), row(1, "wodget", {"widget": 2, "Wodget": 1})])
    assert repair._doubtful(df).select("spelled").distinct().count() == 1
    lex = spark.createDataFrame([("widget", "widget")], "key string, word string")
    got = repair.dictionary_support(df, lex, "near").collect()
    assert sorted((r.idx, r.best.entry, r.best.support) for r in got) == [(0, "widget", 3), (1, "widget", 3)]


def test_consensus_runs_end_to_end(spark):
    df = readings(spark, {"rx": ["Tab Gamaprol 20 mg 1-0-1"] * 3, "n": ["a plain note", "a plain note", "a plane note"]}).withColumn("error", F.lit(None).cast("string"))
    _, pages = pipeline.consensus(df)
    got = {r.page_id: r for r in pages.collect()}
    assert got["rx"].doc_type == "prescription" and got["n"].doc_type == "note"
    assert got["n"].text == "a plain note"


def test_cuts_change_no_alignment():
    from quorumtext.functions.arrow import _pair_up, safe_cuts

    rng, cut = random.Random(1), 0
    for _ in range(1500):
        size, e = rng.choice([6, 20, 60, 200]), rng.choice([0.02, 0.1, 0.2])
        a = [str(int(size * rng.random() ** 2)) for _ in range(rng.choice([3, 20, 60, 150]))]
        b = []
        for w in a:
            x = rng.random()
            b += [] if x < e else [str(rng.randrange(size))] if x < 2 * e else [w, str(rng.randrange(size))] if x < 3 * e else [w]
        if rng.random() < 0.3 and len(b) > 10:  # a passage that moved
            i, j = sorted(rng.sample(range(len(b)), 2))
            moved, rest = b[i:j], b[:i] + b[j:]
            k = rng.randrange(len(rest) + 1)
            b = rest[:k] + moved + rest[k:]
        places = [(0, 0), *safe_cuts(a, b, rng.choice([5, 10, 30])), (len(a), len(b))]
        slots, gaps = [], []
        for (i, j), (k, m) in zip(places, places[1:]):
            s, g = _pair_up(a[i:k], b[j:m])
            slots += [x if x is None else x + j for x in s]
            gaps += [(p + i, lo + j, hi + j) for p, lo, hi in g]
        cut += len(places) - 2
        assert (slots, gaps) == _pair_up(a, b)
    assert cut > 100


def test_long_pages_align_in_many_tasks(spark):
    rng = random.Random(4)
    truth = [f"w{int(900 * rng.random() ** 2)}" for _ in range(20_000)]
    copies = []
    for k in range(3):
        copies.append(" ".join(w + "x" if rng.random() < 0.02 else w for w in truth if rng.random() > 0.01))
    rows = readings(spark, {"long": copies, "short": ["the cat sat", "the cat sat on", "a cat sat"], "one": ["alone here"]})
    pages = V.page_frame(rows)
    found = V._align_pieces(pages, 500).collect()
    want = {r.page_id: r.al for r in pages.select("page_id", V.align_page(F.expr("transform(rd, r -> r.keys)")).alias("al")).collect()}
    assert {r.page_id: r.al for r in found} == want
    keys = {r.page_id: r.k for r in pages.select("page_id", F.expr("transform(rd, r -> r.keys)").alias("k")).collect()}["long"]
    from quorumtext.functions.arrow import safe_cuts

    assert len(safe_cuts(keys[0], keys[1], 500)) > 25
    both = [
        sorted((r.page_id, r.words) for r in V.vote_columns(V.align_sequences(pages, long_page=n, piece=500)).select("page_id", F.to_json("words").alias("words")).collect())
        for n in (0, 10**9)
    ]
    assert both[0] == both[1]


def test_settings_over_sequences(spark):
    from quorumtext.operators import scoring

    texts = {"p": ["buy 7 litres milk", "buy 1 litres of milk", "buy 7 litres of milk"], "q": ["the cat sat", "the cat sat", "cat sat"]}
    truth = spark.createDataFrame([("p", "buy 7 litres of milk".split()), ("q", "the cat sat".split())], "page_id string, ref array<string>")
    got = {(r["mask"], r.rule, r.digits_strict, r.drop_minority): r for r in scoring.tune_sequences(readings(spark, texts), truth, ["r0", "r1", "r2"]).collect()}
    assert len(got) == 4 * 3 * 2 * 2 and {r.ref_words for r in got.values()} == {8}
    for (mask, rule, digits, drop), r in got.items():
        own = {p: [t for i, t in enumerate(x) if mask >> i & 1] for p, x in texts.items()}
        edits = flagged = wrong_flagged = 0
        for p, x in own.items():
            cfg = V.vote_columns(V.align_sequences(V.page_frame(readings(spark, {p: x}))), drop) if (mask, rule) in ((7, "two_thirds"), (3, "unanimous")) else None
            if cfg is None:
                break
            words = V.explode_words(cfg, rule, digits).orderBy("idx").collect()
            want = {"p": "buy 7 litres of milk", "q": "the cat sat"}[p].split()
            h = [w.text for w in words]
            ops = [o for o in SequenceMatcher(None, h, want, autojunk=False).get_opcodes() if o[0] != "equal"]
            edits += sum(max(o[2] - o[1], o[4] - o[3]) for o in ops)
            flagged += sum(w.flagged for w in words)
        else:
            assert (r.word_edits, r.flagged) == (edits, flagged)
    assert "r9" not in got and not scoring.tune_sequences(readings(spark, {"p": texts["p"]}), truth, ["r0", "r1", "r2"]).collect()


def test_settings_compare_a_subset_of_a_page_at_most_twice(spark, monkeypatch):
    from quorumtext.operators import scoring

    texts = {"p": ["one two 3 four", "one two extra 3 four", "one too 8 four more"], "q": ["a b", "a b", "a b"], "e": [" ", "x", "x"]}
    truth = spark.createDataFrame([("p", "one two 3 four".split()), ("q", ["a", "b"]), ("e", ["x"])], "page_id string, ref array<string>")
    real, rows = scoring.page_edits, []
    monkeypatch.setattr(scoring, "page_edits", lambda pages: (rows.append(pages.count()), real(pages))[1])
    got = {(r["mask"], r.rule, r.digits_strict, r.drop_minority): r for r in scoring.tune_sequences(readings(spark, texts), truth, ["r0", "r1", "r2"]).collect()}
    assert rows[0] <= 2 * 4 * 3 and len(got) == 4 * 3 * 2 * 2
    for mask in (6, 7):
        own = {p: [t if mask >> i & 1 else "" for i, t in enumerate(x)] for p, x in texts.items()}
        r = readings(spark, own).where("trim(text) <> ''")
        for drop in (True, False):
            words = V.vote_columns(V.align_sequences(V.page_frame(r)), drop)
            for rule, digits in (("unanimous", True),) if drop else (("majority", False),):
                hyp = scoring.evaluation_words(V.explode_words(words, rule, digits))
                want = scoring.page_score(hyp.join(truth, "page_id")).agg(*[F.sum(c).alias(c) for c in scoring.COUNTS]).first()
                assert [got[mask, rule, digits, drop][c] for c in scoring.COUNTS] == list(want)


def test_row_vote_equals_page_vote(spark):
    texts = {
        "even": ["Tab 20 mg\nthe cat", "tab 20 mg\nthe [cat]", "Tab 29 mg\nThe [?]"],
        "uneven": ["one two\nthree four", "one\ntwo three", "one two three four five", "uno"],
        "marks": ["[margin] [] ok.", "[margin] [] OK", "margin [x] [?]"],
        "single": ["alone\n\nhere"],
    }
    pages = V.page_frame(readings(spark, texts))
    for drop in (True, False):
        whole = V.explode_words(V.vote_columns(V.align_positional(pages), drop))
        rows = V.vote_rows(V.positional_rows(pages, drop))
        assert rows.schema == whole.schema
        got, want = (sorted(r.j for r in d.select(F.to_json(F.struct("*")).alias("j")).collect()) for d in (rows, whole))
        assert got == want
    # a filter on the words must not repeat the tally below the explode
    plan = V.vote_rows(V.positional_rows(pages)).where("flagged")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(transform(lambda") <= 1


def test_words_in_doubt_hold_every_flagged_one(spark):
    rng = random.Random(2)
    kinds = ["a", "A", "a.", "b", "7", "7.", "[?]", "x[?]", "[a]", "..", "[margin]", None]
    cells = [(1, i, [rng.choice(kinds[: rng.randint(1, 12)]) for _ in range(5)], [f"r{k}" for k in range(5)]) for i in range(3000)]
    cells += [(2, i, ["\n"] * 5, [f"r{k}" for k in range(5)]) for i in range(3)]
    rows = spark.createDataFrame(cells, "page_id int, idx int, toks array<string>, names array<string>").where("toks[0] is not null")
    for rule in ("majority", "two_thirds", "unanimous"):
        want, got = (sorted(r.idx for r in V.vote_rows(x, rule).where("flagged").collect()) for x in (rows, V.in_doubt(rows)))
        assert got == want
    assert V.in_doubt(rows).count() < rows.count()
    text = ["a\u2003b\u00a0c\x1fd\u2028e\u3000\x85f", "a\tb\x1cc\r\nd"]
    got = spark.createDataFrame([(t,) for t in text], "t string").select(X.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "b", "c", "d", "\n", "e", "\n", "f"], ["a", "b", "\n", "c", "\n", "d"]]


def test_split_words_of_a_long_page(spark):
    import time

    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(6_000)]
    split = [p for i, w in enumerate(names) for p in ((w[:4], w[4:]) if i % 12 == 0 else (w,))]
    slipped = [w[:-1] + "z" if i % 24 == 0 else w for i, w in enumerate(names)]
    pages = V.page_frame(readings(spark, {"p": [" ".join(split), " ".join(slipped), " ".join(slipped)], "q": ["a b", "ab"], "e": [""]}))
    start = time.perf_counter()
    got = {r.page_id: [x.toks for x in r.rd] for r in V.unsplit(pages).collect()}
    assert time.perf_counter() - start < 40
    assert got["p"][0] == names and got["p"][1] == slipped and got["q"] == [["a", "b"], ["ab"]] and got["e"] == [[]]


def test_near_words_equal_all_pairs():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(400)})
    near = arrow.NearWords(words)
    for w in words[:120]:
        plain = {o for o in words if arrow.bit_distance(w, o) <= (1 if max(len(w), len(o)) <= 8 else 2)}
        assert set(near.find(w)) == plain


def test_rows_that_stand_for_several_words(spark):
    df = spark.createDataFrame([(1.0, True, 3), (1.0, False, 1), (0.6, True, 2)], "confidence double, right boolean, n long")
    got = {(r.words, r.right) for r in scoring.calibration(df).collect()}
    assert got == {(4, 3), (2, 2)}
    cells = spark.createDataFrame([(["a", "a"], [False, False], "a", 5)], "keys array<string>, digits array<boolean>, truth string, n long")
    assert [r["columns"] for r in scoring.vote_signatures(cells, 2).collect()] == [5]


def test_similarity_of_cells_is_that_of_reader_rows(spark):
    cells = spark.createDataFrame([(1, ["a.", "A", "b"]), (1, ["b", "b", "b"]), (1, ["c", None, "c"]), (2, ["x", "x", "x"])], "page_id int, toks array<string>")
    each = cells.select("page_id", F.posexplode("toks").alias("i", "t")).where("t is not null")
    rows = each.select("page_id", F.concat(F.lit("r"), F.col("i").cast("string")).alias("reader"), X.key(F.col("t")).alias("key"))
    names = ["r0", "r1", "r2"]
    plain, got = similarity.pair_similarity(rows, names), similarity.cell_similarity(cells, names)
    assert sorted(plain.collect()) == sorted(got.collect())


def test_no_text_moves_to_count_readers(spark):
    df = spark.createDataFrame([(1, 0, "a", "long text", None), (1, 0, "a", " ", "gone"), (1, 1, "b", "", None)], "page_id int, slot int, reader string, text string, error string")
    out = review.page_readers(df)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "THEN x" in plan


def test_blocks_as_difflib_on_lists_that_repeat():
    import random
    import time
    from difflib import SequenceMatcher

    from quorumtext.functions import arrow, matching

    rnd = random.Random(4)
    for n in (5, 40, 250):
        for kinds in (1, 2, 5, 40, 400):
            for _ in range(8):
                a = [str(int(kinds * rnd.random() ** 2)) for _ in range(n)]
                b = [w for w in a if rnd.random() > 0.1] + [str(rnd.randrange(kinds)) for _ in range(rnd.randrange(4))]
                for junk in (True, False):
                    found = matching.blocks(*arrow._as_words(a, b), junk)
                    want = SequenceMatcher(None, a, b, autojunk=junk)
                    assert sum(k for _, _, k in found) == sum(m.size for m in want.get_matching_blocks())
                slots, _ = arrow._pair_up(a, b)
                assert [slots[i + k] - j for i, j, size in want.get_matching_blocks() for k in range(size)] == [
                    k for _, _, size in want.get_matching_blocks() for k in range(size)]
    # one word over and over was walked through for every block
    long = ["ha" if rnd.random() > 0.05 else str(rnd.randrange(9)) for _ in range(4000)]
    began = time.time()
    arrow._pair_up(long, [w for w in long if rnd.random() > 0.03])
    assert time.time() - began < 5


def test_lists_of_a_slice_with_nulls():
    import pyarrow as pa

    from quorumtext.functions import arrow

    column = pa.array([["x"], ["a", None], None, [], ["b"]], pa.list_(pa.string()))
    assert arrow._lists(column.slice(1)) == [["a", None], [], [], ["b"]]
    rows = [[{"toks": ["re", "member"], "keys": ["re", "member"], "word": [True] * 2, "plain": [True] * 2}, {"toks": ["remember"], "keys": ["remember"], "word": [True], "plain": [True]}], None, []]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([None, *rows])], names=["page_id", "__readers"])
    out = next(arrow.with_joined([batch.slice(1)]))
    assert out.column("__to").to_pylist() == [[[1], None], None, []]
