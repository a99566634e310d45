"""Scanners, streams and the faults of the first round, on small files and rows."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quorumtext.functions import arrow
from quorumtext.operators import audit, pipeline, safety
from quorumtext.operators import voting as V
from quorumtext.sources import exports, files
from quorumtext.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_scan_runs(spark, tmp_path):
    runs = [{"image": "a", "readings": {"r1": "x"}}, {"image": "b", "readings": {}, "error": "down"}, {"image": "c"}, {"note": "no image"}]
    (tmp_path / "runs.jsonl").write_text("\n".join(map(json.dumps, runs)) + "\n{broken")
    ok, failed = files.scan_runs(spark, str(tmp_path))
    assert [r.image for r in ok.collect()] == ["a"] and sorted(r.image for r in failed.collect()) == ["b", "c"]


def test_scan_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿IMG,TEXT\n1.png,one\n2.png,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('file,label\n3.png,"x, y"\n')
    got = files.scan_labels(spark, [("d1", "train", f"{tmp_path}/a.csv", "IMG", "TEXT"), ("d2", "test", f"{tmp_path}/b.csv", "file", "label")])
    assert sorted(map(tuple, got.collect())) == [("d1", "train", "1.png", "one"), ("d1", "train", "2.png", ""), ("d2", "test", "3.png", "x, y")]
    with pytest.raises(ValueError):
        files.scan_labels(spark, [])


def test_scan_pairs(spark, tmp_path):
    for name, text in (("p1.PNG", "i"), ("p1.txt", "one\ntwo"), ("p2.jpg", "i"), ("p3.txt", "alone"), ("p4.gif", "i"), ("p4.txt", "x")):
        (tmp_path / name).write_text(text)
    assert [(r.stem, r.text) for r in files.scan_pairs(spark, str(tmp_path)).collect()] == [("p1", "one\ntwo")]


def test_scan_wordlist(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zeta\n# note\n\n alpha \n")
    (tmp_path / "a.txt").write_text("omega\nbeta")
    got = files.scan_wordlist(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.word, r.source) for r in got] == [("omega", "a.txt"), ("beta", "a.txt"), ("zeta", "b.txt"), ("alpha", "b.txt")]


def test_scan_documents_and_events(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.md").write_bytes(b"caf\xc3\xa9 \xff!")
    assert [(r.source, r.page, r.text) for r in files.scan_documents(spark, f"{tmp_path}/d").collect()] == [("x.md", None, "café !")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "l.jsonl").write_text('{"job_id": "j", "seq": 1, "type": "plan"}\n{"job_id": "j", "seq": 2, "type": "other"}\n')
    assert [r.seq for r in files.read_events(spark, f"{tmp_path}/e", streaming=False).collect()] == [1]


def stream_of(spark, rows, schema, folder, parts=1):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(parts).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_windows_sessions_and_distinct_events(spark, tmp_path):
    rows = [("u", at(0), 1), ("u", at(30), 2), ("u", at(30), 2), ("u", at(700), 3), ("v", at(5), 4)]
    schema = "user string, ts timestamp, id int"
    s = stream_of(spark, rows, schema, f"{tmp_path}/w")
    slide = jobs.windows(s, "user", "60 seconds", slide="30 seconds").select(F.unix_seconds("w.start").alias("s"), "user", "n")
    got = {(r.s - int(START.replace(tzinfo=dt.timezone.utc).timestamp()), r.user): r.n for r in jobs.run_updates(slide, ["s", "user"], "slide").collect()}
    assert got == {(-30, "u"): 1, (0, "u"): 3, (30, "u"): 2, (660, "u"): 1, (690, "u"): 1, (-30, "v"): 1, (0, "v"): 1}
    late = [*rows, ("z", at(9000), 9)]  # moves the watermark on
    s = stream_of(spark, late, schema, f"{tmp_path}/s")
    found = jobs.run_appends(jobs.sessions(s, "user", "60 seconds").select("user", "n"), "sessions")
    assert sorted((r.user, r.n) for r in found.collect() if r.user != "z") == [("u", 1), ("u", 3), ("v", 1)]
    s = stream_of(spark, rows, schema, f"{tmp_path}/d")
    assert sorted(r.id for r in jobs.run_appends(jobs.distinct_events(s, ["user", "id"]), "distinct").collect()) == [1, 2, 3, 4]


def test_stream_job_progress(spark, tmp_path):
    rows = [("j", 0, "start", "m1", 1), ("j", 0, "failed", "m1", 2), ("j", 0, "start", "m2", 3), ("j", 0, "done", None, 4), ("j", 1, "start", "m1", 5), ("j", 1, "odd", "m9", 6)]
    schema = "job_id string, slot int, status string, model string, seq bigint"
    s = stream_of(spark, rows, schema, f"{tmp_path}/p").withColumn("type", F.lit("reader"))
    got = {r.slot: (r.state, r.model, r.replaced) for r in jobs.run_updates(jobs.reader_progress(s), ["job_id", "slot"], "progress").collect()}
    assert got == {0: ("done", "m2", 1), 1: ("running", "m1", 0)}


def test_answers_are_appended(spark, tmp_path):
    schema = "writer string, original string, answer string, created_at timestamp"
    source = f"{tmp_path}/in"
    for k, rows in enumerate([[("Ann", "a", "Asprin", at(1)), ("Ann", "b", "  ", at(2))], [("ann", "c", "asprin", at(3)), ("Bob", "d", "Other", at(4))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest_answers(spark.readStream.schema(schema).parquet(source), f"{tmp_path}/out").awaitTermination()
    got = jobs.read_answers(spark, f"{tmp_path}/out").collect()
    assert sorted((r.writer, r.answer) for r in got) == [("ann", "Asprin"), ("bob", "Other")]


def test_composed_words(spark):
    df = spark.createDataFrame([("café crème",), ("café crème",)], "t string").select(arrow.word_list(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["café", "crème"]] * 2


def test_neighbour_labels_fold(spark):
    rows = [("i", "d", "Haus", "Strasse", ["Straße"], False, 0.5, 2, 1.0)]
    df = spark.createDataFrame(rows, "image string, dataset string, label string, pred string, neighbours array<string>, flagged boolean, confidence double, readers int, seconds double")
    assert audit.score_words(df).first().neighbour_label


READINGS = "page_id int, slot int, reader string, text string, error string, given string"


def test_page_type_column_and_repeated_slots(spark):
    rows = [(1, 0, "a", "cat", None, "legal"), (1, 0, "a", "cat", None, "legal"), (1, 1, "b", "cot", None, "legal"), (1, 2, "c", "cot", None, "legal"),
            (2, 0, "a", "1-0-1 x 5 days 10 mg", None, "prescription"), (2, 1, "b", "1-0-1 x 5 days 70 mg", None, "prescription")]
    words, pages = pipeline.consensus(spark.createDataFrame(rows, READINGS), page_type=F.col("given"))
    one = [r for r in words.collect() if r.page_id == 1]
    assert [(r.text, r.readers) for r in one] == [("cot", 3)]
    assert {r.page_id: r.doc_type for r in pages.collect()} == {1: "note", 2: "prescription"}


def test_replay_steps(spark):
    with pytest.raises(ValueError):
        pipeline.parse_config("vote+kbb")
    with pytest.raises(ValueError):
        pipeline.parse_config("votes")
    texts = ["take alpha now", "take alphq now", "take alxha now"]
    rows = [(1, k, f"r{k}", t, None, "") for k, t in enumerate(texts)]
    lexicon, shipped, dictionary = (spark.createDataFrame(x, s) for x, s in (
        ([("alphas", 1)], "word string, ord int"), ([("alpha", 1)], "word string, ord int"), ([("zzzz", "zzzz")], "key string, word string")))
    picks = spark.createDataFrame([(1, 1, "alphas")], "page_id int, idx int, pick string")
    names = ["vote", "vote+dict", "vote+dict+appkb", "vote+context+kb", "vote+context+kbstrict"]
    got = {r.config: r for r in pipeline.replay(spark.createDataFrame(rows, READINGS), names, lexicon=lexicon, dictionary=dictionary, picks=picks, shipped=shipped).collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    plain = digest("take alpha now")
    assert {c: (r.words, r.flagged, r.digest) for c, r in got.items()} == {
        "vote": (3, 1, plain), "vote+dict": (3, 1, plain), "vote+dict+appkb": (3, 0, plain),
        "vote+context+kb": (3, 0, digest("take alphas now")), "vote+context+kbstrict": (3, 1, digest("take alphas now")),
    }


def test_replay_votes_prescriptions_by_their_own_rule(spark):
    text = "Tab alfa 10 mg 1-0-1 x 5 days "
    rows = [(1, k, f"r{k}", text + ("often" if k else "after"), None, "") for k in range(3)] + [(2, k, f"r{k}", "plain " + ("often" if k else "after"), None, "") for k in range(3)]
    got = {(r.config, r.page_id): r.flagged for r in pipeline.replay(spark.createDataFrame(rows, READINGS), ["vote", "vote_majority", "v2:vote", "reader:r1"]).collect()}
    assert got == {("vote", 1): 1, ("vote", 2): 0, ("vote_majority", 1): 0, ("vote_majority", 2): 0, ("v2:vote", 1): 1, ("v2:vote", 2): 0, ("reader:r1", 1): 0, ("reader:r1", 2): 0}


def test_lookalike_table(spark):
    drugs = spark.createDataFrame([("losartan", "mg", [50.0], 100.0), ("losartin", "mg", [1.0], 2.0)], "name string, unit string, strengths array<double>, max_day double")
    aliases = spark.createDataFrame([("cozaar", "losartan")], "alias string, canonical string")
    groups = spark.createDataFrame([("g1", "cozaar"), ("g1", "zocor"), ("g2", "abc"), ("g2", "abd")], "group_id string, name string")
    got = {r.name: r.alike for r in safety.build_lookalikes(drugs, aliases, groups).collect()}
    assert got == {"cozaar": ["zocor"], "zocor": ["cozaar"], "losartan": ["losartin"], "losartin": ["losartan"]}


def test_stray_slots_are_listed_and_do_not_vote(spark):
    rows = [(1, k, f"r{k}", "the cat sat", None, "") for k in range(3)] + [(1, 99, "far", "a dog ran", None, ""), (1, None, "none", "a dog ran", None, ""), (1, -1, "less", "x", None, "")]
    df = spark.createDataFrame(rows, READINGS)
    good, out = pipeline.admitted(df)
    assert {r.reader for r in good.collect()} == {"r0", "r1", "r2"}
    assert {(r.reader, r.problem) for r in out.collect()} == {(n, f"reader slot out of range: {s}") for n, s in (("far", "99"), ("none", "none"), ("less", "-1"))}
    assert [r.text for r in V.explode_words(V.vote_columns(V.align_sequences(V.page_frame(df)))).orderBy("idx").collect()] == ["the", "cat", "sat"]


def test_json_and_markdown_exports(spark):
    rows = [(1, k, f"r{k}", "Tab alfa 10 mg" if k else "Tab alta 70 mg", None, "") for k in range(3)]
    words = V.explode_words(V.vote_columns(V.align_positional(V.page_frame(spark.createDataFrame(rows, READINGS)))))
    pages = spark.createDataFrame([(1, "scan.png", START, "prescription", 3, 1, "raw")], "page_id int, name string, digitized_at timestamp, doc_type string, models int, failed int, baseline string")
    readings = spark.createDataFrame([(1, f"r{k}", None) for k in range(3)] + [(1, "r9", "down"), (1, "baseline", "x")], "page_id int, reader string, error string")
    drugs = spark.createDataFrame([(1, 0, "alfa", "10 mg", "Tab", "OD", None, ["too much"], True)], "page_id int, row int, drug string, strength string, form string, frequency string, duration string, warnings array<string>, flagged boolean")
    doc = json.loads(exports.to_json_doc(words, pages, readings=readings, rows=drugs).first().value)
    assert doc["models"] == {"answered": ["r0", "r1", "r2"], "failed": {"r9": "down"}} and doc["baseline"] == "raw" and doc["note"] == exports.NOTE
    assert doc["prescription"][0]["drug"] == "alfa" and doc["prescription"][0]["duration"] is None and doc["exported_at"]
    assert [w["text"] for w in doc["words"]] == ["Tab", "alfa", "10", "mg"] and [w["verified"] for w in doc["words"]] == [True, True, False, True]
    text = exports.to_markdown(words, pages, drugs).first().value
    assert "| alfa | 10 mg | Tab | OD | - | Check dose: too much |" in text and "- Models that read it: 3 (1 failed)" in text and "**[[10?]]**" in text


def test_exports_gather_marked_words_only(spark):
    df = spark.createDataFrame([(1, 0, "ab", False), (1, 1, "c", True)], "page_id int, idx int, text string, flagged boolean")
    p = exports._bodies(df).collect()[0]
    assert (p.body, p.marked) == ("ab [[c?]]", 1)
