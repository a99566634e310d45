"""Queries over the words of documents next to their SQL, on texts that the test tables lack."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "", " ", "\n \n", "one two\nthree", "a\tb c", "x\r\ny z", "A B one two", "  two  spaces\n \n line ", "a\n\n\nb",
    "m² a[?]b [margin] [?]", "x \x01 y", "!!!", None, *[" "] * 40,
]


@pytest.fixture(scope="module")
def odd_texts(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for name, column, texts in (("documents", "doc_id", TEXTS), ("benchmark", "item_id", ["three words spaces"])):
        con.execute(f"CREATE TABLE {name} ({column} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", list(enumerate(texts)))
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["strict_words", "tokens_norm", "word_edits", "edit_distance", "calibration", "faithfulness"])
def test_blank_pages_and_odd_spaces_as_in_sql(spark, odd_texts, name):
    folder, con = odd_texts
    got = entry.queries()[name](spark, folder)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
