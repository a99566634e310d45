"""Corpus pipeline: each stage is one operator of the llm folder, written as Parquet and read by the next.

Rows without doc_id take part in every stage.  Rows that share a doc_id count as one document where documents are
counted; among near copies, rows are told apart by id and text, so rows that share an id but not a text are judged each
by its own text.  Null texts have no language and go with the first stage.  Extra columns stay to the last stage, which
returns the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.llm import decontam, langid, lines, mixing, ngram_join
from quorumtext.llm.common import MADE, remove, small, written

ROW = "__row"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ROW): the row whole, beside what the operators read."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled rows of the fold for learning; rows without letters, and rows that no
    language explains better than chance, go."""
    model = langid.learn(langid.training_rows(docs))
    found = langid.infer(_rows(docs), model, carry=ROW)
    return langid.accepted(found).select(f"{ROW}.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; texts keep the rest, and n_chars follows."""
    found = lines.line_dedup(_rows(docs), carry=ROW)
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    out = found.select(f"{ROW}.*", lines.kept_text(F.col("kept")).alias("__kept")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _named(docs: DataFrame) -> DataFrame:
    """Adds `__id`, the number that the join knows a row's id and text by: the doc_id; a large number from id and text
    for rows without one, and for all texts of an id but the first by hash."""
    hashed = docs.withColumn("__h", F.xxhash64("text"))
    twice = hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("__h").alias("__lo"), F.max("__h").alias("__hi"))
    twice = twice.where("__lo <> __hi").select(F.col("doc_id").alias("__doc"), "__lo")
    own = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 61)
    first = F.col("__lo").isNull() | (F.col("__h") == F.col("__lo"))
    joined = hashed.join(small(twice), F.col("doc_id") == F.col("__doc"), "left")
    return joined.withColumn("__id", F.when(F.col("doc_id").isNotNull() & first, F.col("doc_id").cast("long")).otherwise(own)).drop("__h", "__doc", "__lo")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of similarity 0.8 join, the one with the smallest id stays (rows without id, and later
    texts of an id, rank behind all others).  Of rows with equal id and text the smallest row stays.  Texts without words
    stay."""
    named = _named(docs)
    found = written(ngram_join.similar_sets(named.select(F.col("__id").alias("doc_id"), "text")), "pipeline-groups")
    found = found.where("n_shingles > 0").withColumnRenamed("doc_id", "__id")
    gone = small(found.where("__id <> component_id").select("__id").distinct())
    twice = found.where("__id = component_id").groupBy("__id").count().where("count > 1").select("__id")
    kept = named.join(gone, "__id", "left_anti")
    if not twice.isEmpty():
        twice = small(twice)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        once = kept.join(twice, "__id", "left_semi").groupBy("__id").agg(F.min(row).alias("r")).select("__id", "r.*")
        kept = kept.join(twice, "__id", "left_anti").unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a near copy of one, go.  Found by text, so equal texts go together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.withColumn("__key", F.xxhash64("text"))
    found = decontam.contaminated(named.select(F.col("__key").alias("doc_id"), "text"), benchmark)
    found = written(found.select(F.col("doc_id").alias("__key")).distinct(), "pipeline-leaks")
    return named.join(small(found), "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)


#: Tables that the last call of each stage wrote for itself.
_own: dict[str, list[str]] = {}


def _stage(name: str, before: str | None, work: Callable) -> tuple[str, Callable]:
    """The stage under its name.  Its docs are the written result of the stage before, so that one's own tables go."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before:
            remove(spark, _own.pop(before, []))
        start = len(MADE)
        out = work(spark, docs, sf_dir)
        _own[name] = MADE[start:]
        return out

    return name, run_stage


STAGES = [
    _stage("language", None, identify),
    _stage("line_dedup", "language", dedup_lines),
    _stage("near_dup", "line_dedup", dedup_near),
    _stage("decontaminate", "near_dup", decontaminate),
    _stage("mix", "decontaminate", mix),
]

#: The language stage learns its model, which SQL cannot express; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
