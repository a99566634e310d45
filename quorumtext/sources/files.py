"""Readers of run logs, label files, page/truth pairs, word lists, documents and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.functions import text as X

# Image extensions and the event types the log defines.
IMAGE_EXT = ("jpg", "jpeg", "png", "webp")
EVENT_TYPES = ("plan", "stage", "reader", "ping", "result", "error")

WORD = (
    "text:string, confidence:double, flagged:boolean, likely:boolean, alternatives:array<string>, votes:map<string,int>, "
    "readers:int, by_model:map<string,string>, lookalikes:array<string>, resolved_by:string, evidence:string, original:string"
)
RUN = (
    "image string, dataset string, final string, readings map<string,string>, errors map<string,string>, doc_type string, "
    "seconds double, baseline_raw string, single_raw string, single_clean string, error string, "
    f"ablation_errors map<string,string>, words array<struct<{WORD}>>"
)
EVENT = (
    "job_id string, seq bigint, ts timestamp, type string, stage string, status string, slot int, model string, error string, ms bigint, "
    "answered int, failed int, readers array<string>"
)


def scan_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ok, failed): runs with readings, and runs where no reader answered (an infrastructure failure)."""
    runs = spark.read.schema(RUN).json(path).where("image is not null")
    answered = F.coalesce(F.size("readings"), F.lit(0)) > 0
    return runs.where(answered), runs.where(~answered)


def scan_labels(spark: SparkSession, spec: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """spec rows: (dataset, split, csv path, image column, label column) -> (dataset, split, image, label)."""
    out = None
    for dataset, split, path, image, label in spec:
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
        clean = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
        part = clean.select(
            F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), F.col(image).alias("image"), F.coalesce(label, F.lit("")).alias("label")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no label files given")
    return out


def _stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def scan_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, image, text): page files of an image type that have a same-named text file."""
    images = (
        spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
        .where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_EXT))
        .select(_stem().alias("stem"), F.col("path").alias("image"))
    )
    texts = (
        spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
        .select(_stem("_metadata.file_path").alias("stem"), F.col("value").alias("text"))
    )
    return images.join(texts, "stem")


def scan_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(word, source, ord): trimmed lines of text files without blanks and # comments.  `ord` sorts by file name, block of
    the file and line of the block."""
    source = F.col("_metadata.file_name")
    place = F.struct(source.alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(X.strip(F.col("value")).alias("word"), source.alias("source"), place.alias("ord"))
    return lines.where((F.col("word") != "") & ~F.col("word").startswith("#")).select("word", "source", "ord")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, text): text files as one page without a number; undecodable bytes are dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), F.lit(None).cast("int").alias("page"),
        F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"),
    )


def read_events(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Event log as JSON lines; unknown event types are ignored."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(EVENT).json(path).where(F.col("type").isin(*EVENT_TYPES))
