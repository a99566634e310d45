"""Word benchmark scores, dataset audit, near-copy joins, manifests and reader health."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.functions import text as X
from quorumtext.functions.arrow import bench_norm
from quorumtext.operators.fuzzy import spread
from quorumtext.operators.selection import medians

# ---------------------------------------------------------------- near copies

def _bands(h: Column, bits: int, distance: int, agree: int) -> Column:
    """Keys of a hash: every choice of `agree` bands out of distance + agree.  Up to `distance` differing bits
    spoil at most that many bands, so near hashes share at least one key."""
    n = distance + agree
    edges = [i * bits // n for i in range(n + 1)]

    def band(i: int) -> Column:
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("string")

    return F.array(*[F.concat_ws("|", F.lit("".join(map(str, c))), *[band(i) for i in c]) for c in combinations(range(n), agree)])


def hamming_join(a: DataFrame, b: DataFrame, distance: int, bits: int = 64, agree: int = 2) -> DataFrame:
    """Distinct hash pairs (ha, hb, d) within `distance` bits.  a: ha, b: hb.

    Equal hashes are collapsed first, so a third of the rows being copies of one item costs one hash.  Two
    agreeing bands make keys of about half the bits, selective enough to keep the candidate lists short.
    """
    x = a.select("ha").distinct().select("ha", F.explode(_bands(F.col("ha"), bits, distance, agree)).alias("band"))
    y = b.select("hb").distinct().select("hb", F.explode(_bands(F.col("hb"), bits, distance, agree)).alias("band"))
    d = F.bit_count(F.col("ha").bitwiseXOR(F.col("hb")))
    # the keys of a hash are many times its size, which Spark's estimate does not see: without the hint a side that is
    # called small goes through the driver, and without the explicit number few tasks compare all candidates
    near = spread(x, "band").join(spread(y, "band").hint("merge"), "band").where(d <= distance).select("ha", "hb").distinct()
    return near.withColumn("d", d)


def exclude_copies(test: DataFrame, train: DataFrame, distance: int = 2, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded) rows of `test`: a row goes when some `train` hash is near.  Both have `h`."""
    near = hamming_join(test.select(F.col("h").alias("ha")), train.select(F.col("h").alias("hb")), distance, bits)
    bad = near.select(F.col("ha").alias("h")).distinct()
    return test.join(bad, "h", "left_anti"), test.join(bad, "h", "left_semi")


# ---------------------------------------------------------------- inventory

def split_inventory(files: DataFrame) -> DataFrame:
    """Counts per split of (split, label, content), and of images (width, height) where the table has those columns: an
    image that is there but has no size could not be read."""
    label = F.col("label")
    sized = {"width", "height"} <= set(files.columns)
    broken = [F.count_if(F.col("content").isNotNull() & (F.col("width").isNull() | F.col("height").isNull())).alias("unreadable")] if sized else []
    counts = files.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("content").isNull()).alias("missing"),
        F.count_if(F.coalesce(X.strip(label), F.lit("")) == "").alias("empty_label"),
        F.countDistinct("label").alias("unique_labels"),
        F.max(F.length("label")).alias("longest_label"),
        F.count_if(X.has_digit(label)).alias("with_digit"),
        F.count_if(label.contains(" ")).alias("with_space"),
        *broken,
    )
    middle = {"median_label": F.length("label")}
    if sized:
        middle |= {"median_width": F.col("width"), "median_height": F.col("height")}
    return _with_medians(counts, files, "split", middle)


def _with_medians(counts: DataFrame, rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Both per key; a row a key, so this join is small whatever the input."""
    middle = medians(rows, key, values).withColumnRenamed(key, "__key")
    return counts.join(middle, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Files beyond the first of every content, per split; the hash count combines before it shuffles."""
    per = files.where("content is not null").groupBy("split", F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("n"))
    return per.groupBy("split").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: contents in both, labels in both, rows of `b` whose label also occurs in `a`.  Both: label, content."""
    digest = F.sha2("content", 256)
    same = a.select(digest.alias("x")).intersect(b.select(digest.alias("x"))).agg(F.count("*").alias("identical"))
    labels = a.select("label").intersect(b.select("label")).agg(F.count("*").alias("shared_labels"))
    hit = b.join(a.select("label").distinct(), "label", "left_semi").agg(F.count("*").alias("covered"))
    total = b.agg(F.count("*").alias("rows"))
    return total.select(
        same.scalar().alias("identical"), labels.scalar().alias("shared_labels"), hit.scalar().alias("covered"), "rows"
    )


def near_copies(a: DataFrame, b: DataFrame, distance: int = 2) -> DataFrame:
    """One row: rows of `b` whose hash is near one of `a`, and those with the very same hash.  Both: h."""
    _, out = exclude_copies(b, a, distance)
    same = b.join(a.select("h").distinct(), "h", "left_semi").agg(F.count("*").alias("same"))
    return out.agg(F.count("*").alias("near")).select("near", same.scalar().alias("same"))


def manifest(test: DataFrame, train: DataFrame, per_dataset: int, distance: int = 2, seed: int = 2026) -> DataFrame:
    """Sample of the test items that are no copies of train items, datasets in turn.  Both: dataset, image, h."""
    kept, _ = exclude_copies(test, train, distance)
    return interleave(seeded_sample(kept, per_dataset, seed))


def unlabelled(files: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return files.select(key).subtract(labels.select(key))


def top_labels(rows: DataFrame, n: int) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def train_vocabulary(labels: DataFrame) -> DataFrame:
    """Words longer than two characters, not all digits, from the train split only."""
    w = labels.where("split = 'train'").select(F.explode(X.tokens(F.col("label"))).alias("word"))
    return w.where((F.length("word") > 2) & ~F.col("word").rlike(r"^\d+$") & (F.col("word") != X.NEWLINE)).distinct()


# ---------------------------------------------------------------- manifest

def seeded_sample(items: DataFrame, per_dataset: int, seed: int = 2026) -> DataFrame:
    """First `per_dataset` items of every dataset in a fixed hash order, with their place."""
    order = F.md5(F.concat_ws("-", F.lit(seed), "dataset", "image"))
    w = Window.partitionBy("dataset").orderBy("draw", "image")
    return items.withColumn("draw", order).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_dataset)


def interleave(sample: DataFrame) -> DataFrame:
    """Round robin over the datasets, cut to the shortest."""
    least = sample.groupBy("dataset").agg(F.max("place").alias("n")).agg(F.min("n").alias("least"))
    return sample.where(F.col("place") <= least.scalar()).orderBy("place", "dataset")


def pending(items: DataFrame, done: DataFrame, key: str = "image") -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def first_runs(runs: DataFrame, min_readers: int = 0) -> DataFrame:
    """First run of every image that has readings."""
    cols = F.struct(*[c for c in runs.columns if c != "image"])
    ok = runs.where("readers > 0")
    return ok.groupBy("image").agg(F.min_by(cols, "run_no").alias("r")).select("image", "r.*").where(F.col("readers") >= min_readers)


def head_and_tail(runs: DataFrame, n: int, order: str = "run_no") -> tuple[DataFrame, DataFrame]:
    """First n runs and the rest, without sorting everything in one task."""
    head = runs.orderBy(order).limit(n)
    last = head.agg(F.max(order).alias("last"))
    return head, runs.where(F.col(order) > last.scalar())


def stop_point(runs: DataFrame, min_readers: int, order: str = "run_no", chunk: int = 100_000) -> DataFrame:
    """Rows up to the first place where two runs in a row have too few readers.

    Neighbours are found inside chunks of the run number; the first row of a chunk looks at the last of the
    chunk before through a one-row-per-chunk summary, so no window spans the whole log.
    """
    low = (F.col("readers") < min_readers).cast("int")
    c = runs.withColumn("chunk", F.floor(F.col(order) / chunk)).withColumn("low", low)
    ends = c.groupBy("chunk").agg(F.max_by("low", order).alias("end_low"))
    # chunk summaries are few; a chunk may be empty, so the one before is found in order
    before = ends.select("chunk", F.lag("end_low").over(Window.orderBy("chunk")).alias("before_low"))
    w = Window.partitionBy("chunk").orderBy(order)
    seen = c.join(before, "chunk").withColumn("prev", F.coalesce(F.lag("low").over(w), "before_low", F.lit(0)))
    stop = seen.where("low = 1 and prev = 1").agg(F.min(order).alias("stop"))
    return runs.where(stop.scalar().isNull() | (F.col(order) <= stop.scalar()))


# ---------------------------------------------------------------- word scores

def neighbour_labels(labels: DataFrame) -> DataFrame:
    """(n, neighbours): labels of the rows numbered n-1 and n+1, by an equi-join on the row number."""
    shifted = labels.select(F.explode(F.array(F.col("n") - 1, F.col("n") + 1)).alias("n"), F.col("label").alias("other"))
    near = shifted.groupBy("n").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))
    return labels.join(near, "n", "left")


def score_words(runs: DataFrame) -> DataFrame:
    """One scored row per run.  runs: image, dataset, label, pred, neighbours, flagged, confidence, readers, seconds."""
    pred = F.coalesce("pred", F.lit(""))
    p, g = F.col("p"), F.col("g")
    keyed = runs.withColumn("p", bench_norm(F.col("pred"))).withColumn("g", bench_norm(F.col("label")))
    # neighbours take the same normal form as the prediction, all of a row in one call; the mark between them stays
    between = "\ue000"
    near = F.array_contains(F.split(bench_norm(F.array_join(F.coalesce("neighbours", F.array().cast("array<string>")), between)), between), p)
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return keyed.select(
        *runs.columns,
        (p == "").alias("empty"),
        (X.raw_clean(F.col("pred")) == X.raw_clean(F.col("label"))).alias("exact_raw"),
        (p == g).alias("exact_norm"),
        F.levenshtein(p, g).alias("char_edits"),
        F.greatest(F.lit(1), F.length(g)).alias("ref_chars"),
        ((p != g) & near).alias("neighbour_label"),
        X.has_digit(F.col("label")).alias("has_digit"),
        (digits(F.col("label")) == digits(pred)).alias("digits_ok"),
    )


def measured(scored: DataFrame) -> DataFrame:
    """Rows the reader answered; no answer is not a wrong answer."""
    return scored.where("pred is not null")


def summary(scored: DataFrame) -> DataFrame:
    """Sixteen metrics per dataset and for all together, in one pass."""
    wrong = ~F.col("exact_norm")
    out = scored.rollup("dataset").agg(
        F.count("*").alias("samples"),
        F.avg(F.col("exact_raw").cast("int")).alias("exact_raw"),
        F.avg(F.col("exact_norm").cast("int")).alias("exact_norm"),
        (F.sum("char_edits") / F.sum("ref_chars")).alias("cer_norm"),
        F.avg(F.col("flagged").cast("int")).alias("flag_rate"),
        F.avg(F.when(~F.col("flagged"), F.col("exact_norm").cast("int"))).alias("acc_unflagged"),
        F.avg(F.when(F.col("flagged"), F.col("exact_norm").cast("int"))).alias("acc_flagged"),
        F.count_if(wrong & ~F.col("flagged")).alias("confident_errors"),
        F.avg((wrong & ~F.col("flagged")).cast("int")).alias("confident_error_rate"),
        F.avg(F.when(wrong, F.col("flagged").cast("int"))).alias("error_recall"),
        F.count_if("empty").alias("empty"),
        F.count_if("neighbour_label").alias("neighbour_label_matches"),
        F.count_if("has_digit").alias("digit_samples"),
        F.count_if(F.col("has_digit") & ~F.col("digits_ok")).alias("digit_errors"),
        F.avg("readers").alias("avg_readers"),
    )
    out = out.withColumn("dataset", F.coalesce("dataset", F.lit("Combined")))
    names = F.explode(F.array_distinct(F.array(F.coalesce("dataset", F.lit("Combined")), F.lit("Combined"))))
    return _with_medians(out, scored.select(names.alias("dataset"), "seconds"), "dataset", {"median_seconds": F.col("seconds")})


# Names of the failure categories.
EMPTY, NEIGHBOUR = "empty output / abstained entirely", "matches a neighbouring row's label (suspected label error)"
PARTLY, NUMBER = "partly unreadable ([?] kept)", "number wrong or missing"
EXTRA, MISSING = "extra words added", "word missing"
NEAR_MISS, FAR_MISS = "near miss (<=25% characters wrong)", "far miss (>25% characters wrong)"


def category() -> Column:
    """One failure category per wrong prediction, first matching rule wins."""
    pred, label = F.coalesce("pred", F.lit("")), F.col("label")
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    return (
        F.when(F.col("empty"), EMPTY)
        .when(F.col("neighbour_label"), NEIGHBOUR)
        .when(pred.contains("[?]"), PARTLY)
        .when(F.col("has_digit") & ~F.col("digits_ok"), NUMBER)
        .when(n(pred) > n(label), EXTRA)
        .when(n(pred) < n(label), MISSING)
        .when(F.col("char_edits") / F.col("ref_chars") <= 0.25, NEAR_MISS)
        .otherwise(FAR_MISS)
    )


def categories(scored: DataFrame) -> DataFrame:
    wrong = scored.where(~F.col("exact_norm"))
    return wrong.groupBy(category().alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two configurations on the rows both have."""
    cols = ("exact_norm", "char_edits", "ref_chars", "flagged")
    left = a.select("image", *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select("image", *[F.col(c).alias(f"b_{c}") for c in cols])
    both = left.join(right, "image")
    out = [F.count("*").alias("images")]
    for s in ("a", "b"):
        out += [
            F.count_if(f"{s}_exact_norm").alias(f"{s}_exact"),
            (F.sum(f"{s}_char_edits") / F.sum(f"{s}_ref_chars")).alias(f"{s}_cer"),
            F.count_if(~F.col(f"{s}_exact_norm") & ~F.col(f"{s}_flagged")).alias(f"{s}_confident"),
        ]
    return both.agg(*out)


def faithfulness(rows: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored text against text computed again: rows compared and mismatches."""
    # counted after the join: a filter on the text would be pushed into, and repeat, whatever computes it
    both = rows.join(recomputed.select("image", F.col("final").alias("again")), "image")
    stored = F.col("final").isNotNull()
    return both.agg(
        F.count_if(stored).alias("rows"), F.count_if(stored & ~F.col("final").eqNullSafe(F.col("again"))).alias("mismatches")
    )


# ---------------------------------------------------------------- readers

def reader_health(log: DataFrame) -> DataFrame:
    """(reader, status, ms): answered, failed, timeout rate, latency per reader."""
    counts = log.groupBy("reader").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "done").alias("answered"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg((F.col("status") == "timeout").cast("int")).alias("timeout_rate"),
        F.max("ms").alias("max_ms"),
    )
    return _with_medians(counts, log, "reader", {"median_ms": F.when(F.col("status") == "done", F.col("ms"))})


def reader_coverage(readings: DataFrame, samples: Column, share: float = 0.6) -> DataFrame:
    """Readers that answered at least `share` of the samples."""
    return readings.groupBy("reader").agg(F.countDistinct("page_id").alias("n")).withColumn("usable", F.col("n") >= samples * share)


def reader_accuracy(cells: DataFrame) -> DataFrame:
    """(reader, right) -> words, right and accuracy per reader."""
    return cells.groupBy("reader").agg(
        F.count("*").alias("words"), F.count_if("right").alias("right"), F.avg(F.col("right").cast("int")).alias("accuracy")
    )


def readiness(pages: DataFrame, saved: DataFrame, slots: int) -> DataFrame:
    """(page_id) and saved (page_id, prompt, slot): best prompt per page over the slots: ok, partly or missing."""
    per_prompt = saved.groupBy("page_id", "prompt").agg(F.countDistinct("slot").alias("n"))
    best = per_prompt.groupBy("page_id").agg(F.max("n").alias("best"))
    b = F.coalesce("best", F.lit(0))
    return pages.join(best, "page_id", "left").select(
        "page_id", b.alias("saved"), F.when(b >= slots, "ok").when(b > 0, "partly").otherwise("missing").alias("state")
    )
