"""Language identification by mixtures: each document's language proportions by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quorumtext.llm.arrow import frame, segments
from quorumtext.llm.common import written

#: Letter trigrams are hashed to so many features; a model holds one number per feature and language.
FEATURES = 1 << 16
MOST_LANGS = 256
SPACE = 32
#: Characters made into trigrams at a time.
PIECE = 2_000_000


@dataclass
class Model:
    langs: list[str]
    #: log likelihood of each feature, features x languages
    logp: np.ndarray


class Grams:
    """Letter trigrams of many texts at once."""

    def __init__(self):
        # code points that are letters: the one table that a worker builds for itself
        self.letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature) of every trigram, and which documents hold a letter.

        Texts are lower-cased, runs of non-letters become one space, and each text stands between spaces.  A text of
        more than PIECE characters is taken in pieces, each between spaces of its own."""
        docs, features, has = [], [], np.zeros(len(texts), bool)
        waiting: list[tuple[int, str]] = []
        held = 0
        for i, t in enumerate(texts):
            for a in range(0, max(len(t), 1), PIECE):
                waiting.append((i, t[a : a + PIECE]))
                held += len(waiting[-1][1])
                if held >= PIECE:
                    self._add(waiting, docs, features, has)
                    waiting, held = [], 0
        if waiting:
            self._add(waiting, docs, features, has)
        return np.concatenate(docs), np.concatenate(features), has

    def _add(self, pieces: list[tuple[int, str]], docs: list, features: list, has: np.ndarray) -> None:
        names = np.array([i for i, _ in pieces], np.int32)
        doc, feature, letters = self._grams([t for _, t in pieces])
        docs.append(names[doc])
        features.append(feature)
        has[names[letters]] = True

    def _grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = [t.lower() for t in texts]
        points = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 2 for t in low])
        letter = self.letter[points]
        has = np.zeros(len(low), bool)
        has[doc[letter]] = True
        # one space stays after each run of letters, and one in front of each text
        first = np.diff(doc, prepend=-1) != 0
        keep = letter | first
        keep[1:] |= letter[:-1]
        c = np.where(letter, points, SPACE).astype(np.uint32)[keep]
        doc = doc[keep]
        same = doc[2:] == doc[:-2]
        h = c[:-2] * np.uint32(0x9E3779B1)
        h ^= c[1:-1] * np.uint32(0x85EBCA77)
        h ^= (c[2:] * np.uint32(0xC2B2AE3D)) << np.uint32(1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        return doc[2:][same], (h & np.uint32(FEATURES - 1))[same], has


def learn(labelled: DataFrame, smoothing: float = 0.05) -> Model:
    """Trigram counts of all rows of (text, lang), summed by Spark; the driver gets languages x features numbers.

    Rows without lang or text add nothing.  More than MOST_LANGS languages are refused."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for batch in batches:
            for part in segments(batch):
                langs = part.column("lang").to_pylist()
                doc, feature, _ = grams([t or "" for t in part.column("text").to_pylist()])
                own = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                index = np.array([own[x] for x in langs])[doc] * FEATURES + feature
                sums = np.bincount(index, minlength=len(own) * FEATURES).reshape(-1, FEATURES)
                for x, i in own.items():
                    total[x] = total[x] + sums[i] if x in total else sums[i]
        for x, sums in total.items():
            at = np.flatnonzero(sums)
            yield frame({"lang": ([x] * len(at), pa.string()), "feature": (at, pa.int32()), "n": (sums[at], pa.int64())})

    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    counts = written(counts, "lang-counts")  # read twice, counted once
    if counts.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    rows = counts.toPandas()  # at most MOST_LANGS x FEATURES numbers
    langs = sorted(rows["lang"].unique())
    n = np.full((FEATURES, len(langs)), smoothing)
    np.add.at(n, (rows["feature"].to_numpy(), np.searchsorted(langs, rows["lang"].to_numpy()) if len(langs) else []), rows["n"].to_numpy())
    return Model(langs, np.log(n / n.sum(0)) if len(langs) else np.zeros((FEATURES, 0)))


def _em(p: np.ndarray, n: np.ndarray, cuts: np.ndarray, of: np.ndarray, mix: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) after expectation-maximisation, and the log likelihoods.  `p`: likelihoods
    of the distinct features of all documents, `n`: how often they occur, `of`: their document, in order from `cuts`."""
    total = np.add.reduceat(n, cuts)[:, None]
    for _ in range(rounds):
        share = p * mix[of]
        share *= (n / share.sum(1))[:, None]
        new = np.add.reduceat(share, cuts) / total
        done = np.abs(new - mix).max() < 1e-4
        mix = new
        if done:
            break
    return mix, np.add.reduceat(n * np.log((p * mix[of]).sum(1)), cuts)


def mixtures(n: np.ndarray, feature: np.ndarray, of: np.ndarray, docs: int, logp: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's languages, and its log likelihood a trigram.

    Starts from the best single language.  The language along which the likelihood rises most is added, and stays if
    the fitted likelihood grows by more than `penalty` x log(trigrams); one that costs less than that to leave out goes.
    The likelihood is concave in the proportions, so a language whose slope is below the penalty is not tried."""
    out, fit = np.zeros((docs, logp.shape[1])), np.zeros(docs)
    if not len(n):
        return out, fit
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    ids, n = of[cuts], n.astype(float)
    local = np.repeat(np.arange(len(ids)), np.diff(np.append(cuts, len(of))))
    rows = logp[feature]
    single = np.add.reduceat(rows * n[:, None], cuts)
    best = single.argmax(1)
    total = np.add.reduceat(n, cuts)
    rows -= rows.max(1, keepdims=True)
    p = np.exp(rows)
    base = np.add.reduceat(n * logp[feature].max(1), cuts)  # what the scaling above took off
    mix = np.zeros_like(single)
    mix[np.arange(len(ids)), best] = 1
    ll = single[np.arange(len(ids)), best] - base
    cost = penalty * np.log(np.maximum(total, 2))
    open_ = np.ones(len(ids), bool)
    for _ in range(logp.shape[1] - 1):
        take = open_[local]
        if not take.any():
            break
        sub, pn, pp = local[take], n[take], p[take]
        at = np.flatnonzero(np.diff(sub, prepend=-1))
        who = sub[at]
        own = np.repeat(np.arange(len(who)), np.diff(np.append(at, len(sub))))
        slope = np.add.reduceat(pp * (pn / (pp * mix[who][own]).sum(1))[:, None], at) - total[who][:, None]
        slope[mix[who] > 0] = -np.inf
        add = slope.argmax(1)
        worth = slope[np.arange(len(who)), add] > cost[who]
        open_[who[~worth]] = False
        if not worth.any():
            break
        rows_on = worth[own]
        who, add = who[worth], add[worth]
        own = np.cumsum(worth)[own[rows_on]] - 1
        pp, pn = pp[rows_on], pn[rows_on]
        at = np.flatnonzero(np.diff(own, prepend=-1))
        start = mix[who] * 0.9
        start[np.arange(len(who)), add] = 0.1
        new, value = _em(pp, pn, at, own, start, rounds)
        better = value - ll[who] > cost[who]
        open_[who[~better]] = False
        mix[who[better]], ll[who[better]] = new[better], value[better]
    # a language that a later one has made superfluous goes again
    for j in range(logp.shape[1]):
        trial = (mix[:, j] > 0) & ((mix > 0).sum(1) > 1)
        take = trial[local]
        if not take.any():
            continue
        who = np.flatnonzero(trial)
        at = np.flatnonzero(np.diff(local[take], prepend=-1))
        own = np.repeat(np.arange(len(who)), np.diff(np.append(at, take.sum())))
        start = mix[who]
        start[:, j] = 0
        start /= start.sum(1, keepdims=True)
        new, value = _em(p[take], n[take], at, own, start, rounds)
        gone = ll[who] - value < cost[who]
        mix[who[gone]], ll[who[gone]] = new[gone], value[gone]
    out[ids], fit[ids] = mix, (ll + base) / total
    return out, fit


def infer(docs: DataFrame, model: Model, penalty: float = 3.0, rounds: int = 30, carry: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, shares, fit) of each row's whole text, and the column `carry` if one is named.

    `shares` lists the languages found with their proportions, largest first; `lang_pred` is the first (ties: the
    smaller name) and `score` its proportion.  `fit` is the mean log likelihood of a trigram.  Null text, text without
    a letter, or a model without languages gives `und`, score 0 and no shares.  Every row gives one row; no shuffle.  Other columns of `docs` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))  # at most MOST_LANGS x FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        grams = Grams()
        for batch in batches:
            for part in segments(batch):
                doc, feature, has = grams([t or "" for t in part.column("text").to_pylist()])
                if not langs:
                    has = np.zeros_like(has)
                key, n = np.unique(doc.astype(np.int64) * FEATURES + feature, return_counts=True)
                of, feature = key // FEATURES, key % FEATURES
                mix, fit = mixtures(n, feature, of, len(has), logp, penalty, rounds) if langs else (np.zeros((len(has), 0)), np.zeros(len(has)))
                pred, score, shares = [], [], []
                for row, ok in zip(mix, has):
                    order = np.argsort(-row, kind="stable") if ok else []
                    if ok and not row.any():  # letters, but too few for a trigram
                        row = np.full(len(langs), 1 / len(langs))
                    pred.append(langs[order[0]] if ok else "und")
                    score.append(float(min(row[order[0]], 1.0)) if ok else 0.0)
                    shares.append([{"lang": langs[i], "share": float(row[i])} for i in order if row[i] > 0])
                share_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                out = {
                    "doc_id": (part.column("doc_id"), None), "lang_pred": (pred, pa.string()), "score": (score, pa.float64()),
                    "shares": (shares, share_type), "fit": (fit, pa.float64()),
                }
                yield frame(out | ({carry: (part.column(carry), None)} if carry else {}))

    schema = "doc_id long, lang_pred string, score double, shares array<struct<lang:string,share:double>>, fit double"
    slim = docs.select(F.col("doc_id").cast("long"), "text", *([carry] if carry else []))
    schema = StructType.fromDDL(schema)
    return slim.mapInArrow(run, StructType(schema.fields + [f for f in slim.schema.fields if f.name == carry]))


def held_out(docs: DataFrame):
    """Whether the row's id falls in the fold that is never learnt from; a null id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of the rows that may be learnt from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(docs)).select("text", "lang")


def accepted(found: DataFrame) -> DataFrame:
    """The rows of `infer` whose text some language explains better than trigrams drawn at random would be."""
    return found.where((F.col("lang_pred") != "und") & (F.col("fit") > -float(np.log(FEATURES))))
