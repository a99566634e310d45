"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments
from quorumtext.llm.common import word_count
from quorumtext.llm.shingles import ODD, Hasher, mix, shingles

#: Benchmark words a task holds at a time; a larger benchmark is taken in blocks of whole items.
BLOCK_WORDS = 400_000
SPAN = 5
#: Windows start in so many words at a time; a longer text is taken in pieces that share an item's length.
STEP = 5_000


#: Bits of a fingerprint.
BITS = 384


def _signs(parts: np.ndarray) -> np.ndarray:
    """Each shingle's BITS votes, +1 or -1."""
    seeds = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * ODD
    return np.unpackbits(mix(parts[:, None] + seeds).view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int8) * 2 - 1


def _fingerprints(votes: np.ndarray) -> np.ndarray:
    return votes > 0


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shingles of two windows weighed by how often they occur: sum of minima over sum of maxima."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    low = sum(min(n, y[t]) for t, n in x.items())
    return low / (len(a) + len(b) - low)


class Items:
    """One block of benchmark items: fingerprints indexed by item length and Hamming block.

    A fingerprint is cut into `radius` + 1 blocks, so two of them that differ in `radius` bits or fewer agree in one."""

    def __init__(self, rows: list[tuple[int, str]], radius: int, exact: bool = False):
        hasher = Hasher()
        self.blocks, self.wide, self.exact = radius + 1, BITS // (radius + 1), exact
        self.ids, self.size, self.parts, prints = [], [], [], []
        for item_id, text in rows:
            w = hasher.words([text])[0]
            if len(w):
                self.ids.append(item_id)
                self.size.append(len(w))
                self.parts.append(shingles(w, SPAN))
                prints.append(_fingerprints(_signs(self.parts[-1]).sum(0, dtype=np.int32)))
        self.prints = np.array(prints, bool).reshape(-1, BITS)
        #: (length, block, value) -> items
        self.index: dict[tuple[int, int, int], list[int]] = {}
        for i, (n, values) in enumerate(zip(self.size, self.cut(self.prints).tolist())):
            for b, v in enumerate(values):
                self.index.setdefault((n, b, v), []).append(i)
        #: every shingle of every item, and the lengths of the items that hold it; (length, shingle) -> items
        self.lengths: dict[int, set[int]] = {}
        self.holders: dict[tuple[int, int], list[int]] = {}
        for i, (n, part) in enumerate(zip(self.size, self.parts)):
            for t in set(part.tolist()):
                self.lengths.setdefault(t, set()).add(n)
                self.holders.setdefault((n, t), []).append(i)
        self.known = np.array(sorted(self.lengths), np.uint64)

    def cut(self, prints: np.ndarray) -> np.ndarray:
        """Value of each block of each fingerprint."""
        used = prints[:, : self.blocks * self.wide].reshape(-1, self.blocks, self.wide)
        return used @ (1 << np.arange(self.wide))


def _found(items: Items, words: np.ndarray, short: int, least: float) -> dict[int, tuple[float, int]]:
    """Item -> (similarity, first word) of its best window in one document, the first of equal ones."""
    best: dict[int, tuple[float, int]] = {}
    longest = max(items.size, default=1)
    for base in range(0, len(words), STEP):
        w = words[base : base + STEP + longest - 1]
        parts = [shingles(w, n) for n in range(short, min(SPAN, len(w) + 1))]  # items shorter than a shingle
        for part in [*parts, shingles(w, SPAN)] if len(w) >= SPAN else parts:
            for i, (score, at) in _windows(items, w, part, least, base == 0).items():
                if i not in best or score > best[i][0]:
                    best[i] = (score, base + at)
    return best


def _windows(items: Items, words: np.ndarray, parts: np.ndarray, least: float, start: bool) -> dict[int, tuple[float, int]]:
    """Item -> (similarity, first word) of its best window in one document, or in a piece of it.

    The piece at the document's start holds more words than any item if the document does, so for a longer item it is
    the whole document."""
    best: dict[int, tuple[float, int]] = {}
    if not len(items.known) or not len(parts):
        return best
    # A window without any item's shingle has similarity 0: it cannot pass and gets no fingerprint.
    at = np.searchsorted(items.known, parts)
    at[at == len(items.known)] = 0
    hits = np.flatnonzero(items.known[at] == parts)
    if not len(hits):
        return best
    of_length: dict[int, list[int]] = {}
    for h in hits.tolist():
        for n in items.lengths[int(parts[h])]:
            of_length.setdefault(n, []).append(h)
    sums = np.zeros((len(parts) + 1, BITS), np.int32)
    np.cumsum(_signs(parts), axis=0, dtype=np.int32, out=sums[1:])
    for n, places in of_length.items():
        span = min(SPAN, n)
        size = min(n, len(words))  # a shorter document is one window
        last = len(words) - size
        if size < n and (not start or (size - span + 1) / (n - span + 1) < least):
            continue
        starts = np.unique(np.concatenate([np.arange(max(0, h - n + span), min(h, last) + 1) for h in places]))
        p, m = size - span + 1, n - span + 1
        near: set[tuple[int, int]] = set()
        # most windows that hold one shingle of an item hold no more: few starts at a time, so memory is bounded
        for k in range(0, len(starts), 2048):
            own = starts[k : k + 2048]
            values = items.cut(_fingerprints(sums[own + p] - sums[own]))
            for b in range(items.blocks):
                for v in np.unique(values[:, b]).tolist():
                    for i in items.index.get((n, b, v), ()):
                        near.update((i, k + s) for s in np.flatnonzero(values[:, b] == v).tolist())
        if items.exact:
            # a similar window has at least this many places that hold shingles of the item
            enough = math.ceil(least * (p + m) / (1 + least) - 1e-9)
            held = np.zeros(len(parts) + 1, np.int64)
            held[np.array(places) + 1] = 1
            held = np.cumsum(held)
            for s in np.flatnonzero(held[starts + p] - held[starts] >= enough).tolist():
                a = int(starts[s])
                shared = Counter(i for t in parts[a : a + p].tolist() for i in items.holders.get((n, t), ()))
                near.update((i, s) for i, k in shared.items() if k >= enough)
        for i, s in sorted(near):
            a = int(starts[s])
            score = weighted_similarity(parts[a : a + p], items.parts[i])
            if score >= least and (i not in best or score > best[i][0]):
                best[i] = (score, a)
    return best


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_WORDS words (or one longer item), one block on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    parts = -(-2 * total // BLOCK_WORDS)
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        yield [tuple(r) for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 31, exact: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): benchmark items found in each row's whole text, with the
    best window of each.

    Windows are as long as the item, at every word; a text of fewer words than the item is one window, the whole of it,
    so an item without some of its words is found where nothing else stands.  A window's SimHash has BITS bits, voted by
    its five-word shingles as often as they occur; it is looked up by `radius` + 1 Hamming blocks, which finds every item
    within `radius` bits, and by chance nearly all of those at `least` (see the README for the recall measured).  All
    pairs are verified by the similarity of their shingles, weighed by count, which must reach `least`.  With `exact`,
    windows that hold as many shingles of an item as `least` takes are verified too, so none is missed.

    Words are lower-cased (A-Z) and split at ASCII white space; an item of fewer than five words is one shingle.
    Null or empty texts and items match nothing.  Repeated rows each give their rows.  The benchmark is brought to the
    documents in blocks of bounded size, so no text is shuffled.  Other columns of both tables are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = None
    for rows in _item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)  # at most about BLOCK_WORDS words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, hasher = Items(shared.value, radius, exact), Hasher()
            short = min((n for n in items.size if n < SPAN), default=SPAN)
            for batch in batches:
                for part in segments(batch):
                    out: list[tuple] = []
                    words, ends = hasher.words(part.column("text").to_pylist())
                    begin = 0
                    for doc_id, end in zip(part.column("doc_id").to_pylist(), ends.tolist()):
                        w, begin = words[begin:end], end
                        best = _found(items, w, short, least)
                        out += [(doc_id, items.ids[i], s, a, items.size[i]) for i, (s, a) in best.items()]
                    cols = list(zip(*out)) or [[]] * 5
                    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
                    yield frame({n: (list(c), t) for n, c, t in zip(names, cols, types)})

        one = slim.mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return slim.sparkSession.createDataFrame([], schema) if found is None else found
