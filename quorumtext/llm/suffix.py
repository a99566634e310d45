"""Suffix-array dedup of repeated byte strings.

Text is cut by content: of every 400-byte string the 32-byte piece with the smallest hash is its anchor, so equal
strings have equal anchors at equal places.  Contexts of anchors that occur twice meet by anchor.  There the contexts
are read as sequences of 32-byte blocks counted from the anchor, and a suffix array of all sequences of a shard, built
by linear grouping, finds the runs of blocks that repeat; the odd bytes at both ends of a string are compared by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments
from quorumtext.llm.common import FILTER_BITS, bit_filter, in_filter, written
from quorumtext.llm.shingles import ODD, mix

PIECE = 32
BLOCK = 32
#: Contexts of a shard.  Anchors that occur more often than HOT are dealt by RANGES of starts and the bytes that all strings
#: of a range share, and so are groups that still have more contexts, down to one start.  There the key is the whole
#: string, equal strings of a segment are one row, and nothing is left to compare.
SHARD, HOT, RANGES = 8_000, 4_000, 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last is the only smallest, by linear grouping.

    First part: suffixes are grouped by first symbol.  Groups are taken in descending order.  For each member the
    nearest earlier suffix of a lower group (its previous smaller) is found along the pointers of higher groups; those
    earlier suffixes, by how many members point at them, leave their groups for new ones just above the rest.  In the
    end the groups are those of the Lyndon prefixes, in order.  Second part: starting with the last suffix, the
    suffixes before each one placed are placed at the front of their groups, along the pointers.  Nothing is renamed
    or sorted again.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = s[order]
    head = np.maximum.accumulate(np.where(np.append(True, first[1:] != first[:-1]), np.arange(n), 0))
    start_of = np.empty(n, np.int64)
    start_of[order] = head
    group = start_of.tolist()  # the first place of each suffix's group
    members: dict[int, list[int]] = {}
    cuts = np.flatnonzero(np.append(True, head[1:] != head[:-1])).tolist()
    listed = order.tolist()
    for a, b in zip(cuts, [*cuts[1:], n]):
        members[a] = listed[a:b]
    size = {a: len(m) for a, m in members.items()}
    prev = [-1] * n
    end = n
    # groups by the place behind them: the next one below ends where this one starts
    at_end = {a + len(m): a for a, m in members.items()}
    while end > 0:
        start = at_end[end]
        own = sorted(i for i in members.pop(start) if group[i] == start) if len(members[start]) > 1 else members.pop(start)
        points: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                points[p] = points.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, k in points.items():
            by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for g, moved in by_count[k].items():
                rest = size[g] - len(moved)
                if rest:
                    top = g + rest
                    at_end[g + size[g]] = top
                    at_end[top] = g
                    size[g], size[top] = rest, len(moved)
                    members[top] = moved
                    for p in moved:
                        group[p] = top
        end = start
    out, front = [-1] * n, dict(size)
    front = {g: g for g in front}
    placed = [False] * n
    out[0], placed[n - 1] = n - 1, True
    for r in range(n):
        p = out[r] - 1
        while p >= 0 and not placed[p]:
            placed[p] = True
            out[front[group[p]]] = p
            front[group[p]] += 1
            p = prev[p]
    return np.array(out)


def _hash_pieces(flat: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes at each place, by doubling."""
    h, wide, power = mix(flat.astype(np.uint64) + np.uint64(1)), 1, int(ODD)
    while wide < PIECE:
        h = h[:-wide] * np.uint64(power) + h[wide:]
        power, wide = power * power % (1 << 64), wide * 2
    return mix(h)


def _smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` numbers."""
    n = len(v) - width + 1
    full = -(-len(v) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, starts): anchors, and the strings of `length` bytes that each of them marks."""
    out = []
    step = 1 << 22  # long texts are taken in pieces that share length - 1 bytes
    for base in range(0, max(len(text) - length + 1, 0), step):
        flat = np.frombuffer(text, np.uint8)[base : base + step + length - 1]
        h = _hash_pieces(flat)
        ranked = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)  # ties: the first
        at = (_smallest(ranked, length - PIECE + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out.append((h[at[cuts]], at[cuts] + base, cuts + base, np.diff(np.append(cuts, len(at)))))
    if not out:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _repeated_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, n) of the anchors that occur twice or more, counted with a map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch):
                found = [anchors((t or "").encode(), length)[0] for t in part.column("text").to_pylist()]
                a, n = np.unique(np.concatenate(found), return_counts=True)
                yield frame({"anchor": (a.view(np.int64), pa.int64()), "n": (n, pa.int64())})

    found = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return written(found.where("n > 1"), "suffix-anchors")


def _steps(length: int) -> list[int]:
    """Starts of a range at each split, down to one."""
    out = [-(-(length - PIECE + 1) // RANGES)]
    while out[-1] > 1:
        out.append(-(-out[-1] // RANGES))
    return out


def _split(raw: bytes, group: int, place: int, low: int, first: int, starts: int, length: int, hot: list[np.ndarray], depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(group, first, starts, depth): the strings of a group, which start at `low` or later, by range of their start,
    counted from the anchor, for as long as the group is hot.  Equal strings fall in the same range and share the bytes
    that all strings of that range cover, so they stay together; a range of one start is the string itself."""
    steps = _steps(length)
    if depth == min(len(hot), len(steps)) or not hot[depth][group % FILTER_BITS >> 6] >> np.uint64(group & 63) & np.uint64(1):
        yield group, first, starts, depth
        return
    step = steps[depth]
    for lo in range(low, first + starts, step):
        a, b = max(first, lo), min(first + starts, lo + step)
        if a < b:
            core = raw[lo + step - 1 : lo + length]
            key = xxhash.xxh3_64_intdigest(core, seed=(group ^ (place - lo)) % (1 << 64)) - (1 << 63)
            yield from _split(raw, key, place, lo, a, b - a, length, hot, depth + 1)


def _hot_groups(texts: DataFrame, length: int, often: DataFrame) -> tuple[list[np.ndarray], int]:
    """Filters of the groups of more than HOT contexts at each depth, and how many contexts the splits add at most.

    A group is counted after equal contexts of a segment have met, as it is sent.  Each depth that has hot groups reads
    the texts once more; the last split needs no count."""
    spark, steps, added = texts.sparkSession, _steps(length), 0
    counted = often.withColumnRenamed("anchor", "group")
    hot: list[np.ndarray] = []
    for depth in range(1, len(steps) + 1):
        large = counted.where(F.col("n") > HOT)
        m = large.agg(F.sum("n")).first()[0] or 0
        if not m:
            break
        hot.append(bit_filter(large, "group"))
        if depth == len(steps):
            added += m * RANGES
            break
        bits = spark.sparkContext.broadcast(hot)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], bits=bits, depth=depth) -> Iterator[pa.RecordBatch]:
            hot = bits.value
            for batch in batches:
                for part in segments(batch):
                    seen = set()
                    for text in part.column("text").to_pylist():
                        raw = text.encode()
                        a, place, first, starts = anchors(raw, length)
                        maybe = in_filter(hot[0], a.view(np.int64))
                        for h, p, s, n in zip(a[maybe].view(np.int64).tolist(), place[maybe].tolist(), first[maybe].tolist(), starts[maybe].tolist()):
                            for group, s2, n2, d in _split(raw, h, p, p - length + PIECE, s, n, length, hot):
                                if d == depth:
                                    seen.add((group, xxhash.xxh3_64_intdigest(raw[s2 : s2 + n2 + length - 1], seed=p - s2)))
                    groups, n = np.unique(np.array([g for g, _ in seen], np.int64), return_counts=True)
                    yield frame({"group": (groups, pa.int64()), "n": (n, pa.int64())})

        found = texts.select("text").mapInArrow(run, "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
        counted = written(found.where("n > 1"), "suffix-groups")
        added += counted.agg(F.sum("n")).first()[0] or 0
    return hot, added


def _bytes_at(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Contexts as rows of `width` bytes whose anchors stand below each other, zero where a context has no byte."""
    out = np.zeros((len(starts), width), np.uint8)
    row = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, inside + left[row]] = flat[starts[row] + inside]
    return out


def _repeated(group: np.ndarray, rows: np.ndarray, first: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which strings repeat between the contexts of a group.

    `rows` are aligned contexts, all different within their group; context i has strings at columns first[i] to
    first[i] + starts[i] - 1.  The answer has a column for each start."""
    d, width = rows.shape
    nb = width // BLOCK
    last = first + starts - 1 + length  # the context's end
    # sequences of whole blocks, each context closed by a symbol of its own
    words = rows.reshape(d, nb, BLOCK // 8, 8).view(np.uint64)[..., 0]
    h = np.zeros((d, nb), np.uint64)
    for k in range(BLOCK // 8):
        h = mix(h * ODD + words[:, :, k])
    h = mix(h ^ mix(group)[:, None] ^ mix(np.arange(nb, dtype=np.uint64))[None, :])
    column = np.arange(nb)[None, :]
    whole = (column * BLOCK >= first[:, None]) & ((column + 1) * BLOCK <= last[:, None])
    _, name = np.unique(h[whole], return_inverse=True)
    count = whole.sum(1)
    ends = np.cumsum(count + 1) - 1
    symbols = np.empty(int(ends[-1]) + 1, np.int64)
    place = np.ones(len(symbols), bool)
    place[ends] = False
    symbols[place] = name + d
    symbols[ends] = d - 1 - np.arange(d)  # the last one is the smallest
    at = np.full((d, nb), -1, np.int64)
    at[whole] = np.flatnonzero(place)

    sa = suffix_array(symbols)
    out = np.zeros((d, int(starts.max())), bool)
    sums = np.zeros((d, width + 1), np.uint64)
    powers = np.cumprod(np.append(np.uint64(1), np.full(width - 1, ODD)))
    np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
    #: neighbours in the suffix array that share m symbols are one class
    shared, classes = np.ones(len(sa) - 1, bool), {}
    for m in range(1, length // BLOCK + 1):
        a, b = np.minimum(sa[1:] + m - 1, len(symbols) - 1), np.minimum(sa[:-1] + m - 1, len(symbols) - 1)
        shared &= symbols[a] == symbols[b]
        if m >= (length - BLOCK) // BLOCK:
            name = np.empty(len(sa), np.int64)
            name[sa] = np.cumsum(np.append(False, ~shared))
            many = np.append(shared, False) | np.append(False, shared)
            alone = np.ones(len(sa), bool)
            alone[sa] = ~many
            classes[m] = (name, alone)
    keys, where = [], []
    for delta in range(BLOCK):
        head = BLOCK - delta if delta else 0  # odd bytes before the first whole block
        m, tail = (length - head) // BLOCK, (length - head) % BLOCK
        name, alone = classes[m]
        for j in range(nb):
            o = j * BLOCK + delta
            block = j + (1 if delta else 0)
            if block + m > nb or o + length > width:
                continue
            i = np.flatnonzero((o >= first) & (o < first + starts))
            if not len(i):
                continue
            run = at[i, block]
            i, run = i[~alone[run]], run[~alone[run]]
            if not len(i):
                continue
            odd = mix(sums[i, o + head] - sums[i, o]) ^ mix(sums[i, o + length] - sums[i, o + length - tail] + ODD)
            keys.append(mix(mix(group[i]) ^ mix(name[run].astype(np.uint64) + np.uint64(o * int(ODD) % (1 << 64))) ^ odd))
            where.append(i * width + o)
    if keys:
        _, inverse, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hit = np.concatenate(where)[n[inverse] > 1]
        i, o = hit // width, hit % width
        out[i, o - first[i]] = True
    return out


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    wide = np.zeros((covered.shape[0], covered.shape[1] + 2), np.int8)
    wide[:, 1:-1] = covered
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, first, end - 1


def _shard(f: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the texts of one shard that other places repeat."""
    ready = f[f["context"].isna()]
    out = [ready[["k1", "k2", "start", "stop"]]]
    f = f[f["context"].notna()].reset_index(drop=True)
    if len(f):
        # equal contexts of an anchor repeat as a whole
        same = f.groupby(["anchor", "left", "context"], sort=False)
        f["copy"] = same.ngroup()
        f["copies"] = same["weight"].transform("sum")
        whole = f[f["copies"] > 1]
        out.append(whole.assign(stop=whole["start"] + whole["context"].map(len))[["k1", "k2", "start", "stop"]])
        one = f.drop_duplicates("copy")
        # contexts are the whole of their groups, so groups are worked on in turn, in bounded blocks
        n = one.groupby("anchor")["copy"].transform("size")
        one = one[n > 1].sort_values("anchor", kind="stable").reset_index(drop=True)
        width = 2 * -(-length // BLOCK) * BLOCK
        zero = width // 2
        sizes = one.groupby("anchor", sort=False).size().to_numpy()
        block_of = np.repeat(np.cumsum(sizes) // 3000, sizes)
        single = f[f["copies"] == 1].drop_duplicates("copy").set_index("copy")
        for _, g in one.groupby(block_of):
            context = g["context"].tolist()
            lengths = np.array(list(map(len, context)))
            flat = np.frombuffer(b"".join(context), np.uint8)
            first = zero - g["left"].to_numpy(dtype=np.int64)
            rows = _bytes_at(flat, np.cumsum(lengths) - lengths, lengths, first, width)
            hit = _repeated(g["anchor"].to_numpy().view(np.uint64), rows, first, lengths - length + 1, length)
            row, a, b = _runs(hit)
            copy = g["copy"].to_numpy()[row]
            mine = np.isin(copy, single.index)
            owner = single.loc[copy[mine]]
            start = owner["start"].to_numpy() + a[mine]
            out.append(pd.DataFrame({"k1": owner["k1"].to_numpy(), "k2": owner["k2"].to_numpy(), "start": start, "stop": owner["start"].to_numpy() + b[mine] + length}))
    return pd.concat(out).drop_duplicates().astype("int64")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(k1, k2, start, stop): byte spans of each different text, named by 128 bits of hash, that are covered by
    strings of `length` bytes which also start anywhere else."""
    spark = docs.sparkSession
    texts = docs.select("text").where(F.octet_length("text") >= length)
    often = _repeated_anchors(texts, length)
    hot_groups, added = _hot_groups(texts, length, often)
    bits = spark.sparkContext.broadcast((bit_filter(often, "anchor"), hot_groups))  # of fixed size
    slim = texts.select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = bits.value
        for batch in batches:
            for part in segments(batch):
                seen: dict[tuple, list] = {}
                for k1, k2, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    raw = text.encode()
                    a, place, first, starts = anchors(raw, length)
                    maybe = in_filter(repeated, a.view(np.int64))
                    found = zip(a[maybe].view(np.int64).tolist(), place[maybe].tolist(), first[maybe].tolist(), starts[maybe].tolist())
                    for h, p, s, n in found:
                        for group, s, n, _ in _split(raw, h, p, p - length + PIECE, s, n, length, hot):
                            seen.setdefault((group, p - s, raw[s : s + n + length - 1]), []).append((k1, k2, s, s + n + length - 1))
                spans: dict[tuple[int, int], list] = {}
                rows = []
                for (h, left, context), found in seen.items():
                    rows.append((h, left, context, *found[0], len(found)))
                    if len(found) > 1:  # repeated right here
                        for k1, k2, s, e in found:
                            spans.setdefault((k1, k2), []).append((s, e))
                for (k1, k2), own in spans.items():
                    rows += [(a, None, None, k1, k2, a, b, 0) for a, b in merged(own)]
                cols = list(zip(*rows)) or [[]] * 8
                names = ["anchor", "left", "context", "k1", "k2", "start", "stop", "weight"]
                yield frame({n: (list(c), pa.binary() if n == "context" else pa.int64()) for n, c in zip(names, cols)})

    fields = "anchor long, left long, context binary, k1 long, k2 long, start long, stop long, weight long"
    shards = max(1, -(-((often.agg(F.sum("n")).first()[0] or 0) + added) // SHARD))
    sent = slim.mapInArrow(run, fields).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = sent.groupBy("shard").applyInPandas(lambda f: _shard(f, length), "k1 long, k2 long, start long, stop long")
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): each row's text as UTF-8 bytes, the maximal removed runs, and the rest.

    Every byte is removed that a `length`-byte string covers which also starts anywhere else, in another row or in the
    same one; overlapping occurrences count, and strings are judged on the input.  Strings never cross rows.

    Null text is empty; texts shorter than `length` keep all bytes; rows with equal texts lose them whole.  Repeated
    rows are copies of each other and each keep their row.  Other columns of `docs` are ignored.  Blocks, odd bytes
    and texts are compared by 64 to 128 bits of hash.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    # a text's spans are bounded by its own length: distinct first, then one array
    spans = repeated_spans(docs, length).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    both = base.join(spans, ["k1", "k2"], "left").select(F.col("doc_id").cast("long"), "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in segments(batch):
                sizes, removed, kept = [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    raw = text.encode()
                    runs = merged([(s["start"], s["stop"]) for s in own or ()])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    sizes.append(len(raw))
                    removed.append([{"start": a, "stop": b} for a, b in runs])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                run_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield frame({"doc_id": (part.column("doc_id"), None), "n_bytes": (sizes, pa.int64()), "removed": (removed, run_type), "kept": (kept, pa.binary())})

    return both.mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
