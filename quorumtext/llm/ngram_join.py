"""N-gram Jaccard join with prefix filters under several global token orders.

Documents are sets of distinct word shingles.  Two sets of similarity t or more share, under any order of all tokens, k
tokens among the first |x| - ceil(t |x|) + k of either.  A pair must pass that filter under every order before its
similarity is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments
from quorumtext.llm.common import bit_filter, in_filter, small, written
from quorumtext.llm.graph import components
from quorumtext.llm.shingles import Hasher, distinct, mix

#: Tokens a task counts at a time when it looks for frequent ones.
WINDOW = 2_000_000
#: Frequent tokens kept for the orders.  Any order is right, so this bounds only the broadcast.
MOST_FREQUENT = 500_000
#: Buckets of more sets than this are linked through pivots; what that leaves open is compared in blocks.
LARGE = 8
#: Sets of a block, on either side, when the rest of a large bucket is compared.
BLOCK = 1500
PAIR, MEMBER, SALTS = 0, 1, 16
#: Prefix tokens of a shard.
SHARD = 1_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of tokens."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def spare(size):
    """Tokens by which prefixes are longer than they must be for one common token.  Prefixes of similar sets then
    share so many: at least the smaller `spare` of the two."""
    return size // 20 + 1


def prefix(tokens: np.ndarray, rare: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The first tokens of a set under an order: rare before frequent, then by a hash of the order's own."""
    n = len(tokens)
    take = n - -(-percent * n // 100) + spare(n)
    if take >= n:
        return tokens
    rank = (tokens ^ np.uint64((order + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xA0761D6478BD642F)
    rank ^= rank >> np.uint64(32)
    rank = rank >> np.uint64(1) | (~rare).astype(np.uint64) << np.uint64(63)
    return tokens[np.argpartition(rank, take - 1)[:take]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int(_among(b, a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: (doc_id, size, f1, f2) of every row.  kind 1: (token, count) of tokens that repeat within a window of a
    task's documents, equal sets counted once; their sums show the frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, waiting = Hasher(), set(), 0, []

        def repeated() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(waiting), return_counts=True)
            token, count = token[count > 1], count[count > 1]
            none = pa.nulls(len(token), pa.int64())
            return frame({"kind": (np.ones(len(token), np.int32), pa.int32()), "id": (none, None), "size": (count, pa.int64()), "f1": (_signed(token), pa.int64()), "f2": (none, None)})

        for batch in batches:
            for part in segments(batch):
                sizes, f1, f2 = [], [], []
                for tokens in map(distinct, hasher.shingles(part.column("text").to_pylist(), n)):
                    a, b = fingerprint(tokens)
                    sizes.append(len(tokens))
                    f1.append(a)
                    f2.append(b)
                    if a not in seen and len(tokens):
                        seen.add(a)
                        waiting.append(tokens)
                        held += len(tokens)
                kind = np.zeros(part.num_rows, np.int32)
                yield frame({"kind": (kind, pa.int32()), "id": (part.column("doc_id"), None), "size": (sizes, pa.int64()), "f1": (f1, pa.int64()), "f2": (f2, pa.int64())})
                if held > WINDOW:
                    yield repeated()
                    seen, held, waiting = set(), 0, []
        if waiting:
            yield repeated()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, id long, size long, f1 long, f2 long")


def _tokens(f: pd.DataFrame) -> np.ndarray:
    """48 bits of each token: two tokens that agree on them only meet in vain."""
    low = np.concatenate([np.frombuffer(b, np.uint32) for b in f["low"]]).astype(np.uint64)
    return low | np.concatenate([np.frombuffer(b, np.uint16) for b in f["high"]]).astype(np.uint64) << np.uint64(32)


def _buckets(f: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of one shard: PAIR rows (a, b, common tokens, tokens needed) of small buckets, MEMBER rows (token, node, 1, tokens
    needed at least) of large ones."""
    tables = [np.frombuffer(b, np.int64) for b in f["nodes"]]
    sizes = np.concatenate([np.frombuffer(b, np.int32) for b in f["sizes"]])
    nodes, first, inverse = np.unique(np.concatenate(tables), return_index=True, return_inverse=True)
    sizes = sizes[first].astype(np.int64)
    starts = np.cumsum([0, *map(len, tables)])
    place = np.concatenate([np.frombuffer(b, np.uint16).astype(np.int64) + a for b, a in zip(f["places"], starts)])
    token, node = _tokens(f), inverse[place]
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    keep = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
    token, node = token[keep], node[keep]
    cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    count = np.diff(np.append(cuts, len(token)))
    wide = np.int64(len(nodes))
    pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
    for c in range(2, LARGE + 1):
        members = node[cuts[count == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        for some in np.array_split(members, max(1, len(members) * len(i) // 2_000_000)):  # bounded memory
            a, b = some[:, i].ravel(), some[:, j].ravel()
            fits = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
            key, n = np.unique(a[fits] * wide + b[fits], return_counts=True)
            pairs, back = np.unique(np.append(pairs, key), return_inverse=True)
            times = np.bincount(back, weights=np.append(times, n), minlength=len(pairs)).astype(np.int64)
    a, b = pairs // wide, pairs % wide
    few = pd.DataFrame({"kind": np.full(len(a), PAIR), "a": nodes[a], "b": nodes[b], "common": times, "need": spare(np.minimum(sizes[a], sizes[b]))})
    crowded = np.repeat(count > LARGE, count)
    token, node = token[crowded], node[crowded]
    large = pd.DataFrame({"kind": np.full(len(node), MEMBER), "a": _signed(token), "b": nodes[node], "common": 1, "need": spare(percent * sizes[node] // 100)})
    return pd.concat([few, large]).astype("int64")


def candidates(docs: DataFrame, n: int, percent: int, orders: int, frequent, shards: int) -> DataFrame:
    """(ord, kind, a, b, common, need): sets that share prefix tokens, under each of the orders (see `_buckets`)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hasher, seen = frequent.value, Hasher(), set()
        for batch in batches:
            for part in segments(batch):
                parts, nodes, sizes = [], [], []
                for own in map(distinct, hasher.shingles(part.column("text").to_pylist(), n)):
                    if len(own):
                        key = fingerprint(own)[0]
                        if key not in seen:
                            if len(seen) > 1_000_000:
                                seen.clear()  # equal sets sent twice cost only their rows
                            seen.add(key)
                            rare = ~_among(common, own)
                            parts.append([prefix(own, rare, percent, k) for k in range(orders)])
                            nodes.append(key)
                            sizes.append(len(own))
                for k in range(orders if nodes else 0):
                    length = [len(p[k]) for p in parts]
                    token = np.concatenate([p[k] for p in parts])
                    doc = np.repeat(np.arange(len(nodes)), length)
                    shard = (mix(token) % np.uint64(shards)).astype(np.int32)
                    by = np.argsort(shard, kind="stable")
                    token, doc, shard = token[by], doc[by], shard[by]
                    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
                    packs: dict[str, list] = {"low": [], "high": [], "places": [], "nodes": [], "sizes": []}
                    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                        own, places = np.unique(doc[a:b], return_inverse=True)
                        packs["low"].append(token[a:b].astype(np.uint32).tobytes())
                        packs["high"].append((token[a:b] >> np.uint64(32)).astype(np.uint16).tobytes())
                        packs["places"].append(places.astype(np.uint16).tobytes())
                        packs["nodes"].append(np.array(nodes, np.int64)[own].tobytes())
                        packs["sizes"].append(np.array(sizes, np.int32)[own].tobytes())
                    columns = {"ord": ([k] * len(cuts), pa.int32()), "shard": (shard[cuts], pa.int32())}
                    yield frame(columns | {name: (v, pa.binary()) for name, v in packs.items()})

    sent = docs.select("text").mapInArrow(emit, "ord int, shard int, low binary, high binary, places binary, nodes binary, sizes binary")
    return sent.groupBy("ord", "shard").applyInPandas(lambda f: _buckets(f, percent).assign(ord=f["ord"].iloc[0]), "ord int, kind int, a long, b long, common long, need long")


def _compare(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b) links between a block of sets and another block of the same bucket; one link for each two components."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    if len(left) and len(right):
        sets = [np.frombuffer(b, np.uint64) for b in right["tokens"]]
        size = np.array([len(s) for s in sets])
        token, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        by = np.argsort(at, kind="stable")
        owner, starts = owner[by], np.searchsorted(at[by], np.arange(len(token) + 1))
        nodes, comps = right["node"].to_numpy(), right["component"].to_numpy()
        for node, comp, blob in zip(left["node"], left["component"], left["tokens"]):
            own = np.frombuffer(blob, np.uint64)
            k = np.searchsorted(token, own)
            k[k == len(token)] = 0
            k = k[token[k] == own]
            both = np.bincount(np.concatenate([owner[starts[i] : starts[i + 1]] for i in k]), minlength=len(sets)) if len(k) else np.zeros(len(sets), int)
            hits = np.flatnonzero((100 * both >= percent * (size + len(own) - both)) & (comps != comp))
            for h in hits.tolist():
                found.setdefault((comp, comps[h]), (node, nodes[h]))
    return pd.DataFrame(list(found.values()), columns=["a", "b"]).astype("int64")


def _between(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose sides are not in one component."""
    x = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y)], dtype=bool)

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    return both.where(similar("x", "y")).select("a", "b")


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 80, orders: int = 2, min_frequent: int = 48) -> DataFrame:
    """(doc_id, n_shingles, component_id): every row with the size of its set of distinct `n`-word shingles, and the
    smallest doc_id that links reach from it, its own included.

    Rows link when 100 * intersection >= `percent` * union.  Words are lower-cased (A-Z) and split at ASCII white
    space; a text of fewer words is one shingle; null, empty or blank texts have an empty set, link with nothing and
    keep their own id.  Equal sets are one node (128-bit fingerprints), so copies meet nowhere.  Rows without doc_id
    take part; their component_id is that of the smallest id linked with them, or null.  Repeated rows each keep
    their row.  Other columns of `docs` are ignored.

    Frequent tokens come last in every order, so a passage that many documents share puts its tokens in few prefixes.
    Buckets of at most LARGE sets give their pairs; a pair that fails the filter of any order is dropped.  A larger
    bucket gives only links to its pivot, and only for sets that can have all they need in large buckets.  The pair of
    each set that has most in common is verified first, then those that still lie between two components.  Sets that
    large buckets join, and that verified links don't connect, are compared with the rest of their group in blocks,
    without a row for each pair.  Inside one component no further test is needed, so no link between components is lost.
    """
    spark = docs.sparkSession
    found = written(shingle_sets(docs, n), "join-sets")
    often = found.where("kind = 1").groupBy(F.col("f1").alias("token")).agg(F.sum("size").alias("c")).where(F.col("c") >= min_frequent)
    often = often.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"]
    frequent = spark.sparkContext.broadcast(np.sort(_unsigned(often.to_numpy())))  # at most MOST_FREQUENT numbers

    sets = found.where("kind = 0").select(F.col("id").alias("doc_id"), "size", "f1", "f2")
    total = sets.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total * (125 - percent) // 100 // SHARD))
    met = written(candidates(docs, n, percent, orders, frequent, shards), "join-met")
    # under each order a pair must share as many prefix tokens as are needed; those in large buckets are not counted by
    # pair, so each side's number of them bounds what may be missing
    under = lambda c, k: F.coalesce(F.sum(F.when(F.col("ord") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    pairs = met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.max("need").alias("need"), *[under("common", k) for k in range(orders)])
    members = met.where(F.col("kind") == MEMBER)
    crowd = members.groupBy("b").agg(F.max("need").alias("need"), *[under("common", k) for k in range(orders)])
    crowd = written(crowd.withColumnRenamed("b", "node"), "join-crowd")
    side = lambda c: crowd.select(F.col("node").alias(c), *[F.col(f"common{k}").alias(f"{c}{k}") for k in range(orders)])
    enough = lambda missing: reduce(and_, [F.col(f"common{k}") + missing(k) >= F.col("need") for k in range(orders)])
    sure = pairs.where(enough(lambda k: F.lit(0)))
    rest = pairs.where(~enough(lambda k: F.lit(0))).join(side("a"), "a").join(side("b"), "b")
    rest = rest.where(enough(lambda k: F.least(f"a{k}", f"b{k}")))
    common = reduce(lambda x, y: x + y, [F.col(f"common{k}") for k in range(orders)]).alias("common")
    pairs = written(sure.select("a", "b", common).unionByName(rest.select("a", "b", common)), "join-pairs")
    # large buckets, of sets that can have all they need there: each member and the smallest one
    able = crowd.where(enough(lambda k: F.lit(0))).select(F.col("node").alias("b"))
    members = members.where(F.col("ord") == 0).select(F.col("a").alias("token"), "b").join(able, "b")
    pivots = members.groupBy("token").agg(F.min("b").alias("a"))
    stars = members.join(pivots, "token").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    stars = written(stars, "join-stars")

    # the sets of the nodes that are left, packed; one row a node
    nodes = pairs.select("a", "b").unionByName(stars.select("a", "b")).select(F.explode(F.array("a", "b")).alias("f1")).distinct()
    chosen = sets.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")).join(nodes, "f1")
    packed = written(_packed(docs, chosen, n), "join-packed")

    # first the pair of each node that has most in common, then those that still lie between two components
    best = pairs.unionByName(stars).withColumn("node", F.explode(F.array("a", "b"))).groupBy("node")
    best = best.agg(F.max_by(F.struct("a", "b"), F.struct("common", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = written(_verified(best, packed, percent), "join-links")
    joined = components(links)
    left = _between(pairs.select("a", "b"), joined).join(best, ["a", "b"], "left_anti")
    left = written(left, "join-left")
    wanted = small(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = links.unionByName(written(_verified(left, packed.join(wanted, "node", "left_semi"), percent), "join-links"))

    joined = components(links)
    group = components(stars).select("node", F.col("component").alias("bucket"))
    mine = group.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mine = written(mine, "join-groups")
    counts = mine.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("m"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    main = main.where("k > 1").select("bucket", F.col("m.main").alias("main"), F.col("total"), (F.col("total") - F.col("m.n")).alias("rest"))
    open_ = mine.join(main, "bucket")
    wanted = small(open_.select("node"))
    open_ = written(open_.join(packed.join(wanted, "node", "left_semi"), "node"), "join-open")
    rights = F.ceil(F.col("total") / BLOCK).cast("int")
    lefts = F.ceil(F.col("rest") / BLOCK).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    right = open_.select("bucket", "node", "component", "tokens", F.pmod(F.xxhash64("node"), rights).cast("int").alias("r"), every(lefts).alias("l"))
    own = [F.col(c).alias(c) for c in ("bucket", "node", "component", "tokens")]
    left = open_.where("component <> main").select(*own, F.pmod(F.xxhash64("node"), lefts).cast("int").alias("l"), every(rights).alias("r"))
    more = left.groupBy("bucket", "l", "r").cogroup(right.groupBy("bucket", "l", "r")).applyInPandas(lambda x, y: _compare(x, y, percent), "a long, b long")
    more = written(more, "join-more")

    graph = components(links.unionByName(more))
    # copies of one set, or one large component, may be a third of all rows: they are dealt over SALTS tasks, and only
    # what differs from a row's own name is looked up
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    moved = graph.where("node <> component").select(F.col("node").alias("f1"), "component", every)
    named = sets.select("doc_id", "size", "f1", salt).join(moved, ["f1", "salt"], "left")
    named = named.select("doc_id", "size", "salt", F.coalesce("component", "f1").alias("root"))
    ids = named.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    shared = ids.where("n > 1").select("root", F.col("component_id").alias("least"), F.lit(True).alias("many"), every)
    out = named.join(shared, ["root", "salt"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when((F.col("size") > 0) & F.col("many"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _packed(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """(node, tokens) of the chosen rows: the documents are read again past a filter of fixed size.  What it lets through
    by chance is another node, or the same one once more; neither changes what the joins find."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen.select(F.col("f1").bitwiseXOR(F.coalesce("doc_id", F.lit(0))).alias("key")), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            for part in segments(batch):
                ids, nodes, sets = [], [], []
                for i, own in zip(part.column("doc_id").to_pylist(), map(distinct, hasher.shingles(part.column("text").to_pylist(), n))):
                    f1 = fingerprint(own)[0]
                    if (i, f1) not in seen and in_filter(bits.value, np.array([f1 ^ (i or 0)]))[0]:
                        seen.add((i, f1))
                        ids.append(i)
                        nodes.append(f1)
                        sets.append(own.tobytes())
                if ids:
                    yield frame({"doc_id": (ids, pa.int64()), "node": (nodes, pa.int64()), "tokens": (sets, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, node long, tokens binary")
