"""Conversation prefix trie: which conversations share their first turns, and what sharing them would save.

A turn is known by two 64-bit hashes, a prefix by the xor of its turns' hashes, each hashed again with its place; that
is a running value which Spark can compute over range partitions, so no conversation has to fit into one task.  Equal
conversations become one sequence with a weight.  Prefixes below which many turns lie are upper nodes, kept as rows;
below them each sequence belongs to the shard of its first light prefix, and shards become double-array tries inside
tasks.  What the shards found for their roots is added to the upper nodes by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumtext.llm.common import written

#: Turns below one prefix, and turns a task's bundle of shards is meant to hold.
LIGHT, BUNDLE = 100_000, 200_000
#: Tasks that rows of one hot prefix are dealt to, ids in one piece of a digest's input, turns in one piece of a conversation.
SALTS, PIECE, STRETCH = 16, 4096, 65_536


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("int")


def _within(df: DataFrame, key: list[str], order: list[str], values: list[str], add, name: str) -> DataFrame:
    """Replaces each of `values` by its running aggregate (`F.sum` or `F.bit_xor`) within its `key`, in `order`, with
    this row's.  Keys must not be null.

    Rows are range-partitioned by key and order and written with their range, so reruns keep the boundaries and one
    key may fill many tasks.  Only the last key of a range can go on in the next one: what its earlier ranges hold is
    known from one row a range."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, *order)
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()), name)
    inside = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.struct(*key)
    tails = ranged.groupBy("__part").agg(F.max(last).alias("__last"))
    # one row a range: the last key, and its total in that range
    tails = F.broadcast(tails.select("__part", *[F.col(f"__last.{k}").alias(k) for k in key]))
    totals = ranged.join(tails, ["__part", *key]).groupBy("__part", *key).agg(*[add(v).alias(f"__t_{v}") for v in values])
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ranged.select("__part", *key).distinct().join(F.broadcast(totals.select(*key).distinct()), key, "left_semi")
    held = spans.join(totals, ["__part", *key], "left")
    held = held.select("__part", *key, *[add(f"__t_{v}").over(earlier).alias(f"__e_{v}") for v in values])
    # rows of `held`: the ranges of keys that end a range, at most two keys a range
    both = ranged.join(F.broadcast(held), ["__part", *key], "left")
    join = (lambda a, b: a.bitwiseXOR(b)) if add is F.bit_xor else (lambda a, b: a + b)
    rest = [c for c in df.columns if c not in values]
    return both.select(*rest, *[join(F.coalesce(F.col(f"__e_{v}"), F.lit(0)), add(v).over(inside)).alias(v) for v in values])


def _stretches(df: DataFrame, length: Column) -> DataFrame:
    """A row for every stretch of a conversation of so many turns."""
    return df.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(length / STRETCH))))


def _stretch(place: str) -> Column:
    return F.floor(F.col(place) / STRETCH).alias("stretch")


def _lookup(left: DataFrame, right: DataFrame, on: list[str], spread: str, how: str = "inner") -> DataFrame:
    """Join with a unique right side; rows of a hot key are dealt by `spread` to SALTS tasks."""
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(right, [*on, "__salt"], how).drop("__salt")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, a, b, len, rest) for the turns of the rebuilt conversations, `rest` turns before the last one; and
    (conv_id, length) of all, those without turns too.  Texts end here: a turn goes on as two hashes and a length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), text, role).alias("b"), F.char_length(text).cast("long").alias("len"), F.lit(1).cast("long").alias("pos"),
    )
    turns = written(_within(slim, ["conv_id"], ["turn", "a", "b"], ["pos"], F.sum, "trie-turns").drop("turn"), "trie-placed")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", "own", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(heads, "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("there", F.lit(0))))
    convs = convs.select("conv_id", "base", "own", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "trie-convs")
    first = turns.where("pos <= 5").withColumnRenamed("conv_id", "base")
    shared = convs.join(first, "base").where("pos <= taken").withColumnRenamed("pos", "d")
    own = turns.withColumn("stretch", _stretch("pos")).join(_stretches(convs.where("own > h"), F.col("own")), ["conv_id", "stretch"])
    own = own.where("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", F.col("d").cast("long").alias("d"), "a", "b", "len", (F.col("length") - F.col("d")).alias("rest")]
    return shared.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "length")


def _placed_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "d", "a", "b")


def _digests(ends: DataFrame) -> DataFrame:
    """(pa, pb, ends_sha256): hash of the ids that end at each node.  Ids are numbered inside their node and joined in
    pieces of PIECE; a digest has to read its pieces in order, which a task does as a stream."""
    numbered = _within(ends.select("pa", "pb", "conv_id", F.lit(1).cast("long").alias("k")), ["pa", "pb"], ["conv_id"], ["k"], F.sum, "trie-ends")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = numbered.groupBy("pa", "pb", F.floor((F.col("k") - 1) / PIECE).alias("piece")).agg(joined.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("pa", "pb", "ids"))):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, state.hexdigest())])

    ordered = pieces.repartition("pa", "pb").sortWithinPartitions("pa", "pb", "piece").select("pa", "pb", "ids")
    return ordered.mapInArrow(digest, "pa long, pb long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, s = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=["pa", "pb", "ends_sha256"])


class DoubleArray:
    """A trie in two arrays: the child of state s by symbol c is t = base[s] + c, and check[t] = s says that it exists."""

    def __init__(self, room: int):
        self.base = np.zeros(room, np.int64)
        self.check = np.full(room, -1, np.int64)
        self.check[0] = 0  # the top
        self.free = 1

    def _room(self, last: int) -> None:
        if last >= len(self.check):
            more = max(last + 1 - len(self.check), len(self.check))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add(self, state: int, symbols: np.ndarray) -> None:
        """Children of a state that has none yet: the first place where all of them fall on empty slots."""
        offsets = symbols - symbols[0]
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        slot = self.free
        while True:
            self._room(slot + int(offsets[-1]))
            if self.check[slot] < 0 and (len(symbols) == 1 or (self.check[slot + offsets] < 0).all()):
                break
            slot += 1
        self.base[state] = slot - symbols[0]
        self.check[slot + offsets] = state

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Children of many states at once; -1 where there is none."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def pack(levels: list[tuple[np.ndarray, np.ndarray]], sequences: int) -> DoubleArray:
    """The double array of many sequences; level by level (sequence numbers, symbols)."""
    trie = DoubleArray(sum(len(s) for s, _ in levels) + 2)
    at = np.zeros(sequences, np.int64)
    for who, symbols in levels:
        edges = np.unique(np.stack([at[who], symbols]), axis=1)
        cuts = np.flatnonzero(np.diff(edges[0])) + 1
        groups = np.split(edges[1], cuts)
        parents = edges[0][np.concatenate([[0], cuts])]
        for i in sorted(range(len(groups)), key=lambda i: -len(groups[i])):
            trie.add(int(parents[i]), groups[i])
        at[who] = trie.step(at[who], symbols)
    return trie


NODE = "pa long, pb long, depth long, conv_id long, up_a long, up_b long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct rows of some long columns."""
    return np.unique(np.rec.fromarrays(columns), return_inverse=True)[1]


def _bundle(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the shards of one bundle.  The first symbol of a sequence is its shard, the others are its turns."""
    rows = rows.sort_values(["rep", "d"], kind="stable").reset_index(drop=True)
    level = (rows["d"] - rows["u"]).to_numpy()
    who = np.cumsum(level == 1) - 1
    shard, turn = _dense(rows["root_a"].to_numpy(), rows["root_b"].to_numpy()), _dense(rows["a"].to_numpy(), rows["b"].to_numpy())
    symbol = np.where(level == 1, shard, turn)
    order = np.argsort(level, kind="stable")
    at = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)
    trie = pack([(who[i], symbol[i]) for i in at], int(who[-1]) + 1)
    size = len(trie.check)
    state, now = np.zeros(len(rows), np.int64), np.zeros(int(who[-1]) + 1, np.int64)
    for i in at:
        now[who[i]] = state[i] = trie.step(now[who[i]], symbol[i])
    weight, rep = rows["w"].to_numpy(), rows["rep"].to_numpy()
    n, first = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    np.add.at(n, state, weight)
    np.minimum.at(first, state, rep)
    nodes, row = np.unique(state, return_index=True)
    up = trie.check[nodes]
    children = np.bincount(up, minlength=size)
    leaves = (children == 0).astype(np.int64)
    saved = np.zeros(size, np.int64)
    saved[nodes] = (n[nodes] - 1) * rows["len"].to_numpy()[row]
    for i in reversed(at):  # children before their parents
        here = np.unique(state[i])
        np.add.at(leaves, trie.check[here], leaves[here])
        np.add.at(saved, trie.check[here], saved[here])
    top = up == 0
    pick = lambda c: rows[c].to_numpy()[row]
    none = lambda v, where: pd.Series(v).astype("Int64").mask(where)
    return pd.DataFrame({
        "pa": pick("pa"), "pb": pick("pb"), "depth": pick("d"), "conv_id": first[nodes], "up_a": none(pick("up_a"), ~top), "up_b": none(pick("up_b"), ~top),
        "parent_conv_id": none(first[up], top), "n_convs": n[nodes], "n_children": children[nodes], "n_leaves": leaves[nodes], "saved_tokens": saved[nodes],
    })


def prefix_nodes(conversations: DataFrame, light: int = LIGHT, bundle: int = BUNDLE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns come in order of `turn`, null first, ties by hash of role and text; null role or text is empty; rows that
    repeat are turns of their own; rows without conv_id take no part; other columns are ignored.  An empty table has
    no node, not even the root.  Very long texts count only through their hash and length.

    Heavy prefixes, with more than `light` turns below them, are upper nodes: their aggregates are sums over the
    sequences through them, taken with a map-side combine, so a first turn that a third of the conversations share is
    one row a task.  Everything below is packed in tasks of about `bundle` turns.  Sequences are compared by 128 bits.
    """
    turns, convs = rebuilt(conversations)
    turns = turns.withColumn("pa", _placed_hash(1)).withColumn("pb", _placed_hash(2))
    turns = written(_within(turns, ["conv_id"], ["d"], ["pa", "pb"], F.bit_xor, "trie-prefixes"), "trie-hashed")
    zero = F.lit(0).cast("long")
    empty = convs.where("length = 0").select("conv_id", zero.alias("pa"), zero.alias("pb"), zero.alias("length"))
    ends = turns.where("rest = 0").select("conv_id", "pa", "pb", F.col("d").alias("length")).unionByName(empty)
    reps = ends.groupBy("pa", "pb").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.max("length").alias("length"))
    reps = written(reps.select("rep", "w", "length"), "trie-sequences")

    placed = turns.withColumnRenamed("conv_id", "rep").withColumn("stretch", _stretch("d"))
    rows = placed.join(_stretches(reps, F.col("length")), ["rep", "stretch"]).drop("stretch", "length")
    heavy = rows.groupBy("pa", "pb").agg(F.sum(F.col("rest") + 1).alias("below")).where(F.col("below") > light).select("pa", "pb")
    upper = written(_lookup(rows, heavy, ["pa", "pb"], "rep"), "trie-upper")
    deepest = reps.join(upper.groupBy("rep").agg(F.max("d").alias("u")), "rep", "left").withColumn("u", F.coalesce("u", zero))
    lower = placed.join(_stretches(deepest, F.col("length")), ["rep", "stretch"]).where("d > u").drop("stretch", "length")
    above = [F.col(f"p{c}").bitwiseXOR(_placed_hash(i)).alias(f"up_{c}") for i, c in ((1, "a"), (2, "b"))]
    roots = lower.where("d = u + 1").select("rep", F.col("pa").alias("root_a"), F.col("pb").alias("root_b"), *above)
    lower = lower.join(roots, "rep")
    bundles = max(1, -(-turns.count() // bundle))
    dealt = lower.withColumn("bundle", F.pmod(F.xxhash64("root_a", "root_b"), F.lit(bundles)))
    low = written(dealt.groupBy("bundle").applyInPandas(_bundle, NODE), "trie-nodes")

    # upper nodes: what they hold themselves, what lies below them, the root always among them
    start = reps.select("rep", zero.alias("d"), zero.alias("pa"), zero.alias("pb"), zero.alias("len"), "w", zero.alias("up_a"), zero.alias("up_b"))
    up = upper.select("rep", "d", "pa", "pb", "len", "w", *above).unionByName(start)
    of = up.groupBy("pa", "pb").agg(
        F.sum("w").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("d").alias("depth"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")
    )
    of = written(of, "trie-upper-nodes")
    owned = _lookup(up.drop("up_a", "up_b"), of.select("pa", "pb", F.col("conv_id").alias("owner")), ["pa", "pb"], "rep")
    gain = F.col("w") * F.col("len") - F.when(F.col("rep") == F.col("owner"), F.col("len")).otherwise(zero)
    tops = low.where("up_a is not null")
    values = owned.select("rep", "d", "pa", "pb", gain.alias("saved"), zero.alias("leaves"), F.lit(True).alias("node"))
    found = tops.select(
        F.col("conv_id").alias("rep"), F.col("depth").alias("d"), zero.alias("pa"), zero.alias("pb"),
        F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"), F.lit(False).alias("node"),
    )
    summed = _within(values.unionByName(found).withColumn("back", -F.col("d")), ["rep"], ["back"], ["saved", "leaves"], F.sum, "trie-below")
    summed = summed.where("node").groupBy("pa", "pb").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    born = of.where("depth > 0").select("up_a", "up_b").unionByName(tops.select("up_a", "up_b"))
    born = born.groupBy(F.col("up_a").alias("pa"), F.col("up_b").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    high = of.join(summed, ["pa", "pb"]).join(born, ["pa", "pb"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    high = high.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")))
    # parents of upper nodes and of shard roots are upper nodes
    names = of.select(F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["pa", "pb", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    orphans = high.where("depth > 0").unionByName(tops.drop("parent_conv_id"))
    named = _lookup(orphans, names, ["up_a", "up_b"], "conv_id").select(columns)
    root = high.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns)
    nodes = named.unionByName(root).unionByName(low.where("up_a is null").select(columns))
    nobody = hashlib.sha256(b"").hexdigest()
    out = nodes.join(_digests(ends), ["pa", "pb"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nobody)))
    return out.select(*columns[2:], "ends_sha256")
