"""Passage retrieval: chunking, postings, BM25, vector top-k, citations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorumtext.functions import text as X
from quorumtext.session import cut_lineage

# BM25 parameters, hits per query, chunk size.
K1, B, TOP_K, CHUNK_SIZE = 1.5, 0.75, 5, 900


# ---------------------------------------------------------------- chunks

def _cut_long(s: Column, size: int) -> Column:
    """Pieces of at most `size` characters, cut at the last space of the second half where there is one."""
    piece = rf" ?(.{{1,{size}}}$|.{{{size // 2 + 1},{size - 1}}}(?= )|.{{{size}}})"
    return F.when(F.length(s) <= size, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(piece), F.lit(1)))


def pack_sentences(sents: Column, size: int) -> Column:
    start = F.struct(
        F.array().cast("array<struct<a:int,b:int>>").alias("cuts"),
        F.lit(0).alias("a"),
        F.lit(0).alias("i"),
        F.lit(-1).alias("len"),
        F.lit(0).alias("last"),
    )

    def step(acc: Column, n: Column) -> Column:
        full = (acc.len >= 0) & (acc.len + 1 + n > size)
        repeat = acc["last"] < size // 3
        cut = F.struct(acc.a.alias("a"), acc.i.alias("b"))
        return F.struct(
            F.when(full, F.concat(acc.cuts, F.array(cut))).otherwise(acc.cuts).alias("cuts"),
            F.when(full, acc.i - repeat.cast("int")).otherwise(acc.a).alias("a"),
            (acc.i + 1).alias("i"),
            F.when(full & repeat, acc["last"] + 1 + n).when(full, n).otherwise(acc.len + 1 + n).alias("len"),
            n.alias("last"),
        )

    folded = F.aggregate(
        F.transform(sents, F.length),
        start,
        step,
        lambda acc: F.concat(acc.cuts, F.array(F.struct(acc.a.alias("a"), acc.i.alias("b")))),
    )
    chunks = F.transform(folded, lambda c: F.array_join(F.slice(sents, c.a + 1, c.b - c.a), " "))
    # the closing chunk is dropped when it says exactly what the one before it said
    return F.filter(
        chunks,
        lambda c, i: (c != "") & ~((i > 0) & (i == F.size(chunks) - 1) & (c == F.get(chunks, i - 1))),
    )


def chunk(pages: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """(source, page, text) -> (source, page, chunk_no, text); chunk_no counts within the page."""
    sents = F.flatten(F.transform(X.sentences(F.col("text")), lambda s: _cut_long(s, size)))
    ready = pages.withColumn("sents", F.filter(F.transform(sents, X.strip), lambda s: s != ""))
    packed = ready.withColumn("chunks", pack_sentences(F.col("sents"), size))
    kept = [c for c in pages.columns if c != "text"]
    return packed.select(*kept, F.posexplode_outer("chunks").alias("chunk_no", "text")).where("chunk_no is not null")


def ingest(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replace all chunks of the sources that arrive."""
    return remove(store, chunks.select("source").distinct()).unionByName(chunks, allowMissingColumns=True)


def remove(store: DataFrame, sources: DataFrame) -> DataFrame:
    return store.join(sources, "source", "left_anti")


def doc_list(store: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Chunks per source in upload order."""
    return store.groupBy("source").agg(F.count("*").alias("chunks"), F.min(order).alias("first"))


def label(source: Column, page: Column) -> Column:
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(source, F.lit(", page "), page.cast("string"))).otherwise(source)


# ---------------------------------------------------------------- postings and BM25

def postings(passages: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl) from (chunk_id, text)."""
    toks = passages.select("chunk_id", X.rag_tokens(F.col(text)).alias("t"))
    terms = toks.select("chunk_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return terms.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(passages: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of passages and their average length."""
    dl = F.size(X.rag_tokens(F.col(text)))
    return passages.agg(F.count("*").alias("n"), F.avg(dl).alias("avg_dl"))


def asked_postings(passages: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, asked): (chunk_id, term, tf, dl) of the terms somebody asks for, and (query_id, term).

    The corpus is read and tokenised once; a row with the empty term stands for each passage and carries its length.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.rag_tokens(F.col("text")))).alias("term"))
    toks = passages.select("chunk_id", X.rag_tokens(F.col("text")).alias("t"))
    terms = toks.select("chunk_id", F.size("t").alias("dl"), F.explode(F.concat("t", F.array(F.lit("")))).alias("term"))
    wanted = asked.select("term").distinct().unionByName(queries.sparkSession.createDataFrame([("",)], "term string"))
    counted = terms.join(wanted, "term", "left_semi").groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    return cut_lineage(counted), asked


#: Passages of one block of the index, of which the largest weight of each term is known.
BLOCK = 64


class _Segment:
    """Postings of some passages, by term and then passage, with the largest weight of each term in each block."""

    def __init__(self, chunk: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.chunks, doc = np.unique(chunk, return_inverse=True)
        self.terms, term = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.blocks = -(-len(self.chunks) // BLOCK)
        self.most = np.zeros((len(self.terms), self.blocks))
        np.maximum.at(self.most, (term, doc // BLOCK), weight)

    def scores(self, at: np.ndarray, idf: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage numbers, scores) of the passages of these blocks that hold one of the terms."""
        inside = np.zeros(self.blocks, bool)
        inside[blocks] = True
        docs, parts = [], []
        for t, w in zip(at, idf):
            own = slice(self.starts[t], self.starts[t + 1])
            keep = inside[self.doc[own] // BLOCK]
            docs.append(self.doc[own][keep])
            parts.append(self.weight[own][keep] * w)
        docs = np.concatenate(docs)
        total = np.bincount(docs, np.concatenate(parts), len(self.chunks))
        found = np.flatnonzero(np.bincount(docs, minlength=len(self.chunks)))
        # rounded, so that equal passages tie whatever order their terms were added in
        return found, np.round(total[found], 9)

    def best(self, terms: np.ndarray, idf: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(chunk ids, scores) of the `k` best passages that reach `floor`.  Blocks come by falling bound, a few first
        and then twice as many each time; the k-th score so far lets the rest be skipped."""
        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, idf = at[there], idf[there]
        bound = idf @ self.most[at] if len(at) else np.zeros(self.blocks)
        order, docs, score, step, i = np.argsort(-bound, kind="stable"), np.zeros(0, np.int64), np.zeros(0), 2, 0
        # bounds are sums in another order, and scores are rounded
        while len(at) and i < self.blocks and bound[order[i]] > 0 and bound[order[i]] + 1e-8 >= floor:
            more = order[i : i + step]
            d, s = self.scores(at, idf, more[bound[more] + 1e-8 >= floor])
            docs, score = np.concatenate([docs, d]), np.concatenate([score, s])
            top = np.lexsort((docs, -score))[:k]
            docs, score = docs[top], score[top]
            if len(top) == k:
                floor = max(floor, score[-1])
            i, step = i + step, step * 2
        return self.chunks[docs], score


def bm25_top(
    passages: DataFrame, queries: DataFrame, k: int = TOP_K, k1: float = K1, b: float = B, seed: int = 2000,
    segment: int = 4096, query_block: int = 2000,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best `k` passages of each query, exactly.

    The rarest terms of a query, with about `seed` postings, give partial scores, whose k-th largest no final answer
    falls below.  Postings of asked terms are dealt by hash of their passage to segments of about `segment` passages;
    each is a block-max index: a block of passages is looked at only if the largest weights of the query's terms in
    it could reach the k-th score known so far.  Segments hand on at most `k` rows a query; no pair of query and
    passage is ever a row.  Terms meet by 64 bits of hash.
    """
    post, asked = asked_postings(passages, queries)
    stats = post.where("term = ''").agg(F.count("*"), F.avg("dl")).first()
    n, avg = stats[0], stats[1] or 1.0
    post = post.where("term <> ''")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    known = cut_lineage(asked.join(idf, "term"))
    norm = k1 * (1 - b + b * F.greatest("dl", F.lit(1)) / avg)
    weighed = post.withColumn("w", F.col("tf") * (k1 + 1) / (F.col("tf") + norm))

    rare = Window.partitionBy("query_id").orderBy("df", "term")
    running = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0))
    seeds = known.select("query_id", "term", "idf", running.alias("c"), F.row_number().over(rare).alias("r")).where((F.col("c") <= seed) | (F.col("r") == 1))
    partial = weighed.join(seeds, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))
    floor = top_k(partial, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    segments = max(1, -(-n // segment))
    parts = max(1, -(-queries.count() // query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = weighed.select(own("chunk_id", segments).alias("s"), "chunk_id", F.xxhash64("term").alias("t"), "w").withColumn("q", every(parts))
    packed = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "idf"))).alias("terms"))
    packed = packed.join(floor, "query_id", "left").select(
        own("query_id", parts).alias("q"), "query_id", F.col("terms.t").alias("t"), F.col("terms.idf").alias("idf"), F.coalesce("floor", F.lit(0.0)).alias("floor")
    )
    right = packed.withColumn("s", every(segments))

    def search_segment(posts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if posts.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        index = _Segment(posts["chunk_id"].to_numpy(), posts["t"].to_numpy(), posts["w"].to_numpy())
        hits = [index.best(np.asarray(t), np.asarray(i), f, k) for t, i, f in zip(asked["t"], asked["idf"], asked["floor"])]
        return pd.DataFrame({
            "query_id": np.repeat(asked["query_id"].to_numpy(), [len(h[0]) for h in hits]),
            "chunk_id": np.concatenate([h[0] for h in hits]), "score": np.concatenate([h[1] for h in hits]),
        })

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {passages.schema['chunk_id'].dataType.simpleString()}, score double"
    return top_k(left.groupBy("s", "q").cogroup(right.groupBy("s", "q")).applyInPandas(search_segment, kinds), k)


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best k per query, ties to the earlier chunk.  Spark keeps k rows per query and partition before the
    shuffle, so a query with many hits never reaches one task whole."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("chunk_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pad_with_unscored(hits: DataFrame, passages: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Passages without any query term score 0 and still rank: the earliest of them fill a short list."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("have"), F.collect_list("chunk_id").alias("ids"))
    short = queries.select("query_id").join(found, "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    # a query with fewer than k hits needs at most 2k of the earliest passages
    early = passages.select("chunk_id").orderBy("chunk_id").limit(2 * k).agg(F.sort_array(F.collect_list("chunk_id")).alias("e"))
    known = F.coalesce("ids", F.array().cast("array<bigint>"))
    listed = short.select("query_id", F.coalesce("have", F.lit(0)).cast("int").alias("have"), known.alias("ids"), early.scalar().alias("e"))
    spare = listed.select("query_id", "have", F.array_except("e", "ids").alias("spare"))
    fill = spare.select("query_id", F.posexplode(F.slice("spare", F.lit(1), F.lit(k) - F.col("have"))).alias("i", "chunk_id"), "have")
    return hits.select("query_id", "chunk_id", "score", "rank").unionByName(
        fill.select("query_id", "chunk_id", F.lit(0.0).alias("score"), (F.col("have") + F.col("i") + 1).cast("int").alias("rank"))
    )


def bm25_search(passages: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    hits = bm25_top(passages, queries, k)
    return pad_with_unscored(hits, passages, queries, k)


# ---------------------------------------------------------------- vectors

def unit(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(vec, lambda x: x / norm)


def vector_top(passages: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best `k` dot products of normalised vectors.

    Passages and queries are dealt by hash to blocks of bounded size; each pair of blocks keeps k rows a query, and
    those are merged.  Ties, at nine digits, take the earlier chunk.
    """
    blocks = max(1, -(-passages.count() // block))
    parts = max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    p = passages.select(own("chunk_id", blocks).alias("b"), "chunk_id", unit(F.col("vec").cast("array<double>")).alias("v")).withColumn("q", every(parts))
    q = queries.select(own("query_id", parts).alias("q"), "query_id", unit(F.col("vec").cast("array<double>")).alias("v")).withColumn("b", every(blocks))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        ids = left["chunk_id"].to_numpy()
        score = np.round(np.array(right["v"].tolist()) @ np.array(left["v"].tolist()).T, 9)
        at = [np.lexsort((ids, -s))[:k] for s in score]
        return pd.DataFrame({
            "query_id": np.repeat(right["query_id"].to_numpy(), [len(a) for a in at]), "chunk_id": ids[np.concatenate(at)],
            "score": np.concatenate([s[a] for s, a in zip(score, at)]),
        })

    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {p.schema['chunk_id'].dataType.simpleString()}, score double"
    return top_k(p.groupBy("b", "q").cogroup(q.groupBy("b", "q")).applyInPandas(best, kinds), k)


def search(passages: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Vector ranking when every passage has a vector, else BM25; decided by one cheap aggregate."""
    all_vectors = passages.agg(F.coalesce(F.bool_and(F.col("vec").isNotNull()), F.lit(False)).alias("v")).first()["v"]
    if all_vectors and "vec" in queries.columns:
        return vector_top(passages, queries, k)
    return bm25_search(passages, queries, k)


# ---------------------------------------------------------------- answers

def context_block(hits: DataFrame) -> DataFrame:
    """Numbered passages of a query joined into one block; hits: query_id, rank, source, page, text."""
    line = F.format_string("[%d] (%s) %s", F.col("rank"), label(F.col("source"), F.col("page")), F.col("text"))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(lines.alias("l")).select("query_id", F.array_join("l.line", "\n\n").alias("context"))


def ground(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citation brackets normalised; `cited` = distinct cited ranks that exist, sorted; grounded = any.

    answers: answer_id, query_id, answer, ...; hits: query_id, rank.
    """
    fixed = answers.withColumn("answer", X.fix_citations(F.col("answer")))
    wanted = fixed.select("answer_id", "query_id", F.explode(F.array_distinct(X.cited_numbers(F.col("answer")))).alias("rank"))
    real = wanted.join(hits.select("query_id", "rank"), ["query_id", "rank"])
    cited = real.groupBy("answer_id").agg(F.sort_array(F.collect_set("rank")).alias("cited"))
    return (
        fixed.join(cited, "answer_id", "left")
        .withColumn("cited", F.coalesce("cited", F.array().cast("array<int>")))
        .withColumn("grounded", F.size("cited") > 0)
    )
