"""One thin query per operator, over whole tables, with the production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.llm import decontam, html_text, langid, lines, mih, mixing, ngram_join, prefix_trie, quality, secret_scan
from quorumtext.llm import suffix, token_trie, whitening
from quorumtext.llm.common import LOWER, UPPER, table
from quorumtext.llm.registry import ORACLES, QUERIES, query  # noqa: F401

BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

@query("op1_multi_index_hashing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    vectors = mih.clean_vectors(table(spark, sf, "embeddings"))
    return mih.nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, mih.fit_rotation(vectors))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
             coalesce(sum(3.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
             sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
             (sum(source_size) OVER ())::DOUBLE AS whole
      FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source)),
lev AS (SELECT first((whole - closed) / open_w ORDER BY cap / w, source) FILTER (w * ((whole - closed) / open_w) <= cap) AS level FROM r),
t AS (SELECT source, source_size, least(w * level, cap) AS target FROM r, lev),
o AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(least(budget % source_size - before, size), 0) ELSE 0 END)::BIGINT AS taken
FROM o
"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    base = [r.kind for r in secret_scan.BASE]
    d = secret_scan.scan_secrets(table(spark, sf, "documents"))
    d = d.withColumn("base", secret_scan.of_kinds(F.col("spans"), base))
    counts = [F.size(secret_scan.of_kinds(F.col("base"), [k])).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256")
    return d.select("doc_id", *counts, digest, secret_scan.span_text(F.col("spans")).alias("spans"))


@query("op4_language_mixture")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.learn(langid.training_rows(docs))
    found = langid.infer(docs, model)
    return found.select("doc_id", langid.held_out(found).alias("held_out"), "lang_pred", "score", F.size("shares").alias("n_langs"))


@query("op5_html_text")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf, "pages"))


OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {BLANK_SQL}), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    d = lines.line_dedup(table(spark, sf, "documents"))
    total = F.size("lines").cast("long")
    return d.select(
        "doc_id", total.alias("n_lines"), (total - F.size("kept")).alias("n_dropped"), F.sha2(lines.kept_text(F.col("kept")), 256).alias("kept_sha256")
    )


#: The vocabulary file of op8; another SentencePiece file serves as well.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_token_counts")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return token_trie.token_counts(table(spark, sf, "documents"), token_trie.piece_scores(PIECES))


@query("op9_decontaminate")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP10_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS s
     FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 3, 2))) AS i FROM w WHERE len(a) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
t AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS near FROM n UNION SELECT r.doc_id, t.b FROM r JOIN t ON t.a = r.near),
m AS (SELECT doc_id, min(near) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


@query("op10_ngram_jaccard", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf, "documents"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    d = suffix.remove_repeats(table(spark, sf, "documents"))
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r.stop - r.start)
    spans = F.size("removed").cast("long")
    return d.select("doc_id", "n_bytes", cut.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_quality_rules")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    ratio = quality.fit(docs, quality.trusted_rows(docs, table(spark, sf, "labels")))
    return quality.quality(docs, ratio)


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = whitening.clean_vectors(table(spark, sf, "embeddings"))
    return whitening.whiten(vectors, whitening.fit_spaces(vectors))


@query("op12_prefix_trie")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf, "conversations"))
