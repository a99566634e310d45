"""Registered queries: prescription safety and word joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.functions import rx as R
from quorumtext.functions import text as X
from quorumtext.operators import fuzzy, review, safety
from quorumtext.plans import inputs as I
from quorumtext.plans import oracle as O
from quorumtext.plans.catalog import query
from quorumtext.plans.text_queries import RX_SQL, PER_DAY_SQL, pick, rx_cells

# A small made-up formulary; real ones come from the user.
DRUGS = [("alfazine", "mg", [20.0, 40.0], 80.0), ("betadine-x", "mcg", [25.0, 50.0], 300.0), ("gammaprol", "mg", [20.0], None)]
ALIASES = [("alfa", "alfazine"), ("beta", "betadine-x")]


def formulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRUGS, "name string, unit string, strengths array<double>, max_day double")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, canonical string")


FORMULARY_SQL = """drugs AS (SELECT * FROM (VALUES ('alfazine', 'mg', [20.0, 40.0], 80.0), ('betadine-x', 'mcg', [25.0, 50.0], 300.0), ('gammaprol', 'mg', [20.0], NULL)) t(name, unit, strengths, max_day)),
aliases AS (SELECT * FROM (VALUES ('alfa', 'alfazine'), ('beta', 'betadine-x')) t(alias, canonical))"""


@query(
    "dose_warnings",
    rf"""WITH {RX_SQL}, {FORMULARY_SQL}, g AS (SELECT drug, strength, frequency, count(*) AS n, replace(lower(frequency), '½', '0.5') AS f,
       CASE WHEN regexp_matches(strength, '\d+\s*(mcg|ug|mg|gm|g)?\b') THEN strength ELSE drug END AS cell,
       CASE drug WHEN 'Tab. Alfa' THEN 'alfazine' WHEN 'betadine-x' THEN 'betadine-x' WHEN 'Cap GAMMAPROL' THEN 'gammaprol' WHEN 'alfazin 650' THEN 'alfazine' END AS canonical FROM rx GROUP BY ALL),
    p AS (SELECT g.*, d.unit AS ref, d.strengths, d.max_day, try_cast(regexp_extract(cell, '(\d+(?:\.\d+)?)\s*(mcg|ug|mg|gm|g)?\b', 1) AS DOUBLE) AS v,
       nullif(regexp_extract(cell, '(\d+(?:\.\d+)?)\s*(mcg|ug|mg|gm|g)?\b', 2), '') AS u, {PER_DAY_SQL} AS pd FROM g LEFT JOIN drugs d ON d.name = g.canonical),
    q AS (SELECT *, v * (CASE WHEN coalesce(u, ref) IN ('g', 'gm') THEN 1000.0 WHEN coalesce(u, ref) IN ('mcg', 'ug') THEN 0.001 ELSE 1.0 END) / (CASE WHEN ref = 'mcg' THEN 0.001 ELSE 1.0 END) AS amt,
       coalesce(u IN ('g', 'gm') AND v >= 5, false) AS imp FROM p)
    SELECT drug, strength, frequency, n, coalesce(canonical, '') AS canonical, concat_ws(',',
       CASE WHEN regexp_matches(frequency, '\d+\s*-\s*\d+\s*-\s*\d+') AND regexp_matches(frequency, '\b([5-9]|\d\d+)\b') THEN 'odd frequency' END, CASE WHEN imp THEN 'impossible' END,
       CASE WHEN canonical IS NOT NULL AND v IS NOT NULL AND NOT imp AND len(list_filter(strengths, lambda s: abs(amt - s) < 1e-6)) = 0 THEN 'unusual strength' END,
       CASE WHEN canonical IS NOT NULL AND v IS NOT NULL AND NOT imp AND pd > 0 AND amt * pd > max_day * 1.001 THEN 'above maximum' END) AS warnings FROM q""",
)
def dose_warnings(spark: SparkSession, sf: str) -> DataFrame:
    g = rx_cells(spark, sf).groupBy("drug", "strength", "frequency").agg(F.count("*").alias("n"))
    out = safety.check_rows(g.withColumn("flagged", F.lit(False)), formulary(spark), alias_table(spark))
    short = F.transform(
        "warnings",
        lambda w: F.when(w.startswith("Frequency"), "odd frequency").when(w.contains("not possible"), "impossible")
        .when(w.contains("not a usual"), "unusual strength").otherwise("above maximum"),
    )
    return out.select("drug", "strength", "frequency", "n", F.coalesce("canonical", F.lit("")).alias("canonical"), F.array_join(short, ",").alias("warnings"))


@query(
    "extract_rows",
    rf"""WITH {RX_SQL}, l AS (SELECT page_id, row, drug || ' ' || strength || ' ' || frequency || ' x ' || row || ' days' AS line FROM rx),
    f AS (SELECT page_id, row, line, regexp_extract(line, '(?i)^\s*(tab|cap)\b\.?', 1) AS form, regexp_replace(line, '(?i)^\s*(tab|cap)\b\.?', '') AS rest FROM l WHERE regexp_matches(line, '(?i)^\s*(tab|cap)\b'))
    SELECT form, regexp_extract(rest, '^\s*([A-Za-z][A-Za-z-]*)', 1) AS drug, regexp_extract(rest, '(?i)(\d+(?:\.\d+)?\s*(?:mcg|ug|mg|gm|g))\b', 1) AS strength,
      regexp_extract(rest, '(?i)(\d+-\d+-\d+|½-0-½|\b(?:od|tds|sos|twice daily)\b)', 1) AS frequency, regexp_extract(rest, '(?i)\bx\s*(\d+\s*days)\b', 1) AS duration, count(*) AS n FROM f GROUP BY ALL""",
)
def extract_rows(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" ", "drug", "strength", "frequency", F.lit("x"), "row", F.lit("days"))
    pages = rx_cells(spark, sf).select("page_id", line.alias("text"))
    rows = safety.extract_rows(pages)
    return rows.groupBy(*[c for c in safety.FIELDS]).agg(F.count("*").alias("n"))


@query(
    "validate_rows",
    rf"""WITH {RX_SQL}, m AS (SELECT page_id, string_agg(drug || ' ' || CASE WHEN row = 3 THEN '[[' || strength || '?]]' ELSE strength END, chr(10) ORDER BY row, drug, strength) AS marked FROM rx GROUP BY page_id),
    s AS (SELECT page_id, regexp_extract_all(regexp_replace(marked, '\[\[(.*?)\?\]\]', '\1', 'g'), '\d+(?:\.\d+)?') AS src, regexp_extract_all(marked, '\[\[(.*?)\?\]\]', 1) AS spans FROM m),
    t AS (SELECT page_id, src, flatten(list_transform(spans, lambda x: regexp_extract_all(x, '\d+(?:\.\d+)?'))) AS fn,
       list_transform(list_filter(flatten(list_transform(spans, lambda x: string_split(x, ' '))), lambda w: w <> '' AND NOT regexp_matches(w, '\d')), lambda w: {O.key('w')}) AS fw FROM s),
    r AS (SELECT page_id, row, drug, strength, frequency, regexp_extract_all(drug || ' ' || strength || ' ' || frequency, '\d+(?:\.\d+)?') AS nums,
       list_transform(list_filter(string_split(drug || ' ' || strength || ' ' || frequency, ' '), lambda w: w <> ''), lambda w: {O.key('w')}) AS keys FROM rx)
    SELECT r.page_id, len(list_filter(nums, lambda x: list_contains(fn, x) OR NOT list_contains(src, x))) > 0 OR len(list_filter(keys, lambda x: list_contains(fw, x))) > 0 AS flagged, count(*) AS n
    FROM r JOIN t USING (page_id) GROUP BY ALL""",
)
def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = rx_cells(spark, sf)
    shown = F.concat(F.col("drug"), F.lit(" "), F.when(F.col("row") == 3, F.concat(F.lit("[["), F.col("strength"), F.lit("?]]"))).otherwise(F.col("strength")))
    marked = cells.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("row", "drug", "strength", shown.alias("s")))).alias("l"))
    pages = marked.select("page_id", F.array_join("l.s", "\n").alias("marked"))
    rows = cells.withColumn("form", F.lit("")).withColumn("duration", F.lit(""))
    out = safety.validate_rows(rows, pages)
    return out.groupBy("page_id", "flagged").agg(F.count("*").alias("n"))


# Look-alike groups from the parts table: names that share their last word.
def part_groups(spark: SparkSession, sf: str) -> DataFrame:
    p = I.table(spark, sf, "part")
    return p.select(F.element_at(F.split("p_name", " "), -1).alias("group_id"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("name")).distinct()


@query(
    "lasa_groups",
    """WITH g AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS group_id, replace(p_name, ' ', '-') AS name FROM part)
    SELECT a.name, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS alike FROM g a JOIN g b ON a.group_id = b.group_id AND a.name <> b.name GROUP BY a.name""",
)
def lasa_groups(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.expand_groups(part_groups(spark, sf)).select("name", F.array_join("alike", ",").alias("alike"))


@query("lookalike_table")
def lookalike_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every name with all it could be mistaken for: mates of its group, and close spellings of another medicine."""
    lex = fuzzy.lexicon(I.lexicon_words(spark, sf)).select(F.col("key").alias("group_id"), F.col("key").alias("name"))
    alike = safety.build_lookalikes(formulary(spark), alias_table(spark), part_groups(spark, sf).unionByName(lex))
    return alike.select("name", F.array_join("alike", ",").alias("alike"))


@query("spelling_pairs")
def spelling_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words read as drug names: pairs that look alike."""
    names = fuzzy.lexicon(I.lexicon_words(spark, sf)).select(F.col("key").alias("name"))
    return safety.spelling_pairs(names, alias_table(spark))


@query(
    "lookalike_flags",
    f"""WITH {O.VOTED}, {O.LEX}, g AS (SELECT key AS name, array_to_string(list_sort(list_distinct(string_split(key, ''))), '') AS gid FROM lex WHERE regexp_matches(key, '^[a-z]+$')),
    al AS (SELECT a.name, string_agg(DISTINCT b.name, ',' ORDER BY b.name) AS alike FROM g a JOIN g b ON a.gid = b.gid AND a.name <> b.name WHERE length(a.name) >= 4 GROUP BY a.name)
    SELECT v.page_id, v.idx, v.text, al.alike FROM voted v JOIN al ON al.name = trim(regexp_replace(lower(v.text), '[^a-z-]', '', 'g'), '-') WHERE v.text <> chr(10) AND idx % 13 <> 1""",
)
def lookalike_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Names made of the same letters are a group; only names that stand on a page are looked up."""
    lex = fuzzy.lexicon(I.lexicon_words(spark, sf)).where(F.col("key").rlike("^[a-z]+$"))
    letters = F.array_join(F.sort_array(F.array_distinct(F.filter(F.split("key", ""), lambda c: c != ""))), "")
    groups = lex.select(letters.alias("group_id"), F.col("key").alias("name"))
    words = I.voted(spark, sf).withColumn("resolved_by", F.when(F.col("idx") % 13 == 1, "human"))
    alike = fuzzy.expand_groups(groups, safety.page_names(words)).where(F.length("name") >= 4)
    out = safety.lasa_flags(words, alike).where("lookalikes is not null")
    return out.select("page_id", "idx", "text", F.array_join("lookalikes", ",").alias("alike"))


@query(
    "resolve_drug",
    rf"""WITH {RX_SQL}, {FORMULARY_SQL}, k AS (SELECT drug, trim(regexp_replace(lower(regexp_replace(drug, '^(Tab\.|Cap) ', '')), '[^a-z\-]', '', 'g'), '-') AS key, count(*) AS n FROM rx GROUP BY ALL)
    SELECT k.drug, k.n, d.name AS canonical FROM k LEFT JOIN aliases a ON a.alias = k.key LEFT JOIN drugs d ON d.name = coalesce(a.canonical, k.key)""",
)
def resolve_drug(spark: SparkSession, sf: str) -> DataFrame:
    g = rx_cells(spark, sf).groupBy("drug").agg(F.count("*").alias("n"))
    names = g.withColumn("name", F.regexp_replace("drug", r"^(Tab\.|Cap) ", ""))
    return fuzzy.resolve(names, alias_table(spark), formulary(spark)).select("drug", "n", "canonical")


@query(
    "lexicon_hits",
    f"""WITH {O.TOK}, {O.LEX} SELECT page_id, count(*) AS hits FROM tok WHERE {O.key('tok')} IN (SELECT key FROM drugkeys) AND tok <> chr(10) GROUP BY page_id""",
)
def lexicon_hits(spark: SparkSession, sf: str) -> DataFrame:
    toks = I.documents(spark, sf, "text").select(F.col("doc_id").alias("page_id"), F.explode(X.tokens(F.col("text"))).alias("tok"))
    words = toks.where(F.col("tok") != X.NEWLINE).withColumn("key", X.key(F.col("tok")))
    return fuzzy.lexicon_hits(words, I.lexicon_words(spark, sf)).groupBy("page_id").agg(F.count("*").alias("hits"))


@query(
    "route_kind",
    rf"""WITH {RX_SQL}, {O.LEX}, t AS (SELECT page_id, string_agg(drug || ' ' || strength || ' ' || frequency, ' ' ORDER BY row, drug, strength, frequency) AS text FROM rx GROUP BY page_id),
    h AS (SELECT page_id, len(regexp_extract_all(text, '(?i)\b\d+(\.\d+)?\s*(mg|mcg|ml|g|iu)\b')) + len(regexp_extract_all(text, '(?i)\b[01]\s*-\s*[01]\s*-\s*[01]\b'))
      + len(regexp_extract_all(text, '(?i)\b(rx|tab|tabs|cap|caps|syp|syr|inj|od|bd|bid|tds|tid|qid|sos|hs|stat|x\s*\d+\s*days?)\b')) AS hits FROM t)
    SELECT page_id, hits, CASE WHEN hits >= 2 THEN 'prescription' ELSE 'note' END AS detected,
      CASE page_id % 5 WHEN 0 THEN 'prescription' WHEN 1 THEN 'note' WHEN 2 THEN 'note' ELSE CASE WHEN hits >= 2 THEN 'prescription' ELSE 'note' END END AS kind FROM h""",
)
def route_kind(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" ", "drug", "strength", "frequency")
    lines = rx_cells(spark, sf).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("row", "drug", "strength", "frequency", line.alias("l")))).alias("w"))
    pages = lines.select("page_id", F.array_join("w.l", " ").alias("text"))
    kind = pick(F.col("page_id") % 5, "prescription", "form", "legal", "auto", "unknown")
    detected = review.detected_kind(F.col("text"), F.lit(0))
    return pages.select(
        "page_id", R.rx_hits(F.col("text")).alias("hits"), detected.alias("detected"), review.route_kind(kind, detected).alias("kind")
    )


@query(
    "near_join",
    f"""WITH {O.TOK}, {O.LEX}, v AS (SELECT DISTINCT {O.key('tok')} AS key FROM tok WHERE tok <> chr(10)), a AS (SELECT key, {O.ascii_letters('key')} AS x FROM v),
    b AS (SELECT key AS entry, {O.ascii_letters('key')} AS y FROM lex)
    SELECT a.key, b.entry, levenshtein(x, y) AS d FROM a JOIN b ON abs(length(x) - length(y)) <= 2 AND levenshtein(x, y) <= CASE WHEN greatest(length(x), length(y)) <= 8 THEN 1 ELSE 2 END""",
)
def near_join(spark: SparkSession, sf: str) -> DataFrame:
    toks = I.documents(spark, sf, "text").select(F.explode(X.tokens(F.col("text"))).alias("tok"))
    keys = toks.where(F.col("tok") != X.NEWLINE).select(X.key(F.col("tok")).alias("key"))
    lex = fuzzy.lexicon(I.lexicon_words(spark, sf)).select(F.col("key").alias("entry"))
    return fuzzy.near_join(keys, lex, "key", "entry")


@query("fuzzy_top")
def fuzzy_top(spark: SparkSession, sf: str) -> DataFrame:
    """Closest three benchmark words of every word of the documents."""
    toks = I.documents(spark, sf, "text").select(F.explode(X.tokens(F.col("text"))).alias("tok"))
    # each spelling gets its key once
    keys = toks.where(F.col("tok") != X.NEWLINE).distinct().select(X.key(F.col("tok")).alias("word"))
    lex = fuzzy.lexicon(I.lexicon_words(spark, sf)).select(F.col("key").alias("entry"))
    return fuzzy.fuzzy_top(keys, lex, 0.7, 3).select("word", "entry", F.round("ratio", 6).alias("ratio"), "rank")


@query(
    "vocabulary",
    f"WITH {O.LEX} SELECT key AS name FROM lex UNION SELECT replace(p_name, ' ', '-') FROM part UNION SELECT 'alfazine' UNION SELECT 'betadine-x' UNION SELECT 'gammaprol' UNION SELECT 'alfa' UNION SELECT 'beta'",
)
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    lex = fuzzy.lexicon(I.lexicon_words(spark, sf)).select(F.col("key").alias("name"))
    groups = part_groups(spark, sf).select("name").union(lex)
    return safety.known_names(formulary(spark), alias_table(spark), groups)
