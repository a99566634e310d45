"""Registered queries: keyed tables, cache, history, exports, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumtext.functions import labels as L
from quorumtext.functions import text as X
from quorumtext.operators import audit as A
from quorumtext.operators import review as RV
from quorumtext.operators import voting as V
from quorumtext.plans import inputs as I
from quorumtext.plans import oracle as O
from quorumtext.plans.catalog import query
from quorumtext.sources import exports as E
from quorumtext.sources import tables as T


def cache_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a cache: key from user and kind, every seventh value blank."""
    value = F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("props"))
    return I.table(spark, sf, "events").select(
        T.cache_key(F.col("user_id"), F.col("event_type")).alias("key"), value.alias("value"), F.col("ts").alias("created_at"), "user_id", "event_type", "event_id"
    )


CACHE = """ev AS (SELECT substr(sha256('["' || user_id || '","' || event_type || '"]'), 1, 32) AS key, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE props END AS value, ts AS created_at, user_id, event_type, event_id FROM events)"""


@query(
    "cache_hits",
    f"""WITH {CACHE}, c AS (SELECT key, arg_max(value, created_at) AS value FROM ev WHERE trim(value) <> '' AND event_id % 2 = 0 GROUP BY key), r AS (SELECT DISTINCT key FROM ev)
    SELECT r.key, c.value, c.value IS NOT NULL AS hit FROM r LEFT JOIN c USING (key)""",
)
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = cache_rows(spark, sf)
    return T.cache_hits(rows.select("key").distinct(), rows.where("event_id % 2 = 0"))


@query("upsert_latest", f"WITH {CACHE} SELECT key, arg_max(value, created_at) AS value, epoch_us(max(created_at)) AS created_us FROM ev GROUP BY key")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = cache_rows(spark, sf).select("key", "value", "created_at", "event_id")
    half = F.col("event_id") % 2 == 0
    done = T.upsert(rows.where(half).drop("event_id"), rows.where(~half).drop("event_id"), ["key"])
    return done.select("key", "value", F.unix_micros("created_at").alias("created_us"))


ANSWERS = """an AS (SELECT CASE WHEN user_id % 50 = 0 THEN '__' ELSE 'Writer ' || user_id % 20 END AS writer, event_type AS original, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE upper(event_type) || '-' || event_id % 13 END AS answer, ts, event_id FROM events),
cl AS (SELECT 'writer_' || split_part(writer, ' ', 2) AS writer, original, answer, ts, event_id, regexp_replace(lower(answer), '[^a-z0-9_]', '', 'g') AS k FROM an WHERE writer <> '__' AND trim(answer) <> '')"""


def answer_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    writer = F.when(F.col("user_id") % 50 == 0, "__").otherwise(F.concat(F.lit("Writer "), (F.col("user_id") % 20).cast("string")))
    answer = F.when(n % 11 == 0, " ").otherwise(F.concat(F.upper("event_type"), F.lit("-"), (n % 13).cast("string")))
    return I.table(spark, sf, "events").select(writer.alias("writer"), F.col("event_type").alias("original"), answer.alias("answer"), F.col("ts").alias("created_at"), "event_id")


@query(
    "writer_words_merge",
    f"""WITH {ANSWERS}, base AS (SELECT writer, original, answer, ts, k FROM cl WHERE event_id < 500), b AS (SELECT writer, k, arg_min(answer, ts) AS answer, min(ts) AS ts FROM base GROUP BY ALL),
    nw AS (SELECT writer, k, arg_min(answer, ts) AS answer, min(ts) AS ts FROM cl WHERE event_id >= 500 AND (writer, k) NOT IN (SELECT (writer, k) FROM b) GROUP BY ALL),
    u AS (SELECT * FROM b UNION ALL SELECT * FROM nw) SELECT writer, answer, epoch_us(ts) AS created_us FROM u""",
)
def writer_words_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = answer_rows(spark, sf)
    empty = spark.createDataFrame([], "writer string, original string, answer string, created_at timestamp")
    first = T.add_answers(empty, rows.where("event_id < 500"))
    return T.add_answers(first, rows.where("event_id >= 500")).select("writer", "answer", F.unix_micros("created_at").alias("created_us"))


@query(
    "writer_words_lookup",
    f"""WITH {ANSWERS}, lo AS (SELECT DISTINCT writer, answer, k FROM cl WHERE event_id % 2 = 0), sh AS (SELECT DISTINCT writer, answer, k FROM cl WHERE event_id % 2 = 1)
    SELECT writer, answer, 0 AS place FROM lo UNION ALL SELECT writer, answer, 1 FROM sh WHERE (writer, k) NOT IN (SELECT (writer, k) FROM lo)""",
)
def writer_words_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = answer_rows(spark, sf).withColumn("writer", L.writer_slug(F.col("writer"))).where("writer is not null and trim(answer) <> ''")
    side = lambda n: rows.where(F.col("event_id") % 2 == n).select("writer", "answer").distinct()
    return T.words_for(side(0), side(1))


def history_table(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.when(F.col("event_id") % 17 == 0, "{broken").when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"long": "'), F.repeat("event_type", 3), F.lit('"}'))).otherwise(F.col("props"))
    return I.table(spark, sf, "events").select(
        (F.col("user_id") % 40).alias("user_id"), (F.col("event_id") % 700).alias("id"), F.unix_millis("ts").alias("ts"), F.unix_millis("ts").alias("updated"),
        F.col("event_type").alias("name"), F.repeat(F.lit("t"), (F.col("event_id") % 9).cast("int")).alias("thumb"), payload.alias("payload"), "event_id",
    )


HISTORY = """hs AS (SELECT user_id % 40 AS user_id, event_id % 700 AS id, epoch_us(ts) // 1000 AS ts, event_type AS name, repeat('t', (event_id % 9)::INT) AS thumb, CASE WHEN event_id % 13 = 0 THEN '{"long": "' || repeat(event_type, 3) || '"}' ELSE props END AS payload, event_id FROM events WHERE event_id % 17 <> 0),
fit AS (SELECT user_id, id, ts, name, CASE WHEN length(payload) + length(thumb) <= 16 THEN thumb END AS thumb, event_id FROM hs WHERE length(payload) <= 16),
up AS (SELECT user_id, id, max(ts) AS ts, arg_max(name, ts) AS name, arg_max(coalesce(thumb, '~'), ts) AS thumb FROM fit GROUP BY ALL)"""


@query(
    "history_top",
    f"""WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS place FROM up)
    SELECT user_id, id, ts, name, nullif(thumb, '~') AS thumb, place FROM r WHERE place <= 100""",
)
def history_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = history_table(spark, sf)
    ok, _ = T.history_rows(rows, 16)
    old, new = ok.where("event_id < 5000").drop("event_id"), ok.where("event_id >= 5000").drop("event_id")
    return T.history_latest(T.history_upsert(old, new)).select("user_id", "id", "ts", "name", "thumb", "place")


@query("delete_rows", "SELECT event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY event_type")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    gone = I.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return T.delete_by(I.table(spark, sf, "events"), gone, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("owned_rows", "SELECT event_id, event_type FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def owned_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    return T.owned_by(e, e.agg(F.min("user_id").alias("u")).scalar()).select("event_id", "event_type")


@query(
    "prefer_results",
    """SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE -1 END AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END AS source_rank FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def prefer_results(spark: SparkSession, sf: str) -> DataFrame:
    test = I.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    dev = I.table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return T.prefer(test, dev, key="doc_id")


@query(
    "resume_pending",
    "SELECT o_orderkey AS image FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)",
)
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    done = I.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("image"))
    return A.pending(I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image")), done)


@query(
    "history_search",
    "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') OR contains(lower(text), 'tion the')",
)
def history_search(spark: SparkSession, sf: str) -> DataFrame:
    d = I.table(spark, sf, "documents").select("doc_id", "source", "text")
    both = RV.search_history(d, " SRC1 ", "source").unionByName(RV.search_history(d, "tion the", "text"))
    return both.select("doc_id", "source").distinct()


@query(
    "day_bucket",
    """WITH m AS (SELECT max(ts) AS now FROM events) SELECT CASE WHEN ts >= date_trunc('day', now) THEN 'today' WHEN ts >= date_trunc('day', now) - INTERVAL 1 DAY THEN 'yesterday' ELSE 'earlier' END AS day, count(*) AS n,
      count(*) FILTER (WHERE epoch_us(now) - epoch_us(ts) < 3600000000) AS last_hour FROM events, m GROUP BY 1""",
)
def day_bucket(spark: SparkSession, sf: str) -> DataFrame:
    e = I.table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now")).scalar()
    fresh = now - F.col("ts") < F.expr("INTERVAL 1 HOUR")
    return e.groupBy(L.day_bucket(F.col("ts"), now).alias("day")).agg(F.count("*").alias("n"), F.count_if(fresh).alias("last_hour"))


@query(
    "usable_readings",
    """WITH r AS (SELECT conv_id AS page_id, turn AS slot, CASE WHEN turn % 4 = 3 THEN '  ' WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN NULL ELSE text END AS text, CASE WHEN turn % 4 = 2 AND conv_id % 2 = 0 THEN repeat('x', 250) END AS error FROM conversations),
    p AS (SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN coalesce(substr(error, 1, 200), 'empty reply') END AS problem FROM r)
    SELECT page_id, slot, problem, count(*) FILTER (WHERE problem IS NULL) OVER (PARTITION BY page_id) >= 2 AS enough FROM p""",
)
def usable_readings(spark: SparkSession, sf: str) -> DataFrame:
    n, dead = F.col("turn") % 4, (F.col("turn") % 4 == 2) & (F.col("conv_id") % 2 == 0)
    r = I.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("slot"),
        F.when(n == 3, "  ").when(~dead, F.col("text")).alias("text"), F.when(dead, F.repeat(F.lit("x"), 250)).alias("error"),
    )
    p = V.usable(r)
    enough = p.groupBy("page_id").agg((F.count_if(F.col("problem").isNull()) >= 2).alias("enough"))
    return p.join(enough, "page_id").select("page_id", "slot", "problem", "enough")


@query(
    "drop_translations",
    r"""WITH r AS (SELECT conv_id AS page_id, turn AS slot, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN translate(text, 'aeinorst', 'аеиноrст') WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN translate(text, 'x', 'х') ELSE text END AS text FROM conversations),
    s AS (SELECT *, len(regexp_extract_all(text, '\p{L}')) AS n, len(regexp_extract_all(text, '\p{Cyrillic}')) AS f FROM r),
    t AS (SELECT page_id, slot, CASE WHEN n = 0 THEN 0.0 ELSE f / n END AS share FROM s)
    SELECT page_id, slot, round(share, 6) AS share, max(share) OVER (PARTITION BY page_id) >= 0.4 AND share < 0.1 AS translated FROM t""",
)
def drop_translations(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("turn") % 2 == 0
    text = (
        F.when(even & (F.col("conv_id") % 3 == 0), F.translate("text", "aeinorst", "аеиноrст"))
        .when(even & (F.col("conv_id") % 3 == 1), F.translate("text", "x", "х"))
        .otherwise(F.col("text"))
    )
    r = I.table(spark, sf, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("slot"), text.alias("text"))
    return V.drop_translations(r).select("page_id", "slot", F.round("share", 6).alias("share"), "translated")


@query(
    "claims",
    "SELECT o_custkey AS page_id, o_orderpriority AS reader, min(o_orderkey) AS slot FROM orders GROUP BY ALL",
)
def claims(spark: SparkSession, sf: str) -> DataFrame:
    r = I.table(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderpriority").alias("reader"), F.col("o_orderkey").alias("slot"))
    return V.dedupe_claims(r).select("page_id", "reader", "slot")


@query("mark_distinct", "SELECT o_custkey, count(DISTINCT lower(o_orderpriority))::INT AS kinds, arg_min(o_orderpriority, o_orderkey) AS first FROM orders GROUP BY o_custkey")
def mark_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct values per group with the first one seen."""
    o = I.table(spark, sf, "orders")
    # one row per customer and spelling first, so the list holds each spelling once
    per = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("at"))
    seen = per.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("at", F.col("o_orderpriority").alias("mark")))).alias("s"))
    kept = X.first_by_lower(F.col("s.mark"))
    return seen.select("o_custkey", F.size(kept).alias("kinds"), F.get(kept, F.lit(0)).alias("first"))


def page_meta(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("name"), F.timestamp_seconds(F.col("doc_id")).alias("digitized_at"),
        F.lit("note").alias("doc_type"), F.lit(5).alias("models"), F.lit(0).alias("failed"),
    )


@query(
    "export_text",
    rf"""WITH {O.VOTED}, j AS (SELECT page_id, string_agg(CASE WHEN flagged THEN '[[' || text || '?]]' ELSE text END, ' ' ORDER BY idx) AS m, count(*) FILTER (WHERE flagged) AS n FROM voted GROUP BY page_id)
    SELECT page_id, trim(regexp_replace(regexp_replace(m, '\s*\n\s*', chr(10), 'g'), ' ([.,;:!?)\]])', '\1', 'g'), ' ' || chr(10))
      || CASE WHEN n > 0 THEN chr(10) || chr(10) || '---' || chr(10) || n || ' word(s) in [[ ]] were not verified. Check them against the original.' || chr(10) ELSE chr(10) END AS value FROM j""",
)
def export_text(spark: SparkSession, sf: str) -> DataFrame:
    return E.to_text(I.voted(spark, sf))


MARKDOWN = rf"""WITH {O.VOTED}, c AS (SELECT *, replace(replace(text, '|', '\|'), chr(10), ' ') AS cell,
      replace(replace(array_to_string(list_transform(models, lambda x, i: 'r' || i || ': ' || x), '; '), '|', '\|'), chr(10), ' ') AS seen FROM voted),
    j AS (SELECT page_id, count(*) FILTER (WHERE flagged) AS n, string_agg(CASE WHEN flagged THEN '[[' || text || '?]]' ELSE text END, ' ' ORDER BY idx) AS m,
      string_agg('| ' || cell || ' | ' || seen || ' |  |', chr(10) ORDER BY idx) FILTER (WHERE flagged AND text <> chr(10)) AS tab FROM c GROUP BY page_id),
    b AS (SELECT *, trim(regexp_replace(regexp_replace(m, '\s*\n\s*', chr(10), 'g'), ' ([.,;:!?)\]])', '\1', 'g'), ' ' || chr(10)) AS body FROM j)
    SELECT page_id, array_to_string(['# Transcription', '', '- Source: ' || source, '- Digitized: ' || strftime(make_timestamp(doc_id * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ'),
      '- Document type: note', '- Models that read it: 5', '- Unverified words: ' || n, '- Corrected by a person: 0', '', '## Text', '',
      replace(regexp_replace(body, '\[\[(.+?)\?\]\]', '**[[\1?]]**', 'g'), chr(10), '  ' || chr(10)), ''], chr(10))
      || CASE WHEN n > 0 THEN array_to_string(['', '> Words in **[[ ]]** were not verified. Check them against the original before use.', '', '## Needs verification', '',
      '| Word | Models read | Note |', '| --- | --- | --- |', tab, ''], chr(10)) ELSE '' END AS value FROM b JOIN documents d ON d.doc_id = b.page_id"""


@query("export_markdown", MARKDOWN)
def export_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return E.to_markdown(I.voted(spark, sf), page_meta(spark, sf))


@query("export_json")
def export_json(spark: SparkSession, sf: str) -> DataFrame:
    readings = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.explode(F.array(*[F.lit(f"r{k}") for k in range(1, I.READERS + 1)])).alias("reader"), F.lit(None).cast("string").alias("error")
    )
    return E.to_json_doc(I.voted(spark, sf), page_meta(spark, sf), readings=readings, exported_at=F.timestamp_seconds(F.lit(0)))
