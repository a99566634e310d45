"""Consensus vote: readings of a page -> aligned columns -> one voted word per column.

A page travels as ONE row holding its readings, so after the single shuffle that brings the readings together
(raw text, the compact form) every step up to the word list is local to the row: no join, window or second
exchange.  The group behind a row is bounded by the reader slots of the page, which `page_frame` enforces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumtext.functions import text as X
from quorumtext.functions.arrow import align_page, align_piece, key_ratio, page_cuts, with_joined

WORD_FIELDS = (
    "text", "confidence", "flagged", "likely", "alternatives", "votes", "readers", "by_model",
    "top", "number", "lookalikes", "resolved_by", "evidence", "original",
)


@dataclass(frozen=True)
class VoteConfig:
    """Flag rule per page kind and the switches of the vote."""

    rule: str = "two_thirds"
    rule_prescription: str = "unanimous"
    digits_strict: bool = True
    drop_minority: bool = True
    join_splits: bool = True
    max_slots: int = 16


def trusted(votes: Column, n: Column, rule: str) -> Column:
    """Do enough readers agree to show the word without a flag?"""
    enough = {"unanimous": votes == n, "two_thirds": votes * 3 >= n * 2, "majority": votes * 2 > n}[rule]
    return (n <= 1) | enough


def is_flagged(top: Column, n: Column, number: Column, rule: str, digits_strict: bool = True) -> Column:
    """Flag of a voted word from its counts, so any number of rules can share one vote."""
    flag = (top == 0) | ~trusted(top, n, rule)
    return flag | (number & (top < n)) if digits_strict else flag


# ---------------------------------------------------------------- readings -> page rows

def usable(readings: DataFrame) -> DataFrame:
    """Adds `problem`: null for a usable reading, else why it takes no part in the vote."""
    blank = X.strip(F.coalesce(F.col("text"), F.lit(""))) == ""
    message = F.coalesce(F.substring("error", 1, 200), F.lit("empty reply"))
    return readings.withColumn("problem", F.when(blank, message))


def drop_translations(readings: DataFrame) -> DataFrame:
    """Adds `translated`: a Latin reading of a page that others copied in its own script. Never all of a page."""
    share = X.non_latin_share(F.col("text"))
    scored = readings.withColumn("share", share)
    # the largest share of the page decides; max combines map-side, so a page with many rows stays cheap
    peak = scored.groupBy("page_id").agg(F.max("share").alias("peak"))
    return (
        scored.join(peak, "page_id")
        .withColumn("translated", (F.col("peak") >= 0.4) & (F.col("share") < 0.1))
        .drop("peak")
    )


def latest_per_slot(readings: DataFrame) -> DataFrame:
    """One reading per (page, slot): the newest by `ts`, without that column any one of them with text.  Combines
    map-side, so repeated deliveries never pile up."""
    rest = [c for c in readings.columns if c not in ("page_id", "slot", "ts")]
    newest = F.col("ts") if "ts" in readings.columns else F.struct(F.coalesce(X.strip(F.col("text")) != "", F.lit(False)), "reader", "text")
    kept = F.max_by(F.struct(*rest), newest).alias("__r")
    return readings.groupBy("page_id", "slot").agg(kept).select("page_id", "slot", "__r.*")


def dedupe_claims(readings: DataFrame) -> DataFrame:
    """Two slots answered by the same reader count once: the lower slot stays."""
    first = readings.groupBy("page_id", "reader").agg(F.min("slot").alias("slot"))
    return readings.join(first, ["page_id", "reader", "slot"], "left_semi")


def in_list(max_slots: int = 16) -> Column:
    """Is the slot one of the reader list?"""
    return F.coalesce(F.col("slot").between(0, max_slots - 1), F.lit(False))


def stray_slots(readings: DataFrame, max_slots: int = 16) -> DataFrame:
    """(page_id, slot, reader, problem): rows whose slot no reader has."""
    note = F.concat(F.lit("reader slot out of range: "), F.coalesce(F.col("slot").cast("string"), F.lit("none")))
    return readings.where(~in_list(max_slots)).select("page_id", "slot", "reader", note.alias("problem"))


def page_frame(readings: DataFrame, max_slots: int = 16, keys: bool = True) -> DataFrame:
    """page_id, rd: array<struct<ord, reader, toks, keys>> in slot order; and `chars`, the size of the texts.  The row-wise
    vote needs no `keys`.

    (page_id, slot) must be unique (see `latest_per_slot`).  A slot outside the reader list takes no part, so no group
    grows without bound; `stray_slots` lists such rows.
    """
    readings = readings.where(in_list(max_slots))
    one = F.struct("slot", "reader", "text")
    # by an explicit number: pages are small next to the work on them, and should not be coalesced to a few tasks
    spread = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    readings = readings.withColumn("__n", F.length("text")).repartition(spread, "page_id")
    pages = readings.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("r"), F.coalesce(F.sum("__n"), F.lit(0)).alias("chars"))
    return with_tokens(
        pages.select("page_id", "chars", F.transform("r", lambda x: F.struct(x.reader, x.text)).alias("r")), keys
    )


def with_tokens(pages: DataFrame, keys: bool = True) -> DataFrame:
    """`r` array<struct<reader, text>> -> `rd` with tokens and comparison keys."""
    toks = F.transform(
        "r", lambda x, i: F.struct(i.alias("ord"), x.reader.alias("reader"), X.tokens(x.text).alias("toks"))
    )
    pages = pages.withColumn("rd", toks).drop("r")
    return pages.withColumn("rd", with_keys(F.col("rd"))) if keys else pages


def with_keys(rd: Column) -> Column:
    return F.transform(
        rd,
        lambda x: F.struct(x.ord.alias("ord"), x.reader.alias("reader"), x.toks.alias("toks"),
                           F.transform(x.toks, X.key).alias("keys")),
    )


# ---------------------------------------------------------------- split words

def unsplit(pages: DataFrame) -> DataFrame:
    """Join two neighbouring pieces of one reader when the joined form is (nearly) a word another reader wrote
    and neither piece stands alone in any other reading.  Numbers are never joined.

    Keys are looked up in sets and near words by a shared piece, so the work grows with the length of a page.  Pages
    without a pair of pieces stay as they are.
    """
    word = lambda x: F.transform(x.toks, X.is_word).alias("word")
    plain = lambda x: F.transform(x.toks, lambda t: X.is_word(t) & ~X.has_digit(t)).alias("plain")
    asked = F.transform("rd", lambda x: F.struct(x.toks.alias("toks"), x["keys"].alias("keys"), word(x), plain(x)))
    schema = T.StructType([*pages.schema.fields, T.StructField("__to", T.ArrayType(T.ArrayType(T.IntegerType())))])
    staged = pages.withColumn("__readers", asked).mapInArrow(with_joined, schema)

    def rebuilt(x: Column, to: Column) -> Column:
        place = lambda c: F.shiftright(c, 1)
        tok = lambda c: F.when(c.bitwiseAND(F.lit(1)) == 1, F.concat(F.get(x.toks, place(c)), F.get(x.toks, place(c) + 1))).otherwise(F.get(x.toks, place(c)))
        key = lambda c: F.when(c.bitwiseAND(F.lit(1)) == 1, X.key(tok(c))).otherwise(F.get(x["keys"], place(c)))
        return F.struct(
            x.ord.alias("ord"), x.reader.alias("reader"),
            F.when(to.isNull(), x.toks).otherwise(F.transform(to, tok)).alias("toks"),
            F.when(to.isNull(), x["keys"]).otherwise(F.transform(to, key)).alias("keys"),
        )

    some = F.zip_with("rd", "__to", rebuilt)
    return staged.withColumn("rd", F.when(F.col("__to").isNull(), F.col("rd")).otherwise(some)).drop("__to")


# ---------------------------------------------------------------- alignment -> columns

_NO_GAP = "cast(null as struct<text:string,votes:int,number:boolean>)"


def align_positional(pages: DataFrame) -> DataFrame:
    """Readings of equal length: column = position, the first reading is the pivot."""
    return pages.drop("chars").selectExpr(
        "*",
        f"""transform(rd[0].toks, (t, i) -> named_struct(
              'pos', i, 'sub', 1, 'k', 0,
              'cells', transform(rd, r -> named_struct('ord', r.ord, 'tok', get(r.toks, i), 'key', get(r.keys, i))),
              'gap', {_NO_GAP})) as cols""",
    )


#: Characters of all readings of a page beyond which it is aligned in pieces, and words a piece is meant to hold.
LONG_PAGE, PIECE_WORDS = 400_000, 1_000


def page_chars(pages: DataFrame) -> Column:
    """Size of a page row: as `page_frame` counted it, else from its tokens."""
    return F.col("chars") if "chars" in pages.columns else F.aggregate("rd", F.lit(0), lambda n, r: n + 2 * F.size(r.toks))


def _align_pieces(pages: DataFrame, piece: int) -> DataFrame:
    """(page_id, al) as `align_page` gives it, for long pages: each pair of readings is compared for the pivot in a task
    of its own, then every reading is cut, together with the pivot, where both certainly meet, and the pieces are aligned
    in tasks of their own and put together again."""
    keys = pages.select("page_id", F.expr("transform(rd, r -> r.keys)").alias("ks"))
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = keys.select("page_id", F.posexplode("ks").alias("i", "ki"), "ks")
    pairs = numbered.select("page_id", "i", "ki", F.posexplode("ks").alias("j", "kj")).where("i <> j").repartition(spread, "page_id", "i", "j")
    ratio = F.when(F.col("ki") == F.col("kj"), F.lit(1.0)).otherwise(key_ratio("ki", "kj"))
    scored = pairs.select("page_id", "i", "j", ratio.alias("ratio")).groupBy("page_id", "i")
    # added in reading order, as one task would
    total = F.aggregate(F.sort_array(F.collect_list(F.struct("j", "ratio"))), F.lit(0.0), lambda t, x: t + x.ratio)
    sums = scored.agg(total.alias("total")).groupBy("page_id").agg(F.max_by("i", F.struct("total", -F.col("i"))).alias("pivot"))
    chosen = keys.join(sums, "page_id", "left").withColumn("pivot", F.coalesce("pivot", F.lit(0)))
    readings = chosen.select("page_id", "pivot", F.expr("ks[pivot]").alias("kp"), F.posexplode("ks").alias("r", "kr"))
    cut = readings.where("r <> pivot").withColumn("cuts", page_cuts(piece)("kp", "kr"))
    ranges = F.expr("transform(sequence(1, size(cuts) - 1), x -> struct(cuts[x - 1].i as i, cuts[x - 1].j as j, cuts[x].i as to_i, cuts[x].j as to_j))")
    each = cut.withColumn("ranges", ranges).select("page_id", "r", "kp", "kr", F.posexplode("ranges").alias("piece", "c"))
    each = each.select(
        "page_id", "r", "piece", F.expr("c.i").alias("i"), F.expr("c.j").alias("j"),
        F.expr("slice(kp, c.i + 1, c.to_i - c.i)").alias("a"), F.expr("slice(kr, c.j + 1, c.to_j - c.j)").alias("b"),
    ).repartition(spread, "page_id", "r", "piece")
    done = each.withColumn("al", align_piece("a", "b")).select(
        "page_id", "r", "piece", F.expr("transform(al.slots, s -> s + j)").alias("slots"),
        F.expr("transform(al.gaps, g -> struct(g.gap + i as gap, r as ord, g.lo + j as lo, g.hi + j as hi))").alias("gaps"),
    )
    whole = done.groupBy("page_id", "r").agg(F.sort_array(F.collect_list(F.struct("piece", "slots", "gaps"))).alias("p"))
    whole = whole.select("page_id", "r", F.flatten("p.slots").alias("slots"), F.flatten("p.gaps").alias("gaps"))
    own = readings.where("r = pivot").select(
        "page_id", "r", F.expr("transform(kr, (k, i) -> i)").alias("slots"), F.expr("cast(array() as array<struct<gap:int,ord:int,lo:int,hi:int>>)").alias("gaps")
    )
    packed = whole.unionByName(own).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("r", "slots", "gaps"))).alias("p"))
    al = F.struct(F.col("pivot").alias("pivot"), F.col("p.slots").alias("slots"), F.flatten("p.gaps").alias("gaps"))
    return packed.join(chosen.select("page_id", "pivot"), "page_id").select("page_id", al.alias("al"))


def align_sequences(pages: DataFrame, long_page: int = LONG_PAGE, piece: int = PIECE_WORDS) -> DataFrame:
    """Sequence alignment to the pivot reading; runs the pivot lacks become gap columns in between.

    A page of more than `long_page` characters is aligned in pieces by many tasks, with the same result.  Whether there
    is one is asked first, which reads no more than the lengths of the texts.
    """
    size = page_chars(pages)
    aligned = pages.where(size <= long_page).withColumn("al", align_page(F.expr("transform(rd, r -> r.keys)")))
    long = pages.where(size > long_page)
    if not long.select("page_id").isEmpty():
        aligned = aligned.unionByName(long.join(_align_pieces(long, piece), "page_id"))
    aligned = aligned.drop("chars")
    ordered = aligned.selectExpr(
        "*",
        "concat(array(al.pivot), filter(sequence(0, size(rd) - 1), i -> i <> al.pivot)) as ords",
        "size(rd) as n",
        """transform(al.gaps, g -> named_struct('gap', g.gap, 'ord', g.ord,
             'seq', filter(slice(rd[g.ord].toks, g.lo + 1, g.hi - g.lo), t -> t <> '\n'))) as runs""",
    )
    keyed = ordered.selectExpr(
        "* except (runs)",
        """transform(filter(runs, g -> size(g.seq) > 0), g -> named_struct('gap', g.gap, 'ord', g.ord, 'seq', g.seq)) as runs""",
    ).withColumn(
        "runs",
        F.transform("runs", lambda g: g.withField("keys", F.transform(g.seq, X.key))),
    )
    # one winner per gap: the key sequence most readers inserted, ties to the reading that comes first
    counted = keyed.selectExpr(
        "*",
        """transform(array_distinct(runs.gap), p -> named_struct('gap', p, 'runs', filter(runs, g -> g.gap = p))) as at_gap""",
    ).selectExpr(
        "* except (at_gap)",
        """transform(at_gap, p -> named_struct('gap', p.gap, 'runs', p.runs, 'best', array_max(transform(p.runs,
             (g, i) -> named_struct('votes', size(filter(p.runs, o -> o.keys = g.keys)), 'first', -i, 'seq', g.seq))))) as at_gap""",
    )
    gap_cols = f"""flatten(transform(filter(at_gap, p -> p.best.votes * 2 >= n), p -> transform(p.best.seq, (t, i) ->
        named_struct('pos', p.gap, 'sub', 0, 'k', i,
          'cells', transform(p.runs, g -> named_struct('ord', g.ord, 'tok', get(g.seq, i), 'key', get(g.keys, i))),
          'gap', named_struct('text', t, 'votes', p.best.votes, 'number', exists(p.best.seq, x -> x rlike r'{X.DIGIT}'))))))"""
    main_cols = f"""transform(rd[al.pivot].toks, (t, i) -> named_struct('pos', i, 'sub', 1, 'k', 0,
          'cells', transform(ords, o -> named_struct('ord', o, 'tok', get(rd[o].toks, get(al.slots[o], i)),
                                                   'key', get(rd[o].keys, get(al.slots[o], i)))),
          'gap', {_NO_GAP}))"""
    return counted.withColumn(
        "cols", F.expr(f"array_sort(concat({gap_cols}, {main_cols}), (a, b) -> "
                       "case when a.pos <> b.pos then a.pos - b.pos when a.sub <> b.sub then a.sub - b.sub else a.k - b.k end)")
    ).selectExpr("* except (al, ords, n, runs, at_gap)", "al.pivot as pivot")


# ---------------------------------------------------------------- columns as rows

def positional_rows(pages: DataFrame, drop_minority: bool = True, max_slots: int = 16) -> DataFrame:
    """page_id, idx, toks, names: one row per position of readings of equal length, as `vote_rows` takes them.

    Readings are zipped, which costs no lambda per token.  Pages whose readings differ in length or line breaks are
    looked through for columns that most readers lack.
    """
    empty = F.array().cast("array<string>")
    slots = [F.coalesce(F.get("rd", F.lit(k)).toks, empty).alias(f"t{k}") for k in range(max_slots)]
    breaks = lambda r: F.transform(r.toks, lambda t: t == X.NEWLINE)
    regular = F.forall("rd", lambda r: breaks(r) == breaks(F.get("rd", F.lit(0))))
    # names and cells first: beside an explode that needs `rd` every row would carry the whole page
    staged = pages.select("page_id", F.expr("transform(rd, r -> r.reader)").alias("names"), regular.alias("regular"), *slots)
    zipped = F.arrays_zip(*[f"t{k}" for k in range(max_slots)])
    cells = F.slice(zipped, F.lit(1), F.size("t0"))
    if drop_minority:
        seen = lambda z: F.size(F.filter(F.array(*[z[f"t{k}"] for k in range(max_slots)]), lambda x: x.isNotNull() & (x != X.NEWLINE)))
        cells = F.filter(cells, lambda z: (z.t0 == X.NEWLINE) | (seen(z) * 2 >= F.size("names")))
    staged = staged.select("page_id", "names", F.when(F.col("regular"), zipped).otherwise(cells).alias("cells"))
    # the outer form, as in `explode_words`
    rows = staged.select("page_id", "names", F.posexplode_outer("cells").alias("idx", "z")).where(F.col("idx").isNotNull())
    toks = F.slice(F.array(*[F.col(f"z.t{k}") for k in range(max_slots)]), F.lit(1), F.size("names"))
    return rows.select("page_id", "idx", toks.alias("toks"), "names")


def _tally(toks: Column) -> Column:
    """Per distinct key of the readable cells: votes, place, key, spellings and the one shown."""
    real = F.filter(toks, lambda x: x.isNotNull() & (x != X.NEWLINE) & ~x.contains(X.UNREADABLE))
    keyed = F.transform(real, lambda x: F.struct(x.alias("tok"), X.key(x).alias("key")))

    def shown(same: Column) -> Column:
        plain = F.btrim(F.coalesce(F.get(F.filter(same, lambda s: ~s.contains("[")), F.lit(0)), same[0]), F.lit("[]"))
        return F.when(F.array_contains(same, X.MARGIN), X.MARGIN).when(plain == "", same[0]).otherwise(plain)

    # a transform of one element names a value, so that it is computed once
    each = F.transform(F.array(keyed), lambda k: F.transform(
        F.array_distinct(F.transform(k, lambda x: x["key"])),
        lambda q, i: F.transform(
            F.array(F.transform(F.filter(k, lambda x: x["key"] == q), lambda x: x.tok)),
            lambda same: F.struct(F.size(same).alias("votes"), (-i).alias("first"), q.alias("key"), same.alias("same"), shown(same).alias("surface")),
        )[0],
    ))
    return each[0]


def in_doubt(rows: DataFrame) -> DataFrame:
    """Of the rows `vote_rows` takes those that can be flagged: where all readers wrote the same, no rule flags."""
    first = F.get("toks", F.lit(0))
    return rows.where((F.size(F.array_distinct("toks")) != 1) | F.coalesce(first.contains(X.UNREADABLE), F.lit(True)))


def vote_rows(rows: DataFrame, rule: str = "two_thirds", digits_strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of rows (page_id, idx, toks, names), one row per column of the page: what `vote_columns` and `explode_words`
    make of a column without insertions.  Only columns in doubt are tallied, and fields nobody reads are not computed."""
    first = F.get("toks", F.lit(0))
    agreed = (F.size(F.array_distinct("toks")) == 1) & ~first.contains(X.UNREADABLE)
    staged = rows.withColumn("nl", first == X.NEWLINE).withColumn("one", agreed)
    staged = staged.withColumn("tally", F.when(~F.col("nl") & ~F.col("one"), _tally(F.col("toks"))))
    # a generator of one row: filters on the words would else move below and repeat the whole tally inside themselves
    counted = F.inline_outer(F.array(F.struct(F.col("nl").alias("is_nl"), F.col("one").alias("is_one"), F.col("tally").alias("groups"), F.array_max("tally").alias("best"))))
    staged = staged.select(*dict.fromkeys((*keep, "page_id", "idx", "toks", "names")), counted)
    nl, one, tally, best, toks = (F.col(c) for c in ("is_nl", "is_one", "groups", "best", "toks"))
    plain = F.btrim(first, F.lit("[]"))
    none = F.array().cast("array<string>")
    others = F.flatten(F.transform(F.filter(tally, lambda t: t["key"] != best["key"]), lambda t: t.same))
    text = F.when(nl, X.NEWLINE).when(one, F.when((first == X.MARGIN) | (plain == ""), first).otherwise(plain))
    text = text.when(best.isNull(), X.UNREADABLE).otherwise(best.surface)
    words = staged.select(
        *keep, "page_id", "idx", text.alias("text"),
        F.when(nl, None).when(one | best.isNull(), none).otherwise(F.array_sort(F.array_distinct(others))).alias("alternatives"),
        F.when(nl, None).when(one, F.array(F.struct(text.alias("text"), F.size(toks).alias("votes"))))
        .otherwise(F.transform(tally, lambda t: F.struct(t.surface.alias("text"), t.votes.alias("votes")))).alias("votes"),
        F.when(~nl, F.size(toks)).alias("readers"),
        F.when(~nl, F.transform("names", lambda r, i: F.struct(r.alias("reader"), F.when(F.get(toks, i) != X.NEWLINE, F.get(toks, i)).alias("text")))).alias("by_model"),
        F.when(~nl, F.when(one, F.size(toks)).otherwise(F.coalesce(best.votes, F.lit(0)))).alias("top"),
        F.when(~nl, F.when(one, X.has_digit(first)).otherwise(F.exists(tally, lambda t: F.exists(t.same, X.has_digit)))).alias("number"),
    )
    return finish_words(words, rule, digits_strict, keep)


# ---------------------------------------------------------------- columns -> words

_SURFACE = r"""case when array_contains(same, '[margin]') then '[margin]'
  else coalesce(nullif(regexp_replace(coalesce(get(filter(same, s -> not contains(s, '[')), 0), same[0]), '^[\\[\\]]+|[\\[\\]]+$', ''), ''), same[0]) end"""


def _surface(same: str) -> str:
    return _SURFACE.replace("same", same)


def vote_columns(pages: DataFrame, drop_minority: bool = True) -> DataFrame:
    """Adds `words`: one struct per column; newline columns carry only their text."""
    keep = "nl or seen * 2 >= size(rd) or gap is not null" if drop_minority else "true"
    keep = keep.replace("nl", "c.nl").replace("seen", "c.seen").replace("gap is", "c.gap is")
    # `one` marks columns where every reader wrote the same token: most of a page, and they skip the tally
    real = pages.selectExpr(
        "* except (cols)",
        """transform(cols, c -> named_struct('nl', c.sub = 1 and c.cells[0].tok = '\n', 'gap', c.gap, 'cells', c.cells,
              'one', c.gap is null and c.cells[0].key <> '[?]' and forall(c.cells, x -> x.tok <=> c.cells[0].tok))) as cols""",
    ).selectExpr(
        "* except (cols)",
        f"""filter(transform(cols, c -> named_struct('nl', c.nl, 'gap', c.gap, 'cells', c.cells, 'one', c.one,
              'real', case when c.nl or c.one then null
                 else filter(c.cells, x -> x.tok is not null and x.tok <> '\n' and x.key <> '[?]') end,
              'seen', case when c.nl or c.one then size(c.cells)
                 else size(filter(c.cells, x -> x.tok is not null and x.tok <> '\n')) end)), c -> {keep}) as cols""",
    )
    grouped = real.selectExpr(
        "* except (cols)",
        f"""transform(cols, c -> named_struct('nl', c.nl, 'gap', c.gap, 'cells', c.cells, 'one', c.one,
              'number', case when c.one then c.cells[0].tok rlike r'{X.DIGIT}' else exists(c.real, x -> x.tok rlike r'{X.DIGIT}') end,
              'tally', case when c.real is not null then transform(array_distinct(c.real.key), (q, i) -> named_struct(
                 'votes', size(filter(c.real, x -> x.key = q)), 'first', -i, 'key', q,
                 'same', filter(c.real, x -> x.key = q).tok)) end)) as cols""",
    )
    spelled = grouped.selectExpr(
        "* except (cols)",
        f"""transform(cols, c -> named_struct('nl', c.nl, 'gap', c.gap, 'cells', c.cells, 'one', c.one, 'number', c.number,
              'plain', case when c.one or c.gap is not null then {_surface('array(coalesce(c.gap.text, c.cells[0].tok))')} end,
              'tally', case when c.tally is not null then transform(c.tally, t -> named_struct('votes', t.votes,
                 'first', t.first, 'key', t.key, 'same', t.same, 'surface', {_surface('t.same')})) end)) as cols""",
    )
    won = spelled.selectExpr(
        "* except (cols)",
        """transform(cols, c -> named_struct('nl', c.nl, 'gap', c.gap, 'cells', c.cells, 'one', c.one, 'number', c.number,
              'plain', c.plain, 'tally', c.tally, 'best', array_max(c.tally))) as cols""",
    )
    words = won.selectExpr(
        "* except (cols)",
        """transform(cols, c -> named_struct(
          'text', case when c.nl then '\n' when c.plain is not null then c.plain
                       when c.best is null then '[?]' else c.best.surface end,
          'alternatives', case when c.nl then null when c.plain is not null or c.best is null then cast(array() as array<string>)
               else array_sort(array_distinct(flatten(transform(filter(c.tally, t -> t.key <> c.best.key), t -> t.same)))) end,
          'votes', case when c.nl then null
               when c.plain is not null then array(named_struct('text', c.plain, 'votes', coalesce(c.gap.votes, size(c.cells))))
               else transform(c.tally, t -> named_struct('text', t.surface, 'votes', t.votes)) end,
          'readers', case when not c.nl then size(rd) end,
          'by_model', case when c.nl then null
               when c.one then transform(rd, r -> named_struct('reader', r.reader, 'text', c.cells[0].tok))
               else transform(rd, r -> named_struct('reader', r.reader, 'text',
                   get(filter(c.cells, x -> x.ord = r.ord and x.tok <> '\n').tok, 0))) end,
          'top', case when not c.nl then coalesce(c.gap.votes, c.best.votes, if(c.one, size(c.cells), 0)) end,
          'number', case when not c.nl then coalesce(c.gap.number, c.number) end)) as words""",
    )
    return words


def explode_words(pages: DataFrame, rule: str = "two_thirds", digits_strict: bool = True) -> DataFrame:
    """One row per word with a dense `idx`, confidence and flag under the given rule."""
    # the outer form: a plain explode would infer a `size(words) > 0` filter and compute the whole vote twice
    rows = (
        pages.select("page_id", F.posexplode_outer("words").alias("idx", "w"))
        .where(F.col("idx").isNotNull())
        .select("page_id", "idx", "w.*")
    )
    return finish_words(rows, rule, digits_strict)


def finish_words(rows: DataFrame, rule: str = "two_thirds", digits_strict: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    flag = is_flagged(F.col("top"), F.col("readers"), F.col("number"), rule, digits_strict)
    nothing = F.lit(None)
    return rows.select(
        *keep,
        "page_id",
        "idx",
        "text",
        F.bround(F.col("top") / F.col("readers"), 2).alias("confidence"),
        F.coalesce(flag, F.lit(False)).alias("flagged"),
        F.lit(False).alias("likely"),
        "alternatives",
        "votes",
        "readers",
        "by_model",
        "top",
        "number",
        nothing.cast("array<string>").alias("lookalikes"),
        nothing.cast("string").alias("resolved_by"),
        nothing.cast("string").alias("evidence"),
        nothing.cast("string").alias("original"),
    )


def page_rollup(words: DataFrame) -> DataFrame:
    """Text, marked text, flag counts per page."""
    ordered = F.sort_array(F.collect_list(F.struct("idx", "text", X.mark(F.col("text"), F.col("flagged")).alias("marked"))))
    return (
        words.groupBy("page_id")
        .agg(
            ordered.alias("w"),
            F.count_if("flagged").alias("flagged"),
            F.count_if(F.col("flagged") & ~F.coalesce("likely", F.lit(False))).alias("to_check"),
        )
        .select(
            "page_id",
            X.detok(F.col("w.text")).alias("text"),
            X.detok(F.col("w.marked")).alias("marked"),
            X.join_words(F.col("w.marked")).alias("display"),
            "flagged",
            "to_check",
        )
    )
