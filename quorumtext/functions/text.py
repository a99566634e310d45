"""String functions of the consensus engine, as Column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, character classes and patterns the results depend on.
UNREADABLE = "[?]"
MARGIN = "[margin]"
WILD = "<any>"
WILD_MARKS = ("[unclear]", "[illegible]", "[?]")
NEWLINE = "\n"
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
NON_WORD, WORD_CHAR = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]"
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"
RAG_TOKEN = r"[\p{L}\p{N}_\x{0900}-\x{0DFF}\x{064B}-\x{065F}\x{0670}]+"
SENTENCE_BREAK = rf"(?<=[.!?।]){SPACE}+|\n{SPACE}*\n|\n(?={SPACE}*(?:[-*•]|\d+[.)]){SPACE})"

# the same classes as plain characters: line breaks, and all other white space but the blank
BREAKS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = "\t\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" " + BREAKS + BLANKS))


def raw_clean(c: Column) -> Column:
    """Outer whitespace stripped, inner whitespace collapsed; null reads as empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def _plain(c: Column) -> Column:
    """Is it ASCII?  Classes of ASCII characters alone are looked up in a table, others walked through for every letter."""
    return F.length(c) == F.octet_length(c)


def tokens(text: Column) -> Column:
    """Words in order with an explicit newline token between lines."""

    def spaced(t: Column, breaks: str, blanks: str) -> Column:
        return F.regexp_replace(F.regexp_replace(t, f"[{breaks}]", f" {NEWLINE} "), f"[{blanks}]", " ")

    lines = F.replace(strip(text), F.lit("\r\n"), F.lit(NEWLINE))
    ascii_only = ("".join(c for c in cs if c.isascii()) for cs in (BREAKS, BLANKS))
    every = (r"\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}", r"\t\x1f\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}")
    # a split at one plain character needs no pattern
    return F.array_remove(F.split(F.when(_plain(text), spaced(lines, *ascii_only)).otherwise(spaced(lines, *every)), " "), "")


def key(tok: Column) -> Column:
    """Comparison key of a token; the unreadable marker keeps its own key."""
    return (
        F.when(tok.contains(UNREADABLE), UNREADABLE)
        .when(~tok.rlike(WORD_CHAR), tok)
        .otherwise(F.regexp_replace(F.lower(tok), NON_WORD, ""))
    )


def detok(toks: Column) -> Column:
    """Tokens back to text: one space inside a line, a line break per newline token."""
    return F.regexp_replace(F.array_join(toks, " "), " ?\n ?", "\n")


def mark(text: Column, flagged: Column) -> Column:
    doubtful = F.coalesce(flagged, F.lit(False)) & (text != NEWLINE)
    return F.when(doubtful, F.concat(F.lit("[["), text, F.lit("?]]"))).otherwise(text)


def join_words(toks: Column) -> Column:
    """Display join: no space before closing punctuation, blank lines collapsed."""
    line = F.regexp_replace(F.array_join(toks, " "), r"\s*\n\s*", "\n")
    return strip(F.regexp_replace(line, r" ([.,;:!?)\]])", "$1"))


def is_newline(tok: Column) -> Column:
    return tok == NEWLINE


def is_margin_tag(tok: Column) -> Column:
    return F.lower(tok) == MARGIN


def is_word(tok: Column) -> Column:
    return (tok != NEWLINE) & (tok != MARGIN) & ~tok.contains(UNREADABLE)


def has_digit(tok: Column) -> Column:
    return tok.rlike(DIGIT)


def strip_reasoning(text: Column) -> Column:
    t = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(F.regexp_replace(t, r"^```", ""), r"```\z", ""))


_QUOTED = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""


def tidy_reading(text: Column) -> Column:
    """Undo wrapping some readers put around a transcription; the words stay as they are."""
    t = strip_reasoning(text)
    t = strip(F.regexp_replace(t, r"^```[a-z]*\s*|\s*```\z", ""))
    t = F.regexp_replace(t, r"^(?i:transcription|transcribed text|text)\s*:\s*", "")
    is_list = t.rlike(rf"(?s)\A\[\s*{_QUOTED}(?:\s*,\s*{_QUOTED})*\s*,?\s*\]\z")
    no_trailing = F.regexp_replace(t, r",\s*\]\z", "]")
    items = F.when(is_list, F.from_json(no_trailing, "array<string>"))
    t = F.coalesce(F.array_join(F.transform(items, strip), "\n"), t)
    first = F.substring(t, 1, 1)
    uses = F.length(t) - F.length(F.replace(t, first, F.lit("")))
    quoted = (
        (F.length(t) >= 2)
        & first.isin("'", '"', "`")
        & (F.right(t, F.lit(1)) == first)
        & (uses == 2)
    )
    return F.when(quoted, strip(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def non_latin_share(text: Column) -> Column:
    """Letters beyond Latin Extended-B over all letters, 0 when there are none."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    far = F.regexp_count(text, F.lit(r"[\p{L}&&[^\x{0000}-\x{024F}]]"))
    return F.when(letters == 0, 0.0).otherwise(far / letters)


def near(a: Column, b: Column) -> Column:
    """Same word up to a small slip: one edit for words of up to 8 characters, else two."""
    most = F.when(F.greatest(F.length(a), F.length(b)) <= 8, 1).otherwise(2)
    return F.call_function("levenshtein", a, b, most) >= 0


def word_list(text: Column, ref: bool = False) -> Column:
    """Evaluation words: hyphen and slash split, keys only, illegible spots kept for references."""
    spaced = F.replace(text, F.lit(MARGIN), F.lit(" "))
    toks = F.filter(F.split(spaced, f"{SPACE}+"), lambda t: t != "")
    pieces = F.flatten(
        F.transform(
            toks,
            lambda t: F.when(F.lower(t).isin(*WILD_MARKS), F.array(t)).otherwise(F.split(t, "[-/–]+")),
        )
    )
    pieces = F.filter(pieces, lambda t: t != "")

    def to_key(t: Column) -> Column:
        return F.when(F.lower(t).isin(*WILD_MARKS), WILD).otherwise(key(t)) if ref else key(t)

    return F.filter(
        F.transform(pieces, to_key),
        lambda w: w.isin(UNREADABLE, WILD) | w.rlike(r"[\p{L}\p{N}]"),
    )


def piece_list(tok: Column) -> Column:
    """`word_list` of one token; a token of plain letters, digits and points is not split."""
    k = key(tok)
    plain = F.when(k.rlike("[A-Za-z0-9]"), F.array(k)).otherwise(F.array().cast("array<string>"))
    return F.when(tok.rlike(r"\A[A-Za-z0-9.,;:]+\z"), plain).otherwise(word_list(tok))


def rag_tokens(text: Column) -> Column:
    """Retrieval tokens; Indic vowel signs and Urdu marks stay inside a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(RAG_TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences, whitespace collapsed, empty ones dropped."""
    parts = F.transform(F.split(text, SENTENCE_BREAK), raw_clean)
    return F.filter(parts, lambda s: s != "")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def marked_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[(.*?)\?\]\]"), F.lit(1))


def unmark(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[(.*?)\?\]\]", "$1")


def fix_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"【\s*(\d{1,3})[^】]*】", "[$1]")


def cited_numbers(text: Column) -> Column:
    """Cited numbers in order of appearance, lists such as ``[2, 3]`` included, duplicates kept."""
    spans = F.regexp_extract_all(text, F.lit(r"\[(\d{1,3}(?:\s*[,;]\s*\d{1,3})*)\]"), F.lit(1))
    return F.transform(
        F.flatten(F.transform(spans, lambda s: F.split(s, r"\s*[,;]\s*"))), lambda n: n.cast("int")
    )


def first_by_lower(items: Column) -> Column:
    """Case-insensitive distinct that keeps the first spelling."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
