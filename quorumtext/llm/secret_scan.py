"""Secret scan by trigram inverted indexes.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold.  Texts are indexed in
bounded segments, postings are intersected and united by the query, and only the candidates are verified with the
expression.  A rule without mandatory trigrams verifies every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and non-overlapping, whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# Public formats of keys, after the base rules.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,200}:[^\s/@]{1,200}@"),
)
RULES = BASE + MORE

#: Beyond so many strings a run is closed; it then asks for what it holds so far.
MOST_STRINGS = 64
ALL = ("all",)


def _both(parts: list, kind: str):
    """`kind` ("and" or "or") over the parts; ALL is neutral to "and" and swallows "or"."""
    if kind == "or" and ALL in parts:
        return ALL
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    if not parts:
        return ALL
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(s: str):
    """All trigrams of the folded UTF-8 form."""
    b = s.encode().lower()
    return _both([("gram", b[i] << 16 | b[i + 1] << 8 | b[i + 2]) for i in range(len(b) - 2)], "and")


def _ask(run: set[str]):
    return _both([_grams(s) for s in sorted(run)], "or")


def _exact(op, arg) -> set[str] | None:
    """The few strings a node can match, or None."""
    if op is K.LITERAL:
        return {chr(arg)}
    if op is K.IN:
        found: set[str] = set()
        for kind, v in arg:
            if kind is K.LITERAL:
                found.add(chr(v))
            elif kind is K.RANGE and v[1] - v[0] < MOST_STRINGS:
                found.update(map(chr, range(v[0], v[1] + 1)))
            else:
                return None
        return found if len(found) <= 8 else None
    if op is K.SUBPATTERN:
        return _exact_all(arg[3])
    if op is K.BRANCH:
        options = [_exact_all(x) for x in arg[1]]
        return None if None in options else set().union(*options)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 4:
        one = _exact_all(arg[2])
        if one is None:
            return None
        out, power = set(), {""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power) > MOST_STRINGS:
                return None
        return out
    return {""} if op is K.AT else None


def _exact_all(nodes) -> set[str] | None:
    run = {""}
    for op, arg in nodes:
        own = _exact(op, arg)
        if own is None or len(own) * len(run) > MOST_STRINGS:
            return None
        run = {a + b for a in run for b in own}
    return run


def _query(nodes):
    parts, run = [], {""}
    for op, arg in nodes:
        own = _exact(op, arg)
        if own is not None and len(own) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(_ask(run))
        run = own if own is not None else {""}
        if own is None:
            if op is K.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif op is K.BRANCH:
                parts.append(_both([_query(x) for x in arg[1]], "or"))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2]))
    return _both([*parts, _ask(run)], "and")


def trigram_query(pattern: str):
    """Boolean query over folded trigrams: ("gram", code), ("and", parts), ("or", parts), or ALL for a full scan."""
    return _query(_parser.parse(pattern))


def _asked(query) -> set[int]:
    return {query[1]} if query[0] == "gram" else set().union(*map(_asked, query[1])) if len(query) > 1 else set()


def _postings(texts: list[bytes], asked: np.ndarray) -> dict[int, np.ndarray]:
    """Trigram -> sorted places of the texts that hold it, for the trigrams that some query asks for."""
    flat = np.frombuffer(b"\xff\xff".join(texts) + b"\xff\xff", np.uint8)
    codes = flat[:-2].astype(np.uint32)
    codes <<= 8
    codes |= flat[1:-1]
    codes <<= 8
    codes |= flat[2:]
    at = np.flatnonzero(asked[codes])
    ends = np.cumsum([len(t) + 2 for t in texts])
    pairs = np.unique(codes[at].astype(np.uint64) << np.uint64(32) | np.searchsorted(ends, at, "right").astype(np.uint64))
    gram, place = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(gram, prepend=np.uint64(1 << 40)))
    return {int(gram[a]): p for a, p in zip(cuts, np.split(place, cuts[1:]))} if len(gram) else {}


def _candidates(query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
    if query == ALL:
        return np.arange(n)
    if query[0] == "gram":
        return postings.get(query[1], np.empty(0, np.int64))
    found = sorted((_candidates(q, postings, n) for q in query[1]), key=len)
    out = found[0]
    for other in found[1:]:
        out = np.union1d(out, other) if query[0] == "or" else np.intersect1d(out, other, assume_unique=True)
    return out


SPANS = "array<struct<kind:string,start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans): every rule's spans in each row's whole text, by start, then in the order of the rules.

    Positions are code points, the end is exclusive; rules are independent, so spans of different kinds may overlap.
    Null and empty texts have no spans.  Every row gives one row, repeated rows too.  One pass, no shuffle: a hot
    source, id or text cannot pile up in a task.  Other columns of `docs` are ignored.
    """
    rules = tuple(rules)
    queries = [trigram_query(r.pattern) for r in rules]
    asked = sorted(set().union(*map(_asked, queries)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, bool)
        table[asked] = True
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            for part in segments(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                postings = _postings([t.encode().lower() for t in texts], table)
                found: list[list] = [[] for _ in texts]
                for place, (rule, rx, query) in enumerate(zip(rules, compiled, queries)):
                    for i in _candidates(query, postings, len(texts)).tolist():
                        for m in rx.finditer(texts[i]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), place, m.end()))
                spans = [[{"kind": rules[k].kind, "start": a, "stop": b} for a, k, b in sorted(f)] for f in found]
                yield frame({"doc_id": (part.column("doc_id"), None), "spans": (spans, _SPANS)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, spans {SPANS}")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
