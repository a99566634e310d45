"""Arrow UDFs for the few steps no built-in expresses; every one works on one row at a time."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections import Counter
from difflib import Match, SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quorumtext.functions import matching
from quorumtext.functions import text as X


@F.arrow_udf(T.StringType())
def _nfc(a: pa.Array) -> pa.Array:
    return pa.array([x and unicodedata.normalize("NFC", x) for x in a.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkc_casefold(a: pa.Array) -> pa.Array:
    return pa.array([x and unicodedata.normalize("NFKC", x).casefold() for x in a.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Text below U+0300 is already composed, so only the rest travels to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x{0000}-\x{02FF}]"), c)), c)


def word_list(text: Column, ref: bool = False) -> Column:
    """Evaluation words of composed text, so that both spellings of an accented letter are one word."""
    return X.word_list(nfc(text), ref)


def bench_norm(c: Column) -> Column:
    """Benchmark key: NFKC, case-folded, letters and digits only; ASCII never leaves the JVM."""
    c = F.coalesce(c, F.lit(""))
    folded = F.coalesce(_nfkc_casefold(F.when(c.rlike(r"[^\x{0000}-\x{007F}]"), c)), F.lower(c))
    return F.regexp_replace(folded, r"[^0-9a-z\x{0080}-\x{FFFF}]", "")


class _Matcher(SequenceMatcher):
    """The standard matcher (no junk test), looking only at the positions inside the asked range.

    The stock search walks every position of a frequent token for every sub-range, which turns long pages
    quadratic; the positions are sorted, so the range is cut out by bisection.
    """

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b = self.a, self.b
        ahi = len(a) if ahi is None else ahi
        bhi = len(b) if bhi is None else bhi
        at_a, at_b, size = alo, blo, 0
        runs: dict[int, int] = {}
        for i in range(alo, ahi):
            places = self.b2j.get(a[i])
            grown: dict[int, int] = {}
            if places:
                for j in places[bisect_left(places, blo) : bisect_left(places, bhi)]:
                    k = grown[j] = runs.get(j - 1, 0) + 1
                    if k > size:
                        at_a, at_b, size = i - k + 1, j - k + 1, k
            runs = grown
        # frequent tokens may be left out of the index: grow the block over them
        while at_a > alo and at_b > blo and a[at_a - 1] == b[at_b - 1]:
            at_a, at_b, size = at_a - 1, at_b - 1, size + 1
        while at_a + size < ahi and at_b + size < bhi and a[at_a + size] == b[at_b + size]:
            size += 1
        return Match(at_a, at_b, size)


def _blocks(a: matching.Words, b: matching.Words, autojunk: bool) -> list[tuple[int, int, int]]:
    """Matching blocks in order; lists that repeat themselves too much are walked through."""
    found = matching.blocks(a, b, autojunk)
    return _Matcher(None, a.ids, b.ids, autojunk).get_matching_blocks()[:-1] if found is None else found


def _ratio(a: matching.Words, b: matching.Words) -> float:
    size = len(a.ids) + len(b.ids)
    return 2.0 * sum([n for _, _, n in _blocks(a, b, True)]) / size if size else 1.0


def _as_words(*lists: list[str]) -> list[matching.Words]:
    codes: dict[str, int] = {}
    return [matching.Words(x, codes) for x in lists]


def _pick_pivot(keys: list[list[str]]) -> int:
    return _pivot(_as_words(*keys))


def _pivot(page: list[matching.Words]) -> int:
    """Reading with the highest summed ratio to all others, ties to the first.

    The longest common subsequence bounds a ratio from above, so a reading whose bound stays below the best sum found is
    not compared.
    """
    n = range(len(page))
    masks = [matching.bit_masks(r) for r in page]
    bound = [[1.0] * len(page) for _ in n]
    for i in n:
        for j in range(i):
            size = len(page[i].ids) + len(page[j].ids)
            if page[i].ids != page[j].ids and size:
                bound[i][j] = bound[j][i] = 2.0 * matching.most_in_common(page[i], masks[j], len(page[j].ids)) / size
    limit = [sum([bound[i][j] for j in n if j != i]) for i in n]
    best, best_sum = 0, -1.0
    for i in sorted(n, key=lambda r: (-limit[r], r)):
        if limit[i] < best_sum - 1e-9:
            break
        total, rest = 0.0, limit[i]
        for j in n:
            if j == i:
                continue
            if total + rest < best_sum - 1e-9:
                break
            total += 1.0 if page[i].ids == page[j].ids else _ratio(page[i], page[j])
            rest -= bound[i][j]
        else:
            if total > best_sum or (total == best_sum and i < best):
                best, best_sum = i, total
    return best


def _pair_up(pivot: list[str], other: list[str]):
    return _paired(*_as_words(pivot, other))


def _paired(pivot: matching.Words, other: matching.Words):
    """Index into ``other`` for every pivot position, plus the runs the pivot lacks as (gap, start, end)."""
    slots: list[int | None] = [None] * len(pivot.ids)
    gaps = []
    i = j = 0
    # words between two blocks are paired from the left
    for a, b, n in [*_blocks(pivot, other, False), (len(pivot.ids), len(other.ids), 0)]:
        paired = min(a - i, b - j)
        slots[i : i + paired] = range(j, j + paired)
        if b - j > paired:
            gaps.append((a, j + paired, b))
        slots[a : a + n] = range(b, b + n)
        i, j = a + n, b + n
    return slots, gaps


_INT = T.IntegerType()
_RUN = T.StructType([T.StructField(f, _INT) for f in ("gap", "ord", "lo", "hi")])
ALIGNED = T.StructType(
    [
        T.StructField("pivot", _INT),
        T.StructField("slots", T.ArrayType(T.ArrayType(_INT))),
        T.StructField("gaps", T.ArrayType(_RUN)),
    ]
)
TRACE = T.StructType(
    [
        T.StructField("edits", _INT),
        T.StructField("wrong", T.ArrayType(T.BooleanType())),
        T.StructField("wild", T.ArrayType(_INT)),
    ]
)


#: Words of the sequences that mark a place in two readings.
MARK = 4


def _unique_in_both(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of the sequences of MARK words that stand once in each, by place in a."""
    in_a, in_b = ([tuple(x[i : i + MARK]) for i in range(len(x) - MARK + 1)] for x in (a, b))
    count_a, count_b = Counter(in_a), Counter(in_b)
    at_b = {w: j for j, w in enumerate(in_b) if count_b[w] == 1}
    return [(i, at_b[w]) for i, w in enumerate(in_a) if count_a[w] == 1 and w in at_b]


def _stretches(n: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, length) of the stretches between marked places."""
    edges = np.concatenate([[-1], np.sort(marks), [n]])
    return edges[:-1] + 1, edges[1:], np.diff(edges) - 1


def safe_cuts(a: list[str], b: list[str], piece: int) -> list[tuple[int, int]]:
    """Places (i, j) at which both lists can be cut without changing how they align, about `piece` words apart.

    The alignment takes the longest common run, then goes on left and right of it.  A run is therefore taken whenever
    no run that conflicts with it (crosses it, or uses some of its words elsewhere) is as long.  Runs with a mark, a
    sequence of words unique in both lists, are all known; a run without one fits between marks in both lists.  A cut
    lies behind a run that is longer than every run of either kind that could conflict with it.
    """
    anchors = _unique_in_both(a, b)
    if not anchors:
        return []
    runs, reach = [], {}
    for i, j in anchors:
        if i < reach.get(j - i, 0):
            continue
        lo, hi = 0, MARK
        while i - lo > 0 and j - lo > 0 and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        runs.append((i - lo, j - lo, lo + hi))
        reach[j - i] = i + hi - MARK + 1
    start_a, start_b, size = np.array(sorted(runs)).T
    end_a, end_b = start_a + size, start_b + size
    marks = np.array(anchors)
    from_a, to_a, long_a = _stretches(len(a) - MARK + 1, marks[:, 0])
    from_b, to_b, long_b = _stretches(len(b) - MARK + 1, marks[:, 1])

    def safe(r: int) -> bool:
        other = np.arange(len(size)) != r
        crossing = ((start_a < end_a[r]) & (end_b > start_b[r])) & ((end_a > start_a[r]) | (start_b >= end_b[r]))
        crossing |= ((end_a > start_a[r]) & (start_b < end_b[r])) & ((end_b > start_b[r]) | (start_a >= end_a[r]))
        if size[crossing & other].max(initial=0) >= size[r]:
            return False
        before_a = long_a[from_a < end_a[r]].max(initial=0)
        after_a = long_a[to_a + MARK - 1 > start_a[r]].max(initial=0)
        before_b = long_b[from_b < end_b[r]].max(initial=0)
        after_b = long_b[to_b + MARK - 1 > start_b[r]].max(initial=0)
        return size[r] > max(min(before_a, after_b), min(after_a, before_b)) + MARK - 1

    cuts = []
    for target in range(piece, len(a), piece):
        near = np.flatnonzero(np.abs(end_a - target) < piece // 2)
        for r in near[np.argsort(-size[near], kind="stable")][:8]:
            place = (int(end_a[r]), int(end_b[r]))
            if place[0] < len(a) and place[1] < len(b) and (not cuts or (place[0] > cuts[-1][0] and place[1] > cuts[-1][1])) and safe(r):
                cuts.append(place)
                break
    return cuts


_CUT = T.StructType([T.StructField(f, _INT) for f in ("i", "j")])


def page_cuts(piece: int):
    """Column function: the cuts of (pivot keys, other keys), (0, 0) and the ends included."""

    @F.arrow_udf(T.ArrayType(_CUT))
    def cuts(pivot: pa.Array, other: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(pivot.to_pylist(), other.to_pylist()):
            places = [(0, 0), *safe_cuts(a, b, piece), (len(a), len(b))]
            rows.append([{"i": i, "j": j} for i, j in places])
        return pa.array(rows, to_arrow_type(T.ArrayType(_CUT)))

    return cuts


@F.arrow_udf(T.DoubleType())
def key_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sequence ratio of two key lists, as the choice of the pivot uses it."""
    return pa.array([_ratio(*_as_words(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(T.StructType([T.StructField("slots", T.ArrayType(_INT)), T.StructField("gaps", T.ArrayType(_RUN))]))
def align_piece(pivot: pa.Array, other: pa.Array) -> pa.Array:
    """Alignment of one piece of a reading to the same piece of the pivot."""
    rows = []
    for a, b in zip(pivot.to_pylist(), other.to_pylist()):
        slots, runs = _pair_up(a, b)
        rows.append({"slots": slots, "gaps": [{"gap": g, "ord": 0, "lo": lo, "hi": hi} for g, lo, hi in runs]})
    return pa.array(rows, to_arrow_type(T.StructType([T.StructField("slots", T.ArrayType(_INT)), T.StructField("gaps", T.ArrayType(_RUN))])))


def _lists(column: pa.Array) -> list[list]:
    """Rows of a list column; the values are taken out at once, which costs much less than row by row.  Null is empty."""
    values, out, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), [], 0
    for n in column.value_lengths().to_pylist():
        out.append(values[at : at + (n or 0)])
        at += n or 0
    return out


@F.arrow_udf(ALIGNED)
def align_page(keys: pa.Array) -> pa.Array:
    """Alignment of the readings of one page to their pivot; input is array<array<key>> in reader order."""
    rows, readings, at = [], _lists(keys.flatten()), 0
    for n in keys.value_lengths().to_pylist():
        page = _as_words(*readings[at : at + (n or 0)])
        at += n or 0
        p = _pivot(page) if len(page) > 1 else 0
        slots, gaps = [], []
        for r, other in enumerate(page):
            if r == p:
                slots.append(list(range(len(other.ids))))
                continue
            mine, runs = _paired(page[p], other)
            slots.append(mine)
            gaps += [{"gap": g, "ord": r, "lo": lo, "hi": hi} for g, lo, hi in runs]
        rows.append({"pivot": p, "slots": slots, "gaps": gaps})
    return pa.array(rows, to_arrow_type(ALIGNED))


def _pieces(word: str, d: int) -> list[tuple[int, str]]:
    """A word cut into d + 1 pieces, with the place of each; d edits leave one of them whole."""
    cuts = [i * len(word) // (d + 1) for i in range(d + 2)]
    return [(cuts[i], word[cuts[i] : cuts[i + 1]]) for i in range(d + 1)]


def within(a: str, b: str, d: int) -> bool:
    """Is the edit distance at most d, for a small d?  What both words begin with never costs an edit."""
    n, m, i = len(a), len(b), 0
    if abs(n - m) > d:
        return False
    while i < n and i < m and a[i] == b[i]:
        i += 1
    if i == n or i == m:
        return max(n, m) - i <= d
    if not d:
        return False
    a, b = a[i:], b[i:]
    return within(a[1:], b[1:], d - 1) or within(a[1:], b, d - 1) or within(a, b[1:], d - 1)


class NearWords:
    """The words of a page that differ from a given one by a small slip, found by a piece both share."""

    def __init__(self, words):
        self.index: dict[tuple[int, int, int, str], list[str]] = {}
        for w in words:
            # two edits are allowed where the longer word has more than eight letters
            for d in (1, 2) if 7 <= len(w) <= 8 else (1,) if len(w) < 7 else (2,):
                for at, piece in _pieces(w, d):
                    self.index.setdefault((d, len(w), at, piece), []).append(w)

    def find(self, word: str):
        n, seen = len(word), set()
        for m in range(n - 2, n + 3):
            d = 1 if max(n, m) <= 8 else 2
            if m < 1 or abs(n - m) > d:
                continue
            cuts = [i * m // (d + 1) for i in range(d + 2)]
            for at, to in zip(cuts, cuts[1:]):
                for start in range(max(0, at - d), min(n - (to - at), at + d) + 1):
                    for other in self.index.get((d, m, at, word[start : start + to - at]), ()):
                        if other not in seen:
                            seen.add(other)
                            if within(word, other, d):
                                yield other


def joined_key(a: str, b: str) -> str:
    """Key of two joined words, as `text.key` makes it."""
    word = a + b
    if X.UNREADABLE in word:
        return X.UNREADABLE
    kept = "".join([ch for ch in word.lower() if ch == "_" or unicodedata.category(ch)[0] in "LN"])
    return kept if any(ch == "_" or unicodedata.category(ch)[0] in "LN" for ch in word) else word


def joined_words(page: list[dict]) -> list[list[int] | None]:
    """Per reader of a page its words after joining: twice the place of a word, plus one where the next word is joined to
    it; None where nothing is joined.  A reader: toks, keys, word and plain (a word without digits) by place."""
    own = [{k for k, w in zip(r["keys"], r["word"]) if w} for r in page]
    writers = Counter(k for keys in own for k in keys)
    pairs = []
    for r in page:
        lone = [p and writers[k] == 1 for k, p in zip(r["keys"], r["plain"])]
        pairs.append([i for i in range(len(lone) - 1) if lone[i] and lone[i + 1]])
    near = NearWords([k for k in writers if len(k) >= 4]) if any(pairs) else None
    out: list[list[int] | None] = []
    for r, mine, places in zip(page, own, pairs):
        last, taken = -2, set()
        for i in places:
            if i == last + 1:  # its first word was used by the pair before it
                continue
            k = joined_key(r["toks"][i], r["toks"][i + 1])
            if len(k) >= 4 and any(writers[o] > (o in mine) for o in near.find(k)):
                taken.add(i)
                last = i
        out.append([2 * i + (i in taken) for i in range(len(r["toks"])) if i - 1 not in taken] if taken else None)
    return out


def with_joined(batches):
    """Batches whose last column, the readers, is replaced by their `joined_words`."""
    for batch in batches:
        readers = batch.column(batch.num_columns - 1)
        flat = readers.flatten()
        columns = {c: _lists(flat.field(c)) for c in ("toks", "keys", "word", "plain")}
        found, at = [], 0
        for n in readers.value_lengths().to_pylist():
            found.append(None if n is None else joined_words([{c: v[k] for c, v in columns.items()} for k in range(at, at + n)]))
            at += n or 0
        places = pa.array(found, pa.list_(pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], places], names=[*batch.schema.names[:-1], "__to"])


SUBSTITUTE, INSERT, DELETE = 0, 1, 2
WIDE = 50  # edits from which the exact distance is worth its time


def _moves(h: np.ndarray, r: np.ndarray, free: np.ndarray, width: int) -> tuple[int, list[np.ndarray]]:
    """Edit distance of h to r, and for every prefix of h the last move of the best path to each prefix of r.

    Only cells within `width` of the diagonal are filled; row i starts at column max(0, i - width).  On equal cost a
    substitution is taken before an insertion, that before a deletion.
    """
    far = len(h) + len(r) + 1
    # deleting reference words costs one each, illegible spots are free
    skip = np.concatenate(([0], np.cumsum(~free)))
    row, first, taken = skip[: min(len(r), width) + 1].astype(np.int64), 0, [np.empty(0, np.int8)]
    for i, word in enumerate(h, 1):
        lo, hi = max(0, i - width), min(len(r), i + width)
        # the row above, padded so that every column of this row finds its two neighbours
        above = np.full(hi - lo + 2, far, np.int64)
        a, b = max(lo - 1, first), min(hi + 1, first + len(row))
        above[a - lo + 1 : b - lo + 1] = row[a - first : b - first]
        inserted = above[1:] + 1
        cols = np.arange(lo, hi + 1) - 1
        cost = np.where(cols >= 0, (r[cols] != word) & ~free[cols], True) if len(r) else np.ones(hi - lo + 1, bool)
        swapped = above[:-1] + cost
        swapped[cols < 0] = far
        row = np.minimum.accumulate(np.minimum(inserted, swapped) - skip[lo : hi + 1]) + skip[lo : hi + 1]
        taken.append(np.where(row == swapped, SUBSTITUTE, np.where(row == inserted, INSERT, DELETE)).astype(np.int8))
        first = lo
    return int(row[-1]), taken


def edit_trace(hyp: list[str], ref: list[str]) -> tuple[int, list[bool], list[int]]:
    """Word edits, wrong flag per hypothesis word, hypothesis words matched to an illegible spot.

    Of as many words on both sides, those that differ by position are the edits if none of them stands on the other side
    among them: the words in common bound the distance from below, and the path along the diagonal is the one preferred.
    Otherwise equal words at the end always lie on the optimal path, so they are peeled off; the rest is solved in a
    band that a bound, the exact distance if that is wide, proves wide enough.
    """
    if len(hyp) == len(ref) and X.WILD not in ref:
        off = [a != b for a, b in zip(hyp, ref)]
        if {a for a, o in zip(hyp, off) if o}.isdisjoint([b for b, o in zip(ref, off) if o]):
            return sum(off), off, []
    n, m = len(hyp), len(ref)
    wrong, wild = [True] * n, []
    while n and m and hyp[n - 1] == ref[m - 1] and ref[m - 1] != X.WILD:
        n, m = n - 1, m - 1
        wrong[n] = False
    codes: dict[str, int] = {X.WILD: -1}
    h = np.array([codes.setdefault(w, len(codes)) for w in hyp[:n]], dtype=np.int64)
    h[h == -1] = -2  # a literal marker in a reading is an ordinary word
    r = np.array([codes.setdefault(w, len(codes)) for w in ref[:m]], dtype=np.int64)
    free = r == -1
    k = min(n, m)
    bound = int(np.sum((h[:k] != r[:k]) & ~free[:k])) + abs(n - m)
    if bound > WIDE and not free.any():
        bound = code_distance(hyp[:n], ref[:m])
    width = bound + int(free.sum()) + 1
    edits, taken = _moves(h, r, free, width)
    column = m
    for i in range(n, 0, -1):
        moves, first = taken[i], max(0, i - width)
        while column and moves[column - first] == DELETE:
            column -= 1
        if column and moves[column - first] == SUBSTITUTE:
            column -= 1
            wrong[i - 1] = bool(not free[column] and h[i - 1] != r[column])
            if free[column]:
                wild.append(i - 1)
    return edits, wrong, sorted(wild)


@F.arrow_udf(TRACE)
def align_wild(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    rows = []
    for h, r in zip(hyp.to_pylist(), ref.to_pylist()):
        edits, wrong, wild = edit_trace(h or [], r or [])
        rows.append({"edits": edits, "wrong": wrong, "wild": wild})
    return pa.array(rows, to_arrow_type(TRACE))


def bit_distance(a: str, b: str) -> int:
    """Edit distance of two long texts, bit-parallel: a column of the table is two integers with a bit for each letter of
    `a` (the cell below is one more, or one less), so a step for each letter of `b` costs len(a) / 64 machine words.
    What both texts share at either end is left out."""
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    tail = 0
    for x, y in zip(reversed(a[lead:]), reversed(b[lead:])):
        if x != y:
            break
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, list[int]] = {}
    for i, ch in enumerate(a):
        places.setdefault(ch, []).append(i)
    masks = {}
    for ch, at in places.items():
        if ch in b:
            bits = np.zeros(len(a), np.uint8)
            bits[at] = 1
            masks[ch] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, distance = every, 0, len(a)
    for ch in b:
        same = masks.get(ch, 0)
        diagonal = (((same & more) + more) ^ more) | same | less
        up = less | (every & ~(diagonal | more))
        down = more & diagonal
        distance += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        down <<= 1
        more = (down | ~(diagonal | up)) & every
        less = up & diagonal & every
    return distance


def code_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two word lists: every distinct word is one letter, outside the surrogates."""
    codes: dict[str, str] = {}
    x, y = ("".join([codes.setdefault(w, chr(len(codes) + (len(codes) >= 0xD800) * 0x800)) for w in words]) for words in (a, b))
    return bit_distance(x, y)


@F.arrow_udf(T.IntegerType())
def word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else code_distance(x, y) for x, y in pairs], pa.int32())


def _packed(a: str, b: str) -> tuple[np.ndarray, np.ndarray, int]:
    """At every place of each text the next letters as one number, and the bits of a letter.  Letters are numbered over
    both texts; what stands behind the ends never matches."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b)]
    letters, both = np.unique(np.concatenate(codes), return_inverse=True)
    kind = np.uint8 if len(letters) < 254 else np.uint16 if len(letters) < 65_534 else np.uint32
    step = 8 // np.dtype(kind).itemsize
    out = []
    for end, part in enumerate((both[: len(codes[0])], both[len(codes[0]) :])):
        padded = np.full(len(part) + step, end, kind)
        padded[: len(part)] = part + 2
        windows = np.lib.stride_tricks.sliding_window_view(padded, step)
        out.append(np.ascontiguousarray(windows).view(np.uint64).ravel())
    return out[0], out[1], 64 // step


TABLE_CELLS = 1_000_000  # places of the diagonals up to which a table of them is made


def near_distance(x: np.ndarray, y: np.ndarray, bits: int, most: int) -> int | None:
    """Edit distance of two packed texts if it is at most `most`: the furthest place on each diagonal that such a path can
    use, edit by edit.  Takes about `most` squared steps, however long the texts are."""
    n, m, step = len(x) - 1, len(y) - 1, 64 // bits
    shift = m - n
    if abs(shift) > most:
        return None
    spare = (most - abs(shift)) // 2
    diagonal = np.arange(min(0, shift) - spare, max(0, shift) + spare + 1)
    zero, end, rows = -int(diagonal[0]), np.minimum(n, m - diagonal), np.arange(len(diagonal))
    stop = None
    if n * len(diagonal) <= TABLE_CELLS:
        # of a short text the first place at or behind i where a diagonal differs is looked up
        letters = np.full(n + len(diagonal) + m, -1, np.int64)
        mask = np.uint64((1 << bits) - 1)
        letters[zero : zero + m] = y[:m] & mask
        differ = np.lib.stride_tricks.sliding_window_view(letters[: n + len(diagonal) - 1], n)[: len(diagonal)] != (x[:n] & mask).astype(np.int64) if n else np.zeros((len(diagonal), 0), bool)
        stop = np.full((len(diagonal), n + 1), n, np.int32)
        stop[:, :n] = np.where(differ, np.arange(n, dtype=np.int32), np.int32(n))
        stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    never = -2 * most - 2
    far = np.full(len(diagonal), never)
    best = far.copy()
    best[zero] = 0
    for edits in range(most + 1):
        if edits:
            best = far + 1
            best[1:] = np.maximum(best[1:], far[:-1])
            best[:-1] = np.maximum(best[:-1], far[1:] + 1)
            best = np.minimum(best, end)
        if stop is not None:
            best = np.where(best < 0, never, stop[rows, np.maximum(best, 0)])
        else:
            at = np.flatnonzero(best >= 0)
            i = best[at]
            j = i + diagonal[at]
            while len(at):
                other = x[i] ^ y[j]
                same = np.bitwise_count((other & (~other + np.uint64(1))) - np.uint64(1)) // bits
                best[at] += same
                on = same == step
                at, i, j = at[on], i[on] + step, j[on] + step
            best = np.where(best < 0, never, best)
        far = best
        if far[shift + zero] == n:
            return edits
    return None


def long_distance(a: str, b: str, bound: int | None) -> int:
    """Edit distance of two texts, `bound` being an upper bound where one is known; else the number of edits looked for
    doubles.  Texts with little in common take the bit-parallel distance."""
    x, y, bits = _packed(a, b)
    most = abs(len(x) - len(y)) + 32 if bound is None else bound
    while most <= 64 + len(x) // 16:
        found = near_distance(x, y, bits, most)
        if found is not None:
            return found
        most *= 2
    return bit_distance(a, b)


@F.arrow_udf(T.IntegerType())
def text_distance(a: pa.Array, b: pa.Array, bound: pa.Array) -> pa.Array:
    rows = zip(a.to_pylist(), b.to_pylist(), bound.to_pylist())
    return pa.array([None if x is None or y is None else long_distance(x, y, k) for x, y, k in rows], pa.int32())
