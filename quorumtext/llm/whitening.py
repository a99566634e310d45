"""Embedding whitening: exact integer covariance by Spark, float32 eigenvectors refined in higher precision.

The refinement is the matrix-multiplication iteration of Ogita and Aishima (2018, 2019): from approximate eigenvectors
X of a symmetric A it forms R = I - X'X and S = X'AX, reads eigenvalues and a correction off their entries, and doubles
the number of right digits a round.  Where eigenvalues lie closer than the error allows, the part of X that spans them
is solved again as a small shifted problem of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.common import written

SCALE = 256
#: Sums leave a task in two decimal digits of this base, so that none can overflow.
LIMB = 10**18
#: Entries of one numpy block.
BLOCK = 1 << 20
WIDE = np.longdouble


def clean_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector is not null and holds only finite numbers, as whole multiples of 1 / 256 rounded
    down.  Numbers beyond the range of long stop at its ends."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(2**63 - 1024)
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(top)), F.lit(-top))
    return table.where(v.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(held(c)).cast("long")).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with vectors of one width: (batch, row numbers, matrix of long)."""
    for batch in batches:
        x = batch.column("x")
        sizes = np.diff(x.offsets.to_numpy())
        flat, first = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()[:-1]
        for width in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == width)
            for k in range(0, len(at), max(1, BLOCK // width)):
                rows = at[k : k + max(1, BLOCK // width)]
                yield batch, rows, flat[first[rows][:, None] + np.arange(width)]


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers; by floating point where every partial sum is a whole number below 2^53."""
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else max((abs(v) for v in y.flat), default=0)
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _sums(fit: DataFrame, centre: dict[int, list[int]] | None) -> dict[int, tuple[int, np.ndarray]]:
    """width -> (rows, sums): sums of the vectors, or with `centre` sums of products of all pairs of dimensions of the
    vectors less their centre.  Whole numbers throughout, so neither order nor reruns matter.  Tasks add up their own
    rows, Spark adds up the tasks by entry; the driver gets one row an entry, which the width alone bounds."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for _, at, x in _blocks(batches):
            width = x.shape[1]
            if centre is None:
                big = np.abs(x.astype(np.float64)).max() * len(x) < 2.0**62
                got = (x.sum(0) if big else x.astype(object).sum(0)).astype(object)
            else:
                mid = centre[width]
                near = np.abs(x.astype(np.float64)).max() < 2.0**61 and max(map(abs, mid)) < 1 << 61
                got = _exact_products(x - np.array(mid, np.int64) if near else x.astype(object) - np.array(mid, object))
            rows[width] = rows.get(width, 0) + len(at)
            total[width] = got + total[width] if width in total else got
        for width, t in total.items():
            flat = [int(v) for v in t.ravel()]
            for k in range(0, len(flat), 1 << 16):
                piece = flat[k : k + (1 << 16)]
                cols = [pa.array([width] * len(piece), pa.int64()), pa.array(range(k, k + len(piece)), pa.int64())]
                cols.append(pa.array([rows[width]] * len(piece), pa.int64()))
                cols += [pa.array(list(map(Decimal, limb)), pa.decimal128(38, 0)) for limb in zip(*(divmod(v, LIMB) for v in piece))]
                yield pa.RecordBatch.from_arrays(cols, names=["width", "entry", "n", "hi", "lo"])

    schema = "width long, entry long, n long, hi decimal(38,0), lo decimal(38,0)"
    got = fit.mapInArrow(part, schema).groupBy("width", "entry").agg(*[F.sum(c).alias(c) for c in ("n", "hi", "lo")])
    out: dict[int, tuple[int, dict]] = {}
    for width, entry, n, hi, lo in got.collect():  # one row an entry
        out.setdefault(width, (n, {}))[1][entry] = int(hi) * LIMB + int(lo)
    return {w: (n, np.array([e[i] for i in range(len(e))], object)) for w, (n, e) in out.items()}


def _wide(f: Fraction) -> np.longdouble:
    """The fraction in extended precision: its double, and the double of what that leaves."""
    head = float(f)
    return WIDE(head) + WIDE(float(f - Fraction(head)))


def refine(a: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the symmetric matrix `a` (extended precision), by falling eigenvalue.

    Starts from float32 eigenvectors.  Each round applies the correction of Ogita and Aishima; runs of eigenvalues that
    lie closer than their bound are then solved again inside their own span, shifted by their mean and scaled, which
    splits them as far as `a` tells them apart.  Ends when no correction exceeds the last bits of extended precision, or
    stops falling.
    """
    a = np.asarray(a, WIDE)
    scale = np.abs(a).max(initial=0)
    d = len(a)
    if scale == 0:
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE)
    m = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(m.astype(np.float32))[1][:, ::-1].astype(WIDE)
    eye, norm = np.eye(d, dtype=WIDE), np.linalg.norm(m.astype(np.float64), 2)
    bits, last = float(np.finfo(WIDE).eps), math.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ (m @ x)
        s = (s + s.T) / 2  # a correction must turn the vectors, and not stretch them
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.linalg.norm(off.astype(np.float64), "fro") + norm * np.linalg.norm(r.astype(np.float64), "fro"))
        near = max(near, 1000 * d * bits * norm)  # closer than this, rounding alone would decide the correction
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > near
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ step
        order = np.argsort(-values, kind="stable")
        x, ranked = x[:, order], values[order]
        cut = np.flatnonzero(-np.diff(ranked) > near) + 1
        for run in np.split(np.arange(d), cut):
            if len(run) > 1:
                own = x[:, run]
                mid = ranked[run].mean()
                inner = own.T @ (m @ own) - mid * (own.T @ own)
                size = np.abs(inner).max()
                if np.abs(inner - np.diag(np.diag(inner))).max() > 4 * d * bits * norm:
                    turn = np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(np.float64))[1][:, ::-1]
                    x[:, run] = own @ turn.astype(WIDE)
        change = float(np.abs(np.where(far, step, r / 2)).max())
        if change <= 4 * bits or (change < 1e-6 and change > last / 2):
            break
        last = change
    r, s = eye - x.T @ x, x.T @ (m @ x)
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    top = np.abs(x).argmax(0)
    return values[order] * scale, x * np.sign(x[top, np.arange(d)])


@dataclass
class Space:
    """What one width needs: number of fit vectors, their sums, components (columns) and eigenvalues, and how far the
    whitened fit vectors are from unit covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    error: float | None = None
    width: int = field(init=False)

    def __post_init__(self):
        self.width = len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of `x` less the mean, on each component over the root of its eigenvalue; nan where that is 0."""
        mid = np.array([_wide(Fraction(s, self.n)) for s in self.sums])
        centred = (x.astype(WIDE) - mid).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sums)^2, exactly: long arithmetic is exact modulo 2^64, and a rough sum tells whether the
        true one fits.  Null where it does not."""
        rough = ((self.n * x.astype(np.float64) - np.array(self.sums, np.float64)) ** 2).sum(1)
        if max(abs(s) for s in self.sums) < 1 << 63 and self.n < 1 << 63:
            with np.errstate(over="ignore"):
                d = np.int64(self.n) * x - np.array(self.sums, np.int64)
                out = (d * d).sum(1)
        else:
            out = np.zeros(len(x), np.int64)
            rough[:] = np.inf
        result = out.tolist()
        for i in np.flatnonzero(rough > 2.0**62):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            result[i] = exact if exact < 1 << 63 else None
        return result


def fit_spaces(vectors: DataFrame, components: int = 4) -> dict[int, Space]:
    """width -> Space from (vec_id, x).  Equal vectors meet by a grouping that combines inside each task first, so a
    vector that a third of the rows share is one row a task; the distinct ones are written once and read three times."""
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    spaces: dict[int, Space] = {}
    first = _sums(fit, None)
    if not first:
        return spaces
    # whole numbers next to the means: what is left of the mean is below one half and goes by an exact correction
    centre = {w: [round(Fraction(int(s), n)) for s in t] for w, (n, t) in first.items()}
    for width, (n, t) in _sums(fit, centre).items():
        sums = [int(s) for s in first[width][1]]
        rest = [s - n * c for s, c in zip(sums, centre[width])]
        cov = np.array([_wide(Fraction(int(t[i * width + j]) * n - rest[i] * rest[j], n * n)) for i in range(width) for j in range(width)], WIDE)
        values, x = refine(cov.reshape(width, width))
        trace = cov.reshape(width, width).trace()
        # an eigenvalue within rounding of zero belongs to a direction without variance
        values = np.where(values > width * np.finfo(np.float64).eps * values.max(initial=0), values, 0)
        k = min(components, width)
        spaces[width] = Space(
            n, sums, x[:, :k].astype(np.float64), values[:k].astype(np.float64), [float(v / trace) if trace > 0 else None for v in values[:k]]
        )
    for width, e in _identity_errors(fit, spaces).items():
        spaces[width].error = e
    return spaces


def _identity_errors(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Largest entry of the covariance of the whitened fit vectors less the identity, measured on all of them: blocks
    are centred on their own mean before multiplying, and merged pairwise."""

    def part(batches):
        state: dict[int, tuple] = {}
        for _, _, x in _blocks(batches):
            width = x.shape[1]
            w = spaces[width].whiten(x)[:, spaces[width].values > 0]
            mid = w.mean(0)
            state[width] = _merge(state.get(width), (len(w), mid, (w - mid).T @ (w - mid)))
        rows = [(width, n, mid.tolist(), m.ravel().tolist()) for width, (n, mid, m) in state.items()]
        if rows:
            names = ["width", "n", "mid", "m"]
            types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # `components` squared numbers a task and width; tasks are merged by Spark down to one row for 256 of them
    got = fit.mapInArrow(part, "width long, n long, mid array<double>, m array<double>")
    got = got.withColumn("part", F.spark_partition_id() % 64).groupBy("width", "part").applyInPandas(_merge_rows, "width long, n long, mid array<double>, m array<double>")
    out: dict[int, tuple] = {}
    for width, n, mid, m in sorted(got.collect()):
        k = len(mid)
        out[width] = _merge(out.get(width), (n, np.array(mid), np.array(m).reshape(k, k)))
    return {w: float(np.abs(m / n - np.eye(len(mid))).max()) for w, (n, mid, m) in out.items() if len(mid)}


def _merge(a: tuple | None, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _merge_rows(rows: pd.DataFrame) -> pd.DataFrame:
    state = None
    for n, mid, m in sorted(zip(rows["n"], map(tuple, rows["mid"]), map(tuple, rows["m"]))):
        state = _merge(state, (n, np.array(mid), np.array(m).reshape(len(mid), len(mid))))
    return pd.DataFrame({"width": [rows["width"].iloc[0]], "n": [state[0]], "mid": [state[1].tolist()], "m": [state[2].ravel().tolist()]})


def whiten(vectors: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of (vec_id, x) and each of the
    first components of its width.

    The covariance is that of the distinct vectors.  Vectors of another width are a space of their own, with its own
    `n`; a vector without entries has no component and gives no row.  A component without variance (equal vectors
    only, or fewer vectors than dimensions) keeps its rows with `whitened` null; `explained` and `identity_error` are
    null where nothing varies.  A deviation beyond long is null.  Rows that repeat, and null ids, keep their rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _blocks(batches):
            s = spaces[x.shape[1]]
            w, k = s.whiten(x), len(s.explained)
            each = np.repeat(np.arange(len(at)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array([s.n] * len(each), pa.int64()),
                    pa.array(s.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel())),
                    pa.array(s.explained * len(at), pa.float64()),
                    pa.array([s.error] * len(each), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.mapInArrow(part, schema)
