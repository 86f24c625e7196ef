"""Whitening of embeddings by a bidiagonal qd solver.

Each entry c becomes the whole number x = floor(64 c) + 1,000,000, so sums over
all rows are exact and a centred entry (n x - S) / n is rounded once.

1. Every task reduces its centred rows block by block to one triangular factor
   R (Householder QR); factors are stacked and reduced again, 16 to a task,
   until the driver can stack the last ones: R'R is n times the covariance.
   The covariance itself, which squares the condition number, is never formed.
2. R is brought to bidiagonal form by Householder reflections.
3. dqds with shifts that are never above the smallest value left finds the
   squared singular values to high relative accuracy.
4. A twisted factorisation of B'B - s I for each value s gives its vector
   directly, at the row where the factorisation is most singular; vectors of
   close values are made orthogonal.  The reflections carry them back.

What reaches the driver is bounded by the dimension d: d sums, 16 factors of
d x d and 16 sums of c x c products.

Results: a row whose vector is null or holds null or non-finite entries is left
out; of vectors of several lengths those of the most frequent length (the
longer, when equally frequent) are fitted and returned; components of no
variance (to rounding) are left out, so vectors that are all equal, or empty,
give no rows; x is limited to the range of long; ``deviation`` is null where it
does not fit in a long; a direction's entry of largest size is positive;
repeated rows and null ids are kept; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouch.llm.common import small_batches, written

SCALE, OFFSET = 64, 1_000_000
_EPS = 2.0 ** -52
#: Factors that one task (and at the end the driver) merges.
_FAN_IN = 16
_SAFE = 1 << 62
_LONG = (1 << 63) - 1

SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


# ----------------------------------------------------------------------
# rows to blocks
# ----------------------------------------------------------------------
def whole_numbers(flat: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 as int64, limited to the range of long."""
    scaled = np.floor(flat * float(SCALE))
    inside = np.clip(scaled, -(2.0 ** 62), 2.0 ** 62)
    out = inside.astype(np.int64) + OFFSET
    if (far := scaled != inside).any():
        for i in np.flatnonzero(far):
            out[i] = min(max(int(scaled[i]) + OFFSET, -_LONG - 1), _LONG)
    return out


def _block(batch, dim: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat.astype(np.float64)).reshape(-1, dim)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they surely fit, else in Python's whole numbers."""
    if n * _largest(x) + max(map(abs, sums)) < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(exact: np.ndarray, n: int) -> np.ndarray:
    return (exact / n).astype(np.float64)


def _deviations(exact: np.ndarray) -> list[int | None]:
    if exact.dtype != object:
        size = _largest(exact)
        if size * size * exact.shape[1] < _SAFE:
            return (exact * exact).sum(axis=1).tolist()
        exact = exact.astype(object)
    return [v if v <= _LONG else None for v in (exact * exact).sum(axis=1).tolist()]


def _sums(dim: int):
    def run(batches):
        total, n = [0] * dim, 0
        for b in batches:
            x = _block(b, dim)
            n += len(x)
            part = x.sum(axis=0) if _largest(x) * max(len(x), 1) < _SAFE else x.astype(object).sum(axis=0)
            total = [a + int(p) for a, p in zip(total, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["d", "s"])

    return run


# ----------------------------------------------------------------------
# blockwise QR and its merging
# ----------------------------------------------------------------------
def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _factors(dim: int, fit):
    def run(batches):
        n, sums = fit.value
        r = np.empty((0, dim))
        for b in batches:
            r = triangle(np.vstack([r, _centred(_exact(_block(b, dim), n, sums), n)]))
        if len(r):
            yield _piece(r)

    return run


def _piece(a: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([a.astype("<f8").tobytes()], pa.binary())], ["piece"])


def _gathered(pieces: DataFrame, combine, name: str) -> np.ndarray | None:
    """All pieces (one a task) combined, at most 16 of them in one place at a time."""

    def merge(batches):
        got = None
        for b in batches:
            for raw in b.column("piece").to_pylist():
                a = np.frombuffer(raw, "<f8")
                got = a if got is None else combine(got, a)
        if got is not None:
            yield _piece(got)

    pieces = written(pieces, name)
    n = pieces.count()
    while n > _FAN_IN:
        pieces = written(pieces.repartition(-(-n // _FAN_IN)).mapInArrow(merge, "piece binary"), name)
        n = pieces.count()
    got = None
    for row in pieces.collect():
        a = np.frombuffer(row["piece"], "<f8")
        got = a if got is None else combine(got, a)
    return got


# ----------------------------------------------------------------------
# the bidiagonal solver (d x d, on the driver)
# ----------------------------------------------------------------------
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with R = U B V', by Householder reflections."""
    m = r.astype(np.float64).copy()
    d = m.shape[1]
    v = np.eye(d)
    for k in range(d):
        w = _reflector(m[k:, k])
        if w is not None:
            m[k:, k:] -= np.outer(w, 2.0 * (w @ m[k:, k:]))
        if k < d - 2:
            w = _reflector(m[k, k + 1:])
            if w is not None:
                m[k:, k + 1:] -= np.outer(2.0 * (m[k:, k + 1:] @ w), w)
                v[:, k + 1:] -= np.outer(2.0 * (v[:, k + 1:] @ w), w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector w for which (1 - 2ww')x is a multiple of the first axis."""
    size = np.linalg.norm(x)
    if size == 0.0 or not np.any(x[1:]):
        return None
    w = x.copy()
    w[0] += math.copysign(size, x[0])
    return w / np.linalg.norm(w)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float]:
    """One dqds step: the new q and e, the least and the reciprocal sum of its d."""
    n, d = len(q), q[0] - shift
    least, inverse, q2, e2 = d, 0.0, [], []
    for k in range(n - 1):
        inverse += 1.0 / d if d > 0.0 else math.inf
        top = d + e[k]
        if top <= 0.0:
            return q2, e2, -1.0, math.inf
        ratio = q[k + 1] / top
        q2.append(top)
        e2.append(e[k] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    inverse += 1.0 / d if d > 0.0 else math.inf
    q2.append(d)
    return q2, e2, least, inverse


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> list[float]:
    """All squared singular values of an unreduced bidiagonal block, by dqds.

    After a step without a shift the smallest value left is at least the
    reciprocal of the sum of 1/d, so this shift keeps every d positive; should
    rounding push one below zero, the step is taken again with half the shift.
    """
    q, e = [float(x) ** 2 for x in a], [float(x) ** 2 for x in b]
    out, total = [], 0.0
    for _ in range(100 * len(q) + 100):  # three to six steps a value are usual
        n = len(q)
        if n == 1:
            out.append(total + q[0])
            return out
        if e[-1] <= (_EPS / 4) ** 2 * 16 * q[-1] or e[-1] <= _EPS / 8 * (total + q[-1]) * 1e-4:
            out.append(total + q[-1])
            q, e = q[:-1], e[:-1]
            continue
        if min(q) <= 0.0:  # a value of zero: one step moves it to the end
            q, e, _least, _inv = _sweep([max(x, 1e-300) for x in q], e, 0.0)
            q[-1] = max(q[-1], 0.0)
            if q[-1] <= 1e-290:
                out.append(total)
                q, e = q[:-1], e[:-1]
            continue
        _q, _e, _least, inverse = _sweep(q, e, 0.0)
        shift = 1.0 / inverse if inverse < math.inf else 0.0
        shift *= 1.0 - 8 * _EPS * n
        while True:
            q2, e2, least, _inv = _sweep(q, e, shift)
            if least >= 0.0 and len(q2) == n:
                break
            shift = shift / 2 if shift > 1e-3 * _EPS * (total + min(q)) else 0.0
        q, e, total = q2, e2, total + shift
    raise ArithmeticError("dqds does not end")


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector z with (B'B - value) z = gamma_r e_r, z_r = 1, normalised, for the
    row r of least |gamma|: the top-down and the bottom-up factorisation of
    B'B - value, joined at row r."""
    n = len(a)
    d = a * a
    l = np.append(b / a[:-1], 0.0)
    tiny = _EPS * _EPS * (abs(value) + float(d.max()) * _EPS + 1e-290)
    s, down = np.empty(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if abs(plus) > tiny else -tiny
        down[i] = d[i] * l[i] / plus
        s[i + 1] = down[i] * l[i] * s[i] - value
    p, up, gamma = np.empty(n), np.zeros(n), np.empty(n)
    p[n - 1] = d[n - 1] - value
    gamma[n - 1] = s[n - 1] + d[n - 1]
    for i in range(n - 2, -1, -1):
        minus = d[i] * l[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > tiny else -tiny
        t = d[i] / minus
        up[i] = l[i] * t
        p[i] = p[i + 1] * t - value
        gamma[i] = s[i] + t * p[i + 1]
    r = int(np.abs(gamma).argmin())
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z made orthogonal to unit vectors, normalised, and the share of it that was left."""
    size, left = float(np.linalg.norm(z)), 0.0
    for step in range(2):
        for c in others:
            z = z - (c @ z) * c
        left = float(np.linalg.norm(z))
        if left == 0.0:
            return z, 0.0
        if step == 0:
            share = left / size
        z = z / left
    return z, share


def _inverse_vector(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """Where values agree to rounding, twisted vectors coincide: inverse iteration
    from a vector orthogonal to those found."""
    t = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t[np.arange(1, len(a)), np.arange(1, len(a))] += b * b
    t -= np.eye(len(a)) * value * (1.0 + 16 * _EPS)
    z = _apart(np.cos(np.arange(len(a)) * (1.0 + len(others))), others)[0]
    for _ in range(4):
        z = _apart(np.linalg.solve(t + np.eye(len(a)) * _EPS * _EPS * value, z), others)[0]
    return z


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(squared singular values, unit right vectors as columns, sum of all squared
    values) of R, the largest ``most`` of those above rounding."""
    a, b, v = bidiagonal(r)
    d = len(a)
    size = max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)))
    if size == 0.0:
        return np.empty(0), np.empty((d, 0)), 0.0
    a = np.where(np.abs(a) < _EPS ** 2 * size, _EPS ** 2 * size, a)
    b = np.where(np.abs(b) <= _EPS * size, 0.0, b)  # R itself is not more exact than that
    found = []
    for block in np.split(np.arange(d), np.flatnonzero(b == 0.0) + 1):  # where b is zero, B falls apart
        ab, bb = a[block], b[block[:-1]]
        found += [(s, block) for s in squared_singular_values(ab, bb)]
    found.sort(key=lambda f: -f[0])
    total = math.fsum(f[0] for f in found)
    floor = (8 * d * _EPS) ** 2 * found[0][0]
    values, columns = [], []
    for s, block in [f for f in found if f[0] > floor][:most]:
        close = [c[block] for t, o, c in columns if o is block and abs(t - s) <= 1e-3 * s]
        best, kept = np.ones(1), 1.0
        if len(block) > 1:
            best, kept = _apart(twisted_vector(a[block], b[block[:-1]], s), close)
        if kept < 0.1:
            best = _inverse_vector(a[block], b[block[:-1]], s, close)
        whole = np.zeros(d)
        whole[block] = best
        values.append(s)
        columns.append((s, block, whole))
    out = v @ np.array([c for _s, _o, c in columns]).T
    out /= np.linalg.norm(out, axis=0)
    peak = out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])]
    return np.array(values), out * np.where(peak < 0, -1.0, 1.0), total


# ----------------------------------------------------------------------
# whitened rows
# ----------------------------------------------------------------------
def _spread(parts: int):
    """Count, mean and centred products of whitened blocks, joined pairwise."""

    def combine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x[0], y[0]
        step = y[1:parts + 1] - x[1:parts + 1]
        mean = x[1:parts + 1] + step * (m / (n + m))
        products = x[parts + 1:] + y[parts + 1:] + np.outer(step, step).reshape(-1) * (n * m / (n + m))
        return np.concatenate([[n + m], mean, products])

    return combine


def _products(dim: int, fit, model):
    def run(batches):
        n, sums = fit.value
        scaled, _explained = model.value
        combine, got = _spread(scaled.shape[1]), None
        for b in batches:
            w = _centred(_exact(_block(b, dim), n, sums), n) @ scaled
            if len(w):
                mean = w.mean(axis=0)
                c = w - mean
                one = np.concatenate([[float(len(w))], mean, (c.T @ c).reshape(-1)])
                got = one if got is None else combine(got, one)
        if got is not None:
            yield _piece(got)

    return run


def _rows(dim: int, fit, model, error: float):
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        n, sums = fit.value
        scaled, explained = model.value
        k = scaled.shape[1]
        for b in batches:
            exact = _exact(_block(b, dim), n, sums)
            w = _centred(exact, n) @ scaled
            rows = len(w)
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                pa.array(_deviations(exact), pa.int64()).take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error))], names)

    return run


def whitened(embeddings: DataFrame, most: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector and component (numbered from 1 by falling variance,
    ``most`` at most): n, deviation (sum of (n x - S)^2), whitened, explained
    (share of the whole variance), identity_error (largest entry of the whitened
    covariance minus the identity, over all rows)."""
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x))
    rows = rows.filter(F.col("vector").isNotNull() & finite)
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.agg(F.max(F.struct("n", "dim")).alias("t")).first()["t"]  # one row
    if top is None or top["dim"] == 0:
        return spark.createDataFrame([], SCHEMA)
    dim = top["dim"]
    rows = rows.filter(F.size("vector") == dim)

    parts = rows.mapInArrow(_sums(dim), "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = {r["d"]: int(r["s"]) for r in parts.collect()}
    n = sums.pop(-1)
    fit = spark.sparkContext.broadcast((n, [sums[i] for i in range(dim)]))

    def stacked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return triangle(np.vstack([x.reshape(-1, dim), y.reshape(-1, dim)])).reshape(-1)

    r = _gathered(rows.mapInArrow(_factors(dim, fit), "piece binary"), stacked, "whitening-factors").reshape(-1, dim)
    r = np.vstack([r, np.zeros((dim - len(r), dim))])
    values, vectors, total = directions(r, most)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    model = spark.sparkContext.broadcast((vectors / np.sqrt(values / n), values / total))
    k = len(values)
    spread = _gathered(rows.mapInArrow(_products(dim, fit, model), "piece binary"), _spread(k), "whitening-products")
    error = float(np.abs(spread[k + 1:].reshape(k, k) / n - np.eye(k)).max())
    return rows.mapInArrow(_rows(dim, fit, model, error), SCHEMA)
