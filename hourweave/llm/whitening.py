"""Whitening of embeddings: leading principal components at unit variance.

Spark reduces all distinct vectors to their covariance (products of centred numbers, summed per pair of
dimensions); the matrix, whose size depends on the dimension alone, is then taken apart on the driver:
Householder reflections to a tridiagonal matrix, bisection by Sturm counts for the leading eigenvalues, inverse iteration
with orthogonalisation inside clusters of close eigenvalues for the vectors. The components
go to the tasks, which project their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourweave.session import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Dimensions a vector may have: bounds the matrix on the driver (8 bytes times its square).
MAX_DIMENSION = 2048
#: Lengths of vectors that may occur together; each is whitened on its own.
MAX_LENGTHS = 64
#: Components of less variance than this share of the whole are taken as absent.
LEAST_SHARE = 1e-10
_ROWS = 4096
_HALF = 1 << 32
#: Codes beyond this saturate, so that differences stay within 64 bits.
_MOST = 1 << 61


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q of Q T Q' = a, by Householder reflections."""
    a = np.array(a, float)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or norm == abs(x[0]):
            continue
        v = x.copy()
        v[0] += np.copysign(norm, x[0])
        v /= np.linalg.norm(v)
        # both sides at once: a - v w' - w v'
        part = a[k + 1 :, k + 1 :]
        p = part @ v
        w = 2 * (p - (p @ v) * v)
        part -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _above(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvalues greater than each x: signs in the Sturm sequence of T - x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = d[0] - x
    count = (pivot > 0).astype(int)
    for i in range(1, len(d)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d[i] - x - e[i - 1] ** 2 / pivot
        count += pivot > 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bits."""
    reach = np.abs(np.r_[e, 0]) + np.abs(np.r_[0, e])
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    room = 4 * np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - room, high + room
    wanted = np.arange(k)
    for _ in range(120):
        middle = (low + high) / 2
        more = _above(d, e, middle) > wanted
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    return (low + high) / 2


def _solve(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - x) y = b by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n = len(d)
    main, upper, second = d - x, np.r_[e, 0.0], np.zeros(n)
    b = b.copy()
    for i in range(n - 1):
        below, next_main, next_upper = e[i], main[i + 1], upper[i + 1]
        if abs(below) > abs(main[i]):
            ratio = main[i] / below
            main[i], upper[i], second[i], other, b[i], b[i + 1] = below, next_main, next_upper, upper[i], b[i + 1], b[i]
            main[i + 1], upper[i + 1] = other - ratio * next_main, -ratio * next_upper
        else:
            main[i] = main[i] if main[i] != 0 else least
            ratio = below / main[i]
            main[i + 1] = next_main - ratio * upper[i]
        b[i + 1] -= ratio * b[i]
    main[-1] = main[-1] if abs(main[-1]) > least else least
    y = np.zeros(n)
    for i in reversed(range(n)):
        after = (upper[i] * y[i + 1] if i + 1 < n else 0.0) + (second[i] * y[i + 2] if i + 2 < n else 0.0)
        y[i] = (b[i] - after) / main[i]
    return y


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one column for each of the falling ``values``.

    Vectors of a cluster of close eigenvalues are kept orthogonal to each other in every iteration.
    """
    n = len(d)
    size = max(np.abs(d).max(), np.abs(e).max() if n > 1 else 0.0, np.finfo(float).tiny)
    least = np.finfo(float).eps * size
    out = np.zeros((n, len(values)))
    cluster = 0
    r = np.random.default_rng(1)
    for j, x in enumerate(values):
        if j and values[j - 1] - x > 1e-3 * size:
            cluster = j
        # equal values are moved apart by a few last bits, so that their first solutions differ
        shift = x - (j - cluster) * 4 * least
        y = r.standard_normal(n)
        for _ in range(6):
            y = _solve(d, e, shift, y / np.linalg.norm(y), least)
            for _ in range(2):
                y -= out[:, cluster:j] @ (out[:, cluster:j].T @ y)
        out[:, j] = y / np.linalg.norm(y)
    return out


def components(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of the leading components with any variance, at most ``k``."""
    trace = float(np.trace(covariance))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    d, e, q = tridiagonal(covariance / trace)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    values = values[values > LEAST_SHARE]
    vectors = q @ eigenvectors(d, e, values)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * trace, vectors


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists of longs."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, row numbers) of the rows of a batch, in blocks of bounded size."""
    lengths = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for a in range(0, len(rows), _ROWS):
            yield int(n), rows[a : a + _ROWS]


def _sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and length: (length, i, n, high, low), sums of dimension i as high * 2^32 + low."""
    sums: dict[int, list] = {}
    for batch in source:
        for d, rows in _by_length(batch, 0):
            x = _matrix(batch.column(0).take(pa.array(rows)))
            s = sums.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            s[0] += len(x)
            s[1] += (x >> 32).sum(0)
            s[2] += (x & (_HALF - 1)).sum(0)
    for d, (n, high, low) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (np.full(d, d), np.arange(d), np.full(d, n), high, low)],
            ["length", "i", "n", "high", "low"],
        )


def _centre(fit: dict, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and the fractions beyond."""
    n, sums = fit[d]
    whole = [s // n for s in sums]
    return np.array(whole, np.int64), np.array([float(Fraction(s - w * n, n)) for s, w in zip(sums, whole)])


def _products(fit: dict, project: dict | None = None):
    """Per partition and length the sums of products of centred numbers, (length, i, j, product), i <= j.

    With ``project``, of the whitened numbers instead.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {d: _centre(fit, d) for d in fit}
        sums: dict[int, np.ndarray] = {}
        for batch in source:
            for d, rows in _by_length(batch, 0):
                whole, rest = centres[d]
                y = (_matrix(batch.column(0).take(pa.array(rows))) - whole) - rest
                if project is not None:
                    y = y @ project[d][1] / np.sqrt(project[d][0])
                sums[d] = sums.get(d, 0.0) + y.T @ y
        for d, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), d), pa.int64()), pa.array(i), pa.array(j), pa.array(s[i, j])],
                ["length", "i", "j", "product"],
            )

    return batches


_PAIRS = "length bigint, i bigint, j bigint, product double"


def _covariances(distinct: DataFrame, fit: dict, project: dict | None = None) -> dict[int, np.ndarray]:
    sums = distinct.mapInArrow(_products(fit, project), _PAIRS).groupBy("length", "i", "j").agg(F.sum("product").alias("s"))
    sizes = {d: d if project is None else len(project[d][0]) for d in fit}
    out = {d: np.zeros((k, k)) for d, k in sizes.items()}
    for r in sums.collect():
        out[r["length"]][r["i"], r["j"]] = out[r["length"]][r["j"], r["i"]] = r["s"] / fit[r["length"]][0]
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - S)^2; None where they pass 64 bits."""
    whole = [s // n for s in sums]
    moved, rest = x - np.array(whole, np.int64), np.array([s - w * n for s, w in zip(sums, whole)], np.int64)
    if (int(np.abs(moved).max(initial=0)) + 1) * n * (int(x.shape[1] ** 0.5) + 1) < 2**31:
        return ((moved * n - rest) ** 2).sum(1).tolist()
    about = ((moved * float(n) - rest) ** 2).sum(1)
    exact = [
        sum((int(m) * n - int(r)) ** 2 for m, r in zip(row, rest)) if a < 1e19 else 2**63 for row, a in zip(moved, about)
    ]
    return [v if v < 2**63 else None for v in exact]


def _whitened(fit: dict, parts: dict, errors: dict, kind: pa.DataType):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {d: _centre(fit, d) for d in fit}
        for batch in source:
            for d, rows in _by_length(batch, 1):
                values, vectors, trace = parts[d]
                k = len(values)
                if not k:
                    continue
                x = _matrix(batch.column(1).take(pa.array(rows)))
                n, sums = fit[d]
                whole, rest = centres[d]
                z = ((x - whole) - rest) @ vectors / np.sqrt(values)
                at = pa.array(np.repeat(rows, k))
                deviation = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at).cast(kind),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(at), n, np.int64)), deviation, pa.array(z.reshape(-1)),
                        pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(at), errors[d])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return batches


def usable_codes(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x) of rows whose vector has entries, none of them null, NaN or infinite; x = floor(64 * entry) + 1000000."""
    entry = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    good = F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, bad)
    code = F.transform(column, lambda c: F.least(F.greatest(F.floor(entry(c) * SCALE), F.lit(-_MOST)), F.lit(_MOST)) + SHIFT)
    return vectors.where(good).select(id_column, code.alias("x"))


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    The fit list holds each distinct vector once. ``whitened`` is the row's centred vector projected on the
    component, over the root of the component's variance; ``explained`` the component's share of all variance;
    ``deviation`` the exact sum of (n x - S)^2 (null beyond 64 bits); ``identity_error`` the largest
    entry of the whitened fit list's covariance minus the identity.

    Components with less than 1e-10 of the variance are left out, so a table with one distinct
    vector gives no rows, as does one without usable vectors. Rows with null, empty, NaN or infinite vectors are dropped; null
    and repeated ids are kept as they are, and copies of a vector get the same numbers. Vectors of different
    lengths are whitened apart, each length with its own n (at most 64 lengths of at most 2,048 dimensions, else an error). Among
    components of equal variance the choice is any orthogonal one, the same for all rows.
    """
    codes = usable_codes(vectors, id_column, column)
    distinct = written(codes.groupBy("x").agg(F.lit(1).alias("_one")).select("x"), "whitening_fit")
    lengths = [r[0] for r in distinct.select(F.size("x")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS or max(lengths, default=0) > MAX_DIMENSION:
        raise ValueError(f"at most {MAX_LENGTHS} lengths of at most {MAX_DIMENSION} dimensions")
    sums = distinct.mapInArrow(_sums, "length bigint, i bigint, n bigint, high bigint, low bigint").groupBy("length", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")
    )
    fit: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("length", "i").collect():
        fit.setdefault(r["length"], (r["n"], []))[1].append(int(r["high"]) * _HALF + int(r["low"]))
    covariances = _covariances(distinct, fit)
    parts = {d: (*components(c, k), float(np.trace(c))) for d, c in covariances.items()}
    errors = {
        d: float(np.abs(c - np.eye(len(c))).max(initial=0.0))
        for d, c in _covariances(distinct, fit, {d: p[:2] for d, p in parts.items()}).items()
    }
    from pyspark.sql.pandas.types import to_arrow_type

    kind = vectors.schema[id_column].dataType
    out = codes.mapInArrow(
        _whitened(fit, parts, errors, to_arrow_type(kind)),
        f"{id_column} {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double",
    )
    return out
