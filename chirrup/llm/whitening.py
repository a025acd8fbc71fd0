"""Whitening of vectors by their leading principal components, found by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.llm.common import map_batches
from chirrup.session import materialize

#: Components at most, vectors iterated beside them, the filter's largest degree and growth, steps that measure the spectrum.
COMPONENTS, GUARD, DEGREE, GROWTH, PROBE = 16, 16, 12, 1e10, 8
#: A component is certified when its residual is at most this part of the largest eigenvalue.
TOLERANCE = 1e-13
#: Rounds of filter and Rayleigh-Ritz before a spectrum that does not settle is an error, and rounds that may bring no gain.
ROUNDS, STALLED = 60, 3
#: A residual that no longer falls is accepted up to this part; double precision reaches no further then.
FLOOR = 1e-11
#: Vectors that a stored block holds.
BLOCK = 2048
#: Partial sums that the driver adds itself.
DIRECT = 64
#: Entries with at most this size are exact in double precision.
LARGEST = 2**52


def _integers(df: DataFrame, id: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, dim, x): floor(scale * c) + offset of every entry c in double precision, as 8-byte integers."""

    def make():
        def step(batch):
            ids, dims, cells = [], [], []
            for row, value in enumerate(batch.column(1)):
                if not value.is_valid or value.values is None or value.values.null_count:
                    continue
                c = np.asarray(value.values, np.float64)
                if not np.isfinite(c).all():
                    continue
                x = np.floor(scale * c)
                if x.size and np.abs(x).max() + abs(offset) > LARGEST:
                    raise ValueError("an entry is too large to be an exact integer")
                ids.append(row)
                dims.append(len(x))
                cells.append((x.astype("<i8") + offset).tobytes())
            yield batch.column(0).take(pa.array(ids, pa.int64())), dims, cells

        return step

    kind = df.schema[id].dataType.simpleString()
    return map_batches(df.select(id, vector), make, f"vec_id {kind}, dim int, x binary")


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i8").reshape(len(column), dim)


def _added(parts: DataFrame, tasks: int, columns: int) -> np.ndarray:
    """The sum of partial matrices, kept as bytes of doubles; many are first added by a few tasks."""

    def make():
        total = None

        def step(batch):
            nonlocal total
            if batch is not None:
                for (blob,) in zip(batch.column(0).to_pylist()):
                    one = np.frombuffer(blob, np.float64)
                    total = one.copy() if total is None else total + one
                return
            if total is not None:
                yield ([total.tobytes()],)

        return step

    rows = parts
    if tasks > DIRECT:
        rows = map_batches(parts.repartition(DIRECT // 4), make, "part binary", finish=True)
    found = [np.frombuffer(r.part, np.float64) for r in rows.collect()]
    return np.sum(found, axis=0).reshape(-1, columns)


class Fit:
    """The distinct integer vectors of one dimension, in stored blocks, and passes over them."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int], squares: int):
        self.blocks, self.dim, self.n, self.sums = blocks, dim, n, sums
        self.base = [s // n for s in sums]
        #: What the mean has beyond `base`, so that centring keeps all digits.
        self.rest = np.array([(s - b * n) / n for s, b in zip(sums, self.base)])
        #: n * n * trace of the covariance, exact.
        self.spread = n * squares - sum((s - b * n) ** 2 for s, b in zip(sums, self.base))
        self.trace = self.spread / n / n
        self.passes, self.tasks = 0, blocks.select(F.spark_partition_id().alias("p")).distinct().count()

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times `q`, in one pass: each task adds up Xᵀ(XQ) over its centred blocks."""
        self.passes += 1
        fit, dim = self, self.dim
        blocks, centred = self.blocks, _centring(self)

        def make():
            total = np.zeros((dim, q.shape[1]))

            def step(batch):
                nonlocal total
                if batch is None:
                    yield ([total.tobytes()],)
                    return
                for (data,) in zip(batch.column(0).to_pylist()):
                    x = centred(np.frombuffer(data, "<i8").reshape(-1, dim))
                    total += x.T @ (x @ q)

            return step

        return _added(map_batches(blocks, make, "part binary", finish=True), fit.tasks, q.shape[1]) / fit.n

    def spread_of(self, map: np.ndarray) -> np.ndarray:
        """The covariance of the vectors after the map, from their centred images, in one pass."""
        blocks, centred, dim = self.blocks, _centring(self), self.dim

        def make():
            total = np.zeros((map.shape[1], map.shape[1]))

            def step(batch):
                nonlocal total
                if batch is None:
                    yield ([total.tobytes()],)
                    return
                for (data,) in zip(batch.column(0).to_pylist()):
                    y = centred(np.frombuffer(data, "<i8").reshape(-1, dim)) @ map
                    total += y.T @ y

            return step

        return _added(map_batches(blocks, make, "part binary", finish=True), self.tasks, map.shape[1]) / self.n


def _centring(fit: Fit):
    base, rest = np.array(fit.base, np.int64), fit.rest
    return lambda x: (x - base).astype(np.float64) - rest


def _fits(vectors: DataFrame) -> list[Fit]:
    """A fit per dimension over its distinct vectors; their sums are exact integers."""
    distinct = vectors.select("dim", "x").where("dim > 0").distinct()

    def make():
        held: dict[int, list] = {}

        def block(dim):
            x = np.frombuffer(b"".join(held.pop(dim)), "<i8").reshape(-1, dim)
            exact = x.astype(object) if np.abs(x).max(initial=0) > 2**50 else x
            return dim, len(x), x.tobytes(), [str(s) for s in exact.sum(axis=0)]

        def step(batch):
            full = []
            if batch is None:
                full = [block(dim) for dim in list(held)]
            else:
                for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.setdefault(dim, []).append(x)
                    if len(held[dim]) >= BLOCK:
                        full.append(block(dim))
            if full:
                yield list(zip(*full))

        return step

    ddl = "dim int, rows long, x binary, sums array<string>"
    blocks = materialize(map_batches(distinct, make, ddl, finish=True))
    out = []
    for dim, n in sorted((r["dim"], r["n"]) for r in blocks.groupBy("dim").agg(F.sum("rows").alias("n")).collect()):
        mine = blocks.where(F.col("dim") == dim)
        total = mine.select(F.posexplode(F.transform("sums", lambda s: s.cast("decimal(38,0)"))).alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
        sums = [int(r["s"]) for r in total.orderBy("at").collect()]
        base = [s // n for s in sums]
        out.append(Fit(mine.select("x"), dim, n, sums, _squares(mine, base, dim)))
    return out


def _squares(blocks: DataFrame, base: list[int], dim: int) -> int:
    """The exact sum of (x - base)^2 over all entries, `base` given per dimension."""

    def make():
        total = 0
        low = np.array(base, np.int64)

        def step(batch):
            nonlocal total
            if batch is None:
                yield ([str(total)],)
                return
            for (data,) in zip(batch.column(0).to_pylist()):
                d = np.frombuffer(data, "<i8").reshape(-1, dim) - low
                d = d.astype(object) if np.abs(d).max(initial=0) > 2**24 else d
                total += int((d * d).sum())

        return step

    found = map_batches(blocks.select("x"), make, "part string", finish=True)
    return int(found.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0] or 0)


def _bounds(fit: Fit) -> tuple[float, float]:
    """(low, high) about the covariance's spectrum: Lanczos steps from a fixed random start, widened by the last residual."""
    q = np.random.default_rng(11).standard_normal(fit.dim)
    q /= np.linalg.norm(q)
    basis, main, side = [q], [], []
    for _ in range(min(PROBE, fit.dim)):
        w = fit.times(basis[-1][:, None])[:, 0]
        main.append(float(basis[-1] @ w))
        for _ in range(2):
            for b in basis:
                w -= (b @ w) * b
        side.append(float(np.linalg.norm(w)))
        if side[-1] <= 1e-12 * max(main):
            break
        basis.append(w / side[-1])
    values = np.linalg.eigvalsh(np.diag(main) + np.diag(side[: len(main) - 1], 1) + np.diag(side[: len(main) - 1], -1))
    return max(0.0, float(values[0] - side[-1])), float(values[-1] + side[-1])


def _filtered(fit: Fit, q: np.ndarray, low: float, cut: float, high: float) -> np.ndarray:
    """`q` under the scaled Chebyshev recurrence that damps eigenvalues in [low, cut] and lets those above grow.

    The degree is kept so low that the largest eigenvalue grows by GROWTH at
    most: rounding in its direction must not drown a vector that hardly grows.
    """
    centre, half = (cut + low) / 2, (cut - low) / 2
    degree = max(2, min(DEGREE, int(math.acosh(GROWTH) / max(math.acosh(max((high - centre) / half, 1.0)), 1e-3))))
    scale = half / (high - centre)
    start, ahead = scale, q
    now = (fit.times(q) - centre * q) * (start / half)
    for _ in range(2, degree + 1):
        following = 1 / (2 / start - scale)
        ahead, now = now, 2 * (following / half) * (fit.times(now) - centre * now) - (scale * following) * ahead
        scale = following
    return now


def components(fit: Fit, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the largest eigenvalues of the covariance, falling, and unit eigenvectors in columns.

    Each round filters the subspace, orthonormalises it (QR) and takes the
    eigenpairs of the covariance on it (Rayleigh-Ritz).  It ends when every
    wanted pair's residual is within TOLERANCE of the largest eigenvalue, or
    has come within FLOOR and falls no more.  Eigenvalues of rounding size are
    left out, so a fit of few or equal vectors has fewer components.  The
    guard vectors make the wanted ones converge together; a subspace as wide as
    the space is exact at once.
    """
    width = min(fit.dim, count + GUARD)
    rng = np.random.default_rng(13)
    q = np.linalg.qr(rng.standard_normal((fit.dim, width)))[0]
    if fit.spread == 0:
        return np.zeros(0), np.zeros((fit.dim, 0))
    low, high = _bounds(fit) if width < fit.dim else (0.0, 0.0)
    best, stalled = np.inf, 0
    for round in range(ROUNDS):
        image = fit.times(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = values[0]
        wanted = min(count, width)
        left = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        stalled = stalled + 1 if left > best / 2 else 0
        best = min(best, left)
        if width == fit.dim or left <= TOLERANCE or (stalled >= STALLED and left <= FLOOR):
            kept = int((values[:wanted] > top * 1e-12 * fit.dim).sum())
            return values[:kept].copy(), q[:, :kept].copy()
        cut = values[-1]
        low = min(low, cut)
        if cut - low <= 1e-14 * top:
            low = 0.0
        if cut <= 1e-14 * top:
            cut = 1e-14 * top
        q = np.linalg.qr(_filtered(fit, q, low, cut, max(high, top)))[0]
    raise RuntimeError(f"the components did not settle: a residual of {best:.1e} of the largest eigenvalue is left")


def whiten(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS, scale: float = 1.0, offset: int = 0
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row and component.

    Rows whose vector is null, or holds a null or non-finite entry, are left
    out.  Entries c become integers floor(scale * c) + offset, exact up to
    2^52 (larger ones stop the job).  The fit takes each distinct integer vector once: n
    of them with sums S and the covariance V, divisor n.  `deviation` is the
    sum of (n * x - S)^2 over dimensions, exact; if it does not fit a long, the
    job stops.  `whitened` is x - S / n on the component's unit eigenvector
    over the root of its eigenvalue, which is the `explained` part of V's
    trace.  `identity_error` is the largest absolute entry of the whitened
    fit's covariance minus the identity.

    Repeated rows are each put out and weigh once in the fit.  Rows of unequal
    dimension are fitted apart, each dimension by itself.  Components without
    variance are left out, so equal vectors, vectors without entries and empty
    tables give no rows.  Ids may be null or repeated.  Only the basis, of
    dimension x (count + GUARD) numbers, and its products travel through the driver.
    """
    kind = df.schema[id].dataType.simpleString()
    vectors = materialize(_integers(df, id, vector, scale, offset))
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for fit in _fits(vectors):
        values, basis = components(fit, count)
        if not len(values):
            continue
        down = basis / np.sqrt(values)
        error = float(np.abs(fit.spread_of(down) - np.eye(len(values))).max())
        part = _projected(vectors.where(F.col("dim") == fit.dim), fit, down, (values / fit.trace).tolist(), error, ddl)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], ddl)


def _projected(vectors: DataFrame, fit: Fit, down: np.ndarray, explained: list[float], error: float, ddl: str) -> DataFrame:
    n, dim, k = fit.n, fit.dim, down.shape[1]
    base, centred = np.array(fit.base, np.int64), _centring(fit)
    #: n * x - S is n * (x - base) - over.
    over = np.array([s - b * n for s, b in zip(fit.sums, fit.base)], np.int64)

    def make():
        def deviations(x):
            d = x - base
            if n * int(np.abs(d).max(initial=0)) + n < math.isqrt((2**63 - 1) // dim):
                return ((n * d - over) ** 2).sum(axis=1)
            return np.array([int(v) for v in ((n * d.astype(object) - over.astype(object)) ** 2).sum(axis=1)], np.int64)

        def step(batch):
            if not batch.num_rows:
                return
            x = _rows(batch.column(1), dim)
            m = len(x)
            yield (
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(deviations(x), k)), pa.array((centred(x) @ down).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            )

        return step

    return map_batches(vectors.select("vec_id", "x"), make, ddl)
