"""Whitening of embeddings on leading covariance components found by block Jacobi-Davidson.

The covariance matrix is never formed. Centred vectors lie in blocks on the executors, and the
only access is the product of the covariance with a few columns: every block adds its share, and
the shares are summed up a tree. Around that product runs Jacobi-Davidson on the driver, on
matrices with one row per dimension:

* Rayleigh-Ritz on an orthonormal subspace gives Ritz pairs and their residuals.
* Pairs whose residual is at rounding level are locked, in order, and projected out from then on.
* For the others the projected correction equations are solved roughly by inner MINRES, all of
  them together: one product per inner step serves every right-hand side.
* The corrections widen the subspace, which is cut back to the best Ritz vectors when it is full.

Entries are integers (``floor(1024 * c) + 100000``), sums per dimension are exact, and a centred
entry is ``(n * x - S) / n`` with one rounding, so no digits cancel. ``deviation``, a sum of squares of
``n * x - S``, grows with the square of the number of rows and is exact: a long, or ``decimal(38,0)`` for
a table of which some deviation does not fit into a long.

Nulls: vectors that are null, empty, or hold null or non-finite entries are dropped, as are those
shorter than the longest vector, which have no place in its covariance; a null id is carried. Repeated
rows count as often as they occur. Ties of eigenvalues come in any orthonormal basis of their
space, the same for all rows. A component without variance has null ``whitened`` and explains 0;
``identity_error`` leaves it out. An empty table gives an empty result. Other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import written

SCALE, SHIFT = 1024, 100_000
#: Bytes of centred entries in one block.
BLOCK_BYTES = 4 << 20
#: Bytes of centred entries in one partition at least, unless there would be fewer partitions than cores.
PART_BYTES = 64 << 20
#: Shares of a product that are added up in one place.
FAN_IN = 64
INNER_STEPS = 8
#: A residual below so many units of rounding of the largest eigenvalue counts as zero.
ROUNDING_UNITS = 16
MAX_OUTER = 200
_HALF, _LIMB = np.uint64(32), np.uint64((1 << 32) - 1)

Product = Callable[[np.ndarray], np.ndarray]


def usable(vector: Column) -> Column:
    """Not null, not empty, and all entries finite."""
    finite = F.forall(vector, lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The new directions of ``block``: orthonormal, orthogonal to ``against``, without those that are only rounding."""
    out = np.zeros((block.shape[0], 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in (against, out):
                column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-12:
                break
            column = column / left
        else:
            out = np.column_stack((out, column))
    return out


def minres(product: Product, shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``P (A - shift_j) P t_j = right_j``, one column each, sharing one product per step.

    Lanczos with the running QR of the tridiagonal matrix; a column stops where its Lanczos vectors end.
    """
    beta = np.linalg.norm(right, axis=0)
    scale = np.where(beta > 0, beta, 1.0)
    v, v_old = right / scale, np.zeros_like(right)
    t, w, w_old = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta = beta.copy()
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    b = np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        z = project(product(v) - v * shifts)
        a = np.einsum("ij,ij->j", v, z)
        z = z - v * a - v_old * b
        b_next = np.linalg.norm(z, axis=0)
        r1 = c * a - c_old * s * b
        r2, r3 = s * a + c_old * c * b, s_old * b
        rho = np.hypot(r1, b_next)
        live = live & (rho > 0)
        safe = np.where(rho > 0, rho, 1.0)
        c_old, s_old, c, s = c, s, r1 / safe, b_next / safe
        w, w_old = (v - w_old * r3 - w * r2) / safe, w
        t = t + np.where(live, c * eta, 0.0) * w
        eta = np.where(live, -s * eta, 0.0)
        live = live & (b_next > 1e-14 * np.maximum(np.abs(a), 1e-300))
        v_old, v, b = v, np.where(live, z / np.where(b_next > 0, b_next, 1.0), 0.0), b_next
    return project(t)


def leading_pairs(product: Product, dims: int, count: int, room: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors, of a symmetric operator known by its products.

    Two pairs more than asked for are sought as a guard, so that a pair that starts out faint is
    not missed. ``room`` bounds the columns of the subspace.
    """
    count = min(count, dims)
    sought = min(dims, count + 2)
    room = min(dims, room or max(48, 4 * sought))
    rng = np.random.default_rng(11)
    basis = _orthonormal(rng.standard_normal((dims, min(dims, sought + 4))), np.zeros((dims, 0)))
    image = product(basis)
    values, vectors = np.zeros(0), np.zeros((dims, 0))
    for _ in range(MAX_OUTER):
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        want = min(sought - values.size, theta.size)
        ritz, moved = basis @ y, image @ y
        residual = moved[:, :want] - ritz[:, :want] * theta[:want]
        norm = max(np.abs(theta[0]) if theta.size else 0.0, values[0] if values.size else 0.0)
        level = ROUNDING_UNITS * np.finfo(float).eps * norm
        small_enough = np.linalg.norm(residual, axis=0) <= level
        # Locked in order: a pair waits for all larger ones.
        n = want if small_enough.all() else int(np.argmin(small_enough))
        values, vectors = np.append(values, theta[:n]), np.column_stack((vectors, ritz[:, :n]))
        if values.size >= sought or basis.shape[1] + values.size - n >= dims and n == want:
            break
        if n or ritz.shape[1] >= room:
            # The rest of the subspace goes on; when it is full only its best part does.
            keep = ritz.shape[1] if ritz.shape[1] - n + want - n <= room else min(ritz.shape[1], n + 2 * sought)
            basis, image = ritz[:, n:keep], moved[:, n:keep]
        focus, shifts = ritz[:, n:want], theta[n:want]
        held = np.column_stack((vectors, focus))
        # Twice, so that what is left along the held directions is rounding of rounding.
        project = lambda x: (lambda y: y - held @ (held.T @ y))(x - held @ (held.T @ x))
        right = -project(residual[:, n:want])
        step = minres(product, shifts, project, right, INNER_STEPS)
        fresh = _orthonormal(np.column_stack((step, right)), np.column_stack((vectors, basis)))[:, : max(0, dims - values.size - basis.shape[1])]
        if not fresh.shape[1]:
            # Nothing new to add: the residuals left are rounding of the products themselves.
            rest = sought - values.size
            values, vectors = np.append(values, shifts[:rest]), np.column_stack((vectors, focus[:, :rest]))
            break
        basis, image = np.column_stack((basis, fresh)), np.column_stack((image, product(fresh)))
    else:
        raise ArithmeticError(f"no convergence after {MAX_OUTER} outer steps")
    order = np.argsort(-values, kind="stable")[:count]
    return np.maximum(values[order], 0.0), vectors[:, order]


class Covariance:
    """The covariance of all vectors as an operator: centred blocks on the executors, products summed up a tree."""

    def __init__(self, table: DataFrame, total: np.ndarray, n: int):
        dims = total.size
        self.n = n
        rows = max(1, BLOCK_BYTES // (8 * dims))

        def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for x in _entries(batches, "x"):
                for at in range(0, len(x), rows):
                    yield (n * x[at : at + rows] - total) / n

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in centred(batches):
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

        # Kept by the executors; a lost block is read again from the written table.
        parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-8 * n * dims // PART_BYTES))
        self.parts = max(2, parts)
        self.blocks: RDD = table.select("x").coalesce(parts).mapInArrow(blocks, "block binary").rdd.map(
            lambda r: np.frombuffer(r.block, float).reshape(-1, dims)
        ).persist(StorageLevel.MEMORY_AND_DISK)

    def reduced(self, own: Callable[[Iterator[np.ndarray]], Iterator], merge: Callable):
        # As many levels as keep the shares that meet in one place, the driver included, below the fan-in.
        depth = max(1, math.ceil(math.log(self.parts, FAN_IN)))
        return self.blocks.mapPartitions(own).treeReduce(merge, depth=depth)

    def sum(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        def added(own: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
            out = np.zeros(shape)
            for block in own:
                out += share(block)
            yield out

        return self.reduced(added, np.add)

    def product(self, columns: np.ndarray) -> np.ndarray:
        return self.sum(lambda c: c.T @ (c @ columns), columns.shape) / self.n

    def spread(self) -> tuple[float, float]:
        """The trace, and the largest square of a vector's distance from the mean."""

        def squares(own: Iterator[np.ndarray]) -> Iterator[tuple[float, float]]:
            total = most = 0.0
            for c in own:
                each = np.einsum("ij,ij->i", c, c)
                total, most = total + float(each.sum()), max(most, float(each.max(initial=0.0)))
            yield total, most

        total, most = self.reduced(squares, lambda a, b: (a[0] + b[0], max(a[1], b[1])))
        return total / self.n, most

    def close(self) -> None:
        self.blocks.unpersist()


def _entries(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _deviation_type(largest: float) -> str:
    """The type that holds deviations up to about ``largest``."""
    if largest >= 1e38 * (1 - 1e-9):
        raise OverflowError("a deviation does not fit into 38 digits")
    return "long" if largest < 2.0**63 * (1 - 1e-9) else "decimal(38,0)"


def _squares(x: np.ndarray, total: np.ndarray, n: int, kind: str) -> pa.Array:
    """Sum over the dimensions of ``(n*x - S)^2``, exact; decimals are added up in limbs of 32 bits."""
    # The difference fits into a long, so it is right even where ``n * x`` wraps around.
    away = n * x - total
    if kind == "long":
        return pa.array(np.einsum("ij,ij->i", away, away))
    size = np.abs(away).astype(np.uint64)
    high, low = size >> _HALF, size & _LIMB
    limbs = np.zeros((4, len(x)), np.uint64)
    for i, product, times in ((0, low * low, 1), (1, high * low, 2), (2, high * high, 1)):
        limbs[i] += (product & _LIMB).sum(axis=1) * np.uint64(times)
        limbs[i + 1] += (product >> _HALF).sum(axis=1) * np.uint64(times)
    for i in range(3):
        limbs[i + 1] += limbs[i] >> _HALF
        limbs[i] &= _LIMB
    words = np.column_stack((limbs[0] | limbs[1] << _HALF, limbs[2] | limbs[3] << _HALF))
    return pa.Decimal128Array.from_buffers(pa.decimal128(38, 0), len(x), [None, pa.py_buffer(words.tobytes())])


def whiten(table: DataFrame, vec_id: str, vector: str, components: int = 8) -> DataFrame:
    """One row per usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    own = table.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).filter(usable(F.col("vector")))
    integer = F.transform("vector", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + SHIFT)
    kept = written(own.select("vec_id", integer.alias("x")))
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation {{}}, whitened double, explained double, identity_error double"
    dims = kept.agg(F.max(F.size("x"))).first()[0]
    if dims is None:
        return kept.sparkSession.createDataFrame([], schema.format("long"))
    full = kept.filter(F.size("x") == dims)
    sums = [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    per_dim = full.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(*sums).collect()
    n, total = per_dim[0].n, np.array([r.s for r in sorted(per_dim)], np.int64)
    if max(max(n * r.high - r.s, r.s - n * r.low) for r in per_dim) >= 1 << 63:
        raise OverflowError("an entry is too far from its mean for a long")
    cov = Covariance(full, total, n)
    values, vectors = leading_pairs(cov.product, dims, components)
    trace, farthest = cov.spread()
    squares = _deviation_type(farthest * n * n)
    real = values > dims * np.finfo(float).eps * values[0]
    scaled = vectors / np.sqrt(np.where(real, values, 1.0))

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ scaled
        return np.vstack((w.T @ w, w.sum(axis=0)))

    second = cov.sum(moments, (values.size + 1, values.size)) / n
    off = (second[:-1] - np.outer(second[-1], second[-1]) - np.eye(values.size))[real][:, real]
    error, explained = float(np.abs(off).max(initial=0.0)), values / trace if trace > 0 else np.zeros_like(values)
    cov.close()
    k = values.size
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = ((n * x - total) / n) @ scaled
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)), _squares(x, total, n, squares).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.ravel(), mask=np.tile(~real, m)), pa.array(np.tile(np.where(real, explained, 0.0), m)), pa.array(np.full(m * k, error)),
            ], names=names)

    return full.mapInArrow(rows, schema.format(squares))
