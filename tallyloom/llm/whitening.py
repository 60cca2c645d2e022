"""Whitening of embeddings: leading eigenvectors of their covariance by a block Jacobi-Davidson iteration.

Entries become whole numbers first, x = floor(64 * c) + 1,000,000, so that sums are exact and equal vectors are equal. The
covariance is that of the distinct vectors and is never formed: all that is asked of the data are products of it with a
few columns, each one pass over the written distinct vectors. A task centres its vectors, multiplies, and passes on one sum
of dimension x columns numbers; the sums of many tasks are added in tasks again before they reach the driver.

The driver keeps a search space of at most ``SPACE`` times the wanted columns. Rayleigh-Ritz in it gives approximate pairs;
for each that isn't good enough, the correction equation, projected against the pair and all locked ones, is solved by a few
steps of MINRES (all columns in step, so that a step is one pass), and the corrections widen the space. A pair is locked, and
the space cleared of it, once its residual is at most ``RESIDUAL`` times the largest eigenvalue.

Results: rows whose vector is null or holds a null or non-finite entry are left out, as are vectors of another length than
the commonest (of equally common ones the longest). A null id stays null, equal vectors have equal results, and other
columns are not read. Components without variance (eigenvalue at most dimension x 2**-52 times the largest) are left out, so
one distinct vector, or an empty table, gives no rows. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.core import shuffle_width, written
from tallyloom.llm.arrow import record

#: Scale and offset of the whole numbers that entries become.
SCALE, OFFSET = 64, 1_000_000
#: Components wanted, and how many more are followed so that the last wanted ones are told from their neighbours.
COMPONENTS, GUARD = 16, 4
#: Residual of a locked pair in units of the largest eigenvalue: some dozen roundings of double precision.
RESIDUAL = 2.0**-47
#: Columns of the search space, in units of the columns followed, before it is cut back to twice their number.
SPACE = 5
#: Steps of MINRES in a correction equation, and the relative residual at which it may end earlier.
INNER_STEPS, INNER_RESIDUAL = 8, 1e-2
#: Corrections after which the iteration gives up with an error.
ROUNDS = 200
#: Sums that the driver adds itself; those of more tasks are added in tasks first.
FAN_IN = 64


@dataclass
class Whitening:
    """Distinct vectors, their sums by dimension, trace of the covariance, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0


def whole_entries(vector: str | Column) -> Column:
    """A vector's whole numbers; null if it or an entry is null, or an entry isn't finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sum(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "<f8") -> np.ndarray:
    """The sum over all tasks of ``of`` summed over their batches of vectors (a matrix of whole numbers each)."""
    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = of(_matrix(batch.column("x")))
                total = found if total is None else total + found
        if total is not None:
            yield record({"part": pa.array([np.ascontiguousarray(total, kind).tobytes()], pa.binary())})

    def added(batches):
        total = None
        for batch in batches:
            for part in batch.column("part").to_pylist():
                found = np.frombuffer(part, kind)
                total = found if total is None else total + found
        if total is not None:
            yield record({"part": pa.array([total.tobytes()], pa.binary())})

    sums, width = fit.select("x").mapInArrow(partial, "part binary"), fit.rdd.getNumPartitions()
    if width > FAN_IN:
        sums = sums.repartition(max(FAN_IN, int(width**0.5))).mapInArrow(added, "part binary")
    return sum(np.frombuffer(r.part, kind) for r in sums.collect())


def _orthonormal(basis: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns add to a basis; columns that add nothing are dropped."""
    out = np.empty((len(columns), 0))
    for column in columns.T:
        size = np.linalg.norm(column)
        if not size > 0 or not np.isfinite(size):
            continue
        column = column / size
        for _ in range(3):  # repeated, as one projection leaves roundings of what it takes away
            column = column - basis @ (basis.T @ column)
            column = column - out @ (out.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-8:
                break
            column = column / size
        else:
            out = np.column_stack([out, column])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = INNER_STEPS, least: float = INNER_RESIDUAL) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column, each by MINRES of its own, all in step."""
    x = np.zeros_like(right)
    first = np.linalg.norm(right, axis=0)
    going = first > 0
    v, v_old, w, w_old = right.copy(), np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    gamma, eta = first.copy(), first.copy()
    c, c_old, s, s_old = (np.full(len(first), k) for k in (1.0, 1.0, 0.0, 0.0))
    for _ in range(steps):
        if not going.any():
            break
        v = np.where(going, v / np.where(going, gamma, 1), 0)
        moved = product(v)
        delta = (moved * v).sum(axis=0)
        v_next = moved - delta * v - gamma * v_old
        gamma_next = np.linalg.norm(v_next, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_next)
        a2 = s * delta + c_old * c * gamma
        a3 = s_old * gamma
        going &= a1 > 0
        safe = np.where(going, a1, 1)
        c_old, s_old, c, s = c, s, a0 / safe, gamma_next / safe
        w_old, w = w, (v - a3 * w_old - a2 * w) / safe
        x += np.where(going, c * eta, 0) * w
        eta = -s * eta
        going &= (np.abs(eta) > least * first) & (gamma_next > 1e-14 * first)
        v_old, v, gamma = v, v_next, gamma_next
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenpairs of a positive semidefinite symmetric matrix of ``size`` rows that is known by its products."""
    follow = min(size, wanted + GUARD)
    most = min(size, SPACE * follow)
    locked, values = np.empty((size, 0)), []
    space = _orthonormal(locked, np.random.default_rng(0).standard_normal((size, follow)))
    images, largest = product(space), 0.0
    for _ in range(ROUNDS):
        small = space.T @ images
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, images = space @ y, images @ y
        largest = max(largest, float(theta[0]))
        errors = images - space * theta
        errors = errors - locked @ (locked.T @ errors)
        sizes = np.linalg.norm(errors, axis=0)
        good = 0
        while good < len(theta) and len(values) + good < wanted and sizes[good] <= residual * largest:
            good += 1
        locked = np.column_stack([locked, space[:, :good]])
        values += theta[:good].tolist()
        space, images, theta, errors, sizes = space[:, good:], images[:, good:], theta[good:], errors[:, good:], sizes[good:]
        if len(values) == wanted:
            return np.array(values), locked
        if space.shape[1] + follow > most and space.shape[1] + len(values) < size:
            space, images = space[:, : 2 * follow], images[:, : 2 * follow]
        open_ = np.flatnonzero(sizes[: follow - len(values)] > residual * largest)
        u, shift = space[:, open_], theta[open_]

        def projected(z, u=u):
            z = z - locked @ (locked.T @ z)
            return z - u * (u * z).sum(axis=0)

        steps = 0 if space.shape[1] + len(values) + len(open_) >= size else INNER_STEPS
        fixes = -errors[:, open_]
        if steps:
            fixes = minres(lambda z: projected(product(projected(z)) - shift * projected(z)), projected(fixes), steps)
        more = _orthonormal(np.column_stack([locked, space]), fixes)
        if not more.shape[1]:  # nothing new from the corrections: look elsewhere
            more = _orthonormal(np.column_stack([locked, space]), np.random.default_rng(len(values) + 1).standard_normal((size, follow)))
        if not more.shape[1]:  # the space is the whole space; fresh images remove what rounding has left
            images = product(space)
            continue
        space, images = np.column_stack([space, more]), np.column_stack([images, product(more)])
    raise ArithmeticError(f"no convergence after {ROUNDS} corrections: {len(values)} of {wanted} pairs")


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of a table's vectors; every distinct vector counts once."""
    spark = rows.sparkSession
    distinct = written(rows.select(whole_entries(vector_col).alias("x")).filter("x is not null").distinct(), "vectors")
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or lengths.d == 0:
        return Whitening(0, [], 0.0, np.empty(0), np.empty((0, 0)))
    n, d = lengths.n, lengths.d
    same = distinct.filter(F.size("x") == d).coalesce(max(FAN_IN, 4 * shuffle_width(spark)))
    sums = [int(s) for s in _sum(same, lambda x: x.sum(axis=0, dtype=np.int64), "<i8")]
    centred = _centring(n, sums)
    trace = float(_sum(same, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    if not trace > 0:
        return Whitening(n, sums, trace, np.empty(0), np.empty((d, 0)))

    def product(columns: np.ndarray) -> np.ndarray:
        def of(x):
            c = centred(x)
            return c.T @ (c @ columns)

        return _sum(same, of).reshape(columns.shape) / n

    values, vectors = leading_pairs(product, d, min(d, components))
    order = np.argsort(-values, kind="stable")
    kept = order[values[order] > d * 2.0**-52 * values.max()]
    found = Whitening(n, sums, trace, values[kept], vectors[:, kept])
    project, k = _projection(found), len(kept)

    def moments(x):
        z = project(x)
        return np.column_stack([z.T @ z, z.sum(axis=0)])

    total = _sum(same, moments).reshape(k, k + 1) / n
    covariance = total[:, :k] - np.outer(total[:, k], total[:, k])
    found.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return found


def _centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - sums / n: the whole part of the mean is taken away before anything is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - rest


def _projection(w: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centred, columns = _centring(w.n, w.sums), w.vectors / np.sqrt(w.values)
    return lambda x: centred(x) @ columns


def _deviations(w: Whitening, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n * x - sums) ** 2 by row."""
    sums = np.array(w.sums, np.int64)
    far = float(np.abs(x - np.array([s // w.n for s in w.sums])).max(initial=0) + 1) * w.n
    if far * far * x.shape[1] < 2.0**62:
        return ((w.n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((w.n * a - s) ** 2 for a, s in zip(row, w.sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, w: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row that takes part and component: id, component, n, deviation, whitened, explained, identity_error."""
    d, k = len(w.sums), len(w.values)
    kind = rows.schema[id_col].dataType.simpleString()
    base = rows.select(F.col(id_col).alias("id"), whole_entries(vector_col).alias("x")).filter((F.size("x") == d) & F.lit(k > 0))
    project, share = _projection(w), w.values / w.trace if k else w.values

    def rows_of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            row, n = pa.array(np.repeat(np.arange(len(x)), k)), len(x) * k
            yield record({
                "id": batch.column("id").take(row), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(n, w.n, np.int64)), "deviation": pa.array(_deviations(w, x), pa.int64()).take(row),
                "whitened": pa.array(project(x).ravel()), "explained": pa.array(np.tile(share, len(x))),
                "identity_error": pa.array(np.full(n, w.identity_error)),
            })

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return base.mapInArrow(rows_of, schema).withColumnRenamed("id", id_col)
