"""Whitening of embeddings along their first principal components, by Chebyshev-filtered subspace iteration.

Vectors are written once as blocks of integers; sums are exact, so centring is. A product of the
covariance with a block of columns is one pass: every task adds up X'(X Q) of its centred blocks and
Spark adds the tasks' rows, so the driver holds matrices of dimension x COLUMNS at most. A few passes
of a single column (Lanczos) bound the spectrum from below. Each round then runs the Chebyshev
recurrence over the interval of unwanted eigenvalues, which damps them against the wanted ones, makes
the block orthonormal (QR) and solves the projected problem (Rayleigh-Ritz). Rounds go on until the
residual of each wanted pair over its distance to the next eigenvalue is under ANGLE, or no round makes
residuals smaller that are already of the size of rounding.

Defined results: rows whose vector is null or holds null, NaN or infinite entries are dropped, and so
are those with an entry beyond 2**53 once scaled (it has no exact double) or of another length than most
vectors (of equally many, the longest). Null and repeated ids are rows of their own. Vectors with fewer
dimensions, or of lower rank, than COMPONENTS have that many components, and equal vectors, a single
one or none give no rows. A deviation that no long holds is null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

COMPONENTS = 8
#: Scale and shift of the integers; columns beyond the wanted ones; most steps of one recurrence, and how far its columns may grow apart in it; passes that bound the spectrum; least width of the damped interval, as a share of its upper end; angle that is certified; what counts as rounding; rounds.
SCALE, SHIFT, GUARD, STEPS, SPREAD, LANCZOS, NARROW, ANGLE, ROUNDING, ROUNDS = 1024, 100_000, 16, 10, 1e7, 8, 1e-3, 1e-11, 1e-12, 500
#: Bytes of a block; a larger vector stands alone.
BLOCK_BYTES = 2_000_000
BLOCKS = "ids array<long>, n long, dims int, width int, data binary"


def scaled(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids, the lengths, and where the integers of each row begin, with all integers: of the rows that count."""
    column = batch.column("embedding").cast(pa.large_list(pa.float64()))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    entries = column.values
    holes = entries.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(entries.to_numpy(zero_copy_only=False) * SCALE) + SHIFT
    wrong = np.concatenate([[0], np.cumsum(holes | ~(np.abs(x) <= 2.0**53))])
    edges = column.offsets.to_numpy()
    valid &= wrong[edges[1:]] == wrong[edges[:-1]]
    return batch.column("vec_id").filter(pa.array(valid)), np.diff(edges)[valid], edges[:-1][valid], x


def blocking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, length, start, x = scaled(batch)
        for dims in np.unique(length):
            rows = np.flatnonzero(length == dims)
            size = max(1, BLOCK_BYTES // (8 * max(1, int(dims))))
            for k in range(0, len(rows), size):
                some = rows[k : k + size]
                data = x[start[some][:, None] + np.arange(dims)].astype(np.int64) - SHIFT
                width = 4 if not data.size or np.abs(data).max() < 2**31 else 8
                held = ids.take(pa.array(some))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), held), pa.array([len(some)], pa.int64()), pa.array([dims], pa.int32()), pa.array([width], pa.int32()), pa.array([data.astype(f"<i{width}").tobytes()])],
                    [c.split()[0] for c in BLOCKS.split(", ")],
                )


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """ids and integers less SHIFT of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            n, dims = row["n"].as_py(), row["dims"].as_py()
            yield row["ids"].values if "ids" in row else None, np.frombuffer(row["data"].as_buffer(), f"<i{row['width'].as_py()}").reshape(n, dims).astype(np.int64)


class Centre:
    """Exact sums of n vectors; centred(x) is x less the mean, of which the whole part goes before anything is rounded."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        whole = [s // n for s in sums]
        self.rest = [s - n * w for s, w in zip(sums, whole, strict=True)]
        self.whole, self.part = np.array(whole, np.int64), np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, of each row; null where no long holds it."""
        u, rest = x - self.whole, np.array(self.rest, np.int64)
        dims, most = x.shape[1], int(np.abs(u).max(initial=0))
        if most * max(most, self.n) * max(1, dims) >= 2**62:
            u, rest = u.astype(object), rest.astype(object)
        squares, products = (u * u).sum(1).astype(object), (u * rest).sum(1).astype(object)
        found = squares * self.n**2 - products * (2 * self.n) + sum(r * r for r in self.rest)
        return pa.array([int(v) if v < 2**63 else None for v in found], pa.int64())


def sums_of(blocks: DataFrame) -> tuple[int, list[int]]:
    """Rows and the exact sums of the integers less SHIFT; high and low halves are summed apart, so nothing overflows."""

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for _, x in matrices(batches):
            h, w = (x >> 26).sum(0), (x & (2**26 - 1)).sum(0)
            n, high, low = (n + len(x), h, w) if high is None else (n + len(x), high + h, low + w)
        if high is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    rows = blocks.mapInArrow(adding, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low"))).orderBy("i").collect()
    return (int(rows[0]["n"]), [(int(r["high"]) << 26) + int(r["low"]) for r in rows]) if rows else (0, [])


def summed(blocks: DataFrame, centre: Centre, product: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """The sum over all blocks of product(centred block), a matrix of rows x columns, each row added up by Spark."""

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for _, x in matrices(batches):
            total += product(centre.centred(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *(pa.array(total[:, k].copy()) for k in range(columns))], ["i", *(f"c{k}" for k in range(columns))])

    schema = ", ".join(["i long", *(f"c{k} double" for k in range(columns))])
    found = blocks.mapInArrow(adding, schema).groupBy("i").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(columns))).toPandas().sort_values("i")
    return found[[f"c{k}" for k in range(columns)]].to_numpy(np.float64).reshape(-1, columns) if len(found) else np.zeros((rows, columns))


def lower_bound(apply: Callable[[np.ndarray], np.ndarray], dims: int, steps: int) -> float:
    """A bound that no eigenvalue is far below: the least Ritz value of a Krylov space of one column, less its residual."""
    q = np.random.default_rng(0).standard_normal((dims, 1))
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dims)):
        w = apply(basis[-1])
        diagonal.append((basis[-1].T @ w).item())
        held = np.hstack(basis)
        for _ in range(2):
            w = w - held @ (held.T @ w)
        beside.append(np.linalg.norm(w).item())
        if beside[-1] <= ROUNDING * max(diagonal):
            beside[-1] = 0.0
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, float(values[0] - beside[-1] * abs(vectors[-1, 0])))


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, product: np.ndarray, low: float, high: float, steps: int) -> np.ndarray:
    """T_steps((2 V - high - low) / (high - low)) q by the three-term recurrence; product is V q, steps are at least one."""
    middle, half = (high + low) / 2, (high - low) / 2
    before, now = q, (product - middle * q) / half
    for _ in range(steps - 1):
        before, now = now, 2 * (apply(now) - middle * now) / half - before
        size = np.abs(now).max(0)
        before, now = before / size, now / size
    return now


def principal(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` greatest eigenvalues, falling, and unit eigenvectors of a symmetric operator without negative eigenvalues."""
    columns = min(dims, wanted + GUARD)
    wanted = min(wanted, columns)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, columns)))[0]
    low = lower_bound(apply, dims, LANCZOS) if columns < dims else 0.0
    before = np.inf
    for _ in range(ROUNDS):
        product = apply(q)
        projected = q.T @ product
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        residual = np.linalg.norm(product - q * values, axis=0)
        top = max(float(values[0]), np.finfo(float).tiny)
        gaps = np.maximum(values[:wanted] - np.append(values[1:], values[-1])[:wanted], np.finfo(float).eps * top)
        gaps = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
        worst = float(residual[:wanted].max())
        if (residual[:wanted] <= ANGLE * gaps).all() or (worst <= ROUNDING * top and worst > before / 2):
            return values[:wanted], q[:, :wanted]
        before = worst
        if columns == dims:  # nothing is left to damp: one more product and projection
            q = np.linalg.qr(q)[0]
            continue
        high = float(values[-1])
        low = min(low, high - NARROW * max(high, ROUNDING * top))
        reach = [np.arccosh(max(1.0, (2 * v - high - low) / (high - low))) for v in (values[0], values[wanted - 1])]
        apart = max(1e-9, float(reach[0] - reach[1]))
        steps = int(np.clip(np.log(SPREAD) / apart, 1, STEPS))
        q = np.linalg.qr(filtered(apply, q, product, low, high, steps))[0]
    raise ArithmeticError(f"eigenvectors are not certified after {ROUNDS} rounds: residual {before}")


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector that counts and each of its first components."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = tk.only(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    blocks = tk.materialize(spark, rows.mapInArrow(blocking, BLOCKS), "blocks")
    lengths = blocks.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None or not lengths["dims"]:
        return spark.createDataFrame([], schema)
    blocks = blocks.where(F.col("dims") == lengths["dims"])
    numbers, dims = blocks.select("n", "dims", "width", "data"), int(lengths["dims"])
    centre = Centre(*sums_of(numbers))
    n = centre.n
    trace = float(summed(numbers, centre, lambda y: np.array([[np.vdot(y, y)]]), 1, 1)[0, 0]) / n
    if trace == 0:
        return spark.createDataFrame([], schema)
    values, vectors = principal(lambda q: summed(numbers, centre, lambda y: y.T @ (y @ q), dims, q.shape[1]) / n, dims, min(components, dims, n - 1))
    there = values > ROUNDING * values[0]
    values, vectors = values[there], vectors[:, there]
    turn, k = vectors / np.sqrt(values), int(there.sum())
    moments = summed(numbers, centre, lambda y: np.vstack([(y @ turn).T @ (y @ turn), (y @ turn).sum(0)]), k + 1, k) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())

    def projecting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for ids, x in matrices(batches):
            place = pa.array(np.repeat(np.arange(len(x)), k))
            component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            rows, off = (pa.array(np.full(len(x) * k, v)) for v in (n, error))
            yield pa.RecordBatch.from_arrays([ids.take(place), component, rows, centre.deviation(x).take(place), pa.array((centre.centred(x) @ turn).ravel()), pa.array(np.tile(values / trace, len(x))), off], names)

    return blocks.mapInArrow(projecting, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, tk.table(spark, sf_dir, "embeddings"))
