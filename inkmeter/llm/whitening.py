"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration over distributed passes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, release

COMPONENTS = 32
#: Columns that the iteration carries besides the wanted ones; the least of them bounds what is damped.
GUARDS = 16
#: Passes of the estimate that bounds the spectrum from below.
BOUND_STEPS = 12
#: A filter polynomial has this degree at most, and grows at most so much more on the first column than on the last.
DEGREE, SPREAD = 12, 1e6
#: Certified: residuals so small against the largest eigenvalue, or below ENOUGH and no longer falling.
RESIDUAL, ENOUGH = 4e-15, 1e-12
ROUNDS = 200
#: Fixed by the contract: a whole number for each entry.
SCALE, SHIFT = 64, 1_000_000
#: Larger entries (times SCALE) count as this much, so that whole numbers stay exact in a double.
_LARGEST = float(1 << 52)
_BLOCK_VALUES = 1 << 18
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors of ``dim`` whole numbers (less SHIFT) with exact ``sums``; orthonormal ``components`` in columns."""

    dim: int
    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - np.array([s // self.n for s in self.sums]) - np.array([s % self.n / self.n for s in self.sums])


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of the vectors (the larger of two), 0 if there is none; others are no vectors of the table."""
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("dim")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("dim")).first()
    return first["dim"] if first else 0


def _whole(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``dim`` finite entries, and floor(SCALE * entry) of these rows."""
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False))
    flat = vectors.filter(pa.array(fits)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null entry is not a number here
    finite = np.isfinite(values).all(1)
    fits[fits] = finite
    return fits, np.floor(np.clip(values[finite] * SCALE, -_LARGEST, _LARGEST)).astype(np.int64)


def write_blocks(vectors: DataFrame, dim: int, path: str, column: str = "embedding") -> None:
    """The whole numbers, in blocks of rows of the least width that holds them, with the sums of each block."""
    rows = max(1, _BLOCK_VALUES // dim)
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("sums", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def block(x: np.ndarray) -> pa.RecordBatch:
            width = next(i for i, w in enumerate(_WIDTHS) if np.iinfo(w).min <= x.min() and x.max() <= np.iinfo(w).max)
            values = (part, len(x), width, x.sum(0).tolist(), x.astype(_WIDTHS[width]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        held, count = [], 0
        for batch in batches:
            x = _whole(batch.column(0), dim)[1]
            held.append(x)
            count += len(x)
            while count >= rows:
                joined = np.concatenate(held)
                yield block(joined[:rows])
                held, count = [joined[rows:]], count - rows
        if count:
            yield block(np.concatenate(held))
        del held
        release()

    vectors.select(column).mapInArrow(pack, "part int, n int, width int, sums array<long>, data binary").write.parquet(path)


class _Passes:
    """Sums over all blocks; each call reads the blocks once.  What comes back grows with the dimension alone."""

    def __init__(self, spark: SparkSession, path: str, dim: int) -> None:
        self.blocks, self.dim, self.count = spark.read.parquet(path), dim, 0
        self.n = self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = self.blocks.agg(F.max("part")).first()[0]
        self.folds = max(1, int(((parts or 0) + 1) ** 0.5))
        each = self.blocks.select(F.posexplode("sums").alias("at", "value"))
        of = {r["at"]: int(r["total"]) for r in each.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()}
        self.sums = tuple(of.get(i, 0) for i in range(dim))
        if self.n:
            self.low = np.array([s // self.n for s in self.sums])
            self.rest = np.array([s % self.n / self.n for s in self.sums])

    def _sum(self, of_block, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``of_block(centred rows)`` over all blocks: by task, by folds of tasks, and on the driver by folds."""
        dim, low, rest, folds = self.dim, self.low, self.rest, self.folds

        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, part = np.zeros(shape), None
            for batch in batches:
                for p, width, data in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "data")), strict=True):
                    x = np.frombuffer(data, _WIDTHS[width]).reshape(-1, dim)
                    out += of_block((x - low).astype(np.float64) - rest)
                    part = p if part is None else min(part, p)
            if part is not None:
                yield pa.RecordBatch.from_pydict({"fold": pa.array([part % folds], pa.int32()), "part": pa.array([part], pa.int32()), "total": pa.array([out.tobytes()], pa.binary())})

        def by_fold(batch):
            ordered = batch.sort_values("part")["total"]
            total = sum((np.frombuffer(t) for t in ordered), np.zeros(int(np.prod(shape))))
            return batch.head(1).assign(total=[total.tobytes()])

        kind = "fold int, part int, total binary"
        folded = self.blocks.select("part", "width", "data").mapInArrow(by_task, kind).groupBy("fold").applyInPandas(by_fold, kind).collect()
        self.count += 1
        return sum((np.frombuffer(r["total"]).reshape(shape) for r in sorted(folded, key=lambda r: r["fold"])), np.zeros(shape))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q: the centred rows are multiplied into ``q`` and back, so no covariance matrix is formed."""
        return self._sum(lambda x: x.T @ (x @ q), q.shape) / self.n

    def trace(self) -> float:
        return float(self._sum(lambda x: np.array([np.einsum("ij,ij->", x, x)]), (1,))[0] / self.n)

    def identity_error(self, to: np.ndarray) -> float:
        """Of the rows projected by ``to``: the covariance's largest distance from the identity."""
        k = to.shape[1]

        def second(x: np.ndarray) -> np.ndarray:
            z = x @ to
            return z.T @ z

        mean = self._sum(lambda x: (x @ to).sum(0), (k,)) / self.n
        return float(np.abs(self._sum(second, (k, k)) / self.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def _least(passes: _Passes, rng: np.random.Generator) -> float:
    """A lower bound of the spectrum, from a short orthogonalised Krylov run; never below zero."""
    q = rng.standard_normal(passes.dim)
    basis = [q / np.linalg.norm(q)]
    diagonal, beside = [], []
    for _ in range(min(BOUND_STEPS, passes.dim)):
        w = passes.times(basis[-1][:, None])[:, 0]
        diagonal.append(float(basis[-1] @ w))
        done = np.array(basis)
        for _ in range(2):
            w = w - done.T @ (done @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / beside[-1])
    t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def _filter(passes: _Passes, locked: np.ndarray, q: np.ndarray, top: float, cut: float, low: float) -> np.ndarray:
    """Columns ``q`` times a scaled Chebyshev polynomial of V that is small on [low, cut]; ``locked`` is kept out."""
    centre, half = (cut + low) / 2, max((cut - low) / 2, 1e-9 * top)
    reach = np.arccosh(max((top - centre) / half, 1 + 1e-9))
    degree = int(np.clip(np.log(2 * SPREAD) // reach, 1, DEGREE))
    out = lambda y: y - locked @ (locked.T @ y)
    first = sigma = half / (top - centre)
    before, now = q, out(passes.times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        follows = 1 / (2 / first - sigma)
        before, now = now, out((passes.times(now) - centre * now) * (2 * follows / half) - sigma * follows * before)
        sigma = follows
    return now


def _iterate(passes: _Passes, wanted: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and eigenvectors: filter, QR, Rayleigh-Ritz, until the wanted residuals are certified."""
    rng = np.random.default_rng(seed)
    size = min(passes.dim, wanted + GUARDS)
    low = _least(passes, rng) if size < passes.dim else 0.0
    q = np.linalg.qr(rng.standard_normal((passes.dim, size)))[0]
    fixed, worst = 0, np.inf
    for _ in range(ROUNDS):
        y = passes.times(q)
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residual = np.linalg.norm(y - q * values, axis=0)[:wanted]
        top = max(values[0], np.finfo(float).tiny)
        before, worst = worst, float(residual.max() / top)
        if size == passes.dim or worst <= RESIDUAL or (worst <= ENOUGH and worst > before / 4):
            return values[:wanted], q[:, :wanted]
        low = min(low, max(0.0, float(values[-1])))
        small = residual <= RESIDUAL * top
        fixed = wanted if small.all() else int(np.argmin(small))
        locked, active = q[:, :fixed], q[:, fixed:]
        if values[-1] <= 1e-13 * top:  # the columns span all there is
            grown = passes.times(active)
        else:
            grown = _filter(passes, locked, active, float(values[fixed]), float(values[-1]), min(low, 0.99 * float(values[-1])))
        grown = grown / np.maximum(np.linalg.norm(grown, axis=0), np.finfo(float).tiny)
        q = np.linalg.qr(np.concatenate([locked, grown], axis=1))[0]
    raise ArithmeticError(f"residual {worst:.1e} after {ROUNDS} rounds")


def fit(vectors: DataFrame, k: int = COMPONENTS, column: str = "embedding", seed: int = 42) -> Whitening | None:
    """Leading components of all vectors of the table's dimension with finite entries; None if there is none.

    An entry c counts as the whole number floor(64 c).  These are written once to the shared folder in compact blocks;
    every pass multiplies the centred blocks into a few columns and back.  Directions in which the vectors do not
    differ (eigenvalue zero up to rounding) are no components, so constant vectors have none.  A repeated vector counts
    as often as it is there.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, column)
    if not dim:
        return None
    path = new_path(spark, "vectors")
    write_blocks(vectors, dim, path, column)
    passes = _Passes(spark, path, dim)
    if not passes.n:
        return None
    trace = passes.trace()
    if trace <= 0:
        return Whitening(dim, passes.n, passes.sums, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, passes.count)
    values, q = _iterate(passes, min(k, dim), seed)
    real = values > 1e-12 * trace
    values, q = values[real], q[:, real]
    signs = np.where(q[np.abs(q).argmax(0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    q = q * signs
    return Whitening(dim, passes.n, passes.sums, q, values, trace, passes.identity_error(q / np.sqrt(values)), passes.count)


def whitened(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(``key``, deviation, whitened array<double>) of every row whose vector has the model's dimension and finite entries.

    deviation is the exact sum over dimensions of (n x - S) squared, null beyond a long.  Null and repeated keys are rows
    like others; without a model there is no row.
    """
    kind = dict(vectors.dtypes)[key]
    schema = f"{key} {kind}, deviation long, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n, to = model.dim, model.n, model.components / np.sqrt(model.eigenvalues)

    def exact(x: np.ndarray) -> list[int | None]:
        sums = np.array(model.sums, dtype=object)
        if float(np.abs(x).max(initial=0)) * n < 2.0**62 and max(map(abs, model.sums)) < 1 << 62:
            off = x * n - sums.astype(np.int64)
            if float((off.astype(float) ** 2).sum(1).max(initial=0)) < 2.0**62:
                return (off * off).sum(1).tolist()
        totals = ((x.astype(object) * n - sums) ** 2).sum(1).tolist()
        return [t if t < 1 << 63 else None for t in totals]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = _whole(batch.column(1), dim)
            z = model.centred(x) @ to
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * to.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), pa.array(exact(x), pa.int64()), lists], names=[key, "deviation", "whitened"])

    return vectors.select(key, column).mapInArrow(project, schema)


def component_rows(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector and component: component number from 1, n, deviation, whitened, explained, identity_error."""
    known = model or Whitening(0, 0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    shares = F.array(*[F.lit(float(e / known.trace)) for e in known.eigenvalues]).cast("array<double>")
    rows = whitened(vectors, model, key, column).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(known.identity_error).alias("identity_error"),
    )
