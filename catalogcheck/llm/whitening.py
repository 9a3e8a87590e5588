"""Whitened embeddings: leading eigenpairs of the covariance by a block Jacobi-Davidson method.

Entries become whole numbers, x = floor(64 c) + 1000000, and the vectors are written once as narrow binary blocks in
the shared folder. The covariance V is never formed: Spark jobs return V P = sum of (x - mean) ((x - mean) P) / n for
a few columns P at a time, each task adding up its own rows and a grouping adding up the tasks by dimension. The
driver holds only matrices of (dimension x subspace). Each round

1. takes Ritz pairs of the subspace (Rayleigh-Ritz) and locks the leading ones whose residual is at rounding level,
2. solves the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r of every next target by a few steps of MINRES,
   all targets in step, so that a step is one job; Q holds the locked vectors and the Ritz vectors of all wanted pairs,
3. adds the corrections, made orthogonal, to the subspace, which restarts from its best Ritz vectors when it is full,

until ``COMPONENTS`` pairs (or as many as there are dimensions) are locked.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite entry are dropped; so are vectors of
another length than the most frequent one (the longest of equally frequent ones). Repeated rows and ids are rows like
any other; ids may be null. An empty table, or one without usable vectors, gives no rows. Components whose variance
is zero to rounding (equal vectors, rank below 32) have whitened 0 and leave the identity out of account, so one vector
alone gives zeros and identity_error 0. ``deviation`` is null where it doesn't fit a long; entries beyond +-2^34,
for which it never does, count as that. Columns other than vec_id and embedding are not read. Equal eigenvalues leave
a free choice of directions within their space; all rows use the same. Texts don't occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Targets of a round, and so columns of a product.
BLOCK = 16
#: MINRES steps of a round, and the share of the residual at which they may end.
INNER, FORCING = 8, 1e-4
#: Rounds after which the solver gives up with an error, far beyond what any spectrum has needed.
ROUNDS = 500
#: Vectors of one binary block.
BLOCK_ROWS = 4096
LIMIT = 1 << 40
EPS = float(np.finfo(np.float64).eps)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(64 c) for every entry, as long; without the shift, which no covariance sees."""
    return np.clip(np.floor(values * float(SCALE)), -LIMIT, LIMIT).astype(np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (array of doubles) of the rows that remain."""
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = typed.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    lengths = whole.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return whole.where(F.size("embedding") == (lengths[0]["size"] if lengths else 0))


def blocks(rows: DataFrame) -> DataFrame:
    """The remaining vectors as written binary blocks: ids, n, dim, width (bytes of an entry), data, and sums by dimension."""

    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        kind = next(t for t in (np.int16, np.int32, np.int64) if x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max)
        sums = [int(s) for s in x.sum(axis=0)]
        fields = [[ids], [len(x)], [x.shape[1]], [np.dtype(kind).itemsize], [np.ascontiguousarray(x.astype(kind)).tobytes()], [sums]]
        types = [pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, types, strict=True)], ["ids", "n", "dim", "width", "data", "sums"])

    def run(batches):
        ids, held, count = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            held.append(scaled(flat.reshape(batch.num_rows, -1)))
            ids += batch.column(0).to_pylist()
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                yield packed(ids, np.concatenate(held))
                ids, held, count = [], [], 0
        if count:
            yield packed(ids, np.concatenate(held))

    schema = "ids array<long>, n long, dim int, width int, data binary, sums array<long>"
    return tk.written(usable(rows).mapInArrow(run, schema), "vectors")


def _matrices(batches):
    """(ids, whole numbers without the shift) of every block of a task."""
    for batch in batches:
        for row in batch.to_pylist():
            yield row["ids"], np.frombuffer(row["data"], f"<i{row['width']}").reshape(row["n"], row["dim"])


class Covariance:
    """The covariance of the blocks as an operator: products with a few columns, each one Spark job."""

    def __init__(self, table: DataFrame):
        self.table = table
        sums = table.select("n", F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        sums = sorted(sums, key=lambda r: r["k"])
        self.n = sums[0]["n"] if sums else 0
        self.dim = len(sums)
        self.sums = np.array([r["s"] for r in sums], np.int64)
        #: mean as whole part and rest, so that centring loses nothing
        self.whole = np.array([int(s) // self.n for s in self.sums], np.int64)
        self.rest = np.array([(int(s) % self.n) / self.n for s in self.sums])

    def centring(self):
        """A function for tasks: the rows of a block less the mean."""
        whole, rest = self.whole, self.rest
        return lambda x: (x - whole).astype(np.float64) - rest

    def summed(self, of_block, rows: int, width: int) -> np.ndarray:
        """Sum over all blocks of a (rows x width) matrix: tasks add up their own, a grouping by row adds up the tasks."""
        names = [f"v{i}" for i in range(width)]

        def run(batches):
            total = None
            for _, x in _matrices(batches):
                part = of_block(x)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *(pa.array(np.ascontiguousarray(total[:, i])) for i in range(width))], ["k", *names])

        parts = self.table.mapInArrow(run, ", ".join(["k int", *(f"{v} double" for v in names)]))
        got = parts.groupBy("k").agg(*(F.sum(v).alias(v) for v in names)).toArrow()
        out = np.zeros((rows, width))
        out[got.column("k").to_numpy()] = np.column_stack([got.column(v).to_numpy() for v in names])
        return out

    def __call__(self, p: np.ndarray) -> np.ndarray:
        """V P; columns beyond those given are zero, so that every job has the same plan."""
        wide = np.zeros((self.dim, max(BLOCK, p.shape[1])))
        wide[:, : p.shape[1]] = p
        centred = self.centring()

        def of_block(x):
            c = centred(x)
            return c.T @ (c @ wide)

        return self.summed(of_block, self.dim, wide.shape[1])[:, : p.shape[1]] / self.n

    def trace(self) -> float:
        centred = self.centring()
        return float(self.summed(lambda x: np.square(centred(x)).sum(axis=0)[:, None], self.dim, 1).sum() / self.n)


def orthogonal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of t made orthonormal to each other and to the given bases; what is left of none is dropped."""
    out: list[np.ndarray] = []
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for base in (*against, *(c[:, None] for c in out)):
                column = column - base @ (base.T @ column)
            left = np.linalg.norm(column)
            if not left > 1e-10 * size or left == 0:
                break
            column, size = column / left, 1.0
        else:
            out.append(column)
    return np.array(out).T if out else np.zeros((t.shape[0], 0))


def minres(apply, rhs: np.ndarray, steps: int, share: float) -> np.ndarray:
    """MINRES on all columns in step: ``apply`` gives the (symmetric) products of all of them at once.

    Lanczos vectors with the QR factors of their tridiagonal matrices, by Givens rotations, one scalar for each column.
    """
    size = np.linalg.norm(rhs, axis=0)
    live = size > 0
    beta, v = size.copy(), rhs / np.where(live, size, 1)
    before, x = np.zeros_like(rhs), np.zeros_like(rhs)
    w, w_before = np.zeros_like(rhs), np.zeros_like(rhs)
    c, s, c_before, s_before = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    left = size.copy()
    old_beta = np.zeros_like(size)
    for _ in range(steps):
        y = apply(v)
        alpha = np.einsum("ij,ij->j", v, y)
        y = y - alpha * v - old_beta * before
        beta = np.linalg.norm(y, axis=0)
        epsilon, rest = s_before * old_beta, c_before * old_beta
        delta, gamma = c * rest + s * alpha, c * alpha - s * rest
        rho = np.hypot(gamma, beta)
        safe = np.where(rho > 0, rho, 1)
        c_before, s_before, c, s = c, s, np.where(rho > 0, gamma / safe, 1), np.where(rho > 0, beta / safe, 0)
        w_next = (v - delta * w - epsilon * w_before) / safe
        x = x + np.where(live & (rho > 0), c * left, 0) * w_next
        left = -s * left
        w_before, w = w, w_next
        live = live & (rho > 0) & (beta > EPS * size) & (np.abs(left) > share * size)
        if not live.any():
            break
        before, v, old_beta = v, np.where(live, y / np.where(beta > 0, beta, 1), 0), beta
    return x


def eigenpairs(product, dim: int, wanted: int = COMPONENTS, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading eigenvalues (falling), unit eigenvectors and their products, by block Jacobi-Davidson."""
    wanted = min(wanted, dim)
    most, least = min(dim, wanted + 2 * block), min(dim, wanted + block // 2)
    locked, locked_product, values = np.zeros((dim, 0)), np.zeros((dim, 0)), []
    # as many random columns as pairs are wanted, so that an eigenvalue may fill all of them
    basis = orthogonal(np.random.default_rng(seed).standard_normal((dim, wanted)))
    image = product(basis)
    scale = 0.0
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta)
        theta, turn = theta[order], turn[:, order]
        ritz, ritz_image = basis @ turn, image @ turn
        scale = max([scale, *np.abs(theta), *values])
        residual = ritz_image - ritz * theta
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        done = 0
        # of the leading pairs only: a later one may still move up. A subspace that is all there is holds them all.
        while done < len(theta) and len(values) + done < wanted and size[done] <= max(32, dim) * EPS * scale:
            done += 1
        locked, locked_product = np.hstack([locked, ritz[:, :done]]), np.hstack([locked_product, ritz_image[:, :done]])
        values += list(theta[:done])
        basis, image, theta, residual, size = ritz[:, done:], ritz_image[:, done:], theta[done:], residual[:, done:], size[done:]
        if len(values) == wanted:
            return np.array(values), locked, locked_product
        room = most - len(values)
        if basis.shape[1] + min(block, wanted - len(values)) > room and locked.shape[1] + basis.shape[1] < dim:
            keep = max(1, least - len(values))
            basis, image, theta, residual, size = basis[:, :keep], image[:, :keep], theta[:keep], residual[:, :keep], size[:keep]
        open_ = np.flatnonzero(size[: wanted - len(values)] > max(32, dim) * EPS * scale)[:block]
        fresh = np.zeros((dim, 0))
        if len(open_):
            # all wanted Ritz vectors are projected out, not one's own alone: near copies of an eigenvalue make the equation singular
            shift, r, known = theta[open_], residual[:, open_], np.hstack([locked, basis[:, : wanted - len(values)]])

            def project(t, known=known):
                return t - known @ (known.T @ t)

            def apply(t, project=project, shift=shift):
                t = project(t)
                return project(product(t) - t * shift)

            fresh = orthogonal(minres(apply, project(-r), INNER, FORCING), locked, basis)
        if not fresh.shape[1]:  # the subspace can't grow from its own residuals: give it new directions
            fresh = orthogonal(np.random.default_rng(seed + len(values) + 1).standard_normal((dim, min(block, dim))), locked, basis)
        if fresh.shape[1]:
            basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
        else:  # all of space: one more product takes away what the restarts have gathered
            basis = orthogonal(basis, locked)
            image = product(basis)
    raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs after {ROUNDS} rounds")


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n x - sum)^2 for every row, exactly; None where it doesn't fit a long."""
    far = max(abs(int(x.max()) * n - int(sums.min())), abs(int(x.min()) * n - int(sums.max())))
    if far * far * x.shape[1] < 1 << 63:
        return list(np.square(x.astype(np.int64) * n - sums).sum(axis=1).tolist())
    wide = (x.astype(object) * n - sums.astype(object)) ** 2
    return [v if v < 1 << 63 else None for v in wide.sum(axis=1).tolist()]


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = blocks(rows)
    v = Covariance(table)
    if not v.n:
        return spark.createDataFrame([], schema)
    values, vectors, _ = eigenpairs(v, v.dim, components)
    trace, k = v.trace(), len(values)
    real = values > max(32, v.dim) * EPS * max(values.max(), 0)
    turn = vectors * np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)
    centred = v.centring()

    def moments(x):
        y = centred(x) @ turn
        return np.vstack([y.T @ y, y.sum(axis=0)])

    second = v.summed(moments, k + 1, k) / v.n
    mean = second[k]
    error = float(np.abs(second[:k] - np.outer(mean, mean) - np.diag(real.astype(float))).max())
    explained = values / trace if trace > 0 else np.zeros(k)
    n, sums = v.n, v.sums

    def run(batches):
        for ids, x in _matrices(batches):
            for low in range(0, len(x), 512):
                part, own = x[low : low + 512], ids[low : low + 512]
                m = len(part)
                deviation = exact_deviation(part, n, sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array((centred(part) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.mapInArrow(run, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES: dict[str, str] = {}
