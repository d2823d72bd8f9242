"""Whitening of embeddings by shifted Cholesky QR.

Entries become whole numbers x = floor(scale * c) + offset, so their sums, and the deviations n * x - S from them, are exact. Rows
centred in that way are orthogonalised in passes: each pass solves every block of rows through the triangular factors found
so far and adds up its Gram matrix; the driver takes the Cholesky factor of the sum. The first factor is shifted, so it
exists however ill-conditioned the vectors are; later ones are shifted only where they fail. Passes go on until the Gram matrix
is that of orthonormal columns (or of a projection, where the vectors don't span all dimensions). The composed factors
are R of the QR decomposition of the centred rows, and the SVD of R gives components and eigenvalues without the
covariance ever being squared into another one.

Only sums of one number per dimension and Gram matrices of dimension x dimension leave the tasks; they are added up in rounds
of ``FAN`` until at most that many reach the driver. Nothing else is collected, and no key is shuffled.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries, or an entry so large that it has no exact
whole number (2^53 and more after scaling), are left out; of vectors of differing lengths those of the most frequent length count
(of equally frequent ones the longest) and the others are left out; components without variance are left out, so equal
rows, a single row or an empty table give no row; a deviation beyond 64 bits is null in ``whitened`` (the general form keeps it as
a decimal); repeated rows and null ids are rows like others; other columns don't matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN, BLOCK, MAX_PASSES = 32, 4096, 8
EXACT = float(1 << 53)


def solve_upper(rows: np.ndarray, r: np.ndarray, width: int = 64) -> np.ndarray:
    """rows @ inverse(r) for an upper triangular r, by blocks of columns."""
    out = rows.copy()
    for a in range(0, len(r), width):
        b = min(a + width, len(r))
        if a:
            out[:, a:b] -= out[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            out[:, j] -= out[:, a:j] @ r[a:j, j]
            out[:, j] /= r[j, j]
    return out


def _vectors(batch: pa.RecordBatch, at: int, dim: int):
    """(rows that count, their entries) of a column of vectors with ``dim`` entries each."""
    column = batch.column(at)
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    if not len(rows) or not dim:
        return rows[:0], np.zeros((0, dim))
    entries = column.take(pa.array(rows)).flatten()
    entries = entries.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return rows, entries


class Integers:
    """floor(scale * c) + offset of vectors with ``dim`` entries."""

    def __init__(self, dim: int, scale: float = 64.0, offset: int = 1_000_000):
        self.dim, self.scale, self.offset = dim, scale, offset

    def of(self, batch: pa.RecordBatch, at: int = 0):
        """(rows that remain, whole numbers) by blocks of rows."""
        rows, entries = _vectors(batch, at, self.dim)
        for a in range(0, len(rows), BLOCK):
            with np.errstate(over="ignore"):
                x = np.floor(entries[a:a + BLOCK] * self.scale)
            fine = (np.abs(x) < EXACT).all(1)                      # false for NaN and infinities
            yield rows[a:a + BLOCK][fine], x[fine].astype(np.int64) + self.offset


class Centre:
    """The number of rows and the exact sum of each dimension."""

    def __init__(self, integers: Integers, n: int, sums: list[int]):
        self.integers, self.n, self.sums = integers, n, sums
        # n * x - S as two parts that fit 64 bits: x less the rounded mean, and what the mean was rounded by
        self.mean = [s // n for s in sums] if n else sums
        self.rest = np.array([s - n * m for s, m in zip(sums, self.mean)], np.int64)
        self.small = n < 1 << 31

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; as Python's own integers where they might not fit."""
        d = x - np.array(self.mean, np.int64)
        if self.small and np.abs(d).max(initial=0) < 1 << 31:
            return d * self.n - self.rest
        return d.astype(object) * self.n - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64) if len(x) else np.zeros(x.shape)

    def squared(self, x: np.ndarray) -> list[int]:
        """The exact sum of the squared deviations of every row."""
        d = self.deviations(x)
        if d.dtype != object and np.abs(d).max(initial=0) < 2 ** 31 / max(1, self.integers.dim) ** 0.5:
            return (d * d).sum(1).tolist()
        return [sum(v * v for v in row) for row in d.tolist()]


def added_up(parts: DataFrame) -> list[np.ndarray]:
    """The sums of each named array of ``parts`` (name, values): added up inside tasks, round by round, until at most FAN rows come to
    the driver."""
    def merge(batches):
        total = {}
        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(values.as_buffer(), np.float64)
                total[name] = total[name] + got if name in total else got.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                             ["name", "values"])
    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks).mapInArrow(merge, "name string, values binary")
    out: dict = {}
    for name, values in parts.collect():
        got = np.frombuffer(values, np.float64)
        out[name] = out[name] + got if name in out else got.copy()
    return out


def _emit(total: dict):
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.ravel().tobytes() for v in total.values()], pa.binary())],
                                      ["name", "values"])


def centre(vectors: DataFrame, integers: Integers) -> Centre:
    """Count and exact sums, added up by Spark as decimals: one row per dimension comes back."""
    dim = integers.dim

    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            for rows, x in integers.of(batch):
                n += len(rows)
                # halves of 26 bits, so no block's sum can leave 64 bits
                high, low = x >> 26, x & ((1 << 26) - 1)
                sums = [s + (int(h) << 26) + int(l) for s, h, l in zip(sums, high.sum(0), low.sum(0))]
        if n:
            text = [str(v) for v in [n, *sums]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim), pa.int32()), pa.array(text)], ["dim", "sum"])
    parts = vectors.mapInArrow(run, "dim int, sum string")
    got = dict(parts.groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)"))).collect())
    return Centre(integers, int(got.get(-1, 0)), [int(got.get(d, 0)) for d in range(dim)])


def gram(vectors: DataFrame, middle: Centre, through) -> np.ndarray:
    """The Gram matrix of through(centred rows)."""
    held = vectors.sparkSession.sparkContext.broadcast((middle, through))       # one number per dimension, factors of dimension x dimension

    def run(batches):
        middle, through = held.value
        total = None
        for batch in batches:
            for rows, x in middle.integers.of(batch):
                q = through(middle.centred(x))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield _emit({"gram": total})
    flat = added_up(vectors.mapInArrow(run, "name string, values binary")).get("gram")
    if flat is None:
        return np.zeros((0, 0))
    size = int(len(flat) ** 0.5)
    return flat.reshape(size, size)


class Through:
    """Rows solved through one triangular factor after the other."""

    def __init__(self, factors=()):
        self.factors = list(factors)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        for r in self.factors:
            rows = solve_upper(rows, r)
        return rows


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of g + shift * I; the shift grows until there is one."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, float(np.trace(g)) * np.finfo(float).eps / len(g), np.finfo(float).tiny)


class Whitener:
    """Centre, components (one per column) and eigenvalues, largest first, of those with variance."""

    def __init__(self, middle: Centre, components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.middle, self.components, self.eigenvalues, self.trace = middle, components, eigenvalues, trace

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.eigenvalues)


class Less:
    """Whitened rows less their mean."""

    def __init__(self, model: Whitener, mean: np.ndarray):
        self.model, self.mean = model, mean

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.model.whiten(rows) - self.mean


def fit(vectors: DataFrame, integers: Integers, components: int = 32) -> Whitener:
    """Whitening learned from all remaining vectors."""
    middle = centre(vectors, integers)
    dim, n = integers.dim, middle.n
    none = Whitener(middle, np.zeros((dim, 0)), np.zeros(0), 0.0)
    if n < 2 or not dim:
        return none
    unit = np.finfo(float).eps / 2
    factors: list[np.ndarray] = []
    r = np.eye(dim)
    for turn in range(MAX_PASSES):
        g = gram(vectors, middle, Through(factors))
        if not turn and not np.trace(g) > 0:
            return none
        if turn and np.abs(g @ g - g).max() < 1e-13 * dim:          # orthonormal columns, or a projection of them
            break
        norm = float(np.abs(g).sum(0).max())
        factor = cholesky(g, min(11 * (n * dim + dim * (dim + 1)) * unit, 1e-3) * norm if not turn else 0.0)
        factors.append(factor)
        r = factor @ r
    _, sigma, right = np.linalg.svd(r)
    seen = sigma > sigma[0] * max(dim, 64) * np.finfo(float).eps * 8
    eigenvalues = sigma ** 2 / n
    k = min(components, int(seen.sum()))
    return Whitener(middle, right[:k].T.copy(), eigenvalues[:k], float(eigenvalues.sum()))


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    n = model.middle.n
    held = vectors.sparkSession.sparkContext.broadcast(model)       # at most dimension x components numbers

    def sums(batches):
        model, total = held.value, None
        for batch in batches:
            for rows, x in model.middle.integers.of(batch):
                part = model.whiten(model.middle.centred(x)).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield _emit({"sum": total})
    mean = added_up(vectors.mapInArrow(sums, "name string, values binary"))["sum"] / n
    g = gram(vectors, model.middle, Less(model, mean)) / n
    return float(np.abs(g - np.eye(len(g))).max())


def most_frequent_length(vectors: DataFrame, column: str) -> int:
    """The length most vectors have, the longest of equally frequent ones; 0 where there is none."""
    sizes = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "size")).alias("best")).first()
    return row["best"]["size"] if row["best"] else 0


def whitened(table: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 32, scale: float = 64.0,
             offset: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation decimal, whitened, explained, identity_error) of every remaining row and component."""
    vectors = table.select(F.col(column).cast("array<double>").alias("vector"))
    model = fit(vectors, Integers(most_frequent_length(vectors, "vector"), scale, offset), components)
    k = len(model.eigenvalues)
    error = identity_error(vectors, model) if k else 0.0
    held = table.sparkSession.sparkContext.broadcast(model)
    share = (model.eigenvalues / model.trace).tolist() if k else []
    schema = "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches):
        model = held.value
        for batch in batches:
            for rows, x in model.middle.integers.of(batch, 1):
                m = len(rows)
                if not m or not k:
                    continue
                white = model.whiten(model.middle.centred(x))
                deviation = pa.array([str(v) for v in model.middle.squared(x)]).cast(pa.decimal128(38, 0))
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.middle.n, np.int64)), deviation.take(pa.array(each)), pa.array(white.ravel()),
                     pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    rows = table.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
