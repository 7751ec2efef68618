"""Whitening of embeddings by shifted Cholesky orthogonalisation of their distributed Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import discard, partial_sum, releasing, staged, tree_sum

#: Entries become floor(SCALE * entry).
SCALE = 256
#: Gram passes at most; three are enough for any matrix of full rank.
PASSES = 5
#: An eigenvalue under this share of the trace for each dimension can't be told from rounding.
RANK = 64 * np.finfo(float).eps
#: Exact sums go by limbs of this many bits, whose float sums stay exact up to 2^37 rows.
LIMB = 16
UNIT = np.finfo(float).eps / 2


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n vectors of `dims` entries with sums S (exact), and the components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dims x components
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.dims)


def whole(vector: Column) -> Column:
    """floor(SCALE * entry) of every entry as long; entries beyond the range of long become its ends."""
    return F.transform(vector, lambda e: F.floor(e.cast("double") * SCALE))


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its entries are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as long integers."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangular r, by forward substitution over the columns."""
    out = np.empty_like(a)
    for j in range(len(r)):
        out[:, j] = (a[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of gram + shift * identity; the shift grows from rounding size where that isn't positive definite."""
    size = max(float(np.trace(gram)), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, UNIT * size)


def _summed(fit: DataFrame, of: object, width: int) -> np.ndarray:
    """Sum over all rows' batches of of(x): an array of `width` numbers for a matrix of vectors."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(batch.column(0))
        yield partial_sum(total)

    found = tree_sum(fit.mapInArrow(run, "place long, block int, part binary"))
    return found if len(found) else np.zeros(width)


def fit_whitening(vectors: DataFrame, components: int = 4, vector_col: str = "embedding") -> Whitening:
    """Components of the covariance of the distinct whole vectors (divisor n, centred before multiplying).

    Each pass reads the fit list once, takes the centred rows through the triangular solves of the factors found so far and
    sums their Gram matrix by partitions; its Cholesky factor (the first with the shift that keeps it positive definite) is
    the next factor. The product R of the factors has the singular values and right vectors of the centred rows. Only
    matrices of dims x dims leave the tasks. Cases: vectors that usable() refuses take no part; of several lengths the one of
    most distinct vectors counts (ties: the longer), others take no part; eigenvalues that can't be told from rounding, as of
    constant or dependent dimensions or a single vector, give no component; an empty table gives n = 0 and none.
    """
    kept = vectors.where(usable(F.col(vector_col))).select(whole(F.col(vector_col)).alias("x"))
    fit = staged(kept.distinct(), "fit")
    size = fit.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    n, d = (size["n"], size["dims"]) if size else (0, 0)
    if not d:
        discard(fit)
        return Whitening(n if d else 0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    rows = fit.where(F.size("x") == d)

    def limbs(column: pa.Array) -> np.ndarray:
        x, out = matrix(column, d), []
        for _ in range(3):
            out.append((x & ((1 << LIMB) - 1)).sum(axis=0))
            x = x >> LIMB
        return np.concatenate([*out, x.sum(axis=0)]).astype(float)

    parts = _summed(rows, limbs, 4 * d).reshape(4, d)
    sums = tuple(sum(int(parts[i, j]) << (LIMB * i) for i in range(4)) for j in range(d))
    mean = np.array([s / n for s in sums])
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        gram = _summed(rows, lambda c, f=tuple(factors): _gram(c, d, mean, f), d * d).reshape(d, d)
        gram = (gram + gram.T) / 2
        shift = 11 * (n * d + d * (d + 1)) * UNIT * float(np.linalg.norm(gram, 2)) if k == 0 else 0.0
        if not gram.any():
            break
        factors.append(cholesky(gram, shift))
        if k > 1 and np.abs(gram - np.eye(d)).max() < 1e-10:
            break
    r = np.eye(d) if factors else np.zeros((d, d))
    for factor in factors:
        r = factor @ r
    _, sigma, vt = np.linalg.svd(r)
    e = sigma**2 / n
    trace = float(e.sum())
    k = min(components, int((e > RANK * d * trace).sum())) if trace > 0 else 0
    chosen, values = np.ascontiguousarray(vt[:k].T), e[:k]
    error = 0.0
    if k:
        scale = chosen / np.sqrt(values)
        got = _summed(rows, lambda c: _moments(c, d, mean, scale), k + k * k)
        first = got[:k] / n
        error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(first, first) - np.eye(k)).max())
    discard(fit)
    return Whitening(n, sums, chosen, values, trace, error)


def _gram(column: pa.Array, d: int, mean: np.ndarray, factors: tuple[np.ndarray, ...]) -> np.ndarray:
    a = matrix(column, d) - mean
    for r in factors:
        a = solved(a, r)
    return (a.T @ a).ravel()


def _moments(column: pa.Array, d: int, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    w = (matrix(column, d) - mean) @ scale
    return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2 for each row, exactly; None beyond the range of long."""
    if not len(x):
        return []
    reach = n * int(np.abs(x.astype(float)).max()) + max(map(abs, sums))
    if reach * reach * len(sums) < 1 << 62:
        z = n * x - np.array(sums, np.int64)
        return (z * z).sum(axis=1).tolist()
    z = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def whitened(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row of the model's length and component.

    component counts from 1 by falling eigenvalue; whitened is the centred whole vector projected on the component, over the
    root of its eigenvalue. Rows that repeat an id or a vector each get their rows; a null id stays null; deviation is null
    beyond the range of long; other columns are ignored, whatever their names.
    """
    id_type = vectors.schema[id_col].dataType.simpleString()
    k, mean = len(model.eigenvalues), model.mean
    scale = model.components / np.sqrt(model.eigenvalues) if k else np.zeros((model.dims, 0))
    explained = model.eigenvalues / model.trace if k else np.zeros(0)
    n, sums, error, dims = model.n, model.sums, model.identity_error, model.dims
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1), dims)
            rows = np.repeat(np.arange(m), k)
            values = [
                batch.column(0).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                pa.array(((x - mean) @ scale).ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(values, names=names)

    vector = F.col(vector_col)
    kept = vectors.where(usable(vector) & (F.size(vector) == dims)) if k else vectors.limit(0)
    out = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return kept.select(F.col(id_col).alias("id"), whole(vector).alias("x")).mapInArrow(run, out)
