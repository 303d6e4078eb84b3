"""Embedding whitening: a centred covariance from all vectors, its leading eigenvectors, and a broadcast projection.

Sums, centred products and the whitened vectors' own covariance are gathered by Spark; only matrices of the size of the
vectors reach the driver, which reduces the covariance to three diagonals by Householder reflections, finds the leading
eigenvalues by bisection on Sturm counts and their vectors by inverse iteration, made orthogonal again within clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.common import opened, read, shipped
from corpusframe.llm.words import column

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: An eigenvalue of less than this part of the greatest is taken for zero: its component has no defined direction.
LEAST = 1e-12
#: Rows that a task multiplies at once.
BLOCK = 4096


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, off-diagonal and q with matrix = q T q', T symmetric and tridiagonal."""
    a, n = np.array(matrix, float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (p @ v) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal (d, e) lie below each x: signs of the Sturm sequence's ratios."""
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.max(e * e, initial=0)))
    ratio, count = np.ones(len(x)), np.zeros(len(x), int)
    for i in range(len(d)):
        ratio = d[i] - x - (e[i - 1] ** 2 / ratio if i else 0)
        ratio = np.where(np.abs(ratio) < tiny, -tiny, ratio)
        count += ratio < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues of the tridiagonal (d, e), falling, each bisected until its bounds are neighbours or nearly so."""
    n = len(d)
    around = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(k, np.min(d - around)), np.full(k, np.max(d + around))
    width = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - width * 1e-12, high + width * 1e-12
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    while True:
        mid = (low + high) / 2
        if np.all((high - low <= 2e-16 * width) | (mid <= low) | (mid >= high)):
            return mid
        above = below(d, e, mid) <= rank
        low, high = np.where(above, mid, low), np.where(above, high, mid)


def _solved(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = b, by elimination with row exchanges; zero pivots are replaced by tiny ones."""
    n = len(d)
    tiny = np.finfo(float).eps * max(np.max(np.abs(d)), np.max(np.abs(e), initial=0), np.finfo(float).tiny)
    u0, u1, u2, y = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low, diag, next_ = e[i], u0[i + 1], u1[i + 1]
        if abs(u0[i]) < abs(low):
            u0[i], low = low, u0[i]
            u1[i], diag = diag, u1[i]
            u2[i], next_ = next_, u2[i]
            y[i], y[i + 1] = y[i + 1], y[i]
        pivot = u0[i] if u0[i] else tiny
        u0[i], m = pivot, low / pivot
        u0[i + 1], u1[i + 1] = diag - m * u1[i], next_ - m * u2[i]
        y[i + 1] -= m * y[i]
    x = np.zeros(n + 2)
    for i in reversed(range(n)):
        pivot = u0[i] if abs(u0[i]) > tiny else np.copysign(tiny, u0[i])
        x[i] = (y[i] - u1[i] * x[i + 1] - u2[i] * x[i + 2]) / pivot
    return x[:n]


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Columns: unit eigenvectors of falling eigenvalues, by inverse iteration; those of near values are made orthogonal in every round."""
    scale = max(float(np.max(np.abs(values))), np.finfo(float).tiny)
    near, out = 1e-3 * scale, np.zeros((len(d), len(values)))
    random = np.random.default_rng(7)
    begin = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            begin = j
        # values that coincide are told apart by a hair, or they would give one vector
        shift = value - (j - begin) * 4e-16 * scale
        x = random.standard_normal(len(d))
        for _ in range(rounds):
            for _ in range(2):
                x -= out[:, begin:j] @ (out[:, begin:j].T @ x)
            x = _solved(d, e, shift, x / np.linalg.norm(x))
            x /= np.max(np.abs(x))
        for _ in range(2):
            x -= out[:, begin:j] @ (out[:, begin:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    d, e, q = householder(matrix)
    values = leading_values(d, e, k)
    return values, q @ tridiagonal_vectors(d, e, values)


def _valid(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors as whole numbers): those of dims entries, none null, all finite."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    at = vectors.offsets.to_numpy()
    size = np.where(np.asarray(vectors.is_valid()), np.diff(at), -1)
    rows = np.flatnonzero(size == dims)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    c = flat[at[:-1][rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    fine = np.isfinite(c).all(axis=1)
    return rows[fine], np.floor(SCALE * c[fine]).astype(np.int64) + SHIFT


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Sums of the arrays v of rows(i, v), by i: first in tasks, then over tasks; as many arrays reach the driver as there are i."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(column(b, "i").to_pylist(), column(b, "v"), strict=True):
                total[i] = total.get(i, 0) + v.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "v"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(tasks, "i").mapInArrow(add, rows.schema).collect()
    out = np.zeros((width, width))
    for r in found:
        out[r["i"], : len(r["v"])] = r["v"]
    return out


def _products(of, width: int):
    """Partial products of the centred (or projected) vectors of a task: a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, mean, project = opened(of)
        total = np.zeros((width, width))
        for b in batches:
            _, x = _valid(column(b, "embedding"), dims)
            for i in range(0, len(x), BLOCK):
                c = x[i : i + BLOCK] - mean
                c = c if project is None else c @ project
                total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    return run


class Whitening(NamedTuple):
    """What a fit knows: vectors n, sums a dimension, the means, eigenvalues, and the columns that project and scale a centred vector."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    project: np.ndarray
    trace: float
    identity_error: float


def finite(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows whose vector is not null, has no null and no infinite entry and the most frequent length (of equals the greatest)."""
    fine = embeddings.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))").select("vec_id", "embedding")
    sizes = fine.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return fine.where(F.size("embedding") == (sizes["size"] if sizes else 0))


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of embeddings(vec_id, embedding) of finite(); None without vectors or entries."""
    spark = embeddings.sparkSession
    entries = embeddings.select(F.posexplode("embedding").alias("i", "c")).select("i", (F.floor(SCALE * F.col("c").cast("double")) + SHIFT).alias("x"))
    found = {r["i"]: r for r in entries.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()}
    if not found:
        return None
    dims, n = len(found), found[0]["n"]
    sums = [found[i]["s"] for i in range(dims)]
    mean = np.array([s // n + (s % n) / n for s in sums])
    rows = embeddings.select("embedding")
    moments = lambda project, width: _summed(rows.mapInArrow(_products(shipped(spark, (dims, mean, project)), width), "i int, v array<double>"), width) / n
    covariance = moments(None, dims)
    trace = float(np.trace(covariance))
    values, vectors = leading((covariance + covariance.T) / 2, min(components, dims)) if trace > 0 else (np.zeros(0), np.zeros((dims, 0)))
    keep = values > LEAST * max(values, default=0)
    values, vectors = values[keep], vectors[:, keep]
    project = vectors / np.sqrt(values)
    error = float(np.max(np.abs(moments(project, len(values)) - np.eye(len(values))))) if len(values) else 0.0
    return Whitening(n, sums, mean, values, project, trace, error)


def _projected(of, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whitening = opened(of)
        k, sums = len(w.values), np.array(w.sums, object)
        for b in batches:
            rows, x = _valid(column(b, "embedding"), len(w.sums))
            for i in range(0, len(x), BLOCK):
                part, own = x[i : i + BLOCK], rows[i : i + BLOCK]
                far = int(np.max(np.abs(part - w.mean), initial=0) + 2) * w.n
                if w.n * int(np.max(np.abs(part), initial=0)) < 2**62 and far * far * len(sums) < 2**62 and max(map(abs, w.sums)) < 2**62:
                    deviation = ((w.n * part - sums.astype(np.int64)) ** 2).sum(axis=1)
                else:  # beyond 64 bits on the way: whole numbers of any size
                    deviation = ((w.n * part.astype(object) - sums) ** 2).sum(axis=1)
                names = column(b, "vec_id").take(pa.array(own)).cast(kind)
                spread = np.repeat(np.arange(len(own)), k)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(spread)), pa.array(np.tile(np.arange(1, k + 1), len(own)), pa.int32()), pa.array(np.full(len(spread), w.n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(((part - w.mean) @ w.project).ravel()), pa.array(np.tile(w.values / w.trace, len(own))), pa.array(np.full(len(spread), w.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector of embeddings(vec_id, embedding) and component.

    Vectors that are null or hold a null or a non-finite entry are left out, as are those of another length than the most
    frequent (of equally frequent ones the longest); each remaining row counts, repeated ones and those of a null vec_id too.
    Components of no variance (less than 1e-12 of the first one's) have no defined direction and no rows: one vector alone,
    equal vectors, vectors without entries and an empty table give an empty result. deviation is exact; one that needs more
    than 64 bits is an error. Other columns are not read. Matrices of the size of a vector squared pass through the driver.
    """
    rows = finite(embeddings)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_projected(shipped(embeddings.sparkSession, model), to_arrow_type(embeddings.schema["vec_id"].dataType)), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
