"""PCA by the Gram matrix or by block Lanczos passes, and Mahalanobis outliers.

The distributed part is the sum of products of each row's standardised cells: samples by samples for a
small roster, the smaller side (samples or rows) by a narrow block in each pass for any other. Everything after it is linear
algebra of that size on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Up to this many samples the Gram matrix is made at once; beyond it, passes over the cells are cheaper.
GRAM_SAMPLES = 512
#: Vectors (samples long) that the driver holds between restarts, and passes after which it gives up.
MAX_BASIS, MAX_PASSES = 240, 400
#: Cells of a packed block, at least; bytes of partial sums that a pass may send to the driver without adding them first.
BLOCK, SENT = 1 << 18, 64 << 20


def gram_matrix(cells: DataFrame, samples: list[str]) -> np.ndarray:
    """``Z'Z`` of ``row_id, sample_id, z`` with missing cells 0. Rows are gathered as sparse vectors; each task
    adds up its own matrix, about the square root of as many tasks add those, and the driver the rest, one
    at a time. Rosters above ``GRAM_SAMPLES`` go through ``pca``, which needs no such matrix."""
    k = len(samples)
    spark = cells.sparkSession
    order = spark.createDataFrame([(s, i) for i, s in enumerate(samples)], "sample_id string, i int")
    rows = cells.join(order, "sample_id").groupBy("row_id").agg(F.collect_list(F.struct("i", "z")).alias("c"))

    def packed(g: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                i, v = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                z = np.zeros((part.num_rows, k))
                z[np.repeat(np.arange(part.num_rows), part.column(0).value_lengths().to_numpy()), i] = v
                g += z.T @ z
        yield packed(g)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for b in batches:
            for x in b.column(0):
                g += np.frombuffer(x.as_py()).reshape(k, k)
        yield packed(g)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.select(F.col("c.i").alias("i"), F.col("c.z").alias("z")).mapInArrow(partial, "g binary")
    sums = sums.repartition(max(1, math.isqrt(tasks))).mapInArrow(add, "g binary")
    g = np.zeros((k, k))
    for r in sums.toLocalIterator():
        g += np.frombuffer(bytes(r["g"])).reshape(k, k)
    return g


def standardised(view: DataFrame, rows: DataFrame, moments: DataFrame) -> DataFrame:
    m = moments.select("sample_id", "mean", "std")
    return view.join(rows.select("row_id"), "row_id").join(m, "sample_id").select(
        "row_id", "sample_id", ((F.col("value") / 10000.0 - F.col("mean")) / F.col("std")).alias("z")
    )


def standardised_fractions(cells: DataFrame) -> DataFrame:
    """The same from ``row_id, sample_id, fraction`` in full precision: each sample's mean and deviation over
    its own cells; at most one cell gives 0 and 1, a zero deviation counts as 1."""
    m = cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k"), F.avg("fraction").alias("mean"), F.stddev_samp("fraction").alias("std"))
    m = m.select("sample_id", F.when(F.col("k") > 1, F.col("mean")).otherwise(F.lit(0.0)).alias("mean"), F.when((F.col("k") > 1) & (F.col("std") > 0), F.col("std")).otherwise(F.lit(1.0)).alias("std"))
    return cells.join(m, "sample_id").select("row_id", "sample_id", ((F.col("fraction") - F.col("mean")) / F.col("std")).alias("z"))


def pca_from_gram(gram: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample coordinates and explained-variance ratios. The sign of each component makes its largest
    loading positive; the number of components is at most the matrix's size."""
    n = min(n_components, len(gram))
    values, vectors = np.linalg.eigh(gram)
    return _coordinates(values[::-1][:n], vectors[:, ::-1][:, :n], np.trace(gram))


def _coordinates(values: np.ndarray, vectors: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    values = np.maximum(values, 0)
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]) if n else np.ones(0)
    return vectors * np.where(flip == 0, 1, flip) * np.sqrt(values), values / total if total else np.zeros(n)


def _blocks(cells: DataFrame, by: str, at: str, width: int, rows: np.ndarray) -> DataFrame:
    """The cells ``i, row_id, z`` packed in blocks of whole groups of equal ``by``, in which ``at`` numbers a vector's
    entries; a row's number is its place in ``rows`` where one of the two is ``row_id`` and it is not empty. A task
    holds one block, of about ``BLOCK`` cells or one group."""
    spark = cells.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast(rows)
    least = max(BLOCK, width)

    def block(g: np.ndarray, i: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
        i = np.searchsorted(sent.value, i) if at == "row_id" else i
        x = (g[start], start, i.astype(np.int32), z)
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in x], ["g", "start", "i", "z"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, want = [], 0, least
        for b in batches:
            parts.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            n += b.num_rows
            if n < want:
                continue
            g, i, z = (np.concatenate(c) for c in zip(*parts))
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield block(g[:cut], i[:cut], z[:cut])
            parts, n = [[g[cut:], i[cut:], z[cut:]]], len(g) - cut
            want = max(least, 2 * n)
        if n:
            yield block(*(np.concatenate(c) for c in zip(*parts)))

    cells = cells.select(F.col(by).cast("long"), F.col(at).cast("long"), "z").repartition(tasks, by).sortWithinPartitions(by)
    return cells.mapInArrow(packed, "g binary, start binary, i binary, z binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for g, start, i, z in zip(*(b.column(c) for c in range(4))):
            yield (np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(start.as_buffer(), np.int64), np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(z.as_buffer()))


def _times_gram(blocks: DataFrame, v: np.ndarray) -> np.ndarray:
    """``A'A v`` for the matrix A whose rows are the groups of ``blocks``, by one pass over them. Each core sends one
    vector block of the size of ``v`` at a time, all in one job; where those would be more than ``SENT`` bytes for
    the driver, they are added up by ranges of entries first, and it gets one."""
    k, b = v.shape
    spark = blocks.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(v.T))
    parts = 1 if tasks * v.nbytes <= SENT else min(k, max(tasks, -(-v.nbytes // SENT)))
    edges = [k * p // parts for p in range(parts + 1)]

    def batch(p: int, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["p", "y"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, y = sent.value, np.zeros((b, k))
        for _, start, i, z in _unpacked(batches):
            size = np.diff(start, append=len(i))
            for c in range(b):
                t = np.add.reduceat(v[c][i] * z, start)
                y[c] += np.bincount(i, np.repeat(t, size) * z, k)
        for p in range(parts):
            yield batch(p, y[:, edges[p] : edges[p + 1]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x in batches:
            for p, y in zip(x.column(0).to_pylist(), x.column(1)):
                y = np.frombuffer(y.as_buffer())
                sums[p] = sums[p] + y if p in sums else y
        for p, y in sums.items():
            yield batch(p, y)

    out = blocks.coalesce(tasks).mapInArrow(partial, "p int, y binary")
    if parts > 1:
        out = out.repartition(parts, "p").mapInArrow(add, "p int, y binary")
    y = np.zeros((b, k))
    for r in out.collect():
        lo, hi = edges[r["p"]], edges[r["p"] + 1]
        y[:, lo:hi] += np.frombuffer(r["y"]).reshape(b, hi - lo)
    sent.destroy()
    return np.ascontiguousarray(y.T)


def _times(blocks: DataFrame, v: np.ndarray, size: int) -> np.ndarray:
    """``A v`` by the groups' numbers, ``size`` of them; 0 for a number without a cell."""
    k, b = v.shape
    sent = blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v.T))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, start, i, z in _unpacked(batches):
            y = np.stack([np.add.reduceat(x[i] * z, start) for x in sent.value])
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["g", "y"])

    out = np.zeros((size, b))
    for r in blocks.mapInArrow(product, "g binary, y binary").collect():
        g = np.frombuffer(r["g"], np.int64)
        out[g] = np.frombuffer(r["y"]).reshape(b, len(g)).T
    sent.destroy()
    return out


def top_eigenpairs(times, k: int, n: int, tol: float = 1e-8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and vectors of a symmetric matrix of size k that is only known by
    ``times(block)``: block Lanczos with full orthogonalisation and thick restarts. Ends when each pair's
    residual is at most ``tol`` of the smallest of the n values; never with an unfinished result."""
    b = n + 5

    def orthonormal(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = q.T @ x
        x = x - q @ c
        d = q.T @ x
        w, r = np.linalg.qr(x - q @ d)
        w, s = np.linalg.qr(w - q @ (q.T @ w))
        return w, s @ r, c + d

    new, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, b)))
    basis, h = np.zeros((k, 0)), np.zeros((0, 0))
    for _ in range(MAX_PASSES):
        m = basis.shape[1]
        basis = np.hstack([basis, new])
        new, r, c = orthonormal(times(new), basis)
        h = np.block([[h, c[:m]], [c[:m].T, (c[m:] + c[m:].T) / 2]])
        values, s = np.linalg.eigh(h)
        values, s = values[::-1], s[:, ::-1]
        left = np.linalg.norm(r @ s[-b:, :n], axis=0)
        if (left <= tol * max(values[n - 1], values[0] * 1e-9)).all():
            return values[:n], basis @ s[:, :n]
        if basis.shape[1] + b > MAX_BASIS:
            keep = min(3 * b, basis.shape[1])
            basis, h = basis @ s[:, :keep], np.diag(values[:keep])
    raise RuntimeError(f"{MAX_PASSES} passes did not give {n} components; residuals {left}")


def pca(cells: DataFrame, samples: list[str], n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every sample and explained-variance ratios from ``row_id, sample_id, z`` with
    missing cells 0. A small roster goes through its Gram matrix; any other is read once into sparse blocks
    and gets its leading components by passes over them. The vectors of the passes number the rows where
    those are fewer than the samples, else the samples: ``ZZ'`` and ``Z'Z`` have the same eigenvalues, and ``Z'`` takes
    vectors of the one to those of the other. So neither the driver nor a task ever holds more than the
    smaller side times ``MAX_BASIS``. Without a single cell nothing is defined, and all is NaN."""
    k = len(samples)
    if k <= GRAM_SAMPLES:
        gram = gram_matrix(cells, samples)
        if not np.trace(gram):
            return np.full((k, min(n_components, k)), np.nan), np.full(min(n_components, k), np.nan)
        return pca_from_gram(gram, n_components)
    spark = cells.sparkSession
    order = spark.createDataFrame(pa.table({"sample_id": pa.array(samples, pa.string()), "i": np.arange(k, dtype=np.int32)}), "sample_id string, i int")
    numbered = cells.join(order, "sample_id").select("i", F.col("row_id").cast("long").alias("row_id"), "z").persist()
    try:
        total = numbered.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
        if not total:
            return np.full((k, n_components), np.nan), np.full(n_components, np.nan)
        rows = np.sort(numbered.select("row_id").distinct().limit(k).toPandas()["row_id"].to_numpy())
        by_sample = GRAM_SAMPLES < len(rows) < k
        by, at, width = ("i", "row_id", len(rows)) if by_sample else ("row_id", "i", k)
        blocks = _blocks(numbered, by, at, width, rows if by_sample else rows[:0])
        blocks = cut_lineage(blocks)  # a cached plan would be planned and kept anew by every pass
    finally:
        numbered.unpersist()
    values, vectors = top_eigenpairs(lambda v: _times_gram(blocks, v), width, n_components)
    if by_sample:
        x = _times(blocks, vectors, k)
        size = np.linalg.norm(x, axis=0)
        vectors = x / np.where(size > 0, size, 1)
    return _coordinates(values, vectors, total)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series or continued fraction."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * scale


def chi_square_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1.0
    while _gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def mahalanobis(coordinates: np.ndarray, alpha: float = 0.999) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (NaN for rows that are not finite) and outlier flags."""
    ok = np.isfinite(coordinates).all(axis=1)
    d = np.full(len(coordinates), np.nan)
    if ok.sum() < 3:
        return d, np.zeros(len(coordinates), bool)
    x = coordinates[ok]
    y = x - x.mean(axis=0)
    inv = np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False, ddof=1)))
    d[ok] = np.einsum("ij,jk,ik->i", y, inv, y)
    return d, np.nan_to_num(d) > chi_square_quantile(alpha, coordinates.shape[1])
