"""Non-negative matrix factorisation by alternating non-negative least squares.

A is features x cells; W (features x k) and H (cells x k) have columns of unit
sum, and their scale is kept in d.  Zeros are data unless ``mask_zeros``.  Every
cell of the assay has a usage; a cell without a non-zero value uses nothing.

Cells are rows of sparse arrays, kept by Spark.  A half-step sends W with the
job, solves every cell's usage in Arrow batches and returns only k x k and
features x k sums; H is never kept between steps, so lineage stays flat.  Sums
are added in the order of partitions, so a seed gives the same factors again.
Small matrices (by their counted cells times features) run the same kernel on
one machine.  W, features x k, is on the driver by design.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Cells times features up to which a matrix is factorised on the driver, where it is dense.
LOCAL_CELLS = 4_000_000


def _exact(gram: np.ndarray, linear: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows solved exactly on the support that x suggests, and which of them meet the conditions of the minimum."""
    out, fine = x.copy(), np.zeros(len(x), bool)
    patterns, of = np.unique(x > 0, axis=0, return_inverse=True)
    of = of.reshape(-1)
    for i, on in enumerate(patterns):
        at, keep = np.flatnonzero(of == i), np.flatnonzero(on)
        z = np.zeros((len(at), len(gram)))
        if len(keep):
            try:
                z[:, keep] = np.linalg.solve(gram[np.ix_(keep, keep)], linear[np.ix_(at, keep)].T).T
            except np.linalg.LinAlgError:
                continue
        slope = linear[at] - z @ gram
        size = np.abs(linear[at]).max(axis=1, initial=0.0)[:, None] + 1e-300
        good = (z >= 0).all(axis=1) & ((slope <= 1e-9 * size) | on).all(axis=1)
        out[at[good]], fine[at[good]] = z[good], True
    return out, fine


def nnls(gram: np.ndarray, linear: np.ndarray, start: np.ndarray | None = None, sweeps: int = 400) -> np.ndarray:
    """Rows x >= 0 that minimise x G x' / 2 - x b'.

    Cyclic coordinate descent over all rows at once finds which entries are zero;
    every twenty sweeps rows are solved exactly on what is left, and those for
    which that is the minimum are done.
    """
    out = np.zeros_like(linear) if start is None else start.copy()
    diagonal = np.maximum(np.diag(gram), 1e-15)
    todo = np.arange(len(linear))
    for sweep in range(1, sweeps + 1):
        x, moved = out[todo], 0.0
        for j in range(gram.shape[0]):
            new = np.maximum(x[:, j] + (linear[todo, j] - x @ gram[:, j]) / diagonal[j], 0.0)
            moved = max(moved, float(np.abs(new - x[:, j]).max(initial=0.0)))
            x[:, j] = new
        still = moved <= 1e-12 * max(1e-300, float(np.abs(x).max(initial=0.0)))
        if still or sweep % 20 == 0:
            x, fine = _exact(gram, linear[todo], x)
            out[todo] = x
            todo = todo[~fine]
            if still or not len(todo):
                break
        else:
            out[todo] = x
    return out


def least_squares(gram: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """Rows x of any sign that minimise the same."""
    return linear @ np.linalg.pinv(gram)


@dataclass(frozen=True)
class Factors:
    """A factorisation: basis and usage tables, scale, and how it ended."""

    basis: DataFrame
    usage: DataFrame
    scale: list[float]
    iterations: int
    final_tol: float
    converged: bool
    seed: int
    kept: DataFrame | None = None

    def release(self) -> None:
        """Free what Spark keeps of the usage; it is worked out again if it is read later."""
        if self.kept is not None:
            self.kept.unpersist()


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size else 1.0


def sparse_rows(assay: DataFrame, features: list[str]) -> DataFrame:
    """One row for each cell: numbers and values of its non-zero features, in order; other features are ignored."""
    order = assay.sparkSession.createDataFrame([(f, i) for i, f in enumerate(features)], "feature_id string, feature_idx int")
    rows = assay.join(F.broadcast(order), "feature_id", "left")  # one row a feature, as many as W has on the driver
    entry = F.when(F.col("feature_idx").isNotNull() & (F.col("value") != 0), F.struct("feature_idx", "value"))
    packed = rows.groupBy("cell_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return packed.select("cell_id", F.col("e.feature_idx").alias("idx"), F.col("e.value").alias("val"))


def _dense(frame: pd.DataFrame, m: int) -> np.ndarray:
    a = np.zeros((len(frame), m))
    for i, (idx, val) in enumerate(zip(frame["idx"], frame["val"])):
        a[i, idx] = val
    return a


def _usage(a: np.ndarray, w: np.ndarray, l1: float, mask: bool, solve=nnls) -> np.ndarray:
    if not mask:
        return solve(w.T @ w, a @ w - l1)
    out = np.zeros((len(a), w.shape[1]))
    for i, row in enumerate(a):
        at = np.flatnonzero(row)
        out[i] = solve(w[at].T @ w[at], (row[at] @ w[at])[None, :] - l1)[0]
    return out


def _sums(w: np.ndarray, l1: float, mask: bool, solve=nnls):
    """Partial sums of a partition: H'H (for each feature if zeros are masked), A'H and column sums of H."""

    def run(batches):
        m, k = w.shape
        s, b, t = np.zeros((m if mask else 1, k, k)), np.zeros((m, k)), np.zeros(k)
        for frame in batches:
            for i in range(0, len(frame), 2000):
                a = _dense(frame.iloc[i : i + 2000], m)
                h = _usage(a, w, l1, mask, solve)
                s += np.einsum("cf,ci,cj->fij", (a != 0).astype(float), h, h) if mask else (h.T @ h)[None]
                b += a.T @ h
                t += h.sum(axis=0)
        yield pd.DataFrame({"s": [s.ravel()], "b": [b.ravel()], "t": [t]})

    return run


def _project(w: np.ndarray, l1: float, mask: bool, scale: np.ndarray | None = None, solve=nnls):
    """Usage of cells on a fixed basis."""

    def run(batches):
        for frame in batches:
            h = _usage(_dense(frame, w.shape[0]), w, l1, mask, solve)
            h = h if scale is None else h / scale
            yield pd.DataFrame({"cell_id": frame["cell_id"], "weights": list(h)})

    return run


USAGE = "cell_id string, weights array<double>"


def _loop(step, w, tol, maxit, l1, mask, solve=nnls, diag: bool = True, say=log.debug):
    """Alternate until W's correlation with its last value is within tol of 1; returns (w, d, iterations, tol)."""
    change, it = 1.0, 0
    d = np.ones(w.shape[1])
    for it in range(1, maxit + 1):
        s, b, t = step(w)
        if diag:
            t = np.where(t > 0, t, 1.0)  # a dead factor keeps its zeros
            s, b = s / np.outer(t, t)[None], b / t
        if mask:
            new = np.vstack([solve(s[f], b[f : f + 1] - l1) for f in range(len(b))])
        else:
            new = solve(s[0], b - l1)
        if diag:
            d = new.sum(axis=0)
            new = new / np.where(d > 0, d, 1.0)
        change = 1.0 - _correlation(new, w)
        w = new
        say("iteration %d: tol %.3g", it, change)
        if change < tol:
            break
    return w, d, it, change


def factorise(assay: DataFrame, k: int, tol: float = 1e-5, maxit: int = 100, l1: tuple[float, float] = (0.0, 0.0), seed: int | None = None, mask_zeros: bool = False, partitions: int | None = None, local: bool | None = None, cells: DataFrame | None = None, diag: bool = True, nonneg: bool = True, start: np.ndarray | None = None, verbose: bool = False) -> Factors:
    """Factorise ``(cell_id, feature_id, value)``; programs are ordered by their scale, largest first.

    ``l1`` are the penalties of (w, h), taken off the linear term of each
    half-step.  Null or NaN values are an error, negative ones count as zero.
    ``cells`` (cell_id) adds cells of which the assay has no row.  Without
    ``diag`` factors keep whatever size they get, and d is 1; without ``nonneg``
    they may be negative.  ``start`` is the first W (features by name x k)
    instead of a random one.  ``verbose`` logs each iteration as information.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark: SparkSession = assay.sparkSession
    say, solve = log.info if verbose else log.debug, nnls if nonneg else least_squares
    base = assay.select(F.col("cell_id").cast("string").alias("cell_id"), "feature_id", F.col("value").cast("double").alias("value")).persist()
    rows = None
    try:
        value = F.col("value")
        facts = base.agg(F.count_if(value.isNull() | F.isnan("value")).alias("bad"), F.count_if(value < 0).alias("negative")).first()
        if facts["bad"]:
            raise ValueError(f"{facts['bad']} values are null or NaN")
        if facts["negative"]:
            log.warning("%d negative values count as zero", facts["negative"])
        features = sorted(r[0] for r in base.select("feature_id").distinct().collect())
        if not features:
            raise ValueError("the assay is empty")
        rows = sparse_rows(base.withColumn("value", F.greatest("value", F.lit(0.0))), features)
        if cells is not None:
            every = cells.select(F.col("cell_id").cast("string").alias("cell_id")).distinct().join(rows, "cell_id", "full")
            rows = every.select("cell_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("val", F.array().cast("array<double>")).alias("val"))
        n = rows.count()
        if k > min(n, len(features)):
            log.warning("k is %d, but there are %d cells and %d features", k, n, len(features))
        say("factorising %d cells x %d features with k=%d", n, len(features), k)
        seed = int(np.random.default_rng().integers(1 << 31)) if seed is None else seed
        w = np.random.default_rng(seed).random((len(features), k)) if start is None else np.array(start, float)
        w /= w.sum(axis=0)
        near = n * len(features) <= LOCAL_CELLS if local is None else local
        if near:
            frame = rows.toPandas().sort_values("cell_id")
            a = _dense(frame, len(features))

            def step(w):
                h = _usage(a, w, l1[1], mask_zeros, solve)
                s = np.einsum("cf,ci,cj->fij", (a != 0).astype(float), h, h) if mask_zeros else (h.T @ h)[None]
                return s, a.T @ h, h.sum(axis=0)
        else:
            rows = rows.repartition(partitions or spark.sparkContext.defaultParallelism, "cell_id").sortWithinPartitions("cell_id").persist()

            def step(w):
                got = rows.mapInPandas(_sums(w, l1[1], mask_zeros, solve), "s array<double>, b array<double>, t array<double>").withColumn("part", F.spark_partition_id()).collect()
                got = sorted(got, key=lambda r: r["part"])
                add = lambda c: np.sum([np.asarray(r[c]) for r in got], axis=0)
                return add("s").reshape(-1, k, k), add("b").reshape(len(features), k), add("t")

        w, d, it, change = _loop(step, w, tol, maxit, l1[0], mask_zeros, solve, diag, say)
        order = np.argsort(-d, kind="stable")
        w, d = w[:, order], d[order]
        total = step(w)[2] if diag else np.ones(k)
        total = np.where(total > 0, total, 1.0)
        basis = spark.createDataFrame([(i, f, j + 1, f"NMF_{j + 1}", float(w[i, j])) for i, f in enumerate(features) for j in range(k)], "feature_idx int, feature_id string, program_idx int, program string, weight double")
        if near:
            h = _usage(a, w, l1[1], mask_zeros, solve) / total
            wide, kept = spark.createDataFrame(list(zip(frame["cell_id"], h.tolist())), USAGE), None
        else:
            wide = kept = rows.mapInPandas(_project(w, l1[1], mask_zeros, total, solve), USAGE).persist()
            wide.count()  # what it is made of can go
    finally:
        base.unpersist()
        if rows is not None:
            rows.unpersist()
    say("done after %d iterations, tol %.3g", it, change)
    return Factors(basis, long_usage(wide), [float(x) for x in total], it, change, change < tol, seed, kept)


def long_usage(wide: DataFrame) -> DataFrame:
    """(cell_id, program_idx, program, weight) from arrays."""
    rows = wide.select("cell_id", F.posexplode("weights").alias("i", "weight"))
    return rows.select("cell_id", (F.col("i") + 1).alias("program_idx"), F.concat(F.lit("NMF_"), F.col("i") + 1).alias("program"), "weight")


def basis_matrix(basis: DataFrame) -> tuple[list[str], np.ndarray]:
    """Features and W of a basis table: features x programs, which a machine holds by assumption."""
    frame = basis.select("feature_idx", "feature_id", "program_idx", "weight").toPandas()
    wide = frame.pivot(index=["feature_idx", "feature_id"], columns="program_idx", values="weight").sort_index()
    return [x[1] for x in wide.index], wide.to_numpy()


def project(assay: DataFrame, basis: DataFrame, l1: float = 0.0) -> DataFrame:
    """Usage of new cells on a fixed basis, not scaled to unit sums."""
    features, w = basis_matrix(basis)
    return long_usage(sparse_rows(assay, features).mapInPandas(_project(w, l1, False), USAGE))
