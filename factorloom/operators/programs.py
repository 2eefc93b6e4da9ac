"""Tables behind the plots of programs: dots, scatter, heatmaps."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.assays import require

log = logging.getLogger(__name__)

#: Features whose covariance one machine decomposes.
MOST_FEATURES = 5000


def select_programs(df: DataFrame, programs: list | None) -> DataFrame:
    """Rows of programs given by number or by name; unknown ones are named in the error."""
    if programs is None:
        return df
    if not programs:
        raise ValueError("no program selected")
    numbers = all(isinstance(p, int) for p in programs)
    column = "program_idx" if numbers else "program"
    known = {r[0] for r in df.select(column).distinct().collect()}
    missing = [str(p) for p in programs if p not in known]
    if missing:
        raise ValueError(f"programs not found: {', '.join(missing)}")
    return df.filter(F.col(column).isin(list(programs)))


def dots(usage: DataFrame, group: str, programs: list | None = None, scale: bool = False, min_pct: float = 0.0) -> DataFrame:
    """(program_idx, program, grp, sum_weight, pct_nonzero) for each program and group.

    Rows without a group are left out.  ``scale`` maps each program's weights to
    0..1 over all its cells first; a constant program becomes 0.
    """
    require(usage, group, "program_idx", "weight")
    rows = select_programs(usage, programs).filter(F.col(group).isNotNull())
    if scale:
        # One row a program.
        ends = rows.groupBy("program_idx").agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
        low, high = F.col("low"), F.col("high")
        rows = rows.join(F.broadcast(ends), "program_idx").withColumn("weight", F.when(high > low, (F.col("weight") - low) / F.when(high > low, high - low)).otherwise(F.lit(0.0))).drop("low", "high")
    out = rows.groupBy("program_idx", "program", F.col(group).alias("grp")).agg(F.sum("weight").alias("sum_weight"), (100.0 * F.avg((F.col("weight") > 0).cast("double"))).alias("pct_nonzero"))
    return out.filter(F.col("pct_nonzero") >= min_pct)


def _check_dims(coords: DataFrame, dims: tuple[int, int], name: str) -> None:
    has = coords.agg(F.min(F.size("coords"))).first()[0] or 0
    if min(dims) < 1 or has < max(dims):
        raise ValueError(f"dimensions {', '.join(map(str, dims))} aren't all in {name}, which has {has}")


def axis_labels(name: str, dims: tuple[int, int], labels: list[str] | None = None) -> tuple[str, str]:
    """The labels of two dimensions: their own names, or the embedding's with a number."""
    return tuple(labels[d - 1] if labels else f"{name}{d}" for d in dims)


def scatter(coords: DataFrame, usage: DataFrame, program: int | str = 1, dims: tuple[int, int] = (1, 2), name: str = "the embedding") -> DataFrame:
    """(cell_id, x, y, program_usage): an embedding's coordinates with one program's usage."""
    require(coords, "cell_id", "coords")
    _check_dims(coords, dims, name)
    one = select_programs(usage, [program]).select("cell_id", F.col("weight").alias("program_usage"))
    return _points(coords, dims).join(one, "cell_id")


def _points(coords: DataFrame, dims: tuple[int, int]) -> DataFrame:
    return coords.select("cell_id", F.element_at("coords", dims[0]).cast("double").alias("x"), F.element_at("coords", dims[1]).cast("double").alias("y"))


def category_scatter(coords: DataFrame, groups: DataFrame, dims: tuple[int, int] = (1, 2), name: str = "the embedding") -> DataFrame:
    """(cell_id, x, y, grp): an embedding's coordinates with a label; cells without one have null."""
    require(coords, "cell_id", "coords")
    require(groups, "cell_id", "grp")
    _check_dims(coords, dims, name)
    return _points(coords, dims).join(groups.select("cell_id", F.col("grp").cast("string").alias("grp")), "cell_id", "left")


def principal_components(assay: DataFrame, n: int = 50) -> DataFrame:
    """(cell_id, coords): the cells on the first principal components of the features.

    Means and products of features are summed in Spark (absent pairs are zero);
    their covariance, features x features, is decomposed on the driver, and
    cells are projected in Arrow batches.  A component's largest loading is
    positive, so a rerun agrees.
    """
    from . import nmf

    features = sorted(r[0] for r in assay.select("feature_id").distinct().collect())
    m = len(features)
    if not 1 <= n <= m:
        raise ValueError(f"{n} components of {m} features")
    if m > MOST_FEATURES:
        raise ValueError(f"{m} features; select {MOST_FEATURES} at most, as their covariance is worked out on one machine")
    rows = nmf.sparse_rows(assay.select(F.col("cell_id").cast("string"), "feature_id", F.col("value").cast("double")), features).persist()

    def sums(batches):
        total, product, count = np.zeros(m), np.zeros((m, m)), 0
        for frame in batches:
            a = nmf._dense(frame, m)
            total, product, count = total + a.sum(axis=0), product + a.T @ a, count + len(a)
        yield pd.DataFrame({"t": [total], "p": [product.ravel()], "n": [count]})

    try:
        got = rows.mapInPandas(sums, "t array<double>, p array<double>, n long").withColumn("part", F.spark_partition_id()).collect()
        got = sorted(got, key=lambda r: r["part"])
        count = sum(r["n"] for r in got)
        mean = np.sum([r["t"] for r in got], axis=0) / count
        cov = (np.sum([r["p"] for r in got], axis=0).reshape(m, m) - count * np.outer(mean, mean)) / max(1, count - 1)
        _, vectors = np.linalg.eigh(cov)
        axes = vectors[:, ::-1][:, :n]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(n)])

        def project(batches):
            for frame in batches:
                yield pd.DataFrame({"cell_id": frame["cell_id"], "coords": list((nmf._dense(frame, m) - mean) @ axes)})

        return rows.mapInPandas(project, "cell_id string, coords array<double>")
    finally:
        rows.unpersist()


def grouped_means(assay: DataFrame, groups: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(grp, feature_id, mean, z): mean value over a group's cells, absent pairs as zero, and its z-score over groups."""
    kept = assay.filter(F.col("feature_id").isin(features)) if features else assay
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    sums = kept.join(groups, "cell_id").groupBy("grp", "feature_id").agg(F.sum("value").alias("s"))
    means = sums.join(sizes, "grp").select("grp", "feature_id", (F.col("s") / F.col("n")).alias("mean"))
    row = Window.partitionBy("feature_id")
    sd = F.stddev_samp("mean").over(row)
    return means.withColumn("z", F.when(sd > 0, (F.col("mean") - F.avg("mean").over(row)) / F.when(sd > 0, sd)).otherwise(F.lit(0.0)))
