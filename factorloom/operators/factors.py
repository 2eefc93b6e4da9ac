"""Questions about the factors: top features, unions, unique picks, z-scores, owners, reconstruction.

A basis is the long table ``(feature_id, program_idx, program, weight)``, a
usage table ``(cell_id, program_idx, program, weight)``.  Equal weights are
ordered by feature id, or by ``feature_idx`` where the basis has one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import specs
from . import clustering
from .programs import select_programs


def _tie(basis: DataFrame) -> str:
    return "feature_idx" if "feature_idx" in basis.columns else "feature_id"


def top_features(basis: DataFrame, n: int = 10) -> DataFrame:
    """(program_idx, program, rank, feature_id, weight): the n largest weights of each program."""
    if n < 1:
        raise ValueError("n must be at least 1")
    rank = F.row_number().over(Window.partitionBy("program_idx").orderBy(F.desc("weight"), _tie(basis)))
    return basis.withColumn("rank", rank).filter(F.col("rank") <= n).select("program_idx", "program", "rank", "feature_id", "weight")


def top_lists(basis: DataFrame, n: int = 10) -> DataFrame:
    """One row for each program with its top features as an array."""
    top = top_features(basis, n).groupBy("program_idx", "program").agg(F.sort_array(F.collect_list(F.struct("rank", "feature_id"))).alias("t"))
    return top.select("program_idx", "program", F.col("t.feature_id").alias("features"))


def top_unique(basis: DataFrame, n: int = 10) -> DataFrame:
    """Greedy picks: each program in turn takes its n best of what earlier ones left.

    Sequential by nature: one step for each program.  Only the n picks of a
    step are carried on, so a step's list has at most programs * n names.
    """
    chosen: list[str] = []
    out = None
    tie = _tie(basis)
    for idx in sorted(r[0] for r in basis.select("program_idx").distinct().collect()):
        left = basis.filter(F.col("program_idx") == idx)
        left = left.filter(~F.col("feature_id").isin(chosen)) if chosen else left
        picked = left.orderBy(F.desc("weight"), tie).limit(n)
        chosen += [r[0] for r in picked.select("feature_id").collect()]
        part = top_features(left, n)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the basis has no program")
    return out


def top_union(basis: DataFrame, n: int = 5) -> DataFrame:
    """(position, feature_id): features of all top lists once, in the order in which they are first met."""
    first = top_features(basis, n).groupBy("feature_id").agg(F.min(F.struct("program_idx", "rank")).alias("first"))
    return first.select(F.row_number().over(Window.orderBy("first.program_idx", "first.rank")).alias("position"), "feature_id")


def z_scores(basis: DataFrame, programs: list | None = None) -> DataFrame:
    """Weights of each feature, centred and scaled over the selected programs; constant rows give 0."""
    kept = select_programs(basis, programs)
    row = Window.partitionBy("feature_id")
    sd = F.stddev_samp("weight").over(row)
    z = F.when(sd > 0, (F.col("weight") - F.avg("weight").over(row)) / F.when(sd > 0, sd)).otherwise(F.lit(0.0))
    return kept.select("feature_id", "program_idx", "program", "weight", z.alias("z"))


def owners(basis: DataFrame, n: int = 10) -> DataFrame:
    """(feature_id, owner): of the features in top lists, the only program that lists them, else the one of largest weight."""
    top = top_features(basis, n).groupBy("feature_id").agg(F.count("*").alias("lists"), F.min("program_idx").alias("only"))
    best = basis.withColumn("r", F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("weight"), "program_idx"))).filter("r = 1").select("feature_id", F.col("program_idx").alias("best"))
    return top.join(best, "feature_id").select("feature_id", F.when(F.col("lists") == 1, F.col("only")).otherwise(F.col("best")).alias("owner"))


#: Features of a block of the basis, and values of a basis that is sent to every machine.
BLOCK, BROADCAST = 4096, 4_000_000


def reconstruct(basis: DataFrame, usage: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """(feature_id, cell_id, value): products of basis and usage, with the factors' scale ``(program_idx, d)`` if given.

    Each cell's usage and each feature's weights are arrays over the programs;
    the product is worked out where a cell is, against blocks of features, so
    products are never shuffled.  Blocks are broadcast while the counted basis is
    small; beyond, they are paired with partitions of cells.
    """
    left = basis.select("program_idx", "feature_id", F.col("weight").alias("w"))
    if scale is not None:
        left = left.join(scale, "program_idx").withColumn("w", F.col("w") * F.col("d")).drop("d")
    programs = sorted(r[0] for r in left.select("program_idx").distinct().collect())  # k numbers
    weights = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("program_idx") == p, F.col(c))), F.lit(0.0)) for p in programs])
    rows = left.groupBy("feature_id").agg(weights("w").alias("w"))
    n = rows.count()
    blocks = rows.groupBy(F.pmod(F.xxhash64("feature_id"), F.lit(n // BLOCK + 1)).alias("block")).agg(F.collect_list(F.struct("feature_id", "w")).alias("features")).select("features")
    cells = usage.select("program_idx", "cell_id", F.col("weight").alias("h")).groupBy("cell_id").agg(weights("h").alias("h"))
    pairs = cells.crossJoin(F.broadcast(blocks) if n * len(programs) <= BROADCAST else blocks)  # the result has every pair
    out = pairs.select("cell_id", "h", F.explode("features").alias("f"))
    dot = F.aggregate(F.zip_with("f.w", "h", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return out.select("f.feature_id", "cell_id", dot.alias("value"))


#: The colours of programs beside a heatmap, repeated beyond.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def heatmap(basis: DataFrame, programs: list | None = None, n: int = 10, unique: bool = True, scale_rows: bool = True, cluster_rows: bool = True, cluster_cols: bool = False, colours: tuple[str, ...] = ("#1e90ff", "#ffffff", "#ff0000")) -> tuple[DataFrame, dict]:
    """The heatmap of programs' top features: (row, col, feature_id, program, weight, value, owner) and its specification.

    ``unique`` lets each program in turn take its n best of what earlier ones
    left, otherwise lists may share features.  ``value`` is the z-score over the
    chosen programs with ``scale_rows``, else the weight.  ``owner`` is the
    program that lists the feature, of several the one of largest weight.  Rows
    keep the order in which they were chosen unless they are clustered.  What is
    shown is programs x their lists: its order is worked out on the driver.
    """
    kept = select_programs(basis, programs)
    if programs is not None:  # in the order asked for
        column = "program_idx" if isinstance(programs[0], int) else "program"
        place = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(programs) for x in (p, i + 1)]), F.col(column))
        kept = kept.withColumn("program_idx", place)
    picked = top_unique(kept, n) if unique else top_features(kept, n)
    lists = picked.select("program_idx", "program", "rank", "feature_id", "weight").collect()
    chosen = list(dict.fromkeys(r["feature_id"] for r in sorted(lists, key=lambda r: (r["program_idx"], r["rank"]))))
    listed: dict[str, set[str]] = {}
    for r in lists:
        listed.setdefault(r["feature_id"], set()).add(r["program"])
    spark = basis.sparkSession
    small = kept.join(F.broadcast(spark.createDataFrame([(f,) for f in chosen], "feature_id string")), "feature_id")
    table = z_scores(small).select("feature_id", "program_idx", "program", "weight", (F.col("z") if scale_rows else F.col("weight")).alias("value"))
    held = {(r["feature_id"], r["program"]): r for r in table.collect()}
    names = [p for _, p in sorted({(r["program_idx"], r["program"]) for r in held.values()})]
    grid = np.array([[held[f, p]["value"] for p in names] for f in chosen])
    rows, cols = clustering.order(grid, cluster_rows), clustering.order(grid.T, cluster_cols)
    best = lambda f: max(names, key=lambda p: (held[f, p]["weight"], -names.index(p)))
    owner = {f: next(iter(listed[f])) if len(listed[f]) == 1 else best(f) for f in chosen}
    out = [(i + 1, j + 1, chosen[r], names[c], float(held[chosen[r], names[c]]["weight"]), float(grid[r, c]), owner[chosen[r]]) for i, r in enumerate(rows) for j, c in enumerate(cols)]
    spec = specs.heatmap(len(chosen), float(np.abs(grid).max(initial=0.0)), colours, small_above=50, small=6, font=8)
    spec |= {"rows": [chosen[r] for r in rows], "columns": [names[c] for c in cols], "annotation": {"owner": {p: PALETTE[i % len(PALETTE)] for i, p in enumerate(names)}}}
    return spark.createDataFrame(out, "row int, col int, feature_id string, program string, weight double, value double, owner string"), spec
