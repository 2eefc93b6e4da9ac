"""Differential programs between groups of cells: pairwise tests, combined p-values, folds, and their plots' tables.

Each pair of groups is tested for each program; a group's p-values are then
combined over its partners.  Folds compare a group's mean usage with that of
all others.  P-values are optimistic: the same cells have shaped the programs.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..plans import specs
from ..sources.assays import require
from . import clustering

log = logging.getLogger(__name__)


def folds(usage: DataFrame) -> DataFrame:
    """(program_idx, program, grp, mean_in, mean_out, fold).

    Means of the others add the other groups' sums, so a program that no other
    group uses has a mean of exactly 0 and an infinite fold.
    """
    sums = usage.groupBy("program_idx", "program", "grp").agg(F.sum("weight").alias("s"), F.count("weight").alias("n"))
    other = sums.select("program_idx", F.col("grp").alias("og"), F.col("s").alias("os"), F.col("n").alias("on"))
    pairs = sums.join(other, "program_idx").filter(F.col("grp") != F.col("og"))
    out = pairs.groupBy("program_idx", "program", "grp").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.sum("os").alias("os"), F.sum("on").alias("on"))
    mean_in, mean_out = F.col("s") / F.col("n"), F.col("os") / F.col("on")
    return out.select("program_idx", "program", "grp", mean_in.alias("mean_in"), mean_out.alias("mean_out"), stats.ratio(mean_in, mean_out).alias("fold"))


#: Slices of a program's values in which ranks are counted apart.
SLICES = 64


def wilcoxon(usage: DataFrame, slices: int = SLICES) -> DataFrame:
    """(program_idx, g1, g2, u, auc, z) for all ordered pairs of groups.

    Counts by value carry everything: for each value, the cells of every group
    at it and below it.  A program's values are cut into slices by its
    quantiles; counts below are summed within a slice, and the slices' totals are
    carried over, so no task holds a program and a value that many cells share is
    one row.  A row has one count a group: the table is values x groups.  Ties
    and continuity are corrected for in z.
    """
    labels = sorted(r[0] for r in usage.select("grp").distinct().collect())  # groups are few: results are their pairs
    at = [f"_c{i}" for i in range(len(labels))]
    rows = usage.groupBy("program_idx", F.col("weight").alias("v")).agg(*[F.count_if(F.col("grp") == F.lit(g)).alias(c) for g, c in zip(labels, at)])
    # One row a program.
    edges = rows.groupBy("program_idx").agg(F.percentile_approx("v", F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(1000)).alias("edges"))
    rows = rows.join(F.broadcast(edges), "program_idx").withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    totals = rows.groupBy("program_idx", "slice").agg(*[F.sum(c).alias(c) for c in at])
    lower = Window.partitionBy("program_idx").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("program_idx", "slice", F.array(*[F.coalesce(F.sum(c).over(lower), F.lit(0)) for c in at]).alias("carried"))
    inside = Window.partitionBy("program_idx", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("program_idx", "slice", F.array(*at).alias("c"), F.array(*[F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in at]).alias("below"))
    rows = rows.join(carried, ["program_idx", "slice"]).select("program_idx", "c", F.zip_with("below", "carried", lambda x, y: x + y).alias("below"))
    d = lambda c: c.cast("double")
    tied = lambda x: x * x * x - x
    # A value counts for the groups that have it; most have none.
    one = rows.select("program_idx", "c", "below", F.posexplode("c").alias("i1", "n1")).filter("n1 > 0")
    both = one.select("program_idx", "i1", d(F.col("n1")).alias("c1"), F.posexplode(F.arrays_zip("c", "below")).alias("i2", "o")).filter("i1 <> i2")
    both = both.select("program_idx", "i1", "i2", "c1", d(F.col("o.c")).alias("c2"), d(F.col("o.below")).alias("b2"))
    # Ties of two groups beyond those of each alone.
    shared = F.when(F.col("c2") > 0, tied(F.col("c1") + F.col("c2")) - tied(F.col("c1")) - tied(F.col("c2"))).otherwise(F.lit(0.0))
    sums = both.groupBy("program_idx", "i1", "i2").agg(F.sum(F.col("c1") * (F.col("b2") + F.lit(0.5) * F.col("c2"))).alias("u"), F.sum(shared).alias("t"))
    own = one.groupBy("program_idx", "i1").agg(F.sum(d(F.col("n1"))).alias("n"), F.sum(tied(d(F.col("n1")))).alias("t"))
    side = lambda i: own.select("program_idx", F.col("i1").alias(f"i{i}"), F.col("n").alias(f"n{i}"), F.col("t").alias(f"t{i}"))
    rows = sums.join(side(1), ["program_idx", "i1"]).join(side(2), ["program_idx", "i2"]).withColumn("t", F.col("t") + F.col("t1") + F.col("t2"))
    total = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * (total + 1.0 - F.col("t") / F.greatest(total * (total - 1.0), F.lit(1.0)))
    diff = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    shift = F.when(diff > 0, F.lit(0.5)).when(diff < 0, F.lit(-0.5)).otherwise(F.lit(0.0))
    z = F.when(var > 0, (diff - shift) / F.sqrt(F.when(var > 0, var))).otherwise(F.lit(0.0))
    name = lambda i: F.element_at(F.array(*[F.lit(g) for g in labels]), F.col(i) + 1)
    return rows.select("program_idx", name("i1").alias("g1"), name("i2").alias("g2"), "u", (F.col("u") / (F.col("n1") * F.col("n2"))).alias("auc"), z.alias("z"))


def _moments(usage: DataFrame) -> DataFrame:
    return usage.groupBy("program_idx", "grp").agg(F.count("weight").cast("double").alias("n"), F.avg("weight").alias("m"), F.coalesce(F.var_samp("weight"), F.lit(0.0)).alias("v"), F.sum((F.col("weight") > 0).cast("double")).alias("k"))


def _pairs(usage: DataFrame) -> DataFrame:
    one = _moments(usage)
    side = lambda i: one.select("program_idx", *[F.col(c).alias(f"{o}{i}") for c, o in (("grp", "g"), ("n", "n"), ("m", "m"), ("v", "v"), ("k", "k"))])
    return side(1).join(side(2), "program_idx").filter(F.col("g1") != F.col("g2"))


def welch(usage: DataFrame) -> DataFrame:
    """(program_idx, g1, g2, effect, t, df): difference of means by Welch's statistic."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    se = a + b
    parts = a * a / F.greatest(F.col("n1") - 1, F.lit(1.0)) + b * b / F.greatest(F.col("n2") - 1, F.lit(1.0))
    t = F.when(se > 0, (F.col("m1") - F.col("m2")) / F.sqrt(F.when(se > 0, se))).otherwise(F.lit(0.0))
    df = F.when(parts > 0, se * se / F.when(parts > 0, parts)).otherwise(F.lit(1.0))
    return _pairs(usage).select("program_idx", "g1", "g2", (F.col("m1") - F.col("m2")).alias("effect"), t.alias("t"), df.alias("df"))


def detection(usage: DataFrame) -> DataFrame:
    """(program_idx, g1, g2, k1, n1, k2, n2, effect): cells that use a program, and the log2 ratio of their shares with a pseudo-count."""
    share = lambda i: (F.col(f"k{i}") + 0.5) / (F.col(f"n{i}") + 1.0)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return _pairs(usage).select("program_idx", "g1", "g2", whole("k1"), whole("n1"), whole("k2"), whole("n2"), F.log2(share(1) / share(2)).alias("effect"))


def pair_tests(usage: DataFrame, test: str = "wilcox") -> DataFrame:
    """(program_idx, g1, g2, effect, p, log_p) of the chosen test."""
    if test == "wilcox":
        rows = wilcoxon(usage).select("program_idx", "g1", "g2", F.col("auc").alias("effect"), stats.log_normal_p("z").alias("log_p"))
    elif test == "t":
        rows = welch(usage).select("program_idx", "g1", "g2", "effect", stats.log_t_p("t", "df").alias("log_p"))
    elif test == "binom":
        # Given all users of both groups, how many fall into the first.
        share = F.col("n1") / (F.col("n1") + F.col("n2"))
        rows = detection(usage).select("program_idx", "g1", "g2", "effect", stats.log_binomial_p("k1", F.col("k1") + F.col("k2"), share).alias("log_p"))
    else:
        raise ValueError(f"test must be wilcox, t or binom, not {test}")
    return rows.select("program_idx", "g1", "g2", "effect", F.exp("log_p").alias("p"), "log_p")


def named(usage: DataFrame) -> DataFrame:
    """Usage whose programs have names: ``Program_i`` where there is none."""
    own = F.concat(F.lit("Program_"), F.col("program_idx"))
    return usage.withColumn("program", F.coalesce("program", own) if "program" in usage.columns else own)


def find_all_deps(usage: DataFrame, group: str = "grp", test: str = "wilcox", pval_type: str = "some", log_p: bool = False, min_prop: float = 0.1) -> DataFrame:
    """One row for each group and program, ordered by ``row_order`` within its group.

    Columns: cell_type, row_order, program, fold_enrichment, mean_usage_in,
    mean_usage_out, p_value, fdr (or log_p_value, log_fdr), summary_effect,
    effects (by partner) and top (the best rank over partners, for ``any``).
    P-values are combined and adjusted as logs, so strong ones don't vanish;
    ``summary_effect`` is that of the comparison the p-value is of.  Cells
    without a group are left out.
    """
    require(usage, group, "program_idx", "weight")
    usage = named(usage)
    kept = usage.filter(F.col(group).isNotNull()).withColumn("grp", F.col(group).cast("string"))
    gone = usage.filter(F.col(group).isNull()).select("cell_id").distinct().count()
    if gone:
        log.warning("%d cells without a group are left out", gone)
    if kept.select("grp").distinct().count() < 2:
        raise ValueError("a test needs two groups at least")
    pairs = pair_tests(kept, test)
    keys = ["g1", "program_idx"]
    effects = pairs.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("g2"), F.col("effect"))))).alias("effects"))
    p = stats.adjust(stats.combine(pairs, keys, pval_type, min_prop, p="log_p", log=True, effect="effect"), ["g1"], log=True)
    rank = F.row_number().over(Window.partitionBy("g1", "g2").orderBy("log_p", "program_idx"))
    top = pairs.withColumn("r", rank).groupBy(*keys).agg(F.min("r").alias("top"))
    f = folds(kept).withColumnRenamed("grp", "g1")
    out = p.join(effects, keys).join(top, keys).join(f, keys)
    first = ["top", "p_value"] if pval_type == "any" else ["p_value"]
    order = F.row_number().over(Window.partitionBy("g1").orderBy(*first, "program_idx"))
    ps = [F.col("p_value").alias("log_p_value"), F.col("fdr").alias("log_fdr")] if log_p else [F.exp("p_value").alias("p_value"), F.exp("fdr").alias("fdr")]
    return out.select(F.col("g1").alias("cell_type"), order.alias("row_order"), "program_idx", "program", F.col("fold").alias("fold_enrichment"), F.col("mean_in").alias("mean_usage_in"), F.col("mean_out").alias("mean_usage_out"), *ps, "summary_effect", "effects", "top")


def _only(rows: DataFrame, column: str, wanted: list[str] | None, what: str) -> DataFrame:
    """Rows of the wanted values; unknown ones are named in the error."""
    if wanted is None:
        return rows
    known = {r[0] for r in rows.select(column).distinct().collect()}
    missing = [str(x) for x in wanted if x not in known]
    if missing or not wanted:
        raise ValueError(f"{what} not found: {', '.join(missing)}" if missing else f"no {what} selected")
    return rows.filter(F.col(column).isin(list(wanted)))


def volcano(deps: DataFrame, cell_types: list[str] | None = None, fold_threshold: float = 1.5, pval_threshold: float = 0.05, top_n: int = 5) -> DataFrame:
    """Points of a volcano plot: log folds with infinite ones placed beyond the finite, classes, labels of the first ``top_n``."""
    require(deps, "cell_type", "program", "fold_enrichment")
    rows = _only(deps, "cell_type", cell_types, "cell types")
    height = stats.neg_log10(F.col("p_value"))
    if "p_value" not in rows.columns:  # logs: a p-value that is 0 as a number still has its height
        height = -F.col("log_p_value") / F.lit(math.log(10))
        rows = rows.withColumn("p_value", F.exp("log_p_value")).withColumn("fdr", F.exp("log_fdr"))
    raw = stats.log2_fold(F.col("fold_enrichment"))
    rows = rows.withColumn("raw", raw).withColumn("neg_log10_pval", height)
    own = Window.partitionBy("cell_type")
    finite = F.when(stats.is_finite(F.col("raw")), F.col("raw"))
    high, low = F.coalesce(F.max(finite).over(own) + 0.5, F.lit(5.0)), F.coalesce(F.min(finite).over(own) - 0.5, F.lit(-5.0))
    rows = rows.withColumn("log2_fold", F.when(F.col("raw") == F.lit(stats.INF), high).when(F.col("raw") == F.lit(-stats.INF), low).otherwise(F.col("raw")))
    fold, sure = F.col("fold_enrichment"), F.col("p_value") <= pval_threshold
    rows = rows.withColumn("significance", F.when(sure & (fold <= 1.0 / fold_threshold), "Depleted").when(sure & (fold >= fold_threshold), "Enriched").otherwise("Not Significant"))
    # Labels go to the strongest points of each cell type; only significant ones are labelled.
    sig = (F.col("significance") != "Not Significant").cast("int")
    rank = F.row_number().over(own.orderBy(F.desc(sig), F.desc("neg_log10_pval"), F.desc(F.abs("log2_fold")), "program"))
    label = F.when((rank <= top_n) & (sig == 1), F.col("program")).otherwise(F.lit(""))
    return rows.select("cell_type", "program", "fold_enrichment", "p_value", "fdr", "neg_log10_pval", "log2_fold", "significance", label.alias("label"))


def fold_matrix(deps: DataFrame, threshold: float = 1.0, programs: list[str] | None = None) -> DataFrame:
    """(program, cell_type, logfc, star): log2 folds, infinite ones as 10 or -10; a star from the threshold on."""
    rows = _only(deps, "program", programs, "programs")
    raw = stats.log2_fold(F.col("fold_enrichment"))
    value = F.when(raw == F.lit(stats.INF), F.lit(10.0)).when(raw == F.lit(-stats.INF), F.lit(-10.0)).otherwise(raw)
    return rows.select("program", "cell_type", value.alias("logfc")).withColumn("star", F.when(F.col("logfc") >= threshold, "*").otherwise(""))


def fold_pivot(matrix: DataFrame) -> DataFrame:
    """Programs as rows, cell types as columns; cell types are listed first, so there is one pass."""
    types = [r[0] for r in matrix.select("cell_type").distinct().orderBy("cell_type").collect()]
    return matrix.groupBy("program").pivot("cell_type", types).agg(F.first("logfc"))


def heatmap(deps: DataFrame, programs: list[str] | None = None, threshold: float = 1.0, cluster_rows: bool = False, cluster_cols: bool = False, colours: tuple[str, ...] = ("#1e90ff", "#ffffff", "#ff0000"), star_size: int = 14) -> tuple[DataFrame, dict]:
    """The heatmap of folds: (row, col, program, cell_type, logfc, star) and its specification.

    Rows are the wanted programs in their order, or all in that of the first
    cell type's tests; columns are the cell types by name.  Clustering puts
    either in the order of a complete-linkage tree over Euclidean distances.
    The matrix is programs x cell types: its order is worked out on the driver.
    """
    require(deps, "cell_type", "program", "fold_enrichment")
    matrix = fold_matrix(deps, threshold, programs)
    types = [r[0] for r in deps.select("cell_type").distinct().orderBy("cell_type").collect()]
    if not types:
        raise ValueError("there are no tests to show")
    if programs is None:
        first = deps.filter(F.col("cell_type") == types[0])
        programs = [r[0] for r in first.orderBy(*[c for c in ("row_order",) if c in deps.columns], "program").select("program").collect()]
    held = {(r["program"], r["cell_type"]): r["logfc"] for r in matrix.collect()}
    grid = np.array([[held.get((p, t), np.nan) for t in types] for p in programs], float)
    rows, cols = clustering.order(grid, cluster_rows), clustering.order(grid.T, cluster_cols)
    spark = deps.sparkSession
    places = lambda names, at, a, b: F.broadcast(spark.createDataFrame([(names[i], n + 1) for n, i in enumerate(at)], f"{a} string, {b} int"))  # noqa: E731  one row a program or cell type
    table = matrix.join(places(programs, rows, "program", "row"), "program").join(places(types, cols, "cell_type", "col"), "cell_type")
    largest = float(np.nanmax(np.abs(grid))) if np.isfinite(grid).any() else 0.0
    spec = specs.heatmap(len(programs), largest, colours, star_size=star_size)
    spec |= {"rows": [programs[i] for i in rows], "columns": [types[i] for i in cols], "columns_font": 8 if len(types) > 20 else 10}
    return table.select("row", "col", "program", "cell_type", "logfc", "star"), spec
