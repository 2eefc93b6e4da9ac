"""Queries by name, and the same questions in DuckDB's SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import consensus, deps, factors, nmf, programs
from ..operators.experiment import Experiment
from ..sources import assays

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_U = """u AS (SELECT vec_id AS cell_id, label AS grp, i AS program_idx, 'NMF_' || i AS program,
  greatest(CAST(embedding[i] AS DOUBLE), CAST(0 AS DOUBLE)) AS weight FROM embeddings, range(1, 65) AS t(i))"""
_B = """b0 AS (SELECT p_brand AS feature_id, c_mktsegment AS program, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT feature_id, CAST(dense_rank() OVER (ORDER BY program) AS INTEGER) AS program_idx, program, weight FROM b0)"""
_M = """m AS (SELECT CAST(o_custkey AS VARCHAR) AS cell_id, p_brand AS feature_id, CAST(sum(l_quantity) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_L = _M + """, tot AS (SELECT cell_id, sum(value) AS total FROM m GROUP BY 1),
lg AS (SELECT m.cell_id, feature_id, log2(value / (total / (SELECT avg(total) FROM tot)) + 1.0) AS value FROM m JOIN tot USING (cell_id))"""
_E = "e AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, 'd' || i AS feature_id, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS t(i))"
_FOLD = _U + """, s AS (SELECT program_idx, program, grp, sum(weight) AS s, count(*) AS n FROM u GROUP BY ALL),
f AS (SELECT a.program_idx, a.program, a.grp, a.s / a.n AS mean_in, sum(o.s) / sum(o.n) AS mean_out
  FROM s a JOIN s o ON a.program_idx = o.program_idx AND a.grp <> o.grp GROUP BY a.program_idx, a.program, a.grp, a.s, a.n),
fold AS (SELECT *, CASE WHEN mean_out = 0 THEN CASE WHEN mean_in = 0 THEN 1.0 ELSE CAST('Infinity' AS DOUBLE) END ELSE mean_in / mean_out END AS fold FROM f)"""
_W = _U + """, c AS (SELECT program_idx, weight AS v, grp, count(*) AS c FROM u GROUP BY ALL),
sz AS (SELECT program_idx, grp, count(*) AS n FROM u GROUP BY ALL),
grid AS (SELECT k.program_idx, k.v, sz.grp, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT program_idx, v FROM c) k JOIN sz USING (program_idx)
  LEFT JOIN c ON c.program_idx = k.program_idx AND c.v = k.v AND c.grp = sz.grp),
cum AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY program_idx, grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM grid),
us AS (SELECT a.program_idx, a.grp AS g1, b.grp AS g2, sum(CAST(a.c AS DOUBLE) * (CAST(b.below AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(b.c AS DOUBLE))) AS u,
  sum(pow(CAST(a.c + b.c AS DOUBLE), 3) - CAST(a.c + b.c AS DOUBLE)) AS t FROM cum a JOIN cum b ON a.program_idx = b.program_idx AND a.v = b.v AND a.grp <> b.grp GROUP BY 1, 2, 3),
w0 AS (SELECT us.*, CAST(x.n AS DOUBLE) AS n1, CAST(y.n AS DOUBLE) AS n2 FROM us JOIN sz x ON x.program_idx = us.program_idx AND x.grp = g1 JOIN sz y ON y.program_idx = us.program_idx AND y.grp = g2),
w1 AS (SELECT *, n1 * n2 / 12.0 * (n1 + n2 + 1 - t / greatest((n1 + n2) * (n1 + n2 - 1), 1)) AS var, u - n1 * n2 / 2 AS diff FROM w0),
w AS (SELECT program_idx, g1, g2, u, u / (n1 * n2) AS auc, CASE WHEN var > 0 THEN (diff - CASE WHEN diff > 0 THEN 0.5 WHEN diff < 0 THEN -0.5 ELSE 0 END) / sqrt(var) ELSE 0 END AS z FROM w1)"""


def _erf(x: str) -> str:
    """The error function of x >= 0 as a series of positive terms."""
    return f"CASE WHEN {x} < 1e-150 THEN 0 WHEN {x} > 7 THEN 1 ELSE least(1, 2 / sqrt(pi()) * exp(-{x} * {x}) * {x} * list_sum([exp(n * ln(2 * {x} * {x}) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())) for n in range(0, 161)])) END"


def _beta(a: str, b: str, y: str) -> str:
    """The regularised incomplete beta function by its hypergeometric series, for y well below 1."""
    return f"exp({a} * ln({y}) + {b} * ln(1 - {y}) + lgamma({a} + {b}) - lgamma({a} + 1) - lgamma({b})) * list_sum([exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({y})) for n in range(0, 301)])"


#: Two-sided normal p-values.
_P = _W + f", zx AS (SELECT *, abs(z) / sqrt(2) AS zz FROM w), pv AS (SELECT program_idx, g1, g2, auc AS effect, 1 - ({_erf('zz')}) AS p FROM zx)"


def r6(name: str):
    """A double rounded to 6 places, never minus zero."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


def s6(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Assays.


@query(f"WITH {_M} SELECT cell_id, feature_id, {s6('value', 'value')} FROM m")
def assay_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.purchases(spark, sf_dir).select("cell_id", "feature_id", r6("value"))


@query(f"WITH {_M} SELECT cell_id, {s6('sum(value)', 'total')}, CAST(count(*) AS BIGINT) AS n_features FROM m GROUP BY 1")
def assay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assays.purchases(spark, sf_dir).groupBy("cell_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_features"))
    return out.select("cell_id", r6("total"), "n_features")


@query(f"WITH {_L} SELECT cell_id, feature_id, {s6('value', 'value')} FROM lg")
def assay_lognorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.log_normalise(assays.purchases(spark, sf_dir)).select("cell_id", "feature_id", r6("value"))


@query(f"WITH {_M} SELECT cell_id, feature_id, {s6('value', 'value')} FROM m WHERE feature_id IN ('Brand#11', 'Brand#23', 'Brand#5')")
def subset_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.subset_features(assays.purchases(spark, sf_dir), ["Brand#11", "Brand#23", "Brand#5"]).select("cell_id", "feature_id", r6("value"))


@query(f"WITH {_M} SELECT cell_id, feature_id, {s6('value', 'value')} FROM m WHERE NOT regexp_matches(feature_id, '^Brand#1')")
def exclude_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.exclude_features(assays.purchases(spark, sf_dir), "^Brand#1").select("cell_id", "feature_id", r6("value"))


@query(f"WITH {_E} SELECT CAST(count(*) FILTER (value < 0) AS BIGINT) AS n_negative, coalesce(bool_or(value < 0), false) AS any_negative FROM e")
def negative_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.negative_count(assays.embedding_values(spark, sf_dir))


@query(f"WITH {_E} SELECT cell_id, feature_id, {s6('greatest(value, CAST(0 AS DOUBLE))', 'value')} FROM e")
def clamp_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.clamp(assays.embedding_values(spark, sf_dir)).select("cell_id", "feature_id", r6("value"))


# Factors.

_TOP = "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY program_idx ORDER BY weight DESC, feature_id) AS INTEGER) AS rank FROM b)"


def _top_sql(n: int) -> str:
    return f"WITH {_B}, {_TOP} SELECT program_idx, program, rank, feature_id, {s6('weight', 'weight')} FROM top WHERE rank <= {n}"


def _top(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return factors.top_features(assays.segment_basis(spark, sf_dir), n).select("program_idx", "program", "rank", "feature_id", r6("weight"))

    return run


for _name, _n in (("top_features", 10), ("top_features_n1", 1), ("top_features_all", 1000)):
    QUERIES[_name], ORACLE_SQL[_name] = _top(_n), _top_sql(_n)


def _greedy_sql(k: int, n: int) -> str:
    parts = []
    for i in range(1, k + 1):
        taken = "".join(f" AND NOT EXISTS (SELECT 1 FROM g{j} WHERE g{j}.feature_id = b.feature_id)" for j in range(1, i))
        parts.append(f"g{i} AS (SELECT program_idx, program, feature_id, weight, CAST(row_number() OVER (ORDER BY weight DESC, feature_id) AS INTEGER) AS rank FROM b WHERE program_idx = {i}{taken} QUALIFY rank <= {n})")
    return f"WITH {_B}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT program_idx, program, rank, feature_id, {s6('weight', 'weight')} FROM g{i}" for i in range(1, k + 1))


@query(_greedy_sql(5, 4))
def top_unique_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.top_unique(assays.segment_basis(spark, sf_dir), 4).select("program_idx", "program", "rank", "feature_id", r6("weight"))


def _union_sql(n: int) -> str:
    return f"WITH {_B}, {_TOP}, one AS (SELECT feature_id, program_idx, rank FROM top WHERE rank <= {n} QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY program_idx, rank) = 1) SELECT CAST(row_number() OVER (ORDER BY program_idx, rank) AS INTEGER) AS position, feature_id FROM one"


@query(_union_sql(10))
def top_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.top_union(assays.segment_basis(spark, sf_dir), 10)


@query(_union_sql(5))
def top5_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.top_union(assays.segment_basis(spark, sf_dir), 5)


@query(f"WITH {_B}, z AS (SELECT *, avg(weight) OVER w AS m, stddev_samp(weight) OVER w AS sd FROM b WINDOW w AS (PARTITION BY feature_id)) SELECT feature_id, program_idx, program, {s6('weight', 'weight')}, {s6('CASE WHEN sd > 0 THEN (weight - m) / sd ELSE 0 END', 'z')} FROM z")
def gene_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.z_scores(assays.segment_basis(spark, sf_dir)).select("feature_id", "program_idx", "program", r6("weight"), r6("z"))


@query(f"WITH {_B}, {_TOP}, t AS (SELECT feature_id, count(*) AS lists, min(program_idx) AS only_ FROM top WHERE rank <= 10 GROUP BY 1), best AS (SELECT feature_id, program_idx FROM b QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY weight DESC, program_idx) = 1) SELECT t.feature_id, CASE WHEN lists = 1 THEN only_ ELSE best.program_idx END AS owner FROM t JOIN best USING (feature_id)")
def gene_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.owners(assays.segment_basis(spark, sf_dir), 10)


_SEG = _B + """, h AS (SELECT CAST(c_nationkey AS VARCHAR) AS cell_id, c_mktsegment AS program, CAST(count(*) AS DOUBLE) AS h FROM customer GROUP BY 1, 2)"""


def _segment_usage(spark: SparkSession, sf_dir: str, basis: DataFrame) -> DataFrame:
    customers = assays.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("cell_id"), F.col("c_mktsegment").alias("program")).agg(F.count("*").cast("double").alias("weight"))
    return customers.join(basis.select("program", "program_idx").distinct(), "program")


@query(f"WITH {_SEG} SELECT feature_id, cell_id, {s6('sum(weight * h)', 'value')} FROM b JOIN h USING (program) GROUP BY 1, 2")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = assays.segment_basis(spark, sf_dir)
    return factors.reconstruct(basis, _segment_usage(spark, sf_dir, basis)).select("feature_id", "cell_id", r6("value"))


@query(f"WITH {_SEG} SELECT feature_id, cell_id, {s6('sum(weight * program_idx * 0.5 * h)', 'value')} FROM b JOIN h USING (program) GROUP BY 1, 2")
def reconstruct_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = assays.segment_basis(spark, sf_dir)
    scale = basis.select("program_idx", (F.col("program_idx") * F.lit(0.5)).alias("d")).distinct()
    return factors.reconstruct(basis, _segment_usage(spark, sf_dir, basis), scale).select("feature_id", "cell_id", r6("value"))


# Programs by group.


def _dots_sql(weight: str = "weight", having: str = "") -> str:
    scaled = "v AS (SELECT program_idx, program, grp, weight AS raw, CASE WHEN max(weight) OVER p > min(weight) OVER p THEN (weight - min(weight) OVER p) / (max(weight) OVER p - min(weight) OVER p) ELSE 0 END AS scaled, weight FROM u WINDOW p AS (PARTITION BY program_idx))"
    return f"WITH {_U}, {scaled} SELECT program_idx, program, grp, {s6(f'sum({weight})', 'sum_weight')}, {s6(f'100.0 * avg(CASE WHEN {weight} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)', 'pct_nonzero')} FROM v GROUP BY 1, 2, 3 {having}"


def _dots(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    out = programs.dots(assays.embedding_usage(spark, sf_dir), "grp", **options)
    return out.select(F.col("program_idx").cast("long").alias("program_idx"), "program", "grp", r6("sum_weight"), r6("pct_nonzero"))


@query(_dots_sql())
def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dots(spark, sf_dir)


@query(_dots_sql("scaled"))
def dots_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dots(spark, sf_dir, scale=True)


@query(_dots_sql(having="HAVING 100.0 * avg(CASE WHEN weight > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END) >= 50"))
def dots_min_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dots(spark, sf_dir, min_pct=50.0)


@query(f"WITH {_U} SELECT cell_id, {s6('CAST(embedding[9] AS DOUBLE)', 'x')}, {s6('CAST(embedding[10] AS DOUBLE)', 'y')}, {s6('weight', 'program_usage')} FROM embeddings JOIN u ON vec_id = cell_id AND program_idx = 3")
def dimred_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = assays.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.slice("embedding", 9, 2).alias("coords"))
    return programs.scatter(coords, assays.embedding_usage(spark, sf_dir), 3).select("cell_id", r6("x"), r6("y"), r6("program_usage"))


@query(f"WITH {_L}, g AS (SELECT CAST(c_custkey AS VARCHAR) AS cell_id, c_mktsegment AS grp FROM customer), n AS (SELECT grp, count(*) AS n FROM g GROUP BY 1), a AS (SELECT grp, feature_id, sum(value) / any_value(n) AS mean FROM lg JOIN g USING (cell_id) JOIN n USING (grp) GROUP BY 1, 2), z AS (SELECT *, avg(mean) OVER w AS mm, stddev_samp(mean) OVER w AS sd FROM a WINDOW w AS (PARTITION BY feature_id)) SELECT grp, feature_id, {s6('mean', 'mean')}, {s6('CASE WHEN sd > 0 THEN (mean - mm) / sd ELSE 0 END', 'z')} FROM z")
def grouped_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = assays.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_mktsegment").alias("grp"))
    return programs.grouped_means(assays.log_normalise(assays.purchases(spark, sf_dir)), groups).select("grp", "feature_id", r6("mean"), r6("z"))


# Tests between groups.


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assays.embedding_usage(spark, sf_dir)


def _idx():
    return F.col("program_idx").cast("long").alias("program_idx")


@query(f"WITH {_FOLD} SELECT program_idx, program, grp, {s6('mean_in', 'mean_in')}, {s6('mean_out', 'mean_out')}, {s6('fold', 'fold')} FROM fold")
def fold_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.folds(_usage(spark, sf_dir)).select(_idx(), "program", "grp", r6("mean_in"), r6("mean_out"), r6("fold"))


for _name in ("u", "auc", "z"):

    def _wilcox(spark: SparkSession, sf_dir: str, column: str = _name) -> DataFrame:
        return deps.wilcoxon(_usage(spark, sf_dir)).select(_idx(), "g1", "g2", r6(column))

    QUERIES[f"wilcox_{_name}"], ORACLE_SQL[f"wilcox_{_name}"] = _wilcox, f"WITH {_W} SELECT program_idx, g1, g2, {s6(_name, _name)} FROM w"

_MOM = _U + ", q AS (SELECT program_idx, grp, CAST(count(*) AS DOUBLE) AS n, avg(weight) AS m, coalesce(var_samp(weight), 0) AS v, sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS k FROM u GROUP BY 1, 2)"


@query(f"WITH {_MOM}, t AS (SELECT a.program_idx, a.grp AS g1, b.grp AS g2, a.m - b.m AS effect, a.v / a.n AS x, b.v / b.n AS y, a.n AS n1, b.n AS n2 FROM q a JOIN q b ON a.program_idx = b.program_idx AND a.grp <> b.grp) SELECT program_idx, g1, g2, {s6('effect', 'effect')}, {s6('CASE WHEN x + y > 0 THEN effect / sqrt(x + y) ELSE 0 END', 't')}, {s6('CASE WHEN x + y > 0 THEN (x + y) * (x + y) / (x * x / greatest(n1 - 1, 1) + y * y / greatest(n2 - 1, 1)) ELSE 1 END', 'df')} FROM t")
def welch_t_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.welch(_usage(spark, sf_dir)).select(_idx(), "g1", "g2", r6("effect"), r6("t"), r6("df"))


@query(f"WITH {_MOM} SELECT a.program_idx, a.grp AS g1, b.grp AS g2, CAST(a.k AS BIGINT) AS k1, CAST(a.n AS BIGINT) AS n1, CAST(b.k AS BIGINT) AS k2, CAST(b.n AS BIGINT) AS n2, {s6('log2(((a.k + 0.5) / (a.n + 1)) / ((b.k + 0.5) / (b.n + 1)))', 'effect')} FROM q a JOIN q b ON a.program_idx = b.program_idx AND a.grp <> b.grp")
def binom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.detection(_usage(spark, sf_dir)).select(_idx(), "g1", "g2", "k1", "n1", "k2", "n2", r6("effect"))


def _pair_p(spark: SparkSession, sf_dir: str, test: str = "wilcox") -> DataFrame:
    return deps.pair_tests(_usage(spark, sf_dir), test).select(_idx(), "g1", "g2", "effect", "p", "log_p")


_T = _MOM + f""", t0 AS (SELECT a.program_idx, a.grp AS g1, b.grp AS g2, a.m - b.m AS effect, a.v / a.n AS x, b.v / b.n AS y, a.n AS n1, b.n AS n2 FROM q a JOIN q b ON a.program_idx = b.program_idx AND a.grp <> b.grp),
t1 AS (SELECT *, CASE WHEN x + y > 0 THEN effect / sqrt(x + y) ELSE 0 END AS t, CASE WHEN x + y > 0 THEN (x + y) * (x + y) / (x * x / greatest(n1 - 1, 1) + y * y / greatest(n2 - 1, 1)) ELSE 1 END AS df FROM t0),
t2 AS (SELECT *, t * t / (df + t * t) AS yy, df / 2 AS hb FROM t1),
pv AS (SELECT program_idx, g1, g2, effect, CASE WHEN t = 0 THEN 1 ELSE greatest(0, 1 - {_beta('0.5', 'hb', 'yy')}) END AS p FROM t2)"""
_TERM = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(s) + (n - i) * ln(1 - s))"
_BIN = _MOM + f""", b0 AS (SELECT a.program_idx, a.grp AS g1, b.grp AS g2, CAST(a.k AS BIGINT) AS k, CAST(a.k + b.k AS BIGINT) AS n, a.n / (a.n + b.n) AS s, log2(((a.k + 0.5) / (a.n + 1)) / ((b.k + 0.5) / (b.n + 1))) AS effect FROM q a JOIN q b ON a.program_idx = b.program_idx AND a.grp <> b.grp),
pv AS (SELECT program_idx, g1, g2, effect, CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * least(list_sum([{_TERM} for i in range(0, k + 1)]), list_sum([{_TERM} for i in range(k, n + 1)]))) END AS p FROM b0)"""
for _name, _sql in {"wilcox": _P, "t": _T, "binom": _BIN}.items():

    def _p_values(spark: SparkSession, sf_dir: str, test: str = _name) -> DataFrame:
        return _pair_p(spark, sf_dir, test).select("program_idx", "g1", "g2", r6("effect"), r6("p"))

    QUERIES[f"{_name}_p"], ORACLE_SQL[f"{_name}_p"] = _p_values, f"WITH {_sql} SELECT program_idx, g1, g2, {s6('effect', 'effect')}, {s6('p', 'p')} FROM pv"


_COMBINE = {
    "any": "least(CAST(1 AS DOUBLE), min(p * n / r))",
    "some": "max(holm) FILTER (r = greatest(1, ceil(0.1 * n)))",
    "all": "max(p)",
}
_RANKED = _P + ", k AS (SELECT *, row_number() OVER (PARTITION BY g1, program_idx ORDER BY p, g2) AS r, count(*) OVER (PARTITION BY g1, program_idx) AS n FROM pv), hm AS (SELECT *, least(CAST(1 AS DOUBLE), max((n - r + 1) * p) OVER (PARTITION BY g1, program_idx ORDER BY p, g2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm FROM k)"
for _name, _sql in _COMBINE.items():

    def _combined(spark: SparkSession, sf_dir: str, how: str = _name) -> DataFrame:
        return stats.combine(_pair_p(spark, sf_dir), ["g1", "program_idx"], how).select("g1", "program_idx", r6("p_value"))

    QUERIES[f"combine_{_name}"], ORACLE_SQL[f"combine_{_name}"] = _combined, f"WITH {_RANKED} SELECT g1, program_idx, {s6(_sql, 'p_value')} FROM hm GROUP BY 1, 2"

_BH = _RANKED + """, cp AS (SELECT g1, program_idx, max(p) AS p_value FROM hm GROUP BY 1, 2),
raw AS (SELECT *, p_value * count(*) OVER (PARTITION BY g1) / count(*) OVER (PARTITION BY g1 ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM cp),
bh AS (SELECT *, least(CAST(1 AS DOUBLE), min(raw) OVER (PARTITION BY g1 ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM raw)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.adjust(stats.combine(_pair_p(spark, sf_dir), ["g1", "program_idx"], "all"), ["g1"])


@query(f"WITH {_BH} SELECT g1, program_idx, {s6('p_value', 'p_value')}, {s6('fdr', 'fdr')} FROM bh")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).select("g1", "program_idx", r6("p_value"), r6("fdr"))


# Plots of tests. Some folds are made infinite or zero, so that their replacement is tested.

_DEPS = _BH + ", " + _FOLD[len(_U) + 2 :] + """, d AS (SELECT CAST(bh.g1 AS VARCHAR) AS cell_type, program, CASE WHEN (bh.g1 + bh.program_idx) % 11 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN (bh.g1 + bh.program_idx) % 7 = 0 THEN 0 ELSE fold END AS fold, p_value, fdr
  FROM bh JOIN fold ON fold.program_idx = bh.program_idx AND fold.grp = bh.g1),
v0 AS (SELECT *, CASE WHEN fold = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE log2(fold) END AS raw, -log10(p_value) AS neg_log10_pval FROM d),
v1 AS (SELECT *, coalesce(max(CASE WHEN isfinite(raw) THEN raw END) OVER (PARTITION BY cell_type) + 0.5, 5) AS hi, coalesce(min(CASE WHEN isfinite(raw) THEN raw END) OVER (PARTITION BY cell_type) - 0.5, -5) AS lo FROM v0),
v2 AS (SELECT *, CASE WHEN raw = CAST('Infinity' AS DOUBLE) THEN hi WHEN raw = CAST('-Infinity' AS DOUBLE) THEN lo ELSE raw END AS log2_fold,
  CASE WHEN p_value <= 0.995 AND fold <= 1.0 / 1.05 THEN 'Depleted' WHEN p_value <= 0.995 AND fold >= 1.05 THEN 'Enriched' ELSE 'Not Significant' END AS significance FROM v1),
v AS (SELECT *, CASE WHEN significance <> 'Not Significant' AND row_number() OVER (PARTITION BY cell_type ORDER BY CASE WHEN significance <> 'Not Significant' THEN 1 ELSE 0 END DESC, neg_log10_pval DESC, abs(log2_fold) DESC, program) <= 2 THEN program ELSE '' END AS label FROM v2)"""


def _deps_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _adjusted(spark, sf_dir)
    f = deps.folds(_usage(spark, sf_dir)).select(_idx(), "program", F.col("grp").alias("g1"), "fold")
    odd = F.col("g1") + F.col("program_idx")
    fold = F.when(odd % 11 == 0, F.lit(stats.INF)).when(odd % 7 == 0, F.lit(0.0)).otherwise(F.col("fold"))
    return p.join(f, ["program_idx", "g1"]).select(F.col("g1").cast("string").alias("cell_type"), "program", fold.alias("fold_enrichment"), "p_value", "fdr")


def _volcano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.volcano(_deps_table(spark, sf_dir), fold_threshold=1.05, pval_threshold=0.995, top_n=2)


@query(f"WITH {_DEPS} SELECT cell_type, program, {s6('p_value', 'p_value')}, {s6('neg_log10_pval', 'neg_log10_pval')}, significance FROM v")
def volcano(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volcano(spark, sf_dir).select("cell_type", "program", r6("p_value"), r6("neg_log10_pval"), "significance")


@query(f"WITH {_DEPS} SELECT cell_type, program, {s6('log2_fold', 'log2_fold')} FROM v")
def volcano_inf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volcano(spark, sf_dir).select("cell_type", "program", r6("log2_fold"))


@query(f"WITH {_DEPS} SELECT cell_type, program, label FROM v WHERE label <> ''")
def volcano_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volcano(spark, sf_dir).filter("label <> ''").select("cell_type", "program", "label")


_LOGFC = "CASE WHEN raw = CAST('Infinity' AS DOUBLE) THEN 10 WHEN raw = CAST('-Infinity' AS DOUBLE) THEN -10 ELSE raw END"


@query(f"WITH {_DEPS}, x AS (SELECT program, cell_type, {_LOGFC} AS logfc FROM v0) SELECT program, {', '.join(s6(f'max(logfc) FILTER (cell_type = {chr(39)}{i}{chr(39)})', f'g{i}') for i in range(10))} FROM x GROUP BY 1")
def deps_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = deps.fold_pivot(deps.fold_matrix(_deps_table(spark, sf_dir)))
    return wide.select("program", *[(F.round(F.col(f"`{i}`"), 6) + F.lit(0.0)).alias(f"g{i}") for i in wide.columns[1:]])


@query(f"WITH {_DEPS}, x AS (SELECT program, cell_type, {_LOGFC} AS logfc FROM v0) SELECT program, cell_type, {s6('logfc', 'logfc')}, CASE WHEN logfc >= 0.05 THEN '*' ELSE '' END AS star FROM x")
def deps_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deps.fold_matrix(_deps_table(spark, sf_dir), threshold=0.05).select("program", "cell_type", r6("logfc"), "star")


# All tests of a usage table.


def _full_sql(pairs: str, how: str, columns: str, tail: str = "") -> str:
    """Everything find_all_deps says, from the pairs' p-values and effects (pv)."""
    p, effect = {"any": ("least(CAST(1 AS DOUBLE), min(p * n / r))", "arg_min(effect, r)"), "some": ("max(holm) FILTER (r = spot)", "max(effect) FILTER (r = spot)"), "all": ("max(p)", "arg_max(effect, r)")}[how]
    first = "top, p_value" if how == "any" else "p_value"
    return f"""WITH {pairs}, k AS (SELECT *, row_number() OVER (PARTITION BY g1, program_idx ORDER BY p, CAST(g2 AS VARCHAR)) AS r, count(*) OVER (PARTITION BY g1, program_idx) AS n, row_number() OVER (PARTITION BY g1, g2 ORDER BY p, program_idx) AS place FROM pv),
hm AS (SELECT *, greatest(1, ceil(0.1 * n)) AS spot, least(CAST(1 AS DOUBLE), max((n - r + 1) * p) OVER (PARTITION BY g1, program_idx ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm FROM k),
cp AS (SELECT g1, program_idx, {p} AS p_value, {effect} AS summary_effect, CAST(min(place) AS INTEGER) AS top FROM hm GROUP BY 1, 2),
raw AS (SELECT *, p_value * count(*) OVER (PARTITION BY g1) / count(*) OVER (PARTITION BY g1 ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM cp),
bh AS (SELECT *, least(CAST(1 AS DOUBLE), min(raw) OVER (PARTITION BY g1 ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM raw),
{_FOLD[len(_U) + 2 :]},
every AS (SELECT CAST(bh.g1 AS VARCHAR) AS cell_type, CAST(row_number() OVER (PARTITION BY bh.g1 ORDER BY {first}, bh.program_idx) AS INTEGER) AS row_order, bh.program_idx, program, fold AS fold_enrichment, mean_in AS mean_usage_in, mean_out AS mean_usage_out, p_value, fdr, summary_effect, top FROM bh JOIN fold ON fold.program_idx = bh.program_idx AND fold.grp = bh.g1)
SELECT {columns} FROM every{tail}"""


_DEP_NUMBERS = ["fold_enrichment", "mean_usage_in", "mean_usage_out", "p_value", "fdr", "summary_effect"]
_DEP_COLUMNS = "cell_type, row_order, program_idx, program, top, " + ", ".join(s6(c, c) for c in _DEP_NUMBERS)


def _all_deps(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return deps.find_all_deps(_usage(spark, sf_dir), **options)


for _name, _test, _how, _sql in (("deps_full", "wilcox", "some", _P), ("deps_any", "wilcox", "any", _P), ("deps_all", "wilcox", "all", _P), ("deps_t", "t", "some", _T)):

    def _deps(spark: SparkSession, sf_dir: str, test: str = _test, how: str = _how) -> DataFrame:
        return _all_deps(spark, sf_dir, test=test, pval_type=how).select("cell_type", "row_order", _idx(), "program", "top", *[r6(c) for c in _DEP_NUMBERS])

    QUERIES[_name], ORACLE_SQL[_name] = _deps, _full_sql(_sql, _how, _DEP_COLUMNS)


#: Counts make p-values that are equal but for the last bits, so what their order decides is left out.
_BINOM_NUMBERS = [c for c in _DEP_NUMBERS if c != "summary_effect"]


@query(_full_sql(_BIN, "all", "cell_type, program, " + ", ".join(s6(c, c) for c in _BINOM_NUMBERS)))
def deps_binom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_deps(spark, sf_dir, test="binom", pval_type="all").select("cell_type", "program", *[r6(c) for c in _BINOM_NUMBERS])


@query(_full_sql(_P, "some", f"cell_type, program, {s6('ln(p_value)', 'log_p_value')}, {s6('ln(fdr)', 'log_fdr')}"))
def deps_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_deps(spark, sf_dir, log_p=True).select("cell_type", "program", r6("log_p_value"), r6("log_fdr"))


@query(f"WITH {_P} SELECT CAST(g1 AS VARCHAR) AS cell_type, program_idx, CAST(g2 AS VARCHAR) AS partner, {s6('effect', 'effect')} FROM pv")
def deps_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_deps(spark, sf_dir).select("cell_type", _idx(), F.explode("effects").alias("partner", "effect"))
    return rows.select("cell_type", "program_idx", "partner", r6("effect"))


@query(_full_sql(_P, "some", f"CAST(first.row_order AS INTEGER) AS row, CAST(dense_rank() OVER (ORDER BY every.cell_type) AS INTEGER) AS col, every.program, every.cell_type, {s6('log2(every.fold_enrichment)', 'logfc')}, CASE WHEN log2(every.fold_enrichment) >= 0.05 THEN '*' ELSE '' END AS star", " JOIN every first ON first.program_idx = every.program_idx AND first.cell_type = '0'"))
def deps_heatmap_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of the first cell type's tests."""
    table, _ = deps.heatmap(_all_deps(spark, sf_dir), threshold=0.05)
    return table.select("row", "col", "program", "cell_type", r6("logfc"), "star")


@query(_full_sql(_P, "some", f"CAST(i AS INTEGER) AS place, {s6('-m + 2 * m * i / 100', 'break')}").replace("FROM every", "FROM (SELECT max(abs(log2(fold_enrichment))) AS m FROM every), range(0, 101) AS t(i)"))
def deps_heatmap_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, spec = deps.heatmap(_all_deps(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(spec["breaks"])), "place int, break double").select("place", r6("break"))


@query(_U.join(["WITH ", ""]).replace("label AS grp", "CASE WHEN label < 3 THEN NULL ELSE label END AS grp") + f", {_FOLD[len(_U) + 2 :]} SELECT program, CAST(grp AS VARCHAR) AS cell_type, {s6('mean_in', 'mean_usage_in')}, {s6('mean_out', 'mean_usage_out')} FROM fold".replace("FROM u GROUP", "FROM u WHERE grp IS NOT NULL GROUP"))
def deps_null_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a label are left out of all means."""
    usage = _usage(spark, sf_dir).withColumn("grp", F.when(F.col("grp") >= 3, F.col("grp")))
    return deps.find_all_deps(usage, test="t").select("program", "cell_type", r6("mean_usage_in"), r6("mean_usage_out"))


# The container and what it shows.


def _seen(spark: SparkSession, sf_dir: str) -> Experiment:
    """Usage of the embeddings' components as a result, with the labels and two embeddings."""
    rows = assays.table(spark, sf_dir, "embeddings").withColumn("cell_id", F.col("vec_id").cast("string"))
    usage = _usage(spark, sf_dir).select(F.col("cell_id").cast("string").alias("cell_id"), "program_idx", F.lit(None).cast("string").alias("program"), "weight")
    held = nmf.Factors(assays.segment_basis(spark, sf_dir), usage, [], 0, 0.0, True, 0)
    dimreds = {"UMAP": rows.select("cell_id", F.slice("embedding", 9, 2).alias("coords")), "PCA": rows.select("cell_id", F.slice("embedding", 1, 8).alias("coords"))}
    return Experiment({}, rows.select("cell_id", "label"), dimreds, {"NMF": held})


@query(f"WITH {_U} SELECT CAST(cell_id AS VARCHAR) AS cell_id, {s6('CAST(embedding[9] AS DOUBLE)', 'x')}, {s6('CAST(embedding[10] AS DOUBLE)', 'y')}, {s6('weight', 'program_usage')} FROM embeddings JOIN u ON vec_id = cell_id AND program_idx = 4")
def viz_umap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs without a name go by ``Program_i``."""
    return _seen(spark, sf_dir).umap(program="Program_4")[0].select("cell_id", r6("x"), r6("y"), r6("program_usage"))


@query(f"WITH {_U} SELECT CAST(cell_id AS VARCHAR) AS cell_id, {s6('CAST(embedding[7] AS DOUBLE)', 'x')}, {s6('CAST(embedding[2] AS DOUBLE)', 'y')}, {s6('weight', 'program_usage')} FROM embeddings JOIN u ON vec_id = cell_id AND program_idx = 2")
def viz_dimred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).scatter("PCA", program=2, dims=(7, 2))[0].select("cell_id", r6("x"), r6("y"), r6("program_usage"))


@query(f"SELECT CAST(vec_id AS VARCHAR) AS cell_id, {s6('CAST(embedding[9] AS DOUBLE)', 'x')}, {s6('CAST(embedding[10] AS DOUBLE)', 'y')}, CAST(label AS VARCHAR) AS grp FROM embeddings")
def category_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).category_scatter("label")[0].select("cell_id", r6("x"), r6("y"), "grp")


@query(f"WITH {_U} SELECT CAST(cell_id AS VARCHAR) AS cell_id, program_idx, CAST(grp AS VARCHAR) AS grp, {s6('weight', 'weight')} FROM u")
def grouped_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).grouped_usage("label").select("cell_id", _idx(), F.col("grp").cast("string").alias("grp"), r6("weight"))


@query(_dots_sql().replace("FROM v GROUP", "FROM v WHERE program_idx IN (2, 5, 60) GROUP"))
def dots_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dots(spark, sf_dir, programs=["NMF_60", "NMF_2", "NMF_5"])


def _heatmap_sql(picked: str, value: str) -> str:
    return f"""WITH {picked}, lists AS (SELECT feature_id, count(*) AS lists, min(program_idx) AS only_, min(program_idx * 1000 + rank) AS place FROM picked GROUP BY 1),
rows_ AS (SELECT *, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS row FROM lists),
z AS (SELECT *, avg(weight) OVER w AS m, stddev_samp(weight) OVER w AS sd FROM b WINDOW w AS (PARTITION BY feature_id)),
best AS (SELECT feature_id, program_idx FROM b QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY weight DESC, program_idx) = 1)
SELECT row, z.program_idx AS col, z.feature_id, z.program, {s6('z.weight', 'weight')}, {s6(value, 'value')}, o.program AS owner FROM z JOIN rows_ USING (feature_id) JOIN best USING (feature_id)
JOIN (SELECT DISTINCT program_idx, program FROM b) o ON o.program_idx = CASE WHEN lists = 1 THEN only_ ELSE best.program_idx END"""


def _gene_heatmap(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    table, _ = factors.heatmap(assays.segment_basis(spark, sf_dir), cluster_rows=False, **options)
    return table.select("row", "col", "feature_id", "program", r6("weight"), r6("value"), "owner")


_GREEDY = _greedy_sql(5, 4)


@query(_heatmap_sql(_GREEDY[len("WITH ") : _GREEDY.index(" SELECT program_idx, program, rank, feature_id, round")] + ", picked AS (" + " UNION ALL ".join(f"SELECT program_idx, rank, feature_id FROM g{i}" for i in range(1, 6)) + ")", "CASE WHEN sd > 0 THEN (z.weight - m) / sd ELSE 0 END"))
def gene_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_heatmap(spark, sf_dir, n=4)


@query(_heatmap_sql(f"{_B}, {_TOP}, picked AS (SELECT program_idx, rank, feature_id FROM top WHERE rank <= 6)", "z.weight"))
def gene_heatmap_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_heatmap(spark, sf_dir, n=6, unique=False, scale_rows=False)


@query("""WITH a AS (SELECT user_id AS c, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS x, coalesce(sum(value) FILTER (event_type <> 'click'), 0) AS y FROM events GROUP BY 1),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cxy FROM a),
t AS (SELECT *, 0.5 * atan2(2 * cxy, vx - vy) AS angle FROM m), u AS (SELECT *, cos(angle) AS ux, sin(angle) AS uy FROM t),
s AS (SELECT *, CASE WHEN abs(ux) >= abs(uy) THEN sign(ux) ELSE sign(uy) END AS s1, CASE WHEN abs(uy) >= abs(ux) THEN sign(-uy) ELSE sign(ux) END AS s2 FROM u)
SELECT CAST(c AS VARCHAR) AS cell_id, """ + s6("s1 * ((x - mx) * ux + (y - my) * uy)", "pc1") + ", " + s6("s2 * (-(x - mx) * uy + (y - my) * ux)", "pc2") + " FROM a, s")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks against all else, whose axes have a closed form."""
    kind = F.when(F.col("event_type") == "click", "a_click").otherwise("b_rest")
    out = programs.principal_components(assays.coo(assays.table(spark, sf_dir, "events"), "user_id", kind, "value"), 2)
    return out.select("cell_id", F.col("coords")[0].alias("pc1"), F.col("coords")[1].alias("pc2")).select("cell_id", r6("pc1"), r6("pc2"))


# Factorisation.


def _als_sql(steps: int, columns: str) -> str:
    """Alternating non-negative least squares with two programs, solved in closed form, from a fixed start."""

    def solve(b: str, rows: str) -> str:
        # Both positive, or the better of the two alone.
        return f"""SELECT {rows}, CASE WHEN p > 0 AND q > 0 THEN p WHEN one >= two THEN greatest(b1 / g11, 0) ELSE 0 END AS x1, CASE WHEN p > 0 AND q > 0 THEN q WHEN one >= two THEN 0 ELSE greatest(b2 / g22, 0) END AS x2
  FROM (SELECT *, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) AS p, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) AS q, greatest(b1, 0) * greatest(b1, 0) / g11 AS one, greatest(b2, 0) * greatest(b2, 0) / g22 AS two FROM {b})"""

    parts = ["a AS (SELECT CAST(user_id AS VARCHAR) AS c, event_type AS f, CAST(sum(value) AS DOUBLE) AS v FROM events GROUP BY 1, 2)", "f0 AS (SELECT f, row_number() OVER (ORDER BY f) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT f FROM a))"]
    parts.append("s0 AS (SELECT f, CASE WHEN 2 * i <= m THEN 3 ELSE 1 END AS x1, CASE WHEN i % 2 = 0 THEN 4 ELSE 1 END AS x2 FROM f0), w0 AS MATERIALIZED (SELECT f, x1 / (SELECT CAST(sum(x1) AS DOUBLE) FROM s0) AS x1, x2 / (SELECT CAST(sum(x2) AS DOUBLE) FROM s0) AS x2 FROM s0)")
    half = "wg{0} AS (SELECT sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22 FROM w{0}), wb{0} AS (SELECT c, sum(v * x1) AS b1, sum(v * x2) AS b2 FROM a JOIN w{0} USING (f) GROUP BY 1), h{1} AS MATERIALIZED ({2}), t{1} AS (SELECT sum(x1) AS t1, sum(x2) AS t2 FROM h{1}), n{1} AS MATERIALIZED (SELECT c, x1 / t1 AS x1, x2 / t2 AS x2 FROM h{1}, t{1})"
    for i in range(1, steps + 1):
        parts.append(half.format(i - 1, i, solve(f"wb{i - 1}, wg{i - 1}", "c")))
        parts.append(f"hg{i} AS (SELECT sum(x1 * x1) AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) AS g22 FROM n{i}), hb{i} AS (SELECT f, sum(v * x1) AS b1, sum(v * x2) AS b2 FROM a JOIN n{i} USING (c) GROUP BY 1), r{i} AS MATERIALIZED ({solve(f'hb{i}, hg{i}', 'f')}), d{i} AS (SELECT sum(x1) AS d1, sum(x2) AS d2 FROM r{i}), w{i} AS MATERIALIZED (SELECT f, x1 / d1 AS x1, x2 / d2 AS x2 FROM r{i}, d{i})")
    parts.append(half.format(steps, steps + 1, solve(f"wb{steps}, wg{steps}", "c")))
    k = "CASE WHEN (i = 1) = (d1 >= d2) THEN 1 ELSE 2 END"
    parts.append(f"basis AS (SELECT f AS feature_id, CAST({k} AS INTEGER) AS program_idx, CASE WHEN i = 1 THEN x1 ELSE x2 END AS weight FROM w{steps}, d{steps}, range(1, 3) AS t(i)), usage AS (SELECT c AS cell_id, CAST({k} AS INTEGER) AS program_idx, CASE WHEN i = 1 THEN x1 ELSE x2 END AS weight FROM n{steps + 1}, d{steps}, range(1, 3) AS t(i)), scale AS (SELECT CAST({k} AS INTEGER) AS program_idx, CASE WHEN i = 1 THEN t1 ELSE t2 END AS d FROM t{steps + 1}, d{steps}, range(1, 3) AS t(i))")
    return f"WITH {', '.join(parts)} {columns}"


def _als(spark: SparkSession, sf_dir: str, **options) -> Experiment:
    assay = assays.activity(spark, sf_dir)
    m = assay.select("feature_id").distinct().count()
    start = np.array([[3 if 2 * i <= m else 1, 4 if i % 2 == 0 else 1] for i in range(1, m + 1)], float)
    return Experiment({"counts": assay}).run_nmf(2, "counts", start=start, tol=-1.0, maxit=4, **options)


for _name, _far in (("nmf_basis", False), ("nmf_basis_distributed", True)):

    def _als_basis(spark: SparkSession, sf_dir: str, far: bool = _far) -> DataFrame:
        return _als(spark, sf_dir, local=not far).basis().select("feature_id", "program_idx", r6("weight"))

    QUERIES[_name], ORACLE_SQL[_name] = _als_basis, _als_sql(4, f"SELECT feature_id, program_idx, {s6('weight', 'weight')} FROM basis")


@query(_als_sql(4, f"SELECT cell_id, program_idx, {s6('weight', 'weight')} FROM usage"))
def nmf_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _als(spark, sf_dir).coefficients().select("cell_id", "program_idx", r6("weight"))


@query(_als_sql(4, f"SELECT cell_id, program_idx, {s6('weight * d', 'weight')} FROM usage JOIN scale USING (program_idx)"))
def nmf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage refitted on the basis, on the data's scale."""
    return nmf.project(assays.activity(spark, sf_dir), _als(spark, sf_dir).basis()).select("cell_id", "program_idx", r6("weight"))


@query(_als_sql(4, f"SELECT feature_id, cell_id, {s6('sum(basis.weight * usage.weight * d)', 'value')} FROM basis JOIN usage USING (program_idx) JOIN scale USING (program_idx) GROUP BY 1, 2"))
def nmf_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _als(spark, sf_dir).reconstruct(include_scale=True).select("feature_id", "cell_id", r6("value"))


def _factors(spark: SparkSession, sf_dir: str, **options) -> nmf.Factors:
    return nmf.factorise(assays.log_normalise(assays.purchases(spark, sf_dir)), 5, seed=42, **options)


@query()
def nmf_als(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir).usage


@query()
def nmf_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basis at the default limits, with how the factorisation ended on every row."""
    found = _factors(spark, sf_dir, local=False)
    return found.basis.withColumns({"iterations": F.lit(found.iterations), "final_tol": F.lit(found.final_tol), "converged": F.lit(found.converged)})


@query()
def consensus_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.run_consensus(assays.activity(spark, sf_dir), [2, 3], seed=7)
    return found.basis


_PAIRS = _B + ", x AS (SELECT l.program_idx AS a, r.program_idx AS b, sum(l.weight * r.weight) AS dot FROM b l JOIN b r USING (feature_id) GROUP BY 1, 2), d AS (SELECT x.a, x.b, 1 - x.dot / sqrt(y.dot * z.dot) AS cosine FROM x JOIN x y ON y.a = x.a AND y.b = x.a JOIN x z ON z.a = x.b AND z.b = x.b)"


def _spectra(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return nmf.basis_matrix(assays.segment_basis(spark, sf_dir).withColumn("feature_idx", F.lit(0)))[1].T


@query(f"WITH {_PAIRS} SELECT a, b, {s6('cosine', 'distance')} FROM d")
def cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _spectra(spark, sf_dir)
    rows = [(i + 1, j + 1, consensus.cosine_distance(x[i], x[j])) for i in range(len(x)) for j in range(len(x))]
    return spark.createDataFrame(rows, "a int, b int, distance double").select("a", "b", r6("distance"))


@query(f"WITH {_PAIRS}, near AS (SELECT a, sqrt(greatest(2 * cosine, 0)) AS dist FROM d WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine, b) <= 2) SELECT a AS program_idx, avg(dist) <= 0.06 AS kept FROM near GROUP BY 1")
def density_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = consensus.density_filter(_spectra(spark, sf_dir), 0.06, share=0.5, runs=5)
    return spark.createDataFrame([(i + 1, bool(x)) for i, x in enumerate(kept)], "program_idx int, kept boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brands define each purchasing program of the customers?"""
    return factors.top_features(_factors(spark, sf_dir).basis, 10)


QUERIES["flagship"] = flagship
