"""Tail probabilities and combined p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_tail(z: float) -> float:
    """Two-sided p-value of a normal deviate."""
    return math.erfc(abs(z) / math.sqrt(2))


def log_normal_tail(z: float) -> float:
    """Log of the two-sided p-value, by an asymptotic series where the plain one would vanish."""
    z = abs(z)
    if z < 30:
        return math.log(math.erfc(z / math.sqrt(2)))
    return -z * z / 2 - math.log(z) + 0.5 * math.log(2 / math.pi) + math.log1p(-1 / z**2 + 3 / z**4)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1 - (a + b) * x / (a + 1), tiny) if abs(1 - (a + b) * x / (a + 1)) > tiny else 1 / tiny
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def log_beta_cdf(a: float, b: float, x: float) -> float:
    """Log of the regularised incomplete beta function; it does not vanish where the function itself would."""
    if x <= 0 or x >= 1:
        return 0.0 if x >= 1 else -math.inf
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return front + math.log(_beta_fraction(a, b, x) / a)
    rest = math.exp(front) * _beta_fraction(b, a, 1 - x) / b
    return math.log1p(-rest) if rest < 1 else -math.inf


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    return math.exp(log_beta_cdf(a, b, x))


def log_t_tail(t: float, df: float) -> float:
    """Log of the two-sided p-value of Student's t."""
    return 0.0 if t == 0 else log_beta_cdf(df / 2, 0.5, df / (df + t * t))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return math.exp(log_t_tail(t, df))


def log_binomial_test(k: int, n: int, p: float) -> float:
    """Log of the two-sided exact p-value: twice the smaller tail, 1 at most."""
    if n == 0:
        return 0.0
    lower = 0.0 if k >= n else log_beta_cdf(n - k, k + 1, 1 - p)
    upper = 0.0 if k <= 0 else log_beta_cdf(k, n - k + 1, p)
    return min(0.0, math.log(2) + min(lower, upper))


def binomial_test(k: int, n: int, p: float) -> float:
    return math.exp(log_binomial_test(k, n, p))


def _mapped(one, *columns: pd.Series, missing: float = 0.0) -> pd.Series:
    """A function of numbers over whole columns; rows with a missing number give ``missing``."""
    held = pd.concat(columns, axis=1)
    good = held.notna().all(axis=1).to_numpy()
    out = np.full(len(held), missing)
    out[good] = np.frompyfunc(one, len(columns), 1)(*[held.iloc[:, i].to_numpy()[good] for i in range(len(columns))]).astype(float)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def log_normal_p(z: pd.Series) -> pd.Series:
    return _mapped(log_normal_tail, z)


@F.pandas_udf(DoubleType())
def log_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(lambda a, b: log_t_tail(a, b) if b > 0 else 0.0, t, df)


@F.pandas_udf(DoubleType())
def log_binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return _mapped(lambda a, b, c: log_binomial_test(int(a), int(b), c), k, n, p)


def _times(p: Column, factor: Column, log: bool) -> Column:
    return p + F.ln(factor) if log else p * factor


def combine(pairs: DataFrame, keys: list[str], how: str = "some", min_prop: float = 0.1, p: str = "p", log: bool = False, effect: str | None = None) -> DataFrame:
    """One p-value for each group of ``keys``; with ``log`` both ``p`` and the result are logs.

    ``any``: Simes; ``some``: Holm, then the value at rank ceil(min_prop * n), 1
    at least; ``all``: the largest.  With ``effect`` the effect of the comparison
    that gives the p-value comes along as ``summary_effect``: of the smallest p
    for ``any``, of that rank for ``some``, of the largest p for ``all``.
    """
    one = F.lit(0.0 if log else 1.0)
    shown = lambda x: [x.alias("summary_effect")] if effect else []
    # Equal p-values are ranked by their partner where there is one, so that a rerun agrees.
    tie = [c for c in ("g2",) if c in pairs.columns]
    if how == "all":
        return pairs.groupBy(*keys).agg(F.max(p).alias("p_value"), *shown(F.max_by(effect, F.struct(p, *tie)) if effect else one))
    if how not in ("any", "some"):
        raise ValueError(f"pval_type must be any, some or all, not {how}")
    by = Window.partitionBy(*keys).orderBy(p, *tie)
    ranked = pairs.withColumn("rank", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    if how == "any":
        simes = F.least(one, F.min(_times(F.col(p), F.col("n") / F.col("rank"), log)))
        return ranked.groupBy(*keys).agg(simes.alias("p_value"), *shown(F.min_by(effect, "rank") if effect else one))
    holm = F.least(one, F.max(_times(F.col(p), F.col("n") - F.col("rank") + 1, log)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.greatest(F.lit(1), F.ceil(F.lit(float(min_prop)) * F.col("n")))
    return ranked.withColumn("holm", holm).filter(F.col("rank") == at).select(*keys, F.col("holm").alias("p_value"), *shown(F.col(effect) if effect else one))


def adjust(df: DataFrame, keys: list[str], p: str = "p_value", out: str = "fdr", log: bool = False) -> DataFrame:
    """Benjamini-Hochberg within each group of ``keys``; with ``log`` of and to logs."""
    whole = Window.partitionBy(*keys)
    # Equal p-values share the largest rank among them, as a running minimum from above gives.
    up = F.count("*").over(whole.orderBy(p).rangeBetween(Window.unboundedPreceding, 0))
    raw = df.withColumn("_raw", _times(F.col(p), F.count("*").over(whole) / up, log))
    least = F.min("_raw").over(whole.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(out, F.least(F.lit(0.0 if log else 1.0), least)).drop("_raw")


INF = float("inf")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def ratio(num: Column, den: Column) -> Column:
    """Fold with 0/0 = 1 and x/0 = infinity."""
    return F.when(den == 0, F.when(num == 0, F.lit(1.0)).otherwise(F.lit(INF))).otherwise(num / F.when(den != 0, den))


def log2_fold(x: Column) -> Column:
    """log2 with 0 as minus infinity."""
    return F.when(x == 0, F.lit(-INF)).otherwise(F.log2(x))


def neg_log10(p: Column) -> Column:
    return F.when(p == 0, F.lit(INF)).otherwise(-F.log10(p))
