"""Consensus factorisation: many runs, their spectra clustered, unstable ones dropped, usage refitted.

Runs are independent.  While the counted matrix is small enough for one machine
each run is a Spark task; a larger one is factorised by all machines together,
run after run.  What comes back is runs * k spectra of the features' length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import permutations as _permutations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import specs
from . import factors, nmf
from .clustering import leaf_order, linkage  # noqa: F401

log = logging.getLogger(__name__)


def cosine_distance(x: np.ndarray, y: np.ndarray) -> float:
    """1 - cosine; 1 if either is zero."""
    size = float(np.sqrt((x @ x) * (y @ y)))
    return 1.0 - float(x @ y) / size if size else 1.0


def pairwise_distances(spectra: np.ndarray) -> np.ndarray:
    """Euclidean distances of spectra scaled to unit length."""
    size = np.sqrt((spectra**2).sum(axis=1, keepdims=True))
    x = spectra / np.where(size > 0, size, 1)
    return np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))


def density_filter(spectra: np.ndarray, threshold: float = 0.5, share: float = 0.3, runs: int | None = None) -> np.ndarray:
    """Which spectra have close neighbours: mean distance to the nearest share of runs within the threshold."""
    d = np.sort(pairwise_distances(spectra), axis=1)
    near = max(1, int(share * (runs or len(spectra))))
    return d[:, 1 : near + 1].mean(axis=1) <= threshold if len(spectra) > 1 else np.ones(len(spectra), bool)


def kmeans(x: np.ndarray, k: int, seed: int = 0, maxit: int = 1000) -> np.ndarray:
    """Cluster numbers; starts far apart (k-means++), ties go to the lower number."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() else int(rng.integers(len(x)))]])
    label = np.full(len(x), -1)
    for _ in range(maxit):
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        centres = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
    return label


def consensus_matrix(valid: np.ndarray, clusters: np.ndarray, total: int) -> np.ndarray:
    """1 where two spectra share a cluster, 0 elsewhere and for dropped ones."""
    out = np.zeros((total, total))
    at = np.flatnonzero(valid) if valid.dtype == bool else valid
    out[np.ix_(at, at)] = clusters[:, None] == clusters[None]
    return out


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    d, out = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)), []
    for i, own in enumerate(label):
        same = (label == own) & (np.arange(len(x)) != i)
        other = [d[i, label == j].mean() for j in np.unique(label) if j != own]
        if same.any() and other:
            a, b = d[i, same].mean(), min(other)
            out.append((b - a) / max(a, b) if max(a, b) else 0.0)
        else:
            out.append(0.0)
    return float(np.mean(out)) if out else 0.0


def cophenetic_distances(d: np.ndarray) -> np.ndarray:
    """Heights at which average linkage joins each pair, by a nearest-neighbour chain: O(n^2)."""
    n = len(d)
    d, coph = d.astype(float), np.zeros((n, n))
    np.fill_diagonal(d, np.inf)  # joined clusters are infinitely far too
    members, open_, chain = [np.array([i]) for i in range(n)], np.ones(n, bool), []
    for _ in range(n - 1):
        chain = chain or [int(np.argmax(open_))]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        coph[np.ix_(members[a], members[b])] = coph[np.ix_(members[b], members[a])] = d[a, b]
        p, q = len(members[a]), len(members[b])
        d[a] = d[:, a] = (p * d[a] + q * d[b]) / (p + q)
        d[b] = d[:, b] = d[a, a] = np.inf
        members[a], open_[b] = np.concatenate([members[a], members[b]]), False
    return coph


def cophenetic_correlation(consensus: np.ndarray) -> float:
    """Correlation of distances with the heights at which average linkage joins their pairs.

    1 if either doesn't vary.  A matrix of one clustering holds 0 and 1 alone, a
    tree of two heights that average linkage returns as it is: its value is 1.
    """
    d, pairs = 1.0 - consensus, np.triu_indices(len(consensus), 1)
    x, y = d[pairs], cophenetic_distances(d)[pairs]
    # Rounded, so that equal values don't get different ranks by the last bits.
    return round(float(np.corrcoef(x, y)[0, 1]), 12) if len(x) > 1 and x.std() and y.std() else 1.0


def permutations(k: int) -> list[tuple[int, ...]]:
    return list(_permutations(range(k)))


def greedy_matching(cor: np.ndarray) -> list[int]:
    """For each row a column of its own, best correlations first."""
    cor, out = cor.astype(float).copy(), [-1] * len(cor)
    for _ in range(min(cor.shape)):
        i, j = np.unravel_index(int(np.argmax(cor)), cor.shape)
        out[i] = int(j)
        cor[i, :] = cor[:, j] = -np.inf
    return out


def assignment(gain: np.ndarray) -> list[int]:
    """For each row a column of its own so that the summed gain is the largest, by shortest augmenting paths: O(n^3)."""
    n, m = gain.shape
    if n > m:
        raise ValueError("there are more rows than columns")
    cost = gain.max() - gain
    rows, cols = np.zeros(n), np.zeros(m + 1)  # prices; the last column is where a search begins
    owner = np.full(m + 1, -1)
    for i in range(n):
        owner[m], at = i, m
        least, came, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            row = owner[at]
            slack = cost[row] - rows[row] - cols[:m]
            closer = ~done[:m] & (slack < least)
            least[closer], came[closer] = slack[closer], at
            free = np.where(done[:m], np.inf, least)
            nearest = int(np.argmin(free))
            step = free[nearest]
            rows[owner[done]] += step
            cols[done] -= step
            least[~done[:m]] -= step
            at = nearest
        while at != m:  # hand columns on along the path
            owner[at] = owner[came[at]]
            at = came[at]
    out = [-1] * n
    for j in range(m):
        if owner[j] >= 0:
            out[owner[j]] = j
    return out


def best_matching(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Columns of b for the columns of a with the largest summed correlation, exact at every size."""
    k = a.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        cor = np.nan_to_num(np.corrcoef(a.T, b.T)[:k, k:])
    return assignment(cor)


@dataclass(frozen=True)
class ConsensusMatrices:
    """What one k's spectra agree on: medians of the clusters (features x k), which spectra were kept, their clusters, the consensus matrix."""

    spectra: np.ndarray
    valid: np.ndarray
    clusters: np.ndarray
    consensus: np.ndarray


def consensus_matrices(spectra: np.ndarray, k: int, density_threshold: float = 0.5, max_iter: int = 1000, n_runs: int | None = None, seed: int = 0) -> ConsensusMatrices | None:
    """Cluster the spectra (rows) that the density filter keeps; None if it keeps fewer than k."""
    valid = density_filter(spectra, density_threshold, runs=n_runs)
    if valid.sum() < k:
        return None
    label = kmeans(_unit(spectra[valid]), k, seed, max_iter)
    median = np.stack([np.median(spectra[valid][label == j], axis=0) if (label == j).any() else np.zeros(spectra.shape[1]) for j in range(k)])
    median = (median / np.maximum(median.sum(axis=1, keepdims=True), 1e-15)).T
    return ConsensusMatrices(median, valid, label, consensus_matrix(valid, label, len(spectra)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-15)


def stability_metrics(spectra: np.ndarray, found: ConsensusMatrices, k: int) -> dict[str, float]:
    """stability (cophenetic correlation of the consensus matrix), silhouette of the clusters, and reproducibility: how like the consensus a run's matched spectra are."""
    agree = []
    for i in range(0, len(spectra), k):  # a run has k neighbouring spectra
        w = spectra[i : i + k].T
        agree.append(np.mean([1 - cosine_distance(w[:, j], found.spectra[:, m]) for j, m in enumerate(best_matching(w, found.spectra))]))
    return {"stability": cophenetic_correlation(found.consensus), "silhouette": silhouette(_unit(spectra[found.valid]), found.clusters), "reproducibility": float(np.mean(agree))}


@dataclass(frozen=True)
class Consensus:
    """Consensus programs for every k that has any; ``optimal_k`` is taken where no k is named."""

    metrics: DataFrame
    optimal_k: int
    available_k: list[int]
    settings: dict
    features: list[str]
    spectra: dict[int, np.ndarray]
    assay: DataFrame

    def _k(self, k: int | None) -> int:
        k = self.optimal_k if k is None else k
        if k not in self.spectra:
            raise ValueError(f"there is no consensus for k={k}; there are {', '.join(map(str, self.available_k))}")
        return k

    def geps(self, k: int | None = None) -> DataFrame:
        """The basis: (feature_idx, feature_id, program_idx, program, weight)."""
        held = self.spectra[self._k(k)]
        rows = [(i, f, j + 1, f"NMF_{j + 1}", float(held[i, j])) for i, f in enumerate(self.features) for j in range(held.shape[1])]
        return self.assay.sparkSession.createDataFrame(rows, "feature_idx int, feature_id string, program_idx int, program string, weight double")

    def gep_usage(self, k: int | None = None) -> DataFrame:
        """Usage of every cell, refitted on the consensus basis."""
        return nmf.project(self.assay, self.geps(k))

    @cached_property
    def basis(self) -> DataFrame:
        return self.geps()

    @cached_property
    def usage(self) -> DataFrame:
        return self.gep_usage()

    def top_features(self, n: int = 20, k: int | None = None) -> DataFrame:
        return factors.top_features(self.geps(k), n)

    def info(self) -> dict:
        return {**self.settings, "available_k": self.available_k, "optimal_k": self.optimal_k, "features": len(self.features)}


def _runs(a: np.ndarray, tol: float, maxit: int, l1: tuple[float, float]):
    def run(batches):
        for frame in batches:
            for k, seed in zip(frame["k"], frame["seed"]):
                w = np.random.default_rng(int(seed)).random((a.shape[1], int(k)))

                def step(w):
                    h = nmf.nnls(w.T @ w, a @ w - l1[1])
                    return (h.T @ h)[None], a.T @ h, h.sum(axis=0)

                w, d, *_ = nmf._loop(step, w / w.sum(axis=0), tol, maxit, l1[0], False)
                w = w[:, np.argsort(-d, kind="stable")]
                yield pd.DataFrame({"k": k, "seed": seed, "program": range(int(k)), "spectrum": list(w.T)})

    return run


def select_k(metrics: pd.DataFrame, method: str = "combined", verbose: bool = False) -> int:
    """The k of best stability, silhouette or reproducibility, or of their mean rank; a k without a consensus is out."""
    names = ["stability", "silhouette", "reproducibility"]
    if method not in (*names, "combined"):
        raise ValueError(f"unknown method {method}")
    metrics = metrics.dropna(subset=names)
    if not len(metrics):
        raise ValueError("no k has a consensus; raise the density threshold or the number of runs")
    if method == "combined":
        rank = sum(metrics[c].rank(ascending=False) for c in names)
        best = int(metrics.assign(rank=rank).sort_values(["rank", "k"])["k"].iloc[0])
    else:
        best = int(metrics.sort_values([method, "k"], ascending=[False, True])["k"].iloc[0])
    if verbose:
        log.info("k=%d is best by %s", best, method)
    return best


def _spectra(assay: DataFrame, features: list[str], k_range: list[int], seeds: dict[int, list[int]], tol: float, maxit: int, l1: tuple[float, float], tasks: int, local: bool | None) -> dict[int, np.ndarray]:
    """Each k's spectra (rows), run after run."""
    spark = assay.sparkSession
    rows = nmf.sparse_rows(assay, features).persist()
    try:
        near = rows.count() * len(features) <= nmf.LOCAL_CELLS if local is None else local
        if near:
            a = nmf._dense(rows.toPandas().sort_values("cell_id"), len(features))
            plan = spark.createDataFrame([(k, s) for k in k_range for s in seeds[k]], "k int, seed long").repartition(tasks)
            got = plan.mapInPandas(_runs(a, tol, maxit, l1), "k int, seed long, program int, spectrum array<double>").toPandas().sort_values(["k", "seed", "program"])
            return {k: np.stack(got[got["k"] == k]["spectrum"].to_list()) for k in k_range}
    finally:
        rows.unpersist()
    out = {}
    for k in k_range:
        held = []
        for s in sorted(seeds[k]):
            one = nmf.factorise(assay, k, tol=tol, maxit=maxit, l1=l1, seed=s, local=False)
            held.append(nmf.basis_matrix(one.basis)[1].T)
            one.release()
        out[k] = np.vstack(held)
    return out


def run_consensus(assay: DataFrame, k_range: list[int] = range(5, 16), n_runs: int = 100, density_threshold: float = 0.5, tol: float = 1e-5, maxit: int = 100, seed: int = 0, method: str = "combined", subset: list | None = None, l1: tuple[float, float] = (0.0, 0.0), n_cores: int | None = None, local: bool | None = None, verbose: bool = False) -> Consensus:
    """Factorise with every k and seed, cluster spectra, and refit usage on the clusters' medians, for the best k unless another is asked for.

    ``stability`` is the cophenetic correlation of the consensus matrix at every
    size.  Spectra are clustered once for each k, so it is 1 for each (see
    ``cophenetic_correlation``) and doesn't tell values of k apart.  A k of which
    the density filter keeps fewer than k spectra has no consensus: its metrics
    are null, a warning says so, and it isn't chosen.
    """
    from ..sources.assays import subset_features

    spark, k_range = assay.sparkSession, list(k_range)
    if not k_range or min(k_range) < 1 or n_runs < 1:
        raise ValueError("k_range and n_runs must name at least one run")
    assay = assay if subset is None else subset_features(assay, subset)
    assay = assay.select(F.col("cell_id").cast("string").alias("cell_id"), "feature_id", F.greatest(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    features = sorted(r[0] for r in assay.select("feature_id").distinct().collect())
    seeds = {k: [seed * 100_003 + k * 1_009 + r for r in range(n_runs)] for k in k_range}
    held = _spectra(assay, features, k_range, seeds, tol, maxit, l1, n_cores or min(len(k_range) * n_runs, 64), local)
    rows, medians = [], {}
    for k in k_range:
        found = consensus_matrices(held[k], k, density_threshold, n_runs=n_runs, seed=seed)
        if found is None:
            log.warning("k=%d: the density filter keeps fewer than %d of %d spectra", k, k, len(held[k]))
            rows.append((k, None, None, None, int(density_filter(held[k], density_threshold, runs=n_runs).sum())))
            continue
        medians[k] = found.spectra
        m = stability_metrics(held[k], found, k)
        rows.append((k, m["stability"], m["silhouette"], m["reproducibility"], int(found.valid.sum())))
        if verbose:
            log.info("k=%d: %s", k, m)
    frame = pd.DataFrame(rows, columns=["k", "stability", "silhouette", "reproducibility", "n_spectra"])
    best = select_k(frame, method, verbose)
    metrics = spark.createDataFrame(rows, "k int, stability double, silhouette double, reproducibility double, n_spectra int")
    settings = {"n_runs": n_runs, "seed": seed, "density_threshold": density_threshold, "method": method, "tol": tol, "maxit": maxit, "l1": tuple(l1)}
    return Consensus(metrics, best, sorted(medians), settings, features, medians, assay)


def stability_table(found: Consensus, metrics: tuple[str, ...] = ("stability", "silhouette", "reproducibility")) -> DataFrame:
    """(k, metric, value) for a plot of the metrics over k."""
    odd = [m for m in metrics if m not in found.metrics.columns]
    if odd:
        raise ValueError(f"unknown metrics: {', '.join(odd)}")
    return found.metrics.unpivot(["k"], list(metrics), "metric", "value")


def stability_plot(found: Consensus, metrics: tuple[str, ...] = ("stability", "silhouette", "reproducibility")) -> tuple[DataFrame, dict]:
    return stability_table(found, metrics), specs.lines("k", "value", "metric", found.optimal_k)


def stability_comparison(found: Consensus) -> tuple[DataFrame, dict]:
    """(k, metric, value, scaled): every metric on one scale from 0, its worst k, to 1, its best; a metric that doesn't vary is 1."""
    rows = stability_table(found)
    ends = rows.groupBy("metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low"))).when(F.col("value").isNotNull(), F.lit(1.0))
    return rows.join(F.broadcast(ends), "metric").select("k", "metric", "value", scaled.alias("scaled")), specs.lines("k", "scaled", None, found.optimal_k)  # one row a metric


def gep_heatmap(found: Consensus, k: int | None = None, programs: list | None = None, n: int = 20, **options) -> tuple[DataFrame, dict]:
    """The heatmap of the top features of a k's programs."""
    return factors.heatmap(found.geps(k), programs, n, **options)


def gep_usage_panels(found: Consensus, coords: DataFrame, k: int | None = None, programs: list | tuple = (1, 2, 3, 4)) -> DataFrame:
    """(cell_id, x, y, program, program_usage): usage of a k's programs on an embedding; programs beyond k are left out."""
    k = found._k(k)
    return usage_panels(found.gep_usage(k), coords, [p for p in programs if not isinstance(p, int) or p <= k])


def usage_panels(usage: DataFrame, coords: DataFrame, programs: list) -> DataFrame:
    """(cell_id, x, y, program, program_usage) for several programs at once."""
    from .programs import _check_dims, _points, select_programs

    _check_dims(coords, (1, 2), "the embedding")
    rows = select_programs(usage, list(programs))
    return _points(coords, (1, 2)).join(rows.select("cell_id", "program", F.col("weight").alias("program_usage")), "cell_id")
