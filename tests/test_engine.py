"""Invariants of the factorisation and the statistics, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import stats
from factorloom.operators import clustering, consensus, deps, factors, nmf, programs
from factorloom.operators.experiment import Experiment
from factorloom.plans import registry, specs
from factorloom.sources import assays
from factorloom.streaming.projection import project_stream


def _assay(spark, a):
    return spark.createDataFrame([(f"c{i:03d}", f"f{j:02d}", float(v)) for (i, j), v in np.ndenumerate(a) if v], "cell_id string, feature_id string, value double")


def _planted(cells=40, features=20, k=3):
    rng = np.random.default_rng(0)
    return rng.random((cells, k)) ** 3 @ (rng.random((k, features)) ** 3)


@pytest.fixture(scope="module")
def planted(spark):
    return _planted(), _assay(spark, _planted()).cache()


def _wide(df, row):
    return df.toPandas().pivot(index=row, columns="program_idx", values="weight").sort_index().to_numpy()


def test_factors_recover_a_planted_matrix(planted):
    a, assay = planted
    e = Experiment({"logcounts": assay}).run_nmf(3, seed=1, maxit=500, tol=1e-9)
    w, h = _wide(e.basis(), "feature_id"), _wide(e.coefficients(), "cell_id")
    assert w.shape == (20, 3) and h.shape == (40, 3) and (w >= 0).all() and (h >= 0).all()
    assert np.allclose(w.sum(axis=0), 1) and np.allclose(h.sum(axis=0), 1)
    back = h * np.array(e.result().scale) @ w.T
    assert np.linalg.norm(back - a) / np.linalg.norm(a) < 2e-2
    table = e.reconstruct(include_scale=True)
    assert table.count() == 800


def test_distributed_equals_local(planted):
    _, assay = planted
    local = nmf.factorise(assay, 3, seed=5, maxit=12, local=True)
    for parts in (1, 4):
        far = nmf.factorise(assay, 3, seed=5, maxit=12, local=False, partitions=parts)
        assert np.allclose(_wide(local.basis, "feature_id"), _wide(far.basis, "feature_id"), atol=1e-6)


def test_distributed_query_runs_to_the_default_limits(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.nmf_distributed(spark, sf)
    ended = got.first()
    assert ended.converged == (ended.final_tol < 1e-5) and (ended.converged or ended.iterations == 100)
    want = registry._factors(spark, sf)  # the local path, default limits
    assert np.allclose(_wide(got, "feature_id"), _wide(want.basis, "feature_id"), atol=1e-6)


def test_every_cell_has_a_usage(spark, planted):
    a, _ = planted
    a = a.copy()
    a[[3, 17]] = 0.0
    rows = [(f"c{i:03d}", f"f{j:02d}", float(v)) for (i, j), v in np.ndenumerate(a)]
    rows += [("all negative", "f00", -2.0)]
    assay = spark.createDataFrame(rows, "cell_id string, feature_id string, value double")
    for local in (True, False):
        f = nmf.factorise(assay, 3, seed=1, maxit=5, local=local)
        got = f.usage.groupBy("cell_id").agg(F.sum("weight").alias("s")).collect()
        assert len(got) == 41 and {r.cell_id for r in got if r.s == 0} == {"c003", "c017", "all negative"}
        f.release()
    assert nmf.project(assay, f.basis).select("cell_id").distinct().count() == 41
    # Cells of the cell table of which the assay has no row, and those that lose all rows to a subset.
    cells = spark.createDataFrame([(f"c{i:03d}", i % 2) for i in range(50)], "cell_id string, batch int")
    e = Experiment({"logcounts": assay.filter("value > 0")}, cells).run_nmf(2, seed=1, maxit=3, subset=[1, 2, 3])
    assert e.coefficients().select("cell_id").distinct().count() == 50 and e.basis().count() == 6
    # As many cells as the reference's mock has, some without a value.
    sparse = spark.createDataFrame([(f"c{i}", f"f{j}", float((i * j) % 7)) for i in range(50) for j in range(100)], "cell_id string, feature_id string, value double")
    e = Experiment({"logcounts": sparse}).run_nmf(5, seed=1, maxit=10)
    assert e.coefficients().count() == 250 and e.basis().count() == 500


def test_signs_and_scale_can_be_left_free(planted):
    a, assay = planted
    free = nmf.factorise(assay, 3, seed=1, maxit=200, tol=1e-12, nonneg=False, diag=False)
    w, h = _wide(free.basis, "feature_id"), _wide(free.usage, "cell_id")
    best = np.linalg.svd(a, compute_uv=False)
    assert abs(np.linalg.norm(a - h @ w.T) ** 2 - (best[3:] ** 2).sum()) < 1e-6 and free.scale == [1.0] * 3


def test_a_container_is_written_and_read(spark, planted, tmp_path):
    _, assay = planted
    cells = spark.createDataFrame([(f"c{i:03d}", "ab"[i % 2]) for i in range(40)], "cell_id string, kind string")
    e = Experiment({"logcounts": assay}, cells).run_nmf(3, seed=1, maxit=20).run_pca(3)
    e = e.with_cells("batch", spark.createDataFrame([("c000", 1)], "cell_id string, batch int"))
    e.save(str(tmp_path / "held"))
    back = Experiment.load(spark, str(tmp_path / "held"))
    assert np.allclose(_wide(back.basis(), "feature_id"), _wide(e.basis(), "feature_id")) and back.result().scale == e.result().scale
    assert back.cells.columns == ["cell_id", "kind", "batch"] and back.dimred("PCA").count() == 40
    points, spec = back.scatter("PCA", program="NMF_2", dims=(3, 1), color_scale="magma")
    assert points.count() == 40 and spec["labels"] == ["PCA3", "PCA1"] and spec["scale"] == "magma"
    with pytest.raises(ValueError, match="which has 3"):
        back.scatter("PCA", dims=(1, 4))
    with pytest.raises(ValueError, match="no embedding named UMAP"):
        back.umap()
    assert back.category_scatter("kind", "PCA")[1]["legend"] == "kind"
    table, spec = back.gene_heatmap(programs=["NMF_3", "NMF_1"], n=4)
    assert table.count() == 16 and set(spec["columns"]) == {"NMF_1", "NMF_3"} and sorted(spec["rows"]) == sorted({r.feature_id for r in table.collect()})
    assert back.find_all_deps("kind").count() == 6 and back.volcano(back.find_all_deps("kind"))[0].count() == 6 and back.dots("kind")[0].count() == 6


def test_principal_components(spark, planted):
    a, assay = planted
    got = programs.principal_components(assay, 4).toPandas().sort_values("cell_id")
    x = np.stack(got["coords"].to_list())
    u, s, v = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(x), np.abs(u[:, :4] * s[:4]), atol=1e-8)
    with pytest.raises(ValueError):
        programs.principal_components(assay, 21)


def test_masked_zeros_and_penalty(planted):
    _, assay = planted
    assert nmf.factorise(assay, 2, seed=1, maxit=3, mask_zeros=True).basis.count() == 40
    plain, thin = (nmf.factorise(assay, 3, seed=1, maxit=20, l1=(x, x)) for x in (0.0, 0.002))
    zeros = lambda f: f.basis.filter("weight = 0").count()
    assert zeros(thin) >= zeros(plain)


def test_bad_input(spark, planted):
    _, assay = planted
    with pytest.raises(ValueError):
        nmf.factorise(assay.withColumn("value", F.lit(None).cast("double")), 2)
    with pytest.raises(ValueError):
        Experiment({"logcounts": assay}).run_nmf(2, assay="counts")
    with pytest.raises(ValueError):
        nmf.factorise(assay, 0)
    held = nmf.factorise(assay.union(spark.createDataFrame([("c000", "f99", -1.0)], assay.schema)), 2, seed=1, maxit=2)
    assert held.basis.filter("feature_id = 'f99'").count() == 2


def test_streamed_cells_match_a_batch(spark, planted, tmp_path):
    _, assay = planted
    f = nmf.factorise(assay, 3, seed=1, maxit=20)
    rows = assay.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("features"))
    rows.write.parquet(str(tmp_path / "cells"))
    q = project_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "cells")), f.basis).writeStream.format("memory").queryName("projected").start()
    q.processAllAvailable()
    q.stop()
    got = _wide(spark.table("projected"), "cell_id")
    assert np.allclose(got, _wide(nmf.project(assay, f.basis), "cell_id"), atol=1e-8)


def test_top_features_ties_and_limits(spark):
    b = spark.createDataFrame([(i, f, p, f"NMF_{p}", w) for p in (1, 2, 10) for i, (f, w) in enumerate([("b", 1.0), ("a", 1.0), ("c", 2.0)])], "feature_idx int, feature_id string, program_idx int, program string, weight double")
    assert [r.feature_id for r in factors.top_features(b, 99).filter("program_idx = 10").orderBy("rank").collect()] == ["c", "b", "a"]
    assert factors.top_features(b, 1).count() == 3
    assert sorted(r.feature_id for r in factors.top_unique(b, 1).collect()) == ["a", "b", "c"]
    assert factors.top_lists(b, 2).first().features == ["c", "b"]
    assert factors.z_scores(b).filter("z <> 0").count() == 0
    with pytest.raises(ValueError):
        factors.top_features(b, 0)


def _usage(spark, rows):
    return spark.createDataFrame(rows, "cell_id string, program_idx int, program string, grp string, weight double")


def test_rank_sums_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"c{i}", p, f"NMF_{p}", "abc"[i % 3], float(rnd.randint(0, 4))) for i in range(40) for p in (1, 2)]
    got = {(r.program_idx, r.g1, r.g2): r for r in deps.wilcoxon(_usage(spark, rows)).collect()}
    for (p, a, b), r in got.items():
        x, y = ([w for _, q, _, g, w in rows if q == p and g == s] for s in (a, b))
        assert r.u == sum((i > j) + 0.5 * (i == j) for i in x for j in y)
        assert abs(r.auc + got[p, b, a].auc - 1) < 1e-12 and abs(r.z + got[p, b, a].z) < 1e-9


def test_deps_edges(spark):
    rows = [(f"c{i}", p, f"NMF_{p}", None if i % 10 == 9 else "ab"[i % 2], w) for i in range(40) for p, w in ((1, float(i % 2 == 0)), (2, 0.0), (3, float(i)))]
    got = {(r.cell_type, r.program): r for r in deps.find_all_deps(_usage(spark, rows)).collect()}
    assert got["a", "NMF_1"].fold_enrichment == math.inf and got["b", "NMF_1"].fold_enrichment == 0
    assert got["a", "NMF_2"].fold_enrichment == 1 and got["a", "NMF_2"].p_value == 1
    assert all(r.fdr >= r.p_value - 1e-12 for r in got.values())
    ways = [{(r.cell_type, r.program): r.p_value for r in deps.find_all_deps(_usage(spark, rows), pval_type=t).collect()} for t in ("any", "some", "all")]
    assert all(abs(ways[0][k] - ways[1][k]) < 1e-12 and abs(ways[0][k] - ways[2][k]) < 1e-12 for k in ways[0])
    v = deps.volcano(deps.find_all_deps(_usage(spark, rows), log_p=True))
    assert v.filter("log2_fold = double('Infinity')").count() == 0 and v.count() == 6
    for test in ("t", "binom"):
        assert deps.find_all_deps(_usage(spark, rows), test=test).filter("p_value between 0 and 1").count() == 6
    with pytest.raises(ValueError):
        deps.find_all_deps(_usage(spark, [r for r in rows if r[3] == "a"]))
    assert deps.fold_matrix(deps.find_all_deps(_usage(spark, rows))).filter("abs(logfc) > 10").count() == 0


def test_strong_p_values_keep_their_logs(spark):
    rows = [(f"c{i}", 1, "NMF_1", "ab"[i % 2], float(i % 2) * 10 + (i % 97) / 100) for i in range(4000)]
    rows += [(f"c{i}", 2, "NMF_2", "ab"[i % 2], float((i * 7919) % 4000)) for i in range(4000)]
    for test in ("wilcox", "t", "binom"):
        held = rows if test != "binom" else [(c, p, n, g, w if p == 2 or w > 5 else 0.0) for c, p, n, g, w in rows]
        for how in ("any", "some", "all"):
            got = {(r.cell_type, r.program): r for r in deps.find_all_deps(_usage(spark, held), test=test, pval_type=how, log_p=True).collect()}
            strong = got["a", "NMF_1"]
            assert math.isfinite(strong.log_p_value) and strong.log_p_value < -600 and math.isclose(strong.log_fdr, strong.log_p_value + math.log(2))
            assert got["a", "NMF_2"].log_p_value > -5
    v = {(r.cell_type, r.program): r for r in deps.volcano(deps.find_all_deps(_usage(spark, rows), log_p=True)).collect()}
    assert v["a", "NMF_1"].significance == "Depleted" and v["b", "NMF_1"].significance == "Enriched" and 250 < v["a", "NMF_1"].neg_log10_pval < math.inf
    # An empty name is a number's name.
    assert {r.program for r in deps.find_all_deps(_usage(spark, rows).withColumn("program", F.lit(None).cast("string"))).collect()} == {"Program_1", "Program_2"}


def test_logs_of_tails():
    assert abs(stats.log_t_tail(3.0, 10) - math.log(stats.t_tail(3.0, 10))) < 1e-12 and -3060 < stats.log_t_tail(1e4, 500) < -250 * math.log(1 + 1e8 / 500)
    exact = sum(math.comb(3000, i) for i in range(0, 101)) * 2
    assert abs(stats.log_binomial_test(100, 3000, 0.5) - (math.log(exact) - 3000 * math.log(2))) < 1e-6


def test_ranks_do_not_depend_on_slices(spark):
    rnd = random.Random(8)
    rows = [(f"c{i}", p, f"NMF_{p}", "abcd"[rnd.randrange(4)], rnd.choice([0.0, 0.0, rnd.random()])) for i in range(300) for p in (1, 2)]
    held = [sorted(map(tuple, deps.wilcoxon(_usage(spark, rows), slices=s).collect())) for s in (2, 7, 64)]
    assert held[0] == held[1] == held[2] and len(held[0]) == 24


def test_unknown_names_are_errors(spark):
    rows = [(f"c{i}", p, f"NMF_{p}", "ab"[i % 2], float(i * p)) for i in range(20) for p in (1, 2, 3, 4)]
    found = deps.find_all_deps(_usage(spark, rows))
    for call in (lambda: deps.heatmap(found, ["NMF_9"]), lambda: deps.volcano(found, ["c"]), lambda: deps.fold_matrix(found, programs=[]), lambda: factors.z_scores(_usage(spark, rows), ["NMF_7"])):
        with pytest.raises(ValueError):
            call()
    table, spec = deps.heatmap(found, ["NMF_4", "NMF_2"])
    assert spec["rows"] == ["NMF_4", "NMF_2"] and table.count() == 4 and abs(spec["breaks"][0] + spec["breaks"][-1]) < 1e-12
    assert sorted(deps.heatmap(found, cluster_rows=True, cluster_cols=True)[1]["rows"]) == [f"NMF_{i}" for i in range(1, 5)]


def test_deps_heatmap_has_every_label(spark, monkeypatch):
    rows = [("NMF_1", "0", 2.0), ("NMF_1", "10", 4.0), ("NMF_2", "10", 8.0)]
    monkeypatch.setattr(registry, "_deps_table", lambda *_: spark.createDataFrame(rows, "program string, cell_type string, fold_enrichment double"))
    got = registry.deps_heatmap(spark, "")
    assert got.columns == ["program", "g0", "g10"]
    assert sorted(map(tuple, got.collect())) == [("NMF_1", 1.0, 2.0), ("NMF_2", None, 3.0)]


def test_tails():
    assert abs(stats.normal_tail(1.959963984540054) - 0.05) < 1e-12
    assert abs(stats.t_tail(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(stats.t_tail(12.706204736432095, 1) - 0.05) < 1e-9
    exact = sum(math.comb(10, i) for i in range(0, 3)) / 2**10
    assert abs(stats.binomial_test(2, 10, 0.5) - 2 * exact) < 1e-12
    assert abs(stats.log_normal_tail(29.99) - stats.log_normal_tail(30.0)) < 0.5


def test_adjusted_p_values(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.03]
    got = {r.i: r.fdr for r in stats.adjust(spark.createDataFrame([(1, i, x) for i, x in enumerate(p)], "g int, i int, p_value double"), ["g"]).collect()}
    order = sorted(range(5), key=lambda i: p[i])
    for r, i in enumerate(order):
        assert abs(got[i] - min(1, min(p[j] * 5 / (s + 1) for s, j in enumerate(order) if s >= r))) < 1e-12


def test_dots_and_scatter(spark):
    rows = [(f"c{i}", 1, "NMF_1", None if i == 0 else "ab"[i % 2], float(i)) for i in range(6)]
    got = {r.grp: r for r in programs.dots(_usage(spark, rows), "grp").collect()}
    assert set(got) == {"a", "b"} and got["a"].sum_weight == 6 and got["a"].pct_nonzero == 100
    with pytest.raises(ValueError):
        programs.dots(_usage(spark, rows), "grp", programs=[7])
    coords = spark.createDataFrame([(f"c{i}", [1.0, 2.0, float(i)]) for i in range(6)], "cell_id string, coords array<double>")
    assert programs.scatter(coords, _usage(spark, rows), "NMF_1", (3, 1)).filter("x = program_usage and y = 1").count() == 6


def test_consensus_and_specs(spark, planted):
    _, assay = planted
    found = consensus.run_consensus(assay, [2, 3], n_runs=4, seed=1, maxit=30)
    assert found.optimal_k in (2, 3) and found.usage.count() == 40 * found.optimal_k
    assert consensus.stability_table(found).count() == 6
    assert consensus.greedy_matching(np.array([[0.9, 0.8], [0.95, 0.1]])) == [1, 0]
    d = np.array([[0, 1, 5], [1, 0, 4], [5, 4, 0.0]])
    assert consensus.leaf_order(consensus.linkage(d), 3) in ([2, 0, 1], [0, 1, 2])
    assert specs.lines("k", "value")["kind"] == "lines"
    assert len(specs.ramp(["#000000", "#ffffff"])) == 100 and specs.breaks(2.0)[50] == 0
    assert specs.scatter("odd")["scale"] == "viridis"


def test_stability_is_one_measure_at_every_size(planted):
    d = np.random.default_rng(4).random((40, 40))
    d = (d + d.T) / 2
    want, held = np.zeros((40, 40)), {i: [i] for i in range(40)}
    for i, (a, b, h) in enumerate(consensus.linkage(d, "average")):
        want[np.ix_(held[a], held[b])] = want[np.ix_(held[b], held[a])] = h
        held[40 + i] = held.pop(a) + held.pop(b)
    assert np.allclose(consensus.cophenetic_distances(d), want)
    # 304 spectra, of which the filter drops some.
    found = consensus.run_consensus(planted[1], [4], n_runs=76, density_threshold=0.05, maxit=30)
    row = found.metrics.first()
    assert row.n_spectra < 304 and row.stability == 1


def test_consensus_for_every_k_and_exact_matching(spark, planted):
    _, assay = planted
    found = consensus.run_consensus(assay, [2, 3], n_runs=5, seed=1, maxit=40, l1=(0.001, 0.0), subset=[f"f{j:02d}" for j in range(15)])
    assert found.available_k == [2, 3] and found.info()["features"] == 15 and found.info()["optimal_k"] == found.optimal_k
    for k in (2, 3):
        assert found.geps(k).count() == 15 * k and found.gep_usage(k).count() == 40 * k and found.top_features(4, k).count() == 4 * k
    with pytest.raises(ValueError):
        found.geps(9)
    table, spec = consensus.gep_heatmap(found, 3, [1, 3], n=4)
    assert table.count() == 8 * 2 and len(spec["rows"]) == 8
    coords = spark.createDataFrame([(f"c{i:03d}", [1.0, float(i)]) for i in range(40)], "cell_id string, coords array<double>")
    assert consensus.gep_usage_panels(found, coords, 3).count() == 120
    compared, _ = consensus.stability_comparison(found)
    assert compared.filter("scaled < 0 or scaled > 1").count() == 0 and compared.count() == 6
    # A filter that keeps too few spectra is said, not turned off.
    rng = np.random.default_rng(2)
    assert consensus.consensus_matrices(rng.random((40, 30)), 12, density_threshold=1e-9) is None
    with pytest.raises(ValueError):
        consensus.run_consensus(assay, [3], n_runs=3, density_threshold=-1.0, maxit=5)
    # k = 12 and more columns than permutations could be tried for.
    a = rng.random((30, 12))
    shuffle = rng.permutation(12)
    assert consensus.best_matching(a[:, shuffle] + 0.01 * rng.random((30, 12)), a) == shuffle.tolist()
    greedy_fails = np.array([[0.9, 0.85], [0.89, 0.1]])
    assert consensus.assignment(greedy_fails) == [1, 0] and consensus.greedy_matching(greedy_fails) == [0, 1]
    far = consensus.run_consensus(assay, [2], n_runs=2, seed=1, maxit=8, local=False)
    near = consensus.run_consensus(assay, [2], n_runs=2, seed=1, maxit=8, local=True)
    assert np.allclose(far.spectra[2], near.spectra[2], atol=1e-6)


def test_linkage_equals_brute_force():
    rng = np.random.default_rng(5)
    for method, pick in (("complete", max), ("average", lambda x: sum(x) / len(x))):
        d = rng.random((14, 14))
        d = d + d.T
        held, want = {i: [i] for i in range(14)}, []
        for n in range(14, 27):
            h, a, b = min((pick([d[i, j] for i in held[p] for j in held[q]]), p, q) for p in held for q in held if p < q)
            held[n] = held.pop(a) + held.pop(b)
            want.append((a, b, h))
        got = clustering.linkage(d, method)
        assert [(min(a, b), max(a, b)) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([m[2] for m in got], [m[2] for m in want])
    assert clustering.order(np.array([[0.0], [9.0], [0.1], [9.2]])) in ([0, 2, 1, 3], [1, 3, 0, 2])


def test_consensus_query_takes_the_default_runs(spark, monkeypatch):
    held, run = [], consensus.run_consensus
    monkeypatch.setattr(consensus, "run_consensus", lambda *a, **b: held.append(run(*a, **b)) or held[-1])
    assert registry.consensus_programs(spark, "/root/testdata/sf0.001").count() > 0
    assert held[0].settings["n_runs"] == 100 and {r.k: r.n_spectra for r in held[0].metrics.collect()}[2] > 12


def test_subset_and_missing_columns(spark, planted):
    _, assay = planted
    for wanted in (["f00"], [1], [j == 0 for j in range(20)]):
        assert [r[0] for r in assays.subset_features(assay, wanted).select("feature_id").distinct().collect()] == ["f00"]
    for wanted in (["f00", "nope"], [21], [True]):
        with pytest.raises(ValueError):
            assays.subset_features(assay, wanted)
    with pytest.raises(ValueError):
        assays.subset_features(assay, [])
    with pytest.raises(ValueError):
        assays.require(assay, "nothing")
