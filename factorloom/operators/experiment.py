"""The container: assays, cells, features, embeddings and named results, all immutable."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..plans import specs
from . import deps, factors, nmf, programs


@dataclass(frozen=True)
class Experiment:
    assays: Mapping[str, DataFrame]
    cells: DataFrame | None = None
    dimreds: Mapping[str, DataFrame] = field(default_factory=dict)
    results: Mapping[str, nmf.Factors] = field(default_factory=dict)

    def assay(self, name: str) -> DataFrame:
        return _named(self.assays, name, "assay")

    def dimred(self, name: str) -> DataFrame:
        return _named(self.dimreds, name, "embedding")

    def result(self, name: str = "NMF") -> nmf.Factors:
        return _named(self.results, name, "result")

    def with_result(self, name: str, factors_: nmf.Factors) -> Experiment:
        return replace(self, results={**self.results, name: factors_})

    def run_nmf(self, k: int, assay: str = "logcounts", name: str = "NMF", subset: list | None = None, **options) -> Experiment:
        """A new experiment with the factors of an assay under ``name``; every cell of the cell table has a usage.

        ``subset`` are features by name, by position from 1 or as a mask.
        """
        from ..sources.assays import subset_features

        rows = self.assay(assay)
        # A cell without a value among the chosen features is still there.
        cells = rows.select("cell_id") if self.cells is None else self.cells.select("cell_id")
        options.setdefault("cells", cells if subset is not None or self.cells is not None else None)
        rows = rows if subset is None else subset_features(rows, subset)
        return self.with_result(name, nmf.factorise(rows, k, **options))

    def with_cells(self, column: str, values: DataFrame) -> Experiment:
        """A cell column more, from (cell_id, value); cells without one have null."""
        held = values.select("cell_id", values.columns[1])
        cells = held.toDF("cell_id", column) if self.cells is None else self.cells.drop(column).join(held.toDF("cell_id", column), "cell_id", "left")
        return replace(self, cells=cells)

    def run_pca(self, n: int = 50, assay: str = "logcounts", name: str = "PCA") -> Experiment:
        """A new experiment with the cells' principal components as an embedding."""
        return replace(self, dimreds={**self.dimreds, name: programs.principal_components(self.assay(assay), n)})

    def scatter(self, dimred: str = "UMAP", name: str = "NMF", program: int | str = 1, dims: tuple[int, int] = (1, 2), labels: list[str] | None = None, color_scale: str = "viridis", point_size: float = 0.8, alpha: float = 1.0) -> tuple[DataFrame, dict]:
        """An embedding coloured by a program's usage: points and their specification."""
        coords, usage = self.dimred(dimred), deps.named(self.coefficients(name))
        return programs.scatter(coords, usage, program, dims, dimred), specs.scatter(color_scale, point_size, alpha, programs.axis_labels(dimred, dims, labels))

    def umap(self, name: str = "NMF", program: int | str = 1, color_scale: str = "viridis", point_size: float = 0.8, alpha: float = 1.0) -> tuple[DataFrame, dict]:
        """:meth:`scatter` on the first two dimensions of the embedding ``UMAP``."""
        return self.scatter("UMAP", name, program, (1, 2), None, color_scale, point_size, alpha)

    def category_scatter(self, column: str, dimred: str = "UMAP", dims: tuple[int, int] = (1, 2), labels: list[str] | None = None) -> tuple[DataFrame, dict]:
        """An embedding coloured by a cell column."""
        points = programs.category_scatter(self.dimred(dimred), self._column(column), dims, dimred)
        return points, specs.scatter(labels=programs.axis_labels(dimred, dims, labels), colour="grp", legend=column)

    def gene_heatmap(self, name: str = "NMF", programs: list | None = None, n: int = 10, unique: bool = True, **options) -> tuple[DataFrame, dict]:
        return factors.heatmap(self.basis(name), programs, n, unique, **options)

    def dots(self, column: str, name: str = "NMF", **options) -> tuple[DataFrame, dict]:
        """Program by group: summed weight and share of cells that use it."""
        return programs.dots(self.grouped_usage(column, name), "grp", **options), specs.dots()

    def find_all_deps(self, column: str, name: str = "NMF", **options) -> DataFrame:
        return deps.find_all_deps(self.grouped_usage(column, name), "grp", **options)

    def volcano(self, found: DataFrame, cell_types: list[str] | None = None, fold_threshold: float = 1.5, pval_threshold: float = 0.05, top_n: int = 5, columns: int = 3) -> tuple[DataFrame, dict]:
        return deps.volcano(found, cell_types, fold_threshold, pval_threshold, top_n), specs.volcano(fold_threshold, pval_threshold, columns)

    def save(self, path: str) -> None:
        """Write every table and result below a folder (any file system of Spark's)."""
        spark = next(iter(self.assays.values())).sparkSession
        held = {"assays": sorted(self.assays), "dimreds": sorted(self.dimreds), "cells": self.cells is not None, "results": {}}
        for kind, tables in (("assays", self.assays), ("dimreds", self.dimreds)):
            for n, t in tables.items():
                t.write.mode("overwrite").parquet(f"{path}/{kind}/{n}")
        if self.cells is not None:
            self.cells.write.mode("overwrite").parquet(f"{path}/cells")
        for n, r in self.results.items():
            r.basis.write.mode("overwrite").parquet(f"{path}/results/{n}/basis")
            r.usage.write.mode("overwrite").parquet(f"{path}/results/{n}/usage")
            held["results"][n] = {"scale": r.scale, "iterations": r.iterations, "final_tol": r.final_tol, "converged": r.converged, "seed": r.seed}
        spark.createDataFrame([(json.dumps(held),)], "held string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Experiment:
        held = json.loads(spark.read.text(f"{path}/index").first()[0])
        read = lambda *parts: spark.read.parquet("/".join((path, *parts)))
        results = {n: nmf.Factors(read("results", n, "basis"), read("results", n, "usage"), **r) for n, r in held["results"].items()}
        return cls({n: read("assays", n) for n in held["assays"]}, read("cells") if held["cells"] else None, {n: read("dimreds", n) for n in held["dimreds"]}, results)

    def basis(self, name: str = "NMF") -> DataFrame:
        return self.result(name).basis

    def coefficients(self, name: str = "NMF") -> DataFrame:
        return self.result(name).usage

    def top_features(self, name: str = "NMF", n: int = 10) -> DataFrame:
        return factors.top_features(self.basis(name), n)

    def reconstruct(self, name: str = "NMF", include_scale: bool = False) -> DataFrame:
        """W H' on unit-sum factors, or on the data's scale with ``include_scale``."""
        held = self.result(name)
        scale = held.basis.sparkSession.createDataFrame([(i + 1, d) for i, d in enumerate(held.scale)], "program_idx int, d double") if include_scale else None
        return factors.reconstruct(held.basis, held.usage, scale)

    def _column(self, column: str) -> DataFrame:
        from ..sources.assays import require

        if self.cells is None:
            raise ValueError("the experiment has no cell table")
        require(self.cells, "cell_id", column)
        return self.cells.select("cell_id", self.cells[column].alias("grp"))

    def grouped_usage(self, column: str, name: str = "NMF") -> DataFrame:
        """Usage with a cell column as ``grp``."""
        return self.coefficients(name).join(self._column(column), "cell_id")


def _named(held: Mapping, name: str, what: str):
    if name not in held:
        raise ValueError(f"no {what} named {name}; there are: {', '.join(held) or 'none'}")
    return held[name]
