"""Usage of streaming cells on a fixed basis: stateless, so batches and restarts don't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.nmf import USAGE, _usage, basis_matrix, long_usage


def project_stream(cells: DataFrame, basis: DataFrame) -> DataFrame:
    """Long usage of a stream of rows (cell_id, features MAP<STRING, DOUBLE>); unknown features are ignored."""
    features, w = basis_matrix(basis)
    place = {f: i for i, f in enumerate(features)}

    def run(batches):
        for frame in batches:
            a = np.zeros((len(frame), len(features)))
            for i, held in enumerate(frame["features"]):
                for f, v in dict(held or {}).items():
                    if f in place and v is not None:
                        a[i, place[f]] = max(v, 0.0)
            yield pd.DataFrame({"cell_id": frame["cell_id"], "weights": list(_usage(a, w, 0.0, False))})

    return long_usage(cells.mapInPandas(run, USAGE))
