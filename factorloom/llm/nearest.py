"""Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its nearest pivots.  The index is cut
into blocks of rows; each block posts its vectors in inverted files, one for
each pivot, with the pivot's rank.  A query walks the files of its own nearest
pivots and accumulates the footrule distance of the two truncated orders
(pivots that one side lacks count as rank ``depth``).  The share of a block with
the least footrule is reranked by exact cosine in double precision, and the
blocks' best are merged.  Queries and index rows meet in a grid of blocks, so
neither side has to fit one task, and equal vectors spread over all blocks.

Pivots are a bounded sample: the ``pivots`` rows with the least hash of their
id.  Every usable row is indexed.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those whose dimension isn't the most common
one (ties: the largest); ties of footrule and score go to the smaller id; a
null id takes no part; rows that repeat an id are never neighbours of
themselves; fewer candidates than ``k`` give all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import ship

#: Pivots, length of the truncated order, share of a block that is reranked, and rows of a block.
PIVOTS, DEPTH, RERANK, BLOCK = 512, 64, 0.12, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Each row's nearest pivots by cosine, nearest first; ties go to the earlier pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :depth]


class InvertedFiles:
    def __init__(self, order: np.ndarray, pivots: int):
        n, self.depth = order.shape
        at = np.argsort(order.ravel(), kind="stable")
        self.row = (at // self.depth).astype(np.int32)
        self.rank = (at % self.depth).astype(np.int32)
        self.ends = np.searchsorted(order.ravel()[at], np.arange(pivots + 1))
        self.n = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule of one query's order to all rows, less a constant."""
        out = np.zeros(self.n, np.int32)
        for i, p in enumerate(order):
            a, b = self.ends[p], self.ends[p + 1]
            rank = self.rank[a:b]
            # Unposted here: depth - i for the query's pivot, depth - rank for the row's.
            out[self.row[a:b]] += np.abs(rank - i) - (self.depth - i) - (self.depth - rank)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _search(pivots: np.ndarray, depth: int, share: float, k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, queries = rows.sort_values("vec_id", kind="stable"), queries.sort_values("vec_id", kind="stable")
        ids, qids = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        raw_x, raw_q = np.stack(rows["v"].to_list()).astype(float), np.stack(queries["v"].to_list()).astype(float)
        x, q = _unit(raw_x), _unit(raw_q)
        files = InvertedFiles(orders(x, pivots, depth), len(pivots))
        take = min(len(ids), max(64, int(np.ceil(share * len(ids)))) + 1)
        out = []
        for i, order in enumerate(orders(q, pivots, depth)):
            foot = files.footrule(order).astype(np.int64) * len(ids) + np.arange(len(ids))
            near = np.argpartition(foot, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
            near = np.sort(near[ids[near] != qids[i]])
            score = (x[near] * q[i]).sum(axis=1)
            best = near[np.lexsort((ids[near], -score))[:k]]
            out.append(pd.DataFrame({"query_id": qids[i], "vec_id": ids[best], "score": (x[best] * q[i]).sum(axis=1)}))
        return pd.concat(out)

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, depth: int = DEPTH, share: float = RERANK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["d"])
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    centre = _unit(np.array([r["v"] for r in chosen], float))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    down, across = int(sizes["n"] // block) + 1, int(rows.filter(is_query).count() // block) + 1
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("vec_id", "v", place(down, 1).alias("i"), each(across).alias("j"))
    asked = rows.filter(is_query).select("vec_id", "v", place(across, 2).alias("j"), each(down).alias("i"))
    met = index.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(_search(centre, min(depth, len(centre)), share, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
