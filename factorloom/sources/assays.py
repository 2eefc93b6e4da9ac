"""Assays as COO tables ``(cell_id, feature_id, value)``; an absent pair is zero, not missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    """Fail before any job if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}; there are {', '.join(df.columns)}")


def coo(df: DataFrame, cell: str | Column, feature: str | Column, value: str | Column) -> DataFrame:
    """Sum a table to one row for each (cell, feature)."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(as_col(cell).cast("string").alias("cell_id"), as_col(feature).cast("string").alias("feature_id"), as_col(value).cast("double").alias("value"))
    return rows.groupBy("cell_id", "feature_id").agg(F.sum("value").alias("value"))


def log_normalise(assay: DataFrame) -> DataFrame:
    """``log2(value / size factor + 1)``; a cell's size factor is its total over the mean total.

    Totals are a window over a cell's own rows, so the assay isn't joined with itself.
    """
    scaled = assay.withColumn("total", F.sum("value").over(Window.partitionBy("cell_id")))
    mean = assay.agg((F.sum("value") / F.count_distinct("cell_id")).alias("mean"))
    factor = F.col("total") / F.col("mean")
    scaled = scaled.crossJoin(F.broadcast(mean))  # one row
    return scaled.select("cell_id", "feature_id", F.when(factor > 0, F.log2(F.col("value") / factor + 1.0)).otherwise(0.0).alias("value"))


def subset_features(assay: DataFrame, wanted: Iterable) -> DataFrame:
    """Rows of the wanted features: names, positions from 1 or a mask over the features by name; unknown ones are named in the error."""
    wanted = list(wanted)
    if not wanted:
        raise ValueError("no feature selected")
    features = sorted(r[0] for r in assay.select("feature_id").distinct().collect())
    if all(isinstance(x, bool) for x in wanted):
        if len(wanted) != len(features):
            raise ValueError(f"the mask has {len(wanted)} entries for {len(features)} features")
        names = [f for f, x in zip(features, wanted) if x]
        if not names:
            raise ValueError("no feature selected")
    elif all(isinstance(x, int) for x in wanted):
        odd = [x for x in wanted if not 1 <= x <= len(features)]
        if odd:
            raise ValueError(f"positions out of 1 to {len(features)}: {', '.join(map(str, odd))}")
        names = [features[x - 1] for x in wanted]
    else:
        held = set(features)
        missing = [str(x) for x in wanted if x not in held]
        if missing:
            raise ValueError(f"features not found: {', '.join(missing)}")
        names = wanted
    return assay.filter(F.col("feature_id").isin(names))


def exclude_features(assay: DataFrame, pattern: str) -> DataFrame:
    """Rows of features that don't match a regular expression."""
    return assay.filter(~F.col("feature_id").rlike(pattern))


def negative_count(assay: DataFrame) -> DataFrame:
    """One row: values below zero, and whether there is any."""
    return assay.agg(F.count_if(F.col("value") < 0).alias("n_negative"), F.coalesce(F.max(F.col("value") < 0), F.lit(False)).alias("any_negative"))


def clamp(assay: DataFrame) -> DataFrame:
    """Negative values as zero; the input stays as it is."""
    return assay.withColumn("value", F.greatest("value", F.lit(0.0)))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by brands: quantities bought."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return coo(joined, "o_custkey", "p_brand", "l_quantity")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event types: summed values."""
    return coo(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


def embedding_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an assay: vectors by dimensions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.select(F.col("vec_id").cast("string").alias("cell_id"), F.concat(F.lit("d"), F.col("dim") + 1).alias("feature_id"), F.col("x").cast("double").alias("value"))


def embedding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed usage table: the components of the embeddings, negatives as zero, grouped by label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return rows.select(F.col("vec_id").alias("cell_id"), F.col("label").alias("grp"), (F.col("i") + 1).alias("program_idx"), F.concat(F.lit("NMF_"), F.col("i") + 1).alias("program"), F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("weight"))


def segment_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed basis: brands by market segments, mean quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey).join(customers, orders.o_custkey == customers.c_custkey)
    means = joined.groupBy(F.col("p_brand").alias("feature_id"), F.col("c_mktsegment").alias("program")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("weight"))
    # Segments are few by nature; their order numbers the programs.
    order = means.select("program").distinct().select("program", F.row_number().over(Window.orderBy("program")).alias("program_idx"))
    return means.join(F.broadcast(order), "program").select("feature_id", "program_idx", "program", "weight")
