"""Quality classifier: perplexity under a language model of trusted text.

A Kneser-Ney model of order ``order`` is trained on a bounded sample of rows
labelled good.  Its counts are sharded by hash; every block's distinct n-grams
are looked up in the mapped shards where the documents are read, so documents
never shuffle (a join of all documents' n-grams with the shards would move
several times the input; see the README).  All good rows that weren't trained on give each language's quantile
of log perplexity; documents above it by more than ``slack`` are rejected.
Languages with fewer than ``LEAST`` such rows take the quantile over all.

Half of the good ids, by hash, may be trained on, at most ``fit_rows`` of them:
that bound is a parameter, and the only one.  If they are more, half of the
bound goes to the ids with the least hash and the other to languages in turn,
so that a rare language has all of its ids or an equal share.  Every row is
scored; the good rows left give quantiles, exact, from counts by bin and the
rows of the bins that hold them.

Defined results: null and empty texts have their end alone and are rejected; a
null language, one that the labels don't have or one of which fewer than
``LEAST`` good rows are left takes the threshold over all languages; rows are
judged one by one, those that repeat an id too (each trains, or none); a text at
its threshold is kept; very long texts are scored whole; without labels nothing
is trusted and only empty texts go; an empty table gives an empty result;
further columns stay inside ``row``, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import kneser_ney

#: Labelled ids to train on; quantile of trusted log10 perplexities, and what a text may lie above it; rows for a language's own quantile.
FIT_ROWS, QUANTILE, SLACK, LEAST = 20_000, 0.995, 0.05, 50


def quality_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, quantile: float = QUANTILE, slack: float = SLACK, order: int = 3, columns: list[str] | None = None) -> DataFrame:
    """``row`` (of ``columns``, or all) with ``n_tokens``, ``perplexity``, ``threshold`` and ``kept``.

    With ``columns`` rows are scored once and written with their scores.  Whole
    rows are not written: they are scored again when the result is read.
    """
    spark = docs.sparkSession
    B.bounded_batches(spark)
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns or docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("good_id"), docs["lang"].cast("string").alias("lang"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    trained = B.written(_sample(rows.select("good_id", "lang"), good, fit_rows), "trained")
    # The list has at most fit_rows ids.
    trusted = B.written(rows.join(F.broadcast(trained), "good_id").select("text"), "trusted")
    meta = kneser_ney.train(trusted, order)
    B.discard(trusted)

    def scores(row) -> DataFrame:
        scored = kneser_ney.score(rows.select(F.struct(row.alias("row"), "good_id", "lang").alias("row"), "text"), meta)
        return scored.select("row.row", "row.good_id", "row.lang", "n_tokens", (-F.col("score") / F.col("n_tokens")).alias("log_perplexity"))

    scored = B.written(scores(F.col("row") if columns else F.lit(0)), "scored")
    logs = scored.filter("good_id is not null and n_tokens > 1").select("good_id", "lang", "log_perplexity")
    logs = logs.join(good, "good_id", "left_semi").join(F.broadcast(trained), "good_id", "left_anti")
    logs = B.written(logs.select("lang", "log_perplexity"), "trusted-scores")
    every = _quantiles(logs.select(F.lit("").alias("lang"), "log_perplexity"), quantile).first()
    every = float("inf") if every is None else every["q"] + slack
    own = _quantiles(logs.filter("lang is not null"), quantile).filter(F.col("n") >= LEAST).select(F.col("lang").alias("own_lang"), (F.col("q") + slack).alias("own"))
    own = B.written(own, "thresholds", coalesce=1)
    B.discard(trained, logs)
    if columns:
        B.delete(spark, f"file://{meta['folder']}")
    else:
        B.discard(scored)
        scored = scores(F.col("row"))
    # One row for each language with LEAST good rows or more.
    out = scored.join(F.broadcast(own), F.col("lang") == F.col("own_lang"), "left")
    limit = F.coalesce("own", F.lit(every))
    return out.select("row", "n_tokens", F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"), ((F.col("n_tokens") > 1) & (F.col("log_perplexity") <= limit)).alias("kept"))


def _sample(named: DataFrame, good: DataFrame, fit_rows: int) -> DataFrame:
    """(good_id): the ids to train on; see the module's text.  An id of several rows counts for the least of their languages."""
    may = good.filter(F.pmod(F.xxhash64(F.lit(5), "good_id"), F.lit(4)) < 2)
    may = named.join(may, "good_id").groupBy("good_id").agg(F.min("lang").alias("lang")).withColumn("h", F.xxhash64("good_id"))
    may = B.written(may, "may-train")
    if may.count() <= fit_rows:
        return may.select("good_id")
    first = B.written(may.orderBy("h", "good_id").limit(fit_rows // 2).select("good_id"), "trained-first")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "good_id"))
    rest = may.join(F.broadcast(first), "good_id", "left_anti").withColumn("turn", turn).filter(F.col("turn") <= fit_rows)
    return first.union(rest.orderBy("turn", "h", "good_id").limit(fit_rows - fit_rows // 2).select("good_id"))


def _quantiles(logs: DataFrame, quantile: float) -> DataFrame:
    """(lang, n, q): rows and interpolated quantile of each language's log perplexities."""
    logs = logs.withColumn("bin", F.floor(F.col("log_perplexity") * 4096))
    upto = Window.partitionBy("lang").orderBy("bin")
    bins = logs.groupBy("lang", "bin").agg(F.count("*").alias("c"))
    bins = bins.select("lang", "bin", "c", (F.sum("c").over(upto) - F.col("c")).alias("below"), F.sum("c").over(Window.partitionBy("lang")).alias("n"))
    at = F.lit(quantile) * (F.col("n") - 1)
    # Ranks from 0; the quantile lies between two of them.
    bins = bins.withColumn("low", F.floor(at)).withColumn("high", F.ceil(at)).withColumn("part", at - F.floor(at))
    held = lambda rank: (F.col("below") <= F.col(rank)) & (F.col(rank) < F.col("below") + F.col("c"))
    near = logs.join(F.broadcast(bins.filter(held("low") | held("high"))), ["lang", "bin"])
    near = near.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("lang", "bin").orderBy("log_perplexity")) - 1)
    value = lambda rank: F.max(F.when(F.col("rank") == F.col(rank), F.col("log_perplexity")))
    ends = near.groupBy("lang", "n", "part").agg(value("low").alias("x"), value("high").alias("y"))
    return ends.select("lang", "n", (F.col("x") + F.col("part") * (F.col("y") - F.col("x"))).alias("q"))
