"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / weight`` with u from a seeded hash of
its id, text and source, so reruns agree.  Each source's share of the budget is
set by its weight and capped at a number of epochs; the excess goes to the
others by weight, to the level at which all shares fit.  Complete epochs come
first; the fraction that is left takes documents in key order until it is
filled.

The prefix sum needs no task that holds a source: keys are cut into bins by
their logarithm, bins are summed by source, and the bin in which a source's
budget ends is cut again until it holds few rows, which alone are sorted.  A bin
of an exponential law spans the same factor everywhere, so the fullest of the
first cut holds less than a thousandth of the rows of any one weight, whatever
the weights are.

Rows with equal id, text and source would have one key.  Where there are any,
the table is written and they are numbered (by task, with offsets by task, so
that no task holds them all), and each number has a draw of its own.

Defined results: a null text has size 0 and is never taken; a null source is a
source of its own, ordered last; a null id is drawn by text and source; equal
rows are drawn one by one, and which of them are taken is open; very long texts
are counted whole; an empty table gives an empty result; further columns are
kept in ``row``, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

#: A key's logarithm in units of 2^-40; bins are 2^30 of them at first, and each further cut makes 1024 of one.
UNIT, STEPS = 40, (30, 20, 10, 0)
#: Rows of a source that one task sorts.
EDGE = 20_000


def text_size(text: Column) -> Column:
    """Words of a text: 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(B.WORD)), F.lit(0)).cast("long")


def letter_weight(text: Column) -> Column:
    """A quality weight in (0, 1]: falls with the share of symbols among a text's characters."""
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>{}[]=\\^~!", ""))
    return F.coalesce(F.greatest(F.lit(0.01), 1.0 - 4.0 * signs / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def targets(sizes: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from a table (source, size, ...).

    Sources by code point, null last, weigh ``weights``, repeating.  The level
    at which capped shares add up is found in one pass over the sources, those
    that reach their cap first before the rest.  The table has one row a source.
    """
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    held = held.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    held = held.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everyone = Window.partitionBy(F.lit(1))
    first = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("total", F.sum("source_size").over(everyone) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everyone))
    before, used = F.coalesce(F.sum("cap").over(first), F.lit(0.0)), F.coalesce(F.sum("weight").over(first), F.lit(0.0))
    held = held.withColumn("level", (F.col("total") - before) / (F.col("all_weight") - used))
    # Sources that fit under the level of the first one that doesn't reach its cap all get that level.
    held = held.withColumn("free", F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level"))))
    held = held.withColumn("level", F.min("free").over(everyone)["level"])
    share_of = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return held.select("source", "source_size", share_of.alias("target"))


def drawn(docs: DataFrame, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """``row`` (the input's columns) with ``source``, ``size``, ``draw`` (64 bits) and ``es_weight``."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = F.col("row.text").cast("string")
    weight = letter_weight(text) if weight is None else weight
    draw = F.xxhash64(F.lit(seed), F.col("row.doc_id").cast("long"), text, F.col("row.source").cast("string"))
    return rows.select("row", F.col("row.source").cast("string").alias("source"), text_size(text).alias("size"), draw.alias("draw"), weight.alias("es_weight"))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of :func:`drawn` with the sampling key ``es_key`` and its place ``es_log``."""
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    key = F.greatest(-F.log(u) / F.col("es_weight"), F.lit(1e-300))
    return rows.withColumn("es_key", key).withColumn("es_log", F.floor(F.log("es_key") * float(1 << UNIT)).cast("long")).drop("draw", "es_weight")


def repeated(rows: DataFrame) -> DataFrame:
    """The draws that several rows have."""
    return rows.groupBy("draw").count().filter("count > 1").select("draw")


def apart(rows: DataFrame) -> DataFrame:
    """Written rows of :func:`drawn`, each with a draw of its own."""
    again = B.written(repeated(rows), "repeated-draws")
    rows = rows.withColumn("at", F.monotonically_increasing_id())  # the same in every read of a written table
    few = rows.select("draw", "at", F.shiftright("at", 33).alias("task")).join(again, "draw", "left_semi")
    by_task = few.groupBy("draw", "task").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("draw").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("draw", "task", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("draw", "task").orderBy("at")) - 1
    number = few.withColumn("own", own).join(by_task, ["draw", "task"]).select("at", (F.col("before") + F.col("own")).alias("number"))
    rows = rows.join(number, "at", "left").drop("at")
    return rows.withColumn("draw", F.when(F.col("number") > 0, F.xxhash64("draw", "number")).otherwise(F.col("draw"))).drop("number")


def cuts(narrow: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, edge: int = EDGE) -> DataFrame:
    """One row a source: target, complete epochs, and up to where the fraction takes keys."""
    goal = B.written(targets(narrow, weights, share, epochs), "targets", coalesce=1)
    goal = goal.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    open_, last = goal.select("source", "rest", F.lit(0).cast("long").alias("before")), None
    for step in STEPS:
        # Rows of the last cut's bin only; bins of a source are at most some ten thousand.
        inside = narrow if last is None else _by_source(narrow, last.select("source", "low", "high"), "inner").filter((F.col("es_log") >= F.col("low")) & (F.col("es_log") < F.col("high"))).drop("low", "high")
        bins = inside.groupBy("source", F.shiftright("es_log", step).alias("bin")).agg(F.sum("size").alias("binned"), F.count("*").alias("rows"))
        bins = _by_source(bins, open_, "inner")
        bins = bins.withColumn("upto", F.col("before") + F.sum("binned").over(Window.partitionBy("source").orderBy("bin")))
        hit = bins.filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("binned") < F.col("rest")))
        hit = hit.groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("binned")).alias("before"), "rest", "rows")).alias("c"))
        low = F.shiftleft(F.col("c.bin"), step)
        last_ = B.written(hit.select("source", low.alias("low"), (low + F.lit(1 << step)).alias("high"), F.col("c.before").alias("before"), F.col("c.rest").alias("rest"), F.col("c.rows").alias("rows")), "bins", coalesce=1)
        B.discard(last)
        last = last_
        open_ = last.select("source", "rest", "before")
        if (last.agg(F.max("rows")).first()[0] or 0) <= edge:
            break
    ends = _by_source(narrow, last, "inner").filter((F.col("es_log") >= F.col("low")) & (F.col("es_log") < F.col("high")))
    sums = Window.partitionBy("source").orderBy("es_key")
    ends = ends.withColumn("upto", F.col("before") + F.sum("size").over(sums.rangeBetween(Window.unboundedPreceding, 0)))
    ends = ends.filter(F.col("upto") - F.col("size") / 2.0 <= F.col("rest")).groupBy("source").agg(F.max("es_key").alias("last_key"))
    ends = B.written(ends, "ends", coalesce=1)
    held = _by_source(_by_source(goal, last.select("source", "low"), "left"), ends, "left")
    none = F.lit(-(1 << 62))
    out = B.written(held.select("source", "source_size", "target", "full", F.coalesce("low", none).alias("low"), F.coalesce("last_key", F.lit(-1.0)).alias("last_key")), "cuts", coalesce=1)
    B.discard(goal, last, ends)
    return out


def _by_source(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by source, null included; the right side has one row a source and is broadcast while its counted rows are few."""
    right = right.withColumnRenamed("source", "of_source")
    if right.count() <= 100_000:
        right = F.broadcast(right)
    return left.join(right, F.col("source").eqNullSafe(F.col("of_source")), how).drop("of_source")


def mixed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Rows of :func:`keyed` with ``source_size``, ``target``, ``copies`` and ``taken``."""
    out = _by_source(rows, cut, "inner")
    part = (F.col("es_log") < F.col("low")) | (F.col("es_key") <= F.col("last_key"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("full") + part.cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("full", "low", "last_key", "es_key", "es_log")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, weight: Column | None = None, seed: int = 17, edge: int = EDGE) -> DataFrame:
    """Every input row as ``row`` with ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words."""
    rows = drawn(docs, weight, seed)
    narrow = B.written(rows.drop("row"), "draws")
    if not repeated(narrow).isEmpty():
        B.discard(narrow)
        whole = B.written(rows, "drawn")
        rows = B.written(apart(whole), "drawn-apart")
        B.discard(whole)
        narrow = rows.drop("row")
    cut = cuts(keyed(narrow), weights, share, epochs, edge)
    B.discard(narrow)
    return mixed(keyed(rows), cut)


def mix_sizes(docs: DataFrame, weights: list[float], share: float = 1.5, epochs: float = 2.0, weight: Column | None = None, seed: int = 17, edge: int = EDGE) -> DataFrame:
    """:func:`mix` with ``doc_id`` alone in the place of ``row``; texts are read once."""
    rows = B.written(drawn(docs, weight, seed).withColumn("row", F.col("row.doc_id")).withColumnRenamed("row", "doc_id"), "draws")
    if not repeated(rows).isEmpty():
        whole, rows = rows, B.written(apart(rows), "drawn-apart")
        B.discard(whole)
    return mixed(keyed(rows), cuts(keyed(rows.drop("doc_id")), weights, share, epochs, edge))
