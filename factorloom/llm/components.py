"""Connected components of a table of links, by hash-minimum with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``links`` (a, b).

    Each round takes the smallest label among a node's neighbours and then the
    label of that label, so long chains shrink by doubling.  A round's table is
    written to the shared folder.  Loops end when a round changes nothing.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = B.written(both, f"{name}-links")
    held = B.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), f"{name}-labels")
    while True:  # labels only fall, so this ends
        near = both.join(held.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = held.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = held.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = B.written(new.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), f"{name}-labels")
        B.discard(held)
        if new.filter("label <> was").isEmpty():
            B.discard(both)
            return new
        held = new
