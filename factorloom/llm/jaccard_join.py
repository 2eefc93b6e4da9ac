"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The incidence matrix is cut into column blocks by n-gram hash.  One pass over
the texts deals each document's distinct n-grams to their blocks, as the hash
and the document's place (text block, row); a column block drops the columns
with one document (they overlap with nothing) and sends the rest back to their
text block, where rows are put together, rarest column first.  Rows are then
collapsed by their whole set, so exact copies are one row, the *class*.

Size-derived bounds discard pairs before and after they are counted: sets with
Jaccard of at least t overlap in t * max(size) n-grams or more, so a row with
fewer shared columns has no partner, and two partners share one of the first
``size - ceil(t * size) + 1`` columns in any fixed order.

The product is worked out in blocks of a *hub* and up to ``PART`` rows that
share a bounded column with it: each column of the hub adds one to the overlap
of every row that has it too, and pairs below the bound of their sizes go.

For components not every pair of a large group is needed: rows sharing a column
are first multiplied with a few hubs of that column (the rows with the fewest
columns of their own).  Whatever is then in the component of most rows of the
column is settled; every remaining pair of different components that shares a
bounded column is multiplied, so no link between components is lost.

Defined results: null or empty texts have no n-grams and are alone; texts with
fewer words than ``n`` have their whole sequence as one n-gram; very long texts
are taken whole, a text larger than a block being a block of its own; a null
``doc_id`` gives a null component; rows that repeat a ``doc_id`` are judged one
by one; ties go to the smaller id; an empty table gives an empty result; further
columns are ignored, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import components

#: Rows that are multiplied with a hub at a time.
PART = 256
#: Kinds of payloads: incidence entries, and the rows of a text block.
_ENTRIES, _ROWS = 0, 1


def shingle_sets(texts: list[bytes], n: int):
    """(row, name) of each row's distinct n-grams, sorted by row and name."""
    words = B.Words(texts, lower=True)
    starts = words.windows(n)
    name, row = B.window_names(words.h, n)[starts], words.doc[starts]
    for size in range(1, n):
        short = np.flatnonzero(words.n == size)
        if len(short):
            name = np.r_[name, B.window_names(words.h, size, salt=size)[words.start[short]]]
            row = np.r_[row, short]
    order = np.lexsort((name, row))
    name, row = name[order], row[order]
    first = B.groups(row, name)
    return row[first], name[first]


class _Route(B.Route):
    """Entries go by their column's hash, or ``back`` to their text block, as its rows do."""

    def __init__(self, n: int, back: bool = False):
        self.n, self.back = n, back

    def buckets(self, kind: int, e: dict[str, np.ndarray]) -> np.ndarray:
        return B.ranged(e["blk" if self.back or kind == _ROWS else "name"], self.n)


def _dealt(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> list[tuple[int, bytes]]:
    return [(b, B.pack(kind, **{k: v[x] for k, v in columns.items()})) for b, x in B.by_bucket(bucket)]


def _incidence(n: int, buckets: int, fan: int):
    step = B.first_step(buckets, fan)

    def run(batches):
        task = np.uint64(TaskContext.get().partitionId())
        for number, batch in enumerate(B.blocks(batches)):
            texts, ids = B.raw(batch), B.column(batch, "doc_id")
            rows = len(texts)
            blk = B.mix(np.array([(task << np.uint64(32)) + np.uint64(number + 1)]))
            row, name = shingle_sets(texts, n)
            size = np.bincount(row, minlength=rows).astype(np.int64)
            sums = np.zeros((2, rows), np.uint64)
            np.add.at(sums[0], row, B.mix(name))
            np.add.at(sums[1], row, B.mix(name + np.uint64(12345)))
            f1, f2 = B.mix(sums[0] + size.astype(np.uint64)), B.mix(sums[1])
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
            # One named row of a set stands for all in its block; a set without a named document takes part in nothing.
            named = np.flatnonzero(~null)
            own = np.zeros(rows, bool)
            if len(named):
                own[named[np.unique(np.stack([f1[named], f2[named]]), axis=1, return_index=True)[1]]] = True
            keep = np.flatnonzero(own[row])
            name, row = name[keep], row[keep]
            order = np.argsort(name, kind="stable")
            name, row = name[order], row[order].astype(np.uint16 if rows < 65536 else np.uint32)
            out = _dealt(_ENTRIES, B.ranged(name, buckets) // step, name=name, row=row, blk=np.repeat(blk, len(name)))
            stats = {"row": np.arange(rows, dtype=row.dtype), "id": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), "null": null.astype(np.int8), "n": size, "f1": f1, "f2": f2}
            out.append((int(B.ranged(blk, buckets)[0]) // step, B.pack(_ROWS, blk=np.repeat(blk, rows), **stats)))
            yield B.packed(out)

    return run


def _shared_columns(buckets: int, fan: int):
    """Columns of two rows or more, back to their text blocks; the text blocks' rows pass through."""
    step = B.first_step(buckets, fan)

    def run(batches):
        entries, rows = B.of_kinds(batches)
        for p in rows:
            blk = B.unpack(p)["blk"][:1]
            yield B.packed([(int(B.ranged(blk, buckets)[0]) // step, p)])
        e = B.gathered(entries)
        del entries, rows
        if not e:
            return
        order = np.argsort(e["name"], kind="stable")
        name = e["name"][order]
        head = B.groups(name)
        df = np.diff(np.r_[head, len(name)])
        many = np.repeat(df > 1, df)
        order, name, df = order[many], name[many], np.repeat(df, df)[many].astype(np.int32)
        blk, row = e["blk"][order], e["row"][order]
        del e
        order = np.lexsort((row, blk))
        out = _dealt(_ENTRIES, B.ranged(blk[order], buckets) // step, blk=blk[order], row=row[order], col=name[order], df=df[order])
        if out:
            yield B.packed(out)

    return run


def _node_names(f1: np.ndarray, f2: np.ndarray) -> pa.Array:
    held = np.stack([f1.byteswap(), f2.byteswap()], axis=1)
    return pa.array([x.tobytes() for x in held], pa.binary())


_TABLE = "node binary, n long, doc_id long, bound int, cols array<long>"


def _rows(percent: int):
    """Every row (without ``cols``), and those whose shared columns can reach the bound: their columns, rarest first."""

    def run(batches):
        entries, rows = B.of_kinds(batches)
        s, e = B.gathered(rows), B.gathered(entries)
        if not s:
            return
        order = np.lexsort((s["row"], s["blk"]))
        s = {k: v[order] for k, v in s.items()}
        k = len(s["n"])
        none = pa.nulls(k, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([_node_names(s["f1"], s["f2"]), pa.array(s["n"]), pa.array(s["id"], mask=s["null"].astype(bool)), pa.nulls(k, pa.int32()), none], names=["node", "n", "doc_id", "bound", "cols"])
        if not e:
            return
        order = np.lexsort((e["col"], e["df"], e["row"], e["blk"]))
        blk, row, col = e["blk"][order], e["row"][order], e["col"][order]
        del e
        head = B.groups(blk, row)
        shared = np.diff(np.r_[head, len(blk)])
        # Rows of a text block are numbered without a gap.
        first = np.searchsorted(s["blk"], blk[head])
        at = first + row[head]
        f1, f2, n = s["f1"][at], s["f2"][at], s["n"][at]
        least = -(-percent * n // 100)
        take = np.flatnonzero(shared >= least)
        for i in range(0, len(take), 500):
            x = take[i : i + 500]
            yield pa.RecordBatch.from_arrays(
                [
                    _node_names(f1[x], f2[x]),
                    pa.array(n[x]),
                    pa.nulls(len(x), pa.int64()),
                    pa.array((shared[x] - least[x] + 1).astype(np.int32)),
                    pa.array([col[a : a + m].view(np.int64) for a, m in zip(head[x], shared[x])], pa.list_(pa.int64())),
                ],
                names=["node", "n", "doc_id", "bound", "cols"],
            )

    return run


def _product(percent: int):
    """Overlaps of each hub (kind 0) with the rows behind it, column by column; pairs within the bound are links."""

    def run(batches):
        hub = None  # of the group that the last batch has ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [hub] if hub is not None else []
            table = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            kind, n = B.column(table, "kind").to_numpy(), B.column(table, "n").to_numpy()
            node = B.column(table, "node").to_pylist()
            cols = B.column(table, "cols")
            ends = cols.offsets.to_numpy()
            flat = cols.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] :]
            of = np.repeat(np.arange(len(kind)), np.diff(ends))
            group = np.cumsum(kind == 0) - 1  # a group begins with its hub
            hubs = np.flatnonzero(kind == 0)
            cell = B.join2(flat, group[of].astype(np.uint64))
            mine = np.sort(cell[kind[of] == 0])
            other = np.flatnonzero(kind[of] == 1)
            if len(other):
                at = np.minimum(np.searchsorted(mine, cell[other]), len(mine) - 1)
                overlap = np.bincount(of[other][mine[at] == cell[other]], minlength=len(kind))
                with_ = hubs[group]
                x = np.flatnonzero((kind == 1) & (overlap * 100 >= percent * (n + n[with_] - overlap)))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([node[i] for i in x], pa.binary()), pa.array([node[i] for i in with_[x]], pa.binary())], names=["a", "b"])
            hub = table.slice(int(hubs[-1]), 1)

    return run


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, hub b) those whose accumulated overlap reaches the bound."""
    # Hubs of many rows are several blocks of the product.
    large = pairs.groupBy("b").agg(F.count("*").alias("k")).filter(F.col("k") > PART)
    parts = F.coalesce(F.ceil(F.col("k") / F.lit(PART)), F.lit(1))
    placed = pairs.join(large, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    side = rows.select("node", "n", "cols")
    right = placed.select("b", "part").distinct().join(side, F.col("b") == F.col("node")).select("b", "part", F.lit(0).alias("kind"), "node", "n", "cols")
    left = placed.join(side, F.col("a") == F.col("node")).select("b", "part", F.lit(1).alias("kind"), "node", "n", "cols")
    work = right.union(left).repartition("b", "part").sortWithinPartitions("b", "part", "kind")
    return work.select("kind", "node", "n", "cols").mapInArrow(B.tidied(_product(percent)), "a binary, b binary")


def _possible(percent: int):
    """Whether a pair can reach the bound, by its sizes and by the places of a column that both have.

    Sets of sizes n and hn must overlap in percent / (100 + percent) * (n + hn)
    or more; if this is the first column that they share, no more than what
    follows it in either set can overlap.  Other shared columns allow less, so a
    pair that no column allows is no link.
    """
    least = F.ceil(F.lit(percent) * (F.col("n") + F.col("hn")) / F.lit(100 + percent))
    return F.least(F.col("n") - F.col("pos"), F.col("hn") - F.col("hpos")) >= least


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, hubs: int = 4, fan: int = B.FAN) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    B.bounded_batches(spark)
    buckets = B.bucket_count(docs)
    base = B.steady(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    dealt = base.mapInArrow(B.tidied(_incidence(n, buckets, fan)), B.PACKED)
    back = B.exchange(dealt, buckets, _shared_columns(buckets, fan), B.PACKED, _Route(buckets), fan)
    table = B.written(B.exchange(back, buckets, _rows(percent), _TABLE, _Route(buckets, back=True), fan), "rows")
    B.discard(base)
    sizes = table.filter("cols is null").select("doc_id", F.col("n").alias("n_shingles"), "node")
    # A class may have a row in several text blocks; they are equal.
    rows = table.filter("cols is not null").groupBy("node").agg(F.first(F.struct("n", "bound", "cols")).alias("r")).select("node", "r.*")
    rows = B.written(rows, "classes")
    links, used = class_links(rows, percent, hubs)
    labels = components(links)
    B.discard(rows, *used)
    classes = sizes.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = classes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    best = joined.filter("label is not null").join(joined.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("node", "component_id")
    out = sizes.join(best, "node", "left")
    named = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    # Three numbers a document; all else can go.
    out = B.written(out.select("doc_id", "n_shingles", named.alias("component_id")), "groups")
    B.discard(table, labels)
    return out


def class_links(rows: DataFrame, percent: int, hubs: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between classes with the components of all links, and the tables they are read from; see the module's text."""
    own = F.col("n") - F.size("cols")
    entries = rows.select("node", "n", own.alias("own"), F.posexplode(F.slice("cols", F.lit(1), F.col("bound"))).alias("at", "col"))
    # Columns that no other set has come first in a set's order.
    entries = B.written(entries.select("node", "n", "own", (F.col("own") + F.col("at")).alias("pos"), "col"), "entries")
    found, used = None, []
    label = entries.select("node", "n", "own", "pos", "col", F.col("node").alias("label"))
    for turn in range(2):
        # Hubs of a column: of each hashed share of its rows the one with the fewest columns of its own.
        share = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(hubs * (1 + turn)))
        best = label.groupBy("col", share.alias("share")).agg(F.min(F.struct("own", "node", "n", "pos", "label")).alias("hub"))
        best = best.select("col", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hn"), F.col("hub.pos").alias("hpos"), F.col("hub.label").alias("hl"))
        near = label.join(best, "col").filter(F.col("node") != F.col("hub")).filter(F.col("label") != F.col("hl")).filter(_possible(percent))
        new = B.written(_linked(near.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), rows, percent), "links")
        found = new if found is None else found.union(new)
        named = components(found, f"hubs{turn}")
        label_ = entries.join(named, "node", "left").select("node", "n", "own", "pos", "col", F.coalesce("label", "node").alias("label"))
        # Columns whose rows are all in one component are settled.
        open_ = label_.groupBy("col").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("col")
        label_ = B.written(label_.join(open_, "col", "left_semi"), "open")
        B.discard(named, label)
        label = label_
        used.append(new)
    B.discard(entries)
    count = label.groupBy("col", "label").agg(F.count("*").alias("k"))
    main = count.groupBy("col").agg(F.max(F.struct("k", "label")).alias("main")).select("col", F.col("main.label").alias("main"))
    rest = label.join(main, "col").filter(F.col("label") != F.col("main")).select("col", F.col("node").alias("hub"), F.col("n").alias("hn"), F.col("pos").alias("hpos"), F.col("label").alias("hl"))
    near = label.join(rest, "col").filter(F.col("label") != F.col("hl")).filter(_possible(percent))
    near = near.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    new = B.written(_linked(near, rows, percent), "links")
    B.discard(label)
    return found.union(new), [*used, new]
