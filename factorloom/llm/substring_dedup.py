"""Substring dedup by recompression.

Rounds of recompression name the tokens of every text: first runs of one
word, then adjacent pairs (left class, right class), round after round.  A
name is a hash of what it stands for, so naming is global without a shuffle,
and whether two neighbours merge depends on nothing but their own names:
equal substrings get equal symbols, apart from a few at their two ends.  For
every window of ``window`` words the code computes which symbols of each level
are certain from the window's words alone.

Symbols reveal repeats: the certain symbols of the highest level give each
window's *anchor* (a pair of neighbours with the least name).  Equal windows
have equal anchors, so a window can only repeat if its anchor does.  Symbols
also verify them: a window's *name* (96 bits) is made of the symbols that each
level drops at its two ends and those certain at the top, which together spell
its words, so equal names are equal windows and the other way round.

1. Anchors are dealt by name; those that two documents hold are sent back to
   their documents.
2. Windows with such an anchor are named by their symbols and dealt by name;
   those that also start in a document with a smaller id are reported.
3. The reported positions meet the texts again and their words are removed.

A block settles what repeats inside it: it sends one entry for each anchor and
for each window, and what it has settled goes to where the block's documents
are put together, not to the anchor's or window's task.  So a passage that a
third of all documents share costs entries by block, not by document.  Entries
name documents by text block and row; for that, tasks must read the same rows
whenever they run again, so an input that comes out of a shuffle is written.

Defined results: a null text has no words; a null ``doc_id`` neither gives nor
receives (its words are all kept); rows that repeat a ``doc_id`` are one
document, so they don't remove each other's words; the first of equal passages
is that of the smallest id; very long texts are taken whole, a text larger than
a block being a block of its own; an empty table gives an empty result; further
columns stay in ``row``, so their names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Rounds of pair naming; words lost at each end of a window grow with the rounds.
ROUNDS = 3
_NONE = np.uint64(0)


def _left_class(names: np.ndarray, level: int) -> np.ndarray:
    """Whether a symbol is in the left class of this round, from its name alone."""
    return (B.mix(names + np.uint64(7919 * (level + 1))) & np.uint64(1)).astype(bool)


class Symbols:
    """The symbols of a block of words, level by level."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
        self.h, self.levels = h, []
        new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        self.run, self.head = np.cumsum(new, dtype=np.int32) - np.int32(1), np.flatnonzero(new)
        length = np.diff(np.r_[self.head, len(h)]).astype(np.uint64)
        self.word, doc = h[self.head], doc[self.head]
        names = np.where(length > 1, B.join2(self.word, length, 100), self.word)
        for level in range(rounds if len(h) else 0):
            left = _left_class(names if level else self.word, level)
            joined = np.zeros(len(names), bool)
            joined[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
            second = np.r_[False, joined[:-1]]
            self.levels.append((names, left, joined, np.cumsum(~second, dtype=np.int32) - np.int32(1)))
            head = np.flatnonzero(~second)
            up = names[head].copy()
            at = head[joined[head]]
            up[joined[head]] = B.join2(names[at], names[at + 1], level + 101)
            names, doc = up, doc[head]
        self.top = names

    def _interiors(self, starts: np.ndarray, window: int):
        """For each level: its names, and of all windows the first and last certain symbol and which were dropped at its two ends.

        A last item has the top's names.  Windows of which nothing is left have their last symbol before the first.
        """
        a, b = self.run[starts] + 1, self.run[starts + window - 1] - 1  # the outer runs may reach beyond the window
        for level, (names, left, joined, parent) in enumerate(self.levels):
            lost = np.zeros((2, len(a)), bool)
            live = np.flatnonzero(a <= b)
            if level:  # what lies beside the interior is unknown, so a possible merge counts
                lost[0, live], lost[1, live] = ~left[a[live]], left[b[live]]
            else:  # the outer runs' words are known, and with them their classes
                lost[0, live], lost[1, live] = joined[a[live] - 1], joined[b[live]]
            yield level, names, a, b, lost
            a, b = a + lost[0].astype(a.dtype), b - lost[1].astype(b.dtype)
            live = np.flatnonzero(a <= b)
            dead = np.ones(len(a), bool)
            dead[live] = False
            a[live], b[live] = parent[a[live]], parent[b[live]]
            a[dead], b[dead] = 1, 0
        yield len(self.levels), self.top, a, b, None

    def anchors(self, starts: np.ndarray, window: int) -> np.ndarray:
        """The anchor of each window; 0 where no symbol is certain (such windows are always compared)."""
        found = np.zeros(len(starts), np.uint64)
        if len(starts):
            for level, names, a, b, _ in self._interiors(starts, window):
                if level > 1:  # later levels overwrite: the highest with a certain symbol counts
                    _choose(found, names, a, b, np.flatnonzero(a <= b), level - 1)
        return found

    def names(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent names of each window, made of its certain symbols."""
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        one, last = self.run[starts], self.run[starts + window - 1]
        # The outer runs as far as they lie in the window.
        ends = np.r_[self.head[1:], len(self.h)]
        n1 = np.minimum(ends[one] - starts, window).astype(np.uint64)
        n2 = np.where(one == last, window, starts + window - self.head[last]).astype(np.uint64)
        out = [B.join2(B.join2(self.word[one], n1, salt), B.join2(self.word[last], n2, salt), salt) for salt in (11, 12)]
        for level, names, a, b, lost in self._interiors(starts, window):
            if lost is None:
                base = [np.uint64(0x9E6C63D0876A9A47), np.uint64(0xD1B54A32D192ED03)]
                for i, r in enumerate(base):
                    # The interior as a polynomial in an odd base, from prefix sums.
                    power = np.ones(len(names) + 1, np.uint64)
                    power[1:] = np.cumprod(np.full(len(names), r))
                    upto = np.r_[_NONE, np.cumsum(B.mix(names + np.uint64(i)) * power[:-1])]
                    back = np.ones(len(names) + 1, np.uint64)
                    back[1:] = np.cumprod(np.full(len(names), np.uint64(pow(int(r), -1, 1 << 64))))
                    live = a <= b
                    x, y = np.where(live, a, 0), np.where(live, b + 1, 0)
                    out[i] = B.join2(out[i], (upto[y] - upto[x]) * back[x] + (y - x).astype(np.uint64), 13)
                break
            for side, at in ((0, a), (1, b)):
                x = np.flatnonzero(lost[side])
                for i in range(2):
                    out[i][x] = B.join2(out[i][x], names[at[x]], 31 * level + 2 * side + i + 17)
        return out[0], out[1]


def _choose(found, names, a, b, live, level) -> None:
    one = live[a[live] == b[live]]
    found[one] = B.mix(names[a[one]] + np.uint64(level + 11)) | np.uint64(1)
    more = live[a[live] < b[live]]
    if not len(more):
        return
    pair = B.join2(names[:-1], names[1:], level + 31) | np.uint64(1)
    table, span = [pair], 1
    width = int((b[more] - a[more]).max())
    while 2 * span <= width:
        low = table[-1]
        table.append(np.minimum(low[: len(low) - span], low[span:]))
        span *= 2
    n = b[more] - a[more]  # pairs in the interior
    power = np.frexp(n.astype(float))[1] - 1
    for p, least in enumerate(table):
        at = more[power == p]
        found[at] = np.minimum(least[a[at]], least[b[at] - (1 << p)])


#: Kinds of payloads: entries to be compared, what is settled, and the documents of a text block.
_OPEN, _DONE, _ROWS = 0, 1, 2


class _Route(B.Route):
    """Entries go by their name, all else and what comes ``back`` to its text block."""

    def __init__(self, n: int, back: bool = False):
        self.n, self.back = n, back

    def buckets(self, kind: int, e: dict[str, np.ndarray]) -> np.ndarray:
        return B.ranged(e["blk" if self.back or kind != _OPEN else "name"], self.n)


def _sent(kind: int, bucket: np.ndarray, **columns: np.ndarray) -> list[tuple[int, bytes]]:
    return [(b, B.pack(kind, **{k: v[x] for k, v in columns.items()})) for b, x in B.by_bucket(bucket)]


class _Block:
    """A text block: its documents, words and symbols, and a name by which entries can say whose they are."""

    def __init__(self, batch: pa.RecordBatch, number: int, window: int, rounds: int):
        self.ids, self.keys = B.longs(batch, "doc_id"), B.longs(batch, "text_key")
        self.blk = B.mix(np.array([(np.uint64(TaskContext.get().partitionId()) << np.uint64(32)) + np.uint64(number + 1)]))
        self.words = B.Words(B.raw(batch))
        # Of rows with one id and text one speaks for all: results are joined by id and text.
        own = np.zeros(len(self.ids), bool)
        own[np.unique(np.stack([self.ids, self.keys]), axis=1, return_index=True)[1]] = True
        self.starts = self.words.windows(window)
        self.starts = self.starts[own[self.words.doc[self.starts]]]
        self.symbols = Symbols(self.words.h, self.words.doc, rounds)
        self.anchor, self.doc = self.symbols.anchors(self.starts, window), self.words.doc[self.starts]

    def rows(self, n: int, step: int) -> list[tuple[int, bytes]]:
        k = len(self.ids)
        blk = np.repeat(self.blk, k)
        return _sent(_ROWS, B.ranged(blk, n) // step, blk=blk, row=np.arange(k, dtype=np.uint32), id=self.ids, key=self.keys)

    def done(self, n: int, step: int, row: np.ndarray, data: np.ndarray) -> list[tuple[int, bytes]]:
        order = np.lexsort((data, row))
        blk = np.repeat(self.blk, len(row))
        return _sent(_DONE, B.ranged(blk, n) // step, blk=blk, row=row[order].astype(np.uint32), data=data[order])


def _anchor_blocks(window: int, rounds: int, n: int, fan: int):
    """A block's anchors: one entry for each, marked if it is known to repeat; the other documents that hold it are settled."""
    step = B.first_step(n, fan)

    def run(batches):
        for number, batch in enumerate(B.blocks(batches)):
            block = _Block(batch, number, window, rounds)
            name, doc = block.anchor, block.doc
            at = B.groups(name, doc)
            at = at[name[at] != _NONE]
            name, doc = name[at], doc[at]
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            at = B.groups(name, doc)
            name, doc = name[at], doc[at]
            out = block.rows(n, step)
            if len(name):
                head = B.groups(name)
                size = np.diff(np.r_[head, len(name)])
                ids = block.ids[doc]
                told = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
                rest = np.ones(len(name), bool)
                rest[head] = False
                rest &= np.repeat(told, size)
                x = name[head]
                out += _sent(_OPEN, B.ranged(x, n) // step, name=x, told=told.astype(np.int8), blk=np.repeat(block.blk, len(x)), row=doc[head].astype(np.uint32))
                # Repeated rows of one document hold an anchor together; all of them have to know.
                same = np.ones(len(name), bool)
                same[head] = False
                same &= ~np.repeat(told, size)
                x = np.flatnonzero(same)
                out += _sent(_OPEN, B.ranged(name[x], n) // step, name=name[x], told=np.zeros(len(x), np.int8), blk=np.repeat(block.blk, len(x)), row=doc[x].astype(np.uint32))
                out += block.done(n, step, doc[rest], name[rest])
            yield B.packed(out)

    return run


def _pass_on(done: list[bytes], rows: list[bytes], n: int, step: int):
    """What is settled goes on to its text block's task as it is."""
    for p in [*done, *rows]:
        e = B.unpack(p)
        bucket = B.ranged(e["blk"], n) // step
        if bucket.min() == bucket.max():
            yield B.packed([(int(bucket[0]), p)])
        else:  # payloads of several blocks, put together on the way
            yield B.packed(_sent(p[0], bucket, **e))


def _repeated_anchors(n: int, fan: int):
    """Of a bucket's anchors those of two documents, back to them."""
    step = B.first_step(n, fan)

    def run(batches):
        open_, done, rows = B.of_kinds(batches, 3)
        yield from _pass_on(done, rows, n, step)
        e = B.gathered(open_)
        if not e:
            return
        order = np.argsort(e["name"], kind="stable")
        name = e["name"][order]
        head = B.groups(name)
        size = np.diff(np.r_[head, len(name)])
        many = (size > 1) | (np.maximum.reduceat(e["told"][order], head) > 0)
        at = order[np.repeat(many, size)]
        yield from _settled(e["blk"][at], e["row"][at], e["name"][at], n, step)

    return run


def _settled(blk, row, data, n: int, step: int):
    order = np.lexsort((data, row, blk))
    out = _sent(_DONE, B.ranged(blk[order], n) // step, blk=blk[order], row=row[order], data=data[order])
    if out:
        yield B.packed(out)


def _document_rows(batches):
    """One row for each document of the task's text blocks that anything is known of."""
    _, done, rows = B.of_kinds(batches, 3)
    s, e = B.gathered(rows), B.gathered(done)
    if not s or not e:
        return
    order = np.lexsort((s["row"], s["blk"]))
    s = {k: v[order] for k, v in s.items()}
    order = np.lexsort((e["data"], e["row"], e["blk"]))
    blk, row, data = e["blk"][order], e["row"][order], e["data"][order]
    at = B.groups(blk, row, data)
    blk, row, data = blk[at], row[at], data[at]
    head = B.groups(blk, row)
    ends = np.r_[head[1:], len(blk)]
    # Rows of a text block are numbered without a gap.
    of = np.searchsorted(s["blk"], blk[head]) + row[head]
    for i in range(0, len(head), 2000):
        h, t, x = head[i : i + 2000], ends[i : i + 2000], of[i : i + 2000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s["id"][x]), pa.array(s["key"][x]), pa.array([data[a:b].tobytes() for a, b in zip(h, t)], pa.binary())], names=["doc_id", "text_key", "data"]
        )


_DOCUMENT_ROWS = "doc_id long, text_key long, data binary"


def _lists(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the binary lists of a batch."""
    held = [np.frombuffer(x or b"", kind) for x in B.column(batch, "data").to_pylist()]
    return np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate([*held, np.zeros(0, kind)])


def _window_blocks(window: int, rounds: int, n: int, fan: int):
    """Names of the windows whose anchor repeats; what a block can tell by itself is settled here."""
    step = B.first_step(n, fan)

    def run(batches):
        for number, batch in enumerate(B.blocks(batches)):
            block = _Block(batch, number, window, rounds)
            ids, name, doc = block.ids, block.anchor, block.doc
            row, told = _lists(batch, np.uint64)
            told = np.unique(B.join2(told, row.astype(np.uint64)))
            head = B.groups(name, doc)
            mine = B.join2(name[head], doc[head].astype(np.uint64))
            at = np.searchsorted(told, mine)
            hit = (name[head] == _NONE) | (told[np.minimum(at, len(told) - 1)] == mine if len(told) else False)
            take = np.flatnonzero(np.repeat(hit, np.diff(np.r_[head, len(name)])))
            if not len(take):
                continue
            pos, doc = block.starts[take], doc[take]
            k1, k2 = block.symbols.names(pos, window)
            k2 = (k2 >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((pos, ids[doc], k2, k1))
            k1, k2, doc, pos = k1[order], k2[order], doc[order], (pos - block.words.start[doc])[order].astype(np.int32)
            head = B.groups(k1, k2)
            size = np.diff(np.r_[head, len(k1)])
            later = ids[doc] > np.repeat(ids[doc[head]], size)
            # A window's smallest document speaks for the block; all of its rows and places are open, as another block's may be smaller.
            x = np.flatnonzero(~later)
            out = block.rows(n, step)
            out += _sent(_OPEN, B.ranged(k1[x], n) // step, name=k1[x], k2=k2[x], id=ids[doc[x]], pos=pos[x], blk=np.repeat(block.blk, len(x)), row=doc[x].astype(np.uint32))
            out += block.done(n, step, doc[later], pos[later])
            yield B.packed(out)

    return run


def _later_windows(n: int, fan: int):
    """Of a bucket's windows those that a document with a smaller id also has."""
    step = B.first_step(n, fan)

    def run(batches):
        open_, done, rows = B.of_kinds(batches, 3)
        yield from _pass_on(done, rows, n, step)
        e = B.gathered(open_)
        if not e:
            return
        order = np.lexsort((e["id"], e["k2"], e["name"]))
        k1, k2, ids = e["name"][order], e["k2"][order], e["id"][order]
        head = B.groups(k1, k2)
        at = order[ids > np.repeat(ids[head], np.diff(np.r_[head, len(k1)]))]
        yield from _settled(e["blk"][at], e["row"][at], e["pos"][at], n, step)

    return run


def repeats(docs: DataFrame, window: int = 13, rounds: int = ROUNDS, fan: int = B.FAN) -> DataFrame:
    """(doc_id, text_key, data): int32 start positions, by document, of windows that a document with a smaller id has too."""
    spark = docs.sparkSession
    B.bounded_batches(spark)
    n = B.bucket_count(docs)
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_key")).filter("doc_id is not null and text is not null")
    base = B.steady(base)
    again = not base.groupBy("doc_id").count().filter("count > 1").isEmpty()

    def known(dealt: DataFrame, fn, name: str) -> DataFrame:
        out = B.exchange(B.exchange(dealt, n, fn, B.PACKED, _Route(n), fan), n, _document_rows, _DOCUMENT_ROWS, _Route(n, back=True), fan)
        # Equal rows of a document may lie in several blocks; they know the same.
        return B.written(out.dropDuplicates(["doc_id", "text_key"]) if again else out, name)

    told = known(base.mapInArrow(B.tidied(_anchor_blocks(window, rounds, n, fan)), B.PACKED), _repeated_anchors(n, fan), "anchors")
    B.release(spark)
    met = base.join(told, ["doc_id", "text_key"], "left").sortWithinPartitions("doc_id", "text_key")
    found = known(met.mapInArrow(B.tidied(_window_blocks(window, rounds, n, fan)), B.PACKED), _later_windows(n, fan), "repeats")
    B.discard(told, base)
    return found


def _cut(window: int):
    def run(batches):
        for batch in B.blocks(batches):
            kept, n_words, n_removed = [], [], []
            for text, data in zip(B.raw(batch), B.column(batch, "data").to_pylist()):
                words = text.split()
                if data:
                    edge = np.zeros(len(words) + 1, np.int32)
                    pos = np.frombuffer(data, np.int32)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    left = [words[i] for i in np.flatnonzero(keep)]
                else:
                    left = words
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [B.column(batch, "row"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "kept_text", "n_words", "n_removed"]
            )

    return run


def dedup_substrings(docs: DataFrame, window: int = 13, rounds: int = ROUNDS) -> DataFrame:
    """Every input row as ``row`` with ``kept_text`` (kept words joined by a space), ``n_words`` and ``n_removed``.

    ``row`` is a struct of the row's own columns, so no name can clash.
    """
    found = repeats(docs, window, rounds)
    B.release(docs.sparkSession)
    key = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).select("row", key.alias("text"), F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(key).alias("text_key"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(found, ["doc_id", "text_key"], "left").select("row", "text", "data").mapInArrow(B.tidied(_cut(window)), f"row {kind}, kept_text string, n_words long, n_removed long")
