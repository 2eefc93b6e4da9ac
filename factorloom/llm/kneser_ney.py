"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting: a block counts its distinct n-grams of the highest order and deals
them by their hash, so no context, however common, lies in one bucket.  A
bucket adds the counts up, writes its shard (sorted hashes and counts) to the
shared folder and sends sums by n-gram of one order less on: as a suffix its
occurrences and the distinct words before it, as a context its total and its
successors seen once, twice and more often.  These are added up in the next
exchange, written likewise and summed for the order below, down to words.
N-grams travel as the hashes of their words, the first of them sorted, so a
payload's bytes don't depend on how many buckets there are.
A shard is one file, written under a name of its own and then renamed, so a
task that runs again after its executor is lost replaces it by the same bytes.

Scoring: a worker maps the shards it needs, a bounded number at a time, and
looks up each distinct n-gram of a block once, by binary search of sorted
queries.  Mapped pages belong to the operating system, so the model's size
doesn't count against a worker's memory.  The shared folder must be one that
machines can open as files (``file:``); a cluster mounts it.

Words are hashed to 64 bits.  Text ends are tokens; text starts are contexts
only.  The counts of lower orders are of distinct words before, except for
n-grams that begin with a text's start, which have none and keep their
occurrences.  Unknown words share the probability that the lowest order leaves
for one word more than the vocabulary.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Words hold no white space, so these can't be words.
END, START = b" end", b" start"
_START = B.hash_words([START])[0]
#: Shards that a worker keeps mapped.
MAPPED = 256
#: What is known of an n-gram of a lower order: distinct words before it, occurrences, and as a context its total and successors seen once, twice and more.
_SUMS = ("adj", "raw", "ctx", "n1", "n2", "n3")


def _folder(url: str) -> str:
    found = urlparse(url)
    if found.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped, so the shared folder must be a mounted path (file:), not {url}")
    return found.path


class Tokens:
    """The tokens of a block: numbers of words in ``vocabulary`` (sorted hashes), and for each token the words before it."""

    def __init__(self, texts: list[bytes], order: int):
        self.words = B.Words(texts, lower=True, end=END)
        h = self.words.h
        self.vocabulary, at = np.unique(np.r_[h, _START], return_inverse=True)
        self.at, start = at[:-1].astype(np.int32), int(at[-1])
        # back[j]: the word j places before each token.
        self.back = [self.at]
        place = np.arange(len(h)) - self.words.start[self.words.doc] if len(h) else np.zeros(0, np.int64)
        for j in range(1, order):
            before = np.r_[np.full(min(j, len(h)), start, np.int32), self.at[:-j]]
            self.back.append(np.where(place >= j, before, np.int32(start)))

    def grams(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct n-grams as rows of word numbers, which of them each token has, how many tokens have each)."""
        v = len(self.vocabulary)
        if v ** len(columns) < 1 << 62:
            key = columns[0].astype(np.int64)
            for c in columns[1:]:
                key = key * v + c
            held, of, count = np.unique(key, return_inverse=True, return_counts=True)
            rows = np.empty((len(held), len(columns)), np.int64)
            for j in range(len(columns) - 1, -1, -1):
                held, rows[:, j] = np.divmod(held, v)
            return rows, of, count
        rows, of, count = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True, return_counts=True)
        return rows, of.reshape(-1), count


def gram_names(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of each n-gram, from its words' hashes."""
    out = columns[0]
    for c in columns[1:]:
        out = B.join2(out, c)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _folded(columns: list[np.ndarray], x: np.ndarray, **sums: np.ndarray) -> bytes:
    """The n-grams at ``x`` (words' hashes by place) and their sums as a payload."""
    x = x[np.argsort(columns[0][x], kind="stable")]
    return B.pack(name=columns[0][x], **{f"g{j}": c[x] for j, c in enumerate(columns[1:])}, **{c: _small(v[x]) for c, v in sums.items()})


def _unfolded(payloads: list[bytes]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """(words' hashes of all n-grams by place, their sums) of several payloads."""
    e = B.gathered(payloads)
    if not e:
        return [], {}
    columns = [e.pop("name")]
    while f"g{len(columns) - 1}" in e:
        columns.append(e.pop(f"g{len(columns) - 1}"))
    return columns, e


class _Route(B.Route):
    """N-grams go by their hash, counts of counts to the first bucket."""

    def __init__(self, n: int):
        self.n = n

    def gather(self, kind: int, payloads: list[bytes]):
        return sum(B.unpack(p)["of"] for p in payloads) if kind else _unfolded(payloads)

    def buckets(self, kind: int, e) -> np.ndarray:
        return np.zeros(1, np.int64) if kind else B.ranged(gram_names(e[0]), self.n)

    def pack(self, kind: int, e, x: np.ndarray) -> bytes:
        return B.pack(1, of=e) if kind else _folded(e[0], x, **e[1])


def _blocks(order: int, n: int, step: int):
    """A block's distinct n-grams; blocks and buckets are smaller for higher orders, of which there are more."""

    def run(batches):
        for batch in B.blocks(batches, limit=max(1, 24 >> order) * B.BLOCK_BYTES):
            t = Tokens(B.raw(batch), order)
            rows, _, count = t.grams(t.back[::-1])
            if not len(rows):
                continue
            columns = [t.vocabulary[rows[:, j]] for j in range(order)]
            del rows, t
            yield B.packed([(b, _folded(columns, x, count=count)) for b, x in B.by_bucket(B.ranged(gram_names(columns), n) // step)])

    return run


def _save(folder: str, level: int, shard: int, **columns: np.ndarray) -> None:
    """One file: a line that says what follows, then the arrays, keys first."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{level}-{shard:06d}"
    own = f"{path}.{uuid.uuid4().hex}"
    kinds = {c: _small(x) if c != "key" else x for c, x in columns.items()}
    head = json.dumps({"n": len(columns["key"]), "kinds": {c: x.dtype.str for c, x in kinds.items()}}).encode()
    with open(own, "wb") as f:
        f.write(head.ljust(-(-(len(head) + 1) // 8) * 8 - 1) + b"\n")
        for x in kinds.values():
            f.write(x.tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0"))
    os.replace(own, path)


def _mapped(path: str) -> dict[str, np.ndarray]:
    held = np.memmap(path, np.uint8, "r")
    line = held[:4096].tobytes().split(b"\n", 1)[0]
    head, at, out = json.loads(line), len(line) + 1, {}
    for c, kind in head["kinds"].items():
        size = head["n"] * np.dtype(kind).itemsize
        out[c] = held[at : at + size].view(kind)
        at += -(-size // 8) * 8
    return out


def _shards(folder: str, level: int, order: int, n: int, step: int):
    """Add up a bucket's n-grams of one order, write its shard, send sums for the order below on; counts of counts go along."""

    def run(batches):
        payloads = [p for batch in batches for p in B.column(batch, "payload").to_pylist()]
        shard = [p for p in payloads if p[0] == 0]
        passed = np.zeros((order + 1, 4), np.int64)
        for p in payloads:
            if p[0] == 1:
                passed += B.unpack(p)["of"].reshape(passed.shape)
        del payloads
        columns, e = _unfolded(shard)
        del shard
        if columns:
            key = gram_names(columns)
            by = np.argsort(key, kind="stable")
            key = key[by]
            head = B.groups(key)
            key = key[head]
            first = by[head]
            sums = {c: np.add.reduceat(e[c][by].astype(np.int64), head) for c in list(e)}
            columns = [c[first] for c in columns]
            del e, by, first, head
            if level == order:
                adj = raw = sums["count"]
                _save(folder, level, int(B.ranged(key[:1], n)[0]), key=key, adj=adj)
            else:
                raw = sums["raw"]
                adj = np.where(columns[0] == _START, raw, sums["adj"]) if level > 1 else sums["adj"]
                sums["adj"] = adj
                _save(folder, level, int(B.ranged(key[:1], n)[0]), key=key, **sums)
            passed[level] += [int((adj == i).sum()) for i in range(1, 5)]
            if level > 1:
                yield from _below(columns, adj, raw, n, step)
            else:
                passed[0] += [int(sums["raw"].sum()), int((sums["raw"] > 0).sum()), int(adj.sum()), 0]
        if passed.any():
            yield B.packed([(0, B.pack(1, of=passed.ravel()))])

    return run


def _below(columns: list[np.ndarray], adj: np.ndarray, raw: np.ndarray, n: int, step: int):
    """What n-grams say of those of one order less: of the one they end in, and of the one they begin with, their context."""
    live = np.flatnonzero(adj > 0)
    columns, adj, raw = [c[live] for c in columns], adj[live], raw[live]
    if not len(live):
        return
    key, first, of = np.unique(np.concatenate([gram_names(columns[1:]), gram_names(columns[:-1])]), return_index=True, return_inverse=True)
    m, k = len(key), len(live)
    suffix, prefix = of[:k].astype(np.int32), of[k:].astype(np.int32)
    del of
    grams = [np.where(first < k, columns[j + 1][first % k], columns[j][first % k]) for j in range(len(columns) - 1)]
    del columns
    sums = {"adj": np.bincount(suffix, None, m), "raw": np.bincount(suffix, raw, m), "ctx": np.bincount(prefix, adj, m)}
    sums |= {f"n{i}": np.bincount(prefix, (adj == i) if i < 3 else (adj > 2), m) for i in (1, 2, 3)}
    sums = {c: x.astype(np.int64) for c, x in sums.items()}
    for b, x in B.by_bucket(B.ranged(key, n) // step):
        yield B.packed([(b, _folded(grams, x, **sums))])


def _totals(fn):
    """The last level's counts of counts alone, as rows: one Python worker a task, not one for each of two steps."""

    def run(batches):
        for batch in fn(batches):
            for p in B.column(batch, "payload").to_pylist():
                if p[0] == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([B.unpack(p)["of"].tolist()], pa.list_(pa.int64()))], names=["of"])

    return run


def discounts(n: list[int]) -> list[float]:
    """The three discounts from how many have counts 1 to 4; plain fallbacks where a count is missing."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else y * k
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def train(texts: DataFrame, order: int = 3, fan: int = B.FAN) -> dict:
    """Count a model over the ``text`` column; its place and totals."""
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark = texts.sparkSession
    B.bounded_batches(spark)
    folder = f"{_folder(B.shared_folder(spark))}/factorloom/model-{uuid.uuid4().hex}"
    B.keep(spark, f"file://{folder}")
    n = B.bucket_count(texts, share=B.BUCKET_BYTES * 4 >> order)
    step = B.first_step(n, fan)
    held = texts.select(F.col("text").cast("string")).mapInArrow(B.tidied(_blocks(order, n, step)), B.PACKED)
    for level in range(order, 0, -1):
        fn, schema = _shards(folder, level, order, n, step), B.PACKED
        if level == 1:
            fn, schema = _totals(fn), "of array<long>"
        held = B.exchange(held, n, fn, schema, _Route(n), fan)
    got = held.agg(*[F.sum(F.col("of")[i]) for i in range(4 * (order + 1))]).first()
    got = np.array([x or 0 for x in got]).reshape(order + 1, 4).tolist()
    B.release(spark)
    tokens, vocabulary, types, _ = got[0]
    return {"folder": folder, "order": order, "shards": n, "tokens": tokens, "vocabulary": vocabulary, "types": types, "d": [[0.0, *discounts(x)] for x in got], "word_counts": got[1]}


class Model:
    """A model as a worker sees it."""

    def __init__(self, meta: dict):
        self.meta, self.held = meta, OrderedDict()

    def shard(self, level: int, number: int) -> dict[str, np.ndarray] | None:
        at = (level, number)
        if at not in self.held:
            path = f"{self.meta['folder']}/{level}-{number:06d}"
            self.held[at] = _mapped(path) if os.path.exists(path) else None
            if len(self.held) > MAPPED:
                self.held.popitem(last=False)
        self.held.move_to_end(at)
        return self.held[at]

    def lookup(self, level: int, query: np.ndarray, names) -> dict[str, np.ndarray]:
        """Values of distinct hashes, 0 where unknown."""
        by = np.argsort(query)
        asked = query[by]
        out = {c: np.zeros(len(query), np.int64) for c in names}
        ends = np.searchsorted(B.ranged(asked, self.meta["shards"]), np.arange(self.meta["shards"] + 1))
        for number in np.flatnonzero(np.diff(ends)):
            held = self.shard(level, int(number))
            if held is None:
                continue
            x = slice(ends[number], ends[number + 1])
            keys = held["key"]
            at = np.minimum(np.searchsorted(keys, asked[x]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == asked[x])
            to = by[x][hit]
            for c in names:
                out[c][to] = held[c][at[hit]]
        return out

    def log10(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token."""
        m, order = self.meta, self.meta["order"]
        if not m["types"] or not len(t.at):
            return np.zeros(len(t.at)), np.zeros(len(t.at), np.int64)
        # Distinct n-grams of each order: those that end in a token, and below the highest also the contexts.
        known = self.lookup(1, t.vocabulary, _SUMS)
        d = np.array(m["d"][1])
        one, two = m["word_counts"][:2]
        left = (d[1] * one + d[2] * two + d[3] * (m["vocabulary"] - one - two)) / m["types"]
        cont = known["adj"][t.at]
        p = np.maximum(cont - d[np.minimum(cont, 3)], 0) / m["types"] + left / (m["vocabulary"] + 1)
        context = {c: known[c][t.back[1]] for c in _SUMS}
        for level in range(2, order + 1):
            rows, of, _ = t.grams(t.back[level - 1 :: -1])
            names = gram_names([t.vocabulary[rows[:, j]] for j in range(level)])
            a = self.lookup(level, names, ("adj",))["adj"][of]
            d = np.array(m["d"][level])
            ctx = context["ctx"].astype(float)
            rest = d[1] * context["n1"] + d[2] * context["n2"] + d[3] * context["n3"]
            p = np.where(ctx > 0, (np.maximum(a - d[np.minimum(a, 3)], 0) + rest * p) / np.maximum(ctx, 1), p)
            if level < order:
                rows, of, _ = t.grams(t.back[level:0:-1])
                context = self.lookup(level, gram_names([t.vocabulary[rows[:, j]] for j in range(level)]), _SUMS[2:])
                context = {c: x[of] for c, x in context.items()}
        return np.log10(p), known["raw"][t.at]


_models: dict[str, Model] = {}


def model(meta: dict) -> Model:
    key = json.dumps(meta, sort_keys=True)
    if key not in _models:
        _models.clear()
        _models[key] = Model(meta)
    return _models[key]


def _score(meta: dict):
    def run(batches):
        held = model(meta)
        for batch in B.blocks(batches):
            t = Tokens(B.raw(batch), meta["order"])
            p, c = held.log10(t)
            rows, doc = len(t.words.n), t.words.doc
            base = np.log10((c + 0.5) / (meta["tokens"] + 0.5 * (meta["vocabulary"] + 1))) if len(c) else p
            sums = [np.bincount(doc, x, rows) for x in (c > 0, base, p)]
            yield pa.RecordBatch.from_arrays(
                [B.column(batch, "row"), pa.array(t.words.n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(rows, meta["tokens"], np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["row", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(rows: DataFrame, meta: dict) -> DataFrame:
    """``row`` (kept) of a table (row, text) with token counts and the log10 probabilities of its text."""
    B.bounded_batches(rows.sparkSession)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(B.tidied(_score(meta)), f"row {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame, held_out, order: int = 3) -> DataFrame:
    """``row`` with ``held_out``, token counts, ``base_score`` and ``score``.

    ``held_out`` is a condition over ``row``'s fields; the model learns from the
    rows that don't meet it.  Defined results: a null text is empty and has its
    end alone; a null id is scored like any other and never held out (its
    condition is null); rows are scored one by one, so repeated rows agree; with
    nothing to learn from, ``score`` is 0; very long texts are scored whole; an
    empty table gives an empty result; further columns stay inside ``row``, so
    their names may clash.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    out = F.coalesce(held_out, F.lit(False))
    meta = train(rows.filter(~out).select("text"), order)
    return score(rows, meta).withColumn("held_out", out)
