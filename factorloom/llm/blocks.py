"""Shared plumbing: word blocks, hashed symbols, packed exchanges, shared folder.

Arrow batches of documents are cut into blocks of bounded text size, so a
Python worker never holds more than one block of word objects.  What blocks
tell each other travels as *packed rows*: ``(bucket INT, payload BINARY)``
where a payload is a compressed dictionary of NumPy arrays.  A bucket is
dealt to one task by :func:`exchange`; packing thousands of entries in one
row keeps the shuffle near the entropy of its keys, and each block sums,
counts or deduplicates its entries first, so a hot key costs one entry a
block, not one a row.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship

#: Words are what lies between these bytes; ``bytes.split()`` splits at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes of one block of words in a Python worker.
BLOCK_BYTES = 2 << 20
#: Input text bytes that one bucket of a packed exchange stands for.
BUCKET_BYTES = 8 << 20
#: Drops an execution's shuffle files when it ends; what it has written outlives them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Payloads that a block or a task deals at most in one step.
FAN = 4096
#: Bytes of payloads that a task gathers before it deals them on.
REGROUP_BYTES = 4 << 20
PACKED = "bucket int, payload binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def join2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """The name of the ordered pair (a, b)."""
    return mix(a * _M1 + mix(b + np.uint64(salt)))


def hash_words(words: list[bytes], key: str = "0123456789123456") -> np.ndarray:
    """64-bit SipHash of each word, the same on every machine."""
    if not words:
        return np.zeros(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, hash_key=key, categorize=False)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    length = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    length = np.nan_to_num(np.asarray(pc.binary_length(length).to_numpy(zero_copy_only=False), dtype=float))
    block = (np.cumsum(length) - length) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of all batches; small neighbours are put together up to ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        for piece in slices(batch, text, limit):
            n = piece.nbytes
            if held and size + n > limit:
                yield _merged(held)
                held, size = [], 0
            held.append(piece)
            size += n
    if held:
        yield _merged(held)


def _merged(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column(batch, name).cast(pa.binary()).to_pylist()]


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """Word hashes of a block: ``h`` flat, ``doc`` the row of each word, ``start`` the offsets by row."""

    def __init__(self, texts: list[bytes], lower: bool = False, end: bytes | None = None):
        # The words themselves are not kept: their objects weigh many times their text.
        lists = [x.lower().split() if lower else x.split() for x in texts]
        if end is not None:
            for x in lists:
                x.append(end)
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.start = np.r_[0, np.cumsum(self.n)]
        self.h = hash_words([w for x in lists for w in x])
        self.doc = np.repeat(np.arange(len(lists)), self.n)

    def windows(self, size: int) -> np.ndarray:
        """Start positions of the windows of ``size`` words that lie in one row."""
        m = len(self.h) - size + 1
        return np.flatnonzero(self.doc[:m] == self.doc[size - 1 :]) if m > 0 else np.zeros(0, np.int64)


def window_names(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Names of all windows of ``size`` symbols, put together from windows of powers of two."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out, at, power, level = None, 0, 1, mix(h + np.uint64(salt))
    while True:
        if size & power:
            part = level[at : at + len(h) - size + 1]
            out = part if out is None else join2(out, part, salt)
            at += power
        power *= 2
        if power > size:
            return out
        half = power // 2
        level = join2(level[: len(level) - half], level[half:], salt)


def pack(_kind: int = 0, **arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integer bytes are transposed so that their leading zeros meet.

    Its first byte is the payload's kind.

    ``name`` is kept as the steps between its values, which are small where it is sorted.
    """
    head, body = [], []
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        if k == "name":  # sorted hashes: keep the steps between them
            a = np.diff(a, prepend=a.dtype.type(0))
        head.append(f"{k}{a.dtype.str}{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return bytes([_kind]) + zstandard.ZstdCompressor(level=1).compress(b"".join([",".join(head).encode(), b"\n", *body]))


def unpack(payload: bytes) -> dict[str, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(memoryview(payload)[1:])
    at = data.index(b"\n") + 1
    out = {}
    for k, kind, n in re.findall(r"(\w+)([<>|]\w\d)(\d+)", data[: at - 1].decode()):
        d, n = np.dtype(kind), int(n)
        held = np.frombuffer(data, np.uint8, n * d.itemsize, at).reshape(d.itemsize, n)
        out[k] = np.ascontiguousarray(held.T).reshape(-1).view(d) if n else np.zeros(0, d)
        if k == "name":
            out[k] = np.cumsum(out[k], dtype=d)
        at += n * d.itemsize
    return out


def packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], schema=PACKED_ARROW)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    ends = np.r_[groups(held), len(held)] if len(held) else [0]
    for a, b in zip(ends[:-1], ends[1:]):
        yield int(held[a]), order[a:b]


def groups(*keys: np.ndarray) -> np.ndarray:
    """Start offsets of the groups of equal keys in arrays sorted by them."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def gathered(payloads) -> dict[str, np.ndarray]:
    """Payloads as one dictionary of long arrays; those of ``batches`` if given Arrow batches."""
    parts = [unpack(p) for x in payloads for p in (column(x, "payload").to_pylist() if isinstance(x, pa.RecordBatch) else [x])]
    # Each column's pieces are freed as soon as they are put together.
    return {k: np.concatenate([p.pop(k) for p in parts]) for k in list(parts[0])} if parts else {}


def of_kinds(batches, n: int = 2) -> list[list[bytes]]:
    """The payloads of Arrow batches by their kind."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    for batch in batches:
        for p in column(batch, "payload").to_pylist():
            out[p[0]].append(p)
    return out


def tidied(fn: Callable) -> Callable:
    """``fn`` of a ``mapInArrow``, after which its worker, which Spark keeps, gives freed memory back to the system."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def ranged(name: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, by its size: a bucket's sorted hashes are as close together as all are, whatever ``n`` is."""
    return ((name >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def first_step(n: int, fan: int = FAN) -> int:
    """How many neighbouring buckets are dealt as one in the first step of an exchange of ``n`` buckets."""
    step = 1
    while -(-n // step) > fan:
        step *= fan
    return step


class Route:
    """How payloads on their way through the steps of an exchange are put together and dealt on."""

    def gather(self, kind: int, payloads: list[bytes]):
        return gathered(payloads)

    def buckets(self, kind: int, e) -> np.ndarray:
        """The bucket of each entry."""
        raise NotImplementedError

    def pack(self, kind: int, e, x: np.ndarray) -> bytes:
        """The entries at ``x`` as a payload."""
        return pack(kind, **{k: v[x] for k, v in e.items()})


def _regroup(route: Route, step: int):
    """Payloads of several senders as fewer and larger ones, each for ``step`` buckets."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        size = 0

        def flush():
            for kind, payloads in held.items():
                e = route.gather(kind, payloads)
                for b, x in by_bucket(route.buckets(kind, e) // step):
                    yield packed([(b, route.pack(kind, e, x))])

        for batch in batches:
            for p in column(batch, "payload").to_pylist():
                held.setdefault(p[0], []).append(p)
                size += len(p)
                if size > REGROUP_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run


def exchange(df: DataFrame, n: int, fn: Callable, schema: str, route: Route | None = None, fan: int = FAN) -> DataFrame:
    """Deal packed rows to their buckets' tasks, then run ``fn`` (``mapInArrow``) there.

    With ``route`` the rows of ``df`` carry ``bucket // first_step(n)``: a block
    then deals ``fan`` payloads at most however many buckets there are, and steps
    between put payloads together and deal them on.  Payloads thus grow in number with the input, not its square.
    """
    step = first_step(n, fan) if route else 1
    while step > 1:
        # A coarse bucket's payloads are shared out to tasks, each of which deals about eight buckets' worth.
        coarse, salts = -(-n // step), max(1, step // 8)
        step //= fan
        df = df.repartition(coarse * salts, "bucket", F.pmod(F.crc32("payload"), F.lit(salts))).mapInArrow(tidied(_regroup(route, step)), PACKED)
    return df.repartitionById(n, F.col("bucket")).mapInArrow(tidied(fn), schema)


def bucket_count(df: DataFrame, text: str = "text", share: int = BUCKET_BYTES) -> int:
    """Buckets for a table, from its measured text bytes: a bucket's load stays the same at every size."""
    total = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return max(2, int(total // share) + 1)


def bounded_batches(spark: SparkSession, rows: int = 250) -> None:
    """Send the code to the workers and keep Arrow batches small enough for long texts; the setting lasts for the session."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/factorloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables of this session that are still there.
_left: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _left.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "_written", None) in _left:
            delete(t.sparkSession, t._written)


def cleanup() -> None:
    """Delete every table that is left; results that read them are no longer usable.  Runs when Python ends, too."""
    for path, spark in list(_left.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended and with it the way to its file system
            _left.pop(path, None)


atexit.register(cleanup)


def left() -> set[str]:
    """The folders that :func:`cleanup` would delete."""
    return set(_left)


def drop(paths: set[str]) -> None:
    """Delete those of the folders that are left."""
    for path in paths & set(_left):
        delete(_left[path], path)


def keep(spark: SparkSession, path: str) -> str:
    """Note a folder for :func:`cleanup`."""
    _left[path] = spark
    return path


_STEADY = {"Project", "Filter", "LocalRelation", "Range", "SubqueryAlias", "Relation", "LogicalRelation"}


def steady(df: DataFrame) -> DataFrame:
    """``df`` if its tasks read the same rows in the same order whenever they run again, else a written copy.

    Rows that are named by their place in a block need that; it holds for what is
    read from files and not for what comes out of a shuffle.
    """
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split(" ")[0] not in _STEADY:
            return written(df, "input")
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


def written(df: DataFrame, name: str, coalesce: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    release(spark)  # what earlier steps have left: their frames are gone only now
    path = keep(spark, f"{shared_folder(spark)}/factorloom/{name}-{uuid.uuid4().hex}")
    schema = df.schema
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.coalesce(coalesce) if coalesce else df).write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
