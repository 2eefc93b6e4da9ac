"""Packing of token sequences by best-fit decreasing.

Documents are tokenised where they are read; only piece lengths travel.  Each
document is cut into full windows and one remainder.  Full windows fill a
sequence each; remainders are dealt to shards of a measured size and packed
there, longest first, each into the open window with the least room that still
holds it.  A segment tree over remaining capacities finds that window in
log2(window) steps.  Shards of ``SHARD`` remainders keep padding as low as one
global run would, while no task's work grows with the corpus.  Remainders are
dealt to shards by their place in the written table, so equal ones spread too;
full windows aren't dealt at all.  Remainders' sequences are numbered from 0,
full windows' from 2^62.

Defined results: a null or empty text has the end token alone; rows that repeat
a ``doc_id`` (or have none) are packed row by row; ties are broken by id, then
row; very long texts are tokenised whole and cut; an empty table gives an empty
result; further columns are ignored, so their names may clash.
"""

from __future__ import annotations

import array
import json
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Remainders that one packing task takes.
SHARD = 50_000
#: The first number of a full window's sequence.
FULL = 1 << 62
#: Words whose token ids a worker remembers.
REMEMBERED = 300_000
#: White space other than the single spaces and line feeds that a text is cut at; the last is U+3000.
_OTHER_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
_OTHER_ASCII = [c for c in _OTHER_SPACE if c.isascii()]
_DOUBLE = ["  ", " \n", "\n ", "\n\n"]

#: Fixed value: the public byte-level BPE's splitting pattern.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


class WordEncoder:
    """Token ids of whole texts through a memory of words.

    The tokenizer's pattern never joins a character to the white space behind
    it, so a text whose white space is single spaces and line feeds falls into
    units of one white-space character and a word.  Each unit's ids are looked
    up, or made once by the tokenizer.  Other texts go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.specials = [s for s in specials if s]
        self.quick = _ranked(path, self.whole)
        # tiktoken has no public method that takes one piece.
        self.piece = getattr(getattr(self.quick, "_core_bpe", None), "encode_single_piece", None)
        self.after_space, self.after_line = _Memory(self.spaced), _Memory(lambda word: self.fresh("\n" + word))

    def fresh(self, unit: str) -> bytes:
        if self.quick is not None and not any(s in unit for s in self.specials):
            return _ids(self.quick.encode_ordinary(unit))
        return _ids(self.whole.encode(unit, add_special_tokens=False).ids)

    def spaced(self, word: str) -> bytes:
        """The ids of a space and a word; one of letters alone is one piece of the pattern (those up to U+052F are letters in every library)."""
        if self.piece is not None and word.isalpha() and max(word) < "\u0530" and not any(s in f" {word}" for s in self.specials):
            return _ids(self.piece(f" {word}".encode()))
        return self.fresh(" " + word)

    def odd(self, text: str) -> bool:
        """Whether a text has more white space than single spaces and line feeds with a word behind each, or a special token."""
        found = self.specials + _DOUBLE + (_OTHER_ASCII if text.isascii() else _OTHER_SPACE)
        return text.endswith((" ", "\n")) or any(x in text for x in found)

    def __call__(self, text: str) -> bytes:
        if self.odd(text):
            return self.fresh(text)
        out, space, line = [], self.after_space, self.after_line
        for i, part in enumerate(text.split("\n")):
            words = part.split(" ")
            out.append(line[words[0]] if i else self.fresh(words[0]))
            out += [space[w] for w in words[1:]]
        return b"".join(out)


def _ranked(path: str, whole):
    """A faster encoder with the same ids, or None unless the file is a byte-level BPE whose ids follow its merges."""
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, before = held["model"], held.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab"), model.get("merges") or []
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or held.get("normalizer") or model.get("ignore_merges"):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    # Byte-level files write each byte as a printable character: itself if printable, else one from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = set(whole.get_added_tokens_decoder())
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if i not in added}
    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    held = array.array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class _Memory(dict):
    def __init__(self, fresh):
        self.fresh = fresh

    def __missing__(self, word: str) -> bytes:
        ids = self.fresh(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = ids
        return ids


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class OpenWindows:
    """Open windows by remaining capacity, in a segment tree that holds whether a capacity has any."""

    def __init__(self, size: int):
        self.size, self.leaves = size, 1 << size.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece: the tightest open window, or a new one."""
        tree, i = self.tree, length + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):  # up, until a right neighbour has some
                i >>= 1
            i = i + 1 if i > 1 else 0
            while i and i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        if i:
            room = i - self.leaves
            window = self.at[room].pop()
            if not self.at[room]:
                self._mark(room)
        else:
            room, window = self.size, self.made
            self.made += 1
        left = room - length
        if left:
            self.at[left].append(window)
            if len(self.at[left]) == 1:
                self._mark(left)
        return window, self.size - room

    def _mark(self, room: int) -> None:
        i, tree = room + self.leaves, self.tree
        tree[i] = bool(self.at[room])
        i >>= 1
        while i:
            tree[i] = tree[2 * i] | tree[2 * i + 1]
            i >>= 1


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of pieces given longest first."""
    open_ = OpenWindows(size)
    out = [open_.put(x) for x in lengths.tolist()]
    return (np.array([x for x, _ in out], np.int64), np.array([x for _, x in out], np.int64)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pieces(path: str, end: int, size: int):
    def run(batches):
        tokens = encoder(path)
        for batch in B.blocks(batches):
            out: list[tuple] = []
            for row, (doc, text) in enumerate(zip(B.column(batch, "doc_id").to_pylist(), B.column(batch, "text").to_pylist())):
                ids = tokens(text or "") + np.array([end], "<u4").tobytes()
                n = len(ids) // 4
                out += [(doc, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * min(n, a + size)]), n) for a in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _packer(size: int, shards: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("shard", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        shard = table["shard"].to_numpy()
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            part = table.slice(a, b - a)
            window, offset = best_fit(part["length"].to_numpy(), size)
            part = part.drop_columns(["shard"]).append_column("sequence_id", pa.array(window * shards + s)).append_column("offset", pa.array(offset))
            yield from part.to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_token: int = 1, size: int = 2048, shard: int = SHARD) -> DataFrame:
    """One row for each piece: its place in its document and in its sequence.

    ``tokenizer`` is the path of a ``tokenizers`` file that every worker can open.
    """
    spark = docs.sparkSession
    B.bounded_batches(spark)
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(B.tidied(_pieces(tokenizer, end_token, size)), _PIECES)
    pieces = B.written(pieces, "pieces")
    shards = int(pieces.filter(F.col("length") < size).count() // shard) + 1
    # The same in every read of a written table.
    placed = pieces.withColumn("at", F.monotonically_increasing_id())
    full = placed.filter(F.col("length") == size).withColumn("sequence_id", F.lit(FULL) + F.col("at")).withColumn("offset", F.lit(0).cast("long")).drop("at")
    dealt = placed.filter(F.col("length") < size).withColumn("shard", F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int")).drop("at")
    packed = dealt.repartitionById(shards, F.col("shard")).mapInArrow(B.tidied(_packer(size, shards)), _PIECES + ", sequence_id long, offset long")
    return packed.unionByName(full)
