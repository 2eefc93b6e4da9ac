"""Dealing in steps, and what operators leave behind."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import blocks as B
from factorloom.llm import jaccard_join, substring_dedup


def docs(spark, n=300):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    texts = [say(rnd.randint(3, 60)) for _ in range(n)]
    for i in range(0, n, 3):
        w = texts[i].split()
        w[rnd.randrange(len(w))] = "odd"
        texts[(i * 7 + 1) % n] = " ".join(w)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_any_number_of_steps_gives_the_same(spark, monkeypatch):
    table = docs(spark).persist()
    want = Counter(map(tuple, jaccard_join.jaccard_components(table).collect()))
    assert len({c for _, _, c in want}) < 300
    monkeypatch.setattr(B, "bucket_count", lambda *a, **b: 30)
    for fan in (3, 6, 100):
        assert Counter(map(tuple, jaccard_join.jaccard_components(table, fan=fan).collect())) == want


def test_dedup_in_any_number_of_steps(spark, monkeypatch):
    table = docs(spark).persist()
    held = lambda **o: Counter(map(tuple, substring_dedup.repeats(table, 5, **o).collect()))
    want = held()
    assert len(want) > 20
    monkeypatch.setattr(B, "bucket_count", lambda *a, **b: 30)
    assert held(fan=3) == want and held(fan=6) == want


@pytest.mark.parametrize("copies", [200, 400, 800])
def test_a_shared_passage_costs_entries_by_block(spark, copies):
    """All documents hold one passage; the hottest anchor and window have one entry a block."""
    rnd = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'w{rnd.randrange(10**6)}' for _ in range(20))} {passage}", i) for i in range(copies)]
    held = spark.createDataFrame(rows, "doc_id long, text string, text_key long").coalesce(1)

    def hottest(sent, key):
        open_ = B.of_kinds([r for r in [sent]], 3)[0]
        e = B.gathered(open_)
        return max(Counter(e[key].tolist()).values())

    batch = held.toArrow().combine_chunks().to_batches()[0]
    monkey = substring_dedup.TaskContext
    try:
        substring_dedup.TaskContext = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())})
        first = next(substring_dedup._anchor_blocks(13, 3, 4, 512)([batch]))
        told = B.gathered(B.of_kinds([first], 3)[0])
        assert hottest(first, "name") == 1
        again = batch.append_column("data", __import__("pyarrow").array([told["name"].tobytes()] * copies))
        second = next(substring_dedup._window_blocks(13, 3, 4, 512)([again]))
        assert hottest(second, "name") == 1
    finally:
        substring_dedup.TaskContext = monkey


def test_steps():
    assert B.first_step(B.FAN) == 1 and B.first_step(B.FAN + 1) == B.FAN and B.first_step(12_000_000) == B.FAN
    assert [B.first_step(30, f) for f in (3, 6, 100)] == [27, 6, 1]
    h = B.mix(np.arange(1000, dtype=np.uint64))
    for n in (1, 2, 1800):
        b = B.ranged(h, n)
        assert b.min() >= 0 and b.max() < n and (np.diff(b[np.argsort(h)]) >= 0).all()


def test_sent_bytes_do_not_grow_with_the_buckets():
    """The incidence of three megabytes of text, dealt to 2 to 1800 buckets, and to more in steps."""
    rnd = np.random.default_rng(1)
    name, row = np.sort(B.mix(rnd.integers(0, 1 << 62, 450_000).astype(np.uint64))), rnd.integers(0, 1500, 450_000).astype(np.uint16)
    blk = np.full(len(name), 77, np.uint64)
    sent = {}
    for n in (2, 33, 256, 1800, 6000):
        out = jaccard_join._dealt(0, B.ranged(name, n) // B.first_step(n), name=name, row=row, blk=blk)
        assert len(out) <= B.FAN
        sent[n] = sum(len(p) for _, p in out)
    assert max(sent.values()) < 1.15 * min(sent.values()), sent


def test_nothing_is_left_after_cleanup(spark):
    folder = B.shared_folder(spark).removeprefix("file://") + "/factorloom"
    B.cleanup()
    got = jaccard_join.jaccard_components(docs(spark, 60))
    while_used = len(os.listdir(folder))
    assert got.count() == 60 and while_used <= 3
    B.cleanup()
    assert os.listdir(folder) == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Far()
        conf = {}

    with pytest.raises(ValueError):
        B.shared_folder(Session())
