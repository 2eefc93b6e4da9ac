"""The pipeline's stages take effect, each on what the one before has kept, and equal their plain versions."""

import random
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402
from factorloom.llm import blocks as B  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = [plain.quality, plain.near_duplicates, plain.substrings, plain.mixture]


def tables():
    """Rows of documents and labels: good and noisy texts, near copies, shared passages, nulls, repeats, a long text."""
    rnd = random.Random(11)
    vocab = {"en": [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)], "fr": [f"v{i}" for i in range(60)]}
    say = lambda n, lang="en": " ".join(rnd.choice(vocab[lang]) for _ in range(n))
    passage, base = say(60), say(120)
    texts = [(i, say(rnd.randint(20, 80)), "en") for i in range(260)]
    texts += [(300 + i, say(rnd.randint(20, 80), "fr"), "fr") for i in range(60)]
    texts += [(400 + i, f"{say(20)}\n{passage} {say(15)}", "en") for i in range(9)]
    for i in range(8):
        w = base.split()
        for _ in range(i % 4):
            w[rnd.randrange(120)] = "w1"
        texts.append((420 + i, " ".join(w), "en"))
    texts += [(440 + i, " ".join(f"{rnd.random()}%%" for _ in range(40)), "en") for i in range(12)]
    texts += [(500, "", "en"), (501, None, "fr"), (502, "w1 w2", None), (503, say(6000), "en"), (504, passage, "en"), (None, passage, "en"), (None, None, None), (505, "w1 w2 ! w3", "de")]
    docs = [(i, t, lang, [None, "b", "a", "c", "a", "a"][n % 6], None if t is None else len(t)) for n, (i, t, lang) in enumerate(texts)]
    labels = [(i, 1, 0) for i in [*range(230), *range(300, 350)]] + [(440, 0, 0), (None, 1, 0), (3, 1, 0), (9999, 1, None)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, (docs, labels) = str(tmp_path_factory.mktemp("tables")), tables()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_stage_equals_its_plain_version(spark, folder):
    """Each stage on what the one before has kept, then the pieces of run()."""
    docs, labels = tables()
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES[:-1], PLAIN, strict=True):
        before, docs = len(docs), by_hand(docs, labels)
        assert len(docs) != before and docs, name
        held = stage(spark, held, folder).cache()
        assert Counter(map(tuple, held.collect())) == Counter(docs), name
    want = plain.pieces(docs, BPE)
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) == plain.sequences([r.length for r in got])


def test_one_row_of_a_group_stays_where_ids_repeat(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    near = text("a").replace("a39", "z")
    docs = [(1, text("a"), "x"), (1, text("a"), "x"), (1, near, "y"), (2, text("b"), "x"), (3, text("b"), "x"), (3, text("c"), "x"), (4, text("d"), "x"), (None, text("d"), "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, table, SF)
    assert got.columns == table.columns
    got = [tuple(r) for r in got.collect()]
    assert sum(r[0] == 1 for r in got) == 1
    assert Counter(r for r in got if r[0] != 1) == Counter([docs[3], docs[5], docs[6], docs[7]])


def test_stages_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    kept, unique, cut, mixed = counts[1:]
    assert 0.7 * counts[0] < kept < counts[0] and cut <= unique <= kept and mixed > 0
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, path, docs, schema, labels):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path, [], DOCS, [])
    held = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, folder)
        assert out.columns == held.columns and out.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_only_empty_texts_go_without_labels(spark, tmp_path):
    docs = [(1, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, None, None, None, None), (4, " ".join(f"w{i}" for i in range(40_000)), "en", None, 1)]
    folder = _tables(spark, tmp_path, docs, DOCS, [])
    held = corpus_pipeline.quality(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert sorted(map(tuple, held.collect())) == [docs[0], docs[3]]
    # A text much longer than a sequence lies in several, and every id once in each copy.
    got = [r for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id == 4]
    assert len(got) > 20 and sum(r.length for r in got) % got[0].doc_tokens == 0


def test_clashing_columns_go_along(spark, tmp_path):
    """Names that the stages use themselves."""
    extra = ["row", "data", "text_key", "size", "draw", "es_weight", "es_key", "target", "copies", "good_id", "own", "kept", "score", "at", "node", "label", "bucket", "shard", "copy"]
    rnd = random.Random(5)
    say = lambda n: " ".join(f"w{rnd.randrange(50)}" for _ in range(n))
    passage = say(40)
    docs = [(i, f"{say(30)} {passage}" if i % 3 == 0 else say(60), "en", "ab"[i % 2], 1, *[f"{c}{i}" for c in extra]) for i in range(30)]
    docs += [(30, docs[1][1], *docs[1][2:]), (31, docs[4][1] + " w1", "en", "a", 1, *[f"{c}31" for c in extra])]
    folder = _tables(spark, tmp_path, docs, DOCS + "".join(f", {c} string" for c in extra), [(i, 1, 0) for i in range(20)])
    held, by_id = spark.read.parquet(f"{folder}/documents.parquet"), {d[0]: d for d in docs}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, folder).cache()
        assert out.columns == held.columns and out.count() > 0
        assert all(tuple(r)[5:] == by_id[r.doc_id][5:] for r in out.collect())
        held = out
    assert corpus_pipeline.packed(spark, held, folder).count() >= held.count()


def test_stages_leave_nothing_but_the_last(spark, folder):
    B.cleanup()
    got = corpus_pipeline.run(spark, folder)
    names = sorted(p.rsplit("/", 1)[1].split("-")[0] for p in B.left())
    assert names == ["pieces", "stage3"], names
    assert got.count() > 0
    B.cleanup()
    assert not B.left()
