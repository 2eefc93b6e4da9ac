"""Operators against brute force on small tables full of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factorloom.llm import jaccard_join, kneser_ney, mixing, nearest, packing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from factorloom.llm import blocks as B

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, bucket string, data string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows():
    rnd = random.Random(5)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, base = say(60), say(120)
    out = [(i, say(rnd.randint(1, 200))) for i in range(40)]
    out += [(100 + i, f"{say(20)}\n{passage} {say(15)}") for i in range(12)]
    for i in range(14):
        words = base.split()
        for _ in range(i % 5):
            words[rnd.randrange(120)] = "x%%%"
        out.append((200 + i, " ".join(words)))
    out += [(300, ""), (301, None), (302, "a b c"), (303, "A  b\tc"), (304, " \n "), (305, "ha " * 400), (306, "ha " * 300 + say(30)), (307, say(30000)), (None, passage), (None, None), (5, out[5][1]), (308, "日本 x🙂\xa0y  z \x1c q")]
    lines = say(12)
    out.append((309, "\n".join([lines] * 4 + [say(10)] * 2)))
    return [(i, t, ["en", "fr", None][n % 3], [None, "b", "a", "c"][n % 4], 7, "odd", "x") for n, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(1)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_words_are_those_of_the_pattern():
    for _, text, *_ in rows():
        assert [w.decode() for w in words(text)] == re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_packed_rows_come_back():
    a = np.sort(B.mix(np.arange(1000, dtype=np.uint64)))
    out = B.unpack(B.pack(name=a, pos=np.arange(1000, dtype=np.int32), none=np.zeros(0, np.int8)))
    assert (out["name"] == a).all() and (out["pos"] == np.arange(1000)).all() and len(out["none"]) == 0


@pytest.mark.parametrize("window", [5, 13])
def test_substring_dedup(docs, empty, window):
    first = {}
    for i, t, *_ in rows():
        w = words(t)
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    want = []
    for i, t, *_ in rows():
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for p in range(len(w) - window + 1):
                if first[tuple(w[p : p + window])] < i:
                    gone[p : p + window] = [True] * window
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    out = substring_dedup.dedup_substrings(docs, window)
    got = [tuple(r) for r in out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.dedup_substrings(empty, window).count() == 0


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(1)
    for kinds in (2, 5, 1000):
        h = B.mix(rnd.integers(0, kinds, 20000).astype(np.uint64) + np.uint64(9))
        doc = np.repeat(np.arange(10), 2000)
        starts = np.flatnonzero(doc[:-12] == doc[12:])
        symbols = substring_dedup.Symbols(h, doc)
        name = symbols.anchors(starts, 13)
        k1, k2 = symbols.names(starts, 13)
        held, spelt = {}, [{}, {}]
        for s, a, x, y in zip(starts, name, k1, k2):
            words = h[s : s + 13].tobytes()
            assert held.setdefault(words, a) == a
            # Names are made of symbols and tell windows apart.
            assert spelt[0].setdefault(x, words) == words and spelt[1].setdefault(y, words) == words
        assert len(spelt[0]) == len(held) == len(spelt[1])
    assert (name != 0).mean() > 0.9


def test_jaccard_components(docs, empty):
    sets, ids = [], []
    for i, t, *_ in rows():
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        ids.append(i)
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if ids[a] is not None and ids[b] is not None and o and 100 * o >= 75 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {x: min(i for i, y in zip(ids, label) if y == x and i is not None) for x, i in zip(label, ids) if i is not None}
    want = Counter((i, len(s), None if i is None else least[x]) for i, s, x in zip(ids, sets, label))
    for hubs in (1, 4):
        assert Counter(tuple(r) for r in jaccard_join.jaccard_components(docs, hubs=hubs).collect()) == want
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_quality_rules(docs, empty):
    want = Counter()
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        covered = {p + d for p in range(len(w) - 4) if seen[tuple(w[p : p + 5])] > 1 for d in range(5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed] += 1
    out = quality_rules.quality_rules(docs)
    assert Counter(tuple(r) for r in out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == want
    assert out.filter("base_failed and kept").count() == 0 and out.filter("kept").count() > 20
    assert quality_rules.quality_rules(empty).count() == 0


def test_posterior_equals_plain_em(spark, docs):
    """The EM over vote patterns in plain Python, over the votes that the operator returns."""
    import math

    big = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rules = list(quality_rules.votes())
    for table in (docs, big):
        got = quality_rules.quality_rules(table).collect()
        votes = Counter(tuple(r[c] for c in rules) for r in got)
        good, start = 0.85, (0.98, 0.7)
        prior, chance = good, [start] * len(rules)

        def posterior(v):
            odds = math.log(prior / (1 - prior))
            for x, (g, b) in zip(v, chance):
                odds += math.log(g / b) if x == 1 else math.log((1 - g) / (1 - b)) if x == -1 else 0
            return 1 / (1 + math.exp(-odds))

        for _ in range(quality_rules.STEPS):
            p = {v: posterior(v) for v in votes}
            was = (prior, chance)
            prior = (sum(votes[v] * p[v] for v in votes) + 2 * good) / (sum(votes.values()) + 2)
            chance = []
            for i in range(len(rules)):
                side = []
                for q, s in ((p, start[0]), ({v: 1 - x for v, x in p.items()}, start[1])):
                    up, any_ = (sum(votes[v] * q[v] for v in votes if v[i] in of) for of in ((1,), (1, -1)))
                    side.append((up + 10 * s) / (any_ + 10))
                chance.append(tuple(side))
            if abs(prior - was[0]) < 1e-5 and all(abs(x - y) < 1e-4 for c, d in zip(chance, was[1]) for x, y in zip(c, d)):
                break
        for r in got:
            want = posterior(tuple(r[c] for c in rules))
            assert abs(r.posterior - want) < 1e-9 and (abs(want - 0.5) < 1e-6 or r.kept == (not r.base_failed and want >= 0.5))


def test_mixing(docs, empty):
    got = mixing.mix(docs, [5.0, 2.0, 1.0]).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows())
    size = Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [5, 2, 1][n % 3] for n, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == size[s] and r.taken <= 2 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine)
    again = mixing.mix(docs.repartition(5), [5.0, 2.0, 1.0]).select("row.doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source))
    assert [(r.doc_id, r.taken) for r in sorted(got, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    assert mixing.mix(empty, [5.0, 2.0, 1.0]).count() == 0


def test_sampling_follows_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    weight = F.when(F.col("row.doc_id") % 2 == 0, 1.0).otherwise(0.25)
    out = mixing.mix(docs, [1.0], share=0.3, weight=weight)
    even = out.filter("copies = 1 and row.doc_id % 2 = 0").count()
    assert out.filter("copies = 1").count() == 1200 and even > 800


def test_the_cut_bin_is_refined_at_any_weight(spark):
    """Sources of low weight, budgets that end anywhere: the same rows whether one bin or many cuts settle the end."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id")).alias("text"), F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("source"))
    weight = F.when(F.col("row.source") == "x", 0.01).otherwise(1.0)
    taken = [sorted(r.row.doc_id for r in mixing.mix(docs, [1.0, 3.0], share=0.4, weight=weight, edge=e).filter("taken > 0").collect()) for e in (1, 20, 10**6)]
    assert taken[0] == taken[1] == taken[2] and abs(len(taken[0]) - 1200) <= 2
    rows = mixing.keyed(mixing.drawn(docs, weight))
    fullest = rows.groupBy("source", F.shiftright("es_log", 30).alias("bin")).count().agg(F.max("count")).first()[0]
    assert fullest < 20  # of 1500 in a source


def test_equal_rows_are_drawn_one_by_one(spark):
    docs = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d e f").alias("text"), F.lit("s").alias("source")).repartition(7)
    for f in (mixing.mix, mixing.mix_sizes):
        out = f(docs, [1.0], share=1.0 / 3.0)
        assert out.count() == 1000 and out.agg(F.sum("taken")).first()[0] == 1998
    out = mixing.mix(docs, [1.0], share=1.5)
    assert abs(out.agg(F.sum("taken")).first()[0] - 9000) <= 6 and out.agg(F.max("copies")).first()[0] == 2


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_sums_to_one_and_scores(docs, empty, order):
    out = F.crc32(F.col("row.doc_id").cast("string")) % 5 == 1
    got = kneser_ney.lm_scores(docs, out, order).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    p, score, train = plain.ngram_model([t for i, t, *_ in rows() if not held(i)], order)
    N, V = sum(train.values()), len(train)
    for a in (["start"] * (order - 1), ["start", b"ha"][-(order - 1) :], [b"ha"] * (order - 1), [b"w1", b"w3"][: order - 1], ["unseen"] * (order - 1)):
        assert abs(sum(p(*a, b) for b in train) + p(*a, "never") - 1) < 1e-9
    want = {}
    for i, t, *_ in rows():
        tok = [*(t or "").encode().lower().split(), "end"]
        want[i, t] = (held(i), len(tok), sum(train[x] > 0 for x in tok), sum(np.log10((train[x] + 0.5) / (N + 0.5 * (V + 1))) for x in tok), score(t)[0])
    assert len(got) == len(rows())
    for r in got:
        w = want[r.row.doc_id, r.row.text]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*w[:3], N)
        assert np.isclose(r.base_score, w[3], rtol=1e-9) and np.isclose(r.score, w[4], rtol=1e-9)
    assert kneser_ney.lm_scores(empty, out, order).count() == 0


def test_a_worker_maps_a_bounded_number_of_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(B, "bucket_count", lambda *a, **b: 40)
    meta = kneser_ney.train(docs.select("text"), 3)
    monkeypatch.setattr(kneser_ney, "MAPPED", 8)
    held = kneser_ney.Model(meta)
    t = kneser_ney.Tokens([(x or "").encode() for _, x, *_ in rows()], 3)
    few = held.log10(t)
    assert len(held.held) <= 8
    monkeypatch.setattr(kneser_ney, "MAPPED", 10**6)
    whole = kneser_ney.Model(meta)
    assert (whole.log10(t)[0] == few[0]).all() and len(whole.held) <= 120
    # Dealt in steps of three at most.
    assert (kneser_ney.Model(kneser_ney.train(docs.select("text"), 3, fan=3)).log10(t)[0] == few[0]).all()


def test_quality_classifier_rejects_noise(spark, docs, empty):
    rnd = random.Random(2)
    vocab = ["the", "of", "and", "to", "in", "is", "was", "for", "on", "as"] + [f"word{i}" for i in range(60)]
    good = [(i, " ".join(rnd.choice(vocab) for _ in range(80)), "en") for i in range(400)]
    bad = [(1000 + i, " ".join(f"{rnd.random()}%%" for _ in range(80)), "en") for i in range(20)]
    table = spark.createDataFrame([*good, *bad, (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good[:300]] + [(1000, 0), (None, 1)], "doc_id long, quality int")
    got = {r.row.doc_id: r.kept for r in quality_classifier.quality_classifier(table, labels).collect()}
    assert not any(got[i] for i, *_ in bad) and not got[None] and sum(got[i] for i, *_ in good) >= 395
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    assert quality_classifier.quality_classifier(docs, labels.filter("false")).filter("kept").count() > 0


def test_a_rare_language_has_its_own_threshold(spark):
    """More good labels than may be trained on, few of them French, whose words vary more."""
    rnd = random.Random(3)
    en = [(i, " ".join(f"e{rnd.randrange(20)}" for _ in range(30)), "en") for i in range(2000)]
    fr = [(5000 + i, " ".join(f"f{rnd.randrange(300)}" for _ in range(30)), "fr") for i in range(160)]
    few = [(9000 + i, " ".join(f"g{rnd.randrange(300)}" for _ in range(30)), "de") for i in range(20)]
    table = spark.createDataFrame([*en, *fr, *few], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in [*en, *fr, *few]], "doc_id long, quality int")
    got = quality_classifier.quality_classifier(table, labels, fit_rows=400).select("row.lang", "threshold", "kept").collect()
    limit = {r.lang: r.threshold for r in got}
    assert len({r.threshold for r in got if r.lang == "fr"}) == 1 and limit["fr"] > 2 * limit["en"]
    assert sum(r.kept for r in got if r.lang == "fr") >= 155
    q = quality_classifier._quantiles(spark.createDataFrame([("a", float(x)) for x in range(11)] + [("b", 0.5)], "lang string, log_perplexity double"), 0.93)
    assert {(r.lang, r.n, round(r.q, 9)) for r in q.collect()} == {("a", 11, 9.3), ("b", 1, 0.5)}
    # Of 100 ids to train on, half go to languages in turn.
    named, good = table.select(F.col("doc_id").alias("good_id"), "lang"), table.select(F.col("doc_id").alias("good_id"))
    took = Counter(r.lang for r in quality_classifier._sample(named, good, 100).join(named, "good_id").collect())
    assert sum(took.values()) == 100 and took["fr"] >= 18 and took["de"] >= 5


def test_toxicity(spark, empty):
    rnd = random.Random(4)
    vocab = [f"harmless{i}" for i in range(50)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    table = [(i, " ".join([*say(40), *(["grumpf"] if i % 4 == 0 else [])])) for i in range(400)]
    table += [(i, " ".join([*say(10), "grumpf", "cake"])) for i in range(401, 440, 2)]
    table += [(1000, "you GRUМPF!"), (1001, "gr.umpf grump f"), (1002, None), (None, "grumpf"), (1003, "a grumpf cake")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in table[:420]], "doc_id long, toxic int")
    got = {r.row.doc_id: r for r in toxicity.toxicity(docs, labels, F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i, _ in table[:420])
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and got[1002].predicted == 0 and got[None].predicted == 1 and got[1003].predicted == 0
    assert got[None].held_out is False and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.toxicity(empty, labels, F.lit(False)).count() == 0
    assert toxicity.toxicity(docs, labels.filter("toxic = 0"), F.lit(False)).filter("score > 0.01").count() == 0


def test_toxicity_equals_a_plain_version(spark):
    """Lexicon, exceptions, sums and scores worked out by hand; odd rows and columns on the way."""
    import math

    rnd = random.Random(9)
    vocab = [f"word{i}" for i in range(40)]
    table = []
    for i in range(300):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(3, 40))]
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = rnd.choice(["blargh", "Bl4rgh!", "zonkers", "zonked", "zonking"])
        elif i % 30 == 1:
            w += ["blargh", "pie"]
        table.append((i, " ".join(w)))
    # A repeated id (its least text is learned from), a very long text, nulls.
    table += [(0, "zzz later text"), (900, " ".join(rnd.choice(vocab) for _ in range(60000)) + " blargh"), (901, ""), (902, None), (None, "zonkers")]
    docs = spark.createDataFrame([(i, t, i, 1, 0.5) for i, t in table], "doc_id long, text string, label_id long, toxic int, score double").repartition(3)
    label = {i: int(i % 3 == 0) for i in range(300)}
    labels = spark.createDataFrame([*label.items(), (7, 0), (8888, 1)], "doc_id long, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    least = {}
    for i, t in table:
        if i in label and not held(i):
            least[i] = min(least.get(i, t), t)
    n1 = sum(label[i] for i in least)
    n0 = len(least) - n1
    a, b = Counter(), Counter()
    for i, t in least.items():
        (a if label[i] else b).update(toxicity.features(toxicity.fold(t)))
    top = {}
    for f in {*a, *b}:
        x, y = a[f], b[f]
        share = n1 / (n1 + n0)
        ratio = 2 * sum(c * math.log(c / ((x + y) * s)) for c, s in ((x, share), (y, 1 - share)) if c)
        if x / (x + y) >= toxicity.PRECISION and ratio >= toxicity.RATIO:
            top[f] = math.log((x + 0.5) / (n1 + 1)) - math.log((y + 0.5) / (n0 + 1))
    words_ = [f for f in top if f.endswith(" ")]
    top = {f: w for f, w in top.items() if f.endswith(" ") or max([a[x] for x in words_ if x.startswith(f)], default=0) < toxicity.ONE_WORD * a[f]}
    lexicon = {f: w for f, w in top.items() if not any(f != g and not g.endswith(" ") and f.startswith(g) for g in top)}
    assert any("zonk" in f for f in lexicon) and any("blargh" in f for f in lexicon)
    sample = spark.createDataFrame([(t, label[i]) for i, t in least.items()], "text string, toxic int")
    entries, exceptions, coefficients = toxicity.fit(sample)
    assert set(entries) == set(lexicon) and all(abs(entries[f] - lexicon[f]) < 1e-9 for f in lexicon)

    def matches(text):
        t = toxicity.fold(text).split()
        for p, w in enumerate(t):
            for f, weight in lexicon.items():
                if f == f" {w} " or (not f.endswith(" ") and f" {w}".startswith(f)):
                    yield weight, " ".join(t[max(0, p - 1) : p + 1]), " ".join(t[p : p + 2])

    phrase = {}
    for i, t in least.items():
        for p in {x for _, *ps in matches(t) for x in ps if " " in x}:
            phrase.setdefault(p, []).append(label[i])
    assert exceptions == {p for p, ls in phrase.items() if not any(ls) and len(ls) >= 3}

    def measure(text):
        kept = [w for w, p, q in matches(text) if p not in exceptions and q not in exceptions]
        return sum(kept), 100 * sum(kept) / max(1, len(toxicity.fold(text).split())), len(kept)

    # The coefficients are where the penalised likelihood is flat.
    x = np.array([[1, math.log1p(m[0]), math.log1p(m[1])] for m in map(measure, least.values())])
    y = np.array([label[i] for i in least])
    w = np.array(coefficients)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-2 * w).max() < 1e-6
    got = toxicity.toxicity(docs, labels, F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0).collect()
    assert len(got) == len(table)
    for r in got:
        total, density, n = measure(r.row.text or "")
        score = 1 / (1 + math.exp(-(w[0] + w[1] * math.log1p(total) + w[2] * math.log1p(density))))
        assert r.n_matches == n and abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.5)
        assert r.held_out == (r.row.doc_id is not None and held(r.row.doc_id))


def test_folding():
    assert toxicity.fold("1D1OT") == " idiot " and toxicity.fold("ｍoron") == " moron " and toxicity.fold("іdiot") == " idiot "
    assert toxicity.fold("") == "  " and toxicity.fold("a, b") == " a b "


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer, models

    pieces = token_counts.sentencepiece_vocabulary(PIECES)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=True))
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, PIECES).collect())
    assert got == Counter((i, len(library.encode((t or "").replace(" ", token_counts.MARK), add_special_tokens=False).ids)) for i, t, *_ in rows())
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_viterbi_ties():
    c = token_counts.UnigramCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("ba", -2.0)])
    assert c("ab") == 1 and c("aab") == 2 and c("zz") == 1 and c("azb") == 3


def test_nearest(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1500, 16))
    x[7] = x[100]
    table = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    table += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] + [1.0] * 15), (5200, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    x = np.array(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = nearest.nearest(df, every=50, k=5, block=400).collect()
    assert len(got) == 150
    hit = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -9
        best = set(np.lexsort((np.arange(1500), -s))[:5].tolist())
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hit += len(best & {r.vec_id for r in mine})
    assert hit / 150 >= 0.9
    few = nearest.nearest(df.filter("vec_id < 4"), every=50, k=5).orderBy("rank").collect()
    assert [r.query_id for r in few] == [0, 0, 0]
    assert nearest.nearest(df.filter("false")).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = Counter()
    for i, text, *_ in rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 256):
            want[i, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)] += 1
    got = packing.pack_documents(docs, BPE, size=256).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 256 and sum(held.values()) / (256 * len(held)) > 0.95
    assert packing.pack_documents(empty, BPE).count() == 0


def test_equal_remainders_spread_over_all_shards(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, "long " * 700) for i in range(20)], "doc_id long, text string"))
    got = packing.pack_documents(docs, BPE, size=64, shard=50).collect()
    small = [r.sequence_id for r in got if r.length < 64]
    assert len(small) == 520 and len({i % 11 for i in small}) == 11 and max(Counter(i % 11 for i in small).values()) < 100
    whole = [r for r in got if r.length == 64]
    assert len(whole) > 100 and len({r.sequence_id for r in whole}) == len(whole) and all(r.offset == 0 and r.sequence_id >= packing.FULL for r in whole)


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(1)
    lengths = sorted((rnd.randint(1, 100) for _ in range(500)), reverse=True)
    window, offset = packing.best_fit(np.array(lengths), 100)
    left = []
    for n, w, o in zip(lengths, window, offset):
        fits = [room for room in left if room >= n]
        if fits:
            assert left[w] == min(fits)
        else:
            assert w == len(left)
            left.append(100)
        assert o == 100 - left[w]
        left[w] -= n


def test_word_encoder_gives_the_tokenizer_s_ids():
    from tokenizers import Tokenizer

    whole, words, rnd = Tokenizer.from_file(BPE), packing.encoder(BPE), random.Random(9)
    letters = [" ", "\n", "a", "B", "é", "ж", "中", "ʼ", "'", "s", "7", "٣", "ա", "ͅ", "ª", "̈", ".", "😀", "\t", "\x1c", "\x85", " ", "　", "​", "<|endoftext|>"]
    for i in range(4000):
        text = "".join(rnd.choices(letters[: rnd.choice([6, 18, 25])], k=rnd.randint(0, 16)))
        assert words(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
