"""The pipeline's stages in plain Python, for small tables of (doc_id, text, lang, source, n_chars) rows."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from factorloom.llm import packing, quality_classifier


def words(text):
    return (text or "").encode().split()


def spark_hash(*values, first=None):
    """Spark's xxhash64 of an int literal ``first``, if given, then longs and strings: each hash is the next one's seed; null changes nothing."""
    h = 42 if first is None else xxhash.xxh64_intdigest(struct.pack("<i", first), seed=42)
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def discounts(counts):
    """The three discounts of modified Kneser-Ney from the counts of one order, by their textbook formula."""
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else y
    d2 = 2 - 3 * y * n3 / n2 if n2 else 2 * y
    d3 = 3 - 4 * y * n4 / n3 if n3 else 3 * y
    return [0, min(max(d1, 0.05), 0.95), min(max(d2, 0.05), 1.95), min(max(d3, 0.05), 2.95)]


def ngram_model(texts, order):
    """Probability of a word after others, and log10 probability and tokens of a text, as functions; the training tokens' counts."""
    split = lambda t: [*(t or "").encode().lower().split(), "end"]
    raw = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["start"] * (order - 1) + split(t)
        for i in range(order - 1, len(w)):
            for m in range(1, order + 1):
                raw[m][tuple(w[i - m + 1 : i + 1])] += 1
    # Lower orders count the distinct words before, unless a text's start leaves none.
    adj = [None] * (order + 1)
    adj[order] = raw[order]
    for m in range(order - 1, 0, -1):
        cont = Counter(g[1:] for g in adj[m + 1])
        adj[m] = Counter({g: raw[m][g] if m > 1 and g[0] == "start" else cont[g] for g in raw[m]})
    d = [None, *[discounts(adj[m].values()) for m in range(1, order + 1)]]
    total, rest = defaultdict(int), defaultdict(float)
    for m in range(1, order + 1):
        for g, c in adj[m].items():
            total[m, g[:-1]] += c
            rest[m, g[:-1]] += d[m][min(c, 3)]
    words_ = len(raw[1])

    def p(*gram):
        m = len(gram)
        if m == 0:
            return 1 / (words_ + 1)
        context = (m, gram[:-1])
        if not total.get(context):
            return p(*gram[1:])
        c = adj[m].get(gram, 0)
        return (max(c - d[m][min(c, 3)], 0) + rest[context] * p(*gram[1:])) / total[context]

    def score(text):
        w = ["start"] * (order - 1) + split(text)
        n = len(w) - order + 1
        return (sum(math.log10(p(*w[i : i + order])) for i in range(n)) if words_ else 0.0), n

    return p, score, Counter({g[0]: c for g, c in raw[1].items()})


def quality(docs, labels):
    good = sorted({i for i, q, _ in labels if q == 1 and i is not None}, key=lambda i: (signed(spark_hash(i)), i))[: quality_classifier.FIT_ROWS]
    part = {i: signed(spark_hash(i, first=5)) % 4 for i in good}
    _, score, _ = ngram_model([t for i, t, *_ in docs if part.get(i, 9) < 2], 3)
    own, seen = defaultdict(list), []
    for i, t, lang, *_ in docs:
        if part.get(i, 0) >= 2:
            s, n = score(t)
            if n > 1:
                own[lang].append(-s / n)
                seen.append(-s / n)
    limit = lambda x: np.quantile(x, quality_classifier.QUANTILE) + quality_classifier.SLACK
    every = limit(seen) if seen else math.inf
    limits = {k: limit(v) for k, v in own.items() if k is not None and len(v) >= quality_classifier.LEAST}
    out = []
    for r in docs:
        s, n = score(r[1])
        if n > 1 and -s / n <= limits.get(r[2], every):
            out.append(r)
    return out


def near_duplicates(docs, labels):
    sets = []
    for _, t, *_ in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if docs[a][0] is not None and docs[b][0] is not None and o and 100 * o >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for r, x in zip(docs, label):
        if r[0] is not None:
            least[x] = min(least.get(x, r[0]), r[0])
    return [r for r, x in zip(docs, label) if r[0] is None or r[0] == least[x]]


def substrings(docs, labels, window=13):
    first = {}
    for i, t, *_ in docs:
        w = words(t)
        for p in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for r in docs:
        w = words(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if r[0] is not None else 0):
            if first[tuple(w[p : p + window])] < r[0]:
                gone[p : p + window] = [True] * window
        if not any(gone):
            out.append(r)
        elif not all(gone):
            text = b" ".join(x for x, g in zip(w, gone) if not g).decode()
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def mixture(docs, labels, weights=(5.0, 2.0, 1.0)):
    size = [len(words(r[1])) for r in docs]
    by = Counter()
    for r, n in zip(docs, size):
        by[r[3]] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[n % 3] for n, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(by.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * by[s]
            left -= target[s]
        open_ -= over
    out = []
    for s in order:
        full = int(target[s] // by[s]) if by[s] else 0
        rest, keyed = target[s] - full * by[s], []
        for r, n in zip(docs, size):
            if r[3] == s and n:
                signs = sum(c in "#*$%&|<>{}[]=\\^~!" for c in r[1])
                u = ((spark_hash(r[0], r[1], r[3], first=17) >> 11) + 0.5) / (1 << 53)
                keyed.append((-math.log(u) / max(0.01, 1 - 4 * signs / max(len(r[1]), 1)), n, r))
        keyed.sort(key=lambda k: k[0])
        upto = {}
        total = 0
        for k, n, _ in keyed:
            total += n
            upto[k] = total
        last = max((k for k, n, _ in keyed if upto[k] - n / 2 <= rest), default=-1)
        for k, _, r in keyed:
            out += [r] * (full + (k <= last))
    return out


def pieces(docs, path, size=2048):
    """(doc_id, start, length, ids_crc32, doc_tokens) and how often, by the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(path), Counter()
    for i, text, *_ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), size):
            out[i, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes()), len(ids)] += 1
    return out


def sequences(lengths, size=2048):
    """Sequences of best-fit decreasing over one shard."""
    assert len(lengths) <= packing.SHARD
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(left) if room >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(size - n)
    return len(left)
