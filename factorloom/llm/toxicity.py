"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs and wide forms to plain letters,
digits and signs inside words to the letters they stand for, everything else to
spaces.  The lexicon is learned from a bounded sample of labelled rows: words
and word beginnings that are much more frequent in toxic texts, by likelihood
ratio, each weighing its log odds.  Phrases of a lexicon word and a neighbour
that only harmless texts use become exceptions, and their matches don't count.
The sum of weights and its density per word go through a logistic curve, fitted
on the same sample.

The sample takes the rows with the least hash of their id, up to ``fit_rows``:
a parameter and the only bound; lexicon and exceptions hold all that it bears
out.  Every text is scored whole, however long.

Defined results: a null or empty text has no match and the score of that; a null
id is never in the sample and not held out; labels for one id that disagree
count as toxic; of rows that repeat an id the least text is learned from;
without toxic labels every score is 0; rows are judged one by one, a score of
exactly 0.5 as toxic; an empty table gives an empty result; further columns stay
in ``row``, so their names may clash.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

FIT_ROWS = 20_000
#: Least likelihood ratio of an entry, least share of toxic texts among its texts,
#: share of a beginning's toxic texts from which one word stands for it.
RATIO, PRECISION, ONE_WORD = 25.0, 0.75, 0.8
#: Cyrillic and Greek letters that look like Latin ones, and what digits and signs stand for inside words.
_LOOKALIKES = dict(zip("асеорхуіјѕԁһӏԛԝвкмнтαεικνορτυχѵɑɡıοⅼ", "aceopxyijsdhlqwbkmhtaeiknoptuxvagiol"))
_STANDS_FOR = dict(zip("013457@$", "oieastas"))


class _Fold(dict):
    """A translation table that decides on a character when it first meets it."""

    def __missing__(self, code: int):
        c = chr(code)
        plain = "".join(_LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c).lower())
        kept = "".join(x for x in plain if x.isalpha() or x.isdigit() or unicodedata.combining(x))
        out = kept or ("" if unicodedata.category(c) in ("Cf", "Mn") else c if c in "@$" else " ")
        self[code] = out
        return out


_fold = _Fold()
_ODD = re.compile(r"\S*[013457@$]\S*")


def _plain(token: re.Match) -> str:
    """A word with digits or signs: read as letters if at least half of it are letters."""
    word = token[0].strip("@$")
    if 2 * sum(c.isalpha() for c in word) >= len(word):
        word = "".join(_STANDS_FOR.get(c, c) for c in word)
    return word.replace("@", " ").replace("$", " ")


def fold(text: str) -> str:
    """The folded text with a space at both ends."""
    out = text.lower().translate(_fold)
    out = _ODD.sub(_plain, out)
    return " " + " ".join(out.split()) + " "


def features(folded: str) -> set[str]:
    """Words (between spaces) and word beginnings of 4 to 8 characters of a folded text."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:i]}" for i in range(4, min(8, len(w) - 1) + 1))
    return out


def _feature_rows(batches):
    for batch in B.blocks(batches):
        for text, toxic in zip(B.column(batch, "text").to_pylist(), B.column(batch, "toxic").to_pylist()):
            f = sorted(features(fold(text or "")))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array([toxic] * len(f), pa.int32())], names=["feature", "toxic"])


def lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries and weights from a bounded table (text, toxic): as many as the sample bears out."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    a, b = F.col("a"), F.col("b")
    share = n1 / (n1 + n0)
    counted = sample.mapInArrow(B.tidied(_feature_rows), "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    ratio = 2.0 * (log(a, (a + b) * share) + log(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    top = counted.filter((a / (a + b) >= PRECISION) & (ratio >= RATIO)).select("feature", odds.alias("weight"), ratio.alias("ratio"), "a")
    rows = top.orderBy(F.desc("ratio"), "feature").collect()
    # A beginning that is nearly always the same word says no more than that word.
    most: dict[str, float] = {}
    for r in rows:
        if r["feature"][-1] == " ":
            for i in range(5, min(9, len(r["feature"]) - 1)):
                most[r["feature"][:i]] = max(most.get(r["feature"][:i], 0), r["a"])
    found = {r["feature"]: r["weight"] for r in rows if r["feature"][-1] == " " or most.get(r["feature"], 0) < ONE_WORD * r["a"]}
    # An entry whose beginning is one already would only count its match again.
    begins = {f for f in found if f[-1] != " "}
    return {f: w for f, w in found.items() if not any(f[:i] in begins for i in range(5, len(f.rstrip()) + (f[-1] == " ")))}


class Matcher:
    def __init__(self, entries: dict[str, float], exceptions: set[str]):
        import ahocorasick

        self.find, self.exceptions = ahocorasick.Automaton(), exceptions
        for f, w in entries.items():
            self.find.add_word(f, (len(f), w))
        if entries:
            self.find.make_automaton()
        self.empty = not entries

    def hits(self, folded: str) -> list[tuple[float, str, str]]:
        """(weight, phrase with the word before, phrase with the word after) of the matches."""
        out = []
        if self.empty:
            return out
        for last, (size, weight) in self.find.iter(folded):
            start = last + 1 - size
            end = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start) + 1
            after = folded.find(" ", end + 1)
            out.append((weight, folded[before:end], folded[start + 1 : after if after > 0 else end]))
        return out

    def measure(self, text: str) -> tuple[float, float, int]:
        """(sum of weights, weights per 100 words, matches) of a text, exceptions left out."""
        folded = fold(text)
        kept = [w for w, p, q in self.hits(folded) if p not in self.exceptions and q not in self.exceptions]
        return sum(kept), 100 * sum(kept) / max(1, folded.count(" ") - 1), len(kept)


def _inputs(total, density) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(np.asarray(total, float)), np.log1p(np.asarray(density, float))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; matches never speak for a harmless text."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _measures(entries, exceptions):
    def run(batches):
        matcher = Matcher(entries, exceptions)
        for batch in B.blocks(batches):
            m = [matcher.measure(x or "") for x in B.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [B.column(batch, "row"), pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64()), pa.array([x[2] for x in m], pa.int64())], names=["row", "total", "density", "n_matches"]
            )

    return run


def _phrases(entries):
    def run(batches):
        matcher = Matcher(entries, set())
        for batch in B.blocks(batches):
            for text, toxic in zip(B.column(batch, "text").to_pylist(), B.column(batch, "toxic").to_pylist()):
                held = sorted({x for _, p, q in matcher.hits(fold(text or "")) for x in (p, q) if " " in x})
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([toxic] * len(held), pa.int32())], names=["phrase", "toxic"])

    return run


def measures(rows: DataFrame, entries: dict[str, float], exceptions: set[str]) -> DataFrame:
    kind = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "text").mapInArrow(B.tidied(_measures(entries, exceptions)), f"row {kind}, total double, density double, n_matches long")


def fit(sample: DataFrame) -> tuple[dict[str, float], set[str], list[float]]:
    """(lexicon, exceptions, coefficients) from a bounded table (text, toxic)."""
    entries = lexicon(sample)
    if not entries:
        return {}, set(), [-30.0, 0.0, 0.0]
    phrases = sample.mapInArrow(B.tidied(_phrases(entries)), "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    exceptions = {r["phrase"] for r in phrases.filter("a = 0 and n >= 3").select("phrase").collect()}
    got = measures(sample.select(F.struct("toxic").alias("row"), "text"), entries, exceptions).select("row.toxic", "total", "density").collect()
    x = _inputs([r["total"] for r in got], [r["density"] for r in got])
    return entries, exceptions, [float(v) for v in logistic(x, np.array([r["toxic"] for r in got], float))]


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``row`` with ``held_out`` (a condition over ``row``), ``n_matches``, ``score`` and ``predicted``."""
    spark = docs.sparkSession
    B.bounded_batches(spark)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    out = F.coalesce(held_out, F.lit(False))
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.select(F.struct(F.col("label_id").alias("doc_id")).alias("row"), "label_id", "toxic").filter(~out).drop("row")
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows)
    # The list has at most fit_rows ids, and so has the sample: of rows that repeat an id the least text counts.
    sample = rows.join(F.broadcast(known), F.col("row.doc_id").cast("long") == F.col("label_id")).groupBy("label_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = B.written(sample.select("text", "toxic"), "toxic-sample")
    entries, exceptions, w = fit(sample)
    B.discard(sample)
    logit = F.lit(w[0]) + w[1] * F.log1p("total") + w[2] * F.log1p("density")
    scored = measures(rows, entries, exceptions).withColumn("score", 1.0 / (1.0 + F.exp(-logit)))
    return scored.select("row", out.alias("held_out"), "n_matches", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
