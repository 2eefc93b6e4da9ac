"""Quality rules by weak supervision, in DataFrame functions only.

Rules look at a text and vote good (+1), bad (-1) or abstain (0).  All that
expectation-maximisation needs is how many documents share each vote pattern,
so documents are reduced to at most 3^rules patterns by one aggregation.  The
EM steps run over that table: each rule has a chance of voting and, by class, a
chance of voting good, both estimated; the posterior of each pattern follows.
A document is kept if its posterior reaches the threshold, so one odd sign does
not reject a text that all other rules speak for.

Repeated windows are found inside a text without exploding it: words are hashed
once, five shifted copies of the hashes are zipped and hashed again; only texts
whose hashes are not all distinct sort them with their positions, and neighbours
in that order mark repeats.

Defined results: a null or empty text has zero counts and fails the base rule
(fewer than ten words); rows are judged one by one, so repeated rows and null
ids don't matter; very long texts are looked at whole; a posterior equal to the
threshold keeps a text; an empty table gives an empty result; further columns
are ignored, so their names may clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

_SIGNS = "#*$%&|<>"
#: EM steps; the change of a step is below 1e-4 long before.
STEPS = 25


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _windows(hashes: Column, size: int) -> Column:
    """Hashes of the windows of ``size`` words, from the words' hashes."""
    n = F.greatest(F.array_size(hashes) - (size - 1), F.lit(0))
    return F.transform(F.arrays_zip(*[F.slice(hashes, F.lit(i + 1), n).alias(f"w{i}") for i in range(size)]), lambda w: F.xxhash64(w))


def measured(docs: DataFrame) -> DataFrame:
    """``row`` with the counts that rules look at."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = rows.select("row", F.regexp_extract_all(text, F.lit(f"({B.WORD})"), F.lit(1)).alias("words"), F.split(text, "\n", -1).alias("lines"), text.alias("text"))
    signs = F.length("text") - F.length(F.translate("text", _SIGNS, ""))
    rows = rows.withColumns(
        {
            "n_words": F.array_size("words").cast("long"),
            "n_chars": F.length("text").cast("long"),
            "word_chars": (F.length("text") - spaces_of("text")).cast("long"),
            "n_symbols": signs.cast("long"),
            "n_upper": (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
            "n_bangs": (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).cast("long"),
            "n_marks": F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\p{N}\s]")).cast("long"),
            "n_runs": F.regexp_count("text", F.lit(r"([^\p{L}\p{N}\s])\1+|(?<!\S)[#*$%&|<>](?!\S)")).cast("long"),
            "n_lines": F.array_size("lines").cast("long"),
            "lines": F.filter("lines", lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.array_size("lines") - F.array_size(F.array_distinct("lines"))).cast("long"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    covered = _let(hashes, lambda h: _let(_windows(h, 5), lambda w: _covered(w, 5)))
    return rows.withColumn("n_repeat_words", covered).drop("words", "lines", "text")


def spaces_of(name: str) -> Column:
    return F.length(name) - F.length(F.translate(name, " \t\n\x0b\x0c\r", ""))


def _covered(windows: Column, size: int) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def places(placed: Column) -> Column:
        # A window repeats if its hash is that of its neighbour in the sorted order.
        pairs = F.filter(F.arrays_zip(placed.alias("a"), F.slice(placed, F.lit(2), F.array_size(placed)).alias("b")), lambda z: z["a"]["h"] == z["b"]["h"])
        return F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))

    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    first = F.struct(F.lit(0).alias("sum"), F.lit(-1_000_000).alias("last"))
    gaps = F.aggregate(_let(placed, places), first, lambda s, x: F.struct((s["sum"] + F.least(F.lit(size), x - s["last"])).alias("sum"), x.alias("last")), lambda s: s["sum"])
    return F.when(F.array_size(F.array_distinct(windows)) < F.array_size(windows), gaps).otherwise(F.lit(0)).cast("long")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules' votes over the columns of :func:`measured`; each leaves a band in which it abstains."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "length": _vote(F.col("n_words") >= 20, F.col("n_words") < 10),
        "word_size": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(F.col("n_symbols") * 50 <= words, F.col("n_symbols") * 5 > words),
        "upper": _vote(F.col("n_upper") * 5 <= chars, F.col("n_upper") * 2 > chars),
        "bangs": _vote(F.col("n_bangs") * 50 <= words, F.col("n_bangs") * 5 > words),
        "marks": _vote(F.col("n_marks") * 4 <= words, F.col("n_marks") * 5 > 4 * words),
        "runs": _vote(F.col("n_runs") * 50 <= words, F.col("n_runs") * 4 > words),
        "lines": _vote(F.col("n_dup_lines") * 10 <= F.col("n_lines"), F.col("n_dup_lines") * 10 > 3 * F.col("n_lines")),
        "repeats": _vote(F.col("n_repeat_words") * 20 <= words, F.col("n_repeat_words") * 10 > 2 * words),
    }


def posterior(patterns: DataFrame, rules: list[str], steps: int = STEPS, good: float = 0.85, start: tuple[float, float] = (0.98, 0.7), weight: float = 10.0) -> Column:
    """EM over the table of vote patterns (rules' columns and ``docs``): the posterior as an expression of the votes.

    ``start`` holds the first chances that a vote is good in good and in bad
    documents: a bad vote says more than a good one, as bad documents pass most
    rules.  Both get ``weight`` pseudo-votes, so a rule that never votes keeps
    them and no chance reaches 0 or 1; nothing else bounds the estimates.
    """
    prior = good
    chance = dict.fromkeys(rules, start)

    def expression() -> Column:
        odds = F.lit(math.log(prior / (1 - prior)))
        for r in rules:
            a, b = chance[r]
            odds = odds + F.when(F.col(r) == 1, F.lit(math.log(a / b))).when(F.col(r) == -1, F.lit(math.log((1 - a) / (1 - b)))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-odds))

    for _ in range(steps):
        p = expression()
        sums = {"n": F.sum("docs"), "g": F.sum(F.col("docs") * p)}
        for r in rules:
            for side, w in (("g", p), ("b", 1.0 - p)):
                sums[f"{r}_{side}_up"] = F.sum(F.when(F.col(r) == 1, F.col("docs") * w).otherwise(0.0))
                sums[f"{r}_{side}_any"] = F.sum(F.when(F.col(r) != 0, F.col("docs") * w).otherwise(0.0))
        got = patterns.agg(*[v.alias(k) for k, v in sums.items()]).first()
        if not got["n"]:
            break
        was = (prior, dict(chance))
        prior = (got["g"] + 2 * good) / (got["n"] + 2)
        for r in rules:
            a = (got[f"{r}_g_up"] + weight * start[0]) / (got[f"{r}_g_any"] + weight)
            b = (got[f"{r}_b_up"] + weight * start[1]) / (got[f"{r}_b_any"] + weight)
            chance[r] = (a, b)
        if abs(prior - was[0]) < 1e-5 and all(abs(chance[r][0] - was[1][r][0]) < 1e-4 and abs(chance[r][1] - was[1][r][1]) < 1e-4 for r in rules):
            break
    return expression()


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id with the counts, votes, ``base_failed``, ``posterior`` and ``kept``, one row for each input row."""
    rules = list(votes())
    rows = measured(docs).withColumns(votes())
    rows = B.written(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *rules), "votes")
    patterns = B.written(rows.groupBy(*rules).agg(F.count("*").cast("double").alias("docs")), "patterns", coalesce=1)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.withColumn("base_failed", failed).withColumn("posterior", posterior(patterns, rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
